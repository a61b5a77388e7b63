"""Repeated-passage removal: blockwise suffix sorting with a difference cover.

Every string of LENGTH bytes is put in the bucket of its anchor, the LETTERS
bytes inside it whose fingerprint is least, so equal strings share a bucket and
a bucket of one string needs no sorting.  A bucket too large for a block is cut
by the bytes around its anchor, as a radix step of the sort, until its parts
fit.  Buckets whose strings may repeat are sorted a block of buckets at a time.
Suffixes are first told apart by what stands at either end of the string; the
ties that are left are resolved by ranks of a difference cover of the block's
places, made beforehand: whichever two suffixes tie, some shift under COVER
takes both to ranked places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.common import Scratch, by_size, mix64

LENGTH, LETTERS = 400, 50
SPAN = LENGTH - LETTERS + 1
#: A perfect difference set: every difference modulo COVER is one of two members.
COVER, MEMBERS = 57, (0, 1, 3, 13, 32, 36, 43, 52)
EDGE = 64
SEGMENT = 2_000_000
#: Bytes sorted at a time, and the contexts above which a bucket is cut once more before it is sorted.
BLOCK_BYTES, MOST_CONTEXTS = 1_000_000, 2_000
FEW = 500
STEP = np.uint64(0x9E3779B97F4A7C15)


def grams(flat: np.ndarray, letters: int = LETTERS) -> np.ndarray:
    """Fingerprints of the `letters` bytes at every place from which so many can be read, joined of ever longer parts."""
    padded = np.concatenate([flat, np.zeros(8, np.uint8)]).astype(np.uint64)
    h, size = np.zeros(len(flat), np.uint64), 8
    for j in range(8):
        h |= padded[j : j + len(flat)] << np.uint64(8 * j)
    h = mix64(h)[: len(flat) - 7]
    while size < letters:
        shift = min(size, letters - size)
        h = mix64(h[: len(h) - shift] * STEP + h[shift:])
        size += shift
    return h


def digest(*parts) -> tuple[int, int]:
    """128 bits of a cryptographic hash, as two signed longs; parts are bytes or small numbers."""
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(p.to_bytes(8, "little") if isinstance(p, int) else p)
    d = h.digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of texts of at most SEGMENT bytes or so: text index, place of the anchor, first and last start of the strings it serves, the anchor's fingerprint and two halves of the context's digest.

    The context is all that those strings cover.
    """
    size = np.array([len(t) for t in texts], np.int64)
    whole = b"".join(texts)
    flat = np.frombuffer(whole, np.uint8)
    end = np.cumsum(size)
    n = len(flat)
    if not (size >= LENGTH).any():
        return tuple(np.empty(0, np.int64) for _ in range(4)) + tuple(np.empty(0, np.int64) for _ in range(3))
    found = grams(flat)
    low = np.uint64((1 << 24) - 1)
    m = len(found)
    full = -(-m // SPAN) * SPAN
    packed = np.full(full, np.uint64(2**64 - 1))
    packed[:m] = (found & ~low) | np.arange(m, dtype=np.uint64)
    rows = packed.reshape(-1, SPAN)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[: n - LENGTH + 1], ahead[SPAN - 1 : SPAN - 1 + n - LENGTH + 1])
    place = (least & low).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), size)[: n - LENGTH + 1]
    starts = np.flatnonzero(end[owner] - np.arange(n - LENGTH + 1) >= LENGTH)
    place, owner = place[starts], owner[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, place, owner = starts[first], starts[last], place[first], owner[first]
    view, blake = memoryview(whole), hashlib.blake2b
    # what is before the anchor and how many strings there are tells contexts of one content apart
    names = [blake(view[a : b + LENGTH], digest_size=16, salt=(p - a).to_bytes(8, "little")).digest() for a, b, p in zip(lo.tolist(), hi.tolist(), place.tolist())]
    context = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
    begin = (end - size)[owner]
    return owner, place - begin, lo - begin, hi - begin, found[place].view(np.int64), context[:, 0], context[:, 1]


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[list, list, list]]:
    """Ids, offsets and bytes; a very long text comes in overlapping parts that share no start of a string."""
    for own, part in by_size(batch, SEGMENT):
        cut = [(i, a, t[a : a + SEGMENT + LENGTH - 1]) for i, t in zip(own, part) if t for a in range(0, max(1, len(t) - LENGTH + 1), SEGMENT)]
        while cut:
            take, size = 0, 0
            while take < len(cut) and (not take or size + len(cut[take][2]) <= SEGMENT):
                size += len(cut[take][2])
                take += 1
            yield tuple(list(c) for c in zip(*cut[:take]))
            cut = cut[take:]


def once_a_text(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row for each context of a text, the first: its index, how many times the text has it, and the spans these cover together.

    Spans are given for contexts that a text has several times, and joined where
    they overlap: as bounds of each row's spans, starts and ends.
    """
    order = np.lexsort((lo, c1, c0, owner))
    a, b = lo[order], hi[order] + LENGTH
    new = np.ones(len(order), bool)
    new[1:] = False
    for key in (owner, c0, c1):
        new[1:] |= key[order][1:] != key[order][:-1]
    first = np.flatnonzero(new)
    times = np.diff(first, append=len(order))
    start = new.copy()
    start[1:] |= a[1:] > b[:-1]
    run = np.flatnonzero(start)
    last = np.flatnonzero(np.append(start[1:], len(order) > 0))
    row = (np.cumsum(new) - 1)[run]
    several = times[row] > 1
    bounds = np.append(0, np.cumsum(np.bincount(row[several], minlength=len(first))))
    return order[first], times, bounds, a[run[several]], b[last[several]]


FOUND = "g long, c0 long, c1 long, id long, lo long, hi long, at long, times long, inside array<struct<a: long, b: long>>"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["g", "c0", "c1", "id", "lo", "hi", "at", "times", "inside"]
    for batch in batches:
        for ids, offsets, texts in _segments(batch):
            owner, place, lo, hi, gram, c0, c1 = anchors(texts)
            at = np.array(offsets, np.int64)[owner]
            lo, hi, place = lo + at, hi + at, place + at
            one, times, bounds, a, b = once_a_text(owner, lo, hi, c0, c1)
            columns = [pa.array(np.ascontiguousarray(c[one])) for c in (gram, c0, c1, np.array(ids, np.int64)[owner], lo, hi, place)]
            inside = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(times, pa.int64()), inside], names=names)


def _ranks(keys: np.ndarray) -> np.ndarray:
    """The rank of every key among the distinct ones."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _twice(keys: np.ndarray) -> np.ndarray:
    r = _ranks(keys)
    return np.bincount(r)[r] > 1 if len(r) else np.zeros(0, bool)


def repeated_strings(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the LENGTH-byte strings at starts equal another of them.

    Ranks are of actual bytes, by doubling: 8, 16, 32 and 64 bytes at every
    place, and 57, 114, 228 and 342 bytes at the cover's places only, which are
    closed under steps of COVER.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    r = np.zeros(n, np.uint64)
    for j in range(8):
        r |= padded[j : j + n] << np.uint64(56 - 8 * j)
    r, step = _ranks(r), 8

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _ranks(a * np.int64(n + 1) + b)

    while step < EDGE:
        if step == 32:
            r32 = r
        r = joined(r[: len(r) - step], r[step:])
        step *= 2
    ends = r[starts] * np.int64(n + 1) + r[starts + LENGTH - EDGE]
    ends = _ranks(ends)
    tied = np.flatnonzero(np.bincount(ends)[ends] > 1)
    out = np.zeros(len(starts), bool)
    if not len(tied):
        return out
    inside = np.zeros(COVER, bool)
    inside[list(MEMBERS)] = True
    # places of the cover from which 342 bytes can be read; `at` is a place's index among them
    place = np.flatnonzero(inside[np.arange(n - 57 + 1) % COVER])
    at = np.full(n + 1, -1, np.int64)
    at[place] = np.arange(len(place))
    rank = joined(r32[place], r32[place + 25])
    short = rank
    for shift, width in ((57, 114), (114, 228), (228, 342)):
        own = place <= n - width
        place = place[own]
        other = short if shift < 228 else half
        rank = joined(rank[: len(place)], other[at[place + shift]])
        if width == 114:
            half = rank
        short = rank
    s = starts[tied]
    keys = [((ends[tied] * np.int64(n + 1) + rank[at[s + d]]) * 64 + d) for d in ((m - s) % COVER for m in MEMBERS)]
    out[tied] = _twice(np.concatenate(keys)).reshape(len(MEMBERS), -1).any(axis=0)
    return out


def _strings(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """Of rows (.., lo, hi, bytes): all bytes, the row of every string, its place among the row's, and its start among all bytes."""
    text = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
    many = np.array([r[5] - r[4] + 1 for r in rows], np.int64)
    begin = np.cumsum(many + LENGTH - 1) - many - LENGTH + 1
    within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return text, np.repeat(np.arange(len(rows)), many), within, np.repeat(begin, many) + within


def likely(rows: list[tuple]) -> list[tuple]:
    """The rows of which some string has the fingerprints of another's both ends: no other can hold an equal one."""
    text, owner, _, starts = _strings(rows)
    ends = grams(text, EDGE)
    return [rows[i] for i in np.unique(owner[_twice(mix64(ends[starts] * STEP + ends[starts + LENGTH - EDGE]))])]


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k0, k1, n, id, lo, hi, bytes) sorted by bucket to spans (id, a, b) of strings found twice; whole buckets, a block at a time."""
    held: list[tuple] = []
    size = 0

    def block(rows: list[tuple]) -> pa.RecordBatch:
        rows = likely(rows)
        text, owner, within, starts = _strings(rows)
        ids, lo = (np.array([r[c] for r in rows], np.int64) for c in (3, 4))
        hit = repeated_strings(text, starts) if rows else np.zeros(0, bool)
        hit &= np.array([r[2] == 1 for r in rows], bool)[owner]
        at = np.flatnonzero(hit)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1 if len(at) else first
        o = owner[at[first]]
        columns = (ids[o], lo[o] + within[at[first]], lo[o] + within[at[last]] + LENGTH)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "a", "b"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if held and size >= BLOCK_BYTES and row[:2] != held[-1][:2]:
                yield block(held)
                held, size = [], 0
            held.append(row)
            size += len(row[6])
    if held:
        yield block(held)


#: A bucket's rows: its key, the offsets of its anchor in the strings it serves, how many texts share the context, one of them, and the bytes.
KEYS = "k0 long, k1 long, l1 int, l2 int"
SHIPPED = f"{KEYS}, n long, id long, lo long, hi long, at long, bytes binary"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(SHIPPED + ", many long")
    for batch in batches:
        for i in range(batch.num_rows):
            text, wanted = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            rows = [{"k0": w["g"], "k1": 0, "l1": 0, "l2": SPAN - 1, **w, "bytes": text[w["lo"] : w["hi"] + LENGTH]} for w in wanted]
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=schema)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large buckets, each cut in two by the anchor's offset in its strings.

    All strings of a half reach some bytes further to one side of the anchor at
    least, so those bytes are part of the half's key: equal strings stay together.
    """
    schema = _arrow(f"{SHIPPED}, c0 long, c1 long")
    # a batch's rows become Python objects a few at a time, each with the bytes of its strings
    for part in (batch.slice(a, FEW) for batch in batches for a in range(0, batch.num_rows, FEW)):
        out = []
        for r in part.to_pylist():
            middle, raw, lo, at = (r["l1"] + r["l2"] + 1) // 2, r["bytes"], r["lo"], r["at"]
            for l1, l2 in ((r["l1"], middle - 1), (middle, r["l2"])):
                first, last = max(lo, at - l2), min(r["hi"], at - l1)
                if l1 <= l2 and first <= last:
                    k0, k1 = digest(l1, l2, raw[at - l1 - lo : at - l2 + LENGTH - lo])
                    own = raw[first - lo : last - lo + LENGTH]
                    c0, c1 = digest(at - first, own)
                    out.append({**r, "k0": k0, "k1": k1, "l1": l1, "l2": l2, "lo": first, "hi": last, "bytes": own, "c0": c0, "c1": c1})
        if out:
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in out], schema=schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in range(batch.num_rows):
            i, text, spans = (batch.column(k)[row].as_py() for k in range(3))
            text, kept, runs, at = text or b"", [], [], 0
            for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(b, runs[-1][1])
                else:
                    runs.append([a, b])
            for a, b in runs:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            left = b"".join(kept)
            out.append((i, left, len(text), len(text) - len(left), len(runs)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), *3 * (pa.int64(),)))], names=["id", "kept", "n_bytes", "n_removed", "n_spans"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a, b): byte spans that strings of LENGTH bytes cover which also start elsewhere; spans of one text may overlap.

    Contexts that are equal as a whole, by a 128-bit cryptographic digest, are
    counted, not sorted: all their strings repeat, and one of them stands for
    all where its bucket is sorted.  Those of one text are counted where they are
    found, so a line that fills texts is a row a text.  A bucket of more than MOST_CONTEXTS
    contexts is cut in halves by the anchor's offset, up to nine times; a half
    of one offset holds one string, so whatever its size it is counted.
    """
    tmp = Scratch(docs.sparkSession, "suffixes")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).where(f"octet_length(text) >= {LENGTH}")
    found = tmp.save(rows.mapInArrow(_anchor_rows, FOUND))
    spans = [tmp.save(found.where("times > 1").selectExpr("id", "inline(inside)"))]
    # what joins a hot anchor's rows is written first, so that adaptive execution can split them
    again = tmp.save(found.groupBy("g").count().where(F.col("count") > 1).select("g"))
    repeated = tmp.save(found.drop("inside").join(again, "g"))
    tmp.drop(found)

    def wanted(classes: DataFrame, key: list[str]) -> DataFrame:
        """The classes of buckets that hold several and have one that isn't known to repeat."""
        sizes = tmp.save(classes.groupBy(*key).agg(F.count("*").alias("many"), F.min("n").alias("rarest")).where("many > 1 and rarest = 1").drop("rarest"))
        return classes.join(sizes, key)

    own = ["g", "c0", "c1"]
    classes = tmp.save(repeated.groupBy(*own).agg(F.sum("times").alias("n"), F.min(F.struct("id", "lo", "hi", "at")).alias("one")))
    spans.append(repeated.where("times = 1").join(classes.where("n > 1").select(*own), own).select("id", F.col("lo").alias("a"), (F.col("hi") + LENGTH).alias("b")))
    by_text = wanted(classes, ["g"]).groupBy("one.id").agg(F.collect_list(F.struct("g", "n", "many", "one.*")).alias("wanted"))
    shipped = tmp.save(rows.join(by_text, "id").select("text", "wanted").mapInArrow(_contexts, SHIPPED + ", many long"))
    key = ["k0", "k1", "l1", "l2"]
    while True:
        fit = shipped.where(F.col("many") <= MOST_CONTEXTS).select("k0", "k1", "n", "id", "lo", "hi", "bytes")
        spans.append(fit.repartition("k0", "k1").sortWithinPartitions("k0", "k1").mapInArrow(_sort_blocks, "id long, a long, b long"))
        large = shipped.where(F.col("many") > MOST_CONTEXTS).drop("many")
        if large.isEmpty():
            break
        halves = tmp.save(large.mapInArrow(_halves, f"{SHIPPED}, c0 long, c1 long"))
        one = F.min_by(F.struct("n", "id", "lo", "hi", "at", "bytes"), F.struct("id", "lo")).alias("one")
        classes = tmp.save(halves.groupBy(*key, "c0", "c1").agg(F.count("*").alias("copies"), one))
        new = halves.where("n = 1").drop("n", "bytes").join(classes.where("copies > 1").select(*key, "c0", "c1"), [*key, "c0", "c1"])
        spans.append(new.select("id", F.col("lo").alias("a"), (F.col("hi") + LENGTH).alias("b")))
        classes = classes.select(*key, "one.*", "copies").withColumn("n", F.greatest("n", "copies")).drop("copies")
        shipped = tmp.save(wanted(classes, key))
    out = spans[0]
    for more in spans[1:]:
        out = out.union(more)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept, n_bytes, n_removed, n_spans): each text's bytes without those in strings of LENGTH bytes that start anywhere else too.

    Strings are judged on the input; all their places lose them, copies within a
    text included.  Null and empty texts have no bytes and lose none; nor do
    texts under LENGTH bytes.  Rows that repeat an id are documents of their own;
    where there are any, the rows are first written under keys.  A null id is
    left out; an empty table gives no row; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).where("id is not null")
    if rows.groupBy("id").count().where(F.col("count") > 1).isEmpty():
        rows = rows.withColumn("key", F.col("id"))
    else:
        rows = Scratch(docs.sparkSession, "suffixes").save(rows.withColumn("key", F.monotonically_increasing_id()))
    spans = repeated_spans(rows, "key").groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = rows.join(spans.withColumnRenamed("id", "key"), "key", "left").select("id", "text", "spans")
    return joined.mapInArrow(_cut, "id long, kept binary, n_bytes long, n_removed long, n_spans long").withColumnRenamed("id", id_col)
