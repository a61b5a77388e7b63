"""SuperMinHash near-duplicate grouping: signatures, banding, verification on full sets, union-find.

A SuperMinHash signature lets every element of a set draw, at level j, a rank
j + r from a slot of its own random permutation; a slot keeps the least rank.
Ranks of one element are correlated over its permutation, which lowers the
variance, and once every slot is taken no later level can change one, so a long
text stops after two or three of the SLOTS levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.llm.common import Scratch, by_size, connected_components, mix64, worker_cache

WORDS, NUM, DEN = 5, 75, 100
#: 40 bands of 5: two sets of similarity 0.75 share no band with probability 2e-5.
BANDS, ROWS = 40, 5
SLOTS = BANDS * ROWS
CHUNK_BYTES = 1_000_000
#: Sketches keep four bits of every slot in longs of 16; at similarity 0.75 some 153 of the 200 agree, 6.1 the deviation; 4.5 deviations are let through.
LONGS, LEAST_EQUAL = -(-SLOTS // 16), 125
SKETCH = [f"s{i}" for i in range(LONGS)]
#: Shingles whose ranks are drawn at a time.
PIECE = 100_000
#: Distinct words whose hashes a worker remembers before it starts afresh.
REMEMBERED = 200_000
SEED = 0x5DEECE66D
STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Seeded 64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word, SEED)
        return h


def _hashes() -> _Hashes:
    held = worker_cache()
    if len(held.get("words", ())) > REMEMBERED or "words" not in held:
        held["words"] = _Hashes()
    return held["words"]


def words_of(text: bytes | None) -> list[bytes]:
    """Words parted by ASCII white space, A-Z in lower case."""
    return (text or b"").lower().split()


def shingle_sets(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of each word list's distinct five-word shingles, sorted, one list after another; and how many each has.

    A list of fewer words is one shingle; an empty one none.  A name chains the
    seeded hashes of the words; names choose candidates, links are judged on words.
    """
    counts = np.array([len(w) for w in texts], np.int64)
    n_sh = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    total = int(n_sh.sum())
    if not total:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    known = _hashes()
    word = np.fromiter((known[w] for ws in texts for w in ws), np.uint64, int(counts.sum()))
    first = np.repeat(np.cumsum(counts) - counts, n_sh) + np.arange(total) - np.repeat(np.cumsum(n_sh) - n_sh, n_sh)
    size = np.repeat(np.minimum(counts, WORDS), n_sh)
    h = size.astype(np.uint64)
    for d in range(WORDS):
        at = np.minimum(first + d, len(word) - 1)
        h = np.where(d < size, mix64(h * STEP + word[at]), h)
    owner = np.repeat(np.arange(len(texts)), n_sh)
    order = np.lexsort((h, owner))
    h = h[order]
    new = np.ones(total, bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(texts))


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """The set that links are judged on."""
    if len(words) < WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(WORDS))))


def is_link(a: set, b: set) -> bool:
    if DEN * min(len(a), len(b)) < NUM * max(len(a), len(b)):
        return False
    both = len(a & b)
    return DEN * both >= NUM * (len(a) + len(b) - both)


def superminhash(h: np.ndarray, sizes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (sets, slots) of element names; the level is in the top byte, the rank's fraction below.  Empty sets: all ones.

    Elements are drawn PIECE at a time, so a very long text needs no more memory.
    """
    sig = np.full((len(sizes), slots), np.uint64(2**64 - 1))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for a in range(0, len(h), PIECE):
        own, names = owner[a : a + PIECE], h[a : a + PIECE]
        at = np.arange(len(own))
        perm = np.tile(np.arange(slots, dtype=np.uint8), (len(own), 1))
        for j in range(slots):
            if not len(at):
                break
            x = mix64(names[at] + np.uint64((j + 1) * 0xD1342543DE82EF95 % 2**64))
            k = j + ((x >> np.uint64(40)) * np.uint64(slots - j) >> np.uint64(24)).astype(np.int64)
            slot = perm[at, k]
            perm[at, k] = perm[at, j]
            np.minimum.at(sig.reshape(-1), own[at] * slots + slot, np.uint64(j << 56) | mix64(x) >> np.uint64(8))
            docs = np.unique(own[at])
            open_ = np.zeros(len(sizes), bool)
            # a slot that no level up to this one has taken can still change
            open_[docs] = (sig[docs] >= np.uint64((j + 1) << 56)).any(axis=1)
            at = at[open_[own[at]]]
    return sig


SIGNED = "id long, n long, k0 long, k1 long, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k0 and k1 are a 128-bit digest of the word sequence."""
    for batch in batches:
        for ids, texts in by_size(batch, CHUNK_BYTES):
            words = [words_of(t) for t in texts]
            h, sizes = shingle_sets(words)
            sig = superminhash(h, sizes)
            digests = b"".join(hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in words)
            key = np.frombuffer(digests, np.int64).reshape(-1, 2)
            bands = np.zeros((len(ids), BANDS), np.uint64)
            bands += np.arange(1, BANDS + 1, dtype=np.uint64)
            for r in range(ROWS):
                bands = mix64(bands * STEP + sig[:, r::ROWS])
            bits = np.zeros((len(ids), LONGS * 16), np.uint64)
            bits[:, :SLOTS] = mix64(sig) & np.uint64(15)
            shifts = 4 * np.arange(16, dtype=np.uint64)
            sketch = np.bitwise_or.reduce(bits.reshape(len(ids), LONGS, 16) << shifts, axis=2).view(np.int64)
            flat = pa.array(bands.view(np.int64).reshape(-1))
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32), flat)
            ends = [np.ascontiguousarray(c) for c in (sizes.astype(np.int64), key[:, 0], key[:, 1])]
            arrays = [pa.array(ids, pa.int64()), *map(pa.array, ends), lists]
            arrays += [pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(LONGS)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "k0", "k1", "bands", *SKETCH])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in by_size(batch, CHUNK_BYTES):
            h, sizes = shingle_sets([words_of(t) for t in texts])
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            names = pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), names], names=["id", "names"])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links among rows (u, v, text of u, text of v), by their sets of words; rows of one v stand together."""
    last, own = None, set()
    for batch in batches:
        u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = []
        for i in range(batch.num_rows):
            a, b = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
            if b != last:
                last, own = b, shingles(words_of(b))
            if is_link(shingles(words_of(a)), own):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in keep], pa.int64()), pa.array([v[i] for i in keep], pa.int64())], names=["u", "v"])


def _agreeing(x: str, y: str) -> Column:
    """How many slots of two sketches agree."""

    def fields(a: Column, b: Column) -> Column:
        d = a.bitwiseXOR(b)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return 16 - F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    return sum(fields(F.col(f"{x}.{s}"), F.col(f"{y}.{s}")) for s in SKETCH) - (16 * LONGS - SLOTS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): documents linked where 100 * |A & B| >= 75 * |A | B| over five-word shingle sets.

    Null and blank texts have no shingle and are linked with nothing; a null id
    is left out; rows that repeat an id are one document, which has the links of
    each of its texts and the size of the largest set.  Texts of one word
    sequence are one node, so a group of copies never meets itself.  Within a
    band's bucket each node is first compared with one centre; only nodes that a
    bucket still leaves in another class than its largest are then compared one
    by one, so a hot group of near copies makes one pair for each member.  Every
    link is confirmed on the sets of words themselves.  Small sides of joins by
    a hot key are written first, so that adaptive execution can split the other.
    Extra columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "minhash")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).where("id is not null")
    sig = tmp.save(base.mapInArrow(_sign, SIGNED))
    full = sig.where("n > 0")
    same = tmp.save(full.groupBy("k0", "k1").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    again = same.where("copies > 1").select("k0", "k1", "rep")
    members = tmp.save(full.select("id", "k0", "k1", "n").join(again, ["k0", "k1"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep")))
    reps = full.join(again, ["k0", "k1"], "left").where("rep is null or rep = id")
    rows = reps.select("id", F.explode("bands").alias("h"))
    centres = tmp.save(rows.groupBy("h").agg(F.min("id").alias("c"), F.max("id").alias("last")).where("c < last").select("h", "c"))
    rows = tmp.save(rows.join(centres, "h"))

    def texts_of(ids: DataFrame) -> DataFrame:
        return tmp.save(base.join(ids.distinct().hint("merge"), "id", "left_semi"))

    def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs (u, v) that are links, judged on words."""
        a, b = (texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")) for x in "uv")
        found = tmp.save(pairs.join(a, "u").join(b, "v").select("u", "v", "tu", "tv").mapInArrow(_judge, "u long, v long"))
        tmp.drop(texts)
        return found

    shared = rows.where("id <> c").groupBy("id", "c").count()
    best = shared.groupBy("id").agg(F.max_by("c", F.struct("count", -F.col("c"))).alias("c"))
    pairs = tmp.save(best.select(F.col("id").alias("u"), F.col("c").alias("v")))
    links = confirm(pairs, texts_of(pairs.select(F.explode(F.array("u", "v")).alias("id"))))
    # texts of one id are one document
    twice = members.groupBy("id").agg(F.min("rep").alias("v"), F.max("rep").alias("w")).where("v < w").select("id", "v")
    links = tmp.save(links.union(members.join(twice, "id").select(F.col("rep").alias("u"), "v").where("u <> v")))
    classes = connected_components(links, tmp)

    marked = tmp.save(rows.join(classes, "id", "left").select("h", "id", F.coalesce("component_id", "id").alias("k")))
    split = tmp.save(marked.groupBy("h").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a < b").select("h"))
    left = tmp.save(marked.join(split, "h", "left_semi"))
    tmp.drop(rows, marked)
    largest = tmp.save(left.groupBy("h", "k").count().groupBy("h").agg(F.max_by("k", F.struct("count", "k")).alias("largest")))
    left = tmp.save(left.join(largest, "h").join(reps.select("id", "n", *SKETCH), "id"))
    x, y = left.where("k <> largest").alias("x"), left.alias("y")
    near = (F.col("x.h") == F.col("y.h")) & (F.col("x.k") != F.col("y.k")) & ((F.col("y.k") == F.col("y.largest")) | (F.col("x.id") > F.col("y.id")))
    near &= (DEN * F.least("x.n", "y.n") >= NUM * F.greatest("x.n", "y.n")) & (_agreeing("x", "y") >= LEAST_EQUAL)
    # only rows with a likely partner carry their set; the join itself judges the pairs, so that none but links are made
    likely = tmp.save(x.join(y, near, "left_semi").union(y.join(x, near, "left_semi")).distinct())
    if not likely.isEmpty():
        texts = texts_of(likely.select("id"))
        whole = tmp.save(likely.join(texts.mapInArrow(_sets, "id long, names array<long>"), "id"))
        x, y = whole.where("k <> largest").alias("x"), whole.alias("y")
        both = F.size(F.array_intersect("x.names", "y.names"))
        named = DEN * both >= NUM * (F.size("x.names") + F.size("y.names") - both)
        more = tmp.save(x.join(y, near & named).select(F.col("x.id").alias("u"), F.col("y.id").alias("v")).distinct())
        links = tmp.save(links.union(confirm(more, texts)))
        tmp.drop(whole)
        classes = connected_components(links, tmp)
    group = members.join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("id", "n", F.coalesce("component_id", "rep").alias("g"))
    group = group.union(sig.where("n = 0").select("id", "n", F.col("id").alias("g")))
    found = group.groupBy("id").agg(F.max("n").alias("n_shingles"), F.min("g").alias("component_id"))
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
