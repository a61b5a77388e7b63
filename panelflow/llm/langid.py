"""Language identification by partial matching: variable-order byte contexts with escapes, frozen code lengths.

A language's model is a tree of contexts of up to ORDER preceding bytes, ASCII
letters without case.  A byte seen in a context costs -log2(count / (total +
kinds)); one not seen costs the escape, -log2(kinds / (total + kinds)), and its
cost in the context one byte shorter; below the empty context all bytes cost the
same.  Costs are frozen as whole numbers of 1 / SCALE bit, so a text's code
length is exact.  Of every language only what it has seen is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.llm.common import by_size

ORDER, SCALE = 4, 1024
#: Bound of the labelled sample: about this many documents and bytes a language, chosen by a hash of the id.
MAX_DOCS, MAX_BYTES = 1_500, 4_000_000
CHUNK_BYTES = 2_000_000
#: Bound of the costs worked out at a time, distinct keys times languages.
CELLS = 40_000_000
UNKNOWN = "und"
#: Bytes as they are, but for A-Z, which count as a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of all texts with the ORDER bytes before it as one number, the byte lowest (white space before a text); and where texts end."""
    pad = b" " * ORDER
    flat = np.frombuffer(b"".join(pad + t for t in texts).translate(FOLD), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    keys = flat.astype(np.int64)
    for i in range(1, ORDER + 1):
        keys[i:] |= flat[:-i].astype(np.int64) << (8 * i)
    begin = np.cumsum(size + ORDER) - size
    own = np.ones(len(flat), bool)
    for i in range(1, ORDER + 1):
        own[begin - i] = False
    return keys[own], np.cumsum(size)


def suffix(keys: np.ndarray, order: int) -> np.ndarray:
    """Keys with their last `order` bytes of context only."""
    return keys & ((1 << 8 * (order + 1)) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for langs, texts in by_size(batch, CHUNK_BYTES):
            for lang in sorted(set(langs)):
                keys, _ = contexts([t for t, own in zip(texts, langs) if own == lang])
                key, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key), pa.array(n)], names=["lang", "key", "n"])


class Sparse:
    """Values by key and language, held only where a language has one: keys in order, and of each the run of its languages' values."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, bits: np.ndarray):
        order = np.lexsort((langs, keys))
        self.keys, begin = np.unique(keys[order], return_index=True)
        self.begin = np.append(begin, len(keys))
        self.langs = langs[order].astype(np.int32)
        self.values = np.minimum(np.rint(bits[order] * SCALE), 65535).astype(np.uint16)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, language, value) of all that is held for the keys given."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        rows = np.flatnonzero(self.keys[at] == keys)
        begin, size = self.begin[at[rows]], self.begin[at[rows] + 1] - self.begin[at[rows]]
        own = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.repeat(rows, size), self.langs[own], self.values[own]


class CodeLengths:
    """Frozen costs: by order, what each language has seen and its cost, and what an escape from each of its contexts costs.

    Sparse by language: 22 bytes at most for each language and pair of context and byte that it has seen, and for each of its contexts.
    """

    def __init__(self, langs: np.ndarray, keys: np.ndarray, counts: np.ndarray, k: int):
        self.k, self.pairs, self.escapes = k, [], []
        for order in range(ORDER + 1):
            pair, n, lang = _sums(suffix(keys, order), langs, counts)
            context, total, own = _sums(pair >> 8, lang, n)
            _, kinds, _ = _sums(pair >> 8, lang, np.ones_like(n))
            both = total + kinds
            # pairs are in the order of their languages and contexts, as these are
            at = np.searchsorted(_joined(own, context), _joined(lang, pair >> 8))
            self.pairs.append(Sparse(pair, lang, np.log2(both[at] / n)))
            self.escapes.append(Sparse(context, own, np.log2(both / kinds)))

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Costs [key, language] of keys with ORDER bytes of context.

        A context that a language has not seen costs it nothing to leave, but
        every language has seen the empty one, so a byte new to it costs an
        escape and 8 bits.
        """
        out = np.zeros((len(keys), self.k), np.int32)
        left = np.ones((len(keys), self.k), bool)
        for order in range(ORDER, -1, -1):
            short = suffix(keys, order)
            row, lang, cost = self.pairs[order].find(short)
            new = left[row, lang]
            out[row[new], lang[new]] += cost[new]
            left[row, lang] = False
            row, lang, cost = self.escapes[order].find(short >> 8)
            out[row, lang] += np.where(left[row, lang], cost, 0).astype(np.int32)
        return out + left * np.int32(8 * SCALE)


def _joined(langs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Language and key as one number; a key has 8 * (ORDER + 1) bits."""
    return langs.astype(np.int64) << (8 * (ORDER + 1)) | keys


def _sums(keys: np.ndarray, langs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, sum, language) of every language and key, in that order."""
    both, at = np.unique(_joined(langs, keys), return_inverse=True)
    return suffix(both, ORDER), np.bincount(at, counts, len(both)), both >> (8 * (ORDER + 1))


def fit(docs: DataFrame, lang: Column, trains: Column, text_col: str = "text", id_col: str = "doc_id", most: int = MAX_DOCS) -> tuple[list[str], pa.Table]:
    """Languages and (lang, key, n), how often a key occurs, from a bounded sample of labelled rows.

    A language of more than `most` labelled rows or MAX_BYTES gives those whose
    hash of the id falls below the share wanted, and at least the one of its
    smallest hash: whole texts always, however long.  So every language that
    has a labelled text with a byte in it is learned.
    """
    known = docs.select(lang.alias("lang"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).where(trains & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    place = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    sizes = sorted(tuple(r) for r in known.groupBy("lang").agg(F.count("*"), F.sum(F.octet_length("text")), F.min(place)).collect())
    share = F.lit(0)
    for name, n, size, first in sizes:
        share = F.when(F.col("lang") == name, max(first + 1, int(1_000_000 * min(1.0, most / n, MAX_BYTES / size)))).otherwise(share)
    chosen = known.where(place < share).select("lang", "text")
    counts = chosen.mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    return [name for name, *_ in sizes], counts.toArrow()


def identify(docs: DataFrame, names: list[str], model: pa.Table, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score): the language of the shortest code, and its share of 2 ** -length over all languages.

    A text that is null or has no letter is UNKNOWN with score 0; equal codes go
    to the language first in order; names the model has not counted are never
    given, and without any all is UNKNOWN.  Null ids stay null, rows that repeat
    are scored each, an empty table gives no row.  The driver builds the costs
    once from the sample's distinct keys, at most MAX_BYTES a language, and
    broadcasts them as they are used.
    """
    names = sorted(set(names) & set(model["lang"].unique().to_pylist()))
    known = model.filter(pc.is_in(model["lang"], pa.array(names, pa.string())))
    langs = pc.index_in(known["lang"], pa.array(names, pa.string())).to_numpy().astype(np.int64)
    built = CodeLengths(langs, known["key"].to_numpy(), known["n"].to_numpy(), len(names)) if names else None
    sent = docs.sparkSession.sparkContext.broadcast(built)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in by_size(batch, CHUNK_BYTES):
                yield _score(ids, texts, names, sent.value)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).cast("binary").alias("text"))
    return rows.mapInArrow(score, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def _bits(texts: list[bytes], model: CodeLengths) -> np.ndarray:
    """Code lengths [text, language]; many bytes are costed in parts, each distinct key of a part once."""
    keys, ends = contexts(texts)
    bits = np.zeros((len(texts), model.k), np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    part = max(1, min(CHUNK_BYTES, CELLS // model.k))
    for a in range(0, len(keys), part):
        distinct, at = np.unique(keys[a : a + part], return_inverse=True)
        cost, own = model.costs(distinct), owner[a : a + part]
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        for lang in range(model.k):
            bits[own[begin], lang] += np.add.reduceat(cost[:, lang][at], begin, dtype=np.int64)
    return bits


def _score(ids: list, texts: list, names: list[str], model: CodeLengths | None) -> pa.RecordBatch:
    pred, score = np.full(len(ids), UNKNOWN, object), np.zeros(len(ids))
    own = [i for i, t in enumerate(texts) if t] if model else []
    if own:
        bits = _bits([texts[i] for i in own], model)
        more = np.minimum((bits - bits.min(axis=1, keepdims=True)) / SCALE, 1000.0)
        pred[own] = np.array(names, object)[bits.argmin(axis=1)]
        score[own] = 1 / np.exp2(-more).sum(axis=1)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pred.tolist(), pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])


def predict_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row.

    Documents whose crc32 of the id as text is 1 modulo 3 are held out of
    learning.  A row without id teaches nothing and is not held out; see
    `identify` for null and empty texts, repeated rows and empty tables.
    """
    held_out = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1
    trains = F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1
    names, model = fit(docs, F.col(lang_col), trains, text_col, id_col)
    return identify(docs, names, model, text_col, id_col).withColumn("held_out", F.coalesce(held_out, F.lit(False))).select(id_col, "held_out", "lang_pred", "score")
