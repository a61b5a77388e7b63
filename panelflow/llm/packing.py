"""Best-fit packing: documents as token sequences of a fixed length, by bounded-space online best-fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.common import Scratch, by_size
from panelflow.llm.tokens import CHUNK_BYTES, encoder

LIMIT = 1024
#: Bins open at once in a task, and the pieces that a task packs.
OPEN, PIECES = 1024, 100_000


class OpenBins:
    """At most `most` open bins; a bitset holds which amounts of free space some open bin has."""

    def __init__(self, limit: int = LIMIT, most: int = OPEN):
        self.limit, self.most = limit, most
        self.by_free: list[list[int]] = [[] for _ in range(limit + 1)]
        self.bits = self.open = self.made = 0

    def _take(self, free: int) -> int:
        found = self.by_free[free]
        if len(found) == 1:
            self.bits ^= 1 << free
        return found.pop()

    def place(self, length: int) -> tuple[int, int]:
        """The bin that a piece goes to, the one with least room that is enough, and its offset there."""
        enough = self.bits >> length
        if enough:
            free = length + (enough & -enough).bit_length() - 1
            at = self._take(free)
        else:
            free, at = self.limit, self.made
            self.made += 1
            self.open += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(at)
            self.bits |= 1 << rest
            if self.open > self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
        else:
            self.open -= 1
        return at, self.limit - free


def cut(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; the first may be shorter than limit."""
    first = n if n <= limit else n % limit or limit
    return [(0, first), *((a, limit) for a in range(first, n, limit))]


def pieces(docs: DataFrame, vocabulary: str, keep_space: bool = True, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's pieces; a null text is only an end id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = encoder(vocabulary, keep_space)
        for batch in batches:
            for ids, texts in by_size(batch, CHUNK_BYTES):
                flat, counts = encoded(texts)
                raw, at, rows = memoryview(flat.astype("<u4").tobytes()), 0, []
                for doc, n in zip(ids, counts.tolist()):
                    rows += [(doc, i, a, k, zlib.crc32(raw[4 * (at + a) : 4 * (at + a + k)])) for i, (a, k) in enumerate(cut(n, limit))]
                    at += n
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(encode, "id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, vocabulary: str, keep_space: bool = True, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): every piece's place in a sequence of at most limit ids.

    A task packs a range of ids in id order, so that a task that runs again
    packs alike; sequence ids hold the task's number above the bin's.  Null and
    empty texts are one id; rows that repeat an id are packed each; an empty
    table gives no row; other columns are not read.
    """
    found = Scratch(docs.sparkSession, "packing").save(pieces(docs, vocabulary, keep_space, limit, id_col, text_col))
    parts = max(1, -(-found.count() // PIECES))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(limit), TaskContext.get().partitionId() << 40
        for batch in batches:
            at = np.array([bins.place(n) for n in batch.column(3).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base + at[:, 0]), pa.array(at[:, 1])], names=[*batch.schema.names, "sequence_id", "offset"])

    rows = found.repartitionByRange(parts, "id", "piece").sortWithinPartitions("id", "piece", "length", "ids_crc32")
    return rows.mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
