"""Token ids: encoding by chunk with a cache, Simple-8b blocks, and token files in document order."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.common import Scratch, by_size, worker_cache

END_ID = 2
CHUNK_BYTES = 1_000_000
#: Distinct chunks a worker remembers before it starts afresh.
REMEMBERED = 600_000
#: Ids in a block of a token file, if its last document doesn't need more.
BLOCK_IDS = 65_536


def tokenizer(path: str):
    held = worker_cache()
    if ("tokenizer", path) not in held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        held["tokenizer", path] = Tokenizer.from_file(path)
    return held["tokenizer", path]


#: Kinds of bytes: white space, letters (Latin-1 ones by their UTF-8 bytes), digits, marks, the end of a text, the place of a text cut elsewhere.
WHITE, LETTER, DIGIT, MARK, END, ELSEWHERE = range(6)
BYTES = (b" \t\n\v\f\r", bytes([*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]), b"0123456789", bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39), b"\0", b"\1")
KIND = bytes(next((k for k, found in enumerate(BYTES) if b in found), ELSEWHERE) for b in range(256))
#: Bytes of texts cut into the vocabularies' own words: no apostrophes, which start contractions, no control characters, only ASCII and Latin-1 letters.
PLAIN = b"".join(BYTES[:END])
TIMES, DIVIDED = b"\xc3\x97", b"\xc3\xb7"
#: Of other texts: white space and what follows it, and white space other than ASCII.
LOOSE = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class _Known(dict):
    """Numbers of chunks; a new chunk gets the next one and is noted in `new`."""

    def __missing__(self, chunk) -> int:
        self[chunk] = at = len(self)
        self.new.append(chunk)
        return at


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct chunk encoded once.

    Texts are cut only where the vocabulary's rules never look across.  A text
    of ASCII and Latin-1 letters is cut into the vocabulary's own words; others
    before ASCII white space.  With keep_space (byte-level rules) chunks keep
    white space, and a text with other kinds of it is one chunk; without, white
    space and case are dropped, as that vocabulary drops them.
    """

    def __init__(self, path: str, keep_space: bool):
        self.path, self.keep_space = path, keep_space
        # the library finds these in a text before any other rule, so a text that holds one is never cut
        self.added = [x.content.encode() for x in tokenizer(path).get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known = _Known({None: 0})
        self.known.new = []
        self.pool, self.begin, self.length = np.array([END_ID], np.uint32), np.zeros(1, np.int32), np.ones(1, np.int32)

    def holds_added(self, text: bytes) -> bool:
        return any(x in text for x in self.added)

    def chunks(self, text: bytes) -> list[bytes]:
        """The chunks of a text that isn't plain."""
        if self.holds_added(text):
            return [text]
        if not self.keep_space:
            return text.split()
        return [text] if ODD.search(text) else LOOSE.findall(text)

    def words(self, plain: bytes) -> pa.DictionaryArray:
        """The chunks of plain texts, each ended by a byte of kind END, which is a chunk too.

        With white space kept, a word takes the one space before it; what else
        is white before a word splits into its last character and the rest.
        Without, digits stand alone.
        """
        raw, kind = np.frombuffer(plain, np.uint8), np.frombuffer(plain.translate(KIND), np.uint8)
        starts = np.empty(len(raw), bool)
        starts[0] = True
        np.not_equal(kind[1:], kind[:-1], out=starts[1:])
        if self.keep_space:
            starts |= kind >= END
            after = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] > WHITE) & (kind[1:] < END))
            starts[after] = True
            starts[after + 1] = raw[after] != 0x20
        else:
            starts |= (kind == DIGIT) | (kind >= END)
            held = kind != WHITE
            raw, starts = raw[held], starts[held]
        offsets = np.append(np.flatnonzero(starts), len(raw)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
        return found.dictionary_encode()

    def numbers(self, texts: list[bytes | None]) -> np.ndarray:
        """Every chunk's number in known, one text after another, each ended by 0."""
        parts, others = [], []
        for t in texts:
            if t and (t.translate(None, PLAIN) or TIMES in t or DIVIDED in t or self.holds_added(t)):
                others.append(t)
                t = BYTES[ELSEWHERE]
            parts.append(t or b"")
        plain = BYTES[END].join([*parts, b""])
        words = self.words(plain if self.keep_space else plain.lower())
        own, at = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        own[at[-1]] = None
        if not others:
            return np.fromiter(map(self.known.__getitem__, own), np.int32, len(own))[at]
        place = own.index(BYTES[ELSEWHERE])
        own[place] = None
        gaps = np.flatnonzero(at == place)
        at = np.split(np.fromiter(map(self.known.__getitem__, own), np.int32, len(own))[at], gaps)
        rest = []
        for t, after in zip(others, at[1:]):
            cut = self.chunks(t)
            rest += [np.fromiter(map(self.known.__getitem__, cut), np.int32, len(cut)), after[1:]]
        return np.concatenate([at[0], *rest])

    def learn(self, new: list[bytes]) -> None:
        text = [w.decode("utf-8", "replace") for w in new]
        lists = [text[a : a + 500] for a in range(0, len(text), 500)]
        found = tokenizer(self.path).encode_batch(lists, is_pretokenized=True, add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        owner = np.concatenate([np.array(e.word_ids, np.int64) + 500 * i for i, e in enumerate(found)])
        length = np.bincount(owner, minlength=len(new)).astype(np.int32)
        self.begin = np.concatenate([self.begin, (len(self.pool) + np.cumsum(length) - length).astype(np.int32)])
        self.length = np.concatenate([self.length, length])
        self.pool = np.concatenate([self.pool, flat])

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, each ended by END_ID; and how many each text has."""
        if len(self.known) > REMEMBERED:
            self.forget()
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        at = self.numbers(texts)
        if self.known.new:
            self.learn(self.known.new)
            self.known.new = []
        length = self.length[at]
        stop = np.cumsum(length, dtype=np.int32 if len(at) < 1 << 24 else np.int64)
        ids = self.pool[np.repeat(self.begin[at] - stop + length, length) + np.arange(int(stop[-1]), dtype=stop.dtype)]
        return ids, np.diff(stop[at == 0].astype(np.int64), prepend=0)


def encoder(path: str, keep_space: bool) -> Encoder:
    held = worker_cache()
    if ("encoder", path) not in held:
        held["encoder", path] = Encoder(path, keep_space)
    return held["encoder", path]


#: Simple-8b selectors 1 to 15 as (ids in a word, bits of each); selector 0 is an escape.
SELECTORS = ((120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))


LIMITS = np.array([1 << b for b in range(61)], np.uint64)
#: Bits that a small id needs.
BITS = np.searchsorted(LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned ids: the selector in the top four bits, ids from the lowest bits up.

    At each place the selector of most ids is taken that holds the next ones;
    the last word may be part filled.  An id of over 60 bits is an escape: its
    word has selector 0 and the id's index among the raw words at the end.
    """
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    ids = ids.astype(np.uint64)
    need = BITS[ids.astype(np.int64)] if ids.max() < len(BITS) else np.searchsorted(LIMITS, ids, side="right").astype(np.uint8)
    widest = {1: need}

    def most_bits(c: int) -> np.ndarray:
        """The bits that the next c ids need; ids past the end need none."""
        if c not in widest:
            a = max(k for k in widest if k < c)
            b = max(k for k in widest if k <= c - a)
            out = widest[a].copy()
            if a < n:
                np.maximum(out[: n - a], widest[b][a:], out=out[: n - a])
            widest[a + b] = out
            return most_bits(c)
        return widest[c]

    choice = np.zeros(n, np.uint8)
    for s in range(len(SELECTORS), 0, -1):
        c, b = SELECTORS[s - 1]
        choice[most_bits(c) <= b] = s
    counts = np.array([1, *(c for c, _ in SELECTORS)], np.uint8)
    step, starts, i = counts[choice].tobytes(), [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts, np.int64)
    chosen = choice[at]
    out = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(120, np.uint64)])
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if s == 0:
            out[rows] = np.arange(len(rows), dtype=np.uint64)
            out = np.concatenate([out, ids[at[rows]]])
        elif c := SELECTORS[s - 1][1]:
            many = SELECTORS[s - 1][0]
            shifts = np.arange(many, dtype=np.uint64) * np.uint64(c)
            out[rows] |= np.bitwise_or.reduce(padded[at[rows, None] + np.arange(many)] << shifts, axis=1)
    return out


def unpack(words: np.ndarray, n: int, escapes: int = 0) -> np.ndarray:
    """The n ids of pack()'s words, of which the last `escapes` are raw."""
    body = words[: len(words) - escapes]
    chosen = (body >> np.uint64(60)).astype(np.int64)
    counts = np.array([1, *(c for c, _ in SELECTORS)])[chosen]
    begin = np.cumsum(counts) - counts
    out = np.zeros(n + 120, np.uint64)
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if s == 0:
            out[begin[rows]] = words[len(body) + (body[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif b := SELECTORS[s - 1][1]:
            many = SELECTORS[s - 1][0]
            shifts = np.arange(many, dtype=np.uint64) * np.uint64(b)
            out[begin[rows, None] + np.arange(many)] = (body[rows, None] >> shifts) & np.uint64((1 << b) - 1)
    return out[:n]


BLOCKS = "part int, block int, start long, n_ids long, n_escapes long, doc_ids array<long>, ends array<long>, words binary"


def write_blocks(docs: DataFrame, path: str, vocabulary: str, keep_space: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes token files under path: one row a block, in ascending id order over the files and within them.

    A block holds whole documents: their ids, where each ends among the block's
    token ids, and Simple-8b words.  start counts the token ids of the file's
    earlier blocks.  A null text is only an end id.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        encoded = encoder(vocabulary, keep_space)
        for batch in batches:
            for ids, texts in by_size(batch, CHUNK_BYTES):
                flat, counts = encoded(texts)
                ends = np.cumsum(counts)
                a = done = 0
                while a < len(ids):
                    b = max(a + 1, int(np.searchsorted(ends, done + BLOCK_IDS, side="right")))
                    own = flat[done : ends[b - 1]]
                    words = pack(own)
                    escapes = int((own.astype(np.uint64) >> np.uint64(60) > 0).sum())
                    row = {"part": part, "block": block, "start": start, "n_ids": len(own), "n_escapes": escapes, "doc_ids": ids[a:b], "ends": (ends[a:b] - done).tolist(), "words": words.astype("<u8").tobytes()}
                    yield pa.RecordBatch.from_pylist([row], schema=schema)
                    start, block, done, a = start + len(own), block + 1, int(ends[b - 1]), b

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("n_escapes", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("words", pa.binary())])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(encode, BLOCKS).write.option("compression", "uncompressed").parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """(id, start, ids): every document of write_blocks()'s files, start counting all token ids of documents before it."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(np.frombuffer(r["words"], "<u8"), r["n_ids"], r["n_escapes"]).astype(np.uint32)
                ends = np.array([0, *r["ends"]], np.int64)
                flat = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(r["base"] + r["start"] + ends[:-1]), flat], names=["id", "start", "ids"])

    return _based(spark, path).mapInArrow(decode, "id long, start long, ids array<long>")


def _based(spark, path: str) -> DataFrame:
    """The blocks with base, the token ids of earlier files; one small row a file reaches the driver."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    bases, total = [], 0
    for part, n in blocks.groupBy("part").agg(F.sum("n_ids")).orderBy("part").collect():
        bases.append((part, total))
        total += n
    return blocks.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part")


def read_digests(spark, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, decoded block by block from write_blocks()'s files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                raw = memoryview(unpack(np.frombuffer(r["words"], "<u8"), r["n_ids"], r["n_escapes"]).astype("<u4").tobytes())
                ends = np.array([0, *r["ends"]], np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(r["base"] + r["start"] + ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    return _based(spark, path).mapInArrow(digest, "id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, vocabulary: str, keep_space: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs' token files to the shared folder and reads every document's place, length and checksum back from them.

    Null and empty texts have one id.  Rows that repeat an id follow one
    another.  An empty table gives no row; other columns are not read.
    """
    at = Scratch(docs.sparkSession, "tokens").path()
    write_blocks(docs, at, vocabulary, keep_space, id_col, text_col)
    return read_digests(docs.sparkSession, at).withColumnRenamed("id", id_col)
