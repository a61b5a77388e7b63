"""Toxicity by a noisy channel: disguised words are decoded by Viterbi under a character model of the corpus, restored text is scored.

Letters come down to SYMBOLS symbols: boundary, a to z without accents, digits,
marks within words, and other scripts' letters in three classes by code point.
The character model counts every run of ORDER symbols over all texts, so what it
gathers grows with the corpus, in a table of SYMBOLS ** ORDER counts, whatever the
corpus.  A disguised stretch is a lattice: a digit or mark stands for itself or
for a letter it looks like, a letter repeated three times or more may be meant
fewer times, and separators between single letters may be no boundaries.  The
best path through the lattice under channel and model is what was meant.

Labels teach which pieces of restored words are telling; a document's score is
the calibrated evidence of its telling words.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.llm.common import Scratch, by_size, worker_cache

SYMBOLS, ORDER = 32, 4
DIGIT, MARK = 27, 28
CHUNK_BYTES = 2_000_000
#: At most about this many labelled documents teach, chosen by a hash of the id; 0 takes all.
MAX_LABELLED = 20_000
#: Letters of the beginnings of words that can be telling; a word's end counts as one.
SHORTEST, LONGEST = 3, 12
#: A beginning rests on MIN_DOCS documents at least; the share of false ones among telling beginnings; how many documents its parent's share weighs.
MIN_DOCS, FALSE_SHARE, PARENT, SURE = 3, 0.05, 4.0, 0.95
#: At most this many beginnings are sent to workers, the most frequent first.
MAX_KNOWN = 200_000
THRESHOLD = 0.7
#: What a character may be meant for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "+": "t", "|": "il", "(": "c", "*": "aeiou", "€": "e", "£": "l", "¡": "i", "#": "h",
}
#: Channel costs in nats: a look-alike, a letter repeated, a separator put between letters; and their honest counterparts.
ALIKE, REPEATED, SPACED, HONEST = 2.0, 0.7, 0.4, 0.1
#: A path is settled this many symbols behind the last, so that a lattice of any length takes bounded memory.
LAG = 64

_SEPARATORS = r" \t._*/\-"
#: Single characters with one separator between each two.
_SPACED = re.compile(rf"(?<![^\s])[^\W_](?:[{_SEPARATORS}][^\W_](?!\w)){{2,}}(?!\w)")
_NOISY = re.compile(r"([^\W\d_])\1\1|[^\W\d_].*[0-9@$!+|(*€£¡#].*|[0-9@$!+|(*€£¡#].*[^\W\d_]")
_EDGES = "\"'`.,;:?!()[]{}<>*#|-_/"
_LEFT_EDGES = _EDGES.replace("(", "").replace("*", "").replace("|", "").replace("!", "")
_WORD = re.compile(r"[a-zA-C]+")


def symbol(ch: str) -> int:
    """The symbol of a character."""
    if ch in "æœøđłþð":
        return ord("aoodltd"["æœøđłþð".index(ch)]) - 96
    if ch == "ß":
        return 19
    base = unicodedata.normalize("NFKD", ch.lower())[:1] or ch
    if "a" <= base <= "z":
        return ord(base) - 96
    if ch.isalpha():
        return 29 + ord(ch) % 3
    if ch.isdigit():
        return DIGIT
    return MARK if ch in LOOKS_LIKE or ch in "_-'’" else 0


#: Symbols of the code points below 0x250; beyond, letters go by code point.
TABLE = np.array([symbol(chr(c)) for c in range(0x250)], np.uint8)
#: Restored words are written in these; digits and marks end words.
LETTERS = " abcdefghijklmnopqrstuvwxyz09ABC"
LETTER_OF = np.frombuffer(re.sub("[^a-zA-C]", " ", LETTERS).encode(), np.uint8)
ALIKE_OF = np.array([chr(c) in LOOKS_LIKE for c in range(0x250)])
SPACE_OF = np.array([chr(c).isspace() for c in range(0x250)])


def symbols(text: str) -> np.ndarray:
    """A text's symbols; code points beyond the table count as letters of other scripts, general punctuation as boundaries."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    out = TABLE[np.minimum(points, 0x24F)]
    far = points >= 0x250
    if far.any():
        out = np.where(far, np.where((points >= 0x2000) & (points < 0x2C00), 0, 29 + points % 3), out).astype(np.uint8)
    return out


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a run of ORDER symbols that a task's texts hold, each text between boundaries."""
    total = np.zeros(SYMBOLS**ORDER, np.int64)

    def add(parts: list[np.ndarray]) -> None:
        s = np.concatenate(parts).astype(np.int64)
        key = s[ORDER - 1 :].copy()
        for back in range(1, ORDER):
            key += s[ORDER - 1 - back : len(s) - back] << (5 * back)
        np.add(total, np.bincount(key, minlength=len(total)), out=total)

    pad = np.zeros(ORDER - 1, np.uint8)
    for batch in batches:
        for _, texts in by_size(batch, CHUNK_BYTES):
            parts = [x for t in texts if t for x in (pad, symbols(t))]
            if parts:
                add([*parts, pad])
    key = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total[key])], names=["key", "n"])


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all runs of ORDER symbols over every whole text; null texts hold none."""
    rows = docs.select(F.lit(0).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_count_runs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS**ORDER, np.int64)
    out[found["key"].to_numpy()] = found["n"].to_numpy()
    return out


def costs_of(counts: np.ndarray) -> np.ndarray:
    """-log P(symbol | the three before), each order backing off to the one below by its number of kinds (Witten and Bell)."""
    below = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, ORDER + 1):
        n = counts.reshape(-1, SYMBOLS**order).sum(axis=0).reshape(-1, SYMBOLS).astype(float)
        kinds = (n > 0).sum(axis=1, keepdims=True)
        lower = np.broadcast_to(below, n.shape) if order == 1 else np.tile(below, (SYMBOLS, 1))
        below = (n + kinds * lower) / np.maximum(n.sum(axis=1, keepdims=True) + kinds, 1)
        below = np.where(kinds > 0, below, lower)
    return -np.log(below).astype(np.float32).ravel()


def lattice(chars: str, spaced: bool) -> list[list[tuple[int, float]]]:
    """For each character what it may be: (symbol, cost), or -1 for nothing."""
    out = []
    for i, ch in enumerate(chars):
        own = symbol(ch)
        if spaced and i % 2:
            out.append([(0, HONEST), (-1, SPACED)])
            continue
        able = [(own, HONEST if ch in LOOKS_LIKE else 0.0)]
        able += [(ord(x) - 96, ALIKE) for x in LOOKS_LIKE.get(ch, "")]
        a, b = i, i
        while a and chars[a - 1] == ch:
            a -= 1
        while b + 1 < len(chars) and b - i < 2 and chars[b + 1] == ch:
            b += 1
        if i > a and b - a >= 2 and ch.isalpha():
            able.append((-1, REPEATED))
        out.append(able)
    return out


def decode(steps: list[list[tuple[int, float]]], cost: np.ndarray) -> list[int]:
    """The symbols of the cheapest path, boundaries at both ends left out.

    A state is the last three symbols.  Paths are linked lists that share what
    they have in common; once a path is LAG symbols long the best one's oldest
    symbols are settled.
    """
    # state -> (cost, path), a path is (symbol, path before)
    live: dict[int, tuple[float, tuple | None, int]] = {0: (0.0, None, 0)}
    done: list[int] = []

    def settle(best: tuple, keep: int) -> tuple[tuple | None, list[int]]:
        path, out = best[1], []
        while path is not None:
            out.append(path[0])
            path = path[1]
        out.reverse()
        return None, out[: len(out) - keep] if keep else out

    for able in [*steps, [(0, 0.0)]]:
        new: dict[int, tuple[float, tuple | None, int]] = {}
        for state, (was, path, size) in live.items():
            for s, c in able:
                if s < 0:
                    to, total, more = state, was + c, (path, size)
                else:
                    to = (state << 5 | s) & 0x7FFF
                    total, more = was + c + float(cost[state << 5 | s]), ((s, path), size + 1)
                if to not in new or total < new[to][0]:
                    new[to] = (total, *more)
        live = new
        longest = max(x[2] for x in live.values())
        if longest >= 2 * LAG:
            best = min(live.values(), key=lambda x: x[0])
            _, sure = settle(best, LAG)
            done += sure
            cut = len(sure)
            live = {k: v for k, v in ((k, _cut(v, cut)) for k, v in live.items())}
    _, rest = settle(min(live.values(), key=lambda x: x[0]), 0)
    return (done + rest)[:-1]


def _cut(state: tuple, drop: int) -> tuple:
    """A state whose path has lost its `drop` oldest symbols."""
    total, path, size = state
    kept = []
    while path is not None and len(kept) < size - drop:
        kept.append(path[0])
        path = path[1]
    out = None
    for s in reversed(kept):
        out = (s, out)
    return total, out, max(size - drop, 0)


def _noisy_chunks(points: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
    """Where chunks between white space stand that hold letters beside look-alikes, or a letter three times in a row."""
    letter = LETTER_OF[own] != 32
    alike = ALIKE_OF[np.minimum(points, 0x24F)]
    thrice = letter[2:] & (points[2:] == points[1:-1]) & (points[1:-1] == points[:-2])
    at = np.concatenate([np.flatnonzero(alike), np.flatnonzero(thrice)])
    if not len(at):
        return []
    space = np.flatnonzero(SPACE_OF[np.minimum(points, 0x24F)])
    k = np.unique(np.searchsorted(space, at))
    begin, end = np.append(0, space + 1)[k], np.append(space, len(points))[k]
    held = np.append(0, np.cumsum(letter))
    some = held[end] > held[begin]
    return list(zip(begin[some].tolist(), end[some].tolist()))


class Restorer:
    """Restores chunks between white space and stretches of single letters; short ones are remembered."""

    REMEMBERED = 200_000

    def __init__(self, cost: np.ndarray):
        self.cost, self.known = cost, {}

    def _words(self, symbols_of: list[int]) -> list[str]:
        return _WORD.findall("".join(LETTERS[s] for s in symbols_of))

    def _restore(self, chunk: str, spaced: bool) -> list[str]:
        core = chunk.rstrip(_EDGES).lstrip(_LEFT_EDGES)
        if spaced or _NOISY.search(core):
            return self._words(decode(lattice(core.lower(), spaced), self.cost))
        return _WORD.findall("".join(LETTERS[s] for s in symbols(core.lower()).tolist()))

    def chunk(self, chunk: str, spaced: bool = False) -> list[str]:
        key = (chunk, spaced)
        found = self.known.get(key)
        if found is None:
            found = self._restore(chunk, spaced)
            if len(chunk) <= 64:
                if len(self.known) >= self.REMEMBERED:
                    self.known.clear()
                self.known[key] = found
        return found

    def words(self, text: str) -> dict[str, str]:
        """Words of a text as they stand and as restored, and what each restored one was written as (other words: themselves)."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        own = symbols(text)
        out = {w: w for w in LETTER_OF[own].tobytes().decode("ascii").split()}
        for a, b in _noisy_chunks(points, own):
            for word in self.chunk(text[a:b]):
                out[word] = text[a:b]
        for m in _SPACED.finditer(text):
            for word in self.chunk(m.group(), True):
                out[word] = m.group()
        return out

    def text(self, text: str) -> str:
        """The whole text with what was disguised restored, the rest as it is."""

        def meant(m: re.Match, spaced: bool) -> str:
            core = m.group() if spaced else m.group().rstrip(_EDGES).lstrip(_LEFT_EDGES)
            if not spaced and not _NOISY.search(core):
                return m.group()
            words = self.chunk(core, spaced)
            return m.group().replace(core, " ".join(words)) if words and (spaced or _WORD.findall(core)) else m.group()

        text = _SPACED.sub(lambda m: meant(m, True), text)
        return re.sub(r"\S+", lambda m: meant(m, False), text)


def beginnings(word: str) -> list[str]:
    """A word's beginnings from short to long, the last with its end where it is short enough."""
    w = word + "."
    return [w[:n] for n in range(SHORTEST, min(len(w), LONGEST) + 1)]


def _restorer(sent) -> Restorer:
    held, key = worker_cache(), ("channel", sent.id)
    if key not in held:
        for old in [x for x in held if x[0] == "channel"]:
            del held[old]
        held[key] = Restorer(costs_of(sent.value))
    return held[key]


class Channel:
    """A broadcast of the character counts, SYMBOLS ** ORDER numbers, by which workers restore."""

    def __init__(self, docs: DataFrame, counts: np.ndarray):
        self.id, self.sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(counts)

    @property
    def value(self) -> np.ndarray:
        return self.sent.value


def deobfuscate(docs: DataFrame, channel: Channel | None = None, text_col: str = "text") -> DataFrame:
    """docs with its text column restored; null and plain texts stay as they are."""
    channel = channel or Channel(docs, character_counts(docs, text_col))
    at = docs.columns.index(text_col)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _restorer(channel)
        for batch in batches:
            texts = [None if t is None else own.text(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(restore, docs.schema)


def _beginning_counts(channel: Channel):
    """(label, text, half) rows to (piece, label, half, n): in how many of a task's documents a beginning occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _restorer(channel)
        for batch in batches:
            for keys, texts in by_size(batch, CHUNK_BYTES):
                seen: dict[int, Counter] = {}
                for key, text in zip(keys, texts):
                    seen.setdefault(key, Counter()).update({p for w in own.words(text or "") for p in beginnings(w)})
                for key, n in seen.items():
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array([key] * len(n), pa.int32()), pa.array(list(n.values()), pa.int64())], names=["piece", "key", "n"])

    return run


def surprising(k: np.ndarray, n: np.ndarray, many: np.ndarray, share: float) -> np.ndarray:
    """Which of the kinds of beginnings, with k of n documents toxic and `many` beginnings each, have more than chance gives.

    Chernoff's bound exp(-n KL(k / n, share)) stands for the p-value, Benjamini
    and Hochberg's step keeps false ones under FALSE_SHARE.
    """
    q = k / n
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = np.where(k > 0, q * np.log(q / share), 0.0) + np.where(k < n, (1 - q) * np.log((1 - q) / (1 - share)), 0.0)
    log_p = np.where(q > share, -n * apart, 0.0)
    order = np.argsort(log_p, kind="stable")
    fine = np.flatnonzero(log_p[order] <= np.log(FALSE_SHARE * np.cumsum(many[order]) / many.sum()))
    out = np.zeros(len(k), bool)
    out[order[: fine[-1] + 1 if len(fine) else 0]] = True
    return out


def telling_words(counts: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Weights of beginnings of words from counts (piece, k, c) of toxic and clean documents: telling ones and the frequent ones that go on from these.

    A beginning's share of toxic documents is drawn to its parent's, the
    beginning one letter shorter, as if that had PARENT documents more, and
    counts for no more than SURE, as both rest on the same documents; its weight
    is the log odds of the share over those of all documents.
    """
    if not toxic or not clean:
        return {}
    counts = counts.where(F.col("k") + F.col("c") >= MIN_DOCS)
    share = toxic / (toxic + clean)
    kinds = counts.groupBy("k", "c").agg(F.count("*").alias("n")).toArrow()
    if not kinds.num_rows:
        return {}
    k, c = kinds["k"].to_numpy(), kinds["c"].to_numpy()
    told = surprising(k, k + c, kinds["n"].to_numpy(), share)
    least: dict[int, int] = {}
    for a, b in zip(k[told].tolist(), c[told].tolist()):
        least[a] = max(least.get(a, 0), b)
    if not least:
        return {}
    # the more clean documents of as many toxic ones, the less telling, so a bound on c by k says it
    bound = F.get(F.array(*(F.lit(least.get(a, -1)) for a in range(max(least) + 1))), F.col("k").cast("int"))
    stems = F.broadcast(counts.where(F.col("c") <= bound).select(F.col("piece").alias("stem")).orderBy("stem").limit(MAX_KNOWN))
    parents = F.transform(F.sequence(F.lit(SHORTEST), F.greatest(F.length("piece"), F.lit(SHORTEST))), lambda n: F.substring("piece", F.lit(1), n))
    known = counts.withColumn("stem", F.explode(parents)).join(stems, "stem", "left_semi").groupBy("piece").agg(F.first("k").alias("k"), F.first("c").alias("c"))
    rows = known.orderBy(F.desc(F.col("k") + F.col("c")), "piece").limit(MAX_KNOWN).collect()
    shares: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: len(r["piece"])):
        before = min(max(shares.get(r["piece"][:-1], share), 1 - SURE), SURE)
        shares[r["piece"]] = (r["k"] + PARENT * before) / (r["k"] + r["c"] + PARENT)
    return {p: float(np.log(q / (1 - q)) - np.log(share / (1 - share))) for p, q in shares.items()}


class Telling:
    """Weights by beginning, and the heads that any known beginning has."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.heads = weights, {p[:SHORTEST] for p in weights}

    def weight(self, word: str) -> float:
        """The weight of the longest known beginning of a word."""
        if (word + ".")[:SHORTEST] not in self.heads:
            return 0.0
        return next((self.weights[p] for p in reversed(beginnings(word)) if p in self.weights), 0.0)

    def evidence(self, words: dict[str, str]) -> tuple[float, list[tuple[str, str, float]]]:
        """The sum of the words' weights, and the telling words as (found, restored, weight)."""
        found = [(written, word, w) for word, written in words.items() if (w := self.weight(word)) > 0]
        found.sort(key=lambda x: (-x[2], x[1]))
        return sum(x[2] for x in found), found


def calibrate(bins: dict[tuple[int, int], int]) -> tuple[float, float]:
    """Intercept and slope of the log odds on the evidence, from counts by (evidence, label): Newton's steps, held by a weak prior."""
    if not bins:
        return 0.0, 0.0
    z = np.array([k[0] for k in bins], float)
    y = np.array([k[1] for k in bins], float)
    n = np.array(list(bins.values()), float)
    # one pseudo-document each way at no evidence and at some keeps both finite
    z, y, n = np.append(z, [0, 0, 8, 8]), np.append(y, [0, 1, 0, 1]), np.append(n, [0.5, 0.005, 0.005, 0.5])
    beta, x = np.zeros(2), np.stack([np.ones(len(z)), z])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        grad = x @ (n * (y - p)) - np.array([0.0, 1e-3]) * beta
        step = np.linalg.solve((x * (n * p * (1 - p))) @ x.T + np.diag([1e-6, 1e-3]), grad)
        beta = beta + np.clip(step, -2, 2)
    return float(beta[0]), float(max(beta[1], 0.0))


def _scores(channel: Channel, weights, line: tuple[float, float]):
    """Rows (id, text) to (id, z, score, evidence)."""
    key = ("telling", uuid.uuid4().hex)
    kind = pa.list_(pa.struct([("found", pa.string()), ("restored", pa.string()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = _restorer(channel), worker_cache()
        if key not in held:
            for old in [x for x in held if x[0] == "telling"]:
                del held[old]
            held[key] = Telling(weights.value)
        told = held[key]
        for batch in batches:
            for ids, texts in by_size(batch, CHUNK_BYTES):
                got = [told.evidence(own.words(t or "")) for t in texts]
                z = np.minimum(np.array([g[0] for g in got]), 50.0)
                score = 1 / (1 + np.exp(-(line[0] + line[1] * z)))
                shown = pa.array([[{"found": a, "restored": b, "weight": c} for a, b, c in g[1]] for g in got], kind)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(z), pa.array(score), shown], names=["id", "z", "score", "evidence"])

    return run


def _scored(docs: DataFrame, channel: Channel, weights: dict[str, float], line: tuple[float, float]) -> DataFrame:
    """docs (id, text) to (id, z, score, evidence)."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(_scores(channel, sent, line), f"id {kind}, z double, score double, evidence array<struct<found: string, restored: string, weight: double>>")


def labelled_sample(docs: DataFrame, labels: DataFrame, trains: Column, most: int, label_col: str, id_col: str) -> DataFrame:
    """(label int, text string, half int) of documents with a label that may teach, about `most` of them by a hash of the id.

    A label other than 0 counts as 1; an id labelled twice is 1 if either is.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & trains)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) != 0).cast("int")).alias("label"))
    if most:
        n = known.count()
        known = known.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(n, 1))))
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int")
    chosen = F.broadcast(known) if most else known
    return docs.select(F.col(id_col).alias("id"), F.col("text")).join(chosen, "id").select("label", "text", half.alias("half"))


def fit(sample: DataFrame, channel: Channel) -> tuple[dict[str, float], tuple[float, float]]:
    """Weights of beginnings of words and the calibration, each half of the sample scored by what the other taught."""
    scratch = Scratch(sample.sparkSession, "toxicity")
    sample = scratch.save(sample)
    sizes = {(r["label"], r["half"]): r["n"] for r in sample.groupBy("label", "half").agg(F.count("*").alias("n")).collect()}
    pieces = sample.select((F.col("label") * 2 + F.col("half")).alias("key"), "text").mapInArrow(_beginning_counts(channel), "piece string, key int, n long")
    cells = [F.sum(F.when(F.col("key") == k, F.col("n")).otherwise(0)).alias(name) for k, name in enumerate(("c0", "c1", "k0", "k1"))]
    counts = scratch.save(pieces.groupBy("piece").agg(*cells).where(F.col("c0") + F.col("c1") + F.col("k0") + F.col("k1") >= MIN_DOCS))

    def taught(halves: tuple[int, ...]) -> dict[str, float]:
        both = counts.select("piece", *(sum((F.col(f"{x}{h}") for h in halves), F.lit(0)).alias(x) for x in "kc"))
        return telling_words(both, sum(sizes.get((1, h), 0) for h in halves), sum(sizes.get((0, h), 0) for h in halves))

    bins: dict[tuple[int, int], int] = {}
    for half in (0, 1):
        other = sample.where(F.col("half") == half).select(F.col("label").alias("id"), "text")
        rows = _scored(other, channel, taught((1 - half,)), (0.0, 0.0))
        for r in rows.groupBy(F.round("z").cast("int").alias("z"), "id").agg(F.count("*").alias("n")).collect():
            bins[r["z"], r["id"]] = bins.get((r["z"], r["id"]), 0) + r["n"]
    weights = taught((0, 1))
    scratch.drop(sample, counts)
    return weights, calibrate(bins)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, trains: Column | None = None, most: int = MAX_LABELLED, threshold: float = THRESHOLD,
    text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id",
) -> DataFrame:
    """(id, score, predicted, evidence) of every row of docs, evidence the telling words as found and as restored.

    A null or empty text has the score of a text without evidence; null and
    repeated ids keep their rows; without labels of both kinds all scores are
    alike.  trains says of labels' id whether it may teach (all may).  Extra
    columns go.
    """
    docs = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    channel = Channel(docs, character_counts(docs))
    sample = labelled_sample(docs, labels, F.lit(True) if trains is None else trains, most, label_col, id_col)
    weights, line = fit(sample, channel)
    rows = _scored(docs.select(F.col(id_col).alias("id"), "text"), channel, weights, line)
    return rows.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
