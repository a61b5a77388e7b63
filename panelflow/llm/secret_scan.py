"""Secret scans: fixed patterns, and a battery of randomness tests on the other long tokens.

DataFrame functions only.  Offsets are in code points, ends exclusive.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in listed order, pattern, least length, and the group that length is of.
KINDS = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    "access": (r"AKIA[A-Z0-9]+", 20, 0),
    "hex": (r"[0-9a-f]{24,}+", 24, 0),
}
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
RANDOM = "random"
TOKEN, LEAST = r"[A-Za-z0-9+/_=-]{20,}+", 20
#: Encodings in the order they are inferred: name, pattern of whole tokens, symbols in code order, chance that two symbols of written text agree.
ENCODINGS = (
    ("decimal", "^[0-9]+$", "0123456789", 0.13),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.11),
    ("letters", "^([a-z]+|[A-Z]+|[A-Z][a-z]+)$", "abcdefghijklmnopqrstuvwxyz", 0.075),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.07),
    ("base36", "^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.07),
    ("base62", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0.065),
    ("base64", ".*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 0.06),
)
#: Lower bounds of the length classes in which false discoveries are controlled, each at RATE.
LENGTHS, RATE = (20, 32, 48, 64, 128), 0.01
#: How many times wider than for random symbols the runs and serial deviations of written tokens are taken to spread.
SPREAD = 3.0
#: Encodings whose tokens are decoded as well, and how often a byte of text and a random one (98 of 256) can be read.
DECODED, READABLE, CHANCE = ("hex", "base62", "base64"), 0.98, 98 / 256
STEP, MOST_BINS = 0.1, 2000
#: Parts of a text that one fold strings together; more are folded by chunks.
FOLD = 1024
_MARK = "\x01"


def _matches(t: Column, pattern: str, keep, kind: int) -> Column:
    """Array of (s, e, k, x) of the matches of pattern that keep() accepts.

    The text's own marks were replaced before by another control character,
    which no pattern takes, so every mark found is one set around a match.
    """
    none = F.array().cast("array<struct<s:bigint,e:bigint,k:int,x:string>>")

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.length(x)
        found = F.array(F.struct(a["at"].alias("s"), end.alias("e"), F.lit(kind).alias("k"), x.alias("x")))
        return F.struct(end.alias("at"), (~a["odd"]).alias("odd"), F.when(a["odd"] & keep(x), F.concat(a["out"], found)).otherwise(a["out"]).alias("out"))

    def fold(parts: Column, at: Column) -> Column:
        start = F.struct(at.cast("long").alias("at"), F.lit(False).alias("odd"), none.alias("out"))
        return F.aggregate(parts, start, step, lambda a: a["out"])

    def chunked(parts: Column) -> Column:
        """A fold copies its array at every match, so long texts fold FOLD parts at a time, each from where it begins."""
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(parts) / FOLD).cast("int") - 1), lambda c: F.slice(parts, c * FOLD + 1, F.lit(FOLD)))
        sizes = F.transform(cut, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.length(x)))
        begin = F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda b, n: F.array_append(b, F.element_at(b, -1) + n))
        return F.flatten(F.zip_with(cut, begin, lambda c, b: F.when(c.isNotNull(), fold(c, b)).otherwise(none)))

    parts = F.split(F.regexp_replace(t, pattern, f"{_MARK}$0{_MARK}"), _MARK)
    found = F.transform(F.array(parts), lambda p: F.when(F.size(p) <= 2 * FOLD, fold(p, F.lit(0))).otherwise(chunked(p)))
    return F.get(found, F.lit(0))


def _base(t: Column) -> Column:
    none = F.array().cast("array<struct<s:bigint,e:bigint,k:int,x:string>>")
    # a one-element array binds the lower-cased text, so that it is made once
    keyword = F.exists(F.array(F.lower(t)), lambda low: reduce(or_, (low.contains(word) for word in KEYWORDS)))
    likely = {"assign": keyword, "access": t.contains("AKIA"), "hex": t.rlike("[0-9a-f]{24}")}
    found = []
    for k, (kind, (pattern, least, group)) in enumerate(KINDS.items()):
        keep = (lambda x, p=pattern, n=least, g=group: F.length(F.regexp_extract(x, p, g)) >= n) if group else (lambda x, n=least: F.length(x) >= n)
        found.append(F.when(likely[kind], _matches(t, pattern, keep, k)).otherwise(none))
    return F.concat(*found)


def _decoded(name: Column, body: Column) -> Column:
    """log10 of how much likelier the bytes that a token encodes are to be random than text; null where it is not decoded.

    Whole groups of symbols are decoded.  A byte can be read if it is printable
    ASCII or white space, all can if they are UTF-8 without control characters.
    """
    whole = lambda x, group: F.substring(x, F.lit(1), (F.length(x) - F.length(x) % group).cast("int"))
    data = F.when(name == "hex", F.unhex(whole(body, 2))).otherwise(F.unbase64(whole(F.translate(body, "-_=", "+/"), 4)))

    def ratio(b: Column) -> Column:
        plain = F.decode(b, "ISO-8859-1")
        ascii_ = F.length(F.regexp_replace(plain, r"[^\x20-\x7E\t\r\n]", ""))
        text = F.is_valid_utf8(b.cast("string")) & ~plain.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")
        read = F.when(text, F.octet_length(b)).otherwise(ascii_)
        return read * math.log10(CHANCE / READABLE) + (F.octet_length(b) - read) * math.log10((1 - CHANCE) / (1 - READABLE))

    return F.when(name.isin(*DECODED), F.get(F.transform(F.array(data), ratio), F.lit(0)))


def _battery(x: Column) -> Column:
    """Of one token: its encoding, length, the deviations of the three tests and `rare`, -log10 of their combined p-value.

    Each test weighs how likely its deviation is for random symbols of the
    encoding against written ones: chi-squared by the agreement of symbols that
    the encoding's writing has, runs and serial correlation by a spread of
    SPREAD.  The product of the three ratios exceeds x for written tokens with a
    chance of 1 / x at most, so its inverse is a p-value.  Text that is encoded
    looks random to these, so its bytes are held against text as well, and the
    larger p-value of the two counts.  A token that any one
    test calls far from random has a p-value of 1, as has one that is too even.
    """
    name, size, symbols, agree = (F.coalesce(*(F.when(x.rlike(p), F.lit(of(n, a, q))) for n, p, a, q in ENCODINGS)) for of in (lambda n, a, q: n, lambda n, a, q: len(a), lambda n, a, q: a, lambda n, a, q: q))
    body = F.rtrim(F.when(name.isin("hex", "letters"), F.lower(x)).when(name == "base36", F.lower(x)).otherwise(x), F.lit("="))
    head = F.struct(name.alias("name"), size.cast("double").alias("a"), symbols.alias("symbols"), agree.alias("q"), body.alias("x"))

    def tests(h: Column) -> Column:
        n = F.length(h["x"]).cast("double")
        chars = F.split(h["x"], "")
        codes = F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.instr(h["symbols"], c).cast("double") - 1)
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + F.when(c == "", 0.0).otherwise(F.pow(n - F.length(F.replace(h["x"], c, F.lit(""))), F.lit(2.0))))
        return F.struct(h["name"].alias("name"), h["a"].alias("a"), h["q"].alias("q"), n.alias("n"), codes.alias("codes"), squares.alias("squares"))

    def sums(h: Column) -> Column:
        half = (h["a"] - 1) / 2
        start = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("high"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"), F.lit(0.0).alias("sl"))

        def step(a: Column, c: Column) -> Column:
            again = (a["last"] >= 0) & ((a["last"] > half) == (c > half))
            return F.struct(c.alias("last"), (a["runs"] + F.when(again, 0.0).otherwise(1.0)).alias("runs"), (a["high"] + F.when(c > half, 1.0).otherwise(0.0)).alias("high"), (a["s"] + c).alias("s"), (a["ss"] + c * c).alias("ss"), (a["sl"] + F.when(a["last"] >= 0, a["last"] * c).otherwise(F.element_at(h["codes"], -1) * c)).alias("sl"))

        z = F.aggregate(h["codes"], start, step)
        return F.struct(h["name"].alias("name"), h["a"].alias("a"), h["q"].alias("q"), h["n"].alias("n"), h["squares"].alias("squares"), z.alias("z"))

    def result(h: Column) -> Column:
        n, a, z = h["n"], h["a"], h["z"]
        chi = a / n * h["squares"] - n
        z_chi = (chi - (a - 1)) / F.sqrt(2 * (a - 1))
        low = n - z["high"]
        mean = 2 * z["high"] * low / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        z_runs = F.when(var > 0, (z["runs"] - mean) / F.sqrt(var)).otherwise(9.0)
        spread = n * z["ss"] - z["s"] * z["s"]
        z_serial = F.when(spread > 0, (n * z["sl"] - z["s"] * z["s"]) / spread * F.sqrt(n)).otherwise(9.0)
        more = (n - 1) * (a * h["q"] - 1)
        z_text = (chi - (a - 1) - more) / F.sqrt(2 * (a - 1) + 4 * more)
        even = F.log(F.sqrt(1 + 2 * more / (a - 1))) + (z_text * z_text - z_chi * z_chi) / 2
        wide = lambda z: math.log(SPREAD) - z * z * (1 - SPREAD**-2) / 2
        rare = F.greatest(F.lit(0.0), F.least((even + wide(z_runs) + wide(z_serial)) / math.log(10), _decoded(h["name"], body)))
        return F.struct(h["name"].alias("name"), F.length(x).alias("n"), z_chi.alias("z_chi"), z_runs.alias("z_runs"), z_serial.alias("z_serial"), rare.alias("rare"))

    def chain(first: Column, *steps) -> Column:
        for s in steps:
            first = F.transform(F.array(first), s)[0]
        return first

    return F.when(F.length(F.rtrim(x, F.lit("="))) >= LEAST, chain(head, tests, sums, result))


def _class(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(LENGTHS):
        out = F.when(n >= least, i).otherwise(out)
    return out


def cutoffs(counts: list[tuple[int, int, int]], rate: float = RATE) -> dict[int, float]:
    """Benjamini-Hochberg in each length class over (class, bin of -log10 p, tokens): the least -log10 p that is a discovery."""
    out = {}
    for k in {c for c, _, _ in counts}:
        bins = sorted(((b, n) for c, b, n in counts if c == k), reverse=True)
        total, seen = sum(n for _, n in bins), 0
        for b, n in bins:
            seen += n
            if b * STEP >= -math.log10(rate * seen / total):
                out[k] = b * STEP
    return out


def find_secrets(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> DataFrame:
    """docs with `_base` and `_random`: arrays of (s, e, k, x), base spans by place and kind, tokens that pass as random by place.

    Null and empty texts have no span.  A token that overlaps a base span is
    not tested again.  Equal texts get equal spans; an empty table stays empty.
    Columns of docs named `_base` or `_random` are replaced.  The corpus gives
    the tests one histogram of at most a few thousand bins.
    """
    t = F.translate(F.coalesce(F.col(text_col), F.lit("")), _MARK, "\x02")
    found = docs.drop("_base", "_random").withColumn("_base", F.array_sort(_base(t)))
    other = F.when(t.rlike(f"[A-Za-z0-9+/_=-]{{{LEAST}}}"), _matches(t, TOKEN, lambda x: F.length(x) >= LEAST, len(KINDS))).otherwise(F.array().cast("array<struct<s:bigint,e:bigint,k:int,x:string>>"))
    apart = F.filter(other, lambda o: ~F.exists(F.col("_base"), lambda b: (b["s"] < o["e"]) & (o["s"] < b["e"])))
    tested = F.filter(F.transform(apart, lambda o: F.struct(o.alias("o"), _battery(o["x"]).alias("r"))), lambda y: y["r"].isNotNull())
    found = found.withColumn("_random", tested)
    r = found.select(F.explode("_random").alias("y")).select(_class(F.col("y.r.n")).alias("c"), F.least(F.floor(F.col("y.r.rare") / STEP), F.lit(MOST_BINS)).cast("int").alias("b"))
    cuts = cutoffs([tuple(x) for x in r.groupBy("c", "b").count().collect()], rate)

    def secret(y: Column) -> Column:
        rare = F.lit(False)
        for k, least in cuts.items():
            rare |= (_class(y["r"]["n"]) == k) & (F.floor(y["r"]["rare"] / STEP) * STEP >= least - 1e-9)
        return rare

    return found.withColumn("_random", F.transform(F.filter("_random", secret), lambda y: y["o"]))


def count_kind(spans: Column, kind: str) -> Column:
    number = list(KINDS).index(kind)
    return F.size(F.filter(spans, lambda s: s["k"] == number)).cast("long")


def written(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in (*KINDS, RANDOM)))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["s"].cast("string"), s["e"].cast("string"))))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by mask; overlapping spans become one.  Null texts stay null."""
    found = find_secrets(docs, text_col)
    spans = F.array_sort(F.concat("_base", "_random"))
    t = F.col(text_col)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.when(s["s"] >= a["at"], F.concat(F.substring(t, (a["at"] + 1).cast("int"), (s["s"] - a["at"]).cast("int")), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], s["e"]).alias("at"), F.concat(a["out"], gap).alias("out"))

    whole = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(t, (a["at"] + 1).cast("int"), F.length(t))))
    return found.withColumn(text_col, F.when(t.isNull() | (F.size(spans) == 0), t).otherwise(whole)).drop("_base", "_random")
