"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

DataFrame functions only.  The corpus enters the fit, on the driver, as counts of
vote patterns, at most 3 ** len(RULES) rows however many documents there are.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.llm.common import SPACE, Scratch

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bits of a packed key that hold a window's place; longer texts take the exact path.
PLACE = 20
ROUNDS = 50
KEEP_AT = 0.5
#: What the priors expect: the share of bad documents, how often a kind of defect fires its own rule and another, and a good document any.
BAD, OWN, OTHER, MISS = 0.1, 0.8, 0.2, 0.01
#: Weights of the priors of a defect's rates and of a good document's, as parts of the corpus.
WEIGHT_BAD, WEIGHT_GOOD = 0.002, 0.02
#: ASCII digits and marks; any other character in a word counts as a letter.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())
#: Words between which the share of distinct ones tells something: it falls with a text's length.
FEW, MANY = 30, 3000

#: name: (value, bad from, good up to); between the two, or where value is null, a rule abstains.
#: Every defect shows in two rules or more, so that agreement tells a defect from a rule's noise.
RULES = {
    "symbols_per_word": (lambda c: c("n_symbols") / c("n_words"), 0.3, 0.05),
    "repeated_words": (lambda c: c("n_repeat_words") / c("n_words"), 0.3, 0.1),
    "repeated_lines": (lambda c: F.when(c("n_lines") >= 4, c("n_dup_lines") / c("n_lines")), 0.5, 0.05),
    "capitals": (lambda c: c("n_upper") / c("word_chars"), 0.4, 0.15),
    "exclamations": (lambda c: c("n_exclaim") / c("n_words"), 0.3, 0.05),
    "marks": (lambda c: c("n_marks") / c("word_chars"), 0.2, 0.1),
    "few_distinct": (lambda c: F.when(c("n_words").between(FEW, MANY), 1 - c("n_distinct") / c("n_words")), 0.65, 0.5),
    "word_length": (lambda c: F.abs(c("word_chars") / c("n_words") - 6.0), 5.0, 3.0),
}


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeated_words(w: Column) -> Column:
    """Words inside three-word windows found twice or more.

    Sorts keys of a window's hash and place; windows of equal hashes are
    compared word by word, and where two differ all windows are sorted as text.
    """
    n = F.size(w)
    places = F.sequence(F.lit(0), n - 3)
    mask = F.lit((1 << PLACE) - 1).cast("long")

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("sum"))
        return F.aggregate(p, start, lambda a, x: F.struct(x.alias("at"), (a["sum"] + F.least(F.lit(3), x - a["at"])).alias("sum")), lambda a: a["sum"])

    def at(i: Column, d: int) -> Column:
        return F.get(w, (i + d).cast("int"))

    def same(i: Column, j: Column) -> Column:
        return (at(i, 0) == at(j, 0)) & (at(i, 1) == at(j, 1)) & (at(i, 2) == at(j, 2))

    keys = F.sort_array(F.transform(places, lambda i: F.shiftleft(F.shiftright(F.xxhash64(at(i, 0), at(i, 1), at(i, 2)), PLACE), PLACE).bitwiseOR(i.cast("long"))))

    def of_keys(k: Column) -> Column:
        equal = lambda j, d: F.coalesce(F.shiftright(F.get(k, j).bitwiseXOR(F.get(k, j + d)), PLACE) == 0, F.lit(False))
        place = lambda j: F.get(k, j).bitwiseAND(mask).cast("int")
        twins = F.filter(places, lambda j: equal(j, 1) | equal(j, -1))
        clash = F.exists(twins, lambda j: equal(j, 1) & ~same(place(j), place(j + 1)))
        texts = F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", at(i, 0), at(i, 1), at(i, 2)).alias("t"), i.alias("i"))))
        return F.when(~clash, covered(F.sort_array(F.transform(twins, place)))).otherwise(exact(texts))

    def exact(s: Column) -> Column:
        t = lambda j: F.get(s, j)["t"]
        twins = F.filter(places, lambda j: F.coalesce(t(j) == t(j + 1), F.lit(False)) | F.coalesce(t(j) == t(j - 1), F.lit(False)))
        return covered(F.sort_array(F.transform(twins, lambda j: F.get(s, j)["i"])))

    # one-element arrays bind what several expressions read, so that it is made once
    fast = F.transform(F.array(keys), of_keys)[0]
    slow = F.transform(F.array(F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", at(i, 0), at(i, 1), at(i, 2)).alias("t"), i.alias("i"))))), exact)[0]
    return F.when(n < 3, F.lit(0).cast("long")).when(n < (1 << PLACE), fast).otherwise(slow)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct column `_q` of counts; a null text has no words.  Other columns stay as they are."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(t, f"{SPACE}+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    length, word_chars = F.length(t), _without(t, WHITE)
    # one struct, named as no caller's column can be by the names that are replaced
    first = docs.withColumn("_q", F.struct(words.alias("w"), lines.alias("l")))
    w, l = F.col("_q.w"), F.col("_q.l")  # noqa: E741
    counts = {
        "n_words": F.size(w), "word_chars": word_chars, "n_symbols": length - _without(t, SYMBOLS), "n_lines": F.size(l),
        "n_dup_lines": F.size(l) - F.size(F.array_distinct(l)), "n_repeat_words": _repeated_words(w),
        "n_upper": length - _without(t, UPPER), "n_exclaim": length - _without(t, "!"),
        "n_marks": length - _without(t, MARKS), "n_distinct": F.size(F.array_distinct(w)),
    }
    return first.withColumn("_q", F.struct(*(v.cast("long").alias(k) for k, v in counts.items())))


def _count(name: str) -> Column:
    return F.col("_q")[name]


def votes() -> Column:
    """An array of one byte a rule: 1 bad, 0 good, null abstains."""
    out = []
    for value, bad, good in RULES.values():
        v = F.when(_count("n_words") > 0, value(_count))
        out.append(F.when(v >= bad, 1).when(v <= good, 0).cast("byte"))
    return F.array(*out)


def base_failed() -> Column:
    return (_count("n_words") < 50) | (100 * _count("n_repeat_words") > 50 * _count("n_words"))


def fit(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = ROUNDS) -> dict:
    """Expectation-maximisation over (votes, number of documents): good documents, and as many kinds of defect as rules.

    A bad document has one kind of defect, which starts out as what fires the
    rule of its number; how often each kind and good documents fire each rule is
    estimated, an abstention says nothing.  Rules that agree more often than
    noise would make a kind of defect; a rule that fires alone, where all others
    call the document good, is found to be noise of good documents, and is
    outvoted.  Weak priors hold rules with few votes.  No document: the priors.
    Returns each class's share and its rates by rule, good documents first.
    """
    k = len(patterns[0][0]) if patterns else len(RULES)
    n = np.array([n for _, n in patterns], float)
    fired = np.array([[v == 1 for v in vote] for vote, _ in patterns], float).reshape(-1, k)
    voted = np.array([[v is not None for v in vote] for vote, _ in patterns], float).reshape(-1, k)
    own = np.eye(k, dtype=bool)
    expect = np.vstack([np.full(k, MISS), np.where(own, OWN, OTHER)])
    weight = max(1.0, n.sum()) * np.array([WEIGHT_GOOD, *[WEIGHT_BAD] * k])
    share0 = np.array([1 - BAD, *[BAD / k] * k])
    share, rate = share0, expect
    for _ in range(rounds if len(patterns) else 0):
        odds = np.log(share) + fired @ np.log(rate).T + (voted - fired) @ np.log1p(-rate).T
        p = np.exp(odds - odds.max(axis=1, keepdims=True))
        p *= (n / p.sum(axis=1))[:, None]
        share = (p.sum(axis=0) + share0 * weight[0]) / (n.sum() + weight[0])
        rate = (p.T @ fired + expect * weight[:, None]) / (p.T @ voted + weight[:, None])
        rate = rate.clip(1e-4, 1 - 1e-4)
    return {"share": share.tolist(), "rate": rate.tolist()}


def posterior(model: dict) -> Column:
    """Probability that a document is good, given its votes in `_v`."""

    def vote(j: int, good: float, bad: float) -> Column:
        v = F.col("_v")[j]
        return F.when(v == 1, math.log(bad / good)).when(v == 0, math.log((1 - bad) / (1 - good))).otherwise(0.0)

    good, *kinds = zip(model["share"], model["rate"])
    odds = []
    for share, rate in kinds:
        votes = (vote(j, g, b) for j, (g, b) in enumerate(zip(good[1], rate)))
        odds.append(F.exp(sum(votes, F.lit(math.log(share / good[0])))))
    return 1 / (1 + sum(odds, F.lit(0.0)))


def score_quality(docs: DataFrame, text_col: str = "text", only: list[str] | None = None) -> DataFrame:
    """docs, or their columns `only`, with `_q` (counts), `_v` (votes), `base_failed`, `p_quality` and `kept`.

    A document is kept if the base rules pass and its posterior reaches KEEP_AT.
    Null and blank texts have zero counts and fail; equal rows score alike; an
    empty table stays empty.  Columns of docs by the five names are replaced.
    With `only`, counts are made once and written to the shared folder; whole
    rows are measured again rather than written.
    """
    judged = measure(docs.drop("_q", "_v", "base_failed", "p_quality", "kept"), text_col).withColumn("_v", votes())
    if only is not None:
        judged = Scratch(docs.sparkSession, "quality").save(judged.select(*only, "_q", "_v"))
    rows = judged.groupBy("_v").count().collect()
    model = fit([(tuple(r["_v"]), r["count"]) for r in rows])
    judged = judged.withColumn("base_failed", base_failed()).withColumn("p_quality", posterior(model))
    # a filter on kept is not moved below a row number, where every use of a count would make the count anew
    in_place = F.monotonically_increasing_id() >= 0
    return judged.withColumn("kept", in_place & ~F.col("base_failed") & (F.col("p_quality") >= KEEP_AT))
