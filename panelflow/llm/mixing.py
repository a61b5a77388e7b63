"""Soft-membership mixing: domain posteriors from a labelled table, and document rates that meet token targets.

DataFrame functions only.  What reaches the driver is bounded: the vocabulary
(VOCABULARY words), one row a domain, and sums over domain pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.llm.common import Scratch

#: Bound of the labelled sample, chosen by a hash of the id; the words kept, and the documents a word must be in.
MAX_LABELLED, VOCABULARY, LEAST_DOCS = 20_000, 500, 10
#: How many times likelier a word must be in one domain than in the others to tell anything.
TELLING = 3.0
ROUNDS, CLOSE = 30, 1e-3
#: Share of expected tokens by domain, in production; domains are written q<quality>t<toxic>.
TARGETS = {"q1t0": 0.95, "q0t0": 0.03, "q1t1": 0.015, "q0t1": 0.005}


def tokens(text: Column) -> Column:
    """A struct of n, the words of a text, and words: the distinct ones in lower case, and tokens for texts full of capitals, of marks or of repeats."""
    t = F.coalesce(text, F.lit(""))
    share = lambda marks: 1 - F.length(F.translate(t, marks, "")) / F.greatest(F.length(t), F.lit(1))
    flags = [F.when(share("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 0.4, F.lit(" capitals")), F.when(share("#*$%&|<>!") > 0.05, F.lit(" marks"))]
    parts = F.array_remove(F.split(F.lower(t), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")

    def made(p: Column) -> Column:
        d = F.array_distinct(p)
        return F.struct(F.size(p).cast("long").alias("n"), F.transform(F.array(d), lambda d: F.array_compact(F.concat(d, F.array(*flags, F.when((F.size(p) > 40) & (F.size(d) < 0.25 * F.size(p)), F.lit(" repeats"))))))[0].alias("words"))

    return F.transform(F.array(parts), made)[0]


def sample_labels(labels: DataFrame, id_col: str, most: int = MAX_LABELLED) -> DataFrame:
    """(id, domain) of at most about `most` labelled rows: all, or those whose hash of the id falls below a share."""
    known = labels.where("quality is not null and toxic is not null").groupBy(F.col(id_col).alias("id")).agg(F.concat(F.lit("q"), F.min("quality").cast("string"), F.lit("t"), F.max("toxic").cast("string")).alias("domain"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return known


def fit_classifier(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[list[str], list[float], list[tuple]]:
    """Bernoulli naive Bayes on the presence of telling words.

    Domains; log odds of a text with none of the words (priors and absences);
    and (word, what its presence adds by domain).
    """
    known = sample_labels(labels, id_col)
    words = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("domain", F.explode(F.array_append(tokens(F.col("text"))["words"], "")).alias("word"))
    counts = words.groupBy("domain", "word").count()
    sizes = {r[0]: r[1] for r in counts.where("word = ''").select("domain", "count").collect()}
    domains, total = sorted(sizes), sum(sizes.values())
    if not domains:
        return [], [], []
    by = [F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("count"))), F.lit(0)).alias(f"n{i}") for i, d in enumerate(domains)]
    per_word = counts.where("word <> ''").groupBy("word").agg(F.sum("count").alias("n"), *by).where(F.col("n") >= LEAST_DOCS)
    share = [(F.col(f"n{i}") + 0.5 * F.col("n") / total) / (sizes[d] + 1.0) for i, d in enumerate(domains)]
    overall = F.col("n") / total
    # the part of the mutual information of word and domain that lies where the word is present
    gain = sum(F.col(f"n{i}") * F.log(x / overall) for i, x in enumerate(share))
    rest = [(F.col("n") - F.col(f"n{i}") + 0.5) / (total - sizes[d] + 1.0) for i, d in enumerate(domains)]
    telling = F.greatest(*(x / y for x, y in zip(share, rest)), F.lit(0.0)) >= TELLING
    best = per_word.where(telling).select("word", *(x.alias(f"l{i}") for i, x in enumerate(share)), gain.alias("gain")).orderBy(F.desc("gain"), "word").limit(VOCABULARY).drop("gain").collect()
    cut = lambda x: min(max(x, 1e-6), 1 - 1e-6)
    none = [math.log(sizes[d] / total) + sum(math.log(1 - cut(r[i + 1])) for r in best) for i, d in enumerate(domains)]
    return domains, none, [(r[0], *(math.log(cut(x) / (1 - cut(x))) for x in r[1:])) for r in best]


def posteriors(docs: DataFrame, model: tuple, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, p): words of each document and its probability of each domain.

    A text without known words has their absence to go by; of rows that repeat
    an id, the one of most words counts.  The known words are data of the plan:
    each row finds its own, so no word is dealt out or joined.
    """
    domains, prior, vocabulary = model
    known = [r[0] for r in vocabulary]
    odds = F.lit([float(x) for x in prior])
    if known:
        adds = F.map_from_arrays(F.lit(known), F.lit([[float(x) for x in r[1:]] for r in vocabulary]))
        hits = F.filter("t.words", lambda w: w.isin(known))
        odds = F.aggregate(hits, odds, lambda so_far, w: F.zip_with(so_far, F.element_at(adds, w), lambda x, y: x + y))
    found = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    rows = found.select("id", F.struct(F.col("t.n").alias("n_tokens"), odds.alias("odds")).alias("own"))
    best = rows.groupBy("id").agg(F.max("own").alias("own")).select("id", "own.n_tokens", "own.odds")
    e = [F.exp(F.get("odds", F.lit(i)) - F.array_max("odds")) for i in range(len(domains))]
    return best.select("id", "n_tokens", F.array(*(x / sum(e[1:], e[0]) for x in e)).alias("p"))


def solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Gaussian elimination with a ridge, for the few domains."""
    k = len(b)
    ridge = 1e-9 * max(a[i][i] for i in range(k)) + 1e-12
    m = [[a[i][j] + (ridge if i == j else 0.0) for j in range(k)] + [b[i]] for i in range(k)]
    for i in range(k):
        best = max(range(i, k), key=lambda r: abs(m[r][i]))
        m[i], m[best] = m[best], m[i]
        for r in range(k):
            if r != i:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i])]
    return [m[i][k] / m[i][i] for i in range(k)]


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float]) -> tuple[Column, list[dict]]:
    """Projected gradient descent on 1/2 * sum over domains of (expected tokens - target) ** 2 over rates >= 0, from rates of 1.

    Distances between rates are weighted by the documents' tokens, so that a
    document's gradient is its posterior times the residuals, and its rate is a
    fold over the residuals of all rounds.  A round is one distributed aggregate
    of a few sums.  Residuals are scaled by the curvature over documents whose
    rate is positive, a small matrix of domain pairs: one step size for all
    would take some hundred rounds where domains differ a hundredfold in size.
    Returns the rate as a column of `p`, and the domains' totals.
    """
    k = len(domains)
    p = [F.get("p", F.lit(i)) for i in range(k)]
    share = [max(0.0, targets.get(d, 0.0)) for d in domains]
    if sum(share) <= 0:
        share = [1.0] * k
    share = [x / sum(share) for x in share]
    steps, budget, seen = [], None, []

    def rated() -> Column:
        """Folds over the steps so far; they are data of the plan, so no round needs new code."""
        past = F.lit(steps) if steps else F.array().cast("array<array<double>>")
        return F.aggregate(past, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - sum(F.get(g, F.lit(i)) * p[i] for i in range(k))))

    goal = [0.0] * k
    for _ in range(ROUNDS + 1):
        t = F.col("n_tokens").cast("double")
        now = members.select(t.alias("t"), *(x.alias(f"p{i}") for i, x in enumerate(p)), rated().alias("r"))
        free = F.when(F.col("r") > 0, F.col("t")).otherwise(0.0)
        row = now.agg(*(F.sum(F.col("t") * F.col("r") * F.col(f"p{i}")).alias(f"m{i}") for i in range(k)), *(F.sum(free * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k))).first()
        mass = [row[f"m{i}"] or 0.0 for i in range(k)]
        if budget is None:
            anchor = max(range(k), key=lambda i: (share[i], -i))
            budget = mass[anchor] / share[anchor]
            goal = [budget * s for s in share]
        seen.append(dict(zip(domains, zip(mass, goal))))
        gap = [m - g for m, g in zip(mass, goal)]
        if not budget or max(map(abs, gap)) <= CLOSE * budget:
            break
        steps.append([float(s) for s in solve([[row[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], gap)])
    return rated(), seen


def copies(of: Column, rate: Column) -> Column:
    """Whole copies whose expectation over ids is the rate; salted, as the labelled sample is chosen by the plain hash."""
    part = F.pmod(F.xxhash64(F.lit("copies"), of), F.lit(1_000_000)) / 1_000_000
    return F.floor(rate) + (part < rate - F.floor(rate)).cast("long")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, domain, p, rate, copies): rates whose expected token totals by domain are in the ratio of targets.

    The domain with the largest target keeps its expected tokens and so sets the
    budget.  copies is the rate's whole part, and one more where a number in
    [0, 1) made of the id falls below the rest, so that copies meet the targets
    as rates do, in expectation, and the same documents are taken every time.
    Without labelled documents every rate is
    1, the domain null.  Null texts have no tokens; rows that repeat an id are
    one document, the longest; domains missing from targets have a target of 0, and targets
    of unknown domains are left out.
    """
    tmp = Scratch(docs.sparkSession, "mixing")
    model = fit_classifier(docs, labels, text_col, id_col)
    if not model[0]:
        return docs.groupBy(id_col).agg(F.max(tokens(F.col(text_col))["n"]).alias("n_tokens")).select(id_col, "n_tokens", F.lit(None).cast("string").alias("domain"), F.array().cast("array<double>").alias("p"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"))
    members = tmp.save(posteriors(docs, model, text_col, id_col))
    rate, _ = fit_rates(members, model[0], targets or TARGETS)
    domain = F.get(F.array(*(F.lit(d) for d in model[0])), (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    return members.select(F.col("id").alias(id_col), "n_tokens", domain.alias("domain"), "p", rate.alias("rate")).withColumn("copies", copies(F.col(id_col), F.col("rate")))


def apply_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with each row repeated `copies` times, none where that is 0; columns as they were, whatever their names."""
    spare = next(f"_mix{'_' * i}" for i in range(1000) if not any(c.startswith(f"_mix{'_' * i}") for c in docs.columns))
    decided = mix(docs, labels, targets, text_col, id_col).where("copies > 0").select(F.col(id_col).alias(f"{spare}i"), F.col("copies").alias(f"{spare}n"))
    joined = docs.join(decided, docs[id_col].eqNullSafe(decided[f"{spare}i"]))
    return joined.withColumn(f"{spare}k", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{spare}n")))).select(*docs.columns)
