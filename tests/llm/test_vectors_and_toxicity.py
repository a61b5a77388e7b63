"""Whitening and clustering against brute force in whole numbers; toxicity on disguised words and held-out labels."""

import hashlib
import itertools
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from panelflow.llm import clustering, toxicity, whitening
from panelflow.llm.queries import QUERIES
from panelflow.llm.sql import ORACLES

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, cluster string, x int"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, "own", 7) for i, v in rows], SCHEMA)


def _odd(n, dim, seed=3):
    """Vectors, the rows of which that count, and rows that do not."""
    rng = np.random.default_rng(seed)
    fine = [(int(i), rng.normal(0, 0.2, dim).tolist()) for i in range(n)]
    bad = [(900, None), (901, []), (902, [*fine[0][1][:-1], None]), (903, [float("nan")] * dim), (904, [float("inf"), *fine[0][1][1:]]), (905, [0.1] * (dim + 1)), (906, [1e300] * dim)]
    return fine + [(907, fine[0][1]), (None, fine[1][1]), (0, fine[2][1])], bad


def test_whitening_equals_exact_sums(spark):
    fine, bad = _odd(40, 6)
    got = whitening.whitened_components(_vectors(spark, fine + bad)).collect()
    assert len(got) == len(fine) * 6 and got[0].__fields__ == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in fine], object)
    n, s = len(fine), x.sum(axis=0)
    v = np.array([[float(Fraction(int(((n * x[:, i] - s[i]) * (n * x[:, j] - s[j])).sum()), n**3)) for j in range(6)] for i in range(6)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    want = np.array([[float(c) for c in row - np.array([Fraction(int(k), n) for k in s])] for row in x]) @ u / np.sqrt(e)
    deviation = sorted(int(((n * row - s) ** 2).sum()) for row in x)
    assert sorted(r.deviation for r in got if r.component == 1) == deviation and {r.n for r in got} == {n}
    for k in range(6):
        own = sorted(r.whitened for r in got if r.component == k + 1)
        assert min(np.abs(np.array(own) - np.sort(sign * want[:, k])).max() for sign in (1, -1)) < 1e-10
        assert all(abs(r.explained * e.sum() / e[k] - 1) < 1e-9 for r in got if r.component == k + 1)
    assert max(r.identity_error for r in got) < 1e-10


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5, 0.25])] * 3])
def test_whitening_without_spread_is_empty(spark, rows):
    assert whitening.whitened_components(_vectors(spark, rows)).collect() == []


def test_whitening_leaves_out_flat_directions(spark):
    rows = [(i, [a, a, b]) for i, (a, b) in enumerate(itertools.product((0.0, 0.5, 1.0), (0.0, 1.0)))]
    got = whitening.whitened_components(_vectors(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-12


def test_whitening_query(spark):
    got = QUERIES["op11_whitening"](spark, SF).toPandas()
    v = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    assert len(got) == 8 * len(v) and got.identity_error.max() < 1e-4
    x = np.floor(1024 * np.array(v.embedding.map(lambda e: np.asarray(e, float)).tolist())).astype(np.int64) + 100_000
    s = x.sum(axis=0)
    want = dict(zip(v.vec_id, ((len(v) * x - s) ** 2).sum(axis=1)))
    assert all(want[i] == d for i, d in zip(got.vec_id, got.deviation))


def _lloyd(rows, k, rounds):
    """Whole-number Lloyd rounds written apart: (cluster, distance) by row, centroids."""
    x = [[int(np.floor(64 * c)) for c in v] for _, v in rows]
    order = sorted((r for r in range(len(rows)) if rows[r][0] is not None), key=lambda r: (hashlib.sha256(f"1:{rows[r][0]}".encode()).hexdigest(), x[r]))
    c = [x[r] for r in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        own = [near(v)[1] for v in x]
        c = [[sum(col) // len(col) for col in zip(*(v for v, o in zip(x, own) if o == j))] if j in own else m for j, m in enumerate(c)]
    return [near(v)[::-1] for v in x], c


def test_clustering_equals_whole_numbers(spark):
    fine, bad = _odd(60, 5)
    # ties: vectors midway between others, and large entries where float32 cannot tell neighbours apart
    fine += [(2000 + i, [i / 64 + 30_000.0, 0.0, 0.0, 0.0, 0.0]) for i in range(6)]
    got = clustering.cluster_vectors(_vectors(spark, fine + bad), k=7, rounds=3, dim=5).collect()
    want, c = _lloyd(fine, 7, 3)
    total = sum(d for _, d in want)
    each = {j: sum(d for o, d in want if o == j) for j in range(7)}
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, o, d, each[o], total, digest[o]) for (i, _), (o, d) in zip(fine, want)), key=str)


def test_screen_never_loses_the_nearest():
    rng = np.random.default_rng(5)
    for scale in (3, 1_000, 2**20, 2**26):
        c = rng.integers(-scale, scale, (16, 64))
        x = np.concatenate([rng.integers(-scale, scale, (300, 64)), (c[:8] + c[8:]) // 2, c])
        own, distance = clustering.nearest(x, c)
        exact = ((x[:, None].astype(object) - c) ** 2).sum(axis=2)
        assert (own == [min(range(16), key=lambda j: (row[j], j)) for row in exact]).all()
        assert (distance == exact.min(axis=1)).all()
        low, high = clustering.screen(x, c)
        rank = (c.astype(object) ** 2).sum(axis=1) - 2 * x.astype(object) @ c.T.astype(object)
        assert (low <= rank).all() and (rank <= high).all()


def test_equal_centroids_go_to_the_lowest_number():
    c = np.zeros((3, 64), np.int64)
    assert clustering.nearest(np.ones((2, 64), np.int64), c)[0].tolist() == [0, 0]


@pytest.mark.parametrize("rows,n", [([], 0), ([(1, None)], 0), ([(1, [0.5] * 64)] * 2, 2)])
def test_clustering_of_few_vectors(spark, rows, n):
    got = clustering.cluster_vectors(_vectors(spark, rows)).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in got] == [(0, 0, 0)] * n


def test_clustering_query_equals_sql(spark):
    got = sorted(map(tuple, QUERIES["op12_centroids"](spark, SF).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got == sorted(db.execute(ORACLES["op12_centroids"]).fetchall())


TAME = "the weather was fine and everyone walked home along the river before dinner"
INSULTS = ("idiot", "worthless", "pathetic")


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    # plain words are far more frequent than disguised ones, which are counted too
    for i in range(720):
        words = TAME.split()
        toxic = i % 4 == 0
        if toxic:
            words.insert(i % 9, INSULTS[i // 4 % 3])
        words.insert(i % 5, f"word{chr(97 + i % 26)}")
        rows.append((i, " ".join(words), int(toxic), "en"))
    more = [(1000, None), (1001, ""), (1002, " \n"), (1003, "you 1d10t"), (1004, "so p a t h e t i c it was"), (1005, "w0rthless"), (1006, "an idiooooooot"), (1007, "i.d.i.o.t"), (1008, TAME), (1009, "a " * 5_000), (1010, ("xy" * 60 + "1") * 70), (1011, (TAME + " ") * 2_000), (1008, TAME), (None, TAME)]
    rows += [(i, t, None, "en") for i, t in more]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")


@pytest.fixture(scope="module")
def scored(spark, corpus):
    labels = corpus.where("toxic is not null").select("doc_id", "toxic", "score")
    return corpus, toxicity.score_toxicity(corpus, labels, threshold=0.5).collect()


def test_disguised_words_are_scored_as_what_they_mean(scored):
    corpus, got = scored
    assert len(got) == corpus.count()
    of = {r.doc_id: r for r in got}
    assert {i: of[i].predicted for i in range(1000, 1012)} == {1000: 0, 1001: 0, 1002: 0, 1003: 1, 1004: 1, 1005: 1, 1006: 1, 1007: 1, 1008: 0, 1009: 0, 1010: 0, 1011: 0}
    assert ("1d10t", "idiot") in [(e.found, e.restored) for e in of[1003].evidence]
    assert of[1000].score == of[1001].score == of[1002].score and 0 <= of[1000].score < 0.5
    assert all((of[i].predicted == 1) == (i % 4 == 0) for i in range(720))


def test_deobfuscated_text(spark, corpus):
    rows = [(1, "you 1d10t, go"), (2, None), (3, "in 2024 the weather was fine"), (4, "so i d i o t it was")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    channel = toxicity.Channel(corpus, toxicity.character_counts(corpus))
    got = {r.doc_id: r.text for r in toxicity.deobfuscate(docs, channel).collect()}
    assert got == {1: "you idiot, go", 2: None, 3: "in 2024 the weather was fine", 4: "so idiot it was"}


def test_decode_equals_every_path():
    rng = np.random.default_rng(2)
    cost = toxicity.costs_of(rng.integers(0, 4, toxicity.SYMBOLS**toxicity.ORDER))

    def total(path):
        out, state = 0.0, 0
        for s, c in [*path, (0, 0.0)]:
            out += c
            if s >= 0:
                out += float(cost[state << 5 | s])
                state = (state << 5 | s) & 0x7FFF
        return out

    for word, spaced in (("1d10t", False), ("heeee11o", False), ("l o $", True), ("a", False)):
        steps = toxicity.lattice(word, spaced)
        best = min(itertools.product(*steps), key=total)
        assert toxicity.decode(steps, cost) == [s for s, _ in best if s >= 0]


def test_long_lattices_are_settled_as_they_go():
    cost = toxicity.costs_of(np.random.default_rng(1).integers(0, 50, toxicity.SYMBOLS**toxicity.ORDER))
    steps = toxicity.lattice("1d10t0" * 60, False)
    whole, toxicity.LAG = toxicity.LAG, 10_000
    try:
        want = toxicity.decode(steps, cost)
    finally:
        toxicity.LAG = whole
    assert toxicity.decode(steps, cost) == want and len(want) == 360


def test_character_counts_cover_every_text(spark):
    texts = ["Ärger, naïve", None, "", "x" * 70_000, "日本語 text"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {}
    for t in texts:
        s = [0, 0, 0, *(toxicity.symbol(c) if ord(c) < 0x250 else 29 + ord(c) % 3 for c in t), 0, 0, 0] if t else []
        for i in range(3, len(s)):
            k = s[i - 3] << 15 | s[i - 2] << 10 | s[i - 1] << 5 | s[i]
            want[k] = want.get(k, 0) + 1
    got = toxicity.character_counts(docs)
    # texts of one task share the boundaries between them
    seen = {int(k): int(got[k]) for k in np.flatnonzero(got)}
    assert {k: n for k, n in seen.items() if k & 31} == {k: n for k, n in want.items() if k & 31}


@pytest.mark.parametrize("labelled", [[], [(1, 0)], [(1, None), (None, 1)]])
def test_without_labels_of_both_kinds_all_scores_are_alike(spark, labelled):
    docs = spark.createDataFrame([(1, "one idiot"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame(labelled, "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len({r.score for r in got}) == 1 and len(got) == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect() == []


def test_toxicity_query_on_held_out_labels(spark):
    got = {r.doc_id: r for r in QUERIES["op13_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    held = [(got[i].predicted, t) for i, t in labels.items() if got[i].held_out]
    caught = [p for p, t in held if t == 1]
    assert sum(caught) >= 0.7 * len(caught) and sum(p for p, t in held if t == 0) <= 0.01 * len(held)
