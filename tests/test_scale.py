"""Work that must not grow with rounds, uses or files."""

import hashlib
from datetime import datetime

import numpy as np
import pytest

from panelflow.operators import cluster
from panelflow.plans import registry
from panelflow.sources import adapters, writers


def _jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def _points(spark, ids, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, a, float(x), float(y)) for i, n in ((3, 60), (4, 25), (7, 5)) for a, (x, y) in zip(rng.permutation(ids)[:n].tolist(), np.round(rng.normal(0, 1, (n, 2)), 3))]
    kind = "string" if isinstance(ids[0], str) else "long"
    return spark.createDataFrame(rows, f"i int, algo_id {kind}, x double, y double")


def test_kmeans_takes_no_more_jobs_for_more_rounds(spark):
    points = _points(spark, list(range(100)))
    few = _jobs(spark, "few", lambda: cluster.kmeans(points, 5, 1).count())
    many = _jobs(spark, "many", lambda: cluster.kmeans(points, 5, 40).count())
    rest = _jobs(spark, "rest", lambda: cluster.kmeans(points, 5, starts=4).count())
    assert few == many == rest and few[0] == 90


@pytest.mark.parametrize("ids", [list(range(100)), [f"é{n}" for n in range(99)] + [None]])
@pytest.mark.parametrize("how", [{"rounds": 3}, {"starts": 4}, {"starts": 3, "most": 2}])
def test_kmeans_of_dates_too_large_for_a_task(spark, ids, how):
    points = _points(spark, ids)
    one, spread = (sorted(map(str, cluster.kmeans(points, 5, task_points=n, **how).collect())) for n in (1000, 10))
    assert len(one) == 90 and one == spread


def test_digests_of_many_messages_at_once():
    tails = [b":" + b"7" * n for n in range(45)] + [b"", ":ü\x00".encode()]
    want = [int(hashlib.md5(b"105:3:4" + t).hexdigest()[:8], 16) for t in tails]
    blocks = cluster._blocks(7, tails)
    blocks[:, :7] = np.frombuffer(b"105:3:4", np.uint8)
    assert cluster._md5_heads(blocks).tolist() == want
    assert cluster._blocks(7, [b"a" * 49]) is None and cluster._blocks(7, [b"a" * 48]) is not None
    kept = {}
    short, long = cluster._draw(b"1:2:3", [b":7"], kept), cluster._draw(b"1:2:3", [b":7", b":" + b"a" * 80], {})
    assert kept[5] is not None and short[0] == long[0]


@pytest.mark.parametrize("name", ["q12_cluster_returns", "q39_full_cluster_wide", "q40_full_backtest_log", "q60_full_walk_forward"])
def test_panel_is_aggregated_once(spark, name, monkeypatch):
    asked = []
    monkeypatch.setattr(registry, "_panel", lambda *a, was=registry._panel: asked.append(a) or was(*a))
    out = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(asked) == 1 and not [f for f in out.inputFiles() if "lineitem" in f]


def test_price_files_are_opened_once(spark, tmp_path):
    rows = spark.createDataFrame([(f"a{n}", datetime(2024, 1, d), float(n + d)) for n in range(20) for d in (1, 2)], "algo_id string, ts timestamp, close double")
    writers.write_prices(rows, str(tmp_path / "raw"))
    assert sorted(p.name for p in (tmp_path / "raw").glob("*.csv")) == sorted(f"a{n}.csv" for n in range(20))
    got = adapters.read_prices(spark, str(tmp_path / "raw"))
    assert not [f for f in got.inputFiles() if f.endswith(".csv")]
    assert sorted(got.select("algo_id", "ts", "close").collect()) == sorted(rows.collect())


def test_many_price_files_are_dealt_out_to_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "FOLDER_FILES", 5)
    rows = spark.createDataFrame([(f"a{n}", datetime(2024, 1, d), float(n + d) if d < 3 else None) for n in range(43) for d in (1, 2, 3)], "algo_id string, ts timestamp, close double")
    raw = tmp_path / "raw"
    writers.write_prices(rows, str(raw))
    files = sorted(raw.rglob("*.csv"))
    assert sorted(f.name for f in files) == sorted(f"a{n}.csv" for n in range(43)) and not list(raw.glob("*.csv"))
    assert max(sum(f.parent == d for f in files) for d in raw.iterdir()) < 20
    (raw / "late.csv").write_text("datetime,close\n2024-01-01,7\n")
    (raw / "else").mkdir()
    (raw / "else" / "not.csv").write_text("datetime,close\n2024-01-01,7\n")
    seen, was = [], type(spark.read).text
    monkeypatch.setattr(type(spark.read), "text", lambda self, *a, **k: seen.append(was(self, *a, **k)) or seen[-1])
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    got = adapters.read_prices(spark, str(raw)).select("algo_id", "ts", "close").collect()
    assert sorted(map(str, got)) == sorted(map(str, [*rows.collect(), got[0].__class__("algo_id", "ts", "close")("late", datetime(2024, 1, 1), 7.0)]))
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost
    assert len(seen) == 10 and sorted(x for s in seen for x in s.inputFiles()) == sorted(f"file://{f}" for f in [*files, raw / "late.csv"])


@pytest.mark.parametrize("most", [3, 10_000])
def test_price_files_are_alike_on_every_store(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(writers, "FOLDER_FILES", most)
    for at in ("here", "there"):
        (tmp_path / at).mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.m{most}.link./in", f"file://{tmp_path}/there")
    ids = ["plain", "a b", "ü", "x=1", "c%d", "e:f/g", "[h]{i}", "q\"'#", "", None, "7"]
    prices = [1e7, 1e-5, 0.0, float("nan"), None, 1234567.89]
    rows = spark.createDataFrame([(a, datetime(2024, 1, 1 + d, 5, d), p) for a in ids for d, p in enumerate(prices) if a or d < 1], "algo_id string, ts timestamp, close double")
    writers.write_prices(rows, f"{tmp_path}/here/raw")
    writers.write_prices(rows, f"viewfs://m{most}/in/raw")
    a, b = ({str(f.relative_to(tmp_path / at)): sorted(f.read_text().split("\n")) for f in (tmp_path / at).rglob("*.csv")} for at in ("here", "there"))
    assert a == b and len(a) == 10 and {len(f.split("/")) for f in a} == {3 if most == 3 else 2}
    a, b = (sorted(map(str, adapters.read_prices(spark, at).select("algo_id", "ts", "close").collect())) for at in (f"{tmp_path}/here/raw", f"viewfs://m{most}/in/raw"))
    assert a == b and len(a) == 54
