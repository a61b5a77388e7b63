"""Dates appended by a stream against the whole panel at once; batches that run twice, late and repeated rows, gaps."""

import datetime as dt
import random

import pytest

from panelflow.operators import panel
from panelflow.streaming import daily

SCHEMA = "ts timestamp, algo_id long, close double"


def _rows(days, seed=4):
    r = random.Random(seed)
    for d in days:
        for algo in range(1, 9):
            if d >= 2 * algo and r.random() < 0.8:
                yield dt.datetime(2020, 1, 1) + dt.timedelta(days=d), algo, r.choice([None, 0.0, *(r.uniform(50, 150) for _ in range(8))])


def _same(spark, folder, rows):
    whole = spark.createDataFrame(rows, SCHEMA)
    times = panel.calendar(whole)
    rets = panel.returns(whole, times)
    got, cal = daily.read_returns(spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rets.collect()))
    assert sorted(map(tuple, cal.collect())) == sorted(map(tuple, times.collect()))
    macro = [sorted(map(tuple, m.collect())) for m in (daily.read_macro(spark, folder), panel.macro(rets, times))]
    assert len(macro[0]) == len(macro[1])
    for a, b in zip(*macro):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-12)


def test_stream_equals_whole_panel(spark, tmp_path):
    inbox, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    rows = list(_rows(range(40)))
    for days in (range(0, 15), range(15, 16), range(16, 40)):
        part = [x for x in rows if (x[0] - dt.datetime(2020, 1, 1)).days in days]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
        daily.run_available(spark, inbox, folder)
    daily.run_available(spark, inbox, folder)
    _same(spark, folder, rows)


def test_batches_that_run_again_change_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    parts = [spark.createDataFrame(list(_rows(d)), SCHEMA) for d in (range(0, 12), range(12, 20), range(20, 30))]
    for batch, part in enumerate(parts):
        daily.append(part, batch, folder)
        daily.append(part, batch, folder)
    _same(spark, folder, [x for d in (range(0, 12), range(12, 20), range(20, 30)) for x in _rows(d)])


def test_a_batch_whose_snapshot_is_not_whole_does_not_count(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    first = list(_rows(range(0, 12)))
    daily.append(spark.createDataFrame(first, SCHEMA), 0, folder)
    daily.append(spark.createDataFrame(list(_rows(range(12, 20))), SCHEMA), 1, folder)
    (tmp_path / "out/last/batch=1/_SUCCESS").unlink()
    _same(spark, folder, first)


def test_late_repeated_and_broken_rows(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    day = lambda d: dt.datetime(2020, 1, d)
    daily.append(spark.createDataFrame([(day(1), 1, 100.0), (day(2), 1, 110.0), (day(2), 2, None)], SCHEMA), 0, folder)
    daily.append(spark.createDataFrame([(day(2), 2, 5.0), (day(3), 1, 99.0), (day(3), 1, 121.0), (day(3), 1, None), (None, 1, 1.0), (day(3), None, 1.0)], SCHEMA), 1, folder)
    daily.append(spark.createDataFrame([], SCHEMA), 2, folder)
    daily.append(spark.createDataFrame([(day(4), 2, 7.0)], SCHEMA), 3, folder)
    _same(spark, folder, [(day(1), 1, 100.0), (day(2), 1, 110.0), (day(2), 2, None), (day(3), 1, 99.0), (day(4), 2, 7.0)])
    late = spark.read.parquet(f"{folder}/late").collect()
    assert [(r.ts, r.algo_id, r.close, r.batch) for r in late] == [(day(2), 2, 5.0, 1)]


def test_nothing_written_and_a_foreign_folder(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    assert daily.read_macro(spark, folder).count() == 0 == daily.read_returns(spark, folder)[0].count()
    with pytest.raises(ValueError, match="missing"):
        daily.append(spark.createDataFrame([], SCHEMA), 5, folder)
