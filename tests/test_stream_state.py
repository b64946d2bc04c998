"""Streaming operators whose state is Spark's own: ST2, ST4, ST5, ST6."""

from __future__ import annotations

import datetime as dt
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from inspectkit import columns as C
from inspectkit.operators.alerts import copq_spike_days
from inspectkit.params import DEFAULT_PARAMS
from inspectkit.streaming import alert_state
from inspectkit.streaming import jobs as S
from tests.conftest import ts

SCHEMA = "Date timestamp, CostImpact double, DefectRate double, Supplier string"
PARAMS = DEFAULT_PARAMS.with_(alert_copq_spike_threshold=50.0)


def _arrive(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.01)  # files are taken in the order of their times


def _rows(days, rate=0.01, supplier="s"):
    return [(ts(2024, 1, 1) + dt.timedelta(days=d, hours=h), c / 2, rate, supplier) for d, c in days for h in (1, 5)]


def _stream(spark, path):
    return S.stream_fact(spark, path, spark.createDataFrame([], SCHEMA).schema, max_files_per_trigger=1)


def _alerts(spark, out):
    return sorted((r.key, r.day, r.message, round(r.value, 6), r.epoch) for r in spark.read.schema(S.ALERT_OUT).parquet(out).collect())


COSTS = [10.0] * 8 + [100.0] + [10.0] * 3 + [0.0] * 2 + [150.0, 10.0, 170.0]  # two quiet days, without rows
DAYS = [(d, c) for d, c in enumerate(COSTS) if c]
BATCHES = [DAYS[:5], DAYS[5:9], DAYS[9:12], DAYS[12:], [(len(COSTS) + 1, 1.0)]]


def _expected(spark):
    batch = spark.createDataFrame(_rows(DAYS), SCHEMA)
    found = copq_spike_days(batch, PARAMS).collect()
    return [(r.period, round(r.value, 6), round(r.baseline)) for r in sorted(found, key=lambda r: r.period)]


def test_alerts_equal_the_batch_history_over_quiet_days(spark, tmp_path):
    """Every day of a spike, as A3 finds them; timers close the quiet days."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for b in BATCHES:
        _arrive(spark, src, _rows(b))
    alert_state.start_alerts(_stream(spark, src), out, str(tmp_path / "ck"), PARAMS).awaitTermination()
    got = _alerts(spark, out)
    want = _expected(spark)
    assert [(d, v) for _, d, _, v, _ in got] == [(d, v) for d, v, _ in want] and len(want) == 3
    assert got[0][2].endswith(f"7-day avg {want[0][2]}") and {g[0] for g in got} == {"copq_spike"}
    emitted = spark.read.schema(S.ALERT_OUT).parquet(out).agg(F.min("emitted_at")).first()[0]
    assert emitted is not None and emitted.year >= 2024


@pytest.mark.parametrize("killed", [False, True])
def test_alerts_are_the_same_after_restarts(spark, tmp_path, killed):
    """A query ended, or killed, after every arrival goes on from its state store."""
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    for i, b in enumerate(BATCHES):
        _arrive(spark, src, _rows(b))
        q = alert_state.start_alerts(_stream(spark, src), out, ck, PARAMS, available_now=not killed)
        if killed:
            q.processAllAvailable()
            q.stop()
        else:
            q.awaitTermination()
    assert [(d, v) for _, d, _, v, _ in _alerts(spark, out)] == [(d, v) for d, v, _ in _expected(spark)]


def test_alert_emitted_only_on_change(spark, tmp_path):
    """A constant defect rate above the limit is told once, not every day."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _arrive(spark, src, _rows([(d, 10.0) for d in range(12)], rate=0.2))
    _arrive(spark, src, _rows([(14, 1.0)], rate=0.2))
    alert_state.start_alerts(_stream(spark, src), out, str(tmp_path / "ck"), PARAMS).awaitTermination()
    assert [(k, m) for k, _, m, _, _ in _alerts(spark, out)] == [("defect_rate", "High overall defect rate: 20.00% (threshold 5.0%)")]


def test_alerts_by_group_and_every_third_day(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _arrive(spark, src, _rows([(d, 10.0) for d in range(8)] + [(8, 90.0)], supplier="a") + _rows([(d, 10.0) for d in range(9)] + [(9, 95.0)], supplier="b"))
    _arrive(spark, src, _rows([(12, 1.0)], supplier="a"))
    alert_state.start_alerts(_stream(spark, src), out, str(tmp_path / "ck"), PARAMS, every=3, by=[C.SUPPLIER]).awaitTermination()
    found = spark.read.parquet(out).select("Supplier", "key", F.col("day").cast("string"), "epoch").collect()
    assert [tuple(r) for r in found] == [("a", "copq_spike", "2024-01-09", 2)]  # b's spike is on its tenth day


def test_kpis_upsert_changed_keys_over_restarts(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "job")
    parts = [_rows([(1, 10.0)], supplier="a") + _rows([(1, 6.0)], supplier=None), _rows([(2, 5.0)], supplier="b"), _rows([(3, 7.0)], supplier="a")]
    for rows in parts:
        _arrive(spark, src, rows)
        now = S.run_to_table(spark, S.stream_kpis(_stream(spark, src), ["Supplier"]), "update", "kpis", ["Supplier"], base=base)
    want = spark.createDataFrame([r for p in parts for r in p], SCHEMA).groupBy("Supplier").agg(F.count(F.lit(1)).alias("Rows"), F.sum("CostImpact").alias("COPQ"))
    key = lambda r: str(r[0])
    assert sorted(((r.Supplier, r.Rows, r.COPQ) for r in now.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    per_epoch = {r.epoch: r.n for r in spark.read.parquet(f"{base}/out").groupBy("epoch").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sorted(per_epoch.values()) == [1, 1, 2]  # changed keys only


def test_seven_day_windows_keep_one_state_row_a_day(spark, tmp_path):
    src = str(tmp_path / "in")
    _arrive(spark, src, [(ts(2024, 1, 1) + dt.timedelta(days=d, seconds=k), 1.0 + d, 0.0, "s") for d in range(12) for k in range(50)])
    q = S.write_epochs(S.stream_copq_7d(_stream(spark, src)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    first = q.recentProgress[0]["stateOperators"]
    assert [op["numRowsTotal"] for op in first if op["numRowsUpdated"]] == [12]  # not 12 x 7
    want = defaultdict(float)
    for d in range(12):
        for k in range(7):
            want[d - k] += 50 * (1.0 + d)
    got = {(r.start_day - dt.date(2024, 1, 1)).days: r.COPQ_7d for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    last = 11 - 1  # the watermark is a day behind the last event
    assert got == {d: v for d, v in want.items() if d + 7 <= last}


def test_streams_without_data(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([], SCHEMA).limit(0).write.parquet(src)
    sdf = lambda: _stream(spark, src + "/nothing*")
    report = S.stream_quality_report(spark, sdf())
    assert report.columns == ["seq", "column", "missing", "rows", "missing_frac"] and report.collect() == []
    assert S.run_to_table(spark, S.stream_daily(sdf())).collect() == []
    assert S.run_to_table(spark, S.stream_kpis(sdf(), ["Supplier"]), "update", keys=["Supplier"]).collect() == []
    assert S.stream_alerts(spark, sdf()).collect() == []


def test_quality_counts_add_up_over_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    for k in range(3):
        _arrive(spark, src, _rows([(k, 1.0)], supplier=None if k else "s"))
    got = {r.column: (r.missing, r.rows) for r in S.stream_quality_report(spark, _stream(spark, src)).collect()}
    assert got["Supplier"] == (4, 6) and got["Date"] == (0, 6)
