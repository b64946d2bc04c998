"""ST5: alerts on change, with the state of each alert key in Spark's state store.

Rows are summed per event-time day by a streaming aggregation; a day is passed
on, once, when the watermark passes its end.  ``transformWithState`` then
keeps one value per alert key (and group, if any): the days seen, the last
seven daily costs, the sums behind the overall defect rate, and the message
emitted last.  Rules are those of the batch alerts A1 and A2, evaluated on the
days as they end; an alert is emitted only if its message differs from the
last one of its key.  A day without rows has no cost: an event-time timer on
each key closes it when the watermark passes its end.

Both states and the timers belong to the query's checkpoint, so a query that
was killed goes on where it stopped; the file sink drops what a replayed batch
wrote before.  A key's state is eight numbers and a message, whatever the
number of rows; what reaches it is one row per day.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from inspectkit import columns as C
from inspectkit.operators.alerts import KEY_COPQ_SPIKE, KEY_DEFECT_RATE, MSG_COPQ_SPIKE, MSG_DEFECT_RATE
from inspectkit.operators.kpis import copq_expr
from inspectkit.params import DEFAULT_PARAMS, QualityParams

DAYS = 7  # of the baseline, the day itself included
STATE = "days int, last int, costs array<double>, rate_sum double, rate_n bigint, message string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = dt.date(1970, 1, 1)
_DAY_MS = 86_400_000


class AlertProcessor(StatefulProcessor):
    """Days of one alert key in, changed alerts out."""

    def __init__(self, spike: float, rate: float, every: int, by: list[str]):
        self.spike, self.rate, self.every, self.by = spike, rate, every, by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alert", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.state.get() if self.state.exists() else (0, None, [], 0.0, 0, None)
        known = state[1]
        out = []
        for row in sorted(rows, key=lambda r: r["day"]):
            day = (row["day"] - _EPOCH).days
            while state[1] is not None and state[1] + 1 < day:
                state = self._close(key, state, state[1] + 1, 0.0, 0.0, 0, out)
            state = self._close(key, state, day, row["cost"], row["rate_sum"], row["rate_n"], out)
        self._keep(state, known)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, out = self.state.get(), []
        if expiredTimerInfo.getExpiryTimeInMs() >= (state[1] + 2) * _DAY_MS:  # else the day had rows
            known = state[1]
            self._keep(self._close(key, state, known + 1, 0.0, 0.0, 0, out), known)
        return iter(out)

    def _keep(self, state: tuple, known: int | None) -> None:
        self.state.update(state)
        if known is not None and known != state[1]:
            self.handle.deleteTimer((known + 2) * _DAY_MS)
        self.handle.registerTimer((state[1] + 2) * _DAY_MS)  # the end of the next day

    def _close(self, key, state: tuple, day: int, cost: float, rate_sum: float, rate_n: int, out: list) -> tuple:
        n, _, costs, sums, count, said = state
        n, costs, sums, count = n + 1, [*costs, float(cost)][-DAYS:], sums + float(rate_sum or 0.0), count + int(rate_n or 0)
        text = value = None
        if n % self.every == 0:
            if key[0] == KEY_COPQ_SPIKE and n > DAYS:
                mean = sum(costs) / DAYS
                if costs[-1] > mean + self.spike:
                    value, text = costs[-1], MSG_COPQ_SPIKE % (costs[-1], mean)
            elif key[0] == KEY_DEFECT_RATE and count:
                value = sums / count * 100.0
                text = MSG_DEFECT_RATE % (value, repr(self.rate)) if value > self.rate else None
        if text is not None and text != said:
            said = text
            about = dict(zip(["key", *self.by], key), message=text, value=float(value), day=_EPOCH + dt.timedelta(days=day))
            out.append(Row(**about, epoch=n // self.every - 1, emitted_at=dt.datetime.now(dt.timezone.utc)))
        return n, day, costs, sums, count, said

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB (read at the start)."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if old is None else spark.conf.set(PROVIDER, old)


def alert_changes(sdf: DataFrame, params: QualityParams = DEFAULT_PARAMS, every: int = 1, by: list[str] | tuple[str, ...] = (),
                  delay: str = "1 day") -> DataFrame:
    """Streaming DataFrame of changed alerts: key, the ``by`` columns, message, value,
    day (the day it is about), epoch (number of the evaluation, from 0; the rules are evaluated
    after every ``every`` days of a key) and emitted_at (the time of emission)."""
    by = list(by)
    rate = F.col(C.DEFECT_RATE).cast("double") if C.has(sdf, C.DEFECT_RATE) else F.lit(None).cast("double")
    days = sdf.withWatermark(C.DATE, delay).groupBy(F.window(C.DATE, "1 day").alias("w"), *by).agg(
        copq_expr(sdf).alias("cost"), F.sum(rate).alias("rate_sum"), F.count(rate).alias("rate_n"))
    keys = [KEY_COPQ_SPIKE] + ([KEY_DEFECT_RATE] if C.has(sdf, C.DEFECT_RATE) else [])
    rows = days.select(
        F.explode(F.array(*map(F.lit, keys))).alias("key"), *by, "w", F.to_date("w.start").alias("day"),
        "cost", F.coalesce("rate_sum", F.lit(0.0)).alias("rate_sum"), "rate_n")
    types = dict(sdf.dtypes)
    schema = ", ".join(["key string", *(f"`{c}` {types[c]}" for c in by), "message string, value double, day date, epoch int, emitted_at timestamp"])
    processor = AlertProcessor(float(params.alert_copq_spike_threshold), float(params.alert_defect_rate_threshold), every, by)
    return rows.groupBy("key", *by).transformWithState(processor, schema, "append", "eventTime")


def start_alerts(sdf: DataFrame, out: str, checkpoint: str, params: QualityParams = DEFAULT_PARAMS, every: int = 1,
                 by: list[str] | tuple[str, ...] = (), delay: str = "1 day", available_now: bool = True):
    """Start ST5: changed alerts are appended to the folder ``out``."""
    with rocksdb_state(sdf.sparkSession):
        w = alert_changes(sdf, params, every, by, delay).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
        return w.outputMode("append").start()
