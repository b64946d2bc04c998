"""Registered queries: Structured Streaming jobs over the ``events`` table.

Each query streams the events parquet through ``trigger(availableNow)``
into the shared checkpoint folder and returns a batch DataFrame read from
the sink.  Append-mode windows are emitted once the watermark (max event
time - 1 day) passes their end; the twins state exactly that.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from inspectkit import columns as C
from inspectkit.operators.normalize import normalize
from inspectkit.params import DEFAULT_PARAMS
from inspectkit.plans.catalog import fact, register, rounded
from inspectkit.plans.oracle import EVENTS_CTE, with_events, with_fact
from inspectkit.session import prepare, scratch_path
from inspectkit.sources.tables import events_to_raw, read_table
from inspectkit.streaming import jobs as S


def events_stream(spark, sf_dir):
    """The events file as a stream (a glob, since the source must be a
    folder or pattern), mapped to quality records and normalised."""
    prepare(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return S.stream_fact(spark, f"{sf_dir}/[e]vents.parquet", schema, to_raw=events_to_raw)


@register("stream_ingest", "ST1", with_events("""
SELECT Defect_Type, count(*) AS n_rows, CAST(sum(DefectCount) AS BIGINT) AS defects,
  round(sum(CostImpact), 4) AS copq FROM evfact GROUP BY Defect_Type"""))
def q_stream_ingest(spark, sf_dir):
    t = S.run_to_table(spark, events_stream(spark, sf_dir), "append", "ingest")
    out = t.groupBy(C.DEFECT_TYPE).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(C.DEFECT_COUNT).alias("defects"),
                                       F.sum(C.COST_IMPACT).alias("copq"))
    return rounded(out, money=("copq",))


@register("append_batch", "ST1 append", with_fact("""
SELECT Defect_Type, count(*) AS n_rows, count(QualityScore) AS n_scored, count(event_id) AS n_events,
  CAST(sum(DefectCount) AS BIGINT) AS defects
FROM (SELECT * FROM fact UNION ALL BY NAME SELECT * FROM evfact) GROUP BY Defect_Type""", EVENTS_CTE))
def q_append_batch(spark, sf_dir):
    """The quality fact and the events as an arriving batch with other columns."""
    events = normalize(events_to_raw(read_table(spark, sf_dir, "events")))
    both = S.append_batch(fact(spark, sf_dir), events)
    return both.groupBy(C.DEFECT_TYPE).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(C.QUALITY_SCORE).alias("n_scored"), F.count("event_id").alias("n_events"),
        F.sum(C.DEFECT_COUNT).alias("defects"))


@register("stream_kpis", "ST2", with_events("""
SELECT count(*) AS "Rows", CAST(coalesce(sum(DefectCount), 0) AS BIGINT) AS Defects,
  round(coalesce(sum(CostImpact), 0.0), 4) AS COPQ FROM evfact"""))
def q_stream_kpis(spark, sf_dir):
    t = S.run_to_table(spark, S.stream_kpis(events_stream(spark, sf_dir)), "update", "kpis")
    return rounded(t, money=("COPQ",))


@register("stream_kpis_by_type", "ST2 keyed", with_events("""
SELECT Defect_Type, count(*) AS "Rows", CAST(coalesce(sum(DefectCount), 0) AS BIGINT) AS Defects,
  round(coalesce(sum(CostImpact), 0.0), 4) AS COPQ FROM evfact GROUP BY 1"""))
def q_stream_kpis_by_type(spark, sf_dir):
    """The rows that batches changed, upserted by defect type."""
    kpis = S.stream_kpis(events_stream(spark, sf_dir), [C.DEFECT_TYPE])
    return rounded(S.run_to_table(spark, kpis, "update", "kpis", [C.DEFECT_TYPE]), money=("COPQ",))


_WM = """wm AS (SELECT max("Date") - INTERVAL 1 DAY AS wm FROM evfact)"""


@register("stream_daily_trend", "ST3", with_events("""
SELECT CAST("Date" AS DATE) AS day, CAST(coalesce(sum(DefectCount), 0) AS BIGINT) AS Defects,
  round(coalesce(sum(CostImpact), 0.0), 4) AS COPQ, count(*) AS "Rows"
FROM evfact GROUP BY 1
HAVING CAST(CAST("Date" AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT wm FROM wm)""", _WM))
def q_stream_daily_trend(spark, sf_dir):
    t = S.run_to_table(spark, S.stream_daily(events_stream(spark, sf_dir)), "append", "daily")
    return rounded(t, money=("COPQ",))


@register("stream_copq_7d", "ST4", with_events("""
SELECT start_day, CAST(start_day + INTERVAL 7 DAY AS DATE) AS end_day, round(sum(CostImpact), 4) AS COPQ_7d,
  round(sum(CostImpact) / 7.0, 4) AS COPQ_7d_avg
FROM (SELECT CAST(CAST("Date" AS DATE) - INTERVAL (k) DAY AS DATE) AS start_day, CostImpact
      FROM evfact, range(7) t(k))
GROUP BY start_day
HAVING CAST(start_day AS TIMESTAMP) + INTERVAL 7 DAY <= (SELECT wm FROM wm)""", _WM))
def q_stream_copq_7d(spark, sf_dir):
    t = S.run_to_table(spark, S.stream_copq_7d(events_stream(spark, sf_dir)), "append", "copq7d")
    return rounded(t, money=("COPQ_7d", "COPQ_7d_avg"))


_ALERT_SPIKE, _ALERT_DAYS = 500.0, 3


@register("stream_alerts", "ST5", with_events(f"""
SELECT 'copq_spike' AS "key", printf('COPQ spike: today''s cost %.0f vs 7-day avg %.0f', value, baseline) AS message,
  round(value, 4) AS value, (n // {_ALERT_DAYS} - 1)::INTEGER AS epoch
FROM (
  SELECT period, value, avg(value) OVER w AS baseline, count(*) OVER w AS wn,
         row_number() OVER (ORDER BY period) AS n
  FROM series_e WINDOW w AS (ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
) s2
WHERE n > 7 AND wn = 7 AND n % {_ALERT_DAYS} = 0 AND value > baseline + {_ALERT_SPIKE}""",
    """daily_e AS (SELECT CAST("Date" AS DATE) AS d, sum(coalesce(CostImpact, 0.0)) AS v FROM evfact
       WHERE "Date" IS NOT NULL GROUP BY 1)""",
    """series_e AS (
  SELECT c.period, coalesce(daily_e.v, 0.0) AS value
  FROM (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS period FROM daily_e) c
  LEFT JOIN daily_e ON c.period = daily_e.d)"""))
def q_stream_alerts(spark, sf_dir):
    """Alerts on change, the rules evaluated after every third day.  A second
    stream brings one heartbeat, a row without values two days after the last
    event, as sources send to let the watermark pass their last day."""
    events = events_stream(spark, sf_dir)
    last = read_table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    path = scratch_path(spark, "heartbeat")
    beat = spark.range(1).select(F.lit(last).cast("timestamp").alias("ts"))
    beat.select((F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias(C.DATE)).write.parquet(path)
    beats = spark.readStream.schema(f"{C.DATE} timestamp").parquet(path)
    params = DEFAULT_PARAMS.with_(alert_copq_spike_threshold=_ALERT_SPIKE)
    found = S.stream_alerts(spark, events.unionByName(beats, allowMissingColumns=True), params, _ALERT_DAYS)
    return rounded(found.select("key", "message", "value", "epoch"), money=("value",))


_STREAM_COLUMNS = ("event_id", "EventDate", "SupplierID", "DefectType", "Cost_Impact_SGD", "DefectCount",
                   "CostImpact", "Supplier", "Defect_Type", "Date")


def _stream_missing_sql() -> str:
    parts = [f"SELECT {i} AS seq, '{c}' AS \"column\", CAST(count(*) - count(\"{c}\") AS BIGINT) AS missing FROM evfact"
             for i, c in enumerate(_STREAM_COLUMNS)]
    return "SELECT m.*, r.n AS \"rows\", round(CAST(m.missing AS DOUBLE) / CAST(r.n AS DOUBLE), 6) AS missing_frac FROM (" \
        + "\nUNION ALL ".join(parts) + ") m CROSS JOIN (SELECT count(*) AS n FROM evfact) r"


@register("stream_quality_report", "ST6", with_events(_stream_missing_sql()))
def q_stream_quality_report(spark, sf_dir):
    return rounded(S.stream_quality_report(spark, events_stream(spark, sf_dir)))
