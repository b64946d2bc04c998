"""ST1-ST6: Structured Streaming versions of the live refresh.

The reference appends one fabricated row on a timer and recomputes every
view over the whole table.  Here arriving files are the stream: rows are
normalised statelessly (ST1), KPIs are running aggregates of which a batch hands on
only the rows it changed, upserted by key (ST2), daily sums are an event-time
aggregate with a watermark (ST3; rows later than the watermark are dropped), the
7-day windows are a second aggregate over the finished days (ST4), alerts on
change keep their state per alert key (ST5, ``alert_state``), and the data-quality
counts are a running aggregate too (ST6).  All state is Spark's own and belongs
to the checkpoint.  Sinks are files in the shared checkpoint folder, one folder per
micro-batch epoch written idempotently, so a restarted query that replays
an epoch overwrites instead of duplicating.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectkit import columns as C
from inspectkit.operators.kpis import copq_expr, defects_expr
from inspectkit.operators.normalize import normalize
from inspectkit.params import DEFAULT_PARAMS, QualityParams
from inspectkit.session import scratch_path
from inspectkit.streaming.alert_state import start_alerts


def stream_fact(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                to_raw: Callable[[DataFrame], DataFrame] | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """ST1 source: arriving files -> (optional mapping) -> normalised rows.

    ``normalize`` is a stateless projection; the canonical Date is a
    session-timezone timestamp, as ``withWatermark`` requires."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    sdf = r.load(path)
    if to_raw is not None:
        sdf = to_raw(sdf)
    return normalize(sdf)


def append_batch(table: DataFrame, batch: DataFrame) -> DataFrame:
    """ST1 for an arriving batch with other columns: rows of both, matched by
    column name; columns that one side lacks are NULL in its rows."""
    return table.unionByName(batch, allowMissingColumns=True)


def stream_kpis(sdf: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """ST2: running Rows / Defects / COPQ / rate means, per ``by`` key if given.
    In update mode a batch hands on the keys it changed; ``run_to_table`` or
    ``current_rows`` upsert them."""
    aggs = [F.count(F.lit(1)).alias("Rows"), defects_expr(sdf).alias("Defects"), copq_expr(sdf).alias("COPQ")]
    if C.has(sdf, C.ON_TIME_FLAG):
        aggs.append((F.avg(C.ON_TIME_FLAG) * 100.0).alias("OnTimeRate"))
    if C.has(sdf, C.DEFECT_RATE):
        aggs.append((F.avg(C.DEFECT_RATE) * 100.0).alias("DefectRatePct"))
    return sdf.groupBy(*by).agg(*aggs)


def stream_daily(sdf: DataFrame, delay: str = "1 day") -> DataFrame:
    """ST3: daily defects and COPQ per event-time day (append mode: a day is
    emitted once the watermark passes its end; rows later than that are dropped)."""
    w = sdf.withWatermark(C.DATE, delay).groupBy(F.window(C.DATE, "1 day").alias("w"))
    return w.agg(defects_expr(sdf).alias("Defects"), copq_expr(sdf).alias("COPQ"),
                 F.count(F.lit(1)).alias("Rows")).select(
        F.to_date(F.col("w.start")).alias("day"), "Defects", "COPQ", "Rows")


def stream_copq_7d(sdf: DataFrame, delay: str = "1 day") -> DataFrame:
    """ST4: 7-day COPQ sums sliding by one day, and their daily average.

    Two chained stateful aggregates: rows are summed per day, and the finished
    days (one row each) fall into seven windows, so no row is multiplied and
    the first state holds one entry per open day."""
    day = F.window(C.DATE, "1 day").alias("d")
    days = sdf.withWatermark(C.DATE, delay).groupBy(day).agg(copq_expr(sdf).alias("cost"))
    w = days.groupBy(F.window("d", "7 days", "1 day").alias("w")).agg(F.sum("cost").alias("COPQ_7d"))
    return w.select(
        F.to_date(F.col("w.start")).alias("start_day"), F.to_date(F.col("w.end")).alias("end_day"),
        "COPQ_7d", (F.col("COPQ_7d") / 7.0).alias("COPQ_7d_avg"))


ALERT_OUT = "key string, message string, value double, day date, epoch int, emitted_at timestamp"


def stream_alerts(spark: SparkSession, sdf: DataFrame, params: QualityParams = DEFAULT_PARAMS, every: int = 1) -> DataFrame:
    """Run ST5 to the end of the available input; the emitted alerts with the
    time of their emission (the alert history)."""
    base = scratch_path(spark, "alerts")
    start_alerts(sdf, f"{base}/out", f"{base}/ckpt", params, every).awaitTermination()
    return spark.read.schema(ALERT_OUT).parquet(f"{base}/out")


def write_epochs(sdf: DataFrame, out: str, checkpoint: str, mode: str = "append", name: str | None = None,
                 available_now: bool = True):
    """Run a streaming DataFrame into ``out/epoch=<id>`` folders (idempotent
    per epoch).  Returns the started query."""
    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    w = sdf.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    if name:
        w = w.queryName(name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def current_rows(changes: DataFrame, keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Upsert the rows of all epochs by key: of each key those of its last epoch."""
    last = changes.groupBy(*keys).agg(F.max("epoch").alias("__e"))
    if not keys:
        return changes.join(F.broadcast(last), F.col("epoch") == F.col("__e")).drop("__e", "epoch")
    for k in keys:
        last = last.withColumnRenamed(k, f"__k_{k}")
    same = [changes[k].eqNullSafe(last[f"__k_{k}"]) for k in keys]
    return changes.join(last, [*same, changes["epoch"] == last["__e"]], "left_semi").drop("epoch")


def run_to_table(spark: SparkSession, sdf: DataFrame, mode: str = "append", tag: str = "stream",
                 keys: list[str] | tuple[str, ...] = (), base: str | None = None) -> DataFrame:
    """Run ``sdf`` with ``availableNow`` to completion and return what the
    sink holds: every epoch for append mode, the current row of each key for update mode,
    the last epoch for complete mode.  ``base``: folder to go on from."""
    base = base or scratch_path(spark, tag)
    q = write_epochs(sdf, f"{base}/out", f"{base}/ckpt", mode)
    q.awaitTermination()
    if not _has_epochs(spark, f"{base}/out"):
        return spark.createDataFrame([], sdf.schema)
    schema = T.StructType([*sdf.schema.fields, T.StructField("epoch", T.IntegerType())])
    res = spark.read.schema(schema).parquet(f"{base}/out")
    if mode == "append":
        return res.drop("epoch")
    return current_rows(res, keys if mode == "update" else ())


def _has_epochs(spark: SparkSession, path: str) -> bool:
    """Has the sink written any batch?  A stream without data writes none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stream_quality_report(spark: SparkSession, sdf: DataFrame) -> DataFrame:
    """ST6: rows and NULLs per column as a running aggregate (one state row);
    a stream without data gives no rows.  Duplicates need the whole table and
    are left to the batch report."""
    counts = [F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"__{i}") for i, c in enumerate(sdf.columns)]
    total = run_to_table(spark, sdf.agg(F.count(F.lit(1)).alias("rows"), *counts), "update", "dq")
    names = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(c).alias("column"), F.col(f"__{i}").alias("missing")) for i, c in enumerate(sdf.columns)])
    long = total.select("rows", F.explode(names).alias("c")).select("c.seq", "c.column", "c.missing", "rows")
    share = F.col("missing").cast("double") / F.nullif(F.col("rows").cast("double"), F.lit(0.0))
    return long.withColumn("missing_frac", share)
