"""Session helpers: configuration the plans rely on, shared scratch space."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "inspectkit") -> SparkSession:
    """The running session as it is, or a new one.

    A session that exists keeps all its settings but the time zone, which the
    plans rely on.  For a new one the launcher's settings hold; values here are
    for local runs, and the number of shuffle partitions is set only if given.
    """
    spark = SparkSession.getActiveSession()
    if spark is None:
        b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
        if master:
            b = b.master(master)
        if master and master.startswith("local"):
            # the driver JVM is the only executor; it is sized here (takes
            # effect when this call launches the JVM)
            b = b.config("spark.driver.memory", os.environ.get("INSPECTKIT_DRIVER_MEMORY", "16g"))
            b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        if shuffle_partitions:
            b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        spark = b.getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Per-query settings every plan assumes (safe to call repeatedly)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, stream state and written tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir).  Only
    in local mode, where nothing is shared anyway, a fresh temporary folder is
    created when none is set; a cluster session without one is an error.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        jd = sc._jsc.sc().getCheckpointDir()
        d = jd.get() if jd.isDefined() else None
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder every executor can reach"
            )
        d = tempfile.mkdtemp(prefix="inspectkit-ckpt-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", d)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(d)
    return d


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small aggregated intermediate that is read more
    than once (e.g. a per-period series feeding both its calendar bounds and
    a join).  Column pruning makes such branches differ, so exchange reuse
    does not apply and each branch would rescan the fact; an eager checkpoint
    into the shared checkpoint folder computes it once.  Only for results
    whose size is bounded by groups x periods or label pairs, never rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write into the shared folder as parquet and read back: cuts the lineage
    of row-level data that is read more than once, and keeps column pruning."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_columns(df: DataFrame, names, name: str) -> DataFrame:
    """The columns of ``names`` that df has, written once.  Files hold neither columns
    without a type, which are added again, nor rows without a column, which get one."""
    wanted = set(names)
    fields = [f for f in df.schema.fields if f.name in wanted]
    kept = [F.col(f"`{f.name}`") for f in fields if not isinstance(f.dataType, T.NullType)]
    out = written(df.select(*(kept or [F.lit(True).alias("__row")])), name)
    return out.withColumns({f.name: F.lit(None) for f in fields if isinstance(f.dataType, T.NullType)})


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """An empty DataFrame with a declared schema (degraded paths)."""
    return spark.createDataFrame([], schema)
