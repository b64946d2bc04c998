"""Composite quality index, its statistics, histogram and series.

X1 needs two quantiles per part column.  All columns share the passes of
``quantiles.column_quantiles``; the few numbers found enter the plan as literals
(per group, they are joined by the group key) and the index is plain arithmetic in
the same codegen stage as the scan.  After winsorising, min = q_lo and
max = q_hi exactly.  X2 to X4 write the index, one narrow column, before they
count over it or sort by it, so no predicate or sort key carries the index expression.  Who reads rows and
index writes the columns it needs first (``index_columns``, ``stored``): the
quantile passes and the index itself then share one computation of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inspectkit import columns as C
from inspectkit.operators.seriesidx import downsample_rows
from inspectkit.params import DEFAULT_PARAMS, QualityParams
from inspectkit.operators.quantiles import column_quantiles, exact_quantiles, quantile_columns
from inspectkit.session import empty, written, written_columns

INDEX = "QualityIndex"


METHODS = ("two_pass", "percentile", "approx")


def _method(params: QualityParams) -> str:
    if params.quantile_method not in METHODS:
        raise ValueError(f"unknown quantile method {params.quantile_method!r}")
    return params.quantile_method


def quantiles(col: Column, probs: list[float], params: QualityParams) -> Column:
    """Quantiles as one aggregate, for the methods other than "two_pass":
    linear-interpolated ones (``percentile`` keeps a value->count map per
    group) or Greenwald-Khanna sketches (``percentile_approx``)."""
    if _method(params) == "approx":
        return F.percentile_approx(col, probs, params.approx_accuracy)
    return F.percentile(col, probs)


def join_stats(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Attach group statistics: a broadcast cross join for one global row
    (a proven size of one), a null-safe equi-join (the planner decides
    broadcast by measured size) per group."""
    if not by:
        return df.crossJoin(F.broadcast(stats))
    s = stats
    for k in by:
        s = s.withColumnRenamed(k, f"__k_{k}")
    cond = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by]
    out = df.join(s, cond, "left")
    return out.drop(*[f"__k_{k}" for k in by])


def quality_index(
    df: DataFrame,
    params: QualityParams = DEFAULT_PARAMS,
    by: list[str] | tuple[str, ...] = (),
    name: str = INDEX,
    stored: bool = False,
) -> DataFrame:
    """Add the 0-100 composite index as column ``name``.

    Parts present among DefectRate (lower is better), QualityScore,
    YieldPercentage, OnTimeFlag: winsorise to the [0.05, 0.95] linear
    quantiles, min-max scale, flip when lower is better, clip to 0..1; a
    constant or all-NULL part is 0.5 on every row; mean over non-NULL parts
    times 100; NULL when no part is non-NULL.  Statistics are per ``by`` group.
    ``stored``: df is a written table, so its columns need no copy for the passes.
    """
    by = list(by)
    parts = [(c, hb) for c, hb in C.QUALITY_INDEX_PARTS if C.has(df, c)]
    if not parts:
        return df.withColumn(name, F.lit(None).cast("double"))
    lo_p, hi_p = params.quality_index_winsor_limits
    literal = params.quality_index_winsorize and _method(params) == "two_pass" and not by
    if literal:
        found = column_quantiles(df, [c for c, _ in parts], [lo_p, hi_p], stored=stored)
        j = df.select("*", *[F.lit(found[c][e]).cast("double").alias(f"__{end}{i}") for i, (c, _) in enumerate(parts) for e, end in enumerate(("lo", "hi"))])
    elif params.quality_index_winsorize and _method(params) == "two_pass":
        qc = quantile_columns(df, [c for c, _ in parts], [lo_p, hi_p], by)
        stats = qc.select(*by, *[x for i, (c, _) in enumerate(parts) for x in (
            F.col(f"{c}_q0").alias(f"__lo{i}"), F.col(f"{c}_q1").alias(f"__hi{i}"))])
        # a file's size is known: the rows are not shuffled by group for a small table
        stats = written(stats, "index-bounds")
    else:
        aggs = []
        for i, (c, _) in enumerate(parts):
            v = F.col(c).cast("double")
            if params.quality_index_winsorize:
                aggs.append(quantiles(v, [lo_p, hi_p], params).alias(f"__q{i}"))
            else:
                aggs.append(F.array(F.min(v), F.max(v)).alias(f"__q{i}"))
        stats = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
        stats = stats.select(
            *by,
            *[x for i in range(len(parts)) for x in (
                F.col(f"__q{i}")[0].alias(f"__lo{i}"), F.col(f"__q{i}")[1].alias(f"__hi{i}"))],
        )
    if not literal:
        j = join_stats(df, stats, by)
    # staged projections: every sub-expression is a column used by the next
    # stage, so Catalyst keeps it computed once instead of inlining it into
    # each CASE branch (one huge expression would exceed codegen limits)
    raw = []
    for i, (c, higher_better) in enumerate(parts):
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        v = F.col(c).cast("double")
        if params.quality_index_winsorize:
            v = F.when(v < lo, lo).when(v > hi, hi).otherwise(v)
        r = (v - lo) / F.nullif(hi - lo, F.lit(0.0))  # constant part: guarded below
        if not higher_better:
            r = F.lit(1.0) - r
        const = lo.isNull() | hi.isNull() | (lo == hi)
        raw += [r.alias(f"__r{i}"), const.alias(f"__c{i}")]
    j = j.select("*", *raw)
    parts_s = []
    for i in range(len(parts)):
        r = F.col(f"__r{i}")
        clipped = F.when(r < 0, F.lit(0.0)).when(r > 1, F.lit(1.0)).otherwise(r)
        parts_s.append(F.when(F.col(f"__c{i}"), F.lit(0.5)).otherwise(clipped).alias(f"__s{i}"))
    j = j.select("*", *parts_s)
    sc = [F.col(f"__s{i}") for i in range(len(parts))]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in sc[1:]), F.coalesce(sc[0], F.lit(0.0)))
    cnt = sum((x.isNotNull().cast("int") for x in sc[1:]), sc[0].isNotNull().cast("int"))
    j = j.select("*", total.alias("__tot"), cnt.alias("__cnt"))
    idx = F.when(F.col("__cnt") > 0, F.col("__tot") / F.col("__cnt").cast("double") * F.lit(100.0))
    drop = [f"__{k}{i}" for i in range(len(parts)) for k in ("lo", "hi", "r", "c", "s")] + ["__tot", "__cnt"]
    return j.withColumn(name, idx).drop(*drop)


def index_columns(df: DataFrame, others: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The parts of the index and ``others``, those that df has, written once."""
    return written_columns(df, [*others, *[c for c, _ in C.QUALITY_INDEX_PARTS]], "index-parts")


def quality_index_stats(df: DataFrame, params: QualityParams = DEFAULT_PARAMS, by=()) -> DataFrame:
    """Mean, median, min, max of the index (NULLs skipped)."""
    by = list(by)
    d = index_columns(df, by)
    q = written(quality_index(d, params, by, stored=True).select(*by, INDEX), "index")
    v = F.col(INDEX)
    aggs = [F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n")]
    if _method(params) != "two_pass":
        median = F.percentile_approx(v, 0.5, params.approx_accuracy) if _method(params) == "approx" else F.percentile(v, 0.5)
        aggs.append(median.cast("double").alias("median"))
    out = q.groupBy(*by).agg(*aggs)
    if _method(params) == "two_pass" and by:
        out = join_stats(out, exact_quantiles(q, INDEX, [0.5], by).withColumnRenamed("q0", "median"), by)
    elif _method(params) == "two_pass":
        out = out.withColumn("median", F.lit(column_quantiles(q, [INDEX], [0.5], stored=True)[INDEX][0]).cast("double"))
    return out.select(*by, "mean", "median", "min", "max", "n")


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """X3 core: equal-width bins between min and max, last bin closed;
    constant data uses min-0.5 .. max+0.5.  All bins are returned, empty ones
    with 0.  One aggregation for the range, one for the counts; the bin table
    has ``bins`` rows."""
    v = F.col(col).cast("double")
    rng = df.agg(F.min(v).alias("__mn"), F.max(v).alias("__mx")).select(
        F.when(F.col("__mn") == F.col("__mx"), F.col("__mn") - 0.5).otherwise(F.col("__mn")).alias("__lo"),
        F.when(F.col("__mn") == F.col("__mx"), F.col("__mx") + 0.5).otherwise(F.col("__mx")).alias("__hi"),
    )
    counts = (
        df.select(v.alias("__v")).filter(F.col("__v").isNotNull())
        .crossJoin(F.broadcast(rng))
        .select(F.least(
            F.floor((F.col("__v") - F.col("__lo")) * F.lit(float(bins)) / (F.col("__hi") - F.col("__lo"))).cast("int") + 1,
            F.lit(bins)).alias("bin"))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    )
    grid = rng.filter(F.col("__lo").isNotNull()).select(
        F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "__lo", "__hi"
    )
    width = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
    return grid.join(counts, "bin", "left").select(
        F.col("bin"),
        (F.col("__lo") + (F.col("bin") - 1) * width).alias("bin_lo"),
        (F.col("__lo") + F.col("bin") * width).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
    )


def quality_index_histogram(df: DataFrame, params: QualityParams = DEFAULT_PARAMS, bins: int = 20) -> DataFrame:
    """Histogram of the index."""
    return histogram(written(quality_index(index_columns(df), params, stored=True).select(INDEX), "index"), INDEX, bins)


def quality_index_series(df: DataFrame, params: QualityParams = DEFAULT_PARAMS, k: int | None = None,
                         digits: int | None = None) -> DataFrame:
    """(Date, index) for rows where both are non-NULL, in date order,
    thinned to ``k`` evenly spaced rows (all rows when there are fewer).
    ``digits``: the index is rounded before."""
    if not C.has(df, C.DATE):
        return empty(df.sparkSession, "Date timestamp, QualityIndex double, pos bigint")
    k = params.max_points_line_chart if k is None else k
    # filter, sort keys and sampling of the ranges read the index as a column
    index = F.col(INDEX) if digits is None else F.round(INDEX, digits).alias(INDEX)
    q = written(quality_index(index_columns(df, [C.DATE]), params, stored=True).select(C.DATE, index), "index")
    q = q.filter(F.col(C.DATE).isNotNull() & F.col(INDEX).isNotNull())
    return downsample_rows(q, [C.DATE, INDEX], k)
