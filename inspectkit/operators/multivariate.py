"""M1-M3, M6: correlation, strongest pairs, PCA, candidate target columns.

M1 is two aggregations over the whole table (means, then sums of centred
products for every column pair): partial aggregates per partition, merged
once.  M3 uses Spark ML, whose PCA builds the p x p covariance with a tree
aggregation (p = number of numeric columns, not rows).  What several passes
read is written once, so the input's own joins run once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectkit import columns as C
from inspectkit.functions import is_numeric_type
from inspectkit.session import empty, written


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def complete_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Listwise deletion: rows with no NULL (or NaN) in ``cols``, as doubles."""
    sel = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    cond = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`")) for c in cols])
    return sel.filter(cond)


def written_complete_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """The complete rows, written once, as columns x0, x1, ..."""
    d = complete_rows(df, cols)
    return written(d.select(*[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(cols)]), "complete-rows")


def correlation_long(df: DataFrame, cols: list[str] | None = None, digits: int | None = 3) -> DataFrame:
    """M1: Pearson r for every ordered column pair ``(col_a, col_b, corr)``
    after listwise deletion; a constant column gives NULL (never an error).

    Two cheap passes instead of p(p+1)/2 covariance aggregates (whose
    buffers exceed the codegen field limit): means and constant flags (one
    row), then plain sums of centred products -- numerically stable, and
    every aggregate a codegen'd ``sum``.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    if len(cols) < 2:
        return empty(df.sparkSession, "seq_a int, col_a string, seq_b int, col_b string, corr double")
    d = written_complete_rows(df, cols)
    x = [F.col(f"x{i}") for i in range(len(cols))]
    first = d.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.avg(v).alias(f"__m{i}") for i, v in enumerate(x)],
                  *[(F.min(v) == F.max(v)).alias(f"__k{i}") for i, v in enumerate(x)]).first()
    # pass 1 is one row of 2p+1 numbers (bounded by the column count): it is
    # read on the driver and enters pass 2 as literals
    n = int(first["__n"])
    means = [first[f"__m{i}"] for i in range(len(cols))]
    const = [bool(first[f"__k{i}"]) if first[f"__k{i}"] is not None else True for i in range(len(cols))]
    z = d.select(*[(v - F.lit(float(means[i]) if means[i] is not None else 0.0)).alias(f"__z{i}")
                   for i, v in enumerate(x)])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    st = z.agg(*[F.sum(F.col(f"__z{i}") * F.col(f"__z{j}")).alias(f"__s{i}_{j}") for i, j in pairs])
    rs = []
    for i, j in pairs:
        den = F.sqrt(F.col(f"__s{i}_{i}")) * F.sqrt(F.col(f"__s{j}_{j}"))
        if const[i] or const[j] or n < 2:
            r = F.lit(None).cast("double")
        else:
            r = F.col(f"__s{i}_{j}") / F.nullif(den, F.lit(0.0))
        rs.append((F.round(r, digits) if digits is not None else r).alias(f"r{i}_{j}"))
    long = st.select(*rs).unpivot([], [f"r{i}_{j}" for i, j in pairs], "__key", "corr")
    # the pair table has p*p rows: bounded by the column count
    names = [(f"r{min(i, j)}_{max(i, j)}", i, cols[i], j, cols[j]) for i in range(len(cols)) for j in range(len(cols))]
    grid = df.sparkSession.createDataFrame(names, "__key string, seq_a int, col_a string, seq_b int, col_b string")
    return F.broadcast(grid).join(long, "__key").select("seq_a", "col_a", "seq_b", "col_b", "corr")


def top_correlations(df: DataFrame, n: int = 5, cols: list[str] | None = None) -> DataFrame:
    """M2: distinct off-diagonal pairs by |r| descending (NULLs dropped), top ``n``."""
    long = correlation_long(df, cols)
    return (
        long.filter((F.col("seq_a") < F.col("seq_b")) & F.col("corr").isNotNull())
        .orderBy(F.abs(F.col("corr")).desc(), F.col("seq_a").asc(), F.col("seq_b").asc())
        .limit(n)
        .select("col_a", "col_b", "corr")
    )


def pca_projection(df: DataFrame, k: int = 2, cols: list[str] | None = None):
    """M3: standardise, project on ``k`` principal components.

    Returns ``(scores, explained)``: per-row component scores, and one row per
    component with its explained-variance ratio.  Needs >= 3 complete rows
    and >= 2 columns, else both are empty.  Component signs are fixed so the
    largest absolute loading is positive (PCA signs are arbitrary).
    """
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    spark = df.sparkSession
    cols = list(cols) if cols is not None else numeric_columns(df)
    empty_scores = empty(spark, ", ".join(f"pc{i + 1} double" for i in range(k)))
    empty_ratio = empty(spark, "component int, explained_ratio double")
    if len(cols) < 2:
        return empty_scores, empty_ratio
    d = written_complete_rows(df, cols)
    if d.limit(3).count() < 3:
        return empty_scores, empty_ratio
    k = min(k, len(cols))
    va = VectorAssembler(inputCols=d.columns, outputCol="__x")
    x = va.transform(d)
    sc = StandardScaler(inputCol="__x", outputCol="__z", withMean=True, withStd=True).fit(x)
    z = sc.transform(x)
    pca = PCA(k=k, inputCol="__z", outputCol="__p").fit(z)
    pcs = pca.pc.toArray()  # p x k loadings: bounded by the column count
    signs = [1.0 if pcs[abs(pcs[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    scores = pca.transform(z).select(vector_to_array("__p").alias("__a")).select(
        *[(F.col("__a")[i] * F.lit(signs[i])).alias(f"pc{i + 1}") for i in range(k)])
    ratio = spark.createDataFrame(
        [(i + 1, float(v)) for i, v in enumerate(pca.explainedVariance.toArray())],
        "component int, explained_ratio double")
    return scores, ratio


def candidate_targets(df: DataFrame, max_categories: int = 50, exact_band: float = 0.15) -> DataFrame:
    """M6: columns (all but Date) with 2..``max_categories`` distinct non-NULL values.

    One pass of ``approx_count_distinct`` (HyperLogLog++, a few KB per
    column) over all columns; only columns whose estimate is at most a
    margin above the threshold get an exact ``count(distinct)`` in a second
    (lazy) pass, so exact distinct sets are never built for
    high-cardinality columns.  Both passes read the columns as written once.
    """
    # a column without a type has no values, and files have no such columns
    cols = [(i, f.name) for i, f in enumerate(df.schema.fields) if f.name != C.DATE and not isinstance(f.dataType, T.NullType)]
    if not cols:
        return empty(df.sparkSession, "seq int, column string, n_distinct bigint")
    d = written(df.select(*[F.col(f"`{c}`").alias(f"x{i}") for i, c in cols]), "target-columns")
    approx = d.agg(*[F.approx_count_distinct(f"x{i}", 0.02).alias(f"a{i}") for i, c in cols]).first()
    # the estimate's standard deviation is 2 %: a column of max_categories values is
    # estimated 15 % too high, seven and a half deviations, once in 10^13
    cand = [(i, c) for i, c in cols if approx[f"a{i}"] <= max_categories * (1 + exact_band) + 1]
    if not cand:
        return empty(df.sparkSession, "seq int, column string, n_distinct bigint")
    # exact pass on the few low-cardinality candidates only: Spark rewrites the
    # distinct aggregates into (column, value) partial aggregation, which stays
    # small map-side because every candidate has few values
    ex = d.agg(*[F.count_distinct(F.col(f"x{i}")).alias(f"e{i}") for i, c in cand])
    cells = [F.struct(F.lit(i).alias("seq"), F.lit(c).alias("column"), F.col(f"e{i}").cast("bigint").alias("n_distinct"))
             for i, c in cand]
    out = ex.select(F.explode(F.array(*cells)).alias("t")).select("t.*")
    return out.filter((F.col("n_distinct") >= 2) & (F.col("n_distinct") <= max_categories))
