"""M4-M5: isolation-forest anomaly flags over every complete row.

MLlib has no isolation forest, so the published algorithm (random axis
splits on small subsamples; anomaly score 2^(-E[h(x)] / c(psi))) is
expressed as Spark jobs:

1. Subsample pool.  Every complete row gets a random key of its own, equal rows too, and
   the ``trees x psi`` smallest keys are taken: a per-partition top-n of the rows
   below a limit, merged; no row is shuffled before.  The draw follows the seed and
   the partitioning; a table that fits the pool is drawn whole, and its trees don't
   depend on the partitioning.
2. Trees.  The pool's places are dealt to the trees in order, ``psi`` each,
   around the pool as often as needed -- one rule for any table size -- and
   ``groupBy(tree).applyInPandas`` grows all trees in parallel (one small
   group of ``psi`` rows per tree).
3. Scoring.  The forest is a table of at most ``trees x (2 psi - 1)`` nodes,
   a size fixed by the parameters, so it is broadcast; a vectorised pandas
   UDF walks all trees level by level over Arrow batches of rows.
4. Threshold.  The 1 - contamination quantile of the scores of ALL complete
   rows (a sketch of bounded size); every row scoring above it is flagged.
   Rows with a NULL feature are never flagged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectkit.operators.multivariate import numeric_columns
from inspectkit.params import DEFAULT_PARAMS, QualityParams
from inspectkit.session import materialize, written, written_columns

NODE_SCHEMA = T.StructType([
    T.StructField("tree_id", T.IntegerType()),
    T.StructField("node_id", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("leaf_depth", T.DoubleType()),
])

_EULER = 0.5772156649015329


def avg_path_length(n: np.ndarray | float) -> np.ndarray:
    """c(n): mean path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + _EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def grow_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """One isolation tree on the sample ``x`` as (node, feature, threshold, left, right, leaf_depth)."""
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, 0)]  # (rows, depth, parent, side)
    while stack:
        rows, depth, parent, side = stack.pop()
        nid = len(nodes)
        nodes.append([nid, -1, 0.0, -1, -1, 0.0])
        if parent >= 0:
            nodes[parent][3 if side == 0 else 4] = nid
        sub = x[rows]
        if depth >= max_depth or len(rows) <= 1:
            nodes[nid][5] = depth + float(avg_path_length(len(rows)))
            continue
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            nodes[nid][5] = depth + float(avg_path_length(len(rows)))
            continue
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < thr
        nodes[nid][1], nodes[nid][2] = f, thr
        stack.append((rows[~go_left], depth + 1, nid, 1))
        stack.append((rows[go_left], depth + 1, nid, 0))
    return [tuple(n) for n in nodes]


def pool_plan(d: DataFrame, most: int, total: int, seed: int) -> DataFrame:
    """The ``most`` of ``total`` rows with the smallest random keys, a key of its own for
    every row, equal rows too.  Rows whose key cannot be among them never leave their
    partition: the limit below which they are taken is eight deviations high."""
    share = min(1.0, (most + 8 * math.sqrt(most) + 64) / max(total, 1))
    return d.withColumn("__u", F.rand(seed)).where(F.col("__u") < share).orderBy("__u").limit(most)


def drawn_pool(d: DataFrame, most: int, seed: int) -> DataFrame:
    total = d.count()
    pool = materialize(pool_plan(d, most, total, seed))
    if pool.count() < min(most, total):  # too few below the limit: all keys
        pool = materialize(pool_plan(d, most, 0, seed))
    return pool


def fit_isolation_forest(df: DataFrame, cols: list[str] | None = None, params: QualityParams = DEFAULT_PARAMS,
                         n_trees: int | None = None, sample_rows: int | None = None, seed: int | None = None):
    """Grow the forest; returns ``(nodes DataFrame, psi, cols)`` or None when
    fewer than 10 complete rows exist."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    n_trees = n_trees or params.anomaly_trees
    sample_rows = sample_rows or params.anomaly_sample_rows
    seed = params.random_state if seed is None else seed
    if not cols:
        return None
    d = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).dropna()
    pool = drawn_pool(d, n_trees * sample_rows, seed)
    # inside the pool, keys by value and place among equal rows: a table that the pool
    # holds whole gives the same trees however it is partitioned
    place = F.row_number().over(Window.partitionBy(*cols).orderBy("__u"))
    pool = pool.withColumn("__j", place).withColumn("__u", F.xxhash64(*cols, "__j", F.lit(seed)))
    n = pool.count()
    if n < 10:
        return None
    psi = min(sample_rows, n)
    # tree t gets the places t * psi .. t * psi + psi - 1 of the pool, counted
    # around it: disjoint samples where the pool holds trees x psi rows,
    # overlapping ones otherwise, never a row twice in a tree.  The window
    # spans the pool only
    place = F.row_number().over(Window.orderBy("__u", *cols, "__j")) - 1
    dealt = pool.withColumn("__k", place).withColumn(
        "__r", F.explode(F.sequence(F.col("__k"), F.lit(n_trees * psi - 1), F.lit(n))))
    sample = dealt.select("*", F.floor(F.col("__r") / F.lit(psi)).cast("int").alias("tree_id"))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tid = int(pdf["tree_id"].iloc[0])
        rng = np.random.default_rng([seed, tid])
        x = pdf.sort_values("__r")[cols].to_numpy(dtype=float)
        rows = grow_tree(x, rng, max_depth)
        out = pd.DataFrame(rows, columns=["node_id", "feature", "threshold", "left", "right", "leaf_depth"])
        out.insert(0, "tree_id", tid)
        return out.astype({"tree_id": "int32", "node_id": "int32", "feature": "int32", "left": "int32", "right": "int32"})

    nodes = sample.select("tree_id", "__r", *cols).groupBy("tree_id").applyInPandas(build, NODE_SCHEMA)
    return nodes, psi, cols


def _forest_arrays(nodes_pdf: pd.DataFrame):
    nodes_pdf = nodes_pdf.sort_values(["tree_id", "node_id"])
    trees = []
    for _, g in nodes_pdf.groupby("tree_id"):
        trees.append((g["feature"].to_numpy(np.int32), g["threshold"].to_numpy(float),
                      g["left"].to_numpy(np.int32), g["right"].to_numpy(np.int32), g["leaf_depth"].to_numpy(float)))
    return trees


def detect_anomalies(df: DataFrame, cols: list[str] | None = None, params: QualityParams = DEFAULT_PARAMS,
                     contamination: float | None = None, seed: int | None = None,
                     n_trees: int | None = None, sample_rows: int | None = None,
                     keep: list[str] | None = None) -> DataFrame:
    """M4: add ``anomaly_score`` (higher = more isolated) and ``is_anomaly``
    to every row.  Rows with a NULL feature get a NULL score and False.  ``keep``:
    the other columns to return, all by default."""
    spark = df.sparkSession
    contamination = params.anomaly_contamination if contamination is None else contamination
    if not 0 < contamination < 1:
        raise ValueError(f"the share to flag must lie between 0 and 1, not {contamination}")
    cols = list(cols) if cols is not None else numeric_columns(df)
    keep = list(df.columns) if keep is None else list(keep)
    # count, pool and scoring each read the rows: written once
    df = written_columns(df, [*keep, *cols], "anomaly-rows")
    fitted = fit_isolation_forest(df, cols, params, n_trees, sample_rows, seed)
    if fitted is None:
        return df.select(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("double").alias("anomaly_score"), F.lit(False).alias("is_anomaly"))
    nodes, psi, cols = fitted
    # forest size is fixed by the parameters (trees x (2 psi - 1) nodes)
    forest = spark.sparkContext.broadcast(_forest_arrays(nodes.toPandas()))
    c_psi = float(avg_path_length(psi))

    @F.pandas_udf("double")
    def score(xdf: pd.DataFrame) -> pd.Series:
        x = xdf.to_numpy(dtype=float)
        ok = ~np.isnan(x).any(axis=1)
        total = np.zeros(len(x))
        for feat, thr, left, right, leaf in forest.value:
            node = np.zeros(len(x), dtype=np.int64)
            active = ok.copy()
            while active.any():
                f = feat[node]
                inner = active & (f >= 0)
                if not inner.any():
                    break
                idx = np.flatnonzero(inner)
                v = x[idx, f[idx]]
                nd = node[idx]
                node[idx] = np.where(v < thr[nd], left[nd], right[nd])
                active = inner
            total += leaf[node]
        s = np.power(2.0, -(total / len(forest.value)) / c_psi)
        s[~ok] = np.nan
        return pd.Series(s)

    def feats():
        return F.struct(*[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(cols)])

    # every row is scored once and written; the threshold is the
    # 1 - contamination quantile of the scores of all complete rows, from a
    # sketch of bounded size (rank error below 1e-4 of the rows)
    scored = df.withColumn("__s", score(feats())).select(
        *[F.col(f"`{c}`") for c in keep], F.when(~F.isnan(F.col("__s")), F.col("__s")).alias("anomaly_score"))
    scored = written(scored, "anomaly-scores")
    thr = scored.agg(F.percentile_approx("anomaly_score", 1.0 - contamination, 10000).alias("__t")).first()["__t"]
    if thr is None:
        return scored.withColumn("is_anomaly", F.lit(False))
    return scored.withColumn("is_anomaly", F.coalesce(F.col("anomaly_score") > F.lit(float(thr)), F.lit(False)))


def anomaly_summary(flagged: DataFrame) -> DataFrame:
    """M5: rows, flagged rows and their percentage."""
    return flagged.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col("is_anomaly"), 1)).alias("anomalies"),
    ).select("rows", "anomalies",
             (F.col("anomalies").cast("double") * 100.0 / F.nullif(F.col("rows").cast("double"), F.lit(0.0)))
             .alias("anomaly_pct"))
