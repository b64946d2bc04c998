"""Registered queries: correlation, PCA, candidate targets, anomalies, classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from inspectkit import columns as C
from inspectkit.operators import classify as CL
from inspectkit.operators import forest as FR
from inspectkit.operators import multivariate as M
from inspectkit.plans.catalog import fact, register, rounded
from inspectkit.plans.oracle import with_fact
from inspectkit.plans.q_report import FACT_COLUMNS
from inspectkit.operators.normalize import normalize
from inspectkit.sources.tables import quality_raw, read_table
from inspectkit.streaming import jobs as S

NUMERIC = [c for c, t in FACT_COLUMNS if t in ("double", "bigint")]


def _corr_cte(cols: list[str]) -> str:
    conds = " AND ".join(f'"{c}" IS NOT NULL AND NOT isnan(CAST("{c}" AS DOUBLE))' for c in cols)
    sel = ", ".join(f'CAST("{c}" AS DOUBLE) AS x{i}' for i, c in enumerate(cols))
    aggs = [f"stddev_samp(x{i}) AS s{i}" for i in range(len(cols))]
    aggs += [f"covar_samp(x{i}, x{j}) AS c{i}_{j}" for i in range(len(cols)) for j in range(i, len(cols))]
    rows = []
    for i in range(len(cols)):
        for j in range(len(cols)):
            a, b = min(i, j), max(i, j)
            rows.append(f"SELECT {i} AS seq_a, '{cols[i]}' AS col_a, {j} AS seq_b, '{cols[j]}' AS col_b, "
                        f"round(c{a}_{b} / nullif(s{i} * s{j}, 0.0), 3) AS corr FROM cagg")
    return (f"cdata AS (SELECT {sel} FROM fact WHERE {conds}),\n"
            f"cagg AS (SELECT {', '.join(aggs)} FROM cdata),\n"
            f"corr_long AS (\n" + "\nUNION ALL ".join(rows) + "\n)")


_CORR = _corr_cte(NUMERIC)


@register("numeric_correlation", "M1", with_fact("SELECT * FROM corr_long", _CORR))
def q_numeric_correlation(spark, sf_dir):
    return M.correlation_long(fact(spark, sf_dir))


@register("top_correlations", "M2", with_fact("""
SELECT col_a, col_b, corr FROM corr_long WHERE seq_a < seq_b AND corr IS NOT NULL
ORDER BY abs(corr) DESC, seq_a, seq_b LIMIT 5""", _CORR))
def q_top_correlations(spark, sf_dir):
    return M.top_correlations(fact(spark, sf_dir))


def _leading(k: int, matrix: str) -> list[str]:
    """CTEs of the largest eigenvalue l{k} and its vector v{k} of a symmetric matrix: the
    matrix is squared until only the leading component is left."""
    square = "list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b)))"
    scaled = "list_transform(mm, lambda r: list_transform(r, lambda x: x / mx))"
    most = "list_max(list_transform(mm, lambda r: list_max(list_transform(r, lambda x: abs(x)))))"
    unit = "list_transform(r, lambda x: x / sqrt(list_dot_product(r, r)))"
    return [
        f"""sq{k} AS (
  SELECT 0 AS k, m FROM {matrix}
  UNION ALL SELECT k + 1, {scaled} FROM (SELECT k, mm, {most} AS mx FROM (SELECT k, {square} AS mm FROM sq{k} WHERE k < 16)))""",
        f"""v{k} AS (SELECT {unit} AS v FROM (
  SELECT list_extract(m, list_position(list_transform(m, lambda r: list_dot_product(r, r)), list_max(list_transform(m, lambda r: list_dot_product(r, r))))) AS r
  FROM sq{k} WHERE k = 16))""",
        f"l{k} AS (SELECT list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM {matrix}, v{k})",
    ]


def _pca_sql(cols: list[str]) -> str:
    cell = lambda i, j: f"c{min(i, j)}_{max(i, j)} / (s{i} * s{j})"
    rows = ", ".join("[" + ", ".join(cell(i, j) for j in range(len(cols))) + "]" for i in range(len(cols)))
    rest = "list_transform(range(1, len(v) + 1), lambda i: list_transform(range(1, len(v) + 1), lambda j: m[i][j] - l * v[i] * v[j]))"
    ctes = [f"r1 AS (SELECT [{rows}] AS m FROM cagg)", *_leading(1, "r1"), f"r2 AS (SELECT {rest} AS m FROM r1, v1, l1)", *_leading(2, "r2")]
    sql = with_fact(f"""
SELECT 1 AS component, round(l / {len(cols)}, 6) AS explained_ratio FROM l1
UNION ALL SELECT 2, round(l / {len(cols)}, 6) FROM l2""", _CORR, *ctes)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@register("pca_explained_variance", "M3", _pca_sql(NUMERIC))
def q_pca_explained_variance(spark, sf_dir):
    _, ratio = M.pca_projection(fact(spark, sf_dir), 2)
    return rounded(ratio)


@register("pca_projection", "M3 scores", None)
def q_pca_projection(spark, sf_dir):
    scores, _ = M.pca_projection(fact(spark, sf_dir), 2)
    return scores


def _targets_sql() -> str:
    parts = [f"SELECT {i} AS seq, '{c}' AS \"column\", CAST(count(DISTINCT \"{c}\") AS BIGINT) AS n_distinct FROM fact"
             for i, (c, _) in enumerate(FACT_COLUMNS) if c != C.DATE]
    return "SELECT * FROM (\n" + "\nUNION ALL ".join(parts) + "\n) WHERE n_distinct BETWEEN 2 AND 50"


@register("candidate_targets", "M6", with_fact(_targets_sql()))
def q_candidate_targets(spark, sf_dir):
    return M.candidate_targets(fact(spark, sf_dir))


# ---------------------------------------------------------------- M4-M5, M7-M10


CLASSIFIER_FEATURES = [C.PART_TYPE, C.MATERIAL, C.QUALITY_SCORE, C.UNITS_INSPECTED, C.YIELD, C.COST_IMPACT,
                       C.ON_TIME_FLAG]
CLASSIFIER_TARGET = C.DEFECT_SEVERITY


def _trained(spark, sf_dir, again: bool = False) -> CL.ClassifierResult:
    """M7 trains on the table it is given and stores the model; M9, M10 and the stream
    load it, or train where this version of the table has none yet."""
    return CL.trained_classifier(fact(spark, sf_dir), CLASSIFIER_FEATURES, CLASSIFIER_TARGET, again=again)


@register("detect_anomalies", "M4", None)
def q_detect_anomalies(spark, sf_dir):
    return FR.detect_anomalies(fact(spark, sf_dir), keep=[C.SUPPLIER, C.DATE, C.DEFECT_TYPE, C.COST_IMPACT])


@register("anomaly_summary", "M5", None)
def q_anomaly_summary(spark, sf_dir):
    return rounded(FR.anomaly_summary(FR.detect_anomalies(fact(spark, sf_dir), keep=[])))


@register("stratified_split", "M8", with_fact("""
SELECT label, CAST(n - ntest AS BIGINT) AS train_rows, CAST(ntest AS BIGINT) AS test_rows FROM (
  SELECT Defect_Severity AS label, count(*) AS n,
         CASE WHEN count(*) >= 2 THEN greatest(1, round(count(*) * 0.3)) ELSE 0 END AS ntest
  FROM fact WHERE Defect_Severity IS NOT NULL GROUP BY 1)"""))
def q_stratified_split(spark, sf_dir):
    d = fact(spark, sf_dir).filter(F.col(CLASSIFIER_TARGET).isNotNull())
    train, test = CL.stratified_split(d, CLASSIFIER_TARGET, 0.3, 42)
    a = train.groupBy(F.col(CLASSIFIER_TARGET).alias("label")).agg(F.count(F.lit(1)).alias("train_rows"))
    b = test.groupBy(F.col(CLASSIFIER_TARGET).alias("label")).agg(F.count(F.lit(1)).alias("test_rows"))
    return a.join(b, "label", "full").select(
        "label", F.coalesce("train_rows", F.lit(0)).alias("train_rows"), F.coalesce("test_rows", F.lit(0)).alias("test_rows"))


@register("train_defect_classifier", "M7", None)
def q_train_defect_classifier(spark, sf_dir):
    r = _trained(spark, sf_dir, again=True)
    if not r.success:
        return spark.createDataFrame([(r.error,)], "error string")
    return rounded(r.metrics)


@register("feature_importance", "M9", None)
def q_feature_importance(spark, sf_dir):
    return rounded(_trained(spark, sf_dir).importance)


@register("score_defects", "M10", None)
def q_score_defects(spark, sf_dir):
    r = _trained(spark, sf_dir)
    scored = CL.score_defects(r.model, fact(spark, sf_dir))
    return scored.groupBy("prediction").agg(F.count(F.lit(1)).alias("rows"))


@register("stream_score_defects", "M10 on a stream", None)
def q_stream_score_defects(spark, sf_dir):
    """Arriving line items, joined with the stored orders, parts and suppliers, are
    scored by the stored model."""
    r = _trained(spark, sf_dir)
    lines = spark.readStream.schema(read_table(spark, sf_dir, "lineitem").schema).parquet(f"{sf_dir}/[l]ineitem.parquet")
    scored = CL.score_defects(r.model, normalize(quality_raw(spark, sf_dir, lines))).select("prediction")
    done = S.run_to_table(spark, scored, "append", "scored")
    return done.groupBy("prediction").agg(F.count(F.lit(1)).alias("rows"))
