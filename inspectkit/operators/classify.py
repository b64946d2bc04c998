"""Defect classifier (Spark ML random forest), stratified split,
feature importances per source column, a store of trained models, and scoring.

The split is exact per class and repeatable without a per-class window
(a hot class would put a third of the table in one task): rows are ranked
by (class, row hash) with the range-partition offsets of ``seriesidx``,
and each class's first round(frac * n_class) rows go to the test side.

A trained model is kept in the shared folder under a name made from the
table's version (its files, their sizes and times), the columns and the
parameters: a table is trained on once per version, and importances and
predictions, of batches and streams, come from the stored model.
"""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, IndexToString, OneHotEncoder, OneHotEncoderModel, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectkit.functions import is_numeric_type
from inspectkit.operators import bagged
from inspectkit.operators.seriesidx import with_global_index
from inspectkit.params import DEFAULT_PARAMS, QualityParams
from inspectkit.session import checkpoint_dir, written

LABEL = "__label_text"

# --- Fixed values: error sentences ---
ERROR_NO_FEATURES = "No feature columns selected"
ERROR_TARGET_IS_FEATURE = "Target column cannot also be a feature"
ERROR_MISSING = "Missing columns: "
ERROR_NO_TARGET = "Target column contains only missing values."

MOST_LEVELS = 30  # Spark's forest grows no deeper
MOST_DRAWS = 2**24  # rows x trees up to which Spark ML's forest keeps its draws


@dataclass
class ClassifierResult:
    success: bool
    error: str | None = None
    model: PipelineModel | None = None
    metrics: DataFrame | None = None
    importance: DataFrame | None = None
    classes: list[str] | None = None


def stratified_split(df: DataFrame, label: str, test_frac: float, seed: int = 42,
                     cols: list[str] | None = None, max_broadcast_classes: int = 100000,
                     position: str | None = None) -> tuple[DataFrame, DataFrame]:
    """M8: exact per-class split; the same rows for the same seed whatever
    the partitioning.  Returns ``(train, test)`` with a ``__is_test`` flag dropped;
    ``position``: name of a column for the rank of each row, a number of its own."""
    cols = list(cols) if cols is not None else list(df.columns)
    h = F.xxhash64(*[F.col(f"`{c}`") for c in cols], F.lit(seed)).alias("__sh")
    ranked = with_global_index(df.select("*", h), [label, "__sh"], "__pos")
    per = ranked.groupBy(label).agg(F.min("__pos").alias("__start"), F.count(F.lit(1)).alias("__n"))
    per = per.withColumn("__ntest", F.when(F.col("__n") >= 2, F.greatest(F.lit(1), F.round(F.col("__n") * test_frac)))
                         .otherwise(F.lit(0)).cast("bigint"))
    # one row per class: its row count is checked (a tiny job on the
    # aggregated table) and the table broadcast only under the limit, which
    # also keeps the ranked partitions (the forest's training parallelism)
    per = per.checkpoint(eager=True)
    small = per.count() <= max_broadcast_classes
    j = ranked.join(F.broadcast(per) if small else per, ranked[label].eqNullSafe(per[label]), "inner").drop(per[label])
    j = j.withColumn("__is_test", (F.col("__pos") - F.col("__start")) < F.col("__ntest"))
    if position:
        j = j.withColumn(position, F.col("__pos"))
    drop = [c for c in ("__sh", "__pos", "__start", "__n", "__ntest") if c != position]
    test = j.filter(F.col("__is_test")).drop(*drop, "__is_test")
    train = j.filter(~F.col("__is_test")).drop(*drop, "__is_test")
    return train, test


def _memory_mb(text: str | None, default_mb: int = 1024) -> int:
    """Parse a JVM memory setting such as '16g' or '512m' into MB."""
    if not text:
        return default_mb
    t = text.strip().lower()
    units = {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1024 * 1024}
    try:
        if t[-1] in units:
            return int(float(t[:-1]) * units[t[-1]])
        return int(int(t) / (1024 * 1024))
    except ValueError:
        return default_mb


def forest_memory_mb(spark) -> int:
    """Node-statistics budget per training task: the heap (the driver's in
    local mode, an executor's otherwise) shared by the concurrently running
    tasks, with half of it for these histograms, between 32 MB and 1 GB.
    A larger budget means fewer passes over the data per tree level; too
    large a one exhausts the heap, since every running task holds one."""
    heap, slots = _heap_and_slots(spark)
    return max(32, min(1024, heap // (2 * slots)))


def _heap_and_slots(spark) -> tuple[int, int]:
    """MB of heap of the driver in local mode, an executor otherwise, and its task slots."""
    sc = spark.sparkContext
    conf = sc.getConf()
    local = sc.master.startswith("local")
    heap = _memory_mb(conf.get("spark.driver.memory" if local else "spark.executor.memory", None))
    return heap, max(1, sc.defaultParallelism if local else int(conf.get("spark.executor.cores", "1")))


def node_ids_fit(spark, rows: int, trees: int) -> bool:
    """Whether the forest may keep the node of each row in each tree: the old and new
    ids, 4 bytes each, take an eighth of all heaps at most.  Beyond that they would be
    written to disk at each level; rows then find their nodes by walking the trees, at
    more CPU time and with the same result."""
    heap, slots = _heap_and_slots(spark)
    executors = max(1, spark.sparkContext.defaultParallelism // slots)
    return 8 * rows * trees <= executors * heap * 2**20 // 8


def _impute_strategy(s: str) -> str:
    return {"most_frequent": "mode", "mode": "mode", "median": "median"}.get(s, "mean")


def train_defect_classifier(df: DataFrame, features: list[str], target: str,
                            params: QualityParams = DEFAULT_PARAMS) -> ClassifierResult:
    """M7: random forest predicting ``target`` (as text) from ``features``.

    Refused: no features, target among features, missing columns, a target
    without values.  Numeric features are imputed (mean / median /
    mode); text features become one-hot slots, one per value and one for
    NULL and values not seen in training.  No scaling: tree splits are scale-free.
    Up to MOST_DRAWS the prepared vectors are written once and Spark ML's forest reads
    those; beyond, the forest is grown over binned rows (``bagged``), into the same model.
    """
    if not 0 < params.model_test_size < 1:
        raise ValueError(f"the share of test rows must lie between 0 and 1, not {params.model_test_size}")
    if not 0 < params.classifier_max_depth <= MOST_LEVELS:
        raise ValueError(f"a forest has 1 to {MOST_LEVELS} levels, not {params.classifier_max_depth}")
    if not features:
        return ClassifierResult(False, ERROR_NO_FEATURES)
    if target in features:
        return ClassifierResult(False, ERROR_TARGET_IS_FEATURE)
    missing = [c for c in list(features) + [target] if c not in df.columns]
    if missing:
        return ClassifierResult(False, ERROR_MISSING + ", ".join(missing))
    types = {f.name: f.dataType for f in df.schema.fields}
    d = df.select(*features, target).filter(F.col(target).isNotNull()).withColumn(
        LABEL, F.col(target).cast("string"))
    num = [c for c in features if is_numeric_type(types[c])]
    cat = [c for c in features if c not in num]
    d = d.select(*[F.col(c).cast("double").alias(c) for c in num], *[F.col(c).cast("string").alias(c) for c in cat],
                 LABEL)
    # the check, the ranges of the split and their rows read it: written once
    d = written(d, "labelled-rows")
    if d.limit(1).count() == 0:
        return ClassifierResult(False, ERROR_NO_TARGET)
    train, test = stratified_split(d, LABEL, params.model_test_size, params.random_state, position=bagged.POSITION)
    stages = []
    if num:
        stages.append(Imputer(inputCols=num, outputCols=[f"__imp_{c}" for c in num],
                              strategy=_impute_strategy(params.classifier_impute_strategy)))
    if cat:
        stages.append(StringIndexer(inputCols=cat, outputCols=[f"__idx_{c}" for c in cat], handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[f"__idx_{c}" for c in cat], outputCols=[f"__hot_{c}" for c in cat],
                                    handleInvalid="keep", dropLast=True))
    stages.append(StringIndexer(inputCol=LABEL, outputCol="__y", handleInvalid="keep", stringOrderType="alphabetAsc"))
    slots = [f"__imp_{c}" for c in num] + [f"__hot_{c}" for c in cat]
    stages.append(VectorAssembler(inputCols=slots, outputCol="__features", handleInvalid="keep"))
    prep = Pipeline(stages=stages).fit(train)
    # every tree level is a pass over the training data: dealt out evenly, a
    # partition per task slot or more
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rf = RandomForestClassifier(featuresCol="__features", labelCol="__y", predictionCol="__pred",
                                numTrees=params.classifier_trees, maxDepth=params.classifier_max_depth, seed=params.random_state)
    prepared = prep.transform(train)
    ranges = slot_ranges(prepared.schema, slots)
    rows = train.count()
    if rows * params.classifier_trees <= MOST_DRAWS:
        vectors = written(prepared.select(*slots, "__features", "__y").repartition(tasks), "training-vectors")
        forest = rf.copy({rf.cacheNodeIds: node_ids_fit(spark, rows, params.classifier_trees),
                          rf.maxMemoryInMB: forest_memory_mb(spark)}).fit(vectors.select("__features", "__y"))
    else:
        forest = _grown_forest(rf, prepared, rows, num, cat, ranges, len(prep.stages[-2].labels))
    labels = prep.stages[-2].labels
    model = PipelineModel(stages=prep.stages + [forest,
                                                IndexToString(inputCol="__pred", outputCol="prediction", labels=labels)])
    pred = _predicted(model, test)
    metrics = pred.agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.avg((F.col("prediction") == F.col(LABEL)).cast("double")).alias("accuracy"),
    ).crossJoin(spark.createDataFrame([(rows,)], "train_rows bigint"))
    importance = feature_importance(forest.featureImportances.toArray(), ranges, num + cat, spark)
    return ClassifierResult(True, None, model, metrics, importance, list(labels))


def _grown_forest(rf: RandomForestClassifier, prepared: DataFrame, rows: int, num: list[str], cat: list[str],
                  ranges: list[tuple[int, int]], classes: int):
    """``rf``'s model, grown over the binned rows: kept in as many parts as tasks run at once,
    since each part counts all nodes."""
    spark, seed = prepared.sparkSession, rf.getSeed()
    numbers = [f"__imp_{c}" for c in num]
    bounds = bagged.drawn_bounds(prepared, numbers, rows, seed)
    columns = [bagged.Binned(b) for b in bounds] + [bagged.Binned(values=b - a) for a, b in ranges[len(num):]]
    binned = bagged.binned_rows(prepared, numbers, [f"__idx_{c}" for c in cat], "__y", bounds)
    binned = binned.repartition(spark.sparkContext.defaultParallelism).persist()
    try:
        trees = bagged.grown(binned, columns, classes, rf.getNumTrees(), rf.getMaxDepth(), seed, rf.getBootstrap())
    finally:
        binned.unpersist()
    return bagged.spark_model(spark, rf, trees, columns, classes + 1)


def slot_ranges(schema: T.StructType, columns: list[str]) -> list[tuple[int, int]]:
    """First and last + 1 slot of each column in the vector assembled from
    ``columns``: a number has one, a vector as many as its metadata says."""
    out, at = [], 0
    for c in columns:
        f = schema[c]
        size = 1
        if not is_numeric_type(f.dataType):
            attr = f.metadata["ml_attr"]
            size = attr.get("num_attrs") or sum(len(a) for a in attr["attrs"].values())
        out.append((at, at + size))
        at += size
    return out


def feature_importance(importances, ranges: list[tuple[int, int]], sources: list[str], spark: SparkSession) -> DataFrame:
    """M9: forest importances per source column (D6): its slots' added up by
    their range, no name is parsed.  One entry per slot: read on the driver."""
    assert ranges[-1][1] == len(importances)
    out = [(c, float(importances[a:b].sum())) for c, (a, b) in zip(sources, ranges)]
    return spark.createDataFrame(out, "feature string, importance double").orderBy(
        F.col("importance").desc(), F.col("feature").asc())


def table_version(df: DataFrame) -> str:
    """A name for the contents of the files that df reads: their paths, sizes and times."""
    spark = df.sparkSession
    conf, version = spark._jsc.hadoopConfiguration(), hashlib.sha256()
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        version.update(f"{name} {status.getLen()} {status.getModificationTime()}\n".encode())
    return version.hexdigest()[:24]


def model_path(df: DataFrame, features: list[str], target: str, params: QualityParams = DEFAULT_PARAMS) -> str:
    """Where the model of this version of the table, these columns and parameters is kept."""
    what = repr((table_version(df), list(features), target, sorted(asdict(params).items())))
    return f"{checkpoint_dir(df.sparkSession).rstrip('/')}/models/{hashlib.sha256(what.encode()).hexdigest()[:24]}"


def save_classifier(result: ClassifierResult, path: str) -> None:
    """Keep a trained model with its metrics and importances.  The model comes last:
    a folder with one is complete."""
    result.metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    result.importance.coalesce(1).write.mode("overwrite").parquet(f"{path}/importance")
    result.model.write().overwrite().save(f"{path}/model")


def load_classifier(spark: SparkSession, path: str) -> ClassifierResult | None:
    """The model kept under ``path``; None if there is none."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/model/metadata/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return None
    model = PipelineModel.load(f"{path}/model")
    importance = spark.read.parquet(f"{path}/importance").orderBy(F.col("importance").desc(), F.col("feature").asc())
    return ClassifierResult(True, None, model, spark.read.parquet(f"{path}/metrics"), importance, list(model.stages[-1].getLabels()))


def trained_classifier(df: DataFrame, features: list[str], target: str, params: QualityParams = DEFAULT_PARAMS,
                       again: bool = False) -> ClassifierResult:
    """The stored model of this version of the table, trained and stored first where
    there is none (or ``again``)."""
    path = model_path(df, features, target, params)
    found = None if again else load_classifier(df.sparkSession, path)
    if found is None:
        found = train_defect_classifier(df, features, target, params)
        if not found.success:
            return found
        save_classifier(found, path)
        found = load_classifier(df.sparkSession, path)
    return found


def score_defects(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Apply a trained model to new rows, a batch or a stream (adds
    ``prediction``)."""
    out = _predicted(model, df)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def _predicted(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``model.transform(df)``, with the forest's votes from ``bagged.votes``."""
    *prep, assembler, forest, to_text = model.stages
    out = PipelineModel(stages=prep).transform(df)
    slots = assembler.getInputCols()
    hot = {o: i for s in prep if isinstance(s, OneHotEncoderModel) for i, o in zip(s.getInputCols(), s.getOutputCols())}
    values = [b - a for c, (a, b) in zip(slots, slot_ranges(out.schema, slots)) if c in hot]
    votes = bagged.votes(forest, [c for c in slots if c not in hot], [hot[c] for c in slots if c in hot], values)
    out = out.withColumn("__votes", votes)
    total = F.aggregate("__votes", F.lit(0.0), lambda a, v: a + v)
    out = out.withColumns({
        forest.getRawPredictionCol(): array_to_vector("__votes"),
        forest.getProbabilityCol(): array_to_vector(F.transform("__votes", lambda v: F.when(total != 0, v / total).otherwise(v))),
        forest.getPredictionCol(): (F.array_position("__votes", F.array_max("__votes")) - 1).cast("double"),
    })
    return to_text.transform(out)
