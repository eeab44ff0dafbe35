"""Species classification on segment features and habitat types by clustering."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.operators import forest
from canopyframe.runtime import GROUP_LIMIT, cut_lineage, ensure_checkpoint_dir

#: Rows of a training frame in one task. Each task keeps figures of all open nodes, so small frames aren't divided further.
FIT_ROWS = 50_000
#: Rows times trees of one fit, which bounds the nodes that the driver holds for it.
FIT_NODES = 150_000
#: Fits at the same time: one over few tasks leaves cores idle, each holds its open nodes on the driver.
FITS = 2
#: Rows up to which Spark fits the forests: more rows have so many nodes that a task grows whole trees faster.
SPARK_ROWS = 1_000


def group_split(df: DataFrame, group: str, folds: int = 4) -> DataFrame:
    """Fold number from the group, so that no group is on both sides of a split."""
    digits = F.conv(F.substring(F.md5(F.col(group).cast("string")), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("fold", F.pmod(digits, F.lit(folds)).cast("int"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight n / (classes * class size) per row."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    weights = counts.crossJoin(F.broadcast(total)).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))
    return df.join(weights, label)


def _forest(trees: int, seed: int, figures: str = "auto") -> RandomForestClassifier:
    """Trees as deep as Spark allows; the rows keep their nodes, so rounds send no trees to the tasks."""
    return RandomForestClassifier(labelCol="_y", featuresCol="_x", weightCol="weight", numTrees=trees, seed=seed, maxDepth=30,
                                  cacheNodeIds=True, featureSubsetStrategy=figures, predictionCol="_p", probabilityCol="_prob", rawPredictionCol="_raw")


def train_species(df: DataFrame, features: list[str], label: str, trees: int = 300, seed: int = 7) -> PipelineModel:
    """Class-balanced random forest; its trees are as deep as Spark allows."""
    stages = [StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"),
              VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip"), _forest(trees, seed)]
    indexer = stages[0].fit(df)
    back = IndexToString(inputCol="_p", outputCol="species", labels=indexer.labels)
    return Pipeline(stages=[indexer, *stages[1:], back]).fit(class_weights(df, label))


def score_species(model: PipelineModel, df: DataFrame, key: str) -> DataFrame:
    """Predicted species and its probability; rows without features keep nulls."""
    scorer = PipelineModel(model.stages[1:])
    done = scorer.transform(df).select(key, "species", F.array_max(vector_to_array("_prob")).alias("species_conf"))
    return df.select(key).join(done, key, "left")


def cross_species(df: DataFrame, features: list[str], label: str, key: str, trees: int = 300, seed: int = 7,
                  fit_nodes: int = FIT_NODES) -> DataFrame:
    """Every row scored by a forest of the other folds (column ``fold``); nulls if these have no complete row.

    Tasks grow the trees, each on rows of their figures' bins, where ``SPARK_ROWS`` to ``GROUP_LIMIT`` rows are complete; then
    trees have no largest depth. Other frames are fitted by Spark in parts of a few trees.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    blank = df.select(key, F.lit(None).cast("string").alias("species"), F.lit(None).cast("double").alias("species_conf"))
    complete = df.where(F.col("fold").isNotNull()).dropna(subset=features).count()
    in_tasks = SPARK_ROWS < complete <= GROUP_LIMIT
    cast = _task_votes(df, features, label, key, trees, seed, complete) if in_tasks else _spark_votes(df, features, label, key, trees, seed, fit_nodes)
    if cast is None:
        return blank
    summed, names = cast
    known = spark.createDataFrame(names, "fold int, _names array<string>")
    top = F.array_max("_sum")
    done = summed.join(F.broadcast(known), "fold").select(
        key, "fold", F.element_at("_names", F.array_position("_sum", top).cast("int")).alias("species"), (top / trees).alias("species_conf"))
    return df.select(key, "fold").join(done, [key, "fold"], "left").select(key, "species", "species_conf")


def _task_votes(df: DataFrame, features: list[str], label: str, key: str, trees: int, seed: int, complete: int) -> tuple[DataFrame, list] | None:
    """``key, fold, _sum`` and the classes of each fold from trees grown by tasks."""
    whole = df.where(F.col("fold").isNotNull()).dropna(subset=features).select(key, "fold", label, *[F.col(f).cast("double") for f in features])
    # dealt by key and in order of the rows, so that a rerun draws the same samples
    whole = cut_lineage(whole.repartition(math.ceil(complete / FIT_ROWS), key).sortWithinPartitions(key, *features, label))
    sizes = whole.groupBy("fold", label).count().collect()
    classes = sorted({r[label] for r in sizes if r[label] is not None}, key=str)
    folds = [f for f in sorted({r["fold"] for r in sizes}) if any(r["fold"] != f and r[label] is not None for r in sizes)]
    if not folds:
        return None
    number = F.create_map(*[F.lit(v) for k, name in enumerate(classes) for v in (name, k)])[F.col(label)].cast("int")
    ready = whole.withColumn("_y", number).withColumn("_id", F.monotonically_increasing_id())
    voted = cut_lineage(forest.votes(ready.select("_id", "fold", "_y", *features), features, folds, len(classes), trees, seed))
    rows = ready.select("_id", key, "fold").join(voted, "_id").groupBy(key, "fold")
    sums = F.array(*[F.sum(F.element_at("_votes", c + 1)).cast("double") / forest.UNIT for c in range(len(classes))])
    return rows.agg(sums.alias("_sum")), [(f, [str(c) for c in classes]) for f in folds]


def _spark_votes(df: DataFrame, features: list[str], label: str, key: str, trees: int, seed: int, fit_nodes: int) -> tuple[DataFrame, list] | None:
    """The same from Spark's forest.

    A forest grows in parts of a few trees, several at a time. A part votes on the fold's rows and is
    given up; the votes of all parts add up to those of the whole forest.
    """
    spark = df.sparkSession
    vectors = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip")
    figures = "sqrt" if trees > 1 else "auto"  # a part of one tree is no tree by itself
    jobs, names = [], []
    for fold in [r["fold"] for r in df.select("fold").distinct().orderBy("fold").collect()]:
        train = df.where(F.col("fold") != fold)
        if not train.dropna(subset=[*features, label]).take(1):
            continue
        indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(train)
        ready = vectors.transform(indexer.transform(class_weights(train, label))).select(key, "_x", "_y", "weight")
        rows = ready.count()
        ready = cut_lineage(ready.repartition(math.ceil(rows / FIT_ROWS)).sortWithinPartitions(key))
        held = cut_lineage(vectors.transform(df.where(F.col("fold") == fold)).select(key, "_x"))
        size = max(1, min(trees, fit_nodes // rows))
        jobs += [(ready, held, fold, first, min(size, trees - first)) for first in range(0, trees, size)]
        names.append((fold, indexer.labels))

    def votes(job: tuple) -> DataFrame:
        ready, held, fold, first, count = job
        model = _forest(count, seed + 1000 * first, figures).fit(ready)
        return cut_lineage(model.transform(held).select(
            key, F.lit(fold).alias("fold"), F.lit(first).alias("_first"), vector_to_array("_raw").alias("_votes")))

    if not jobs:
        return None
    with ThreadPoolExecutor(FITS) as pool:
        parts = list(pool.map(inheritable_thread_target(spark)(votes), jobs))
    cast = parts[0]
    for part in parts[1:]:
        cast = cast.unionByName(part)
    # added in the order of the parts, so that reruns agree to the last bit
    listed = cast.groupBy(key, "fold").agg(F.array_sort(F.collect_list(F.struct("_first", "_votes"))).alias("_parts"))
    summed = F.aggregate(F.col("_parts"), F.transform(F.element_at("_parts", 1)["_votes"], lambda v: F.lit(0.0)),
                         lambda s, p: F.zip_with(s, p["_votes"], lambda a, b: a + b))
    return listed.select(key, "fold", summed.alias("_sum")), names


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts per pair of actual and predicted class."""
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, plus the overall accuracy."""
    pairs = confusion_matrix(df, actual, predicted)
    rows = pairs.groupBy(F.col(actual).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0)).alias("tp"))
    cols = pairs.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("_pred"))
    total = pairs.agg((F.sum(F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("_pred")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    return rows.join(cols, "class", "left").crossJoin(F.broadcast(total)).select(
        "class", "support", precision.alias("precision"), recall.alias("recall"),
        F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"), "accuracy")


def habitat_types(metrics: DataFrame, features: list[str], k: int = 4, seed: int = 1, key: str = "seg_id") -> DataFrame:
    """Cluster segments into ``k`` types by standardised figures.

    Segments are named by ``key`` and, where it is there, ``tile_id``. Every segment is kept: the type is null where a figure is missing, and for all with
    fewer than ``k`` complete segments.
    """
    by = [k for k in ("tile_id",) if k in metrics.columns] + [key]
    metrics = cut_lineage(metrics.select(*by, *features))  # one row per segment, read by each stage of the fit and by the scoring
    whole = F.lit(True)
    for name in features:
        whole = whole & F.col(name).isNotNull() & ~F.isnan(name)
    known = metrics.where(whole)
    untyped = F.lit(None).cast("int").alias("habitat_type")
    rows = known.count()
    if rows < k:
        return metrics.select(*by, untyped)
    # the first centres depend on the place of the rows, so rows are dealt out by their key
    known = cut_lineage(known.repartition(math.ceil(rows / FIT_ROWS), *by).sortWithinPartitions(*by))
    stages = [VectorAssembler(inputCols=features, outputCol="_x"),
              StandardScaler(inputCol="_x", outputCol="_z", withMean=True),
              KMeans(k=k, seed=seed, featuresCol="_z", predictionCol="_c")]
    fitted = Pipeline(stages=stages).fit(known)
    typed = fitted.transform(known).select(*by, (F.col("_c") + 1).alias("habitat_type"))
    return typed.unionByName(metrics.where(~whole).select(*by, untyped))
