"""Boosted regression trees on the feature matrix, as Spark ML pipelines."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.functions.expressions import (
    implied_share,
    log_share,
    odds_floor,
    share_floor,
)
from oddsmith.operators.matrix import ENTRY_SIDE, column_means, fit_sex_labels, impute
from oddsmith.operators.pricing import price_races
from oddsmith.recipes import Recipe
from oddsmith.workspace import discard, is_complete, shared_dir, stored

_LABEL = "_target"
VECTOR = "_features"
_SCORE = "_score"
_ROWS_PER_TASK = 20_000
_MOST_ROWS_PER_TASK = 500_000


def target_of(recipe: Recipe) -> Column:
    odds = F.col("odds")
    return {"odds": odds, "share": implied_share(odds), "log_share": log_share(odds)}[recipe.target]


def _fill(features: Sequence[str], means: dict[str, float], zero_fill: bool) -> SQLTransformer:
    """Imputation at scoring time as a pipeline stage, so that a saved model carries its means.

    History features get the training mean (or 0). The entry's own columns are not imputed;
    training saw no nulls there, and a missing value counts as 0.
    """

    def value(feature: str) -> float:
        return 0.0 if zero_fill or feature in ENTRY_SIDE else means[feature]

    filled = [f"coalesce(cast({f} AS double), {value(f)!r}D) AS {f}__x" for f in features]
    return SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__")


def fit(train: DataFrame, recipe: Recipe, at_once: int = 1) -> PipelineModel:
    """Fit the recipe's model on rows with features attached and derived.

    The fitted pipeline takes unimputed rows. Only the feature means (one value per feature)
    and the sex labels reach the driver. ``at_once`` says how many fits the caller runs side by
    side; they share the cores.
    """
    spark = train.sparkSession
    plain = [f for f in recipe.features if f != "sex_encoded"]
    needed = [*plain, *(["sex"] if recipe.encodes_sex else []), target_of(recipe).alias(_LABEL)]
    # Every level of every tree is a job over the rows, and each of its tasks carries the plan behind
    # them and sends back all counters of that plan. So the matrix is stored and the plan is a scan.
    # The shared folder also lets the learner cut its own lineage by checkpoints.
    folder = f"{shared_dir(spark)}/training-{uuid.uuid4().hex}"
    kept = stored(train.select(*needed), folder)
    try:
        tasks = _tasks(kept.count(), max(1, spark.sparkContext.defaultParallelism // at_once))
        return _fit(kept.coalesce(tasks), recipe, plain)
    finally:
        discard(spark, folder)


def _tasks(rows: int, cores: int) -> int:
    """Tasks of each of the learner's many jobs: few for few rows, and one a core for many.

    More than one a core only add to what is scheduled and sent to the driver, so they are used
    only where the rows of a task would become too many.
    """
    return max(1, min(rows // _ROWS_PER_TASK, max(cores, -(-rows // _MOST_ROWS_PER_TASK))))


def _fit(train: DataFrame, recipe: Recipe, plain: list[str]) -> PipelineModel:
    means = column_means(train, plain).first().asDict()
    stages = [_fill(plain, means, recipe.zero_fill_scores)]
    inputs = [f"{f}__x" for f in plain]
    if recipe.encodes_sex:
        labels = fit_sex_labels(train)
        unseen = len(labels.labels)
        code = f"SELECT *, if(sex_index = {unseen}, 0.0D, sex_index) AS sex__x FROM __THIS__"
        stages += [labels, SQLTransformer(statement=code)]
        inputs.insert(recipe.features.index("sex_encoded"), "sex__x")
    learner = GBTRegressor(
        featuresCol=VECTOR,
        labelCol=_LABEL,
        predictionCol=_SCORE,
        maxIter=recipe.trees,
        stepSize=recipe.learning_rate,
        maxDepth=recipe.depth,
        maxBins=recipe.bins,
        minInstancesPerNode=recipe.min_rows_per_leaf,
        featureSubsetStrategy="all" if recipe.feature_fraction >= 1 else str(recipe.feature_fraction),
        seed=recipe.seed,
        checkpointInterval=10,
    )
    stages += [VectorAssembler(inputCols=inputs, outputCol=VECTOR), learner]
    means_row = train.sparkSession.createDataFrame([means])
    return Pipeline(stages=stages).fit(impute(train, means_row, plain))


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` plus the model's raw output as ``score``."""
    output = model.transform(rows)
    return output.select(*rows.columns, F.col(_SCORE).alias("score"))


def staged_scores(model: PipelineModel, rows: DataFrame, stages: Sequence[int]) -> DataFrame:
    """``rows`` once for each of ``stages``, with ``trees`` and the ``score`` of that many trees.

    The ensemble is cut into runs of trees between the stages, and a stage's score is the sum over
    its runs, so every tree is applied once whatever the number of stages. A stage beyond the last
    tree fails.
    """
    ensemble = model.stages[-1]
    bounds = [0, *sorted(set(stages))]
    if bounds[-1] > ensemble.getNumTrees or bounds[1] < 1:
        raise ValueError(f"stages must lie from 1 to {ensemble.getNumTrees}")
    prepared = PipelineModel(model.stages[:-1]).transform(rows)
    sums, total = [], F.lit(0.0)
    for n, (first, end) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        prepared = _trees(ensemble, first, end, f"_run_{n}").transform(prepared)
        total = total + F.col(f"_run_{n}")
        sums.append(F.struct(F.lit(end).alias("trees"), total.alias("score")))
    return prepared.select(*rows.columns, F.inline(F.array(*sums)))


def _trees(ensemble: GBTRegressionModel, first: int, end: int, output: str) -> GBTRegressionModel:
    """The trees ``first`` to ``end`` of an ensemble, with their weights, as a model of their own."""
    context = SparkContext._active_spark_context
    jvm, gateway = context._jvm, context._gateway
    regression = jvm.org.apache.spark.ml.regression
    trees, weights = ensemble._java_obj.trees(), ensemble.treeWeights
    chosen = gateway.new_array(regression.DecisionTreeRegressionModel, end - first)
    by = gateway.new_array(jvm.double, end - first)
    for n in range(first, end):
        chosen[n - first], by[n - first] = trees[n], weights[n]
    run = GBTRegressionModel(regression.GBTRegressionModel(output, chosen, by, ensemble.numFeatures))
    return run.setFeaturesCol(VECTOR).setPredictionCol(output)


def raw_share(recipe: Recipe) -> Column:
    """The share the raw output stands for, before calibration."""
    raw = F.col("score")
    if recipe.target == "odds":
        raise ValueError("this recipe predicts odds, not shares")
    share = F.exp(raw) if recipe.target == "log_share" else raw
    return share if recipe.share_floor is None else share_floor(share, recipe.share_floor)


def price(scored: DataFrame, recipe: Recipe) -> DataFrame:
    """Raw output to ``predicted_odds`` by the recipe's calibration, normalisation and floors."""
    if recipe.normalise:
        return price_races(scored, raw_share(recipe), recipe.k, recipe.odds_floor)
    return scored.withColumn("predicted_odds", odds_floor(F.col("score"), recipe.odds_floor))


def importance(model: PipelineModel, recipe: Recipe, spark: SparkSession) -> DataFrame:
    """(feature, importance), the most important first."""
    values = model.stages[-1].featureImportances.toArray()
    pairs = [(f, float(v)) for f, v in zip(recipe.features, values)]
    table = spark.createDataFrame(pairs, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature")


def ensemble_nodes(spark: SparkSession, path: str, recipe: Recipe) -> DataFrame:
    """The trees of the model saved at ``path``, a row a node.

    ``tree, node, feature, threshold, gain, rows, low, high``; of a leaf all but the first two and
    ``rows`` are null. Rows at or below the threshold go to the node ``low``.
    """
    saved = spark.read.parquet(f"{path}/stages/*GBTRegressor*/data")
    node, split = F.col("nodeData"), F.col("nodeData.split")
    inner = F.col("nodeData.leftChild") >= 0
    names = F.array(*[F.lit(f) for f in recipe.features])

    def of_split(value: Column) -> Column:
        return F.when(inner, value)

    return saved.select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        of_split(F.try_element_at(names, split["featureIndex"] + 1)).alias("feature"),
        of_split(split["leftCategoriesOrThreshold"][0]).alias("threshold"),
        of_split(node["gain"]).alias("gain"),
        node["rawCount"].alias("rows"),
        of_split(node["leftChild"]).alias("low"),
        of_split(node["rightChild"]).alias("high"),
    )


def split_importance(nodes: DataFrame, recipe: Recipe) -> DataFrame:
    """``feature, splits, gain``: how often each feature splits, and its gain weighted by rows.

    The most used first; features without a split have zeros.
    """
    features = nodes.sparkSession.createDataFrame([(f,) for f in recipe.features], "feature string")
    used = nodes.where(F.col("feature").isNotNull()).groupBy("feature")
    counted = used.agg(F.count("*").alias("splits"), F.sum(F.col("gain") * F.col("rows")).alias("gain"))
    return features.join(counted, "feature", "left").na.fill(0).orderBy(F.desc("splits"), "feature")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_or_fit(
    spark: SparkSession, path: str, fit_model: Callable[[], PipelineModel], force: bool = False
) -> PipelineModel:
    """The saved model if there is one, else ``fit_model()``, saved."""
    if not force and is_complete(spark, path, "metadata/_SUCCESS"):
        return PipelineModel.load(path)
    model = fit_model()
    save_model(model, path)
    return model
