"""The feature matrix: history joined to rows, derived columns, imputation, sex codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.functions.expressions import handicap_diff, jockey_changed
from oddsmith.operators.joins import hot_keys, join_by_key

# Columns that come with the entry itself; imputation at scoring time leaves them alone.
ENTRY_SIDE = (
    "horse_number", "handicap", "age", "sex_encoded", "weight", "weight_change",
    "handicap_diff", "jockey_changed",
)


def attach_features(
    rows: DataFrame,
    jockey: DataFrame,
    horse: DataFrame,
    combo: DataFrame | None = None,
    total: int | None = None,
) -> DataFrame:
    """``rows`` left-joined to jockey, horse and (horse, jockey) features.

    No feature table is forced to broadcast, for they grow with the data; a hot jockey or
    horse among ``rows`` is spread over several tasks. ``total`` is their number, if known.
    """
    tables = [(jockey, ["jockey_name"]), (horse, ["horse_name"])]
    if combo is not None:
        tables.append((combo, ["horse_name", "jockey_name"]))
    frequent = hot_keys(rows, *[keys for _, keys in tables], total=total)
    joined = rows
    for (table, keys), hot in zip(tables, frequent, strict=True):
        joined = join_by_key(joined, table, keys, hot=[hot])
    return joined


def derive(rows: DataFrame, zero_handicap_diff: bool = False) -> DataFrame:
    """Change of weight carried and change of jockey against the previous start.

    ``zero_handicap_diff`` sets the former to 0, as some model versions do on training rows.
    """
    diff = handicap_diff(F.col("handicap"), F.col("prev_handicap"))
    return rows.withColumns(
        {
            "handicap_diff": F.lit(0.0) if zero_handicap_diff else diff,
            "jockey_changed": jockey_changed(F.col("jockey_name"), F.col("prev_jockey_name")),
        }
    )


def column_means(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the mean of each column, 0 for a column without values: a single pass."""
    return rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns])


def impute(rows: DataFrame, means: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls of ``columns`` replaced by the means of :func:`column_means`.

    The means enter as one scalar subquery, so nothing is joined and nothing is collected here.
    """
    mean = means.select(F.struct(*means.columns).alias("m")).scalar()
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col("_mean")[c]) for c in columns}
    return rows.withColumn("_mean", mean).withColumns(filled).drop("_mean")


def impute_zero(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls of ``columns`` replaced by 0, the scoring variant of one model version."""
    return rows.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    )


def history_side(features: Sequence[str]) -> list[str]:
    """The features that scoring imputes: all but the entry's own columns."""
    return [f for f in features if f not in ENTRY_SIDE]


def fit_sex_labels(train: DataFrame) -> StringIndexerModel:
    """The labels of the training rows, numbered in code-point order."""
    indexer = StringIndexer(
        inputCol="sex", outputCol="sex_index", stringOrderType="alphabetAsc", handleInvalid="keep"
    )
    return indexer.fit(train)


def sex_code(model: StringIndexerModel) -> Column:
    """The label's number; a label unseen in training counts as the first one."""
    unseen = len(model.labels)
    index = F.col("sex_index")
    return F.when(index == unseen, 0).otherwise(index.cast("int"))


def encode_sex(rows: DataFrame, model: StringIndexerModel) -> DataFrame:
    coded = model.transform(rows).withColumn("sex_encoded", sex_code(model))
    return coded.drop("sex_index")
