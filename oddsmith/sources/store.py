"""The feature store: jockey, horse and combination tables kept as Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from oddsmith.operators.history import combo_stats, horse_features, jockey_stats
from oddsmith.settings import Course, HistoryWindow
from oddsmith.workspace import identity, is_complete

_TABLES = ("jockey", "horse", "combo")


@dataclass(frozen=True)
class Features:
    """The three feature tables."""

    jockey: DataFrame
    horse: DataFrame
    combo: DataFrame


def build_features(
    history: DataFrame, course: Course = Course(), window: HistoryWindow = HistoryWindow()
) -> Features:
    """Snapshot features of all given history, as lazy plans."""
    return Features(
        jockey_stats(history, window.jockey_since, window.min_rides),
        horse_features(history, course, window),
        combo_stats(history),
    )


def write_features(features: Features, folder: str) -> None:
    for name in _TABLES:
        getattr(features, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def read_features(spark: SparkSession, folder: str) -> Features:
    return Features(*[spark.read.parquet(f"{folder}/{name}") for name in _TABLES])


def load_or_build(
    history: DataFrame,
    folder: str,
    course: Course = Course(),
    window: HistoryWindow = HistoryWindow(),
    force_refresh: bool = False,
) -> Features:
    """The stored tables if all three are complete, else built, written and read back.

    They lie below ``folder`` under a name made of all parameters and of the history's files, so
    that no other history, course or window reads them.
    """
    spark = history.sparkSession
    folder = f"{folder}/{identity(history, course, window)}"
    complete = all(is_complete(spark, f"{folder}/{name}") for name in _TABLES)
    if force_refresh or not complete:
        write_features(build_features(history, course, window), folder)
    return read_features(spark, folder)
