"""Race results: the joined scan and its restrictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.operators.joins import keep_listed
from oddsmith.schema import NAMED, RACE
from oddsmith.settings import Course

HISTORY_COLUMNS = (
    "race_id", "horse_number", "horse_name", "jockey_name", "finish_position", "popularity", "odds",
    "date_text", "venue_code", "handicap", "distance", "surface", "track_condition",
    "running_time", "final_600m_time", "race_name", "race_class", "weight", "weight_change",
)
ENTRY_COLUMNS = (
    "race_id", "date_text", "horse_number", "horse_name", "jockey_name", "handicap", "sex", "age",
    "odds", "weight", "weight_change",
)


def read_tables(spark: SparkSession, race: str, horse: str, jockey: str) -> tuple[DataFrame, ...]:
    """The three base tables from Parquet paths, with explicit schemas."""
    return (
        spark.read.schema(RACE).parquet(race),
        spark.read.schema(NAMED).parquet(horse),
        spark.read.schema(NAMED).parquet(jockey),
    )


def read_tables_jdbc(
    spark: SparkSession, url: str, race: str, horse: str, jockey: str, **options: str
) -> tuple[DataFrame, ...]:
    """The three base tables from a database.

    Pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` for the race
    table as options to read it in parallel.
    """
    split = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"}
    plain = {key: value for key, value in options.items() if key not in split}
    return (
        spark.read.format("jdbc").options(url=url, dbtable=race, **options).load(),
        spark.read.format("jdbc").options(url=url, dbtable=horse, **plain).load(),
        spark.read.format("jdbc").options(url=url, dbtable=jockey, **plain).load(),
    )


def runners(
    race: DataFrame, horse: DataFrame | None = None, jockey: DataFrame | None = None
) -> DataFrame:
    """Every runner of every race with the names of horse and jockey, scratched ones included.

    Without one of the name tables its name is left out, for jobs that need only the other.

    The joins carry no broadcast hint: the name tables grow with the data, so the engine
    decides by their size, and splits a hot horse or jockey where it sorts and merges two scans.
    """
    named = race
    for table, who in ((horse, "horse"), (jockey, "jockey")):
        if table is not None:
            names = table.select(F.col("id").alias(f"{who}_id"), F.col("name").alias(f"{who}_name"))
            named = named.join(names, f"{who}_id")
    return named.drop("horse_id", "jockey_id")


def by_race(rows: DataFrame, placed: bool = False) -> DataFrame:
    """``rows`` laid out for storage by race day, race and runner.

    Files then cover separate dates, so a date filter skips most of them, and the runners of a
    race lie together, so sums per race are almost done before they are shuffled. The runner
    number in the key splits a giant race over several files.

    ``placed`` says that the tasks already hold whole races. Then nothing is shuffled, nor are the
    rows made a second time to find the ranges: each file covers all dates in their order, and a
    date filter skips most pages of each.
    """
    layout = ["date_text", "race_id", "horse_number"]
    ranged = rows if placed else rows.repartitionByRange(*layout)
    return ranged.sortWithinPartitions(*layout)


def write_by_race(
    rows: DataFrame, path: str, races: int = 100_000, placed: bool = False, **options: str
) -> DataFrame:
    """``rows`` stored at ``path`` as ``by_race`` lays them out, with Bloom filters on the race id.

    Race ids need not follow the dates, so the least and greatest id of a row group say little; the
    filter of a row group, sized for ``races`` different ids, tells whether it may hold one.
    ``options`` are passed on to the Parquet writer.
    """
    writer = by_race(rows, placed).write.mode("overwrite").options(**options)
    writer.option("parquet.bloom.filter.enabled#race_id", "true").option(
        "parquet.bloom.filter.expected.ndv#race_id", str(races)
    ).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def history_of(rows: DataFrame) -> DataFrame:
    """The history all features are built from: priced runners, history columns."""
    return priced(rows).select(*HISTORY_COLUMNS)


def priced(rows: DataFrame) -> DataFrame:
    """Only runners with closing odds."""
    return rows.where(F.col("odds").isNotNull())


def results_scan(race: DataFrame, horse: DataFrame, jockey: DataFrame) -> DataFrame:
    """The history, straight from the base tables.

    Every feature reads it, so store :func:`runners` once (see :func:`by_race`) and take
    :func:`history_of` that table where the name tables are too large to broadcast.
    """
    return history_of(runners(race, horse, jockey))


def training_scope(rows: DataFrame, course: Course = Course()) -> DataFrame:
    """Priced rows run under the conditions of ``course``, with the training columns."""
    return priced(rows).where(on_course(course)).select(*ENTRY_COLUMNS)


def on_course(course: Course):
    return (
        (F.col("venue_code") == course.venue_code)
        & (F.col("distance") == course.distance)
        & (F.col("surface") == course.surface)
    )


def before(rows: DataFrame, cutoff: str) -> DataFrame:
    """Rows strictly before a ``yyyy/MM/dd`` date."""
    return rows.where(F.col("date_text") < cutoff)


def race_entries(rows: DataFrame, race_ids: DataFrame) -> DataFrame:
    """All runners of the listed races, odds as ``actual_odds``; unpriced runners stay."""
    return (
        keep_listed(rows, race_ids, "race_id")
        .select(*ENTRY_COLUMNS)
        .withColumnRenamed("odds", "actual_odds")
    )


def race_dates(rows: DataFrame, race_ids: DataFrame) -> DataFrame:
    """One date per listed race, for all of them in one pass."""
    listed = keep_listed(rows.select("race_id", "date_text"), race_ids, "race_id")
    return listed.groupBy("race_id").agg(F.min("date_text").alias("date_text"))
