"""A feature store that takes in new result files without reading the old ones again.

What is stored are states that can be merged: sums and counts instead of means, maxima, the latest
starts and the best speed at the nearest distance. The features are a projection of them. New files
are turned into states of their own and merged by key; the stored side is bucketed and sorted by key,
so only the new side moves. Merging does not depend on the order of the files, so a file with older
races than those stored may come late. A file that was changed or taken away cannot be merged out
again: then all states are built anew.

A version of the states is complete when the list of the files in it is written, which comes last. An
update that fails before leaves the former version as it was and can be repeated.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsmith.operators.history import (
    PREVIOUS,
    at_distance,
    at_venue,
    graded,
    latest_starts,
    on_firm,
    recent_turf,
    start_speed,
    top_performance,
)
from oddsmith.schema import RACE
from oddsmith.settings import Course, HistoryWindow
from oddsmith.sources.results import HISTORY_COLUMNS, history_of
from oddsmith.sources.store import Features
from oddsmith.workspace import folders_of, is_complete, parameters_id

KEYS = {"jockey": ["jockey_name"], "horse": ["horse_name"], "combo": ["horse_name", "jockey_name"]}
_STARTS = 3
_LAST_NUMBER = 2**31 - 1


@dataclass(frozen=True)
class States:
    """The three tables of mergeable states, one row per key each; rows without a key are left out."""

    jockey: DataFrame
    horse: DataFrame
    combo: DataFrame

    def by_name(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in KEYS}


# -- states -------------------------------------------------------------------------------------


def _sum_and_count(value: Column, name: str) -> list[Column]:
    return [F.sum(value).cast("double").alias(f"{name}_sum"), F.count(value).alias(f"{name}_n")]


def _start() -> Column:
    """A start whose order as a struct, the largest first, is that of ``latest_first``."""
    number = F.coalesce(-F.col("horse_number"), F.lit(_LAST_NUMBER))
    order = [F.col("date_text"), F.col("race_id").try_cast("bigint").alias("race"), "race_id"]
    return F.struct(*order, number.alias("number"), "finish_position", *_previous_columns())


def _previous_columns() -> list[Column]:
    return [F.col(source).alias(name) for name, source in PREVIOUS.items()]


def _jockey_states(history: DataFrame, window: HistoryWindow) -> DataFrame:
    recent = history.where(F.col("date_text") >= window.jockey_since)
    won = (F.col("finish_position") == 1).cast("double")
    return recent.groupBy("jockey_name").agg(
        *_sum_and_count(F.col("odds"), "odds"), *_sum_and_count(won, "won"), F.count("*").alias("rides_n")
    )


def _horse_states(history: DataFrame, course: Course, window: HistoryWindow) -> DataFrame:
    finish = F.col("finish_position")
    recent = recent_turf(course, window)
    sums = graded(history).groupBy("horse_name").agg(
        *_sum_and_count(finish, "finish"),
        *_sum_and_count(F.col("popularity"), "popularity"),
        *_sum_and_count(F.col("odds"), "odds"),
        *_sum_and_count(F.when(recent, F.col("final_600m_time")), "final600"),
        *_sum_and_count(F.when(at_venue(course), finish), "venue"),
        *_sum_and_count(F.when(at_distance(course), finish), "dist"),
        *_sum_and_count(F.when(on_firm(course), finish), "firm"),
        F.count("*").alias("races_n"),
        F.max("_grade").alias("grade_max"),
        F.max(top_performance()).alias("top_max"),
        # the least distance to the course's, there an unknown speed first, then the highest
        F.min(
            F.when(
                recent,
                F.struct(
                    F.abs(F.col("distance") - course.distance).alias("off"),
                    start_speed().isNotNull().alias("known"),
                    (-start_speed()).alias("slower"),
                ),
            )
        ).alias("nearest_min"),
    )
    starts = latest_starts(history, _STARTS).groupBy("horse_name")
    # at most three starts a horse
    latest = starts.agg(F.sort_array(F.collect_list(_start()), asc=False).alias("starts"))
    return sums.join(latest, "horse_name")


def states_of(
    history: DataFrame, course: Course = Course(), window: HistoryWindow = HistoryWindow()
) -> States:
    """The states of the given history."""
    horse = history.where(F.col("horse_name").isNotNull())
    jockey = history.where(F.col("jockey_name").isNotNull())
    both = horse.where(F.col("jockey_name").isNotNull()).groupBy(*KEYS["combo"])
    return States(
        _jockey_states(jockey, window),
        _horse_states(horse, course, window),
        both.agg(*_sum_and_count(F.col("finish_position"), "finish")),
    )


def _merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables of states as one, by a full join that leaves the bucketed side where it is."""
    a, b = old.alias("a"), new.alias("b")
    same = [F.col(f"a.{key}") == F.col(f"b.{key}") for key in keys]

    def united(name: str) -> Column:
        x, y = F.col(f"a.{name}"), F.col(f"b.{name}")
        if name in keys:
            value = F.coalesce(x, y)
        elif name == "starts":
            both = F.concat(F.coalesce(x, F.array()), F.coalesce(y, F.array()))
            value = F.slice(F.sort_array(both, asc=False), 1, _STARTS)
        elif name.endswith("_min"):
            value = F.least(x, y)
        elif name.endswith("_max"):
            value = F.greatest(x, y)
        else:
            value = F.coalesce(x + y, x, y)
        return value.alias(name)

    joined = a.join(b.hint("merge"), same, "full")
    return joined.select(*[united(name) for name in old.columns])


def merged(old: States, new: States) -> States:
    """The states of both histories together."""
    tables, more = old.by_name(), new.by_name()
    return States(**{name: _merged(tables[name], more[name], keys) for name, keys in KEYS.items()})


def features_of(states: States, window: HistoryWindow = HistoryWindow()) -> Features:
    """The features that ``store.build_features`` gives for the same history."""

    def mean(name: str, feature: str) -> Column:
        return F.try_divide(F.col(f"{name}_sum"), F.col(f"{name}_n")).alias(feature)

    jockey = states.jockey.where(F.col("rides_n") > window.min_rides).select(
        "jockey_name",
        mean("odds", "jockey_avg_odds"),
        mean("won", "jockey_win_rate"),
        F.col("rides_n").alias("jockey_ride_count"),
    )
    finishes = F.filter(F.transform("starts", lambda s: s["finish_position"]), lambda p: p.isNotNull())
    total = F.aggregate(finishes, F.lit(0.0), lambda sum_, p: sum_ + p)
    horse = states.horse.select(
        "horse_name",
        mean("finish", "horse_avg_finish_pos"),
        mean("popularity", "horse_avg_popularity"),
        mean("odds", "horse_avg_odds"),
        F.col("races_n").alias("horse_race_count"),
        F.col("grade_max").alias("horse_max_grade"),
        F.col("top_max").alias("horse_is_g1_performer"),
        mean("final600", "horse_recent_avg_final_600m"),
        mean("venue", "horse_venue_avg_finish_pos"),
        mean("dist", "horse_dist_avg_finish_pos"),
        mean("firm", "horse_firm_avg_finish_pos"),
        F.try_divide(total, F.size(finishes)).alias("horse_recent_3_avg_finish_pos"),
        *[F.col("starts")[0][name].alias(name) for name in PREVIOUS],
        (-F.col("nearest_min.slower")).alias("horse_recent_max_speed"),
    )
    combo = states.combo.select(*KEYS["combo"], mean("finish", "combo_avg_finish_pos"))
    return Features(jockey, horse, combo)


# -- the store ----------------------------------------------------------------------------------


def result_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modified`` of every Parquet file below ``path``; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    listed = files.option("pathGlobFilter", "*.parquet").load(path)
    return listed.select("path", "length", F.col("modificationTime").alias("modified"))


def _bucketed(spark: SparkSession, path: str, schema, keys: list[str], buckets: int) -> str:
    """The name of a table over ``path`` that is bucketed and sorted by its keys."""
    name = f"states_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by = ", ".join(keys)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
        f"INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return name


@dataclass(frozen=True)
class FeatureStore:
    """States of all result files taken in so far, below ``folder`` for one course and window.

    ``buckets`` must stay the same for a folder. Each update writes a new version and leaves the older
    ones to their readers.
    """

    spark: SparkSession
    folder: str
    course: Course = Course()
    window: HistoryWindow = HistoryWindow()
    buckets: int = 64

    @property
    def _path(self) -> str:
        return f"{self.folder}/states-{parameters_id(self.course, self.window, self.buckets)}"

    def _versions(self) -> list[str]:
        found = folders_of(self.spark, self._path)
        return [p for p in sorted(found) if is_complete(self.spark, f"{p}/files")]

    def files(self) -> DataFrame | None:
        """The files taken in, or None where nothing is stored yet."""
        versions = self._versions()
        return self.spark.read.parquet(f"{versions[-1]}/files") if versions else None

    def states(self) -> States:
        """The latest complete states."""
        latest = self._versions()[-1]
        names = [T.StructField(name, T.StringType()) for name in ("horse_name", "jockey_name")]
        nothing = self.spark.createDataFrame([], T.StructType([*RACE.fields, *names])).select(*HISTORY_COLUMNS)
        empty, tables = states_of(nothing, self.course, self.window).by_name(), {}
        for name, keys in KEYS.items():
            table = _bucketed(self.spark, f"{latest}/{name}", empty[name].schema, keys, self.buckets)
            tables[name] = self.spark.table(table)
        return States(**tables)

    def features(self) -> Features:
        """The features of all files taken in; their tables keep the buckets of the states."""
        return features_of(self.states(), self.window)

    def _write(self, states: States, files: DataFrame) -> None:
        known = self._versions()
        number = int(known[-1].rsplit("-", 2)[-2]) + 1 if known else 1
        # a version of its own for every attempt, so that a failed one is never added to
        path = f"{self._path}/version-{number:08d}-{uuid.uuid4().hex}"
        for name, table in states.by_name().items():
            keys = KEYS[name]
            target = _bucketed(self.spark, f"{path}/{name}", table.schema, keys, self.buckets)
            table.write.insertInto(target)
        files.write.parquet(f"{path}/files")

    def update(self, results: str, cutoff: str | None = None) -> str:
        """Take in what is new below ``results``, a folder of Parquet files with :func:`runners` rows.

        Returns ``"unchanged"``, ``"merged"`` or ``"built"``. Only races before ``cutoff`` count, which
        must stay the same for a folder. The driver sees the paths of the new files.
        """
        listed = result_files(self.spark, results)
        known = self.files()
        key = ["path", "length", "modified"]
        if known is not None and known.join(listed, key, "left_anti").isEmpty():
            new = [r["path"] for r in listed.join(known, key, "left_anti").collect()]
            if not new:
                return "unchanged"
            self._write(merged(self.states(), self._states_in(new, cutoff)), listed)
            return "merged"
        everything = self._states_in([r["path"] for r in listed.collect()], cutoff).by_name()
        dealt = {name: everything[name].repartition(self.buckets, *keys) for name, keys in KEYS.items()}
        self._write(States(**dealt), listed)
        return "built"

    def _states_in(self, paths: list[str], cutoff: str | None) -> States:
        rows = self.spark.read.parquet(*paths) if paths else None
        if rows is None:
            raise ValueError("no result files")
        history = history_of(rows).select(*HISTORY_COLUMNS)
        if cutoff:
            history = history.where(F.col("date_text") < cutoff)
        return states_of(history, self.course, self.window)
