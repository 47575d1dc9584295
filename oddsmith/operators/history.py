"""History features as one snapshot over all given results.

Averages are plain grouped aggregates, which combine on the map side, so a horse or jockey
that holds a large part of the rows costs its tasks no more than any other. The latest starts
and the speed at the nearest distance are ``row_number() <= k`` filters: the engine keeps k
rows per horse in each map task before it shuffles, so those are safe for a hot horse too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.functions.expressions import race_grade, speed_mps, time_to_seconds
from oddsmith.settings import Course, HistoryWindow

PREVIOUS = {
    "prev_finish_pos": "finish_position",
    "prev_popularity": "popularity",
    "prev_odds": "odds",
    "prev_jockey_name": "jockey_name",
    "prev_handicap": "handicap",
}


def latest_first() -> list[Column]:
    """A total order from the latest start back: date, then race, then runner."""
    return [
        F.col("date_text").desc(),
        F.col("race_id").try_cast("bigint").desc_nulls_last(),
        F.col("race_id").desc(),
        F.col("horse_number").asc(),
    ]


def start_speed() -> Column:
    return speed_mps(F.col("distance"), time_to_seconds(F.col("running_time")))


def start_grade() -> Column:
    return race_grade(F.col("race_name"), F.col("race_class"))


def graded(history: DataFrame) -> DataFrame:
    """Results with each start's race grade, so that the texts are searched once."""
    return history.withColumn("_grade", start_grade())


def top_performance(grade: Column | None = None, finish: Column | None = None) -> Column:
    """1 for a first, second or third place in a top-grade race, else 0; for graded rows."""
    grade = F.col("_grade") if grade is None else grade
    finish = F.col("finish_position") if finish is None else finish
    placed = (grade == 4) & (finish <= 3)
    return F.when(placed, 1).otherwise(0)


def recent_turf(course: Course, window: HistoryWindow) -> Column:
    return (F.col("date_text") >= window.recent_since) & (F.col("surface") == course.surface)


def at_venue(course: Course) -> Column:
    return F.col("venue_code") == course.venue_code


def at_distance(course: Course) -> Column:
    return (F.col("distance") == course.distance) & (F.col("surface") == course.surface)


def on_firm(course: Course) -> Column:
    return (F.col("surface") == course.surface) & (F.col("track_condition") == course.firm)


def _finish_where(condition: Column, name: str) -> Column:
    return F.avg(F.when(condition, F.col("finish_position"))).alias(name)


def _alltime_means() -> list[Column]:
    return [
        F.avg("finish_position").alias("horse_avg_finish_pos"),
        F.avg("popularity").alias("horse_avg_popularity"),
        F.avg("odds").alias("horse_avg_odds"),
        F.count(F.lit(1)).alias("horse_race_count"),
    ]


def _class_flags() -> list[Column]:
    return [
        F.max("_grade").alias("horse_max_grade"),
        F.max(top_performance()).alias("horse_is_g1_performer"),
    ]


# -- single features, one row per key that has any ---------------------------------------------


def jockey_stats(history: DataFrame, since: str, min_rides: int = 5) -> DataFrame:
    """Mean odds, win rate and rides of each jockey from a date on, for more than ``min_rides``."""
    # a null finish is left out of the win rate, not counted as a loss
    won = (F.col("finish_position") == 1).cast("double")
    stats = history.where(F.col("date_text") >= since).groupBy("jockey_name")
    return stats.agg(
        F.avg("odds").alias("jockey_avg_odds"),
        F.avg(won).alias("jockey_win_rate"),
        F.count(F.lit(1)).alias("jockey_ride_count"),
    ).where(F.col("jockey_ride_count") > min_rides)


def horse_alltime(history: DataFrame) -> DataFrame:
    return history.groupBy("horse_name").agg(*_alltime_means())


def horse_class(history: DataFrame) -> DataFrame:
    return graded(history).groupBy("horse_name").agg(*_class_flags())


def combo_stats(history: DataFrame) -> DataFrame:
    means = F.avg("finish_position").alias("combo_avg_finish_pos")
    return history.groupBy("horse_name", "jockey_name").agg(means)


def final600_recent(
    history: DataFrame, course: Course = Course(), window: HistoryWindow = HistoryWindow()
) -> DataFrame:
    recent = history.where(recent_turf(course, window))
    return recent.groupBy("horse_name").agg(
        F.avg("final_600m_time").alias("horse_recent_avg_final_600m")
    )


def _aptitude(history: DataFrame, condition: Column, name: str) -> DataFrame:
    return history.where(condition).groupBy("horse_name").agg(F.avg("finish_position").alias(name))


def venue_aptitude(history: DataFrame, course: Course = Course()) -> DataFrame:
    return _aptitude(history, at_venue(course), "horse_venue_avg_finish_pos")


def distance_aptitude(history: DataFrame, course: Course = Course()) -> DataFrame:
    return _aptitude(history, at_distance(course), "horse_dist_avg_finish_pos")


def going_aptitude(history: DataFrame, course: Course = Course()) -> DataFrame:
    return _aptitude(history, on_firm(course), "horse_firm_avg_finish_pos")


def latest_starts(history: DataFrame, starts: int) -> DataFrame:
    """The given number of latest starts of each horse."""
    by_horse = Window.partitionBy("horse_name").orderBy(*latest_first())
    return history.withColumn("_start", F.row_number().over(by_horse)).where(
        F.col("_start") <= starts
    )


def previous_start(history: DataFrame) -> DataFrame:
    """Result, popularity, odds, jockey and weight carried at each horse's latest start."""
    columns = [F.col(source).alias(name) for name, source in PREVIOUS.items()]
    return latest_starts(history, 1).select("horse_name", *columns)


def recent_form(history: DataFrame, starts: int = 3) -> DataFrame:
    """Mean finish over each horse's latest starts."""
    latest = latest_starts(history, starts).groupBy("horse_name")
    return latest.agg(F.avg("finish_position").alias("horse_recent_3_avg_finish_pos"))


def nearest_speed(
    history: DataFrame, course: Course = Course(), window: HistoryWindow = HistoryWindow()
) -> DataFrame:
    """Best speed over the recent distance nearest to the course's.

    A start without a time ranks before all timed ones at the same distance, so the feature
    is null then.
    """
    starts = history.where(recent_turf(course, window)).select(
        "horse_name",
        F.abs(F.col("distance") - course.distance).alias("_off"),
        start_speed().alias("horse_recent_max_speed"),
    )
    order = [F.col("_off").asc(), F.col("horse_recent_max_speed").desc_nulls_first()]
    rank = F.row_number().over(Window.partitionBy("horse_name").orderBy(*order))
    nearest = starts.withColumn("_rank", rank).where(F.col("_rank") == 1)
    return nearest.select("horse_name", "horse_recent_max_speed")


# -- all horse features together ----------------------------------------------------------------


def horse_features(
    history: DataFrame, course: Course = Course(), window: HistoryWindow = HistoryWindow()
) -> DataFrame:
    """One row per horse with every feature above.

    Three passes that each shuffle pre-reduced rows on the horse, then two joins that reuse
    that partitioning; the result equals left-joining the single features one by one.
    """
    recent = recent_turf(course, window)
    means = graded(history).groupBy("horse_name").agg(
        *_alltime_means(),
        *_class_flags(),
        F.avg(F.when(recent, F.col("final_600m_time"))).alias("horse_recent_avg_final_600m"),
        _finish_where(at_venue(course), "horse_venue_avg_finish_pos"),
        _finish_where(at_distance(course), "horse_dist_avg_finish_pos"),
        _finish_where(on_firm(course), "horse_firm_avg_finish_pos"),
    )
    is_last = F.col("_start") == 1
    starts = (
        latest_starts(history, 3)
        .groupBy("horse_name")
        .agg(
            F.avg("finish_position").alias("horse_recent_3_avg_finish_pos"),
            *[F.max(F.when(is_last, F.col(s))).alias(name) for name, s in PREVIOUS.items()],
        )
    )
    parts = [means, starts, nearest_speed(history, course, window)]
    return reduce(lambda left, right: left.join(right, "horse_name", "left"), parts)
