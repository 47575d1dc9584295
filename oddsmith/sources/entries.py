"""Text inputs of a race day: entry lists, race lists, announced weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.functions.expressions import age_of, sex_of
from oddsmith.settings import DEFAULT_WEIGHT, DEFAULT_WEIGHT_CHANGE


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parse_entries(lines: DataFrame, line: str = "value", bad_age: str = "zero") -> DataFrame:
    """Entry lines ``number,horse,sex+age,handicap,jockey`` as typed columns.

    Blank lines and lines with fewer than five fields are skipped. Other columns of ``lines``
    (a race id, say) are kept.
    """
    keep = [c for c in lines.columns if c != line]
    parts = F.split(_stripped(F.col(line)), ",")
    kept = lines.select(*keep, parts.alias("_parts")).where(F.size("_parts") >= 5)
    field = [F.get("_parts", i) for i in range(5)]
    return kept.select(
        *keep,
        field[0].cast("int").alias("horse_number"),
        field[1].alias("horse_name"),
        sex_of(field[2]).alias("sex"),
        age_of(field[2], bad_age).alias("age"),
        field[3].cast("double").alias("handicap"),
        field[4].alias("jockey_name"),
    )


def read_entries(spark: SparkSession, path: str, bad_age: str = "zero") -> DataFrame:
    return parse_entries(spark.read.text(path), bad_age=bad_age)


def parse_race_list(lines: DataFrame, line: str = "value") -> DataFrame:
    """One race id per non-blank line."""
    return lines.select(_stripped(F.col(line)).alias("race_id")).where(F.length("race_id") > 0)


def read_race_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_race_list(spark.read.text(path))


def overlay_weights(
    entries: DataFrame,
    weights: DataFrame,
    on: list[str],
    default: tuple[int, int] | None = (DEFAULT_WEIGHT, DEFAULT_WEIGHT_CHANGE),
    order: str | None = None,
) -> DataFrame:
    """Entries with the announced body weight and its change.

    ``on`` names the key (horse, or race and number). Horses without an announcement get
    ``default``, or null if that is None. Each key counts once: of several announcements the last
    by the column ``order`` holds; without such a column they must agree, or the query fails.
    """
    pair = F.struct("weight", "weight_change")
    if order is None:
        one, other = F.min(pair), F.max(pair)
        clash = F.raise_error(F.lit(f"weights announced twice for one {', '.join(on)}"))
        chosen = F.when(one.eqNullSafe(other), other).otherwise(clash)
    else:
        chosen = F.max(F.struct(order, pair.alias("pair")))["pair"]
    announced = weights.groupBy(*on).agg(chosen.alias("_announced")).select(*on, "_announced.*")
    joined = entries.drop("weight", "weight_change").join(announced, on, "left")
    if default is None:
        return joined
    return joined.withColumns(
        {
            "weight": F.coalesce("weight", F.lit(default[0])),
            "weight_change": F.coalesce("weight_change", F.lit(default[1])),
        }
    )


def without_weight_change(entries: DataFrame) -> DataFrame:
    """The scenario in which no horse gained or lost weight since its previous start."""
    return entries.withColumns(
        {"weight": F.col("weight") - F.col("weight_change"), "weight_change": F.lit(0)}
    )
