"""Race tables derived from the given order tables, so that real rows drive every query.

An order is a race, a line item a runner, a part a horse, a supplier a jockey, and the line's
price the money bet on the runner. Each derived table is written on first use, once per application,
to the shared folder and read back, as stored race results would be.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsmith.settings import Course, HistoryWindow
from oddsmith.sources.results import on_course, write_by_race
from oddsmith.workspace import (
    discard,
    fingerprint,
    is_complete,
    shared_dir,
    shuffles_dropped,
    stored,
)

# The dates that split the given data as the real ones split theirs.
CUTOFF = "2000/11/01"
WINDOW = HistoryWindow(jockey_since="1997/08/01", recent_since="1999/08/01")

# The grid that the registered search tries: the documented ranges of rate, depth and fraction. Trees
# are grown by level, where so many leaves stand for the depths 4, 5 and 6.
SEARCHED = [
    {"learning_rate": rate, "leaves": leaves, "feature_fraction": fraction}
    for rate in (0.01, 0.03, 0.05)
    for leaves in (15, 31, 63)
    for fraction in (0.6, 0.8)
]

# Odds grow with the field, so fewer of their decimals are stable under another order of summing.
PLACES = {"predicted_odds": 4, "odds_before": 4}


# A race with more runners than this is ranked in parts. At most rows / GIANT_RACE races can be
# that large, so the list of them is small however large the data is.
GIANT_RACE = 1_000_000

_RACE_BUCKETS = 1 << 16

# What `_with_names` adds to the lines: names, and how many runners a line stands for.
_NAMES = ("horse_name", "jockey_name", "horses", "jockeys")

_NUMBER_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _odds() -> Column:
    raw = F.floor(8.0 * F.col("live_pool").cast("double") / F.col("pool").cast("double")) / 10.0
    return F.greatest(raw, F.lit(1.0))


def _live_pool() -> Column:
    return F.sum(F.when(~F.col("scratched"), F.col("pool")))


def _rank_whole(lines: DataFrame) -> DataFrame:
    """Number, odds, popularity and finish, with one shuffle: each race is in one task."""
    race = Window.partitionBy("l_orderkey")
    field = Window.partitionBy("l_orderkey", "scratched")
    # the pool follows from the price, so it is worked out behind the shuffle
    numbered = _with_pool(lines.repartition("l_orderkey")).select(
        "*",
        F.row_number().over(race.orderBy(*_NUMBER_ORDER)).alias("horse_number"),
        _live_pool().over(race).alias("live_pool"),
    ).withColumn("odds", _odds())
    return numbered.select(
        "*",
        F.row_number().over(field.orderBy("odds", "horse_number")).alias("popularity"),
        F.row_number()
        .over(field.orderBy(F.col("l_quantity").desc(), "horse_number"))
        .alias("finish_position"),
    ).drop("live_pool")


def _with_pool(lines: DataFrame) -> DataFrame:
    return lines.withColumn("pool", F.round(F.col("l_extendedprice") * 100).cast("bigint"))


def _band(value: Column) -> Column:
    """A coarse band that never falls as ``value`` rises: at most eight per power of two."""
    return F.floor(F.log2(F.greatest(value.cast("double"), F.lit(0.0)) + 1) * 8)


def _rank_in_parts(
    rows: DataFrame,
    base: DataFrame,
    group: list[str],
    coarse: list[Column],
    order: list[Column],
    name: str,
) -> DataFrame:
    """``row_number`` within ``group`` that no task computes for a whole group.

    Rows are ranked within (group, coarse), where ``coarse`` is a coarser form of the order's
    beginning, and moved up by the counts of the parts before. The counts come from ``base``,
    which holds the same rows, and a window over them sees one row per part.
    """
    parts = [f"_part_{i}" for i in range(len(coarse))]
    keyed = dict(zip(parts, coarse))
    counts = base.withColumns(keyed).groupBy(*group, *parts).agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*group)
        .orderBy(*parts)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    offsets = counts.select(
        *group, *parts, (F.sum("_n").over(earlier) - F.col("_n")).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy(*group, *parts).orderBy(*order))
    split = rows.withColumns(keyed).withColumn("_inside", inside)
    place = (F.col("_before") + F.col("_inside")).cast("int")
    joined = split.join(offsets, [*group, *parts]).withColumn(name, place)
    return joined.drop("_inside", "_before", *parts)


def _rank_giants(lines: DataFrame) -> DataFrame:
    """The columns of :func:`_rank_whole` for the few races too large for one task."""
    lines = _with_pool(lines)
    # one row per giant race, so at most rows / GIANT_RACE
    pools = lines.groupBy("l_orderkey").agg(_live_pool().alias("live_pool"))
    base = lines.join(F.broadcast(pools), "l_orderkey").withColumn("odds", _odds())
    base = base.drop("live_pool")
    number_order = [F.col(c) for c in _NUMBER_ORDER]
    number_parts = [F.col("l_linenumber"), _band(F.col("l_partkey"))]
    field = ["l_orderkey", "scratched"]
    odds_order = [F.col("odds"), F.col("horse_number")]
    numbered = _rank_in_parts(
        base, base, ["l_orderkey"], number_parts, number_order, "horse_number"
    )
    popular = _rank_in_parts(
        numbered, base, field, [_band(F.col("odds"))], odds_order, "popularity"
    )
    return _rank_in_parts(
        popular, base, field, [-F.col("l_quantity")], [F.col("horse_number")], "finish_position"
    )


def _giants(lineitem: DataFrame, giant: int) -> DataFrame:
    """The keys of the races with more than ``giant`` runners.

    Runners are counted by buckets of races first, and only the races of crowded buckets one by
    one: a race is no larger than its bucket.
    """
    bucket = F.pmod(F.xxhash64("l_orderkey"), F.lit(_RACE_BUCKETS)).alias("_bucket")
    keyed = lineitem.select("l_orderkey", bucket)
    crowded = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > giant)
    # at most _RACE_BUCKETS rows
    within = keyed.join(F.broadcast(crowded.select("_bucket")), "_bucket", "left_semi")
    sizes = within.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_n"))
    return sizes.where(F.col("_n") > giant).select("l_orderkey")


def _runners(
    lineitem: DataFrame, giant: int = GIANT_RACE, giants: DataFrame | None = None
) -> DataFrame:
    """Numbers, odds, popularity and finish of the runners of every race.

    ``giants`` holds the keys of the races that are ranked in parts, where a caller knows them.
    """
    lines = lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax",
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("scratched"),
        *[c for c in _NAMES if c in lineitem.columns],
    )
    if giants is None:
        giants = _giants(lineitem, giant)
    if giants.isEmpty():
        return _rank_whole(lines)
    normal = lines.join(F.broadcast(giants), "l_orderkey", "left_anti")
    large = lines.join(F.broadcast(giants), "l_orderkey", "left_semi")
    return _rank_whole(normal).unionByName(_rank_giants(large))


def _race(
    lineitem: DataFrame,
    orders: DataFrame,
    giant: int = GIANT_RACE,
    giants: DataFrame | None = None,
) -> DataFrame:
    """A row a runner; the names that ``_with_names`` gave the lines stand behind the other columns."""
    key = F.col("o_orderkey")
    even = key % 2 == 0
    rank = F.substring("o_orderpriority", 1, 1)
    marks = {"1": ("G1", "GI"), "2": ("G2", "GII"), "3": ("G3", "GIII"), "4": ("オープン",) * 2}
    race_class = reduce(
        lambda chain, item: chain.when(
            rank == item[0], F.when(even, item[1][0]).otherwise(item[1][1])
        ),
        marks.items(),
        F,
    ).otherwise("3勝クラス")
    status = F.col("o_orderstatus")
    races = orders.select(
        key.alias("l_orderkey"),
        key.cast("string").alias("race_id"),
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("date_text"),
        F.lpad((F.col("o_custkey") % 10 + 1).cast("string"), 2, "0").alias("venue_code"),
        (1000 + 200 * (key % 8)).cast("int").alias("distance"),
        F.when(key % 3 == 0, "ダート").otherwise("芝").alias("surface"),
        F.when(status == "O", "良").when(status == "F", "稍重").otherwise("重").alias(
            "track_condition"
        ),
        F.concat(F.lit("R"), key.cast("string")).alias("race_name"),
        race_class.alias("race_class"),
    )
    part = F.col("l_partkey")
    both = F.col("l_orderkey") + part
    ran = ~F.col("scratched")
    tenths = (F.floor(F.col("distance") * 57 / 100) + 50 - F.col("l_quantity")).cast("int")
    digit = (tenths % 10).cast("string")
    short = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), digit)
    seconds = F.lpad(F.floor((tenths % 600) / 10).cast("string"), 2, "0")
    long = F.concat(
        F.floor(tenths / 600).cast("string"), F.lit(":"), seconds, F.lit("."), digit
    )
    time = (
        F.when(F.col("l_orderkey") % 97 == 0, "")
        .when(F.col("l_orderkey") % 89 == 0, "中止")
        .when(tenths < 600, short)
        .otherwise(long)
    )
    return (
        _runners(lineitem, giant, giants)
        .join(races, "l_orderkey")
        .select(
            "race_id", "date_text", "venue_code", "distance", "surface", "track_condition",
            "race_name", "race_class",
            part.alias("horse_id"),
            F.col("l_suppkey").alias("jockey_id"),
            "horse_number",
            ((100 + F.round(F.col("l_discount") * 100)) / 2).alias("handicap"),
            F.when(part % 3 == 0, "牡").when(part % 3 == 1, "牝").otherwise("セ").alias("sex"),
            (2 + part % 6).cast("int").alias("age"),
            F.when(ran, F.col("odds")).alias("odds"),
            F.when(ran, F.col("popularity")).alias("popularity"),
            F.when(ran, F.col("finish_position")).alias("finish_position"),
            F.when(ran, time).alias("running_time"),
            F.when(ran, (330 + 5 * F.round(F.col("l_tax") * 100)) / 10).alias("final_600m_time"),
            F.when(both % 7 != 0, 440 + part % 80).cast("int").alias("weight"),
            (both % 21 - 10).cast("int").alias("weight_change"),
            *[c for c in _NAMES if c in lineitem.columns],
        )
    )


def _with_names(lineitem: DataFrame, horse: DataFrame, jockey: DataFrame) -> DataFrame:
    """The lines with the names of horse and jockey, none lost and none repeated.

    A line is far narrower than the runner it becomes, so names too many to broadcast move less
    here. The ranks count lines without a name too, so these stay until :func:`_named_runners`.
    Where ids repeat, the column ``horses`` or ``jockeys`` says how many runners the line stands for.
    """
    for table, key, who in ((horse, "l_partkey", "horse"), (jockey, "l_suppkey", "jockey")):
        names = table.select(F.col("id").alias(key), F.col("name").alias(f"{who}_name"))
        # an id has one name, see `_named`
        counted = names.groupBy(*names.columns).agg(F.count(F.lit(1)).alias(f"{who}s"))
        if not counted.where(F.col(key).isNotNull() & (F.col(f"{who}s") > 1)).isEmpty():
            names = counted
        lineitem = lineitem.join(names, key, "left")
    return lineitem


def _named_runners(race: DataFrame) -> DataFrame:
    """What the operator ``runners`` makes of the rows, whose lines already have their names."""
    named = race.where(F.col("horse_name").isNotNull() & F.col("jockey_name").isNotNull())
    for times in ("horses", "jockeys"):
        if times in race.columns:
            named = named.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
    return named.drop("horse_id", "jockey_id", "horses", "jockeys")


def folder_of(spark: SparkSession, sf_dir: str) -> str:
    """The folder for the tables derived from ``sf_dir``."""
    sources = [f"{sf_dir}/{name}.parquet" for name in ("lineitem", "orders", "part", "supplier")]
    state = "\n".join([spark.sparkContext.applicationId, *(fingerprint(spark, s) for s in sources)])
    return f"{shared_dir(spark)}/races-{hashlib.sha256(state.encode()).hexdigest()[:16]}"


def landed_names(spark: SparkSession, sf_dir: str, folder: str) -> tuple[str, str]:
    """Where the names of horses and jockeys lie, derived on first use."""
    paths = f"{folder}/horse", f"{folder}/jockey"
    derived = ("part", "p_partkey", "H"), ("supplier", "s_suppkey", "J")
    for path, (source, key, mark) in zip(paths, derived, strict=True):
        if not is_complete(spark, path):
            stored(_named(spark.read.parquet(f"{sf_dir}/{source}.parquet"), key, mark), path)
    return paths


def landed_race(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """Where the rows without names lie, derived on first use."""
    path = f"{folder}/race"
    if not is_complete(spark, path):
        lineitem, orders = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders"))
        stored(_race(lineitem, orders), path)
    return path


def landed_runners(
    spark: SparkSession, sf_dir: str, folder: str, giant: int = GIANT_RACE
) -> DataFrame:
    """The runners with their names, derived on first use.

    Ranking brings the runners of a race into one task, which also writes them, in the order of
    their days. Ranges found by a sample need all rows twice, and stored in between; that is left to
    tables with giant races, whose parts are to lie in several files.
    """
    path = f"{folder}/runners"
    if not is_complete(spark, path):
        lineitem, orders = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders"))
        with shuffles_dropped(spark):
            horse, jockey = (spark.read.parquet(p) for p in landed_names(spark, sf_dir, folder))
            giants = stored(_giants(lineitem, giant), f"{folder}/giants")
            rows = _named_runners(_race(_with_names(lineitem, horse, jockey), orders, giants=giants))
            whole = giants.isEmpty()
            if whole:
                write_by_race(rows, path, placed=True)
            else:
                write_by_race(stored(rows, f"{folder}/unsorted"), path)
                discard(spark, f"{folder}/unsorted")
    return spark.read.parquet(path)


def _named(table: DataFrame, key: str, mark: str) -> DataFrame:
    label = F.concat(F.lit(mark), F.col(key).cast("string"))
    return table.select(F.col(key).cast("bigint").alias("id"), label.alias("name"))


def course_races(rows: DataFrame, min_priced: int = 4) -> DataFrame:
    """Races under the course's conditions with enough priced runners: race_id, date_text."""
    races = rows.where(on_course(Course())).groupBy("race_id", "date_text")
    return races.agg(F.count("odds").alias("n")).where(F.col("n") >= min_priced).drop("n")


def evaluation_races(rows: DataFrame) -> DataFrame:
    """The races to predict: those of the course on or after the cutoff."""
    return course_races(rows).where(F.col("date_text") >= CUTOFF)
