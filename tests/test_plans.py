"""What the physical plans must look like for large data."""

import re

import pytest
from pyspark.sql import functions as F

from checks.compare import database, differences
from checks.oracle import ORACLE
from checks.queries import QUERIES
from oddsmith.operators import joins, pricing
from oddsmith.operators.joins import join_by_key

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("model", "backtest_model", "final", "checked", "feature_vector"))))
def test_no_products_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "MapInPandas"):
        assert operator not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["jockey_stats"](spark, SF))
    scan = re.search(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", plan, re.S)
    read = {c.split("#")[0] for c in scan.group(1).split(",")}
    assert read == {"date_text", "jockey_name", "odds", "finish_position"}
    assert "GreaterThanOrEqual(date_text,1997/08/01)" in scan.group(2)


@pytest.mark.parametrize("name", ["previous_start", "recent3_form", "nearest_speed"])
def test_latest_starts_are_cut_before_the_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    exchange = plan.index("Exchange hashpartitioning(horse_name")
    assert "WindowGroupLimit" in plan[:exchange] and "WindowGroupLimit" in plan[exchange:]


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def test_horse_features_shuffle_each_pass_once(spark, no_broadcast):
    plan = plan_of(QUERIES["horse_features"](spark, SF))
    assert plan.count("Exchange hashpartitioning") == 3


def test_calibration_grid_copies_no_rows(spark, no_broadcast):
    plan = plan_of(QUERIES["k_grid"](spark, SF))
    assert plan.count("Expand") == 0
    # rows are shuffled for the horse means only; the race sums travel pre-aggregated
    assert plan.count("Exchange hashpartitioning(race_id") == 1


def hot_rows(spark):
    """60,000 rows, a third of them on one race and one horse, and a third without a jockey."""
    n = F.col("id")
    return spark.range(0, 60_000, 1, 16).select(
        F.when(n % 3 == 0, 0).otherwise(n % 4999).cast("string").alias("race_id"),
        n.cast("int").alias("horse_number"),
        F.when(n % 3 == 0, "hot").otherwise((n % 997).cast("string")).alias("horse_name"),
        F.when(n % 3 != 1, (n % 101).cast("string")).alias("jockey_name"),
        (1 + n % 9).cast("double").alias("odds"),
    )


def largest_task(df, columns):
    """Rows in the fullest partition, with the joined columns really computed."""
    needed = df.where(F.coalesce(*[F.col(c).cast("string") for c in columns], F.lit("")) != "x")
    counts = needed.groupBy(F.spark_partition_id()).count()
    return counts.agg(F.max("count")).first()[0]


@pytest.fixture
def many_tasks(spark, no_broadcast):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hot_race_is_spread(spark, many_tasks):
    rows = hot_rows(spark).withColumn("share", 0.8 / F.col("odds"))
    priced = pricing.normalise(rows)
    assert largest_task(priced, ["predicted_odds"]) < 10_000
    totals = priced.groupBy("race_id").agg(F.sum("share").alias("s"), F.count("*").alias("n"))
    assert totals.where(F.abs(F.col("s") - 0.8) > 1e-9).isEmpty()
    assert totals.where("race_id = '0'").first().n > 20_000


@pytest.mark.parametrize("key", ["horse_name", "jockey_name"])
def test_hot_key_is_spread(spark, many_tasks, key):
    rows = hot_rows(spark)
    means = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg("odds").alias("m"))
    joined = join_by_key(rows, means, [key], hot_rows=1_000)
    assert largest_task(joined, ["m"]) < 10_000
    assert largest_task(rows.join(means, key, "left"), ["m"]) >= 20_000
    plain = rows.join(means, key, "left").select(joined.columns)
    assert joined.exceptAll(plain).isEmpty() and plain.exceptAll(joined).isEmpty()


@pytest.mark.parametrize(
    "name", ["price_race", "handicap_diff", "scratch_renormalise", "training_matrix", "backtest_snapshot"]
)
def test_hot_keys_are_spread_with_the_same_rows(spark, monkeypatch, name):
    monkeypatch.setattr(joins, "HOT_ROWS", 7)
    rows = QUERIES[name](spark, SF)
    if name != "backtest_snapshot":  # whose joined rows are stored first
        assert "_part" in plan_of(rows)
    assert differences(rows.toPandas(), database(SF).execute(ORACLE[name]).df()) is None


def test_counts_of_several_keys_take_one_pass(spark):
    rows = hot_rows(spark)
    lists = joins.hot_keys(rows, ["horse_name"], ["jockey_name"], ["horse_name", "jockey_name"], hot_rows=1_000)
    horse, jockey, both = lists
    assert horse.collect() == [("hot", 20)]
    assert jockey.isEmpty()  # a third of the rows have no jockey, which is many
    assert both is None  # no pair has as many rows as that
    assert rows.groupBy("horse_name", "jockey_name").count().where("count > 1000").isEmpty()


def test_many_rows_without_a_key_count_as_hot(spark):
    rows = hot_rows(spark).withColumn("jockey_name", F.lit(None).cast("string"))
    (both,) = joins.hot_keys(rows, ["horse_name", "jockey_name"], hot_rows=1_000)
    assert both.isEmpty()


def test_history_is_not_sorted_before_it_is_reduced(spark, no_broadcast):
    plan = plan_of(QUERIES["asof_horse_features"](spark, SF))
    assert "partial_sum" in plan
    assert not re.search(r"SortAggregate\([^\n]*partial_sum", plan)


def test_long_and_short_lists_keep_the_same_rows(spark, monkeypatch):
    rows = hot_rows(spark)
    listed = rows.where("odds > 5").select("race_id")
    short = joins.keep_listed(rows, listed, "race_id")
    monkeypatch.setattr(joins, "MAX_LISTED_ROWS", 10)
    long = joins.keep_listed(rows, listed, "race_id")
    assert short.exceptAll(long).isEmpty() and long.exceptAll(short).isEmpty()
    assert joins.restrict_to(rows, listed, "race_id") is rows


@pytest.mark.parametrize("name", ["feature_store_roundtrip", "feature_store_in_steps"])
def test_stored_features_are_rounded_before_the_join(spark, no_broadcast, name):
    """A horse has one row there, and one for each of its jockeys behind the join."""
    plan = plan_of(QUERIES[name](spark, SF))
    assert "decimal(24,9)" in plan
    assert "decimal(24,9)" not in plan[: plan.index("Join")]
