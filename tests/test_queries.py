"""Every registered query against its SQL, on the given tables and on skewed ones."""

import itertools
import threading
import time
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from checks import race_tables
from checks.compare import database, differences
from checks.oracle import ORACLE
from checks import queries
from checks.queries import QUERIES
from oddsmith.operators import models
from oddsmith.sources import results

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def few_trees():
    """Every query runs whole; only the number of trees is small here."""
    full = queries.RECIPES
    queries.RECIPES = {name: replace(recipe, trees=4) for name, recipe in full.items()}
    yield
    queries.RECIPES = full


def test_registry():
    free = set(QUERIES) - set(ORACLE)
    assert set(ORACLE) <= set(QUERIES)
    free -= {"backtest_model", "final_prediction"}
    assert all(name.startswith("model") for name in free)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    rows = QUERIES[name](spark, SF).toPandas()
    assert differences(rows, database(SF).execute(ORACLE[name]).df()) is None


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """The tables with a third of the lines on one order, one part and one supplier each."""
    folder = tmp_path_factory.mktemp("skewed")
    connection = duckdb.connect()
    for name in ("orders", "part", "supplier"):
        connection.execute(f"COPY (SELECT * FROM '{SF}/{name}.parquet') TO '{folder}/{name}.parquet'")
    connection.execute(
        f"""COPY (SELECT CASE n % 3 WHEN 0 THEN 1153 ELSE l_orderkey END AS l_orderkey,
          CASE n % 3 WHEN 1 THEN 7 ELSE l_partkey END AS l_partkey,
          CASE n % 3 WHEN 2 THEN 3 ELSE l_suppkey END AS l_suppkey,
          * EXCLUDE (l_orderkey, l_partkey, l_suppkey, n)
        FROM (SELECT *, row_number() OVER () AS n FROM '{SF}/lineitem.parquet'))
        TO '{folder}/lineitem.parquet'"""
    )
    return str(folder)


@pytest.mark.parametrize(
    "name",
    ["results_scan", "horse_features", "combo_stats", "price_race", "scratch_renormalise", "k_grid",
     "asof_horse_features", "asof_jockey_stats", "backtest_baseline", "training_matrix"],
)
def test_skewed_against_sql(spark, skewed, name):
    rows = QUERIES[name](spark, skewed).toPandas()
    assert differences(rows, database(skewed).execute(ORACLE[name]).df()) is None


def test_giant_races_are_ranked_alike(spark, skewed):
    lineitem, orders = (spark.read.parquet(f"{skewed}/{n}.parquet") for n in ("lineitem", "orders"))
    whole = race_tables._race(lineitem, orders)
    split = race_tables._race(lineitem, orders, giant=6)
    assert whole.exceptAll(split).isEmpty() and split.exceptAll(whole).isEmpty()


def test_giants_are_found_in_crowded_buckets(spark):
    keys = [1] * 7 + [2] * 6 + [3] * 2 + [None] * 9
    lines = spark.createDataFrame([(k,) for k in keys], "l_orderkey long")
    assert {r[0] for r in race_tables._giants(lines, 6).collect()} == {1, None}
    assert race_tables._giants(lines, 9).isEmpty()


def test_what_follows_from_the_price_is_not_shuffled(spark):
    lineitem = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    plan = race_tables._runners(lineitem)._jdf.queryExecution().executedPlan().toString()
    assert "pool" not in plan[plan.index("Exchange hashpartitioning(l_orderkey") :]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The tables with repeated and null ids of parts and suppliers, and lines without either."""
    folder = tmp_path_factory.mktemp("odd")
    connection = duckdb.connect()
    changed = {
        "orders": "SELECT * FROM t", "lineitem": """SELECT CASE WHEN n % 11 = 0 THEN NULL ELSE l_partkey END
          AS l_partkey, CASE WHEN n % 13 = 0 THEN NULL ELSE l_suppkey END AS l_suppkey,
          * EXCLUDE (l_partkey, l_suppkey, n) FROM (SELECT *, row_number() OVER () AS n FROM t)""",
        "part": """SELECT * FROM t WHERE p_partkey % 5 > 0 UNION ALL SELECT * FROM t WHERE p_partkey % 7 = 0
          UNION ALL SELECT * REPLACE (NULL AS p_partkey) FROM t WHERE p_partkey < 9""",
        "supplier": "SELECT * FROM t WHERE s_suppkey > 3",
    }
    for name, query in changed.items():
        connection.execute(f"CREATE OR REPLACE VIEW t AS SELECT * FROM '{SF}/{name}.parquet'")
        connection.execute(f"COPY ({query}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("giant", [6, race_tables.GIANT_RACE])
@pytest.mark.parametrize("most", ["10MB", "-1"])
def test_names_joined_to_lines_are_those_joined_to_runners(spark, odd, tmp_path, giant, most):
    read = {n: spark.read.parquet(f"{odd}/{n}.parquet") for n in ("lineitem", "orders", "part", "supplier")}
    horse = race_tables._named(read["part"], "p_partkey", "H")
    jockey = race_tables._named(read["supplier"], "s_suppkey", "J")
    want = results.runners(race_tables._race(read["lineitem"], read["orders"]), horse, jockey)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    try:
        found = race_tables.landed_runners(spark, odd, str(tmp_path), giant)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found.columns == want.columns and found.count() == want.count() > 0
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()


def test_runners_are_made_once_and_moved_once(spark, tmp_path, monkeypatch):
    """Ranges found by a sample of the rows need all of them twice, and stored in between."""
    plans, real = [], results.by_race

    def watched(rows, *others):
        plans.append(real(rows, *others)._jdf.queryExecution().executedPlan().toString())
        return real(rows, *others)

    monkeypatch.setattr(results, "by_race", watched)
    found = race_tables.landed_runners(spark, SF, str(tmp_path))
    assert "rangepartitioning" not in plans[0] and plans[0].count("Exchange hashpartitioning") == 1
    assert "Exchange hashpartitioning(l_orderkey" in plans[0] and "Sort [date_text" in plans[0]
    places = found.select("race_id", F.input_file_name().alias("file")).distinct()
    assert places.groupBy("race_id").count().where("count > 1").isEmpty()


def test_files_of_shuffles_do_not_outlive_the_runners(spark, tmp_path):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        names = (file.getName() for file in spark._jvm.scala.jdk.CollectionConverters.SeqHasAsJava(held.getAllFiles()).asJava())
        return {name for name in names if name.startswith("shuffle_") and name.endswith(".data")}

    before = shuffled()
    race_tables.landed_runners(spark, SF, str(tmp_path))
    read = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(read) == "false"
    for _ in range(50):
        left = shuffled() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_model_queries_run(spark, name):
    rows = QUERIES[name](spark, "/root/testdata/sf0.01")
    assert rows.count() > 0


def test_search_fits_every_set_before_every_day(spark, monkeypatch):
    """The whole grid of the documented ranges, and no day scored by a model that missed earlier rows."""
    t = queries.open_tables(spark, "/root/testdata/sf0.01")
    train, entries = queries._backtest_input(t)
    days = {r.date_text for r in entries.select("date_text").distinct().collect()}
    fits, lock = [], threading.Lock()

    def fit(rows, recipe, at_once=1):
        bounds = rows.agg(F.max("date_text"), F.count("*")).first()
        with lock:
            fits.append((recipe.learning_rate, recipe.depth, recipe.feature_fraction, *bounds))

    def score(model, rows):
        return rows.withColumn("score", F.lit(-1.0))

    monkeypatch.setattr(models, "fit", fit)
    monkeypatch.setattr(models, "score", score)
    monkeypatch.setattr(queries.Tables, "once", lambda self, name, build: build())
    monkeypatch.setattr(queries, "_backtest_input", lambda t: (train, entries))
    found = queries.model_param_search(t)
    before = [train.where(F.col("date_text") < day).agg(F.max("date_text"), F.count("*")).first() for day in days]
    grid = itertools.product((0.01, 0.03, 0.05), (4, 5, 6), (0.6, 0.8))
    assert len(days) > 1
    assert sorted(fits) == sorted((*learner, *rows) for learner in grid for rows in before)
    assert found.count() == len(race_tables.SEARCHED) == 18


def test_backtests_cover_every_race_to_predict(spark):
    t = queries.open_tables(spark, "/root/testdata/sf0.01")
    races = {r.race_id for r in t.targets.select("race_id").collect()}
    assert {r.race_id for r in queries.backtest_model(t).collect()} == races
    for point_in_time in (True, False):
        _, entries = queries._backtest_input(t, point_in_time)
        assert {r.race_id for r in entries.select("race_id").collect()} == races
