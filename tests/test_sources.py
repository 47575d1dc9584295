import pytest
from pyspark.sql import functions as F

from oddsmith.operators import joins
from oddsmith.schema import WEIGHTS
from oddsmith.settings import Course, HistoryWindow
from oddsmith.sources import entries, results
from oddsmith.sources.store import build_features, load_or_build
from oddsmith.workspace import identity, is_complete, shared_dir, stored


def test_entry_list(spark, tmp_path):
    file = tmp_path / "entries.txt"
    file.write_text(
        "1,アルファ,牡4,57.0,J\n\n   \n2,B,牝5,55\n 3,C,牡x,55.5,K,extra \r\n4,D,セ,54,L\n",
        encoding="utf-8",
    )
    rows = entries.read_entries(spark, str(file)).orderBy("horse_number").collect()
    assert [tuple(r) for r in rows] == [
        (1, "アルファ", "牡", 4, 57.0, "J"),
        (3, "C", "牡", 0, 55.5, "K"),
        (4, "D", "セ", 0, 54.0, "L"),
    ]


def test_entry_list_keeps_other_columns(spark):
    lines = spark.createDataFrame([("7", "1,A,牡4,57.0,J")], "race_id string, value string")
    row = entries.parse_entries(lines).first()
    assert (row.race_id, row.horse_name, row.age) == ("7", "A", 4)


def test_race_list(spark, tmp_path):
    file = tmp_path / "races.txt"
    file.write_text(" 202506020111\n\n\t\n202406020311 \n", encoding="utf-8")
    ids = {r.race_id for r in entries.read_race_list(spark, str(file)).collect()}
    assert ids == {"202506020111", "202406020311"}


def test_weights(spark):
    rows = spark.createDataFrame([("A", 1), ("B", 2)], "horse_name string, horse_number int")
    weights = spark.createDataFrame([("A", 500, 4)], WEIGHTS)
    by_horse = entries.overlay_weights(rows, weights, ["horse_name"])
    found = {r.horse_name: (r.weight, r.weight_change) for r in by_horse.collect()}
    assert found == {"A": (500, 4), "B": (490, 0)}
    bare = entries.overlay_weights(rows, weights, ["horse_name"], default=None)
    assert {r.horse_name: r.weight for r in bare.collect()} == {"A": 500, "B": None}
    level = entries.without_weight_change(by_horse)
    found = {r.horse_name: (r.weight, r.weight_change) for r in level.collect()}
    assert found == {"A": (496, 0), "B": (490, 0)}


def test_duplicate_announcements(spark):
    rows = spark.createDataFrame([("A", 1), ("B", 2)], "horse_name string, horse_number int")
    twice = spark.createDataFrame([("A", 500, 4), ("A", 500, 4)], WEIGHTS)
    assert entries.overlay_weights(rows, twice, ["horse_name"]).count() == 2
    schema = "horse_name string, weight int, weight_change int, told int"
    clash = spark.createDataFrame([("A", 500, 4, 1), ("A", 490, -6, 2)], schema)
    with pytest.raises(Exception, match="announced twice"):
        entries.overlay_weights(rows, clash, ["horse_name"]).collect()
    last = entries.overlay_weights(rows, clash, ["horse_name"], order="told").collect()
    assert sorted((r.horse_name, r.weight) for r in last) == [("A", 490), ("B", 490)]


def test_scans(spark, make_history):
    rows = make_history(
        {"race_id": "1", "horse_name": "A"},
        {"race_id": "1", "horse_name": "B", "odds": None},
        {"race_id": "2", "horse_name": "C", "surface": "ダート"},
        {"race_id": "3", "horse_name": "D", "date_text": "2024/02/01"},
    )
    names = lambda df: sorted(r.horse_name for r in df.collect())
    assert names(results.training_scope(rows)) == ["A", "D"]
    assert names(results.training_scope(rows, Course(surface="ダート"))) == ["C"]
    assert names(results.before(rows, "2024/02/01")) == ["A", "B", "C"]
    ids = spark.createDataFrame([("1",), ("1",), ("9",)], "race_id string")
    entered = results.race_entries(rows, ids)
    assert names(entered) == ["A", "B"]
    assert "odds" not in entered.columns and "actual_odds" in entered.columns
    assert [tuple(r) for r in results.race_dates(rows, ids).collect()] == [("1", "2024/01/01")]
    laid_out = results.by_race(rows)
    assert names(laid_out) == names(rows)


def test_scan_joins_names_and_drops_unknown_and_unpriced(spark, make_history):
    base = make_history({"odds": 3.0}, {"odds": None}, {"odds": 5.0}).drop(
        "horse_name", "jockey_name"
    )
    race = base.withColumns(
        {"horse_id": F.when(F.col("odds") == 5.0, 99).otherwise(1).cast("long"), "jockey_id": F.lit(2).cast("long")}
    )
    horse = spark.createDataFrame([(1, "A")], "id long, name string")
    jockey = spark.createDataFrame([(2, "J")], "id long, name string")
    rows = results.results_scan(race, horse, jockey).collect()
    assert [(r.horse_name, r.jockey_name, r.odds) for r in rows] == [("A", "J", 3.0)]


def test_feature_store(spark, make_history):
    folder = f"{shared_dir(spark)}/store-test-{spark.sparkContext.applicationId}"
    made = make_history(*[{"race_id": str(i), "horse_name": "A"} for i in range(7)])
    made.write.mode("overwrite").parquet(f"{folder}/history")
    history = spark.read.parquet(f"{folder}/history")
    built = load_or_build(history, folder)
    assert built.jockey.first().jockey_ride_count == 7
    name = identity(history, Course(), HistoryWindow())
    assert is_complete(spark, f"{folder}/{name}/combo") and not is_complete(spark, f"{folder}/combo")
    # what is stored is read, unless asked otherwise
    spark.range(1).selectExpr("'J' jockey_name", "99L jockey_ride_count").write.mode("overwrite").parquet(
        f"{folder}/{name}/jockey"
    )
    assert load_or_build(history, folder).jockey.first().jockey_ride_count == 99
    assert load_or_build(history, folder, force_refresh=True).jockey.first().jockey_ride_count == 7
    # other files, another course or another window are another table
    more = history.unionByName(made)
    more.write.mode("overwrite").parquet(f"{folder}/more")
    more = spark.read.parquet(f"{folder}/more")
    assert load_or_build(more, folder).jockey.first().jockey_ride_count == 14
    assert load_or_build(history, folder, window=HistoryWindow(min_rides=9)).jockey.isEmpty()
    direct = build_features(more)
    assert direct.horse.exceptAll(load_or_build(more, folder).horse).isEmpty()


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == shared_dir(spark)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    path = f"{shared_dir(spark)}/stored-{spark.sparkContext.applicationId}"
    assert stored(spark.range(3), path).count() == 3


def test_bad_number_fails(spark):
    lines = spark.createDataFrame([("x,A,牡4,57.0,J",)], "value string")
    with pytest.raises(Exception):
        entries.parse_entries(lines).collect()


def scanned(df):
    """Rows that the scan of a filtered table hands on, after skipping row groups."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    leaves = execution.executedPlan().collectLeaves()
    return sum(leaves.apply(n).metrics().apply("numOutputRows").value() for n in range(leaves.size()))


def test_race_ids_skip_row_groups(spark, tmp_path):
    """Ids dealt over all dates: only the filters in the files can tell where a race lies."""
    races = spark.range(60_000).select(
        F.concat(F.lit("R"), F.sha2((F.col("id") % 20_000).cast("string"), 256)).alias("race_id"),
        F.date_format(F.expr("date_add('2020-01-01', cast(id % 20000 / 20 as int))"), "yyyy/MM/dd").alias("date_text"),
        F.floor(F.col("id") / 20_000).cast("int").alias("horse_number"),
    )
    small = {"parquet.block.size": "16384", "parquet.enable.dictionary": "false"}
    rows = results.write_by_race(races, str(tmp_path / "races"), races=500, **small)
    wanted = [r.race_id for r in races.where("horse_number = 0 AND id % 4000 = 7").collect()]
    assert len(wanted) == 5
    some = rows.where(joins.among(F.col("race_id"), wanted))
    assert sorted(r.race_id for r in some.collect()) == sorted(wanted * 3)
    assert scanned(some) < 60_000 / 10
    listed = spark.createDataFrame([(w,) for w in [*wanted, None, "unknown"]], "race_id string")
    assert joins.keep_listed(rows, listed, "race_id").count() == 15


def test_long_lists_of_races(spark):
    rows = spark.range(400).select(F.col("id").cast("string").alias("race_id"))
    for n in (0, 1, joins.KEYS_A_LIST + 1, joins.SCANNED_KEYS, joins.SCANNED_KEYS + 1):
        assert joins.keep_listed(rows, rows.limit(n), "race_id").count() == n
