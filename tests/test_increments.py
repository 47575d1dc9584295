import re

import pytest
from pyspark.sql import functions as F

from checks.queries import open_tables
from checks.race_tables import CUTOFF, WINDOW
from oddsmith.operators.joins import join_by_key
from oddsmith.sources import increments
from oddsmith.sources.increments import KEYS, FeatureStore, features_of, merged, result_files, states_of
from oddsmith.sources.results import history_of
from oddsmith.sources.store import build_features

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def runners(spark):
    return open_tables(spark, SF).runners.cache()


def rows_of(table, keys):
    known = table.where(" and ".join(f"{k} is not null" for k in keys))
    names = sorted(known.columns)
    rounded = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in known.select(names).collect()]
    return names, sorted(rounded, key=str)


def same(features, other):
    for name, keys in KEYS.items():
        assert rows_of(getattr(features, name), keys) == rows_of(getattr(other, name), keys)


def test_merged_states_equal_a_fresh_build(spark, runners):
    history = history_of(runners)
    part = F.pmod(F.xxhash64("race_id"), F.lit(3))
    parts = [states_of(history.where(part == k), window=WINDOW) for k in range(3)]
    fresh = build_features(history, window=WINDOW)
    same(features_of(states_of(history, window=WINDOW), WINDOW), fresh)
    same(features_of(merged(merged(parts[2], parts[0]), parts[1]), WINDOW), fresh)


def test_odd_starts(make_history):
    rows = [
        {"race_id": "12", "horse_number": None, "finish_position": None, "running_time": None},
        {"race_id": "x", "horse_number": 3, "finish_position": 4, "running_time": "0:0"},
        {"race_id": "3", "date_text": "2024/02/01", "distance": None, "odds": None},
        {"race_id": "4", "date_text": "2024/02/01", "distance": 1400, "running_time": "1:25.0"},
        {"race_id": "5", "date_text": "2023/02/01", "popularity": None},
        {"horse_name": None, "jockey_name": "K"},
        {"horse_name": "B", "jockey_name": None, "date_text": "2021/01/01"},
    ]
    history = make_history(*rows)
    parts = [states_of(make_history(*rows[k::2])) for k in range(2)]
    same(features_of(merged(*parts)), build_features(history))
    none = states_of(history.limit(0))
    same(features_of(merged(none, states_of(history))), build_features(history))
    same(features_of(none), build_features(history.limit(0)))


def days(runners, *bounds):
    return [runners.where((F.col("date_text") >= a) & (F.col("date_text") < b)) for a, b in zip(bounds, bounds[1:])]


def test_new_files_are_merged_and_changed_ones_rebuilt(spark, runners, tmp_path):
    results = str(tmp_path / "results")
    store = FeatureStore(spark, str(tmp_path / "store"), window=WINDOW, buckets=4)
    early, middle, late = days(runners, "0", "1996/01/01", CUTOFF, "9")
    assert store.files() is None
    early.write.parquet(f"{results}/a")
    assert store.update(results) == "built"
    assert store.update(results) == "unchanged"
    late.write.parquet(f"{results}/c")
    assert store.update(results) == "merged"
    middle.write.parquet(f"{results}/b")  # late, with older races than those stored
    assert store.update(results) == "merged"
    same(store.features(), build_features(history_of(runners), window=WINDOW))
    assert store.files().count() == result_files(spark, results).count()
    late.where("race_id not like '%7'").write.mode("overwrite").parquet(f"{results}/c")  # corrected
    assert store.update(results) == "built"
    left = early.unionByName(middle).unionByName(late.where("race_id not like '%7'"))
    same(store.features(), build_features(history_of(left), window=WINDOW))
    other = FeatureStore(spark, store.folder, buckets=4)
    assert other.update(results, cutoff="1996/01/01") == "built"
    same(other.features(), build_features(history_of(early)))


def test_a_failed_update_can_be_repeated(spark, runners, tmp_path, monkeypatch):
    results = str(tmp_path / "results")
    store = FeatureStore(spark, str(tmp_path / "store"), window=WINDOW, buckets=4)
    early, late = days(runners, "0", CUTOFF, "9")
    early.write.parquet(f"{results}/a")
    store.update(results)
    late.write.parquet(f"{results}/b")
    whole = increments._bucketed

    def fails(spark, path, *rest):
        if path.endswith("/combo") and "version-00000002" in path:
            raise OSError("lost")
        return whole(spark, path, *rest)

    monkeypatch.setattr(increments, "_bucketed", fails)
    with pytest.raises(OSError, match="lost"):
        store.update(results)
    monkeypatch.undo()
    same(store.features(), build_features(history_of(early), window=WINDOW))
    assert store.update(results) == "merged"
    same(store.features(), build_features(history_of(runners), window=WINDOW))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_stored_side_is_not_shuffled(spark, runners, tmp_path):
    results = str(tmp_path / "results")
    store = FeatureStore(spark, str(tmp_path / "store"), window=WINDOW, buckets=16)
    early, late = days(runners, "0", CUTOFF, "9")
    early.write.parquet(f"{results}/a")
    store.update(results)
    late.write.parquet(f"{results}/b")
    fresh = [r.path for r in result_files(spark, f"{results}/b").collect()]
    old, new = store.states(), store._states_in(fresh, None)
    both = merged(old, new)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, keys in KEYS.items():
            table = getattr(both, name)
            read = {f for f in table.inputFiles() if "/results/" in f}
            assert {f.rsplit("/", 1)[1] for f in read} == {f.rsplit("/", 1)[1] for f in fresh}
            shuffles = plan_of(getattr(new, name)).count("Exchange hashpartitioning")
            plan = plan_of(table)
            assert "SortMergeJoin" in plan
            # what is new is dealt by key into the store's buckets, what is stored stays
            assert plan.count("Exchange hashpartitioning") <= shuffles + 1
            stored = plan[plan.index("FullOuter") :].split("FileScan parquet spark_catalog")[0]
            assert "Exchange" not in stored
            features = getattr(store.features(), name)
            joined = plan_of(join_by_key(runners, features, keys, total=10))
            assert joined.count("Exchange hashpartitioning") == 1
            assert re.search(r"Bucketed: true", joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
