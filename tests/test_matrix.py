import pytest
from pyspark.sql import functions as F

from oddsmith.operators import matrix


def test_mean_fill(spark):
    rows = spark.createDataFrame([(1, None), (None, None), (3, None)], "a int, b double")
    filled = matrix.impute(rows, matrix.column_means(rows, ["a", "b"]), ["a", "b"]).collect()
    assert [r.a for r in filled] == [1.0, 2.0, 3.0]
    assert [r.b for r in filled] == [0.0, 0.0, 0.0]


def test_scoring_uses_training_means(spark):
    train = spark.createDataFrame([(1.0, 5), (3.0, 7)], "horse_avg_odds double, weight int")
    score = spark.createDataFrame([(None, None)], "horse_avg_odds double, weight int")
    columns = matrix.history_side(["horse_avg_odds", "weight"])
    row = matrix.impute(score, matrix.column_means(train, columns), columns).first()
    assert row.horse_avg_odds == 2.0 and row.weight is None
    assert matrix.impute_zero(score, columns).first().horse_avg_odds == 0.0


def test_sex_codes(spark):
    train = spark.createDataFrame([("牡",), ("牝",), ("セ",), ("牡",)], "sex string")
    rows = spark.createDataFrame([("セ",), ("牝",), ("牡",), ("騸",)], "sex string")
    coded = matrix.encode_sex(rows, matrix.fit_sex_labels(train))
    assert {r.sex: r.sex_encoded for r in coded.collect()} == {"セ": 0, "牝": 1, "牡": 2, "騸": 0}


def test_attached_and_derived(spark):
    rows = spark.createDataFrame(
        [("A", "J", 57.0), ("B", "K", 55.0), ("C", None, 54.0)],
        "horse_name string, jockey_name string, handicap double",
    )
    jockey = spark.createDataFrame([("J", 9.5)], "jockey_name string, jockey_avg_odds double")
    horse = spark.createDataFrame(
        [("A", "J", 55.0), ("B", "J", 55.0)],
        "horse_name string, prev_jockey_name string, prev_handicap double",
    )
    combo = spark.createDataFrame(
        [("A", "J", 2.0), ("C", None, 9.0)],
        "horse_name string, jockey_name string, combo_avg_finish_pos double",
    )
    found = {
        r.horse_name: (r.jockey_avg_odds, r.handicap_diff, r.jockey_changed, r.combo_avg_finish_pos)
        for r in matrix.derive(matrix.attach_features(rows, jockey, horse, combo)).collect()
    }
    assert found == {
        "A": (9.5, 2.0, 0, 2.0), "B": (None, 0.0, 1, None), "C": (None, 0.0, 1, None),
    }
    zero = matrix.derive(matrix.attach_features(rows, jockey, horse), zero_handicap_diff=True)
    assert zero.agg(F.sum("handicap_diff")).first()[0] == 0.0
    assert pytest.approx(3) == zero.count()
