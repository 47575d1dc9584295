import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from oddsmith.functions import expressions as X


def values(spark, rows, schema, column):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(column).collect()]


def test_time_to_seconds(spark):
    cases = {
        None: None, "": None, "58.9": 58.9, "1:08.2": 68.2, "1:2:3": None, "中止": None, "0": 0.0,
        "1:": None, ":9": None, " 58.9 ": 58.9, "58.9f": None, "1:08.2d": None, "1e1": 10.0,
    }
    found = values(spark, [(t,) for t in cases], "t string", X.time_to_seconds(F.col("t")))
    for text, got, want in zip(cases, found, cases.values()):
        assert got == pytest.approx(want), text


def test_speed_of_zero_time_is_null(spark):
    speed = X.speed_mps(F.col("d"), F.col("s"))
    assert values(spark, [(1200, 60.0), (1200, 0.0), (1200, None)], "d int, s double", speed) == [
        20.0, None, None,
    ]


@pytest.mark.parametrize(
    "name, race_class, grade, strict",
    [
        ("X", "G1", 4, 4), ("X", "GI", 4, 4), ("X", "GII", 4, 3), ("X", "GIII", 4, 2),
        ("AGIII", "open", 3, 2), ("X", "G2", 3, 3), ("X", "G3", 2, 2), ("X", "オープン", 1, 1),
        ("X (L)", "y", 1, 1), ("X", "リステッド", 1, 1), ("X", "3勝クラス", 0, 0),
        ("XGI cup", "y", 4, 4), (None, "GI", 4, 4), ("X", None, 0, 0),
    ],
)
def test_race_grade(spark, name, race_class, grade, strict):
    for is_strict, want in ((False, grade), (True, strict)):
        column = X.race_grade(F.col("n"), F.col("c"), is_strict)
        assert values(spark, [(name, race_class)], "n string, c string", column) == [want]


def test_sex_and_age(spark):
    tokens = [("牡4",), ("牝12",), ("セ",), ("牡x",), ("牡4.0",)]
    assert values(spark, tokens, "t string", X.sex_of(F.col("t"))) == ["牡", "牝", "セ", "牡", "牡"]
    assert values(spark, tokens, "t string", X.age_of(F.col("t"))) == [4, 12, 0, 0, 0]
    raising = X.age_of(F.col("t"), bad_age="raise")
    assert values(spark, [("牡4",), ("セ",)], "t string", raising) == [4, 0]
    with pytest.raises(PySparkException):
        values(spark, [("牡x",)], "t string", raising)


def test_changes_against_previous_start(spark):
    diff = X.handicap_diff(F.col("a"), F.col("b"))
    assert values(spark, [(57.0, 55.0), (57.0, None)], "a double, b double", diff) == [2.0, 0.0]
    changed = X.jockey_changed(F.col("a"), F.col("b"))
    rows = [("J", "J"), ("J", "K"), ("J", None)]
    assert values(spark, rows, "a string, b string", changed) == [0, 1, 1]


def test_shares_and_floors(spark):
    one = [(4.0,)]
    odds = F.col("o")
    assert values(spark, one, "o double", X.implied_share(odds)) == [0.2]
    assert values(spark, one, "o double", X.log_share(odds)) == [pytest.approx(math.log(0.2))]
    assert values(spark, one, "o double", X.share_floor(odds / 1e6)) == [0.001]
    assert values(spark, [(1.02,)], "o double", X.odds_floor(odds, 1.1)) == [1.1]
    assert values(spark, [(0.5,)], "o double", X.odds_floor(odds, None)) == [0.5]
    assert values(spark, one, "o double", X.power_calibration(odds, 2.0)) == [16.0]
    assert values(spark, one, "o double", X.power_calibration(odds, 1.0)) == [4.0]
