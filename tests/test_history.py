import random
import re

import pytest
from pyspark.sql import functions as F

from oddsmith.functions.expressions import race_day
from oddsmith.operators import asof, history, joins
from oddsmith.operators.joins import restrict_to, thinned_to
from oddsmith.plans import prediction
from oddsmith.settings import Course, HistoryWindow


def by_horse(df):
    return {r.horse_name: r.asDict() for r in df.collect()}


def test_win_rate_leaves_out_unknown_finishes(make_history):
    rows = [{"finish_position": f, "race_id": str(i)} for i, f in enumerate([1, 2, None, 3, 1, 4])]
    stats = history.jockey_stats(make_history(*rows), "2022/01/01").collect()
    assert [(r.jockey_ride_count, r.jockey_win_rate) for r in stats] == [(6, 0.4)]
    assert history.jockey_stats(make_history(*rows), "2022/01/01", 6).isEmpty()
    assert history.jockey_stats(make_history(*rows), "2024/01/02").isEmpty()


def test_nearest_speed(make_history):
    rows = make_history(
        {"horse_name": "A", "race_id": "1", "running_time": ""},
        {"horse_name": "A", "race_id": "2", "running_time": "1:00.0"},
        {"horse_name": "B", "race_id": "1", "distance": 1400, "running_time": "1:20.0"},
        {"horse_name": "B", "race_id": "2", "distance": 1400, "running_time": "1:10.0"},
        {"horse_name": "B", "race_id": "3", "distance": 1600, "running_time": "1:10.0"},
        {"horse_name": "C", "surface": "ダート"},
    )
    found = by_horse(history.nearest_speed(rows))
    assert found["A"]["horse_recent_max_speed"] is None
    assert found["B"]["horse_recent_max_speed"] == 20.0
    assert "C" not in found


def test_latest_starts_break_ties_by_race_and_number(make_history):
    rows = make_history(
        {"race_id": "9", "horse_number": 1, "finish_position": 1, "jockey_name": "J1"},
        {"race_id": "10", "horse_number": 2, "finish_position": 2, "jockey_name": "J2"},
        {"race_id": "10", "horse_number": 1, "finish_position": 3, "jockey_name": "J3"},
        {"race_id": "8", "date_text": "2023/12/31", "finish_position": 9},
    )
    assert history.previous_start(rows).first().prev_jockey_name == "J3"
    assert history.recent_form(rows).first().horse_recent_3_avg_finish_pos == 2.0


def test_class_flag(make_history):
    rows = make_history(
        {"horse_name": "A", "race_class": "G1", "finish_position": 3},
        {"horse_name": "B", "race_class": "G1", "finish_position": None},
        {"horse_name": "C", "race_class": "G3", "finish_position": 1},
    )
    found = by_horse(history.horse_class(rows))
    assert [found[h]["horse_is_g1_performer"] for h in "ABC"] == [1, 0, 0]
    assert [found[h]["horse_max_grade"] for h in "ABC"] == [4, 4, 2]


def random_history(make_history, seed, n=160, hot=False):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        horse = "A" if hot and i % 3 == 0 else pick.choice("ABCDEF")
        rows.append(
            {
                "race_id": str(pick.randrange(1, 60)),
                "date_text": f"20{pick.choice(['22', '23', '24'])}/{pick.randrange(1, 13):02}/0{pick.randrange(1, 4)}",
                "horse_number": i,
                "horse_name": horse,
                "jockey_name": pick.choice("JKL"),
                "venue_code": pick.choice(["05", "06"]),
                "distance": pick.choice([1000, 1200, 1400]),
                "surface": pick.choice(["芝", "芝", "ダート"]),
                "track_condition": pick.choice(["良", "重"]),
                "race_class": pick.choice(["G1", "G2", "GIII", "x"]),
                "odds": pick.randrange(10, 500) / 10,
                "popularity": pick.randrange(1, 10),
                "finish_position": pick.choice([None, 1, 2, 3, 4, 5, 6]),
                "running_time": pick.choice(["1:10.5", "59.9", "", "中止", "1:20.0"]),
                "final_600m_time": pick.choice([None, 34.5, 36.0]),
                "handicap": pick.choice([54.0, 55.5, 57.0]),
            }
        )
    return make_history(*rows)


def test_fused_features_equal_single_ones(make_history):
    rows = random_history(make_history, 1)
    parts = [
        history.horse_alltime(rows), history.horse_class(rows), history.previous_start(rows),
        history.nearest_speed(rows), history.final600_recent(rows), history.venue_aptitude(rows),
        history.distance_aptitude(rows), history.going_aptitude(rows), history.recent_form(rows),
    ]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, "horse_name", "left")
    fused = by_horse(history.horse_features(rows))
    single = by_horse(joined)
    assert fused.keys() == single.keys()
    for horse, row in single.items():
        assert fused[horse] == pytest.approx(row), horse


@pytest.mark.parametrize("hot", [False, True])
def test_point_in_time_equals_snapshot_of_earlier_rows(make_history, hot):
    """Each row's features equal the snapshot features of the rows before its day."""
    rows = random_history(make_history, 2, hot=hot)
    window = HistoryWindow(min_rides=2)
    found = asof.asof_horse_features(rows, rows.select("race_id", "horse_number", "horse_name", "date_text"), window=window)
    found = found.toPandas().sort_values("horse_number")
    dates = sorted(found.date_text.unique())
    for date in dates[:: max(1, len(dates) // 8)]:
        past = rows.where(F.col("date_text") < date)
        day = rows.sparkSession.createDataFrame([(date,)], "d string").select(
            F.date_format(F.date_sub(F.to_date("d", "yyyy/MM/dd"), window.recent_days), "yyyy/MM/dd")
        ).first()[0]
        snapshot = by_horse(history.horse_features(past, Course(), HistoryWindow(recent_since=day)))
        for row in found[found.date_text == date].to_dict("records"):
            known = snapshot.get(row["horse_name"])
            for name in found.columns.drop(["race_id", "horse_number", "horse_name", "date_text"]):
                want = known[name] if known else None
                got = row[name]
                if want is None:
                    assert got is None or got != got, (date, name)
                else:
                    assert got == pytest.approx(want), (date, name)


@pytest.mark.parametrize("length", [1, 7, 30, 365])
def test_nearest_speed_of_a_sliding_span(make_history, length):
    """Two running minima per row equal a look at all days of the span, at every offset."""
    rows = random_history(make_history, 5, n=120, hot=True).where("surface = '芝'")
    asked = rows.select("race_id", "horse_number", "horse_name", "date_text")
    found = asof.asof_horse_features(rows, asked, window=HistoryWindow(recent_days=length))
    starts = rows.select(
        "horse_name",
        race_day(F.col("date_text")).alias("day"),
        F.abs(F.col("distance") - 1200).alias("off"),
        history.start_speed().alias("speed"),
    ).collect()
    for row in found.withColumn("day", race_day(F.col("date_text"))).collect():
        span = [
            (s.off, s.speed is not None, -(s.speed or 0.0))
            for s in starts
            if s.horse_name == row.horse_name and row.day - length <= s.day < row.day
        ]
        nearest = min(span, default=None)
        want = -nearest[2] if nearest and nearest[1] else None
        assert row.horse_recent_max_speed == (pytest.approx(want) if want is not None else None)


def test_no_frame_slides(make_history):
    """Every frame starts at the first row, so that a day costs the same however long the span."""
    rows = random_history(make_history, 6, n=20)
    asked = rows.select("race_id", "horse_number", "horse_name", "date_text")
    plan = asof.asof_horse_features(rows, asked)._jdf.queryExecution().optimizedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\((\w+), ([^,]+),", plan)
    assert frames
    assert all(low == "unboundedpreceding$()" or kind == "RowFrame" for kind, low in frames)


def test_point_in_time_jockey_and_combo(make_history):
    rows = random_history(make_history, 3)
    window = HistoryWindow(min_rides=2, jockey_days=200)
    keys = rows.select("race_id", "horse_number", "horse_name", "jockey_name", "date_text")
    jockeys = asof.asof_jockey_stats(rows, keys, window).toPandas()
    combos = asof.asof_combo_stats(rows, keys).toPandas()
    past = rows.withColumn("day", race_day(F.col("date_text"))).toPandas()
    day_of = dict(zip(past.date_text, past.day))
    for row in jockeys.to_dict("records")[::5]:
        day = day_of[row["date_text"]]
        seen = past[(past.jockey_name == row["jockey_name"]) & (past.day < day) & (past.day >= day - 200)]
        if len(seen) <= 2:
            assert row["jockey_ride_count"] is None or row["jockey_ride_count"] != row["jockey_ride_count"]
            continue
        assert row["jockey_ride_count"] == len(seen)
        assert row["jockey_avg_odds"] == pytest.approx(seen.odds.mean())
        known = seen.finish_position.dropna()
        assert row["jockey_win_rate"] == pytest.approx((known == 1).mean())
    for row in combos.to_dict("records")[::5]:
        day = day_of[row["date_text"]]
        seen = past[(past.horse_name == row["horse_name"]) & (past.jockey_name == row["jockey_name"]) & (past.day < day)]
        want = seen.finish_position.dropna().mean()
        assert row["combo_avg_finish_pos"] == pytest.approx(want, nan_ok=True)


def test_later_races_do_not_leak(make_history):
    before = [
        {"race_id": "1", "date_text": "2024/01/01", "finish_position": 2},
        {"race_id": "2", "date_text": "2024/02/01", "finish_position": 4},
    ]
    later = {"race_id": "3", "date_text": "2024/02/01", "finish_position": 9, "odds": 99.0}
    short, long = make_history(*before), make_history(*before, later)
    asked = short.select("race_id", "horse_number", "horse_name", "jockey_name", "date_text")
    for build in (
        asof.asof_horse_features,
        asof.asof_combo_stats,
        lambda h, r: asof.asof_jockey_stats(h, r, HistoryWindow(min_rides=0)),
    ):
        assert build(short, asked).exceptAll(build(long, asked)).isEmpty()


def test_day_without_history_is_answered(make_history):
    past = make_history({"date_text": "2024/01/01", "finish_position": 5})
    asked = make_history(
        {"race_id": "7", "date_text": "2024/03/01", "odds": None},
        {"race_id": "7", "date_text": "2024/03/01", "horse_name": "new", "odds": None},
    ).select("race_id", "horse_name", "date_text")
    found = by_horse(asof.asof_horse_features(past, asked))
    assert found["A"]["horse_avg_finish_pos"] == 5.0 and found["A"]["prev_jockey_name"] == "J"
    assert found["new"]["horse_avg_finish_pos"] is None and found["new"]["horse_max_grade"] is None


def test_restriction_leaves_features_unchanged(make_history):
    rows = random_history(make_history, 4)
    some = rows.where("horse_name IN ('A', 'B')")
    part = by_horse(history.horse_features(restrict_to(rows, some)))
    whole = by_horse(history.horse_features(rows))
    assert sorted(part) == ["A", "B"]
    for horse, row in part.items():
        assert row == pytest.approx(whole[horse])


def keyless(rows):
    """Some rows without a horse, some without a day, and each seventh twice."""
    n = F.col("horse_number")
    changed = rows.withColumns(
        {
            "horse_name": F.when(n % 13 != 0, F.col("horse_name")),
            "date_text": F.when(n % 17 != 0, F.col("date_text")),
            "horse_number": F.when(n % 11 != 0, n),
        }
    )
    return changed.unionByName(changed.where(n % 7 == 0)).localCheckpoint()


def test_starts_are_moved_once(spark, make_history):
    """Reduced by day first, moved on to their horse and back to their rows, they take six times as much."""
    rows = random_history(make_history, 7, n=20)
    asked = rows.select("race_id", "horse_number", "horse_name", "date_text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = asof.asof_horse_features(rows, asked)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize("most", [1, 20, 60])
def test_horses_with_many_rows_get_the_same_features(monkeypatch, make_history, most):
    rows = keyless(random_history(make_history, 8, hot=True))
    # ties between equal starts may fall either way, so asked rows alone are repeated
    past = rows.dropDuplicates(["race_id", "horse_number", "horse_name", "date_text"]).localCheckpoint()
    asked = rows.select("race_id", "horse_number", "horse_name", "date_text")
    window = HistoryWindow(recent_days=200)
    want = asof.asof_horse_features(past, asked, window=window)
    monkeypatch.setattr(joins, "HOT_ROWS", most)
    found = asof.asof_horse_features(past, asked, window=window)
    assert found.columns == want.columns and found.count() == asked.count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(_row" in plan and "partial" not in plan and "Join LeftOuter" in plan
    doubles = [name for name, kind in want.dtypes if kind == "double"]
    a, b = (t.withColumns({c: F.round(c, 9) for c in doubles}) for t in (found, want))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_rows_without_horse_or_day_have_no_features(make_history):
    rows = keyless(random_history(make_history, 9))
    asked = rows.select("race_id", "horse_number", "horse_name", "date_text")
    found = asof.asof_horse_features(rows, asked)
    lone = found.where("horse_name IS NULL OR date_text IS NULL")
    names = found.columns[4:]
    assert lone.count() == asked.where("horse_name IS NULL OR date_text IS NULL").count() > 0
    assert lone.where(" OR ".join(f"{name} IS NOT NULL" for name in names)).isEmpty()


def test_history_is_thinned_to_keys_too_many_for_a_list(spark, monkeypatch):
    past = spark.range(40_000).selectExpr("if(id % 100 = 0, null, concat('H', id)) AS horse_name", "id")
    wanted = past.where("id < 2000 OR horse_name IS NULL")
    monkeypatch.setattr(joins, "MAX_LISTED_ROWS", 10)
    found = thinned_to(past, wanted, "horse_name", wanted.count())
    assert found.columns == past.columns
    assert found.where("id < 2000 AND horse_name IS NOT NULL").count() == 1980
    assert found.count() < 2100
    monkeypatch.setattr(joins, "MASK_WORDS", 1)
    full = thinned_to(past, wanted, "horse_name", wanted.count())
    assert full.where("id < 2000 AND horse_name IS NOT NULL").count() == 1980


def test_backtest_rows_move_the_history_of_their_horses_once(monkeypatch, make_history):
    past = random_history(make_history, 10)
    rows = past.where("horse_name IN ('A', 'B')").select(*past.columns[:2], "horse_number", "horse_name", "jockey_name", "handicap")
    listed = prediction.asof_matrix(past, rows)
    monkeypatch.setattr(joins, "MAX_LISTED_ROWS", 1)
    many = prediction.asof_matrix(past, rows)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(_row") == 1
    assert plan.count("bit_or") == 3  # horses, jockeys, and horses for the pairs
    doubles = [name for name, kind in many.dtypes if kind == "double"]
    a, b = (t.withColumns({c: F.round(c, 9) for c in doubles}) for t in (listed, many))
    assert a.count() == rows.count() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
