import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsmith.operators import evaluation, pricing
from oddsmith.schema import ACTUAL_ODDS

FIELD = "race_id string, horse_number int, share double"


def test_normalise_and_scratch(spark):
    rows = spark.createDataFrame([("1", n, 0.4) for n in (1, 2, 3)], FIELD)
    priced = pricing.normalise(rows).collect()
    assert [r.share for r in priced] == pytest.approx([0.8 / 3] * 3)
    assert [r.predicted_odds for r in priced] == pytest.approx([3.0] * 3)
    left = pricing.renormalise_without(rows, F.col("horse_number") == 2).collect()
    assert [r.predicted_odds for r in left] == pytest.approx([2.0] * 2)


def random_races(spark, seed=0, giant=0):
    pick = random.Random(seed)
    rows = [
        (str(race), number, pick.uniform(0.001, 0.5), pick.uniform(1, 300), pick.randrange(1, 12))
        for race in range(20)
        for number in range(1, pick.randrange(3, 18))
    ]
    rows += [("giant", n, pick.uniform(0.001, 0.5), pick.uniform(1, 300), n) for n in range(1, giant + 1)]
    return spark.createDataFrame(rows, FIELD + ", actual_odds double, finish_position int")


@pytest.mark.parametrize("k", [1.0, 1.2, 1.5])
def test_invariants(spark, k):
    rows = random_races(spark, giant=900)
    priced = pricing.price_races(rows, F.col("share"), k, floor=1.0)
    sums = priced.groupBy("race_id").agg(F.sum("share").alias("s"), F.min("predicted_odds").alias("o"))
    for row in sums.collect():
        assert row.s == pytest.approx(0.8, abs=1e-9)
        assert row.o >= 1.0
    assert priced.count() == rows.count()
    free = pricing.price_races(rows, F.col("share"), k, floor=None)
    before = {(r.race_id, r.horse_number): r.share for r in rows.collect()}
    after = {(r.race_id, r.horse_number): r.predicted_odds for r in free.collect()}
    for race in {key[0] for key in before}:
        runners = sorted((key for key in before if key[0] == race), key=before.get)
        odds = [after[key] for key in runners]
        assert odds == sorted(odds, reverse=True)


def test_fewer_runners_shorten_the_odds(spark):
    rows = random_races(spark)
    whole = {(r.race_id, r.horse_number): r.predicted_odds for r in pricing.normalise(rows).collect()}
    left = pricing.renormalise_without(rows, F.col("horse_number") == 1).collect()
    assert all(r.predicted_odds < whole[r.race_id, r.horse_number] for r in left)


def test_k_on_shares(spark):
    rows = spark.createDataFrame([("1", 1, 0.4), ("1", 2, 0.2)], FIELD)
    priced = pricing.price_races(rows, F.col("share"), 2.0, None).orderBy("horse_number").collect()
    assert [r.share for r in priced] == pytest.approx([0.64, 0.16])


def test_giant_race_is_joined_in_blocks(spark):
    """A race far larger than a block is spread over many keys, a normal one keeps one."""
    rows = random_races(spark, giant=5000)
    blocks = rows.withColumn("b", pricing._block(F.col("horse_number")))
    spread = {r.race_id: r.n for r in blocks.groupBy("race_id").agg(F.countDistinct("b").alias("n")).collect()}
    assert spread.pop("giant") > 70 and set(spread.values()) == {1}
    odd = spark.createDataFrame([("1", None, 0.4), ("1", -3, 0.4), ("1", 2_000_000_000, 0.4)], FIELD)
    assert [r.predicted_odds for r in pricing.normalise(odd).collect()] == pytest.approx([3.0] * 3)


def test_log_rmse(spark):
    rows = [("1", 2.0, 2.0), ("1", 5.0, 5.0), ("2", 3.0, 3.0 * math.e), ("2", 4.0, 4.0 * math.e)]
    df = spark.createDataFrame(rows, "race_id string, actual_odds double, predicted_odds double")
    found = {r.race_id: r.log_rmse for r in evaluation.log_rmse(df).collect()}
    assert found["1"] == 0.0 and found["2"] == pytest.approx(1.0)
    summary = evaluation.backtest_summary(evaluation.log_rmse(df)).first()
    assert summary.mean_log_rmse == pytest.approx(0.5) and summary.races == 2


def test_predicted_next_to_actual(spark):
    predicted = spark.createDataFrame(
        [("1", 1, 3.0), ("1", 2, 2.0)], "race_id string, horse_number int, predicted_odds double"
    )
    actual = spark.createDataFrame([(1, 2.5), (2, 9.9)], ACTUAL_ODDS)
    table = evaluation.predicted_and_actual(predicted, actual, ["horse_number"]).collect()
    assert [(r.horse_number, r.predicted_odds, r.actual_odds) for r in table] == [
        (1, 3.0, 2.5), (2, 2.0, 9.9),
    ]


def test_calibration_grid_against_brute_force(spark):
    rows = random_races(spark, seed=5, giant=300)
    races = rows.toPandas().groupby("race_id")
    want = {}
    for k in evaluation.K_GRID:
        errors = []
        for _, race in races:
            power = race.share.to_numpy() ** k
            odds = 0.8 / (power / power.sum() * 0.8)
            errors.append(np.sqrt(np.mean((np.log(race.actual_odds) - np.log(odds)) ** 2)))
        want[k] = np.mean(errors)
    grid = evaluation.calibration_grid(rows)
    found = {r.k: r.log_rmse for r in grid.collect()}
    assert found == pytest.approx(want)
    assert evaluation.best_k(grid).first().k == min(want, key=lambda k: (want[k], k))


def test_races_are_brought_together_before_their_sums(spark):
    """Sums of runners in any order are more than the runners: 27 numbers to a row."""
    spread = random_races(spark).repartition("horse_number")
    plan = evaluation.calibration_grid(spread)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(race_id") == 1
    moved = plan.index("Exchange hashpartitioning(race_id")
    assert "HashAggregate(keys=[race_id" in plan[:moved] and "HashAggregate(keys=[race_id" not in plan[moved:]


def test_perfect_shares_have_no_error_at_k_1(spark):
    rows = random_races(spark).withColumn("actual_odds", F.lit(1.0))
    exact = pricing.normalise(rows).withColumn("actual_odds", F.col("predicted_odds"))
    best = evaluation.best_k(evaluation.calibration_grid(exact)).first()
    assert best.k == 1.0 and best.log_rmse == pytest.approx(0, abs=1e-6)


def test_log_loss_and_value(spark):
    rows = [
        ("1", "2024/01/01", 0.4, 3.0, 1), ("1", "2024/01/01", 0.4, 1.5, 2),
        ("2", "2025/01/01", 0.2, 5.0, 2), ("2", "2025/01/01", 0.6, 1.1, 1),
    ]
    schema = "race_id string, date_text string, share double, actual_odds double, finish_position int"
    df = spark.createDataFrame(rows, schema)
    loss = evaluation.log_loss(df).first()
    assert loss.log_loss == pytest.approx(-(math.log(0.5) + math.log(0.75)) / 2) and loss.races == 2
    value = {r.year: (r.bets, r.returned, r.return_rate) for r in evaluation.value_return(df).collect()}
    assert value == {"2024": (1, 3.0, 3.0), "2025": (1, 0.0, 0.0)}


def test_races_without_a_known_winner_are_not_perfect_forecasts(spark):
    rows = [("1", 0.4, 1), ("1", 0.4, 2), ("2", 0.4, None), ("2", 0.4, None), ("3", 0.8, 2)]
    df = spark.createDataFrame(rows, "race_id string, share double, finish_position int")
    loss = evaluation.log_loss(df).first()
    assert loss.log_loss == pytest.approx(math.log(2)) and loss.races == 1
