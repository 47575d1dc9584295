import math
import random
import uuid
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from oddsmith.operators import evaluation, models
from oddsmith.operators.evaluation import best_k, calibration_grid, refine_k
from oddsmith.plans import prediction
from oddsmith.recipes import Recipe
from oddsmith.workspace import shared_dir

RECIPE = Recipe("small", ("handicap", "age", "horse_avg_odds"), trees=4, leaves=4, bins=16, min_rows_per_leaf=2)


@pytest.fixture(scope="module")
def matrix(spark):
    pick = random.Random(3)
    rows = []
    for race in range(48):
        for number in range(1, 7):
            mean = pick.uniform(2, 30)
            odds = round(mean * pick.uniform(0.6, 1.6) * (1 + number / 20), 1)
            date = f"20{20 + race // 12}/{race % 12 + 1:02}/01"
            rows.append((str(race), date, number, float(50 + number), pick.randrange(2, 8), mean, odds, odds, "牡"))
    schema = (
        "race_id string, date_text string, horse_number int, handicap double, age int, horse_avg_odds double,"
        " odds double, actual_odds double, sex string"
    )
    return spark.createDataFrame(rows, schema).cache()


def test_staged_scores_are_those_of_shorter_fits(matrix):
    model = models.fit(matrix, RECIPE)
    staged = models.staged_scores(model, matrix, [1, 3, 4])
    assert staged.columns == [*matrix.columns, "trees", "score"]
    for trees in (1, 3, 4):
        shorter = models.fit(matrix, replace(RECIPE, trees=trees))
        want = models.score(shorter, matrix).select("race_id", "horse_number", F.col("score").alias("want"))
        both = staged.where(F.col("trees") == trees).join(want, ["race_id", "horse_number"])
        assert both.count() == matrix.count()
        assert both.where("abs(score - want) > 1e-9").isEmpty()
    with pytest.raises(ValueError, match="stages"):
        models.staged_scores(model, matrix, [5])


GRID = [
    {"learning_rate": rate, "leaves": leaves} for rate in (0.01, 0.3) for leaves in (2, 8)
]


def test_survivors_win_as_in_the_full_grid(spark, matrix):
    train, targets = matrix, matrix.where("date_text >= '2022'")
    full = prediction.search_by_stages(train, targets, RECIPE, GRID, [2, 4], "year", survivors=1).collect()
    assert len(full) == 2 * len(GRID) and {r.rounds for r in full} == {1}
    assert {r.races for r in full} == {targets.select("race_id").distinct().count()}
    assert [r.mean_log_rmse for r in full] == sorted(r.mean_log_rmse for r in full)
    halved = prediction.search_by_stages(train, targets, RECIPE, GRID, [2, 4], "year", survivors=2).collect()
    assert halved[0][:4] == full[0][:4]
    assert {r.rounds for r in halved} == {1, 2}
    # the last stage of the winner, scored in the plain way
    name, change = halved[0].parameters, next(
        c for c in GRID if ", ".join(f"{k}={v}" for k, v in sorted(c.items())) == halved[0].parameters
    )
    plain = prediction.search_parameters(train, targets, RECIPE, [change], "year").first()
    last = next(r for r in halved if (r.parameters, r.trees) == (name, 4))
    assert plain.mean_log_rmse == pytest.approx(last.mean_log_rmse)
    none = prediction.search_by_stages(train, targets.where("false"), RECIPE, GRID, [2], "year")
    assert none.isEmpty()


def test_rounds():
    assert prediction._round_sizes(9, 27, 3) == [1, 3, 9]
    assert prediction._round_sizes(9, 4, 3) == [3, 9]
    assert prediction._round_sizes(9, 2, 3) == [9]
    assert prediction._round_sizes(5, 100, 1) == [5]
    periods = [str(n) for n in range(11)]
    assert sorted(prediction._spread(periods), key=int) == periods
    assert prediction._spread(periods)[:3] == ["5", "2", "8"]


def test_nodes_and_split_importance(spark, matrix):
    model = models.fit(matrix, RECIPE)
    path = f"{shared_dir(spark)}/nodes-{uuid.uuid4().hex}"
    models.save_model(model, path)
    nodes = models.ensemble_nodes(spark, path, RECIPE).cache()
    trees = model.stages[-1].trees
    assert nodes.count() == sum(t.numNodes for t in trees)
    inner = nodes.where("feature is not null")
    assert inner.count() == sum((t.numNodes - 1) // 2 for t in trees)
    assert nodes.where("node = 0 and rows <> %d" % matrix.count()).isEmpty()
    table = models.split_importance(nodes, RECIPE).collect()
    assert {r.feature for r in table} == set(RECIPE.features)
    text = "\n".join(t.toDebugString for t in trees)
    for r in table:
        # each split is printed once for either side
        assert r.splits == text.count(f"(feature {RECIPE.features.index(r.feature)} ") / 2
    assert [r.splits for r in table] == sorted((r.splits for r in table), reverse=True)


def shares(spark, k, spread=0.3):
    pick, rows = random.Random(int(k * 100)), []
    for race in range(30):
        p = [pick.uniform(0.02, 0.3) for _ in range(8)]
        total = sum(x**k for x in p)
        for x in p:
            rows.append((str(race), x, total / x**k * math.exp(pick.gauss(0, spread))))
    return spark.createDataFrame([*rows, ("none", 0.1, None), ("zero", None, 3.0)], "race_id string, share double, actual_odds double")


@pytest.mark.parametrize(("k", "most"), [(1.63, 5), (2.27, 5), (0.5, 5)])
def test_refined_k_against_a_fine_grid(spark, monkeypatch, k, most):
    scored = shares(spark, k).cache()
    passes = []
    moments = evaluation._error_moments
    monkeypatch.setattr(evaluation, "_error_moments", lambda *a: passes.append(1) or moments(*a))
    found = refine_k(scored).first()
    assert len(passes) <= most
    near = best_k(calibration_grid(scored)).first().k
    fine = [near + step / 1000 for step in range(-100, 101) if near + step / 1000 >= 1.0]
    want = best_k(calibration_grid(scored, grid=fine)).first()
    assert found.k == pytest.approx(want.k, abs=1e-3)
    assert found.log_rmse <= want.log_rmse + 1e-9


def test_refined_k_without_errors(spark):
    scored = shares(spark, 1.4).cache()
    assert refine_k(scored.limit(0)).first().k is None
    assert refine_k(scored.withColumn("actual_odds", F.lit(None).cast("double"))).first().k is None
    exact = shares(spark, 1.5, spread=0.0)
    assert refine_k(exact).first().k == pytest.approx(1.5, abs=1e-3)
