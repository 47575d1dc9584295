import math
import random
import uuid
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from oddsmith.operators import models
from oddsmith.plans import prediction
from oddsmith.recipes import RECIPES, Recipe
from oddsmith.settings import HistoryWindow
from oddsmith.sources import entries as entry_source
from oddsmith.sources import results
from oddsmith.sources.store import build_features
from oddsmith.workspace import shared_dir

WINDOW = HistoryWindow("2020/01/01", "2020/01/01", 1)


@pytest.fixture(scope="module")
def history(make_history):
    pick = random.Random(7)
    rows = []
    for race in range(60):
        date = f"20{20 + race // 15}/{race % 12 + 1:02}/01"
        for number in range(1, 9):
            horse = pick.randrange(40)
            rows.append(
                {
                    "race_id": str(race), "date_text": date, "horse_number": number,
                    "horse_name": f"H{horse}", "jockey_name": f"J{pick.randrange(8)}",
                    "odds": round(1.5 + horse * pick.uniform(0.5, 1.5), 1),
                    "popularity": number, "finish_position": number, "sex": pick.choice("牡牝セ"),
                    "weight": pick.choice([None, 470, 500]), "age": pick.randrange(2, 8),
                }
            )
    return make_history(*rows).cache()


@pytest.fixture(scope="module")
def matrix(history):
    return prediction.entry_matrix(history, results.training_scope(history), window=WINDOW).cache()


@pytest.fixture(scope="module")
def entries(history):
    chosen = results.race_entries(history, history.where("race_id IN ('58', '59')"))
    return prediction.entry_matrix(history, chosen, window=WINDOW).cache()


@pytest.mark.parametrize("version", ["v1", "v4", "v9", "v19"])
def test_fit_and_price(version, matrix, entries):
    recipe = RECIPES[version].smaller(trees=4, depth=3)
    model = models.fit(matrix, recipe)
    priced = models.price(models.score(model, entries), recipe)
    assert priced.count() == entries.count()
    assert priced.where(F.col("predicted_odds") < (recipe.odds_floor or 0)).isEmpty()
    if recipe.normalise:
        shares = priced.groupBy("race_id").agg(F.sum("share").alias("s")).collect()
        assert [r.s for r in shares] == pytest.approx([0.8] * 2, abs=1e-9)
    report = prediction.predict(model, entries, recipe).toPandas()
    for _, race in report.groupby("race_id"):
        assert race.predicted_odds.is_monotonic_increasing


def test_saved_model_predicts_the_same(spark, matrix, entries):
    recipe = replace(RECIPES["v16"].smaller(4, 3), zero_fill_scores=True)
    path = f"{shared_dir(spark)}/model-test-{spark.sparkContext.applicationId}"
    calls = []

    def fit():
        calls.append(1)
        return models.fit(matrix, recipe)

    first = models.load_or_fit(spark, path, fit)
    second = models.load_or_fit(spark, path, fit)
    assert len(calls) == 1
    scores = [models.score(m, entries).select("race_id", "horse_number", "score") for m in (first, second)]
    assert scores[0].exceptAll(scores[1]).isEmpty()
    models.load_or_fit(spark, path, fit, force=True)
    assert len(calls) == 2
    again = models.score(models.fit(matrix, recipe), entries).select("race_id", "horse_number", "score")
    assert again.exceptAll(scores[0]).isEmpty()


def test_importance(spark, matrix):
    recipe = RECIPES["v7"].smaller(4, 3)
    table = models.importance(models.fit(matrix, recipe), recipe, spark).toPandas()
    assert sorted(table.feature) == sorted(recipe.features)
    assert table.importance.is_monotonic_decreasing and table.importance.sum() == pytest.approx(1)
    assert table.feature[0] == "horse_avg_odds"


def test_unseen_sex_and_missing_values_are_scored(matrix, entries):
    recipe = RECIPES["v3"].smaller(3, 3)
    odd = entries.withColumns({"sex": F.lit("?"), "horse_avg_odds": F.lit(None).cast("double")})
    scored = models.score(models.fit(matrix, recipe), odd)
    assert scored.where("score IS NULL").isEmpty() and scored.count() == entries.count()


def test_train_on_scope_with_cutoff(history, entries):
    recipe = replace(RECIPES["v13"], cutoff="2023/01/01", jockey_since="2020/01/01", recent_since="2020/01/01")
    recipe = recipe.smaller(3, 3)
    own = prediction.train(history, history, recipe)
    stored = build_features(results.before(history, recipe.cutoff), window=prediction.window_of(recipe))
    given = prediction.train(history, history, recipe, features=stored)
    a, b = (models.score(m, entries).agg(F.sum("score")).first()[0] for m in (own, given))
    assert a == pytest.approx(b)


def test_backtest_sees_only_earlier_rows(history):
    rows = results.training_scope(history).withColumn("actual_odds", F.col("odds"))
    matrix = prediction.asof_matrix(history, rows, window=WINDOW).cache()
    targets = matrix.where("race_id IN ('40', '50')")
    recipe = RECIPES["v17"].smaller(3, 3)
    errors = prediction.model_backtest(prediction.backtest_scores(matrix, targets, recipe), recipe)
    found = {r.race_id: (r.year, r.log_rmse) for r in errors.collect()}
    dates = {r.race_id: r.date_text for r in targets.select("race_id", "date_text").distinct().collect()}
    assert {race: year for race, (year, _) in found.items()} == {r: d[:4] for r, d in dates.items()}
    last = max(dates.values())
    cut = prediction.model_backtest(
        prediction.backtest_scores(results.before(matrix, last), targets, recipe), recipe
    )
    assert {r.race_id: r.log_rmse for r in cut.collect()} == pytest.approx({r: e for r, (_, e) in found.items()})


def test_searches(history):
    rows = results.training_scope(history).withColumn("actual_odds", F.col("odds"))
    matrix = prediction.asof_matrix(history, rows, window=WINDOW).cache()
    targets = matrix.where("race_id IN ('58', '59')")
    recipe = RECIPES["v18"].smaller(3, 3)
    best = prediction.search_k(prediction.backtest_scores(matrix, targets, recipe), recipe).first()
    assert 1.0 <= best.k <= 3.0
    grid = [{"learning_rate": 0.01}, {"learning_rate": 0.05, "feature_fraction": 0.6}]
    found = prediction.search_parameters(matrix, targets, recipe, grid).collect()
    assert len(found) == 2 and found[0].mean_log_rmse <= found[1].mean_log_rmse
    none = prediction.backtest_scores(matrix, targets.where("false"), recipe)
    assert none.isEmpty() and "score" in none.columns


def test_final_prediction_from_an_entry_list(spark, history, tmp_path):
    file = tmp_path / "entries.txt"
    lines = [f"{n},H{n},牡4,55.0,J{n % 8}" for n in range(1, 11)]
    file.write_text("\n".join([*lines, "11,newcomer,牝3,54.0,nobody"]), encoding="utf-8")
    listed = entry_source.read_entries(spark, str(file))
    weights = spark.createDataFrame([("H1", 500, 4)], "horse_name string, weight int, weight_change int")
    folder = f"{shared_dir(spark)}/final-test-{spark.sparkContext.applicationId}"
    recipe = RECIPES["v16"].smaller(3, 3)
    first, second = (
        prediction.final_prediction(history, history, listed, weights, recipe, folder).toPandas()
        for _ in range(2)
    )
    assert first.equals(second)
    assert len(first) == 11 and first.predicted_odds.is_monotonic_increasing
    assert first.predicted_odds.min() >= 1.0


def test_recipes():
    counts = [len(RECIPES[f"v{i}"].features) for i in range(1, 20)]
    assert counts == [4, 6, 9, 10, 12, 14, 16, 18, 18, 21, 20, 22, 22, 23, 23, 23, 23, 23, 23]
    assert [RECIPES[f"v{i}"].k for i in (12, 13, 16, 17, 19)] == [1.0, 1.5, 1.5, 1.2, 1.2]


def test_learner_settings_of_all_recipes():
    depths = [RECIPES[f"v{i}"].depth for i in range(1, 20)]
    assert depths == [5] * 9 + [6, 6, 6] + [5] * 7  # 40, 45 and 50 leaves need six levels
    assert {RECIPES[f"v{i}"].bins for i in range(1, 20)} == {255}
    assert Recipe("x", (), leaves=31, max_depth=6).depth == 5
    assert Recipe("x", (), leaves=31, max_depth=3).depth == 3
    recipe = RECIPES["v18"]
    assert recipe.changed(leaves=15).depth == 4 and recipe.changed(max_depth=3).depth == 3
    for change in ({"leaves": 30}, {"max_depth": 9}, {"learning_rate": 0.1, "leaves": 28}):
        with pytest.raises(ValueError, match="same trees"):
            recipe.changed(**change)


def _race_day(spark, history, version, folder, **switches):
    recipe = replace(
        RECIPES[version].smaller(3, 3), cutoff="2023/01/01" if version == "v13" else None,
        weights_on=("horse_name",), weight_default=(490, 0),
    )
    listed = spark.createDataFrame(
        [(n, f"H{n}", "牡", 4, 55.0, f"J{n % 8}") for n in range(1, 11)],
        "horse_number int, horse_name string, sex string, age int, handicap double, jockey_name string",
    )
    weights = spark.createDataFrame([("H1", 500, 4)], "horse_name string, weight int, weight_change int")
    job = (history, history, listed, weights, recipe, folder)
    return prediction.final_prediction(*job, **switches).toPandas()


@pytest.fixture
def fresh(spark):
    def path():
        return f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"

    return path


@pytest.fixture(scope="module")
def on_disk(spark, history):
    path = f"{shared_dir(spark)}/test-history-{uuid.uuid4().hex}"
    history.write.parquet(path)
    return spark.read.parquet(path)


def test_one_folder_serves_recipes_with_other_windows(spark, on_disk, fresh):
    folder = fresh()
    shared = [_race_day(spark, on_disk, v, folder) for v in ("v13", "v19")]
    alone = [_race_day(spark, on_disk, v, fresh()) for v in ("v13", "v19")]
    assert all(a.equals(b) for a, b in zip(shared, alone, strict=True))


def test_nothing_after_the_cutoff_is_seen(spark, on_disk, fresh):
    cut = results.before(on_disk, "2023/01/01")
    path = fresh()
    cut.write.parquet(path)
    assert _race_day(spark, on_disk, "v13", fresh()).equals(
        _race_day(spark, spark.read.parquet(path), "v13", fresh())
    )


def test_switches_build_anew(spark, on_disk, fresh, monkeypatch):
    folder, fits = fresh(), []
    fit = models.fit
    monkeypatch.setattr(models, "fit", lambda *a: fits.append(1) or fit(*a))
    for switches in ({}, {}, {"force_train": True}, {"force_refresh": True}):
        _race_day(spark, on_disk, "v19", folder, **switches)
    assert len(fits) == 3


def test_the_model_is_applied_once(matrix, entries):
    recipe = RECIPES["v19"].smaller(3, 3)
    model = models.fit(matrix, recipe)
    plan = prediction.priced(model, entries, recipe)._jdf.queryExecution().toString()
    assert "UDF" not in plan.split("== Physical Plan ==")[1]


def test_evaluated_prediction_by_number(spark, matrix, entries):
    recipe = RECIPES["v19"].smaller(3, 3)
    one = entries.where("race_id = '58'")
    actual = one.select("horse_number", "actual_odds")
    prices = prediction.priced(models.fit(matrix, recipe), one, recipe)
    table, error = prediction.evaluated_prediction(prices, actual)
    rows = table.toPandas()
    assert len(rows) == one.count() and rows.actual_odds.is_monotonic_increasing
    want = ((rows.actual_odds.map(math.log) - rows.predicted_odds.map(math.log)) ** 2).mean() ** 0.5
    assert error.first().log_rmse == pytest.approx(want)


@pytest.mark.parametrize(
    ("refit", "first"),
    [("day", "2023/05/01"), ("month", "2023/05"), ("quarter", "2023/04"), ("year", "2023")],
)
def test_refit_periods(spark, refit, first):
    row = spark.createDataFrame([("2023/05/01",)], "date_text string")
    assert row.select(prediction._period(refit)).first()[0] == first


def test_listed_backtest(spark, on_disk):
    listed = spark.createDataFrame([("40",), ("50",), ("50",)], "race_id string")
    recipe = RECIPES["v17"].smaller(3, 3)
    errors, summary = prediction.listed_backtest(on_disk, on_disk, listed, recipe, window=WINDOW, refit="year")
    assert errors.count() == 2
    assert summary.first().mean_log_rmse == pytest.approx(errors.agg(F.avg("log_rmse")).first()[0])
    assert prediction.listed_backtest(on_disk, on_disk, listed)[1].first().races == 2


def test_the_learner_reads_a_stored_matrix(matrix, monkeypatch):
    """Each of its thousands of tasks sends back the counters of the plan it was given."""
    plans, real = [], models._fit

    def watched(train, *others):
        plans.append(train._jdf.queryExecution().executedPlan().toString())
        return real(train, *others)

    monkeypatch.setattr(models, "_fit", watched)
    models.fit(matrix, RECIPES["v19"].smaller(trees=1, depth=2))
    assert "FileScan parquet" in plans[0]
    assert "Join" not in plans[0] and "InMemoryTableScan" not in plans[0]


@pytest.mark.parametrize(
    "rows, cores, tasks",
    [(0, 8, 1), (60_000, 8, 3), (1_300_000, 12, 12), (36_000_000, 12, 72), (1_000_001, 1, 3)],
)
def test_tasks_of_the_learner_follow_the_cores(rows, cores, tasks):
    assert models._tasks(rows, cores) == tasks


@pytest.mark.parametrize("jobs, most", [(1, 8), (2, 4), (4, 2)])
def test_fits_side_by_side_share_the_cores(spark, matrix, monkeypatch, jobs, most):
    """Fits that each take a task a core only wait for one another."""
    found, real = [], models._tasks
    monkeypatch.setattr(models, "_ROWS_PER_TASK", 10)
    monkeypatch.setattr(models, "_tasks", lambda *a: found.append(real(*a)) or found[-1])
    recipe = RECIPES["v19"].smaller(trees=1, depth=2)
    rows = matrix.withColumn("actual_odds", F.col("odds"))
    dates = sorted(r[0] for r in rows.select("date_text").distinct().collect())[-jobs:]
    targets = rows.where(F.col("date_text").isin(dates))
    assert prediction.backtest_scores(rows, targets, recipe).count() == targets.count()
    assert found == [most] * jobs
