"""Jobs put together from the operators: matrices, final prediction, backtest, searches."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.functions.expressions import implied_share
from oddsmith.functions.expressions import race_day as day_of
from oddsmith.operators import asof, models
from oddsmith.operators.evaluation import (
    backtest_summary,
    best_k,
    calibration_grid,
    log_rmse,
    predicted_and_actual,
)
from oddsmith.operators.history import (
    combo_stats,
    horse_alltime,
    horse_features,
    jockey_stats,
)
from oddsmith.operators.joins import join_by_key, restrict_to, thinned_to
from oddsmith.operators.matrix import attach_features, derive
from oddsmith.operators.pricing import price_races, report
from oddsmith.recipes import FINAL_FEATURES, Recipe
from oddsmith.settings import CALIBRATION_K, K_GRID, Course, HistoryWindow
from oddsmith.sources.entries import overlay_weights, without_weight_change
from oddsmith.sources.results import before, race_entries, training_scope
from oddsmith.sources.store import Features, load_or_build
from oddsmith.workspace import identity, shared_dir, shuffles_dropped, stored


def window_of(recipe: Recipe) -> HistoryWindow:
    return HistoryWindow(recipe.jockey_since, recipe.recent_since, recipe.min_rides)


# -- matrices -----------------------------------------------------------------------------------


def snapshot_matrix(
    rows: DataFrame,
    features: Features,
    zero_handicap_diff: bool = False,
    total: int | None = None,
) -> DataFrame:
    """Rows with the features of one snapshot, as the final version trains and scores."""
    attached = attach_features(rows, features.jockey, features.horse, features.combo, total)
    return derive(attached, zero_handicap_diff)


def asof_matrix(
    history: DataFrame,
    rows: DataFrame,
    course: Course = Course(),
    window: HistoryWindow = HistoryWindow(),
) -> DataFrame:
    """Rows with the features each had before its own race day.

    The history is first cut down to the horses and jockeys that occur in ``rows``, also where they
    are too many for a list.
    """
    total = rows.count()
    horses = thinned_to(history, rows, "horse_name", total)
    jockeys = thinned_to(history, rows, "jockey_name", total)
    result = asof.asof_horse_features(horses, rows, course, window)
    # the days come from the rows as they were given, so that each step is worked out once
    result = asof.asof_jockey_stats(jockeys, result, window, rows)
    return derive(asof.asof_combo_stats(horses, result, rows))


def entry_matrix(
    history: DataFrame,
    rows: DataFrame,
    course: Course = Course(),
    window: HistoryWindow = HistoryWindow(),
    zero_handicap_diff: bool = False,
) -> DataFrame:
    """Rows with snapshot features, built only for the horses and jockeys that occur in them."""
    total = rows.count()
    horses = restrict_to(history, rows, "horse_name", total)
    jockeys = restrict_to(history, rows, "jockey_name", total)
    features = Features(
        jockey_stats(jockeys, window.jockey_since, window.min_rides),
        horse_features(horses, course, window),
        combo_stats(horses),
    )
    return snapshot_matrix(rows, features, zero_handicap_diff, total)


# -- final prediction ---------------------------------------------------------------------------


def train(
    history: DataFrame,
    all_rows: DataFrame,
    recipe: Recipe,
    course: Course = Course(),
    features: Features | None = None,
) -> PipelineModel:
    """Fit a recipe on the course's past rows with snapshot features (stored ones, if given)."""
    rows = training_scope(all_rows, course)
    if recipe.cutoff:
        history, rows = before(history, recipe.cutoff), before(rows, recipe.cutoff)
    if features is None:
        window = window_of(recipe)
        matrix = entry_matrix(history, rows, course, window, recipe.zero_train_handicap_diff)
    else:
        matrix = snapshot_matrix(rows, features, recipe.zero_train_handicap_diff)
    return models.fit(matrix, recipe)


def predict(model: PipelineModel, matrix: DataFrame, recipe: Recipe) -> DataFrame:
    """Odds of all entries, race by race, favourites first."""
    return report(priced(model, matrix, recipe))


def priced(model: PipelineModel, matrix: DataFrame, recipe: Recipe) -> DataFrame:
    """Scored and priced entries. Pricing reads the scores twice, so they are stored first."""
    folder = shared_dir(matrix.sparkSession)
    scored = stored(models.score(model, matrix), f"{folder}/scored-{uuid.uuid4().hex}")
    return models.price(scored, recipe)


def stored_features(
    history: DataFrame,
    folder: str,
    recipe: Recipe,
    course: Course = Course(),
    force_refresh: bool = False,
) -> Features:
    """The recipe's features of the history before its cutoff, kept in ``folder``."""
    if recipe.cutoff:
        history = before(history, recipe.cutoff)
    cut = (recipe.cutoff or "all").replace("/", "")
    window = window_of(recipe)
    return load_or_build(history, f"{folder}/features-before-{cut}", course, window, force_refresh)


def race_day(
    history: DataFrame,
    all_rows: DataFrame,
    entries: DataFrame,
    weights: DataFrame,
    recipe: Recipe,
    folder: str,
    course: Course = Course(),
    weights_on: Sequence[str] | None = None,
    force_refresh: bool = False,
    force_train: bool = False,
    features: Features | None = None,
) -> DataFrame:
    """Race-day job: stored features and model if present, announced weights, priced entries.

    ``entries`` comes from an entry list; without a ``race_id`` it is taken as one race. The
    recipe says how weights are looked up (``weights_on`` names another key) and what horses
    without one get. Only history before the recipe's cutoff is seen. Features and model are
    kept in ``folder`` under names made of the parameters and files they depend on; the switches
    build them anew. ``features`` may come from a ``FeatureStore`` that takes in new results.
    """
    if features is None:
        features = stored_features(history, folder, recipe, course, force_refresh)
    if recipe.cutoff:
        history = before(history, recipe.cutoff)
    made_of = identity(history, recipe, course, sorted(all_rows.inputFiles()))
    model = models.load_or_fit(
        history.sparkSession,
        f"{folder}/model-{recipe.name}-{made_of}",
        lambda: train(history, all_rows, recipe, course, features),
        force_train or force_refresh,
    )
    key = list(weights_on or recipe.weights_on)
    weighed = overlay_weights(entries, weights, key, recipe.weight_default)
    if recipe.undo_weight_change:
        weighed = without_weight_change(weighed)
    if "race_id" not in weighed.columns:
        weighed = weighed.withColumn("race_id", F.lit(""))
    return priced(model, snapshot_matrix(weighed, features), recipe)


def final_prediction(*job, **switches) -> DataFrame:
    """The odds report of ``race_day``, favourites first."""
    return report(race_day(*job, **switches))


def evaluated_prediction(
    prices: DataFrame, actual: DataFrame, on: Sequence[str] = ("horse_number",)
) -> tuple[DataFrame, DataFrame]:
    """Prices of ``race_day`` next to known odds, sorted by these, and the Log-RMSE of each race.

    ``actual`` holds ``actual_odds`` by the key ``on``: the runner's number where the entry list is
    one race, race and number otherwise.
    """
    known = actual.select(*on, "actual_odds")
    table = predicted_and_actual(prices.drop("actual_odds"), known, on)
    columns = ["race_id", "horse_number", "horse_name", "predicted_odds", "actual_odds"]
    return table.select(*columns), log_rmse(table)


# -- rolling backtest ---------------------------------------------------------------------------


def _mean_before(rows: DataFrame, value: str) -> DataFrame:
    """Per day of ``rows``: the mean of ``value`` over all earlier days.

    The rows are summed up by day first, so the window over days sees one row per race day.
    """
    daily = rows.groupBy(day_of(F.col("date_text")).alias("_day")).agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_n")
    )
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    mean = F.try_divide(F.sum("_sum").over(earlier), F.sum("_n").over(earlier))
    return daily.select("_day", mean.alias("_mean"))


def baseline_backtest(
    history: DataFrame,
    all_rows: DataFrame,
    race_ids: DataFrame,
    course: Course = Course(),
    point_in_time: bool = True,
    k: float = CALIBRATION_K,
) -> DataFrame:
    """Log-RMSE of each listed race, scored by the horse's mean odds so far: a model-free check.

    ``point_in_time`` uses only races before the target's day; otherwise means are taken over
    the whole history, as the snapshot features do. Horses without history get the mean over
    the course's rows before the race. All races are evaluated in one pass.
    """
    rows = training_scope(all_rows, course).select(
        "race_id", "date_text", "horse_number", "horse_name", "odds"
    )
    targets = race_entries(all_rows, race_ids).select(
        "race_id", "date_text", "horse_number", "horse_name", F.col("actual_odds").alias("odds")
    )
    asked = rows.withColumn("_target", F.lit(False)).unionByName(
        targets.withColumn("_target", F.lit(True))
    )
    past = restrict_to(history, asked)
    if point_in_time:
        known = asof.asof_horse_odds(past, asked)
    else:
        means = horse_alltime(past).select("horse_name", "horse_avg_odds")
        known = join_by_key(asked, means, ["horse_name"])
    narrow = known.select("race_id", "date_text", "horse_number", "odds", "_target", "horse_avg_odds")
    # read for the training means and, twice, for the pricing
    known = stored(narrow, f"{shared_dir(known.sparkSession)}/known-{uuid.uuid4().hex}")
    entries = known.where("_target").withColumn("_day", day_of(F.col("date_text")))
    training = known.where(~F.col("_target")).select("date_text", "horse_avg_odds")
    # every target day gets a row, also where no training row ran on that day
    days = training.unionByName(
        entries.select("date_text", F.lit(None).cast("double").alias("horse_avg_odds"))
    )
    # one row per race day, so a few thousand for any amount of data
    by_day = F.broadcast(_mean_before(days, "horse_avg_odds"))
    filled = entries.join(by_day, "_day", "left")
    odds = F.coalesce("horse_avg_odds", "_mean")
    result = price_races(filled, implied_share(odds), k, floor=None)
    errors = log_rmse(
        result.withColumn("_year", F.substring("date_text", 1, 4)), "odds", race=["race_id", "_year"]
    )
    return errors.select("race_id", F.col("_year").alias("year"), "log_rmse")


# The first letters of a date text ``yyyy/MM/dd`` that name its period.
_PERIOD_LETTERS = {"year": 4, "month": 7, "day": 10}


def _period(refit: str) -> Column:
    date = F.col("date_text")
    if refit == "quarter":
        first = F.ceil(F.substring(date, 6, 2).cast("int") / 3).cast("int") * 3 - 2
        return F.concat(F.substring(date, 1, 5), F.lpad(first.cast("string"), 2, "0"))
    return F.substring(date, 1, _PERIOD_LETTERS[refit])


def backtest_scores(
    matrix: DataFrame,
    entries: DataFrame,
    recipe: Recipe,
    refit: str = "day",
    parallel_fits: int = 4,
) -> DataFrame:
    """Entries scored by models that saw only rows before their race.

    ``matrix`` holds the training rows and ``entries`` the listed races, both with features and
    both stored by the caller. A model is fitted for every period (``day``, ``month``, ``quarter``
    or ``year``) in which a listed race lies, on the rows before its first day, so the number of
    fits follows the calendar, not the list. Scores are written to the shared folder and read
    back as one table.
    """
    return _scored_by(matrix, entries, {"": recipe}, refit, parallel_fits).drop("parameters")


def _scored_by(
    matrix: DataFrame, entries: DataFrame, recipes: dict[str, Recipe], refit: str, parallel_fits: int
) -> DataFrame:
    """The entries once for each named recipe, with ``parameters``, the name, and ``score``.

    One pool serves all recipes and periods.
    """
    spark = matrix.sparkSession
    dated = entries.withColumn("_period", _period(refit))
    # one row per period of the calendar
    periods = [r[0] for r in dated.select("_period").distinct().orderBy("_period").collect()]
    if not periods:
        none = F.lit(None).cast("double").alias("score")
        return entries.select("*", F.lit(None).cast("string").alias("parameters"), none)
    folder = f"{shared_dir(spark)}/backtest-{uuid.uuid4().hex}"

    def one(job: tuple[int, tuple[str, str]]) -> None:
        number, (name, period) = job
        model = models.fit(before(matrix, period), recipes[name], at_once)
        scored = models.score(model, dated.where(F.col("_period") == period).drop("_period"))
        scored.withColumn("parameters", F.lit(name)).write.parquet(f"{folder}/part={number}")

    jobs = [(name, p) for name in recipes for p in periods]
    at_once = min(parallel_fits, len(jobs))
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        list(pool.map(one, enumerate(jobs)))
    return spark.read.parquet(folder).drop("part")


def model_backtest(scored: DataFrame, recipe: Recipe) -> DataFrame:
    """Per race: year and Log-RMSE of the priced scores."""
    result = models.price(scored, recipe).withColumn("year", F.substring("date_text", 1, 4))
    return log_rmse(result, race=["race_id", "year"])


def backtest_input(
    history: DataFrame,
    all_rows: DataFrame,
    race_ids: DataFrame,
    course: Course = Course(),
    window: HistoryWindow = HistoryWindow(),
    point_in_time: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Training rows and the listed races' entries, both with features, stored once."""
    rows = training_scope(all_rows, course)
    rows = rows.withColumns({"actual_odds": F.col("odds"), "is_target": F.lit(False)})
    entries = race_entries(all_rows, race_ids).withColumns(
        {"odds": F.col("actual_odds"), "is_target": F.lit(True)}
    )
    build = asof_matrix if point_in_time else entry_matrix
    wide = build(history, rows.unionByName(entries), course, window)
    columns = [
        "race_id", "date_text", "odds", "actual_odds", "horse_name", "jockey_name", "sex", "is_target",
    ]
    chosen = wide.select(*columns, *FINAL_FEATURES)
    with shuffles_dropped(history.sparkSession):
        kept = stored(chosen, f"{shared_dir(history.sparkSession)}/backtest-rows-{uuid.uuid4().hex}")
    return kept.where(~F.col("is_target")), kept.where("is_target")


def listed_backtest(
    history: DataFrame,
    all_rows: DataFrame,
    race_ids: DataFrame,
    recipe: Recipe | None = None,
    course: Course = Course(),
    window: HistoryWindow = HistoryWindow(),
    refit: str = "day",
) -> tuple[DataFrame, DataFrame]:
    """Rolling backtest of listed races (see ``read_race_list``): their errors, and the mean.

    Without a recipe the races are scored by the horses' mean odds so far.
    """
    wanted = race_ids.select("race_id").distinct()
    if recipe is None:
        errors = baseline_backtest(history, all_rows, wanted, course)
    else:
        train, entries = backtest_input(history, all_rows, wanted, course, window)
        errors = model_backtest(backtest_scores(train, entries, recipe, refit), recipe)
    errors = stored(errors, f"{shared_dir(history.sparkSession)}/errors-{uuid.uuid4().hex}")
    return errors, backtest_summary(errors)


def search_k(scored: DataFrame, recipe: Recipe, grid: Sequence[float] = K_GRID) -> DataFrame:
    """The best calibration exponent for already scored races."""
    shares = scored.withColumn("share", models.raw_share(recipe))
    return best_k(calibration_grid(shares, grid=grid))


def search_parameters(
    matrix: DataFrame,
    entries: DataFrame,
    recipe: Recipe,
    grid: Sequence[dict],
    refit: str = "day",
    parallel_fits: int = 4,
) -> DataFrame:
    """Mean Log-RMSE of each parameter set over the rolling backtest, the best first.

    ``grid`` lists changes to the recipe's learner settings, for example
    ``{"learning_rate": 0.05, "leaves": 15}``; a change without effect on the trees fails.
    """
    scored = _scored_by(matrix, entries, _named_grid(recipe, grid), refit, parallel_fits)
    # a race under one parameter set is a race of its own; learner settings do not touch pricing
    apart = scored.withColumn("race_id", F.concat_ws("|", "parameters", "race_id"))
    errors = log_rmse(models.price(apart, recipe), race=["parameters", "race_id"])
    means = errors.groupBy("parameters").agg(F.avg("log_rmse").alias("mean_log_rmse"))
    return means.orderBy("mean_log_rmse", "parameters")


def _named_grid(recipe: Recipe, grid: Sequence[dict]) -> dict[str, Recipe]:
    labels = [", ".join(f"{name}={value}" for name, value in sorted(c.items())) for c in grid]
    return {label: recipe.changed(**c) for label, c in zip(labels, grid, strict=True)}


def search_by_stages(
    matrix: DataFrame,
    entries: DataFrame,
    recipe: Recipe,
    grid: Sequence[dict],
    stages: Sequence[int],
    refit: str = "day",
    survivors: int = 3,
    parallel_fits: int = 4,
) -> DataFrame:
    """A grid search over a rolling backtest that gives up poor settings early.

    Each parameter set is fitted once a period with the recipe's number of trees, and scored after
    every number of trees in ``stages``. The first round takes few periods, spread over the calendar;
    after each round one set in ``survivors`` goes on, and the next round has as many times more
    periods, up to all of them, for those sets alone. A set is judged by its best stage over all
    periods scored so far. ``survivors=1`` drops none: the full grid.

    One row for each set and stage: ``parameters, trees, mean_log_rmse, races, rounds``; more rounds
    survived first, then the lower error. The driver sees one number for each set and stage.
    """
    spark = matrix.sparkSession
    recipes = _named_grid(recipe, grid)
    dated = entries.withColumn("_period", _period(refit))
    periods = [r[0] for r in dated.select("_period").distinct().orderBy("_period").collect()]
    schema = "parameters string, trees int, mean_log_rmse double, races long, rounds int"
    if not periods or not recipes:
        return spark.createDataFrame([], schema)
    folder = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"

    def one(job: tuple[str, str], at_once: int) -> None:
        name, period = job
        model = models.fit(before(matrix, period), recipes[name], at_once)
        mine = dated.where(F.col("_period") == period).drop("_period")
        scored = models.staged_scores(model, mine, stages).withColumn("parameters", F.lit(name))
        number = list(recipes).index(name) * len(periods) + periods.index(period)
        scored.write.mode("overwrite").parquet(f"{folder}/part={number}")

    alive, done, found = list(recipes), 0, {}
    rounds = _round_sizes(len(periods), len(alive), survivors)
    order = _spread(periods)
    for number, size in enumerate(rounds, 1):
        jobs = [(name, p) for name in alive for p in order[done:size]]
        at_once = min(parallel_fits, len(jobs))
        with ThreadPoolExecutor(max_workers=at_once) as pool:
            list(pool.map(partial(one, at_once=at_once), jobs))
        done = size
        scored = spark.read.parquet(folder).drop("part").where(F.col("parameters").isin(alive))
        errors = _staged_errors(scored, recipe).collect()
        found.update({(r["parameters"], r["trees"]): (*r[2:], number) for r in errors})
        best = {name: min(found[name, s][0] for name_, s in found if name_ == name) for name in alive}
        alive = sorted(alive, key=lambda name: (best[name], name))
        if survivors > 1:
            alive = alive[: max(1, -(-len(alive) // survivors))]
    rows = [(name, trees, *values) for (name, trees), values in found.items()]
    ranked = spark.createDataFrame(rows, schema)
    return ranked.orderBy(F.desc("rounds"), "mean_log_rmse", "parameters", "trees")


def _staged_errors(scored: DataFrame, recipe: Recipe) -> DataFrame:
    """Mean Log-RMSE over races of each parameter set and stage, and the number of races."""
    # a race under one parameter set and stage is a race of its own
    apart = scored.withColumn("race_id", F.concat_ws("|", "parameters", "trees", "race_id"))
    errors = log_rmse(models.price(apart, recipe), race=["parameters", "trees", "race_id"])
    return errors.groupBy("parameters", "trees").agg(
        F.avg("log_rmse").alias("mean_log_rmse"), F.count("log_rmse").alias("races")
    )


def _round_sizes(periods: int, sets: int, survivors: int) -> list[int]:
    """How many periods are scored by the end of each round: all of them in the last."""
    if survivors < 2:
        return [periods]
    sizes, left = [periods], sets
    while left > survivors and sizes[0] > 1:
        sizes.insert(0, -(-sizes[0] // survivors))
        left = -(-left // survivors)
    return sorted(set(sizes))


def _spread(periods: Sequence[str]) -> list[str]:
    """The periods in an order whose beginnings are spread evenly: middle, quarters, eighths."""
    order, parts = [], [list(periods)]
    while parts:
        following = []
        for part in parts:
            middle = len(part) // 2
            order.append(part[middle])
            following += [p for p in (part[:middle], part[middle + 1 :]) if p]
        parts = following
    return order
