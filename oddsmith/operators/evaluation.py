"""How good predicted odds are: log error, calibration search, log loss, value bets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.settings import K_GRID, PAYOUT


def log_rmse(
    rows: DataFrame,
    actual: str = "actual_odds",
    predicted: str = "predicted_odds",
    race: str | list[str] = "race_id",
) -> DataFrame:
    """Root mean squared difference of the logs of actual and predicted odds, per race."""
    error = F.ln(actual) - F.ln(predicted)
    keys = [race] if isinstance(race, str) else race
    return rows.groupBy(*keys).agg(F.sqrt(F.avg(error * error)).alias("log_rmse"))


def predicted_and_actual(
    predicted: DataFrame, actual: DataFrame, on: Sequence[str] = ("race_id", "horse_number")
) -> DataFrame:
    """Predicted next to actual odds, sorted by the actual ones within each race.

    For a single race known by its runner numbers only, pass ``on=["horse_number"]``.
    """
    joined = predicted.join(actual, list(on))
    return joined.orderBy("race_id", "actual_odds", "horse_number")


def backtest_summary(errors: DataFrame) -> DataFrame:
    """The mean of the per-race errors and the number of races."""
    return errors.agg(
        F.avg("log_rmse").alias("mean_log_rmse"), F.count("log_rmse").alias("races")
    )


def calibration_grid(
    scored: DataFrame,
    share: str = "share",
    actual: str = "actual_odds",
    grid: Sequence[float] = K_GRID,
    race: str = "race_id",
) -> DataFrame:
    """Mean Log-RMSE over all races for each exponent k: columns ``k``, ``log_rmse``.

    With shares p and actual odds a, a runner's log error after normalisation is
    ``ln a + k ln p - ln sum(p^k)``. Its mean square over a race is the variance of
    ``ln a + k ln p`` plus the squared distance of its mean from ``ln sum(p^k)``, so one
    grouped pass serves all k: rows are neither copied per k nor joined to their totals.
    """
    scored = _by_race(scored, race, share, actual)
    log_share = F.ln(share)
    known = F.col(actual).isNotNull() & log_share.isNotNull()
    log_actual = F.when(known, F.ln(actual))
    shown = F.when(known, log_share)
    per_race = scored.groupBy(race).agg(
        *[F.ln(F.sum(F.pow(F.col(share), F.lit(k)))).alias(f"_total_{i}") for i, k in enumerate(grid)],
        F.avg(log_actual).alias("_mean_actual"),
        F.avg(shown).alias("_mean_share"),
        F.var_pop(log_actual).alias("_var_actual"),
        F.var_pop(shown).alias("_var_share"),
        F.covar_pop(log_actual, shown).alias("_covar"),
    )

    def rmse(i: int, k: float) -> Column:
        spread = F.col("_var_actual") + 2 * k * F.col("_covar") + k * k * F.col("_var_share")
        offset = F.col("_mean_actual") + k * F.col("_mean_share") - F.col(f"_total_{i}")
        return F.sqrt(F.greatest(spread, F.lit(0.0)) + offset * offset)

    means = per_race.agg(*[F.avg(rmse(i, k)).alias(f"_rmse_{i}") for i, k in enumerate(grid)])
    pairs = [
        F.struct(F.lit(k).alias("k"), F.col(f"_rmse_{i}").alias("log_rmse"))
        for i, k in enumerate(grid)
    ]
    return means.select(F.inline(F.array(*pairs)))


def _by_race(scored: DataFrame, *columns: str) -> DataFrame:
    """The given columns, the race's first, with the rows of a race brought together.

    A race has few runners and many sums. Scored rows come in any order, so sums made before the
    shuffle are nearly one set a runner: larger than the rows, in what moves and in memory. The task
    of a giant race reads its rows one by one and holds only their sums.
    """
    return scored.select(*dict.fromkeys(columns)).repartition(columns[0])


def best_k(grid: DataFrame) -> DataFrame:
    """The exponent with the lowest mean error; the smallest one among equals."""
    return grid.orderBy(F.col("log_rmse").asc_nulls_last(), "k").limit(1)


def refine_k(
    scored: DataFrame,
    share: str = "share",
    actual: str = "actual_odds",
    grid: Sequence[float] = K_GRID,
    race: str = "race_id",
    close: float = 1e-6,
    passes: int = 8,
) -> DataFrame:
    """The exponent with the lowest mean error between the grid points, one row ``k, log_rmse``.

    Newton steps from the best point of the grid, kept between its neighbours; where a step would
    leave them, the half towards the optimum is taken. Each step is one grouped pass: the mean error
    and its two derivatives follow from a race's means, variances and covariance and its sums of
    p^k, p^k ln p and p^k ln² p. Without an error anywhere k is null.
    """
    spark = scored.sparkSession
    schema = "k double, log_rmse double"
    start = best_k(calibration_grid(scored, share, actual, grid, race)).first()
    if start is None or start["log_rmse"] is None:
        return spark.createDataFrame([(None, None)], schema)
    k = start["k"]
    low = max((g for g in grid if g < k), default=k)
    high = min((g for g in grid if g > k), default=k)
    error, best = start["log_rmse"], k
    for _ in range(passes):
        together = _by_race(scored, race, share, actual).groupBy(race)
        value, slope, bend = together.agg(*_error_moments(share, actual, k)).agg(
            *_mean_error_derivatives(k)
        ).first()
        if value <= error:
            error, best = value, k
        if not slope:
            break
        low, high = (low, k) if slope > 0 else (k, high)
        step = k - slope / bend if bend and bend > 0 else low
        following = step if low < step < high else (low + high) / 2
        if abs(following - k) < close:
            break
        k = following
    return spark.createDataFrame([(best, error)], schema)


def _error_moments(share: str, actual: str, k: float) -> list[Column]:
    log_share = F.ln(share)
    known = F.col(actual).isNotNull() & log_share.isNotNull()
    log_actual, shown = F.when(known, F.ln(actual)), F.when(known, log_share)
    power = F.pow(F.col(share), F.lit(k))
    return [
        F.sum(power).alias("_sum"),
        F.sum(power * log_share).alias("_first"),
        F.sum(power * log_share * log_share).alias("_second"),
        F.avg(log_actual).alias("_mean_actual"),
        F.avg(shown).alias("_mean_share"),
        F.var_pop(log_actual).alias("_var_actual"),
        F.var_pop(shown).alias("_var_share"),
        F.covar_pop(log_actual, shown).alias("_covar"),
    ]


def _mean_error_derivatives(k: float) -> list[Column]:
    """The mean over races of the error, its slope and its bend in k."""
    tilt = F.col("_first") / F.col("_sum")
    offset = F.col("_mean_actual") + k * F.col("_mean_share") - F.ln("_sum")
    slant = F.col("_mean_share") - tilt
    spread = F.col("_var_actual") + 2 * k * F.col("_covar") + k * k * F.col("_var_share")
    square = F.greatest(spread, F.lit(0.0)) + offset * offset
    rate = 2 * (F.col("_covar") + k * F.col("_var_share") + offset * slant)
    curve = F.col("_second") / F.col("_sum") - tilt * tilt
    second = 2 * (F.col("_var_share") + slant * slant - offset * curve)
    error = F.sqrt(square)
    # a race without any error has no slope
    slope = F.when(error > 1e-12, rate / (2 * error))
    bend = F.when(error > 1e-12, second / (2 * error) - rate * rate / (4 * error * square))
    return [F.avg(error), F.avg(slope), F.avg(bend)]


def log_loss(
    priced: DataFrame, share: str = "share", payout: float = PAYOUT, race: str = "race_id"
) -> DataFrame:
    """Mean over races with a known winner of minus the log of the winner's probability."""
    winner = F.col("finish_position") == 1
    loss = F.when(winner, -F.ln(F.col(share) / payout))
    per_race = priced.groupBy(race).agg(F.sum(loss).alias("_loss")).where(F.col("_loss").isNotNull())
    return per_race.agg(
        F.avg("_loss").alias("log_loss"), F.count(F.lit(1)).alias("races")
    )


def value_return(
    priced: DataFrame, share: str = "share", market: str = "actual_odds", payout: float = PAYOUT
) -> DataFrame:
    """By year: bets, returns and return per unit staked on runners of expected value above 1."""
    probability = F.col(share) / payout
    bets = priced.where(probability * F.col(market) > 1)
    paid = F.when(F.col("finish_position") == 1, F.col(market)).otherwise(F.lit(0.0))
    by_year = bets.groupBy(F.substring("date_text", 1, 4).alias("year"))
    return by_year.agg(
        F.count(F.lit(1)).alias("bets"),
        F.sum(paid).alias("returned"),
        F.avg(paid).alias("return_rate"),
    )
