"""Holt's linear trend per entity: one short monthly series per row, folded in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HORIZON, MIN_MONTHS, BAND_80 = 3, 24, 1.2815515655446004      # fixed values
#: Weights looked at first (0, 0.01, ... 1), and how often the steps around the best one are made ten times finer.
GRID, FINER = 100, 7


def _fold(series: Column, alpha: Column, beta: float) -> Column:
    """(level, trend, sse, se) after a series: starts at x2 with trend x2 - x1, adds up one-step errors."""
    def step(acc: Column, value: Column) -> Column:
        expected = acc["level"] + acc["trend"]
        error = value - expected
        level = alpha * value + (1.0 - alpha) * expected
        return F.struct(level.alias("level"), (beta * (level - acc["level"]) + (1.0 - beta) * acc["trend"]).alias("trend"),
                        (acc["sse"] + error * error).alias("sse"), (acc["se"] + error).alias("se"))

    first, second = F.get(series, F.lit(0)), F.get(series, F.lit(1))
    start = F.struct(second.alias("level"), (second - first).alias("trend"), F.lit(0.0).alias("sse"), F.lit(0.0).alias("se"))
    return F.aggregate(F.slice(series, F.lit(3), F.size(series) - 2), start, step)


def _best_alpha(series: Column, beta: float) -> Column:
    """Least squared one-step error on [0, 1]: a grid, then ever finer ones around its best point."""
    def best(centre: Column, unit: Column, low: int, high: int) -> Column:
        def tried(i: Column) -> Column:
            alpha = F.greatest(F.lit(0.0), F.least(F.lit(1.0), centre + i * unit))
            return F.struct(_fold(series, alpha, beta)["sse"].alias("sse"), alpha.alias("alpha"))

        return F.array_min(F.transform(F.sequence(F.lit(low), F.lit(high)), tried))["alpha"]

    def finer(acc: Column, _: Column) -> Column:
        unit = acc["unit"] / 10.0
        return F.struct(best(acc["alpha"], unit, -10, 10).alias("alpha"), unit.alias("unit"))

    coarse = F.struct(best(F.lit(0.0), F.lit(1.0 / GRID), 0, GRID).alias("alpha"), F.lit(1.0 / GRID).alias("unit"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(FINER)), coarse, finer)["alpha"]


def monthly_series(monthly: DataFrame, value: str = "elo") -> DataFrame:
    """(team, xs): an entity's months in order; their number is bounded by the calendar."""
    pairs = F.array_sort(F.collect_list(F.struct("month", F.col(value).cast("double").alias("v"))))
    return monthly.groupBy("team").agg(F.transform(pairs, lambda p: p["v"]).alias("xs"))


def smooth_at(monthly: DataFrame, alpha: float, beta: float = 1.0, value: str = "elo") -> DataFrame:
    """Level and trend after each entity's months, and the mean squared one-step error, at given weights."""
    rows = monthly_series(monthly, value).where(F.size("xs") > 2)
    fitted = rows.select("team", F.size("xs").alias("n_months"), F.explode(F.array(_fold(F.col("xs"), F.lit(alpha), beta))).alias("_f"))
    return fitted.select("team", "n_months", "_f.level", "_f.trend", (F.col("_f.sse") / (F.col("n_months") - 2)).alias("mse"))


def holt_forecast(monthly: DataFrame, beta: float = 1.0, value: str = "elo") -> DataFrame:
    """(team, month, value) -> three forecast months with an 80 % band and the hold-out errors.

    The trend weight is fixed (1 as published); the level weight minimises the squared error.
    Entities with fewer than 24 months plus the hold-out are left out.
    """
    rows = monthly_series(monthly, value).where(F.size("xs") >= MIN_MONTHS + HORIZON)
    both = rows.select("team", "xs", F.explode(F.array(F.lit(False), F.lit(True))).alias("held")).withColumn(
        "_s", F.when(F.col("held"), F.slice("xs", F.lit(1), F.size("xs") - HORIZON)).otherwise(F.col("xs")))
    weighed = both.select("team", "xs", "held", "_s", F.explode(F.array(_best_alpha(F.col("_s"), beta))).alias("alpha"))
    fitted = weighed.select("team", "xs", "held", "alpha", F.size("_s").alias("_n"), F.explode(F.array(_fold(F.col("_s"), F.col("alpha"), beta))).alias("_f"))
    m = F.col("_n") - 2
    a = F.col("alpha")
    parts = []
    for h in range(1, HORIZON + 1):
        growth = F.lit(1.0)
        for j in range(1, h):
            growth = growth + F.pow(a * (1.0 + j * beta), F.lit(2))
        variance = (F.col("_f.sse") - F.col("_f.se") * F.col("_f.se") / m) / (m - 1)
        parts.append(F.struct(F.lit(h).alias("step"), (F.col("_f.level") + h * F.col("_f.trend")).alias("forecast"),
                              (BAND_80 * F.sqrt(variance * growth)).alias("band"), F.get("xs", F.size("xs") - HORIZON + h - 1).alias("actual"),
                              F.get("xs", F.size("xs") - HORIZON - 1).alias("last")))
    steps = fitted.select("team", "held", "alpha", F.size("xs").alias("n_months"), F.inline(F.array(*parts)))
    off = lambda guess: 100.0 * F.avg(F.abs((F.col("actual") - F.col(guess)) / F.col("actual")))
    errors = steps.where("held").groupBy("team").agg(off("forecast").alias("mape"), off("last").alias("mape_naive"))
    return steps.where(~F.col("held")).join(errors, "team").select(
        "team", "step", "n_months", "alpha", "forecast", (F.col("forecast") - F.col("band")).alias("lo80"), (F.col("forecast") + F.col("band")).alias("hi80"),
        "mape", "mape_naive")
