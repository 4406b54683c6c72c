"""The trend forecast against a plain version with golden section search."""

import math

import numpy as np
import pytest

from faceoff.operators.forecast import BAND_80, HORIZON, holt_forecast, smooth_at


def _smooth(x: np.ndarray, alpha: float, beta: float) -> tuple[float, float, np.ndarray]:
    """Level and trend after the series, and the one-step errors; starts at x2 with trend x2 - x1."""
    level, trend, errors = x[1], x[1] - x[0], np.empty(len(x) - 2)
    for i, value in enumerate(x[2:]):
        expected = level + trend
        errors[i] = value - expected
        new = alpha * value + (1.0 - alpha) * expected
        trend = beta * (new - level) + (1.0 - beta) * trend
        level = new
    return level, trend, errors


def _best_alpha(x: np.ndarray, beta: float) -> float:
    """Least squared one-step error on [0, 1]: a grid, then golden section around its best point."""
    def sse(a: float) -> float:
        return float(np.sum(_smooth(x, a, beta)[2] ** 2))

    grid = np.linspace(0.0, 1.0, 101)
    best = float(grid[int(np.argmin([sse(a) for a in grid]))])
    lo, hi, ratio = max(0.0, best - 0.01), min(1.0, best + 0.01), (math.sqrt(5.0) - 1.0) / 2.0
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if sse(a) < sse(b) else (a, hi)
    return (lo + hi) / 2.0


def _ahead(x: np.ndarray, beta: float) -> tuple[float, np.ndarray, np.ndarray]:
    alpha = _best_alpha(x, beta)
    level, trend, errors = _smooth(x, alpha, beta)
    steps = np.arange(1, HORIZON + 1)
    growth = np.array([1.0 + sum((alpha * (1.0 + j * beta)) ** 2 for j in range(1, h)) for h in steps])
    return alpha, level + steps * trend, BAND_80 * np.sqrt(np.var(errors, ddof=1) * growth)



def test_forecast_equals_the_plain_version(spark):
    rng = np.random.default_rng(2)
    own = {f"T{k}": np.round(1500 + np.cumsum(rng.normal(size=n) * 10) + k * np.arange(n), 3) for k, n in ((0, 27), (1, 40), (2, 90), (3, 26))}
    rows = [(t, f"{2000 + i // 12}-{i % 12 + 1:02d}", float(v)) for t, xs in own.items() for i, v in enumerate(xs)]
    got = holt_forecast(spark.createDataFrame(rows, "team string, month string, elo double").repartition(5)).collect()
    assert sorted({r["team"] for r in got}) == ["T0", "T1", "T2"] and len(got) == 9
    for r in got:
        x = own[r["team"]]
        alpha, point, band = _ahead(x, 1.0)
        _, held, _ = _ahead(x[:-HORIZON], 1.0)
        h = r["step"] - 1
        assert r["alpha"] == pytest.approx(alpha, abs=1e-5) and r["forecast"] == pytest.approx(point[h], abs=1e-3)
        assert r["hi80"] - r["forecast"] == pytest.approx(band[h], rel=1e-4) and r["n_months"] == len(x)
        assert r["mape"] == pytest.approx(np.mean(np.abs((x[-3:] - held) / x[-3:])) * 100, rel=1e-4)
        assert r["mape_naive"] == pytest.approx(np.mean(np.abs((x[-3:] - x[-4]) / x[-3:])) * 100)


def test_smoothing_at_a_weight(spark):
    x = np.array([3.0, 5.0, 4.0, 8.0, 7.0])
    df = spark.createDataFrame([("a", f"2020-0{i + 1}", float(v)) for i, v in enumerate(x)] + [("b", "2020-01", 1.0)], "team string, month string, elo double")
    level, trend, errors = _smooth(x, 0.3, 0.5)
    got = smooth_at(df, 0.3, 0.5).collect()
    assert len(got) == 1 and (got[0]["level"], got[0]["trend"], got[0]["mse"]) == pytest.approx((level, trend, np.mean(errors**2)))
