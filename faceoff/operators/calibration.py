"""Probability calibration of many groups at once: isotonic by mergeable pools, Platt by Newton steps; no loop over groups.

Isotonic. Rows collapse to (group, p) sums. Each group's range is cut into chunks of about equal count; a chunk pools its
adjacent violators, which leaves far fewer ordered blocks, and the blocks of all chunks of a group are pooled again. Pooling is
associative over neighbouring stretches, so this is the fit over all rows. Knots go back to the chunks they serve, and a probability is read
from its chunk's knots with linear interpolation, constant beyond the ends.

Platt. Slope and offset per group on the log-odds; the slope has the penalty of half its square on the summed loss. A step is one aggregate of
five sums per group, solved in closed form there.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faceoff.functions.scalar import logit
from faceoff.session import write_and_reread

CHUNKS = 64


def pool(cells: list[tuple[float, float, float, float]]) -> list[list[float]]:
    """Pooled adjacent violators of ordered (low, high, sum, count) blocks; equal means are pooled too."""
    out: list[list[float]] = []
    for lo, hi, s, n in cells:
        out.append([lo, hi, s, n])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, hi, s, n = out.pop()
            out[-1][1:] = [hi, out[-1][2] + s, out[-1][3] + n]
    return out


def _blocks(table: pa.Table) -> list[tuple[float, float, float, float]]:
    return sorted(zip(*(table.column(c).to_pylist() for c in ("lo", "hi", "s", "n")), strict=True))


def _pool_chunk(table: pa.Table) -> pa.Table:
    own = pool(_blocks(table))
    head = [table.column(c).take(pa.array([0] * len(own))) for c in ("group", "splits")]
    return pa.table([head[0], *(pa.array([b[i] for b in own], pa.float64()) for i in range(4)), head[1]], names=["group", "lo", "hi", "s", "n", "splits"])


def _knots(table: pa.Table) -> pa.Table:
    """(group, chunk, xs, ys): the knots a chunk needs, its own and the nearest on either side."""
    xs, ys = [], []
    for lo, hi, s, n in pool(_blocks(table)):
        for x in (lo, hi) if lo < hi else (lo,):
            xs.append(x)
            ys.append(s / n)
    splits = table.column("splits")[0].as_py()
    rows, at = [], 0
    for chunk, end in enumerate([*splits, float("inf")]):
        first = at
        while at < len(xs) and xs[at] < end:
            at += 1
        a, z = max(first - 1, 0), min(at + 1, len(xs))
        rows.append((chunk, xs[a:z], ys[a:z]))
    return pa.table([table.column("group").take(pa.array([0] * len(rows))), pa.array([r[0] for r in rows], pa.int32()),
                     *(pa.array([r[i] for r in rows], pa.list_(pa.float64())) for i in (1, 2))], names=["group", "chunk", "xs", "ys"])


def _chunk(p: Column, splits: Column) -> Column:
    return F.size(F.filter(splits, lambda x: x <= p)).cast("int")


def isotonic(train: DataFrame, test: DataFrame, group: str, p: str = "p", label: str = "label", into: str = "p_cal",
             chunks: int = CHUNKS) -> DataFrame:
    """``test`` with calibrated probabilities; null for groups without training rows."""
    kind = train.schema[group].dataType.simpleString()
    rows = train.where(F.col(group).isNotNull() & F.col(p).isNotNull() & F.col(label).isNotNull()).select(
        F.col(group).alias("group"), F.col(p).cast("double").alias("lo"), F.col(label).cast("double").alias("y"))
    splits = rows.groupBy("group").agg(F.array_distinct(F.percentile_approx("lo", [i / chunks for i in range(1, chunks)], 10_000)).alias("splits"))
    splits = write_and_reread(splits, "calibration-splits")          # the sketch is drawn once
    cells = rows.groupBy("group", "lo").agg(F.sum("y").alias("s"), F.count("*").cast("double").alias("n")).join(splits, "group").select(
        "group", "lo", F.col("lo").alias("hi"), "s", "n", "splits", _chunk(F.col("lo"), F.col("splits")).alias("chunk"))
    pooled = cells.groupBy("group", "chunk").applyInArrow(_pool_chunk, f"group {kind}, lo double, hi double, s double, n double, splits array<double>")
    knots = pooled.groupBy("group").applyInArrow(_knots, f"group {kind}, chunk int, xs array<double>, ys array<double>")
    asked = test.join(splits.select(F.col("group").alias("_g"), F.col("splits").alias("_s")), F.col(group) == F.col("_g"), "left")
    asked = asked.withColumn("_chunk", _chunk(F.col(p), F.col("_s"))).drop("_g", "_s")
    met = asked.join(knots.select(F.col("group").alias("_g"), F.col("chunk").alias("_c"), F.col("xs").alias("_x"), F.col("ys").alias("_y")),
                     (F.col(group) == F.col("_g")) & (F.col("_chunk") == F.col("_c")), "left")
    at = F.size(F.filter("_x", lambda x: x <= F.col(p)))
    x0, x1, y0, y1 = F.get("_x", at - 1), F.get("_x", at), F.get("_y", at - 1), F.get("_y", at)
    value = F.when(F.col("_x").isNull(), None).when(at == 0, y1).when(at == F.size("_x"), y0).otherwise(y0 + (y1 - y0) * (F.col(p) - x0) / (x1 - x0))
    return met.select(*test.columns, value.alias(into))


def platt_curves(train: DataFrame, group: str, p: str = "p", label: str = "label", tolerance: float = 1e-10, most_steps: int = 100) -> DataFrame:
    """(group, slope, offset) of the logistic curve on the log-odds of every group."""
    rows = write_and_reread(train.where(F.col(group).isNotNull() & F.col(p).isNotNull() & F.col(label).isNotNull()).select(
        F.col(group).alias("group"), logit(F.col(p)).alias("x"), F.col(label).cast("double").alias("y")), "platt-rows")
    curves = rows.select("group").distinct().select("group", F.lit(1.0).alias("slope"), F.lit(0.0).alias("offset"))
    for _ in range(most_steps):
        q = 1.0 / (1.0 + F.exp(-(F.col("slope") * F.col("x") + F.col("offset"))))
        w = q * (1.0 - q)
        sums = rows.join(curves, "group").groupBy("group", "slope", "offset").agg(
            F.sum((F.col("y") - q) * F.col("x")).alias("a"), F.sum(F.col("y") - q).alias("b"), F.sum(w * F.col("x") * F.col("x")).alias("aa"),
            F.sum(w * F.col("x")).alias("ab"), F.sum(w).alias("bb"))
        g, h = F.col("a") - F.col("slope"), F.col("aa") + 1.0
        whole = h * F.col("bb") - F.col("ab") * F.col("ab")
        step = [F.try_divide(g * F.col("bb") - F.col("b") * F.col("ab"), whole), F.try_divide(h * F.col("b") - F.col("ab") * g, whole)]
        bounded = [F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.coalesce(s, F.lit(0.0)))) for s in step]
        curves = write_and_reread(sums.select("group", (F.col("slope") + bounded[0]).alias("slope"), (F.col("offset") + bounded[1]).alias("offset"),
                                              F.greatest(F.abs(bounded[0]), F.abs(bounded[1])).alias("_moved")), "platt-curves")
        moved = curves.agg(F.max("_moved")).first()[0]
        curves = curves.drop("_moved")
        if moved is None or moved <= tolerance:
            return curves
    raise RuntimeError(f"curves did not settle in {most_steps} steps")


def platt(train: DataFrame, test: DataFrame, group: str, p: str = "p", label: str = "label", into: str = "p_cal") -> DataFrame:
    """``test`` with calibrated probabilities; null for groups without training rows."""
    curves = platt_curves(train, group, p, label).withColumnRenamed("group", "_g")
    value = 1.0 / (1.0 + F.exp(-(F.col("slope") * logit(F.col(p)) + F.col("offset"))))
    return test.join(curves, F.col(group) == F.col("_g"), "left").select(*test.columns, value.alias(into))
