"""Global order statistics without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_position(df: DataFrame, ts: str, ties: list[str], grain: str = "day",
                    name: str = "position") -> DataFrame:
    """1-based rank in (ts, ties) order.

    Only the per-chunk counts (one row per day) are ordered in a single task; the rows are ranked
    inside their chunk. Pass a finer ``grain`` when a day is too large for one task.
    """
    chunk = F.date_trunc(grain, F.col(ts).cast("timestamp"))
    rows = df.withColumn("_chunk", chunk)
    counts = rows.groupBy("_chunk").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_chunk").orderBy(ts, *ties)
    ranked = rows.withColumn("_rank", F.row_number().over(inside))
    return ranked.join(offsets, ranked["_chunk"].eqNullSafe(offsets["_chunk"])).select(
        *df.columns, (F.col("_before") + F.col("_rank")).cast("long").alias(name))


def dense_index(df: DataFrame, key: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Number distinct keys 0..n-1 (per ``by``) in (md5 prefix, key) order.

    The keys fall into 4096 hash chunks; only the chunk counts are accumulated per ``by``.
    """
    rows = df.withColumn("_chunk", F.substring(F.md5(F.col(key).cast("string")), 1, 3))
    counts = rows.groupBy(*by, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_chunk").orderBy(key)
    return rows.join(offsets, [*by, "_chunk"]).select(
        *df.columns, (F.col("_before") + F.row_number().over(inside) - 1).cast("long").alias(name))


def last_k(df: DataFrame, keys: list[str], order: list[str], k: int, name: str = "back") -> DataFrame:
    """The last ``k`` rows per key. Spark trims every key to ``k`` rows before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn(name, F.row_number().over(newest)).where(F.col(name) <= k)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
                    accuracy: int = 10_000, few: bool = False) -> DataFrame:
    """Exact, linearly interpolated quantiles per key: columns keys, prob, value.

    A mergeable rank sketch per key (memory follows ``accuracy``, not the rows) gives two splitters
    around every wanted rank. Its rank error is bounded, so what lies between two splitters is
    about six rows in ``accuracy`` of the key's, whatever the values are; only those are ranked.
    Rows below a splitter are counted. Keys with fewer than two times ``accuracy`` rows are ranked whole.
    A sketch depends on the order in which its parts arrive, so rows meet it once: what is counted and what
    is ranked see the same splitters. ``few`` says that the keys are a handful: their splitters are sent to the rows.
    """
    probs = sorted(probs)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    margin = 3.0 / accuracy
    ends = sorted({0.0, 1.0, *(min(max(p + d, 0.0), 1.0) for p in probs for d in (-margin, margin))})
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("_total"), F.percentile_approx("_v", ends, accuracy).alias("_e"))
    small = F.col("_total") < 2 * accuracy

    def splitter(p: float, otherwise: float) -> Column:
        at = ends.index(min(max(p, 0.0), 1.0))
        return F.when(small, F.get("_e", F.lit(ends.index(otherwise)))).otherwise(F.get("_e", F.lit(at)))

    spans = sketch.select(*keys, "_total", *[splitter(p - margin, 0.0).alias(f"_lo{i}") for i, p in enumerate(probs)],
                          *[splitter(p + margin, 1.0).alias(f"_hi{i}") for i, p in enumerate(probs)])
    near = _join(rows, F.broadcast(spans) if few else spans, keys)
    # splitters rise with their rank: a row is above the first ``_past`` spans, in the next up to ``_met``, below the others
    past = sum((F.col("_v") > F.col(f"_hi{i}")).cast("int") for i in range(len(probs)))
    met = sum((F.col("_v") >= F.col(f"_lo{i}")).cast("int") for i in range(len(probs)))
    placed = near.select(*keys, "_total", "_v", past.alias("_past"), met.alias("_met"))
    counted = placed.groupBy(*keys, "_past", "_met", F.when(F.col("_past") < F.col("_met"), F.col("_v")).alias("_v")).agg(
        F.first("_total").alias("_total"), F.count("*").alias("_n"))
    # one row per span and value in it, and one without value for all that lies below the span
    spread = counted.where(F.col("_past") < len(probs)).select(
        *keys, "_total", "_n", "_met", "_v", F.explode(F.sequence("_past", F.lit(len(probs) - 1))).alias("_i"))
    summed = spread.groupBy(*keys, "_i", F.when(F.col("_i") < F.col("_met"), F.col("_v")).alias("_v")).agg(
        F.first("_total").alias("_total"), F.sum("_n").alias("_n"))
    inside = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = summed.withColumns({"_upto": F.sum("_n").over(inside), "prob": F.get(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i"))})
    # ranks covered by a value: (_upto - _n, _upto]; wanted ranks are 1-based positions
    target = (F.col("_total") - 1) * F.col("prob")
    low, high = F.floor(target) + 1, F.ceil(target) + 1

    def covers(rank: Column) -> Column:
        return (rank > F.col("_upto") - F.col("_n")) & (rank <= F.col("_upto"))

    hits = ranked.groupBy(*keys, "prob").agg(
        F.max(F.when(covers(low), F.col("_v"))).alias("_a"), F.max(F.when(covers(high), F.col("_v"))).alias("_b"),
        F.max(target - F.floor(target)).alias("_w"))
    missed = F.raise_error(F.lit("a wanted rank lies outside its splitters"))
    return hits.select(*keys, "prob", F.when(F.col("_a").isNull() | F.col("_b").isNull(), missed.cast("double")).otherwise(
        F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias("value"))


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys) if keys else left.crossJoin(right)
