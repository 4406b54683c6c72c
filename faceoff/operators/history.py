"""Strictly-earlier history per entity: lags, rolling form, running totals, streaks.

All of it rests on two primitives.

``over_frame``     bounded look-back / look-ahead (``lag``, ``rowsBetween(-5, -1)``).
``prior_totals``   unbounded running sums, counts and maxima before each row.

Both plan one exchange and one sort on the entity key. A caller whose entities can be hot says so in
the Timeline: ``split=True`` cuts every entity into day chunks, ``hot_rows=n`` those with more than
n rows (a count per entity, combined before its shuffle). The windows then run per (entity, day),
and only one summary row per (entity, day) is ordered per entity. A bounded frame gets the few
neighbouring rows it needs copied into the chunk; a running total gets the sum of the earlier
chunks. The result is the same either way, and nothing is decided by the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Timeline:
    """Which rows form one history and in what order they happened."""

    keys: tuple[str, ...]
    order: tuple[str, ...] = ("datetime", "match_id")
    hot_rows: int | None = None    # entities with more rows are split
    grain: str = "day"
    split: bool = False            # every entity is split

    def by(self, *keys: str) -> "Timeline":
        return replace(self, keys=keys)


TEAM = Timeline(("team",))


@dataclass
class Frames:
    """Window builder handed to the expression callback."""

    keys: list[str]
    order: list[str]
    ordered: WindowSpec = field(init=False)

    def __post_init__(self) -> None:
        self.ordered = Window.partitionBy(*self.keys).orderBy(*self.order)

    def rows(self, start: int, end: int) -> WindowSpec:
        return self.ordered.rowsBetween(start, end)


def _hot_entities(df: DataFrame, line: Timeline) -> DataFrame | None:
    """The entities to split: all, those above ``hot_rows`` (at most rows / hot_rows of them), or none."""
    if line.split:
        return df.select(*line.keys).distinct()
    if line.hot_rows is None:
        return None
    return df.groupBy(*line.keys).count().where(F.col("count") > line.hot_rows).select(*line.keys)


def _with_chunks(df: DataFrame, hot: DataFrame, line: Timeline) -> DataFrame:
    """``_chunk``: the day for rows of hot entities, one constant chunk for the others."""
    marked = hot.withColumn("_hot", F.lit(True))
    day = F.date_trunc(line.grain, F.col(line.order[0]).cast("timestamp"))
    return df.join(marked, list(line.keys), "left").withColumn(
        "_chunk", F.when(F.col("_hot"), day).otherwise(F.lit(0).cast("timestamp"))
    ).drop("_hot")


def over_frame(
    df: DataFrame, line: Timeline, before: int, after: int,
    make: Callable[[Frames], dict[str, Column]],
) -> DataFrame:
    """Add window columns whose frames reach at most ``before`` rows back and ``after`` ahead."""
    keys, order = list(line.keys), list(line.order)
    hot = _hot_entities(df, line)
    if hot is None:
        return df.withColumns(make(Frames(keys, order)))

    rows = _with_chunks(df, hot, line)
    chunk_keys = [*keys, "_chunk"]
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    chunks = rows.groupBy(*chunk_keys).agg(F.count("*").alias("_n"))
    chunks = chunks.withColumns({
        "_start": F.coalesce(
            F.sum("_n").over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_end": F.sum("_n").over(by_chunk.rowsBetween(Window.unboundedPreceding, 0)),
    })
    chunks = chunks.withColumns({
        "_next": F.collect_list(F.struct("_chunk", "_start")).over(by_chunk.rowsBetween(1, max(before, 1))),
        "_prev": F.collect_list(F.struct("_chunk", "_end")).over(by_chunk.rowsBetween(-max(after, 1), -1)),
    }).drop("_n", "_end")
    placed = rows.join(chunks, chunk_keys).withColumn(
        "_pos", F.col("_start") + F.row_number().over(Window.partitionBy(*chunk_keys).orderBy(*order))
    )

    def target(chunk: Column, core: bool) -> Column:
        return F.struct(chunk.alias("_target"), F.lit(core).alias("_core"))

    later = F.filter("_next", lambda c: c["_start"] <= F.col("_pos") + (before - 1))
    earlier = F.filter("_prev", lambda c: c["_end"] >= F.col("_pos") - after)
    targets = F.concat(
        F.array(target(F.col("_chunk"), True)),
        F.transform(later, lambda c: target(c["_chunk"], False)),
        F.transform(earlier, lambda c: target(c["_chunk"], False)),
    )
    names = df.columns
    copied = placed.select(*names, F.inline(targets))
    made = make(Frames([*keys, "_target"], order))
    return copied.withColumns(made).where("_core").select(*names, *made)


_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def prior_totals(df: DataFrame, line: Timeline, totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running aggregates over all strictly earlier rows; ``{name: ("sum"|"max"|"min", expr)}``.

    Sums over no earlier row are 0, maxima and minima are null.
    """
    keys, order = list(line.keys), list(line.order)
    hot = _hot_entities(df, line)

    def exclusive(frame: WindowSpec, kind: str, value: Column) -> Column:
        out = _COMBINE[kind][0](value).over(frame)
        return F.coalesce(out, F.lit(0)) if kind == "sum" else out

    if hot is None:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: exclusive(frame, k, v) for n, (k, v) in totals.items()})

    rows = _with_chunks(df, hot, line)
    chunk_keys = [*keys, "_chunk"]
    before_chunk = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    chunks = rows.groupBy(*chunk_keys).agg(
        *[_COMBINE[k][0](v).alias(f"_c_{n}") for n, (k, v) in totals.items()])
    carried = chunks.select(*chunk_keys, *[
        exclusive(before_chunk, k, F.col(f"_c_{n}")).alias(f"_b_{n}")
        for n, (k, _) in totals.items()])
    inside = Window.partitionBy(*chunk_keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    local = rows.withColumns({f"_l_{n}": exclusive(inside, k, v) for n, (k, v) in totals.items()})
    joined = local.join(carried, chunk_keys)
    return joined.select(*df.columns, *[
        _COMBINE[k][1](F.col(f"_b_{n}"), F.col(f"_l_{n}")).alias(n) for n, (k, _) in totals.items()])


def with_position(df: DataFrame, line: Timeline, name: str = "pos") -> DataFrame:
    """1-based position in the entity's history."""
    return prior_totals(df, line, {name: ("sum", F.lit(1))}).withColumn(
        name, (F.col(name) + 1).cast("long"))


# ---- form, rest, head-to-head ---------------------------------------------------------------
def form_lag3(long: DataFrame, line: Timeline = TEAM) -> DataFrame:
    """Mean of up to three prior results; 0.5 before the first."""
    def make(f: Frames) -> dict[str, Column]:
        return {"form_win_share": F.coalesce(F.avg("win").over(f.rows(-3, -1)), F.lit(0.5))}
    return over_frame(long, line, 3, 0, make)


def rolling_form(long: DataFrame, n: int = 5, fill: float | None = None, line: Timeline = TEAM,
                 name: str = "form") -> DataFrame:
    """Mean of the last ``n`` results strictly before each row."""
    def make(f: Frames) -> dict[str, Column]:
        value = F.avg("win").over(f.rows(-n, -1))
        return {name: value if fill is None else F.coalesce(value, F.lit(fill))}
    return over_frame(long, line, n, 0, make)


def rolling_form_strict(long: DataFrame, n: int = 5, line: Timeline = TEAM) -> DataFrame:
    """As ``rolling_form`` but rows at the same instant do not see each other (0.5 before any).

    The first row of an instant sees exactly the rows before that instant, so its value is the
    value of all of them.
    """
    ts, ties = line.order[0], list(line.order[1:])
    seen = rolling_form(long, n, line=line, name="_seen")
    first = seen.groupBy(*line.keys, ts).agg(F.min_by("_seen", F.struct(*ties)).alias("form"))
    return long.join(first, [*line.keys, ts]).withColumn("form", F.coalesce("form", F.lit(0.5)))


def rest_days(long: DataFrame, line: Timeline = TEAM) -> DataFrame:
    """Whole and fractional days since the entity's previous contest; null for the first."""
    def make(f: Frames) -> dict[str, Column]:
        return {"_prev_ts": F.lag(line.order[0]).over(f.ordered)}
    micros = (F.unix_micros(F.col(line.order[0]).cast("timestamp"))
              - F.unix_micros(F.col("_prev_ts").cast("timestamp")))
    return over_frame(long, line, 1, 0, make).withColumns({
        "rest_whole_days": F.floor(micros / 86_400_000_000),
        "rest_days": micros / 86_400_000_000.0,
    }).drop("_prev_ts")


def h2h_before(df: DataFrame, line: Timeline = Timeline(("pair_a", "pair_b"))) -> DataFrame:
    """Earlier meetings of the same two entities: counts and side-one share (0.5 when none)."""
    a, b = F.least("team1", "team2"), F.greatest("team1", "team2")
    oriented = df.withColumns({
        "pair_a": a, "pair_b": b, "_a_win": (F.col("winner") == a).cast("int")})
    run = prior_totals(oriented, line, {
        "meetings_before": ("sum", F.lit(1)), "a_wins_before": ("sum", F.col("_a_win"))})
    share_a = F.when(F.col("meetings_before") > 0,
                     F.col("a_wins_before") / F.col("meetings_before")).otherwise(0.5)
    return run.withColumns({
        "b_wins_before": F.col("meetings_before") - F.col("a_wins_before"),
        "h2h_t1_win_share": F.when(F.col("team1") == F.col("pair_a"), share_a).otherwise(1.0 - share_a),
    }).drop("_a_win")


def conversion_after_form(long: DataFrame, n: int = 5, need: int = 3, line: Timeline = TEAM) -> DataFrame:
    """P(win | at least ``need`` of the previous ``n`` won), only where ``n`` earlier rows exist."""
    def make(f: Frames) -> dict[str, Column]:
        w = f.rows(-n, -1)
        return {"_w": F.sum("win").over(w), "_n": F.count("win").over(w)}
    return over_frame(long, line, n, 0, make).where(
        (F.col("_n") == n) & (F.col("_w") >= need)
    ).agg(F.avg("win").alias("conversion_after_good_form"))


def team_map_winrate(maps: DataFrame, line: Timeline | None = None) -> DataFrame:
    """Each side's win share on this map before now (0.5 without history), one row per map."""
    line = line or Timeline(("team", "map_name"), ("datetime", "match_id", "game_id"))
    flag = (F.col("team1_win") == 1).cast("int")
    long = maps.select("match_id", "game_id", "datetime", "map_name", F.inline(F.array(
        F.struct(F.lit(1).alias("side"), F.col("team1").alias("team"), flag.alias("win")),
        F.struct(F.lit(2).alias("side"), F.col("team2").alias("team"), (1 - flag).alias("win")))))
    run = prior_totals(long, line, {"_n": ("sum", F.lit(1)), "_w": ("sum", F.col("win"))})
    share = F.when(F.col("_n") > 0, F.col("_w") / F.col("_n")).otherwise(0.5)
    return run.withColumn("_wr", share).groupBy("match_id", "game_id").agg(
        F.max(F.when(F.col("side") == 1, F.col("_wr"))).alias("team1_map_wr"),
        F.max(F.when(F.col("side") == 2, F.col("_wr"))).alias("team2_map_wr"))


# ---- streaks --------------------------------------------------------------------------------
def _runs(long: DataFrame, line: Timeline) -> DataFrame:
    """One row per unbroken run of equal results.

    A run of wins is named by the number of losses before it (and the other way round), so the
    runs come out of one running total and one map-side combined aggregate.
    """
    named = prior_totals(long, line, {
        "_losses": ("sum", (F.col("win") == 0).cast("int")),
        "_wins": ("sum", (F.col("win") == 1).cast("int"))})
    island = F.when(F.col("win") == 1, F.col("_losses")).otherwise(F.col("_wins"))
    ts = line.order[0]
    return named.groupBy(*line.keys, "win", island.alias("_island")).agg(
        F.count("*").alias("streak_length"), F.min(ts).alias("streak_start"),
        F.max(ts).alias("streak_end"))


def win_streaks(long: DataFrame, at_least: int = 5, line: Timeline = TEAM) -> DataFrame:
    return _runs(long, line).where((F.col("win") == 1) & (F.col("streak_length") >= at_least)).select(
        *line.keys, "streak_length", "streak_start", "streak_end")


def longest_runs(long: DataFrame, line: Timeline = TEAM) -> DataFrame:
    """Longest winning and losing run per entity (0 when it never won or lost)."""
    def best(outcome: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("win") == outcome, F.col("streak_length"))), F.lit(0))
    return _runs(long, line).groupBy(*line.keys).agg(
        best(1).alias("longest_win_run"), best(0).alias("longest_loss_run"))


# ---- lineups --------------------------------------------------------------------------------
def sided_lineups(series: DataFrame) -> DataFrame:
    """Two rows per contest with the array of five player ids, null when any id is unknown."""
    def side(n: int) -> Column:
        ids = F.array(*[F.col(f"team{n}_player{i}_id") for i in range(1, 6)])
        known = ~F.exists(ids, lambda x: x.isNull())
        return F.struct(F.lit(n).alias("side"), F.col(f"team{n}").alias("team"),
                        F.when(known, F.array_distinct(ids)).alias("lineup"))
    return series.select("match_id", "datetime", F.inline(F.array(side(1), side(2))))


def roster_features(lineups: DataFrame, line: Timeline = TEAM) -> DataFrame:
    """Share of players kept from the last *known* lineup, and a stand-in flag (three or fewer).

    Unknown lineups are skipped, not remembered: they leave the window before it runs and come
    back with null features. Entities that are not split are read once: unknown lineups stay, in histories of their own.
    """
    whole = not line.split and line.hot_rows is None
    if whole:
        known, line = lineups.withColumn("_known", F.col("lineup").isNotNull()), line.by(*line.keys, "_known")
    else:
        known = lineups.where(F.col("lineup").isNotNull())

    def make(f: Frames) -> dict[str, Column]:
        return {"_last": F.lag("lineup").over(f.ordered)}

    shared = F.size(F.array_intersect("lineup", "_last"))
    scored = over_frame(known, line, 1, 0, make).select(
        "match_id", "side", "team",
        F.when(F.col("_last").isNotNull(), shared / 5.0).alias("stability"),
        F.when(F.col("_last").isNotNull(), (shared <= 3).cast("double")).alias("standin"))
    if whole:
        return scored
    unknown = lineups.where(F.col("lineup").isNull()).select(
        "match_id", "side", "team", F.lit(None).cast("double").alias("stability"),
        F.lit(None).cast("double").alias("standin"))
    return scored.unionByName(unknown)
