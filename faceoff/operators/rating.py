"""Rating replay: every contest is predicted from the ratings as they stood before it.

A replay is a recurrence, so inside one pool the order of contests is a true dependency. What is
distributed and bounded here:

* pools (and K values) never exchange ratings and run in parallel;
* every pool is cut into time slices of ``slice_rows`` contests, which are replayed side by side, first from the snapshot, then
  from the ratings at which the slices before ended, until no start differs from what was used. The first pass settles
  the first slice, every further pass at least one more; where entities play often in a slice its end hardly depends on its start and a
  handful of passes settles all slices, however many. Only slices whose start moved are replayed again, and only the table of
  ratings (pool, slice, entity) passes between them, through the shared checkpoint folder;
* a contest depends only on the last contest of either side, so inside a slice the connected components
  of the graph of contests are independent. They are packed into lots, and the lots are replayed in parallel.

No task holds more than ``slice_rows`` contests at a time. Entities with about one contest per slice take the most passes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faceoff.functions.scalar import row_log_loss
from faceoff.operators.history import Timeline, with_position
from faceoff.session import require_columns, write_and_reread

K_VALUES = (8.0, 16.0, 32.0, 64.0)
BASE = 1500.0
SLICE_ROWS = 100_000
LOT_ROWS = 2_000
#: Rating points by which a slice's start may differ from the end before it; doubles near 1,500 are 2e-13 apart.
SETTLED = 1e-10
_ADDED = ("elo_t1_pre", "elo_t2_pre", "elo_t1_post", "elo_t2_post")


def _codes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of the first and the second sides, and the names they stand for; a null name is one like any other."""
    sides = pa.chunked_array([*rows["team1"].chunks, *rows["team2"].chunks], rows["team1"].type)
    coded = sides.combine_chunks().dictionary_encode(null_encoding="encode")
    codes = np.asarray(coded.indices)
    return codes[:len(rows)], codes[len(rows):], coded.dictionary


def _fold(rows: pa.Table, order: list[str], base: float, start: dict[str, float]) -> tuple[pa.Table, dict[str, float]]:
    """Replay one pool's slice in order: its rows with pre- and post-match ratings, and the ratings at its end."""
    rows = rows.sort_by([(c, "ascending") for c in order])
    if rows["k"].null_count:
        raise ValueError("a contest has no k")
    first, second, names = _codes(rows)
    names = names.to_pylist()
    ratings = [start.get(name, base) for name in names]
    results, ks = (np.asarray(rows[c], float).tolist() for c in ("result", "k"))
    out = [[], [], [], []]
    pre1, pre2, post1, post2 = (column.append for column in out)
    for a, b, s, k in zip(first.tolist(), second.tolist(), results, ks, strict=True):
        ra, rb = ratings[a], ratings[b]
        na = ra + k * (s - 1.0 / (1.0 + 10.0 ** ((rb - ra) / 400.0)))
        nb = rb + k * ((1.0 - s) - 1.0 / (1.0 + 10.0 ** ((ra - rb) / 400.0)))
        ratings[a], ratings[b] = na, nb
        pre1(ra), pre2(rb), post1(na), post2(nb)
    for name, column in zip(_ADDED, out, strict=True):
        rows = rows.append_column(name, pa.array(column, pa.float64()))
    return rows, start | dict(zip(names, ratings, strict=True))


def _state_of(table: pa.Table) -> dict[str, float]:
    return dict(zip(table["team"].to_pylist(), table["rating"].to_pylist(), strict=True))


def elo_replay(
    contests: DataFrame, pool: list[str], k: float = 32.0, base: float = BASE,
    order: tuple[str, ...] = ("datetime", "match_id"), snapshot: DataFrame | None = None,
    slice_rows: int | None = None, lot_rows: int = LOT_ROWS,
) -> DataFrame:
    """Walk-forward replay. ``pool`` names the columns that separate independent rating pools.

    Needs team1, team2 and either ``result`` (1.0 = side one won) or ``winner``; without a known winner
    side one did not win (0.0). A column ``k`` overrides the constant. ``snapshot(pool..., team, rating)`` seeds the ratings.
    Lots of components are filled up to ``lot_rows`` contests; a null pool or entity is one like any other.
    Adds elo_t1_pre, elo_t2_pre, elo_t1_post, elo_t2_post, p_t1, result, logloss, brier.
    """
    require_columns(contests, "team1", "team2", *order, *pool)
    if not pool:
        raise ValueError("name the pool columns explicitly; use one_pool() for a single pool")
    df = contests
    if "result" not in df.columns:
        require_columns(df, "winner")
        df = df.withColumn("result", (F.col("winner") == F.col("team1")).cast("double"))
    df = df.withColumn("result", F.coalesce(F.col("result").cast("double"), F.lit(0.0)))
    if "k" not in df.columns:
        df = df.withColumn("k", F.lit(float(k)))
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in _ADDED]])
    replayed = _replay_in_slices(df, pool, order, base, snapshot, slice_rows or SLICE_ROWS, lot_rows, schema)
    p = 1.0 / (1.0 + F.pow(F.lit(10.0), (F.col("elo_t2_pre") - F.col("elo_t1_pre")) / 400.0))
    return replayed.withColumn("p_t1", p).withColumns({
        "logloss": row_log_loss(F.col("p_t1"), F.col("result")),
        "brier": F.pow(F.col("p_t1") - F.col("result"), F.lit(2)),
    })


def _typed(snapshot: DataFrame, df: DataFrame, pool: list[str]) -> DataFrame:
    """The snapshot as pool columns, team and rating."""
    schema = T.StructType([*[df.schema[p] for p in pool], T.StructField("team", T.StringType()), T.StructField("rating", T.DoubleType())])
    return snapshot.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def components(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """The smallest entity number that each of ``n`` entities is connected to by contests."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[first], label[second])
        new = label.copy()
        np.minimum.at(new, first, least)
        np.minimum.at(new, second, least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _lots(lot_rows: int):
    """Appends to one slice of one pool the lot of each contest; a component is never parted."""
    def run(rows: pa.Table) -> pa.Table:
        first, second, names = _codes(rows)
        label = components(first, second, len(names))[first]
        _, of, size = np.unique(label, return_inverse=True, return_counts=True)
        lot = (np.cumsum(size) - size) // lot_rows
        return rows.append_column("_lot", pa.array(lot[of], pa.int64()))
    return run


def placed_in_slices(df: DataFrame, pool: list[str], order, slice_rows: int, lot_rows: int = LOT_ROWS) -> DataFrame:
    """The contests with ``_slice`` (time slice of the pool) and ``_lot`` (independent inside the slice)."""
    keys = {f"_key{i}": F.coalesce(F.concat(F.lit("="), F.col(p).cast("string")), F.lit("")) for i, p in enumerate(pool)}
    line = Timeline(tuple(keys), tuple(order), split=True)      # a pool is hot by nature; a null one is a pool
    cut = with_position(df.withColumns(keys), line, "_pos").withColumn(
        "_slice", F.floor((F.col("_pos") - 1) / slice_rows)).drop("_pos", *keys)
    schema = T.StructType([*cut.schema.fields, T.StructField("_lot", T.LongType())])
    return cut.groupBy(*pool, "_slice").applyInArrow(_lots(lot_rows), schema)


def _replay_in_slices(df, pool, order, base, snapshot, slice_rows, lot_rows, schema) -> DataFrame:
    rows = write_and_reread(placed_in_slices(df, pool, order, slice_rows, lot_rows), "replay-input")
    last = rows.agg(F.max("_slice")).first()[0]
    if last is None:                                             # no contests
        return df.sparkSession.createDataFrame([], schema)
    order_by, lots = list(order), [*pool, "_slice", "_lot"]

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        return _fold(left.drop_columns(["_slice", "_lot"]), order_by, base, _state_of(right))[0]

    sides = rows.select(*lots, F.explode(F.array("team1", "team2")).alias("team")).distinct()
    if snapshot is None:
        first = sides.withColumn("rating", F.lit(float(base)))
    else:
        first = sides.alias("l").join(_typed(snapshot, df, pool).alias("r"), _same([*pool, "team"]), "left").select(
            "l.*", F.coalesce("r.rating", F.lit(float(base))).alias("rating"))
    first = write_and_reread(first, "replay-first")
    starts = first if last == 0 else _settled_starts(rows, first, pool, order_by, base, int(last))
    return rows.groupBy(*lots).cogroup(starts.groupBy(*lots)).applyInArrow(step, schema)


def _settled_starts(rows: DataFrame, first: DataFrame, pool: list[str], order: list[str], base: float, last: int) -> DataFrame:
    """The rating of every entity at the start of each slice it plays in, from those before the first."""
    lots = [*pool, "_slice", "_lot"]
    slim = rows.select(*lots, *[o for o in order if o not in lots], "team1", "team2", "result", *(["k"] if "k" not in pool else []))
    before = Window.partitionBy(*pool, "team").orderBy("_slice")
    fields = [*[first.schema[n] for n in (*lots, "team")], *[T.StructField(n, T.DoubleType()) for n in ("first", "used", "rating")]]

    def end(left: pa.Table, right: pa.Table) -> pa.Table:
        used = _state_of(right)
        after = _fold(left, order, base, used)[1]
        out = right.rename_columns([*right.column_names[:-1], "used"])
        return out.append_column("rating", pa.array([after[t] for t in out["team"].to_pylist()], pa.float64()))

    moved, ends = first.withColumn("first", F.col("rating")).select(*lots, "team", "first", "rating"), None
    for _ in range(last + 1):                                    # slice n is settled by pass n at the latest
        again = slim if ends is None else _of_lots(slim, moved, lots)
        fresh = again.groupBy(*lots).cogroup(moved.groupBy(*lots)).applyInArrow(end, T.StructType(fields))
        if ends is not None:
            fresh = fresh.unionByName(_of_lots(ends, moved, lots, "left_anti"))
        ends = write_and_reread(fresh, "replay-ends")
        starts = write_and_reread(ends.withColumn("_start", F.coalesce(F.lag("rating").over(before), "first")).select(
            *lots, "team", "first", F.col("_start").alias("rating"), (F.abs(F.col("_start") - F.col("used")) > SETTLED).alias("_moved")), "replay-starts")
        if starts.where("_moved").isEmpty():
            break
        moved = _of_lots(starts.drop("_moved"), starts.where("_moved"), lots)
    return starts.select(*lots, "team", "rating")


def _of_lots(df: DataFrame, some: DataFrame, lots: list[str], how: str = "left_semi") -> DataFrame:
    return df.alias("l").join(some.select(*lots).distinct().alias("r"), _same(lots), how)


def _same(names: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names])


def final_ratings(replayed: DataFrame, pool: list[str],
                  order: tuple[str, ...] = ("datetime", "match_id")) -> DataFrame:
    """Latest post-match rating per (pool, entity); combined before the shuffle."""
    return post_long(replayed, [*pool, *[o for o in order if o not in pool]]).groupBy(*pool, "team").agg(
        F.max_by("elo", F.struct(*order)).alias("rating"))


def advance(state: DataFrame | None, replayed: DataFrame, pool: list[str], order) -> DataFrame:
    """The rating table after a slice: new ratings where an entity played, the old one elsewhere."""
    new = final_ratings(replayed, pool, order)
    if state is None:
        return new
    old = state.alias("l").join(new.alias("r"), _same([*pool, "team"]), "left_anti")
    return old.unionByName(new)


def post_long(replayed: DataFrame, keep: list[str]) -> DataFrame:
    """Two rows per contest with the rating after it."""
    return replayed.select(*keep, F.inline(F.array(
        F.struct(F.col("team1").alias("team"), F.col("elo_t1_post").alias("elo")),
        F.struct(F.col("team2").alias("team"), F.col("elo_t2_post").alias("elo")))))


def one_pool(df: DataFrame, name: str = "pool") -> DataFrame:
    """Declare that all contests share one rating pool."""
    return df.withColumn(name, F.lit("all"))


def with_k_values(df: DataFrame, ks=K_VALUES) -> DataFrame:
    """Repeat each contest per K value; (k, pool) then separates the replays."""
    return df.withColumn("k", F.explode(F.array(*[F.lit(float(x)) for x in ks])))


def map_results(maps: DataFrame) -> DataFrame:
    """Map rows with ``result`` by rounds where they differ, by the flag otherwise."""
    from faceoff.operators.clean import map_side1_won

    return maps.where(~F.col("is_total") & F.col("map_name").isNotNull()).dropna(
        subset=["team1", "team2"]).withColumn("result", map_side1_won().cast("double"))


def backtest_table(matches: DataFrame, maps: DataFrame, cutoff: str, ks=K_VALUES) -> DataFrame:
    """model x split losses: every K on the test side, K = 32 also on train, the per-map rating and 0.5."""
    from faceoff.operators.evaluate import score, with_split

    slim = one_pool(matches.select("match_id", "datetime", "team1", "team2", "winner"))
    by_k = elo_replay(with_k_values(slim, ks), ["pool", "k"]).select(
        F.concat(F.lit("elo_k"), F.col("k").cast("int").cast("string")).alias("model"), "datetime",
        F.col("p_t1").alias("p"), F.col("result").alias("y"))
    per_map = elo_replay(
        map_results(maps).select("match_id", "game_id", "datetime", "map_name", "team1", "team2", "result"),
        ["map_name"], order=("datetime", "match_id", "game_id"),
    ).select(F.lit("elo_mapspecific_k32").alias("model"), "datetime", F.col("p_t1").alias("p"), F.col("result").alias("y"))
    constant = matches.select(F.lit("constant_0.5").alias("model"), "datetime", F.lit(0.5).alias("p"),
                              (F.col("winner") == F.col("team1")).cast("double").alias("y"))
    rows = with_split(by_k.unionByName(per_map).unionByName(constant), cutoff)
    return score(rows.where("split = 'test' OR model = 'elo_k32'"), ["model", "split"])


def monthly_last(replayed: DataFrame, teams: int = 10) -> DataFrame:
    """Last post-match rating per (team, month) of the most active teams (ties by name)."""
    long = post_long(replayed, ["match_id", "datetime"])
    top = long.groupBy("team").count().orderBy(F.desc("count"), "team").limit(teams).select("team")
    return (
        long.join(top, "team", "left_semi")
        .groupBy("team", F.date_format("datetime", "yyyy-MM").alias("month"))
        .agg(F.max_by(F.struct("datetime", "elo"), F.struct("datetime", "match_id")).alias("_l"))
        .select("team", "month", "_l.datetime", "_l.elo")
    )


def elo_gap_buckets(replayed: DataFrame) -> DataFrame:
    """Upset rate by absolute rating gap; an equal gap counts side one as the favourite."""
    gap = F.abs(F.col("elo_t1_pre") - F.col("elo_t2_pre"))
    favourite = F.when(F.col("elo_t1_pre") >= F.col("elo_t2_pre"), F.col("team1")).otherwise(F.col("team2"))
    bucket = F.when(gap < 25, 1).when(gap < 50, 2).when(gap < 100, 3).otherwise(4)
    return replayed.groupBy(bucket.alias("elo_bucket")).agg(
        F.count("*").alias("n"),
        (1.0 - F.avg((F.col("winner") == favourite).cast("int"))).alias("upset_rate"))
