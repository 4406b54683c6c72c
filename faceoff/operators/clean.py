"""From raw game rows to one trustworthy row per contest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faceoff.session import require_columns

# The public column order of a cleaned contest.
CONTRACT_COLUMNS = (
    "match_id", "datetime", "tournament", "team1", "team2", "winner", "score1_match",
    "score2_match", "t1_series_score", "t2_series_score", "games_played", "bestOf",
)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``.

    An aggregate instead of a ranking window: partial results merge before the shuffle, so a key
    that holds a large share of all rows costs one row per upstream task.
    """
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return first.select(*[F.col(k) for k in keys], "_row.*").select(*df.columns)


def drop_missing_sides(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["team1", "team2"])


def winner_from_scores(df: DataFrame, s1: str = "score1_match", s2: str = "score2_match") -> DataFrame:
    """Higher contest score wins; a tie or an unknown score leaves the winner null."""
    a, b = F.col(s1).try_cast("double"), F.col(s2).try_cast("double")
    return df.withColumn(
        "winner", F.when(a > b, F.col("team1")).when(b > a, F.col("team2"))
    )


def map_side1_won(s1: str = "score1_game", s2: str = "score2_game", flag: str = "team1_win") -> Column:
    """Did side one win the map: by rounds where they are known and differ, by the flag otherwise."""
    a, b = F.col(s1).try_cast("double"), F.col(s2).try_cast("double")
    decided = a.isNotNull() & b.isNotNull() & (a != b)
    return F.when(decided, a > b).otherwise(F.coalesce(F.col(flag) == 1, F.lit(False)))


def map_winner_counts(maps: DataFrame) -> DataFrame:
    """Maps won per (match, team name)."""
    winner = F.when(map_side1_won(), F.col("team1")).otherwise(F.col("team2"))
    return (
        maps.select("match_id", winner.alias("team"))
        .dropna()
        .groupBy("match_id", "team")
        .agg(F.count("*").alias("maps_won"))
    )


def recover_winner(series: DataFrame, maps: DataFrame) -> DataFrame:
    """Fill winners (and both scores) missing on the summary row from the map rows.

    Only matches that need repair reach the map side: the semi-join runs before the aggregation.
    """
    missing = F.col("winner").isNull()
    wanted = series.where(missing).select("match_id")
    counts = map_winner_counts(maps.join(wanted, "match_id", "left_semi"))
    per_match = counts.groupBy("match_id").agg(
        F.map_from_entries(F.collect_list(F.struct("team", "maps_won"))).alias("_won")
    )
    w1 = F.coalesce(F.try_element_at("_won", F.col("team1")), F.lit(0))
    w2 = F.coalesce(F.try_element_at("_won", F.col("team2")), F.lit(0))
    repaired = missing & F.col("_won").isNotNull() & (w1 != w2)
    return (
        series.join(per_match, "match_id", "left")
        .withColumns({
            "t1_series_score": F.when(repaired, w1.cast("double")).otherwise(F.col("score1_match")),
            "t2_series_score": F.when(repaired, w2.cast("double")).otherwise(F.col("score2_match")),
            "winner": F.when(
                repaired, F.when(w1 > w2, F.col("team1")).otherwise(F.col("team2"))
            ).otherwise(F.col("winner")),
        })
        .drop("_won")
    )


def drop_invalid_series(df: DataFrame) -> DataFrame:
    """Drop rows without a winner and rows whose scores are known to contradict the map count."""
    contradicts = (F.col("t1_series_score") + F.col("t2_series_score")) != F.col(
        "games_played"
    ).try_cast("double")
    return df.where(F.col("winner").isNotNull() & ~F.coalesce(contradicts, F.lit(False)))


def finalize_series(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Public types and column order; ``games_played`` unknown means a single map."""
    whole = ["score1_match", "score2_match", "t1_series_score", "t2_series_score", "bestOf"]
    typed = df.withColumns({c: F.col(c).cast("long") for c in whole}).withColumn(
        "games_played", F.coalesce(F.col("games_played").try_cast("long"), F.lit(1).cast("long"))
    )
    return typed.select(*CONTRACT_COLUMNS, *extra)


def load_series(raw: DataFrame, extra: tuple[str, ...] = ("tier",)) -> DataFrame:
    """The flagship pipeline: raw rows -> one repaired, validated row per contest."""
    require_columns(raw, "match_id", "seq", "is_total", "team1", "team2", "score1_game")
    slim = [c for c in CONTRACT_COLUMNS if c in raw.columns] + ["seq", *extra]
    series = raw.where("is_total").select(*slim)
    maps = raw.where(~F.col("is_total"))
    first = drop_missing_sides(keep_first(series, ["match_id"], ["seq"]))
    return finalize_series(
        drop_invalid_series(recover_winner(winner_from_scores(first), maps)), extra
    )


def sorted_series(df: DataFrame) -> DataFrame:
    """Time order with an explicit tie-breaker; use only at a sink."""
    return df.orderBy("datetime", "match_id")


def canonicalize_names(df: DataFrame, aliases: DataFrame, columns=("team1", "team2", "winner")) -> DataFrame:
    """Replace names found (case-insensitively) in ``aliases(alias, canonical)``; keep the rest.

    The alias sheet is a join side, not a driver dict; Spark broadcasts it while it is small.
    """
    lookup = aliases.select(
        F.lower(F.trim("alias")).alias("_alias"), F.col("canonical").alias("_canonical")
    )
    lookup = lookup.groupBy("_alias").agg(F.min("_canonical").alias("_canonical"))
    for name in columns:
        df = (
            df.withColumn("_alias", F.lower(F.trim(F.col(name))))
            .join(lookup, "_alias", "left")
            .withColumn(name, F.coalesce("_canonical", name))
            .drop("_alias", "_canonical")
        )
    return df


def flag_forfeits(df: DataFrame) -> DataFrame:
    zero = [F.coalesce(F.col(c), F.lit(0)) == 0 for c in ("t1_series_score", "t2_series_score")]
    return df.withColumn(
        "is_forfeit", zero[0] & zero[1] & (F.coalesce(F.col("games_played"), F.lit(0)) >= 1)
    )


def winsorize(df: DataFrame, columns: list[str], lo: float = 0, hi: float = 25) -> DataFrame:
    """Clip to [lo, hi]; nulls stay null (greatest/least alone would replace them)."""
    return df.withColumns({
        c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(hi)), F.lit(lo)))
        for c in columns
    })


def trusted_maps(maps: DataFrame) -> DataFrame:
    """Map rows whose round direction and winner flag agree."""
    by_rounds = F.col("score1_game") > F.col("score2_game")
    return maps.where(~F.col("is_total") & (by_rounds == (F.col("team1_win") == 1)))


def derive_series(df: DataFrame) -> DataFrame:
    a, b = F.col("t1_series_score"), F.col("t2_series_score")
    swept = ((a == 0) | (b == 0)) & (F.col("games_played") >= 2)
    return df.withColumns({
        "total_maps": a + b,
        "margin": F.abs(a - b),
        "is_bo1": F.col("games_played") == 1,
        "swept": swept,
        "bo5_sweep": (F.col("bestOf") == 5) & swept,
    })


def row_assertions(df: DataFrame) -> DataFrame:
    """Violation counts of the contract in one pass plus one distinct count."""
    wrong = ~F.coalesce(F.col("winner").isin(F.col("team1"), F.col("team2")), F.lit(False))
    per_id = df.groupBy("match_id").agg(
        F.count("*").alias("_n"),
        F.count_if(wrong).alias("_outside"),
        F.count_if(F.coalesce(
            F.col("t1_series_score") + F.col("t2_series_score") != F.col("games_played"),
            F.lit(False))).alias("_score"),
    )
    return per_id.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("_outside"), F.lit(0)).alias("winner_outside_pair"),
        F.count_if(F.col("_n") > 1).alias("duplicate_ids"),
        F.coalesce(F.sum("_score"), F.lit(0)).alias("score_mismatch"),
    )


def window_filter(
    df: DataFrame, start: str | None = None, end: str | None = None, maps: list[str] | None = None,
    events: list[str] | None = None, tiers: list[str] | None = None, games: list[str] | None = None,
    map_col: str = "map_name", event_col: str = "tournament",
) -> DataFrame:
    """Independent optional filters, all plain predicates, so parquet scans can apply them."""
    kind = df.schema["datetime"].dataType
    if start:
        df = df.where(F.col("datetime") >= F.lit(start).cast(kind))
    if end:
        last = F.lit(end).cast(kind) + F.expr("INTERVAL '23:59' HOUR TO MINUTE")
        df = df.where(F.col("datetime") <= last)
    if maps:
        df = df.where(F.lower(map_col).isin([m.lower() for m in maps]))
    if events:
        hit = F.lit(False)
        for needle in events:
            hit = hit | F.contains(F.lower(event_col), F.lit(needle.lower()))
        df = df.where(hit)
    if tiers:
        df = df.where(F.col("tier").isin(tiers))
    if games:
        df = df.where(F.lower("game").isin([g.lower() for g in games]))
    return df


def tier_of_match(tagged: DataFrame) -> DataFrame:
    """match -> tier when several tier files list the match: the lowest tier wins."""
    return tagged.groupBy("match_id").agg(F.min("tier").alias("tier"))


def profile_missing(df: DataFrame) -> DataFrame:
    """Share of nulls per column, only columns that have any."""
    names = df.columns
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in names])
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_share")) for c in names
    ])
    return wide.select(F.inline(pairs)).where("null_share > 0")


def lineup_of_match(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Per match the first non-null value of every column, map rows before the summary row."""
    order = F.struct("is_total", "datetime", F.coalesce("game_id", F.lit(0)), "seq")
    return raw.groupBy("match_id").agg(*[
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns
    ])


def assert_one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join two frames that must both be unique on ``key``; a duplicate fails the job.

    The check is an aggregate on the join key, so it shares the join's shuffle.
    """
    def guarded(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        n = F.count("*")
        checked = df.groupBy(key).agg(
            F.any_value(F.struct(*rest)).alias("_row"), n.alias("_n")
        )
        fail = F.raise_error(F.concat(F.lit("duplicate key "), F.col(key).cast("string")))
        return checked.select(
            F.when(F.col("_n") > 1, fail).otherwise(F.col(key)).cast(df.schema[key].dataType).alias(key),
            "_row.*",
        )

    return guarded(left).join(guarded(right), key, how)


def orient_to_team(df: DataFrame, team: str) -> DataFrame:
    """Contest rows of one team from its own viewpoint (needs the rating columns)."""
    home = F.col("team1") == team
    won = F.col("winner") == team

    def pick(a, b):
        return F.when(home, a).otherwise(b)

    us = pick(F.col("t1_series_score"), F.col("t2_series_score"))
    them = pick(F.col("t2_series_score"), F.col("t1_series_score"))
    return df.where((F.col("team1") == team) | (F.col("team2") == team)).select(
        "match_id", "datetime", F.col("tournament").alias("event"), "tier",
        F.col("bestOf").alias("bo"), pick(F.col("team2"), F.col("team1")).alias("opponent"),
        won.alias("won"), us.alias("score_for"), them.alias("score_against"),
        F.col("games_played").alias("maps_played"),
        pick(F.col("elo_t1_pre"), F.col("elo_t2_pre")).alias("elo"),
        pick(F.col("elo_t2_pre"), F.col("elo_t1_pre")).alias("opp_elo"),
        pick(F.col("p_t1"), 1.0 - F.col("p_t1")).alias("p_win"),
        (won & (them == 0)).alias("swept"),
        (F.col("games_played") == F.col("bestOf")).alias("went_the_distance"),
        (them - us).alias("loss_margin"),
    )


def orient_maps(maps: DataFrame, team: str) -> DataFrame:
    """Map rows of one team from its own viewpoint, with five-slot totals and means."""
    home = F.col("team1") == team

    def pick(a, b):
        return F.when(home, a).otherwise(b)

    def slots(stat):
        return F.array(*[
            pick(F.col(f"team1_player{i}_{stat}"), F.col(f"team2_player{i}_{stat}"))
            for i in range(1, 6)
        ])

    def total(stat):
        return F.aggregate(slots(stat), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))

    def mean(stat):
        known = F.filter(slots(stat), lambda x: x.isNotNull())
        return F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.size(known))

    base = maps.where((F.col("team1") == team) | (F.col("team2") == team)).where(
        ~F.col("is_total") & F.col("map_name").isNotNull()
    )
    out = base.select(
        "match_id", "game_id", "datetime", F.col("tournament").alias("event"),
        pick(F.col("team2"), F.col("team1")).alias("opponent"),
        pick(F.col("team2_id"), F.col("team1_id")).alias("opponent_id"),
        "map_name", F.col("bestOf").alias("bo"), (home == (F.col("team1_win") == 1)).alias("won"),
        pick(F.col("score1_game"), F.col("score2_game")).alias("rounds_for"),
        pick(F.col("score2_game"), F.col("score1_game")).alias("rounds_against"),
        total("kills").alias("team_kills"), total("deaths").alias("team_deaths"),
        total("assists").alias("team_assists"), mean("adr").alias("team_adr"),
        kast_fraction(mean("kast")).alias("team_kast"),
    )
    return out.withColumns({
        "round_diff": F.col("rounds_for") - F.col("rounds_against"),
        "total_rounds": F.col("rounds_for") + F.col("rounds_against"),
        "overtime": (F.col("rounds_for") + F.col("rounds_against")) > 24,
        "close": F.abs(F.col("rounds_for") - F.col("rounds_against")) <= 2,
        "team_kddiff": F.col("team_kills") - F.col("team_deaths"),
    })


def kast_fraction(value: Column) -> Column:
    """The source mixes 0-100 and 0-1; values above 1.5 are percentages."""
    return F.when(value > 1.5, value / 100.0).otherwise(value)


def alias_names(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Convenience for a handful of aliases given as a dict."""
    spark = df.sparkSession
    rows = [(k, v) for k, v in mapping.items()]
    return canonicalize_names(df, spark.createDataFrame(rows, "alias string, canonical string"))
