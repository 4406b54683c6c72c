"""Player statistics over ``player_long`` rows, for all players at once or a filtered few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faceoff.functions.scalar import name_key, normalize_name, render_number, render_share
from faceoff.operators.history import Timeline, prior_totals

c = F.col


def aggregates(long: DataFrame, by: list[str] = ("player_key",)) -> DataFrame:
    """Maps, totals, K/D, mean ADR and KAST, kills per round, window, events, map win rate.

    Kills per round divides all kills by the rounds that are known, as published.
    """
    by = list(by)
    measures = [
        F.count("*").alias("maps"), F.sum("kills").alias("kills"), F.sum("deaths").alias("deaths"),
        F.coalesce(F.sum("assists"), F.lit(0.0)).alias("assists"), F.avg("adr").alias("adr"), F.avg("kast").alias("kast"),
        F.coalesce(F.sum("rounds"), F.lit(0.0)).alias("rounds"), F.count("rounds").alias("scored_maps"),
        F.min("datetime").alias("window_start"), F.max("datetime").alias("window_end"),
        F.countDistinct("event").alias("events"), F.avg(c("won").cast("int")).alias("map_win_rate")]
    out = long.groupBy(*by).agg(*measures) if by else long.agg(*measures)
    return out.withColumns({
        "kd": c("kills") / F.nullif(c("deaths"), F.lit(0.0)), "kpr": c("kills") / F.nullif(c("rounds"), F.lit(0.0))})


def by_map(long: DataFrame, keys: list[str] = ("player_key",)) -> DataFrame:
    return aggregates(long, [*keys, "map_name"]).select(
        *keys, c("map_name").alias("map"), "maps", "kd", "adr", "kast", "kpr", c("map_win_rate").alias("win_rate"))


def by_event(long: DataFrame, min_maps: int = 5, keys: list[str] = ("player_key",)) -> DataFrame:
    """Events with enough maps; start and end are those of the event itself."""
    return aggregates(long, [*keys, "event"]).where(c("maps") >= min_maps).select(
        *keys, "event", "maps", "kd", "adr", "kast", c("window_start").alias("start"), c("window_end").alias("end"))


def shared_maps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Maps on which both players were present: one inner join on the map."""
    fields = ["event", "map_name", "datetime", "team", "won", "adr", "kills", "deaths"]

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select("match_id", "game_id", *[c(f).alias(f"{f}_{tag}") for f in fields])

    return side(a, "a").join(side(b, "b"), ["match_id", "game_id"]).select(
        "match_id", "game_id", F.to_date("datetime_a").alias("date"), c("event_a").alias("event"),
        c("map_name_a").alias("map"), F.when(c("won_a"), "A").otherwise("B").alias("result"),
        "won_a", "won_b", "adr_a", "adr_b", "kills_a", "kills_b", "deaths_a", "deaths_b",
        (c("kills_a") / F.nullif(c("deaths_a"), F.lit(0.0))).alias("a_kd"),
        (c("kills_b") / F.nullif(c("deaths_b"), F.lit(0.0))).alias("b_kd"),
        (c("team_a") == c("team_b")).alias("same_team"))


def head_to_head(shared: DataFrame) -> DataFrame:
    def kd(tag: str) -> Column:
        return F.sum(f"kills_{tag}") / F.greatest(F.sum(f"deaths_{tag}"), F.lit(1.0))

    return shared.agg(
        F.count("*").alias("maps"), F.count_if("won_a").alias("a_map_wins"), F.count_if("won_b").alias("b_map_wins"),
        F.avg("adr_a").alias("a_adr"), F.avg("adr_b").alias("b_adr"), kd("a").alias("a_kd"), kd("b").alias("b_kd"),
        F.avg(c("same_team").cast("int")).alias("same_team_share"))


def comparison_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row ``aggregates`` as (metric, a, b) text lines; the metric names are fixed values."""
    whole = lambda n: lambda t: F.format_string("%d", c(f"{n}_{t}").cast("long"))
    lines: list[tuple[str, object]] = [
        ("Maps played", whole("maps")), ("Kills", whole("kills")), ("Deaths", whole("deaths")),
        ("Assists", whole("assists")), ("K/D", lambda t: render_number(c(f"kd_{t}"), 2)),
        ("ADR", lambda t: render_number(c(f"adr_{t}"), 1)), ("KAST", lambda t: render_share(c(f"kast_{t}"))),
        ("Kills per round", lambda t: render_number(c(f"kpr_{t}"), 3)),
        ("Map win rate", lambda t: render_share(c(f"map_win_rate_{t}"))), ("Events", whole("events"))]
    one = a.select(*[c(n).alias(f"{n}_a") for n in a.columns]).crossJoin(
        b.select(*[c(n).alias(f"{n}_b") for n in b.columns]))      # one-row frames
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), fn("a").alias("a"), fn("b").alias("b")) for name, fn in lines])))


def display_labels(long: DataFrame, corrected: DataFrame | None = None) -> DataFrame:
    """player_key -> label: corrected spelling, else long form, newer source, most frequent, smallest."""
    counts = long.groupBy("player_key", "player", (c("game") == "cs2").alias("_new")).agg(F.count("*").alias("_n"))
    rich = F.contains(c("player"), F.lit("("))
    best = counts.groupBy("player_key").agg(
        F.min_by("player", F.struct(~rich, ~c("_new"), -c("_n"), c("player"))).alias("label"))
    if corrected is None:
        return best
    fixed = corrected.groupBy("player_key").agg(F.max("corrected").alias("_fixed"))
    return best.join(fixed, "player_key", "left").select("player_key", F.coalesce("_fixed", "label").alias("label"))


def name_counts(long: DataFrame, fragment: str | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Maps per identity. A fragment keeps identities whose label contains it, whose nickname is
    it, or whose label has a curated alias that contains it."""
    counted = long.groupBy("player_key").agg(F.count("*").alias("maps")).join(display_labels(long), "player_key")
    if fragment is not None:
        needle = name_key(F.lit(fragment))
        nick = name_key(F.substring_index("label", " (", 1))
        keep = F.contains(F.lower("label"), F.lit(fragment.lower())) | (nick == needle)
        if aliases is not None:
            curated = aliases.where(F.contains(name_key(c("alias")), needle)).select(
                c("canonical").alias("label")).distinct().withColumn("_curated", F.lit(True))
            counted = counted.join(curated, "label", "left")
            keep = keep | F.coalesce("_curated", F.lit(False))
        counted = counted.where(keep)
    return counted.select("player_key", "label", "maps")


def lineup_players(rows: DataFrame, value: str = "_id") -> DataFrame:
    """Ten rows per contest: side, team, player (id or label column by suffix)."""
    slots = F.array(*[
        F.struct(F.lit(n).alias("side"), F.col(f"team{n}").alias("team"),
                 F.col(f"team{n}_player{i}{value}").cast("string").alias("player"))
        for n in (1, 2) for i in range(1, 6)])
    return rows.select("match_id", "datetime", F.inline(slots))


def asof_tenure(slots: DataFrame, joins: DataFrame, recent_days: int = 30,
                line: Timeline = Timeline(("_team", "player"), ("_ts", "_kind", "_id"))) -> DataFrame:
    """Days since each lineup player's latest join of that team, as per-contest side differences.

    ``slots`` are ``lineup_players`` rows, ``joins`` (team, player, date). The as-of join is a
    running maximum over the union of both in time order; on a tie the join comes first.
    """
    known = slots.where(c("player").isNotNull())
    facts = joins.select(normalize_name(c("team")).alias("_team"), c("player").cast("string").alias("player"),
                         c("date").alias("_ts"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_id"),
                         F.lit(None).cast("int").alias("side"), c("date").alias("_join"))
    asks = known.select(normalize_name(c("team")).alias("_team"), "player", c("datetime").alias("_ts"),
                        F.lit(1).alias("_kind"), c("match_id").alias("_id"), "side",
                        F.lit(None).cast(joins.schema["date"].dataType).alias("_join"))
    seen = prior_totals(facts.unionByName(asks), line, {"_last": ("max", c("_join"))}).where("_kind = 1")
    micros = lambda n: F.unix_micros(c(n).cast("timestamp"))
    days = F.floor((micros("_ts") - micros("_last")) / 86_400_000_000)
    sides = seen.where(c("_last").isNotNull()).groupBy(c("_id").alias("match_id"), "side").agg(
        F.min(days).cast("double").alias("tmin"), F.avg(days).alias("tavg"),
        F.sum((days <= recent_days).cast("double")).alias("recent"))
    wide = sides.groupBy("match_id").agg(*[
        F.max(F.when(c("side") == n, c(f))).alias(f"{f}{n}") for f in ("tmin", "tavg", "recent") for n in (1, 2)])
    share = slots.groupBy("match_id").agg((F.count("player") / F.lit(10.0)).alias("lineup_known"))
    return share.join(wide, "match_id", "left").select(
        "match_id", (c("tmin1") - c("tmin2")).alias("tenure_min_diff"), (c("tavg1") - c("tavg2")).alias("tenure_avg_diff"),
        (c("recent1") - c("recent2")).alias("recent_join_diff"),
        (c("tmin1").isNotNull() & c("tmin2").isNotNull()).cast("double").alias("tenure_known"), "lineup_known")
