"""Older sources brought into the wide map schema: long per-player rows and per-map column blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faceoff.functions.scalar import player_label, short_label, slug_date, slug_game
from faceoff.operators.longform import STATS
from faceoff.session import write_and_reread

c = F.col


def _wide(slots: DataFrame, keys: list[str], values: list[str], *more: Column) -> DataFrame:
    """(keys, side, slot, values...) rows -> one row per key with team{side}_player{slot}_* columns; ``more`` aggregates go with them."""
    picks = []
    for side in (1, 2):
        for slot in range(1, 6):
            here = (c("side") == side) & (c("slot") == slot)
            for v in values:
                suffix = "" if v == "label" else f"_{v}"
                picks.append(F.max(F.when(here, c(v))).alias(f"team{side}_player{slot}{suffix}"))
    return slots.groupBy(*keys).agg(*more, *picks)


def _match_context(rows: DataFrame, best_of: Column | None = None) -> DataFrame:
    """games_played and series scores from the maps that were kept (a handful per match)."""
    match = Window.partitionBy("match_id")
    out = rows.withColumns({"games_played": F.count("*").over(match), "score1_match": F.sum(c("team1_win").cast("int")).over(match)})
    out = out.withColumn("score2_match", c("games_played") - c("score1_match"))
    return out if best_of is None else out.withColumn("bestOf", best_of)


def _one_row(rows: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """The last (or first) row of each key: by ``seq`` where there is one, else by the values."""
    order = F.struct("seq", *rows.columns) if "seq" in rows.columns else F.struct(*rows.columns)
    best = F.max_by if last else F.min_by
    return rows.groupBy(*keys).agg(best(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


def adapt_long_stats(overview: DataFrame, infos: DataFrame, players: DataFrame, match_ids: DataFrame) -> DataFrame:
    """One row per map from a source with one row per (map, player).

    Maps need at least ten player rows; each side keeps its five players with most kills (ties by
    player id). An id that the look-up tables repeat has its last row, a map that ``overview`` repeats its
    first; ``seq`` columns give the order, without one the values do.

    Labels are stored once, so that few of them are sent to the player rows. Player rows meet their match as one row that holds
    its maps, and go to the match's place for it; ranking, pivot and series scores then move nothing
    (hence a merge join, however small the look-up is).
    """
    players, match_ids = _one_row(players, ["ID"], True), _one_row(match_ids, ["ID"], True)
    overview = _one_row(overview, ["MatchID", "MapName"], False)
    people = write_and_reread(players.select(
        c("ID").alias("PlayerID"), player_label(c("NickName"), c("Name"), c("Country")).alias("label")), "labels")
    matches = overview.where(c("MapName").isNotNull()).groupBy("MatchID").agg(F.array_sort(F.collect_list(F.struct(
        "MapName", "Team1", "Team2", "Team1_Final_Score", "Team2_Final_Score", "Team1_Win"))).alias("_maps"))
    met = infos.join(people, "PlayerID", "left").join(matches.select(
        "MatchID", *[c(f"_maps.{n}").alias(f"_{n}") for n in ("MapName", "Team1", "Team2")]).hint("merge"), "MatchID")
    # a row without side counts for the ten, one of a team that plays itself has both sides
    met = met.withColumn("_at", (F.array_position("_MapName", c("MapName")) - 1).cast("int")).where("_at >= 0")
    sides = F.array_compact(F.array(*[F.when(c("TeamID") == F.get(f"_Team{n}", c("_at")), n) for n in (1, 2)]))
    key = ["MatchID", "_at"]
    slots = met.select(
        *key, c("PlayerID").alias("id"), "label", "Total_Kills", c("Total_Kills").cast("double").alias("kills"),
        c("Total_Deaths").cast("double").alias("deaths"), F.lit(None).cast("double").alias("assists"),
        c("Total_ADR").cast("double").alias("adr"), (c("Total_KAST").cast("double") * 100.0).alias("kast"),
        (c("Total_Kills") - c("Total_Deaths")).cast("double").alias("kddiff"), F.posexplode_outer(sides).alias("_copy", "side"))
    ranked = slots.withColumn(
        "slot", F.row_number().over(Window.partitionBy(*key, "side").orderBy(F.desc("Total_Kills"), "id")))
    wide = _wide(ranked, key, ["id", "label", *STATS, "kddiff"],
                 F.count_if(F.coalesce("_copy", F.lit(0)) == 0).alias("_n"), F.count("side").alias("_sided")).where("_n >= 10 AND _sided > 0")
    wide = wide.join(matches.join(match_ids.select(c("ID").alias("MatchID"), c("Tittle").alias("_slug")), "MatchID", "left"), "MatchID").withColumn(
        "_map", F.get("_maps", c("_at")))
    slug = F.coalesce("_slug", F.lit(""))
    event = F.when(F.contains(slug, F.lit("/")), F.regexp_extract(slug, r"(?s)^[^/]*/(.*)$", 1)).otherwise(slug)
    rows = wide.select(
        c("MatchID").alias("match_id"), F.concat_ws("-", c("MatchID").cast("string"), "_map.MapName").alias("game_id"),
        event.alias("tournament"), c("_map.Team1").alias("team1_id"), c("_map.Team2").alias("team2_id"),
        c("_map.Team1").cast("string").alias("team1"), c("_map.Team2").cast("string").alias("team2"),
        c("_map.Team1_Final_Score").alias("score1_game"), c("_map.Team2_Final_Score").alias("score2_game"),
        c("_map.MapName").alias("map_name"), slug_date(slug).alias("datetime"), c("_map.Team1_Win").cast("boolean").alias("team1_win"),
        F.lit(False).alias("is_total"), slug_game(slug).alias("game"),
        *[n for n in wide.columns if n.startswith("team")])
    return _match_context(rows, F.floor(c("games_played") / 2) * 2 + 1)


def adapt_block_stats(players: DataFrame, results: DataFrame) -> DataFrame:
    """One row per map from player rows that hold three map blocks side by side.

    The block is chosen by map name (the first that carries it), never by position in ``results``.
    Both sides need five players; the first five in file order (``seq``, one per row of a match) fill the slots.

    Player rows meet their match as one row that holds its games, and widen to rows per map only there: one shuffle of
    ``players`` and one of ``results`` on the match, none where they come by match (hence a merge join, however small the games are).
    Of games that repeat a map name the least gives the sides.
    """
    games = results.where(c("map_name").isNotNull()).groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct(
        "map_name", c("team_1").alias("team1"), c("team_2").alias("team2"), c("result_1").alias("score1_game"),
        c("result_2").alias("score2_game"), (c("map_winner") == 1).alias("team1_win")))).alias("_all"))
    games = games.withColumn("_names", F.array_distinct(c("_all.map_name"))).select("match_id", "_names", F.transform(
        "_names", lambda name: F.filter("_all", lambda g: g["map_name"] == name)).alias("_games"))
    names = [F.trim(c(f"map_{i}")) for i in (1, 2, 3)]

    def team(n: int) -> Column:
        return F.transform("_games", lambda g: F.get(g, F.lit(0))[f"team{n}"]).alias(f"_team{n}")

    met = players.join(games.select("match_id", "_names", team(1), team(2)).hint("merge"), "match_id")

    def block(i: int) -> Column:
        again = reduce(Column.__or__, [names[i].eqNullSafe(n) for n in names[:i]], F.lit(False))
        at = F.when(~again, F.array_position("_names", names[i]) - 1).cast("int")
        side = F.when(c("team") == F.get("_team1", at), 1).when(c("team") == F.get("_team2", at), 2)
        return F.struct(at.alias("_at"), side.alias("side"), *[c(f"m{i + 1}_{s}").cast("double").alias(s) for s in STATS])

    key = ["match_id", "_at"]
    sided = met.select(
        "match_id", "seq", short_label(c("player_name"), c("country")).alias("label"), "date", "event_name", "best_of",
        F.inline(F.array(*[block(i) for i in range(3)]))).where("side IS NOT NULL").withColumn(
        "slot", F.row_number().over(Window.partitionBy(*key, "side").orderBy("seq"))).withColumn("kddiff", c("kills") - c("deaths"))
    full = _wide(sided, key, ["label", *STATS, "kddiff"],
                 F.count_if(c("side") == 1).alias("_one"), F.count_if(c("side") == 2).alias("_two"),
                 F.min_by(F.struct("date", "event_name", "best_of"), "seq").alias("_m")).where("_one >= 5 AND _two >= 5")
    wide = full.join(games.select("match_id", "_games"), "match_id").select("*", F.explode(F.get("_games", c("_at"))).alias("_g"))
    rows = wide.select(
        "match_id", F.concat_ws("-", c("match_id").cast("string"), "_g.map_name").alias("game_id"),
        c("_m.event_name").alias("tournament"), c("_g.team1").alias("team1"), c("_g.team2").alias("team2"),
        c("_g.score1_game").alias("score1_game"), c("_g.score2_game").alias("score2_game"),
        (c("_g.score1_game") + c("_g.score2_game")).alias("rounds"), c("_g.map_name").alias("map_name"),
        c("_m.date").cast("string").alias("datetime"), c("_g.team1_win").alias("team1_win"), F.lit(False).alias("is_total"),
        F.lit("csgo").alias("game"), F.coalesce(c("_m.best_of").cast("int"), F.lit(0)).alias("bestOf"),
        *[n for n in wide.columns if n.startswith("team")])
    return _match_context(rows)
