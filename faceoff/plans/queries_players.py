"""Registered queries: players, names, older sources, files, text, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from faceoff.functions import scalar as X
from faceoff.operators import longform, names, players
from faceoff.plans.queries_history import r6
from faceoff.plans.registry import Contests, query
from faceoff.session import shared_folder
from faceoff.sources import adapters, derived, files, text

c_ = F.col

def _entry(n: int, i: int) -> str:
    p = f"team{n}_player{i}"
    stats = ", ".join(f"{s} := {p}_{s}" for s in ("kills", "deaths", "assists", "adr"))
    return (f"struct_pack(side := 'team{n}', slot := {i}, team := team{n}, player := {p}, won := team1_win {'=' if n == 1 else '<>'} 1, {stats}, "
            f"kast := CASE WHEN {p}_kast > 1.5 THEN {p}_kast / 100 ELSE {p}_kast END, player_key := 'p' || {p}_id || '|' || lower(substr(team{n}, 1, 2)))")


PL = ("pq AS (SELECT match_id, game_id, datetime, tournament AS event, map_name, game, score1_game + score2_game AS rounds, unnest(["
      + ", ".join(_entry(n, i) for n in (1, 2) for i in range(1, 6))
      + "]) AS s FROM map_rows), px AS (SELECT * EXCLUDE (s), s.* FROM pq WHERE s.player IS NOT NULL)")


def player_rows(c: Contests):
    return c.stored("players", lambda: longform.player_long(c.map_rows()))


@query("player_long", f"WITH {PL} SELECT match_id, game_id, side, CAST(slot AS INT) AS slot, team, player, won, kills, deaths, assists, adr, ROUND(kast, 6) AS kast, rounds, player_key FROM px")
def _(c: Contests):
    return longform.player_long(c.map_rows()).select(
        "match_id", "game_id", "side", "slot", "team", "player", "won", "kills", "deaths", "assists", "adr", *r6("kast"), "rounds", "player_key")


@query("kast_fraction", f"WITH {PL} SELECT game, COUNT(*) AS n, ROUND(MIN(kast), 6) AS lo, ROUND(MAX(kast), 6) AS hi FROM px GROUP BY game")
def _(c: Contests):
    return player_rows(c).groupBy("game").agg(
        F.count("*").alias("n"), F.round(F.min("kast"), 6).alias("lo"), F.round(F.max("kast"), 6).alias("hi"))


AGG = """COUNT(*) AS maps, SUM(kills) AS kills, SUM(deaths) AS deaths, COALESCE(SUM(assists), 0) AS assists, ROUND(SUM(kills) / NULLIF(SUM(deaths), 0), 6) AS kd, ROUND(AVG(adr), 6) AS adr,
ROUND(AVG(kast), 10) AS kast, ROUND(SUM(kills) / NULLIF(SUM(rounds), 0), 6) AS kpr, SUM(rounds) AS rounds, COUNT(rounds) AS scored_maps, MIN(datetime) AS window_start, MAX(datetime) AS window_end,
COUNT(DISTINCT event) AS events, ROUND(AVG(CAST(won AS INT)), 6) AS map_win_rate"""


@query("player_aggregates", f"WITH {PL} SELECT player_key, {AGG} FROM px GROUP BY player_key")
def _(c: Contests):
    return players.aggregates(player_rows(c)).withColumns({n: F.round(n, 10 if n == "kast" else 6) for n in ("kd", "adr", "kast", "kpr", "map_win_rate")})


@query("player_by_map", f"WITH {PL} SELECT player_key, map, maps, kd, adr, kast, kpr, map_win_rate AS win_rate FROM (SELECT player_key, map_name AS map, {AGG} FROM px GROUP BY 1, 2)")
def _(c: Contests):
    return players.by_map(player_rows(c)).withColumns({n: F.round(n, 10 if n == "kast" else 6) for n in ("kd", "adr", "kast", "kpr", "win_rate")})


@query("player_by_event", f"WITH {PL} SELECT player_key, event, maps, kd, adr, kast, s AS start, e AS \"end\" FROM (SELECT player_key, event, {AGG}, MIN(datetime) AS s, MAX(datetime) AS e FROM px GROUP BY player_key, event) WHERE maps >= 5")
def _(c: Contests):
    return players.by_event(player_rows(c)).withColumns({n: F.round(n, 10 if n == "kast" else 6) for n in ("kd", "adr", "kast")})


A_KEY, B_KEY = "p301|na", "p1202|na"
SHARED = f"sh AS (SELECT a.match_id, a.game_id, a.datetime, a.event, a.map_name, a.won AS aw, b.won AS bw, a.adr AS aa, b.adr AS ba, a.kills AS ak, b.kills AS bk, a.deaths AS ad, b.deaths AS bd, a.team = b.team AS st FROM px a JOIN px b USING (match_id, game_id) WHERE a.player_key = '{A_KEY}' AND b.player_key = '{B_KEY}')"


def _pair(c: Contests):
    rows = player_rows(c)
    return players.shared_maps(rows.where(c_("player_key") == A_KEY), rows.where(c_("player_key") == B_KEY))


@query("shared_maps", f"WITH {PL}, {SHARED} SELECT match_id, game_id, CAST(datetime AS DATE) AS date, event, map_name AS map, CASE WHEN aw THEN 'A' ELSE 'B' END AS result, aa AS adr_a, ba AS adr_b, ROUND(ak / NULLIF(ad, 0), 6) AS a_kd, ROUND(bk / NULLIF(bd, 0), 6) AS b_kd, st AS same_team FROM sh")
def _(c: Contests):
    return _pair(c).select("match_id", "game_id", "date", "event", "map", "result", "adr_a", "adr_b", *r6("a_kd", "b_kd"), "same_team")


@query("head_to_head", f"WITH {PL}, {SHARED} SELECT COUNT(*) AS maps, COUNT(*) FILTER (WHERE aw) AS a_map_wins, COUNT(*) FILTER (WHERE bw) AS b_map_wins, ROUND(AVG(aa), 6) AS a_adr, ROUND(AVG(ba), 6) AS b_adr, ROUND(SUM(ak) / GREATEST(SUM(ad), 1), 6) AS a_kd, ROUND(SUM(bk) / GREATEST(SUM(bd), 1), 6) AS b_kd, ROUND(AVG(CAST(st AS INT)), 6) AS same_team_share FROM sh")
def _(c: Contests):
    out = players.head_to_head(_pair(c))
    return out.withColumns({n: F.round(n, 6) for n in ("a_adr", "b_adr", "a_kd", "b_kd", "same_team_share")})


@query("shared_maps_last", f"WITH {PL}, {SHARED} SELECT game_id, CAST(back AS INT) AS back FROM (SELECT game_id, ROW_NUMBER() OVER (ORDER BY CAST(datetime AS DATE) DESC, game_id DESC) AS back FROM sh) WHERE back <= 15")
def _(c: Contests):
    from faceoff.operators.ordering import last_k
    return last_k(_pair(c).withColumn("pair", F.lit(1)), ["pair"], ["date", "game_id"], 15).select("game_id", "back")


@query("comparison_rows", f"""WITH {PL}, g AS (SELECT player_key, {AGG} FROM px WHERE player_key IN ('{A_KEY}', '{B_KEY}') GROUP BY 1),
t AS (SELECT player_key, [('Maps played', CAST(maps AS VARCHAR)), ('Kills', CAST(CAST(kills AS BIGINT) AS VARCHAR)), ('Deaths', CAST(CAST(deaths AS BIGINT) AS VARCHAR)), ('Assists', CAST(CAST(assists AS BIGINT) AS VARCHAR)), ('K/D', format('{{:.2f}}', kd)), ('ADR', format('{{:.1f}}', adr)),
('KAST', format('{{:.1f}}', kast * 100) || '%'), ('Kills per round', format('{{:.3f}}', kpr)), ('Map win rate', format('{{:.1f}}', map_win_rate * 100) || '%'), ('Events', CAST(events AS VARCHAR))] AS l FROM g),
u AS (SELECT player_key, unnest(l) AS r FROM t)
SELECT a.r[1] AS metric, a.r[2] AS a, b.r[2] AS b FROM u a JOIN u b ON a.r[1] = b.r[1] WHERE a.player_key = '{A_KEY}' AND b.player_key = '{B_KEY}'""")
def _(c: Contests):
    rows = player_rows(c)
    a, b = (players.aggregates(rows.where(c_("player_key") == k), []) for k in (A_KEY, B_KEY))
    return players.comparison_rows(a, b)


SHEET = """sheet AS (SELECT DISTINCT player AS dataset_string, 'Імя «' || split_part(player, ' (', 1) || '» Прізвище ' || player_key AS native_name,
CASE WHEN player_key LIKE 'p1%' THEN 'Fixed ' || player_key END AS corrected_latin FROM px WHERE player LIKE '%(%')"""


def player_names(c: Contests):
    """The distinct names and their keys: all that name lists read of the rows per player and map."""
    slots = F.explode(F.array(*[f"team{n}_player{i}" for n in (1, 2) for i in range(1, 6)]))
    return c.stored("names", lambda: c.map_rows().select(slots.alias("player")).where(F.trim("player") != "").distinct().withColumn(
        "player_key", X.key_of(c_("player"))))


def name_sheet(c: Contests):
    rows = player_names(c).where(F.contains("player", F.lit("(")))
    return rows.select(
        c_("player").alias("dataset_string"),
        F.concat(F.lit("Імя «"), F.substring_index("player", " (", 1), F.lit("» Прізвище "), "player_key").alias("native_name"),
        F.when(F.startswith("player_key", F.lit("p1")), F.concat(F.lit("Fixed "), "player_key")).alias("corrected_latin")).distinct()


@query("display_labels", f"""WITH {PL}, {SHEET}, n AS (SELECT player_key, player, game, COUNT(*) AS k FROM px GROUP BY 1, 2, 3),
b AS (SELECT player_key, player, ROW_NUMBER() OVER (PARTITION BY player_key ORDER BY player NOT LIKE '%(%', game <> 'cs2', k DESC, player) AS r FROM n)
SELECT b.player_key, COALESCE(s.corrected_latin, b.player) AS label FROM b LEFT JOIN (SELECT DISTINCT player_key, corrected_latin FROM sheet JOIN px ON dataset_string = player) s ON s.player_key = b.player_key WHERE r = 1""")
def _(c: Contests):
    return players.display_labels(player_rows(c), files.corrected_labels(name_sheet(c)))


@query("name_counts", f"""WITH {PL}, n AS (SELECT player_key, player, game, COUNT(*) AS k FROM px GROUP BY 1, 2, 3),
b AS (SELECT player_key, player AS label, ROW_NUMBER() OVER (PARTITION BY player_key ORDER BY player NOT LIKE '%(%', game <> 'cs2', k DESC, player) AS r FROM n)
SELECT b.player_key, label, m.maps FROM b JOIN (SELECT player_key, COUNT(*) AS maps FROM px GROUP BY 1) m ON m.player_key = b.player_key WHERE r = 1 AND label ILIKE '%name 1%'""")
def _(c: Contests):
    return players.name_counts(player_rows(c), "NAME 1")


REQUESTS = """
rq AS (SELECT DISTINCT trim(r) AS request FROM (
  SELECT player AS r FROM px UNION ALL SELECT '  ' || upper(player) FROM px UNION ALL SELECT split_part(split_part(player, ' (', 1), ',', 1) FROM px
  UNION ALL SELECT 'name ' || substr(player, 2, 2) FROM px UNION ALL SELECT substr(player, 3, 4) FROM px
  UNION ALL SELECT native_name FROM sheet UNION ALL SELECT 'прізвище ' || split_part(native_name, ' ', 4) FROM sheet UNION ALL SELECT 'fixed' FROM sheet
  UNION ALL SELECT 'nobody ' || n_name FROM nation))"""


def requests(c: Contests):
    rows, sheet, nation = player_names(c).select("player"), name_sheet(c), c.table("nation")
    p, n = c_("player"), c_("native_name")
    parts = [
        rows.select(p), rows.select(F.concat(F.lit("  "), F.upper(p))),
        rows.select(F.substring_index(F.substring_index(p, " (", 1), ",", 1)),
        rows.select(F.concat(F.lit("name "), F.substring(p, 2, 2))), rows.select(F.substring(p, 3, 4)), sheet.select(n),
        sheet.select(F.concat(F.lit("прізвище "), F.get(F.split(n, " "), F.lit(3)))), sheet.select(F.lit("fixed")),
        nation.select(F.concat(F.lit("nobody "), "n_name"))]
    out = parts[0].toDF("request")
    for part in parts[1:]:
        out = out.union(part.toDF("request"))
    return out


@query("resolve_names", f"""WITH {PL}, {SHEET}, {REQUESTS}, nm AS (SELECT DISTINCT player, player_key FROM px),
al AS (SELECT DISTINCT dataset_string AS canonical, lower(trim(regexp_replace(translate(regexp_replace(replace(a, '_', ' '), '[«„"“”''‘’]([^«»„“”"''‘’]*)[»“”''’]', ' ', 'g'), '«»„“”"‘’''', ''), '\\s+', ' ', 'g'))) AS k
       FROM (SELECT dataset_string, native_name AS a FROM sheet UNION ALL SELECT dataset_string, corrected_latin FROM sheet) WHERE a IS NOT NULL),
rk AS (SELECT request, lower(trim(regexp_replace(translate(regexp_replace(replace(request, '_', ' '), '[«„"“”''‘’]([^«»„“”"''‘’]*)[»“”''’]', ' ', 'g'), '«»„“”"‘’''', ''), '\\s+', ' ', 'g'))) AS k FROM rq),
h AS (SELECT request, 1 AS tier, player AS nm, player AS id FROM rq JOIN nm ON player = request
  UNION ALL SELECT request, 2, player, player FROM (SELECT request, MIN(player) AS player FROM rq JOIN nm ON lower(player) = lower(request) GROUP BY 1 HAVING COUNT(DISTINCT player) = 1)
  UNION ALL SELECT request, 3, player, player_key FROM rq JOIN nm ON lower(split_part(player, ' (', 1)) = lower(request)
  UNION ALL SELECT request, 4, player, player_key FROM rq JOIN nm ON contains(lower(player), lower(request))
  UNION ALL SELECT request, 5, canonical, canonical FROM rk JOIN al ON al.k = rk.k
  UNION ALL SELECT request, 6, canonical, canonical FROM rk JOIN al ON rk.k <> '' AND (contains(al.k, rk.k) OR list_has_all(string_split(al.k, ' '), string_split(rk.k, ' ')))),
g AS (SELECT request, tier, MIN(nm) AS resolved, COUNT(DISTINCT id) AS ids, COUNT(DISTINCT nm) AS n FROM h GROUP BY 1, 2),
f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY request ORDER BY tier) AS r FROM g)
SELECT rq.request, CASE WHEN ids = 1 THEN resolved END AS resolved, CASE WHEN ids IS NULL THEN 'missing' WHEN ids = 1 THEN 'ok' ELSE 'ambiguous' END AS status, tier, COALESCE(n, 0) AS n_matches
FROM rq LEFT JOIN f ON f.request = rq.request AND r = 1""")
def _(c: Contests):
    return names.resolve_names(requests(c), player_names(c), files.name_aliases(name_sheet(c)))


@query("asof_tenure", """
WITH sl AS (""" + " UNION ALL ".join(
    f"SELECT match_id, datetime, {n} AS side, team{n} AS team, team{n}_player{i}_id AS player FROM series_rows WHERE seq = 1" for n in (1, 2) for i in range(1, 6)) + """),
tj AS (SELECT s.match_id, s.side, (epoch_us(s.datetime) - epoch_us(t.date)) // 86400000000 AS d FROM (SELECT * FROM sl WHERE player IS NOT NULL AND team IS NOT NULL) s
       ASOF JOIN transfers t ON t.player = s.player AND lower(t.to_team) = lower(s.team) AND t.date <= s.datetime),
sd AS (SELECT match_id, side, CAST(MIN(d) AS DOUBLE) AS a, AVG(d) AS b, CAST(COUNT(*) FILTER (WHERE d <= 30) AS DOUBLE) AS c FROM tj GROUP BY 1, 2),
kn AS (SELECT match_id, COUNT(player) / 10.0e0 AS k FROM sl GROUP BY 1)
SELECT kn.match_id, x.a - y.a AS tenure_min_diff, ROUND(x.b - y.b, 6) AS tenure_avg_diff, x.c - y.c AS recent_join_diff, CAST(x.a IS NOT NULL AND y.a IS NOT NULL AS DOUBLE) AS tenure_known, k AS lineup_known
FROM kn LEFT JOIN sd x ON x.match_id = kn.match_id AND x.side = 1 LEFT JOIN sd y ON y.match_id = kn.match_id AND y.side = 2""")
def _(c: Contests):
    slots = players.lineup_players(c.series_rows().where("seq = 1"))
    joins = c.derive("transfers").select(c_("to_team").alias("team"), "player", "date")
    return players.asof_tenure(slots, joins).withColumn("tenure_avg_diff", F.round("tenure_avg_diff", 6))


# ---- older sources --------------------------------------------------------------------------
SLUG = """CAST(match_id AS VARCHAR) || '/' || lower(tournament) || CASE match_id % 5 WHEN 0 THEN '-fall-2023' WHEN 1 THEN '-spring-2024-finals' WHEN 2 THEN '-2019' WHEN 3 THEN '-Winter-120245' ELSE '-open' END"""
YEAR_SQL = "NULLIF(regexp_extract({s}, '(^|[^0-9])(20[0-2][0-9])([^0-9]|$)', 2), '')"
SEASON_SQL = "lower(regexp_extract({s}, '(?i)\\b(winter|spring|summer|fall|autumn)\\b', 1))"


def slug_sql(s: str) -> tuple[str, str, str]:
    year, season = YEAR_SQL.format(s=s), SEASON_SQL.format(s=s)
    game = f"CASE WHEN CAST({year} AS INT) >= 2024 OR ({year} = '2023' AND {season} IN ('fall', 'autumn', 'winter')) THEN 'cs2' ELSE 'csgo' END"
    day = f"CASE {season} WHEN 'winter' THEN '01-15' WHEN 'spring' THEN '04-15' WHEN 'summer' THEN '07-15' WHEN 'fall' THEN '10-15' WHEN 'autumn' THEN '10-15' ELSE '07-01' END"
    return f"CAST({year} AS INT)", game, f"COALESCE({year} || '-' || {day}, '')"


def _slug(match_id="match_id"):
    return F.expr(SLUG.replace("VARCHAR", "STRING").replace("match_id", match_id))


Y_, G_, D_ = slug_sql("slug")


@query("slug_functions", f"SELECT match_id, slug, {Y_} AS year, {G_} AS game, {D_} AS date FROM (SELECT match_id, {SLUG} AS slug FROM pairing)")
def _(c: Contests):
    s = c_("slug")
    return c.derive("pairing").select("match_id", _slug().alias("slug")).select(
        "match_id", "slug", X.slug_year(s).alias("year"), X.slug_game(s).alias("game"), X.slug_date(s).alias("date"))


LONG_SLOTS = "sl AS (" + " UNION ALL ".join(
    f"SELECT match_id, game_id, map_name || ' ' || (game_id - match_id * 100) AS mn, {n} AS side, team{n}_id AS tid, team{n}_player{i}_id AS id, team{n}_player{i}_kills AS kills, team{n}_player{i}_deaths AS deaths, team{n}_player{i}_adr AS adr, "
    f"CASE WHEN team{n}_player{i}_kast > 1.5 THEN team{n}_player{i}_kast / 100 ELSE team{n}_player{i}_kast END AS kast FROM map_rows"
    for n in (1, 2) for i in range(1, 6)) + ")"
COUNTRY = "CASE {x} % 5 WHEN 0 THEN 'Denmark' WHEN 1 THEN ' UKRAINE ' WHEN 2 THEN 'United States' WHEN 3 THEN 'Atlantis' END"
CODE = "CASE {x} % 5 WHEN 0 THEN 'DK' WHEN 1 THEN 'UA' WHEN 2 THEN 'US' END"
F_Y, F_G, F_D = slug_sql("slug")


def _by_match(maps, match: str):
    """Maps by match in as many parts as shuffles have: parts are not merged by their narrow size, since their rows widen there."""
    return maps.repartition(int(maps.sparkSession.conf.get("spark.sql.shuffle.partitions")), match)


def long_source(c: Contests):
    """The derived maps in the layout of the long per-player source."""
    def with_name(maps):
        return derived.map_rows(maps).withColumn("MapName", F.concat_ws(" ", "map_name", (c_("game_id") - c_("match_id") * 100).cast("string")))

    # the narrow maps go to their match's place before they widen to ten rows of players
    maps = with_name(_by_match(c.maps(), "match_id"))
    overview = maps.select(
        c_("match_id").alias("MatchID"), "MapName", c_("team1_id").alias("Team1"), c_("team2_id").alias("Team2"),
        c_("score1_game").cast("int").alias("Team1_Final_Score"), c_("score2_game").cast("int").alias("Team2_Final_Score"),
        (c_("team1_win") == 1).alias("Team1_Win"))
    slots = F.array(*[
        F.struct(c_(f"team{n}_id").alias("TeamID"), c_(f"team{n}_player{i}_id").alias("PlayerID"),
                 c_(f"team{n}_player{i}_kills").alias("Total_Kills"), c_(f"team{n}_player{i}_deaths").alias("Total_Deaths"),
                 c_(f"team{n}_player{i}_adr").alias("Total_ADR"), c_(f"team{n}_player{i}_kast").alias("k"))
        for n in (1, 2) for i in range(1, 6)])

    def players(maps):
        return maps.select(c_("match_id").alias("MatchID"), "MapName", F.inline(slots)).where("PlayerID IS NOT NULL").withColumn(
            "Total_KAST", F.when(c_("k") > 1.5, c_("k") / 100).otherwise(c_("k"))).drop("k")

    people = players(with_name(c.maps())).select(c_("PlayerID").alias("ID")).distinct().select(
        "ID", F.concat(F.lit("P"), "ID").alias("NickName"),
        F.concat(F.lit("Name 'P"), "ID", F.lit("' No"), "ID").alias("Name"), F.expr(COUNTRY.format(x="ID")).alias("Country"))
    ids = c.pairing().select(c_("match_id").alias("ID"), _slug().alias("Tittle"))
    return overview, players(maps), people, ids


@query("adapt_long_stats", f"""WITH {LONG_SLOTS}, rk AS (SELECT *, COUNT(*) OVER (PARTITION BY game_id) AS n, ROW_NUMBER() OVER (PARTITION BY game_id, side ORDER BY kills DESC, id) AS slot FROM sl WHERE id IS NOT NULL),
w AS (SELECT game_id, MAX(mn) AS mn, MAX(id) FILTER (WHERE side = 1 AND slot = 1) AS a, MAX(kills) FILTER (WHERE side = 1 AND slot = 1) AS ak, MAX(id) FILTER (WHERE side = 2 AND slot = 5) AS b, MAX(kast * 100) FILTER (WHERE side = 2 AND slot = 5) AS bk,
      MAX(kills - deaths) FILTER (WHERE side = 2 AND slot = 3) AS kd FROM rk WHERE n = 10 GROUP BY 1),
m AS (SELECT r.match_id, w.*, r.team1_win, r.score1_game, slug, COUNT(*) OVER (PARTITION BY r.match_id) AS gp, SUM(r.team1_win) OVER (PARTITION BY r.match_id) AS s1
      FROM w JOIN map_rows r USING (game_id) JOIN (SELECT match_id, {SLUG} AS slug FROM pairing) p ON p.match_id = r.match_id)
SELECT match_id, match_id || '-' || mn AS game_id, split_part(slug, '/', 2) AS tournament, {F_D} AS datetime, {F_G} AS game, CAST(score1_game AS INT) AS score1_game, gp AS games_played, (gp // 2) * 2 + 1 AS "bestOf",
CAST(s1 AS BIGINT) AS score1_match, a AS team1_player1_id, 'P' || a || ' (Name No' || a || ')' || COALESCE(', ' || {CODE.format(x='a')}, '') AS team1_player1, ak AS team1_player1_kills, b AS team2_player5_id, ROUND(bk, 6) AS team2_player5_kast, kd AS team2_player3_kddiff FROM m""")
def _(c: Contests):
    return adapters.adapt_long_stats(*long_source(c)).select(
        "match_id", "game_id", "tournament", "datetime", "game", "score1_game", "games_played", "bestOf", "score1_match",
        "team1_player1_id", "team1_player1", "team1_player1_kills", "team2_player5_id", *r6("team2_player5_kast"), "team2_player3_kddiff")


def block_source(c: Contests):
    """The derived maps in the layout of the source with three map blocks per player row."""
    k = c_("game_id") - c_("match_id") * 100 - 1
    # the narrow maps go to their new match's place before they widen to players: grouping these moves nothing
    maps = derived.map_rows(_by_match(c.maps().withColumn("mm", c_("match_id") * 10 + F.floor(k / 3)), "mm"), "mm").withColumns({
        "block": (k % 3 + 1).cast("int"), "mn": F.concat_ws(" ", "map_name", (k + 1).cast("string"))})
    fields = ["kills", "deaths", "assists", "adr", "kast"]
    slots = [(n, i) for n in (1, 2) for i in range(1, 6)]
    # maps of a match and lineup meet as one row; its ten slots become rows after that
    stats = F.array(*[F.struct(*[c_(f"team{n}_player{i}_{f}").alias(f) for f in fields]) for n, i in slots])
    lineups = maps.groupBy(c_("match_id").alias("own"), "mm", "team1", "team2", F.array(*[c_(f"team{n}_player{i}_id") for n, i in slots]).alias("pids")).agg(
        F.min(F.to_date("datetime")).alias("date"), F.min("tournament").alias("event_name"), F.min("bestOf").alias("best_of"),
        *[F.max(F.when(c_("block") == i, F.struct("mn", stats.alias("stats")))).alias(f"b{i}") for i in (1, 2, 3)])
    at = lambda values: F.get(F.array(*values), c_("at"))
    people = lineups.select("*", F.posexplode("pids").alias("at", "pid")).where("pid IS NOT NULL").select(
        c_("mm").alias("match_id"), at([F.lit(n * 10 + i) for n, i in slots]).alias("seq"),
        F.when(c_("at") < 5, c_("team1")).otherwise(c_("team2")).alias("team"), "pid", "date", "event_name", "best_of",
        *[c_(f"b{i}.mn").alias(f"map_{i}") for i in (1, 2, 3)],
        *[F.get(f"b{i}.stats", c_("at"))[f].alias(f"m{i}_{f}") for i in (1, 2, 3) for f in fields]).withColumns({
            "player_name": F.concat(F.lit(" P"), "pid"), "country": F.expr(COUNTRY.format(x="pid"))})
    results = maps.select(
        c_("mm").alias("match_id"), c_("mn").alias("map_name"), c_("team1").alias("team_1"), c_("team2").alias("team_2"),
        c_("score1_game").cast("int").alias("result_1"), c_("score2_game").cast("int").alias("result_2"),
        F.when(c_("team1_win") == 1, 1).otherwise(2).alias("map_winner"))
    return people, results


@query("adapt_block_stats", f"""WITH b AS (SELECT *, game_id - match_id * 100 AS k, match_id * 10 + (game_id - match_id * 100 - 1) // 3 AS mm FROM map_rows WHERE team1_player1_id IS NOT NULL)
SELECT mm AS match_id, mm || '-' || map_name || ' ' || k AS game_id, tournament, strftime(datetime, '%Y-%m-%d') AS datetime, CAST(score1_game + score2_game AS INT) AS rounds, COUNT(*) OVER (PARTITION BY mm) AS games_played,
CAST(SUM(team1_win) OVER (PARTITION BY mm) AS BIGINT) AS score1_match, CAST(bestOf AS INT) AS "bestOf", 'P' || team1_player1_id || COALESCE(', ' || {CODE.format(x='team1_player1_id')}, '') AS team1_player1, team1_player1_kills, team2_player5_assists, team2_player4_kast,
team2_player4_kills - team2_player4_deaths AS team2_player4_kddiff FROM b""")
def _(c: Contests):
    return adapters.adapt_block_stats(*block_source(c)).select(
        "match_id", "game_id", "tournament", "datetime", "rounds", "games_played", "score1_match", "bestOf", "team1_player1",
        "team1_player1_kills", "team2_player5_assists", "team2_player4_kast", "team2_player4_kddiff")


# ---- files ----------------------------------------------------------------------------------
def _path(c: Contests, name: str) -> str:
    import uuid
    return f"{shared_folder(c.spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_sink", "SELECT match_id, datetime, team1, winner, games_played FROM matches")
def _(c: Contests):
    out = c.matches().select("match_id", "datetime", "team1", "winner", "games_played")
    path = _path(c, "csv")
    files.write_csv(out, path)
    return c.spark.read.schema(out.schema).option("header", True).csv(path)


@query("json_sink", "SELECT tier, COUNT(*) AS n, ROUND(AVG(games_played), 6) AS avg_maps, CAST(NULL AS VARCHAR) AS note FROM matches GROUP BY tier")
def _(c: Contests):
    out = c.matches().groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("games_played"), 6).alias("avg_maps")).withColumn(
        "note", F.lit(None).cast("string"))
    path = _path(c, "json")
    files.write_json(out, path)
    return c.spark.read.schema(out.schema).json(path)


@query("store_round_trip", "SELECT match_id, tier, games_played = 1 AS is_bo1 FROM matches WHERE tier = 'tier2'")
def _(c: Contests):
    from faceoff.plans.queries_evaluate import store
    path, built = _path(c, "store"), store(c)
    files.write_store(built, path)
    return files.read_store(c.spark, path, built.schema).where("tier = 'tier2'").select("match_id", "tier", "is_bo1")


@query("scan_ratings", """WITH r AS (SELECT n_name AS team, 1500 + n_nationkey * 7.5e0 AS rating FROM nation)
SELECT 'flat' AS shape, * FROM r UNION ALL SELECT 'nested', * FROM r UNION ALL SELECT 'list', * FROM r""")
def _(c: Contests):
    rows = c.table("nation").select(c_("n_name").alias("team"), (1500 + c_("n_nationkey") * 7.5).alias("rating"))
    pairs = rows.agg(F.map_from_entries(F.collect_list(F.struct("team", "rating"))).alias("m"))      # the file format: one object
    flat = pairs.select(F.lit("flat").alias("shape"), F.to_json("m").alias("value"))
    nested = pairs.select(F.lit("nested"), F.concat(F.lit('{"ratings": '), F.to_json("m"), F.lit("}")))
    listed = pairs.select(F.lit("list"), F.to_json(F.transform(F.map_entries("m"), lambda e: F.struct(
        e["key"].alias("name"), e["value"].alias("elo")))))
    return files.parse_ratings(flat.union(nested).union(listed)).select("shape", "team", "rating")


@query("scan_odds", "SELECT CAST(date AS VARCHAR) AS date, team1, team2, ROUND(odds1, 6) AS odds1, ROUND(odds2, 6) AS odds2 FROM odds WHERE match_id % 29 <> 0")
def _(c: Contests):
    path = _path(c, "odds")
    priced = F.when(c_("match_id") % 29 == 0, "n/a").otherwise(c_("odds1").cast("string"))
    files.write_csv(c.derive("odds").select(
        c_("date").cast("string").alias("Match_Date"), c_("team1").alias("Home"), c_("team2").alias("Away"), F.lit("x").alias("bookmaker"),
        priced.alias("Home_Odds"), c_("odds2").cast("string").alias("Away_Odds")), path)
    return files.scan_odds(c.spark, path).select("date", "team1", "team2", *r6("odds1", "odds2"))


@query("scan_name_sheet", f"WITH {PL}, {SHEET} SELECT dataset_string AS canonical, native_name AS alias FROM sheet UNION ALL SELECT dataset_string, corrected_latin FROM sheet WHERE corrected_latin IS NOT NULL")
def _(c: Contests):
    path = _path(c, "sheet")
    sheet = name_sheet(c).select(F.lit("x").alias("﻿country"), "dataset_string", "native_name", "corrected_latin")
    sheet.coalesce(1).write.option("header", True).option("quoteAll", True).csv(path)
    return files.name_aliases(files.scan_name_sheet(c.spark, path)).select("canonical", "alias")


# ---- text -----------------------------------------------------------------------------------
PAGE = """'== Page ==\n{{Transfer Row|date=' || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '2024-03-0' || (doc_id % 9 + 1) END || '|name=Nick' || doc_id || ' |flag=' || lang || CASE WHEN doc_id % 3 = 0 THEN '|name2=Other' || doc_id || '|flag2=ua|role2=coach' ELSE '' END
|| '|team1=' || source || '|team2 = Team ' || doc_id % 11 || '|role1=rifler|note}}' || text || '{{Transfer Row|date=2023-01-01|date=2023-01-02\n|name=Late' || doc_id || '|name5=Five|team2=A=B}}'"""


@query("extract_transfers", f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all({PAGE}, '(?s)\\{{\\{{Transfer Row\\|(.*?)\\}}\\}}', 1)) AS b FROM documents),
f AS (SELECT doc_id, b, list_transform(list_filter(string_split(b, '|'), lambda x: contains(x, '=')), lambda x: struct_pack(k := trim(split_part(x, '=', 1)), v := trim(substr(x, strpos(x, '=') + 1)))) AS kv FROM t),
g AS (SELECT doc_id, {", ".join(f"COALESCE(list_filter(kv, lambda x: x.k = '{k}')[-1].v, '') AS {k}" for k in ("date", "team1", "team2", "name", "name2", "name3", "name4", "name5", "flag", "flag2", "flag3", "flag4", "flag5", "role", "role1", "role2", "role3", "role4", "role5"))} FROM f)
""" + " UNION ALL ".join(f"SELECT date, name{s} AS player, flag{s} AS flag, team1 AS from_team, team2 AS to_team, CASE WHEN role{s} <> '' THEN role{s} ELSE role1 END AS role, CAST(doc_id AS VARCHAR) AS page FROM g WHERE date <> '' AND name{s} <> ''" for s in ("", "2", "3", "4", "5")))
def _(c: Contests):
    pages = c.table("documents").select(c_("doc_id").cast("string").alias("page"), F.expr(PAGE).alias("text"))
    return text.extract_transfers(pages)


BOX = """'{{Infobox\n|name = ' || lang || ' Nick ' || doc_id || '<ref name=\"a\">see\nhere</ref>  \n| romanized_name= R' || doc_id || '\n|country=' || CASE doc_id % 4 WHEN 0 THEN 'Ukraine' WHEN 1 THEN 'Denmark' WHEN 2 THEN 'latvia' ELSE '' END || '\n|x=1\n}}\n' || text"""


@query("extract_infobox", f"""WITH p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ua' WHEN 1 THEN 'DE' END AS country, {BOX} AS t FROM documents),
f AS (SELECT doc_id, country, {", ".join(f"trim(regexp_replace(regexp_extract(t, '(?m)^\\|\\s*{k}\\s*=\\s*(.+?)\\s*$', 1), '(?s)<ref[^>]*>.*?</ref>', '', 'g')) AS {k}2" for k in ("name", "romanized_name", "country"))} FROM p),
g AS (SELECT *, CASE lower(country2) WHEN 'ukraine' THEN 'UA' WHEN 'latvia' THEN 'LV' ELSE upper(substr(country2, 1, 2)) END AS code FROM f)
SELECT doc_id, name2 AS page_name, romanized_name2 AS page_romanized_name, country2 AS page_country, code AS page_code, COALESCE(country, '') <> '' AND code <> '' AND code <> upper(country) IS TRUE AS country_mismatch FROM g""")
def _(c: Contests):
    pages = c.table("documents").select(
        "doc_id", F.expr("CASE doc_id % 3 WHEN 0 THEN 'ua' WHEN 1 THEN 'DE' END").alias("country"), F.expr(BOX).alias("text"))
    return text.extract_infobox(pages).select(
        "doc_id", "page_name", "page_romanized_name", "page_country", "page_code", "country_mismatch")


# ---- scalar functions -----------------------------------------------------------------------
@query("player_labels", f"""SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'N' || c_custkey ELSE 'N' || c_custkey || ' (' || c_mktsegment || ' Person)' END || COALESCE(', ' || {CODE.format(x='c_custkey')}, '') AS label,
'N' || c_custkey || COALESCE(', ' || {CODE.format(x='c_custkey')}, '') AS short FROM customer""")
def _(c: Contests):
    nick = F.concat(F.lit(" N"), "c_custkey", F.lit(" "))
    real = F.when(c_("c_custkey") % 6 != 0, F.concat(F.initcap("c_mktsegment").substr(F.lit(1), F.lit(0)), "c_mktsegment", F.lit(" 'nick'  Person")))
    country = F.expr(COUNTRY.format(x="c_custkey"))
    return c.table("customer").select(
        "c_custkey", X.player_label(nick, real, country).alias("label"), X.short_label(nick, country).alias("short"))


@query("key_of", f"WITH {PL} SELECT DISTINCT player, player_key FROM px UNION ALL SELECT c_name || ' ( x), y),  FR ', lower(c_name) || '|fr' FROM customer UNION ALL SELECT c_name, lower(c_name) || '|' FROM customer")
def _(c: Contests):
    labels = c.map_rows().select(F.explode(F.array(*[f"team{n}_player{i}" for n in (1, 2) for i in range(1, 6)])).alias("player")).where(
        "player IS NOT NULL").distinct()
    more = c.table("customer").select(F.explode(F.array(F.concat("c_name", F.lit(" ( x), y),  FR ")), "c_name")).alias("player"))
    return labels.unionByName(more).select("player", X.key_of(c_("player")).alias("player_key"))


@query("name_key", """SELECT doc_id, lower(trim(regexp_replace(translate(regexp_replace(replace(text, '_', ' '), '[«„"“”''‘’]([^«»„“”"''‘’]*)[»“”''’]', ' ', 'g'), '«»„“”"‘’''', ''), '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS name_key FROM documents""")
def _(c: Contests):
    return c.table("documents").select("doc_id", X.name_key(c_("text")).alias("name_key"))


@query("parse_label", f"WITH {PL} SELECT DISTINCT player, lower(regexp_extract(player, '^(.*?)\\s*\\((.*?)\\),\\s*([A-Z]{{2}})$', 1)) AS nick, regexp_extract(player, '^(.*?)\\s*\\((.*?)\\),\\s*([A-Z]{{2}})$', 2) AS real, "
       "lower(regexp_extract(player, '^(.*?)\\s*\\((.*?)\\),\\s*([A-Z]{2})$', 3)) AS cc FROM px WHERE player LIKE '%(%'")
def _(c: Contests):
    return player_rows(c).select("player").distinct().withColumn("p", X.parse_label(c_("player"))).where("p IS NOT NULL").select(
        "player", "p.nick", "p.real", "p.cc")


@query("date_functions", """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, strftime(o_orderdate, '%Y-%m') AS period, year(o_orderdate) || '/' || monthname(o_orderdate) AS label,
CAST(date_diff('month', TIMESTAMP '1992-01-01', o_orderdate) + 1 AS INT) AS months, CAST(FLOOR(epoch(o_orderdate) / 86400) AS BIGINT) AS day FROM orders""")
def _(c: Contests):
    ts = c_("o_orderdate")
    months = F.size(F.sequence(F.lit("1992-01-01").cast("date"), F.trunc(ts, "month"), F.expr("INTERVAL 1 MONTH")))
    return c.table("orders").select(
        "o_orderkey", F.trunc(ts, "month").alias("month"), F.date_format(ts, "yyyy-MM").alias("period"), X.month_label(ts).alias("label"),
        months.alias("months"), F.floor(F.unix_micros(ts.cast("timestamp")) / 86_400_000_000).alias("day"))


@query("math_functions", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ROUND(sqrt(l_extendedprice), 6) AS root, ROUND(ln(l_quantity), 6) AS log, ROUND(pow(l_discount + 1, 3), 6) AS cube,
ROUND(LEAST(GREATEST(l_discount, 0.02), 0.08), 6) AS clipped, ROUND(l_extendedprice / NULLIF(l_tax, 0), 4) AS ratio, ABS(l_quantity - 25) AS off FROM lineitem""")
def _(c: Contests):
    d = c_("l_discount")
    return c.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.sqrt("l_extendedprice"), 6).alias("root"), F.round(F.ln("l_quantity"), 6).alias("log"),
        F.round(F.pow(d + 1, F.lit(3)), 6).alias("cube"), F.round(X.clip(d, 0.02, 0.08), 6).alias("clipped"),
        F.round(c_("l_extendedprice") / F.nullif("l_tax", F.lit(0.0)), 4).alias("ratio"), F.abs(c_("l_quantity") - 25).alias("off"))


@query("array_functions", """SELECT vec_id, CAST(len(list_distinct(v)) AS INT) AS distinct_n, list_sort(v)[1] AS smallest, array_to_string(list_transform(list_sort(v)[1:3], lambda x: CAST(x AS VARCHAR)), '/') AS first3, CAST(len(v) AS INT) AS n
FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(FLOOR(x * 10) AS INT)) AS v FROM embeddings)""")
def _(c: Contests):
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 10).cast("int"))
    return c.table("embeddings").select("vec_id", v.alias("v")).select(
        "vec_id", F.size(F.array_distinct("v")).alias("distinct_n"), F.element_at(F.array_sort("v"), 1).alias("smallest"),
        F.array_join(F.slice(F.array_sort("v"), 1, 3).cast("array<string>"), "/").alias("first3"), F.size("v").alias("n"))


@query("render_functions", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '—' ELSE format('{:.2f}', o_totalprice) END AS price, CASE WHEN o_orderkey % 5 = 0 THEN '—' ELSE format('{:.1f}', o_totalprice / 1e6 * 100) || '%' END AS share FROM orders""")
def _(c: Contests):
    price = F.when(c_("o_orderkey") % 5 != 0, c_("o_totalprice"))
    return c.table("orders").select("o_orderkey", X.render_number(price, 2).alias("price"), X.render_share(price / 1e6).alias("share"))
