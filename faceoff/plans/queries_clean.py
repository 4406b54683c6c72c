"""Registered queries: scans, cleaning, joins and simple aggregates over contests."""

from __future__ import annotations

from pyspark.sql import functions as F

from faceoff.functions import scalar as X
from faceoff.operators import clean, longform, teams
from faceoff.plans.registry import Contests, query
from faceoff.sources import games

CONTRACT = ", ".join(clean.CONTRACT_COLUMNS)


@query("scan_games", "SELECT is_total, COUNT(*) AS n, COUNT(map_name) AS n_maps, MIN(datetime) AS first, "
       "MAX(datetime) AS last FROM raw GROUP BY is_total")
def _(c: Contests):
    raw = c.stored_csv("raw-csv", c.raw())
    series, maps = games.split_rows(games.scan_games(c.spark, raw))
    return series.unionByName(maps).groupBy("is_total").agg(
        F.count("*").alias("n"), F.count("map_name").alias("n_maps"),
        F.min("datetime").alias("first"), F.max("datetime").alias("last"))


@query("scan_multi_source", """
SELECT match_id, game_id, map_name, game, score1_game + score2_game AS rounds FROM map_rows
""")
def _(c: Contests):
    raw = c.raw()
    paths = {g: c.stored_csv(f"raw-{g}", raw.where(F.col("game") == g)) for g in ("csgo", "cs2")}
    return games.scan_multi_source(c.spark, paths | {"none": f"{paths['cs2']}-missing"}).select("match_id", "game_id", "map_name", "game", "rounds")


@query("scan_tiers", """
WITH tagged AS (SELECT match_id, tier, seq FROM series_rows
                UNION ALL SELECT match_id, 'tier3', seq + 10 FROM series_rows)
SELECT match_id, MIN(tier) AS tier, COUNT(*) AS copies FROM tagged GROUP BY match_id
""")
def _(c: Contests):
    rows = c.series_rows().select("match_id", "tier", "seq")
    tiers = {t: rows.where(F.col("tier") == t).drop("tier") for t in ("tier1", "tier2")}
    tiers["tier3"] = rows.where(F.col("tier") == "tier3").drop("tier").unionByName(
        rows.drop("tier").withColumn("seq", F.col("seq") + 10))
    tagged = games.label_tiers(tiers)
    kept = clean.keep_first(tagged, ["match_id"], ["tier", "seq"])
    return kept.join(tagged.groupBy("match_id").agg(F.count("*").alias("copies")), "match_id").select(
        "match_id", "tier", "copies")


@query("column_pruned_scan", "SELECT DISTINCT match_id, tier FROM series_rows")
def _(c: Contests):
    return c.series_rows().select("match_id", "tier").distinct()


@query("register_tables", """
SELECT match_id, try_cast(CAST(datetime AS VARCHAR) AS TIMESTAMP) AS datetime, team1, team2, winner FROM matches
""")
def _(c: Contests):
    text = c.matches().withColumn("datetime", F.col("datetime").cast("string"))
    games.register_views(c.spark, {"contest_matches": text}, timestamps=("datetime",))
    return c.spark.sql("SELECT match_id, datetime, team1, team2, winner FROM contest_matches")


@query("row_counts", """
SELECT 'matches' AS table_name, COUNT(*) AS n_rows FROM matches
UNION ALL SELECT 'teams', COUNT(DISTINCT team) FROM long
UNION ALL SELECT 'map_rows', COUNT(*) FROM map_rows
""")
def _(c: Contests):
    matches = c.matches()
    return games.row_counts({
        "matches": matches, "teams": longform.side_long(matches).select("team").distinct(),
        "map_rows": c.map_rows()})


@query("dedupe_keep_first", """
SELECT match_id, team1, team2, seq FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY seq) AS rn
FROM series_rows) WHERE rn = 1
""")
def _(c: Contests):
    rows = c.series_rows().select("match_id", "team1", "team2", "seq")
    return clean.keep_first(rows, ["match_id"], ["seq"])


@query("drop_missing_sides", "SELECT match_id, seq, team1, team2 FROM series_rows "
       "WHERE team1 IS NOT NULL AND team2 IS NOT NULL")
def _(c: Contests):
    return clean.drop_missing_sides(c.series_rows()).select("match_id", "seq", "team1", "team2")


@query("winner_from_scores", """
SELECT match_id, seq, CASE WHEN score1_match > score2_match THEN team1
                           WHEN score2_match > score1_match THEN team2 END AS winner FROM series_rows
""")
def _(c: Contests):
    return clean.winner_from_scores(c.series_rows()).select("match_id", "seq", "winner")


@query("map_winner_counts", """
SELECT match_id, team1 AS team, w1 AS maps_won FROM map_wins JOIN pairing USING (match_id) WHERE w1 > 0
UNION ALL SELECT match_id, team2, w2 FROM map_wins JOIN pairing USING (match_id) WHERE w2 > 0
""")
def _(c: Contests):
    return clean.map_winner_counts(c.map_rows())


@query("recover_winner", "SELECT match_id, winner, t1s AS t1_series_score, t2s AS t2_series_score FROM repaired")
def _(c: Contests):
    first = clean.drop_missing_sides(clean.keep_first(
        c.series_rows().select("match_id", "seq", "team1", "team2", "score1_match", "score2_match"),
        ["match_id"], ["seq"]))
    return clean.recover_winner(clean.winner_from_scores(first), c.map_rows()).select(
        "match_id", "winner", "t1_series_score", "t2_series_score")


@query("drop_invalid_series", "SELECT match_id FROM repaired WHERE winner IS NOT NULL AND "
       "(t1s IS NULL OR t2s IS NULL OR games_played IS NULL OR t1s + t2s = games_played)")
def _(c: Contests):
    first = clean.drop_missing_sides(clean.keep_first(
        c.series_rows().select("match_id", "seq", "team1", "team2", "score1_match", "score2_match",
                               "games_played"), ["match_id"], ["seq"]))
    repaired = clean.recover_winner(clean.winner_from_scores(first), c.map_rows())
    return clean.drop_invalid_series(repaired).select("match_id")


@query("finalize_series", f"SELECT {CONTRACT} FROM matches")
def _(c: Contests):
    return clean.sorted_series(clean.load_series(c.raw(), extra=()))


@query("load_series", f"SELECT {CONTRACT}, tier FROM matches")
def _(c: Contests):
    return clean.load_series(c.raw())


@query("normalize_name", "SELECT team, LOWER(TRIM(team)) AS name_key, COUNT(*) AS n FROM long GROUP BY team")
def _(c: Contests):
    return c.long().groupBy("team").agg(F.count("*").alias("n")).withColumn(
        "name_key", X.normalize_name(F.col("team")))


@query("canonicalize_names", """
WITH sheet AS (SELECT LOWER(n_name) AS alias, r_name || '/' || n_name AS canonical FROM nation
               JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA')
SELECT match_id, COALESCE(a.canonical, team1) AS team1, COALESCE(b.canonical, team2) AS team2,
       COALESCE(w.canonical, winner) AS winner
FROM matches LEFT JOIN sheet a ON a.alias = LOWER(TRIM(team1)) LEFT JOIN sheet b ON b.alias = LOWER(TRIM(team2))
LEFT JOIN sheet w ON w.alias = LOWER(TRIM(winner))
""")
def _(c: Contests):
    sheet = c.table("nation").join(
        c.table("region"), F.col("r_regionkey") == F.col("n_regionkey")).where("r_name <> 'ASIA'").select(
        F.concat(F.lit(" "), F.upper("n_name")).alias("alias"),
        F.concat_ws("/", "r_name", "n_name").alias("canonical"))
    return clean.canonicalize_names(c.matches(), sheet).select("match_id", "team1", "team2", "winner")


@query("flag_forfeits", "SELECT match_id, seq, (COALESCE(score1_match, 0) = 0 AND COALESCE(score2_match, 0) = 0 "
       "AND games_played >= 1) AS is_forfeit FROM series_rows")
def _(c: Contests):
    rows = c.series_rows().withColumnsRenamed(
        {"score1_match": "t1_series_score", "score2_match": "t2_series_score"})
    return clean.flag_forfeits(rows).select("match_id", "seq", "is_forfeit")


@query("winsorize", """
SELECT is_total, match_id, game_id, seq, CASE WHEN score1_game > 25 THEN 25 WHEN score1_game < 5 THEN 5 ELSE score1_game END AS score1_game,
       CASE WHEN score2_game > 25 THEN 25 WHEN score2_game < 5 THEN 5 ELSE score2_game END AS score2_game FROM raw
""")
def _(c: Contests):
    return clean.winsorize(c.raw(), ["score1_game", "score2_game"], lo=5.0, hi=25.0).select(
        "is_total", "match_id", "game_id", "seq", "score1_game", "score2_game")


@query("trusted_maps", "SELECT match_id, game_id, team1_win FROM map_rows WHERE (score1_game > score2_game) = (team1_win = 1)")
def _(c: Contests):
    return clean.trusted_maps(c.raw()).select("match_id", "game_id", "team1_win")


@query("derive_series", """
SELECT match_id, t1_series_score + t2_series_score AS total_maps, ABS(t1_series_score - t2_series_score) AS margin,
       games_played = 1 AS is_bo1, (t1_series_score = 0 OR t2_series_score = 0) AND games_played >= 2 AS swept,
       bestOf = 5 AND (t1_series_score = 0 OR t2_series_score = 0) AND games_played >= 2 AS bo5_sweep FROM matches
""")
def _(c: Contests):
    return clean.derive_series(c.matches()).select(
        "match_id", "total_maps", "margin", "is_bo1", "swept", "bo5_sweep")


@query("row_assertions", """
SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE winner IS NULL OR (winner <> team1 AND winner <> team2)) AS winner_outside_pair,
       (SELECT COUNT(*) FROM (SELECT match_id FROM repaired GROUP BY 1 HAVING COUNT(*) > 1)) AS duplicate_ids,
       COUNT(*) FILTER (WHERE t1s + t2s <> games_played) AS score_mismatch FROM repaired
""")
def _(c: Contests):
    first = clean.drop_missing_sides(clean.keep_first(
        c.series_rows().select("match_id", "seq", "team1", "team2", "score1_match", "score2_match",
                               "games_played"), ["match_id"], ["seq"]))
    return clean.row_assertions(clean.recover_winner(clean.winner_from_scores(first), c.map_rows()))


@query("window_filter", """
SELECT match_id, game_id FROM map_rows WHERE datetime >= TIMESTAMP '1994-01-01' AND datetime <= TIMESTAMP '1997-12-31 23:59:00'
AND map_name IN ('ECONOMY', 'STANDARD', 'PROMO') AND (tournament ILIKE '%urgent%' OR tournament ILIKE '%high%' OR tournament ILIKE '%low%')
AND tier IN ('tier1', 'tier2') AND game = 'csgo'
""")
def _(c: Contests):
    return clean.window_filter(
        c.map_rows(), "1994-01-01", "1997-12-31", ["economy", "Standard", "PROMO"],
        ["Urgent", "high", "low"], ["tier1", "tier2"], ["CSGO"]).select("match_id", "game_id")


@query("tier_of_match", """
SELECT match_id, MIN(tier) AS tier FROM (SELECT match_id, tier FROM series_rows UNION ALL
SELECT match_id, CASE WHEN bestOf = 1 THEN 'tier1' ELSE 'tier3' END FROM map_rows) GROUP BY match_id
""")
def _(c: Contests):
    tagged = c.series_rows().select("match_id", "tier").unionByName(c.map_rows().select(
        "match_id", F.when(F.col("bestOf") == 1, "tier1").otherwise("tier3").alias("tier")))
    return clean.tier_of_match(tagged)


@query("side_long", "SELECT match_id, datetime, team, opponent, side, win FROM long")
def _(c: Contests):
    return c.long()


@query("profile_missing", """
SELECT * FROM (SELECT 'team2' AS column_name, AVG(CAST(team2 IS NULL AS INT)) AS null_share FROM raw
UNION ALL SELECT 'score1_match', AVG(CAST(score1_match IS NULL AS INT)) FROM raw
UNION ALL SELECT 'score1_game', AVG(CAST(score1_game IS NULL AS INT)) FROM raw
UNION ALL SELECT 'team1_player1_id', AVG(CAST(team1_player1_id IS NULL AS INT)) FROM raw
UNION ALL SELECT 'tournament', AVG(CAST(tournament IS NULL AS INT)) FROM raw) WHERE null_share > 0
""")
def _(c: Contests):
    return clean.profile_missing(c.raw().select(
        "team2", "score1_match", "score1_game", "team1_player1_id", "tournament"))


@query("lineup_of_match", """
SELECT match_id,
       arg_min(team1, o) FILTER (WHERE team1 IS NOT NULL) AS team1, arg_min(team2, o) FILTER (WHERE team2 IS NOT NULL) AS team2,
       arg_min(team1_player1_id, o) FILTER (WHERE team1_player1_id IS NOT NULL) AS team1_player1_id,
       arg_min(team2_player5, o) FILTER (WHERE team2_player5 IS NOT NULL) AS team2_player5,
       arg_min(team1_win, o) FILTER (WHERE team1_win IS NOT NULL) AS team1_win
FROM (SELECT *, CAST(is_total AS BIGINT) * 1000000000000 + COALESCE(game_id, 0) * 10 + seq AS o FROM raw) GROUP BY match_id
""")
def _(c: Contests):
    return clean.lineup_of_match(
        c.raw(), ["team1", "team2", "team1_player1_id", "team2_player5", "team1_win"])


# ---- joins ----------------------------------------------------------------------------------
@query("side_features_join", """
WITH f AS (SELECT match_id, team, COUNT(*) OVER (PARTITION BY team ORDER BY datetime, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM long)
SELECT m.match_id, a.n AS played_t1, b.n AS played_t2 FROM matches m
LEFT JOIN f a ON a.match_id = m.match_id AND a.team = m.team1 LEFT JOIN f b ON b.match_id = m.match_id AND b.team = m.team2
""")
def _(c: Contests):
    from faceoff.operators.history import TEAM, prior_totals
    matches = c.matches()
    per_side = prior_totals(longform.side_long(matches), TEAM, {"played": ("sum", F.lit(1))})
    return teams.join_sides(matches.select("match_id"), per_side, ["played"])


@query("month_share_join", """
WITH s AS (SELECT team, date_trunc('month', datetime) AS month, AVG(win) AS share FROM long GROUP BY 1, 2)
SELECT m.match_id, m.winner, ROUND(s.share, 6) AS win_share FROM matches m
LEFT JOIN s ON s.team = m.winner AND s.month = date_trunc('month', m.datetime)
""")
def _(c: Contests):
    return teams.winner_month_share(c.matches()).select(
        "match_id", "winner", F.round("win_share", 6).alias("win_share"))


@query("month_spine", """
WITH b AS (SELECT date_trunc('month', MIN(datetime)) AS a, date_trunc('month', MAX(datetime)) AS z FROM matches),
m AS (SELECT unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS month FROM b)
SELECT CAST(m.month AS DATE) AS month, COUNT(x.match_id) AS n_series FROM m
LEFT JOIN (SELECT * FROM matches WHERE tier = 'tier3') x ON date_trunc('month', x.datetime) = m.month GROUP BY 1
""")
def _(c: Contests):
    matches = c.matches()
    counts = matches.where("tier = 'tier3'").groupBy(
        F.trunc("datetime", "month").alias("month")).agg(F.count("*").alias("n_series"))
    return teams.on_month_spine(matches, counts, ["n_series"])


@query("semi_joins", """
SELECT match_id FROM matches WHERE team1 IN (SELECT team FROM long GROUP BY team HAVING COUNT(*) >= 430)
AND team2 IN (SELECT team FROM long GROUP BY team HAVING COUNT(*) >= 430)
""")
def _(c: Contests):
    return teams.only_active(c.matches(), 430).select("match_id")


@query("unmatched", "SELECT match_id FROM series_rows EXCEPT SELECT match_id FROM map_rows WHERE score1_game > score2_game")
def _(c: Contests):
    return teams.unmatched(c.series_rows(), c.map_rows().where("score1_game > score2_game"))


@query("one_to_one_join", "SELECT m.match_id, m.winner, w.w1 FROM matches m JOIN map_wins w USING (match_id)")
def _(c: Contests):
    wins = c.map_rows().groupBy("match_id").agg(F.count_if(clean.map_side1_won()).alias("w1"))
    return clean.assert_one_to_one(c.matches().select("match_id", "winner"), wins, "match_id")


@query("scalar_subquery", "SELECT tier, COUNT(*) AS n FROM matches WHERE datetime >= (SELECT MAX(datetime) FROM matches) - INTERVAL 6 MONTH GROUP BY tier")
def _(c: Contests):
    c.matches().createOrReplaceTempView("scalar_matches")
    return c.spark.sql("SELECT tier, COUNT(*) AS n FROM scalar_matches WHERE datetime >= "
                       "(SELECT MAX(datetime) FROM scalar_matches) - INTERVAL '6' MONTH GROUP BY tier")


# ---- set operations and sorts ---------------------------------------------------------------
@query("union_all", "SELECT team1 AS team, COUNT(*) AS n FROM (SELECT team1 FROM matches UNION ALL SELECT team2 FROM matches) GROUP BY 1")
def _(c: Contests):
    m = c.matches()
    return m.select(F.col("team1").alias("team")).unionByName(m.select(F.col("team2").alias("team"))).groupBy(
        "team").agg(F.count("*").alias("n"))


@query("set_difference", "SELECT match_id FROM series_rows EXCEPT SELECT match_id FROM matches")
def _(c: Contests):
    return c.series_rows().select("match_id").subtract(c.matches().select("match_id"))


@query("array_set_ops", """
SELECT match_id, CAST(len(list_intersect(a, b)) AS INT) AS shared, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS INT) AS only_a,
       CAST(len(list_distinct(a)) AS INT) AS distinct_a, list_sort(a) = list_sort(b) AS same FROM (
SELECT match_id, [team1_player1_id, team1_player2_id, team1_player3_id, team1_player4_id, team1_player5_id] AS a,
       [team1_player2_id, team1_player3_id, team1_player4_id, team1_player5_id, team2_player1_id] AS b
FROM series_rows WHERE seq = 1 AND team1_player1_id IS NOT NULL)
""")
def _(c: Contests):
    a = F.array(*[f"team1_player{i}_id" for i in range(1, 6)])
    b = F.array(*[f"team1_player{i}_id" for i in range(2, 6)], "team2_player1_id")
    return c.series_rows().where("seq = 1 AND team1_player1_id IS NOT NULL").select(
        "match_id", F.size(F.array_intersect(a, b)).alias("shared"),
        F.size(F.array_except(a, b)).alias("only_a"), F.size(F.array_distinct(a)).alias("distinct_a"),
        (F.array_sort(a) == F.array_sort(b)).alias("same"))


@query("stable_sort", "SELECT match_id, datetime, ROW_NUMBER() OVER (ORDER BY datetime, match_id) AS position FROM matches")
def _(c: Contests):
    from faceoff.operators.ordering import global_position
    return global_position(c.matches().select("match_id", "datetime"), "datetime", ["match_id"])


@query("top_k", "SELECT match_id, margin FROM (SELECT match_id, ABS(t1_series_score - t2_series_score) AS margin FROM matches) ORDER BY margin DESC, match_id LIMIT 10")
def _(c: Contests):
    return clean.derive_series(c.matches()).select("match_id", "margin").orderBy(
        F.desc("margin"), "match_id").limit(10)


@query("top_k_then_filter", """
SELECT match_id, team1, team2 FROM matches WHERE team1 IN (SELECT team FROM long GROUP BY team ORDER BY COUNT(*) DESC, team LIMIT 5)
""")
def _(c: Contests):
    matches = c.matches()
    top = longform.side_long(matches).groupBy("team").count().orderBy(F.desc("count"), "team").limit(5)
    return matches.join(top, matches["team1"] == top["team"], "left_semi").select("match_id", "team1", "team2")


@query("last_k_per_key", """
SELECT team, match_id, CAST(back AS INT) AS back FROM (SELECT team, match_id, ROW_NUMBER() OVER (PARTITION BY team ORDER BY datetime DESC, match_id DESC) AS back FROM long) WHERE back <= 15
""")
def _(c: Contests):
    from faceoff.operators.ordering import last_k
    return last_k(c.long(), ["team"], ["datetime", "match_id"], 15).select("team", "match_id", "back")
