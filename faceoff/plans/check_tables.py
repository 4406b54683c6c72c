"""The shared DuckDB views of the check queries, written independently of the Spark operators."""

FIRST_SERIES = """
SELECT * EXCLUDE (rn) FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY seq) AS rn FROM series_rows)
WHERE rn = 1 AND team1 IS NOT NULL AND team2 IS NOT NULL
"""

MAP_WINS = """
SELECT match_id,
       COUNT(*) FILTER (WHERE one) AS w1, COUNT(*) FILTER (WHERE NOT one) AS w2
FROM (SELECT match_id, CASE WHEN score1_game <> score2_game THEN score1_game > score2_game
                            ELSE team1_win = 1 END AS one FROM map_rows)
GROUP BY match_id
"""

REPAIRED = """
SELECT f.* EXCLUDE (score1_match, score2_match), f.score1_match, f.score2_match,
       CASE WHEN f.score1_match > f.score2_match THEN team1
            WHEN f.score2_match > f.score1_match THEN team2
            WHEN w.w1 > w.w2 THEN team1 WHEN w.w2 > w.w1 THEN team2 END AS winner,
       CASE WHEN f.score1_match <> f.score2_match THEN f.score1_match
            WHEN w.w1 <> w.w2 THEN w.w1 ELSE f.score1_match END AS t1s,
       CASE WHEN f.score1_match <> f.score2_match THEN f.score2_match
            WHEN w.w1 <> w.w2 THEN w.w2 ELSE f.score2_match END AS t2s
FROM first_series f LEFT JOIN map_wins w USING (match_id)
"""

MATCHES = """
SELECT match_id, datetime, tournament, team1, team2, winner,
       CAST(score1_match AS BIGINT) AS score1_match, CAST(score2_match AS BIGINT) AS score2_match,
       CAST(t1s AS BIGINT) AS t1_series_score, CAST(t2s AS BIGINT) AS t2_series_score,
       COALESCE(games_played, 1) AS games_played, bestOf, tier
FROM repaired
WHERE winner IS NOT NULL AND COALESCE(t1s + t2s = games_played, TRUE)
"""

LONG = """
SELECT match_id, datetime, team1 AS team, team2 AS opponent, 1 AS side,
       CAST(winner = team1 AS INT) AS win, tier, games_played, bestOf FROM matches
UNION ALL
SELECT match_id, datetime, team2, team1, 2, CAST(winner = team2 AS INT), tier, games_played, bestOf
FROM matches
"""

TEAM_NO = """
SELECT team, CAST(ROW_NUMBER() OVER (ORDER BY team) AS INT) AS i
FROM (SELECT DISTINCT n_name AS team FROM nation)
"""

# One replay per (pool, k): state is the list of ratings, one list entry per team.
ELO_INPUT = """
SELECT m.*, a.i AS i1, b.i AS i2, CASE WHEN winner = team1 THEN 1.0e0 ELSE 0.0e0 END AS s,
       ROW_NUMBER() OVER (ORDER BY datetime, match_id) AS rn
FROM matches m JOIN team_no a ON a.team = m.team1 JOIN team_no b ON b.team = m.team2
"""

ELO_STATE = """(
SELECT 0::BIGINT AS rn, kk.k, list_transform(range(25), lambda x: 1500.0::DOUBLE) AS st,
       NULL::DOUBLE AS r1, NULL::DOUBLE AS r2, NULL::DOUBLE AS n1, NULL::DOUBLE AS n2
FROM (VALUES (8.0::DOUBLE), (16.0), (32.0), (64.0)) kk(k)
UNION ALL
SELECT o.rn, e.k,
       list_transform(e.st, lambda x, j: CASE WHEN j = o.i1
           THEN x + e.k * (o.s - 1.0 / (1.0 + pow(10.0, (e.st[o.i2] - x) / 400.0)))
           WHEN j = o.i2 THEN x + e.k * ((1.0 - o.s) - 1.0 / (1.0 + pow(10.0, (e.st[o.i1] - x) / 400.0)))
           ELSE x END),
       e.st[o.i1], e.st[o.i2],
       e.st[o.i1] + e.k * (o.s - 1.0 / (1.0 + pow(10.0, (e.st[o.i2] - e.st[o.i1]) / 400.0))),
       e.st[o.i2] + e.k * ((1.0 - o.s) - 1.0 / (1.0 + pow(10.0, (e.st[o.i1] - e.st[o.i2]) / 400.0)))
FROM elo_state e JOIN elo_input o ON o.rn = e.rn + 1)
"""

ELO_ALL = """
SELECT o.match_id, o.datetime, o.tournament, o.team1, o.team2, o.winner, o.tier, o.games_played,
       o.bestOf, o.t1_series_score, o.t2_series_score,
       e.k, e.r1 AS elo_t1_pre, e.r2 AS elo_t2_pre, e.n1 AS elo_t1_post, e.n2 AS elo_t2_post,
       1.0 / (1.0 + pow(10.0, (e.r2 - e.r1) / 400.0)) AS p_t1, o.s AS result
FROM elo_state e JOIN elo_input o ON o.rn = e.rn
"""

CHECK_TABLES = {
    "first_series": FIRST_SERIES,
    "map_wins": MAP_WINS,
    "repaired": REPAIRED,
    "matches": MATCHES,
    "long": LONG,
    "team_no": TEAM_NO,
    "elo_input": ELO_INPUT,
    "elo_state(rn, k, st, r1, r2, n1, n2)": ELO_STATE,
    "elo_all": ELO_ALL,
    "elo": "SELECT * FROM elo_all WHERE k = 32.0",
}
