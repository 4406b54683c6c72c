"""Registered queries: team aggregates, form, streaks, ratings and the question pack."""

from __future__ import annotations

from pyspark.sql import functions as F

from faceoff.functions import scalar as X
from faceoff.operators import clean, gold, history, longform, rating, teams
from faceoff.operators.history import TEAM, Timeline
from faceoff.plans.registry import Contests, query


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# ---- aggregates -----------------------------------------------------------------------------
@query("team_stats", "SELECT team, COUNT(*) AS n_series, CAST(SUM(win) AS BIGINT) AS n_wins, ROUND(AVG(win), 6) AS win_share FROM long GROUP BY team")
def _(c: Contests):
    return teams.team_stats(c.long()).select("team", "n_series", "n_wins", *r6("win_share"))


UPSETS = """
WITH s AS (SELECT team, date_trunc('month', datetime) AS month, AVG(win) AS share FROM long GROUP BY 1, 2),
x AS (SELECT date_trunc('month', m.datetime) AS month, CASE WHEN COALESCE({share}, 0) < 0.5 THEN 1 ELSE 0 END AS upset
      FROM matches m LEFT JOIN {source} s ON s.team = m.winner AND s.month = date_trunc('month', m.datetime)),
b AS (SELECT date_trunc('month', MIN(datetime)) AS a, date_trunc('month', MAX(datetime)) AS z FROM matches),
t AS (SELECT unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS month FROM b)
SELECT CAST(t.month AS DATE) AS month, COUNT(x.month) AS n_series, CAST(COALESCE(SUM(upset), 0) AS BIGINT) AS n_upsets,
       ROUND(COALESCE(SUM(upset) / COUNT(x.month), 0), 6) AS upset_rate
FROM t LEFT JOIN x ON x.month = t.month GROUP BY t.month
"""


@query("monthly_upsets", UPSETS.format(share="s.share", source="s"))
def _(c: Contests):
    return teams.monthly_upsets(c.matches()).select("month", "n_series", "n_upsets", *r6("upset_rate"))


@query("monthly_upsets_pre_month", UPSETS.format(share="s.pre", source="""(
    SELECT team, month, SUM(w) OVER q / SUM(n) OVER q AS pre
    FROM (SELECT team, date_trunc('month', datetime) AS month, SUM(win) AS w, COUNT(*) AS n FROM long GROUP BY 1, 2)
    WINDOW q AS (PARTITION BY team ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""))
def _(c: Contests):
    return teams.monthly_upsets(c.matches(), pre_month=True).select("month", "n_series", "n_upsets", *r6("upset_rate"))


@query("pair_record", """
SELECT team AS team_a, opponent AS team_b, CAST(SUM(win) AS BIGINT) AS a_wins, CAST(COUNT(*) - SUM(win) AS BIGINT) AS b_wins, COUNT(*) AS n
FROM long GROUP BY 1, 2 HAVING COUNT(*) >= 4
""")
def _(c: Contests):
    return teams.pair_record(c.long())


@query("pair_record_unordered", """
SELECT team AS team_a, opponent AS team_b, CAST(SUM(win) AS BIGINT) AS a_wins, CAST(COUNT(*) - SUM(win) AS BIGINT) AS b_wins, COUNT(*) AS n
FROM long WHERE team < opponent GROUP BY 1, 2 HAVING COUNT(*) >= 4
""")
def _(c: Contests):
    return teams.pair_record(c.long(), oriented=False)


@query("map_baseline", "SELECT map_name, ROUND(AVG(team1_win), 6) AS team1_win_rate, COUNT(*) AS n FROM map_rows GROUP BY 1")
def _(c: Contests):
    return teams.map_baseline(c.map_rows()).select("map_name", *r6("team1_win_rate"), "n")


DIGEST = """SELECT '{v}' AS column_name, COUNT(*) AS rows, CAST(MAX(datetime) AS DATE) AS latest,
AVG({v}) AS mean, STDDEV_POP({v}) AS std FROM {t}"""


@query("digest", " UNION ALL ".join(
    f"SELECT column_name, rows, latest, ROUND(mean, 6) AS mean, ROUND(std, 6) AS std FROM ({DIGEST.format(v=v, t='matches')})"
    for v in ("games_played", "t1_series_score")))
def _(c: Contests):
    return teams.digest(c.matches(), ["games_played", "t1_series_score"]).select(
        "column_name", "rows", "latest", *r6("mean", "std"))


@query("digest_drift", f"""
WITH a AS ({" UNION ALL ".join(DIGEST.format(v=v, t="(SELECT * FROM matches WHERE tier <> 'tier3')") for v in ("games_played", "bestOf"))}),
z AS ({" UNION ALL ".join(DIGEST.format(v=v, t="matches") for v in ("games_played", "bestOf"))})
SELECT column_name, z.rows - a.rows AS rows_delta, ROUND(z.mean - a.mean, 6) AS mean_shift,
       ABS(z.mean - a.mean) > 0.25 * CASE WHEN a.std = 0 THEN 1 ELSE a.std END AS shift_flag,
       z.rows < a.rows AS rows_fell, z.latest <= a.latest AS stale FROM a JOIN z USING (column_name)
""")
def _(c: Contests):
    cols = ["games_played", "bestOf"]
    return teams.digest_drift(
        teams.digest(c.matches().where("tier <> 'tier3'"), cols), teams.digest(c.matches(), cols)).select(
        "column_name", "rows_delta", *r6("mean_shift"), "shift_flag", "rows_fell", "stale")


@query("top_share", """
SELECT team, COUNT(*) AS n_series, CAST(SUM(win) AS BIGINT) AS n_wins, ROUND(AVG(win), 6) AS win_share, ROUND(AVG(margin), 6) AS mean_margin
FROM long JOIN (SELECT match_id, ABS(t1_series_score - t2_series_score) AS margin FROM matches) USING (match_id)
GROUP BY team HAVING COUNT(*) >= 20 ORDER BY AVG(win) DESC, team LIMIT 15
""")
def _(c: Contests):
    return teams.top_share(c.matches()).select("team", "n_series", "n_wins", *r6("win_share", "mean_margin"))


@query("mean_by_tier", "SELECT tier, ROUND(AVG(ABS(t1_series_score - t2_series_score)), 6) AS mean_margin, COUNT(*) AS n FROM matches GROUP BY tier")
def _(c: Contests):
    return teams.mean_by_tier(c.matches()).select("tier", *r6("mean_margin"), "n")


@query("format_specialists", """
SELECT team, ROUND(a, 6) AS bo1_share, ROUND(b, 6) AS bo3_share, ROUND(a - b, 6) AS diff FROM (
SELECT team, AVG(win) FILTER (WHERE games_played = 1) AS a, AVG(win) FILTER (WHERE games_played >= 2) AS b FROM long GROUP BY team
HAVING COUNT(*) >= 30 AND COUNT(*) FILTER (WHERE games_played = 1) >= 10 AND COUNT(*) FILTER (WHERE games_played >= 2) >= 10)
""")
def _(c: Contests):
    return teams.format_specialists(c.matches()).select("team", *r6("bo1_share", "bo3_share", "diff"))


@query("sweep_rate_over_time", """
WITH s AS (SELECT datetime, CASE WHEN (t1_series_score = 0 OR t2_series_score = 0) AND games_played >= 2 THEN 1 ELSE 0 END AS sw FROM matches)
SELECT 'month' AS grain, strftime(datetime, '%Y-%m') AS period, ROUND(AVG(sw), 6) AS sweep_rate, COUNT(*) AS n FROM s GROUP BY 1, 2
UNION ALL SELECT 'year', strftime(datetime, '%Y'), ROUND(AVG(sw), 6), COUNT(*) FROM s GROUP BY 1, 2
""")
def _(c: Contests):
    return teams.sweep_rate_over_time(c.matches()).select("grain", "period", *r6("sweep_rate"), "n")


@query("first_listed_bias", """
SELECT COALESCE(tier, 'ALL') AS tier, ROUND(AVG(CAST(winner = team1 AS INT)), 6) AS team1_win_share, COUNT(*) AS n FROM matches GROUP BY ROLLUP (tier)
""")
def _(c: Contests):
    return teams.first_listed_bias(c.matches()).select("tier", *r6("team1_win_share"), "n")


@query("series_per_team", """
SELECT COUNT(*) AS teams, ROUND(AVG(n), 6) AS mean, ROUND(STDDEV_SAMP(n), 6) AS std, MIN(n) AS min, MAX(n) AS max,
       quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75
FROM (SELECT team, COUNT(*) AS n FROM long GROUP BY team)
""")
def _(c: Contests):
    return teams.series_per_team(c.long()).select("teams", *r6("mean", "std"), "min", "max", "q25", "q50", "q75")


@query("top_tournaments", "SELECT tournament, COUNT(*) AS n FROM matches GROUP BY 1 ORDER BY n DESC, tournament LIMIT 10")
def _(c: Contests):
    return teams.top_tournaments(c.matches())


@query("coverage_stats", """
SELECT game, COUNT(*) AS maps, COUNT(DISTINCT match_id) AS matches, COUNT(DISTINCT tournament) AS events,
       AVG(CAST(datetime IS NOT NULL AS INT)) AS dated_share, MIN(datetime) AS first, MAX(datetime) AS last,
       COUNT(team1_player5) AS with_player5, AVG(CAST(team1_player5_kills IS NULL AS INT)) AS null_kills,
       AVG(CAST(team1_player5_deaths IS NULL AS INT)) AS null_deaths, AVG(CAST(team1_player5_assists IS NULL AS INT)) AS null_assists,
       AVG(CAST(team1_player5_adr IS NULL AS INT)) AS null_adr, AVG(CAST(team1_player5_kast IS NULL AS INT)) AS null_kast,
       MIN(team1_player1_kast) AS kast_min, MAX(team1_player1_kast) AS kast_max FROM map_rows GROUP BY game
""")
def _(c: Contests):
    return teams.coverage_stats(c.map_rows())


@query("distinct_counts", "SELECT tier, COUNT(DISTINCT team1) AS teams, COUNT(DISTINCT tournament) AS events FROM matches GROUP BY tier")
def _(c: Contests):
    return c.matches().groupBy("tier").agg(
        F.countDistinct("team1").alias("teams"), F.countDistinct("tournament").alias("events"))


# ---- windows --------------------------------------------------------------------------------
@query("form_lag3", """
SELECT match_id, team, ROUND(COALESCE(AVG(win) OVER (PARTITION BY team ORDER BY datetime, match_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0.5), 6) AS form_win_share FROM long
""")
def _(c: Contests):
    return history.form_lag3(c.long()).select("match_id", "team", *r6("form_win_share"))


@query("win_streaks", """
WITH o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY datetime, match_id)
                   - ROW_NUMBER() OVER (PARTITION BY team, win ORDER BY datetime, match_id) AS g FROM long)
SELECT team, COUNT(*) AS streak_length, MIN(datetime) AS streak_start, MAX(datetime) AS streak_end FROM o WHERE win = 1
GROUP BY team, g HAVING COUNT(*) >= 5
""")
def _(c: Contests):
    return history.win_streaks(c.long())


@query("longest_runs", """
WITH o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY datetime, match_id)
                   - ROW_NUMBER() OVER (PARTITION BY team, win ORDER BY datetime, match_id) AS g FROM long),
r AS (SELECT team, win, COUNT(*) AS n FROM o GROUP BY team, win, g)
SELECT team, COALESCE(MAX(n) FILTER (WHERE win = 1), 0) AS longest_win_run, COALESCE(MAX(n) FILTER (WHERE win = 0), 0) AS longest_loss_run FROM r GROUP BY team
""")
def _(c: Contests):
    return history.longest_runs(c.long())


@query("rolling_form", """
SELECT match_id, team, ROUND(AVG(win) OVER (PARTITION BY team ORDER BY datetime, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS form FROM long
""")
def _(c: Contests):
    return history.rolling_form(c.long()).select("match_id", "team", *r6("form"))


@query("rolling_form_strict", """
WITH d AS (SELECT *, date_trunc('month', datetime) AS moment FROM long)
SELECT a.match_id, a.team, ROUND(COALESCE((SELECT AVG(win) FROM (SELECT win FROM d b WHERE b.team = a.team AND b.moment < a.moment
       ORDER BY b.moment DESC, b.match_id DESC LIMIT 5)), 0.5), 6) AS form FROM d a
""")
def _(c: Contests):
    monthly = c.long().withColumn("moment", F.date_trunc("month", F.col("datetime").cast("timestamp")))
    line = Timeline(("team",), ("moment", "match_id"))
    return history.rolling_form_strict(monthly, line=line).select("match_id", "team", *r6("form"))


@query("rest_days", """
WITH p AS (SELECT match_id, team, datetime, LAG(datetime) OVER (PARTITION BY team ORDER BY datetime, match_id) AS q FROM long)
SELECT match_id, team, CAST((epoch_us(datetime) - epoch_us(q)) // 86400000000 AS BIGINT) AS rest_whole_days,
       ROUND((epoch_us(datetime) - epoch_us(q)) / 86400000000.0, 8) AS rest_days FROM p
""")
def _(c: Contests):
    return history.rest_days(c.long()).select("match_id", "team", "rest_whole_days", F.round("rest_days", 8).alias("rest_days"))


@query("h2h_before", """
WITH q AS (SELECT *, LEAST(team1, team2) AS a, GREATEST(team1, team2) AS b FROM matches),
w AS (SELECT *, COUNT(*) OVER x AS n, COALESCE(SUM(CAST(winner = a AS INT)) OVER x, 0) AS aw FROM q
      WINDOW x AS (PARTITION BY a, b ORDER BY datetime, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT match_id, CAST(aw AS BIGINT) AS a_wins_before, CAST(n - aw AS BIGINT) AS b_wins_before,
       ROUND(CASE WHEN n = 0 THEN 0.5 WHEN team1 = a THEN aw / n ELSE 1 - aw / n END, 6) AS h2h_t1_win_share FROM w
""")
def _(c: Contests):
    return history.h2h_before(c.matches()).select(
        "match_id", "a_wins_before", "b_wins_before", *r6("h2h_t1_win_share"))


@query("h2h_before_split", """
WITH q AS (SELECT *, LEAST(team1, team2) AS a, GREATEST(team1, team2) AS b FROM matches),
w AS (SELECT *, COUNT(*) OVER x AS n, COALESCE(SUM(CAST(winner = a AS INT)) OVER x, 0) AS aw FROM q
      WINDOW x AS (PARTITION BY a, b ORDER BY datetime, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT match_id, CAST(aw AS BIGINT) AS a_wins_before, CAST(n - aw AS BIGINT) AS b_wins_before FROM w
""")
def _(c: Contests):
    line = Timeline(("pair_a", "pair_b"), hot_rows=20)
    return history.h2h_before(c.matches(), line).select("match_id", "a_wins_before", "b_wins_before")


@query("rolling_form_split", """
SELECT match_id, team, ROUND(AVG(win) OVER (PARTITION BY team ORDER BY datetime, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS form FROM long
""")
def _(c: Contests):
    line = Timeline(("team",), hot_rows=420)
    return history.rolling_form(c.long(), line=line).select("match_id", "team", *r6("form"))


@query("team_map_winrate", """
WITH l AS (SELECT match_id, game_id, datetime, map_name, 1 AS side, team1 AS team, team1_win AS win FROM map_rows
           UNION ALL SELECT match_id, game_id, datetime, map_name, 2, team2, 1 - team1_win FROM map_rows),
w AS (SELECT *, COALESCE(AVG(win) OVER (PARTITION BY team, map_name ORDER BY datetime, match_id, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5) AS wr FROM l)
SELECT match_id, game_id, ROUND(MAX(wr) FILTER (WHERE side = 1), 6) AS team1_map_wr, ROUND(MAX(wr) FILTER (WHERE side = 2), 6) AS team2_map_wr FROM w GROUP BY 1, 2
""")
def _(c: Contests):
    return history.team_map_winrate(c.map_rows()).select("match_id", "game_id", *r6("team1_map_wr", "team2_map_wr"))


@query("conversion_after_form", """
WITH w AS (SELECT win, SUM(win) OVER q AS s, COUNT(*) OVER q AS n FROM long
           WINDOW q AS (PARTITION BY team ORDER BY datetime, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT ROUND(AVG(win), 6) AS conversion_after_good_form FROM w WHERE n = 5 AND s >= 3
""")
def _(c: Contests):
    return history.conversion_after_form(c.long()).select(*r6("conversion_after_good_form"))


LINEUPS = """
lu AS (SELECT match_id, datetime, 1 AS side, team1 AS team, {a} AS l FROM series_rows WHERE seq = 1
       UNION ALL SELECT match_id, datetime, 2, team2, {b} FROM series_rows WHERE seq = 1 AND team2 IS NOT NULL)
""".format(**{k: "[" + ", ".join(f"team{n}_player{i}_id" for i in range(1, 6)) + "]" for k, n in (("a", 1), ("b", 2))})


@query("roster_features", f"""
WITH {LINEUPS}, kn AS (SELECT *, LAG(l) OVER (PARTITION BY team ORDER BY datetime, match_id) AS p FROM lu
    WHERE len(list_filter(l, lambda x: x IS NOT NULL)) = 5)
SELECT lu.match_id, lu.side, lu.team, CASE WHEN kn.p IS NOT NULL THEN len(list_intersect(kn.l, kn.p)) / 5.0e0 END AS stability,
       CASE WHEN kn.p IS NOT NULL THEN CAST(len(list_intersect(kn.l, kn.p)) <= 3 AS DOUBLE) END AS standin
FROM lu LEFT JOIN kn ON kn.match_id = lu.match_id AND kn.side = lu.side
""")
def _(c: Contests):
    first = c.series_rows().where("seq = 1")
    return history.roster_features(history.sided_lineups(first).where("team IS NOT NULL"))


# ---- ratings --------------------------------------------------------------------------------
@query("elo_update", """
SELECT match_id, ROUND(1 / (1 + pow(10, (b - a) / 400)), 6) AS expected, ROUND(a + 32 * (1 - 1 / (1 + pow(10, (b - a) / 400))), 6) AS updated
FROM (SELECT match_id, 1500e0 + 40 * games_played + t1_series_score AS a, 1500e0 + 35 * bestOf - t2_series_score AS b FROM matches)
""")
def _(c: Contests):
    df = c.matches().select("match_id", (1500.0 + 40 * F.col("games_played") + F.col("t1_series_score")).alias("a"),
                            (1500.0 + 35 * F.col("bestOf") - F.col("t2_series_score")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return df.select("match_id", F.round(X.elo_expected(a, b), 6).alias("expected"),
                     F.round(X.elo_update(a, b, F.lit(1.0)), 6).alias("updated"))


@query("elo_replay", """
SELECT match_id, ROUND(elo_t1_pre, 6) AS elo_t1_pre, ROUND(elo_t2_pre, 6) AS elo_t2_pre, ROUND(p_t1, 6) AS p_t1, result,
       ROUND(-(result * ln(p_t1) + (1 - result) * ln(1 - p_t1)), 6) AS logloss, ROUND((p_t1 - result) * (p_t1 - result), 6) AS brier FROM elo
""")
def _(c: Contests):
    replayed = rating.elo_replay(rating.one_pool(c.matches()), ["pool"])
    return replayed.select("match_id", *r6("elo_t1_pre", "elo_t2_pre", "p_t1"), "result", *r6("logloss", "brier"))


MAP_ELO = """
mi AS (SELECT m.match_id, m.game_id, m.datetime, m.map_name,
        (a.i - 1) {pool} AS i1, (b.i - 1) {pool} AS i2,
        CASE WHEN {won} THEN 1.0e0 ELSE 0.0e0 END AS s, ROW_NUMBER() OVER (ORDER BY datetime, match_id, game_id) AS rn
       FROM map_rows m JOIN team_no a ON a.team = m.team1 JOIN team_no b ON b.team = m.team2
       JOIN (SELECT map_name, CAST(ROW_NUMBER() OVER (ORDER BY map_name) AS INT) AS n FROM (SELECT DISTINCT map_name FROM map_rows)) x ON x.map_name = m.map_name),
ms(rn, st, r1, r2) AS (SELECT 0::BIGINT, list_transform(range(160), lambda x: 1500.0::DOUBLE), NULL::DOUBLE, NULL::DOUBLE
   UNION ALL SELECT o.rn, list_transform(e.st, lambda x, j: CASE
        WHEN j = o.i1 THEN x + 32 * (o.s - 1.0 / (1.0 + pow(10.0, (e.st[o.i2] - x) / 400.0)))
        WHEN j = o.i2 THEN x + 32 * ((1.0 - o.s) - 1.0 / (1.0 + pow(10.0, (e.st[o.i1] - x) / 400.0))) ELSE x END), e.st[o.i1], e.st[o.i2]
   FROM ms e JOIN mi o ON o.rn = e.rn + 1)
"""
BY_ROUNDS = "CASE WHEN score1_game <> score2_game THEN score1_game > score2_game ELSE team1_win = 1 END"


@query("elo_by_map", "WITH " + MAP_ELO.format(pool="* 6 + x.n", won=BY_ROUNDS) + """
SELECT mi.match_id, mi.game_id, mi.map_name, ROUND(r1, 6) AS elo_t1_pre, ROUND(r2, 6) AS elo_t2_pre, s AS result FROM ms JOIN mi ON mi.rn = ms.rn
""")
def _(c: Contests):
    maps = rating.map_results(c.map_rows()).select("match_id", "game_id", "datetime", "map_name", "team1", "team2", "result")
    return rating.elo_replay(maps, ["map_name"], order=("datetime", "match_id", "game_id")).select(
        "match_id", "game_id", "map_name", *r6("elo_t1_pre", "elo_t2_pre"), "result")


@query("elo_on_maps", "WITH " + MAP_ELO.format(pool="+ 1", won="team1_win = 1") + """
SELECT mi.match_id, mi.game_id, ROUND(r1 - r2, 6) AS elo_diff FROM ms JOIN mi ON mi.rn = ms.rn
""")
def _(c: Contests):
    maps = rating.one_pool(c.map_rows().select(
        "match_id", "game_id", "datetime", "team1", "team2", (F.col("team1_win") == 1).cast("double").alias("result")))
    return rating.elo_replay(maps, ["pool"], order=("datetime", "match_id", "game_id")).select(
        "match_id", "game_id", F.round(F.col("elo_t1_pre") - F.col("elo_t2_pre"), 6).alias("elo_diff"))


@query("elo_final", """
SELECT team, ROUND(arg_max(n, o), 4) AS rating FROM (
SELECT team1 AS team, elo_t1_post AS n, (datetime, match_id) AS o FROM elo UNION ALL SELECT team2, elo_t2_post, (datetime, match_id) FROM elo) GROUP BY team
""")
def _(c: Contests):
    return rating.final_ratings(c.replay(), ["pool"]).select("team", F.round("rating", 4).alias("rating"))


@query("elo_post_long", """
SELECT match_id, team1 AS team, ROUND(elo_t1_post, 6) AS elo FROM elo UNION ALL SELECT match_id, team2, ROUND(elo_t2_post, 6) FROM elo
""")
def _(c: Contests):
    return rating.post_long(c.replay(), ["match_id"]).select("match_id", "team", *r6("elo"))


@query("elo_monthly", """
WITH p AS (SELECT match_id, datetime, team1 AS team, elo_t1_post AS elo FROM elo UNION ALL SELECT match_id, datetime, team2, elo_t2_post FROM elo),
t AS (SELECT team FROM p GROUP BY team ORDER BY COUNT(*) DESC, team LIMIT 10)
SELECT team, strftime(datetime, '%Y-%m') AS month, MAX(datetime) AS datetime, ROUND(arg_max(elo, (datetime, match_id)), 6) AS elo
FROM p WHERE team IN (SELECT team FROM t) GROUP BY 1, 2
""")
def _(c: Contests):
    return rating.monthly_last(c.replay()).select("team", "month", "datetime", *r6("elo"))


@query("elo_gap_buckets", """
SELECT CASE WHEN g < 25 THEN 1 WHEN g < 50 THEN 2 WHEN g < 100 THEN 3 ELSE 4 END AS elo_bucket, COUNT(*) AS n, ROUND(1 - AVG(f), 6) AS upset_rate FROM (
SELECT ABS(elo_t1_pre - elo_t2_pre) AS g, CASE WHEN elo_t1_pre >= elo_t2_pre THEN CAST(winner = team1 AS INT) ELSE CAST(winner = team2 AS INT) END AS f FROM elo) GROUP BY 1
""")
def _(c: Contests):
    return rating.elo_gap_buckets(c.replay()).select("elo_bucket", "n", *r6("upset_rate"))


@query("elo_incremental", "SELECT match_id, ROUND(elo_t1_pre, 6) AS elo_t1_pre, ROUND(elo_t2_pre, 6) AS elo_t2_pre FROM elo")
def _(c: Contests):
    """Replay up to 1996, store the ratings, then rate the rest from that snapshot."""
    from faceoff.streaming.incremental import replay_after

    matches = rating.one_pool(c.matches())
    early = rating.elo_replay(matches.where("datetime < TIMESTAMP_NTZ '1996-01-01'"), ["pool"])
    late = replay_after(early, matches.where("datetime >= TIMESTAMP_NTZ '1996-01-01'"), ["pool"])
    return early.unionByName(late).select("match_id", *r6("elo_t1_pre", "elo_t2_pre"))


@query("elo_sliced", "SELECT match_id, ROUND(elo_t1_post, 6) AS elo_t1_post, ROUND(elo_t2_post, 6) AS elo_t2_post FROM elo")
def _(c: Contests):
    return rating.elo_replay(rating.one_pool(c.matches()), ["pool"], slice_rows=2000).select(
        "match_id", *r6("elo_t1_post", "elo_t2_post"))


@query("bo3_probability", "SELECT match_id, ROUND(p_t1 * p_t1 * (3 - 2 * p_t1), 6) AS p_series FROM elo")
def _(c: Contests):
    return c.replay().select("match_id", F.round(X.bo3_probability(F.col("p_t1")), 6).alias("p_series"))


@query("series_probability", """
SELECT match_id, ROUND(p_t1, 6) AS bo1, ROUND(3 * pow(p_t1, 2) * (1 - p_t1) + pow(p_t1, 3), 6) AS bo3,
       ROUND(10 * pow(p_t1, 3) * pow(1 - p_t1, 2) + 5 * pow(p_t1, 4) * (1 - p_t1) + pow(p_t1, 5), 6) AS bo5 FROM elo
""")
def _(c: Contests):
    p = F.col("p_t1")
    return c.replay().select("match_id", *[F.round(X.series_probability(p, n), 6).alias(f"bo{n}") for n in (1, 3, 5)])


# ---- one team's report ----------------------------------------------------------------------
TEAM_NAME = "NATION_7"
VS = f"""
vs AS (SELECT match_id, datetime, tournament AS event, tier, bestOf AS bo, CASE WHEN h THEN team2 ELSE team1 END AS opponent, winner = '{TEAM_NAME}' AS won,
       CASE WHEN h THEN t1_series_score ELSE t2_series_score END AS score_for, CASE WHEN h THEN t2_series_score ELSE t1_series_score END AS score_against,
       games_played AS maps_played, CASE WHEN h THEN elo_t1_pre ELSE elo_t2_pre END AS elo, CASE WHEN h THEN elo_t2_pre ELSE elo_t1_pre END AS opp_elo,
       CASE WHEN h THEN p_t1 ELSE 1 - p_t1 END AS p_win FROM (SELECT *, team1 = '{TEAM_NAME}' AS h FROM elo) WHERE h OR team2 = '{TEAM_NAME}'),
vm AS (SELECT *, round_for - round_against AS round_diff FROM (SELECT match_id, game_id, datetime, tournament AS event, map_name, bestOf AS bo,
       CASE WHEN h THEN team2 ELSE team1 END AS opponent, h = (team1_win = 1) AS won, CASE WHEN h THEN score1_game ELSE score2_game END AS round_for,
       CASE WHEN h THEN score2_game ELSE score1_game END AS round_against FROM (SELECT *, team1 = '{TEAM_NAME}' AS h FROM map_rows) WHERE h OR team2 = '{TEAM_NAME}'))
"""


def _vs(c: Contests):
    return clean.orient_to_team(c.replay(), TEAM_NAME)


def _vm(c: Contests):
    return clean.orient_maps(c.map_rows(), TEAM_NAME)


@query("orient_to_team", f"WITH {VS} SELECT match_id, event, tier, bo, opponent, won, score_for, score_against, maps_played, "
       "ROUND(elo, 6) AS elo, ROUND(opp_elo, 6) AS opp_elo, ROUND(p_win, 6) AS p_win, won AND score_against = 0 AS swept, "
       "maps_played = bo AS went_the_distance, score_against - score_for AS loss_margin FROM vs")
def _(c: Contests):
    return _vs(c).select("match_id", "event", "tier", "bo", "opponent", "won", "score_for", "score_against", "maps_played",
                         *r6("elo", "opp_elo", "p_win"), "swept", "went_the_distance", "loss_margin")


def _slots(stat: str) -> str:
    pick = ", ".join(f"CASE WHEN h THEN team1_player{i}_{stat} ELSE team2_player{i}_{stat} END" for i in range(1, 6))
    return f"[{pick}]"


@query("orient_maps", f"""
SELECT game_id, won, rf - ra AS round_diff, rf + ra > 24 AS overtime, ABS(rf - ra) <= 2 AS close, list_sum(k) AS team_kills, list_sum(d) AS team_deaths,
       list_sum(a) AS team_assists, ROUND(list_avg(r), 6) AS team_adr, ROUND(CASE WHEN list_avg(s) > 1.5 THEN list_avg(s) / 100 ELSE list_avg(s) END, 6) AS team_kast
FROM (SELECT game_id, h = (team1_win = 1) AS won, CASE WHEN h THEN score1_game ELSE score2_game END AS rf, CASE WHEN h THEN score2_game ELSE score1_game END AS ra,
      {_slots('kills')} AS k, {_slots('deaths')} AS d, {_slots('assists')} AS a, {_slots('adr')} AS r, {_slots('kast')} AS s
      FROM (SELECT *, team1 = '{TEAM_NAME}' AS h FROM map_rows) WHERE h OR team2 = '{TEAM_NAME}')
""")
def _(c: Contests):
    return _vm(c).select("game_id", "won", "round_diff", "overtime", "close", "team_kills", "team_deaths", "team_assists",
                         *r6("team_adr", "team_kast"))


REC = "CONCAT(CAST(SUM(CAST(won AS INT)) AS BIGINT), '-', CAST(SUM(CAST(NOT won AS INT)) AS BIGINT))"


@query("event_table", f"""WITH {VS}, a AS (SELECT event, COUNT(*) AS series, {REC} AS series_record, SUM(maps_played) AS e, CAST(MIN(datetime) AS DATE) AS first,
CAST(MAX(datetime) AS DATE) AS last FROM vs GROUP BY event), b AS (SELECT event, COUNT(*) AS n, {REC} AS map_record, AVG(CAST(won AS INT)) AS r FROM vm GROUP BY event)
SELECT a.event, series, series_record, COALESCE(map_record, '0-0') AS map_record, ROUND(r, 6) AS map_win_rate, CONCAT(COALESCE(n, 0), '/', CAST(e AS BIGINT)) AS map_coverage, first, last FROM a LEFT JOIN b ON a.event = b.event""")
def _(c: Contests):
    return teams.event_table(_vs(c), _vm(c)).withColumn("map_win_rate", F.round("map_win_rate", 6))


@query("month_table", f"""WITH {VS}, a AS (SELECT strftime(datetime, '%Y-%m') AS month, COUNT(*) AS series, {REC} AS record, AVG(CAST(won AS INT)) AS r, AVG(elo) AS e FROM vs GROUP BY 1),
b AS (SELECT strftime(datetime, '%Y-%m') AS month, COUNT(*) AS n, AVG(CAST(won AS INT)) AS r FROM vm GROUP BY 1)
SELECT a.month, series, record, ROUND(a.r, 6) AS series_win_rate, COALESCE(n, 0) AS maps, ROUND(b.r, 6) AS map_win_rate, ROUND(e, 1) AS avg_elo FROM a LEFT JOIN b ON a.month = b.month""")
def _(c: Contests):
    return teams.month_table(_vs(c), _vm(c)).withColumns(
        {n: F.round(n, 6) for n in ("series_win_rate", "map_win_rate")})


@query("map_table", f"WITH {VS} SELECT map_name AS map, COUNT(*) AS maps, {REC} AS record, ROUND(AVG(CAST(won AS INT)), 6) AS win_rate, ROUND(AVG(round_diff), 2) AS avg_round_diff, "
       "COUNT(*) FILTER (WHERE round_for + round_against > 24) AS overtime FROM vm GROUP BY 1")
def _(c: Contests):
    return teams.map_table(_vm(c)).withColumn("win_rate", F.round("win_rate", 6))


@query("opponent_table", f"""WITH {VS}, a AS (SELECT opponent, COUNT(*) AS series, {REC} AS record, AVG(CAST(won AS INT)) AS r, AVG(opp_elo) AS e FROM vs GROUP BY 1),
b AS (SELECT opponent, {REC} AS map_record FROM vm GROUP BY 1)
SELECT a.opponent, series, record, ROUND(r, 6) AS win_rate, COALESCE(map_record, '0-0') AS map_record, ROUND(e, 1) AS avg_opp_elo FROM a LEFT JOIN b ON a.opponent = b.opponent""")
def _(c: Contests):
    return teams.opponent_table(_vs(c), _vm(c)).withColumn("win_rate", F.round("win_rate", 6))


@query("format_table", f"WITH {VS} SELECT CASE WHEN bo IN (1, 3, 5) THEN 'Bo' || bo ELSE 'unknown' END AS format, COUNT(*) AS series, {REC} AS record, ROUND(AVG(CAST(won AS INT)), 6) AS win_rate FROM vs GROUP BY 1")
def _(c: Contests):
    return teams.format_table(_vs(c)).withColumn("win_rate", F.round("win_rate", 6))


@query("closeness", f"""WITH {VS}, a AS (SELECT COUNT(*) FILTER (WHERE ABS(round_diff) <= 2) AS close_maps, ROUND(AVG(CAST(won AS INT)) FILTER (WHERE ABS(round_diff) <= 2), 6) AS close_map_win_rate,
COUNT(*) FILTER (WHERE round_for + round_against > 24) AS overtime_maps, ROUND(AVG(CAST(won AS INT)) FILTER (WHERE round_for + round_against > 24), 6) AS overtime_win_rate FROM vm),
b AS (SELECT COUNT(*) FILTER (WHERE maps_played = bo) AS decider_series, ROUND(AVG(CAST(won AS INT)) FILTER (WHERE maps_played = bo), 6) AS decider_win_rate,
COUNT(*) FILTER (WHERE won AND score_against = 0 AND bo > 1) AS sweeps_for, COUNT(*) FILTER (WHERE NOT won AND score_for = 0 AND bo > 1) AS sweeps_against,
COUNT(*) FILTER (WHERE NOT won AND score_against - score_for = 1) AS one_map_losses, COUNT(*) FILTER (WHERE bo = 1) AS bo1 FROM vs) SELECT * FROM a, b""")
def _(c: Contests):
    return teams.closeness(_vm(c), _vs(c)).withColumns(
        {n: F.round(n, 6) for n in ("close_map_win_rate", "overtime_win_rate", "decider_win_rate")})


@query("elo_section", f"""WITH {VS} SELECT ROUND(arg_min(elo, (datetime, match_id)), 1) AS elo_start, ROUND(arg_max(elo, (datetime, match_id)), 1) AS elo_end, ROUND(MAX(elo), 1) AS elo_peak,
(SELECT CAST(datetime AS DATE) FROM vs ORDER BY elo DESC, datetime, match_id LIMIT 1) AS elo_peak_date, ROUND(MIN(elo), 1) AS elo_low, ROUND(AVG(opp_elo), 1) AS avg_opp_elo,
(SELECT opponent FROM vs ORDER BY opp_elo DESC, datetime, match_id LIMIT 1) AS hardest_opponent, ROUND(MAX(opp_elo), 1) AS hardest_opponent_elo, ROUND(SUM(p_win), 1) AS expected_series_wins,
CAST(SUM(CAST(won AS INT)) AS BIGINT) AS actual_series_wins, ROUND(SUM(CAST(won AS INT)) - SUM(p_win), 1) AS delta_vs_elo FROM vs""")
def _(c: Contests):
    return teams.elo_section(_vs(c))


@query("win_loss_record", f"WITH {VS} SELECT tier, CAST(SUM(CAST(won AS INT)) AS BIGINT) AS wins, CAST(SUM(CAST(NOT won AS INT)) AS BIGINT) AS losses, ROUND(AVG(CAST(won AS INT)), 6) AS win_rate FROM vs GROUP BY tier")
def _(c: Contests):
    return teams.win_loss_record(_vs(c), ["tier"]).withColumn("win_rate", F.round("win_rate", 6))


@query("best_worst", f"""WITH {VS} SELECT * FROM (SELECT 'win' AS kind, match_id, opponent, ROUND(opp_elo, 6) AS opp_elo FROM vs WHERE won ORDER BY vs.opp_elo DESC, datetime, match_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'loss', match_id, opponent, ROUND(opp_elo, 6) FROM vs WHERE NOT won ORDER BY vs.opp_elo, datetime, match_id LIMIT 5)""")
def _(c: Contests):
    return teams.best_worst(_vs(c)).select("kind", "match_id", "opponent", *r6("opp_elo"))


@query("team_expected", """SELECT team, ROUND(SUM(p), 6) AS expected_wins, CAST(SUM(win) AS BIGINT) AS actual_wins, ROUND(SUM(win) - SUM(p), 6) AS delta FROM (
SELECT team1 AS team, p_t1 AS p, CAST(winner = team1 AS INT) AS win FROM elo UNION ALL SELECT team2, 1 - p_t1, CAST(winner = team2 AS INT) FROM elo) GROUP BY team""")
def _(c: Contests):
    return teams.team_expected(teams.rated_long(c.replay())).select("team", *r6("expected_wins"), "actual_wins", *r6("delta"))


PL_TEAM = "pt AS (" + " UNION ALL ".join(
    f"SELECT match_id, game_id, datetime, team{n} AS team, team{n}_player{i} AS player, {'team1_win = 1' if n == 1 else 'team1_win <> 1'} AS won, "
    + ", ".join(f"team{n}_player{i}_{s} AS {s}" for s in longform.STATS) + " FROM map_rows"
    for n in (1, 2) for i in range(1, 6)) + ")"


@query("player_table", f"""WITH {PL_TEAM} SELECT player, COUNT(*) AS maps, SUM(kills) AS kills, SUM(deaths) AS deaths, COALESCE(SUM(assists), 0) AS assists, ROUND(AVG(adr), 6) AS adr,
ROUND(AVG(CAST(won AS INT)), 6) AS map_win_rate, MIN(datetime) AS first, MAX(datetime) AS last, ROUND(AVG(CASE WHEN kast > 1.5 THEN kast / 100 ELSE kast END), 6) AS kast, ROUND(SUM(kills) / SUM(deaths), 6) AS kd
FROM pt WHERE team = '{TEAM_NAME}' AND player IS NOT NULL GROUP BY player""")
def _(c: Contests):
    players = longform.player_long(c.map_rows()).where(F.col("team") == TEAM_NAME)
    return teams.player_table(players).withColumns({n: F.round(n, 6) for n in ("adr", "map_win_rate", "kast", "kd")})


@query("lineup_table", f"""WITH f AS (SELECT match_id, game_id, datetime, CASE WHEN team1 = '{TEAM_NAME}' THEN [{", ".join(f"team1_player{i}" for i in range(1, 6))}]
ELSE [{", ".join(f"team2_player{i}" for i in range(1, 6))}] END AS l FROM map_rows WHERE team1 = '{TEAM_NAME}' OR team2 = '{TEAM_NAME}')
SELECT array_to_string(list_sort(list_filter(l, lambda x: x IS NOT NULL)), ' / ') AS lineup, COUNT(DISTINCT match_id) AS series, COUNT(DISTINCT game_id) AS maps,
MIN(datetime) AS first, MAX(datetime) AS last FROM f GROUP BY 1""")
def _(c: Contests):
    return teams.lineup_table(c.map_rows(), TEAM_NAME)


@query("summary_long")
def _(c: Contests):
    maps = c.map_rows()
    players = longform.player_long(maps).where(F.col("team") == TEAM_NAME)
    return teams.summary_long(TEAM_NAME, "1992-01-01..1998-12-31", _vs(c), _vm(c), teams.player_table(players),
                              teams.lineup_table(maps, TEAM_NAME))


# ---- the question pack ----------------------------------------------------------------------
for _name, (_fn, _sql) in gold.PACK.items():
    query(_name, _sql)(lambda c, fn=_fn: fn(c.matches()))


@query("gold_check")
def _(c: Contests):
    return gold.check_pack(c.matches())
