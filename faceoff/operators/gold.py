"""The question pack: 24 analytical questions over the contest table.

Top-1 answers carry a name tie-break, so each question has exactly one answer. Dates are
parameters with defaults inside the span of the derived contests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faceoff.operators.history import TEAM, conversion_after_form, win_streaks
from faceoff.operators.longform import side_long

YEAR = 1996
c = F.col


def n_rows(name: str):
    return F.count("*").alias(name)


def _one(value: str, df: DataFrame, *order) -> DataFrame:
    return df.orderBy(F.desc(value), *order).limit(1)


def most_wins(m: DataFrame) -> DataFrame:
    return _one("n_wins", m.groupBy(c("winner").alias("team")).agg(n_rows("n_wins")), "team")


def series_per_tier(m: DataFrame) -> DataFrame:
    return m.groupBy("tier").agg(n_rows("n_series"))


def least_active(m: DataFrame) -> DataFrame:
    return side_long(m).groupBy("team").agg(n_rows("n_series")).orderBy("n_series", "team").limit(10)


def mean_maps_per_tier(m: DataFrame) -> DataFrame:
    return m.groupBy("tier").agg(F.round(F.avg("games_played"), 6).alias("avg_maps"))


def in_year(m: DataFrame) -> DataFrame:
    day = F.to_date("datetime")
    return m.where(day.between(F.lit(f"{YEAR}-01-01").cast("date"), F.lit(f"{YEAR}-12-31").cast("date"))).agg(
        n_rows("n_year"))


def last_six_months(m: DataFrame) -> DataFrame:
    latest = m.agg(F.max("datetime").alias("_latest"))      # one row
    return m.where("tier = 'tier1'").crossJoin(F.broadcast(latest)).where(
        c("datetime") >= c("_latest") - F.expr("INTERVAL '6' MONTH")).agg(n_rows("n"))


def before_date(m: DataFrame) -> DataFrame:
    return m.where(c("datetime") < F.lit(f"{YEAR}-01-01").cast("timestamp_ntz")).agg(n_rows("n_before"))


def busiest_month(m: DataFrame) -> DataFrame:
    return _one("n", m.groupBy(F.trunc("datetime", "month").alias("month")).agg(n_rows("n")), "month")


def longest_streak(m: DataFrame) -> DataFrame:
    best = win_streaks(side_long(m), 1).groupBy("team").agg(F.max("streak_length").alias("best_streak"))
    return _one("best_streak", best, "team")


def busiest_oriented_pair(m: DataFrame) -> DataFrame:
    pairs = side_long(m).groupBy(c("team").alias("team_a"), c("opponent").alias("team_b")).agg(n_rows("n"))
    return _one("n", pairs, "team_a", "team_b")


def share_per_team(m: DataFrame) -> DataFrame:
    return side_long(m).groupBy("team").agg(n_rows("n_series"), F.round(F.avg("win"), 6).alias("win_share"))


def after_good_form(m: DataFrame) -> DataFrame:
    return conversion_after_form(side_long(m), line=TEAM).select(
        F.round("conversion_after_good_form", 6).alias("conversion_after_good_form"))


def true_formats(m: DataFrame) -> DataFrame:
    return m.groupBy(F.when(c("games_played") == 1, "bo1").otherwise("multi").alias("fmt")).agg(n_rows("n"))


def shortened_bo3(m: DataFrame) -> DataFrame:
    short = m.where("bestOf = 3 AND games_played = 1").groupBy("tournament").agg(n_rows("n"))
    return _one("n", short, "tournament")


def first_listed_share(m: DataFrame) -> DataFrame:
    return m.agg(F.round(F.avg((c("winner") == c("team1")).cast("int")), 6).alias("team1_win_share"))


def sweep_rate_by_tier(m: DataFrame) -> DataFrame:
    swept = ((c("t1_series_score") == 0) | (c("t2_series_score") == 0)) & (c("games_played") >= 2)
    return m.groupBy("tier").agg(F.round(F.avg(swept.cast("int")), 6).alias("sweep_rate"))


def sweep_share_given_win(m: DataFrame) -> DataFrame:
    return m.where((c("winner") == c("team1")) & (c("games_played") >= 2)).agg(
        F.round(F.avg((c("t2_series_score") == 0).cast("int")), 6).alias("t1_sweep_share"))


def busiest_tournament_half_year(m: DataFrame) -> DataFrame:
    lo, hi = (F.lit(f"{YEAR}-{mm}-01").cast("timestamp_ntz") for mm in ("01", "07"))
    half = m.where((c("datetime") >= lo) & (c("datetime") < hi)).groupBy("tournament").agg(n_rows("n"))
    return _one("n", half, "tournament")


def tournament_count(m: DataFrame) -> DataFrame:
    return m.agg(F.countDistinct("tournament").alias("n_tournaments"))


def most_bo5_wins(m: DataFrame) -> DataFrame:
    return _one("n_bo5_wins", m.where("bestOf = 5").groupBy("winner").agg(n_rows("n_bo5_wins")), "winner")


def most_appearances(m: DataFrame) -> DataFrame:
    sides = [m.groupBy(c(s).alias("team")).agg(n_rows("n")) for s in ("team1", "team2")]
    both = sides[0].unionByName(sides[1]).groupBy("team").agg(F.sum("n").alias("n_appearances"))
    return _one("n_appearances", both, "team")


def per_year(m: DataFrame) -> DataFrame:
    return m.groupBy(F.date_format("datetime", "yyyy").alias("yr")).agg(n_rows("n"))


def busiest_pair(m: DataFrame) -> DataFrame:
    pairs = m.groupBy(F.least("team1", "team2").alias("a"), F.greatest("team1", "team2").alias("b")).agg(n_rows("n"))
    return _one("n", pairs, "a", "b")


def mean_maps_claimed_bo3(m: DataFrame) -> DataFrame:
    return m.where("bestOf = 3").agg(F.round(F.avg("games_played"), 6).alias("avg_maps"))


_SWEEP = "CASE WHEN (t1_series_score = 0 OR t2_series_score = 0) AND games_played >= 2 THEN 1 ELSE 0 END"

PACK = {
    "gold_most_wins": (most_wins, "SELECT winner AS team, COUNT(*) AS n_wins FROM matches GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"),
    "gold_series_per_tier": (series_per_tier, "SELECT tier, COUNT(*) AS n_series FROM matches GROUP BY 1"),
    "gold_least_active": (least_active, "SELECT team, COUNT(*) AS n_series FROM long GROUP BY 1 ORDER BY 2, 1 LIMIT 10"),
    "gold_mean_maps_per_tier": (mean_maps_per_tier, "SELECT tier, ROUND(AVG(games_played), 6) AS avg_maps FROM matches GROUP BY 1"),
    "gold_in_year": (in_year, f"SELECT COUNT(*) AS n_year FROM matches WHERE year(datetime) = {YEAR}"),
    "gold_last_six_months": (last_six_months, "SELECT COUNT(*) AS n FROM matches WHERE tier = 'tier1' AND datetime >= (SELECT MAX(datetime) FROM matches) - INTERVAL 6 MONTH"),
    "gold_before_date": (before_date, f"SELECT COUNT(*) AS n_before FROM matches WHERE year(datetime) < {YEAR}"),
    "gold_busiest_month": (busiest_month, "SELECT CAST(date_trunc('month', datetime) AS DATE) AS month, COUNT(*) AS n FROM matches GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"),
    "gold_longest_streak": (longest_streak, """WITH o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY datetime, match_id)
        - ROW_NUMBER() OVER (PARTITION BY team, win ORDER BY datetime, match_id) AS g FROM long)
        SELECT team, MAX(n) AS best_streak FROM (SELECT team, COUNT(*) AS n FROM o WHERE win = 1 GROUP BY team, g) GROUP BY team ORDER BY 2 DESC, 1 LIMIT 1"""),
    "gold_busiest_oriented_pair": (busiest_oriented_pair, "SELECT team AS team_a, opponent AS team_b, COUNT(*) AS n FROM long GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 1"),
    "gold_share_per_team": (share_per_team, "SELECT team, COUNT(*) AS n_series, ROUND(AVG(win), 6) AS win_share FROM long GROUP BY 1"),
    "gold_after_good_form": (after_good_form, """WITH w AS (SELECT win, SUM(win) OVER q AS s, COUNT(*) OVER q AS k FROM long
        WINDOW q AS (PARTITION BY team ORDER BY datetime, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
        SELECT ROUND(AVG(win), 6) AS conversion_after_good_form FROM w WHERE k = 5 AND s >= 3"""),
    "gold_true_formats": (true_formats, "SELECT CASE games_played WHEN 1 THEN 'bo1' ELSE 'multi' END AS fmt, COUNT(*) AS n FROM matches GROUP BY 1"),
    "gold_shortened_bo3": (shortened_bo3, "SELECT tournament, COUNT(*) AS n FROM matches WHERE games_played = 1 AND bestOf = 3 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"),
    "gold_first_listed_share": (first_listed_share, "SELECT ROUND(AVG(CAST(winner = team1 AS INT)), 6) AS team1_win_share FROM matches"),
    "gold_sweep_rate_by_tier": (sweep_rate_by_tier, f"SELECT tier, ROUND(AVG({_SWEEP}), 6) AS sweep_rate FROM matches GROUP BY 1"),
    "gold_sweep_share_given_win": (sweep_share_given_win, "SELECT ROUND(AVG(CAST(t2_series_score = 0 AS INT)), 6) AS t1_sweep_share FROM matches WHERE games_played >= 2 AND winner = team1"),
    "gold_busiest_tournament_half_year": (busiest_tournament_half_year, f"SELECT tournament, COUNT(*) AS n FROM matches WHERE year(datetime) = {YEAR} AND month(datetime) <= 6 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"),
    "gold_tournament_count": (tournament_count, "SELECT COUNT(DISTINCT tournament) AS n_tournaments FROM matches"),
    "gold_most_bo5_wins": (most_bo5_wins, "SELECT winner, COUNT(*) AS n_bo5_wins FROM matches WHERE bestOf = 5 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"),
    "gold_most_appearances": (most_appearances, "SELECT team, COUNT(*) AS n_appearances FROM long GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"),
    "gold_per_year": (per_year, "SELECT strftime(datetime, '%Y') AS yr, COUNT(*) AS n FROM matches GROUP BY 1"),
    "gold_busiest_pair": (busiest_pair, "SELECT LEAST(team1, team2) AS a, GREATEST(team1, team2) AS b, COUNT(*) AS n FROM matches GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 1"),
    "gold_mean_maps_claimed_bo3": (mean_maps_claimed_bo3, "SELECT ROUND(AVG(games_played), 6) AS avg_maps FROM matches WHERE bestOf = 3"),
}


def check_pack(m: DataFrame) -> DataFrame:
    """Does every question have an answer: at least one row and not a single all-null row."""
    parts = []
    for name, (fn, _) in PACK.items():
        answer = fn(m)
        empty = reduce(lambda a, b: a & b, [c(x).isNull() for x in answer.columns])
        parts.append(answer.agg(F.count("*").alias("n_rows"), F.count_if(empty).alias("n_null")).select(
            F.lit(name).alias("question"), "n_rows",
            ((c("n_rows") > 0) & ~((c("n_rows") == 1) & (c("n_null") == 1))).alias("answered")))
    return reduce(DataFrame.unionByName, parts)
