"""Registered queries: models, calibration, backtests, strengths, batch scoring, forecast."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faceoff.operators import clean, evaluate, features, forecast, history, models, rating
from faceoff.plans.queries_evaluate import rated, store
from faceoff.plans.queries_history import r6
from faceoff.plans.registry import Contests, query
from faceoff.session import shared_folder

CUT = "2000-01-01"
ROSTER = list(features.ROSTER_FEATURES)
c_ = F.col


def matrix(c: Contests, extra: list[str] = ROSTER):
    rows, names = features.feature_matrix(store(c), extra, CUT)
    return rows.where("split = 'train'"), rows.where("split = 'test'"), names


def _metrics(scored: DataFrame) -> DataFrame:
    return evaluate.score(scored, p="p", y="label").crossJoin(evaluate.ece(scored, p="p", y="label"))      # one row each


@query("fit_logistic")
def _(c: Contests):
    train, test, _ = matrix(c)
    return _metrics(models.predict_proba(models.fit_logistic(train), test))


@query("fit_gbm")
def _(c: Contests):
    train, test, _ = matrix(c)
    return _metrics(models.predict_proba(models.fit_gbm(train), test))


@query("fit_gbm_isotonic")
def _(c: Contests):
    train, test, _ = matrix(c, [])
    return _metrics(models.predict_proba(models.fit_gbm_isotonic(train), test))


@query("predict_proba")
def _(c: Contests):
    train, test, _ = matrix(c)
    return models.predict_proba(models.fit_logistic(train), test).select("match_id", "p", "label")


def _scored_split(c: Contests):
    train, test, _ = matrix(c)
    model = models.fit_logistic(train)
    keep = ["match_id", "tier", "label", "p"]
    return models.predict_proba(model, train).select(*keep), models.predict_proba(model, test).select(*keep)


@query("calibrate_per_group")
def _(c: Contests):
    train, test = _scored_split(c)
    return models.calibrate_per_group(train, test)[0]


@query("tier_calibration_report")
def _(c: Contests):
    train, test = _scored_split(c)
    return models.tier_calibration_report(train, test)


CALIBRATED = f"""cr AS (SELECT match_id, tier, ROUND(p_t1, 2) AS p, result AS y, datetime < TIMESTAMP '{CUT}' AS train FROM elo),
ce AS MATERIALIZED (SELECT tier, p, SUM(y) AS s, COUNT(*)::DOUBLE AS n FROM cr WHERE train AND tier IS NOT NULL GROUP BY 1, 2)"""


def platt_sql(steps: int = 15) -> str:
    """Newton steps on the slope and offset of every tier, up to ``w<steps>``."""
    parts = ["lx AS MATERIALIZED (SELECT tier, ln(p / (1 - p)) AS x, s, n FROM ce)", "w0 AS MATERIALIZED (SELECT DISTINCT tier, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM ce)"]
    for k in range(1, steps + 1):
        q = "1 / (1 + exp(-(a * x + b)))"
        parts.append(f"""g{k} AS MATERIALIZED (SELECT tier, a, b, SUM((s - n * {q}) * x) - a AS ga, SUM(s - n * {q}) AS gb, SUM(n * {q} * (1 - {q}) * x * x) + 1 AS haa, SUM(n * {q} * (1 - {q}) * x) AS hab, SUM(n * {q} * (1 - {q})) AS hbb
  FROM lx JOIN w{k - 1} USING (tier) GROUP BY tier, a, b)""")
        parts.append(f"w{k} AS MATERIALIZED (SELECT tier, a + (ga * hbb - gb * hab) / (haa * hbb - hab * hab) AS a, b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM g{k})")
    return ", ".join(parts)


def _elo_split(c: Contests):
    rows = c.replay().select("match_id", "datetime", "tier", F.round("p_t1", 2).alias("p"), c_("result").alias("label"))
    early = F.col("datetime") < F.lit(CUT).cast(rows.schema["datetime"].dataType)
    return rows.where(early), rows.where(~early)


@query("platt_by_tier", f"""WITH {CALIBRATED}, {platt_sql()}
SELECT match_id, tier, p, ROUND(COALESCE(1 / (1 + exp(-(a * ln(p / (1 - p)) + b))), p), 6) AS p_cal FROM cr LEFT JOIN w15 USING (tier) WHERE NOT train""")
def _(c: Contests):
    train, test = _elo_split(c)
    return models.calibrate_per_group(train, test, "platt")[0].select("match_id", "tier", "p", *r6("p_cal"))


@query("isotonic_by_tier", f"""WITH {CALIBRATED},
cu AS (SELECT *, SUM(s) OVER o AS cs, SUM(n) OVER o AS cn, ROW_NUMBER() OVER o AS i FROM ce WINDOW o AS (PARTITION BY tier ORDER BY p)),
mm AS (SELECT a.tier, a.i, b.i AS j, b.p, MIN((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)) OVER (PARTITION BY a.tier, a.i ORDER BY b.i DESC) AS low FROM cu a JOIN cu b ON a.tier = b.tier AND a.i <= b.i),
kn AS (SELECT tier, p, MAX(low) AS v FROM mm GROUP BY tier, p)
SELECT match_id, cr.tier, cr.p, ROUND(COALESCE(CASE WHEN lo.p IS NULL THEN hi.v WHEN hi.p IS NULL OR lo.p = hi.p THEN lo.v ELSE lo.v + (hi.v - lo.v) * (cr.p - lo.p) / (hi.p - lo.p) END, cr.p), 6) AS p_cal
FROM cr ASOF LEFT JOIN kn lo ON lo.tier = cr.tier AND lo.p <= cr.p ASOF LEFT JOIN kn hi ON hi.tier = cr.tier AND hi.p >= cr.p WHERE NOT cr.train""")
def _(c: Contests):
    train, test = _elo_split(c)
    return models.calibrate_per_group(train, test, "isotonic")[0].select("match_id", "tier", "p", *r6("p_cal"))


CUTOFFS = ["1995-06-01", "1998-01-01", "1999-01-01", "2000-01-01", "2001-01-01"]


@query("rolling_backtest")
def _(c: Contests):
    return models.rolling_backtest(store(c), CUTOFFS, ROSTER)


@query("summarize_folds", """
WITH f AS (SELECT year(datetime) AS fold, -AVG(result * ln(p_t1) + (1 - result) * ln(1 - p_t1)) AS logloss, AVG(pow(p_t1 - result, 2)) AS brier, AVG(CAST((p_t1 >= 0.5) = (result = 1) AS INT)) AS acc FROM elo GROUP BY 1),
l AS (SELECT 'logloss' AS metric, logloss AS v FROM f UNION ALL SELECT 'brier', brier FROM f UNION ALL SELECT 'acc', acc FROM f)
SELECT metric, ROUND(AVG(v), 6) AS mean, ROUND(STDDEV_SAMP(v) / sqrt(COUNT(*)), 6) AS sem, COUNT(*) AS n_folds FROM l GROUP BY metric""")
def _(c: Contests):
    yearly = c.replay().select(F.year("datetime").alias("fold"), c_("p_t1").alias("p"), c_("result").alias("y"))
    return models.summarize_folds(evaluate.score(yearly, ["fold"])).select("metric", *r6("mean", "sem"), "n_folds")


@query("map_win_model")
def _(c: Contests):
    maps = clean.trusted_maps(c.map_rows()).select(
        "match_id", "game_id", "datetime", "map_name", "team1", "team2", "team1_win", (c_("team1_win") == 1).cast("double").alias("result"))
    elo = rating.elo_replay(rating.one_pool(maps), ["pool"], order=("datetime", "match_id", "game_id")).select(
        "match_id", "game_id", "datetime", "map_name", (c_("elo_t1_pre") - c_("elo_t2_pre")).alias("elo_diff"), c_("result").alias("label"))
    shares = history.team_map_winrate(maps)
    rows = elo.join(shares, ["match_id", "game_id"]).withColumn("map_wr_diff", c_("team1_map_wr") - c_("team2_map_wr"))
    rows = evaluate.with_split(rows, CUT)
    model = models.map_win_model(rows.where("split = 'train'"))
    return _metrics(model.transform(rows.where("split = 'test'")).withColumn("p", models._p()))


@query("strength_subset", """
WITH s AS (SELECT * FROM matches WHERE tier = 'tier1' AND year(datetime) BETWEEN 1997 AND 1999),
k AS (SELECT team FROM (SELECT team1 AS team FROM s UNION ALL SELECT team2 FROM s) GROUP BY team HAVING COUNT(*) >= 60)
SELECT match_id, team1, team2 FROM s WHERE team1 IN (SELECT team FROM k) AND team2 IN (SELECT team FROM k)""")
def _(c: Contests):
    return models.strength_subset(c.matches(), "tier1", (1997, 1999), 60).select("match_id", "team1", "team2")


def strengths_sql(contests: str, sigma: str, steps: int = 40) -> str:
    """Common table expressions up to ``bt``: damped diagonal Newton steps, each followed by the best common shift."""
    parts = [f"""pr AS MATERIALIZED (SELECT team, opponent, COUNT(*)::DOUBLE AS n, SUM(win)::DOUBLE AS w FROM (
  SELECT team1 AS team, team2 AS opponent, CAST(winner = team1 AS INT) AS win FROM {contests} UNION ALL SELECT team2, team1, CAST(winner = team2 AS INT) FROM {contests}) GROUP BY 1, 2)""",
             f"pi AS MATERIALIZED (SELECT team, n, 1 / pow({sigma}, 2) AS tau FROM (SELECT team, SUM(n) AS n FROM pr GROUP BY 1))",
             "t0 AS MATERIALIZED (SELECT team, n, tau, 0.0::DOUBLE AS th, 0.0::DOUBLE AS info FROM pi)"]
    for k in range(1, steps + 1):
        odds = "1 / (1 + exp(b.th - a.th))"
        parts.append(f"""u{k} AS MATERIALIZED (SELECT a.team, a.n, a.tau, a.th + 0.9 * (2 * SUM(pr.w - pr.n * {odds}) - a.th * a.tau) / (2 * SUM(pr.n * {odds} * (1 - {odds})) + a.tau) AS th,
  2 * SUM(pr.n * {odds} * (1 - {odds})) + a.tau AS info FROM t{k - 1} a JOIN pr ON pr.team = a.team JOIN t{k - 1} b ON b.team = pr.opponent GROUP BY a.team, a.n, a.tau, a.th)""")
        parts.append(f"t{k} AS MATERIALIZED (SELECT team, n, tau, th - (SELECT SUM(th * tau) / SUM(tau) FROM u{k}) AS th, info FROM u{k})")
    parts.append(f"bt AS (SELECT team, n AS n_series, 1500 + 173 * th AS m, 1.8807936081512509e0 * 173 / sqrt(info) AS h FROM t{steps})")
    return ", ".join(parts)


WIDE, POOLED = "(350.0 / 173.0)", "(350.0 / 173.0 * n / (n + 30.0))"
STRENGTHS = "SELECT team, CAST(n_series AS BIGINT) AS n_series, ROUND(m, 3) AS posterior_mean, ROUND(m - h, 3) AS lo, ROUND(m + h, 3) AS hi FROM bt"


def _r3(df: DataFrame) -> DataFrame:
    return df.select("team", "n_series", *[F.round(n, 3).alias(n) for n in ("posterior_mean", "lo", "hi")])


@query("bradley_terry", f"WITH {strengths_sql('matches', WIDE)} {STRENGTHS}")
def _(c: Contests):
    return _r3(models.bradley_terry(c.matches()))


@query("bradley_terry_pooled", f"""WITH s AS (SELECT * FROM matches WHERE tier = 'tier1' AND year(datetime) BETWEEN 1997 AND 1999),
kt AS (SELECT team FROM (SELECT team1 AS team FROM s UNION ALL SELECT team2 FROM s) GROUP BY team HAVING COUNT(*) >= 10),
sb AS MATERIALIZED (SELECT * FROM s WHERE team1 IN (SELECT team FROM kt) AND team2 IN (SELECT team FROM kt)), {strengths_sql('sb', POOLED)} {STRENGTHS}""")
def _(c: Contests):
    return _r3(models.bradley_terry(models.strength_subset(c.matches(), "tier1", (1997, 1999)), hierarchical=True))


@query("rating_agreement", f"""WITH {strengths_sql('matches', WIDE)},
ag AS (SELECT 1 / (1 + pow(10, (elo_t2_pre - elo_t1_pre) / 400)) AS e, 1 / (1 + exp((y.m - x.m) / 173)) AS s FROM elo JOIN bt x ON x.team = team1 JOIN bt y ON y.team = team2)
SELECT COUNT(*) AS n, ROUND(AVG(ABS(e - s)), 6) AS mae, ROUND(corr(e, s), 6) AS pearson_r FROM ag""")
def _(c: Contests):
    return models.rating_agreement(c.replay(), models.bradley_terry(c.matches())).select("n", *r6("mae", "pearson_r"))


@query("encode_entities", f"""
WITH v AS (SELECT team, ROW_NUMBER() OVER (ORDER BY team) AS i FROM (SELECT team1 AS team FROM matches WHERE datetime < TIMESTAMP '1997-06-01' UNION SELECT team2 FROM matches WHERE datetime < TIMESTAMP '1997-06-01'))
SELECT match_id, COALESCE(a.i, 0) AS team1_idx, COALESCE(b.i, 0) AS team2_idx FROM matches m LEFT JOIN v a ON a.team = m.team1 LEFT JOIN v b ON b.team = m.team2""")
def _(c: Contests):
    early = c.matches().where("datetime < TIMESTAMP_NTZ '1997-06-01'")
    return models.encode_entities(early, c.matches().select("match_id", "team1", "team2")).select("match_id", "team1_idx", "team2_idx")


@query("entity_factor_model")
def _(c: Contests):
    rows = store(c).join(c.matches().select("match_id", "team1", "team2"), "match_id").select(
        "match_id", "datetime", "team1", "team2", "elo_diff", "form5_diff", c_("result").alias("label"))
    rows = evaluate.with_split(rows, CUT)
    model = models.entity_factor_model(rows.where("split = 'train'"), ["elo_diff", "form5_diff"])
    return _metrics(model.transform(rows.where("split = 'test'")).withColumn("p", models._p()))


@query("embedding_pairs", """
WITH p AS (SELECT LEAST(team1, team2) AS a, GREATEST(team1, team2) AS b, COUNT(*) AS n, COUNT(*) FILTER (WHERE winner = LEAST(team1, team2)) AS aw FROM matches GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20),
v AS (SELECT n_name AS team, embedding AS e FROM nation JOIN embeddings ON vec_id = n_nationkey)
SELECT a, b, n, aw AS a_wins, n - aw AS b_wins, ROUND(list_cosine_similarity(x.e::DOUBLE[], y.e::DOUBLE[]), 6) AS cosine FROM p JOIN v x ON x.team = a JOIN v y ON y.team = b""")
def _(c: Contests):
    vectors = c.table("nation").join(c.table("embeddings"), c_("vec_id") == c_("n_nationkey")).select(
        c_("n_name").alias("team"), c_("embedding").alias("vector"))
    return models.embedding_pairs(c.matches(), vectors, 20).select("a", "b", "n", "a_wins", "b_wins", *r6("cosine"))


@query("permutation_importance")
def _(c: Contests):
    train, test, names = matrix(c, [])
    return models.permutation_importance(models.fit_logistic(train), test, names)


@query("leakage_demo")
def _(c: Contests):
    return models.leakage_demo(store(c), CUT, {"lr": models.fit_logistic, "gbm": models.fit_gbm})


@query("model_table")
def _(c: Contests):
    scored = models.compare_models(store(c), CUT, {
        "lr": (models.fit_logistic, []), "lr+roster": (models.fit_logistic, ROSTER), "gbm": (models.fit_gbm, [])})
    elo = c.replay().where(f"datetime >= TIMESTAMP_NTZ '{CUT}'").select(
        "match_id", F.lit("elo_k32").alias("model"), c_("p_t1").alias("p"), c_("result").alias("y"))
    return models.model_table(scored.unionByName(elo))


@query("score_batch")
def _(c: Contests):
    train, _, names = matrix(c)
    requests = c.derive("pairing").select(
        c_("match_id").alias("request_id"), "team1", "team2", (c_("bestOf") + F.when(c_("match_id") % 50 == 0, 1).otherwise(0)).alias("best_of"),
        F.when(c_("match_id") % 2 == 0, 0.2).alias("form5_diff"))
    return models.score_batch(models.fit_logistic(train), names, requests, rated(c))


@query("train_run")
def _(c: Contests):
    folder = f"{shared_folder(c.spark)}/run-{uuid.uuid4().hex}"
    return models.train_run(store(c), rating.final_ratings(c.replay(), ["pool"]), folder, CUT, ROSTER).drop("feature_names")


@query("dated_roster_ab")
def _(c: Contests):
    from faceoff.operators import players
    slots = players.lineup_players(c.series_rows().where("seq = 1"))
    tenure = players.asof_tenure(slots, c.derive("transfers").select(c_("to_team").alias("team"), "player", "date"))
    return models.dated_roster_ab(store(c), tenure, CUT)


@query("holt_forecast")
def _(c: Contests):
    return forecast.holt_forecast(rating.monthly_last(c.replay()))


@query("naive_forecast_error", """
WITH p AS (SELECT match_id, datetime, team1 AS team, elo_t1_post AS elo FROM elo UNION ALL SELECT match_id, datetime, team2, elo_t2_post FROM elo),
t AS (SELECT team FROM p GROUP BY team ORDER BY COUNT(*) DESC, team LIMIT 10),
m AS (SELECT team, strftime(datetime, '%Y-%m') AS month, arg_max(elo, (datetime, match_id)) AS elo FROM p WHERE team IN (SELECT team FROM t) GROUP BY 1, 2),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY month DESC) AS back, COUNT(*) OVER (PARTITION BY team) AS n FROM m)
SELECT a.team, CAST(MAX(a.n) AS INT) AS n_months, ROUND(AVG(ABS((a.elo - b.elo) / a.elo)) * 100, 6) AS mape_naive FROM r a JOIN r b ON b.team = a.team AND b.back = 4 WHERE a.back <= 3 AND a.n >= 27 GROUP BY 1""")
def _(c: Contests):
    return forecast.holt_forecast(rating.monthly_last(c.replay())).where("step = 1").select("team", "n_months", *r6("mape_naive"))



@query("holt_smooth", """
WITH p AS (SELECT match_id, datetime, team1 AS team, elo_t1_post AS elo FROM elo UNION ALL SELECT match_id, datetime, team2, elo_t2_post FROM elo),
t AS (SELECT team FROM p GROUP BY team ORDER BY COUNT(*) DESC, team LIMIT 10),
m AS (SELECT team, strftime(datetime, '%Y-%m') AS month, arg_max(elo, (datetime, match_id)) AS elo FROM p WHERE team IN (SELECT team FROM t) GROUP BY 1, 2),
sr AS (SELECT team, elo, ROW_NUMBER() OVER (PARTITION BY team ORDER BY month) AS i, COUNT(*) OVER (PARTITION BY team) AS n FROM m),
ho(team, n, i, lv, tr, sse) AS (
  SELECT a.team, a.n, 2::BIGINT, b.elo, b.elo - a.elo, 0.0::DOUBLE FROM sr a JOIN sr b ON b.team = a.team AND a.i = 1 AND b.i = 2
  UNION ALL
  SELECT h.team, h.n, h.i + 1, 0.3e0 * s.elo + 0.7e0 * (h.lv + h.tr), 0.3e0 * s.elo + 0.7e0 * (h.lv + h.tr) - h.lv, h.sse + pow(s.elo - h.lv - h.tr, 2)
  FROM ho h JOIN sr s ON s.team = h.team AND s.i = h.i + 1)
SELECT team, CAST(n AS INT) AS n_months, ROUND(lv, 6) AS level, ROUND(tr, 6) AS trend, ROUND(sse / (n - 2), 6) AS mse FROM ho WHERE i = n AND n > 2""")
def _(c: Contests):
    return forecast.smooth_at(rating.monthly_last(c.replay()), 0.3).select("team", "n_months", *r6("level", "trend", "mse"))
