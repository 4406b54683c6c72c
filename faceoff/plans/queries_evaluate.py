"""Registered queries: probability quality, market edge, drift, feature store."""

from __future__ import annotations

from pyspark.sql import functions as F

from faceoff.functions import scalar as X
from faceoff.operators import clean, evaluate, features, gold, history, longform, rating
from faceoff.plans.queries_history import BY_ROUNDS, LINEUPS, MAP_ELO, r6
from faceoff.plans.registry import ORACLES, Contests, query

CUT = "1996-06-01"
LL = "-({y} * ln(LEAST(GREATEST({p}, 1e-15), 1 - 1e-15)) + (1 - {y}) * ln(1 - LEAST(GREATEST({p}, 1e-15), 1 - 1e-15)))"


def loss(p: str = "p_t1", y: str = "result") -> str:
    return (f"ROUND(AVG({LL.format(p=p, y=y)}), 6) AS logloss, ROUND(AVG(({p} - {y}) * ({p} - {y})), 6) AS brier, "
            f"ROUND(AVG(CAST(({p} >= 0.5) = ({y} = 1) AS INT)), 6) AS acc, COUNT(*) AS n")


def scored(c: Contests):
    return c.replay().select("match_id", "datetime", "tier", "games_played", F.lit("elo_k32").alias("model"),
                             F.col("p_t1").alias("p"), F.col("result").alias("y"))


def rl(df):
    return df.withColumns({n: F.round(n, 6) for n in ("logloss", "brier", "acc")})


@query("log_loss", f"SELECT tier, {loss()} FROM elo GROUP BY tier")
def _(c: Contests):
    return rl(evaluate.score(scored(c), ["tier"]))


@query("summarize_split", f"""
SELECT 'elo_k32' AS model, CASE WHEN datetime < TIMESTAMP '{CUT}' THEN 'train' ELSE 'test' END AS split, {loss()} FROM elo GROUP BY 2
UNION ALL SELECT 'constant_0.5', CASE WHEN datetime < TIMESTAMP '{CUT}' THEN 'train' ELSE 'test' END, {loss('0.5')} FROM elo GROUP BY 2
""")
def _(c: Contests):
    return rl(evaluate.summarize_split(scored(c), CUT))


@query("elo_k_sweep", f"""
SELECT 'elo_k' || CAST(k AS INT) AS model, CASE WHEN datetime < TIMESTAMP '{CUT}' THEN 'train' ELSE 'test' END AS split, {loss()} FROM elo_all GROUP BY 1, 2
""")
def _(c: Contests):
    matches = rating.with_k_values(rating.one_pool(c.matches().select("match_id", "datetime", "team1", "team2", "winner")))
    replayed = rating.elo_replay(matches, ["pool", "k"])
    rows = replayed.select("datetime", F.concat(F.lit("elo_k"), F.col("k").cast("int").cast("string")).alias("model"),
                           F.col("p_t1").alias("p"), F.col("result").alias("y"))
    return rl(evaluate.score(evaluate.with_split(rows, CUT), ["model", "split"]))


@query("backtest_table", "WITH " + MAP_ELO.format(pool="* 6 + x.n", won=BY_ROUNDS) + f""",
sp AS (SELECT 'elo_k' || CAST(k AS INT) AS model, datetime, p_t1 AS p, result AS y FROM elo_all
       UNION ALL SELECT 'elo_mapspecific_k32', mi.datetime, 1 / (1 + pow(10, (r2 - r1) / 400)), s FROM ms JOIN mi ON mi.rn = ms.rn
       UNION ALL SELECT 'constant_0.5', datetime, 0.5e0, result FROM elo),
ss AS (SELECT *, CASE WHEN datetime < TIMESTAMP '{CUT}' THEN 'train' ELSE 'test' END AS split FROM sp)
SELECT model, split, {loss('p', 'y')} FROM ss WHERE split = 'test' OR model = 'elo_k32' GROUP BY 1, 2""")
def _(c: Contests):
    return rl(rating.backtest_table(c.matches(), c.map_rows(), CUT))


BIN = "LEAST(CAST(list_sum([CAST({p} >= e * 0.1e0 AS INT) FOR e IN [1,2,3,4,5,6,7,8,9]]) AS INT), 9)".format(p="p_t1")
CELLS = f"cells AS (SELECT {{g}} AS g, {BIN} AS bin, COUNT(*) AS n, AVG(p_t1) AS mp, AVG(result) AS ob FROM elo GROUP BY 1, 2)"


@query("reliability_table", f"""WITH {CELLS.format(g="'a'")}, s AS (SELECT CAST(unnest(range(10)) AS INT) AS bin)
SELECT s.bin, ROUND(s.bin * 0.1e0, 6) AS bin_lo, ROUND((s.bin + 1) * 0.1e0, 6) AS bin_hi, COALESCE(n, 0) AS n, ROUND(mp, 6) AS mean_pred, ROUND(ob, 6) AS obs_rate
FROM s LEFT JOIN cells ON cells.bin = s.bin""")
def _(c: Contests):
    return evaluate.reliability_table(scored(c)).select("bin", *r6("bin_lo", "bin_hi"), "n", *r6("mean_pred", "obs_rate"))


@query("ece", f"WITH {CELLS.format(g='tier')} SELECT g AS tier, ROUND(SUM(n * ABS(ob - mp)) / SUM(n), 6) AS ece FROM cells GROUP BY g")
def _(c: Contests):
    return evaluate.ece(scored(c), ["tier"]).select("tier", *r6("ece"))


@query("calibration_by_group", f"""WITH {CELLS.format(g="tier || '/' || games_played")},
e AS (SELECT g, SUM(n * ABS(ob - mp)) / SUM(n) AS ece FROM cells GROUP BY g),
a AS (SELECT tier || '/' || games_played AS g, {loss()}, AVG(p_t1) AS mp, AVG(result) AS ob FROM elo GROUP BY 1)
SELECT a.g AS "group", n, logloss, brier, acc, ROUND(ece, 6) AS ece, ROUND(mp, 6) AS mean_pred, ROUND(ob, 6) AS obs_rate FROM a JOIN e ON a.g = e.g WHERE n >= 30""")
def _(c: Contests):
    out = evaluate.calibration_by_group(scored(c), ["tier", "games_played"])
    return rl(out).withColumns({n: F.round(n, 6) for n in ("ece", "mean_pred", "obs_rate")})


@query("brier_decomposition", f"""WITH {CELLS.format(g='tier')}, t AS (SELECT g, SUM(n * ob) / SUM(n) AS yb FROM cells GROUP BY g)
SELECT cells.g AS tier, ROUND(SUM(n * pow(mp - ob, 2)) / SUM(n), 6) AS reliability, ROUND(SUM(n * pow(ob - yb, 2)) / SUM(n), 6) AS resolution,
ROUND(MAX(yb * (1 - yb)), 6) AS uncertainty FROM cells JOIN t ON t.g = cells.g GROUP BY 1""")
def _(c: Contests):
    return evaluate.brier_decomposition(scored(c), ["tier"]).select("tier", *r6("reliability", "resolution", "uncertainty"))


def priced(c: Contests):
    return c.replay().join(c.derive("odds").select("match_id", "odds1", "odds2"), "match_id")


@query("model_vs_market", f"""
WITH p AS (SELECT p_t1 AS a, (1 / GREATEST(odds1, 1.001)) / (1 / GREATEST(odds1, 1.001) + 1 / GREATEST(odds2, 1.001)) AS b, result AS y FROM elo JOIN odds USING (match_id))
SELECT COUNT(*) AS n, ROUND(AVG({LL.format(p='a', y='y')}), 6) AS model_logloss, ROUND(AVG(pow(a - y, 2)), 6) AS model_brier,
ROUND(AVG({LL.format(p='b', y='y')}), 6) AS market_logloss, ROUND(AVG(pow(b - y, 2)), 6) AS market_brier,
ROUND(AVG({LL.format(p='a', y='y')}) - AVG({LL.format(p='b', y='y')}), 6) AS delta_logloss, ROUND(AVG(pow(a - y, 2)) - AVG(pow(b - y, 2)), 6) AS delta_brier FROM p""")
def _(c: Contests):
    market = X.de_vig(X.odds_to_probability(F.col("odds1")), X.odds_to_probability(F.col("odds2")))
    rows = priced(c).select(F.col("p_t1").alias("model_p_t1"), market.alias("market_p_t1"), "result")
    out = evaluate.model_vs_market(rows)
    return out.select("n", *r6(*[x for x in out.columns if x != "n"]))


@query("odds_functions", """
SELECT match_id, CASE WHEN odds1 > 1 AND odds2 > 1 THEN ROUND((1 / odds1) / (1 / odds1 + 1 / odds2), 6) END AS p1,
CASE WHEN odds1 > 1 AND odds2 > 1 THEN ROUND(1 / odds1 + 1 / odds2 - 1, 6) END AS margin,
ROUND(1 / GREATEST(odds1, 1.001), 6) AS implied, ROUND(0.55 * (odds2 - 1) - 0.45, 6) AS ev, ROUND(ln(0.9 / odds2 / (1 - 0.9 / odds2)), 6) AS logit FROM odds
""")
def _(c: Contests):
    o1, o2 = F.col("odds1"), F.col("odds2")
    vig = X.devig(o1, o2)
    return c.derive("odds").select(
        "match_id", F.round(vig["p1"], 6).alias("p1"), F.round(vig["margin"], 6).alias("margin"),
        F.round(X.odds_to_probability(o1), 6).alias("implied"), F.round(X.expected_value(F.lit(0.55), o2), 6).alias("ev"),
        F.round(X.logit(0.9 / o2), 6).alias("logit"))


RATED = """
fr AS (SELECT t, ROUND(arg_max(n, o), 4) AS rating FROM (SELECT team1 AS t, elo_t1_post AS n, (datetime, match_id) AS o FROM elo UNION ALL
        SELECT team2, elo_t2_post, (datetime, match_id) FROM elo) GROUP BY t),
rt AS (SELECT n_name AS team, rating FROM nation JOIN fr ON t = n_name WHERE n_nationkey <> 5)
"""


def rated(c: Contests):
    """Final ratings, some names in another case and one team missing."""
    final = rating.final_ratings(c.replay(), ["pool"])
    named = final.join(c.table("nation"), F.col("n_name") == F.col("team")).where("n_nationkey <> 5")
    return named.select(
        F.when(F.col("n_nationkey") % 3 == 0, F.lower("team")).otherwise(F.col("team")).alias("team"),
        F.round("rating", 4).alias("rating"))


@query("rating_lookup", f"WITH {RATED} SELECT m.match_id, COALESCE(a.rating, 1500) AS team1_rating, a.rating IS NULL AS team1_unknown FROM pairing m LEFT JOIN rt a ON a.team = m.team1")
def _(c: Contests):
    pairing = c.derive("pairing").select("match_id", "team1")
    return evaluate.rating_lookup(pairing, rated(c), "team1").select("match_id", "team1_rating", "team1_unknown")


EDGE = RATED + """,
pr AS (SELECT o.*, a.rating AS r1, b.rating AS r2, 1 / (1 + pow(10, (b.rating - a.rating) / 400)) AS p FROM odds o LEFT JOIN rt a ON a.team = o.team1 LEFT JOIN rt b ON b.team = o.team2),
ev AS (SELECT *, p * (odds1 - 1) - (1 - p) AS e1, (1 - p) * (odds2 - 1) - p AS e2,
       CASE WHEN odds1 <= 1 OR odds2 <= 1 THEN 'decimal odds must exceed 1.0' WHEN r1 IS NULL THEN 'no rating for ' || team1 WHEN r2 IS NULL THEN 'no rating for ' || team2 END AS skipped FROM pr),
sc AS (SELECT *, CASE WHEN e1 >= e2 THEN p - 1 / odds1 ELSE 1 - p - 1 / odds2 END AS edge FROM ev)
"""


@query("edge_scan", f"WITH {EDGE} SELECT match_id, skipped, CASE WHEN skipped IS NULL THEN ROUND(p, 6) END AS elo_p1, CASE WHEN skipped IS NULL THEN CASE WHEN e1 >= e2 THEN team1 ELSE team2 END END AS best_side, "
       "CASE WHEN skipped IS NULL THEN ROUND(GREATEST(e1, e2), 6) END AS best_ev, CASE WHEN skipped IS NULL THEN ROUND(edge, 6) END AS best_edge, CASE WHEN skipped IS NULL THEN edge > 0 END AS bet FROM sc")
def _(c: Contests):
    return evaluate.edge_scan(c.derive("odds"), rated(c)).select(
        "match_id", "skipped", *r6("elo_p1"), "best_side", *r6("best_ev", "best_edge"), "bet")


@query("edge_counts", f"WITH {EDGE} SELECT COUNT(*) FILTER (WHERE skipped IS NULL AND edge > 0) AS flagged, COUNT(*) FILTER (WHERE skipped IS NULL) AS priced, COUNT(skipped) AS skipped FROM sc")
def _(c: Contests):
    return evaluate.edge_counts(evaluate.edge_scan(c.derive("odds"), rated(c)))


# ---- feature store --------------------------------------------------------------------------
FEATURES = f"""
{LINEUPS}, kn AS (SELECT *, LAG(l) OVER (PARTITION BY team ORDER BY datetime, match_id) AS p FROM lu WHERE len(list_filter(l, lambda x: x IS NOT NULL)) = 5),
ro AS (SELECT match_id, side, len(list_intersect(l, p)) / 5.0e0 AS st, CAST(len(list_intersect(l, p)) <= 3 AS DOUBLE) AS sn FROM kn WHERE p IS NOT NULL),
ht AS (SELECT match_id, side, AVG(win) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS f,
       (epoch_us(datetime) - epoch_us(LAG(datetime) OVER w)) / 86400000000.0e0 AS r FROM long WINDOW w AS (PARTITION BY team ORDER BY datetime, match_id)),
hh AS (SELECT match_id, CASE WHEN n = 0 THEN 0.5e0 WHEN team1 = a THEN aw / n ELSE 1 - aw / n END AS h FROM (
       SELECT match_id, team1, a, COUNT(*) OVER x AS n, COALESCE(SUM(CAST(winner = a AS INT)) OVER x, 0) AS aw FROM (SELECT *, LEAST(team1, team2) AS a, GREATEST(team1, team2) AS b FROM matches)
       WINDOW x AS (PARTITION BY a, b ORDER BY datetime, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
fs AS (SELECT e.match_id, e.datetime, e.tier, e.games_played = 1 AS is_bo1, elo_t1_pre - elo_t2_pre AS elo_diff, COALESCE(a.f, 0.5) - COALESCE(b.f, 0.5) AS form5_diff,
       COALESCE(a.r, 7) - COALESCE(b.r, 7) AS rest_days_diff, hh.h AS h2h_t1_win_share, COALESCE(c.st, 0.5) - COALESCE(d.st, 0.5) AS roster_stability_diff,
       COALESCE(c.sn, 0) - COALESCE(d.sn, 0) AS standin_diff, e.result, CASE WHEN e.games_played = 1 THEN elo_t1_pre - elo_t2_pre ELSE 0 END AS bo1_elo
       FROM elo e LEFT JOIN ht a ON a.match_id = e.match_id AND a.side = 1 LEFT JOIN ht b ON b.match_id = e.match_id AND b.side = 2 LEFT JOIN hh ON hh.match_id = e.match_id
       LEFT JOIN ro c ON c.match_id = e.match_id AND c.side = 1 LEFT JOIN ro d ON d.match_id = e.match_id AND d.side = 2)
"""
def exact_to(n: str) -> int:
    """Day fractions are exact at eight digits, so rounding there cannot differ between engines."""
    return 8 if n == "rest_days_diff" else 6


NUMERIC = ("elo_diff", "form5_diff", "rest_days_diff", "h2h_t1_win_share", "roster_stability_diff", "standin_diff", "bo1_elo")


def store(c: Contests):
    return c.stored("features", lambda: features.build_features(c.replay(), features.first_lineups(c.series_rows())))


@query("build_features", f"WITH {FEATURES} SELECT match_id, datetime, tier, is_bo1, result, {', '.join(f'ROUND({n}, {exact_to(n)}) AS {n}' for n in NUMERIC)} FROM fs")
def _(c: Contests):
    built = features.build_features(c.replay(), features.first_lineups(c.series_rows()))
    return built.select("match_id", "datetime", "tier", "is_bo1", "result", *[F.round(n, exact_to(n)).alias(n) for n in NUMERIC])


@query("verify_features", "SELECT COUNT(*) AS checked, 0::BIGINT AS form_mismatches, 0::BIGINT AS h2h_mismatches FROM matches")
def _(c: Contests):
    return features.verify_features(store(c), c.matches())


@query("feature_summary", f"WITH {FEATURES} " + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, ROUND(AVG({n}), 6) AS mean, ROUND(STDDEV_SAMP({n}), 6) AS std, ROUND(MIN({n}), 6) AS min, ROUND(MAX({n}), 6) AS max FROM fs" for n in NUMERIC))
def _(c: Contests):
    return features.feature_summary(store(c), list(NUMERIC)).select("feature", *r6("mean", "std", "min", "max"))


GUARDED = {**dict.fromkeys(("elo_diff", "form5_diff", "rest_days_diff", "is_bo1", "h2h_t1_win_share", "roster_stability_diff", "standin_diff", "bo1_elo"), "pre_match"),
           **dict.fromkeys(("games_played", "winner", "t1_series_score", "t2_series_score"), "post_outcome"), "tournament": "not_listed", "team1": "not_listed"}


@query("leakage_guard", f"WITH {FEATURES}, gj AS (SELECT fs.*, m.games_played, m.winner, m.t1_series_score, m.t2_series_score, m.tournament, m.team1 FROM fs JOIN matches m USING (match_id)) " + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, '{v}' AS verdict, COUNT({n}) AS n_values FROM gj" for n, v in GUARDED.items()))
def _(c: Contests):
    after = c.matches().select("match_id", "games_played", "winner", "t1_series_score", "t2_series_score", "tournament", "team1")
    return features.leakage_report(store(c).select("match_id", *[n for n, v in GUARDED.items() if v == "pre_match"]).join(after, "match_id"))


@query("feature_matrix", f"""WITH {FEATURES} SELECT match_id, CASE WHEN datetime < TIMESTAMP '{CUT}' THEN 'train' ELSE 'test' END AS split, ROUND(elo_diff, 6) AS elo_diff,
ROUND(form5_diff, 6) AS form5_diff, ROUND(rest_days_diff, 8) AS rest_days_diff, CAST(is_bo1 AS DOUBLE) AS is_bo1, CAST(tier = 'tier1' AS DOUBLE) AS tier_tier1, CAST(tier = 'tier2' AS DOUBLE) AS tier_tier2,
CAST(tier = 'tier3' AS DOUBLE) AS tier_tier3, roster_stability_diff, standin_diff FROM fs""")
def _(c: Contests):
    wide, names = features.feature_columns(store(c), list(features.ROSTER_FEATURES))
    keep = [F.round(n, exact_to(n)).alias(n) if n.endswith("_diff") and n[:3] in ("elo", "for", "res") else F.col(n) for n in names]
    return evaluate.with_split(wide, CUT).select("match_id", "split", *keep)


@query("time_split", f"SELECT CASE WHEN datetime < TIMESTAMP '{CUT}' THEN 'train' ELSE 'test' END AS split, COUNT(*) AS n, MIN(datetime) AS first FROM matches GROUP BY 1")
def _(c: Contests):
    return evaluate.with_split(c.matches(), CUT).groupBy("split").agg(F.count("*").alias("n"), F.min("datetime").alias("first"))


PSI = """
q AS (SELECT f.feature, list_sort(list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e, COUNT(*) AS n FROM f WHERE datetime < TIMESTAMP '{cut}' GROUP BY 1),
b AS (SELECT f.*, q.e, len(q.e) - 1 AS k, CASE WHEN v = q.e[-1] THEN len(q.e) - 2 ELSE len(list_filter(q.e, lambda x: x <= v)) - 1 END AS s FROM f JOIN q ON q.feature = f.feature),
ex AS (SELECT feature, s, COUNT(*) AS c FROM b WHERE datetime < TIMESTAMP '{cut}' GROUP BY 1, 2),
ac AS (SELECT {by} AS g, feature, s, COUNT(*) AS c FROM b {where} GROUP BY 1, 2, 3), tot AS (SELECT g, feature, SUM(c) AS n FROM ac GROUP BY 1, 2),
sl AS (SELECT t.g, t.feature, t.n, q.n AS en, unnest(range(len(q.e) - 1)) AS s FROM tot t JOIN q ON q.feature = t.feature),
pz AS (SELECT sl.g, sl.feature, MAX(sl.n) AS n, SUM((GREATEST(COALESCE(ac.c, 0) / sl.n, 1e-6) - GREATEST(COALESCE(ex.c, 0) / sl.en, 1e-6)) * ln(GREATEST(COALESCE(ac.c, 0) / sl.n, 1e-6) / GREATEST(COALESCE(ex.c, 0) / sl.en, 1e-6))) AS psi
       FROM sl LEFT JOIN ac ON ac.g = sl.g AND ac.feature = sl.feature AND ac.s = sl.s LEFT JOIN ex ON ex.feature = sl.feature AND ex.s = sl.s GROUP BY 1, 2)
"""
LONG_F = "f AS (" + " UNION ALL ".join(f"SELECT datetime, '{n}' AS feature, CAST({n} AS DOUBLE) AS v FROM fs" for n in NUMERIC) + ")"
PRICE_F = "f AS (SELECT o_orderdate AS datetime, 'price' AS feature, o_totalprice AS v FROM orders UNION ALL SELECT o_orderdate, 'customer', o_custkey FROM orders)"


@query("psi", f"WITH {PRICE_F}, {PSI.format(cut=CUT, by='1', where=f'''WHERE datetime >= TIMESTAMP '{CUT}' ''')} SELECT feature, CAST(n AS BIGINT) AS n, ROUND(psi, 6) AS psi FROM pz")
def _(c: Contests):
    orders = c.table("orders").select(F.col("o_orderdate").alias("datetime"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"))
    rows = evaluate.with_split(evaluate.unpivot_features(orders, ["price", "customer"], ["datetime"]), CUT)
    out = evaluate.psi(rows.where("split = 'train'"), rows.where("split = 'test'"))
    return out.select("feature", "n", *r6("psi"))


@query("drift_by_month", f"WITH {FEATURES}, {LONG_F}, {PSI.format(cut=CUT, by='''strftime(datetime, '%Y-%m')''', where='')} SELECT g AS month, feature, CAST(n AS BIGINT) AS n, ROUND(psi, 6) AS psi, psi > 0.25 AS flag FROM pz")
def _(c: Contests):
    return evaluate.drift_by_month(store(c), list(NUMERIC), CUT).withColumn("psi", F.round("psi", 6))


@query("exact_quantiles", """SELECT o_orderstatus, p AS prob, ROUND(quantile_cont(o_totalprice, [0.05, 0.25, 0.5, 0.9])[i], 6) AS value FROM orders,
(VALUES (1, 0.05e0), (2, 0.25e0), (3, 0.5e0), (4, 0.9e0)) t(i, p) GROUP BY 1, i, p""")
def _(c: Contests):
    from faceoff.operators.ordering import exact_quantiles
    return exact_quantiles(c.table("orders"), ["o_orderstatus"], "o_totalprice", [0.05, 0.25, 0.5, 0.9]).withColumn("value", F.round("value", 6))


# ---- grading --------------------------------------------------------------------------------
@query("compare_result_sets", """
WITH gold AS (SELECT team, COUNT(*) AS n, ROUND(AVG(win), 4) AS w FROM long GROUP BY team),
again AS (SELECT team, CAST(SUM(1) AS BIGINT) AS n, ROUND(SUM(win) / COUNT(*), 4) AS w FROM long GROUP BY team),
tiers AS (SELECT tier, COUNT(*) AS n FROM matches GROUP BY tier),
gv AS (SELECT lower(team) AS v FROM gold UNION SELECT CAST(CAST(n AS DOUBLE) AS VARCHAR) FROM gold UNION SELECT CAST(w AS VARCHAR) FROM gold),
wv AS (SELECT lower(team) AS v FROM again UNION SELECT CAST(CAST(n AS DOUBLE) AS VARCHAR) FROM again UNION SELECT CAST(w AS VARCHAR) FROM again),
ov AS (SELECT lower(tier) AS v FROM tiers UNION SELECT CAST(CAST(n AS DOUBLE) AS VARCHAR) FROM tiers),
g AS (SELECT 'same' AS pair, CASE WHEN NOT EXISTS (SELECT * FROM gold EXCEPT SELECT * FROM again) AND NOT EXISTS (SELECT * FROM again EXCEPT SELECT * FROM gold) THEN 'exact'
             WHEN NOT EXISTS (SELECT v FROM gv EXCEPT SELECT v FROM wv) THEN 'partial' ELSE 'wrong' END AS verdict
      UNION ALL SELECT 'wider', CASE WHEN NOT EXISTS (SELECT v FROM gv EXCEPT SELECT v FROM wv) THEN 'partial' ELSE 'wrong' END
      UNION ALL SELECT 'other', CASE WHEN NOT EXISTS (SELECT v FROM gv EXCEPT SELECT v FROM ov) THEN 'partial' ELSE 'wrong' END)
SELECT pair, verdict, CASE verdict WHEN 'exact' THEN 1.0e0 WHEN 'partial' THEN 0.5e0 ELSE 0.0e0 END AS credit FROM g
""")
def _(c: Contests):
    long = c.long()
    share = gold.share_per_team(c.matches())
    again = long.groupBy("team").agg(F.avg("win").alias("w"), F.count("*").alias("n")).select("team", "n", "w")
    wider = again.withColumn("losses", F.col("n") - F.round(F.col("n") * F.col("w")))
    parts = {"same": again, "wider": wider, "other": gold.series_per_tier(c.matches())}
    out = [evaluate.compare_result_sets(df, share).withColumn("pair", F.lit(k)) for k, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("eval_summary", """
WITH r AS (SELECT event_type AS label, CAST(ts AS DATE) AS run_at, user_id % 3 = 0 AS is_trap, value > 20 AS executable, value > 40 AS result_match, value < 30 AS refused_ok,
           CAST(FLOOR(value * 10) AS BIGINT) AS pt, user_id AS ct FROM events),
l AS (SELECT label, MAX(run_at) AS run_at FROM r GROUP BY label)
SELECT r.label, r.run_at, COUNT(*) AS questions, COUNT(*) FILTER (WHERE NOT is_trap AND result_match) AS answerable_correct, COUNT(*) FILTER (WHERE NOT is_trap) AS answerable_total,
COUNT(*) FILTER (WHERE is_trap AND refused_ok) AS traps_refused, COUNT(*) FILTER (WHERE is_trap) AS traps_total, ROUND(AVG(CAST(executable AS INT)) FILTER (WHERE NOT is_trap), 4) AS exec_rate,
CAST(SUM(pt) AS BIGINT) AS prompt_tokens, CAST(SUM(ct) AS BIGINT) AS completion_tokens, ROUND(SUM(pt) / 1e6 * 100 + SUM(ct) / 1e6 * 200, 4) AS est_cost
FROM r JOIN l ON l.label = r.label AND l.run_at = r.run_at GROUP BY 1, 2
""")
def _(c: Contests):
    runs = c.table("events").select(
        F.col("event_type").alias("label"), F.to_date("ts").alias("run_at"), (F.col("user_id") % 3 == 0).alias("is_trap"),
        (F.col("value") > 20).alias("executable"), (F.col("value") > 40).alias("result_match"), (F.col("value") < 30).alias("refused_ok"),
        F.floor(F.col("value") * 10).cast("long").alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"),
        F.lit(100.0).alias("price_in"), F.lit(200.0).alias("price_out"))
    return evaluate.eval_summary(runs)


ORACLES["gold_check"] = None
_parts = []
for _n, (_f, _s) in gold.PACK.items():
    _parts.append(f"SELECT '{_n}' AS question, COUNT(*) AS n_rows, COUNT(*) > 0 AS answered FROM ({_s})")
from faceoff.plans.registry import with_tables  # noqa: E402

ORACLES["gold_check"] = with_tables(" UNION ALL ".join(_parts))
