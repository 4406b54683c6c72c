"""Registered queries: roster study, long breaks, classical tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from faceoff.operators import causal, clean, history, inference
from faceoff.plans.queries_evaluate import FEATURES, store
from faceoff.plans.queries_history import r6
from faceoff.plans.registry import Contests, query

IDS = [f"team{n}_player{i}_id" for n in (1, 2) for i in range(1, 6)]


def with_lineups(c: Contests):
    lineups = clean.lineup_of_match(c.raw(), IDS)
    return clean.assert_one_to_one(c.matches(), lineups, "match_id", "left")


def panel(c: Contests):
    return c.stored("panel", lambda: causal.team_match_panel(with_lineups(c)))


def windows(c: Contests):
    return c.stored("windows", lambda: causal.event_windows(panel(c)))


def pairs(c: Contests):
    return c.stored("pairs", lambda: causal.nearest_control_greedy(
        windows(c).where("relative_match = 0"), causal.eligible_controls(panel(c))))


def paired(c: Contests):
    return c.stored("paired", lambda: causal.paired_event_panel(panel(c), windows(c), pairs(c)))


def _roster(n: int) -> str:
    ids = ", ".join(f"team{n}_player{i}_id" for i in range(1, 6))
    return (f"CASE WHEN len(list_filter([{ids}], lambda x: x IS NOT NULL)) = 5 AND len(list_distinct([{ids}])) = 5 "
            f"THEN list_sort([{ids}]) END")


PANEL = f"""
pl AS (SELECT m.match_id, m.datetime, m.tier, m.games_played, m.team1 AS team, winner = m.team1 AS won, t1_series_score - t2_series_score AS rd, {_roster(1)} AS l
       FROM matches m JOIN (SELECT * FROM series_rows WHERE seq = 1) s USING (match_id)
       UNION ALL SELECT m.match_id, m.datetime, m.tier, m.games_played, m.team2, winner = m.team2, t2_series_score - t1_series_score, {_roster(2)}
       FROM matches m JOIN (SELECT * FROM series_rows WHERE seq = 1) s USING (match_id)),
p1 AS (SELECT *, LAG(l) OVER w AS pv, ROW_NUMBER() OVER w AS pos, COUNT(*) OVER (PARTITION BY team) AS total FROM pl WINDOW w AS (PARTITION BY team ORDER BY datetime, match_id)),
p2 AS (SELECT *, COALESCE(l <> pv, FALSE) AS changed, COALESCE(l = pv, FALSE) AS kept FROM p1),
pn AS (SELECT *, COALESCE(pos - 1 - MAX(CASE WHEN NOT kept THEN pos END) OVER (PARTITION BY team ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ps,
       CASE WHEN changed THEN len(list_filter(l, lambda x: NOT list_contains(pv, x))) WHEN kept THEN 0 END AS cc FROM p2)
"""
EVENTS = PANEL + """,
wn AS (SELECT *, SUM(CAST(changed AS INT)) OVER (PARTITION BY team ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS later,
       MAX(CAST(changed AS INT)) OVER (PARTITION BY team ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS around FROM pn),
ev AS (SELECT *, 'event#' || team || '#' || match_id AS event_id FROM wn WHERE changed AND ps >= 3 AND pos > 5 AND pos + 5 <= total AND later = 0),
ct AS (SELECT * FROM wn WHERE l IS NOT NULL AND around = 0 AND pos > 5 AND pos + 5 <= total)
"""
PAIRS = EVENTS + """,
cand AS (SELECT e.event_id, e.team AS et, e.datetime AS edt, e.match_id AS em, c.team AS cteam, c.match_id AS cm, c.pos AS cpos, c.datetime AS cdt, CAST(ABS(e.ps - c.ps) AS DOUBLE) AS distance,
         ABS(epoch_us(e.datetime) - epoch_us(c.datetime)) // 86400000000 AS days FROM ev e JOIN ct c ON c.tier = e.tier AND c.team <> e.team
         AND ABS(epoch_us(e.datetime) - epoch_us(c.datetime)) // 86400000000 <= 90)
"""
GREEDY = PAIRS + """,
el AS (SELECT *, ROW_NUMBER() OVER (ORDER BY et, edt, em) AS ern FROM (
       SELECT event_id, et, edt, em, list(cteam || '#' || cm ORDER BY distance, days, cteam, cm) AS ids FROM cand GROUP BY 1, 2, 3, 4)),
gr(rn, used, pick, event_id) AS (SELECT 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR
   UNION ALL SELECT el.ern, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END, p, el.event_id FROM (
       SELECT el.ern, el.event_id, gr.used, list_filter(el.ids, lambda x: NOT list_contains(gr.used, x))[1] AS p FROM gr JOIN el ON el.ern = gr.rn + 1) el),
pr AS (SELECT g.event_id, c.et, c.em, c.cteam, c.cm, c.cpos, c.distance, c.days FROM gr g JOIN cand c ON c.event_id = g.event_id AND c.cteam || '#' || c.cm = g.pick)
"""
PAIRED = GREEDY + """,
pp AS (SELECT p.event_id, 1 AS treated, CAST(n.pos - e.pos AS INT) AS rel, n.team, n.match_id, CAST(n.won AS DOUBLE) AS win, n.ps, n.cc FROM pr p JOIN ev e USING (event_id) JOIN pn n ON n.team = e.team AND n.pos BETWEEN e.pos - 5 AND e.pos + 5
       UNION ALL SELECT p.event_id, 0, CAST(n.pos - p.cpos AS INT), n.team, n.match_id, CAST(n.won AS DOUBLE), n.ps, n.cc FROM pr p JOIN pn n ON n.team = p.cteam AND n.pos BETWEEN p.cpos - 5 AND p.cpos + 5)
"""


@query("team_match_panel", f"WITH {PANEL} SELECT match_id, team, won AS won, rd AS round_diff, games_played = 1 AS is_bo1, l IS NOT NULL AS roster_known, changed AS roster_changed, "
       "CAST(cc AS INT) AS change_count, CAST(ps AS BIGINT) AS pre_stable_matches FROM pn")
def _(c: Contests):
    return causal.team_match_panel(with_lineups(c)).select(
        "match_id", "team", (F.col("win") == 1).alias("won"), F.col("round_diff").cast("long").alias("round_diff"), "is_bo1", "roster_known",
        "roster_changed", "change_count", "pre_stable_matches")


@query("team_match_panel_split", f"WITH {PANEL} SELECT match_id, team, changed AS roster_changed, CAST(ps AS BIGINT) AS pre_stable_matches FROM pn")
def _(c: Contests):
    line = history.Timeline(("team",), hot_rows=400)
    return causal.team_match_panel(with_lineups(c), line).select("match_id", "team", "roster_changed", "pre_stable_matches")


@query("event_windows", f"WITH {EVENTS} SELECT e.event_id, CAST(n.pos - e.pos AS INT) AS relative_match, n.match_id, n.team, CAST(n.pos >= e.pos AS INT) AS post "
       "FROM ev e JOIN pn n ON n.team = e.team AND n.pos BETWEEN e.pos - 5 AND e.pos + 5")
def _(c: Contests):
    return causal.event_windows(panel(c)).select("event_id", "relative_match", "match_id", "team", "post")


@query("eligible_controls", f"WITH {EVENTS} SELECT team, match_id FROM ct")
def _(c: Contests):
    return causal.eligible_controls(panel(c)).select("team", "match_id")


@query("eligible_controls_split", f"WITH {EVENTS} SELECT team, match_id FROM ct")
def _(c: Contests):
    line = history.Timeline(("team",), hot_rows=400)
    return causal.eligible_controls(panel(c), line=line).select("team", "match_id")


@query("nearest_control", f"WITH {PAIRS} SELECT event_id, cteam AS control_team, cm AS control_match_id, distance, days FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id "
       "ORDER BY distance, days, cteam, cm) AS r FROM cand) WHERE r = 1")
def _(c: Contests):
    return causal.nearest_control(windows(c).where("relative_match = 0"), causal.eligible_controls(panel(c))).select(
        "event_id", "control_team", "control_match_id", "distance", "days")


@query("nearest_control_greedy", f"WITH {GREEDY} SELECT event_id, cteam AS control_team, cm AS control_match_id, distance, days FROM pr")
def _(c: Contests):
    return pairs(c).select("event_id", "control_team", "control_match_id", "distance", "days")


@query("paired_event_panel", f"WITH {PAIRED} SELECT event_id, treated, rel AS relative_match, team, match_id, win FROM pp")
def _(c: Contests):
    return causal.paired_event_panel(panel(c), windows(c), pairs(c)).select(
        "event_id", "treated", "relative_match", "team", "match_id", "win")


CELL4 = """ROUND(AVG(win) FILTER (WHERE treated = 1 AND rel < 0), 6) AS treated_pre, ROUND(AVG(win) FILTER (WHERE treated = 1 AND rel >= 0), 6) AS treated_post,
ROUND(AVG(win) FILTER (WHERE treated = 0 AND rel < 0), 6) AS control_pre, ROUND(AVG(win) FILTER (WHERE treated = 0 AND rel >= 0), 6) AS control_post"""
DID = """(AVG(win) FILTER (WHERE treated = 1 AND rel >= 0) - AVG(win) FILTER (WHERE treated = 1 AND rel < 0))
- (AVG(win) FILTER (WHERE treated = 0 AND rel >= 0) - AVG(win) FILTER (WHERE treated = 0 AND rel < 0))"""


@query("did_estimate", f"WITH {PAIRED} SELECT {CELL4}, ROUND({DID}, 6) AS estimate, COUNT(*) FILTER (WHERE treated = 1) AS n_treated, COUNT(*) FILTER (WHERE treated = 0) AS n_control FROM pp")
def _(c: Contests):
    return causal.did_estimate(paired(c)).select(
        *r6("treated_pre", "treated_post", "control_pre", "control_post", "estimate"), "n_treated", "n_control")


STUDY = """st AS (SELECT rel, AVG(win) FILTER (WHERE treated = 1) AS t, AVG(win) FILTER (WHERE treated = 0) AS k, COUNT(*) FILTER (WHERE treated = 1) AS tn,
COUNT(*) FILTER (WHERE treated = 0) AS kn FROM pp GROUP BY rel)"""


@query("event_study", f"WITH {PAIRED}, {STUDY} SELECT rel AS relative_match, ROUND(t, 6) AS treated_mean, ROUND(k, 6) AS control_mean, tn AS treated_n, kn AS control_n, ROUND(t - k, 6) AS difference FROM st")
def _(c: Contests):
    return causal.event_study(paired(c)).select(
        "relative_match", *r6("treated_mean", "control_mean"), "treated_n", "control_n", *r6("difference"))


@query("pretrend_screen", f"WITH {PAIRED}, {STUDY} SELECT ROUND(MAX(t - k) FILTER (WHERE rel = -1), 6) AS lead_minus_one, ROUND(MAX(ABS(t - k)) FILTER (WHERE rel < 0), 6) AS max_abs_lead_difference, "
       "MAX(ABS(t - k)) FILTER (WHERE rel < 0) <= 0.10 AS passes_screen FROM st")
def _(c: Contests):
    return causal.pretrend_screen(causal.event_study(paired(c))).select(
        *r6("lead_minus_one", "max_abs_lead_difference"), "passes_screen")


def bootstrap_sql(chunk: int) -> str:
    """Common table expressions up to ``es``: one estimate per replicate."""
    return f"""cl AS (SELECT event_id, {", ".join(f"COALESCE(SUM(win) FILTER (WHERE treated = {t} AND {w}), 0) AS s{i}, COUNT(win) FILTER (WHERE treated = {t} AND {w}) AS n{i}" for i, (t, w) in enumerate(((1, "rel < 0"), (1, "rel >= 0"), (0, "rel < 0"), (0, "rel >= 0"))))} FROM pp GROUP BY 1),
ix AS (SELECT *, ROW_NUMBER() OVER (ORDER BY substr(md5(event_id), 1, 3), event_id) - 1 AS i, COUNT(*) OVER () AS n FROM cl),
nn AS (SELECT COUNT(*) AS n FROM cl),
sh AS (SELECT id // n AS rep, (('0x' || substr(md5('7:' || id), 1, 8))::BIGINT % n) // {chunk} AS ch, n, COUNT(*) AS m FROM (SELECT unnest(range(2000 * n)) AS id, n FROM nn) GROUP BY ALL),
dr AS (SELECT rep, ch * {chunk} + ('0x' || substr(md5('7:' || rep || ':' || ch || ':' || j), 1, 8))::BIGINT % least({chunk}, n - ch * {chunk}) AS i FROM (SELECT rep, ch, n, unnest(range(1, m + 1)) AS j FROM sh)),
es AS (SELECT rep, (SUM(s1) / SUM(n1) - SUM(s0) / SUM(n0)) - (SUM(s3) / SUM(n3) - SUM(s2) / SUM(n2)) AS e FROM dr JOIN ix ON ix.i = dr.i GROUP BY rep)"""


@query("bootstrap_did", f"""WITH {PAIRED}, {bootstrap_sql(16)}
SELECT ROUND((SELECT {DID} FROM pp), 6) AS estimate, ROUND(quantile_cont(e, 0.025), 6) AS ci_low, ROUND(quantile_cont(e, 0.975), 6) AS ci_high, COUNT(*) AS n_boot, (SELECT n FROM nn) AS n_clusters FROM es""")
def _(c: Contests):
    return causal.bootstrap_did(paired(c), n_boot=2000, seed=7, chunk=16).select(
        *r6("estimate", "ci_low", "ci_high"), "n_boot", "n_clusters")


@query("balance_table", f"WITH {PAIRED} " + " UNION ALL ".join(f"""SELECT '{n}' AS covariate, COUNT({x}) FILTER (WHERE treated = 1) AS treated_n, COUNT({x}) FILTER (WHERE treated = 0) AS control_n,
ROUND(AVG({x}) FILTER (WHERE treated = 1), 6) AS treated_mean, ROUND(AVG({x}) FILTER (WHERE treated = 0), 6) AS control_mean,
ROUND((AVG({x}) FILTER (WHERE treated = 1) - AVG({x}) FILTER (WHERE treated = 0)) / sqrt((VAR_SAMP({x}) FILTER (WHERE treated = 1) + VAR_SAMP({x}) FILTER (WHERE treated = 0)) / 2), 6) AS smd
FROM pp WHERE rel = 0""" for n, x in (("pre_stable_matches", "ps"), ("change_count", "cc"))))
def _(c: Contests):
    points = paired(c).where("relative_match = 0")
    return causal.balance_table(points, ["pre_stable_matches", "change_count"]).select(
        "covariate", "treated_n", "control_n", *r6("treated_mean", "control_mean", "smd"))


@query("roster_study", f"""WITH {PAIRED}, {STUDY}, {bootstrap_sql(4096)}
SELECT (SELECT ROUND({DID}, 6) FROM pp) AS estimate, (SELECT COUNT(*) FILTER (WHERE treated = 1) FROM pp) AS n_treated, (SELECT COUNT(*) FILTER (WHERE treated = 0) FROM pp) AS n_control,
(SELECT ROUND(quantile_cont(e, 0.025), 6) FROM es) AS ci_low, (SELECT ROUND(quantile_cont(e, 0.975), 6) FROM es) AS ci_high, (SELECT n FROM nn) AS n_clusters,
ROUND(MAX(t - k) FILTER (WHERE rel = -1), 6) AS lead_minus_one, ROUND(MAX(ABS(t - k)) FILTER (WHERE rel < 0), 6) AS max_abs_lead_difference,
MAX(ABS(t - k)) FILTER (WHERE rel < 0) <= 0.10 AS passes_screen FROM st""")
def _(c: Contests):
    out = causal.roster_study(with_lineups(c), n_boot=2000, seed=7)
    return out["did"].select(*r6("estimate"), "n_treated", "n_control").crossJoin(
        out["bootstrap"].select(*r6("ci_low", "ci_high"), "n_clusters")).crossJoin(
        out["pretrend"].select(*r6("lead_minus_one", "max_abs_lead_difference"), "passes_screen"))      # one-row frames


GAPS = """gp AS (SELECT l.match_id, l.team, l.datetime, l.tier, l.win - f AS y, prior, CASE WHEN r >= 30 THEN 'treated' WHEN r <= 14 THEN 'control' END AS grp FROM (
SELECT *, AVG(win) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS f, list(win) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS prior,
(epoch_us(datetime) - epoch_us(LAG(datetime) OVER w)) / 86400000000.0e0 AS r FROM long WINDOW w AS (PARTITION BY team ORDER BY datetime, match_id)) l WHERE f IS NOT NULL AND r IS NOT NULL)"""


@query("gap_contrast", f"""WITH {FEATURES}, {GAPS}, sp AS (SELECT 'all_teams_net_of_form' AS s, grp, y FROM gp UNION ALL SELECT 'tier1_only_net_of_form', grp, y FROM gp WHERE tier = 'tier1'
UNION ALL SELECT 'close_matches_net_of_form', grp, y FROM gp JOIN fs USING (match_id) WHERE ABS(elo_diff) <= 50),
ag AS (SELECT s, AVG(y) FILTER (WHERE grp = 'treated') - AVG(y) FILTER (WHERE grp = 'control') AS e, COUNT(*) FILTER (WHERE grp = 'treated') AS a, COUNT(*) FILTER (WHERE grp = 'control') AS b,
sqrt(VAR_SAMP(y) FILTER (WHERE grp = 'treated') / COUNT(*) FILTER (WHERE grp = 'treated') + VAR_SAMP(y) FILTER (WHERE grp = 'control') / COUNT(*) FILTER (WHERE grp = 'control')) AS se FROM sp GROUP BY s)
SELECT s AS specification, ROUND(e, 6) AS estimate, ROUND(se, 6) AS se, ROUND(e - 1.96 * se, 6) AS ci_lo, ROUND(e + 1.96 * se, 6) AS ci_hi, a + b AS n, a AS n_treated, b AS n_control FROM ag""")
def _(c: Contests):
    from faceoff.operators.longform import side_long
    long = side_long(c.matches(), ("match_id", "datetime", "tier"))
    rows = causal.gap_rows(long).join(store(c).select("match_id", "elo_diff"), "match_id", "left")
    return causal.gap_contrast(rows, {
        "all_teams_net_of_form": F.lit(True), "tier1_only_net_of_form": F.col("tier") == "tier1",
        "close_matches_net_of_form": F.abs("elo_diff") <= 50,
    }).select("specification", *r6("estimate", "se", "ci_lo", "ci_hi"), "n", "n_treated", "n_control")


PRE = """ex AS (SELECT grp, CAST(i - len(prior) - 1 AS INT) AS step, prior[i] AS won FROM (SELECT grp, prior, unnest(range(1, len(prior) + 1)) AS i FROM {src}))
SELECT step, grp AS "group", ROUND(AVG(won), 6) AS won, COUNT(*) AS n FROM ex GROUP BY 1, 2"""


@query("pre_trend", f"WITH {GAPS}, pk AS (SELECT * FROM gp WHERE grp IS NOT NULL), {PRE.format(src='pk')}")
def _(c: Contests):
    return causal.pre_trend(c.long()).select("step", "group", *r6("won"), "n")


@query("pre_trend_all", f"WITH {GAPS}, pk AS (SELECT * FROM gp WHERE grp IS NOT NULL), {PRE.format(src='pk')}")
def _(c: Contests):
    return causal.pre_trend(c.long()).select("step", "group", *r6("won"), "n")


# ---- classical tests ------------------------------------------------------------------------
WR = "wr AS (SELECT *, ABS(t1_series_score - t2_series_score) AS margin, t1_series_score + t2_series_score AS total_maps, (t1_series_score = 0 OR t2_series_score = 0) AND games_played >= 2 AS swept FROM matches)"


@query("welch_t", f"""WITH {WR}, g AS (SELECT games_played = 1 AS b, COUNT(*) AS n, AVG(margin) AS m, VAR_SAMP(margin) AS v FROM wr WHERE NOT (margin = 0 AND total_maps = 2) GROUP BY 1),
x AS (SELECT a.n AS n1, z.n AS n2, a.m AS m1, z.m AS m2, a.v / a.n AS va, z.v / z.n AS vb FROM g a, g z WHERE a.b AND NOT z.b)
SELECT n1, n2, ROUND((m2 - m1) / sqrt(va + vb), 6) AS t, ROUND(pow(va + vb, 2) / (va * va / (n1 - 1) + vb * vb / (n2 - 1)), 6) AS df, ROUND((m2 - m1) / sqrt(va + vb) * sqrt(1 / n1 + 1 / n2), 6) AS d FROM x""")
def _(c: Contests):
    return inference.welch_t(clean.derive_series(c.matches())).select("n1", "n2", *r6("t", "df", "d"))


@query("anova_by_group", f"""WITH {WR}, m AS (SELECT AVG(margin) AS gm, COUNT(*) AS n, COUNT(DISTINCT tier) AS k FROM wr), t AS (SELECT tier, AVG(margin) AS tm FROM wr GROUP BY tier),
s AS (SELECT SUM(pow(margin - tm, 2)) AS w, SUM(pow(tm - gm, 2)) AS b, MAX(n) AS n, MAX(k) AS k FROM wr JOIN t ON t.tier = wr.tier, m)
SELECT ROUND((b / (k - 1)) / (w / (n - k)), 6) AS f, ROUND(b / (b + w), 6) AS eta_sq FROM s""")
def _(c: Contests):
    return inference.anova_by_group(clean.derive_series(c.matches())).select(*r6("f", "eta_sq"))


@query("pairwise_differences", f"WITH {WR}, t AS (SELECT tier, AVG(margin) AS m FROM wr GROUP BY tier) SELECT b.tier || '-' || a.tier AS pair, ROUND(b.m - a.m, 6) AS difference FROM t a JOIN t b ON b.tier > a.tier")
def _(c: Contests):
    return inference.pairwise_differences(clean.derive_series(c.matches())).select("pair", *r6("difference"))


PROP = f"""{WR}, q AS (SELECT COUNT(*) FILTER (WHERE swept) AS x, COUNT(*) AS n FROM wr WHERE games_played >= 2),
r AS (SELECT x, n, x / n AS p, LEAST(0.5, ABS(x - n * 0.5)) AS y, pow(1.959963984540054e0, 2) / (2 * n) AS h FROM q)"""


@query("prop_test", f"""WITH {PROP} SELECT x, n, ROUND(p, 6) AS share, ROUND(pow(ABS(x - n * 0.5) - y, 2) / (n * 0.25), 6) AS chi2, ROUND(p - 1.96 * sqrt(p * (1 - p) / n), 6) AS wald_lo, ROUND(p + 1.96 * sqrt(p * (1 - p) / n), 6) AS wald_hi,
ROUND(((p - y / n) + h - 1.959963984540054e0 * sqrt((p - y / n) * (1 - p + y / n) / n + h / (2 * n))) / (1 + 2 * h), 6) AS wilson_lo,
ROUND(((p + y / n) + h + 1.959963984540054e0 * sqrt((p + y / n) * (1 - p - y / n) / n + h / (2 * n))) / (1 + 2 * h), 6) AS wilson_hi FROM r""")
def _(c: Contests):
    rows = clean.derive_series(c.matches()).where("games_played >= 2")
    return inference.prop_test(rows, F.col("swept")).select("x", "n", *r6("share", "chi2", "wald_lo", "wald_hi", "wilson_lo", "wilson_hi"))


@query("inference_table")
def _(c: Contests):
    return inference.inference_table(clean.derive_series(c.matches()))
