import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faceoff.operators import causal

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id string, team string, match_id long, datetime timestamp, tier string, pos long, pre_stable_matches long, wins long"


def instance(seed):
    rng = random.Random(seed)
    def row(i, kind):
        return (f"e{i}" if kind == "e" else None, f"T{rng.randrange(6)}", i, T0 + timedelta(seconds=rng.randrange(150 * 86400)),
                rng.choice(["tier1", "tier1", "tier2", None]), i, rng.choice([0, 1, 1, 2, 7]), rng.randrange(2))
    return [row(i, "e") for i in range(14)], [row(100 + i, "c") for i in range(40)]


def serial(events, controls, covariates, replace):
    used, out = set(), {}
    for e in sorted(events, key=lambda r: (r[1], r[3], r[2])):
        best = None
        for c in controls:
            days = abs(c[3] - e[3]).days
            if c[1] == e[1] or days > 90 or (e[4] is not None and c[4] != e[4]) or (c[1], c[2]) in used:
                continue
            d = (sum((e[k] - c[k]) ** 2 for k in covariates) / len(covariates)) ** 0.5
            best = min(best or (d, days, c[1], c[2]), (d, days, c[1], c[2]))
        if best:
            out[e[0]] = best[2:]
            if not replace:
                used.add(best[2:])
    return out


@pytest.mark.parametrize("seed,covariates,replace,square", [(1, [6], False, 64), (2, [6, 7], False, 1), (3, [6], True, 1)])
def test_matching_equals_the_serial_loop(spark, monkeypatch, seed, covariates, replace, square):
    monkeypatch.setattr(causal, "SQUARE", square)
    events, controls = instance(seed)
    names = ["pre_stable_matches" if k == 6 else "wins" for k in covariates]
    fn = causal.nearest_control if replace else causal.nearest_control_greedy
    got = fn(spark.createDataFrame(events, SCHEMA), spark.createDataFrame(controls, SCHEMA), names)
    pairs = {r["event_id"]: (r["control_team"], r["control_match_id"]) for r in got.collect()}
    assert pairs == serial(events, controls, covariates, replace)


def test_did_and_balance(spark):
    cells = {(1, 0): [0, 1], (1, 1): [1, 1, 0, 1], (0, 0): [0, 1], (0, 1): [1, 0]}
    rows = [(t, p, float(w), f"c{i % 3}", p - 1, t * 2.0) for (t, p), ws in cells.items() for i, w in enumerate(ws)]
    panel = spark.createDataFrame(rows, "treated int, post int, win double, event_id string, relative_match int, x double")
    out = causal.did_estimate(panel).first()
    assert out["estimate"] == pytest.approx(0.25) and out["n_treated"] == 6
    study = {r["relative_match"]: r["difference"] for r in causal.event_study(panel).collect()}
    assert study == {-1: 0.0, 0: 0.25}
    assert causal.pretrend_screen(causal.event_study(panel)).first()["passes_screen"]
    boot = causal.bootstrap_did(panel, n_boot=200, seed=1).first()
    again = causal.bootstrap_did(panel.repartition(7), n_boot=200, seed=1).first()
    assert boot == again and boot["ci_low"] <= boot["estimate"] <= boot["ci_high"]
    with pytest.raises(ValueError):
        causal.bootstrap_did(panel, n_boot=10)
    smd = causal.balance_table(panel, ["x"]).first()["smd"]
    assert smd == float("inf")


def test_bootstrap_draws_like_a_plain_loop_over_chunks(spark):
    import hashlib

    import numpy as np

    rng = random.Random(9)
    rows = [(f"c{i % 23:02d}", i % 2, (i // 2) % 2, float(rng.randrange(2))) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id string, treated int, post int, win double")
    got = causal.bootstrap_did(df, n_boot=150, seed=3, chunk=5).first()
    number = lambda *parts: int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)
    names = sorted({r[0] for r in rows}, key=lambda k: (hashlib.md5(k.encode()).hexdigest()[:3], k))
    n, found = len(names), []
    for r in range(150):
        chunks = [number(3, r * n + j) % n // 5 for j in range(n)]
        total = {}
        for ch in set(chunks):
            for j in range(1, chunks.count(ch) + 1):
                own = names[ch * 5 + number(3, r, ch, j) % min(5, n - ch * 5)]
                for _, t, p, w in (x for x in rows if x[0] == own):
                    s = total.setdefault((t, p), [0, 0])
                    s[0], s[1] = s[0] + w, s[1] + 1
        if all(k in total for k in ((0, 0), (0, 1), (1, 0), (1, 1))):
            m = {k: v[0] / v[1] for k, v in total.items()}
            found.append((m[1, 1] - m[1, 0]) - (m[0, 1] - m[0, 0]))
    assert got["n_boot"] == len(found) and [got["ci_low"], got["ci_high"]] == pytest.approx(np.quantile(found, [0.025, 0.975]).tolist())


def test_a_continuous_covariate_has_no_limit_on_its_values(spark):
    n = 21_000
    base = spark.range(n).select(
        F.concat(F.lit("c"), F.col("id")).alias("team"), F.col("id").alias("match_id"), F.lit("t").alias("tier"), F.lit(0).cast("long").alias("pos"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("id") % 2000).cast("int"))).alias("datetime"),
        (F.col("id") / 7.0).alias("x"))
    events = base.where("match_id IN (70, 7000)").select(
        F.concat(F.lit("e"), F.col("match_id")).alias("event_id"), F.lit("mine").alias("team"), (F.col("match_id") + n).alias("match_id"),
        "datetime", "tier", "pos", (F.col("x") + 0.01).alias("x"))
    got = {r["event_id"]: (r["control_match_id"], round(r["distance"], 6)) for r in causal.nearest_control(events, base, ["x"]).collect()}
    assert got == {"e70": (70, 0.01), "e7000": (7000, 0.01)}
