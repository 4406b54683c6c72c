import numpy as np
import pytest
from pyspark.sql import functions as F

from faceoff.operators import evaluate, features, models


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    p = np.clip(rng.beta(2, 2, 400), 0, 1)
    y = (rng.random(400) < p).astype(float)
    rows = [(float(a), float(b), f"g{i % 2}") for i, (a, b) in enumerate(zip(p, y, strict=True))] + [(1.0, 1.0, "rare"), (0.0, 0.0, "rare")]
    return spark.createDataFrame(rows, "p double, y double, g string").cache()


def test_losses_and_calibration(spark, scored):
    row = evaluate.score(scored).first()
    pdf = scored.toPandas()
    q = np.clip(pdf.p, 1e-15, 1 - 1e-15)
    assert row["logloss"] == pytest.approx(float(-(pdf.y * np.log(q) + (1 - pdf.y) * np.log(1 - q)).mean()))
    table = evaluate.reliability_table(scored).orderBy("bin").collect()
    assert len(table) == 10 and sum(r["n"] for r in table) == 402
    groups = {r["group"] for r in evaluate.calibration_by_group(scored, ["g"]).collect()}
    assert groups == {"g0", "g1"}
    d = evaluate.brier_decomposition(scored).first()
    binned = scored.withColumn("b", F.floor(F.least(F.col("p"), F.lit(0.999)) * 10))
    coarse = binned.join(binned.groupBy("b").agg(F.avg("p").alias("m")), "b").agg(F.avg(F.pow(F.col("m") - F.col("y"), F.lit(2)))).first()[0]
    assert d["reliability"] - d["resolution"] + d["uncertainty"] == pytest.approx(coarse, abs=1e-9)


def test_psi(spark):
    same = spark.range(1000).select(F.lit("f").alias("feature"), (F.col("id") % 97).cast("double").alias("value"))
    assert evaluate.psi(same, same).first()["psi"] == 0.0
    moved = same.withColumn("value", F.col("value") + 60)
    assert evaluate.psi(same, moved).first()["psi"] > 0.25
    flat = same.withColumn("value", F.lit(3.0))
    assert evaluate.psi(flat, same).first()["psi"] == 0.0
    closed, opened = (evaluate.psi(same, moved, open_ends=o).first()["psi"] for o in (False, True))
    assert closed != opened


def test_market_needs_rows(spark):
    empty = spark.createDataFrame([], "model_p_t1 double, market_p_t1 double, result double")
    with pytest.raises(Exception, match="no priced contests"):
        evaluate.model_vs_market(empty).collect()


def test_edge_scan(spark):
    odds = spark.createDataFrame([("A", "b", 2.0, 1.9), ("A", "C", 2.0, 2.0), ("A", "B", 0.9, 2.0)], "team1 string, team2 string, odds1 double, odds2 double")
    ratings = spark.createDataFrame([("A", 1600.0), ("B", 1500.0)], "team string, rating double")
    out = evaluate.edge_scan(odds, ratings).collect()
    by = {(r["team2"]): r for r in out}
    assert by["b"]["bet"] and by["b"]["best_side"] == "A" and by["b"]["elo_p1"] == pytest.approx(0.640065, abs=1e-6)
    assert by["C"]["skipped"] == "no rating for C" and by["B"]["skipped"].startswith("decimal odds")


def test_grading(spark):
    gold = spark.createDataFrame([("a", 1.00001)], "x string, y double")
    assert evaluate.compare_result_sets(spark.createDataFrame([("a", 1.0), ("a", 1.0)], "p string, q double"), gold).first()["verdict"] == "exact"
    assert evaluate.compare_result_sets(spark.createDataFrame([("a", 1.0), ("a", 1.0)], "p string, q double"), gold, multiset=True).first()["verdict"] == "partial"
    assert evaluate.compare_result_sets(spark.createDataFrame([(" A ", 1, 7)], "p string, q int, r int"), gold).first()["verdict"] == "partial"
    assert evaluate.compare_result_sets(spark.createDataFrame([("z",)], "p string"), gold).first()["verdict"] == "wrong"


def test_leakage_guard():
    features.leakage_guard(list(features.DEFAULT_FEATURES), ["standin_diff"])
    for bad in ("winner", "margin", "new_column"):
        with pytest.raises(features.LeakageError):
            features.leakage_guard(list(features.DEFAULT_FEATURES), [bad])


def test_models_learn_and_are_symmetric(spark):
    from datetime import datetime, timedelta

    rng = np.random.default_rng(2)
    rows = []
    for i in range(3000):
        gap = float(rng.normal(0, 150))
        rows.append((i, datetime(2024, 1, 1) + timedelta(minutes=12 * i), f"tier{i % 2 + 1}", bool(i % 4 == 0), gap, float(rng.normal()), 0.0,
                     0.5, 0.0, 0.0, float(rng.random() < 1 / (1 + 10 ** (-gap / 400))), 0.0))
    store = spark.createDataFrame(rows, "match_id long, datetime timestamp, tier string, is_bo1 boolean, elo_diff double, form5_diff double, "
                                        "rest_days_diff double, h2h_t1_win_share double, roster_stability_diff double, standin_diff double, "
                                        "result double, bo1_elo double").cache()
    matrix, names = features.feature_matrix(store, [], "2024-01-20")
    model = models.fit_logistic(matrix.where("split = 'train'"))
    test = matrix.where("split = 'test'")
    loss = evaluate.score(models.predict_proba(model, test), p="p", y="label").first()["logloss"]
    truth = [(1 / (1 + 10 ** (-r[4] / 400)), r[10]) for r in rows if r[1] >= datetime(2024, 1, 20)]
    best = -np.mean([y * np.log(p) + (1 - y) * np.log(1 - p) for p, y in truth])
    assert best - 0.01 < loss < best + 0.02 and loss < 0.6931
    importance = {r["feature"]: r["importance"] for r in models.permutation_importance(model, test, names, 3).collect()}
    assert max(importance, key=importance.get) == "elo_diff"
    ratings = spark.createDataFrame([("A", 1600.0), ("B", 1450.0)], "team string, rating double")
    asks = spark.createDataFrame([(1, "A", "B", 3), (2, "B", "a", 3), (3, "A", "B", 2), (4, "A", "zz", 1)], "request_id int, team1 string, team2 string, best_of int")
    out = {r["request_id"]: r for r in models.score_batch(model, names, asks, ratings).collect()}
    assert out[1]["p_team1"] + out[2]["p_team1"] == pytest.approx(1.0) and out[1]["p_team1"] > 0.5
    assert out[3]["status"] == "rejected" and out[4]["unknown_team"] == "zz" and out[4]["elo_t2"] == 1500.0


def test_strengths_shrink_with_few_contests(spark):
    rows = [(i, "A", "B", "A") for i in range(40)] + [(100 + i, "C", "B", "C") for i in range(2)]
    df = spark.createDataFrame(rows, "match_id int, team1 string, team2 string, winner string").withColumn("datetime", F.current_timestamp())
    out = {r["team"]: r for r in models.bradley_terry(df).collect()}
    assert out["A"]["posterior_mean"] > out["C"]["posterior_mean"] > 1500 > out["B"]["posterior_mean"]
    assert out["C"]["hi"] - out["C"]["lo"] > out["A"]["hi"] - out["A"]["lo"] or out["A"]["n_series"] > out["C"]["n_series"]


def test_holt_follows_a_line(spark):
    from faceoff.operators.forecast import holt_forecast

    rows = [("A", f"{2020 + i // 12}-{i % 12 + 1:02d}", 1500.0 + 3 * i + (i % 2) * 0.1) for i in range(30)] + [("short", f"2020-{i:02d}", 1.0) for i in range(1, 10)]
    out = holt_forecast(spark.createDataFrame(rows, "team string, month string, elo double")).orderBy("step").collect()
    assert [r["step"] for r in out] == [1, 2, 3] and out[0]["forecast"] == pytest.approx(1590, abs=1.0)
    assert out[0]["lo80"] < out[0]["forecast"] < out[0]["hi80"] and out[0]["mape"] < out[0]["mape_naive"]
