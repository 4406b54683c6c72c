import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from faceoff.operators import boosting, models
from faceoff.operators.models import encode_entities
from faceoff.plans.catalog import QUERIES


def test_names_are_numbered_in_plain_order(spark):
    names = ["apple", "Banana", "Cat", "cat", "Élan", *[f"Customer#{i:06d}" for i in range(50)]]
    train = spark.createDataFrame([(n, names[0]) for n in names] + [(None, "Cat")], "team1 string, team2 string")
    rows = spark.createDataFrame([(n, "unseen") for n in names], "team1 string, team2 string")
    got = {r["team1"]: (r["team1_idx"], r["team2_idx"]) for r in encode_entities(train, rows).collect()}
    assert got == {n: (i, 0) for i, n in enumerate(sorted(names), 1)}


class Stop(Exception):
    pass


@pytest.mark.parametrize("name", ["fit_gbm", "fit_gbm_isotonic", "leakage_demo", "model_table"])
def test_queries_train_with_the_published_settings(spark, monkeypatch, name):
    def stop(train, members, *settings, **_):
        raise Stop(settings)

    monkeypatch.setattr(boosting, "fit_members", stop)
    with pytest.raises(Stop) as got:
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.value.args == ((200, 3, 0.06, 1.0),)


def test_factors_train_with_the_published_rounds(spark, monkeypatch):
    def stop(**settings):
        raise Stop(settings["maxIter"])

    monkeypatch.setattr(models, "FMClassifier", stop)
    with pytest.raises(Stop) as got:
        QUERIES["entity_factor_model"](spark, "/root/testdata/sf0.001")
    assert got.value.args == (100,)


def plain_boosting(x, y, cuts, rounds, depth, rate, penalty, least):
    """The same trees by loops over nodes, features and cut points."""
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        nodes = [np.arange(len(y))]
        for _ in range(depth):
            following = []
            for at in nodes:
                best = (1e-12, None)
                for j, own in enumerate(cuts):
                    for cut in own:
                        left, right = at[x[at, j] <= cut], at[x[at, j] > cut]
                        if min(len(left), len(right)) >= least:
                            gain = sum(g[s].sum() ** 2 / (h[s].sum() + penalty) for s in (left, right)) - g[at].sum() ** 2 / (h[at].sum() + penalty)
                            if gain > best[0] + 1e-12:
                                best = (gain, (left, right))
                following += list(best[1]) if best[1] else [at]
            nodes = following
        for at in nodes:
            raw[at] -= rate * g[at].sum() / (h[at].sum() + penalty)
    return 1 / (1 + np.exp(-raw))


def test_boosted_trees_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(300, 3)), 2)
    y = (x[:, 0] + x[:, 1] * (x[:, 2] > 0) + rng.normal(size=300) > 0).astype(float)
    rows = [(i, Vectors.dense(v), float(t), 3 if i < 200 else 2) for i, (v, t) in enumerate(zip(x.tolist(), y, strict=True))]
    df = spark.createDataFrame(rows, ["id", "features", "label", "m"])
    first, every = boosting.fit_members(df.repartition(3), 2, 5, 3, 0.3, 1.0, least=10, member="m")
    for model, own in ((first, 200), (every, 300)):
        want = plain_boosting(x[:own], y[:own], model.cuts, 5, 3, 0.3, 1.0, 10)
        got = {r["id"]: r["p"] for r in model.transform(df).collect()}
        assert np.allclose([got[i] for i in range(own)], want)


def test_a_pass_of_boosting_is_one_stage(spark):
    rows = [(Vectors.dense([float(i % 7), float(i % 5)]), float(i % 7 > 3)) for i in range(200)]
    df = spark.createDataFrame(rows, ["features", "label"]).repartition(4).persist()
    df.count()
    tracker, stages = spark.sparkContext.statusTracker(), []
    for rounds in (1, 4):
        group = f"boosting-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        boosting.fit_members(df, 1, rounds, 2, 0.3, 1.0)
        stages.append(sum(len(tracker.getJobInfo(job).stageIds) for job in tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    df.unpersist()
    assert stages[1] - stages[0] == 3 * 2


def test_rows_reach_the_leaf_of_every_node_that_splits():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (4, 500), np.uint8)
    tree = (np.array([1, 3, -1, 0, 2, -1, 1]), rng.integers(0, 8, 7), rng.normal(size=15))
    want = []
    for row in x.T:
        node = 0
        while node < 7:
            node = 2 * node + 1 + int(tree[0][node] >= 0 and row[max(tree[0][node], 0)] > tree[1][node])
        want.append(tree[2][node])
    assert np.allclose(boosting.added([tree, tree], x), 2 * np.array(want))


def test_boosted_trees_on_odd_features(spark):
    rows = [(Vectors.dense([float("nan"), 1.0, float(i % 7)]), float(i % 7 > 3)) for i in range(200)] + [(Vectors.dense([0.0, 1.0, 1e300]), 1.0)]
    df = spark.createDataFrame(rows, ["features", "label"])
    p = [r["p"] for r in models.predict_proba(models.fit_gbm(df, 30), df).collect()]
    assert all((v > 0.5) == (r[1] == 1.0) for v, r in zip(p, rows, strict=True))


def test_dated_rosters_are_derived_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(v):
        seen.add(1)
        return v

    rows = spark.range(120).select(
        F.col("id").alias("match_id"), F.expr("make_date(if(id < 80, 1995, 2000), 1, 1 + CAST(id % 28 AS INT))").cast("timestamp_ntz").alias("datetime"),
        F.lit("tier1").alias("tier"), (F.col("id") % 3 == 0).alias("is_bo1"), (F.col("id") % 2).cast("double").alias("result"),
        *[((F.col("id") * k) % 11).cast("double").alias(n) for k, n in enumerate(
            ("elo_diff", "form5_diff", "rest_days_diff", "h2h_t1_win_share", "roster_stability_diff", "standin_diff"), 2)])
    tenure = spark.range(120).select(F.col("id").alias("match_id"), *[F.udf(count, "double")((F.col("id") % 7).cast("double")).alias("tenure_min_diff")],
                                     F.lit(0.0).alias("tenure_avg_diff"), F.lit(None).cast("double").alias("recent_join_diff"))
    out = models.dated_roster_ab(rows, tenure, "1997-06-01").collect()
    assert [(r["label"], r["n"]) for r in out] == [("current", 40), ("with dated roster", 40)]
    assert seen.value == 120


def test_the_mode_of_sparse_contests_has_no_gradient(spark):
    """A chain, a star and a pair apart: graphs on which steps per entity alone settle slowly."""
    games = [(f"c{i}", f"c{i + 1}", i % 3 > 0) for i in range(30) for _ in range(20)] + [("hub", f"s{i}", i % 2 == 0) for i in range(12)] + [("x", "y", True)] * 50
    rows = [(i, a, b, a if won else b) for i, (a, b, won) in enumerate(games)]
    df = spark.createDataFrame(rows, "match_id int, team1 string, team2 string, winner string").withColumn("datetime", F.current_timestamp())
    for hierarchical in (False, True):
        got = {r["team"]: ((r["posterior_mean"] - 1500) / 173, r["n_series"]) for r in models.bradley_terry(df, hierarchical).collect()}
        slope = {t: -th / (350 / 173 * (n / (n + 30) if hierarchical else 1)) ** 2 for t, (th, n) in got.items()}
        for _, a, b, winner in rows:
            p = 1 / (1 + np.exp(got[b][0] - got[a][0]))
            slope[a] += 2 * ((winner == a) - p)
            slope[b] -= 2 * ((winner == a) - p)
        assert max(map(abs, slope.values())) < 1e-6


def test_boosting_reads_rows_of_equal_bins_as_one_cell(spark, monkeypatch):
    rows = [(Vectors.dense([float(i % 7), float(i % 5)]), float(i % 7 > 3 or i % 5 == 1 and i % 2 == 0), i % 3 + 1) for i in range(2100)]
    df = spark.createDataFrame(rows, ["features", "label", "m"]).repartition(4)
    stored, write = [], boosting.write_and_reread

    def keep(rows, label):
        out = write(rows, label)
        if label == "boosting-blocks":
            stored.append(out.agg(F.sum("n")).first()[0])
        return out

    monkeypatch.setattr(boosting, "write_and_reread", keep)
    first, second = boosting.fit_members(df, 2, 4, 2, 0.3, 1.0, member="m")
    assert stored == [7 * 5 * 3]
    for k, model in enumerate((first, second)):
        own = [(v.toArray(), y) for v, y, m in rows if m >> k & 1]
        x, y = np.stack([v for v, _ in own]), np.array([t for _, t in own])
        got = {tuple(r["features"].toArray()): r["p"] for r in model.transform(df).collect()}
        assert np.allclose([got[tuple(v)] for v in x], plain_boosting(x, y, model.cuts, 4, 2, 0.3, 1.0, 20))


def test_a_model_table_scores_every_row_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def half(v):
        seen.add(1)
        return 0.25 + v % 2 / 2

    rows = spark.range(100).select(F.lit("m").alias("model"), F.udf(half, "double")("id").alias("p"), (F.col("id") % 2).cast("double").alias("y"))
    row = models.model_table(rows).first()
    assert (row["n"], row["acc"], row["brier"], row["ece"]) == (100, 1.0, 0.0625, 0.25) and seen.value == 100
