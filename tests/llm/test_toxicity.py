import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faceoff.llm import text as T
from faceoff.llm import toxicity

BAD = ["grublak", "snorfel", "dreckzon", "mupfel", "vilzak"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        w = [f"{rng.choice(['la', 'mi', 'to', 'ne'])}{rng.choice(['ra', 'lo', 'su'])}{rng.randrange(40)}" for _ in range(rng.randrange(20, 120))]
        toxic = int(rng.random() < .3)
        for _ in range(toxic * rng.randrange(2, 5)):
            w.insert(rng.randrange(len(w)), rng.choice(["you ", ""]) + rng.choice(BAD) + rng.choice(["", "s", "ung"]))
        rows.append((i, " ".join(w)))
        labels.append((i, toxic ^ int(rng.random() < .02)))
    return (spark.createDataFrame(rows, "doc_id long, text string").repartition(4),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, F.col("doc_id") % 4 != 0)
    got = toxicity.score(docs, model).join(labels, "doc_id").where("doc_id % 4 = 0").toPandas()
    wrong = (got["predicted"] != got["toxic"]).mean()
    assert wrong < .08 and ((got["score"] - got["toxic"]) ** 2).mean() < .08
    assert ((got["score"] >= .5).astype(int) == got["predicted"]).all() and got["score"].between(0, 1).all()


def test_only_training_labels_count(corpus):
    docs, labels = corpus
    train = F.col("doc_id") % 4 != 0
    flipped = labels.withColumn("toxic", F.when(train, F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (sorted(tuple(r) for r in toxicity.score(docs, toxicity.fit(docs, x, train)).collect()) for x in (labels, flipped))
    assert a == b


def test_features_are_finite_for_odd_texts(odd, odd_rows):
    for block in T.blocks(pa.array([r[1] for r in odd_rows] + ["!!! ??? 1d10t YOU"], pa.string())):
        x = toxicity.features(block, np.zeros(0, np.uint64), np.zeros(0))
        assert x.shape == (block.docs, len(toxicity.FEATURES)) and np.isfinite(x).all() and (x[0] == 0).all()


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=500)
    x, y = toxicity.isotonic(raw, (rng.random(500) < 1 / (1 + np.exp(-raw))).astype(float))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all()


def test_without_labels_and_empty(odd, none, spark):
    nothing = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, nothing, F.lit(True))
    assert {r["score"] for r in toxicity.score(odd, model).collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0


def test_features_equal_plain_counting():
    texts = ["You GRUBLAK! are a gr0bl@k?? 12", "vous snorfelung x", "la la la", "du!", "A1b c-d YOUR.", ""]
    words = sorted(zip(toxicity._hash_words(BAD).tolist(), [2.0] * len(BAD), strict=True))
    keys, odds = np.array([w[0] for w in words], np.uint64), np.array([w[1] for w in words])
    block = next(T.blocks(pa.array(texts)))
    x = toxicity.features(block, keys, odds)
    for row, text in zip(x, texts, strict=True):
        f = dict(zip(toxicity.FEATURES, row, strict=True))
        tokens = re.findall(r"[0-9A-Za-z]+", text)
        n, hits = max(len(tokens), 1), [t.lower() in BAD for t in tokens]
        second = [t.lower() in toxicity.SECOND for t in tokens]
        near = [h and any(second[max(i - 4, 0):i + 5]) for i, h in enumerate(hits)]
        letters = [c for c in text if c.isalpha()]
        assert f["tokens"] == pytest.approx(np.log1p(len(tokens))) and f["hit_share"] == pytest.approx(sum(hits) / n)
        assert f["weight_share"] == pytest.approx(2 * sum(hits) / n) and f["weight_most"] == 2 * any(hits)
        assert f["second_share"] == pytest.approx(sum(second) / n) and f["near_share"] == pytest.approx(sum(near) / n)
        assert f["capitals"] == pytest.approx(sum(c.isupper() for c in letters) / max(len(letters), 1))
        assert f["exclaims"] == pytest.approx(text.count("!") / max(len(text), 1)) and f["questions"] == pytest.approx(text.count("?") / max(len(text), 1))
        assert f["digits"] == pytest.approx(sum(c.isdigit() for c in text) / max(len(text), 1))
        assert f["capital_words"] == pytest.approx(sum(len(t) > 1 and t.isupper() and t.isalpha() for t in tokens) / n)


def test_trees_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 4)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] * x[:, 1] + .3 * rng.normal(size=400) > 0).astype(float)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, toxicity.BINS)[1:-1])) for j in range(3)]
    trees, bias = toxicity._grow(x, cuts, y)
    raw = np.full(400, np.log(y.mean() / (1 - y.mean())))
    for _ in range(4):
        p = 1 / (1 + np.exp(-raw))
        g, h, nodes = p - y, p * (1 - p), [np.arange(400)]
        score = lambda at: g[at].sum() ** 2 / (h[at].sum() + toxicity.SHRINK)  # noqa: E731, B023
        for _ in range(toxicity.DEPTH):
            following = []
            for at in nodes:
                best, halves = 1e-9, (at, at[:0])
                for j, own in enumerate(cuts):
                    for cut in own:
                        left, right = at[x[at, j] <= cut], at[x[at, j] > cut]
                        if min(len(left), len(right)) >= toxicity.LEAF and score(left) + score(right) - score(at) > best + 1e-12:
                            best, halves = score(left) + score(right) - score(at), (left, right)
                following += halves
            nodes = following
        for at in nodes:
            if len(at):
                raw[at] -= toxicity.RATE * g[at].sum() / (h[at].sum() + toxicity.SHRINK)
    assert np.allclose(toxicity.raw_scores(x, toxicity.ToxicityModel(0.5, trees=trees, bias=bias)), raw)


def test_isotonic_equals_the_largest_smallest_mean():
    rng = np.random.default_rng(4)
    raw = rng.normal(size=60)
    y = (rng.random(60) < 1 / (1 + np.exp(-raw))).astype(float)
    x, v = toxicity.isotonic(raw, y)
    own = y[np.argsort(raw)]
    fit = [max(min(own[i:j + 1].mean() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    assert np.allclose(sorted(set(np.round(fit, 9))), v, atol=1e-3) and len(x) == len(set(np.round(fit, 9)))
