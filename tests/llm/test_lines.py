import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faceoff.llm import lines
from faceoff.llm import text as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(f"w{rng.randrange(400)}" for _ in range(n))



@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        own = [prose(rng, rng.randrange(5, 40)) + rng.choice([".", ""]) for _ in range(rng.randrange(1, 9))]
        bad = int(rng.random() < .3)
        if bad:
            for k in range(rng.randrange(len(own)), len(own)):
                own[k] = " | ".join(own[k].split(" ")) if i % 2 else " ".join(w.upper() + "!!" for w in own[k].split(" "))
        rows.append((i, "\n".join(own)))
        labels.append((i, 1 - (bad ^ int(rng.random() < .01))))
    return (spark.createDataFrame(rows, "doc_id long, text string").repartition(4),
            spark.createDataFrame(labels, "doc_id long, quality int"))


def test_marginals_equal_the_sum_over_all_labellings():
    rng = np.random.default_rng(1)
    first = np.array([0, 1, 1, 5, 8])
    odds, ties = rng.normal(size=8) * 2, rng.normal(size=(2, 2))
    p, pairs = lines.marginals(odds, first, ties)
    want, want_pairs = np.zeros(8), np.zeros((2, 2))
    for a, z in zip(first, first[1:], strict=False):
        total, good, both = 0.0, np.zeros(z - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(z - a)):
            weight = np.exp(sum(odds[a + i] * v for i, v in enumerate(y)) + sum(ties[u, v] for u, v in zip(y, y[1:], strict=False)))
            total += weight
            good += weight * np.array(y)
            for u, v in zip(y, y[1:], strict=False):
                both[u, v] += weight
        if z > a:
            want[a:z] = good / total
        want_pairs += both / total
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)
    extreme, _ = lines.marginals(np.array([800.0, -800.0]), np.array([0, 2]), ties)
    assert np.allclose(extreme, [1, 0])


def test_fit_ends_where_the_gradient_is_small():
    rng = np.random.default_rng(2)
    first = np.arange(0, 401, 4)
    code = rng.integers(0, lines.BINS, size=(400, 3)) + np.arange(3) * (lines.BINS + 1)
    y = ((code[:, 0] > 4) ^ (rng.random(400) < .1)).astype(float)
    weights, ties = lines.fit_field(code, first, y, steps=1500)
    p, _ = lines.marginals(weights[code].sum(1), first, ties)
    slope = np.bincount(code.ravel(), weights=np.repeat(y - p, 3), minlength=len(weights)) / 400 - lines.PENALTY * weights / 20
    assert np.abs(slope).max() < 2e-3


def test_features_by_brute_force(odd_rows):
    texts = [r[1] for r in odd_rows] + ["Ab cd. EF!\n\n| x9 | x9\nAb cd. EF!", "\n", "a\n"]
    for block in T.blocks(pa.array(texts, pa.string())):
        own = lines.lines(block)
        at = 0
        for i in range(block.docs):
            seen = []
            for line in (texts[block.lo + i] or "").split("\n"):
                w = WORD.findall(line)
                if not w:
                    continue
                raw = [x.encode() for x in w]
                x = dict(zip(lines.FEATURES, own.x[at], strict=True))
                assert own.size[at] == len(line.encode()) and np.isclose(x["words"], np.log2(len(w)))
                assert np.isclose(x["word_bytes"], np.mean([len(r) for r in raw])) and np.isclose(x["distinct"], len(set(w)) / len(w))
                assert np.isclose(x["repeats"], np.mean([j > 0 and w[j] == w[j - 1] for j in range(len(w))]))
                assert np.isclose(x["exclaims"], line.count("!") / len(line.encode())) and x["earlier_line"] == (line in seen)
                assert np.isclose(x["digits"], sum(c in "0123456789" for c in line) / len(line.encode())) and x["closed"] == (w[-1][-1] in ".!?")
                seen.append(line)
                at += 1
        assert at == len(own.x) and np.isfinite(own.x).all()


def test_score_is_the_length_weighted_mean_on_a_rising_curve(corpus):
    docs, labels = corpus
    model = lines.fit(docs, labels, F.col("doc_id") % 4 != 0)
    own = lines.lines(next(T.blocks(pa.array(["good words here.\nBAD!! LINE!!\nmore of it", "", None]))))
    p, _ = lines.marginals(model.weights[lines.codes(own, model.cuts)].sum(1), own.first, model.ties)
    raw = lines.raw_quality(own, model)
    assert np.isclose(raw[0], (p * [16, 12, 10]).sum() / 38) and np.isnan(raw[1:]).all()
    assert model.curve[0] > 0 and (lines.probabilities(own, model)[1:] == model.bare).all()


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    model = lines.fit(docs, labels, F.col("doc_id") % 4 != 0)
    got = lines.score(docs, model).join(labels, "doc_id").where("doc_id % 4 = 0").toPandas()
    assert (got["predicted"] != got["quality"]).mean() < .06 and got["score"].between(0, 1).all()
    assert ((got["score"] >= .3).astype(int) == got["predicted"]).all()


def test_only_training_labels_count_and_names_may_clash(corpus):
    docs, labels = corpus
    train = F.col("doc_id") % 4 != 0
    flipped = labels.withColumn("quality", F.when(train, F.col("quality")).otherwise(1 - F.col("quality")))
    clash = docs.select("*", F.lit(0).alias("k"), F.lit(1.0).alias("score"), F.lit("x").alias("t"), F.lit(9).alias("y"), F.lit(1).alias("quality")).repartition(3)
    a, b = (sorted(tuple(r) for r in lines.score(d, lines.fit(d, x, train)).collect()) for d, x in ((docs, labels), (clash, flipped)))
    assert a == b


def test_odd_texts_and_empty_tables(odd, odd_rows, none, spark, corpus):
    nothing = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert {r["score"] for r in lines.score(odd, lines.fit(odd, nothing, F.lit(True))).collect()} == {1.0}
    model = lines.fit(*corpus, F.lit(True))
    got = lines.score(odd, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert lines.score(none, model).count() == 0 and lines.score(none, lines.fit(none, nothing, F.lit(True))).count() == 0
