import numpy as np
import pytest
from pyspark.sql import functions as F

from faceoff.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def whole(e):
    if e is None or not len(e) or any(x is None or not np.isfinite(x) for x in e):
        return None
    return [int(np.floor(256 * np.float64(np.float32(x)))) for x in e]


def brute(rows, every):
    live = [(k, y, whole(e)) for k, e, y in rows if k is not None and y is not None and whole(e) is not None]
    out = []
    for i, (k, y, e) in enumerate(live):
        if k % every:
            continue
        scored = [(-sum(a * b for a, b in zip(e, f, strict=False)), q, z == y) for j, (q, z, f) in enumerate(live) if j != i]
        for p, positive, _ in sorted(s for s in scored if s[2])[:5]:
            fits = sorted(s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            out += [(k, positive, r, q, -p, -s) for r, (s, q, _) in enumerate(fits, 1)]
    return sorted(out)


def clustered(rng, n, dim=12):
    centres = rng.normal(size=(6, dim))
    return [(i, (centres[rng.integers(6)] + rng.normal(size=dim) * .4).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(n)]


def mined(spark, rows, every, schema=SCHEMA):
    got = negatives.hard_negatives(spark.createDataFrame(rows, schema).repartition(3), F.col("vec_id") % every == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:                            # many tiles, blocks, packs and levels of merging
        for name, value in (("TILE", 40), ("BLOCK", 16), ("PACK", 4), ("HELD", 2), ("FAN", 3), ("SAMPLE", 50)):
            monkeypatch.setattr(negatives, name, value)
    rows = clustered(np.random.default_rng(1), 400)
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_odd_rows_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 20)
    rng = np.random.default_rng(2)
    rows = clustered(rng, 90, 4)
    rows += [(90 + i, [1.0, .5, .25, 0.0], i % 2) for i in range(60)]           # a hot group of copies
    rows += [(200, None, 1), (201, [], 1), (202, [1.0, None, 0.0, 0.0], 1), (203, [float("inf"), 0.0, 0.0, 0.0], 1), (204, [float("nan")] * 4, 0),
             (205, [1.0] * 4, None), (None, [1.0] * 4, 1), (210, [0.0] * 4, 0), (220, [0.0] * 4, 1), (230, [1.0, .5], 0), (10, rows[10][1], rows[10][2])]
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_a_search_skips_boxes_and_stays_exact():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-40, 40, size=(2000, 6)), rng.integers(400, 480, size=(2000, 6))])
    label, k = rng.integers(0, 3, 4000), rng.permutation(4000)
    tree = negatives.Tree(x, label, k, np.arange(4000))
    leaves = len(tree.levels[0][0])
    for i in range(0, 4000, 97):
        q = x[i]
        score = x @ q
        for same in (True, False):
            for low, high in ((-negatives.BIG, negatives.BIG), (1000, 9000)):
                best, opened = tree.search(q, int(label[i]), same, i, [low], [high], [-negatives.BIG], 7)
                at = np.flatnonzero(((label == label[i]) == same) & (np.arange(4000) != i) & (score >= low) & (score <= high))
                assert best[0] == sorted((-int(score[j]), int(k[j]), int(j)) for j in at)[:7]
                assert opened < leaves if i >= 2000 and low < 0 else True


def test_extra_columns_and_empty_tables(spark):
    rows = clustered(np.random.default_rng(4), 60, 3)
    clash = [(*r, 1, "x", 5, [1]) for r in rows]
    assert mined(spark, clash, 10, SCHEMA + ", row int, pack string, tile int, lows array<int>") == brute(rows, 10)
    assert mined(spark, [], 10) == [] and mined(spark, [(1, [1.0], 1)], 10) == [] and mined(spark, [(10, [1.0], 1)], 10) == []


def test_one_long_vector(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=5000).astype(np.float32).tolist(), i % 2) for i in range(12)]
    assert mined(spark, rows, 3) == brute(rows, 3)
