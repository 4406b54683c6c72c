import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faceoff.llm import lmscore, packed

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None]


def plain(rows, train, order, weights):
    counts, n, texts = Counter(), 0, 0
    for k, t in rows:
        if train(k):
            w = ["<", *tokens(t)]
            n += len(w) - 1
            texts += 1
            for i in range(1, len(w)):
                for m in range(1, order + 1):
                    if i - m + 1 >= 0:
                        counts[tuple(w[i - m + 1:i + 1])] += 1
    counts[("<",)] = texts
    v = sum(len(g) == 1 and g != ("<",) for g in counts)
    out = {}
    for k, t in rows:
        w = ["<", *tokens(t)]
        base = total = 0.0
        for i in range(1, len(w)):
            p = (counts[tuple(w[i:i + 1])] + 1) / (n + v + 1)
            base += math.log10(p)
            for m in range(2, order + 1):
                if i - m + 1 >= 0:
                    u, weight = counts[tuple(w[i - m + 1:i])], weights[min(m - 2, len(weights) - 1)]
                    p = (counts[tuple(w[i - m + 1:i + 1])] + weight * p) / (u + weight)
            total += math.log10(p)
        out[k] = (len(w) - 1, sum(counts[(x,)] > 0 for x in w[1:]), n, base, total)
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_plain_counting(odd, odd_rows, order):
    rows = list({r[0]: r[:2] for r in odd_rows}.values())
    want = plain(rows, lambda k: zlib.crc32(str(k).encode()) % 7 != 2, order, lmscore.WEIGHTS)
    docs = odd.dropDuplicates(["doc_id"])
    got = lmscore.score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2, order=order).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert abs(r["base_score"] - w[3]) < 1e-6 * max(1, abs(w[3])) and abs(r["score"] - w[4]) < 1e-6 * max(1, abs(w[4]))


def test_a_text_of_many_stretches(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, n) % 50)) for i, n in enumerate((3000, 700, 257, 256, 255, 1, 40))] + [(7, None)]
    docs = spark.createDataFrame([(*r, True, 1, "x") for r in rows], "doc_id long, text string, train boolean, k int, t string")
    for order in (1, 2, 3, 4):
        want = plain(rows, lambda k: k != 1, order, (5.0, 2.0))
        for r in lmscore.score(docs, F.col("doc_id") != 1, order=order, weights=(5.0, 2.0)).collect():
            assert abs(r["score"] - want[r["doc_id"]][4]) < 1e-8 * abs(want[r["doc_id"]][4])


def test_arcs_and_failure_of_a_state_sum_to_one():
    token, first, grams, keys, counts, where = lmscore._own_counts(pa.array(["a b a c a b", "b a b", "b c"]), np.array([True, True, False]), 3)
    number, lo = [], 0
    for _, ok in grams:
        own = np.full(len(ok), -1)
        own[ok] = where[lo:lo + ok.sum()]
        lo += ok.sum()
        number.append(own)
    n_train, vocabulary = 11, 4
    auto = lmscore.Automaton(first, number, counts, n_train, vocabulary, 2, (2.0, 3.0))
    words = np.unique(number[0])
    # the unseen class of the root has what its arcs leave
    assert np.isclose((10 ** auto.arc_weight[words])[counts[words] > 0].sum() + 1 / 16, 1)
    for state in np.flatnonzero((auto.depth[:-2] > 0) & (auto.depth[:-2] < 3) & (counts > 0)):
        leaves = [(number[auto.depth[state]][i + 1], number[0][i + 1]) for i in np.flatnonzero(number[auto.depth[state] - 1] == state)
                  if i + 1 < len(token) and i + 1 not in first]
        arcs = {g: w for g, w in leaves if counts[g] > 0}
        if not arcs:
            continue
        # what the arcs take, and what fails to the shorter history without them
        taken = sum(10 ** auto.arc_weight[g] for g in arcs)
        rest = 10 ** auto.fail_weight[state] * (1 - sum(10 ** auto.arc_weight[number[auto.depth[state] - 1][np.flatnonzero(number[auto.depth[state]] == g)[0]]] for g in arcs))
        assert np.isclose(taken + rest, 1)


def test_every_state_sums_to_one(spark):
    docs = spark.createDataFrame([(0, "a b a c"), (1, "b a b"), (2, "c")], "doc_id long, text string")
    train = F.lit(True)
    words = ["a", "b", "c", "zz"]
    probe = spark.createDataFrame([(10 + i, f"b {w}") for i, w in enumerate(words)] + [(20, "b")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lmscore.score(docs.union(probe), F.col("doc_id") < 3, order=2, weights=(2.0,)).collect()}
    by_plain = plain([(0, "a b a c"), (1, "b a b"), (2, "c")] + [(10 + i, f"b {w}") for i, w in enumerate(words)] + [(20, "b")], lambda k: k < 3, 2, (2.0,))
    assert all(abs(got[k] - by_plain[k][4]) < 1e-9 for k in got) and train is not None
    # p(. | b) over a, b, c, the unseen class and the end
    counts, n, v = Counter("abacbabc") + Counter({None: 3}), 11, 4
    uni = {w: (counts[w] + 1) / (n + v + 1) for w in ["a", "b", "c", "zz", None]}
    after = {"a": 2, None: 1}
    assert abs(sum((after.get(w, 0) + 2 * uni[w]) / (3 + 2) for w in uni) - 1) < 1e-12


def test_no_training_rows_and_empty_table(odd, none):
    got = lmscore.score(odd, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == 0 for r in got) and len(got) == odd.count()
    assert lmscore.score(none, F.lit(True)).count() == 0


def test_keys_survive_packing():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, np.int64).astype(np.uint64) * np.uint64(2))
    assert (packed.unpack_sorted(packed.pack_sorted(keys)) == keys).all() and len(packed.unpack_sorted(packed.pack_sorted(keys[:0]))) == 0
