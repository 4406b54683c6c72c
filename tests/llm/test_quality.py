import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faceoff.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 2), 0) for i in range(8, 40)] + [(None, 1, 0), (9, None, None)],
                                 "doc_id long, quality int, toxic int")


def test_measures_equal_plain_counting(odd, odd_rows, labels):
    model = quality.fit(odd, labels)
    got = {r["doc_id"]: tuple(r[m] for m in quality.MEASURES) + (r["base_failed"],) for r in quality.measure(odd, model).collect()}
    assert got == {r[0]: plain(r[1]) for r in odd_rows}


def test_ratio_rejects_junk_and_keeps_prose(spark):
    good = " ".join(f"word{i % 37} plain{i % 31} text{i % 29}" for i in range(60))
    junk = " ".join(f"x{i}$$$ y{i * 7}%%%" for i in range(90))
    docs = spark.createDataFrame([(i, good if i % 2 else junk) for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    verdict = {r["doc_id"]: r["kept"] for r in quality.measure(docs, quality.fit(docs, labels)).collect()}
    assert all(verdict[i] == bool(i % 2) for i in range(40) if not plain(good)[-1])


def test_no_labels_reject_nothing_more_than_the_rules(odd, labels):
    model = quality.fit(odd, labels.limit(0))
    assert all(r["kept"] != r["base_failed"] for r in quality.measure(odd, model).collect())


def test_keep_is_measure_applied(odd, labels):
    model = quality.fit(odd, labels)
    kept = sorted(r["doc_id"] for r in quality.keep(odd.withColumn("score", F.lit(1)), model).collect())
    assert kept == sorted(r["doc_id"] for r in quality.measure(odd, model).collect() if r["kept"])


def test_empty_tables(none, labels):
    model = quality.fit(none, labels)
    assert quality.measure(none, model).count() == 0 and quality.keep(none, model).count() == 0


@pytest.mark.parametrize("sent", [0, 2_000_000])
def test_ratio_and_threshold_equal_plain_counting_of_all_labelled_texts(odd, odd_rows, spark, monkeypatch, sent):
    monkeypatch.setattr(quality, "SENT_LABELS", sent)
    marks = [(r[0], 1 if r[0] % 3 else 0) for r in odd_rows if r[0] != 13] + [(13, 0), (13, 1), (None, 1), (17, None)]
    model = quality.fit(odd.withColumn("_y", F.lit(1)).withColumn("step", F.lit("x")), spark.createDataFrame(marks, "doc_id long, quality int"))
    agreed = {k: y for k, y in marks if k is not None and y is not None and k != 13}

    def grams(text):
        raw = (text or "").encode()
        return [(int.from_bytes(raw[i:i + 4], "little") * 2654435761 % 2**32) >> 17 for i in range(len(raw) - 3)]

    raw, good = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for k, t, *_ in odd_rows:
        for b in grams(t):
            raw[b] += 1
            good[b] += agreed.get(k) == 1
    ratio = np.log((good + 1) / (good.sum() + quality.BUCKETS)) - np.log((raw + 1) / (raw.sum() + quality.BUCKETS))
    assert np.allclose(model.ratio, ratio)
    scored = [(np.mean([ratio[b] for b in grams(t)]), agreed[k]) for k, t, *_ in odd_rows if k in agreed and not plain(t)[-1]]
    n = [sum(y == v for _, y in scored) for v in (0, 1)]
    cost = lambda cut: quality.TRUST_WEIGHT * sum(y and s < cut for s, y in scored) / n[1] + sum(not y and s >= cut for s, y in scored) / n[0]
    best = min(cost(c) for c in [-np.inf, *(s + 1e-12 for s, _ in scored)])
    assert min(n) and cost(model.threshold) <= best + 1e-9
