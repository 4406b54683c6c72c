"""Quality rules: fixed rules on words and lines, then a hashed n-gram log-likelihood ratio.

Method. Every text is a bag of n-grams of ``GRAM`` bytes (case kept), hashed into ``BUCKETS`` buckets. Two
multinomials over the buckets are counted: one over all documents, one over the trusted documents (label 1).
A text's score is its mean log ratio trusted / raw per n-gram; n-grams typical of junk are common in the raw
counts and rare among trusted texts. A document is kept if it passes the fixed rules and its score reaches
the threshold, which is fitted once on labelled documents and is then the same for every document.

Bounds. Every trusted document is counted and every labelled one helps to place the threshold: labels are joined to
the texts, counts fit in ``BUCKETS`` buckets, scores in steps of 1 / ``STEPS``. A model is ``BUCKETS`` numbers and a
threshold, whatever the input.

Edge cases. Null or empty text: no words, which fails the fixed rules. A text shorter than one n-gram has
score 0. Null labels are ignored; a doc_id labelled twice differently is ignored. Without labels of both
kinds no text is rejected by the ratio. Repeated rows are judged alike, one result each. Extra columns pass
through ``keep`` untouched. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faceoff.llm import text as T

GRAM = 4
BUCKETS = 1 << 15
#: Labels are sent to every executor up to this number (about 24 bytes each); more are joined by a shuffle of the texts.
SENT_LABELS = 2_000_000
#: Steps of a score of 1, in which the labelled documents are counted.
STEPS = 10_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A trusted document rejected weighs as much as this many junk documents kept.
TRUST_WEIGHT = 20


@dataclass(frozen=True)
class QualityModel:
    """Log ratio per bucket, and the least score that is kept."""

    ratio: np.ndarray
    threshold: float


def _grams(block: T.Block) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte, and the number of n-grams of each document."""
    n = len(block.data) - GRAM + 1
    size = np.maximum(np.diff(block.offsets) - GRAM + 1, 0)
    if n <= 0:
        return np.zeros(0, np.int64), size
    x = block.data.astype(np.uint32)
    value = x[:n] | x[1:n + 1] << np.uint32(8) | x[2:n + 2] << np.uint32(16) | x[3:n + 3] << np.uint32(24)
    bucket = (value * np.uint32(2654435761)) >> np.uint32(17)
    end = np.repeat(block.offsets[1:], np.diff(block.offsets))[:n]
    return bucket[np.arange(n) + GRAM <= end].astype(np.int64), size


def _edges(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)])


def _scores(block: T.Block, ratio: np.ndarray) -> np.ndarray:
    bucket, size = _grams(block)
    out, some = np.zeros(len(size)), size > 0
    if some.any():
        # a text's sum does not depend on its neighbours
        out[some] = np.add.reduceat(ratio[bucket], _edges(size)[:-1][some]) / size[some]
    return out


def _repeated(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which (document, key) pairs occur more than once, the first included."""
    tagged = T.mix(keys ^ T.mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(tagged, kind="stable")
    same = tagged[order][1:] == tagged[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _measures(block: T.Block) -> dict[str, np.ndarray]:
    w = T.words(block)
    inside = ~T.SPACE[block.data]
    chars = inside & ((block.data & 0xC0) != 0x80)
    owner = np.repeat(np.arange(block.docs), w.counts)
    at, key = T.windows(w.hashes, w.first, 3)
    covered = np.zeros(len(w.hashes) + 3, bool)
    hit = at[_repeated(owner[at], key)] if len(at) else at
    for k in range(3):
        covered[hit + k] = True
    starts, ends = T.runs(block.data, block.offsets, block.data != 10)
    line_words = np.searchsorted(w.starts, ends) - np.searchsorted(w.starts, starts)
    starts, ends = starts[line_words > 0], ends[line_words > 0]
    line_doc = np.searchsorted(block.offsets, starts, "right") - 1
    tagged = T.mix(T.hash_spans(block.data, starts, ends) ^ T.mix(line_doc.astype(np.uint64) + np.uint64(1)))
    _, seen = np.unique(tagged, return_index=True)
    lines = np.bincount(line_doc, minlength=block.docs)
    return {
        "n_words": w.counts,
        "word_chars": T.sums(chars, block.offsets),
        "n_symbols": T.sums(SYMBOLS[block.data], block.offsets),
        "n_dup_lines": lines - np.bincount(line_doc[seen], minlength=block.docs),
        "n_repeat_words": T.sums(covered[:len(w.hashes)], w.first),
    }


def _base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def _counter(batches):
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        chosen = np.asarray(batch.column("_y").fill_null(0)) == 1
        for block in T.blocks(batch.column("_t")):
            bucket, size = _grams(block)
            raw += np.bincount(bucket, minlength=BUCKETS)
            mine = np.repeat(chosen[block.lo:block.hi], size)
            good += np.bincount(bucket[mine], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], ["bucket", "raw", "good"])


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """Count both multinomials over the corpus and place the threshold; the size of the labels decides how they are joined."""
    rows = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).cast("string").alias("_t"))
    marked = (labels.select(F.col(key).cast("long").alias("_k"), F.col(label).cast("int").alias("_y"))
              .where("_k is not null and _y in (0, 1)").groupBy("_k").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z"))
              .where("_y = _z").select("_k", "_y"))
    if marked.count() <= SENT_LABELS:
        marked = F.broadcast(marked)
    counts = (rows.join(marked, "_k", "left").select("_t", "_y").mapInArrow(_counter, "bucket long, raw long, good long")
              .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect())
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    if not good.sum():
        return QualityModel(np.zeros(BUCKETS), -np.inf)
    ratio = np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    judged = (rows.join(marked, "_k").select("_y", F.col("_t").alias("text"))
              .mapInArrow(_judge(QualityModel(ratio, -np.inf), ["_y"]), "_y int, base_failed boolean, score double")
              .where("not base_failed").groupBy(F.floor(F.col("score") * STEPS).alias("step")).agg(
                  F.count_if(F.col("_y") == 1).alias("good"), F.count_if(F.col("_y") == 0).alias("bad")).orderBy("step").collect())
    return QualityModel(ratio, _threshold(*(np.array([r[c] for r in judged], np.int64) for c in ("step", "good", "bad"))))


def _threshold(step: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The cut between score steps with the least weighted error; the middle of the gap that it lies in."""
    if not good.sum() or not bad.sum():
        return -np.inf
    below_good, below_bad = (np.concatenate([[0], np.cumsum(n)]) / n.sum() for n in (good, bad))
    at = int(np.argmin(TRUST_WEIGHT * below_good + 1 - below_bad))
    if at == 0:
        return -np.inf
    return float((step[-1] + 1 if at == len(step) else (step[at - 1] + 1 + step[at]) / 2) / STEPS)


def _judge(model: QualityModel, carry: list[str], measures: bool = False):
    def run(batches):
        for batch in batches:
            parts: dict[str, list] = {m: [] for m in MEASURES}
            score = []
            for block in T.blocks(batch.column("text")):
                for k, v in _measures(block).items():
                    parts[k].append(v)
                score.append(_scores(block, model.ratio))
            if not score:
                continue
            m = {k: np.concatenate(v).astype(np.int64) for k, v in parts.items()}
            failed, s = _base_failed(m), np.concatenate(score)
            out = {c: batch.column(c) for c in carry} | ({k: pa.array(v) for k, v in m.items()} if measures else {}) | {
                "base_failed": pa.array(failed), "score": pa.array(s)}
            if measures:
                out["kept"] = pa.array(~failed & (s >= model.threshold))
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
    return run


def measure(docs: DataFrame, model: QualityModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, the measures, base_failed, score and kept."""
    kind = dict(docs.dtypes)[key]
    schema = f"{key} {kind}, " + ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean, score double, kept boolean"
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_judge(model, [key], measures=True), schema)


def _keeper(model: QualityModel, text: str):
    def run(batches):
        for batch in batches:
            kept = [np.zeros(0, bool)]
            for block in T.blocks(batch.column(text)):
                kept.append(~_base_failed(_measures(block)) & (_scores(block, model.ratio) >= model.threshold))
            yield batch.filter(pa.array(np.concatenate(kept)))
    return run


def keep(docs: DataFrame, model: QualityModel, *, text: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""
    return docs.mapInArrow(_keeper(model, text), docs.schema)
