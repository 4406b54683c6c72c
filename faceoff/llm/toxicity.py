"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Method. The labelled training rows are split by hash. One part gives the lexicon: words and stems whose document frequency
is clearly higher in toxic texts (smoothed log odds). A second part fits boosted trees (logistic loss, histogram
splits) on the features in ``FEATURES``: lexicon densities, second-person words and their distance to lexicon words,
capitals, punctuation, and obfuscation (digits and symbols standing for letters). A third part calibrates: pooled
adjacent violators, read with linear interpolation, so an order among texts is kept.

Bounds. The classifier is fitted on the ``sample`` (20,000) training rows that come first by a hash of their key; the
lexicon has at most ``LEXICON`` words. The model is a few kB and every text is scored whole, in its own task.

Results. ``score``: key, score (0 to 1), predicted (1 if score >= 0.5). Only the text is an input of a score.

Edge cases. Null or empty text: all features 0, a score like any other. Null labels, null keys and keys labelled both
ways are not learned from. With labels of one kind only, or none, the score is that kind's share (0 without labels).
Repeated rows are scored alike. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faceoff.llm import text as T

FEATURES = ("tokens", "hit_share", "weight_share", "hits", "weight_most", "second_share", "near_share", "near_hits", "capitals",
            "capital_words", "exclaims", "questions", "points", "masked_share", "masked_hits", "capital_hits", "digits")
LEXICON = 2000
#: Lexicon entries are whole words and their first bytes, so that inflected and compound forms are met too.
STEMS = (4, 5, 6, 8)
LEAST_DOCS = 3
LEAST_ODDS = 1.5
NEAR = 4
BINS, DEPTH, TREES, RATE, SHRINK, LEAF = 48, 4, 120, 0.1, 1.0, 20
#: Second-person words of four languages.
SECOND = ("you your yours yourself u ur thou thee tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch "
          "usted ustedes vosotros ti tus").split()


def _flags(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


UPPER, LETTER = _flags(range(65, 91)), _flags([*range(65, 91), *range(97, 123), *range(128, 256)])
DIGIT, WORDY = _flags(range(48, 58)), _flags([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
MARK = _flags(b"@$*!|+")
POINT = _flags(b".,;:-'\"()[]{}#%&*$/\\<>=+_~^`@|")
#: What stands for a letter.
PLAIN = T.LOWER.copy()
for _from, _to in zip(b"013457@$!|+", b"oieastasiit", strict=True):
    PLAIN[_from] = _to


@dataclass(frozen=True)
class ToxicityModel:
    """Lexicon, trees and calibration; ``share`` alone where there was nothing to fit."""

    share: float
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trees: tuple = ()
    bias: float = 0.0
    knots: tuple = ()


def _tokens(block: T.Block):
    starts, ends = T.runs(block.data, block.offsets, WORDY[block.data])
    return starts, ends, T.hash_spans(block.data, starts, ends, T.CODES_LOWER), np.searchsorted(starts, block.offsets)


def _stems(block: T.Block, starts: np.ndarray, ends: np.ndarray):
    """For each stem length: the tokens longer than it, and the hashes of their stems."""
    for size in STEMS:
        long = np.flatnonzero(ends - starts > size)
        if len(long):
            yield long, T.hash_spans(block.data, starts[long], starts[long] + size, T.CODES_LOWER)


def _hash_words(words: list[str]) -> np.ndarray:
    block = next(T.blocks(pa.array([" ".join(words)])))
    return np.sort(_tokens(block)[2])


SECOND_KEYS = _hash_words(SECOND)


def _lookup(keys: np.ndarray, sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, values[at], 0.0)


def features(block: T.Block, words: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per document."""
    d, edge = block.data, block.offsets
    starts, ends, keys, first = _tokens(block)
    count = np.diff(first)
    per = np.maximum(count, 1)
    weight = _lookup(keys, words, odds)
    for long, stem in _stems(block, starts, ends):
        weight[long] = np.maximum(weight[long], _lookup(stem, words, odds))
    hit = weight > 0
    second = _lookup(keys, SECOND_KEYS, np.ones(len(SECOND_KEYS))) > 0
    owner = np.repeat(np.arange(block.docs), count)
    around = np.zeros(len(keys), bool)
    for k in range(1, NEAR + 1):
        if len(keys) > k:
            same = owner[k:] == owner[:-k]
            around[k:] |= second[:-k] & same
            around[:-k] |= second[k:] & same
    near = hit & around
    most = np.zeros(block.docs)
    np.maximum.at(most, owner[hit], weight[hit])
    upper = np.concatenate([[0], np.cumsum(UPPER[d])])
    length = ends - starts
    shout = (upper[ends] - upper[starts] == length) & (length >= 2)
    ms, me = T.runs(d, edge, WORDY[d] | MARK[d])
    odd = np.concatenate([[0], np.cumsum(DIGIT[d] | MARK[d])])
    letters = np.concatenate([[0], np.cumsum(LETTER[d])])
    inner = (odd[me - 1] - odd[np.minimum(ms + 1, me - 1)] > 0) & (letters[me] - letters[ms] >= 2) if len(ms) else np.zeros(0, bool)
    ms, me = ms[inner], me[inner]
    masked_doc = np.searchsorted(edge, ms, "right") - 1
    masked = _lookup(T.hash_spans(d, ms, me, T.CODES[PLAIN]), words, odds) > 0
    chars = np.maximum(np.diff(edge), 1)
    total = lambda flag: T.sums(flag.astype(np.int64), first)
    byte = lambda table: T.sums(table[d].astype(np.int64), edge)
    masked_hits = np.bincount(masked_doc[masked], minlength=block.docs)
    return np.stack([
        np.log1p(count), total(hit) / per, T.sums(weight, first) / per, np.log1p(total(hit)), most, total(second) / per, total(near) / per,
        np.log1p(total(near)), byte(UPPER) / np.maximum(byte(LETTER), 1), total(shout) / per, byte(_flags(b"!")) / chars,
        byte(_flags(b"?")) / chars, byte(POINT) / chars, np.bincount(masked_doc, minlength=block.docs) / per, np.log1p(masked_hits),
        np.log1p(total(hit & shout)), byte(DIGIT) / chars], axis=1)


def _grow(x: np.ndarray, cuts: list[np.ndarray], y: np.ndarray) -> tuple[tuple, float]:
    """Boosted trees of fixed depth: each is (feature, cut) per inner node and a value per leaf."""
    codes = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    raw, trees = np.full(len(y), bias), []
    n_features = x.shape[1]
    flat = codes + np.arange(n_features) * BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            base, width = 2**level - 1, n_features * BINS
            at = ((node - base)[:, None] * width + flat).ravel()
            hist = [np.bincount(at, weights=np.repeat(v, n_features), minlength=2**level * width).reshape(2**level, n_features, BINS).cumsum(2)
                    for v in (g, h, np.ones(len(y)))]
            (gl, hl, nl), (gt, ht, nt) = hist, (v[:, :, -1:] for v in hist)
            gain = gl**2 / (hl + SHRINK) + (gt - gl)**2 / (ht - hl + SHRINK) - gt**2 / (ht + SHRINK)
            gain = np.where((nl >= LEAF) & (nt - nl >= LEAF), gain, 0)
            flat_gain = gain.reshape(2**level, -1)
            best = flat_gain.argmax(1)
            for k in range(2**level):
                j, b = divmod(int(best[k]), BINS)
                if flat_gain[k, best[k]] > 1e-9 and b < len(cuts[j]):
                    feature[base + k], cut[base + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (2**DEPTH - 1)
        value = -RATE * np.bincount(leaf, weights=g, minlength=2**DEPTH) / (np.bincount(leaf, weights=h, minlength=2**DEPTH) + SHRINK)
        raw = raw + value[leaf]
        trees.append((feature, cut, value))
    return tuple(trees), bias


def raw_scores(x: np.ndarray, model: ToxicityModel) -> np.ndarray:
    raw, rows = np.full(len(x), model.bias), np.arange(len(x))
    for feature, cut, value in model.trees:
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        raw += value[node - (2**DEPTH - 1)]
    return raw


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the pooled-adjacent-violators fit: mean raw score and mean label of each pool."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for r, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        pools.append([r, v, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            r2, v2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + r2, pools[-1][1] + v2, pools[-1][2] + n2]
    n = np.array([p[2] for p in pools])
    return np.array([p[0] for p in pools]) / n, np.array([(p[1] + 0.5 * 1e-3) / (p[2] + 1e-3) for p in pools])


def probabilities(x: np.ndarray, model: ToxicityModel) -> np.ndarray:
    if not model.trees:
        return np.full(len(x), model.share)
    return np.clip(np.interp(raw_scores(x, model), *model.knots), 0.0, 1.0)


def _document_words(batches):
    for batch in batches:
        y = np.asarray(batch.column("y"))
        for block in T.blocks(batch.column("t")):
            starts, ends, keys, first = _tokens(block)
            owner = np.repeat(np.arange(block.docs), np.diff(first))
            stems = list(_stems(block, starts, ends))
            owner = np.concatenate([owner, *(owner[long] for long, _ in stems)])
            keys = np.concatenate([keys, *(stem for _, stem in stems)])
            order = np.argsort(owner, kind="stable")
            edge = np.searchsorted(owner[order], np.arange(block.docs + 1))
            for i in range(block.docs):
                own = np.unique(keys[order[edge[i]:edge[i + 1]]])
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(T.signed(own)), pa.array(np.full(len(own), y[block.lo + i], np.int64))], ["word", "y"])


def _featurise(words: np.ndarray, odds: np.ndarray):
    def run(batches):
        for batch in batches:
            for block in T.blocks(batch.column("t")):
                x = features(block, words, odds)
                at = slice(block.lo, block.hi)
                yield pa.RecordBatch.from_arrays([batch.column("y")[at.start:at.stop], batch.column("part")[at.start:at.stop],
                                                  pa.array(x.tolist(), pa.list_(pa.float64()))], ["y", "part", "x"])
    return run


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, key: str = "doc_id", text: str = "text", label: str = "toxic",
        sample: int = 20_000) -> ToxicityModel:
    """Learn from the labelled rows for whose key (column ``key`` of labels) ``train`` holds."""
    spark = docs.sparkSession
    marked = (labels.where(train).select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
              .groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("k", "y"))
    chosen = marked.orderBy(F.xxhash64("k"), "k").limit(sample).withColumn("part", F.pmod(F.xxhash64("k", F.lit(1)), F.lit(5)).cast("int")).collect()
    y = np.array([r["y"] for r in chosen])
    if not len(y) or y.min() == y.max():
        return ToxicityModel(float(y.mean()) if len(y) else 0.0)
    wanted = F.broadcast(spark.createDataFrame([tuple(r) for r in chosen], "k long, y int, part int"))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(wanted, "k")
    share = float(y.mean())
    counted = (rows.where("part in (0, 1)").select("t", "y").mapInArrow(_document_words, "word long, y long").groupBy("word")
               .agg(F.sum("y").alias("bad"), F.count("*").alias("n")))
    sizes = rows.where("part in (0, 1)").agg(F.sum("y"), F.count("*")).first()
    bad, n = (x or 0 for x in sizes)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / (n - bad + 1.0))
    lexicon = (counted.where(F.col("bad") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
               .orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "word").limit(LEXICON).select("word", "odds").collect())
    words = np.array([r[0] for r in lexicon], np.int64).view(np.uint64)
    order = np.argsort(words)
    words, weights = words[order], np.array([r[1] for r in lexicon])[order] if len(lexicon) else np.zeros(0)
    got = rows.where("part > 1").select("t", "y", "part").mapInArrow(_featurise(words, weights), "y int, part int, x array<double>").collect()
    x, yy, part = (np.array([r[c] for r in got]) for c in ("x", "y", "part"))
    grow, held = (part < 4, part == 4) if len(got) else (np.zeros(0, bool),) * 2
    if len(got) < 20 or len(set(yy[grow])) < 2 or len(set(yy[held])) < 2:
        return ToxicityModel(share)
    cuts = [np.unique(np.quantile(x[grow, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    trees, bias = _grow(x[grow], cuts, yy[grow].astype(float))
    model = ToxicityModel(share, words, weights, trees, bias)
    return ToxicityModel(share, words, weights, trees, bias, isotonic(raw_scores(x[held], model), yy[held].astype(float)))


def _score(model: ToxicityModel):
    def run(batches):
        for batch in batches:
            for block in T.blocks(batch.column("t")):
                p = probabilities(features(block, model.words, model.odds), model)
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(block.lo, block.docs), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                                 ["k", "score", "predicted"])
    return run


def score(docs: DataFrame, model: ToxicityModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score and predicted of every text."""
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(_score(model), f"k {kind}, score double, predicted int").withColumnRenamed("k", key)
