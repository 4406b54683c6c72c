"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Method. Every line with a word is good or bad. Its log-odds of being good are a sum of weights, one per feature bin of the
line itself, of the line before and of the line after (``FEATURES``), and of the document's length; neighbouring labels
are tied by a 2 x 2 table. Forward-backward gives each line's marginal, and the mean of the marginals, weighted by
the lines' lengths in characters, is the document's raw quality. A logistic curve fitted on labelled documents that the field was not fitted
on turns it into the score.

Learning. Only documents are labelled. A line first has its document's label; once fitted, the lines of a bad document
that the field finds good are relabelled (not all of them: the worst stays bad), and the field is fitted again. Fitting is gradient
ascent on the penalised log-likelihood, all documents at once. It uses the ``sample`` (6,000) labelled training documents that
come first by a hash of their key, a fifth of them for the curve; every document is scored whole, in its own task.

Results. ``score``: key, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= ``least``, else 0). Only the text
is an input of a score.

Edge cases. A null, empty or wordless text has no line: its score is the smoothed share of good ones among such training
texts. Lines without a word are passed over. Null labels, null keys and keys labelled both ways are not learned
from. With labels of one kind only, or none, the score is that kind's share (1 without labels). Repeated rows are scored alike.
Empty tables give empty results. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faceoff.llm import text as T

FEATURES = ("words", "word_bytes", "capitals", "symbols", "points", "exclaims", "digits", "bare_marks", "repeats", "distinct", "short",
            "capital_words", "sentence", "closed", "earlier_line")
BINS = 10
STEPS, RATE, PENALTY = 150, 0.15, 2e-3
LEAST_DOCUMENTS = 40


def _table(values) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(values)] = 1
    return out


UPPER, LETTER, DIGIT = _table(range(65, 91)), _table([*range(65, 91), *range(97, 123), *range(128, 256)]), _table(range(48, 58))
SYMBOL, POINT, BANG, STOP = _table(b"#*$%&|<>{}\\^~=+_@"), _table(b".,;:'\"()-?/[]"), _table(b"!"), _table(b".!?")


@dataclass
class Lines:
    """Lines with a word, in order: their features, length, and the first line of each document (with an end)."""

    x: np.ndarray
    size: np.ndarray
    first: np.ndarray
    words: np.ndarray


def lines(block: T.Block) -> Lines:
    d, edge = block.data, block.offsets
    newline = np.flatnonzero(d == 10)
    doc = np.concatenate([np.arange(block.docs), np.searchsorted(edge, newline, "right") - 1])
    start = np.concatenate([edge[:-1], newline + 1])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    end = np.where(np.append(doc[1:] == doc[:-1], False), np.append(start[1:], 0) - 1, edge[1:][doc])
    w = T.words(block)
    of = np.searchsorted(start, w.starts, "right") - 1
    keep, of = np.unique(of, return_inverse=True)
    start, end, doc = start[keep], end[keep], doc[keep]
    first = np.searchsorted(doc, np.arange(block.docs + 1))
    n = len(keep)
    if not n:
        return Lines(np.zeros((0, len(FEATURES))), np.zeros(0), first, np.zeros(block.docs))

    def count(table: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[d])])
        return total[z] - total[a]

    per = np.bincount(of, minlength=n)
    length = w.ends - w.starts
    word_bytes = np.bincount(of, weights=length, minlength=n)
    share = lambda flag: np.bincount(of, weights=flag, minlength=n) / per
    letters = count(LETTER, w.starts, w.ends)
    again = np.zeros(len(of), bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (of[1:] == of[:-1])
    at = np.lexsort((w.hashes, of))
    new = np.ones(len(of), bool)
    new[1:] = (w.hashes[at][1:] != w.hashes[at][:-1]) | (of[at][1:] != of[at][:-1])
    whole = T.hash_spans(d, start, end)
    seen = np.lexsort((np.arange(n), whole, doc))
    earlier = np.zeros(n, bool)
    earlier[seen[1:]] = (whole[seen][1:] == whole[seen][:-1]) & (doc[seen][1:] == doc[seen][:-1])
    last = np.append(np.flatnonzero(of[1:] != of[:-1]), len(of) - 1)
    chars = np.maximum(end - start, 1)
    line = lambda table: count(table, start, end) / chars
    x = np.stack([
        np.log2(per), word_bytes / per, count(UPPER, start, end) / np.maximum(count(LETTER, start, end), 1), line(SYMBOL), line(POINT), line(BANG),
        line(DIGIT), share(letters == 0), share(again), np.bincount(of[at], weights=new, minlength=n) / per, share(length <= 3),
        share((count(UPPER, w.starts, w.ends) == letters) & (letters > 1)), per / (count(STOP, start, end) + 1.0),
        STOP[d[w.ends[last] - 1]].astype(float), earlier.astype(float)], axis=1)
    return Lines(x, chars.astype(float), first, np.bincount(doc, weights=per, minlength=block.docs))


@dataclass(frozen=True)
class LineField:
    """Weights of the field and its curve; ``share`` alone where there was nothing to fit."""

    share: float
    bare: float = 0.5
    cuts: tuple = ()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ties: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: tuple = (1.0, 0.0)


def codes(own: Lines, cuts: tuple) -> np.ndarray:
    """Which weights each line adds up: the bins of itself, of the line before and after, and of the document's words."""
    n, width = own.x.shape
    count = np.diff(own.first)
    base = np.stack([np.searchsorted(c, own.x[:, j], "right") for j, c in enumerate(cuts[:-1])], axis=1).reshape(n, width)
    place = np.arange(n) - np.repeat(own.first[:-1], count)
    left = np.repeat(count, count) - 1 - place
    none = np.full((1, width), BINS)
    before = np.where((place > 0)[:, None], np.concatenate([none, base[:-1]]) if n else base, BINS)
    after = np.where((left > 0)[:, None], np.concatenate([base[1:], none]) if n else base, BINS)
    document = np.repeat(np.searchsorted(cuts[-1], np.log2(np.maximum(own.words, 1)), "right"), count)
    every = np.concatenate([base, before, after, document[:, None]], axis=1)
    return every + np.arange(every.shape[1]) * (BINS + 1)


def marginals(odds: np.ndarray, first: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each line is good, and the expected number of each pair of neighbouring labels.

    Documents go side by side, one line of each at a time, longest first, so that those with a line left stand in front.
    """
    n, count = len(odds), np.diff(first)
    order = np.argsort(-count, kind="stable")
    start, count = first[:-1][order], count[order]
    top = int(count[0]) if len(count) else 0
    live = np.searchsorted(-count, -np.arange(top), "left")
    here = np.empty((n, 2))
    least = np.minimum(odds, 0)
    here[:, 0], here[:, 1] = np.exp(least - odds), np.exp(least)     # bad, good; the larger is 1
    step = np.exp(ties - ties.max())
    ahead, back = np.empty((n, 2)), np.ones((n, 2))
    for t in range(top):
        at = start[:live[t]] + t
        a = here[at] if t == 0 else (ahead[at - 1] @ step) * here[at]
        ahead[at] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(top - 2, -1, -1):
        at = start[:live[t + 1]] + t
        onward = here[at + 1] * back[at + 1]
        joint = ahead[at][:, :, None] * step * onward[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        b = onward @ step.T
        back[at] = b / b.sum(1, keepdims=True)
    p = ahead * back
    return p[:, 1] / p.sum(1), pairs


def fit_field(code: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ties that maximise the penalised log-likelihood of the line labels."""
    size = int(code.shape[1] * (BINS + 1))
    n = max(len(y), 1)
    inner = np.ones(n, bool)
    inner[first[:-1][np.diff(first) > 0]] = False                 # not the first line of a document
    good = y.astype(np.int64)
    had = np.bincount(2 * good[:-1][inner[1:]] + good[1:][inner[1:]], minlength=4).reshape(2, 2)
    values = np.zeros(size + 4)
    mean, spread = np.zeros(size + 4), np.zeros(size + 4)
    flat = code.ravel()
    for k in range(1, steps + 1):
        p, pairs = marginals(values[code].sum(1), first, values[size:].reshape(2, 2))
        slope = np.bincount(flat, weights=np.repeat(y - p, code.shape[1]), minlength=size)
        grad = np.concatenate([slope, (had - pairs).ravel()]) / n - PENALTY * values / np.sqrt(n)
        mean, spread = 0.9 * mean + 0.1 * grad, 0.99 * spread + 0.01 * grad**2
        values = values + RATE * (mean / (1 - 0.9**k)) / (np.sqrt(spread / (1 - 0.99**k)) + 1e-8)
    return values[:size], values[size:].reshape(2, 2)


def weighted(p: np.ndarray, own: Lines) -> np.ndarray:
    """The length-weighted mean of the marginals of each document; documents without lines have nan."""
    doc = np.repeat(np.arange(len(own.first) - 1), np.diff(own.first))
    top = np.bincount(doc, weights=p * own.size, minlength=len(own.first) - 1)
    under = np.bincount(doc, weights=own.size, minlength=len(own.first) - 1)
    return np.divide(top, under, out=np.full(len(top), np.nan), where=under > 0)


def raw_quality(own: Lines, model: LineField) -> np.ndarray:
    p, _ = marginals(model.weights[codes(own, model.cuts)].sum(1), own.first, model.ties)
    return weighted(p, own)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_curve(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and offset of a logistic curve over the log-odds of the raw quality: Newton steps, lightly penalised."""
    z = np.stack([_logit(raw), np.ones(len(raw))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        grad = z.T @ (y - p) - 1e-2 * (w - [1.0, 0.0])
        w = w + np.clip(np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), grad), -1, 1)
    return max(float(w[0]), 1e-3), float(w[1])


def probabilities(own: Lines, model: LineField) -> np.ndarray:
    if not len(model.weights):
        return np.full(len(own.first) - 1, model.share)
    raw = raw_quality(own, model)
    a, b = model.curve
    p = 1 / (1 + np.exp(-np.clip(a * _logit(np.nan_to_num(raw, nan=0.5)) + b, -35, 35)))
    return np.where(np.isnan(raw), model.bare, p)


def _measure(batches):
    for batch in batches:
        y, part = np.asarray(batch.column("y")), np.asarray(batch.column("part"))
        for block in T.blocks(batch.column("t")):
            own = lines(block)
            for i in range(block.docs):
                a, z = own.first[i], own.first[i + 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(y[block.lo + i:block.lo + i + 1]), pa.array(part[block.lo + i:block.lo + i + 1]), pa.array([own.words[i]]),
                     pa.array([own.size[a:z].tolist()], pa.list_(pa.float64())), pa.array([own.x[a:z].ravel().tolist()], pa.list_(pa.float64()))],
                    ["y", "part", "words", "size", "x"])


def _stack(rows) -> tuple[Lines, np.ndarray]:
    size = [np.array(r["size"]) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(s) for s in size])]).astype(np.int64)
    x = np.concatenate([np.array(r["x"]) for r in rows] or [np.zeros(0)]).reshape(-1, len(FEATURES))
    return (Lines(x, np.concatenate(size or [np.zeros(0)]), first, np.array([r["words"] for r in rows])), np.array([r["y"] for r in rows], float))


def _learn(grown: tuple[Lines, np.ndarray], held: tuple[Lines, np.ndarray], share: float, bare: float) -> LineField:
    own, y = grown
    at = np.linspace(0, 1, BINS + 1)[1:-1]
    cuts = tuple(np.unique(np.quantile(own.x[:, j], at)) for j in range(own.x.shape[1])) + (np.unique(np.quantile(np.log2(np.maximum(own.words, 1)), at)),)
    code = codes(own, cuts)
    doc = np.repeat(np.arange(len(y)), np.diff(own.first))
    label = y[doc]
    weights, ties = fit_field(code, own.first, label)
    p, _ = marginals(weights[code].sum(1), own.first, ties)
    worst = np.full(len(y), np.inf)
    np.minimum.at(worst, doc, p)
    label = np.where((label == 0) & (p >= 0.5) & (p > worst[doc]), 1.0, label)
    weights, ties = fit_field(code, own.first, label)
    model = LineField(share, bare, cuts, weights, ties)
    raw = raw_quality(held[0], model)
    some = ~np.isnan(raw)
    return LineField(share, bare, cuts, weights, ties, fit_curve(raw[some], held[1][some]))


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, key: str = "doc_id", text: str = "text", label: str = "quality",
        sample: int = 6_000) -> LineField:
    """Learn from the labelled rows for whose key (column ``key`` of labels) ``train`` holds."""
    spark = docs.sparkSession
    marked = (labels.where(train).select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
              .groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("k", "y"))
    chosen = marked.orderBy(F.xxhash64("k", F.lit(13)), "k").limit(sample).withColumn("part", F.pmod(F.xxhash64("k", F.lit(2)), F.lit(5)).cast("int")).collect()
    y = np.array([r["y"] for r in chosen])
    if not len(y) or y.min() == y.max():
        return LineField(float(y.mean()) if len(y) else 1.0)
    wanted = F.broadcast(spark.createDataFrame([tuple(r) for r in chosen], "k long, y int, part int"))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(wanted, "k")
    got = rows.select("t", "y", "part").mapInArrow(_measure, "y int, part int, words double, size array<double>, x array<double>").collect()
    got.sort(key=lambda r: (r["part"], r["y"], r["words"], r["x"]))
    bare = [r["y"] for r in got if not r["size"]]
    share = float(y.mean())
    grown, held = _stack([r for r in got if r["part"] < 4 and r["size"]]), _stack([r for r in got if r["part"] == 4 and r["size"]])
    prior = (sum(bare) + share) / (len(bare) + 1)
    if len(grown[1]) < LEAST_DOCUMENTS or len(set(grown[1])) < 2 or len(set(held[1])) < 2:
        return LineField(share, prior)
    return _learn(grown, held, share, prior)


def _score(model: LineField, least: float):
    def run(batches):
        for batch in batches:
            for block in T.blocks(batch.column("t")):
                p = probabilities(lines(block), model)
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(block.lo, block.docs), pa.array(p), pa.array((p >= least).astype(np.int32))],
                                                 ["k", "score", "predicted"])
    return run


def score(docs: DataFrame, model: LineField, *, key: str = "doc_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """key, score and predicted of every text."""
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(_score(model, least), f"k {kind}, score double, predicted int").withColumnRenamed("k", key)
