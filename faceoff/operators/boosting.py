"""Boosted trees for a binary label, grown from histograms that Spark aggregates.

Every tree level is one pass: (member, node, feature, bin) -> sums of gradient, curvature and rows. A pass is a single stage of at most
``TASKS`` tasks; each sends one histogram, whose size is members x nodes x features x bins whatever the number of rows, and the driver adds
them up and picks the splits; a leaf's value has an L2 penalty. Rows are binned once; those with the same bins and members have the same score in every
pass, so they are one cell with its rows and their labels added up. Cells are never more than rows, and where features have few bins or depend on each
other far fewer, the more so the more rows there are. They are stored in blocks, feature by feature, with their raw scores; the scores are brought up to
date in a stored table every ``REFRESH`` trees, so a pass never replays more than that.
Several models (members) over the same rows, such as those of folds, grow side by side in the same passes.

Null and NaN features are binned as the smallest value. Features are numbers in ``features``, the label is 0 or 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faceoff.session import write_and_reread

BINS = 255
#: Cells of a stored block, and trees after which the stored scores are brought up to date.
BLOCK, REFRESH = 65_536, 20
#: Most tasks of a pass, and so most histograms that the driver adds up.
TASKS = 64
BLOCKS = "x binary, rows binary, ones binary, member binary, raw binary, n int"


@dataclass
class BoostedTrees:
    """Cut points per feature, and trees as (feature, cut, value) arrays in heap order; a feature of -1 does not split."""

    cuts: list[np.ndarray]
    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values of bin numbers (feature, row); the start is not in it."""
        return added(self.trees, x)

    def transform(self, df: DataFrame, into: str = "p") -> DataFrame:
        """``df`` with the probability of label 1."""
        cuts, start, trees = self.cuts, self.start, self.trees

        @F.pandas_udf("double")
        def probability(features: pd.Series) -> pd.Series:
            model = BoostedTrees(cuts, start, trees)
            x = binned(np.stack(features.to_numpy()) if len(features) else np.zeros((0, len(cuts))), cuts)
            return pd.Series(1.0 / (1.0 + np.exp(-(start + model.raw(x)))))

        return df.withColumn(into, probability(vector_to_array("features")))


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of every value, (feature, row): how many cuts lie below it."""
    out = np.empty(x.shape[::-1], np.uint8)
    for j, c in enumerate(cuts):
        out[j] = np.searchsorted(c, np.nan_to_num(x[:, j].astype(float), nan=-np.inf, posinf=np.inf, neginf=-np.inf), "left")
    return out


def place_of(tree: tuple, x: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row reaches after ``depth`` levels, counted from the left of that level."""
    feature, cut, _ = tree
    node = np.zeros(x.shape[1], np.uint8 if depth <= 8 else np.uint32)
    for level in range(depth):
        right = np.zeros(x.shape[1], bool)
        for i in range(2**level):
            f = feature[2**level - 1 + i]
            if f >= 0:
                right |= (node == i) & (x[f] > int(cut[2**level - 1 + i]))      # a plain int keeps the comparison in bytes
        node = 2 * node + right
    return node


def added(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    """Sum of the trees' leaf values."""
    out = np.zeros(x.shape[1])
    for tree in trees:
        depth = int(np.log2(len(tree[0]) + 1))
        out += tree[2][2**depth - 1:].take(place_of(tree, x, depth))
    return out


def split(hist: np.ndarray, penalty: float, least: int) -> tuple[int, int, float]:
    """Best (feature, bin, gain) of a node's histogram (feature, bin, [gradient, curvature, rows]); feature -1 without a gain."""
    left = hist.cumsum(1)
    whole = left[:, -1:]
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + penalty)
    gain = np.where((left[..., 2] >= least) & (right[..., 2] >= least), score(left) + score(right) - score(whole), 0.0)
    j, b = divmod(int(gain.argmax()), gain.shape[1])
    return (j, b, float(gain[j, b])) if gain[j, b] > 1e-12 else (-1, 0, 0.0)


def _bins(cuts: list[np.ndarray]):
    """Rows as their bins (one byte a feature), members and label."""
    def run(batches):
        for batch in batches:
            if len(batch):
                flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
                x = np.ascontiguousarray(binned(flat.reshape(len(batch), -1), cuts).T)
                ends = np.arange(len(batch) + 1, dtype=np.int32) * np.int32(len(cuts))
                yield pa.RecordBatch.from_arrays([
                    pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends), pa.py_buffer(x)]),
                    batch.column("member"), batch.column("label")], ["x", "member", "label"])
    return run


def _kind(members: int) -> type:
    """The smallest of two types that has a bit per member."""
    return np.uint8 if members <= 8 else np.int64


def _store(width: int, members: int):
    """Cells in blocks: bins, rows, rows of label 1, a bit per member that learns from them, and a raw score per member."""
    def run(batches):
        held: list = []

        def flush():
            x, rows, ones, member = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_pydict({
                "x": [np.ascontiguousarray(x.T).tobytes()], "rows": [rows.tobytes()], "ones": [ones.tobytes()], "member": [member.astype(_kind(members)).tobytes()],
                "raw": [np.zeros((members, len(rows))).tobytes()], "n": pa.array([len(rows)], pa.int32())})

        for batch in batches:
            if len(batch):
                x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(len(batch), width)
                held.append((x, *(np.asarray(batch.column(c)) for c in ("rows", "ones", "member"))))
            if sum(len(h[1]) for h in held) >= BLOCK:
                yield flush()
        if held:
            yield flush()
    return run


def _unpack(batch: pa.RecordBatch, width: int, members: int):
    for i in range(len(batch)):
        n = batch.column("n")[i].as_py()
        get = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: E731, B023
        yield (get("x", np.uint8).reshape(width, n), get("rows", np.float64), get("ones", np.float64), get("member", _kind(members)),
               get("raw", np.float64).reshape(members, n))


def _histograms(width: int, starts: list[float], recent: list[list[tuple]], growing: list[tuple], level: int):
    """A task's histogram (member, node, feature, bin, [gradient, curvature, rows]) at a level of the trees that grow.

    ``recent`` are the trees, per member, that the stored scores lack.
    """
    members, nodes = len(starts), 2**level

    def run(batches):
        total = np.zeros((members, nodes, width, BINS + 1, 3))
        for batch in batches:
            for x, rows, ones, member, raw in _unpack(batch, width, members):
                for k in range(members):
                    mine = (member >> k & 1).astype(bool)
                    if mine.all():
                        mine = slice(None)
                    own, n = x[:, mine], rows[mine]
                    p = 1.0 / (1.0 + np.exp(-(starts[k] + raw[k, mine] + added(recent[k], own))))
                    g, h = n * p - ones[mine], n * p * (1 - p)
                    first = place_of(growing[k], own, level).astype(np.int64) * (BINS + 1)
                    for j in range(width):
                        at = first + own[j]
                        for s, v in enumerate((g, h, n)):
                            total[k, :, j, :, s] += np.bincount(at, v, nodes * (BINS + 1)).reshape(nodes, BINS + 1)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})
    return run


def _refresh(width: int, recent: list[list[tuple]]):
    def run(batches):
        for batch in batches:
            for x, rows, ones, member, raw in _unpack(batch, width, len(recent)):
                now = np.stack([raw[k] + added(trees, x) for k, trees in enumerate(recent)])
                yield pa.RecordBatch.from_pydict({"x": [x.tobytes()], "rows": [rows.tobytes()], "ones": [ones.tobytes()], "member": [member.tobytes()],
                                                  "raw": [now.tobytes()], "n": pa.array([len(rows)], pa.int32())})
    return run


def fit_members(train: DataFrame, members: int, rounds: int, depth: int, rate: float, penalty: float, least: int = 20,
                member: str | None = None) -> list[BoostedTrees]:
    """Boosted trees of every member; bit k of column ``member`` says whether member k learns from a row (all do without the column)."""
    v = vector_to_array("features")
    rows = train.select(v.alias("v"), F.col("label").cast("double").alias("label"), (F.col(member) if member else F.lit(2**members - 1)).cast("long").alias("member"))
    rows = write_and_reread(rows, "boosting-rows")
    first = rows.select(F.size("v").alias("n")).first()
    if first is None:
        raise ValueError("no rows to learn from")
    width = first["n"]
    probs = [i / (BINS + 1) for i in range(1, BINS + 1)]
    found = rows.agg(*[F.percentile_approx(F.nullif(F.get("v", F.lit(j)), F.lit(float("nan"))), probs, 10_000).alias(f"c{j}") for j in range(width)]).first()
    cuts = [np.unique(np.array(c if c is not None else [], float)) for c in found]
    shares = rows.agg(*[F.avg(F.when(F.col("member").bitwiseAND(1 << k) != 0, F.col("label"))).alias(f"s{k}") for k in range(members)]).first()
    models = [BoostedTrees(cuts, float(np.log(max(s or 0.0, 1e-12) / max(1 - (s or 0.0), 1e-12)))) for s in shares]
    cells = rows.mapInArrow(_bins(cuts), "x binary, member long, label double").groupBy("x", "member").agg(
        F.count("*").cast("double").alias("rows"), F.sum(F.col("label").cast("int").cast("double")).alias("ones"))
    state = write_and_reread(cells.mapInArrow(_store(width, members), BLOCKS), "boosting-blocks")
    tasks, since = min(train.sparkSession.sparkContext.defaultParallelism, TASKS), 0
    for _ in range(rounds):
        growing = [(np.full(2**depth - 1, -1), np.zeros(2**depth - 1, np.int64), np.zeros(2 ** (depth + 1) - 1)) for _ in models]
        for level in range(depth):
            sums = state.coalesce(tasks).mapInArrow(_histograms(width, [m.start for m in models], [m.trees[since:] for m in models], growing, level), "sums binary")
            hist = sum(np.frombuffer(r["sums"]) for r in sums.collect()).reshape(len(models), 2**level, width, BINS + 1, 3)
            for k, node in np.ndindex(len(models), 2**level):
                feature, cut, value = growing[k]
                here = 2**level - 1 + node
                j, b, _ = split(hist[k, node], penalty, least)
                feature[here], cut[here] = j, b
                side = hist[k, node, max(j, 0)]
                halves = (side[:b + 1].sum(0), side[b + 1:].sum(0)) if j >= 0 else (side.sum(0), np.zeros(3))
                for child, s in zip((2 * here + 1, 2 * here + 2), halves, strict=True):
                    value[child] = -rate * s[0] / (s[1] + penalty)
        for model, tree in zip(models, growing, strict=True):
            model.trees.append(tree)
        if len(models[0].trees) - since == REFRESH and len(models[0].trees) < rounds:
            state = write_and_reread(state.coalesce(tasks).mapInArrow(_refresh(width, [m.trees[since:] for m in models]), BLOCKS), "boosting-blocks")
            since = len(models[0].trees)
    return models
