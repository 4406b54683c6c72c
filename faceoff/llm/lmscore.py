"""LM scoring with a weighted backoff automaton made of smoothed n-gram counts.

Model. States are histories of up to ``order`` - 1 tokens that occur in the training texts, and the empty one.
An arc of state u for token w has log10((c(u w) + K p(w | shorter u)) / (c(u) + K)); a token without an arc takes
the failure arc, log10(K / (c(u) + K)), to the state of the shorter history, down to the empty one, where every
token has its add-one probability (c(w) + 1) / (N + V + 1), unseen tokens as one class. Each state's arcs and
failure sum to one. A text is one traversal from its start: the state is carried along, the log-probabilities of
arcs and failures add up; a token leads to the longest history that is a state. Tokens are words (A-Z lower-cased)
and one end.

Every block of texts builds the part of the automaton that its texts can reach: the weights and targets of its n-grams' arcs and of its
states' failure arcs. An arc of a state is addressed by the number of the n-gram it completes. Texts are cut into stretches of ``STRETCH``
tokens that are walked side by side; a stretch inside a text first reads the ``order`` - 1 tokens before it, after which its
state is that of the walk through the whole text.

Scale. Counts are over all training texts and grow with them, so no task holds the model. Texts are dealt into
blocks of about ``BLOCK_TEXT`` bytes. A block asks for the counts of its distinct n-grams and brings its own
training counts; requests are partitioned by n-gram hash and summed (a word that is a third of all tokens is one
number per block), and a block gets back those that other blocks also count: the part of the automaton that its
texts can reach. Blocks and partitions keep their size while their number grows with the corpus. Requests are sorted
hashes, sent as differences; answers are counts in the order of the request. N, V and the number of training texts are three numbers.

Results. ``score``: key, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (the model).

Edge cases. Null or empty text: the end token alone. No training text: every token is unseen, N and V are 0.
Repeated rows count and are scored each. A null key is a row like others (``train`` decides on it). Empty tables
give empty results. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faceoff.llm import text as T
from faceoff.llm.packed import pack, pack_sorted, unpack, unpack_sorted

BLOCK_TEXT = 10 << 20
LEAST_BLOCKS = 48
PART_GRAMS = 4_000_000
HOLD = 2_000_000
STRETCH = 256
#: N-grams of two tokens and more have 56 bits, which a byte less carries; words have 64.
GRAM_BITS = np.uint64(2**64 - 256)
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
#: Weight K of the shorter history's probability, in counts, for histories of one token, two tokens, and so on (the last holds beyond).
WEIGHTS = (300.0, 30.0)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a column's texts in a row, an end after each text, and where each text begins."""
    parts, counts = [], []
    for block in T.blocks(column):
        w = T.words(block, lower=True)
        own = np.full(len(w.hashes) + block.docs, END, np.uint64)
        place = np.arange(len(w.hashes)) + np.repeat(np.arange(block.docs), w.counts)
        own[place] = w.hashes
        parts.append(own)
        counts.append(w.counts + 1)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def histories(token: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n from 1 to ``order``: hash of the n-gram that ends at each token, and whether there is one.

    A text begins with one start mark, which can be the oldest token of an n-gram.
    """
    place = np.arange(len(token)) - np.repeat(first[:-1], np.diff(first))
    before = np.empty(len(token), np.uint64)
    before[1:] = token[:-1]
    before[first[:-1]] = START
    out = [(T.mix(token ^ np.uint64(0x11)), np.ones(len(token), bool))]
    for n in range(2, order + 1):
        older, has = out[-1]
        context = np.empty(len(token), np.uint64)
        context[1:] = older[:-1]
        if n == 2:
            context = T.mix(before ^ np.uint64(0x11))
            ok = np.ones(len(token), bool)
        else:
            ok = place >= n - 2
            context[first[:-1]] = 0
        out.append((T.mix(context * np.uint64(0x9E3779B97F4A7C15) + token + np.uint64(n)) & GRAM_BITS, ok))
    return out


def _vocabulary(parts: int):
    """(part, keys, counts) of the training words of a task."""
    width = np.uint64(2**64 // parts + 1)

    def flush(keys, counts):
        rows = _by_part(keys, counts, width)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)],
                                          ["part", "keys", "counts"])

    def run(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            new, n = np.unique(tokens(batch.column("t"))[0], return_counts=True)
            keys, counts = _sum(np.concatenate([keys, new]), np.concatenate([counts, n]))
            if len(keys) > HOLD:
                yield flush(keys, counts)
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield flush(keys, counts)
    return run


def _sum(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first)


def _by_part(keys: np.ndarray, counts: np.ndarray, width: np.uint64) -> list[tuple[int, bytes, bytes]]:
    """Sorted keys and their counts, packed for each part that occurs."""
    part, start = np.unique(keys // width, return_index=True)
    edge = np.append(start, len(keys))
    return [(p, pack_sorted(keys[a:z]), pack(counts[a:z])) for p, a, z in zip(part.tolist(), edge, edge[1:], strict=False)]


def _size(table: pa.Table) -> pa.Table:
    keys = np.concatenate([unpack_sorted(x) for x in table.column("keys").to_pylist()])
    counts = np.concatenate([unpack(x, np.int64) for x in table.column("counts").to_pylist()])
    return pa.table({"v": [int(len(np.unique(keys)))], "n": [int(counts.sum())]})


def _own_counts(column: pa.Array, train: np.ndarray, order: int):
    """Distinct n-grams of a block with its training counts, and where each n-gram occurrence is among them."""
    token, first = tokens(column)
    grams = histories(token, first, order)
    every = np.concatenate([g[ok] for g, ok in grams])
    order_ = np.argsort(every)
    every = every[order_]
    fresh = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, bool)
    where = np.empty(len(every), np.int32)
    where[order_] = np.cumsum(fresh, dtype=np.int32) - 1
    keys = every[fresh]
    del every, order_, fresh
    learned = np.repeat(train, np.diff(first))
    counts = np.bincount(where[np.concatenate([learned[ok] for _, ok in grams])], minlength=len(keys))
    return token, first, grams, keys, counts, where


def _request(order: int, parts: int):
    width = np.uint64(2**64 // parts + 1)

    def run(table: pa.Table) -> pa.Table:
        *_, keys, counts, _ = _own_counts(table.column("t").combine_chunks(), np.asarray(table.column("train")), order)
        rows = _by_part(keys, counts, width)
        block = table.column("block")[0].as_py()
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int64()),
                         "keys": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})
    return run


def _answer(table: pa.Table) -> pa.Table:
    """To each block: the totals of its n-grams in their order, where other blocks count any of them too."""
    keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    counts = [unpack(x, np.int64) for x in table.column("counts").to_pylist()]
    every, total = _sum(np.concatenate([k[c > 0] for k, c in zip(keys, counts, strict=True)]),
                        np.concatenate([c[c > 0] for c in counts]))
    rows = []
    for block, part, k, c in zip(table.column("block").to_pylist(), table.column("part").to_pylist(), keys, counts, strict=True):
        if not len(every):
            break
        at = np.minimum(np.searchsorted(every, k), len(every) - 1)
        sum_ = np.where(every[at] == k, total[at], 0)
        if (sum_ != c).any():
            rows.append((block, part, pack(sum_)))
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "part": pa.array([r[1] for r in rows], pa.int32()),
                     "counts": pa.array([r[2] for r in rows], pa.binary())})


class Automaton:
    """States, arcs and failure arcs over a block's distinct n-grams; an n-gram's number is also its state's.

    ``number[m - 1]`` has the number of the m-gram that ends at each token. Arcs: probability, target, and whether there is one; states:
    failure weight, failure target, depth (tokens of history).
    """

    def __init__(self, first: np.ndarray, number: list[np.ndarray], counts: np.ndarray, n_train: int, vocabulary: int, texts: int, weights: tuple[float, ...]) -> None:
        n, order = len(counts), len(number)
        self.root, self.start, self.number, self.first = n, n + 1, number, first
        at, size = np.zeros(n, np.int64), np.zeros(n, np.int64)      # where an n-gram ends once, and its tokens
        for m, own in enumerate(number, 1):
            here = np.flatnonzero(own >= 0)
            at[own[here]], size[own[here]] = here, m
        begins = np.zeros(len(number[0]) + 1, bool)
        begins[first] = True
        known = np.concatenate([counts, [0, texts]])
        self.depth = np.concatenate([size, [0, 1]])
        by_depth = np.array([weights[min(max(d - 1, 0), len(weights) - 1)] for d in range(order + 1)])
        self.arc = np.concatenate([(counts > 0) | (size == 1), [False, False]])
        shorter, p, self.next = np.full(n + 2, self.root), np.zeros(n + 2), np.full(n + 2, self.root)
        for m in range(1, order + 1):
            own = np.flatnonzero(size == m)
            end = at[own]
            if m == 1:
                p[own] = (counts[own] + 1) / (n_train + vocabulary + 1)
            else:
                shorter[own] = number[m - 2][end]
                before = number[m - 2][np.maximum(end - 1, 0)]
                history = np.where(begins[end], self.start, before) if m == 2 else before
                p[own] = (counts[own] + by_depth[m - 1] * p[shorter[own]]) / (known[history] + by_depth[m - 1])
            self.next[own] = np.where(counts[own] > 0, own if m < order else shorter[own], self.root)
        weight = by_depth[self.depth]
        self.fail, self.fail_weight = shorter, np.log10(weight / (known + weight))
        with np.errstate(divide="ignore"):
            self.arc_weight = np.log10(p)

    def walk(self) -> np.ndarray:
        """Log10 probability of every text: one traversal from left to right, all stretches at once."""
        order, lengths = len(self.number), np.diff(self.first)
        pieces = -(-lengths // STRETCH)
        text = np.repeat(np.arange(len(lengths)), pieces)
        inner = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
        begin = self.first[:-1][text] + inner
        warm = np.where(inner > 0, order - 1, 0)
        todo = np.minimum(STRETCH, lengths[text] - inner) + warm
        by_length = np.argsort(-todo, kind="stable")
        place, warm, todo = (begin - warm)[by_length], warm[by_length], todo[by_length]
        state = np.where(inner[by_length] > 0, self.root, self.start if order > 1 else self.root)
        total = np.zeros(len(text))
        grams = np.stack(self.number)
        live = len(text)
        for step in range(int(todo[0]) if len(todo) else 0):
            while todo[live - 1] <= step:
                live -= 1
            s, here = state[:live], place[:live] + step
            gain = np.zeros(live)
            gram = grams[self.depth[s], here]
            stuck = np.flatnonzero(~self.arc[gram])
            while len(stuck):                                     # failure arcs, down to where an arc leaves
                gain[stuck] += self.fail_weight[s[stuck]]
                s[stuck] = self.fail[s[stuck]]
                gram[stuck] = grams[self.depth[s[stuck]], here[stuck]]
                stuck = stuck[~self.arc[gram[stuck]]]
            gain += self.arc_weight[gram]
            total[:live] += np.where(step < warm[:live], 0.0, gain)
            state[:live] = self.next[gram]
        out = np.empty(len(text))
        out[by_length] = total
        return per_text(out, np.concatenate([[0], np.cumsum(pieces)]))


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each text's values; every text has one at least. A text's sum does not depend on its neighbours."""
    return np.add.reduceat(values, first[:-1]) if len(first) > 1 else np.zeros(0)


def _traverse(order: int, parts: int, n_train: int, vocabulary: int, texts: int, weights: tuple[float, ...]):
    width = np.uint64(2**64 // parts + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        _, first, grams, keys, counts, where = _own_counts(left.column("t").combine_chunks(), np.asarray(left.column("train")), order)
        part, start = np.unique(keys // width, return_index=True)
        edge = np.append(start, len(keys))
        for p, c in zip(right.column("part").to_pylist(), right.column("counts").to_pylist(), strict=True):
            at = int(np.searchsorted(part, p))
            counts[edge[at]:edge[at + 1]] = unpack(c, np.int64)
        lo, number = 0, []
        for _, ok in grams:
            own = np.full(len(ok), -1, np.int32)
            own[ok] = where[lo:lo + int(ok.sum())]
            lo += int(ok.sum())
            number.append(own)
        known = counts[number[0]]
        base = np.log10((known + 1) / (n_train + vocabulary + 1))
        walked = Automaton(first, number, counts, n_train, vocabulary, texts, weights).walk()
        return pa.table({"k": left.column("k"), "n_tokens": pa.array(np.diff(first)), "n_known": pa.array(T.sums((known > 0).astype(np.int64), first)),
                         "train_tokens": pa.array(np.full(len(first) - 1, n_train, np.int64)), "base_score": pa.array(per_text(base, first)),
                         "score": pa.array(walked)})
    return run


def score(docs: DataFrame, train: Column, *, key: str = "doc_id", text: str = "text", order: int = 3,
          weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Every row's scores under the model of the rows for which ``train`` holds."""
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    size, texts = rows.agg(F.sum(F.octet_length("t")), F.count_if("train")).first()
    size = size or 0
    blocks = max(LEAST_BLOCKS, -(-size // BLOCK_TEXT))
    parts = max(LEAST_BLOCKS, -(-size // (3 * PART_GRAMS)))
    found = rows.where("train").select("t").mapInArrow(_vocabulary(parts), "part int, keys binary, counts binary").groupBy("part").applyInArrow(
        _size, "v long, n long").agg(F.sum("v"), F.sum("n")).first()
    vocabulary, n_train = (x or 0 for x in found)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("k", "t"), F.lit(blocks)))
    asked = dealt.groupBy("block").applyInArrow(_request(order, parts), "part int, block long, keys binary, counts binary")
    answers = asked.groupBy("part").applyInArrow(_answer, "block long, part int, counts binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _traverse(order, parts, n_train, vocabulary, texts, weights),
        f"k {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("k", key)
