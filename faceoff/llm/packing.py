"""Best-fit packing of documents into sequences of a fixed number of tokens.

Method (best-two-fit). Documents are token ids plus one end id. Longer ones are cut into full pieces and a
rest. Pieces are dealt by hash into shards of about ``SHARD`` pieces; each shard is packed on its own: a bin
is filled greedily with the largest unpacked piece that fits, until none fits. Then its smallest piece is
taken out, and if two unpacked pieces fill the expanded gap more tightly, they go in instead. Bins left with
more than ``LOOSE`` free tokens are opened again and their pieces are packed together in fewer shards, until
that saves no more; a shard's last bins thus cost nothing at scale.

Bounds. A shard is a few thousand lengths, whatever the input; the number of shards follows the number of
pieces. Only lengths are shuffled, never ids or texts.

Interface. ``token_pieces``: key, piece, start, length and the ids (unsigned 32-bit little-endian binary).
``pack``: any table with unique rows and a length, plus sequence_id and offset. ``sequences``: the packed ids.

Edge cases. Null or empty text: one piece with the end id alone. Repeated rows and repeated or null keys:
every row has its own pieces and places. Pieces longer than the capacity or shorter than 1 raise in ``pack``.
Empty tables give empty results. Extra columns of ``pack``'s input pass through; those of documents are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faceoff.llm import text as T
from faceoff.llm.fragments import TEXT, coder
from faceoff.llm.scratch import Scratch

CAPACITY = 4096
END = 1
SHARD = 2048
LOOSE = 8
ROUNDS = 6
#: A letter or digit, then one of these: the words of the tokenizer always part there.
POINTS = np.zeros(256, bool)
POINTS[list(b".,!?;:")] = True
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True


def _word_parts(block: T.Block) -> tuple[np.ndarray, np.ndarray]:
    """Words, parted before a point that follows a letter or digit: each can be encoded on its own."""
    d = block.data
    starts, ends = T.runs(d, block.offsets, ~T.SPACE[d])
    if not len(starts):
        return starts, ends
    inner = np.flatnonzero(ALNUM[d[:-1]] & POINTS[d[1:]]) + 1
    inner = inner[~np.isin(inner, starts)] if len(block.offsets) > 2 else inner
    return np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))


def _pieces(path: str, capacity: int, end: int):
    def run(batches):
        code = coder(path)
        for batch in batches:
            for block in T.blocks(batch.column("t"), TEXT):
                starts, ends = _word_parts(block)
                ids, size = code.encode(block.data, starts, ends)
                first = np.searchsorted(starts, block.offsets)
                edge = np.concatenate([[0], np.cumsum(size)])[first]
                row, piece, start, length, out = [], [], [], [], []
                for i in range(block.docs):
                    own = np.append(ids[edge[i]:edge[i + 1]], end).astype("<u4")
                    for p, a in enumerate(range(0, len(own), capacity)):
                        part = own[a:a + capacity]
                        row.append(block.lo + i)
                        piece.append(p)
                        start.append(a)
                        length.append(len(part))
                        out.append(part.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(out, pa.binary())], ["k", "piece", "start", "length", "ids"])
    return run


def token_pieces(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                 end: int = END) -> DataFrame:
    """The pieces of every document: key, piece, start, length, ids."""
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    out = rows.mapInArrow(_pieces(tokenizer, capacity, end), f"k {kind}, piece int, start long, length long, ids binary")
    return out.withColumnRenamed("k", key)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length, by best-two-fit."""
    order = np.argsort(-lengths, kind="stable")
    count = np.bincount(lengths, minlength=capacity + 1)
    #: largest length not over a gap that is unpacked: kept by walking down and halving the path
    below = np.where(count > 0, np.arange(capacity + 1), -1)
    below = np.maximum.accumulate(below)

    def largest(gap: int) -> int:
        at = int(below[gap])
        while at > 0 and count[at] == 0:
            at = int(below[at - 1])
        below[gap] = at
        return at

    bins: list[list[int]] = []
    left = len(lengths)
    while left:
        gap, own = capacity, []
        while (x := largest(gap)) > 0:
            own.append(x)
            count[x] -= 1
            gap -= x
        left -= len(own)
        if gap and left > 1 and own:
            least = own[-1]
            room = gap + least
            have = np.flatnonzero(count[:room])
            if len(have):
                other = np.searchsorted(have, room - have, "right") - 1
                other = np.minimum(other, np.arange(len(have)))         # the pair's smaller one
                single = (other == np.arange(len(have))) & (count[have] < 2)
                other = np.where(single, other - 1, other)
                total = np.where(other >= 0, have + have[np.maximum(other, 0)], 0)
                best = int(np.argmax(total))
                if least < total[best] <= room:
                    own[-1:] = [int(have[best]), int(have[other[best]])]
                    count[own[-1]] -= 1
                    count[own[-2]] -= 1
                    count[least] += 1
                    left -= 1
                    below = np.maximum.accumulate(np.where(count > 0, np.arange(capacity + 1), -1))
        bins.append(own)
    # lengths back to rows: rows of one length are alike
    place = np.concatenate([np.array(b) for b in bins]) if bins else np.zeros(0, np.int64)
    number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    offset = np.concatenate([np.cumsum(b) - b for b in bins]) if bins else np.zeros(0, np.int64)
    back = np.argsort(-place, kind="stable")
    out_bin, out_offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    out_bin[order], out_offset[order] = number[back], offset[back]
    return out_bin, out_offset


def _pack_shard(capacity: int, step: int):
    def run(shard: pa.Table) -> pa.Table:
        lengths = shard.column("_length").to_numpy()
        number, offset = best_two_fit(lengths, capacity)
        fill = np.bincount(number, weights=lengths).astype(np.int64)
        base = (step << 58) + (int(shard.column("_shard")[0].as_py()) << 24)
        return pa.table({"_row": shard.column("_row"), "_length": shard.column("_length"), "sequence_id": number + base,
                         "offset": offset, "_free": capacity - fill[number]})
    return run


def pack(pieces: DataFrame, *, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; offsets of a sequence are gapless from 0."""
    scratch = Scratch(pieces.sparkSession, "packing")
    stored = scratch.keep(pieces.withColumn("_row", F.monotonically_increasing_id()))
    todo = stored.select("_row", F.col(length).cast("long").alias("_length"))
    n, least, most = todo.agg(F.count("*"), F.min("_length"), F.max("_length")).first()
    if n and (least is None or least < 1 or most > capacity):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    placed, before = None, None
    for step in range(ROUNDS):
        shards = max(1, -(-n // SHARD))
        out = scratch.keep(todo.withColumn("_shard", F.pmod(F.xxhash64("_row", F.lit(step)), F.lit(shards)))
                           .groupBy("_shard").applyInArrow(_pack_shard(capacity, step), "_row long, _length long, sequence_id long, offset long, _free long"))
        loose = out.where(F.col("_free") > LOOSE)
        count, bins = loose.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        # opened again while that can still save a sequence
        if step == ROUNDS - 1 or bins <= 1 or bins == before or shards == 1:
            placed = out if placed is None else placed.union(out)
            break
        tight = out.where(F.col("_free") <= LOOSE)
        placed = tight if placed is None else placed.union(tight)
        todo, n, before = loose.select("_row", "_length"), count, bins
    return stored.join(placed.select("_row", "sequence_id", "offset"), "_row").drop("_row")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of its pieces in order; at most ``capacity`` ids, so a group is small."""
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p.ids)).alias("ids"))
