"""Substring dedup by relative Lempel-Ziv parsing against an index of reference text.

Method. Every text is a sequence of words. The reference of a document is all text before it: documents of
a smaller key, and its own earlier words. The index has two layers:

* Anchors: of any ``window`` (20) consecutive words, the ``ANCHOR``-word run with the least hash (a run of
  equal text always gives equal anchors). An anchor that occurs once in the corpus rules out every window
  it stands for; only windows on shared anchors are looked up, so unique text never leaves its task.
* Reference blocks: the index, partitioned by an 80-bit hash of the window, gives each looked-up window the
  start of its earliest occurrence.

A document is then factored greedily from left to right: a factor begins at the first window that occurs
earlier and grows word by word while the next window continues the same reference place. Where it can grow no
further, the factor ends, and the windows that cross its end are looked up on their own before literal words
follow, so a duplicate that straddles two references is found too. Factors are at least ``window`` words
long and become duplicate spans; words in a span are removed. The result equals the definition: a word goes
if a window that covers it also starts earlier, judged on the input.

Scale. Texts are dealt once into blocks of about ``BLOCK_TEXT`` bytes; anchors, windows and factors travel between
blocks and hash partitions as packed arrays. Work on a passage that a third of all documents share is linear in
its occurrences, and nothing is dropped from a frequent bucket.

Results. ``duplicate_factors``: key, start, length (words), ref_key, ref_start. ``remove_duplicates``: the
documents with kept words joined by one space where something was removed. ``digest``: counts and a hash.

Edge cases. Null or empty text: no words, nothing removed. Fewer than ``window`` words: nothing removed. Null
keys come after all others in no order among them, so their texts never are a reference for each other; they
use others' and, for a passage no row with a key has, their own earlier places. The largest long is read as a null key. Rows that share a key begin at the same place: neither is earlier than the other at equal starts.
Empty tables give empty results. Extra columns pass through ``remove_duplicates`` and are not read elsewhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faceoff.llm import text as T
from faceoff.llm.packed import pack, pack_sorted, unpack, unpack_sorted

ANCHOR = 10
LAST = np.iinfo(np.int64).max
BLOCK_TEXT = 8 << 20
LEAST_BLOCKS = 48
PACKED = ("part", "keys", "check", "doc", "place", "ks", "rs")
PACKED_SCHEMA = "part int, keys binary, check binary, doc binary, place binary, ks binary, rs binary"
SENT = ("block", "rs", "counts", "place", "ref_key", "ref_start")
SENT_SCHEMA = "block long, rs binary, counts binary, place binary, ref_key binary, ref_start binary"


def _table(rows: list[tuple], names: tuple[str, ...], number: pa.DataType) -> pa.Table:
    kinds = (number, *[pa.binary()] * (len(names) - 1))
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def _anchors(w: T.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window start: the start of its anchor, the leftmost run of least hash; and the run's hash at every word."""
    at, h = T.windows(w.hashes, w.first, ANCHOR)
    run = np.full(len(w.hashes), np.iinfo(np.uint64).max, np.uint64)
    run[at] = h
    starts, _ = T.windows(w.hashes, w.first, window)
    best, where = run[starts].copy(), starts.copy()
    for k in range(1, window - ANCHOR + 1):
        value = run[starts + k]
        less = value < best
        best[less], where[less] = value[less], starts[less] + k
    return starts, where, run


def _parted(keys, check, doc, place, k, r, parts: int) -> list[tuple]:
    """Occurrences (key, check, document, place) as one packed row per hash partition."""
    width = np.uint64(2**64 // parts + 1)
    order = np.argsort(keys)
    edge = np.searchsorted(keys[order] // width, np.arange(parts + 1).astype(np.uint64))
    rows = []
    for p, (a, z) in enumerate(zip(edge, edge[1:], strict=False)):
        if a < z:
            own = order[a:z]
            docs, local = np.unique(doc[own], return_inverse=True)
            rows.append((p, pack_sorted(keys[own]), pack(check[own].astype(np.uint16)), pack(local.astype(np.uint32)),
                         pack(place[own].astype(np.uint32)), pack(k[docs]), pack(r[docs])))
    return rows


def _occurrences(table: pa.Table):
    """The occurrences of a partition, sorted by key and check, then by place in the corpus."""
    out = []
    for row in table.to_pylist():
        doc = unpack(row["doc"], np.uint32)
        out.append((unpack_sorted(row["keys"]), unpack(row["check"], np.uint16), unpack(row["ks"], np.int64)[doc],
                    unpack(row["place"], np.uint32).astype(np.int64), unpack(row["rs"], np.int64)[doc]))
    keys, check, k, place, r = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((place, k, check, keys))
    keys, check, k, place, r = keys[order], check[order], k[order], place[order], r[order]
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (check[1:] != check[:-1])])
    return np.cumsum(fresh) - 1, np.flatnonzero(fresh), k, place, r


def _sent(r: np.ndarray, place: np.ndarray, ref_key: np.ndarray, ref_start: np.ndarray, blocks: int) -> pa.Table:
    """What goes back to the texts: one packed row per block, ordered by row and place."""
    block = np.mod(r, blocks)
    order = np.lexsort((place, r, block))
    block, r, place, ref_key, ref_start = (x[order] for x in (block, r, place, ref_key, ref_start))
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(r) else np.zeros(0, np.int64)
    rows, edge = [], np.append(first, len(r))
    for a, z in zip(edge, edge[1:], strict=False):
        own, counts = np.unique(r[a:z], return_counts=True)
        rows.append((int(block[a]), pack(own), pack(counts.astype(np.uint32)), pack(place[a:z].astype(np.uint32)), pack(ref_key[a:z]),
                     pack(ref_start[a:z].astype(np.uint32))))
    return _table(rows, SENT, pa.int64())


def _received(table: pa.Table):
    """All that was sent to a block: row, place, ref_key, ref_start, ordered by row and place, each once."""
    out = [(np.repeat(unpack(x["rs"], np.int64), unpack(x["counts"], np.uint32)), unpack(x["place"], np.uint32).astype(np.int64),
            unpack(x["ref_key"], np.int64), unpack(x["ref_start"], np.uint32).astype(np.int64)) for x in table.to_pylist()]
    if not out:
        return (np.zeros(0, np.int64),) * 4
    r, place, ref_key, ref_start = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((place, r))
    r, place, ref_key, ref_start = r[order], place[order], ref_key[order], ref_start[order]
    once = np.concatenate([[True], (r[1:] != r[:-1]) | (place[1:] != place[:-1])])
    return r[once], place[once], ref_key[once], ref_start[once]


def _emit_anchors(window: int, parts: int):
    def run(batches):
        for batch in batches:
            k, r = np.asarray(batch.column("k")), np.asarray(batch.column("r"))
            for block in T.blocks(batch.column("t")):
                w = T.words(block)
                _, where, runs = _anchors(w, window)
                if len(where):
                    place = np.unique(where)
                    doc = np.searchsorted(w.first, place, "right") - 1
                    rows = _parted(runs[place], np.zeros(len(place), np.uint16), block.lo + doc, place - w.first[doc], k, r, parts)
                    yield from _table(rows, PACKED, pa.int32()).to_batches()
    return run


def _shared(blocks: int):
    """Anchors at more than one place: all their places."""
    def run(table: pa.Table) -> pa.Table:
        group, first, k, place, r = _occurrences(table)
        other = np.concatenate([[False], (group[1:] == group[:-1]) & ((r[1:] != r[:-1]) | (place[1:] != place[:-1]))])
        several = np.zeros(len(first), bool)
        several[group[other]] = True
        hit = several[group]
        return _sent(r[hit], place[hit], np.zeros(int(hit.sum()), np.int64), np.zeros(int(hit.sum()), np.int64), blocks)
    return run


def _texts(table: pa.Table, text: str) -> pa.Array:
    return table.column("_row").combine_chunks().field(text)


def _emit_windows(window: int, parts: int, text: str):
    """The windows on shared anchors, to the partitions of the index."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got_r, got_place, *_ = _received(right)
        k, r = np.asarray(left.column("k")), np.asarray(left.column("r"))
        rows = []
        for block in T.blocks(_texts(left, text)):
            own = r[block.lo:block.hi]
            a, z = np.searchsorted(got_r, own, "left"), np.searchsorted(got_r, own, "right")
            if (a == z).all():
                continue
            w = T.words(block)
            at = np.repeat(a, z - a) + np.arange(int((z - a).sum())) - np.repeat(np.cumsum(z - a) - (z - a), z - a)
            ok = np.zeros(len(w.hashes) + 1, bool)
            ok[np.repeat(w.first[:-1], z - a) + got_place[at]] = True
            starts, where, _ = _anchors(w, window)
            mine = ok[where]
            if mine.any():
                _, one = T.windows(w.hashes, w.first, window, 1)
                _, two = T.windows(w.hashes, w.first, window, 2)
                starts = starts[mine]
                doc = np.searchsorted(w.first, starts, "right") - 1
                rows += _parted(one[mine], two[mine] >> np.uint64(48), block.lo + doc, starts - w.first[doc], k, r, parts)
        return _table(rows, PACKED, pa.int32())
    return run


def _earlier(blocks: int):
    """Windows that occur earlier, with their earliest occurrence."""
    def run(table: pa.Table) -> pa.Table:
        group, first, k, place, r = _occurrences(table)
        ref_key, ref_start = k[first][group], place[first][group]
        hit = (ref_key != LAST) & ((k > ref_key) | (place > ref_start))
        # no row with a key has it: rows without one are each their own reference
        own = np.flatnonzero(ref_key == LAST)
        own = own[np.lexsort((place[own], r[own], group[own]))]
        start = np.ones(len(own), bool)
        start[1:] = (group[own][1:] != group[own][:-1]) | (r[own][1:] != r[own][:-1])
        ref_start[own] = place[own[np.flatnonzero(start)[np.cumsum(start) - 1]]] if len(own) else ref_start[own]
        hit[own] = place[own] > ref_start[own]
        return _sent(r[hit], place[hit], ref_key[hit], ref_start[hit], blocks)
    return run


def _factors_of(right: pa.Table, window: int):
    """Greedy factors by row: row, start, length, ref_key, ref_start."""
    r, start, ref_key, ref_start = _received(right)
    if not len(r):
        return (r,) * 5
    # a factor goes on while the next window is the next place of the same reference
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (start[1:] != start[:-1] + 1) | (ref_key[1:] != ref_key[:-1])
                          | (ref_start[1:] != ref_start[:-1] + 1)])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(r))) + window - 1
    return r[first], start[first], length, ref_key[first], ref_start[first]


def _list_factors(window: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key = dict(zip(left.column("r").to_pylist(), left.column("k").to_pylist(), strict=True))
        r, *rest = _factors_of(right, window)
        return pa.table({"k": pa.array([key[x] for x in r.tolist()], pa.int64()),
                         **{n: pa.array(v.astype(np.int64)) for n, v in zip(("start", "length", "ref_key", "ref_start"), rest, strict=True)}})
    return run


def _cut(window: int, text: str, as_digest: bool):
    """The words that no factor covers."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got_r, start, length, _, _ = _factors_of(right, window)
        r = np.asarray(left.column("r"))
        n_words, removed, out = [], [], []
        for block in T.blocks(_texts(left, text)):
            w = T.words(block)
            raw = block.data.tobytes()
            a, z = (np.searchsorted(got_r, r[block.lo:block.hi], side) for side in ("left", "right"))
            for i in range(block.docs):
                lo, hi = int(w.first[i]), int(w.first[i + 1])
                stay = np.arange(lo, hi)
                if a[i] < z[i]:
                    edge = np.zeros(hi - lo + 1, np.int32)
                    np.add.at(edge, start[a[i]:z[i]], 1)
                    np.add.at(edge, (start + length)[a[i]:z[i]], -1)
                    stay = stay[np.cumsum(edge)[:-1] == 0]
                n_words.append(hi - lo)
                removed.append(hi - lo - len(stay))
                if as_digest or removed[-1]:
                    left_over = b" ".join([raw[s:e] for s, e in zip(w.starts[stay].tolist(), w.ends[stay].tolist(), strict=True)])
                    out.append(hashlib.sha256(left_over).hexdigest() if as_digest else left_over.decode())
                else:
                    out.append(None)
        row = {"k": left.column("k")} if as_digest else {"_row": left.column("_row")}
        return pa.table({**row, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "out": pa.array(out, pa.string())})
    return run


def _parse(docs: DataFrame, key: str, text: str, columns: list[str], window: int):
    """Texts by block, and the windows of each block that occur earlier."""
    # a row is known by a hash of its key and text; rows equal in both get equal results
    rows = docs.select(F.coalesce(docs[key].cast("long"), F.lit(LAST)).alias("k"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"),
                       F.struct(*[docs[c] for c in columns]).alias("_row")).withColumn("r", F.xxhash64("k", "t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = parts = max(LEAST_BLOCKS, -(-size // BLOCK_TEXT))
    dealt = rows.select("k", "r", "_row", F.pmod("r", F.lit(blocks)).alias("block"))
    by_block = dealt.groupBy("block")
    anchors = rows.select("k", "r", "t").mapInArrow(_emit_anchors(window, parts), PACKED_SCHEMA)
    places = anchors.groupBy("part").applyInArrow(_shared(blocks), SENT_SCHEMA)
    found = by_block.cogroup(places.groupBy("block")).applyInArrow(_emit_windows(window, parts, text), PACKED_SCHEMA)
    return by_block, found.groupBy("part").applyInArrow(_earlier(blocks), SENT_SCHEMA)


def duplicate_factors(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """Factors of at least ``window`` words: key, start, length, ref_key, ref_start."""
    by_block, hits = _parse(docs, key, text, [text], window)
    out = by_block.cogroup(hits.groupBy("block")).applyInArrow(
        _list_factors(window), "k long, start long, length long, ref_key long, ref_start long")
    return out.select(F.when(F.col("k") != LAST, F.col("k")).alias(key), "start", "length", F.when(F.col("ref_key") != LAST, F.col("ref_key")).alias("ref_key"),
                      "ref_start")


def digest(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """One row per document: key, n_words, n_removed, kept_sha256 of the kept words joined by one space."""
    by_block, hits = _parse(docs, key, text, [text], window)
    out = by_block.cogroup(hits.groupBy("block")).applyInArrow(
        _cut(window, text, True), "k long, n_words long, n_removed long, out string")
    return out.select(F.when(F.col("k") != LAST, F.col("k")).cast(docs.schema[key].dataType).alias(key), "n_words", "n_removed",
                      F.col("out").alias("kept_sha256"))


def remove_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """The documents with duplicate words removed; texts without any stay as they are, byte for byte."""
    by_block, hits = _parse(docs, key, text, docs.columns, window)
    schema = StructType().add("_row", docs.schema, False).add("n_words", "long").add("n_removed", "long").add("out", "string")
    out = by_block.cogroup(hits.groupBy("block")).applyInArrow(_cut(window, text, False), schema)
    return out.select(*[F.coalesce("out", F.col("_row").getField(c).cast("string")).cast(docs.schema[c].dataType).alias(c) if c == text
                        else F.col("_row").getField(c).alias(c) for c in docs.columns])
