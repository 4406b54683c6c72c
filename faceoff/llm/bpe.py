"""BPE encoding and decoding by forced-boundary splitting.

Method. A pair of bytes that occurs inside no token of the vocabulary can never be merged, so a token always
ends between them. The 256 x 256 table of such pairs is made from the vocabulary; a text is cut at every such
pair with one look-up per byte, the fragments are encoded independently (each distinct one once per worker),
and the ids are concatenated. The tokenizer also parts words by a pattern; a cut is only used where that
pattern reads both sides as it reads the whole: never inside a character, after white space (the pattern looks
ahead there), or beside an apostrophe (contractions). Special tokens in a text are fragments of their own.

Results. ``encode``: key and ids (array of int), equal to the library's. ``decode``: the text of ids.

Edge cases. Null or empty text: no ids; no ids: an empty text. Very long texts have no length limit; a long
run without a certain cut is one fragment. Repeated rows are encoded alike. Empty tables give empty results.
Ids outside the vocabulary are skipped in ``decode``, as the library does. Other columns are not read.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faceoff.llm import text as T
from faceoff.llm.fragments import TEXT, coder


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@cache
def vocabulary(path: str) -> tuple[dict[int, bytes], dict[int, bytes]]:
    """Bytes by id of the ordinary and of the special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = _byte_of()
    special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return {i: bytes(byte[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special}, special


@cache
def certain_cuts(path: str) -> np.ndarray:
    """Whether a token always ends between two bytes: no token holds the pair."""
    cut = np.ones((256, 256), bool)
    for token in vocabulary(path)[0].values():
        for a, b in zip(token, token[1:], strict=False):
            cut[a, b] = False
    cut[:0x21] = False                    # white space and controls before the cut
    cut[:, 0x80:0xC0] = False             # inside a character
    cut[0x27] = cut[:, 0x27] = False      # beside an apostrophe
    return cut


def fragments(block: T.Block, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the fragments of a block's documents."""
    d = block.data
    if not len(d):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.zeros(len(d) + 1, bool)
    table = certain_cuts(path).ravel()
    start[1:-1] = table[d[:-1].astype(np.int32) * 256 + d[1:]]
    # no cut after the first letter of a contraction, or after a character that may be a wide white space
    start[2:-1] &= d[:-2] != 0x27
    start[2:-1] &= ~((d[:-2] == 0xC2) & ((d[1:-1] == 0x85) | (d[1:-1] == 0xA0)))
    start[3:-1] &= ~((d[:-3] >= 0xE1) & (d[:-3] <= 0xE3) & (d[1:-2] >= 0x80) & (d[2:-1] >= 0x80))
    raw = None
    for word in vocabulary(path)[1].values():
        raw = d.tobytes() if raw is None else raw
        at = raw.find(word)
        while at >= 0:
            end = at + len(word)
            # not where it would lie across two documents
            if np.searchsorted(block.offsets, at, "right") == np.searchsorted(block.offsets, end, "left"):
                start[at + 1:end] = False
                start[at] = start[end] = True
                at = raw.find(word, end)
            else:
                at = raw.find(word, at + 1)
    start[block.offsets] = True
    edge = np.flatnonzero(start)
    if edge[0] != 0:
        edge = np.concatenate([[0], edge])
    return edge[:-1], edge[1:]


def _encode(path: str):
    def run(batches):
        code = coder(path)
        for batch in batches:
            for block in T.blocks(batch.column("t"), TEXT):
                starts, ends = fragments(block, path)
                ids, size = code.encode(block.data, starts, ends)
                edge = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, block.offsets)]
                rows = batch.column("k").slice(block.lo, block.docs)
                yield pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids))], ["k", "ids"])
    return run


def encode(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids of every whole text."""
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(_encode(tokenizer), f"k {kind}, ids array<int>").withColumnRenamed("k", key)


@cache
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    plain, special = vocabulary(path)
    every = plain | special
    size = np.zeros(max(every) + 1, np.int64)
    for i, t in every.items():
        size[i] = len(t)
    data = b"".join(every.get(i, b"") for i in range(len(size)))
    return np.frombuffer(data, np.uint8), np.cumsum(size) - size, size


def _decode(path: str, ids: str):
    def run(batches):
        data, start, size = _token_bytes(path)
        for batch in batches:
            column = batch.column("_row").field(ids)
            column = column.fill_null([]) if column.null_count else column
            edge, values = np.asarray(column.offsets).astype(np.int64), column.values
            texts = []
            lo = 0
            while lo < len(column):
                hi = min(max(lo + 1, int(np.searchsorted(edge, edge[lo] + 250_000, "right")) - 1), len(column))
                own = values.slice(edge[lo], edge[hi] - edge[lo])
                own = np.asarray(own.fill_null(-1) if own.null_count else own).astype(np.int64)
                good = (own >= 0) & (own < len(size))
                own = np.where(good, own, 0)
                n = np.where(good, size[own], 0)
                before = np.cumsum(n) - n
                out = data[np.repeat(start[own] - before, n) + np.arange(int(n.sum()))].tobytes()
                cut = np.concatenate([[0], np.cumsum(n)])[edge[lo:hi + 1] - edge[lo]].tolist()
                texts += [out[a:z].decode("utf-8", "replace") for a, z in zip(cut, cut[1:], strict=False)]
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], ["_row", "_text"])
    return run


def decode(encoded: DataFrame, tokenizer: str, *, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids, special tokens included."""
    packed = encoded.select(F.struct(*[encoded[c] for c in encoded.columns]).alias("_row"))
    kind = packed.schema["_row"].dataType.simpleString()
    out = packed.mapInArrow(_decode(tokenizer, ids), f"_row {kind}, _text string")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in encoded.columns if c != into], F.col("_text").alias(into))
