"""Cross-tokenizer alignment by galloping intersection of token ends.

Method. Space + text is encoded by a byte-level tokenizer (A) and by a piece tokenizer (B). Both give ends of tokens as byte
offsets. The shorter list of a document's ends drives: each of its ends is sought in the longer one by exponential steps from
a finger, then by binary search between the last two steps. The finger is the rank at which the end's word begins, since both tokenizers end a
token before a space that follows another character (the pattern of A parts words there, and B has no piece with
a space after another character). All ends of a block are sought at once. Ends found in both lists cut the tokens
into groups; differences of the ranks give each group's tokens on either side, and every A-B pair inside a group is a link.

An id pair's count is the number of documents that hold it linked. Id pairs have a fixed universe (ids of A times ids of B), so
they are dealt by a scramble of the A id over a fixed number of parts; all pairs of an A id are in one part, which also
knows the highest count. Documents are encoded once, in chunks of about ``CHUNK`` bytes; a chunk keeps its documents' pairs, asks each part for
the counts of its distinct pairs, and gets numbers back in the same order. Sums are merged ``FAN`` chunks at a time,
and answers are made for ``ASKED`` chunks at a time, so that no group grows with the corpus.

Results. ``align``: key, the ids, and the rank after each group's last token on either side. ``link_counts``: key, n_a, n_b, n_groups,
n_links, n_best, count_sum, groups_sha256 (of ``a1,a2|b1;a3|b2,b3``; '' without tokens).

Edge cases. Texts that are null, empty, or whose joined A or B bytes differ from space + text (B writes U+2581 for a space) have no tokens.
Strings of special tokens are plain text. Very long texts: memory follows the text; the pairs of a group are made by distinct id where it is long.
A null key is a row like others, repeated rows are rows of their own and count as documents. Empty tables give empty results. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import os
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faceoff.llm import text as T
from faceoff.llm.bpe import vocabulary
from faceoff.llm.packed import pack, pack_sorted, unpack, unpack_sorted
from faceoff.llm.scratch import Scratch

CHUNK = 8 << 20
TEXT = 1 << 20
REMEMBER = 500_000
PART_BITS = 10
FAN, ASKED = 64, 512
#: Pairs made at a time, and pairs of a group above which its distinct ids are paired.
PAIRS, LONG_GROUP = 2_000_000, 4096
B_BITS, A_BITS = 15, 16
#: An odd factor scrambles A ids, so that parts are ranges of about equal use.
SCRAMBLE = 0x9E37
SPACE = 32


class TwoCoder:
    """Ids of text fragments by both tokenizers; every distinct fragment is encoded once per worker."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        plain, special = vocabulary(byte_path)
        every = plain | special
        self.a_bytes = [every.get(i, b"") for i in range(max(every) + 1)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        if len(self.a_bytes) > 1 << A_BITS or len(self.b_bytes) > 1 << B_BITS:
            raise ValueError(f"vocabularies of at most {1 << A_BITS} and {1 << B_BITS} ids")
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")
        self._forget()

    def _forget(self) -> None:
        self.keys, self.good = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.at = np.zeros((0, 4), np.int64)                     # start and size in a_ids, start and size in b_ids
        self.a_ids, self.b_ids = np.zeros(0, np.int32), np.zeros(0, np.int32)

    @staticmethod
    def _joins(ids: list[list[int]], token: list[bytes], raw: list[bytes]) -> np.ndarray:
        return np.array([b"".join([token[i] for i in own]) == r for own, r in zip(ids, raw, strict=True)], bool)

    def _learn(self, keys: np.ndarray, raw: list[bytes]) -> None:
        texts = [r.decode("utf-8", "replace") for r in raw]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # every fragment begins with a space, which B adds by itself
        b = [x if len(t) > 1 else [self.space] for x, t in zip(self.b.encode([t[1:] for t in texts], num_threads=1), texts, strict=True)]
        good = self._joins(a, self.a_bytes, raw) & self._joins(b, self.b_bytes, raw)
        at = np.zeros((len(raw), 4), np.int64)
        for side, ids, held in ((0, a, self.a_ids), (2, b, self.b_ids)):
            at[:, side + 1] = [len(x) for x in ids]
            at[:, side] = len(held) + np.cumsum(at[:, side + 1]) - at[:, side + 1]
        self.a_ids = np.concatenate([self.a_ids, np.fromiter((i for x in a for i in x), np.int32, int(at[:, 1].sum()))])
        self.b_ids = np.concatenate([self.b_ids, np.fromiter((i for x in b for i in x), np.int32, int(at[:, 3].sum()))])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.good, self.at = keys[order], np.concatenate([self.good, good])[order], np.concatenate([self.at, at])[order]

    def fragments(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each fragment among those known, after the new ones were encoded."""
        keys, first, where = np.unique(T.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > REMEMBER:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        inside = at < len(self.keys)
        known = np.zeros(len(keys), bool)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            new, raw = first[~known], data.tobytes()
            self._learn(keys[~known], [raw[a:z] for a, z in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        return at[where]


@cache
def coder(byte_path: str, piece_path: str) -> TwoCoder:
    """The worker's coder for a pair of tokenizer files."""
    return TwoCoder(byte_path, piece_path)


def gallop(short: np.ndarray, long: np.ndarray, finger: np.ndarray) -> np.ndarray:
    """For each value of ``short``: the first place in ``long``, from its finger on, whose value is not below it.

    Both are sorted, nothing before a finger is as large as its value, and long's last value is not below short's.
    """
    low, high, step = finger.copy(), finger.copy(), 1
    todo = np.flatnonzero(long[high] < short)
    while len(todo):                                              # exponential steps
        low[todo] = high[todo] + 1
        high[todo] = np.minimum(high[todo] + step, len(long) - 1)
        step *= 2
        todo = todo[long[high[todo]] < short[todo]]
    todo = np.flatnonzero(low < high)
    while len(todo):                                              # binary search between the last two
        middle = (low[todo] + high[todo]) // 2
        below = long[middle] < short[todo]
        low[todo] = np.where(below, middle + 1, low[todo])
        high[todo] = np.where(below, high[todo], middle)
        todo = todo[low[todo] < high[todo]]
    return low


class Aligned:
    """Tokens and groups of a block: ids of both sides, the rank after each group's last token, and every document's first of each."""

    def __init__(self, block: T.Block, code: TwoCoder) -> None:
        size = np.diff(block.offsets)
        data = np.insert(block.data, block.offsets[:-1][size > 0], SPACE)
        edge = np.concatenate([[0], np.cumsum(np.where(size > 0, size + 1, 0))])
        begin = data == SPACE
        begin[1:] &= data[:-1] != SPACE
        begin[edge[:-1][size > 0]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))[:len(starts)]
        doc = np.searchsorted(edge[1:], starts, "right")
        known = code.fragments(data, starts, ends) if len(starts) else np.zeros(0, np.int64)
        bad = np.zeros(block.docs, bool)
        bad[doc[~code.good[known]]] = True
        stay = ~bad[doc]
        known, doc = known[stay], doc[stay]
        at = code.at[known]
        docs = np.arange(block.docs + 1)
        word = np.searchsorted(doc, docs)                         # first fragment of each document
        self.a, a_word = self._ids(code.a_ids, at[:, 0], at[:, 1])
        self.b, b_word = self._ids(code.b_ids, at[:, 2], at[:, 3])
        self.first_a, self.first_b = a_word[word], b_word[word]
        a_end, b_end = np.cumsum(code.a_size[self.a]), np.cumsum(code.b_size[self.b])
        # the shorter list of each document drives
        a_drives = np.diff(self.first_a) <= np.diff(self.first_b)
        pick = np.repeat(a_drives, np.diff(self.first_a)), np.repeat(a_drives, np.diff(self.first_b))
        finger = np.repeat(np.where(a_drives[doc], b_word[:-1], a_word[:-1]), np.where(a_drives[doc], at[:, 1], at[:, 3]))
        rank_a, rank_b = np.arange(len(self.a)), np.arange(len(self.b))
        found = []
        for mine, own_end, own_rank, end, other_doc in ((pick[0], a_end, rank_a, b_end, True), (~pick[1], b_end, rank_b, a_end, False)):
            driver = own_rank[mine]
            if len(driver):
                place = gallop(own_end[driver], end, finger[np.repeat(a_drives[doc] == other_doc, np.where(a_drives[doc], at[:, 1], at[:, 3]))])
                both = end[place] == own_end[driver]
                pair = (driver[both], place[both])
                found.append(pair if other_doc else pair[::-1])
        last_a, last_b = (np.sort(np.concatenate([f[i] for f in found])) if found else np.zeros(0, np.int64) for i in (0, 1))
        self.stop_a, self.stop_b = last_a + 1, last_b + 1
        self.first_group = np.searchsorted(self.stop_a, self.first_a, "right")
        self.n_a, self.n_b = np.diff(self.stop_a, prepend=0), np.diff(self.stop_b, prepend=0)

    @staticmethod
    def _ids(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.concatenate([[0], np.cumsum(size)])
        return values[np.repeat(start - edge[:-1], size) + np.arange(edge[-1])], edge

    def digests(self) -> list[str]:
        """The hash of each document's groups in text; '' without tokens."""
        total = len(self.a) + len(self.b)
        ids, mark = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        group = np.arange(len(self.stop_a))
        # a group's A tokens come after all tokens of the groups before it, its B tokens after its A tokens
        at_a = np.arange(len(self.a)) + np.repeat(self.stop_b - self.n_b, self.n_a)
        at_b = np.arange(len(self.b)) + np.repeat(self.stop_a, self.n_b)
        ids[at_a], ids[at_b] = self.a, self.b
        mark[at_a[self.stop_a - 1]] = ord("|")
        closes = np.zeros(len(group), bool)
        closes[self.first_group[1:][np.diff(self.first_group) > 0] - 1] = True
        mark[at_b[self.stop_b - 1]] = np.where(closes, 0, ord(";"))
        cells = digits()[ids]
        cells[:, -1] = mark
        flat = cells.ravel()
        solid = flat != 0
        edge = np.concatenate([[0], np.cumsum(solid.reshape(cells.shape).sum(1))])[self.first_a + self.first_b]
        text = flat[solid].tobytes()
        return [hashlib.sha256(text[a:z]).hexdigest() if a < z else "" for a, z in zip(edge.tolist(), edge[1:].tolist(), strict=False)]

    def links(self):
        """(document, pair, number) of the links of a few tokens at a time; pairs are numbers of A_BITS + B_BITS bits."""
        scrambled = ((self.a.astype(np.int64) * SCRAMBLE) & ((1 << A_BITS) - 1)) << B_BITS
        owner = np.repeat(np.arange(len(self.first_a) - 1), np.diff(self.first_group))
        product = self.n_a * self.n_b
        for g in np.flatnonzero(product > LONG_GROUP).tolist():
            x, n = np.unique(scrambled[self.stop_a[g] - self.n_a[g]:self.stop_a[g]], return_counts=True)
            y, m = np.unique(self.b[self.stop_b[g] - self.n_b[g]:self.stop_b[g]], return_counts=True)
            rows = max(1, PAIRS // len(y))
            for i in range(0, len(x), rows):
                pair = (x[i:i + rows, None] | y[None, :]).ravel()
                yield np.full(len(pair), owner[g]), pair, (n[i:i + rows, None] * m[None, :]).ravel()
        group = np.repeat(np.arange(len(product)), self.n_a)
        token = np.flatnonzero(product[group] <= LONG_GROUP)
        group = group[token]
        each = self.n_b[group]
        total = np.concatenate([[0], np.cumsum(each)])
        lo = 0
        while lo < len(token):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, "right")) - 1)
            n, g = each[lo:hi], group[lo:hi]
            b = np.repeat((self.stop_b - self.n_b)[g] - (total[lo:hi] - total[lo]), n) + np.arange(int(n.sum()))
            yield np.repeat(owner[g], n), np.repeat(scrambled[token[lo:hi]], n) | self.b[b], None
            lo = hi


@cache
def digits() -> np.ndarray:
    """Decimal digits of every id, ended by zeros, and a place for a mark."""
    n = 1 << A_BITS
    return np.frombuffer(b"".join(str(i).encode().ljust(6, b"\0") for i in range(n)), np.uint8).reshape(n, 6).copy()


def _distinct(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (document, pair) keys and how often each is linked."""
    bits = A_BITS + B_BITS
    keys, numbers = [], []
    for doc, pair, n in parts:
        key = (doc.astype(np.int64) << bits) | pair
        key.sort() if n is None else None
        order = slice(None) if n is None else np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        keys.append(key[new])
        numbers.append(np.diff(np.append(new, len(key))) if n is None else np.add.reduceat(n[order], new))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return keys_summed(np.concatenate(keys), np.concatenate(numbers)) if len(keys) > 1 else (keys[0], numbers[0])


def keys_summed(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, numbers
    order = np.argsort(keys, kind="stable")
    keys, numbers = keys[order], numbers[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(numbers, new)


MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def _chunks(byte_path: str, piece_path: str, kind: str):
    """Chunks of documents with their measures and pairs, and a row per part with the chunk's distinct pairs and their documents."""
    shift = A_BITS + B_BITS - PART_BITS

    def flush(chunk: int, rows: list) -> pa.RecordBatch:
        docs = [x for r in rows for x in r[0]]
        per_doc = np.concatenate([r[2] for r in rows])
        pair, number = (np.concatenate([r[i] for r in rows]) for i in (3, 4))
        distinct, where = np.unique(pair, return_inverse=True)
        held = np.bincount(where, minlength=len(distinct))
        part, edge = np.unique(distinct >> shift, return_index=True)
        edge = np.append(edge, len(distinct))
        n = len(part) + 1
        head = {"key": docs, "sha": [x for r in rows for x in r[5]], "measures": np.concatenate([r[1] for r in rows]).ravel().tolist(),
                "per_doc": pack(per_doc.astype(np.uint32)), "where": pack(where.astype(np.uint32)), "number": pack(number.astype(np.uint32))}
        kinds = {"key": pa.list_(kind), "sha": pa.list_(pa.string()), "measures": pa.list_(pa.int64()), "per_doc": pa.binary(), "where": pa.binary(),
                 "number": pa.binary()}
        columns = {"chunk": pa.array([chunk] * n, pa.int64()), "part": pa.array([-1, *part.tolist()], pa.int32()),
                   "pairs": pa.array([None, *(pack_sorted(distinct[a:z].astype(np.uint64)) for a, z in zip(edge, edge[1:], strict=False))], pa.binary()),
                   "counts": pa.array([None, *(pack(held[a:z].astype(np.uint32)) for a, z in zip(edge, edge[1:], strict=False))], pa.binary())}
        columns |= {name: pa.array([value] + [None] * (n - 1), kinds[name]) for name, value in head.items()}
        return pa.RecordBatch.from_pydict(columns)

    def run(batches):
        code, task = coder(byte_path, piece_path), TaskContext.get().partitionId()
        rows, size, number = [], 0, 0
        for batch in batches:
            for block in T.blocks(batch.column("t"), TEXT):
                own = Aligned(block, code)
                links = T.sums(own.n_a * own.n_b, own.first_group)
                measures = np.stack([np.diff(own.first_a), np.diff(own.first_b), np.diff(own.first_group), links], axis=1)
                keys, linked = _distinct(list(own.links()))
                bits = A_BITS + B_BITS
                rows.append((batch.column("k").slice(block.lo, block.docs).to_pylist(), measures, np.bincount(keys >> bits, minlength=block.docs),
                             keys & ((1 << bits) - 1), linked, own.digests()))
                size += len(block.data)
                if size >= CHUNK:
                    yield flush((task << 32) + number, rows)
                    rows, size, number = [], 0, number + 1
        if rows:
            yield flush((task << 32) + number, rows)
    return run


def _add(table: pa.Table) -> pa.Table:
    """Distinct pairs of several chunks and their numbers of documents."""
    keys, numbers = keys_summed(np.concatenate([unpack_sorted(x) for x in table.column("pairs").to_pylist()]),
                                np.concatenate([unpack(x, np.uint32).astype(np.int64) if w == 4 else unpack(x, np.int64)
                                                for x, w in zip(table.column("counts").to_pylist(), table.column("width").to_pylist(), strict=True)]))
    return pa.table({"part": table.column("part").slice(0, 1), "grp": table.column("grp").slice(0, 1), "pairs": [pack_sorted(keys)],
                     "counts": [pack(numbers)], "width": pa.array([8], pa.int32())})


ADDED = "part int, grp long, pairs binary, counts binary, width int"


def _answer(asked: pa.Table, total: pa.Table) -> pa.Table:
    """Counts of each chunk's pairs, in their order; twice the count, plus 1 where it is its A id's highest."""
    if not len(asked) or not len(total):
        return pa.table({"chunk": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "answers": pa.array([], pa.binary())})
    keys, numbers = unpack_sorted(total.column("pairs")[0].as_py()), unpack(total.column("counts")[0].as_py(), np.int64)
    a = keys >> np.uint64(B_BITS)
    new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    most = np.repeat(np.maximum.reduceat(numbers, new), np.diff(np.append(new, len(a))))
    value = 2 * numbers + (numbers == most)
    answers = [pack(value[np.searchsorted(keys, unpack_sorted(x))]) for x in asked.column("pairs").to_pylist()]
    return pa.table({"chunk": asked.column("chunk"), "part": asked.column("part"), "answers": pa.array(answers, pa.binary())})


def _close(kind: pa.DataType):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        got = sorted(zip(answers.column("part").to_pylist(), answers.column("answers").to_pylist(), strict=True))
        value = np.concatenate([np.zeros(0, np.int64), *(unpack(x, np.int64) for _, x in got)])
        row = docs.slice(0, 1).to_pylist()[0]
        where, number = unpack(row["where"], np.uint32), unpack(row["number"], np.uint32).astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(unpack(row["per_doc"], np.uint32).astype(np.int64))])
        own = value[where]
        measures = np.array(row["measures"], np.int64).reshape(-1, len(MEASURES))
        columns = {"k": pa.array(row["key"], kind)} | {m: pa.array(measures[:, i]) for i, m in enumerate(MEASURES)}
        columns |= {"n_best": pa.array(T.sums((own & 1) * number, edge)), "count_sum": pa.array(T.sums((own >> 1) * number, edge))}
        return pa.table(columns | {"groups_sha256": pa.array(row["sha"], pa.string())})
    return run


def link_counts(docs: DataFrame, byte_tokenizer: str, piece_tokenizer: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    scratch = Scratch(docs.sparkSession, "alignment")
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    arrow_kind = _arrow_kind(docs, key)
    chunks = scratch.keep(rows.mapInArrow(
        _chunks(byte_tokenizer, piece_tokenizer, arrow_kind),
        f"chunk long, part int, pairs binary, counts binary, key array<{kind}>, sha array<string>, measures array<long>, per_doc binary, where binary, number binary"))
    held = chunks.where("part < 0").select("chunk", "key", "sha", "measures", "per_doc", "where", "number")
    asked = chunks.where("part >= 0").select("chunk", "part", "pairs", "counts")
    many = chunks.where("part < 0").select("chunk").count()
    width = -(-many // FAN)
    sums = asked.select("part", F.pmod(F.xxhash64("chunk"), F.lit(max(width, 1))).alias("grp"), "pairs", "counts", F.lit(4).alias("width"))
    sums = sums.groupBy("part", "grp").applyInArrow(_add, ADDED)
    while width > 1:
        width = -(-width // FAN)
        sums = sums.withColumn("grp", F.pmod("grp", F.lit(width))).groupBy("part", "grp").applyInArrow(_add, ADDED)
    times = max(1, -(-many // ASKED))
    total = sums.select("part", "pairs", "counts", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("time"))
    asked = asked.select("chunk", "part", "pairs", F.pmod(F.xxhash64("chunk"), F.lit(times)).cast("int").alias("time"))
    answers = asked.groupBy("part", "time").cogroup(total.groupBy("part", "time")).applyInArrow(_answer, "chunk long, part int, answers binary")
    closed = held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _close(arrow_kind), f"k {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return closed.withColumnRenamed("k", key)


def _arrow_kind(docs: DataFrame, key: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[key].dataType)


def _align(byte_path: str, piece_path: str):
    def run(batches):
        code = coder(byte_path, piece_path)
        for batch in batches:
            for block in T.blocks(batch.column("t"), TEXT):
                own = Aligned(block, code)

                def listed(values, first):
                    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int32)))

                group = np.repeat(np.arange(block.docs), np.diff(own.first_group))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k").slice(block.lo, block.docs), listed(own.a, own.first_a), listed(own.b, own.first_b),
                     listed(own.stop_a - own.first_a[group], own.first_group), listed(own.stop_b - own.first_b[group], own.first_group)],
                    ["k", "a_ids", "b_ids", "a_stops", "b_stops"])
    return run


def align(docs: DataFrame, byte_tokenizer: str, piece_tokenizer: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, a_ids, b_ids, and for each group the rank after its last token: a_stops, b_stops."""
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(_align(byte_tokenizer, piece_tokenizer),
                           f"k {kind}, a_ids array<int>, b_ids array<int>, a_stops array<int>, b_stops array<int>").withColumnRenamed("k", key)
