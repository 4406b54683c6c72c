"""Hard-negative mining with a packed R-tree (sort-tile-recursive) and best-first search.

Method. Vectors become whole numbers, floor(scale * x); a score is an integer inner product. Boxes bound it: per coordinate the product
of a query with an interval is an interval, and their sums bound every score inside the box. The upper levels
of the tree are tiles: slabs along the coordinate that varies most, cut again along the second, by quantiles of a sample.
Every row belongs to one tile; a tile of many rows is dealt by hash into blocks of about ``BLOCK`` rows, and every
block holds an R-tree packed by the sort-tile-recursive rule over its label and two coordinates. A search keeps a queue of boxes by upper bound. It
drops boxes that lie outside all score windows or strictly below the kth score already found, and ends when the best box does.

A query first searches its own tile. The kth scores found there go with it to those tiles that may still hold something
as good. Positives (same label) are such a search with one open window; negatives (other labels) one with a window per positive.

Scale. Queries travel in packs of about ``PACK``; blocks and packs have fixed sizes, and what a block finds for a
pack is one row. Results of a pack are merged ``FAN`` blocks at a time. At most ``TILES`` tiles are known to the driver (two corners
each). Rows are replicated once per ``HELD`` packs, packs once per block that their tiles' boxes leave open.

Results. ``hard_negatives``: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Nothing is
approximate: the sample only places the cuts.

Edge cases. Rows with a null key, label or vector, an empty vector, or any null or non-finite component take no part. Ties go
by smaller key, then by row. Rows that share a key are rows of their own: each is an anchor, and may be a positive of the other.
Vectors of different lengths are compared as if the shorter one ended in zeros. Whole numbers are held
within +-2^27, so that a score of up to 512 components fits a long. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faceoff.llm.scratch import Scratch

LEAF, FAN_OUT = 64, 16
TILES, TILE, BLOCK = 1024, 1024, 4096
PACK, HELD, FAN = 512, 16, 64
SAMPLE = 20_000
BIG = 2**62
MOST = 2**27

QUERY = ("pack long, row long, k long, label long, vec binary, tile int, lows array<long>, highs array<long>, kths array<long>, "
         "positives array<long>, scores array<long>")
DEALT = ("pack long, tile int, sub int, h long, rows array<long>, labels array<long>, vecs array<binary>, lows array<array<long>>, "
         "highs array<array<long>>, kths array<array<long>>")
FOUND = "pack long, grp long, rows array<long>, w array<int>, scores array<long>, ks array<long>, others array<long>"


def arrow(fields: str) -> pa.Schema:
    """The Arrow schema of a list of the few types used here."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else kinds[name]

    return pa.schema([pa.field(*((n, kind(t)))) for n, t in (f.split(" ") for f in fields.split(", "))])


def _table(fields: str, rows: list[tuple]) -> pa.Table:
    schema = arrow(fields)
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _matrix(vecs: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows of a matrix of whole numbers, ended by zeros."""
    if all(len(v) == 4 * width for v in vecs):
        return np.frombuffer(b"".join(vecs), np.int32).reshape(-1, width).astype(np.int64)
    out = np.zeros((len(vecs), width), np.int64)
    for i, v in enumerate(vecs):
        own = np.frombuffer(v, np.int32)[:width]
        out[i, :len(own)] = own
    return out


def _whole(scale: int):
    """(k, label, anchor, vec, dim): the whole numbers of every row that takes part."""
    def run(batches):
        for batch in batches:
            column = batch.column("e")
            flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(float("nan")))
            size = np.diff(np.asarray(column.offsets).astype(np.int64))
            size[np.asarray(column.is_null())] = 0
            edge = np.concatenate([[0], np.cumsum(size)])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            with np.errstate(all="ignore"):
                whole = np.clip(np.nan_to_num(np.floor(scale * flat)), -MOST, MOST).astype(np.int32)
            at = np.flatnonzero((size > 0) & (bad[edge[1:]] == bad[edge[:-1]]))
            vecs = [whole[edge[i]:edge[i + 1]].tobytes() for i in at]
            keep = pa.array(at)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(keep) for c in ("k", "label", "anchor")), pa.array(vecs, pa.binary()),
                                              pa.array(size[at].astype(np.int32))], ["k", "label", "anchor", "vec", "dim"])
    return run


class Cuts:
    """Slabs along one coordinate, each cut along another: the tile of a vector."""

    def __init__(self, sample: np.ndarray, tiles: int) -> None:
        spread = sample.var(axis=0) if len(sample) else np.zeros(sample.shape[1])
        order = np.argsort(-spread, kind="stable")
        self.a, self.b = int(order[0]), int(order[min(1, len(order) - 1)])
        slabs = int(np.ceil(np.sqrt(tiles)))
        self.inner = -(-tiles // slabs)
        self.first = self._quantiles(sample[:, self.a], slabs)
        slab = np.searchsorted(self.first, sample[:, self.a], "right")
        self.second = [self._quantiles(sample[slab == s, self.b], self.inner) for s in range(slabs)]

    @staticmethod
    def _quantiles(x: np.ndarray, parts: int) -> np.ndarray:
        x = np.sort(x)
        return x[(np.arange(1, parts) * len(x)) // parts] if len(x) else np.zeros(0, np.int64)

    def tile(self, x: np.ndarray) -> np.ndarray:
        slab = np.searchsorted(self.first, x[:, self.a], "right")
        out = slab * self.inner
        for s in np.unique(slab):
            at = slab == s
            out[at] += np.searchsorted(self.second[s], x[at, self.b], "right")
        return out.astype(np.int32)


def _place(cuts: Cuts, width: int):
    def run(batches):
        for batch in batches:
            tile = cuts.tile(_matrix(batch.column("vec").to_pylist(), width)) if len(batch) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile)], [*batch.schema.names, "tile"])
    return run


def _corners(width: int):
    """(tile, n, lo, hi) of a task's rows."""
    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            if not len(batch):
                continue
            x, tile = _matrix(batch.column("vec").to_pylist(), width), np.asarray(batch.column("tile"))
            for t in np.unique(tile).tolist():
                own = x[tile == t]
                lo, hi, n = own.min(0), own.max(0), len(own)
                if t in held:
                    lo, hi, n = np.minimum(lo, held[t][1]), np.maximum(hi, held[t][2]), n + held[t][0]
                held[t] = [n, lo, hi]
        rows = [(t, n, lo.astype(np.int32).tobytes(), hi.astype(np.int32).tobytes()) for t, (n, lo, hi) in held.items()]
        yield from _table("tile int, n long, lo binary, hi binary", rows).to_batches()
    return run


def _one_corner(table: pa.Table) -> pa.Table:
    width = len(table.column("lo")[0].as_py()) // 4
    lo, hi = (_matrix(table.column(c).to_pylist(), width) for c in ("lo", "hi"))
    return _table("tile int, n long, lo binary, hi binary",
                  [(table.column("tile")[0].as_py(), sum(table.column("n").to_pylist()), lo.min(0).astype(np.int32).tobytes(), hi.max(0).astype(np.int32).tobytes())])


def _bounds(lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product that a point of each box can have with q (a little wider than exact)."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    least, most = lo @ up + hi @ down, hi @ up + lo @ down
    return least - 1e-9 * np.abs(least), most + 1e-9 * np.abs(most)


def sort_tile(coordinates: list[np.ndarray], leaf: int) -> np.ndarray:
    """The order of the sort-tile-recursive rule: sort along one coordinate, cut into slabs, go on inside along the next."""
    n, left = len(coordinates[0]), len(coordinates)
    order = np.argsort(coordinates[0], kind="stable")
    if left == 1 or n <= leaf:
        return order
    slabs = int(np.ceil((-(-n // leaf)) ** (1 / left)))
    width = leaf * -(-(-(-n // leaf)) // slabs)
    out = []
    for a in range(0, n, width):
        own = order[a:a + width]
        out.append(own[sort_tile([c[own] for c in coordinates[1:]], leaf)])
    return np.concatenate(out)


class Tree:
    """A packed R-tree over the rows of a block: levels of boxes, leaves first."""

    def __init__(self, x: np.ndarray, label: np.ndarray, k: np.ndarray, row: np.ndarray) -> None:
        spread = np.argsort(-x.astype(float).var(axis=0), kind="stable")
        order = sort_tile([label, *(x[:, d] for d in spread[:2])], LEAF)
        self.x, self.label, self.k, self.row = x[order], label[order], k[order], row[order]
        lo = hi = self.x
        low_label = high_label = self.label
        self.levels, step = [], LEAF
        while True:
            at = np.arange(0, len(lo), step)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            low_label, high_label = np.minimum.reduceat(low_label, at), np.maximum.reduceat(high_label, at)
            self.levels.append((lo.astype(float), hi.astype(float), low_label, high_label))
            step = FAN_OUT
            if len(at) == 1:
                break

    def search(self, q: np.ndarray, label: int, same: bool, row: int, lows: list[int], highs: list[int], kths: list[int], keep: int):
        """For each window the best rows, as (-score, k, row), and the number of boxes looked into."""
        best: list[list[tuple]] = [[] for _ in lows]
        least = np.array([max(a, b) for a, b in zip(lows, kths, strict=True)], np.int64)
        highs = np.array(highs, np.int64)
        qf = q.astype(float)
        queue, opened = [(-np.inf, len(self.levels), 0)], 0
        while queue:
            bound, level, i = heapq.heappop(queue)
            if -bound < least.min():
                break
            opened += 1
            if level == 0:
                a, z = i * LEAF, min((i + 1) * LEAF, len(self.x))
                score = self.x[a:z] @ q
                fits = ((self.label[a:z] == label) == same) & (self.row[a:z] != row)
                for w in range(len(best)):
                    for j in np.flatnonzero(fits & (score >= least[w]) & (score <= highs[w])):
                        best[w].append((-int(score[j]), int(self.k[a + j]), int(self.row[a + j])))
                    if len(best[w]) >= keep:
                        best[w] = heapq.nsmallest(keep, best[w])
                        least[w] = max(int(least[w]), -best[w][-1][0])
                continue
            lo, hi, low_label, high_label = self.levels[level - 1]
            a, z = (0, len(lo)) if level == len(self.levels) else (i * FAN_OUT, min((i + 1) * FAN_OUT, len(lo)))
            under, over = _bounds(lo[a:z], hi[a:z], qf)
            may = ((low_label[a:z] <= label) & (label <= high_label[a:z])) if same else ((low_label[a:z] != label) | (high_label[a:z] != label))
            may &= ((over[:, None] >= least) & (under[:, None] <= highs)).any(1)
            for j in np.flatnonzero(may):
                heapq.heappush(queue, (-float(over[j]), level - 1, a + int(j)))
        return [heapq.nsmallest(keep, b) for b in best], opened


def _deal(tiles: dict, width: int, own: bool, held: int):
    """A pack's queries, to the blocks of their own tile, or of the other tiles whose boxes leave a window open."""
    number = np.array(sorted(tiles))
    lo, hi = (np.stack([tiles[t][c] for t in number.tolist()]).astype(float) for c in (1, 2))

    def run(table: pa.Table) -> pa.Table:
        queries = [r for r in table.to_pylist() if r["lows"]]
        rows = []
        if queries:
            goes = np.zeros((len(queries), len(number)), bool)
            for i, (r, q) in enumerate(zip(queries, _matrix([r["vec"] for r in queries], width).astype(float), strict=True)):
                mine = number == r["tile"]
                if own:
                    goes[i] = mine
                else:
                    under, over = _bounds(lo, hi, q)
                    least = np.maximum(r["lows"], r["kths"])
                    goes[i] = ~mine & ((over[:, None] >= least) & (under[:, None] <= np.array(r["highs"]))).any(1)
            for t in np.flatnonzero(goes.any(0)):
                sent = [r for r, g in zip(queries, goes[:, t], strict=True) if g]
                pack = sent[0]["pack"]
                columns = [[r[c] for r in sent] for c in ("row", "label", "vec", "lows", "highs", "kths")]
                rows += [(pack, int(number[t]), sub, pack // held, *columns) for sub in range(tiles[int(number[t])][3])]
        return _table(DEALT, rows)
    return run


def _search(width: int, same: bool, keep: int, first: dict):
    """Queries against the rows of one block; ``first`` numbers the blocks."""
    def run(rows: pa.Table, packs: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(packs):
            tree = Tree(_matrix(rows.column("vec").to_pylist(), width), *(rows.column(c).to_numpy() for c in ("label", "k", "row")))
            for p in packs.to_pylist():
                found = []
                for i, q in enumerate(_matrix(p["vecs"], width)):
                    best, _ = tree.search(q, p["labels"][i], same, p["rows"][i], p["lows"][i], p["highs"][i], p["kths"][i], keep)
                    found += [(p["rows"][i], w, -s, k, other) for w, own in enumerate(best) for s, k, other in own]
                if found:
                    out.append((p["pack"], first[p["tile"]] + p["sub"], *(list(c) for c in zip(*found, strict=True))))
        return _table(FOUND, out)
    return run


def _best(keep: int):
    """Of all that was found for a pack, the first ``keep`` of each query and window."""
    def run(table: pa.Table) -> pa.Table:
        rows, w, score, k, other = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("rows", "w", "scores", "ks", "others"))
        order = np.lexsort((other, k, -score, w, rows))
        rows, w, score, k, other = rows[order], w[order], score[order], k[order], other[order]
        new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (w[1:] != w[:-1])]))
        rank = np.arange(len(rows)) - np.repeat(new, np.diff(np.append(new, len(rows))))
        at = rank < keep
        head = table.slice(0, 1)
        return _table(FOUND, [(head.column("pack")[0].as_py(), head.column("grp")[0].as_py(), *(c[at].tolist() for c in (rows, w, score, k, other)))])
    return run


def _found(table: pa.Table) -> dict[int, dict[int, list]]:
    """By query and window: (score, k), best first."""
    out: dict[int, dict[int, list]] = {}
    for r in table.to_pylist():
        for row, w, score, k in zip(r["rows"], r["w"], r["scores"], r["ks"], strict=True):
            out.setdefault(row, {}).setdefault(w, []).append((score, k))
    return out


def _with_kth(keep: int):
    def run(queries: pa.Table, found: pa.Table) -> pa.Table:
        best, rows = _found(found), []
        for r in queries.to_pylist():
            own = best.get(r["row"], {})
            kths = [own[w][keep - 1][0] if len(own.get(w, ())) >= keep else -BIG for w in range(len(r["lows"]))]
            rows.append((*(r[c] for c in ("pack", "row", "k", "label", "vec", "tile", "lows", "highs")), kths, r["positives"], r["scores"]))
        return _table(QUERY, rows)
    return run


def _windows(least: int, most: int):
    """Queries for negatives: a window per positive."""
    def run(queries: pa.Table, found: pa.Table) -> pa.Table:
        best, rows = _found(found), []
        for r in queries.to_pylist():
            own = best.get(r["row"], {}).get(0, [])
            lows, highs = [-(-least * s // 100) for s, _ in own], [most * s // 100 for s, _ in own]
            rows.append((*(r[c] for c in ("pack", "row", "k", "label", "vec", "tile")), lows, highs, [-BIG] * len(own), [k for _, k in own], [s for s, _ in own]))
        return _table(QUERY, rows)
    return run


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _listed(queries: pa.Table, found: pa.Table) -> pa.Table:
    best, rows = _found(found), []
    for r in queries.to_pylist():
        for w, negatives in best.get(r["row"], {}).items():
            rows += [(r["k"], r["positives"][w], i, k, r["scores"][w], s) for i, (s, k) in enumerate(negatives, 1)]
    return _table(RESULT, rows)


def hard_negatives(vectors: DataFrame, anchor: Column, *, key: str = "vec_id", embedding: str = "embedding", label: str = "label",
                   positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256) -> DataFrame:
    """For each row for which ``anchor`` holds and each of its ``positives``: the first ``negatives`` rows of other labels whose
    score is ``least`` to ``most`` hundredths of the positive's."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "negatives")
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("e"),
                          F.coalesce(anchor, F.lit(False)).alias("anchor"))
    marked = rows.where("k is not null and label is not null")
    whole = scratch.keep(marked.select("k", "label", F.when(F.size("e") > 0, F.col("e")).alias("e"), "anchor").where("e is not null")
                         .mapInArrow(_whole(scale), "k long, label long, anchor boolean, vec binary, dim int")
                         .withColumn("row", F.monotonically_increasing_id()))
    n, width, anchors = whole.agg(F.count("*"), F.max("dim"), F.count_if("anchor")).first()
    if not anchors:
        return spark.createDataFrame([], RESULT)
    sample = whole.select("k", "row", "vec").orderBy(F.xxhash64("k", "row"), "row").limit(SAMPLE).collect()
    cuts = Cuts(_matrix([bytes(r["vec"]) for r in sample], width), min(TILES, -(-n // TILE)))
    placed = scratch.keep(whole.mapInArrow(_place(cuts, width), "k long, label long, anchor boolean, vec binary, dim int, row long, tile int"))
    corners = placed.select("vec", "tile").mapInArrow(_corners(width), "tile int, n long, lo binary, hi binary").groupBy("tile").applyInArrow(
        _one_corner, "tile int, n long, lo binary, hi binary").collect()
    tiles = {r["tile"]: (r["n"], *(np.frombuffer(bytes(r[c]), np.int32) for c in ("lo", "hi")), -(-r["n"] // BLOCK)) for r in corners}
    first, blocks = {}, 0
    for t in sorted(tiles):
        first[t], blocks = blocks, blocks + tiles[t][3]
    packs = -(-anchors // PACK)
    split = F.broadcast(spark.createDataFrame([(t, v[3]) for t, v in tiles.items()], "tile int, subs int"))
    held = placed.join(split, "tile").select("row", "k", "label", "vec", "tile", F.pmod(F.xxhash64("row"), F.col("subs")).cast("int").alias("sub"))
    held = held.withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((packs - 1) // HELD).cast("long"))))
    none = F.array().cast("array<long>")
    queries = scratch.keep(placed.where("anchor").select(
        F.pmod(F.xxhash64("row"), F.lit(packs)).alias("pack"), "row", "k", "label", "vec", "tile", F.array(F.lit(-BIG)).alias("lows"),
        F.array(F.lit(BIG)).alias("highs"), F.array(F.lit(-BIG)).alias("kths"), none.alias("positives"), none.alias("scores")))

    def merged(found: DataFrame, keep: int) -> DataFrame:
        many = blocks
        while many > FAN:
            many = -(-many // FAN)
            found = found.withColumn("grp", F.pmod("grp", F.lit(many))).groupBy("pack", "grp").applyInArrow(_best(keep), FOUND)
        return found.groupBy("pack").applyInArrow(_best(keep), FOUND)

    def wave(asked: DataFrame, own: bool, same: bool, keep: int) -> DataFrame:
        dealt = asked.groupBy("pack").applyInArrow(_deal(tiles, width, own, HELD), DEALT)
        met = held.groupBy("tile", "sub", "h").cogroup(dealt.groupBy("tile", "sub", "h")).applyInArrow(_search(width, same, keep, first), FOUND)
        return scratch.keep(merged(met, keep))

    def search(asked: DataFrame, same: bool, keep: int) -> DataFrame:
        near = wave(asked, True, same, keep)
        known = scratch.keep(asked.groupBy("pack").cogroup(near.groupBy("pack")).applyInArrow(_with_kth(keep), QUERY))
        return merged(near.union(wave(known, False, same, keep)), keep)

    close = search(queries, True, positives)
    asked = scratch.keep(queries.groupBy("pack").cogroup(close.groupBy("pack")).applyInArrow(_windows(least, most), QUERY))
    return asked.groupBy("pack").cogroup(search(asked, False, negatives).groupBy("pack")).applyInArrow(_listed, RESULT)
