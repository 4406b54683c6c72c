"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

Method. A document is the set of its distinct word n-grams (64-bit hashes; A-Z lower-cased). Documents with
equal sets form one class; classes are joined, copies are members. The global n-gram order is cut into
fragments, each fragment counts on its own, and counts are summed per class or per pair:

1. Probe: the fragments of the lowest ``PROBE`` of the hash range count, per class, the n-grams that no
   other class has. A class that can have a partner misses at most floor((1 - t) * n) n-grams of it, so a
   class with more unshared ones than that is settled: it links with nothing. Most documents end here.
2. The others are ordered exactly: document frequency first, then hash. The rarest n - ceil(t * n) + 1
   n-grams of a set (the prefix) must meet the prefix of any partner.
3. Candidates are counted in the fragments of that order, cut at its quantiles: (pair, fragment) gives a
   partial overlap, the sum per pair decides 100 * overlap >= percent * union.

Large groups of near copies never become all pairs: first every class is compared with one leader per prefix
n-gram, the class whose n-grams are most common, and components merge. Then every prefix list is finished
exactly: all its pairs across different components, except those within the list's largest component. Lists
travel packed; the pairs' common prefix n-grams are counted in a task, and only pairs that can still reach the
threshold leave it. No list and no partner is cut, so components are exact.

Texts are shuffled once, for the classes left after the probe; a sieve of fixed size (a megabyte) keeps most other
texts out of that shuffle. It fills up with the corpus and then saves nothing, but never loses a text.

Results. One row per input row: key, n_shingles, component_id (smallest key reachable by links).

Edge cases. Null or empty text, or no word: n_shingles 0, linked with nothing. Fewer words than n: the whole
sequence is one n-gram. Rows that share a key count as one node with the links of all. A null key has its
n_shingles, a null component_id and no links. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faceoff.llm import text as T
from faceoff.llm.graph import components
from faceoff.llm.packed import pack, pack_sorted, unpack, unpack_sorted
from faceoff.llm.scratch import Scratch

PROBE = 0.375
PART_GRAMS = 4_000_000
LEAST_PARTS = 24
FRAGMENTS = 4
SIEVE_BITS = 1 << 23
CHUNK = 4096


def shingle_sets(block: T.Block, size: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each document of a block."""
    w = T.words(block, lower=True)
    at, grams = T.windows(w.hashes, w.first, size)
    edge = np.searchsorted(at, w.first)
    out = []
    for i, n in enumerate(w.counts):
        if n >= size:
            g = np.sort(grams[edge[i]:edge[i + 1]])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif n:
            h = w.hashes[w.first[i]:w.first[i + 1]]
            out.append(T.mix((h * T.factors(len(h), 9000 + len(h))).sum(keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return tuple(T.signed(T.mix(T.sums(T.mix(every ^ np.uint64(salt)), first))) for salt in (0xA5A5, 0x5A5A5A))


def _sketch(size: int):
    def run(batches):
        for batch in batches:
            n, a, b = [], [], []
            for block in T.blocks(batch.column("t")):
                sets = shingle_sets(block, size)
                n.append(np.array([len(s) for s in sets], np.int64))
                x, y = _set_keys(sets)
                a.append(x)
                b.append(y)
            if n:
                yield pa.RecordBatch.from_arrays([batch.column("k"), *(pa.array(np.concatenate(v)) for v in (n, a, b))],
                                                 ["k", "n", "k1", "k2"])
    return run


def _probe(size: int, parts: int):
    """Rows (part, grams, set keys, grams of each set) of a block's lowest hashes."""
    top = int(PROBE * 2**64)
    width = np.uint64(top // parts + 1)

    def run(batches):
        for batch in batches:
            for block in T.blocks(batch.column("t")):
                sets = shingle_sets(block, size)
                keys, _ = _set_keys(sets)
                low = [s[:int(np.searchsorted(s, np.uint64(top)))] for s in sets]
                owner = np.repeat(np.arange(len(low)), [len(s) for s in low])
                grams = np.concatenate(low)
                part = (grams // width).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edge = np.searchsorted(part[order], np.arange(parts + 1))
                rows = []
                for p in range(parts):
                    mine = order[edge[p]:edge[p + 1]]
                    if len(mine):
                        docs, count = np.unique(owner[mine], return_counts=True)
                        rows.append((p, grams[mine].tobytes(), keys[docs].tobytes(), count.astype(np.uint32).tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                        zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                        ["part", "grams", "sets", "counts"])
    return run


def _unshared(table: pa.Table) -> pa.Table:
    """(set key, number of its n-grams in this part that no other set has)."""
    join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    grams, sets, counts = join("grams", np.uint64), join("sets", np.int64), join("counts", np.uint32)
    owner = np.repeat(sets, counts)
    order = np.lexsort((owner, grams))
    g, o = grams[order], owner[order]
    fresh = np.concatenate([[True], g[1:] != g[:-1]])
    other = np.concatenate([[False], (g[1:] == g[:-1]) & (o[1:] != o[:-1])])
    run = np.cumsum(fresh) - 1
    shared = np.zeros(run[-1] + 1, bool)
    shared[run[other]] = True
    alone = o[fresh][~shared]
    keys, n = np.unique(alone, return_counts=True)
    return pa.table({"k1": keys, "alone": n.astype(np.int64)})


def _sets_of(size: int, parts: int):
    """Rows (part, n-grams, owner of each, class numbers) of the sets whose class is asked for."""
    width = np.uint64(2**64 // parts + 1)

    def run(batches):
        for batch in batches:
            want, numbers = np.asarray(batch.column("k1")), np.asarray(batch.column("c"))
            for block in T.blocks(batch.column("t")):
                sets = shingle_sets(block, size)
                keys, _ = _set_keys(sets)
                own = np.flatnonzero(keys == want[block.lo:block.hi])
                if not len(own):
                    continue
                grams = np.concatenate([sets[i] for i in own])
                owner = np.repeat(np.arange(len(own), dtype=np.uint32), [len(sets[i]) for i in own])
                order = np.argsort(grams)
                edge = np.searchsorted(grams[order] // width, np.arange(parts + 1).astype(np.uint64))
                rows = [(p, pack_sorted(grams[order[x:z]]), pack(owner[order[x:z]]), pack(numbers[block.lo + own]))
                        for p, (x, z) in enumerate(zip(edge, edge[1:], strict=False)) if x < z]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                    zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "grams", "owner", "cs"])
    return run


def _frequencies(blocks: int):
    """The n-grams of a part that several classes have, with their frequency, back to blocks of classes."""
    def run(table: pa.Table) -> pa.Table:
        g = np.concatenate([unpack_sorted(x) for x in table.column("grams").to_pylist()])
        c = np.concatenate([unpack(n, np.int64)[unpack(o, np.uint32)] for o, n in zip(
            table.column("owner").to_pylist(), table.column("cs").to_pylist(), strict=True)])
        order = np.lexsort((c, g))
        g, c = g[order], c[order]
        once = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
        g, c = g[once], c[once]
        run = np.cumsum(np.concatenate([[True], g[1:] != g[:-1]])) - 1
        df = np.bincount(run)[run]
        g, c, df = g[df > 1], c[df > 1], df[df > 1]
        block = np.mod(c, blocks)
        order = np.lexsort((g, c, block))
        g, c, df, block = g[order], c[order], df[order], block[order]
        edge = np.append(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), len(block)) if len(block) else np.zeros(1, np.int64)
        rows = []
        for a, z in zip(edge, edge[1:], strict=False):
            own, n = np.unique(c[a:z], return_counts=True)
            rows.append((int(block[a]), pack(own), pack(n.astype(np.uint32)), pack(g[a:z]), pack(df[a:z].astype(np.uint32))))
        return pa.table({n: pa.array([r[i] for r in rows], pa.int64() if i == 0 else pa.binary()) for i, n in enumerate(("block", "cs", "n", "grams", "df"))})
    return run


def _in_order(table: pa.Table) -> pa.Table:
    """Each class's shared n-grams in the global order."""
    c = np.concatenate([np.repeat(unpack(x, np.int64), unpack(n, np.uint32)) for x, n in zip(
        table.column("cs").to_pylist(), table.column("n").to_pylist(), strict=True)])
    g, df = (np.concatenate([unpack(x, kind) for x in table.column(name).to_pylist()]) for name, kind in (("grams", np.int64), ("df", np.uint32)))
    order = np.lexsort((g, df, c))
    c, g, df = c[order], g[order], df[order].astype(np.int64)
    edge = np.append(np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])), len(c))
    own = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.StructArray.from_arrays([pa.array(df), pa.array(g)], ["df", "g"]))
    return pa.table({"c": pa.array(c[edge[:-1]]), "own": own})


def _finish(percent: int):
    """For each class, its candidates in its lists: those that can still reach the threshold, each once."""
    def run(table: pa.Table) -> pa.Table:
        out = []
        order = np.argsort(table.column("c").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        c = table.column("c").to_numpy()
        edge = np.append(np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])), len(c))
        one = {k: table.column(k).to_numpy() for k in ("n", "alone", "root")}
        for a, z in zip(edge, edge[1:], strict=False):
            lists = table.column("members").slice(a, z - a).combine_chunks()
            y = {k: np.asarray(lists.flatten().field(k)) for k in ("c", "n", "alone", "root", "minor")}
            x = {k: v[a] for k, v in one.items()}
            # where both stand outside the list's largest component, the smaller one counts the pair
            own = (y["root"] != x["root"]) & ~(y["minor"] & (y["c"] < c[a]))
            least = np.minimum(x["n"] - x["alone"], y["n"] - y["alone"])
            own &= 100 * least >= percent * np.maximum(x["n"] + y["alone"], y["n"] + x["alone"])
            who, at, k = np.unique(y["c"][own], return_index=True, return_counts=True)
            n = y["n"][own][at]
            out.append((np.full(len(who), c[a]), who, np.full(len(who), x["n"]), n, k))
        a, b, n, m, k = (np.concatenate(v) for v in zip(*out, strict=True))
        swap = a > b
        return pa.table({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "n": np.where(swap, m, n), "m": np.where(swap, n, m), "k": k})
    return run


def _ordered(batch: pa.RecordBatch):
    """The lists of (df, g) of a batch: edges, frequencies and n-grams."""
    own = batch.column("own")
    flat = own.flatten()
    return np.asarray(own.offsets) - own.offsets[0].as_py(), np.asarray(flat.field(0)), np.asarray(flat.field(1))


def _cut_order(pivots: np.ndarray):
    """Each set's n-grams by fragment of the global order; its list is in that order already."""
    def run(batches):
        for batch in batches:
            edge, df, g = _ordered(batch)
            if not len(g):
                continue
            owner = np.repeat(np.arange(len(batch)), np.diff(edge))
            fragment = np.searchsorted(pivots, df + g / 2.0**64, "left")
            first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (fragment[1:] != fragment[:-1])]))
            bounds = pa.array(np.append(first, len(g)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("c").take(pa.array(owner[first])), pa.array(fragment[first].astype(np.int32)),
                                              pa.ListArray.from_arrays(bounds, pa.array(g))], ["c", "f", "g"])
    return run


def _prefixes(percent: int):
    """The n-grams of each set's prefix that other sets have, with its size, unshared n-grams and mean log frequency."""
    def run(batches):
        for batch in batches:
            edge, df, g = _ordered(batch)
            n, size = np.asarray(batch.column("n")), np.diff(edge)
            length = np.clip(n - (n * percent + 99) // 100 + 1 - (n - size), 0, size)
            weight = T.sums(np.log2(df), edge) / n
            row = np.repeat(np.arange(len(batch)), length)
            if not len(row):
                continue
            at = np.repeat(edge[:-1], length) + np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
            yield pa.RecordBatch.from_arrays([batch.column("c").take(pa.array(row)), pa.array(n[row]), pa.array((n - size)[row]),
                                              pa.array(weight[row]), pa.array(g[at])], ["c", "n", "alone", "weight", "g"])
    return run


def _linked_classes(rows: DataFrame, classes: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame:
    """Edges between class numbers that join everything that links join."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(LEAST_PARTS, -(-int(total * PROBE) // PART_GRAMS))
    alone = (rows.mapInArrow(_probe(size, parts), "part int, grams binary, sets binary, counts binary")
             .groupBy("part").applyInArrow(_unshared, "k1 long, alone long").groupBy("k1").agg(F.sum("alone").alias("alone")))
    spare = F.col("n") - F.floor((F.col("n") * percent + 99) / 100)
    left = scratch.keep(classes.join(alone, "k1", "left").where(F.coalesce("alone", F.lit(0)) <= spare).select("c", "rep", "k1", "n"))
    # a sieve of fixed size: which hashes of keys are asked for at all
    slot = F.pmod(F.xxhash64("k"), F.lit(SIEVE_BITS))
    sieve = left.select(F.col("rep").alias("k")).withColumn("s", slot).groupBy((F.col("s") / 64).cast("long").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits"))
    sieve = F.broadcast(sieve)                                  # at most SIEVE_BITS / 64 rows
    asked = rows.withColumn("s", slot).withColumn("word", (F.col("s") / 64).cast("long")).join(sieve, "word").where(
        F.expr("(shiftright(bits, cast(s % 64 as int)) & 1L) = 1L")).select("k", "t")
    size_left = left.agg(F.sum("n")).first()[0] or 0
    blocks = max(2 * LEAST_PARTS, -(-int(size_left) // PART_GRAMS))
    shared = scratch.keep(
        asked.join(left.select(F.col("rep").alias("k"), "k1", "c"), "k").select("c", "k1", "t")
        .mapInArrow(_sets_of(size, blocks), "part int, grams binary, owner binary, cs binary")
        .groupBy("part").applyInArrow(_frequencies(blocks), "block long, cs binary, n binary, grams binary, df binary")
        .groupBy("block").applyInArrow(_in_order, "c long, own array<struct<df: long, g: long>>"))
    pivots = shared.select(F.explode("own").alias("o")).select((F.col("o.df") + F.col("o.g") / 2.0**64).alias("x")).agg(
        F.percentile_approx("x", [i / FRAGMENTS for i in range(1, FRAGMENTS)], 1000)).first()[0] or []
    pieces = scratch.keep(shared.mapInArrow(_cut_order(np.array(pivots)), "c long, f int, g array<long>"))
    sized = shared.join(left.select("c", "n"), "c")
    lists = scratch.keep(sized.select("c", "n", "own").mapInArrow(_prefixes(percent), "c long, n long, alone long, weight double, g long"))
    scratch.drop(shared)

    def reach(a: str, b: str):
        """Whether two classes can still reach the threshold, by sizes and unshared n-grams."""
        n, m, x, y = (F.col(f"{p}.{q}") for q in ("n", "alone") for p in (a, b))
        return 100 * F.least(n - x, m - y) >= percent * F.greatest(n + y, m + x)

    def links(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, n, m) at or over the threshold: partial overlaps by fragment, summed per pair."""
        one = pairs.join(pieces.select(F.col("c").alias("a"), "f", F.col("g").alias("ga")), "a")
        part = one.join(pieces.select(F.col("c").alias("b"), "f", F.col("g").alias("gb")), ["b", "f"]).select(
            "a", "b", "n", "m", F.size(F.array_intersect("ga", "gb")).alias("overlap"))
        return part.groupBy("a", "b", "n", "m").agg(F.sum("overlap").alias("o")).where(
            100 * F.col("o") >= percent * (F.col("n") + F.col("m") - F.col("o"))).select("a", "b")

    def with_roots(roots: DataFrame | None) -> DataFrame:
        """The lists that are not in one component yet, and which component has most of each."""
        now = lists.withColumn("root", F.col("c")) if roots is None else lists.join(
            roots.select(F.col("v").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
        by_root = now.groupBy("g", "root").agg(F.count("*").alias("k"))
        major = by_root.groupBy("g").agg(F.max_by("root", F.struct("k", "root")).alias("major"), F.count("*").alias("roots")).where("roots > 1")
        return scratch.keep(now.join(major, "g").select("g", "c", "n", "alone", "weight", "root", "major"))

    # every class with one leader per list
    open_lists = with_roots(None)
    leader = open_lists.groupBy("g").agg(F.max_by(F.struct("c", "n", "alone", "root"), F.struct("weight", "c")).alias("y"))
    star = open_lists.join(leader, "g").select(F.struct("c", "n", "alone", "root").alias("x"), "y")
    pairs = star.where((F.col("x.c") != F.col("y.c")) & reach("x", "y")).select(
        F.when(F.col("x.c") < F.col("y.c"), F.struct("x", "y")).otherwise(F.struct(F.col("y").alias("x"), F.col("x").alias("y"))).alias("p")
    ).select(F.col("p.x.c").alias("a"), F.col("p.y.c").alias("b"), F.col("p.x.n").alias("n"), F.col("p.y.n").alias("m")).distinct()
    found = scratch.keep(links(pairs))
    roots = components(found, scratch)

    # the rest of every list, exactly
    open_lists = with_roots(roots)
    most = open_lists.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    chunk = F.pmod(F.xxhash64("c"), F.lit(-(-most // CHUNK) or 1))
    members = open_lists.groupBy("g", chunk.alias("chunk")).agg(F.collect_list(F.struct(
        "c", "n", "alone", "root", (F.col("root") != F.col("major")).alias("minor"))).alias("members"))
    few = open_lists.where("root <> major").select("g", "c", "n", "alone", "root")
    could = few.join(members, "g").withColumn("bucket", F.pmod(F.xxhash64("c"), F.lit(16 * blocks))).groupBy("bucket", "chunk").applyInArrow(
        _finish(percent), "a long, b long, n long, m long, k long")
    # a pair found from both sides, in different lists, has the sum of both
    could = could.groupBy("a", "b", "n", "m").agg(F.sum("k").alias("k"))
    need = lambda n: F.floor((F.col(n) * percent + 99) / 100)
    bound = F.col("k") + F.greatest(need("n"), need("m")) - 1         # common prefix n-grams, and all behind the prefix
    could = could.where(bound * (100 + percent) >= percent * (F.col("n") + F.col("m"))).drop("k")
    more = scratch.keep(links(could))
    return roots.select(F.col("v").alias("a"), F.col("root").alias("b")).union(more)


def jaccard_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5,
                       percent: int = 80) -> DataFrame:
    """One row per document: key, n_shingles, component_id."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    sketch = scratch.keep(rows.mapInArrow(_sketch(size), "k long, n long, k1 long, k2 long"))
    # class numbers are those of a stored table: they don't change when a task runs again
    classes = scratch.keep(sketch.where("n > 0 and k is not null").groupBy("k1", "k2").agg(F.min("k").alias("rep"), F.first("n").alias("n"))
                           .withColumn("c", F.monotonically_increasing_id()))
    edges = _linked_classes(rows.where("k is not null"), classes, scratch, size, percent)
    # a key with rows of several classes joins them
    number = sketch.where("n > 0 and k is not null").join(classes.select("k1", "k2", "c"), ["k1", "k2"]).select("k", "c")
    several = number.groupBy("k").agg(F.min("c").alias("a"), F.max("c").alias("z")).where("a < z")
    several = number.join(several, "k").select("a", F.col("c").alias("b"))
    roots = components(edges.union(several), scratch)
    smallest = (classes.join(roots.select(F.col("v").alias("c"), "root"), "c", "left")
                .select("k1", "k2", "rep", F.coalesce("root", "c").alias("root")))
    least = smallest.groupBy("root").agg(F.min("rep").alias("least"))
    ids = smallest.join(least, "root").select("k1", "k2", "least")
    return sketch.join(ids, ["k1", "k2"], "left").select(
        F.col("k").cast(kind).alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("k")).when(F.col("k").isNotNull(), F.col("least")).alias("component_id"))
