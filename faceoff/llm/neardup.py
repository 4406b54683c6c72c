"""Embedding near-dedup by NN-descent.

Method. Vectors are compared by cosine within equal labels (and equal dimensions). Exactly equal vectors are one class
with a count. A neighbour graph of the classes starts from random-projection leaves (sign codes of a few hundred vectors
each, compared by brute force inside the leaf) and is refined by NN-descent: every vector's neighbours, forward and
reverse, are compared with each other, and whoever finds nearer neighbours takes them. Edges at or over the threshold
form candidate components. A list that is full of such edges is saturated: it may hide links to vectors of other
components. So lists are enlarged: further passes over fresh leaves only look outside the own component, until a pass
joins nothing. Links are then exact inside a component: its members are compared in blocks, in double precision, and
only counts and a spanning forest leave a task, never pairs. An audit compares a fixed number of vectors with all rows
by brute force. Passes go on, each over one more tree of leaves than the last, until both the share of the audited links that
were found and the share of the audited vectors that have all of theirs reach RECALL; a huge component cannot outweigh missed pairs.

Scale. Leaves and blocks have bounded sizes; an over-full leaf is split by hash. A component of s classes costs s / BLOCK
copies of each of its vectors. Equal vectors, even a third of all rows, are one class.

Results. One row per vector: key, n_links (other vectors linked directly), component_id (smallest key reachable), kept
(key = component_id). ``near_edges`` are not expanded.

Edge cases. Null, empty and zero vectors, null or non-finite components, a null label: no links, the own component. A null
key: n_links as others, a null component_id, not kept. Rows that share a key are vectors of their own with one name.
Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faceoff.llm.graph import components
from faceoff.llm.scratch import Scratch

LEAF, LIST, TREES, STEPS = 384, 8, 3, 2
BLOCK = 256
BUCKET_ROWS = 2_000
LEAST_BUCKETS = 48
SLACK = 1e-4
AUDIT, RECALL = 500, 0.99


def _prepare(batches):
    """(k, label, raw, unit, dim): a vector's doubles, or nulls where it can have no links."""
    for batch in batches:
        column = batch.column("e")
        raw, unit, dim = [], [], []
        flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(float("nan")))
        edge = np.asarray(column.offsets).astype(np.int64)
        edge = edge - edge[0]
        null = np.asarray(column.is_null())
        no_label = np.asarray(batch.column("label").is_null())
        at = np.zeros(len(column) + 1, np.int64)
        np.cumsum(np.where(null, 0, np.diff(edge)), out=at[1:])
        for i in range(len(column)):
            x = flat[at[i]:at[i + 1]] + 0.0
            with np.errstate(all="ignore"):
                top = np.abs(x).max() if len(x) else 0.0
                ok = not null[i] and not no_label[i] and len(x) > 0 and np.isfinite(x).all() and top > 0
                y = x / top if ok else x                    # no overflow of squares
            raw.append(x.tobytes() if ok else None)
            unit.append((y / np.sqrt(y @ y)).tobytes() if ok else None)
            dim.append(len(x) if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("label"), pa.array(raw, pa.binary()), pa.array(unit, pa.binary()),
                                          pa.array(dim, pa.int32())], ["k", "label", "raw", "unit", "dim"])


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _codes(trees: list[int]):
    """(c, grp, tree, code): the sign code of each vector in each tree."""
    def run(batches):
        for batch in batches:
            dims, bits = np.asarray(batch.column("dim")), np.asarray(batch.column("bits"))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = _matrix(batch.column("unit").take(pa.array(at)), int(dim))
                for tree in trees:
                    most = int(bits[at].max())
                    plane = np.random.default_rng([tree, int(dim)]).normal(size=(int(dim), 40))[:, :most]
                    code = ((x @ plane > 0) * (np.arange(most) < bits[at][:, None]) @ (1 << np.arange(most, dtype=np.int64))) if most else np.zeros(len(at), np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column("c").take(pa.array(at)), batch.column("grp").take(pa.array(at)),
                                                      pa.array(np.full(len(at), tree, np.int32)), pa.array(code.astype(np.int64))], ["c", "grp", "tree", "code"])
    return run


def _top(sim: np.ndarray, c: np.ndarray, keep: int, least: float = -2.0):
    """Rows (u, v, s): the ``keep`` best of each row of a similarity matrix."""
    keep = min(keep, sim.shape[1])
    at = np.argpartition(-sim, keep - 1, axis=1)[:, :keep]
    s = np.take_along_axis(sim, at, 1)
    u, v = np.repeat(c, keep), c[at].ravel()
    ok = (u != v) & (s.ravel() > least)
    return u[ok], v[ok], s.ravel()[ok]


def _edges(u, v, s) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "s": pa.array(s, pa.float64())})


def _leaf(outside: float | None):
    """Nearest neighbours inside a leaf; with ``outside``, only of other components and at least that near."""
    def run(table: pa.Table) -> pa.Table:
        c = table.column("c").to_numpy()
        dim = table.column("dim")[0].as_py()
        x = _matrix(table.column("unit"), dim)
        sim = x @ x.T
        np.fill_diagonal(sim, -3)
        if outside is None:
            return _edges(*_top(sim, c, LIST, -2.0))
        root = table.column("root").to_numpy()
        sim[root[:, None] == root[None, :]] = -3
        return _edges(*_top(sim, c, 2, outside))
    return run


def _local_join(table: pa.Table) -> pa.Table:
    """Compare the neighbours of every vertex with each other; keep what improves a list."""
    u, v, kth = (table.column(n).to_numpy() for n in ("u", "v", "kth"))
    dim = table.column("dim").to_numpy()
    order = np.lexsort((v, u))
    u, v, kth, dim = u[order], v[order], kth[order], dim[order]
    units = table.column("unit").take(pa.array(order)).to_pylist()
    edge = np.append(np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])), len(u))
    out = []
    for a, z in zip(edge, edge[1:], strict=False):
        if z - a < 2:
            continue
        x = np.frombuffer(b"".join(units[a:z]), np.float64).reshape(-1, int(dim[a]))
        sim = x @ x.T
        np.fill_diagonal(sim, -3)
        i, j = np.nonzero(sim > kth[a:z][:, None])
        if len(i):
            out.append((v[a:z][i], v[a:z][j], sim[i, j]))
    if not out:
        return _edges(*(np.zeros(0),) * 3)
    p, q, s = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((q, p))
    p, q, s = p[order], q[order], s[order]
    once = np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
    return _edges(p[once], q[once], s[once])


def _block(threshold: float):
    """Two blocks of one component: links of each class in number of vectors, and a spanning forest of the links."""
    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        side = table.column("chunk").to_numpy()
        c, m = table.column("c").to_numpy(), table.column("m").to_numpy()
        x = _matrix(table.column("unit"), table.column("dim")[0].as_py())
        a, b = (np.flatnonzero(side == k) for k in (i, j))
        link = x[a] @ x[b].T >= threshold
        if i == j:
            np.fill_diagonal(link, False)
        rows = [(c[a], link @ m[b].astype(np.float64))]
        if i != j:
            rows.append((c[b], m[a].astype(np.float64) @ link))
        seen = np.zeros(len(c), bool)
        forest = []
        for start in range(len(a)):                         # breadth first over the two sides
            if seen[a[start]]:
                continue
            seen[a[start]] = True
            todo = [(0, start)]
            while todo:
                which, k = todo.pop()
                near, own = ((b, link[k]) if which == 0 else (a, link[:, k]))
                fresh = np.flatnonzero(own & ~seen[near])
                seen[near[fresh]] = True
                me = (a if which == 0 else b)[k]
                forest.append(np.stack([np.full(len(fresh), c[me]), c[near[fresh]]]))
                todo += [(1 - which, int(f)) for f in fresh] if i != j else [(0, int(f)) for f in fresh]
        f = np.concatenate(forest, axis=1) if forest else np.zeros((2, 0), np.int64)
        ids = np.concatenate([r[0] for r in rows])
        n = np.concatenate([r[1] for r in rows]).round().astype(np.int64)
        pad = np.zeros(f.shape[1], np.int64)
        return pa.table({"c": np.concatenate([ids, f[0]]), "n": np.concatenate([n, pad]),
                         "to": pa.array(np.concatenate([np.full(len(ids), -1), f[1]]).astype(np.int64))})
    return run


def _audit(threshold: float, probes: dict):
    """Links of the audited vectors, counted over all rows; those within 1e-12 of the threshold hang on rounding and do not count."""
    def run(batches):
        total = {g: np.zeros(len(p[0]), np.int64) for g, p in probes.items()}
        for batch in batches:
            grp = np.asarray(batch.column("grp"))
            for g in np.unique(grp):
                if int(g) in probes:
                    at = pa.array(np.flatnonzero(grp == g))
                    c, x = probes[int(g)]
                    y = _matrix(batch.column("unit").take(at), x.shape[1])
                    link = (x @ y.T >= threshold + 1e-12) & (c[:, None] != np.asarray(batch.column("c").take(at))[None, :])
                    total[int(g)] += link @ np.asarray(batch.column("m").take(at))
        rows = [(int(k), int(n)) for g, p in probes.items() for k, n in zip(p[0], total[g], strict=True) if n]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["c", "n"])
    return run


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    threshold: float = 0.93) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neardup")
    kind = dict(vectors.dtypes)[key]
    label_kind = dict(vectors.dtypes)[label]
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("e"))
    ready = scratch.keep(rows.mapInArrow(_prepare, f"k long, label {label_kind}, raw binary, unit binary, dim int"))
    valid = ready.where("raw is not null")
    groups = scratch.keep(valid.groupBy("label", "dim").agg(F.count_distinct("raw").alias("size")).withColumn("grp", F.monotonically_increasing_id()))
    classes = valid.groupBy("label", "dim", "raw").agg(F.min("k").alias("rep"), F.count("*").alias("m"), F.first("unit").alias("unit"))
    bits = F.greatest(F.lit(0), F.least(F.lit(40), F.ceil(F.log2(F.col("size") / LEAF)))).cast("int")
    v = scratch.keep(classes.join(groups, ["label", "dim"]).withColumn("bits", bits).withColumn("c", F.monotonically_increasing_id())
                     .select("c", "grp", "label", "dim", "raw", "rep", "m", "unit", "bits"))
    n = v.count()
    buckets = max(LEAST_BUCKETS, -(-n * 2 * LIST // (BUCKET_ROWS * 8)))
    vec = v.select("c", "dim", "unit")

    def leaves(trees: list[int]) -> DataFrame:
        code = v.select("c", "grp", "dim", "unit", "bits").mapInArrow(_codes(trees), "c long, grp long, tree int, code long")
        over = code.groupBy("grp", "tree", "code").agg(F.ceil(F.count("*") / (2 * LEAF)).alias("parts"))
        return code.join(over, ["grp", "tree", "code"]).select(
            "c", F.xxhash64("grp", "tree", "code", F.pmod(F.xxhash64("c", "tree"), F.col("parts"))).alias("leaf"))

    def nearest(edges: DataFrame, keep: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
        return edges.groupBy("u", "v").agg(F.max("s").alias("s")).withColumn("r", rank).where(F.col("r") <= keep).drop("r")

    graph = scratch.keep(nearest(leaves(list(range(TREES))).join(vec, "c").groupBy("leaf").applyInArrow(_leaf(None), "u long, v long, s double"), LIST))
    for _ in range(STEPS):
        both = nearest(graph.union(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s")), 2 * LIST)
        kth = graph.groupBy("u").agg(F.min("s").alias("kth")).withColumnRenamed("u", "v")
        lists = both.join(kth, "v", "left").join(vec.withColumnRenamed("c", "v"), "v").select(
            "u", "v", F.coalesce("kth", F.lit(-1.0)).alias("kth"), "dim", "unit", F.pmod(F.xxhash64("u"), F.lit(buckets)).alias("bucket"))
        better = lists.groupBy("bucket").applyInArrow(_local_join, "u long, v long, s double")
        new = scratch.keep(nearest(graph.union(better), LIST))
        scratch.drop(graph)
        graph = new

    near = graph.where(F.col("s") >= threshold - SLACK).select(F.col("u").alias("a"), F.col("v").alias("b"))
    roots = components(near, scratch)
    tree = TREES
    width = 1
    while True:
        # saturated lists: look outside the own component until nothing joins
        while True:
            named = v.select("c", "dim", "unit").join(roots.withColumnRenamed("v", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
            more = scratch.keep(leaves(list(range(tree, tree + width))).join(named, "c").groupBy("leaf").applyInArrow(_leaf(threshold - SLACK), "u long, v long, s double"))
            tree += width
            if more.isEmpty():
                break
            roots = components(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).union(more.select("u", "v")), scratch)
        counted = _counts(v, roots, threshold, scratch)
        if _recall(v, counted, threshold) >= RECALL:
            break
        scratch.drop(counted)
        width += 1
    exact = components(counted.where("to >= 0").select(F.col("c").alias("a"), F.col("to").alias("b")), scratch)
    links = counted.groupBy("c").agg(F.sum("n").alias("n"))
    final = (v.select("c", "label", "dim", "raw", "rep", "m").join(links, "c", "left").join(exact.withColumnRenamed("v", "c"), "c", "left")
             .withColumn("root", F.coalesce("root", "c")))
    least = final.groupBy("root").agg(F.min("rep").alias("least"))
    final = final.join(least, "root").select("label", "dim", "raw", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "least")
    return ready.join(final, ["label", "dim", "raw"], "left").select(
        F.col("k").cast(kind).alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("k").isNotNull(), F.coalesce("least", "k")).alias("component_id"),
        F.coalesce(F.col("k") == F.coalesce("least", "k"), F.lit(False)).alias("kept"))


def _counts(v: DataFrame, roots: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(c, n, to): partial link counts of each class, and links of a spanning forest (to >= 0)."""
    members = roots.withColumnRenamed("v", "c")
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    placed = members.join(sizes, "root").withColumn("chunk", F.pmod(F.xxhash64("c"), F.col("chunks"))).join(v.select("c", "m", "dim", "unit"), "c")
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("long") - 1))).select(
        "root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "c", "m", "dim", "unit")
    return scratch.keep(pairs.groupBy("root", "i", "j").applyInArrow(_block(threshold), "c long, n long, to long"))


def _recall(v: DataFrame, counted: DataFrame, threshold: float) -> float:
    """The lower of two shares: audited links that were found, and audited vectors with links that have all of them."""
    chosen = v.select("c", "grp", "dim", "unit").orderBy(F.xxhash64("c", F.lit(20)), "c").limit(AUDIT).collect()
    probes = {}
    for r in chosen:
        probes.setdefault(r["grp"], []).append(r)
    packed = {g: (np.array([r["c"] for r in rs]), np.frombuffer(b"".join(bytes(r["unit"]) for r in rs), np.float64).reshape(-1, rs[0]["dim"]))
              for g, rs in probes.items()}
    if not packed:
        return 1.0
    true = v.select("c", "grp", "m", "unit").mapInArrow(_audit(threshold, packed), "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    found = counted.groupBy("c").agg(F.sum("n").alias("found"))
    have = F.coalesce("found", F.lit(0))
    total, got, whole = true.join(found, "c", "left").agg(F.sum("n"), F.sum(F.least("n", have)), F.avg((have >= F.col("n")).cast("int"))).first()
    return min(got / total, whole) if total else 1.0
