"""Approximate nearest neighbours: an NN-descent graph and greedy search on it.

Rows with equal vectors are one node.  The graph starts from ``forest`` orders of the
nodes, each by signs and values of random projections: nodes that stand together in
an order, in blocks of ``leaf``, are compared in full.  NN-descent then joins each
node with its neighbours' vectors, neighbours in either direction, and compares them
with one another: a neighbour of a neighbour is likely a neighbour.  A comparison is
made once, where one of the two is new to the node's list, and is kept if it beats the
worst neighbour of either end.  Iterations end, after ``least_iterations``, when few edges are found,
however many that takes.

A query that is itself a row starts from its own node.  Greedy search expands the best
``beam`` unexpanded nodes it knows, over edges of both directions, until no query's best
``beam`` has an unexpanded node.  Neither is cut off: ``guard`` turns without an end are an
error.  Cosines on the way are of unit vectors in half precision; the best candidates are scored anew from the original vectors in double.

Every step is a join or a window of slim rows over nodes; lists are bounded by
``k`` and ``sample`` (hubs keep a hashed sample of the lists they occur in during one
iteration), so no group grows with the data.  A class of equal vectors gives its
``top + 1`` smallest ids to the answer, which is all that ties by id can use.

Defined results: rows with a null id or a vector that is null, empty, zero or holds
nulls or non-finite numbers take no part, nor do vectors of another length than the
most frequent (of equals the greater); repeated rows of an id answer once; fewer than
``top`` candidates give fewer rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabqa.llm.common import n_partitions, ship
from tabqa.session import pin

ship(__name__)


@dataclass(frozen=True)
class AnnParams:
    top: int = 5
    k: int = 30  # neighbours of a node in the graph
    forest: int = 12
    leaf: int = 2048
    sample: int = 15  # of each kind of neighbour joined in an iteration
    least_iterations: int = 2
    least_change: float = 0.03  # share of edges that an iteration still finds when iterations end
    beam: int = 64
    guard: int = 200  # iterations or rounds that raise an error
    rescore: int = 64  # candidates scored in double
    seed: int = 7


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two vectors in double precision; those whose squares would vanish or overflow are scaled by a power of two."""

    def scaled(v: Column) -> Column:
        v = F.transform(v, lambda c: c.cast("double"))
        top = F.array_max(F.transform(v, lambda c: F.abs(c)))
        by = lambda f: F.transform(v, lambda c: c * F.lit(f))
        return F.when(top < 1e-100, by(2.0**600)).when(top > 1e100, by(2.0**-600)).otherwise(v)

    x, y = scaled(x), scaled(y)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, u: s + u)
    return dot(x, y) / F.sqrt(dot(x, x)) / F.sqrt(dot(y, y))


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector, node``: the rows that take part; ``node`` hashes the vector."""
    x = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector")).where(F.col("id").isNotNull() & (F.size("vector") > 0))
    fine = F.forall("vector", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists("vector", lambda v: v != 0)
    x = x.where(fine)
    lengths = x.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    if lengths:
        x = x.where(F.size("vector") == lengths[0]["n"])
    return x.withColumn("node", F.xxhash64(F.transform("vector", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v.cast("double")))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a binary column of equal lengths as half-precision vectors."""
    n = len(column)
    if not n:
        return np.zeros((0, 0), np.float32)
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(n, -1).astype(np.float32)


def _packed(rows: DataFrame, p: AnnParams, n: int) -> DataFrame:
    """``node, vec, keys``: unit vectors in half precision and their places in the orders of the forest."""
    bits = max(0, round(np.log2(max(1, n / p.leaf))))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            if not b.num_rows:
                continue
            v = np.asarray(b.column("vector").flatten(), np.float64).reshape(b.num_rows, -1)
            v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            keys = np.zeros((len(v), p.forest))
            for r in range(p.forest):
                planes = np.random.default_rng(p.seed * 1000 + r).standard_normal((bits + 1, v.shape[1]))
                side = v @ (planes / np.linalg.norm(planes, axis=1, keepdims=True)).T
                code = np.zeros(len(v))
                last = np.zeros(len(v), bool)
                for j in range(bits):  # signs as a Gray code: cells next to each other differ in one sign
                    last = last ^ (side[:, j] > 0)
                    code = code * 2 + last
                keys[:, r] = code + 0.999 * (side[:, bits] + 1) / 2
            vec = pa.array([x.tobytes() for x in v.astype(np.float16)], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * p.forest), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("node"), vec, lists], names=["node", "vec", "keys"])

    return rows.select("node", "vector").mapInArrow(run, "node bigint, vec binary, keys array<double>")


_EDGES = "src bigint, dst bigint, sim float"


def _edges(src, dst, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(sim, pa.float32())], names=["src", "dst", "sim"])


def _start(nodes: DataFrame, p: AnnParams, n: int) -> DataFrame:
    """Edges of all comparisons within blocks of the forest's orders, the ``k`` best of each node and block.

    The orders are dealt out together, by (order, place), and a task cuts what it
    gets into blocks.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            k = min(p.k, len(ids) - 1)
            for at in range(0, len(ids), 512):  # some rows at a time, which bounds the products held
                rows = np.arange(at, min(at + 512, len(ids)))
                s = -(v[rows] @ v.T)
                s[np.arange(len(rows)), rows] = 2
                best = np.argpartition(s, k - 1, axis=1)[:, :k]
                yield _edges(np.repeat(ids[rows], k), ids[best].ravel(), -np.take_along_axis(s, best, 1).ravel())

        def blocks(ids: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            for part in np.array_split(np.arange(len(ids)), max(1, len(ids) // p.leaf)):
                if len(part) > 1:
                    yield from block(ids[part], v[part])

        order, ids, vecs = -1, np.zeros(0, np.int64), np.zeros((0, 0), np.float32)
        for b in parts:
            now, new, m = b.column("r").to_numpy(), b.column("node").to_numpy(), _matrix(b.column("vec"))
            for r in np.unique(now):
                mine = now == r
                if r != order:
                    yield from blocks(ids, vecs)
                    order, ids, vecs = r, new[mine], m[mine]
                else:
                    ids, vecs = np.concatenate([ids, new[mine]]), np.concatenate([vecs, m[mine]])
                while len(ids) >= 2 * p.leaf:
                    yield from block(ids[: p.leaf], vecs[: p.leaf])
                    ids, vecs = ids[p.leaf :], vecs[p.leaf :]
        yield from blocks(ids, vecs)

    parts = max(1, min(n_partitions(nodes.sparkSession), n * p.forest // (4 * p.leaf)))
    ordered = nodes.select("node", "vec", F.posexplode("keys").alias("r", "key"))
    ordered = ordered.repartitionByRange(parts, "r", "key", "node").sortWithinPartitions("r", "key", "node")
    return ordered.select("r", "node", "vec").mapInArrow(run, _EDGES)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` best edges of each source; ``new`` if it has not been joined, ``found`` if it was not known before."""
    once = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("new").alias("new"), F.min("found").alias("found"))
    w = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs among the members of a centre, from rows sorted by centre; a few hundred centres at a time."""

    def settle(c: np.ndarray, member: np.ndarray, new: np.ndarray, floor: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        sizes = np.diff(np.r_[starts, len(c)])
        g, m = len(starts), int(sizes.max())
        row, col = np.repeat(np.arange(g), sizes), np.arange(len(c)) - np.repeat(starts, sizes)
        x = np.zeros((g, m, v.shape[1]), np.float32)
        x[row, col] = v
        ids, fresh, worst = np.zeros((g, m), np.int64), np.zeros((g, m), bool), np.full((g, m), 9.0, np.float32)
        ids[row, col], fresh[row, col], worst[row, col] = member, new, floor
        sims = np.matmul(x, x.transpose(0, 2, 1))
        live = np.zeros((g, m), bool)
        live[row, col] = True
        pair = (fresh[:, :, None] | fresh[:, None, :]) & live[:, :, None] & live[:, None, :] & (ids[:, :, None] != ids[:, None, :]) & (sims > worst[:, :, None])
        a, i, j = np.nonzero(pair)
        return _edges(ids[a, i], ids[a, j], sims[a, i, j])

    held: list = []
    for b in parts:
        if not b.num_rows:
            continue
        now = [b.column(n).to_numpy(zero_copy_only=False) for n in ("centre", "member", "new", "floor")] + [_matrix(b.column("vec"))]
        held = now if not held else [np.concatenate([h, x]) for h, x in zip(held, now, strict=True)]
        at = 0
        edges = np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]])
        for to in range(256, len(edges), 256):  # the last centre may go on in the next batch
            yield settle(*[h[edges[at] : edges[to]] for h in held])
            at = to
        held = [h[edges[at] :] for h in held]
    if held and len(held[0]):
        edges = np.append(np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]]), len(held[0]))
        for at in range(0, len(edges) - 1, 256):
            yield settle(*[h[edges[at] : edges[min(at + 256, len(edges) - 1)]] for h in held])


def graph(nodes: DataFrame, p: AnnParams, n: int) -> DataFrame:
    """``src, dst, sim``: the neighbour lists that NN-descent ends with."""
    fresh = lambda e: e.withColumns({"new": F.lit(True), "found": F.lit(True)})
    known = pin(_best(fresh(_start(nodes, p, n)), p.k), "ann-graph")
    vectors = nodes.select("node", "vec")
    for turn in range(p.guard):
        # Of each node's list the best of the new and of the old; of the lists it occurs in, a hashed sample.
        out = Window.partitionBy("src", "new").orderBy("rank")
        back = Window.partitionBy("dst", "new").orderBy(F.xxhash64(F.lit(turn), "src", "dst"), "src")
        used = known.withColumn("at", F.row_number().over(out)).where(F.col("at") <= p.sample)
        forward = used.select(F.col("src").alias("centre"), F.col("dst").alias("member"), "new")
        reverse = known.withColumn("at", F.row_number().over(back)).where(F.col("at") <= p.sample).select(F.col("dst").alias("centre"), F.col("src").alias("member"), "new")
        members = forward.unionByName(reverse).groupBy("centre", "member").agg(F.max("new").alias("new"))
        floor = known.groupBy("src").agg(F.min("sim").alias("least"), F.count(F.lit(1)).alias("n")).select(F.col("src").alias("node"), F.when(F.col("n") >= p.k, F.col("least")).otherwise(-2.0).cast("float").alias("floor"))
        vecs = vectors.join(floor, "node", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0).cast("float")))
        rows = members.join(vecs, F.col("member") == F.col("node")).select("centre", "member", "new", "floor", "vec")
        found = rows.repartition(n_partitions(nodes.sparkSession), "centre").sortWithinPartitions("centre").mapInArrow(_compare, _EDGES)
        # A new edge that has been joined is old from now on.
        done = used.select("src", "dst", F.lit(True).alias("joined"))
        old = known.join(done, ["src", "dst"], "left").select("src", "dst", "sim", (F.col("new") & F.col("joined").isNull()).alias("new"), F.lit(False).alias("found"))
        known = pin(_best(old.unionByName(fresh(found)), p.k), "ann-graph")
        changed = known.where("found").count()
        if turn + 1 >= p.least_iterations and changed <= p.least_change * n * min(p.k, n - 1):
            return known.select("src", "dst", "sim")
    raise RuntimeError(f"the graph still changes after {p.guard} iterations")


def _cosines(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        if b.num_rows:
            yield _edges(b.column("src"), b.column("dst"), np.einsum("ij,ij->i", _matrix(b.column("x")), _matrix(b.column("y"))))


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, p: AnnParams) -> DataFrame:
    """``src, dst, sim``: the best ``rescore`` nodes that greedy search finds from each query node (``node``)."""
    w = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim").withColumn("at", F.row_number().over(w)).where(F.col("at") <= p.k)
    both = pin(edges.select("src", "dst", "sim").unionByName(reverse.select("src", "dst", "sim")).groupBy("src", "dst").agg(F.max("sim").alias("sim")), "ann-both")
    vectors = nodes.select("node", "vec")
    starts = queries.select("node").distinct()
    known = pin(both.join(starts, F.col("src") == F.col("node"), "left_semi").withColumn("expanded", F.lit(False)).withColumn("rank", F.row_number().over(w)), "ann-found")
    own = starts.join(vectors, "node").select(F.col("node").alias("src"), F.col("vec").alias("x"))
    for _ in range(p.guard):
        open_ = known.where(~F.col("expanded") & (F.col("rank") <= p.beam))
        if open_.isEmpty():
            return known.where(F.col("rank") <= p.rescore).select("src", "dst", "sim")
        step = open_.select("src", F.col("dst").alias("via")).join(both.select(F.col("src").alias("via"), F.col("dst")), "via").where("dst != src").select("src", "dst", F.lit(0).alias("seen"))
        met = step.unionByName(known.select("src", "dst", F.lit(1).alias("seen"))).groupBy("src", "dst").agg(F.max("seen").alias("seen"))
        fresh = met.where("seen = 0").select("src", "dst")
        pairs = fresh.join(own, "src").join(vectors.select(F.col("node").alias("dst"), F.col("vec").alias("y")), "dst")
        scored = pairs.select("src", "dst", "x", "y").mapInArrow(_cosines, _EDGES).withColumn("expanded", F.lit(False))
        old = known.select("src", "dst", "sim", (F.col("expanded") | (F.col("rank") <= p.beam)).alias("expanded"))
        # Beyond the beam a node is never expanded, but it is known: it need not be compared again while it is kept.
        after = old.unionByName(scored.select("src", "dst", "sim", "expanded")).withColumn("rank", F.row_number().over(w))
        known = pin(after.where(F.col("rank") <= 8 * p.rescore), "ann-found")
    raise RuntimeError(f"the search still finds nearer nodes after {p.guard} rounds")


def nearest(rows: DataFrame, is_query: Column, p: AnnParams = AnnParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` nearest rows found for each row for which ``is_query`` holds of ``id``."""
    x = pin(valid(rows, id_col, vector_col), "ann-rows")
    distinct = pin(x.groupBy("node").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n")), "ann-nodes")
    n = distinct.count()
    nodes = pin(_packed(distinct, p, n), "ann-vectors")
    asked = pin(x.where(is_query).select("id", "node").distinct(), "ann-queries")
    found = search(asked, nodes, graph(nodes, p, n), p) if n > 1 else asked.sparkSession.createDataFrame([], _EDGES)

    # The smallest ids of each class; ids that repeat with one vector count once.
    by_id = Window.partitionBy("node").orderBy("id")
    ids = x.select("node", "id").distinct().withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= p.top + 1).select("node", "id")
    classes = found.select("src", "dst").unionByName(asked.select(F.col("node").alias("src"), F.col("node").alias("dst")).distinct())
    vector = distinct.select("node", "vector")
    scored = classes.join(vector.select(F.col("node").alias("src"), F.col("vector").alias("x")), "src").join(vector.select(F.col("node").alias("dst"), F.col("vector").alias("y")), "dst")
    scored = scored.select("src", "dst", cosine(F.col("x"), F.col("y")).alias("score"))
    pairs = asked.select(F.col("id").alias("query_id"), F.col("node").alias("src")).join(scored, "src").join(ids.select(F.col("node").alias("dst"), F.col("id").alias("vec_id")), "dst").where("vec_id != query_id")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= p.top).select("query_id", "rank", "vec_id", "score")
