"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is a weighted set: its shingles of five words, each with weight 1
(``weights="set"``) or its number of occurrences (``"count"``).  Every element owns
weight regions, one per unit of weight (the last may be a part).  In each region
hashed darts land at the ranks of a Poisson process, the gaps being exponential
hashes of the region and the dart's number.  A dart belongs to a hashed coordinate;
per coordinate the earliest dart of all regions is the signature value, so two
documents agree in a coordinate with probability equal to their weighted Jaccard
similarity.  Only darts up to rank ``t / weight`` are thrown, about k ln k + 3 k per
document however long it is; a document with an empty coordinate throws further.

The signatures are banded.  Copies of a text are one node from the start.  A bucket
(band and value) with several nodes picks as its centre the node that shares most
buckets, and members are compared with the centres that they share most buckets
with; exact similarities of the shingle sets decide.  Links merge into classes.
Rounds go on over buckets that still hold nodes of several classes: first with other
centres, in the end with all pairs of members of different classes that have not been
compared.  Pairs that cannot be similar by their sizes and by the shingles that
nobody shares are not formed.  So a group of n near copies costs about n comparisons,
and no similar candidate pair between different classes goes unseen.

A bucket is missed by a pair of similarity 0.8 with probability (1 - 0.8^5)^25, under
1 in 10,000; this bound is the method's, set by ``bands`` and ``rows``.

Defined results: null text is the empty text; equal texts are one class even if they
have no words; other wordless texts link to nothing; texts of one to four words are a
single shingle; rows that repeat a doc_id are documents of their own; a class is named
by its smallest doc_id (null only if it has none); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabqa.llm.common import ship
from tabqa.session import pin

ship(__name__)


@dataclass(frozen=True)
class NearDupParams:
    words: int = 5
    similarity: float = 0.8
    bands: int = 25
    rows: int = 5
    weights: str = "set"  # or "count"
    centre_rounds: int = 3  # rounds with one centre a bucket before the remaining pairs
    centres: int = 2  # centres that a node is compared with in a round
    slice_rows: int = 1_000  # texts turned into Python strings at once by a task
    slice_words: int = 50_000  # words sketched at once by a task
    memo_words: int = 200_000  # word hashes remembered by a task


CELLS = 64  # of the hash space of shingles, for bounds on overlaps

# The odd multipliers of a well-known 64-bit finaliser.
_GAP, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x + _GAP
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word to a 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        v = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[word] = v
        return v


def shingles(texts: list[str], n: int, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and hashes of all shingles, in order; a short text is one shingle."""
    split = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    h = np.fromiter((memo[w] for words in split for w in words), np.uint64, int(counts.sum()))
    first = np.cumsum(counts) - counts
    made = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    doc = np.repeat(np.arange(len(texts)), made)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made) + first[doc]
    left = (first + counts)[doc] - at
    out = np.zeros(len(doc), np.uint64)
    for k in range(n):
        part = h[np.minimum(at + k, len(h) - 1)] if len(h) else out
        out = np.where(left > k, mix64(out ^ part), out)
    return doc, out


def darts(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int, factor: float = 1.0) -> np.ndarray:
    """Signatures (n_docs, k) of weighted sets; a document without weight gets zeros."""
    copies = np.ceil(weight).astype(np.int64)
    owner = np.repeat(np.arange(len(element)), copies)
    copy = np.arange(len(owner)) - np.repeat(np.cumsum(copies) - copies, copies)
    region, of = mix64(element[owner] ^ mix64(copy.astype(np.uint64))), doc[owner]
    part = np.minimum(weight[owner] - copy, 1.0)
    whole = bool((part == 1.0).all())
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    reach = factor * k * (np.log(k) + 3) / np.maximum(total, 1e-12)
    best = np.full(n_docs * k, np.inf)
    thrown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rank, m = np.zeros(len(region)), 0
    while len(region):
        h = mix64(region + np.uint64(m))
        rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
        stay = rank <= reach[of]
        region, of, part, rank, h = region[stay], of[stay], part[stay], rank[stay], h[stay]
        name = mix64(h ^ _M1)
        cell, r, name = of * k + (name % np.uint64(k)).astype(np.int64), rank, mix64(name)
        if not whole:
            inside = (mix64(name) >> np.uint64(11)).astype(np.float64) / 2.0**53 < part
            cell, r, name = cell[inside], r[inside], name[inside]
        np.minimum.at(best, cell, r)
        thrown.append((cell, r, name))
        m += 1
    signature = np.zeros(n_docs * k, np.uint64)
    for cell, r, name in thrown:
        earliest = best[cell] == r
        signature[cell[earliest]] = name[earliest]
    signature = signature.reshape(n_docs, k)
    short = np.isinf(best).reshape(n_docs, k).any(axis=1) & (total > 0)
    if short.any():
        number = np.cumsum(short) - 1
        mine = short[doc]
        signature[short] = darts(number[doc[mine]], element[mine], weight[mine], int(short.sum()), k, factor * 2)
    return signature


def band_values(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    v = np.broadcast_to(mix64(np.arange(bands, dtype=np.uint64)), (len(signature), bands)).copy()
    cells = signature.reshape(len(signature), bands, rows)
    for j in range(rows):
        v = mix64(v ^ cells[:, :, j])
    return v.view(np.int64)


def weighted(doc: np.ndarray, element: np.ndarray, how: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if how == "set":  # an element thrown twice lands on the same darts, so repeats change nothing
        return doc, element, np.ones(len(doc))
    order = np.lexsort((element, doc))
    d, e = doc[order], element[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (e[1:] != e[:-1])
    at = np.flatnonzero(new)
    return d[at], e[at], np.diff(np.append(at, len(d))).astype(np.float64)


def _slices(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` words by length; a longer text is a run of its own."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) // 6 > limit:
            yield at, i
            at, size = i, 0
        size += len(t) // 6
    if at < len(texts):
        yield at, len(texts)


def _blocks(parts: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in blocks of so many rows; in the end unused memory goes back, as idle workers keep what they have."""
    for b in parts:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        b = None
    pa.default_memory_pool().release_unused()


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def sketch(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """``id, node, values`` from ``id, node, text``: the band values, empty for wordless texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in _blocks(parts, p.slice_rows):
            texts = [t or "" for t in b.column("text").to_pylist()]
            for lo, hi in _slices(texts, p.slice_words):
                doc, element = shingles(texts[lo:hi], p.words, memo)
                some = np.bincount(doc, minlength=hi - lo) > 0
                v = band_values(darts(*weighted(doc, element, p.weights), hi - lo, p.bands * p.rows), p.bands, p.rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo), b.column("node").slice(lo, hi - lo), _lists(v[some].ravel(), some * p.bands)], names=["id", "node", "values"]
                )
                if len(memo) > p.memo_words:
                    memo = WordHashes()

    return docs.select("id", "node", "text").mapInArrow(run, f"id {dict(docs.dtypes)['id']}, node binary, values array<bigint>")


def shingle_sets(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """``node, set, cells``: the sorted distinct shingle hashes of each text, and how many fall into each cell of the hash space."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in _blocks(parts, p.slice_rows):
            texts = [t or "" for t in b.column("text").to_pylist()]
            for lo, hi in _slices(texts, p.slice_words):
                doc, element = shingles(texts[lo:hi], p.words, memo)
                d, e, _ = weighted(doc, element, "count")
                cells = np.bincount(d * CELLS + (e % np.uint64(CELLS)).astype(np.int64), minlength=(hi - lo) * CELLS)
                lists = [_lists(e.view(np.int64), np.bincount(d, minlength=hi - lo)), _lists(cells, np.full(hi - lo, CELLS))]
                yield pa.RecordBatch.from_arrays([b.column("node").slice(lo, hi - lo), *lists], names=["node", "set", "cells"])
                if len(memo) > p.memo_words:
                    memo = WordHashes()

    return docs.select("node", "text").mapInArrow(run, "node binary, set array<bigint>, cells array<bigint>")


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for all ends of ``links (a, b)``: the smallest node of each connected component."""
    both = pin(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "neardup-edges")
    labels = pin(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "neardup-labels")
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("heard"))
        near = labels.join(heard, F.col("node") == F.col("a")).select("node", F.least("label", "heard").alias("via"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("next"))
        after = pin(near.join(jump, "via").select("node", F.least("via", "next").alias("label"), "old"), "neardup-labels")
        labels = after.select("node", "label")
        if after.where(F.col("label") != F.col("old")).isEmpty():
            return labels


def _verified(pairs: DataFrame, sets: DataFrame, p: NearDupParams) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets are as similar as asked."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("_x"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("_y"))
    size = F.size(F.array_intersect("_x", "_y"))
    alike = F.least(F.size("_x"), F.size("_y")) >= p.similarity * F.greatest(F.size("_x"), F.size("_y"))
    x = pairs.join(left, "a").join(right, "b").where(alike).withColumn("_n", size)
    return x.where(F.col("_n") >= p.similarity * (F.size("_x") + F.size("_y") - F.col("_n"))).select("a", "b")


def _bounds(sets: DataFrame, p: NearDupParams) -> DataFrame:
    """``node, n, own, lo, hi, shared``: what a similar text can be like.

    Of the ``n`` shingles of a node, ``own`` are in no other candidate's set and so are
    lost to any overlap; a similar text's size lies in [lo, hi].  ``shared`` counts the
    others by cell of the hash space.  Nodes that nothing can be similar to are left
    out.  The bounds are exact: no similar pair is lost.
    """
    s = p.similarity
    alone = sets.select("node", F.explode("set").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1")
    cell = F.pmod("shingle", F.lit(CELLS))
    own = alone.groupBy("node").agg(F.count(F.lit(1)).alias("own"), F.array(*[F.count_if(cell == k) for k in range(CELLS)]).alias("own_cells"))
    x = sets.select("node", F.size("set").alias("n"), "cells").join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)).cast("int"))
    left = F.when(F.col("own") == 0, F.col("cells")).otherwise(F.zip_with("cells", "own_cells", lambda c, o: c - o))
    x = x.withColumn("shared", F.transform(left, lambda c: c.cast("int")))
    x = x.withColumn("lo", F.ceil(F.col("n") * s - 1e-6)).withColumn("hi", F.floor((F.col("n") - F.col("own")) / s - F.col("own") + 1e-6))
    return x.where("lo <= hi and n > 0").select("node", "n", "own", "lo", "hi", "shared")


def _able(a: str, b: str, s: float) -> Column:
    """Whether two nodes (structs of bounds) can be that similar.

    By their sizes, and by the largest overlap that the shingles that others have, too,
    allow cell by cell.
    """
    of = lambda x, f: F.col(f"{x}.{f}")
    fits = of(b, "n").between(of(a, "lo"), of(a, "hi")) & of(a, "n").between(of(b, "lo"), of(b, "hi"))
    enough = lambda o: o >= s * (of(a, "n") + of(b, "n") - o) - 1e-6
    most = F.aggregate(F.zip_with(of(a, "shared"), of(b, "shared"), lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    return fits & enough(F.least(of(a, "n") - of(a, "own"), of(b, "n") - of(b, "own"))) & enough(most)


def _with_centre(open_: DataFrame, turn: int, p: NearDupParams) -> DataFrame:
    """Pairs ``(a, b)`` of a node and a centre of its buckets.

    The centre of a bucket is its member of the highest rank, in later rounds one by
    a hashed order of its own.  A node meets the ``centres`` ones that it shares
    most buckets with; others are left to later rounds.
    """
    by = F.col("rank") if turn == 0 else F.xxhash64(F.lit(turn), "bucket", "label")
    centre = open_.groupBy("bucket").agg(F.max(F.struct(by.alias("by"), "rank", "node", "label", F.col("me").alias("other"))).alias("c"))
    met = open_.join(centre, "bucket").select("node", "me", "label", "c.other", F.col("c.label").alias("label2"), F.col("c.rank").alias("rank2"), F.col("c.node").alias("node2"))
    met = met.where(F.col("label") != F.col("label2")).where(_able("me", "other", p.similarity))
    met = met.groupBy("node", "node2").agg(F.count(F.lit(1)).alias("shared"), F.max("rank2").alias("rank2"))
    nearest = Window.partitionBy("node").orderBy(F.desc("shared"), F.desc("rank2"), "node2")
    met = met.withColumn("at", F.row_number().over(nearest)).where(F.col("at") <= p.centres)
    return met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))


def _remaining(open_: DataFrame, p: NearDupParams) -> DataFrame:
    """All pairs ``(a, b)`` of members of different classes in a bucket that can be similar.

    A node is joined by the sizes that it can be similar to, from the side with more
    shingles of its own, whose range is the narrower; so nodes that differ too much
    from everything else meet nobody.
    """
    cell = lambda c: F.floor(F.log(F.col(c)) / F.log(F.lit(1.03))).cast("int")
    probe = open_.select("bucket", "node", "label", "me", F.explode(F.sequence(cell("me.lo"), cell("me.hi"))).alias("cell"))
    other = open_.select("bucket", F.col("node").alias("node2"), F.col("label").alias("label2"), F.col("me").alias("other"), cell("me.n").alias("cell"))
    more = F.col("me.own") > F.col("other.own")
    first = more | ((F.col("me.own") == F.col("other.own")) & (F.col("node") < F.col("node2")))
    on = (probe["bucket"] == other["bucket"]) & (probe["cell"] == other["cell"]) & (F.col("label") != F.col("label2")) & first & _able("me", "other", p.similarity)
    return probe.join(other, on).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))


def classes(docs: DataFrame, p: NearDupParams = NearDupParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, node, class_id, class_docs, kept`` for every row; ``kept`` marks the rows of the document that names the class."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("node"), text.alias("text"))
    known = pin(sketch(named, p), "neardup-sketch")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("node"))
    nodes = pin(known.groupBy("node").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n_docs"), F.first("values").alias("values")), "neardup-nodes")

    rows = nodes.select("node", F.explode("values").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = pin(rows.join(shared, "bucket"), "neardup-buckets")
    rank = members.groupBy("node").agg(F.sum("n").alias("rank"))
    members = pin(members.join(rank, "node").select("bucket", "node", "rank"), "neardup-members")
    wanted = rank.join(nodes, "node").select("node", F.col("first.id").alias("_id"))
    sets = named.join(wanted.withColumnRenamed("node", "_node"), (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    sets = pin(shingle_sets(sets, p).dropDuplicates(["node"]), "neardup-sets")
    me = F.struct("n", "own", "lo", "hi", "shared").alias("me")
    members = pin(members.join(_bounds(sets, p), "node").select("bucket", "node", "rank", me), "neardup-bounded")

    links, tried, labels = None, None, None
    for turn in range(p.centre_rounds + 1):
        if turn:
            labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            mixed = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket")
            open_ = pin(labelled.join(mixed, "bucket"), "neardup-open")
        else:
            open_ = members.withColumn("label", F.col("node"))
        pairs = (_with_centre(open_, turn, p) if turn < p.centre_rounds else _remaining(open_, p)).distinct()
        pairs = pin(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "neardup-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        fresh = pin(_verified(pairs, sets, p), "neardup-links")
        links = fresh if links is None else links.unionByName(fresh)
        if turn == 0 or not fresh.isEmpty():
            labels = components(links)

    label = F.coalesce("label", "node")
    classed = nodes.join(labels, "node", "left").withColumn("label", label)
    named_by = classed.groupBy("label").agg(F.min("first").alias("class"), F.sum("n_docs").alias("class_docs")).where("class_docs > 1")
    marked = classed.join(named_by, "label").select("node", "class", "class_docs")
    out = known.select("id", "node").join(marked, "node", "left")
    return out.select(
        "id",
        "node",
        F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("class.id")).alias("class_id"),
        F.coalesce("class_docs", F.lit(1)).cast("bigint").alias("class_docs"),
        F.when(F.col("class").isNull(), True).otherwise(F.col("id").eqNullSafe(F.col("class.id")) & (F.col("node") == F.col("class.node"))).alias("kept"),
    )


def deduplicate(docs: DataFrame, p: NearDupParams = NearDupParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class: that with the smallest id, once."""
    found = pin(classes(docs, p, id_col, text_col), "neardup-classes")
    keyed = docs.withColumn("_nd_node", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    gone = found.where(~F.col("kept")).select(F.col("id").alias("_nd_id"), F.col("node").alias("_nd_text")).distinct()
    on = F.col(id_col).eqNullSafe(F.col("_nd_id")) & (F.col("_nd_node") == F.col("_nd_text"))
    stay = keyed.join(gone, on, "left_anti")
    again = pin(found.where("kept").groupBy("id", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("_nd_id"), F.col("node").alias("_nd_text")), "neardup-again")
    if not again.isEmpty():  # rows that repeat both id and text
        stay = stay.join(again, on, "left_anti").unionByName(stay.join(again, on, "left_semi").dropDuplicates([id_col, "_nd_node"]))
    return stay.select(*docs.columns)
