"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Fitting takes a bounded, seeded sample of labelled rows (``max_examples`` of each
class).  Spark counts the terms of the sample by class; the ``vocabulary`` terms
that tell the classes apart best (chi-square) span the vector space.  Terms are
words and ``stem`` letters of word beginnings, of the whole text.  The examples'
unit TF-IDF vectors form an inverted index in blocks: per term and block the
largest weight is kept.  The index is bounded by the parameters and is broadcast as plain arrays.
Document frequencies are counted over all labelled rows, not the sample alone.

A text's bound for a block is the product of its vector with the block's largest
weights.  Blocks are scored exactly in falling order of their bounds until the
``k``-th best example beats every bound that is left, so the ``k`` nearest are exact.
Their votes, weighted by cosine, and the largest cosine go through a logistic
calibration, fitted on the examples with each one left out of its own search and
classes weighted as they occur among all labels.  The nearest examples are returned
as evidence.

Defined results: a text without any term of the vocabulary (null, empty, or plain)
gets the calibrated rate of such examples and no evidence; without labelled rows the
score is 0, with one class only its rate; label rows with a null or other value are
left out, contradicting ones count as toxic; rows that repeat a doc_id are scored
each by its text; ties go to the example with the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabqa.llm.common import ship
from tabqa.session import pin

ship(__name__)


@dataclass(frozen=True)
class ToxicityParams:
    max_examples: int = 4000  # of each class: the bound of the fitted sample
    vocabulary: int = 3000
    min_docs: int = 3  # examples a term must occur in
    min_phi2: float = 0.01  # least chi-square of a term over the number of examples
    purity: float = 0.9  # least share of the toxic class in a term, classes weighted alike
    stem: int = 5
    block: int = 64  # examples in a block
    k: int = 15
    evidence: int = 3
    threshold: float = 0.3


_LETTERS = re.compile(r"[^\W\d_]+")


def terms(text: str | None, stem: int) -> Iterator[str]:
    for w in _LETTERS.findall((text or "").lower()):
        yield w
        if len(w) > stem:
            yield w[:stem] + "*"


def counts(text: str | None, stem: int, ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary numbers in a text, with their counts."""
    words = _LETTERS.findall((text or "").lower())
    found = [i for w in words if (i := ids.get(w)) is not None]
    found += [i for w in words if len(w) > stem and (i := ids.get(w[:stem] + "*")) is not None]
    return np.unique(np.array(found, np.int64), return_counts=True)


class Index:
    """Block-max inverted index over unit vectors of the examples."""

    def __init__(self, n_terms: int, idf: np.ndarray, examples: list[tuple[object, int, np.ndarray, np.ndarray]], p: ToxicityParams):
        self.idf, self.p = idf, p
        vectors = [(i, y, t, self.vector(t, n)) for i, y, t, n in examples if len(t)]
        # Examples of a class with the same heaviest term stand together, so that bounds are tight.
        vectors.sort(key=lambda v: (v[1], int(v[2][np.argmax(v[3])]), v[0] is not None, v[0]))
        self.ids, self.labels = [v[0] for v in vectors], np.array([v[1] for v in vectors], np.float64)
        self.order = np.empty(len(vectors), np.int64)  # place of an example by id, for ties
        self.order[sorted(range(len(vectors)), key=lambda j: (self.ids[j] is not None, self.ids[j]))] = np.arange(len(vectors))
        row = np.concatenate([np.full(len(v[2]), j) for j, v in enumerate(vectors)] or [np.zeros(0, np.int64)])
        term = np.concatenate([v[2] for v in vectors] or [np.zeros(0, np.int64)])
        weight = np.concatenate([v[3] for v in vectors] or [np.zeros(0)])
        by = np.lexsort((row, term))
        self.row, self.weight = row[by], weight[by]
        self.n_blocks = -(-len(vectors) // p.block)
        cell = term * self.n_blocks + row // p.block
        self.ptr = np.searchsorted(cell[by], np.arange(n_terms * self.n_blocks + 1))
        self.top = np.zeros(n_terms * self.n_blocks)
        np.maximum.at(self.top, cell, weight)
        self.top = self.top.reshape(n_terms, self.n_blocks)

    def vector(self, t: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.idf[t]
        return w / np.sqrt((w * w).sum())

    def nearest(self, t: np.ndarray, n: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a cosine above 0."""
        k = self.p.k
        if not len(t) or not self.n_blocks:
            return np.zeros(0, np.int64), np.zeros(0)
        q = self.vector(t, n)
        bound = q @ self.top[t]
        blocks = np.argsort(-bound, kind="stable")
        blocks = blocks[: int((bound > 0).sum())]
        best, score, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 4
        while at < len(blocks):
            if len(best) >= k:
                # A block whose bound equals the k-th cosine may hold a tie of a smaller id.
                rest = blocks[at:][bound[blocks[at:]] >= score[k - 1] - 1e-12]
                if not len(rest):
                    break
                blocks = np.concatenate([blocks[:at], rest])
            chosen = blocks[at : at + step]
            cells = (t[:, None] * self.n_blocks + chosen[None, :]).ravel()
            start, size = self.ptr[cells], self.ptr[cells + 1] - self.ptr[cells]
            full = np.flatnonzero(size)
            start, size = start[full], size[full]
            place = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
            rows = self.row[place]
            products = self.weight[place] * np.repeat(q[full // len(chosen)], size)
            uniq, where = np.unique(rows, return_inverse=True)
            cosine = np.bincount(where, weights=products, minlength=len(uniq))
            if skip >= 0:
                uniq, cosine = uniq[uniq != skip], cosine[uniq != skip]
            best, score = np.concatenate([best, uniq]), np.round(np.concatenate([score, cosine]), 12)
            keep = np.lexsort((self.order[best], -score))[:k]
            best, score = best[keep], score[keep]
            at, step = at + step, step * 2
        return best, score

    def features(self, t: np.ndarray, n: np.ndarray, skip: int = -1) -> tuple[float, float, np.ndarray, np.ndarray] | None:
        best, score = self.nearest(t, n, skip)
        if not len(best):
            return None
        return float((score * self.labels[best]).sum() / score.sum()), float(score[0]), best, score


@dataclass
class Model:
    ids: dict[str, int]
    index: Index | None
    weights: np.ndarray
    plain: float  # score of a text without terms

    def score(self, text: str | None, p: ToxicityParams) -> tuple[float, list, list[float]]:
        got = self.index.features(*counts(text, p.stem, self.ids)) if self.index else None
        if got is None:
            return self.plain, [], []
        vote, top, best, cosine = got
        return _logistic(_inputs(vote, top) @ self.weights), [self.index.ids[j] for j in best[: p.evidence]], cosine[: p.evidence].tolist()


def _state(m: Model) -> dict:
    """What scoring needs, as plain numbers and arrays: it travels without this package."""
    index = {k: v for k, v in vars(m.index).items() if k != "p"} if m.index else None
    return {"ids": m.ids, "index": index, "weights": m.weights, "plain": m.plain}


def _restored(state: dict, p: ToxicityParams) -> Model:
    index = None
    if state["index"] is not None:
        index = Index.__new__(Index)
        index.__dict__.update(state["index"], p=p)
    return Model(state["ids"], index, state["weights"], state["plain"])


def _inputs(vote: float, top: float) -> np.ndarray:
    return np.array([1.0, vote, top, vote * top])


def _logistic(z):
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        pr = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - pr)) - ridge * beta
        step = np.linalg.solve((x * (w * pr * (1 - pr))[:, None]).T @ x + ridge * np.eye(len(beta)), grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def build(vocabulary: list[tuple[str, int]], examples: list[tuple[object, int, np.ndarray, np.ndarray]], totals: dict[int, int], p: ToxicityParams) -> Model:
    """``vocabulary``: (term, labelled texts with it); ``examples``: (id, label, term numbers, counts); ``totals``: labelled rows by class."""
    n = [sum(1 for e in examples if e[1] == y) for y in (0, 1)]
    rate = totals.get(1, 0) / max(1, sum(totals.values()))
    if not all(n):
        return Model({}, None, np.zeros(4), rate)
    idf = np.array([np.log((1 + sum(totals.values())) / (1 + df)) + 1 for _, df in vocabulary])
    index = Index(len(vocabulary), idf, examples, p)
    weight = [totals[y] / n[y] for y in (0, 1)]
    at = {i: j for j, i in enumerate(index.ids)}
    x, y, w, plain = [], [], [], [0.5 * rate, 0.5]
    for i, label, t, c in examples:
        got = index.features(t, c, at[i]) if len(t) else None
        if got is None:
            plain = [plain[0] + label * weight[label], plain[1] + weight[label]]
        else:
            x.append(_inputs(*got[:2]))
            y.append(label)
            w.append(weight[label])
    beta = _fit_logistic(np.array(x), np.array(y, float), np.array(w)) if x else np.zeros(4)
    return Model({t: j for j, (t, _) in enumerate(vocabulary)}, index, beta, plain[0] / plain[1])


def fit(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from ``labels`` (rows to learn from) and the texts they name."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = pin(known.withColumn("at", F.xxhash64("id")), "toxic-labels")
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = [known.where(F.col("y") == y).orderBy("at", "id").limit(p.max_examples) for y in (0, 1)]
    sample = pin(of[0].unionByName(of[1]).select("id", "y"), "toxic-sample")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def extract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            found = [sorted(set(terms(t, p.stem))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(found, pa.list_(pa.string()))], names=["y", "terms"])

    one = pin(texts.groupBy("id", "y").agg(F.min("text").alias("text")), "toxic-texts")  # repeated rows of an id: one example
    found = one.mapInArrow(extract, "y int, terms array<string>").select("y", F.explode("terms").alias("term"))
    n1 = one.where("y = 1").count()
    n0 = one.count() - n1
    by_term = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("df1")).where(F.col("df") >= p.min_docs)
    a, b = F.col("df1").cast("double"), (F.col("df") - F.col("df1")).cast("double")
    n_all = n0 + n1
    phi2 = F.pow(a * (n0 - b) - b * (n1 - a), 2) / ((a + b) * (n_all - a - b + F.lit(1e-9)) * max(1.0, float(n0) * n1))
    pure = a / max(1, n1) >= p.purity * (a / max(1, n1) + (b + 0.5) / max(1, n0))
    chosen = [r["term"] for r in by_term.where((phi2 >= p.min_phi2) & pure).orderBy(phi2.desc(), "term").limit(p.vocabulary).select("term").collect()]
    ids = {t: j for j, t in enumerate(chosen)}

    def present(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([counts(t, p.stem, ids)[0].tolist() for t in b.column("text").to_pylist()], pa.list_(pa.int64()))], names=["id", "t"])

    # Document frequencies are over all rows that may be learnt from; of repeated rows of an id one counts.
    # Texts become lists of chosen terms, most of them empty, before they meet the labels.
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(named.dtypes)["id"]
    found_terms = named.mapInArrow(present, f"id {kind}, t array<bigint>").where(F.size("t") > 0)
    seen = found_terms.join(known.select("id"), "id").groupBy("id").agg(F.max("t").alias("t")).select(F.explode("t").alias("t"))
    often = {r["t"]: r["df"] for r in seen.groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()} if ids else {}  # one row a chosen term
    vocabulary = [(t, often.get(j, 0)) for t, j in ids.items()]

    def vectors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            got = [counts(t, p.stem, ids) for t in b.column("text").to_pylist()]
            lists = [pa.array([x[j].tolist() for x in got], pa.list_(pa.int64())) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), *lists], names=["id", "y", "t", "n"])

    rows = one.mapInArrow(vectors, f"id {kind}, y int, t array<bigint>, n array<bigint>").orderBy("id").collect()  # bounded by the sample and the vocabulary
    return build(vocabulary, [(r["id"], r["y"], np.array(r["t"], np.int64), np.array(r["n"], np.int64)) for r in rows], totals, p)


def score(docs: DataFrame, model: Model, p: ToxicityParams = ToxicityParams(), id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``id, score, predicted, near, cosines`` for every row; with ``keep`` the rows of ``docs`` that are not predicted toxic instead."""
    shared = docs.sparkSession.sparkContext.broadcast(_state(model))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _restored(shared.value, p)
        for b in parts:
            got = [m.score(t.as_py(), p) for t in b.column(b.num_columns - 1 if not keep else b.schema.get_field_index(text_col))]
            if keep:
                yield b.filter(pa.array([g[0] < p.threshold for g in got], pa.bool_()))
                continue
            near = pa.array([g[1] for g in got], pa.list_(b.schema.field("id").type))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([g[0] for g in got], pa.float64()), pa.array([int(g[0] >= p.threshold) for g in got], pa.int32()), near, pa.array([g[2] for g in got], pa.list_(pa.float64()))],
                names=["id", "score", "predicted", "near", "cosines"],
            )

    if keep:
        return docs.mapInArrow(run, docs.schema)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int, near array<{kind}>, cosines array<double>")


def learnable(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Label rows that may be learnt from; the rest is held out."""
    return labels.where(~held_out(id_col))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
