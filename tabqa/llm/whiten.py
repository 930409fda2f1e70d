"""Whitening of embeddings by a block Jacobi-Davidson eigensolver that never forms the covariance.

Entries become integers (``scale`` times the entry, rounded down).  The fit list, each distinct
integer vector once, is written once in blocks of packed rows.  All that is ever asked of it is
the product of its covariance with a few directions: every task centres its rows, multiplies, and
returns one partial sum (``dimensions x directions``), which tasks add up before the driver sees them.

The driver holds a search space of at most ``space`` directions.  Rayleigh-Ritz in it gives the
wanted pairs; a pair whose residual has reached double precision is locked, in order.  For the
others the correction equation, projected off the locked and the present vectors, is solved by a few steps of
MINRES, all directions in one product per step; the corrections widen the space.  It ends
when all residuals are there and one more product confirms them; ``guard`` turns are an error.

Whitening then is one pass over the rows, with a matrix of ``dimensions x components``.

Defined results: vectors that are null or hold null or non-finite entries take no part, nor do
vectors of another length than the most frequent (of equals the greater), empty ones, or such with
entries that leave the range of longs when scaled; repeated rows answer each; a deviation beyond the range
of longs is null; components without variance (below ``flat`` of the first) can't be
scaled to one and don't come out, so a fit list of one vector gives no rows, nor does an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabqa.llm.common import n_partitions, ship
from tabqa.session import pin

ship(__name__)


@dataclass(frozen=True)
class WhitenParams:
    components: int = 4
    scale: int = 256
    space: int = 24  # directions of the search space, at which it restarts
    inner: int = 6  # steps of MINRES in a turn
    block_bytes: int = 1 << 22  # of a block's rows in doubles
    tolerance: float = 64 * np.finfo(float).eps  # of a residual, as a share of the first eigenvalue
    flat: float = 1e-12
    guard: int = 200
    combine: int = 64  # partial sums that the driver adds up by itself
    seed: int = 5


def valid(rows: DataFrame, id_col: str, vector_col: str, p: WhitenParams) -> DataFrame:
    """``id, x``: the rows that take part, with their integer vectors."""
    v = F.transform(vector_col, lambda c: F.floor(F.lit(float(p.scale)) * c.cast("double")))
    fits = F.forall(vector_col, lambda c: F.coalesce(F.abs(F.lit(float(p.scale)) * c.cast("double")) < float(1 << 62), F.lit(False)))
    x = rows.where(F.size(vector_col) > 0).where(fits).select(F.col(id_col).alias("id"), v.alias("x"))
    lengths = x.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    return x.where(F.size("x") == lengths[0]["n"]) if lengths else x.limit(0)


_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def _pack(row: np.ndarray) -> bytes:
    """A vector in the narrowest integers that hold it, so that equal vectors are equal bytes."""
    top = max(int(row.max()), -1 - int(row.min()))
    code = next(i for i, t in enumerate(_WIDTHS) if top <= np.iinfo(t).max)
    return bytes([code]) + row.astype(_WIDTHS[code]).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, _WIDTHS[packed[0]], offset=1).astype(np.int64)


def _rows(b: pa.RecordBatch) -> np.ndarray:
    return np.asarray(b.column("x").flatten(), np.int64).reshape(b.num_rows, -1)


class FitList:
    """The distinct vectors of a table, in written blocks, and products with their covariance."""

    def __init__(self, vectors: DataFrame, p: WhitenParams):
        self.p = p

        def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([_pack(r) for r in _rows(b)], pa.binary())], names=["v"])

        def block(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[bytes] = []
            room = 0

            def out():
                m = np.stack([_unpack(h) for h in held])
                return pa.RecordBatch.from_arrays([pa.array([_pack(m.ravel())], pa.binary()), pa.array([len(held)], pa.int32())], names=["block", "rows"])

            for b in parts:
                for v in b.column("v").to_pylist():
                    if held and room <= len(held):
                        yield out()
                        held = []
                    if not held:
                        room = max(1, p.block_bytes // (8 * len(_unpack(v))))
                    held.append(v)
            if held:
                yield out()

        distinct = vectors.select("x").mapInArrow(pack, "v binary").distinct()
        self.blocks = pin(distinct.mapInArrow(block, "block binary, rows int"), "whiten-blocks")
        self.n, self.sums = 0, None

        def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                for x, rows in zip(b.column("block").to_pylist(), b.column("rows").to_pylist(), strict=True):
                    m = _unpack(x).reshape(rows, -1).astype(object) if x[0] == 3 else _unpack(x).reshape(rows, -1)
                    s = [str(int(t)) for t in m.sum(axis=0)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s)), pa.int32()), pa.array(s, pa.string()), pa.array(np.full(len(s), rows), pa.int64())], names=["d", "s", "n"])

        # Exact sums, one row per dimension.
        total = self.blocks.mapInArrow(sums, "d int, s string, n bigint").groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
        rows = sorted(total.collect(), key=lambda r: r.d)
        if rows:
            self.n, self.sums = rows[0].n, [int(r.s) for r in rows]
            self.mean = np.array([s / self.n for s in self.sums])  # division of integers rounds once

    def _sum(self, f: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """Sum of ``f`` over all blocks of centred rows."""
        mean = self.mean

        def part(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in parts:
                for x, rows in zip(b.column("block").to_pylist(), b.column("rows").to_pylist(), strict=True):
                    got = f(_unpack(x).reshape(rows, -1) - mean)
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, np.float64).tobytes()], pa.binary())], names=["s"])

        def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [np.frombuffer(s, np.float64) for b in parts for s in b.column("s").to_pylist()]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([np.sum(held, axis=0).tobytes()], pa.binary())], names=["s"])

        sums = self.blocks.mapInArrow(part, "s binary")
        n = self.blocks.rdd.getNumPartitions()
        if n > self.p.combine:
            sums = sums.repartition(max(1, round(n**0.5))).mapInArrow(add, "s binary")
        got = sorted(r.s for r in sums.collect())
        return np.sum([np.frombuffer(s, np.float64) for s in got], axis=0).reshape(shape)

    def product(self, u: np.ndarray) -> np.ndarray:
        """Covariance times the columns of ``u``."""
        return self._sum(lambda y: y.T @ (y @ u), u.shape) / self.n

    def trace(self) -> float:
        return float(self._sum(lambda y: np.array([np.einsum("ij,ij->", y, y)]), (1,))[0] / self.n)


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The columns of ``new`` made orthonormal to ``against`` and one another, without those that vanish."""
    kept: list[np.ndarray] = []
    basis = np.hstack([a for a in against if a.shape[1]] or [np.zeros((len(new), 0))])
    for v in new.T:
        norm = np.linalg.norm(v)
        for _ in range(3):
            for q in (basis, np.array(kept).T if kept else basis[:, :0]):
                v = v - q @ (q.T @ v)
        if norm > 0 and np.linalg.norm(v) > 1e-10 * norm:
            kept.append(v / np.linalg.norm(v))
    return np.array(kept).T if kept else np.zeros((len(new), 0))


def minres(product: Callable[[np.ndarray], np.ndarray], theta: np.ndarray, off: np.ndarray, rhs: np.ndarray, steps: int, goal: float) -> np.ndarray:
    """Approximate ``t`` of ``P (V - theta I) P t = rhs``, ``P`` projecting off ``off``, a column each, one product a step."""
    project = lambda x: x - off @ (off.T @ x)
    k = rhs.shape[1]
    x, v_old, w, w_old = (np.zeros_like(rhs) for _ in range(4))
    v = project(rhs)
    beta = np.linalg.norm(v, axis=0)
    begin = np.where(beta > 0, beta, 1)
    live = beta > 0
    v = v / begin
    eta, gamma, gamma_old, sigma, sigma_old = beta.copy(), np.ones(k), np.ones(k), np.zeros(k), np.zeros(k)
    b_now = np.zeros(k)
    for _ in range(steps):
        if not live.any():
            break
        q = project(product(v) - v * theta)
        alpha = np.einsum("ij,ij->j", v, q)
        v_new = project(q - alpha * v - b_now * v_old)
        b_new = np.linalg.norm(v_new, axis=0)
        delta = gamma * alpha - gamma_old * sigma * b_now
        r1 = np.sqrt(delta**2 + b_new**2)
        r2 = sigma * alpha + gamma_old * gamma * b_now
        r3 = sigma_old * b_now
        live &= r1 > 1e-300
        safe = np.where(live, r1, 1)
        gamma_old, sigma_old, gamma, sigma = gamma, sigma, delta / safe, b_new / safe
        w, w_old = (v - r3 * w_old - r2 * w) / safe, w
        x = np.where(live, x + gamma * eta * w, x)
        eta = -sigma * eta
        v_old, v, b_now = v, v_new / np.where(b_new > 0, b_new, 1), b_new
        live &= (np.abs(eta) > goal * begin) & (b_new > 1e-14 * begin)
        for a in (v, v_old, w, w_old):  # a solved column rests
            a[:, ~live] = 0
        eta[~live] = 0
    return project(x)


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], d: int, p: WhitenParams) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns."""
    want = min(p.components, d)
    rng = np.random.default_rng(p.seed)
    v = _orthonormal(rng.standard_normal((d, min(d, 2 * want))))
    av = product(v)
    locked, values = np.zeros((d, 0)), []
    best, stuck = np.inf, 0
    for turn in range(p.guard):
        h = v.T @ av
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, a_ritz = v @ y, av @ y
        top = max([*values, *theta, 0.0])
        open_ = want - locked.shape[1]
        r = a_ritz[:, :open_] - ritz[:, :open_] * theta[:open_]
        r -= locked @ (locked.T @ r)
        size = np.linalg.norm(r, axis=0)
        # Rounding of the products bounds what can be reached; a residual that no longer falls is there, if small.
        stuck = stuck + 1 if size.max(initial=0) > 0.5 * best else 0
        best = min(best, size.max(initial=0))
        enough = p.tolerance * top if stuck < 5 else max(p.tolerance, 1e-12) * top
        done = 0
        while done < len(size) and size[done] <= enough:
            done += 1
        if done == open_:
            vectors, values = np.hstack([locked, ritz[:, :done]]), np.array([*values, *theta[:done]])
            by = np.argsort(-values, kind="stable")
            return values[by], vectors[:, by]
        if done:
            locked, values, best, stuck = np.hstack([locked, ritz[:, :done]]), [*values, *theta[:done]], np.inf, 0
            ritz, a_ritz, theta, r, size = ritz[:, done:], a_ritz[:, done:], theta[done:], r[:, done:], size[done:]
        if ritz.shape[1] + r.shape[1] > p.space:  # restart with the best
            keep = min(ritz.shape[1], max(p.space // 2, r.shape[1]))
            ritz, a_ritz = ritz[:, :keep], a_ritz[:, :keep]
        v = _orthonormal(ritz, locked)
        # Products follow a change of basis; they are made anew if it is more than rounding.
        av = a_ritz if v.shape == ritz.shape and np.abs(v - ritz).max(initial=0) < 1e-13 else product(v)
        bad = r.shape[1]
        t = minres(product, theta[:bad], np.hstack([locked, ritz[:, :bad]]), -r, p.inner, max(1e-8, min(0.1, 2.0 ** -(turn + 2))))
        new = _orthonormal(np.hstack([t, r]) if turn % 2 else t, locked, v)
        if not new.shape[1]:
            new = _orthonormal(np.hstack([r, rng.standard_normal((d, 1))]), locked, v)
        if new.shape[1]:
            v, av = np.hstack([v, new]), np.hstack([av, product(new)])
    raise RuntimeError(f"residuals are still {best:.1e} after {p.guard} turns")


def whiten(rows: DataFrame, p: WhitenParams = WhitenParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row that takes part and each component."""
    kind = rows.schema[id_col].dataType.simpleString()
    shape = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    x = valid(rows, id_col, vector_col, p)
    fit = FitList(x, p)
    empty = rows.sparkSession.createDataFrame([], shape)
    if not fit.n:
        return empty
    d, trace = len(fit.sums), fit.trace()
    if trace <= 0:
        return empty
    e, u = eigenpairs(fit.product, d, p)
    live = e > p.flat * e[0]
    e, u = e[live], u[:, live]
    scaled, share = u / np.sqrt(e), e / trace
    second = fit._sum(lambda y: (y @ scaled).T @ (y @ scaled), (len(e), len(e))) / fit.n
    centre = fit._sum(lambda y: (y @ scaled).sum(axis=0), (len(e),)) / fit.n
    error = float(np.abs(second - np.outer(centre, centre) - np.eye(len(e))).max())
    n, sums, mean, k = fit.n, fit.sums, fit.mean, len(e)
    roomy = max(abs(s) for s in sums) < 2**52

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.array(sums, np.int64 if roomy else object)
        for b in parts:
            if not b.num_rows:
                continue
            m = _rows(b)
            far = n * float(np.abs(m).max()) + float(max(abs(t) for t in sums))
            if roomy and far * far * len(sums) < 2**62:
                off = n * m - s
                deviation = np.einsum("ij,ij->i", off, off).tolist()
            else:
                deviation = [sum((n * a - t) ** 2 for a, t in zip(r, sums, strict=True)) for r in m.tolist()]
                deviation = [v if v < 2**63 else None for v in deviation]
            w = (m - mean) @ scaled
            ids = b.column("id").take(pa.array(np.repeat(np.arange(b.num_rows), k)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)),
                    pa.array(np.full(b.num_rows * k, n, np.int64)),
                    pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                    pa.array(w.ravel()),
                    pa.array(np.tile(share, b.num_rows)),
                    pa.array(np.full(b.num_rows * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(run, shape)
