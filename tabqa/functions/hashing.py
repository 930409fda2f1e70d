"""Portable deterministic draws.

Random choices must not depend on partitioning or on task retries, so
every draw is a hash of a key that names the draw:
``concat_ws('|', seed, table_id, query_no, slot)``.  ``h`` takes the first
32 bits of the MD5 digest as an unsigned number (0 .. 2**32-1).  The same
number is available in plain SQL engines, which is what makes the random
operators testable against an oracle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296


def key(*parts) -> Column:
    """``concat_ws('|', ...)`` over literals and columns; always name the slot."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def h(k: Column) -> Column:
    """Unsigned 32-bit hash of a string key, as BIGINT."""
    return F.conv(F.substring(F.md5(k), 1, 8), 16, 10).cast("bigint")


def hk(*parts) -> Column:
    """``h(key(parts))``."""
    return h(key(*parts))


def unit(k: Column) -> Column:
    """Uniform number in [0, 1) from a key."""
    return h(k) / F.lit(float(TWO32))


def uniform_int(k: Column, lo, hi) -> Column:
    """Integer uniform on the inclusive range [lo, hi]; bounds may be columns."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return (lo_c + F.pmod(h(k), hi_c - lo_c + 1)).cast("bigint")


def weighted_choice(k: Column, elements: Sequence, weights: Sequence[float], force_index: int | None = None) -> Column:
    """Pick one of ``elements`` with the given weights.

    Draw ``u = h/2^32`` and walk the cumulative weights with a CASE.  With
    ``force_index`` the element is fixed, as the reference's forced id does.
    Zero-weight elements are never chosen.
    """
    if force_index is not None:
        return F.lit(elements[force_index])
    u = unit(k)
    expr = None
    steps = thresholds(elements, weights)
    for el, acc in steps[:-1]:
        cond = u < F.lit(acc)
        expr = F.when(cond, F.lit(el)) if expr is None else expr.when(cond, F.lit(el))
    last = F.lit(steps[-1][0])
    return last if expr is None else expr.otherwise(last)


def thresholds(elements: Sequence, weights: Sequence[float]) -> list[tuple]:
    """(element, cumulative probability) for the non-zero weights, in order."""
    total = float(sum(weights))
    acc = 0.0
    out = []
    for el, w in zip(elements, weights):
        if w <= 0:
            continue
        acc += w / total
        out.append((el, acc))
    return out


def pick(k: Column, arr: Column) -> Column:
    """Uniform element of an array column (I2); NULL for an empty array."""
    n = F.size(arr)
    return F.when(n > 0, F.element_at(arr, (F.pmod(h(k), F.greatest(n, F.lit(1))) + 1).cast("int")))


def shuffle_key(seed, *cols) -> Column:
    """Sort key for a deterministic shuffle."""
    return hk(seed, "shuffle", *cols)
