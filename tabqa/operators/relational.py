"""Query surface on one DataFrame with the reference's SQL semantics (C-H).

The relational work itself is Catalyst's; these helpers only pin down the
places where the SQL dialect the benchmark was written for differs from
Spark's: case-insensitive LIKE, integer division with a zero divisor,
bare columns in HAVING, multi-row scalar sub-queries, and deterministic
tie-breaking for ``order by ... limit 1``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- projections


def arith(a: Column, op: str, b: Column) -> Column:
    """Row arithmetic ``a op b``.

    ``/`` on integers truncates toward zero and a zero divisor yields NULL,
    as in SQLite; Spark's ANSI division would raise instead.
    """
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        return int_div(a, b)
    raise ValueError(f"unknown operator {op!r}")


def int_div(a: Column, b: Column) -> Column:
    """Integer division truncating toward zero; a zero divisor gives NULL.

    ``a % b`` keeps the dividend's sign (truncated remainder), so
    ``a - a % b`` is an exact multiple of ``b``.
    """
    a = a.cast("bigint")
    b = b.cast("bigint")
    return F.when(b != 0, ((a - a % b) / b).cast("bigint"))


AGGS = {
    "count": F.count,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "avg": F.avg,
}


def agg(name: str, c: Column, distinct: bool = False) -> Column:
    """Aggregate by name; integer sums stay BIGINT."""
    if name == "count":
        return F.count_distinct(c) if distinct else F.count(c)
    if name == "sum":
        return F.sum(c)
    if name in AGGS:
        return AGGS[name](c)
    raise ValueError(f"unknown aggregate {name!r}")


# ---------------------------------------------------------------- predicates


def like_prefix(c: Column, prefix: str) -> Column:
    """``c like 'abc%'`` with SQLite's case folding.

    ``%``, ``_`` and ``\\`` in the value are escaped so the prefix is literal.
    """
    esc = prefix.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return c.ilike(esc + "%")


def compare(c: Column, op: str, v) -> Column:
    """``c op v`` for ``= > < >= <= != like in``."""
    if op == "=":
        return c == v
    if op == ">":
        return c > v
    if op == "<":
        return c < v
    if op == ">=":
        return c >= v
    if op == "<=":
        return c <= v
    if op in ("!=", "<>"):
        return c != v
    if op == "like":
        return like_prefix(c, v)
    if op == "in":
        return c.isin(list(v))
    raise ValueError(f"unknown operator {op!r}")


# ---------------------------------------------------------------- having


def having_first(c: Column, order_key: Column) -> Column:
    """Value of a bare column in HAVING: the group's first row by ``order_key`` (F8)."""
    return F.min_by(c, order_key)


def having_every(cond: Column) -> Column:
    """True when every row of the group satisfies ``cond`` (F8, the trace's reading)."""
    return F.bool_and(cond)


# ---------------------------------------------------------------- sub-queries


def in_subquery(df: DataFrame, col: str, sub: DataFrame, sub_col: str) -> DataFrame:
    """``where col in (select sub_col ...)`` as a left-semi join.

    NULLs never match, as in SQL.  The semi join keeps ``df`` whole; Catalyst
    chooses broadcast or sort-merge from the sub-query's measured size.
    """
    keys = sub.select(F.col(sub_col).alias("__k")).where(F.col("__k").isNotNull())
    return df.join(keys, df[col] == keys["__k"], "left_semi")


def scalar_first(sub: DataFrame, value_col: str, order_cols: Sequence[str] | None = None) -> Column:
    """Scalar sub-query value; with many rows, the first by ``order_cols``.

    SQLite silently takes the first row of a multi-row scalar sub-query;
    Spark raises, so the first row is made explicit.  Planned as a Catalyst
    scalar sub-query: evaluated once, shipped to tasks as a literal.
    """
    s = sub.select(value_col, *(order_cols or []))
    if order_cols:
        s = s.orderBy(*[F.col(c).asc_nulls_first() for c in order_cols]).limit(1)
    else:
        s = s.limit(1)
    return s.select(value_col).scalar()


# ---------------------------------------------------------------- order / limit


def top1(df: DataFrame, by: Column, desc: bool, tie_break: Sequence[str]) -> DataFrame:
    """``order by by [desc] limit 1`` with a deterministic tie-break.

    NULL sorts first ascending (and last descending) as in SQLite.  Runs
    as TakeOrderedAndProject: each task keeps one candidate row.
    """
    o = by.desc_nulls_last() if desc else by.asc_nulls_first()
    return df.orderBy(o, *[F.col(c).asc_nulls_first() for c in tie_break]).limit(1)


def top1_per_group(df: DataFrame, group: Sequence[str], by: str, desc: bool, tie_break: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Top-1 row per group by a numeric column, without a sort.

    One ``min_by`` over a struct ordering key: it is an algebraic aggregate,
    so partial aggregation keeps one candidate per group per task and a hot
    group never lands whole in one task.  NULL is smallest (first ascending,
    last descending); ties go to the smallest ``tie_break`` values.
    """
    v = F.col(by)
    if desc:
        order = F.struct(v.isNull().alias("n"), (-v).alias("v"), *[F.col(c) for c in tie_break])
    else:
        order = F.struct(v.isNotNull().alias("n"), v.alias("v"), *[F.col(c) for c in tie_break])
    payload = F.struct(*[F.col(c) for c in keep])
    return df.groupBy(*group).agg(F.min_by(payload, order).alias("__row")).select(
        *group, *[F.col("__row")[c].alias(c) for c in keep]
    )


# ---------------------------------------------------------------- set operations


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """``q1 union q2`` (H1)."""
    return a.union(b).distinct()


def intersect_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """``q1 intersect q2`` (H2)."""
    return a.intersect(b)
