"""A corpus of many small tables as two DataFrames (A3).

``rows``:   table_id BIGINT, row_idx BIGINT, cells ARRAY<STRING>, nums ARRAY<BIGINT or REAL_TYPE>
``tables``: table_id BIGINT, header ARRAY<STRING>, types ARRAY<STRING>, n_rows BIGINT, n_cols INT

Every cell has its text form in ``cells`` (dates as ``yyyy-MM-dd``); INT
and REAL cells also carry their value in ``nums`` (NULL for TEXT/DATE).  A corpus with a
REAL column holds all its numbers as exact decimals (``REAL_TYPE``), any other as BIGINT, so
plans over whole numbers stay in longs.  Cell access
is ``element_at(cells, col_idx + 1)`` with a column index that may itself be a
column, which is what lets one plan evaluate many different queries.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabqa.functions.indexing import row_index

TEXT, INT, DATE, REAL = "TEXT", "INT", "DATE", "REAL"


#: Six places are exact; whole numbers of any BIGINT fit.
REAL_TYPE = "decimal(25,6)"
REAL_PLACES = 6


@dataclass
class Corpus:
    rows: DataFrame
    tables: DataFrame

    def materialize(self) -> "Corpus":
        """Write both parts once, as Parquet, to the session's checkpoint folder.

        A corpus is read by spec drawing, execution and features; pinning it
        avoids recomputing the row numbering each time and cuts the lineage
        (the files live in the shared folder, so executor loss is harmless).
        """
        from tabqa.session import pin

        return Corpus(pin(self.rows, "corpus-rows"), pin(self.tables, "corpus-tables"))


def cell_text(c: Column, typ: str) -> Column:
    if typ == DATE:
        return F.date_format(c, "yyyy-MM-dd")
    if typ == REAL:
        return real_text(c.cast(REAL_TYPE))
    if typ == INT:
        return c.cast("bigint").cast("string")
    return c.cast("string")


def real_text(v: Column) -> Column:
    """A decimal as a float prints: no needless zeros, one place at least."""
    return F.regexp_replace(v.cast(f"decimal(38,{REAL_PLACES})").cast("string"), r"(\.\d+?)0+$", "$1")


def number_type(rows: DataFrame) -> str:
    """Type of the numbers of a corpus: ``bigint``, or ``REAL_TYPE`` if it has REAL columns."""
    return rows.schema["nums"].dataType.elementType.simpleString()


def from_dataframe(
    df: DataFrame,
    table_key: Column | str,
    columns: Sequence[tuple[str, Column | str, str]],
    order: Sequence[str | Column],
    hot_rows: int | None = None,
) -> Corpus:
    """Split a DataFrame into a corpus: one table per ``table_key`` value.

    ``columns`` are (header name, expression, type) with type TEXT/INT/REAL/DATE.
    ``order`` fixes ``row_idx`` inside each table and must be total.
    """
    tk = F.col(table_key) if isinstance(table_key, str) else table_key
    exprs = [(n, F.col(e) if isinstance(e, str) else e, t) for n, e, t in columns]
    # A column that is both shown and ordered by moves once.
    place = {o: f"__o{i}" for i, o in enumerate(order) if isinstance(o, str)}
    shown = [place.get(e) if isinstance(e, str) else None for _, e, _ in columns]
    base = df.select(
        tk.cast("bigint").alias("table_id"),
        *[e.alias(f"__c{i}") for i, (_, e, _) in enumerate(exprs) if not shown[i]],
        *[(F.col(o) if isinstance(o, str) else o).alias(f"__o{i}") for i, o in enumerate(order)],
    )
    kw = {} if hot_rows is None else {"hot_rows": hot_rows}
    idx = row_index(base, ["table_id"], [f"__o{i}" for i in range(len(order))], **kw)
    idx = idx.withColumns({f"__c{i}": F.col(o) for i, o in enumerate(shown) if o})
    numbers = REAL_TYPE if any(t == REAL for _, _, t in exprs) else "bigint"
    rows = idx.select(
        "table_id",
        "row_idx",
        F.array(*[cell_text(F.col(f"__c{i}"), t) for i, (_, _, t) in enumerate(exprs)]).alias("cells"),
        F.array(
            *[
                (F.col(f"__c{i}").cast("bigint" if t == INT else numbers) if t in (INT, REAL) else F.lit(None)).cast(numbers)
                for i, (_, _, t) in enumerate(exprs)
            ]
        ).alias("nums"),
    )
    header = F.array(*[F.lit(n) for n, _, _ in exprs])
    types = F.array(*[F.lit(t) for _, _, t in exprs])
    tables = (
        base.groupBy("table_id")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select("table_id", header.alias("header"), types.alias("types"), "n_rows", F.lit(len(exprs)).alias("n_cols"))
    )
    return Corpus(rows, tables)


# ---------------------------------------------------------------- derived corpora


def orders_by_customer(orders: DataFrame, **kw) -> Corpus:
    """One table per customer: its orders, numbered by order key."""
    return from_dataframe(
        orders,
        "o_custkey",
        [
            ("o_orderstatus", "o_orderstatus", TEXT),
            ("o_orderpriority", "o_orderpriority", TEXT),
            ("o_orderdate", "o_orderdate", DATE),
            ("o_orderkey", "o_orderkey", INT),
            ("o_totalprice", F.col("o_totalprice").cast("bigint"), INT),
        ],
        ["o_orderkey"],
        **kw,
    )


def orders_exact(orders: DataFrame, **kw) -> Corpus:
    """One table per customer with exact prices (REAL)."""
    return from_dataframe(
        orders,
        "o_custkey",
        [
            ("o_orderstatus", "o_orderstatus", TEXT),
            ("o_orderpriority", "o_orderpriority", TEXT),
            ("o_orderdate", "o_orderdate", DATE),
            ("o_orderkey", "o_orderkey", INT),
            ("o_totalprice", "o_totalprice", REAL),
        ],
        ["o_orderkey"],
        **kw,
    )


def orders_hard(orders: DataFrame, **kw) -> Corpus:
    """One table per clerk-sized run of customers with what breaks careless queries: missing group
    values, quotes of both kinds, missing numbers, and numbers whose sums leave BIGINT."""
    k = F.col("o_orderkey")
    quoted = F.when(k % 5 == 0, F.concat(F.lit("O'"), F.col("o_orderstatus"))).when(k % 5 == 1, F.concat(F.lit("the \""), F.col("o_orderstatus"), F.lit("\"")))
    both = F.when(k % 5 == 2, F.concat(F.lit("'"), F.col("o_orderstatus"), F.lit("'\"\\")))
    return from_dataframe(
        orders,
        F.expr("o_custkey div 10"),
        [
            ("status", F.when(k % 7 != 0, F.coalesce(quoted, both, F.col("o_orderstatus"))), TEXT),
            ("priority", F.when(k % 4 != 0, F.substring("o_orderpriority", 1, 1)), TEXT),
            ("day", F.when(k % 9 != 0, F.col("o_orderdate")), DATE),
            ("huge", F.when(k % 11 != 0, F.lit(1 << 62) - (k % 1_000_003) * F.when(k % 3 == 0, 1).otherwise(1 << 40)), INT),
            ("small", F.when(k % 6 != 0, k % 10), INT),
        ],
        ["o_orderkey"],
        **kw,
    )


LINEITEM_ORDER = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def lineitem_by_supplier(lineitem: DataFrame, **kw) -> Corpus:
    """One table per supplier; (orderkey, linenumber) repeats, so order by every column."""
    return from_dataframe(
        lineitem,
        "l_suppkey",
        [
            ("l_returnflag", "l_returnflag", TEXT),
            ("l_linestatus", "l_linestatus", TEXT),
            ("l_shipdate", "l_shipdate", DATE),
            ("l_linenumber", "l_linenumber", INT),
            ("l_quantity", F.col("l_quantity").cast("bigint"), INT),
        ],
        LINEITEM_ORDER,
        **kw,
    )


def parts_by_brand(part: DataFrame, **kw) -> Corpus:
    """One table per brand number, numbered by part key."""
    return from_dataframe(
        part,
        F.substring("p_brand", 7, 10).cast("int"),
        [
            ("p_name", "p_name", TEXT),
            ("p_type", "p_type", TEXT),
            ("p_size", "p_size", INT),
            ("p_partkey", "p_partkey", INT),
        ],
        ["p_partkey"],
        **kw,
    )


def text_roles(types: Column) -> tuple[Column, Column]:
    """Column indices (0-based) of text (TEXT/DATE) and numeric (INT/REAL) columns."""
    idx = F.sequence(F.lit(0), F.size(types) - 1)
    text = F.filter(idx, lambda i: F.element_at(types, i + 1).isin(TEXT, DATE))
    num = F.filter(idx, lambda i: F.element_at(types, i + 1).isin(INT, REAL))
    return text, num
