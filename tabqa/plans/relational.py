"""Query surface on whole test tables: projections, predicates, sub-queries,
aggregation, top-1 and set operations (C-H).

Literals are fixed parameters, the way benchmark queries carry them; each
query scans its whole table.  Dates are compared as ``yyyy-MM-dd`` text
(the reference stores DATE as text).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabqa.operators import relational as R
from tabqa.plans.registry import query
from tabqa.sources.tables import Tables

def _qty():
    return F.col("l_quantity").cast("bigint")


# ------------------------------------------------------------------ flagship


@query(
    "flagship",
    """
    SELECT o_orderpriority, count(o_orderkey) AS n_orders
    FROM orders WHERE o_orderstatus = 'F'
    GROUP BY o_orderpriority HAVING count(o_orderkey) > 5
    ORDER BY n_orders DESC, o_orderpriority NULLS FIRST LIMIT 1
    """,
)
def flagship(spark, sf_dir):
    """Priority with the most orders among status F, groups with more than 5 (s7 shape)."""
    o = Tables(spark, sf_dir).orders
    g = (
        o.where(F.col("o_orderstatus") == "F")
        .groupBy("o_orderpriority")
        .agg(F.count("o_orderkey").alias("n_orders"))
        .where(F.col("n_orders") > 5)
    )
    return R.top1(g, F.col("n_orders"), True, ["o_orderpriority"])


# ------------------------------------------------------------------ C: projections


@query("sel_one", "SELECT o_orderpriority FROM orders")
def sel_one(spark, sf_dir):
    return Tables(spark, sf_dir).orders.select("o_orderpriority")


@query("sel_many", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def sel_many(spark, sf_dir):
    return Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")


def _arith_q(op):
    def fn(spark, sf_dir):
        li = Tables(spark, sf_dir).lineitem
        return li.select(
            "l_orderkey",
            "l_linenumber",
            R.arith(_qty(), op, F.col("l_linenumber").cast("bigint") - 1).cast("bigint").alias("v"),
        )

    return fn


for _name, _op, _sql in [
    ("sel_arith_add", "+", "CAST(l_quantity AS BIGINT) + (CAST(l_linenumber AS BIGINT) - 1)"),
    ("sel_arith_sub", "-", "CAST(l_quantity AS BIGINT) - (CAST(l_linenumber AS BIGINT) - 1)"),
    ("sel_arith_mul", "*", "CAST(l_quantity AS BIGINT) * (CAST(l_linenumber AS BIGINT) - 1)"),
    (
        "sel_arith_div",
        "/",
        "CASE WHEN l_linenumber - 1 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) // (CAST(l_linenumber AS BIGINT) - 1) END",
    ),
]:
    query(_name, f"SELECT l_orderkey, l_linenumber, CAST({_sql} AS BIGINT) AS v FROM lineitem")(_arith_q(_op))


@query("sel_group_key", "SELECT o_orderpriority FROM orders GROUP BY o_orderpriority")
def sel_group_key(spark, sf_dir):
    return Tables(spark, sf_dir).orders.select("o_orderpriority").distinct()


@query(
    "sel_group_key_agg",
    """SELECT o_custkey, count(o_orderkey) AS n FROM orders
       GROUP BY o_custkey HAVING count(o_orderkey) > 15""",
)
def sel_group_key_agg(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n")).where(F.col("n") > 15)


@query(
    "sel_agg_arith",
    """SELECT CAST(sum(l_partkey - l_suppkey) AS BIGINT) AS sum_v, min(l_partkey - l_suppkey) AS min_v,
              max(l_partkey - l_suppkey) AS max_v, count(l_partkey - l_suppkey) AS count_v
       FROM lineitem WHERE l_returnflag = 'R'""",
)
def sel_agg_arith(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem.where(F.col("l_returnflag") == "R")
    d = R.arith(F.col("l_partkey"), "-", F.col("l_suppkey"))
    return li.agg(
        F.sum(d).cast("bigint").alias("sum_v"),
        F.min(d).alias("min_v"),
        F.max(d).alias("max_v"),
        F.count(d).alias("count_v"),
    )


# ------------------------------------------------------------------ D: predicates


@query("pred_text_eq", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def pred_text_eq(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return o.where(R.compare(F.col("o_orderpriority"), "=", "1-URGENT")).select("o_orderkey")


@query("pred_like_prefix", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'BLU%'")
def pred_like_prefix(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    return p.where(R.like_prefix(F.col("p_name"), "BLU")).select("p_partkey", "p_name")


@query("pred_in_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW', '5-LOW')")
def pred_in_list(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return o.where(R.compare(F.col("o_orderpriority"), "in", ["1-URGENT", "5-LOW", "5-LOW"])).select("o_orderkey")


@query(
    "pred_num_cmp",
    """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS qty FROM lineitem
       WHERE CAST(l_quantity AS BIGINT) > 48 OR CAST(l_quantity AS BIGINT) < 2 OR l_partkey = 7""",
)
def pred_num_cmp(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    cond = R.compare(_qty(), ">", 48) | R.compare(_qty(), "<", 2) | R.compare(F.col("l_partkey"), "=", 7)
    return li.where(cond).select("l_orderkey", "l_linenumber", _qty().alias("qty"))


@query("pred_text_cmp", "SELECT p_partkey FROM part WHERE p_name > 'red' AND p_type < 'SMALL'")
def pred_text_cmp(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    return p.where(R.compare(F.col("p_name"), ">", "red") & R.compare(F.col("p_type"), "<", "SMALL")).select("p_partkey")


@query("pred_col_col", "SELECT p_partkey, p_size FROM part WHERE p_size > p_partkey")
def pred_col_col(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    return p.where(F.col("p_size") > F.col("p_partkey")).select("p_partkey", "p_size")


@query(
    "pred_and",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
)
def pred_and(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return o.where(
        R.compare(F.col("o_orderstatus"), "=", "F") & R.compare(F.col("o_orderpriority"), "=", "1-URGENT")
    ).select("o_orderkey")


_OPS = [">", "<", "="]
_OPN = {">": "gt", "<": "lt", "=": "eq"}


@query(
    "pred_and_same_col",
    "SELECT "
    + ", ".join(
        f"CAST(count_if(p_size {a} 20 AND p_size {b} 20) AS BIGINT) AS n_{_OPN[a]}_{_OPN[b]}" for a in _OPS for b in _OPS
    )
    + " FROM part",
)
def pred_and_same_col(spark, sf_dir):
    """Same column, same literal, every operator pair (D8): often contradictory."""
    p = Tables(spark, sf_dir).part
    c = F.col("p_size")
    return p.agg(
        *[
            F.count_if(R.compare(c, a, 20) & R.compare(c, b, 20)).alias(f"n_{_OPN[a]}_{_OPN[b]}")
            for a in _OPS
            for b in _OPS
        ]
    )


@query(
    "pred_and_mixed",
    """SELECT p_partkey, p_name FROM part
       WHERE (p_size < 10 AND p_type = 'SMALL') OR (p_name = 'red widget' AND p_brand = 'Brand#3')
          OR (p_size > 45 AND p_partkey < 500)""",
)
def pred_and_mixed(spark, sf_dir):
    """int+text, text+text and int+int conjunctions."""
    p = Tables(spark, sf_dir).part
    c = (
        (R.compare(F.col("p_size"), "<", 10) & R.compare(F.col("p_type"), "=", "SMALL"))
        | (R.compare(F.col("p_name"), "=", "red widget") & R.compare(F.col("p_brand"), "=", "Brand#3"))
        | (R.compare(F.col("p_size"), ">", 45) & R.compare(F.col("p_partkey"), "<", 500))
    )
    return p.where(c).select("p_partkey", "p_name")


# ------------------------------------------------------------------ E: sub-queries


@query(
    "sub_in",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
       WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)""",
)
def sub_in(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    sub = li.where(F.col("l_quantity") >= 50)
    return R.in_subquery(li, "l_partkey", sub, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "sub_scalar_cmp",
    """SELECT p_partkey FROM part
       WHERE p_size > (SELECT p_size FROM part WHERE p_type = 'LARGE' ORDER BY p_retailprice DESC, p_partkey LIMIT 1)""",
)
def sub_scalar_cmp(spark, sf_dir):
    """``c > (select ...)`` where the sub-query has many rows: its first row counts."""
    p = Tables(spark, sf_dir).part
    sub = p.where(F.col("p_type") == "LARGE").select(
        "p_size", (-F.col("p_retailprice")).alias("k1"), F.col("p_partkey").alias("k2")
    )
    return p.where(F.col("p_size") > R.scalar_first(sub, "p_size", ["k1", "k2"])).select("p_partkey")


@query(
    "sub_scalar_test",
    "SELECT CAST((SELECT max(p_size) FROM part WHERE p_type = 'SMALL') > 45 AS INTEGER) AS v",
)
def sub_scalar_test(spark, sf_dir):
    """``select (select agg ...) op value`` → 1/0."""
    p = Tables(spark, sf_dir).part
    return p.where(F.col("p_type") == "SMALL").agg((F.max("p_size") > 45).cast("int").alias("v"))


@query(
    "sub_scalar_in",
    """SELECT CAST((SELECT min(p_name) FROM part WHERE p_size = 7) IN ('blue bolt', 'red widget', 'black bolt')
       AS INTEGER) AS v""",
)
def sub_scalar_in(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    return p.where(F.col("p_size") == 7).agg(
        F.min("p_name").isin("blue bolt", "red widget", "black bolt").cast("int").alias("v")
    )


_PAIR = (
    "(SELECT max(p_size) FROM part WHERE p_type = 'SMALL')",
    "(SELECT min(p_size) FROM part WHERE p_type = 'LARGE')",
)


def _pair(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    a = p.where(F.col("p_type") == "SMALL").agg(F.max("p_size").alias("a"))
    b = p.where(F.col("p_type") == "LARGE").agg(F.min("p_size").alias("b"))
    # Both sides are one-row global aggregates: a bounded cross product.
    return a.crossJoin(b)


@query("sub_pair_arith", f"SELECT CAST({_PAIR[0]} - {_PAIR[1]} AS BIGINT) AS v")
def sub_pair_arith(spark, sf_dir):
    return _pair(spark, sf_dir).select(R.arith(F.col("a"), "-", F.col("b")).cast("bigint").alias("v"))


@query("sub_pair_cmp", f"SELECT CAST({_PAIR[0]} > {_PAIR[1]} AS INTEGER) AS v")
def sub_pair_cmp(spark, sf_dir):
    return _pair(spark, sf_dir).select((F.col("a") > F.col("b")).cast("int").alias("v"))


@query(
    "sub_where_and",
    """SELECT o_orderkey FROM orders
       WHERE o_orderstatus = 'F' AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)""",
)
def sub_where_and(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    avg_price = o.select(F.avg("o_totalprice")).scalar()
    return o.where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > avg_price)).select("o_orderkey")


@query(
    "sub_order_limit",
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
       ORDER BY o_totalprice DESC, o_orderkey NULLS FIRST LIMIT 1""",
)
def sub_order_limit(spark, sf_dir):
    t = Tables(spark, sf_dir)
    sub = t.customer.where(F.col("c_mktsegment") == "BUILDING")
    x = R.in_subquery(t.orders, "o_custkey", sub, "c_custkey")
    return R.top1(x, F.col("o_totalprice"), True, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


# ------------------------------------------------------------------ F: aggregation


@query(
    "agg_count",
    """SELECT count(o_orderpriority) AS n_text, count(o_custkey) AS n_num FROM orders""",
)
def agg_count(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return o.agg(F.count("o_orderpriority").alias("n_text"), F.count("o_custkey").alias("n_num"))


@query(
    "agg_sum_min_max",
    """SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty,
              min(CAST(l_quantity AS BIGINT)) AS min_qty, max(CAST(l_quantity AS BIGINT)) AS max_qty,
              (SELECT CAST(sum(l_partkey) AS BIGINT) FROM lineitem WHERE l_quantity > 1000) AS sum_empty
       FROM lineitem""",
)
def agg_sum_min_max(spark, sf_dir):
    """Global sum/min/max; an aggregate over no rows is NULL (F2)."""
    li = Tables(spark, sf_dir).lineitem
    empty = li.where(F.col("l_quantity") > 1000).select(F.sum("l_partkey").cast("bigint")).scalar()
    return li.agg(
        F.sum(_qty()).cast("bigint").alias("sum_qty"),
        F.min(_qty()).alias("min_qty"),
        F.max(_qty()).alias("max_qty"),
    ).select("*", empty.alias("sum_empty"))


@query(
    "agg_avg",
    """SELECT l_returnflag, round(avg(CAST(l_quantity AS BIGINT)), 6) AS avg_qty
       FROM lineitem GROUP BY l_returnflag""",
)
def agg_avg(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    return li.groupBy("l_returnflag").agg(F.round(F.avg(_qty()), 6).alias("avg_qty"))


@query("agg_count_star", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def agg_count_star(spark, sf_dir):
    return Tables(spark, sf_dir).orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_count_distinct",
    """SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_cust FROM orders
       GROUP BY o_orderpriority HAVING count(DISTINCT o_custkey) > 10""",
)
def agg_count_distinct(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return (
        o.groupBy("o_orderpriority")
        .agg(F.count_distinct("o_custkey").alias("n_cust"))
        .where(F.col("n_cust") > 10)
    )


@query("agg_group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_group_by(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("agg_having_count", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(o_orderkey) > 15")
def agg_having_count(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("__c")).where(F.col("__c") > 15).select("o_custkey")


@query(
    "agg_having_agg",
    "SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING sum(CAST(l_quantity AS BIGINT)) > 15400",
)
def agg_having_agg(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    return li.groupBy("l_suppkey").agg(F.sum(_qty()).alias("__s")).where(F.col("__s") > 15400).select("l_suppkey")


@query(
    "agg_having_first",
    """SELECT o_custkey FROM orders GROUP BY o_custkey
       HAVING min_by(o_totalprice, o_orderkey) > 400000""",
)
def agg_having_first(spark, sf_dir):
    """Bare column in HAVING read as the group's first row (F8)."""
    o = Tables(spark, sf_dir).orders
    return (
        o.groupBy("o_custkey")
        .agg(R.having_first(F.col("o_totalprice"), F.col("o_orderkey")).alias("__v"))
        .where(F.col("__v") > 400000)
        .select("o_custkey")
    )


@query(
    "agg_having_every",
    """SELECT o_custkey FROM orders GROUP BY o_custkey
       HAVING bool_and(o_orderstatus = 'F')""",
)
def agg_having_every(spark, sf_dir):
    """Bare column in HAVING read as 'every row satisfies' (F8, the trace's reading)."""
    o = Tables(spark, sf_dir).orders
    return (
        o.groupBy("o_custkey")
        .agg(R.having_every(F.col("o_orderstatus") == "F").alias("__ok"))
        .where(F.col("__ok"))
        .select("o_custkey")
    )


@query(
    "agg_having_col_col",
    """SELECT p_type FROM part GROUP BY p_type
       HAVING min_by(p_size, p_partkey) > min_by(p_partkey, p_partkey)""",
)
def agg_having_col_col(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    return (
        p.groupBy("p_type")
        .agg(
            R.having_first(F.col("p_size"), F.col("p_partkey")).alias("__a"),
            R.having_first(F.col("p_partkey"), F.col("p_partkey")).alias("__b"),
        )
        .where(F.col("__a") > F.col("__b"))
        .select("p_type")
    )


@query(
    "agg_having_and",
    """SELECT o_custkey FROM orders GROUP BY o_custkey
       HAVING count(o_orderkey) > 12 AND max(o_totalprice) > 450000""",
)
def agg_having_and(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return (
        o.groupBy("o_custkey")
        .agg(F.count("o_orderkey").alias("__c"), F.max("o_totalprice").alias("__m"))
        .where((F.col("__c") > 12) & (F.col("__m") > 450000))
        .select("o_custkey")
    )


@query(
    "agg_where_group_having",
    """SELECT l_suppkey, count(l_orderkey) AS n FROM lineitem
       WHERE l_returnflag = 'N' AND l_linestatus = 'O'
       GROUP BY l_suppkey HAVING count(l_orderkey) < 150""",
)
def agg_where_group_having(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    return (
        li.where((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"))
        .groupBy("l_suppkey")
        .agg(F.count("l_orderkey").alias("n"))
        .where(F.col("n") < 150)
    )


@query(
    "agg_group_having_order",
    """SELECT p_brand, max(p_size) AS max_size FROM part GROUP BY p_brand
       HAVING count(p_partkey) > 5 ORDER BY max(p_size) ASC, p_brand NULLS FIRST LIMIT 1""",
)
def agg_group_having_order(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    g = (
        p.groupBy("p_brand")
        .agg(F.count("p_partkey").alias("__c"), F.max("p_size").alias("max_size"))
        .where(F.col("__c") > 5)
    )
    return R.top1(g, F.col("max_size"), False, ["p_brand"]).select("p_brand", "max_size")


# ------------------------------------------------------------------ G: sort / limit


@query(
    "ord_top1_asc",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC NULLS FIRST, o_orderkey LIMIT 1",
)
def ord_top1_asc(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return R.top1(o, F.col("o_totalprice"), False, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query(
    "ord_top1_desc",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
       ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1""",
)
def ord_top1_desc(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    return R.top1(
        li, F.col("l_extendedprice"), True, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    ).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "ord_top1_group",
    """SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey
       ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey LIMIT 1""",
)
def ord_top1_group(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    g = o.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return R.top1(g, F.col("total"), True, ["o_custkey"])


@query(
    "ord_top1_group_distinct",
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_returnflag
       ORDER BY count(DISTINCT l_partkey) DESC, l_returnflag LIMIT 1""",
)
def ord_top1_group_distinct(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    g = li.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n_parts"))
    return R.top1(g, F.col("n_parts"), True, ["l_returnflag"])


@query(
    "ord_tie_flag",
    """WITH best AS (SELECT l_suppkey, max(CAST(l_quantity AS BIGINT)) AS top_qty FROM lineitem GROUP BY l_suppkey)
       SELECT b.l_suppkey, b.top_qty, CAST(count(*) > 1 AS INTEGER) AS tie
       FROM best b JOIN lineitem l ON l.l_suppkey = b.l_suppkey AND CAST(l.l_quantity AS BIGINT) = b.top_qty
       GROUP BY b.l_suppkey, b.top_qty""",
)
def ord_tie_flag(spark, sf_dir):
    """Top-1 value per supplier with a flag telling whether the top is shared.

    Two partial aggregations and no join back: count rows per (supplier,
    value), then keep the largest value with its count via ``max_by``.
    """
    li = Tables(spark, sf_dir).lineitem
    cnt = li.select("l_suppkey", _qty().alias("q")).groupBy("l_suppkey", "q").agg(F.count(F.lit(1)).alias("c"))
    top = cnt.groupBy("l_suppkey").agg(F.max_by("c", "q").alias("c_top"), F.max("q").alias("top_qty"))
    return top.select("l_suppkey", "top_qty", (F.col("c_top") > 1).cast("int").alias("tie"))


@query(
    "ord_top1_batched",
    """SELECT l_suppkey, arg_max(l_orderkey, (CAST(l_quantity AS BIGINT), -l_orderkey, -l_linenumber)) AS l_orderkey,
              arg_max(l_linenumber, (CAST(l_quantity AS BIGINT), -l_orderkey, -l_linenumber)) AS l_linenumber,
              max(CAST(l_quantity AS BIGINT)) AS qty
       FROM lineitem GROUP BY l_suppkey""",
)
def ord_top1_batched(spark, sf_dir):
    """Per supplier: the row with the largest quantity, ties to the smallest (orderkey, linenumber)."""
    li = Tables(spark, sf_dir).lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", _qty().alias("qty"))
    return R.top1_per_group(li, ["l_suppkey"], "qty", True, ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "qty"])


# ------------------------------------------------------------------ H: set operations


@query(
    "set_union",
    "SELECT p_name FROM part WHERE p_size < 5 UNION SELECT p_name FROM part WHERE p_type = 'SMALL'",
)
def set_union(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    return R.union_distinct(
        p.where(F.col("p_size") < 5).select("p_name"), p.where(F.col("p_type") == "SMALL").select("p_name")
    )


@query(
    "set_intersect",
    "SELECT p_brand FROM part WHERE p_size < 3 INTERSECT SELECT p_brand FROM part WHERE p_type = 'SMALL'",
)
def set_intersect(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    return R.intersect_distinct(
        p.where(F.col("p_size") < 3).select("p_brand"), p.where(F.col("p_type") == "SMALL").select("p_brand")
    )
