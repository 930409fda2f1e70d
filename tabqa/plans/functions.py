"""Scalar helpers applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabqa.functions import text as T
from tabqa.functions.hashing import hk
from tabqa.plans import duck as D
from tabqa.plans.registry import query
from tabqa.sources.tables import Tables

SEED = 42


@query(
    "fn_is_integer",
    """SELECT o_orderkey,
              CAST(coalesce(regexp_matches(trim(o_orderpriority), '^[+-]?\\d+$'), false) AS INTEGER) AS a,
              CAST(coalesce(regexp_matches(trim(' -' || CAST(o_orderkey AS VARCHAR) || ' '), '^[+-]?\\d+$'), false) AS INTEGER) AS b,
              CAST(coalesce(regexp_matches(trim(CAST(o_custkey AS VARCHAR) || '.0'), '^[+-]?\\d+$'), false) AS INTEGER) AS c
       FROM orders""",
)
def fn_is_integer(spark, sf_dir):
    """Optional sign and digits after trimming."""
    o = Tables(spark, sf_dir).orders
    return o.select(
        "o_orderkey",
        T.is_integer(F.col("o_orderpriority")).cast("int").alias("a"),
        T.is_integer(F.concat(F.lit(" -"), F.col("o_orderkey").cast("string"), F.lit(" "))).cast("int").alias("b"),
        T.is_integer(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).cast("int").alias("c"),
    )


_N = "(o_custkey % 20)"


@query(
    "fn_jitter",
    f"""SELECT o_orderkey, CAST(greatest(1, {_N} - 5) + {D.h(D.key(SEED, 'o_orderkey', "'jit'"))} % ({_N} + 5 - greatest(1, {_N} - 5) + 1) AS BIGINT) AS v
       FROM orders""",
)
def fn_jitter(spark, sf_dir):
    """Uniform integer in [max(1, n-5), n+5]."""
    o = Tables(spark, sf_dir).orders
    n = F.col("o_custkey") % 20
    return o.select("o_orderkey", T.jitter(n, hk(SEED, F.col("o_orderkey"), "jit")).cast("bigint").alias("v"))


@query(
    "fn_squeeze_spaces",
    "SELECT o_orderkey, regexp_replace(replace(o_orderpriority, '-', '   '), ' {2}', ' ', 'g') AS v FROM orders",
)
def fn_squeeze_spaces(spark, sf_dir):
    """One pass of two-spaces-to-one (P3): three spaces become two."""
    o = Tables(spark, sf_dir).orders
    return o.select("o_orderkey", T.squeeze_spaces(F.replace(F.col("o_orderpriority"), F.lit("-"), F.lit("   "))).alias("v"))


_TPL_SQL = "'select ( [s' || CAST(o_custkey % 4 + 1 AS VARCHAR) || ', s' || CAST(o_orderkey % 3 + 1 AS VARCHAR) || '] ) x'"


@query(
    "fn_subsql_list",
    f"""SELECT o_orderkey, array_to_string(list_transform(string_split(regexp_extract({_TPL_SQL}, '\\[(.*?)\\]', 1), ','), lambda x: trim(x)), '|') AS v
       FROM orders""",
)
def fn_subsql_list(spark, sf_dir):
    """Items of the ``[s1, s2]`` list in a template text."""
    o = Tables(spark, sf_dir).orders
    tpl = F.concat(
        F.lit("select ( [s"), (F.col("o_custkey") % 4 + 1).cast("string"), F.lit(", s"),
        (F.col("o_orderkey") % 3 + 1).cast("string"), F.lit("] ) x"),
    )
    return o.select("o_orderkey", F.array_join(T.subsql_list(tpl), "|").alias("v"))


@query("fn_prefix", "SELECT p_partkey, substr(p_name, 1, 3) AS v FROM part")
def fn_prefix(spark, sf_dir):
    """First three characters of a value, the LIKE prefix."""
    p = Tables(spark, sf_dir).part
    return p.select("p_partkey", T.prefix(F.col("p_name")).alias("v"))


@query(
    "fn_to_number",
    """SELECT o_orderkey, TRY_CAST(CAST(o_custkey AS VARCHAR) || '.' || CAST(o_orderkey % 100 AS VARCHAR) AS DOUBLE) AS a,
              CAST(TRY_CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) AS DOUBLE) AS b FROM orders""",
)
def fn_to_number(spark, sf_dir):
    """With a dot → float, else int."""
    o = Tables(spark, sf_dir).orders
    return o.select(
        "o_orderkey",
        T.to_number_text(F.concat(F.col("o_custkey").cast("string"), F.lit("."), (F.col("o_orderkey") % 100).cast("string"))).alias("a"),
        T.to_number_text(F.col("o_orderkey").cast("string")).alias("b"),
    )


@query(
    "fn_replace_nth",
    """SELECT doc_id, CAST(len(p) - 1 AS INTEGER) AS n_found,
              CASE WHEN n < len(p) THEN array_to_string(p[1:n], 'an') || '<AN>' || array_to_string(p[n + 1:], 'an') END AS v
       FROM (SELECT doc_id, string_split(text, 'an') AS p, doc_id % 5 + 1 AS n FROM documents)""",
)
def fn_replace_nth(spark, sf_dir):
    """Occurrences of a text counted, and the n-th replaced (P5)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sub = F.lit("an")
    return d.select("doc_id", T.count_of(F.col("text"), sub).alias("n_found"), T.replace_nth(F.col("text"), sub, F.lit("<AN>"), F.col("doc_id") % 5 + 1).alias("v"))


@query(
    "fn_replace_each",
    """SELECT o_orderkey, o_orderstatus || ' on ' || strftime(o_orderdate, '%Y-%m-%d') || ' by ' || o_custkey AS v FROM orders""",
)
def fn_replace_each(spark, sf_dir):
    """The places of a template filled one after the other (P5)."""
    o = Tables(spark, sf_dir).orders
    news = F.array(F.col("o_orderstatus"), F.col("o_orderdate").cast("date").cast("string"), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", T.replace_each(F.lit("{} on {} by {}"), F.lit("{}"), news).alias("v"))


@query(
    "fn_replace_range",
    """SELECT doc_id, substring(text, 1, a) || replace(substring(text, a + 1, 60), 'e', 'EE') || substring(text, a + 61) AS v
       FROM (SELECT doc_id, text, CAST(doc_id % 40 AS INTEGER) AS a FROM documents)""",
)
def fn_replace_range(spark, sf_dir):
    """A text replaced inside a range of characters only."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = F.col("doc_id") % 40
    return d.select("doc_id", T.replace_range(F.col("text"), a, a + 60, F.lit("e"), F.lit("EE")).alias("v"))
