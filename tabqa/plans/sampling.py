"""Deterministic sampling primitives over whole tables (I1-I4) and the results sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabqa.functions.hashing import h, hk, key, pick, weighted_choice
from tabqa.operators import datasets as DS
from tabqa.operators import scoring as O
from tabqa.plans import duck as D
from tabqa.plans.registry import query
from tabqa.plans import scoring as PS
from tabqa.sources.tables import Tables

SEED = 42
OPS = (["=", "like", "in"], [0.6, 0.05, 0.1])


@query(
    "inst_weighted_choice",
    f"SELECT o_orderkey, {D.weighted(D.key(SEED, 'o_orderkey', chr(39) + 'w' + chr(39)), *OPS)} AS choice FROM orders",
)
def inst_weighted_choice(spark, sf_dir):
    """Weighted choice per row: '=' .6, 'like' .05, 'in' .1."""
    o = Tables(spark, sf_dir).orders
    return o.select("o_orderkey", weighted_choice(key(SEED, F.col("o_orderkey"), "w"), *OPS).alias("choice"))


@query(
    "inst_uniform_choice",
    f"""SELECT o_orderkey, [o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR)][1 + {D.h(D.key(SEED, 'o_orderkey', "'u'"))} % 3] AS choice
       FROM orders""",
)
def inst_uniform_choice(spark, sf_dir):
    """Uniform element of a list per row."""
    o = Tables(spark, sf_dir).orders
    arr = F.array("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", pick(key(SEED, F.col("o_orderkey"), "u"), arr).alias("choice"))


def select_n(arr, n, seed, *kparts):
    """``random_select(list, n)``: n < len → n distinct items in list order;
    n == len → the list; n > len → the list plus n-len draws with replacement."""
    size = F.size(arr)
    idx = F.sequence(F.lit(1), size)
    hv = lambda i: hk(seed, *kparts, "sel", i)
    rank = lambda i: F.size(F.filter(idx, lambda j: (hv(j) < hv(i)) | ((hv(j) == hv(i)) & (j < i))))
    fewer = F.transform(F.filter(idx, lambda i: rank(i) < n), lambda i: F.element_at(arr, i))
    extra = F.transform(
        F.sequence(F.lit(1), F.greatest(n - size, F.lit(1))),
        lambda i: F.element_at(arr, (1 + F.pmod(hk(seed, *kparts, "rep", i), size)).cast("int")),
    )
    return F.when(n < size, fewer).when(n == size, arr).otherwise(F.concat(arr, extra))


def _d_select_n():
    hv = lambda i: D.h(D.key(SEED, "p_partkey", "'sel'", i))
    arr = "[p_type, p_brand, p_name, CAST(p_size AS VARCHAR)]"
    n = f"(1 + {D.h(D.key(SEED, 'p_partkey', chr(39) + 'n' + chr(39)))} % 6)"
    rank = f"len(list_filter(range(1, 5), lambda j: {hv('j')} < {hv('i')} OR ({hv('j')} = {hv('i')} AND j < i)))"
    fewer = f"list_transform(list_filter(range(1, 5), lambda i: {rank} < {n}), lambda i: {arr}[i])"
    extra = f"list_transform(range(1, greatest({n} - 4, 1) + 1), lambda i: {arr}[1 + {D.h(D.key(SEED, 'p_partkey', chr(39) + 'rep' + chr(39), 'i'))} % 4])"
    return f"""SELECT p_partkey, CAST({n} AS INTEGER) AS n,
              array_to_string(CASE WHEN {n} < 4 THEN {fewer} WHEN {n} = 4 THEN {arr} ELSE list_concat({arr}, {extra}) END, '|') AS picked
       FROM part"""


@query("inst_select_n", _d_select_n())
def inst_select_n(spark, sf_dir):
    """Choose n of a list keeping its order; n beyond the list repeats draws."""
    p = Tables(spark, sf_dir).part
    arr = F.array("p_type", "p_brand", "p_name", F.col("p_size").cast("string"))
    n = (1 + F.pmod(hk(SEED, F.col("p_partkey"), "n"), F.lit(6))).cast("int")
    return p.select("p_partkey", n.alias("n"), F.array_join(select_n(arr, n, SEED, F.col("p_partkey")), "|").alias("picked"))


@query(
    "inst_repeat_shuffle",
    f"""WITH x AS (SELECT o_orderkey, unnest(list_concat(list_transform(range(0, 1 + o_custkey % 3), lambda r: {{'v': o_orderstatus, 'p': 'a' || CAST(r AS VARCHAR)}}),
                                                      list_transform(range(0, 2), lambda r: {{'v': o_orderpriority, 'p': 'b' || CAST(r AS VARCHAR)}}))) AS e FROM orders)
       SELECT o_orderkey, string_agg(e.v, '|' ORDER BY {D.h(D.key(SEED, 'o_orderkey', 'e.p'))}, e.p) AS shuffled FROM x GROUP BY o_orderkey""",
)
def inst_repeat_shuffle(spark, sf_dir):
    """Expand items by weight, then shuffle by hash (I4): status ×(1 + custkey % 3), priority ×2."""
    o = Tables(spark, sf_dir).orders

    def copies(col, n, tag):
        return F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.struct(F.col(col).alias("v"), F.concat(F.lit(tag), r.cast("string")).alias("p")))

    items = F.concat(copies("o_orderstatus", (F.col("o_custkey") % 3 + 1).cast("int"), "a"), copies("o_orderpriority", F.lit(2), "b"))
    keyed = F.transform(items, lambda e: F.struct(h(key(SEED, F.col("o_orderkey"), e["p"])).alias("k"), e["p"].alias("p"), e["v"].alias("v")))
    return o.select("o_orderkey", F.array_join(F.transform(F.array_sort(keyed), lambda e: e["v"]), "|").alias("shuffled"))


@query(
    "snk_results",
    f"""WITH {PS.d_predictions()}
       SELECT model_id, conv_id, turn, pred, gold, {PS.d_em('pred', 'gold')} AS em FROM preds""",
)
def snk_results(spark, sf_dir):
    """Evaluation results {pred, gold, score} written as JSON lines and read back whole."""
    p = PS.predictions(spark, sf_dir)
    res = p.select("model_id", "conv_id", "turn", "pred", "gold", O.exact_match(F.col("pred"), F.col("gold")).alias("em"))
    path = DS.scratch_path(spark, "results")
    DS.write_jsonl(res, path)
    return DS.read_jsonl(spark, path, "model_id INT, conv_id BIGINT, turn BIGINT, pred STRING, gold STRING, em INT")
