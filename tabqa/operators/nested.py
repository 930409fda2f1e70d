"""Two- and three-level queries built on level-1 answers.

Level-1 specs are drawn with the sub-query rules (flag 'd'), answered by
the batched executor, filtered by the acceptance rule for scalar
sub-queries, and the outer comparison is drawn and evaluated as column
expressions — the level-1 answer is joined, never re-executed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabqa.functions.hashing import hk, key, unit, weighted_choice
from tabqa.operators.batch import SALT_ROWS, Answers, execute
from tabqa.operators.render import _py_repr
from tabqa.operators.specs import CODE_ENGLISH
from tabqa.session import pin
from tabqa.sources.corpus import real_text

KEY = ["table_id", "query_no"]
# Emission weights of two- and three-level queries, and the aggregates a pair may combine.
P_EQ_SELF = 0.4
TEXT_OPS = (["=", "in"], [0.5, 0.6])


def op_and_value(specs: DataFrame, answers: DataFrame, rows: DataFrame, seed: int) -> DataFrame:
    """d1: for each accepted level-1 spec, ``select ( sub ) op value`` with its 1/0 answer."""
    a = answers.select(*KEY, "n_ans_rows", F.col("first_value").alias("answer"))
    j = specs.join(a, KEY)
    s1 = F.element_at("s_cols", 1)
    ok = (F.col("n_ans_rows") > 0) & (F.col("n_ans_rows") != F.col("n_rows")) & F.col("answer").isNotNull() & (F.col("answer") != "None")
    ok = ok & ((F.col("s_kind") == "agg") | (F.col("n_ans_rows") == 1))
    j = j.where(ok).select(
        *KEY, "sql", "n_rows", "answer", s1.alias("scol"),
        ((F.col("s_kind") == "agg") | F.array_contains("ic", s1)).alias("is_num"),
    )
    k = lambda slot: key(seed, F.col("table_id"), F.col("query_no"), "d1", slot)
    # three sampled cells of the selected column (text '=' / 'in' values)
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.pmod(hk(seed, F.col("table_id"), F.col("query_no"), "d1", f"r{i}"), F.col("n_rows")).cast("bigint").alias("row_idx")) for i in range(3)])
    need = j.select(*KEY, "scol", F.explode(slots).alias("x")).select(*KEY, "scol", "x.slot", "x.row_idx")
    cells = need.join(rows.select("table_id", "row_idx", "cells"), ["table_id", "row_idx"]).groupBy(*KEY).agg(
        *[F.max(F.when(F.col("slot") == i, F.element_at("cells", F.col("scol") + 1))).alias(f"c{i}") for i in range(3)]
    )
    j = j.join(cells, KEY, "left")
    n = F.col("answer").try_cast("bigint")
    lo = F.greatest(F.lit(1), n - 5)
    jit = lo + F.pmod(hk(seed, F.col("table_id"), F.col("query_no"), "d1", "jit"), n + 5 - lo + 1)
    num_op = F.element_at(F.array(F.lit("="), F.lit(">"), F.lit("<")), (F.pmod(hk(seed, F.col("table_id"), F.col("query_no"), "d1", "op"), F.lit(3)) + 1).cast("int"))
    text_op = weighted_choice(k("op"), *TEXT_OPS)
    eq_self = unit(k("eq")) < P_EQ_SELF
    op = F.when(F.col("is_num"), num_op).otherwise(text_op)
    num_val = F.when((op == "=") & eq_self, n).otherwise(jit)
    text_val = F.when(eq_self, F.col("answer")).otherwise(F.col("c0"))
    result = (
        F.when(F.col("is_num") & (op == "="), n == num_val)
        .when(F.col("is_num") & (op == ">"), n > num_val)
        .when(F.col("is_num"), n < num_val)
        .when(op == "=", F.col("answer") == text_val)
        .otherwise((F.col("answer") == F.col("c0")) | (F.col("answer") == F.col("c1")) | (F.col("answer") == F.col("c2")))
    )
    value_text = (
        F.when(F.col("is_num"), num_val.cast("string"))
        .when(op == "=", F.concat(F.lit("'"), text_val, F.lit("'")))
        .otherwise(F.concat(F.lit("( '"), F.col("c0"), F.lit("' , '"), F.col("c1"), F.lit("' , '"), F.col("c2"), F.lit("' )")))
    )
    sql = F.regexp_replace(F.concat(F.lit("select ( "), F.col("sql"), F.lit(" ) "), op, F.lit(" "), value_text), " {2}", " ")
    return j.select(
        *KEY, sql.alias("sql"), F.coalesce(result, F.lit(False)).cast("int").cast("string").alias("answer"),
        F.concat(op, F.lit(" "), value_text).alias("op_value"),
    )


# The sentences that link the traces of a nested query's parts.
LINK_ONE = 'This query is a nested query that requires obtaining a query result first, and then using this query result as the "where condition" to do the next query.'
LINK_MATCH = "Then, if the process of the previous query matches {}. True or False."
LINK_WHERE = 'The process of the previous query is the where condition of the next query. The filtering conditions need to meet {} "answer of last step".'
LINK_TWO = "This query is a nested query that requires obtaining the results of two queries first, and then calculating the results of both queries"
LINK_TRUE = "Finally, determine whether the answer to the first query is {} the answer to the second query."
LINK_CALC = "Finally, calculate the {} the answers to the first query and the second query."


def english(code: Column) -> Column:
    """An operator or aggregate in words."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in CODE_ENGLISH.items() for x in kv]), code)


def linked_match(nested: DataFrame, sub_traces: DataFrame) -> DataFrame:
    """M24 of d1: the turns of the sub-query between its linking sentences.

    ``nested`` comes from ``op_and_value``, ``sub_traces`` has ``turn_input, turn_output`` of the level-1 specs.
    """
    j = nested.join(sub_traces.select(*KEY, "turn_input", "turn_output"), KEY)
    last = F.concat(F.lit(LINK_MATCH.split("{}")[0]), F.col("op_value"), F.lit(LINK_MATCH.split("{}")[1]))
    return j.select(
        *KEY, "sql", "answer",
        F.concat(F.array(F.lit(LINK_ONE)), F.col("turn_input"), F.array(last)).alias("turn_input"),
        F.concat(F.array(F.lit("")), F.col("turn_output"), F.array(F.concat(F.lit("Answer is "), F.col("answer")))).alias("turn_output"),
    )


def linked_where(specs: DataFrame, sub_traces: DataFrame, outer_traces: DataFrame) -> DataFrame:
    """M24 of d2-d4: the sub-query's turns, the link, then the outer query's turns over the rows admitted.

    ``specs`` comes from ``where_nested``; both traces are keyed as the specs.
    """
    outer = outer_traces.select(*KEY, F.col("turn_input").alias("o_in"), F.col("turn_output").alias("o_out"))
    sub = sub_traces.select(*KEY, "turn_input", "turn_output")
    j = specs.select(*KEY, "sql", "header", "n_col", "n_op").join(sub, KEY).join(outer, KEY)
    need = F.concat(F.element_at("header", F.col("n_col") + 1), F.lit(" "), F.col("n_op"))
    link = F.concat(F.lit(LINK_WHERE.split("{}")[0]), need, F.lit(LINK_WHERE.split("{}")[1]))
    return j.select(
        *KEY, "sql",
        F.concat(F.array(F.lit(LINK_ONE)), F.col("turn_input"), F.array(link), F.col("o_in")).alias("turn_input"),
        F.concat(F.array(F.lit("")), F.col("turn_output"), F.array(F.lit("")), F.col("o_out")).alias("turn_output"),
    )


def linked_pair(pairs: DataFrame, traces: DataFrame) -> DataFrame:
    """M24 of t1: the turns of both queries, the sentence that combines them (set operations have none) and the answer.

    ``pairs`` comes from ``pair_ops``, ``traces`` has the turns of its specs; an answer is printed as a list of tuples.
    """
    side = lambda i: traces.select("table_id", F.col("query_no").alias(f"query_no{i}"), F.col("turn_input").alias(f"in{i}"), F.col("turn_output").alias(f"out{i}"))
    j = pairs.join(side(1), ["table_id", "query_no1"]).join(side(2), ["table_id", "query_no2"])
    word = english(F.col("op"))
    around = lambda text: F.concat(F.lit(text.split("{}")[0]), word, F.lit(text.split("{}")[1]))
    last = F.when(F.col("op").isin(">", "<", "="), F.array(around(LINK_TRUE))).when(F.col("op").isin("+", "-"), F.array(around(LINK_CALC)))
    several = F.array_join(F.transform("vs", lambda v: F.concat(F.lit("("), _py_repr(v, F.lit(False)), F.lit(",)"))), ", ")
    answer = F.when(F.col("op").isin("union", "intersect"), F.coalesce(several, F.lit(""))).otherwise(F.concat(F.lit("("), F.col("answer"), F.lit(",)")))
    return j.select(
        "table_id", "pair", "sql", "answer",
        F.concat(F.array(F.lit(LINK_TWO)), F.col("in1"), F.col("in2"), F.coalesce(last, F.array().cast("array<string>"))).alias("turn_input"),
        F.concat(F.array(F.lit("")), F.col("out1"), F.col("out2"), F.array(F.concat(F.lit("The answer is ["), answer, F.lit("]")))).alias("turn_output"),
    )


# Weights of the comparison with a sub-query on a numeric column.
NEST_NUM_OPS = ([">", "<", "="], [0.4, 0.4, 0.2])


def where_nested(outer: DataFrame, sub: DataFrame, sub_answers: Answers, seed: int) -> tuple[DataFrame, DataFrame]:
    """d2-d4: ``... where c op ( q )`` queries.

    ``outer`` and ``sub`` are specs over the same tables; those of one (table_id, query_no)
    make a query if the sub-query is accepted: one plain column, an answer neither
    empty nor of every row, its first value not NULL, and a single row where the column
    is numeric.  Text columns compare with ``=`` (one value) or ``in``, numeric ones with a
    drawn operator.  The level-1 answer is never executed again: a number becomes a literal of
    the outer spec, the values of a text column, which only accepted sub-queries put together, are looked up for the
    rows that the rest of the outer WHERE selects.  Returns the outer specs, with their ``sql`` and
    ``NEST_COLS``, and those values (``table_id, query_no, value``).
    """
    s1 = F.try_element_at("s_cols", F.lit(1))
    a = sub.select(*KEY, F.col("sql").alias("sub_sql"), s1.alias("ncol"), F.array_contains("ic", s1).alias("is_num"), F.col("s_kind").alias("sub_kind"))
    a = a.join(sub_answers.answers.select(*KEY, F.col("n_rows").alias("sub_rows"), "n_ans_rows", "n_ans_cols", "first_value"), KEY)
    one = F.when(F.col("is_num"), F.col("n_ans_rows") == 1).otherwise(F.lit(True))
    ok = (F.col("n_ans_rows") > 0) & (F.col("n_ans_rows") != F.col("sub_rows")) & F.col("first_value").isNotNull()
    ok = ok & (F.col("sub_kind") == "cols") & (F.col("n_ans_cols") == 1) & one
    op = F.when(F.col("is_num"), weighted_choice(key(seed, F.col("table_id"), F.col("query_no"), "nest", "op"), *NEST_NUM_OPS)).otherwise(
        F.when(F.col("n_ans_rows") == 1, "=").otherwise("in")
    )
    a = a.where(ok).select(*KEY, "sub_sql", F.when(F.col("is_num"), "num").otherwise("text").alias("n_kind"), F.col("ncol").alias("n_col"), op.alias("n_op"), F.col("first_value").alias("n_val"))
    o = outer.join(a, KEY)
    cond = F.concat(F.element_at("header", F.col("n_col") + 1), F.lit(" "), F.col("n_op"), F.lit(" ( "), F.col("sub_sql"), F.lit(" )"))
    lead = F.when(F.col("w_n") > 0, F.lit(" and ")).otherwise(F.lit(" where "))
    split = r"^(.*?)\s*(order by .*)?$"
    sql = F.concat(F.regexp_extract("sql", split, 1), lead, cond, F.lit(" "), F.regexp_extract("sql", split, 2))
    specs = pin(o.withColumn("sql", F.trim(F.regexp_replace(sql, " {2}", " "))).drop("sub_sql"), "nested-specs")
    values = sub_answers.only(specs.where("n_kind = 'text'")).answer_rows
    values = pin(values.select(*KEY, F.try_element_at("vals", F.lit(1)).alias("value")).where(F.col("value").isNotNull()).distinct(), "nested-values")
    return specs, values


def answer_nested(specs: DataFrame, values: DataFrame, rows: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """The answers of ``where_nested``'s queries, with their whole texts."""
    return execute(rows, specs, salt_rows, admitted=values).assembled().texts(lists=False)


# Fixed values, as above.
PAIR_NUM_OPS = ([">", "<", "+", "-"], [0.1, 0.1, 0.35, 0.35])
ALLOWED_AGG_SETS = [["count"], ["max"], ["min"], ["max", "min"]]


def pair_ops(specs: DataFrame, answers: DataFrame, answer_rows: DataFrame, seed: int) -> DataFrame:
    """t1: ``select ( q1 ) op ( q2 )`` or ``q1 union|intersect q2`` for query pairs (2k, 2k+1)
    drawn from the same template (I8, E4, H1, H2 over corpora).  Besides the query and its answer: the
    operator, the numbers of both specs and the values ``vs`` of a set operation."""
    a = specs.join(answers.select(*KEY, "n_ans_rows", "first_value"), KEY).select(
        "table_id", (F.floor(F.col("query_no") / 2)).cast("int").alias("pair"), (F.col("query_no") % 2).alias("side"),
        "sql", "s_kind", "s_agg", "s_cols", "ic", "n_ans_rows", F.col("first_value").alias("first"),
        F.col("query_no"),
    )
    q1 = a.where(F.col("side") == 0).select("table_id", "pair", *[F.col(c).alias(c + "1") for c in ["sql", "s_kind", "s_agg", "s_cols", "ic", "n_ans_rows", "first", "query_no"]])
    q2 = a.where(F.col("side") == 1).select("table_id", "pair", *[F.col(c).alias(c + "2") for c in ["sql", "s_kind", "s_agg", "s_cols", "n_ans_rows", "first", "query_no"]])
    j = q1.join(q2, ["table_id", "pair"])
    both_plain = (F.col("s_kind1") != "agg") & (F.col("s_kind2") != "agg") & (F.col("s_cols1") == F.col("s_cols2"))
    aggs = F.array_sort(F.array_distinct(F.array("s_agg1", "s_agg2")))
    both_agg = (F.col("s_kind1") == "agg") & (F.col("s_kind2") == "agg") & aggs.isin(*[F.array(*[F.lit(x) for x in s]) for s in ALLOWED_AGG_SETS])
    ok = (
        (F.col("sql1") != F.col("sql2")) & (both_plain | both_agg)
        & (F.col("n_ans_rows1") > 0) & (F.col("n_ans_rows2") > 0)
        & F.col("first1").isNotNull() & (F.col("first1") != "None") & F.col("first2").isNotNull() & (F.col("first2") != "None")
    )
    j = j.where(ok)
    is_num = (F.col("s_kind1") == "agg") | F.array_contains("ic1", F.element_at("s_cols1", 1))
    k = lambda slot: key(seed, F.col("table_id"), F.col("pair"), "t1", slot)
    op = (
        F.when(is_num, weighted_choice(k("op"), *PAIR_NUM_OPS))
        .when(F.col("sql1").contains("limit"), F.lit("="))
        .otherwise(weighted_choice(k("set"), ["union", "intersect"], [1, 1]))
    )
    j = j.withColumn("op", op)
    n1, n2 = F.col("first1").try_cast("decimal(25,6)"), F.col("first2").try_cast("decimal(25,6)")
    whole = ~F.col("first1").contains(".") & ~F.col("first2").contains(".")
    text = lambda v: F.when(whole, v.cast("decimal(38,0)").cast("string")).otherwise(real_text(v))
    scalar = (
        F.when(F.col("op") == ">", (n1 > n2).cast("int").cast("string"))
        .when(F.col("op") == "<", (n1 < n2).cast("int").cast("string"))
        .when(F.col("op") == "+", text(n1 + n2))
        .when(F.col("op") == "-", text(n1 - n2))
        .when(F.col("op") == "=", (F.col("first1") == F.col("first2")).cast("int").cast("string"))
    )
    # set operations over the first column of both answers (distinct, sorted like SQLite's compound select)
    vals = answer_rows.select("table_id", "query_no", F.element_at("vals", 1).alias("v"))
    setj = j.where(F.col("op").isin("union", "intersect")).select("table_id", "pair", "op", "query_no1", "query_no2")
    side1 = setj.join(vals.withColumnRenamed("query_no", "query_no1"), ["table_id", "query_no1"]).select("table_id", "pair", "op", "v", F.lit(1).alias("s"))
    side2 = setj.join(vals.withColumnRenamed("query_no", "query_no2"), ["table_id", "query_no2"]).select("table_id", "pair", "op", "v", F.lit(2).alias("s"))
    per_v = side1.unionByName(side2).where(F.col("v").isNotNull()).groupBy("table_id", "pair", "op", "v").agg(
        F.countDistinct("s").alias("ns")
    )
    kept = per_v.where((F.col("op") == "union") | (F.col("ns") == 2))
    sets = kept.groupBy("table_id", "pair").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    set_ans = F.when(F.size("vs") == 0, F.lit("")).when(F.size("vs") == 1, F.element_at("vs", 1)).otherwise(F.array_join("vs", ", "))
    j = j.join(sets, ["table_id", "pair"], "left")
    sql = F.when(
        F.col("op").isin("union", "intersect"), F.concat(F.col("sql1"), F.lit(" "), F.col("op"), F.lit(" "), F.col("sql2"))
    ).otherwise(F.concat(F.lit("select ( "), F.col("sql1"), F.lit(" ) "), F.col("op"), F.lit(" ( "), F.col("sql2"), F.lit(" )")))
    answer = F.when(F.col("op").isin("union", "intersect"), F.coalesce(set_ans, F.lit(""))).otherwise(scalar)
    return j.select("table_id", "pair", F.regexp_replace(sql, " {2}", " ").alias("sql"), answer.alias("answer"), "op", "query_no1", "query_no2", "vs")
