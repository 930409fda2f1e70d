"""Query features (L1-L11) and the control rules that keep or reject a
generated query (K1-K17), as column expressions over specs ⋈ answers.

Each rule is a named boolean "fails" column, so a run yields both the
kept queries and a rejection report (count per first failing rule).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabqa.operators.batch import BROADCAST_BYTES, TABLE_BYTES, Answers
from tabqa.session import pin

# Fixed word lists of the reference's counters.
FILTER_WORDS = ["=", ">", "<", "in", "like"]
CALC_ONE = ["sum", "count", "min", "max", "+", "-", "*", "/"]
CALC_TWO = ["avg"]
CALC_BASIC = ["sum", "avg", "+", "-", "*", "/"]
AGG_WORDS = ["sum", "count", "min", "max", "avg"]
REJECT_SINGLE = ["None", "0", "NULL", "none"]
REJECT_NESTED = ["None", "NULL", "none"]
VALUE_BYTES = 32  # of a value in an array, besides its text
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"


def _words(sql: Column) -> Column:
    """Python ``str.split()``: runs of whitespace, no empty words."""
    return F.filter(F.split(F.lower(sql), r"\s+"), lambda w: w != "")


def sql_len(sql: Column) -> Column:
    """L1: ``len(sql.split(' '))`` (single spaces; empty pieces count)."""
    return F.size(F.split(sql, " "))


def filter_times(sql: Column) -> Column:
    """L2: number of filter words."""
    return F.size(F.filter(_words(sql), lambda w: w.isin(FILTER_WORDS)))


def calc_times(sql: Column) -> Column:
    """L3: aggregates and arithmetic count 1, avg counts 2."""
    return F.aggregate(
        _words(sql), F.lit(0), lambda a, w: a + F.when(w.isin(CALC_ONE), 1).when(w.isin(CALC_TWO), 2).otherwise(0)
    )


def calc_times_basic(sql: Column) -> Column:
    """L4: the older counter (sum/avg and arithmetic)."""
    return F.size(F.filter(_words(sql), lambda w: w.isin(CALC_BASIC)))


def agg_words(sql: Column) -> Column:
    return F.size(F.filter(_words(sql), lambda w: w.isin(AGG_WORDS)))


def where_cols() -> Column:
    return F.when(F.col("w_n") == 0, F.array().cast("array<int>")).otherwise(
        F.filter(F.array("w1_col", "w1_rcol", "w2_col"), lambda c: c.isNotNull())
    )


def used_cols() -> Column:
    """Distinct columns used by any clause."""
    others = F.filter(F.array("g_col", "h_col", "h_rcol", "o_col"), lambda c: c.isNotNull())
    return F.array_distinct(F.concat(where_cols(), others, F.col("s_cols")))


def depth() -> Column:
    """Group 1 + where columns + having 1 + order 1 + aggregate words."""
    return (
        F.when(F.col("g_col").isNotNull(), 1).otherwise(0)
        + F.size(F.array_distinct(where_cols()))
        + F.when(F.col("h_kind").isNotNull(), 1).otherwise(0)
        + F.when(F.col("o_kind") != "none", 1).otherwise(0)
        + agg_words(F.col("sql"))
    )


def has_dups(arr: Column) -> Column:
    """L11."""
    return F.size(arr) != F.size(F.array_distinct(arr))


def located_values(specs: DataFrame, ans: Answers, rows: DataFrame) -> DataFrame:
    """``table_id, query_no, v``: the value that tells where an answer lies.

    An answer of one row lies where its value does.  An aggregate's value is seldom in the
    table, so it lies where the first row of the same query without the aggregate does;
    that row's number is a minimum inside the aggregation (``Answers.origin``).
    """
    key = ["table_id", "query_no"]
    of = specs.where(F.col("s_kind") == "agg").select(*key, (F.col("s_cols")[0] + 1).alias("c"))
    at = of.join(ans.origin, key).join(rows.select("table_id", "row_idx", "cells"), ["table_id", "row_idx"])
    plain = ans.answers.where(F.col("n_ans_rows") == 1).join(of, key, "left_anti").select(*key, F.col("first_value").alias("v"))
    return plain.unionByName(at.select(*key, F.try_element_at("cells", F.col("c")).alias("v")))


def answer_position(answers: DataFrame, rows: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """First (row, col) in row-major order whose text equals the answer, else (-1, -1).

    ``answers`` has ``n_ans_rows`` and ``first_value``; ``values`` has other values to look for.  A row meets the values
    asked of its table (as many as it has queries) and only cells that equal one of them become rows, whose first places are taken per
    (table, value) as a partial minimum of one number.  Up to ``BROADCAST_BYTES`` of values go to the rows, which then stay where they are.
    """
    single = answers.where(F.col("n_ans_rows") == 1).select("table_id", "query_no", F.col("first_value").alias("v")) if values is None else values
    wanted = pin(single.where(F.col("v").isNotNull()).groupBy("table_id").agg(F.collect_set("v").alias("vs")), "position-values")
    size = wanted.agg(F.sum(F.lit(TABLE_BYTES) + F.aggregate("vs", F.lit(0).cast("bigint"), lambda t, v: t + F.octet_length(v) + VALUE_BYTES))).first()[0] or 0
    table = rows.select("table_id", "row_idx", "cells").join(F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted, "table_id").where(F.arrays_overlap("cells", "vs"))
    cells = table.select("table_id", "row_idx", F.size("cells").cast("bigint").alias("n"), "vs", F.posexplode("cells").alias("col_idx", "v"))
    asked = cells.where(F.array_contains("vs", F.col("v")))
    first = asked.groupBy("table_id", "v").agg(F.min(F.col("row_idx") * F.col("n") + F.col("col_idx")).alias("at"), F.max("n").alias("n"))
    hit = single.join(first, ["table_id", "v"]).select(
        "table_id", "query_no",
        F.struct(F.floor(F.col("at") / F.col("n")).cast("bigint").alias("row_idx"), F.pmod("at", "n").cast("int").alias("col_idx")).alias("p"),
    )
    return answers.select("table_id", "query_no").join(hit, ["table_id", "query_no"], "left").select(
        "table_id", "query_no",
        F.coalesce(F.col("p.row_idx"), F.lit(-1)).alias("ans_row"),
        F.coalesce(F.col("p.col_idx"), F.lit(-1)).alias("ans_col"),
    )


# ---------------------------------------------------------------- controls


@dataclass
class Range:
    available: bool = False
    values: list = field(default_factory=list)
    min: float = 0
    max: float = 0

    def test(self, x: Column, lo_open=False, hi_open=False) -> Column:
        if self.values:
            return x.isin(self.values)
        lo = x > self.min if lo_open else x >= self.min
        hi = x < self.max if hi_open else x <= self.max
        return lo & hi


@dataclass
class Controls:
    """The reference's query controls, defaults as its sample config."""

    keywords_disabled: list = field(default_factory=list)
    length: Range = field(default_factory=lambda: Range(False, [], 6, 16))
    column_ratio: Range = field(default_factory=lambda: Range(False, [], 0.1, 0.3))
    select_row_ratio: Range = field(default_factory=lambda: Range(False, [], 0, 0.2))
    calculate_times: Range = field(default_factory=lambda: Range(False, [0]))
    filter_times: Range = field(default_factory=lambda: Range(False, [0]))
    answer_location: Range = field(default_factory=lambda: Range(False, [], 0, 1))
    answer_location_cols: list = field(default_factory=lambda: [0])
    answer_cells_number: Range = field(default_factory=lambda: Range(True, [], 1, 12))
    include: list = field(default_factory=list)
    exclude: list = field(default_factory=list)
    reject_large_int: bool = True
    reject_ties: bool = False  # queries for one row or group of several with the same ORDER value
    parity: bool = True  # single answers measured in characters, as the reference does


RULES = [
    "K1_null_answer", "K2_list_01", "K3_large_int", "K4_all_rows", "K5_answer_cells", "K6_keywords",
    "K7_length", "K8_column_ratio", "K9_row_ratio", "K10_filter_times", "K11_calc_times",
    "K12_answer_location", "K13_exclude", "K14_include", "G5_ambiguous",
]


#: Rules that read a query and no answer.
SPEC_RULES = ["K6_keywords", "K7_length", "K8_column_ratio", "K10_filter_times", "K11_calc_times", "K13_exclude", "K14_include"]


def spec_rules(specs: DataFrame, c: Controls) -> DataFrame:
    """``SPEC_RULES`` of specs that need not be executed."""
    return specs.select("*", *[F.coalesce(e, F.lit(False)).alias(k) for k, e in _rules(c).items() if k in SPEC_RULES])


def foreseen(c: Controls) -> Column:
    """Whether a query is rejected whatever the cells of its table are: by ``SPEC_RULES``, or since it has no
    condition and lists every row (K4; the answer of a table of one row is measured in characters)."""
    every_row = (F.col("w_n") == 0) & F.col("g_col").isNull() & F.col("s_kind").isin("cols", "calc") & (F.coalesce("o_kind", F.lit("none")) != "col") & (F.col("n_rows") > 1)
    rules = [F.coalesce(e, F.lit(False)) for k, e in _rules(c).items() if k in SPEC_RULES]
    return reduce(lambda a, b: a | b, rules, F.coalesce(every_row, F.lit(False)))


def rule_columns(df: DataFrame, c: Controls) -> DataFrame:
    """Add one boolean column per rule (True = the query fails it).

    ``df`` carries spec and answer columns plus ``ans_row``/``ans_col``.
    """
    return df.select("*", *[F.coalesce(e, F.lit(False)).alias(k) for k, e in _rules(c).items()])


def _rules(c: Controls) -> dict[str, Column]:
    n = F.col("n_ans_rows")
    single = n == 1
    ans_s = F.coalesce(F.col("first_value"), F.lit("None"))  # read where the answer is one row
    nested = F.size(F.split(F.col("sql"), "select")) - 1 > 1
    is_int = single & ans_s.rlike(INTEGER_TEXT)
    as_int = F.trim(ans_s).try_cast("bigint")
    a_len = F.when(n == 0, 0).when(single, F.length(ans_s) if c.parity else F.lit(1)).otherwise(n)
    sql = F.col("sql")
    used = F.size(used_cols())
    return {
        "K1_null_answer": (n == 0)
        | (single & F.when(nested, ans_s.isin(REJECT_NESTED)).otherwise(ans_s.isin(REJECT_SINGLE))),
        "K2_list_01": (n > 1) & F.col("has_01"),
        "K3_large_int": F.lit(c.reject_large_int)
        & is_int
        & F.coalesce((as_int == F.col("n_rows")) | (as_int > F.col("n_rows") - 3), F.lit(True)),
        "K4_all_rows": (a_len == 0) | (a_len == F.col("n_rows")),
        "K5_answer_cells": F.lit(c.answer_cells_number.available) & ~c.answer_cells_number.test(a_len),
        "K6_keywords": F.lit(False)
        if not c.keywords_disabled
        else F.greatest(*[sql.contains(k) for k in c.keywords_disabled], F.lit(False)),
        "K7_length": F.lit(c.length.available) & ~c.length.test(sql_len(sql)),
        "K8_column_ratio": F.lit(c.column_ratio.available)
        & ~(used.isin(c.column_ratio.values) if c.column_ratio.values else c.column_ratio.test(used / F.col("n_cols"))),
        "K9_row_ratio": F.lit(c.select_row_ratio.available)
        & ~(
            F.col("n_selected").isin(c.select_row_ratio.values)
            if c.select_row_ratio.values
            else c.select_row_ratio.test(F.col("n_selected") / F.col("n_rows"))
        ),
        "K10_filter_times": F.lit(c.filter_times.available) & ~filter_times(sql).isin(c.filter_times.values),
        "K11_calc_times": F.lit(c.calculate_times.available) & ~calc_times(sql).isin(c.calculate_times.values),
        "K12_answer_location": F.lit(c.answer_location.available)
        & (
            ~(F.col("ans_row").isin(c.answer_location.values) & F.col("ans_col").isin(c.answer_location_cols))
            if c.answer_location.values
            else ~c.answer_location.test(F.col("ans_row") / F.col("n_rows"), lo_open=True)
        ),
        "K13_exclude": F.lit(False) if not c.exclude else F.greatest(*[sql.contains(x) for x in c.exclude], F.lit(False)),
        "G5_ambiguous": F.col("ambiguous") if c.reject_ties else F.lit(False),
        "K14_include": F.lit(False) if not c.include else ~F.least(*[sql.contains(x) for x in c.include], F.lit(True)),
    }


def first_failure(df: DataFrame) -> Column:
    """Name of the first failing rule, NULL when kept."""
    e = None
    for r in RULES:
        e = F.when(F.col(r), F.lit(r)) if e is None else e.when(F.col(r), F.lit(r))
    return e


def apply(specs: DataFrame, ans: Answers, rows: DataFrame, c: Controls, texts: bool = True) -> DataFrame:
    """specs ⋈ answers ⋈ answer position, with rule columns and ``rejected_by``.

    Rules read the facts of an answer, whatever its size.  ``answer`` is the whole
    text of a query that is kept, whatever parts it lies in, and NULL for the others;
    without ``texts`` no answer is put together.
    """
    df = specs.join(ans.answers.drop("n_rows", "sql"), ["table_id", "query_no"])
    if c.answer_location.available:
        df = df.join(answer_position(ans.answers, rows, located_values(specs, ans, rows)), ["table_id", "query_no"])
    else:
        df = df.select("*", F.lit(-1).alias("ans_row"), F.lit(-1).alias("ans_col"))
    df = rule_columns(df, c)
    checked = df.select("*", first_failure(df).alias("rejected_by"))
    if not texts:
        return checked
    kept = checked.where(F.col("rejected_by").isNull()).select("table_id", "query_no")
    return checked.join(ans.only(kept).whole(), ["table_id", "query_no"], "left")


def report(checked: DataFrame) -> DataFrame:
    """Rejection report: queries per first failing rule ('kept' for survivors)."""
    return checked.groupBy(F.coalesce("rejected_by", F.lit("kept")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))
