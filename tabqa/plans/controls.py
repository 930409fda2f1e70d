"""Query features and control rules over generated queries (K, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabqa.operators import controls as K
from tabqa.operators import specs as S
from tabqa.plans import duck_batch as DB
from tabqa.plans import shared
from tabqa.plans.registry import query

SP = S.SpecParams(seed=42, per_table=20)
CORPUS_SQL = DB.LINEITEM_BY_SUPPLIER


def pipeline(spark, sf_dir, controls: K.Controls | None = None):
    """corpus → specs → answers → features/rules, as one lazy DataFrame."""
    c = shared.corpus(spark, sf_dir, "supplier")
    specs = shared.specs(spark, sf_dir, "supplier", SP)
    ans = shared.executed(spark, sf_dir, "supplier", SP)
    return K.apply(specs, ans, c.rows, controls or K.Controls(), texts=False), c


def drawn(spark, sf_dir):
    """The specs alone, for features and rules that read a query and no answer: every spec has one."""
    return shared.specs(spark, sf_dir, "supplier", SP)


def _duck(select: str) -> str:
    return DB.exec_sql(CORPUS_SQL, SP, select)


# DuckDB spellings of the features, over ``specs s JOIN answers a``.
D_WORDS = "list_filter(string_split_regex(lower(s.sql), '\\s+'), lambda w: w <> '')"
D_SQL_LEN = "CAST(len(string_split(s.sql, ' ')) AS INTEGER)"
D_FILTER = f"CAST(len(list_filter({D_WORDS}, lambda w: w IN ('=', '>', '<', 'in', 'like'))) AS INTEGER)"
D_CALC = (
    f"CAST(coalesce(list_sum(list_transform({D_WORDS}, lambda w: CASE WHEN w IN ('sum', 'count', 'min', 'max', '+', '-', '*', '/') "
    "THEN 1 WHEN w = 'avg' THEN 2 ELSE 0 END)), 0) AS INTEGER)"
)
D_CALC_BASIC = f"CAST(len(list_filter({D_WORDS}, lambda w: w IN ('sum', 'avg', '+', '-', '*', '/'))) AS INTEGER)"
D_AGGW = f"len(list_filter({D_WORDS}, lambda w: w IN ('sum', 'count', 'min', 'max', 'avg')))"
D_WCOLS = "(CASE WHEN s.w_n = 0 THEN CAST([] AS INTEGER[]) ELSE list_filter([s.w1_col, s.w1_rcol, s.w2_col], lambda c: c IS NOT NULL) END)"
D_OTHER = "list_filter([s.g_col, s.h_col, s.h_rcol, s.o_col], lambda c: c IS NOT NULL)"
D_USED = f"list_distinct(list_concat(list_concat({D_WCOLS}, {D_OTHER}), s.s_cols))"
D_DEPTH = (
    f"CAST((CASE WHEN s.g_col IS NOT NULL THEN 1 ELSE 0 END) + len(list_distinct({D_WCOLS})) "
    "+ (CASE WHEN s.h_kind IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN s.o_kind <> 'none' THEN 1 ELSE 0 END) "
    f"+ {D_AGGW} AS INTEGER)"
)
D_FROM = "FROM specs s JOIN answers a USING (table_id, query_no)"


def _feat(name, spark_col, duck_expr, doc, answered=False):
    def fn(spark, sf_dir):
        df = pipeline(spark, sf_dir)[0] if answered else drawn(spark, sf_dir)
        return df.select("table_id", "query_no", spark_col().alias("v"))

    fn.__doc__ = doc
    query(name, _duck(f"SELECT s.table_id, s.query_no, {duck_expr} AS v {D_FROM}"))(fn)


_feat("feat_sql_len", lambda: K.sql_len(F.col("sql")), D_SQL_LEN, "SQL length in space-separated tokens (L1).")
_feat("feat_filter_times", lambda: K.filter_times(F.col("sql")), D_FILTER, "Filter operations in the SQL (L2).")
_feat("feat_calc_times", lambda: K.calc_times(F.col("sql")), D_CALC, "Calculation count (L3).")
_feat("feat_calc_times_basic", lambda: K.calc_times_basic(F.col("sql")), D_CALC_BASIC, "Older calculation count (L4).")
_feat("feat_depth", K.depth, D_DEPTH, "Clause depth (L5).")
_feat("feat_select_rows", lambda: F.col("n_selected"), "a.n_selected", "Rows passing WHERE (L9).", answered=True)
_feat(
    "feat_merge_cols",
    lambda: F.size(F.array_union(K.where_cols(), F.col("s_cols"))),
    f"CAST(len(list_distinct(list_concat({D_WCOLS}, s.s_cols))) AS INTEGER)",
    "Columns of the condition part merged with the select part (L10).",
)
_feat(
    "feat_has_dups",
    lambda: K.has_dups(F.concat(K.where_cols(), F.col("s_cols"))).cast("int"),
    f"CAST(len(list_concat({D_WCOLS}, s.s_cols)) <> len(list_distinct(list_concat({D_WCOLS}, s.s_cols))) AS INTEGER)",
    "Whether a column is used twice across WHERE and SELECT (L11).",
)


@query(
    "feat_coverage",
    _duck(
        f"SELECT s.table_id, s.query_no, CAST(len({D_USED}) AS INTEGER) AS n_cols_used, a.n_selected, "
        f"round(len({D_USED}) / s.n_cols, 6) AS col_ratio, round(a.n_selected / s.n_rows, 6) AS row_ratio {D_FROM}"
    ),
)
def feat_coverage(spark, sf_dir):
    """Columns used, rows covered and their ratios."""
    df, _ = pipeline(spark, sf_dir)
    used = F.size(K.used_cols())
    return df.select(
        "table_id", "query_no", used.alias("n_cols_used"), "n_selected",
        F.round(used / F.col("n_cols"), 6).alias("col_ratio"),
        F.round(F.col("n_selected") / F.col("n_rows"), 6).alias("row_ratio"),
    )


@query(
    "feat_answer_position",
    _duck(
        """, cellx AS (SELECT table_id, row_idx, unnest(cells) AS v, unnest(range(0, len(cells))) AS col_idx FROM crows),
        hit AS (SELECT a.table_id, a.query_no, c.row_idx, c.col_idx,
                       row_number() OVER (PARTITION BY a.table_id, a.query_no ORDER BY c.row_idx, c.col_idx) AS rk
                FROM answers a JOIN cellx c ON c.table_id = a.table_id AND c.v = a.answer WHERE a.n_ans_rows = 1)
        SELECT a.table_id, a.query_no, CAST(coalesce(h.row_idx, -1) AS INTEGER) AS ans_row,
               CAST(coalesce(h.col_idx, -1) AS INTEGER) AS ans_col
        FROM answers a LEFT JOIN (SELECT * FROM hit WHERE rk = 1) h USING (table_id, query_no)"""
    ),
)
def feat_answer_position(spark, sf_dir):
    """First (row, col) of the answer in the table, else (-1, -1)."""
    c = shared.corpus(spark, sf_dir, "supplier")
    ans = shared.executed(spark, sf_dir, "supplier", SP).answers
    return K.answer_position(ans, c.rows).select(
        "table_id", "query_no", F.col("ans_row").cast("int").alias("ans_row"), F.col("ans_col").cast("int").alias("ans_col")
    )


_CLAUSES = [
    ("c_select", r"^select (.*?) from my_table", 1),
    ("c_where", r"where (.*?)( group by | order by |\s*$)", 1),
    ("c_group", r"group by (\S+)", 1),
    ("c_having", r"having (.*?)( order by |\s*$)", 1),
    ("c_order", r"order by (.*?) (asc|desc) limit", 1),
    ("c_dir", r"(asc|desc) limit 1", 1),
]


@query(
    "feat_clauses",
    _duck(
        "SELECT s.table_id, s.query_no, "
        + ", ".join(f"regexp_extract(s.sql, '{pat}', {g}) AS {n}" for n, pat, g in _CLAUSES)
        + ", CAST(len(list_filter(s.header, lambda h: contains(regexp_extract(s.sql, 'where (.*?)( group by | order by |\\s*$)', 1), h))) AS INTEGER) AS n_where_cols "
        + D_FROM
    ),
)
def feat_clauses(spark, sf_dir):
    """Clause decomposition of SQL text with columns by substring match."""
    df = drawn(spark, sf_dir)
    where = F.regexp_extract("sql", _CLAUSES[1][1], 1)
    return df.select(
        "table_id", "query_no",
        *[F.regexp_extract("sql", pat, g).alias(n) for n, pat, g in _CLAUSES],
        F.size(F.filter("header", lambda h: where.contains(h))).alias("n_where_cols"),
    )


_D_CLAUSE = {
    "select": "regexp_extract(s.sql, '^select (.*?) from', 1)",
    "where": "regexp_extract(s.sql, 'where (.*?)( group by | order by |\\s*$)', 1)",
    "group": "regexp_extract(s.sql, 'group by (\\S+)', 1)",
    "having": "regexp_extract(s.sql, 'having (.*?)( order by |\\s*$)', 1)",
    "order": "regexp_extract(s.sql, 'order by (.*?) (asc|desc) limit', 1)",
}


@query(
    "feat_clause_columns",
    _duck(
        "SELECT s.table_id, s.query_no, "
        + ", ".join(f"array_to_string(list_filter(s.header, lambda h: contains({e}, h)), ',') AS {c}_cols" for c, e in _D_CLAUSE.items())
        + f", regexp_extract({_D_CLAUSE['select']}, '(sum|count|min|max|avg) \\(', 1) AS select_agg"
        + f", regexp_extract({_D_CLAUSE['order']}, '(sum|count|min|max|avg) \\(', 1) AS order_agg"
        + ", regexp_extract(s.sql, 'limit (\\d+)', 1) AS limit_n "
        + D_FROM
    ),
)
def feat_clause_columns(spark, sf_dir):
    """Columns of each clause, the aggregates of SELECT and ORDER BY, and the limit, from SQL text."""
    df = drawn(spark, sf_dir)
    text = {
        "select": F.regexp_extract("sql", "^select (.*?) from", 1),
        "where": F.regexp_extract("sql", _CLAUSES[1][1], 1),
        "group": F.regexp_extract("sql", _CLAUSES[2][1], 1),
        "having": F.regexp_extract("sql", _CLAUSES[3][1], 1),
        "order": F.regexp_extract("sql", _CLAUSES[4][1], 1),
    }
    df = df.select("table_id", "query_no", "header", "sql", *[e.alias(f"t_{c}") for c, e in text.items()])
    agg = r"(sum|count|min|max|avg) \("

    def columns(c):
        return F.array_join(F.filter("header", lambda h: F.col(f"t_{c}").contains(h)), ",").alias(f"{c}_cols")

    return df.select(
        "table_id", "query_no", *[columns(c) for c in text],
        F.regexp_extract("t_select", agg, 1).alias("select_agg"), F.regexp_extract("t_order", agg, 1).alias("order_agg"),
        F.regexp_extract("sql", r"limit (\d+)", 1).alias("limit_n"),
    )


# ---------------------------------------------------------------- controls

D_SINGLE = "a.n_ans_rows = 1"
D_ANS = "coalesce(a.answer, 'None')"
D_ALEN = f"(CASE WHEN a.n_ans_rows = 0 THEN 0 WHEN {D_SINGLE} THEN length({D_ANS}) ELSE a.n_ans_rows END)"
D_NESTED = "(len(string_split(s.sql, 'select')) - 1 > 1)"
D_INT = f"TRY_CAST(trim({D_ANS}) AS BIGINT)"
D_RULES = {
    "K1_null_answer": f"(a.n_ans_rows = 0 OR ({D_SINGLE} AND CASE WHEN {D_NESTED} THEN {D_ANS} IN ('None', 'NULL', 'none') ELSE {D_ANS} IN ('None', '0', 'NULL', 'none') END))",
    "K2_list_01": "(a.n_ans_rows > 1 AND (list_contains(a.answer_list, '1') OR list_contains(a.answer_list, '0')))",
    "K3_large_int": f"({D_SINGLE} AND regexp_matches({D_ANS}, '^\\s*[+-]?\\d+\\s*$') AND coalesce({D_INT} = s.n_rows OR {D_INT} > s.n_rows - 3, true))",
    "K4_all_rows": f"({D_ALEN} = 0 OR {D_ALEN} = s.n_rows)",
}

CTL_CASES = {
    "ctl_null_answer": ("K1_null_answer", K.Controls(), D_RULES["K1_null_answer"]),
    "ctl_list_01": ("K2_list_01", K.Controls(), D_RULES["K2_list_01"]),
    "ctl_large_int": ("K3_large_int", K.Controls(), D_RULES["K3_large_int"]),
    "ctl_all_rows": ("K4_all_rows", K.Controls(), D_RULES["K4_all_rows"]),
    "ctl_answer_cells": ("K5_answer_cells", K.Controls(), f"NOT ({D_ALEN} BETWEEN 1 AND 12)"),
    "ctl_keywords": ("K6_keywords", K.Controls(keywords_disabled=["group by"]), "contains(s.sql, 'group by')"),
    "ctl_length": (
        "K7_length", K.Controls(length=K.Range(True, [], 6, 16)), f"NOT ({D_SQL_LEN} BETWEEN 6 AND 16)"
    ),
    "ctl_column_ratio": (
        "K8_column_ratio",
        K.Controls(column_ratio=K.Range(True, [], 0.1, 0.3)),
        f"NOT (len({D_USED}) / s.n_cols BETWEEN 0.1 AND 0.3)",
    ),
    "ctl_row_ratio": (
        "K9_row_ratio",
        K.Controls(select_row_ratio=K.Range(True, [], 0, 0.2)),
        "NOT (a.n_selected / s.n_rows BETWEEN 0 AND 0.2)",
    ),
    "ctl_filter_times": (
        "K10_filter_times", K.Controls(filter_times=K.Range(True, [1, 2])), f"NOT ({D_FILTER} IN (1, 2))"
    ),
    "ctl_calc_times": (
        "K11_calc_times", K.Controls(calculate_times=K.Range(True, [0, 1])), f"NOT ({D_CALC} IN (0, 1))"
    ),
    "ctl_exclude": ("K13_exclude", K.Controls(exclude=["count", "like"]), "(contains(s.sql, 'count') OR contains(s.sql, 'like'))"),
    "ctl_include": ("K14_include", K.Controls(include=["where", "limit"]), "NOT (contains(s.sql, 'where') AND contains(s.sql, 'limit'))"),
}


def _ctl(name, rule, controls, duck_expr):
    def fn(spark, sf_dir):
        df = K.spec_rules(drawn(spark, sf_dir), controls) if rule in K.SPEC_RULES else pipeline(spark, sf_dir, controls)[0]
        return df.select("table_id", "query_no", F.col(rule).cast("int").alias("fails"))

    fn.__doc__ = f"Control rule {rule}: 1 when the query is rejected by it."
    query(name, _duck(f"SELECT s.table_id, s.query_no, CAST(coalesce({duck_expr}, false) AS INTEGER) AS fails {D_FROM}"))(fn)


for _n, (_r, _c, _e) in CTL_CASES.items():
    _ctl(_n, _r, _c, _e)

_LOC = K.Controls(answer_location=K.Range(True, [], 0, 1))


@query(
    "ctl_answer_location",
    _duck(
        """, cellx AS (SELECT table_id, row_idx, unnest(cells) AS v, unnest(range(0, len(cells))) AS col_idx FROM crows),
        origin AS (SELECT f.table_id, f.query_no, f.cells[f.s_cols[1] + 1] AS v,
                          row_number() OVER (PARTITION BY f.table_id, f.query_no ORDER BY k.ord_s NULLS FIRST, f.row_idx) AS rk
                   FROM f JOIN answer_rows k ON k.table_id = f.table_id AND k.query_no = f.query_no
                        AND (f.g_col IS NULL OR f.cells[f.g_col + 1] IS NOT DISTINCT FROM k.ord_s)
                   WHERE f.s_kind = 'agg'),
        asked AS (SELECT table_id, query_no, v FROM origin WHERE rk = 1
                  UNION ALL SELECT a.table_id, a.query_no, a.answer FROM answers a JOIN specs s ON s.table_id = a.table_id AND s.query_no = a.query_no
                  WHERE a.n_ans_rows = 1 AND s.s_kind <> 'agg'),
        hit AS (SELECT a.table_id, a.query_no, c.row_idx,
                       row_number() OVER (PARTITION BY a.table_id, a.query_no ORDER BY c.row_idx, c.col_idx) AS rk
                FROM asked a JOIN cellx c ON c.table_id = a.table_id AND c.v = a.v),
        pos AS (SELECT a.table_id, a.query_no, coalesce(h.row_idx, -1) AS ans_row
                FROM answers a LEFT JOIN (SELECT * FROM hit WHERE rk = 1) h USING (table_id, query_no))
        SELECT p.table_id, p.query_no,
               CAST(coalesce(NOT (p.ans_row / a.n_rows > 0 AND p.ans_row / a.n_rows <= 1), false) AS INTEGER) AS fails
        FROM pos p JOIN answers a USING (table_id, query_no)"""
    ),
)
def ctl_answer_location(spark, sf_dir):
    """Answer row ratio in (0, 1], aggregates by the first row of their plain query."""
    df, _ = pipeline(spark, sf_dir, _LOC)
    return df.select("table_id", "query_no", F.col("K12_answer_location").cast("int").alias("fails"))


@query(
    "ctl_ambiguous",
    _duck(
        """, same AS (
          SELECT r.table_id, r.query_no FROM rm r JOIN rm_top t USING (table_id, query_no) WHERE r.o_kind = 'col' AND r.okey IS NOT DISTINCT FROM t.okey
          UNION ALL
          SELECT g.table_id, g.query_no FROM gok g JOIN gok_top t USING (table_id, query_no) WHERE g.o_kind = 'agg' AND g.okey IS NOT DISTINCT FROM t.okey),
        ties AS (SELECT table_id, query_no, count(*) AS n FROM same ANTI JOIN failed USING (table_id, query_no) GROUP BY ALL)
        SELECT s.table_id, s.query_no, CAST(coalesce(t.n > 1, false) AS INTEGER) AS fails FROM specs s LEFT JOIN ties t USING (table_id, query_no)"""
    ),
)
def ctl_ambiguous(spark, sf_dir):
    """Queries whose top row or group shares its ORDER value with others (G5 over a corpus)."""
    df, _ = pipeline(spark, sf_dir, K.Controls(reject_ties=True))
    return df.select("table_id", "query_no", F.col("G5_ambiguous").cast("int").alias("fails"))


_REPORT_CASE = " ".join(
    f"WHEN {D_RULES[r]} THEN '{r}'" for r in ["K1_null_answer", "K2_list_01", "K3_large_int", "K4_all_rows"]
) + f" WHEN NOT ({D_ALEN} BETWEEN 1 AND 12) THEN 'K5_answer_cells'"


@query(
    "ctl_report",
    _duck(f"SELECT coalesce(CASE {_REPORT_CASE} END, 'kept') AS rule, count(*) AS n {D_FROM} GROUP BY 1"),
)
def ctl_report(spark, sf_dir):
    """All default rules combined: queries per first failing rule."""
    df, _ = pipeline(spark, sf_dir)
    return K.report(df)
