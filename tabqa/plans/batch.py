"""Spec drawing and batched execution over corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabqa.operators import batch as B
from tabqa.operators import specs as S
from tabqa.plans import duck_batch as DB
from tabqa.plans import shared
from tabqa.plans.registry import query
from tabqa.sources import corpus as C
from tabqa.sources.tables import Tables

SP = S.SpecParams(seed=42, per_table=20)
OUT = ["table_id", "query_no", "n_ans_rows", "n_ans_cols", "answer", "n_selected"]
OUT_SQL = "SELECT table_id, query_no, n_ans_rows, n_ans_cols, answer, n_selected FROM answers"


def _supplier(spark, sf_dir):
    return shared.corpus(spark, sf_dir, "supplier")


def run(corpus: C.Corpus, p: S.SpecParams, **kw) -> B.Answers:
    specs = S.draw(corpus.tables, corpus.rows, p)
    return B.execute(corpus.rows, specs, **kw)


@query(
    "inst_coarse_single",
    f"WITH {DB.LINEITEM_BY_SUPPLIER},\n{DB.specs_sql(DB.LINEITEM_BY_SUPPLIER, SP)}\n"
    "SELECT table_id, query_no, tpl, sql FROM specs",
)
def inst_coarse_single(spark, sf_dir):
    """Coarse-template specs s1-s8, 20 per supplier table, with their SQL text."""
    return shared.specs(spark, sf_dir, "supplier", SP).select("table_id", "query_no", "tpl", "sql")


@query(
    "inst_sample_value",
    f"WITH {DB.LINEITEM_BY_SUPPLIER},\n{DB.specs_sql(DB.LINEITEM_BY_SUPPLIER, SP)}\n"
    "SELECT table_id, query_no, w1_v1, w1_v2, w2_v1, h_lit FROM specs",
)
def inst_sample_value(spark, sf_dir):
    """Literals sampled from hashed rows of each table, one join for all slots."""
    return shared.specs(spark, sf_dir, "supplier", SP).select("table_id", "query_no", "w1_v1", "w1_v2", "w2_v1", "h_lit")


@query("exec_batch_all", DB.exec_sql(DB.LINEITEM_BY_SUPPLIER, SP, OUT_SQL))
def exec_batch_all(spark, sf_dir):
    """Every spec of every supplier table answered in one plan."""
    return shared.answers(spark, sf_dir, "supplier", SP).select(*OUT)


def _variant(name, templates, doc):
    p = S.SpecParams(seed=42, per_table=20, templates=templates)

    def fn(spark, sf_dir):
        return shared.answers(spark, sf_dir, "supplier", p).select(*OUT)

    fn.__doc__ = doc
    query(name, DB.exec_sql(DB.LINEITEM_BY_SUPPLIER, p, OUT_SQL))(fn)


_variant("exec_batch_where", ("s2",), "WHERE-only specs (J1).")
_variant("exec_batch_agg", ("s1", "s2"), "Select/aggregate specs without grouping (J1).")
_variant("exec_batch_group", ("s5", "s6"), "GROUP BY + HAVING specs (J1).")
_variant("exec_batch_order", ("s3", "s4", "s7", "s8"), "Specs with ORDER BY ... LIMIT 1 (J1).")

LARGE = S.SpecParams(seed=7, per_table=100)


def lineitem_one_table(li):
    """The whole lineitem table as one corpus table."""
    return C.from_dataframe(
        li,
        F.lit(0),
        [
            ("l_returnflag", "l_returnflag", C.TEXT),
            ("l_linestatus", "l_linestatus", C.TEXT),
            ("l_shipdate", "l_shipdate", C.DATE),
            ("l_linenumber", "l_linenumber", C.INT),
            ("l_quantity", F.col("l_quantity").cast("bigint"), C.INT),
            ("l_suppkey", "l_suppkey", C.INT),
        ],
        C.LINEITEM_ORDER,
    )


_PARTS_SQL = f""", ranged AS (
    SELECT *, CASE WHEN ord_i IS NULL THEN row_number() OVER (PARTITION BY table_id, query_no ORDER BY ord_s NULLS FIRST) - 1 ELSE ord_i END // {B.PART_ROWS} AS rng
    FROM answer_rows),
  parted AS (
    SELECT table_id, query_no, rng, list(coalesce(vals[1], 'None') ORDER BY ord_i NULLS FIRST, ord_s NULLS FIRST) AS firsts,
           list(tup ORDER BY ord_i NULLS FIRST, ord_s NULLS FIRST) AS tups, first(vals[1]) AS only_first,
           count(*) OVER (PARTITION BY table_id, query_no) AS n_parts
    FROM ranged GROUP BY table_id, query_no, rng)
  SELECT a.table_id, a.query_no, a.n_ans_rows, a.n_ans_cols, a.n_selected, coalesce(p.n_parts, 0) AS n_parts,
         CASE WHEN p.n_parts > 1 THEN p.rng ELSE 0 END AS part,
         CASE WHEN a.n_ans_rows = 0 THEN '' WHEN a.n_ans_rows = 1 THEN p.only_first
              WHEN a.n_ans_cols > 1 THEN array_to_string(p.tups, ', ') ELSE array_to_string(p.firsts, ', ') END AS answer
  FROM answers a LEFT JOIN parted p USING (table_id, query_no)"""


@query("exec_large", DB.exec_sql(DB.LINEITEM_ONE_TABLE, LARGE, _PARTS_SQL))
def exec_large(spark, sf_dir):
    """100 specs over one large table, split into row ranges (salted); every answer in ordered parts."""
    c = lineitem_one_table(Tables(spark, sf_dir).lineitem).materialize()
    return run(c, LARGE, salt_rows=20_000).texts(lists=False).select(*OUT, "part", "n_parts")


@query(
    "exec_answer_count",
    DB.exec_sql(DB.LINEITEM_BY_SUPPLIER, SP, OUT_SQL.replace("FROM answers", "FROM answers WHERE n_ans_rows = 1")),
)
def exec_answer_count(spark, sf_dir):
    """Specs whose answer has exactly one row."""
    ans = shared.executed(spark, sf_dir, "supplier", SP)
    one = ans.only(ans.answers.where(F.col("n_ans_rows") == 1))  # no other answer is put together
    return one.assembled().texts(lists=False).select(*OUT)


OBC = S.SpecParams(seed=11, per_table=5)


@query("exec_answer_string", DB.exec_sql(DB.ORDERS_BY_CUSTOMER, OBC, OUT_SQL))
def exec_answer_string(spark, sf_dir):
    """Answer strings over thousands of small customer tables."""
    return shared.answers(spark, sf_dir, "customer", OBC).select(*OUT)


REAL = S.SpecParams(seed=17, per_table=6, profile="ingested")
REAL_WHERE = S.SpecParams(seed=18, per_table=6)
HARD = S.SpecParams(seed=19, per_table=30)


@query("exec_real", DB.exec_sql(DB.ORDERS_EXACT, REAL, OUT_SQL, exact=True))
def exec_real(spark, sf_dir):
    """Queries over exact prices: typed comparison, sums, averages and texts of REAL columns."""
    return shared.answers(spark, sf_dir, "exact", REAL).select(*OUT)


@query("exec_real_where", DB.exec_sql(DB.ORDERS_EXACT, REAL_WHERE, OUT_SQL, exact=True))
def exec_real_where(spark, sf_dir):
    """The English templates over exact prices, arithmetic of whole and REAL columns included."""
    return shared.answers(spark, sf_dir, "exact", REAL_WHERE).select(*OUT)


@query("exec_hard", DB.exec_sql(DB.ORDERS_HARD, HARD, OUT_SQL.replace("n_selected FROM", "n_selected, failed, sql FROM")))
def exec_hard(spark, sf_dir):
    """Missing groups, quotes and numbers beyond BIGINT: queries that fail are named, the others answer."""
    return shared.answers(spark, sf_dir, "hard", HARD).select(*OUT, "failed", "sql")


@query(
    "nl_instruction_en",
    f"WITH {DB.LINEITEM_BY_SUPPLIER},\n{DB.specs_sql(DB.LINEITEM_BY_SUPPLIER, SP)}\n"
    "SELECT table_id, query_no, multistep FROM specs",
)
def nl_instruction_en(spark, sf_dir):
    """English multi-step instruction of every spec: where → group → having → select → order."""
    return shared.specs(spark, sf_dir, "supplier", SP).select("table_id", "query_no", "multistep")


D1 = S.SpecParams(seed=5, per_table=20, templates=("s1", "s2"), flag="d")


def _d_nested():
    from tabqa.plans import duck as D

    def hs(slot):
        return D.h(D.key(5, "j.table_id", "j.query_no", "'d1'", f"'{slot}'"))

    u_eq = f"({hs('eq')} / 4294967296.0)"
    u_op = f"({hs('op')} / 4294967296.0)"
    text_op = f"(CASE WHEN {u_op} < {0.5 / 1.1!r} THEN '=' ELSE 'in' END)"
    num_op = f"(['=', '>', '<'])[1 + {hs('op')} % 3]"
    n = "TRY_CAST(j.answer AS BIGINT)"
    lo = f"greatest(1, {n} - 5)"
    jit = f"({lo} + {hs('jit')} % ({n} + 5 - {lo} + 1))"
    return f"""SELECT 1 AS _z),
    j0 AS (SELECT s.table_id, s.query_no, s.sql, s.n_rows, a.answer, a.n_ans_rows, s.s_cols[1] AS scol,
                  (s.s_kind = 'agg' OR list_contains(s.ic, s.s_cols[1])) AS is_num
           FROM specs s JOIN answers a USING (table_id, query_no)
           WHERE a.n_ans_rows > 0 AND a.n_ans_rows <> s.n_rows AND a.answer IS NOT NULL AND a.answer <> 'None'
             AND (s.s_kind = 'agg' OR a.n_ans_rows = 1)),
    j AS (SELECT j0.*,
                 (SELECT r.cells[j0.scol + 1] FROM crows r WHERE r.table_id = j0.table_id AND r.row_idx = {D.h(D.key(5, 'j0.table_id', 'j0.query_no', "'d1'", "'r0'"))} % j0.n_rows) AS c0,
                 (SELECT r.cells[j0.scol + 1] FROM crows r WHERE r.table_id = j0.table_id AND r.row_idx = {D.h(D.key(5, 'j0.table_id', 'j0.query_no', "'d1'", "'r1'"))} % j0.n_rows) AS c1,
                 (SELECT r.cells[j0.scol + 1] FROM crows r WHERE r.table_id = j0.table_id AND r.row_idx = {D.h(D.key(5, 'j0.table_id', 'j0.query_no', "'d1'", "'r2'"))} % j0.n_rows) AS c2
          FROM j0),
    o AS (SELECT j.*, CASE WHEN is_num THEN {num_op} ELSE {text_op} END AS op FROM j j),
    v AS (SELECT o.*, CASE WHEN op = '=' AND {u_eq.replace('j.', 'o.')} < 0.4 THEN {n.replace('j.', 'o.')} ELSE {jit.replace('j.', 'o.')} END AS num_val,
                 CASE WHEN {u_eq.replace('j.', 'o.')} < 0.4 THEN answer ELSE c0 END AS text_val FROM o)
    SELECT table_id, query_no,
           regexp_replace('select ( ' || sql || ' ) ' || op || ' ' ||
               CASE WHEN is_num THEN CAST(num_val AS VARCHAR) WHEN op = '=' THEN '''' || text_val || ''''
                    ELSE '( ''' || c0 || ''' , ''' || c1 || ''' , ''' || c2 || ''' )' END, ' {{2}}', ' ', 'g') AS sql,
           CAST(CAST(coalesce(CASE WHEN is_num AND op = '=' THEN TRY_CAST(answer AS BIGINT) = num_val
                          WHEN is_num AND op = '>' THEN TRY_CAST(answer AS BIGINT) > num_val
                          WHEN is_num THEN TRY_CAST(answer AS BIGINT) < num_val
                          WHEN op = '=' THEN answer = text_val
                          ELSE answer = c0 OR answer = c1 OR answer = c2 END, false) AS INTEGER) AS VARCHAR) AS answer
    FROM v"""


@query("inst_coarse_nested", DB.exec_sql(DB.LINEITEM_BY_SUPPLIER, D1, ", _x AS (" + _d_nested()))
def inst_coarse_nested(spark, sf_dir):
    """Two-level d1 queries ``select ( q ) op value`` over accepted level-1 answers."""
    from tabqa.operators import nested as N

    c = shared.corpus(spark, sf_dir, "supplier")
    sp = shared.specs(spark, sf_dir, "supplier", D1)
    ans = shared.executed(spark, sf_dir, "supplier", D1).answers
    return N.op_and_value(sp, ans, c.rows, D1.seed).drop("op_value")


INGESTED = S.SpecParams(seed=31, per_table=20, profile="ingested")
CHINESE = S.SpecParams(seed=32, per_table=20, profile="chinese")


def _profile(name: str, p: S.SpecParams, text: str, doc: str) -> None:
    def spelt(spark, sf_dir):
        return shared.specs(spark, sf_dir, "supplier", p).select("table_id", "query_no", "tpl", "sql", text)

    def answered(spark, sf_dir):
        return shared.answers(spark, sf_dir, "supplier", p).select(*OUT)

    spelt.__doc__, answered.__doc__ = f"Coarse specs of the {doc} generator with their text (I7, M16-M18, 2.R).", f"Their answers (J1, 2.R; {doc})."
    cte = f"WITH {DB.LINEITEM_BY_SUPPLIER},\n{DB.specs_sql(DB.LINEITEM_BY_SUPPLIER, p)}\n"
    query(f"inst_{name}", f"{cte}SELECT table_id, query_no, tpl, sql, {text} FROM specs")(spelt)
    query(f"exec_{name}", DB.exec_sql(DB.LINEITEM_BY_SUPPLIER, p, OUT_SQL))(answered)


_profile("ingested", INGESTED, "multistep", "ingested-table")
_profile("zh", CHINESE, "multistep_zh", "Chinese")

SUB = S.SpecParams(seed=21, per_table=10, templates=("s1", "s2", "s3", "s4"), flag="d")
NESTED = {
    "d2": S.SpecParams(seed=22, per_table=10, templates=("s1",)),
    "d3": S.SpecParams(seed=23, per_table=10, templates=("s3",)),
    "d4": S.SpecParams(seed=24, per_table=10, templates=("s2",)),
}


def where_nested_sql(corpus: str, sub: S.SpecParams, p: S.SpecParams, select: str) -> str:
    """Oracle: the sub-queries answered (``acc``), then the outer specs over the rows that they admit."""
    from tabqa.operators import nested as N
    from tabqa.plans import duck as D

    level1 = DB.exec_sql(
        corpus, sub,
        """SELECT s.table_id, s.query_no, s.sql, s.s_cols[1] AS ncol, list_contains(s.ic, s.s_cols[1]) AS is_num, s.s_kind,
                  a.n_rows, a.n_ans_rows, a.n_ans_cols, v.vs, v.first_value
           FROM specs s JOIN answers a USING (table_id, query_no)
           JOIN (SELECT table_id, query_no, list(DISTINCT vals[1]) AS vs, arg_min(vals[1], coalesce(ord_i, 0)) AS first_value
                 FROM answer_rows GROUP BY table_id, query_no) v USING (table_id, query_no)""",
    )
    op_num = D.weighted(D.key(p.seed, "table_id", "query_no", "'nest'", "'op'"), *N.NEST_NUM_OPS)
    accepted = f"""acc AS (SELECT table_id, query_no, sql AS sub_sql, ncol, is_num, vs, first_value,
                      CASE WHEN is_num THEN {op_num} WHEN n_ans_rows = 1 THEN '=' ELSE 'in' END AS nop
               FROM ({level1}) WHERE n_ans_rows > 0 AND n_ans_rows <> n_rows AND first_value IS NOT NULL AND s_kind = 'cols'
                 AND n_ans_cols = 1 AND CASE WHEN is_num THEN n_ans_rows = 1 ELSE true END)"""
    cond = "b.header[c.ncol + 1] || ' ' || c.nop || ' ( ' || c.sub_sql || ' )'"
    pat = r"'^(.*?)\s*(order by .*)?$'"
    sql = (
        f"trim(regexp_replace(regexp_extract(b.sql, {pat}, 1) || CASE WHEN b.w_n > 0 THEN ' and ' ELSE ' where ' END || {cond} || ' ' || "
        f"regexp_extract(b.sql, {pat}, 2), ' {{2}}', ' ', 'g'))"
    )
    body = DB.exec_sql(
        corpus, p, select,
        derive=f"SELECT b.* REPLACE ({sql} AS sql) FROM specs_base b JOIN acc c USING (table_id, query_no)",
    )
    n, v = "r.nums[c.ncol + 1]", "TRY_CAST(c.first_value AS BIGINT)"
    admits = f"CASE WHEN c.is_num THEN CASE c.nop WHEN '>' THEN {n} > {v} WHEN '<' THEN {n} < {v} ELSE {n} = {v} END ELSE list_contains(c.vs, r.cells[c.ncol + 1]) END"
    body = body.replace(
        "x AS (SELECT s.*, r.row_idx, r.cells, r.nums FROM specs s JOIN crows r USING (table_id)),",
        f"x AS (SELECT s.*, r.row_idx, r.cells, r.nums FROM specs s JOIN acc c USING (table_id, query_no) JOIN crows r ON r.table_id = s.table_id WHERE {admits}),",
    )
    return body.replace("WITH ", f"WITH {accepted},\n", 1)


def _nested(name: str, doc: str) -> None:
    def fn(spark, sf_dir):
        from tabqa.operators import nested as N

        c = shared.corpus(spark, sf_dir, "supplier")
        outer, sub = shared.specs(spark, sf_dir, "supplier", NESTED[name]), shared.specs(spark, sf_dir, "supplier", SUB)
        specs, values = N.where_nested(outer, sub, shared.executed(spark, sf_dir, "supplier", SUB), NESTED[name].seed)
        return N.answer_nested(specs, values, c.rows).select("table_id", "query_no", "sql", "n_ans_rows", "answer", "n_selected")

    fn.__doc__ = doc
    answered = "SELECT table_id, query_no, sql, n_ans_rows, answer, n_selected FROM answers"
    query(f"inst_coarse_{name}", where_nested_sql(DB.LINEITEM_BY_SUPPLIER, SUB, NESTED[name], answered))(fn)


_nested("d2", "``select .. where c op ( q )`` over accepted level-1 answers (I8, E1, E2).")
_nested("d3", "``select .. where c op ( q ) order by ..`` (I8, E5).")
_nested("d4", "``select .. where w and c op ( q )`` (I8, E6).")


T1 = S.SpecParams(seed=9, per_table=20, templates=("s1", "s2", "s3"), flag="t", pair=True)


def pairs_sql(more: str = "") -> str:
    """Oracle of pairs; ``more`` adds columns of ``jo`` and ``sets``."""
    from tabqa.operators import nested as N
    from tabqa.plans import duck as D

    op_num = D.weighted(D.key(9, "j.table_id", "j.pair", "'t1'", "'op'"), *N.PAIR_NUM_OPS)
    op_set = D.weighted(D.key(9, "j.table_id", "j.pair", "'t1'", "'set'"), ["union", "intersect"], [1, 1])
    n1, n2 = "TRY_CAST(first1 AS BIGINT)", "TRY_CAST(first2 AS BIGINT)"
    return f""", pa AS (SELECT s.table_id, CAST(floor(s.query_no / 2) AS INTEGER) AS pair, s.query_no % 2 AS side, s.sql, s.s_kind,
                      s.s_agg, s.s_cols, s.ic, an.n_ans_rows, an.answer_list[1] AS first, s.query_no
               FROM specs s JOIN answers an USING (table_id, query_no)),
    j AS (SELECT q1.table_id, q1.pair, q1.sql AS sql1, q2.sql AS sql2, q1.first AS first1, q2.first AS first2,
                 q1.query_no AS qn1, q2.query_no AS qn2, (q1.s_kind = 'agg' OR list_contains(q1.ic, q1.s_cols[1])) AS is_num
          FROM (SELECT * FROM pa WHERE side = 0) q1 JOIN (SELECT * FROM pa WHERE side = 1) q2 USING (table_id, pair)
          WHERE q1.sql <> q2.sql
            AND ((q1.s_kind <> 'agg' AND q2.s_kind <> 'agg' AND q1.s_cols = q2.s_cols)
                 OR (q1.s_kind = 'agg' AND q2.s_kind = 'agg'
                     AND list_sort(list_distinct([q1.s_agg, q2.s_agg])) IN (['count'], ['max'], ['min'], ['max', 'min'])))
            AND q1.n_ans_rows > 0 AND q2.n_ans_rows > 0 AND q1.first IS NOT NULL AND q1.first <> 'None'
            AND q2.first IS NOT NULL AND q2.first <> 'None'),
    jo AS (SELECT j.*, CASE WHEN is_num THEN {op_num} WHEN contains(sql1, 'limit') THEN '=' ELSE {op_set} END AS op FROM j),
    sv AS (SELECT jo.table_id, jo.pair, jo.op, ar.vals[1] AS v, 1 AS s FROM jo JOIN answer_rows ar ON ar.table_id = jo.table_id AND ar.query_no = jo.qn1
           WHERE jo.op IN ('union', 'intersect')
           UNION ALL
           SELECT jo.table_id, jo.pair, jo.op, ar.vals[1] AS v, 2 AS s FROM jo JOIN answer_rows ar ON ar.table_id = jo.table_id AND ar.query_no = jo.qn2
           WHERE jo.op IN ('union', 'intersect')),
    pv AS (SELECT table_id, pair, op, v, count(DISTINCT s) AS ns FROM sv WHERE v IS NOT NULL GROUP BY table_id, pair, op, v),
    sets AS (SELECT table_id, pair, list_sort(list(v)) AS vs FROM pv WHERE op = 'union' OR ns = 2 GROUP BY table_id, pair)
    SELECT jo.table_id, jo.pair,
           regexp_replace(CASE WHEN op IN ('union', 'intersect') THEN sql1 || ' ' || op || ' ' || sql2
                               ELSE 'select ( ' || sql1 || ' ) ' || op || ' ( ' || sql2 || ' )' END, ' {{2}}', ' ', 'g') AS sql,
           CASE WHEN op IN ('union', 'intersect') THEN coalesce(CASE WHEN len(vs) = 0 THEN '' WHEN len(vs) = 1 THEN vs[1] ELSE array_to_string(vs, ', ') END, '')
                WHEN op = '>' THEN CAST(CAST({n1} > {n2} AS INTEGER) AS VARCHAR)
                WHEN op = '<' THEN CAST(CAST({n1} < {n2} AS INTEGER) AS VARCHAR)
                WHEN op = '+' THEN CAST({n1} + {n2} AS VARCHAR)
                WHEN op = '-' THEN CAST({n1} - {n2} AS VARCHAR)
                ELSE CAST(CAST(first1 = first2 AS INTEGER) AS VARCHAR) END AS answer{more}
    FROM jo LEFT JOIN sets USING (table_id, pair)"""


@query("inst_coarse_pairs", DB.exec_sql(DB.LINEITEM_BY_SUPPLIER, T1, pairs_sql()))
def inst_coarse_pairs(spark, sf_dir):
    """Three-level t1 queries: ``select ( q1 ) op ( q2 )`` and ``q1 union|intersect q2``."""
    from tabqa.operators import nested as N

    sp = shared.specs(spark, sf_dir, "supplier", T1)
    ex = shared.executed(spark, sf_dir, "supplier", T1)
    return N.pair_ops(sp, ex.answers, ex.answer_rows, T1.seed).select("table_id", "pair", "sql", "answer")


FINE = S.SpecParams(seed=13, per_table=20, kind="fine")


@query(
    "inst_fine",
    f"WITH {DB.LINEITEM_BY_SUPPLIER},\n{DB.specs_sql(DB.LINEITEM_BY_SUPPLIER, FINE)}\n"
    "SELECT table_id, query_no, tpl, sql FROM specs",
)
def inst_fine(spark, sf_dir):
    """Fine-template instantiation: typed column slots, > < = operators, hashed literals."""
    return shared.specs(spark, sf_dir, "supplier", FINE).select("table_id", "query_no", "tpl", "sql")


@query("exec_fine", DB.exec_sql(DB.LINEITEM_BY_SUPPLIER, FINE, OUT_SQL))
def exec_fine(spark, sf_dir):
    """Answers of the fine-template specs (J1, J5 counts in n_ans_rows)."""
    return shared.answers(spark, sf_dir, "supplier", FINE).select(*OUT)


@query(
    "nl_instruction_zh",
    f"WITH {DB.LINEITEM_BY_SUPPLIER},\n{DB.specs_sql(DB.LINEITEM_BY_SUPPLIER, SP)}\n"
    "SELECT table_id, query_no, multistep_zh FROM specs",
)
def nl_instruction_zh(spark, sf_dir):
    """Chinese multi-step instruction of every spec."""
    return shared.specs(spark, sf_dir, "supplier", SP).select("table_id", "query_no", "multistep_zh")


_FINE_COL = "list_filter(header, lambda h: contains(regexp_extract(sql, 'select (.*?) from', 1), h))[1]"
_FINE_WHERE = "trim(regexp_extract(sql, 'where (.*)$', 1))"
_FINE_EN = (
    f"'Filter the row according to the condition, the cells of the specified column in the row need to meet: ' || {_FINE_WHERE} || '.' || "
    f"'Select cell of ''' || {_FINE_COL} || ''' column in filtered rows.'"
)
_FINE_ZH = f"'根据条件筛选行，行中指定列的单元格需要满足： ' || {_FINE_WHERE} || '.' || '选择已筛选的行中的 ''' || {_FINE_COL} || ''' 列的值作为答案'"


def _fine_text(name: str, zh: bool, duck: str, doc: str) -> None:
    def fn(spark, sf_dir):
        from tabqa.operators.instructions import multiturn

        sp = shared.specs(spark, sf_dir, "supplier", FINE)
        return sp.select("table_id", "query_no", multiturn(F.col("sql"), F.col("header"), zh).alias("multiturn"))

    fn.__doc__ = doc
    query(name, f"WITH {DB.LINEITEM_BY_SUPPLIER},\n{DB.specs_sql(DB.LINEITEM_BY_SUPPLIER, FINE)}\nSELECT table_id, query_no, {duck} AS multiturn FROM specs")(fn)


_fine_text("nl_fine_en", False, _FINE_EN, "English multi-turn instruction of the fine-template queries (M19).")
_fine_text("nl_fine_zh", True, _FINE_ZH, "Chinese multi-turn instruction of the fine-template queries (M19).")


def _d_answer_tables():
    name = lambda c: f"s.header[{c} + 1]"
    hdr = (
        f"CASE s.s_kind WHEN 'calc' THEN [{name('s.s_cols[1]')} || ' ' || s.s_op || ' ' || {name('s.s_cols[2]')}] "
        f"WHEN 'agg' THEN [s.s_agg || ' ( ' || {name('s.s_cols[1]')} || ' )'] "
        f"WHEN 'group' THEN [{name('s.g_col')}] "
        f"WHEN 'group_agg' THEN [{name('s.g_col')}, s.h_agg || ' ( ' || {name('s.h_col')} || ' )'] "
        f"ELSE list_transform(s.s_cols, lambda c: s.header[c + 1]) END"
    )
    typ = (
        "CASE WHEN s.s_kind IN ('calc', 'agg') THEN ['INT'] WHEN s.s_kind = 'group' THEN ['TEXT'] "
        "WHEN s.s_kind = 'group_agg' THEN ['TEXT', 'INT'] ELSE list_transform(s.s_cols, lambda c: s.types[c + 1]) END"
    )
    pad = "CASE WHEN m.ty[j + 1] = 'INT' THEN lpad({v}, CAST(m.w[j + 1] AS INTEGER), ' ') ELSE rpad({v}, CAST(m.w[j + 1] AS INTEGER), ' ') END"
    row = lambda v: "'| ' || array_to_string(list_transform(range(0, len(m.hd)), lambda j: " + pad.format(v=v) + "), ' | ') || ' |'"
    sep = (
        "'|' || array_to_string(list_transform(range(0, len(m.hd)), lambda j: CASE WHEN m.ty[j + 1] = 'INT' "
        "THEN repeat('-', CAST(m.w[j + 1] AS INTEGER) + 1) || ':' ELSE ':' || repeat('-', CAST(m.w[j + 1] AS INTEGER) + 1) END), '|') || '|'"
    )
    return f""", am AS (SELECT s.table_id, s.query_no, {hdr} AS hd, {typ} AS ty FROM specs s),
    ar AS (SELECT table_id, query_no, row_number() OVER (PARTITION BY table_id, query_no
                  ORDER BY coalesce(ord_i, 0), coalesce(ord_s, '')) - 1 AS ri,
                  list_transform(vals, lambda v: coalesce(v, 'None')) AS cells FROM answer_rows),
    cw2 AS (SELECT ar.table_id, ar.query_no, j, max(length(ar.cells[j + 1])) AS w
            FROM ar JOIN am USING (table_id, query_no), range(0, 10) AS t(j) WHERE j < len(am.hd) GROUP BY ar.table_id, ar.query_no, j),
    cwl2 AS (SELECT table_id, query_no, list(w ORDER BY j) AS cw FROM cw2 GROUP BY table_id, query_no),
    m AS (SELECT am.*, list_transform(range(0, len(am.hd)), lambda j: greatest(length(am.hd[j + 1]) + 2, coalesce(c.cw[j + 1], 0))) AS w
          FROM am LEFT JOIN cwl2 c USING (table_id, query_no)),
    body AS (SELECT ar.table_id, ar.query_no, string_agg({row('ar.cells[j + 1]')}, chr(10) ORDER BY ar.ri) AS body
             FROM ar JOIN m USING (table_id, query_no) GROUP BY ar.table_id, ar.query_no)
    SELECT m.table_id, m.query_no, 0 AS chunk,
           CASE WHEN b.body IS NULL THEN 'None Table'
                ELSE {row('m.hd[j + 1]')} || chr(10) || {sep} || chr(10) || b.body END AS text
    FROM m LEFT JOIN body b USING (table_id, query_no)"""


@query("exec_answer_table", DB.exec_sql(DB.ORDERS_BY_CUSTOMER, OBC, _d_answer_tables()))
def exec_answer_table(spark, sf_dir):
    """Answers of the customer-table specs as markdown tables."""
    sp = shared.specs(spark, sf_dir, "customer", OBC)
    ex = shared.executed(spark, sf_dir, "customer", OBC)
    return B.answer_tables(ex, sp, "markdown").select("table_id", "query_no", "chunk", "text")


_SPLIT_SQL = """SELECT * REPLACE (query_no * 2 AS query_no, 1 AS w_n) FROM specs_base WHERE w_n = 2
  UNION ALL
  SELECT * REPLACE (query_no * 2 + 1 AS query_no, 1 AS w_n, w2_col AS w1_col, w2_op AS w1_op, w2_num AS w1_num,
                    w2_nin AS w1_nin, w2_v1 AS w1_v1, w2_v2 AS w1_v2, w2_v3 AS w1_v3) FROM specs_base WHERE w_n = 2"""


def split_conditions(specs):
    """Two single-condition specs per two-condition spec: query_no*2 keeps the first
    condition, query_no*2+1 the second (I16)."""
    two = specs.where(F.col("w_n") == 2)
    first = two.withColumn("query_no", F.col("query_no") * 2).withColumn("w_n", F.lit(1))
    second = two.withColumn("query_no", F.col("query_no") * 2 + 1).withColumn("w_n", F.lit(1))
    for a in ("col", "op", "num", "nin", "v1", "v2", "v3"):
        second = second.withColumn(f"w1_{a}", F.col(f"w2_{a}"))
    return first.unionByName(second)


@query(
    "inst_multi_test",
    DB.exec_sql(
        DB.LINEITEM_BY_SUPPLIER, FINE,
        """SELECT table_id, query_no // 2 AS query_no,
                  max(CASE WHEN query_no % 2 = 0 THEN n_ans_rows END) AS n1,
                  max(CASE WHEN query_no % 2 = 1 THEN n_ans_rows END) AS n2,
                  CAST(max(CASE WHEN query_no % 2 = 0 THEN n_ans_rows END) BETWEEN 2 AND 5
                       AND max(CASE WHEN query_no % 2 = 1 THEN n_ans_rows END) BETWEEN 2 AND 5 AS INTEGER) AS kept
           FROM answers GROUP BY table_id, query_no // 2""",
        derive=_SPLIT_SQL,
    ),
)
def inst_multi_test(spark, sf_dir):
    """Multi-test: each condition of a two-condition fine query alone must return 2..5 rows (I16)."""
    c = shared.corpus(spark, sf_dir, "supplier")
    parts = split_conditions(shared.specs(spark, sf_dir, "supplier", FINE))
    a = B.execute(c.rows, parts).answers
    g = a.groupBy("table_id", (F.floor(F.col("query_no") / 2)).cast("int").alias("query_no")).agg(
        F.max(F.when(F.col("query_no") % 2 == 0, F.col("n_ans_rows"))).alias("n1"),
        F.max(F.when(F.col("query_no") % 2 == 1, F.col("n_ans_rows"))).alias("n2"),
    )
    return g.select("table_id", "query_no", "n1", "n2", (F.col("n1").between(2, 5) & F.col("n2").between(2, 5)).cast("int").alias("kept"))


_MULTI_SQL = """, parts AS (SELECT s.table_id, s.query_no, a.n_ans_rows, a.answer, regexp_extract(s.sql, '^(.*? where )', 1)
                    || string_split(regexp_extract(s.sql, ' where (.*)$', 1), ' and ')[1 + s.query_no % 2] AS sql
             FROM specs s JOIN answers a USING (table_id, query_no))
  SELECT p1.table_id, p1.query_no // 2 AS query_no, p1.sql AS sql1, p1.answer AS answer1, p2.sql AS sql2, p2.answer AS answer2
  FROM parts p1 JOIN parts p2 ON p2.table_id = p1.table_id AND p2.query_no = p1.query_no + 1
  WHERE p1.query_no % 2 = 0 AND p1.n_ans_rows BETWEEN 2 AND 5 AND p2.n_ans_rows BETWEEN 2 AND 5"""


@query("inst_multi_test_fields", DB.exec_sql(DB.LINEITEM_BY_SUPPLIER, FINE, _MULTI_SQL, derive=_SPLIT_SQL))
def inst_multi_test_fields(spark, sf_dir):
    """The two single-condition queries of each kept multi-test query, with their answers (I16)."""
    from tabqa.functions.dialect import SPARK

    c = shared.corpus(spark, sf_dir, "supplier")
    parts = split_conditions(shared.specs(spark, sf_dir, "supplier", FINE))
    parts = S._run_stages(parts, S.render_sql(SPARK))
    a = B.execute(c.rows, parts).assembled().texts(lists=False).where(F.col("n_ans_rows").between(2, 5))
    a = a.select("table_id", "query_no", F.floor(F.col("query_no") / 2).cast("int").alias("of"), "sql", "answer")
    first, second = a.where("query_no % 2 = 0").drop("query_no"), a.where("query_no % 2 = 1").drop("query_no")
    j = first.withColumnsRenamed({"sql": "sql1", "answer": "answer1"}).join(second.withColumnsRenamed({"sql": "sql2", "answer": "answer2"}), ["table_id", "of"])
    return j.withColumnRenamed("of", "query_no")


@query(
    "feat_selected_row_list",
    DB.exec_sql(DB.LINEITEM_BY_SUPPLIER, SP, "SELECT table_id, query_no, row_idx FROM f"),
)
def feat_selected_row_list(spark, sf_dir):
    """The rows that each query's WHERE selects."""
    c = shared.corpus(spark, sf_dir, "supplier")
    return B.selected_rows(c.rows, shared.specs(spark, sf_dir, "supplier", SP))
