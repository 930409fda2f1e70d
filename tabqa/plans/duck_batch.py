"""DuckDB oracle SQL for spec drawing and batched execution.

The draws reuse the portable stage expressions (DuckDB spelling); the
execution below is written independently in DuckDB SQL.
"""

from __future__ import annotations

from tabqa.functions.dialect import DUCK as d
from tabqa.operators import specs as S

LINEITEM_BY_SUPPLIER = """
crows AS (
  SELECT l_suppkey AS table_id,
         CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber,
              l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS BIGINT) AS row_idx,
         [l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'), CAST(l_linenumber AS VARCHAR),
          CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR)] AS cells,
         [NULL, NULL, NULL, CAST(l_linenumber AS BIGINT), CAST(trunc(l_quantity) AS BIGINT)] AS nums
  FROM lineitem),
ctables AS (
  SELECT table_id, ['l_returnflag', 'l_linestatus', 'l_shipdate', 'l_linenumber', 'l_quantity'] AS header,
         ['TEXT', 'TEXT', 'DATE', 'INT', 'INT'] AS types, count(*) AS n_rows, 5 AS n_cols
  FROM crows GROUP BY table_id)"""

LINEITEM_ONE_TABLE = """
crows AS (
  SELECT CAST(0 AS BIGINT) AS table_id,
         CAST(row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber,
              l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS BIGINT) AS row_idx,
         [l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'), CAST(l_linenumber AS VARCHAR),
          CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR), CAST(l_suppkey AS VARCHAR)] AS cells,
         [NULL, NULL, NULL, CAST(l_linenumber AS BIGINT), CAST(trunc(l_quantity) AS BIGINT), l_suppkey] AS nums
  FROM lineitem),
ctables AS (
  SELECT table_id, ['l_returnflag', 'l_linestatus', 'l_shipdate', 'l_linenumber', 'l_quantity', 'l_suppkey'] AS header,
         ['TEXT', 'TEXT', 'DATE', 'INT', 'INT', 'INT'] AS types, count(*) AS n_rows, 6 AS n_cols
  FROM crows GROUP BY table_id)"""

ORDERS_BY_CUSTOMER = """
crows AS (
  SELECT o_custkey AS table_id,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS row_idx,
         [o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d'), CAST(o_orderkey AS VARCHAR),
          CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR)] AS cells,
         [NULL, NULL, NULL, o_orderkey, CAST(trunc(o_totalprice) AS BIGINT)] AS nums
  FROM orders),
ctables AS (
  SELECT table_id, ['o_orderstatus', 'o_orderpriority', 'o_orderdate', 'o_orderkey', 'o_totalprice'] AS header,
         ['TEXT', 'TEXT', 'DATE', 'INT', 'INT'] AS types, count(*) AS n_rows, 5 AS n_cols
  FROM crows GROUP BY table_id)"""


#: The text of an exact decimal, as a float prints.
def real_text(x: str) -> str:
    return f"regexp_replace(CAST(CAST({x} AS DECIMAL(38,6)) AS VARCHAR), '(\\.\\d+?)0+$', '\\1')"


ORDERS_EXACT = f"""
crows AS (
  SELECT o_custkey AS table_id,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS row_idx,
         [o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d'), CAST(o_orderkey AS VARCHAR), {real_text('o_totalprice')}] AS cells,
         [NULL, NULL, NULL, CAST(o_orderkey AS DECIMAL(25,6)), CAST(o_totalprice AS DECIMAL(25,6))] AS nums
  FROM orders),
ctables AS (
  SELECT table_id, ['o_orderstatus', 'o_orderpriority', 'o_orderdate', 'o_orderkey', 'o_totalprice'] AS header,
         ['TEXT', 'TEXT', 'DATE', 'INT', 'REAL'] AS types, count(*) AS n_rows, 5 AS n_cols
  FROM crows GROUP BY table_id)"""

ORDERS_HARD = """
hrows AS (
  SELECT o_custkey // 10 AS table_id, o_orderkey AS k,
         CASE WHEN o_orderkey % 7 <> 0 THEN CASE o_orderkey % 5 WHEN 0 THEN 'O' || chr(39) || o_orderstatus WHEN 1 THEN 'the "' || o_orderstatus || '"'
              WHEN 2 THEN chr(39) || o_orderstatus || chr(39) || '"\\' ELSE o_orderstatus END END AS status,
         CASE WHEN o_orderkey % 4 <> 0 THEN substr(o_orderpriority, 1, 1) END AS priority,
         CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
         CASE WHEN o_orderkey % 11 <> 0 THEN 4611686018427387904 - (o_orderkey % 1000003) * CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 1099511627776 END END AS huge,
         CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 10 END AS small
  FROM orders),
crows AS (
  SELECT table_id, CAST(row_number() OVER (PARTITION BY table_id ORDER BY k) - 1 AS BIGINT) AS row_idx,
         [status, priority, day, CAST(huge AS VARCHAR), CAST(small AS VARCHAR)] AS cells, [NULL, NULL, NULL, huge, small] AS nums
  FROM hrows),
ctables AS (
  SELECT table_id, ['status', 'priority', 'day', 'huge', 'small'] AS header,
         ['TEXT', 'TEXT', 'DATE', 'INT', 'INT'] AS types, count(*) AS n_rows, 5 AS n_cols
  FROM crows GROUP BY table_id)"""


def _stage_chain(first: str, known: list[str], stages, name: str) -> tuple[list[str], str]:
    ctes = []
    prev = first
    known = list(known)
    for i, st in enumerate(stages):
        cur = f"{name}{i}"
        rep = [f"{e} AS {n}" for n, e in st if n in known]
        new = [f"{e} AS {n}" for n, e in st if n not in known]
        star = "*" + (f" REPLACE ({', '.join(rep)})" if rep else "")
        ctes.append(f"{cur} AS (SELECT {', '.join([star, *new])} FROM {prev})")
        known += [n for n, _ in st if n not in known]
        prev = cur
    return ctes, prev


def specs_sql(corpus: str, p: S.SpecParams, out_name: str = "specs") -> str:
    """CTE text defining ``specs`` (one row per spec with literals and sql)."""
    base = (
        f"sbase AS (SELECT table_id, header, types, n_rows, n_cols, CAST(q AS INTEGER) AS query_no "
        f"FROM ctables, unnest(range({p.first}, {p.first + p.per_table})) AS t(q))"
    )
    ctes, last = _stage_chain("sbase", ["table_id", "header", "types", "n_rows", "n_cols", "query_no"], S.stage_list(d, p), "st")
    slots = ", ".join(
        f"{{'slot': '{s}', 'row_idx': CAST(r_{s} AS BIGINT), 'col': {c}}}" for s, c in S.slot_columns()
    )
    need = f"need AS (SELECT table_id, query_no, unnest([{slots}]) AS x FROM {last})"
    vals = (
        "vals AS (SELECT n.table_id, n.query_no, n.x.slot AS slot, r.cells[n.x.col + 1] AS v FROM need n "
        "JOIN crows r ON r.table_id = n.table_id AND r.row_idx = n.x.row_idx WHERE n.x.col IS NOT NULL)"
    )
    piv = "piv AS (SELECT table_id, query_no, " + ", ".join(
        f"max(CASE WHEN slot = '{s}' THEN v END) AS lit_{s}" for s in S.LITERAL_SLOTS
    ) + " FROM vals GROUP BY table_id, query_no)"
    lit = (
        f"slit AS (SELECT {', '.join('s.' + c for c in S.SPEC_COLUMNS)}, "
        + ", ".join(f"{e} AS {n}" for n, e in S.literals(d))
        + f" FROM {last} s LEFT JOIN piv USING (table_id, query_no))"
    )
    lit_cols = ["w1_v1", "w1_v2", "w1_v3", "w2_v1", "w2_v2", "w2_v3", "h_lit"]
    rctes, rlast = _stage_chain("slit", S.SPEC_COLUMNS + lit_cols, S.render_sql(d) + S.instruction_sql(d) + S.instruction_zh_sql(d), "rs")
    out = f"{out_name} AS (SELECT * EXCLUDE (__S, __W, __G, __H, __O, zh_where, zh_group, zh_having, zh_select, zh_order) FROM {rlast})"
    return ",\n".join([base, *ctes, need, vals, piv, lit, *rctes, out])


def _cmp(a: str, op: str, b: str) -> str:
    return f"(CASE {op} WHEN '>' THEN {a} > {b} WHEN '<' THEN {a} < {b} WHEN '=' THEN {a} = {b} END)"


def _repr(x: str) -> str:
    """Python's repr of a printable text; None for NULL."""
    quote, plain = "chr(39)", f"replace({x}, chr(92), chr(92) || chr(92))"
    return (
        f"coalesce(CASE WHEN contains({x}, {quote}) AND NOT contains({x}, chr(34)) THEN chr(34) || {plain} || chr(34) "
        f"ELSE {quote} || CASE WHEN contains({x}, {quote}) THEN replace({plain}, {quote}, chr(92) || {quote}) ELSE {plain} END || {quote} END, 'None')"
    )


def _wcond(n: int, kind: str) -> str:
    c = f"cells[w{n}_col + 1]"
    v = f"nums[w{n}_col + 1]"
    lit = f"w{n}_v1"
    text = (
        f"(CASE w{n}_op WHEN '=' THEN {c} = {lit} "
        f"WHEN 'like' THEN starts_with(lower({c}), lower(substr({lit}, 1, 3))) "
        f"WHEN 'in' THEN coalesce({c} = {lit} OR {c} = w{n}_v2 OR (w{n}_nin = 3 AND {c} = w{n}_v3), false) "
        f"WHEN '>' THEN {c} > {lit} WHEN '<' THEN {c} < {lit} END)"
    )
    num = _cmp(v, f"w{n}_op", f"TRY_CAST({lit} AS {kind})")
    return f"(CASE WHEN w{n}_num THEN {num} ELSE {text} END)"


def exec_sql(corpus: str, p: S.SpecParams, select: str, derive: str | None = None, exact: bool = False) -> str:
    """Full oracle: corpus CTEs, specs, execution, answers; ``select`` reads ``answers``/``specs``.

    ``exact`` if the corpus has REAL columns, so that its numbers are decimals.
    """
    kind = "DECIMAL(25,6)" if exact else "BIGINT"
    wide = "DECIMAL(38,6)" if exact else "HUGEINT"
    real = (lambda *cols: "(" + " OR ".join(f"coalesce(types[{c} + 1] = 'REAL', false)" for c in cols) + ")") if exact else (lambda *_: "false")

    def text(v: str, is_real: str) -> str:
        return f"(CASE WHEN {is_real} THEN {real_text(v)} ELSE CAST(CAST({v} AS HUGEINT) AS VARCHAR) END)" if exact else f"CAST({v} AS VARCHAR)"

    cc = _cmp("nums[w1_col + 1]", "w1_op", "nums[w1_rcol + 1]")
    where_ok = f"coalesce(w_n = 0 OR ((CASE WHEN w_cc THEN {cc} ELSE {_wcond(1, kind)} END) AND (w_n < 2 OR {_wcond(2, kind)})), false)"
    n1, n2 = f"CAST(nums[s_cols[1] + 1] AS {wide})", f"CAST(nums[s_cols[2] + 1] AS {wide})"
    if exact:
        both = "(CASE s_op WHEN '+' THEN {a} + {b} WHEN '-' THEN {a} - {b} END)".format(a=n1, b=n2)
    else:
        both = f"(CASE s_op WHEN '+' THEN {n1} + {n2} WHEN '-' THEN {n1} - {n2} WHEN '*' THEN {n1} * {n2} WHEN '/' THEN {n1} // nullif({n2}, 0) END)"
    calc = text(both, real("s_cols[1]", "s_cols[2]"))
    hv = "nums[h_col + 1]"
    h_row_ok = (
        f"(CASE WHEN h_kind = 'bare' THEN {_cmp(hv, 'h_op', f'TRY_CAST(h_lit AS {kind})')} "
        f"WHEN h_kind = 'colcol' THEN {_cmp(hv, 'h_op', 'nums[h_rcol + 1]')} END)"
    )
    tup = (
        "'(' || array_to_string(list_transform(s_cols, lambda i: CASE WHEN types[i + 1] IN ('INT', 'REAL') THEN coalesce(cells[i + 1], 'None') "
        f"ELSE {_repr('cells[i + 1]')} END), ', ') || ')'"
    )

    def pick(agg, pre):
        return (
            f"(CASE {agg} WHEN 'count' THEN coalesce({pre}_cnt, 0) WHEN 'max' THEN {pre}_max "
            f"WHEN 'min' THEN {pre}_min WHEN 'sum' THEN {pre}_sum END)"
        )

    avg = "CAST(CAST(s_sum AS DOUBLE) / nullif(s_nums, 0) AS VARCHAR)"
    if exact:  # whole millionths, rounded at nine places and at six
        u = "CAST(replace(CAST(CAST(s_sum AS DECIMAL(38,6)) AS VARCHAR), '.', '') AS HUGEINT)"
        u6 = f"(sign({u}) * (((2000 * abs({u}) + s_nums) // (2 * nullif(s_nums, 0)) + 500) // 1000))"
        digits = f"lpad(CAST(abs({u6}) AS VARCHAR), 7, '0')"
        avg = f"CASE WHEN s_real THEN CASE WHEN {u6} < 0 THEN '-' ELSE '' END || regexp_replace(left({digits}, length({digits}) - 6) || '.' || right({digits}, 6), '(\\.\\d+?)0+$', '\\1') ELSE {avg} END"
    s_val = f"(CASE WHEN s_agg = 'avg' THEN {avg} ELSE {text(pick('s_agg', 's'), 's_real AND s_agg <> ' + chr(39) + 'count' + chr(39))} END)"
    h_val = pick("h_agg", "h")
    h_text = text(h_val, "h_real AND h_agg <> 'count'")
    over = lambda v: f"({v} > 9223372036854775807 OR {v} < -9223372036854775808)"
    first = lambda nulls: "CASE WHEN o_desc THEN okey IS NULL ELSE okey IS NOT NULL END, okey, " + nulls
    spec_ctes = specs_sql(corpus, p) if derive is None else specs_sql(corpus, p, "specs_base") + f",\nspecs AS ({derive})"
    return f"""WITH {corpus},
{spec_ctes},
x AS (SELECT s.*, r.row_idx, r.cells, r.nums FROM specs s JOIN crows r USING (table_id)),
f AS (SELECT * FROM x WHERE {where_ok}),
refused AS (SELECT table_id, query_no FROM specs
  WHERE (w_n >= 1 AND NOT w_cc AND w1_num AND w1_v1 = 'None') OR (w_n = 2 AND w2_num AND w2_v1 = 'None') OR (h_kind IN ('agg', 'bare') AND h_lit = 'None')),
rm AS (
  SELECT table_id, query_no, CAST(row_idx AS BIGINT) AS ord_i, CAST(NULL AS VARCHAR) AS ord_s,
         CASE WHEN s_kind = 'calc' THEN [{calc}] ELSE list_transform(s_cols, lambda i: cells[i + 1]) END AS vals,
         {tup} AS tup, o_kind, o_desc,
         CASE WHEN o_desc THEN -nums[o_col + 1] ELSE nums[o_col + 1] END AS okey
  FROM f WHERE g_col IS NULL AND s_kind IN ('cols', 'calc')),
rm_top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id, query_no ORDER BY {first('ord_i')}) AS rk
                 FROM rm WHERE o_kind = 'col') WHERE rk = 1),
grouped AS (
  SELECT table_id, query_no, CASE WHEN g_col IS NOT NULL THEN cells[g_col + 1] END AS gkey, any_value({real('h_col')}) AS h_real, any_value({real('s_cols[1]')}) AS s_real,
         CASE WHEN any_value(h_distinct) THEN count(DISTINCT cells[h_col + 1]) ELSE count(cells[h_col + 1]) END AS h_cnt, max({hv}) AS h_max, min({hv}) AS h_min, sum({hv}) AS h_sum,
         bool_and(coalesce({h_row_ok}, true)) AS h_every,
         count(cells[s_cols[1] + 1]) AS s_cnt, max(nums[s_cols[1] + 1]) AS s_max, min(nums[s_cols[1] + 1]) AS s_min,
         sum(nums[s_cols[1] + 1]) AS s_sum, count(nums[s_cols[1] + 1]) AS s_nums, first({calc} ORDER BY row_idx) AS calc_first
  FROM f WHERE g_col IS NOT NULL OR s_kind = 'agg'
  GROUP BY table_id, query_no, CASE WHEN g_col IS NOT NULL THEN cells[g_col + 1] END),
gspec AS (SELECT table_id, query_no, g_col, h_kind, h_op, h_agg, h_lit, s_kind, s_agg, o_kind, o_desc FROM specs
          WHERE g_col IS NOT NULL OR s_kind = 'agg'),
globrows AS (
  SELECT s.table_id, s.query_no, CAST(0 AS BIGINT) AS ord_i, CAST(NULL AS VARCHAR) AS ord_s,
         [{s_val}] AS vals, CAST(NULL AS VARCHAR) AS tup
  FROM gspec s LEFT JOIN grouped g USING (table_id, query_no)
  WHERE s.g_col IS NULL),
failed AS (SELECT * FROM refused UNION SELECT table_id, query_no FROM grouped JOIN gspec USING (table_id, query_no)
  WHERE (s_kind = 'agg' AND s_agg = 'sum' AND NOT s_real AND {over('s_sum')}) OR (h_kind = 'agg' AND h_agg = 'sum' AND NOT h_real AND {over('h_sum')})),
grp AS (
  SELECT g.*, s.g_col, s.h_kind, s.h_op, s.h_agg, s.h_lit, s.s_kind, s.s_agg, s.o_kind, s.o_desc
  FROM grouped g JOIN gspec s USING (table_id, query_no) WHERE s.g_col IS NOT NULL),
gok AS (
  SELECT table_id, query_no, CAST(NULL AS BIGINT) AS ord_i, gkey AS ord_s, o_kind, o_desc,
         CASE s_kind WHEN 'group' THEN [gkey] WHEN 'group_agg' THEN [gkey, {h_text}]
              WHEN 'agg' THEN [{s_val}] ELSE [calc_first] END AS vals,
         '(' || {_repr('gkey')} || ', ' || coalesce({h_text}, 'None') || ')' AS tup,
         CASE WHEN o_desc THEN -{h_val} ELSE {h_val} END AS okey
  FROM grp
  WHERE coalesce(CASE WHEN h_kind = 'agg' THEN {_cmp(h_val, 'h_op', f'TRY_CAST(h_lit AS {kind})')} ELSE h_every END, false)),
gok_top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id, query_no ORDER BY {first('ord_s NULLS FIRST')}) AS rk
                 FROM gok WHERE o_kind = 'agg') WHERE rk = 1),
all_rows AS (
  SELECT table_id, query_no, ord_i, ord_s, vals, tup FROM rm WHERE o_kind <> 'col'
  UNION ALL SELECT table_id, query_no, ord_i, ord_s, vals, tup FROM rm_top
  UNION ALL SELECT table_id, query_no, ord_i, ord_s, vals, tup FROM globrows
  UNION ALL SELECT table_id, query_no, ord_i, ord_s, vals, tup FROM gok WHERE o_kind <> 'agg'
  UNION ALL SELECT table_id, query_no, ord_i, ord_s, vals, tup FROM gok_top),
answer_rows AS (SELECT * FROM all_rows ANTI JOIN failed USING (table_id, query_no)),
acount AS (
  SELECT table_id, query_no, count(*) AS n_ans_rows, max(len(vals)) AS n_ans_cols,
         list(coalesce(vals[1], 'None') ORDER BY ord_i NULLS FIRST, ord_s NULLS FIRST) AS firsts,
         list(tup ORDER BY ord_i NULLS FIRST, ord_s NULLS FIRST) AS tups,
         first(vals[1]) AS only_first
  FROM answer_rows GROUP BY table_id, query_no),
sel AS (SELECT table_id, query_no, count(*) AS n_selected FROM f GROUP BY table_id, query_no),
answers AS (
  SELECT s.table_id, s.query_no, s.n_rows, s.sql,
         coalesce(a.n_ans_rows, 0) AS n_ans_rows, CAST(coalesce(a.n_ans_cols, 0) AS INTEGER) AS n_ans_cols,
         CASE WHEN a.n_ans_rows IS NULL THEN '' WHEN a.n_ans_rows = 1 THEN a.only_first
              WHEN a.n_ans_cols > 1 THEN array_to_string(a.tups, ', ') ELSE array_to_string(a.firsts, ', ') END AS answer,
         CASE WHEN a.n_ans_rows IS NULL THEN CAST([] AS VARCHAR[]) ELSE a.firsts END AS answer_list,
         CASE WHEN fl.table_id IS NOT NULL THEN 0 ELSE coalesce(sl.n_selected, 0) END AS n_selected, fl.table_id IS NOT NULL AS failed
  FROM specs s LEFT JOIN acount a USING (table_id, query_no) LEFT JOIN sel sl ON sl.table_id = s.table_id AND sl.query_no = s.query_no
       LEFT JOIN failed fl ON fl.table_id = s.table_id AND fl.query_no = s.query_no)
{select}"""
