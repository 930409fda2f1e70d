"""DuckDB oracle SQL for the execution traces (M20-M24), written independently."""

from __future__ import annotations

from tabqa.operators.specs import CODE_ENGLISH
from tabqa.plans import duck_batch as DB


def _eng(x: str) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CODE_ENGLISH.items()) + " END"


def _markdown(rows: str, meta: str, out: str) -> str:
    """CTEs rendering pseudo-tables: rows(pid, ri, cells), meta(pid, hd, ty) -> out(pid, md)."""
    pad = "CASE WHEN m.ty[j + 1] = 'INT' THEN lpad({v}, CAST(m.w[j + 1] AS INTEGER), ' ') ELSE rpad({v}, CAST(m.w[j + 1] AS INTEGER), ' ') END"
    row = lambda v: "'| ' || array_to_string(list_transform(range(0, len(m.hd)), lambda j: " + pad.format(v=v) + "), ' | ') || ' |'"
    sep = (
        "'|' || array_to_string(list_transform(range(0, len(m.hd)), lambda j: CASE WHEN m.ty[j + 1] = 'INT' "
        "THEN repeat('-', CAST(m.w[j + 1] AS INTEGER) + 1) || ':' ELSE ':' || repeat('-', CAST(m.w[j + 1] AS INTEGER) + 1) END), '|') || '|'"
    )
    return f"""{out}_cw AS (SELECT r.pid, j, max(length(r.cells[j + 1])) AS w FROM {rows} r, range(0, 16) AS t(j)
                   WHERE j < len(r.cells) GROUP BY r.pid, j),
    {out}_cwl AS (SELECT pid, list(w ORDER BY j) AS cw FROM {out}_cw GROUP BY pid),
    {out}_m AS (SELECT mm.*, list_transform(range(0, len(mm.hd)), lambda j: greatest(length(mm.hd[j + 1]) + 2, coalesce(c.cw[j + 1], 0))) AS w
                FROM {meta} mm LEFT JOIN {out}_cwl c USING (pid)),
    {out}_b AS (SELECT r.pid, string_agg({row('r.cells[j + 1]')}, chr(10) ORDER BY r.ri) AS body
                FROM {rows} r JOIN {out}_m m USING (pid) GROUP BY r.pid),
    {out} AS (SELECT m.pid, CASE WHEN b.body IS NULL THEN 'None Table'
                     ELSE {row('m.hd[j + 1]')} || chr(10) || {sep} || chr(10) || b.body END AS md
              FROM {out}_m m LEFT JOIN {out}_b b USING (pid))"""


def traces_sql(p, multiturn: bool = False, run=None, final: str | None = None) -> str:
    """Oracle of traces; ``run`` puts the text after other specs and matched rows (``specs``, ``f``), ``final`` reads ``per``."""
    pid = lambda step, g="0": f"((s.table_id * 64 + s.query_no) * 8 + {step}) * 1048576 + {g}"
    name = lambda c: f"s.header[{c} + 1]"
    calc = "(CASE WHEN s.s_op = '+' THEN s.nums[s.s_cols[1] + 1] + s.nums[s.s_cols[2] + 1] ELSE s.nums[s.s_cols[1] + 1] - s.nums[s.s_cols[2] + 1] END)"
    hv = "s.nums[s.h_col + 1]"

    def cmp(a, op, b):
        return f"(CASE {op} WHEN '>' THEN {a} > {b} WHEN '<' THEN {a} < {b} WHEN '=' THEN {a} = {b} END)"

    h_row_ok = f"(CASE WHEN s.h_kind = 'bare' THEN {cmp(hv, 's.h_op', 'TRY_CAST(s.h_lit AS BIGINT)')} WHEN s.h_kind = 'colcol' THEN {cmp(hv, 's.h_op', 's.nums[s.h_rcol + 1]')} END)"

    def pick(agg, pre):
        return f"(CASE {agg} WHEN 'count' THEN {pre}_cnt WHEN 'max' THEN {pre}_max WHEN 'min' THEN {pre}_min WHEN 'sum' THEN {pre}_sum END)"

    sel_hdr = (
        f"CASE WHEN s.s_kind = 'calc' THEN [{name('s.s_cols[1]')} || ' ' || s.s_op || ' ' || {name('s.s_cols[2]')}] "
        f"WHEN s.s_kind = 'agg' THEN [{name('s.s_cols[1]')}] ELSE list_transform(s.s_cols, lambda c: s.header[c + 1]) END"
    )
    sel_ty = "CASE WHEN s.s_kind = 'calc' THEN ['INT'] ELSE list_transform(s.s_cols, lambda c: s.types[c + 1]) END"
    select = f""", tf AS (SELECT * FROM f),
    gx AS (SELECT table_id, query_no, gk, CAST(dense_rank() OVER (PARTITION BY table_id, query_no ORDER BY gk NULLS FIRST) - 1 AS INTEGER) AS gi
           FROM (SELECT DISTINCT table_id, query_no, cells[g_col + 1] AS gk FROM tf WHERE g_col IS NOT NULL)),
    ga0 AS (SELECT s.table_id, s.query_no, s.cells[s.g_col + 1] AS gk,
                   count(s.cells[s.h_col + 1]) AS h_cnt, max({hv}) AS h_max, min({hv}) AS h_min, sum({hv}) AS h_sum,
                   bool_and(coalesce({h_row_ok}, true)) AS h_every,
                   count(s.cells[s.s_cols[1] + 1]) AS s_cnt, max(s.nums[s.s_cols[1] + 1]) AS s_max, min(s.nums[s.s_cols[1] + 1]) AS s_min,
                   sum(s.nums[s.s_cols[1] + 1]) AS s_sum, arg_min({calc}, s.row_idx) AS calc_first,
                   arg_min(s.cells[s.s_cols[1] + 1], s.row_idx) AS s_first
            FROM tf s WHERE s.g_col IS NOT NULL GROUP BY s.table_id, s.query_no, s.cells[s.g_col + 1]),
    ga AS (SELECT g.*, x.gi, sp.h_kind, sp.h_agg, sp.h_op, sp.h_lit, sp.s_kind, sp.s_agg, sp.o_kind, sp.o_desc,
                  {pick('sp.h_agg', 'g.h')} AS h_val, {pick('sp.s_agg', 'g.s')} AS s_val,
                  coalesce(CASE WHEN sp.h_kind = 'agg' THEN {cmp(pick('sp.h_agg', 'g.h'), 'sp.h_op', 'TRY_CAST(sp.h_lit AS BIGINT)')} ELSE g.h_every END, false) AS keep
           FROM ga0 g JOIN gx x ON x.table_id = g.table_id AND x.query_no = g.query_no AND x.gk IS NOT DISTINCT FROM g.gk JOIN specs sp ON sp.table_id = g.table_id AND sp.query_no = g.query_no),
    prow AS (
      SELECT {pid(0)} AS pid, s.row_idx AS ri, s.cells FROM tf s WHERE s.w_n > 0
      UNION ALL SELECT {pid(1, 'x.gi')}, s.row_idx, s.cells FROM tf s JOIN gx x ON x.table_id = s.table_id AND x.query_no = s.query_no
                AND x.gk IS NOT DISTINCT FROM s.cells[s.g_col + 1] WHERE s.g_col IS NOT NULL
      UNION ALL SELECT {pid(2)}, s.row_idx,
                CASE WHEN s.s_kind = 'calc' THEN [CAST({calc} AS VARCHAR)] WHEN s.s_kind = 'agg' THEN [s.cells[s.s_cols[1] + 1]]
                     ELSE list_transform(s.s_cols, lambda c: s.cells[c + 1]) END FROM tf s WHERE s.g_col IS NULL
      UNION ALL SELECT {pid(2)}, s.gi,
                CASE s.s_kind WHEN 'group' THEN [s.gk] WHEN 'group_agg' THEN [s.gk, CAST(s.h_val AS VARCHAR)]
                     WHEN 'agg' THEN [s.s_first] ELSE [CAST(s.calc_first AS VARCHAR)] END FROM ga s WHERE s.keep
      UNION ALL SELECT {pid(3)}, 0, [coalesce(CAST(coalesce({pick('s.s_agg', 'a.s')}, CASE WHEN s.s_agg = 'count' THEN 0 END) AS VARCHAR), 'None')]
                FROM specs s LEFT JOIN (SELECT table_id, query_no, count(cells[s_cols[1] + 1]) AS s_cnt, max(nums[s_cols[1] + 1]) AS s_max,
                                               min(nums[s_cols[1] + 1]) AS s_min, sum(nums[s_cols[1] + 1]) AS s_sum
                                        FROM tf WHERE g_col IS NULL AND s_kind = 'agg' GROUP BY table_id, query_no) a USING (table_id, query_no)
                WHERE s.g_col IS NULL AND s.s_kind = 'agg'
      UNION ALL SELECT {pid(3)}, s.gi, [CAST(s.s_val AS VARCHAR)] FROM ga s WHERE s.keep AND s.s_kind = 'agg'
      UNION ALL SELECT pid, 0, cells FROM (
                SELECT {pid(5)} AS pid, list_transform(s.s_cols, lambda c: s.cells[c + 1]) AS cells,
                       row_number() OVER (PARTITION BY s.table_id, s.query_no
                         ORDER BY CASE WHEN s.o_desc THEN -s.nums[s.o_col + 1] ELSE s.nums[s.o_col + 1] END, s.row_idx) AS rk
                FROM tf s WHERE s.o_kind <> 'none' AND s.g_col IS NULL) WHERE rk = 1
      UNION ALL SELECT pid, 0, cells FROM (
                SELECT {pid(5)} AS pid, [s.gk] AS cells,
                       row_number() OVER (PARTITION BY s.table_id, s.query_no
                         ORDER BY CASE WHEN s.o_desc THEN -s.h_val ELSE s.h_val END, s.gk) AS rk
                FROM ga s WHERE s.keep AND s.o_kind = 'agg') WHERE rk = 1),
    pmeta AS (
      SELECT {pid(0)} AS pid, s.header AS hd, s.types AS ty FROM specs s WHERE s.w_n > 0
      UNION ALL SELECT {pid(1, 'x.gi')}, s.header, s.types FROM specs s JOIN gx x USING (table_id, query_no)
      UNION ALL SELECT {pid(2)}, {sel_hdr}, {sel_ty} FROM specs s WHERE s.g_col IS NULL
      UNION ALL SELECT {pid(2)},
                CASE s.s_kind WHEN 'group' THEN [{name('s.g_col')}] WHEN 'group_agg' THEN [{name('s.g_col')}, s.h_agg || ' ( ' || {name('s.h_col')} || ' )'] ELSE {sel_hdr} END,
                CASE s.s_kind WHEN 'group' THEN [s.types[s.g_col + 1]] WHEN 'group_agg' THEN [s.types[s.g_col + 1], 'INT'] ELSE {sel_ty} END
                FROM specs s WHERE s.g_col IS NOT NULL
      UNION ALL SELECT {pid(3)}, [s.s_agg || ' ( ' || {name('s.s_cols[1]')} || ' )'], ['INT'] FROM specs s WHERE s.s_kind = 'agg'
      UNION ALL SELECT {pid(5)}, CASE WHEN s.g_col IS NOT NULL THEN [{name('s.g_col')}] ELSE list_transform(s.s_cols, lambda c: s.header[c + 1]) END,
                CASE WHEN s.g_col IS NOT NULL THEN [s.types[s.g_col + 1]] ELSE list_transform(s.s_cols, lambda c: s.types[c + 1]) END
                FROM specs s WHERE s.o_kind <> 'none'),
    {_markdown('prow', 'pmeta', 'md')},
    subs AS (SELECT g.table_id, g.query_no, g.gi, g.keep, 'new_table' || CAST(g.gi AS VARCHAR) || ':' || chr(10) || m.md AS t
             FROM ga g JOIN md m ON m.pid = ((g.table_id * 64 + g.query_no) * 8 + 1) * 1048576 + g.gi),
    tgrp AS (SELECT table_id, query_no, count(*) AS n_groups, string_agg(t, chr(10) ORDER BY gi) AS all_t,
                   string_agg(t, chr(10) ORDER BY gi) FILTER (WHERE keep) AS kept_t FROM subs GROUP BY table_id, query_no),
    steps AS (
      SELECT s.table_id, s.query_no, 0 AS code, s.ins_where AS inst, m.md AS inter FROM specs s LEFT JOIN md m ON m.pid = {pid(0)} WHERE s.w_n > 0
      UNION ALL SELECT s.table_id, s.query_no, 1, s.ins_group,
                'Divided rows into ' || CAST(coalesce(g.n_groups, 0) AS VARCHAR) || ' groups based on column ' || {name('s.g_col')} || ': ' || chr(10) || coalesce(g.all_t, '')
                FROM specs s LEFT JOIN tgrp g USING (table_id, query_no) WHERE s.g_col IS NOT NULL
      UNION ALL SELECT s.table_id, s.query_no, 2, s.ins_having, coalesce(g.kept_t, '') FROM specs s LEFT JOIN tgrp g USING (table_id, query_no) WHERE s.g_col IS NOT NULL
      UNION ALL SELECT s.table_id, s.query_no, 3,
                CASE WHEN s.s_kind = 'agg' THEN 'Select cells of ''' || {name('s.s_cols[1]')} || ''' column ' || CASE WHEN s.g_col IS NOT NULL THEN 'of these tables.' ELSE 'in rows.' END
                     WHEN s.s_kind = 'calc' THEN s.ins_select
                     ELSE 'Select the values in column [' || array_to_string(list_transform(s.s_cols, lambda c: '''' || s.header[c + 1] || ''''), ', ') || '] of these tables.' END,
                m.md FROM specs s LEFT JOIN md m ON m.pid = {pid(2)}
      UNION ALL SELECT s.table_id, s.query_no, 4, 'Calculate ' || {_eng('s.s_agg')} || CASE WHEN s.g_col IS NOT NULL THEN ' these cells.' ELSE ' cells.' END, m.md
                FROM specs s LEFT JOIN md m ON m.pid = {pid(3)} WHERE s.s_kind = 'agg'
      UNION ALL SELECT s.table_id, s.query_no, 5, s.ins_order, m.md FROM specs s LEFT JOIN md m ON m.pid = {pid(5)} WHERE s.o_kind <> 'none'),
    per AS (SELECT table_id, query_no, list({{'code': code, 'inst': inst, 'inter': inter}} ORDER BY code) AS st FROM steps GROUP BY table_id, query_no)
    {final or (FINAL_MULTITURN if multiturn else FINAL_TEXT)}"""
    return run(select) if run else DB.exec_sql(DB.ORDERS_BY_CUSTOMER, p, select)


FINAL_MULTITURN = """SELECT table_id, query_no, array_to_string(list_transform(st, lambda s: s.inst), ' || ') AS turn_input,
           CAST(len(st) AS INTEGER) AS n_outputs FROM per"""
FINAL_WHOLE_TURNS = """SELECT table_id, query_no, array_to_string(list_transform(st, lambda s: s.inst), ' || ') AS turn_input,
           array_to_string(list_transform(st, lambda s: s.inter), ' || ') AS turn_output, CAST(len(st) AS INTEGER) AS n_outputs FROM per"""
FINAL_TURNS = """SELECT table_id, query_no, list_transform(st, lambda s: s.inst) AS turn_input, list_transform(st, lambda s: s.inter) AS turn_output FROM per"""
FINAL_TEXT = """SELECT table_id, query_no, CAST(len(st) AS INTEGER) AS n_steps,
           'You need to execute ' || CAST(len(st) AS VARCHAR) || ' steps.' || chr(10) ||
           array_to_string(list_transform(range(0, len(st)), lambda i: CASE WHEN i < len(st) - 1
               THEN 'Step ' || CAST(i AS VARCHAR) || ': ' || st[i + 1].inst || chr(10) || 'Intermediate results ' || CAST(i AS VARCHAR) || ':' || chr(10) || st[i + 1].inter || chr(10)
               ELSE 'Step ' || CAST(i AS VARCHAR) || ': ' || st[i + 1].inst || chr(10) || 'Answer: ' || st[i + 1].inter END), '') AS cot
    FROM per"""
