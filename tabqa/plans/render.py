"""Tables rendered as text, one query per format."""

from __future__ import annotations

from tabqa.operators import render as M
from tabqa.plans import duck_batch as DB
from tabqa.plans.registry import query
from tabqa.sources import corpus as C
from tabqa.sources.tables import Tables

NL = "chr(10)"


def _corpus(spark, sf_dir):
    return C.orders_by_customer(Tables(spark, sf_dir).orders)


def _spark(fmt):
    def fn(spark, sf_dir):
        c = _corpus(spark, sf_dir)
        return M.render(c.rows, c.tables, fmt).drop("n_chunks")

    fn.__doc__ = f"Every customer table rendered as {fmt}."
    return fn


# ------------------------------------------------------------------ DuckDB oracles

J = "range(0, m.n_cols)"
INT = "m.types[j + 1] = 'INT'"


def _lst(expr, sep):
    return f"array_to_string(list_transform({J}, lambda j: {expr}), {sep})"


def _meta_w():
    return """cw AS (SELECT table_id, j, max(length(cells[j + 1])) AS w
           FROM crows, range(0, 5) AS t(j) GROUP BY table_id, j),
    cwl AS (SELECT table_id, list(w ORDER BY j) AS cw FROM cw GROUP BY table_id),
    meta AS (SELECT t.*, list_transform(range(0, t.n_cols), lambda j: CAST(greatest(length(t.header[j + 1]) + 2, c.cw[j + 1]) AS INTEGER)) AS mw,
                    list_transform(range(0, t.n_cols), lambda j: CAST(greatest(length(t.header[j + 1]), c.cw[j + 1] + 1) AS INTEGER)) AS tw
             FROM ctables t JOIN cwl c USING (table_id))"""


def _oracle(line, head, tail, sep, widths=False):
    meta = _meta_w() if widths else "meta AS (SELECT * FROM ctables)"
    return f"""WITH {DB.ORDERS_BY_CUSTOMER},
    {meta},
    lines AS (SELECT r.table_id, r.row_idx, {line} AS line FROM crows r JOIN meta m USING (table_id)),
    body AS (SELECT table_id, string_agg(line, {sep} ORDER BY row_idx) AS body FROM lines GROUP BY table_id)
    SELECT m.table_id, 0 AS chunk, {head} || b.body || {tail} AS text FROM meta m JOIN body b USING (table_id)"""


def _pad(v, w):
    return f"CASE WHEN {INT} THEN lpad({v}, {w}, ' ') ELSE rpad({v}, {w}, ' ') END"


def _md_row(v):
    return f"'| ' || {_lst(_pad(v, 'm.mw[j + 1]'), chr(39) + ' | ' + chr(39))} || ' |'"


def _md_sep():
    cell = "CASE WHEN " + INT + " THEN repeat('-', m.mw[j + 1] + 1) || ':' ELSE ':' || repeat('-', m.mw[j + 1] + 1) END"
    return f"'|' || {_lst(cell, chr(39) + '|' + chr(39))} || '|'"


IW = "CAST(greatest(2, length(CAST(m.n_rows - 1 AS VARCHAR))) AS INTEGER)"


def _mdi_row(first, v):
    return f"'| ' || lpad({first}, {IW}, ' ') || ' | ' || {_lst(_pad(v, 'm.mw[j + 1]'), chr(39) + ' | ' + chr(39))} || ' |'"


MDI_SEP = f"'|' || repeat('-', {IW} + 1) || ':|' || {_lst('CASE WHEN ' + INT + ' THEN repeat(' + chr(39) + '-' + chr(39) + ', m.mw[j + 1] + 1) || ' + chr(39) + ':' + chr(39) + ' ELSE ' + chr(39) + ':' + chr(39) + ' || repeat(' + chr(39) + '-' + chr(39) + ', m.mw[j + 1] + 1) END', chr(39) + '|' + chr(39))} || '|'"

LOW = "coalesce(lower(r.cells[j + 1]), '')"
RI = "CAST(r.row_idx AS VARCHAR)"
R1 = "CAST(r.row_idx + 1 AS VARCHAR)"
HDR = "array_to_string(m.header, ' | ')"
FLAT_HEAD = f"'The table have ' || CAST(m.n_cols AS VARCHAR) || ' columns: ' || {HDR} || {NL}"


def _esc_html(v):
    return f"replace(replace(replace({v}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _csv(v):
    return f"CASE WHEN regexp_matches({v}, '[,\"\\n\\r]') THEN '\"' || replace({v}, '\"', '\"\"') || '\"' ELSE {v} END"


def _json_s(v):
    return f"'\"' || replace(replace({v}, '\\', '\\\\'), '\"', '\\\"') || '\"'"


def _repr(v):
    return f"CASE WHEN {INT} THEN {v} ELSE '''' || {v} || '''' END"


ORACLES = {
    "markdown": _oracle(_md_row("r.cells[j + 1]"), f"{_md_row('m.header[j + 1]')} || {NL} || {_md_sep()} || {NL}", "''", NL, True),
    "markdown_index": _oracle(
        _mdi_row(RI, "r.cells[j + 1]"), f"{_mdi_row(chr(39) * 2, 'm.header[j + 1]')} || {NL} || {MDI_SEP} || {NL}", "''", NL, True
    ),
    "markdown_one_line": _oracle(
        _mdi_row(RI, "r.cells[j + 1]"), f"{_mdi_row(chr(39) * 2, 'm.header[j + 1]')} || ' ' || {MDI_SEP} || ' '", "''", "' '", True
    ),
    "json": _oracle(
        f"'\"' || {RI} || '\":{{' || {_lst(_json_s('m.header[j + 1]') + ' || ' + chr(39) + ':' + chr(39) + ' || CASE WHEN ' + INT + ' THEN r.cells[j + 1] ELSE ' + _json_s('r.cells[j + 1]') + ' END', chr(39) + ',' + chr(39))} || '}}'",
        "'{'", "'}'", "','",
    ),
    "matrix": _oracle(
        f"'  [' || {RI} || ', ' || {_lst(_repr('r.cells[j + 1]'), chr(39) + ', ' + chr(39))} || ']' || {NL}",
        f"'[' || {NL} || '  ['''', ' || array_to_string(list_transform(m.header, lambda x: '''' || x || ''''), ', ') || ']' || {NL}",
        "']'", "''",
    ),
    "html": _oracle(
        f"'    <tr>' || {NL} || '      <th>' || {RI} || '</th>' || {NL} || {_lst(chr(39) + '      <td>' + chr(39) + ' || ' + _esc_html('r.cells[j + 1]') + ' || ' + chr(39) + '</td>' + chr(39) + ' || chr(10)', chr(39) * 2)} || '    </tr>' || {NL}",
        f"'<table border=\"1\" class=\"dataframe\">' || {NL} || '  <thead>' || {NL} || '    <tr style=\"text-align: right;\">' || {NL} || '      <th></th>' || {NL} || "
        f"{_lst(chr(39) + '      <th>' + chr(39) + ' || ' + _esc_html('m.header[j + 1]') + ' || ' + chr(39) + '</th>' + chr(39) + ' || chr(10)', chr(39) * 2)} || '    </tr>' || {NL} || '  </thead>' || {NL} || '  <tbody>' || {NL}",
        f"'  </tbody>' || {NL} || '</table>'", "''",
    ),
    "csv": _oracle(
        f"{RI} || ',' || {_lst(_csv('r.cells[j + 1]'), chr(39) + ',' + chr(39))} || {NL}",
        f"',' || {_lst(_csv('m.header[j + 1]'), chr(39) + ',' + chr(39))} || {NL}", "''", "''",
    ),
    "tab": _oracle(
        f"rpad({RI}, CAST(length(CAST(m.n_rows - 1 AS VARCHAR)) AS INTEGER), ' ') || {_lst(chr(39) + ' ' + chr(39) + ' || lpad(r.cells[j + 1], m.tw[j + 1], ' + chr(39) + ' ' + chr(39) + ')', chr(39) * 2)}",
        f"repeat(' ', CAST(length(CAST(m.n_rows - 1 AS VARCHAR)) AS INTEGER)) || {_lst(chr(39) + ' ' + chr(39) + ' || lpad(m.header[j + 1], m.tw[j + 1], ' + chr(39) + ' ' + chr(39) + ')', chr(39) * 2)} || {NL}",
        "''", NL, True,
    ),
    "flatten": _oracle(
        f"'row ' || {R1} || ' : ' || {_lst('m.header[j + 1] || ' + chr(39) + ' is ' + chr(39) + ' || ' + LOW + ' || ' + chr(39) + '. ' + chr(39), chr(39) * 2)} || {NL}",
        FLAT_HEAD, "''", "''",
    ),
    "tapex": _oracle(
        f"'row ' || {R1} || ' : ' || {_lst(LOW, chr(39) + ' | ' + chr(39))} || {NL}",
        f"'header: ' || {HDR} || {NL}", "''", "''",
    ),
    "flatten_norow": _oracle(
        f"{_lst('m.header[j + 1] || ' + chr(39) + ' is ' + chr(39) + ' || ' + LOW + ' || ' + chr(39) + '. ' + chr(39), chr(39) * 2)} || {NL}",
        FLAT_HEAD, "''", "''",
    ),
    "col_row_line": _oracle(
        f"'row ' || {R1} || ' : ' || {_lst(LOW, chr(39) + ' | ' + chr(39))} || ' '",
        f"'col : ' || {HDR} || ' '", "''", "''",
    ),
    "noenter": _oracle(
        f"'row ' || {R1} || ' : ' || {_lst('m.header[j + 1] || ' + chr(39) + ' is ' + chr(39) + ' || ' + LOW + ' || ' + chr(39) + '.  ' + chr(39) + ' || ' + LOW + ' || ' + chr(39) + ' | ' + chr(39), chr(39) * 2)} || ' '",
        f"'The table have ' || CAST(m.n_cols AS VARCHAR) || ' columns: ' || {HDR} || ' '", "''", "''",
    ),
    "dfloader": f"""WITH {DB.ORDERS_BY_CUSTOMER},
    cols AS (SELECT r.table_id, j, string_agg(CASE WHEN m.types[j + 1] = 'INT' THEN r.cells[j + 1] ELSE '''' || r.cells[j + 1] || '''' END, ', ' ORDER BY r.row_idx) AS vals
             FROM crows r JOIN ctables m USING (table_id), range(0, 5) AS t(j) GROUP BY r.table_id, j),
    body AS (SELECT c.table_id, string_agg('    ''' || m.header[c.j + 1] || ''': [' || c.vals || '],' || {NL}, '' ORDER BY c.j) AS body
             FROM cols c JOIN ctables m USING (table_id) GROUP BY c.table_id)
    SELECT m.table_id, 0 AS chunk, 'pd.DataFrame({{' || {NL} || b.body || '}},' || {NL} || 'index=[' || array_to_string(range(0, m.n_rows), ', ') || '])' AS text
    FROM ctables m JOIN body b USING (table_id)""",
}

for _fmt, _sql in ORACLES.items():
    query(f"fmt_{_fmt}", _sql)(_spark(_fmt))
