"""Typed query specs drawn per table (I1-I7) and their SQL text.

A spec is one row: which template, which columns, operators and literals
each clause uses.  Every choice is a hash of (seed, table_id, query_no,
slot), so the same seed gives the same specs under any partitioning.
Literals are cells of hashed rows; they are fetched with one join of
(table_id, row_idx) slots against the corpus rows, then pivoted back.

Clause rules follow the coarse generator: WHERE is one or two
column-op-value conditions (or one int column against another); GROUP
picks a text column outside WHERE; HAVING is an aggregate test, a test
every row of the group passes, or a column-column test; SELECT is columns,
a two-column sum/difference, an aggregate, the group key, or the group key
with the HAVING aggregate; ORDER takes the top row by an int column (or
the top group by the HAVING aggregate) and is dropped when the select has
more than one column or an aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabqa.functions.dialect import SPARK
from tabqa.session import ensure_checkpoint_dir, pin

# The coarse templates, in order (nest level 1).
TEMPLATES = {
    "s1": "select {S} from my_table",
    "s2": "select {S} from my_table {W}",
    "s3": "select {S} from my_table {O}",
    "s4": "select {S} from my_table {W} {O}",
    "s5": "select {S} from my_table {G} {H}",
    "s6": "select {S} from my_table {W} {G} {H}",
    "s7": "select {S} from my_table {W} {G} {H} {O}",
    "s8": "select {S} from my_table {G} {H} {O}",
}
WHERE_TEMPLATES = ("s2", "s4", "s6", "s7")
GROUP_TEMPLATES = ("s5", "s6", "s7", "s8")
ORDER_TEMPLATES = ("s3", "s4", "s7", "s8")


@dataclass(frozen=True)
class GeneratorProfile:
    """Emission weights of one generator of coarse queries."""

    where_value: float  # a condition on a value, not column against column
    where_one: float  # one condition, not two
    where_repeat: bool  # two conditions may be on one column
    text_ops: tuple  # operators on a text column, and their weights
    having_not_cc: float
    having_agg: float
    having_ops: tuple
    calc: float  # arithmetic of two columns in a top-level select
    calc_ops: tuple
    no_agg: tuple  # by flag: (s, d, t)
    agg_alone: bool  # an aggregate is forced where there is neither WHERE nor GROUP
    aggs: tuple  # aggregates of a numeric column
    plain_falling: bool  # a plain select takes 1..n columns with falling weights, not one
    having_distinct: float = 0.0  # a group's count is one of distinct values


P_IN_TWO = 0.6
P_GROUP_ONLY = 0.5
# The weights of the three generators.
PROFILES = {
    "english": GeneratorProfile(
        where_value=0.7, where_one=0.8, where_repeat=False, text_ops=(("=", "like", "in"), (0.6, 0.05, 0.1)),
        having_not_cc=0.9, having_agg=0.7, having_ops=(">", "<"), calc=0.05, calc_ops=(("+", "-"), (0.5, 0.5)),
        no_agg=(0.8, 40 / 45, 40 / 55), agg_alone=False, aggs=("min", "max", "count", "sum"), plain_falling=True,
    ),
    "ingested": GeneratorProfile(
        where_value=1.0, where_one=1.0, where_repeat=False, text_ops=(("=",), (1.0,)),
        having_not_cc=1.0, having_agg=0.7, having_ops=(">", "<"), calc=0.0, calc_ops=(("+", "-"), (0.5, 0.5)),
        no_agg=(0.8, 0.8, 0.8), agg_alone=True, aggs=("min", "max", "count", "sum"), plain_falling=False,
    ),
    "chinese": GeneratorProfile(
        where_value=1.0, where_one=0.7, where_repeat=True, text_ops=(("=", "like", "in"), (0.6, 0.2, 0.2)),
        having_not_cc=1.0, having_agg=0.7, having_ops=(">", "<", "="), calc=0.05, calc_ops=(("+", "-", "*", "/"), (0.5, 0.3, 0.1, 0.1)),
        no_agg=(0.8, 0.8, 0.8), agg_alone=False, aggs=("min", "max", "count", "sum", "avg"), plain_falling=False, having_distinct=0.5,
    ),
}
PLACE_BYTES = 80  # about what a literal's place takes in a broadcast table
BROADCAST_BYTES = 64 << 20
LITERAL_SLOTS = ("w1a", "w1b", "w1c", "w2a", "w2b", "w2c", "h")


@dataclass(frozen=True)
class SpecParams:
    seed: int = 42
    per_table: int = 20
    templates: tuple = tuple(TEMPLATES)
    # 's' top-level; 'd'/'t' sub-queries of two/three-level templates: no
    # arithmetic select, a single select column, aggregates 5/45 or 15/55.
    flag: str = "s"
    # draw the template once per pair of consecutive queries (three-level t1 pairs)
    pair: bool = False
    # 'coarse' (templates s1-s8) or 'fine' (fine templates)
    kind: str = "coarse"
    profile: str = "english"  # a name in PROFILES
    first: int = 0  # number of the first query, to draw on where another call ended


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


class Draws:
    """Expression builders for one dialect."""

    def __init__(self, d, seed: int):
        self.d = d
        self.seed = seed

    def hs(self, slot: str, *extra: str) -> str:
        return self.d.h(self.d.key(str(self.seed), "table_id", "query_no", _q(slot), *extra))

    def u(self, slot: str) -> str:
        return f"({self.hs(slot)} / 4294967296.0)"

    def pick(self, arr: str, slot: str) -> str:
        d = self.d
        return d.at(arr, f"1 + {self.hs(slot)} % greatest({d.size(arr)}, 1)")

    def choice(self, options, slot: str) -> str:
        arr = self.d.arr(*[_q(o) for o in options])
        return self.d.at(arr, f"1 + {self.hs(slot)} % {len(options)}")

    def weighted(self, options, weights, slot: str) -> str:
        from tabqa.functions.hashing import thresholds

        steps = thresholds(options, weights)
        if len(steps) == 1:
            return _q(steps[0][0])
        u = self.u(slot)
        whens = " ".join(f"WHEN {u} < {acc!r} THEN {_q(el)}" for el, acc in steps[:-1])
        return f"CASE {whens} ELSE {_q(steps[-1][0])} END"

    def two_of(self, arr: str, slot: str) -> tuple[str, str]:
        """Two distinct elements in list order (random_select(list, 2)); [x, x] for one element."""
        d = self.d
        n = d.size(arr)
        i1 = f"({self.hs(slot + '1')} % greatest({n}, 1))"
        j = f"({self.hs(slot + '2')} % greatest({n} - 1, 1))"
        i2 = f"(CASE WHEN {n} < 2 THEN {i1} WHEN {j} >= {i1} THEN {j} + 1 ELSE {j} END)"
        return d.at(arr, f"1 + least({i1}, {i2})"), d.at(arr, f"1 + greatest({i1}, {i2})")


def stages(d, p: SpecParams) -> list[list[tuple[str, str]]]:
    """Ordered stages of (column, expression); each may use earlier columns."""
    x = Draws(d, p.seed)
    prof = PROFILES[p.profile]
    is_in = lambda col, items: f"{col} IN ({', '.join(_q(i) for i in items)})"
    st: list[list[tuple[str, str]]] = []
    st.append([
        ("tc", d.filt(d.rng("n_cols"), "i", f"{d.at('types', 'i + 1')} IN ('TEXT', 'DATE')")),
        ("ic", d.filt(d.rng("n_cols"), "i", f"{d.at('types', 'i + 1')} IN ('INT', 'REAL')")),
    ])
    tpl_arr = d.arr(*[_q(t) for t in p.templates])
    st.append([
        ("ac", d.cat("tc", "ic")),
        ("nic", d.size("ic")),
        (
            "tpl",
            d.at(tpl_arr, f"1 + {d.h(d.key(str(p.seed), 'table_id', 'CAST(floor(query_no / 2) AS INT)', _q('tpl_pair')))} % {len(p.templates)}")
            if p.pair
            else d.at(tpl_arr, f"1 + {x.hs('tpl')} % {len(p.templates)}"),
        ),
    ])
    st.append([
        ("has_w", is_in("tpl", WHERE_TEMPLATES)),
        ("has_g", f"({is_in('tpl', GROUP_TEMPLATES)}) AND nic > 0"),
        ("ord_slot", f"({is_in('tpl', ORDER_TEMPLATES)}) AND nic > 0"),
    ])
    cc_a, cc_b = x.two_of("ic", "wcc")
    st.append([
        ("w_cc", f"has_w AND nic >= 2 AND {x.u('w_mode')} >= {prof.where_value!r}"),
        ("w1_pick", x.pick("ac", "w1_col")),
        ("cc_a", cc_a),
        ("cc_b", cc_b),
    ])
    st.append([
        ("w_n", f"CASE WHEN NOT has_w THEN 0 WHEN w_cc THEN 1 WHEN {x.u('w_num')} < {prof.where_one!r} THEN 1 ELSE 2 END"),
        ("w1_col", "CASE WHEN w_cc THEN cc_a ELSE w1_pick END"),
        ("w1_rcol", "CASE WHEN w_cc THEN cc_b END"),
    ])
    st.append([
        ("w2_col", f"CASE WHEN w_n = 2 THEN {x.pick('ac' if prof.where_repeat else d.filt('ac', 'c', 'c <> w1_col'), 'w2_col')} END"),
    ])

    def op_for(n: int) -> str:
        col = f"w{n}_col"
        return (
            f"CASE WHEN {d.contains('tc', col)} THEN {x.weighted(*prof.text_ops, f'w{n}_op')} "
            f"ELSE {x.choice(['>', '<', '='], f'w{n}_op')} END"
        )

    st.append([
        ("w1_op", f"CASE WHEN w_n = 0 THEN NULL WHEN w_cc THEN {x.choice(['>', '<'], 'wcc_op')} ELSE {op_for(1)} END"),
        ("w1_num", f"NOT {d.contains('tc', 'w1_col')}"),
        ("w1_nin", f"CASE WHEN {x.u('w1_nin')} < {P_IN_TWO!r} THEN 2 ELSE 3 END"),
        ("w2_op", f"CASE WHEN w_n = 2 THEN {op_for(2)} END"),
        ("w2_num", f"NOT {d.contains('tc', 'w2_col')}"),
        ("w2_nin", f"CASE WHEN {x.u('w2_nin')} < {P_IN_TWO!r} THEN 2 ELSE 3 END"),
        (
            "w_cols",
            f"CASE WHEN w_n = 0 THEN {d.filt('ic', 'c', 'c < 0')} WHEN w_cc THEN {d.arr('cc_a', 'cc_b')} "
            f"WHEN w_n = 1 THEN {d.arr('w1_col')} ELSE {d.arr('w1_col', 'w2_col')} END",
        ),
    ])
    st.append([
        ("tc_nw", d.filt("tc", "c", f"NOT {d.contains('w_cols', 'c')}")),
        ("remain0", d.filt("ac", "c", f"NOT {d.contains('w_cols', 'c')}")),
    ])
    hc_a, hc_b = x.two_of("ic", "hcc")
    st.append([
        (
            "g_col",
            f"CASE WHEN NOT has_g THEN NULL WHEN {d.size('tc_nw')} > 0 THEN {x.pick('tc_nw', 'g')} ELSE {x.pick('tc', 'g')} END",
        ),
        (
            "h_kind",
            f"CASE WHEN NOT has_g THEN NULL WHEN nic >= 2 AND {x.u('h_mode')} >= {prof.having_not_cc!r} THEN 'colcol' "
            f"WHEN {x.u('h_agg')} < {prof.having_agg!r} THEN 'agg' ELSE 'bare' END",
        ),
        ("remain", f"CASE WHEN {d.size('remain0')} > 0 THEN remain0 ELSE ac END"),
        ("hc_a", hc_a),
        ("hc_b", hc_b),
    ])
    st.append([
        (
            "h_col",
            f"CASE h_kind WHEN 'agg' THEN {x.pick('ac', 'h_col')} WHEN 'bare' THEN {x.pick('ic', 'h_col')} "
            f"WHEN 'colcol' THEN hc_a END",
        ),
        ("h_rcol", "CASE WHEN h_kind = 'colcol' THEN hc_b END"),
        ("h_op", f"CASE WHEN has_g THEN {x.choice(prof.having_ops, 'h_op')} END"),
        ("h_n1", f"1 + {x.hs('h_n1')} % 6"),
    ])
    sc_a, sc_b = x.two_of("ic", "sc")
    nr = d.size("remain")
    wtot = f"({nr} * ({nr} + 3) / 2)"
    r_k = f"({x.hs('s_num')} % CAST({wtot} AS BIGINT))"
    k_sel = f"(1 + {d.size(d.filt(d.rng1('1', nr), 'm', f'm * ({nr} + 2) - m * (m + 1) / 2 <= {r_k}'))})"
    st.append([
        (
            "h_agg",
            f"CASE WHEN h_kind = 'agg' THEN CASE WHEN {d.contains('tc', 'h_col')} THEN 'count' "
            f"ELSE {x.choice(['count', 'max', 'min', 'sum'], 'h_aggf')} END END",
        ),
        ("h_uniq", f"{x.u('h_distinct')} < {prof.having_distinct!r}" if prof.having_distinct else "FALSE"),
        ("s_calc", f"{x.u('s_calc')} < {(prof.calc if p.flag == 's' else 0.0)!r}"),
        ("s_noagg", f"{x.u('s_agg')} < {prof.no_agg['sdt'.index(p.flag)]!r}" + (" AND (has_w OR has_g)" if prof.agg_alone else "")),
        ("s_op", x.weighted(*prof.calc_ops, "s_op")),
        ("sc_a", sc_a),
        ("sc_b", sc_b),
        ("s_k", k_sel if p.flag == "s" and prof.plain_falling else "1"),
        ("s_col", x.pick("remain", "s_col")),
    ])
    st.append([
        ("s_sel", d.lowest("remain", lambda v: x.hs("s_pick", v), "s_k")),
        (
            "s_kind",
            "CASE WHEN s_calc THEN 'calc' WHEN NOT s_noagg THEN 'agg' "
            f"WHEN g_col IS NOT NULL THEN CASE WHEN h_kind = 'agg' AND {'TRUE' if p.flag == 's' else 'FALSE'} AND {x.u('s_grp')} >= {P_GROUP_ONLY!r} THEN 'group_agg' ELSE 'group' END "
            "ELSE 'cols' END",
        ),
        (
            "s_agg",
            f"CASE WHEN {d.contains('ic', 's_col')} THEN {x.choice(prof.aggs, 's_aggf')} ELSE 'count' END",
        ),
    ])
    st.append([
        (
            "s_cols",
            f"CASE s_kind WHEN 'cols' THEN s_sel WHEN 'calc' THEN {d.arr('sc_a', 'sc_b')} WHEN 'agg' THEN {d.arr('s_col')} "
            f"WHEN 'group' THEN {d.arr('g_col')} ELSE {d.arr('g_col', 'h_col')} END",
        ),
    ])
    st.append([
        (
            "o_kind",
            f"CASE WHEN NOT ord_slot OR {d.size('s_cols')} > 1 OR s_kind = 'agg' THEN 'none' "
            "WHEN g_col IS NOT NULL THEN CASE WHEN h_kind = 'agg' THEN 'agg' ELSE 'none' END ELSE 'col' END",
        ),
        ("o_pick", x.pick("ic", "o_col")),
        ("o_desc", f"{x.u('o_dir')} >= 0.5"),
    ])
    st.append([
        ("o_col", "CASE o_kind WHEN 'col' THEN o_pick WHEN 'agg' THEN h_col END"),
        ("s_agg", "CASE WHEN s_kind = 'agg' THEN s_agg END"),
        ("h_distinct", "coalesce(h_agg = 'count' AND h_uniq, FALSE)"),
    ])
    # literal rows, one per slot
    st.append([(f"r_{s}", f"{x.hs('r_' + s)} % greatest(n_rows, 1)") for s in LITERAL_SLOTS])
    return st


def stage_list(d, p: SpecParams):
    return fine_stages(d, p) if p.kind == "fine" else stages(d, p)


def slot_columns() -> list[tuple[str, str]]:
    """(slot, column holding the cell's column index) for the literal join."""
    return [("w1a", "w1_col"), ("w1b", "w1_col"), ("w1c", "w1_col"),
            ("w2a", "w2_col"), ("w2b", "w2_col"), ("w2c", "w2_col"), ("h", "h_col")]


def literals(d) -> list[tuple[str, str]]:
    """Literals from the cells joined in (``lit_<slot>``); a missing cell is written as ``None``."""
    of = {s: f"CASE WHEN {c} IS NOT NULL THEN coalesce(lit_{s}, 'None') END" for s, c in slot_columns()}
    out = [(f"w{n}_v{i}", of[f"w{n}{x}"]) for n in (1, 2) for i, x in enumerate("abc", 1)]
    return [*out, ("h_lit", f"CASE WHEN h_agg = 'count' THEN {d.s('h_n1')} ELSE {of['h']} END")]


SPEC_COLUMNS = [
    "table_id", "query_no", "tpl", "n_rows", "n_cols", "header", "types", "ic",
    "w_n", "w_cc", "w1_col", "w1_rcol", "w1_op", "w1_num", "w1_nin", "w2_col", "w2_op", "w2_num", "w2_nin",
    "g_col", "h_kind", "h_col", "h_rcol", "h_op", "h_agg", "h_distinct", "h_n1",
    "s_kind", "s_cols", "s_op", "s_agg", "o_kind", "o_col", "o_desc",
]


def render_sql(d) -> list[tuple[str, str]]:
    """Stage producing the SQL text of a spec (M16) from header names and literals."""
    name = lambda c: d.at("header", f"{c} + 1")
    quoted = lambda v: f"replace({v}, '''', '''''')"  # noqa: E731  a quote inside a literal is doubled

    def cond(n: int) -> str:
        c, op, num = name(f"w{n}_col"), f"w{n}_op", f"w{n}_num"
        a, b, cc = (quoted(f"w{n}_v{i}") for i in (1, 2, 3))
        in_list = (
            f"'( ''' || {a} || ''' , ''' || {b} || ''''"
            f" || CASE WHEN w{n}_nin = 3 THEN ' , ''' || {cc} || '''' ELSE '' END || ' )'"
        )
        return (
            f"CASE WHEN {op} = 'like' THEN {c} || ' like ''' || {quoted(f'substr(w{n}_v1, 1, 3)')} || '%'''"
            f" WHEN {op} = 'in' THEN {c} || ' in ' || {in_list}"
            f" WHEN {num} THEN {c} || ' ' || {op} || ' ' || {a}"
            f" ELSE {c} || ' ' || {op} || ' ''' || {a} || '''' END"
        )

    where = (
        "CASE WHEN w_n = 0 THEN '' "
        f"WHEN w_cc THEN 'where ' || {name('w1_col')} || ' ' || w1_op || ' ' || {name('w1_rcol')} "
        f"WHEN w_n = 1 THEN 'where ' || {cond(1)} "
        f"ELSE 'where ' || {cond(1)} || ' and ' || {cond(2)} END"
    )
    group = f"CASE WHEN g_col IS NULL THEN '' ELSE 'group by ' || {name('g_col')} END"
    h_of = f"h_agg || CASE WHEN h_distinct THEN ' ( distinct ' ELSE ' ( ' END || {name('h_col')} || ' )'"
    having = (
        "CASE WHEN h_kind IS NULL THEN '' "
        f"WHEN h_kind = 'agg' THEN 'having ' || {h_of} || ' ' || h_op || ' ' || h_lit "
        f"WHEN h_kind = 'bare' THEN 'having ' || {name('h_col')} || ' ' || h_op || ' ' || h_lit "
        f"ELSE 'having ' || {name('h_col')} || ' ' || h_op || ' ' || {name('h_rcol')} END"
    )
    sel = (
        f"CASE s_kind WHEN 'cols' THEN {d.join(d.tr('s_cols', 'c', name('c')), chr(39) + ',' + chr(39))} "
        f"WHEN 'calc' THEN {name(d.at('s_cols', '1'))} || ' ' || s_op || ' ' || {name(d.at('s_cols', '2'))} "
        f"WHEN 'agg' THEN s_agg || ' ( ' || {name(d.at('s_cols', '1'))} || ' )' "
        f"WHEN 'group' THEN {name('g_col')} "
        f"ELSE {name('g_col')} || ', ' || {h_of} END"
    )
    direction = "CASE WHEN o_desc THEN 'desc' ELSE 'asc' END"
    order = (
        "CASE o_kind WHEN 'none' THEN '' "
        f"WHEN 'col' THEN 'order by ' || {name('o_col')} || ' ' || {direction} || ' limit 1' "
        f"ELSE 'order by ' || {h_of} || ' ' || {direction} || ' limit 1' END"
    )
    parts = {"S": "S", "W": "W", "G": "G", "H": "H", "O": "O"}
    cases = []
    for t, text in {**TEMPLATES, **{f: "select {S} from my_table {W}" for f in FINE}}.items():
        pieces = []
        rest = text
        while "{" in rest:
            pre, _, tail = rest.partition("{")
            ph, _, rest = tail.partition("}")
            pieces.append(_q(pre))
            pieces.append(f"__{parts[ph]}")
        pieces.append(_q(rest))
        cases.append(f"WHEN '{t}' THEN " + " || ".join(p for p in pieces if p != "''"))
    text = "CASE tpl " + " ".join(cases) + " END"
    return [
        [("__S", sel), ("__W", where), ("__G", group), ("__H", having), ("__O", order)],
        [("sql", d.squeeze(text))],
    ]


def _run_stages(df: DataFrame, st) -> DataFrame:
    for stage in st:
        names = [n for n, _ in stage]
        keep = [c for c in df.columns if c not in names]
        df = df.selectExpr(*[f"`{c}`" for c in keep], *[f"{e} AS {n}" for n, e in stage])
    return df


def draw(tables: DataFrame, rows: DataFrame, p: SpecParams = SpecParams()) -> DataFrame:
    """Specs for every table: ``per_table`` rows per table with their SQL text."""
    d = SPARK
    base = tables.select(
        "table_id", "header", "types", "n_rows", "n_cols",
        F.explode(F.sequence(F.lit(p.first), F.lit(p.first + p.per_table - 1))).alias("query_no"),
    )
    # The draws are CPU-heavy per spec but the input is small: spread it over
    # an explicit partition count (AQE keeps explicit counts, it would merge
    # a size-based repartition into one task).
    n_parts = max(tables.sparkSession.sparkContext.defaultParallelism * 2, 1)
    base = base.repartition(n_parts, "table_id", "query_no")
    ensure_checkpoint_dir(tables.sparkSession)
    # The draws are deep expressions used several times below: pin them once
    # (reliable checkpoint in the session's checkpoint folder; specs are small).
    sp = pin(_run_stages(base, stage_list(d, p)), "spec-draws")
    # Literal cells: one (slot, row, col) per slot, one join with the rows, pivot back.
    slots = F.array(*[
        F.struct(F.lit(s).alias("slot"), F.col(f"r_{s}").cast("bigint").alias("row_idx"), F.col(c).alias("col"))
        for s, c in slot_columns()
    ])
    need = sp.select("table_id", "query_no", F.explode(slots).alias("x")).select(
        "table_id", "query_no", "x.slot", "x.row_idx", "x.col"
    ).where(F.col("col").isNotNull())
    # The places asked for go to the rows while their bytes allow, so that the corpus is not shuffled for a few cells.
    small = sp.count() * len(LITERAL_SLOTS) * PLACE_BYTES <= BROADCAST_BYTES
    vals = rows.select("table_id", "row_idx", "cells").join(F.broadcast(need) if small else need, ["table_id", "row_idx"]).select(
        "table_id", "query_no", "slot", F.try_element_at("cells", F.col("col") + 1).alias("v")
    )
    piv = vals.groupBy("table_id", "query_no").agg(
        *[F.max(F.when(F.col("slot") == s, F.col("v"))).alias(f"lit_{s}") for s in LITERAL_SLOTS]
    )
    sp = sp.join(piv, ["table_id", "query_no"], "left")
    sp = sp.select(
        *SPEC_COLUMNS,
        *[F.expr(e).alias(n) for n, e in literals(d)],
    )
    sp = _run_stages(sp, render_sql(d) + instruction_sql(d) + instruction_zh_sql(d))
    return pin(sp.drop("__S", "__W", "__G", "__H", "__O", "zh_where", "zh_group", "zh_having", "zh_select", "zh_order"), "specs")


# English words for operators and aggregates in instructions.
CODE_ENGLISH = {
    ">": "greater than", "<": "less than", "=": "equal to", "count": "the number of",
    "max": "the maximum value of", "min": "the minimum value of", "sum": "the sum of the values of",
    "avg": "the average of", "+": "sum of", "-": "difference between", "*": "product of", "/": "quotient of",
}


def instruction_sql(d) -> list[list[tuple[str, str]]]:
    """Stages producing the English multi-step instruction of a spec."""
    name = lambda c: d.at("header", f"{c} + 1")

    def eng(x: str) -> str:
        return "CASE " + x + " " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in CODE_ENGLISH.items()) + " END"

    nl = "'\n'"

    def cond(n: int) -> str:
        c, op, num = name(f"w{n}_col"), f"w{n}_op", f"w{n}_num"
        a, b, cc = f"w{n}_v1", f"w{n}_v2", f"w{n}_v3"
        return (
            f"CASE WHEN {op} = 'like' THEN 'The value of column ' || {c} || ' is required to fuzzy match ''' || substr({a}, 1, 3) || '%''.'"
            f" WHEN {op} = 'in' THEN 'The value of column ' || {c} || ' is either ''' || {a} || ''' or ''' || {b} || ''''"
            f" || CASE WHEN w{n}_nin = 3 THEN ' or ''' || {cc} || '''' ELSE '' END || '.'"
            f" WHEN {num} THEN 'The value of column ' || {c} || ' needs to be ' || {eng(op)} || ' ' || {a} || '.'"
            f" ELSE 'The value of column ' || {c} || ' is ''' || {a} || '''.' END"
        )

    where = (
        "CASE WHEN w_n = 0 THEN '' ELSE 'Please filter the rows by the column conditions, which need to be met: ' || "
        f"CASE WHEN w_cc THEN 'The value of column ' || {name('w1_col')} || ' needs to be ' || {eng('w1_op')} || ' the value of column ' || {name('w1_rcol')} || '.' "
        f"WHEN w_n = 1 THEN {cond(1)} ELSE {cond(1)} || ' ' || {cond(2)} END || {nl} END"
    )
    group = f"CASE WHEN g_col IS NULL THEN '' ELSE 'The rows are then grouped according to the value of the ' || {name('g_col')} || ' in the remaining rows.' || {nl} END"
    having = (
        "CASE WHEN h_kind IS NULL THEN '' ELSE 'Then filter some groups by the following condition:' || "
        f"CASE WHEN h_kind = 'agg' AND h_agg = 'count' THEN CASE WHEN h_distinct THEN 'the number of distinct values of column ' ELSE 'the number of column ' END || {name('h_col')} || ' is ' || {eng('h_op')} || ' ' || h_lit || '.' "
        f"WHEN h_kind = 'agg' THEN {eng('h_agg')} || ' column ' || {name('h_col')} || ' is ' || {eng('h_op')} || ' ' || h_lit || '.' "
        f"WHEN h_kind = 'bare' THEN 'the column ' || {name('h_col')} || ' is ' || {eng('h_op')} || ' ' || h_lit || '.' "
        f"ELSE 'The value of column ' || {name('h_col')} || ' needs to be ' || {eng('h_op')} || ' the value of column ' || {name('h_rcol')} || '.' END || {nl} END"
    )
    distinct = "CASE WHEN h_distinct THEN ' distinct values of ' ELSE ' ' END"
    pylist = "'[' || " + d.join(d.tr("s_cols", "c", "'''' || " + name("c") + " || ''''"), "', '") + " || ']'"
    s1 = name(d.at("s_cols", "1"))
    s2 = name(d.at("s_cols", "2"))
    select = (
        f"CASE s_kind WHEN 'calc' THEN 'Select calculate ' || {eng('s_op')} || ' the values in columns ' || {s1} || ' and ' || {s2} || ' in filtered rows.' "
        f"WHEN 'agg' THEN CASE WHEN s_agg = 'count' AND NOT {d.contains('ic', d.at('s_cols', '1'))} THEN 'Select the number of cells of ' || {s1} || ' column in filtered rows.' "
        f"ELSE 'Select ' || {eng('s_agg')} || ' values of ' || {s1} || ' column in filtered rows.' END "
        f"WHEN 'group_agg' THEN 'Select values of ' || {name('g_col')} || ' column and ' || {eng('h_agg')} || {distinct} || {name('h_col')} || ' in filtered rows.' "
        f"ELSE 'Select values of ' || {pylist} || ' column in filtered rows.' END"
    )
    order = (
        "CASE o_kind WHEN 'none' THEN '' ELSE 'Sort the obtained values in ' || CASE WHEN o_desc THEN 'descending' ELSE 'ascending' END "
        f"|| ' order of ' || CASE WHEN o_kind = 'agg' THEN {eng('h_agg')} || {distinct} || {name('h_col')} ELSE {name('o_col')} END "
        f"|| ' and select the ' || CASE WHEN o_desc THEN 'largest' ELSE 'smallest' END || ' value to get the answer.' || {nl} END"
    )
    return [
        [("ins_where", where), ("ins_group", group), ("ins_having", having), ("ins_select", select), ("ins_order", order)],
        [("multistep", "ins_where || ins_group || ins_having || ins_select || ins_order")],
    ]


# The fine templates (easy, where-condition and long-context lines), in order.
FINE_TEMPLATES = [
    "select <text_col1> from my_table where <int_col1> = <int_1>",
    "select <int_col1> from my_table where <text_col1> = <text_1>",
    "select <int_col1> from my_table where <int_col2> = <int_2>",
    "select <text_col1> from my_table where <text_col2> = <text_2>",
    "select <text_col1> from my_table where <text_col2> <op2> <text_2>",
    "select <int_col1> from my_table where <text_col1> <op1> <text_1>",
    "select <text_col1> from my_table where <int_col1> <op1> <int_1>",
    "select <int_col1> from my_table where <int_col2> <op2> <int_2>",
    "select <text_col1> from my_table where <text_col1> = <text_1>",
    "select <text_col1> from my_table where <int_col1> <op1> <int_1> and <int_col1> <op2> <int_1>",
    "select <text_col1> from my_table where <text_col2> = <text_2> and <text_col3> = <text_3>",
    "select <text_col1> from my_table where <int_col1> <op1> <int_1> and <int_col2> <op2> <int_2>",
    "select <text_col1> from my_table where <int_col1> <op1> <int_1> and <text_col1> = <text_1>",
    "select <text_col1> from my_table where <text_col1> = <text_1> and <int_col1> <op1> <int_1>",
    "select <text_col1> from my_table where <text_col1> = <text_1> and <text_col2> = <text_2>",
    "select <text_col1> from my_table where <text_col2> = <text_2>",
]
FINE_OPS = [">", "<", "="]


def _fine_structure(t: str):
    """(select slot, [(column slot, op slot or literal op, literal slot)]) of a fine template."""
    import re

    sel = re.match(r"select <(\w+)> from my_table", t).group(1)
    conds = re.findall(r"<(\w+_col\d)> (=|<op\d>) <(\w+_\d)>", t)
    return sel, [(c, op.strip("<>"), lit) for c, op, lit in conds]


FINE = {f"f{i + 1}": _fine_structure(t) for i, t in enumerate(FINE_TEMPLATES)}


def fine_stages(d, p: "SpecParams") -> list[list[tuple[str, str]]]:
    """Draws for fine-template specs (I6), as the same spec columns the executor reads.

    Column slots take distinct columns of their type while more than one is
    left (int_col1..3, text_col1..4); each <opN> is one of > < =; each
    literal slot takes the value of its column in one hashed row, so a slot
    used twice repeats its value.
    """
    x = Draws(d, p.seed)
    names = list(FINE)
    st: list[list[tuple[str, str]]] = []
    st.append([
        ("tc", d.filt(d.rng("n_cols"), "i", f"{d.at('types', 'i + 1')} IN ('TEXT', 'DATE')")),
        ("ic", d.filt(d.rng("n_cols"), "i", f"{d.at('types', 'i + 1')} IN ('INT', 'REAL')")),
    ])
    st.append([
        ("ac", d.cat("tc", "ic")),
        ("nic", d.size("ic")),
        ("tpl", d.at(d.arr(*[_q(n) for n in names]), f"1 + {x.hs('tpl')} % {len(names)}")),
    ])

    # picks depend on earlier picks: one stage per slot keeps the expressions small
    for prefix, arr, k in (("int_col", "ic", 3), ("text_col", "tc", 4)):
        rest = arr
        for i in range(1, k + 1):
            name = f"{prefix}{i}"
            st.append([(name, x.pick(rest, name))])
            st.append([(f"__rest_{name}", f"CASE WHEN {d.size(rest)} > 1 THEN {d.filt(rest, 'c', f'c <> {name}')} ELSE {rest} END")])
            rest = f"__rest_{name}"
    st.append([(f"op{i}", x.choice(FINE_OPS, f"op{i}")) for i in range(1, 5)])

    def case(fn):
        return "CASE tpl " + " ".join(f"WHEN {_q(n)} THEN {fn(FINE[n])}" for n in names) + " END"

    def cond_part(k: int, part: int):
        def f(s):
            _, conds = s
            if len(conds) < k:
                return "NULL"
            v = conds[k - 1][part]
            if part == 1:
                return _q(v) if v == "=" else v
            return v

        return f

    def lit_key(k: int):
        return lambda s: _q(s[1][k - 1][2]) if len(s[1]) >= k else "NULL"

    st.append([
        ("w_n", case(lambda s: str(len(s[1])))),
        ("w_cc", "FALSE"),
        ("w1_col", case(cond_part(1, 0))),
        ("w2_col", case(cond_part(2, 0))),
        ("w1_op", case(cond_part(1, 1))),
        ("w2_op", case(cond_part(2, 1))),
        ("__lk1", case(lit_key(1))),
        ("__lk2", case(lit_key(2))),
        ("s_col1", case(lambda s: s[0])),
    ])
    st.append([
        ("w1_rcol", "CAST(NULL AS INT)"),
        ("w1_num", f"{d.contains('ic', 'w1_col')}"),
        ("w2_num", f"coalesce({d.contains('ic', 'w2_col')}, FALSE)"),
        ("w1_nin", "2"), ("w2_nin", "2"),
        ("w_cols", d.filt(d.arr("w1_col", "w2_col"), "c", "c IS NOT NULL")),
        ("g_col", "CAST(NULL AS INT)"), ("h_kind", "CAST(NULL AS STRING)" if d.name == "spark" else "CAST(NULL AS VARCHAR)"),
        ("h_col", "CAST(NULL AS INT)"), ("h_rcol", "CAST(NULL AS INT)"),
        ("h_op", "CAST(NULL AS STRING)" if d.name == "spark" else "CAST(NULL AS VARCHAR)"),
        ("h_agg", "CAST(NULL AS STRING)" if d.name == "spark" else "CAST(NULL AS VARCHAR)"),
        ("h_distinct", "FALSE"), ("h_n1", "1"),
        ("s_kind", "'cols'"), ("s_cols", d.arr("s_col1")),
        ("s_op", "CAST(NULL AS STRING)" if d.name == "spark" else "CAST(NULL AS VARCHAR)"),
        ("s_agg", "CAST(NULL AS STRING)" if d.name == "spark" else "CAST(NULL AS VARCHAR)"),
        ("o_kind", "'none'"), ("o_col", "CAST(NULL AS INT)"), ("o_desc", "FALSE"),
        ("r_w1a", f"{d.h(d.key(str(p.seed), 'table_id', 'query_no', '__lk1'))} % greatest(n_rows, 1)"),
        ("r_w2a", f"{d.h(d.key(str(p.seed), 'table_id', 'query_no', '__lk2'))} % greatest(n_rows, 1)"),
    ] + [(f"r_{s}", "0") for s in LITERAL_SLOTS if s not in ("w1a", "w2a")])
    return st


# Chinese words for operators and aggregates in instructions.
CODE_CHINESE = {
    ">": "大于", "<": "小于", "=": "等于", "count": "数量", "max": "最大值", "min": "最小值",
    "sum": "和", "avg": "平均值", "+": "之和", "-": "之差", "*": "之积", "/": "之商",
}


def instruction_zh_sql(d) -> list[list[tuple[str, str]]]:
    """Stages producing the Chinese instruction of a spec.

    Clauses are joined with newlines (empty clauses included), as the
    Chinese generator does.  Column-vs-column conditions, which that
    generator never draws, are phrased like the value conditions.
    """
    name = lambda c: d.at("header", f"{c} + 1")

    def zh(x: str) -> str:
        return "CASE " + x + " " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in CODE_CHINESE.items()) + " END"

    number_zh = "CASE WHEN h_distinct THEN ' 列未重复的数量' ELSE ' 列的数量' END"

    def cond(n: int) -> str:
        c, op, num = name(f"w{n}_col"), f"w{n}_op", f"w{n}_num"
        a, b, cc = f"w{n}_v1", f"w{n}_v2", f"w{n}_v3"
        return (
            f"CASE WHEN {op} = 'like' THEN '列 ' || {c} || ' 的值模糊匹配''' || substr({a}, 1, 3) || '%''.'"
            f" WHEN {op} = 'in' THEN '列 ' || {c} || ' 的值是 ''' || {a} || ''' 或 ''' || {b} || ''''"
            f" || CASE WHEN w{n}_nin = 3 THEN ' 或 ''' || {cc} || '''' ELSE '' END || '.'"
            f" WHEN {num} THEN '列 ' || {c} || ' 的值 ' || {zh(op)} || ' ' || {a} || '.'"
            f" WHEN {op} = '=' THEN '列 ' || {c} || ' 的值是 ''' || {a} || '''.'"
            f" ELSE '列 ' || {c} || ' 的值 ' || {zh(op)} || ' ''' || {a} || '''.' END"
        )

    where = (
        "CASE WHEN w_n = 0 THEN '' ELSE '请按需要满足的列条件筛选行： ' || "
        f"CASE WHEN w_cc THEN '列 ' || {name('w1_col')} || ' 的值 ' || {zh('w1_op')} || ' 列 ' || {name('w1_rcol')} || ' 的值.' "
        f"WHEN w_n = 1 THEN {cond(1)} ELSE {cond(1)} || ' ' || {cond(2)} END END"
    )
    group = f"CASE WHEN g_col IS NULL THEN '' ELSE '然后根据剩余行中' || {name('g_col')} || '的值对行进行分组.' END"
    having = (
        "CASE WHEN h_kind IS NULL THEN '' ELSE '然后根据以下条件筛选某些组：' || "
        f"CASE WHEN h_kind = 'agg' AND h_agg = 'count' THEN {name('h_col')} || {number_zh} || ' ' || {zh('h_op')} || ' ' || h_lit || CASE WHEN h_distinct AND NOT {d.contains('ic', 'h_col')} THEN '' ELSE '.' END "
        f"WHEN h_kind = 'agg' THEN {name('h_col')} || ' 列的' || {zh('h_agg')} || ' ' || {zh('h_op')} || ' ' || h_lit || '.' "
        f"WHEN h_kind = 'bare' THEN {name('h_col')} || ' 列 ' || {zh('h_op')} || ' ' || h_lit || '.' "
        f"ELSE {name('h_col')} || ' 列 ' || {zh('h_op')} || ' ' || {name('h_rcol')} || ' 列.' END END"
    )
    s1 = name(d.at("s_cols", "1"))
    s2 = name(d.at("s_cols", "2"))
    cols = d.join(d.tr("s_cols", "c", name("c")), "', '")
    select = (
        f"CASE s_kind WHEN 'calc' THEN '选择，并计算，已筛选行中，两列 ' || {s1} || ' 和 ' || {s2} || {zh('s_op')} || '。 ' "
        f"WHEN 'agg' THEN CASE WHEN s_agg = 'count' AND NOT {d.contains('ic', d.at('s_cols', '1'))} THEN '选择，已筛选行中的' || {s1} || ' 列的数量' "
        f"ELSE '选择，已筛选行中的' || {s1} || ' 列，并求' || {zh('s_agg')} END "
        f"WHEN 'group_agg' THEN '选择，已筛选行中的 ' || {name('g_col')} || ' 列，并求' || {name('h_col')} || CASE WHEN h_distinct THEN ' 列未重复的' ELSE ' 列的' END || {zh('h_agg')} "
        f"ELSE '选择，已筛选行中的 ' || {cols} || ' 列' END"
    )
    order = (
        "CASE o_kind WHEN 'none' THEN '' "
        "WHEN 'col' THEN '将已选择的值按 ' || CASE WHEN o_desc THEN '降序' ELSE '升序' END || ' ' || "
        f"{name('o_col')} || '排序，并且选择最' || CASE WHEN o_desc THEN '大' ELSE '小' END || '的值。' "
        "ELSE '将已选择的值按 ' || CASE WHEN h_agg = 'count' THEN "
        f"{name('h_col')} || {number_zh} ELSE {name('h_col')} || ' 列的' || {zh('h_agg')} END || CASE WHEN h_distinct AND o_desc THEN ' 降序' ELSE ' 升序' END || '排序，并且选择最' "
        "|| CASE WHEN o_desc THEN '大' ELSE '小' END || '的值。' END"
    )
    nl = "'\n'"
    return [
        [("zh_where", where), ("zh_group", group), ("zh_having", having), ("zh_select", select), ("zh_order", order)],
        [("multistep_zh", f"zh_where || {nl} || zh_group || {nl} || zh_having || {nl} || zh_select || {nl} || zh_order")],
    ]
