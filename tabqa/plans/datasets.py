"""Data-set assembly, sinks/sources round trips and prompts (I12-I15, A4, A7-A9, N)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tabqa.operators import datasets as DS
from tabqa.operators import prompts as P
from tabqa.operators import render as M
from tabqa.operators import specs as S
from tabqa.plans import controls as PC
from tabqa.plans import duck_batch as DB
from tabqa.plans import shared
from tabqa.plans.registry import query
from tabqa.session import pin
from tabqa.sources import corpus as C
from tabqa.sources.tables import Tables

N_SHOT = 5
CAP = 3
SEED = 42
OBC = S.SpecParams(seed=11, per_table=8)


def kept_queries(spark, sf_dir, corpus="supplier", texts=True):
    """corpus → specs → answers → default controls → kept (table_id, query_no, sql, and the answer if ``texts``)."""
    p = PC.SP if corpus == "supplier" else OBC
    return shared.kept(spark, sf_dir, corpus, p, texts), shared.corpus(spark, sf_dir, corpus)


D_KEPT = f"""kept AS (SELECT s.table_id, s.query_no, s.sql, a.answer {PC.D_FROM}
           WHERE NOT coalesce({PC.D_RULES['K1_null_answer']} OR {PC.D_RULES['K2_list_01']} OR {PC.D_RULES['K3_large_int']}
                           OR {PC.D_RULES['K4_all_rows']} OR NOT ({PC.D_ALEN} BETWEEN 1 AND 12), false)),
dd AS (SELECT k.* FROM kept k JOIN (SELECT table_id, min(query_no) AS query_no FROM kept GROUP BY table_id, sql) f
       USING (table_id, query_no)),
rk AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY query_no) AS rn FROM dd),
shots AS (SELECT table_id, list({{'sql': sql, 'answer': answer}} ORDER BY query_no) AS shots, count(*) AS n
          FROM rk WHERE rn <= {N_SHOT} GROUP BY table_id),
inst AS (SELECT t.table_id, t.query_no, t.rn, list_concat([{{'sql': t.sql, 'answer': t.answer}}], s.shots) AS examples
         FROM rk t JOIN shots s USING (table_id) WHERE t.rn > {N_SHOT} AND s.n = {N_SHOT})"""


def _duck(corpus_sql, p, select):
    return DB.exec_sql(corpus_sql, p, ", " + D_KEPT + "\n" + select)


def _instances(spark, sf_dir, fields=("sql", "answer")):
    kept, c = kept_queries(spark, sf_dir, texts="answer" in fields)
    return DS.few_shot(DS.dedup_first(kept), N_SHOT, fields), c


def _ex_sql():
    return F.array_join(F.transform("examples", lambda e: e["sql"]), " ;; ")
D_EX_SQL = "array_to_string(list_transform(examples, lambda e: e.sql), ' ;; ')"


@query("inst_dedup_first", _duck(DB.LINEITEM_BY_SUPPLIER, PC.SP, "SELECT table_id, query_no, sql FROM dd"))
def inst_dedup_first(spark, sf_dir):
    """Kept queries, first of each distinct SQL text per table."""
    kept, _ = kept_queries(spark, sf_dir, texts=False)
    return DS.dedup_first(kept).select("table_id", "query_no", "sql")


@query(
    "inst_few_shot",
    _duck(
        DB.LINEITEM_BY_SUPPLIER, PC.SP,
        f"SELECT table_id, query_no, CAST(rn AS INTEGER) AS rn, CAST(len(examples) AS INTEGER) AS n_examples, {D_EX_SQL} AS ex_sql FROM inst",
    ),
)
def inst_few_shot(spark, sf_dir):
    """Targets with their table's five shared shots."""
    inst, _ = _instances(spark, sf_dir, fields=("sql",))
    return inst.select("table_id", "query_no", F.col("rn").cast("int").alias("rn"), F.size("examples").alias("n_examples"), _ex_sql().alias("ex_sql"))


@query(
    "inst_cap",
    _duck(
        DB.LINEITEM_BY_SUPPLIER, PC.SP,
        f"SELECT table_id, query_no FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY rn) AS k FROM inst) WHERE k <= {CAP}",
    ),
)
def inst_cap(spark, sf_dir):
    """At most three instances per table."""
    inst, _ = _instances(spark, sf_dir, fields=("sql",))
    return DS.cap(inst, CAP).select("table_id", "query_no")


def _d_flatten_text():
    line = (
        "'row ' || CAST(r.row_idx + 1 AS VARCHAR) || ' : ' || array_to_string(list_transform(range(0, m.n_cols), "
        "lambda j: m.header[j + 1] || ' is ' || coalesce(lower(r.cells[j + 1]), '') || '. '), '') || chr(10)"
    )
    return (
        "ftab AS (SELECT m.table_id, 'The table have ' || CAST(m.n_cols AS VARCHAR) || ' columns: ' || array_to_string(m.header, ' | ') || chr(10) || "
        f"string_agg({line}, '' ORDER BY r.row_idx) AS text FROM crows r JOIN ctables m USING (table_id) GROUP BY m.table_id, m.n_cols, m.header)"
    )


@query(
    "inst_ft_pairs",
    _duck(
        DB.ORDERS_BY_CUSTOMER, OBC,
        f", {_d_flatten_text()}\nSELECT k.table_id, k.query_no, t.text || chr(10) || 'Execute this SQL based on the above table: ' || k.sql AS input, "
        "k.answer AS output FROM kept k JOIN ftab t USING (table_id)",
    ),
)
def inst_ft_pairs(spark, sf_dir):
    """Fine-tuning pairs over the customer tables, table as flatten text."""
    kept, c = kept_queries(spark, sf_dir, "customer")
    text = M.joined(M.render(c.rows, c.tables, "flatten"), "flatten")
    return DS.ft_pairs(kept, text).select("table_id", "query_no", "input", "output")


@query(
    "snk_jsonl",
    _duck(
        DB.LINEITEM_BY_SUPPLIER, PC.SP,
        f"SELECT table_id, query_no, CAST(rn AS INTEGER) AS rn, {D_EX_SQL} AS ex_sql, examples[1].answer AS answer FROM inst",
    ),
)
def snk_jsonl(spark, sf_dir):
    """Instances written as JSON lines in seeded order, read back whole."""
    inst, _ = _instances(spark, sf_dir)
    path = DS.scratch_path(spark, "instances")
    DS.write_jsonl(DS.shuffled(inst, SEED, "table_id", "query_no"), path)
    back = DS.read_jsonl(
        spark, path, "table_id BIGINT, query_no INT, rn INT, examples ARRAY<STRUCT<sql: STRING, answer: STRING>>"
    )
    return back.select("table_id", "query_no", "rn", _ex_sql().alias("ex_sql"), F.element_at("examples", 1)["answer"].alias("answer"))


@query(
    "src_jsonl",
    _duck(
        DB.LINEITEM_BY_SUPPLIER, PC.SP,
        "SELECT table_id, query_no, CAST(rn AS INTEGER) AS rn FROM inst ORDER BY table_id, query_no LIMIT 100",
    ),
)
def src_jsonl(spark, sf_dir):
    """Read instances back with a test-number cut: the first 100 by key (A4)."""
    inst, _ = _instances(spark, sf_dir)
    path = DS.scratch_path(spark, "instances")
    DS.write_jsonl(inst, path)
    back = DS.read_jsonl(spark, path, "table_id BIGINT, query_no INT, rn INT", first_n=100, order=["table_id", "query_no"])
    return back.select("table_id", "query_no", "rn")


@query(
    "snk_text_pairs",
    _duck(
        DB.LINEITEM_BY_SUPPLIER, PC.SP,
        "SELECT 'sql' AS kind, examples[1].sql AS value FROM inst UNION ALL SELECT 'answer' AS kind, examples[1].answer AS value FROM inst",
    ),
)
def snk_text_pairs(spark, sf_dir):
    """Target SQL and answers exported as two text outputs, read back."""
    inst, _ = _instances(spark, sf_dir)
    t = inst.select("table_id", "query_no", F.element_at("examples", 1)["sql"].alias("sql"), F.element_at("examples", 1)["answer"].alias("answer"))
    a, b = DS.write_text_pairs(t, DS.scratch_path(spark, "pairs"), ["table_id", "query_no"])
    return spark.read.text(a).select(F.lit("sql").alias("kind"), "value").unionByName(
        spark.read.text(b).select(F.lit("answer").alias("kind"), "value")
    )


# ------------------------------------------------------------------ prompts

_HA, _HB, _HC = P.header("sql", N_SHOT)


def _d_lit(s):
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


D_BLOCK = (
    f"array_to_string(list_transform(examples[2:{N_SHOT + 1}], lambda e: 'SQL:' || e.sql || chr(10) || 'Answer:' || coalesce(e.answer, 'None') || chr(10)), '') "
    "|| 'SQL:' || examples[1].sql"
)


@query(
    "prm_header",
    "SELECT task, n_shot, " + "CASE " + " ".join(
        f"WHEN task = '{t}' AND n_shot {'<>' if s else '='} 0 THEN {_d_lit(h)}" for (t, s), h in P.HEADERS.items()
    ) + " END AS header FROM (SELECT CASE WHEN turn % 3 = 0 THEN 'qa' WHEN turn % 3 = 1 THEN 'sql' ELSE 'cot' END AS task, "
    "CAST(turn % 2 AS INTEGER) * 5 AS n_shot, conv_id FROM conversations)",
)
def prm_header(spark, sf_dir):
    """Prompt header by task and shot mode, chosen per conversation turn."""
    cv = Tables(spark, sf_dir).conversations
    x = cv.select(
        F.when(F.col("turn") % 3 == 0, "qa").when(F.col("turn") % 3 == 1, "sql").otherwise("cot").alias("task"),
        ((F.col("turn") % 2).cast("int") * 5).alias("n_shot"),
    )
    e = None
    for (t, s), h in P.HEADERS.items():
        cond = (F.col("task") == t) & ((F.col("n_shot") != 0) if s else (F.col("n_shot") == 0))
        e = F.when(cond, F.lit(h)) if e is None else e.when(cond, F.lit(h))
    return x.select("task", "n_shot", e.alias("header"))


@query(
    "prm_few_shot",
    _duck(DB.LINEITEM_BY_SUPPLIER, PC.SP, f"SELECT table_id, query_no, {D_BLOCK} AS block FROM inst"),
)
def prm_few_shot(spark, sf_dir):
    """Few-shot block: five 'SQL:/Answer:' shots then the target SQL."""
    inst, _ = _instances(spark, sf_dir)
    return inst.select("table_id", "query_no", P.few_shot_block(F.col("examples"), N_SHOT).alias("block"))


@query(
    "prm_full",
    _duck(
        DB.ORDERS_BY_CUSTOMER, OBC,
        f", {_d_flatten_text()}\nSELECT i.table_id, i.query_no, {_d_lit(_HA)} || t.text || {_d_lit(_HB)} || {D_BLOCK.replace('examples', 'i.examples')} || {_d_lit(_HC)} AS prompt "
        "FROM inst i JOIN ftab t USING (table_id)",
    ),
)
def prm_full(spark, sf_dir):
    """Full 5-shot SQL-execution prompts over the customer tables (flatten table text)."""
    inst, c = _examples(spark, sf_dir, "sql")
    inst = pin(inst, "instances")
    some = inst.select("table_id").distinct()  # the others' texts are not read
    rows, tables = (x.join(some, "table_id", "left_semi") for x in (c.rows, c.tables))
    text = M.joined(M.render(rows, tables, "flatten"), "flatten")
    j = inst.join(text.select("table_id", "text"), "table_id")
    return j.select("table_id", "query_no", P.full_prompt(F.col("text"), P.few_shot_block(F.col("examples"), N_SHOT), "sql", N_SHOT).alias("prompt"))


def _d_block(ask: str, asked: str, before: str, answered: str, after: str, ends: bool) -> str:
    """A table's shots and each target's block, as text, from ``rk`` with the fields joined."""
    lit = _d_lit
    return f"""shot AS (SELECT table_id, string_agg({lit(ask)} || {asked} || {lit(before)} || {answered} || {lit(after)}, '' ORDER BY query_no) AS t, count(*) AS n
              FROM full_rk WHERE rn <= {N_SHOT} GROUP BY table_id)
       SELECT f.table_id, f.query_no, s.t || {lit(ask)} || f.{asked} || {lit(before if ends else '')} AS block
       FROM full_rk f JOIN shot s USING (table_id) WHERE f.rn > {N_SHOT} AND s.n = {N_SHOT}"""


def _d_ins() -> str:
    full = "full_rk AS (SELECT rk.*, s.multistep FROM rk JOIN specs s USING (table_id, query_no))"
    return f", {D_KEPT}, {full}, " + _d_block("Instruction:", "multistep", "\nAnswer:", "answer", "\n", True)


def _d_cot(select: str) -> str:
    from tabqa.plans.duck_traces import traces_sql

    kept = DB.exec_sql(DB.ORDERS_BY_CUSTOMER, OBC, f", {D_KEPT} SELECT table_id, query_no, sql, answer, rn FROM rk")
    full = f"full_rk AS (SELECT k.*, t.cot AS sql_cot FROM ({kept}) k JOIN ({traces_sql(OBC)}) t USING (table_id, query_no))"
    block = _d_block("SQL:", "sql", "\nExecution process:\n", "sql_cot", "\n\n", True)
    return f"WITH {full}, {block}" if not select else f"WITH {full}, blocks AS (WITH {block}), {select}"


def _examples(spark, sf_dir, task: str):
    """Few-shot instances over the customer tables with the fields of a task."""
    c = shared.corpus(spark, sf_dir, "customer")
    kept = shared.kept_of_tables(spark, sf_dir, "customer", OBC, N_SHOT + 1)
    fields = {"sql": ("sql", "answer"), "ins": ("multistep", "answer"), "cot": ("sql", "answer", "sql_cot")}[task]
    inst = DS.dedup_first(kept)
    if task == "cot":
        from tabqa.operators import traces as TR

        inst = pin(inst, "kept")  # read by every step of the trace
        cot = TR.cot(c.rows, inst.drop("answer")).select("table_id", "query_no", F.col("cot").alias("sql_cot"))
        inst = pin(inst.join(cot, ["table_id", "query_no"]), "kept-cot")
    return DS.few_shot(inst.select("table_id", "query_no", *fields), N_SHOT, fields), c


@query("prm_few_shot_ins", DB.exec_sql(DB.ORDERS_BY_CUSTOMER, OBC, _d_ins()))
def prm_few_shot_ins(spark, sf_dir):
    """Few-shot block of the instruction task, target ending where its answer begins."""
    inst, _ = _examples(spark, sf_dir, "ins")
    return inst.select("table_id", "query_no", P.few_shot_block(F.col("examples"), N_SHOT, "ins", answer_prompt=True).alias("block"))


@query("prm_few_shot_cot", _d_cot(""))
def prm_few_shot_cot(spark, sf_dir):
    """Few-shot block of the execution-process task."""
    inst, _ = _examples(spark, sf_dir, "cot")
    return inst.select("table_id", "query_no", P.few_shot_block(F.col("examples"), N_SHOT, "cot").alias("block"))


BUDGET = 120


def _d_truncate():
    words = "list_filter(regexp_split_to_array(text, '" + __import__("tabqa.functions.text", fromlist=["x"]).WS_CLASS + "+'), lambda w: w <> '')"
    return f"""w AS (SELECT table_id, text, {words} AS ws FROM ftab),
    tokw AS (SELECT table_id, p, sum(len(regexp_extract_all(ws[p], '\\w+|[^\\w\\s]'))) OVER (PARTITION BY table_id ORDER BY p) AS cum
             FROM (SELECT table_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
    best AS (SELECT table_id, max(CASE WHEN p <= {BUDGET} AND ({BUDGET} - p) % 500 = 0 AND cum <= {BUDGET} THEN p END) AS k,
                    max(cum) AS total FROM tokw GROUP BY table_id)"""


@query(
    "prm_truncate",
    DB.exec_sql(
        DB.ORDERS_BY_CUSTOMER, OBC,
        f", {_d_flatten_text()}, {_d_truncate()}\nSELECT w.table_id, CASE WHEN coalesce(b.total, 0) <= {BUDGET} THEN w.text "
        "ELSE array_to_string(w.ws[1:coalesce(b.k, 0)], ' ') END AS text FROM w LEFT JOIN best b USING (table_id)",
    ),
)
def prm_truncate(spark, sf_dir):
    """Table texts cut to a 120-token budget on the reference's word grid."""
    c = C.orders_by_customer(Tables(spark, sf_dir).orders)
    return P.truncate_parts(M.render(c.rows, c.tables, "flatten"), ["table_id"], "text", BUDGET)


# ------------------------------------------------------------------ E7, I9-I11, I18


def sub_accept_expr(answers_n: str = "n_ans_rows") -> "F.Column":
    """A level-1 answer can feed a sub-query when it is non-empty, not every row,
    its first value is not NULL, and its arity fits the link: a scalar link needs one
    row or an aggregate; a text membership link needs a plain text select."""
    n = F.col(answers_n)
    base = (n > 0) & (n != F.col("n_rows")) & F.col("answer").isNotNull() & (F.col("answer") != "None")
    scalar_ok = (F.col("s_kind") == "agg") | ((F.col("s_kind") != "agg") & (n == 1))
    s1 = F.element_at("s_cols", 1)
    is_text = ~F.array_contains("ic", s1)
    member_ok = (is_text & (F.col("s_kind") != "agg")) | (~is_text & (n == 1))
    return base, scalar_ok, member_ok


@query(
    "sub_accept",
    DB.exec_sql(
        DB.LINEITEM_BY_SUPPLIER, PC.SP,
        """SELECT s.table_id, s.query_no,
              CAST(a.n_ans_rows > 0 AND a.n_ans_rows <> s.n_rows AND a.answer IS NOT NULL AND a.answer <> 'None'
                   AND (s.s_kind = 'agg' OR a.n_ans_rows = 1) AS INTEGER) AS ok_scalar,
              CAST(a.n_ans_rows > 0 AND a.n_ans_rows <> s.n_rows AND a.answer IS NOT NULL AND a.answer <> 'None'
                   AND ((NOT list_contains(s.ic, s.s_cols[1]) AND s.s_kind <> 'agg') OR (list_contains(s.ic, s.s_cols[1]) AND a.n_ans_rows = 1))
                   AS INTEGER) AS ok_member
       FROM specs s JOIN answers a USING (table_id, query_no)""",
    ),
)
def sub_accept(spark, sf_dir):
    """Which answered specs may serve as a scalar or a membership sub-query."""
    specs = shared.specs(spark, sf_dir, "supplier", PC.SP)
    ans = shared.executed(spark, sf_dir, "supplier", PC.SP).answers.drop("n_rows", "sql")
    ans = ans.withColumn("answer", F.when(F.col("n_ans_rows") <= 1, F.col("first_value")).otherwise(F.lit("")))
    j = specs.join(ans, ["table_id", "query_no"])
    base, scalar_ok, member_ok = sub_accept_expr()
    return j.select(
        "table_id", "query_no",
        F.coalesce(base & scalar_ok, F.lit(False)).cast("int").alias("ok_scalar"),
        F.coalesce(base & member_ok, F.lit(False)).cast("int").alias("ok_member"),
    )


TARGET_PER_TABLE = 5


@query(
    "inst_acceptance_rate",
    _duck(
        DB.LINEITEM_BY_SUPPLIER, PC.SP,
        f""", rate AS (SELECT (SELECT count(*) FROM kept) / (SELECT count(*) FROM specs) AS r)
        SELECT round(r, 6) AS acceptance,
               CAST(CASE WHEN r = 0 THEN NULL ELSE pow(5, greatest(1, ceil(ln(ceil({TARGET_PER_TABLE} / ({PC.SP.per_table} * r) * 1.2)) / ln(5)))) END AS BIGINT) AS multiple
        FROM rate""",
    ),
)
def inst_acceptance_rate(spark, sf_dir):
    """Acceptance rate of drawn queries and the oversampling multiple it implies.

    The reference multiplies draws by 5 until enough queries survive; here the
    rate is measured once (one aggregate) and the multiple is the smallest power
    of 5 (at least 5) covering the target with a 20 % margin.
    """
    kept, c = kept_queries(spark, sf_dir, texts=False)
    total = c.tables.select((F.count(F.lit(1)) * PC.SP.per_table).alias("n_specs"))
    k = kept.agg(F.count(F.lit(1)).alias("n_kept"))
    r = (F.col("n_kept") / F.col("n_specs"))
    need = F.ceil(F.lit(TARGET_PER_TABLE) / (F.lit(PC.SP.per_table) * r) * 1.2)
    mult = F.pow(F.lit(5), F.greatest(F.lit(1), F.ceil(F.log(need) / F.log(F.lit(5.0)))))
    return k.crossJoin(total).select(
        F.round(r, 6).alias("acceptance"), F.when(r == 0, F.lit(None)).otherwise(mult).cast("bigint").alias("multiple")
    )


REACH = S.SpecParams(seed=51)
REACH_ROUNDS = 2
_REACH_FIRST, _REACH_ALL = TARGET_PER_TABLE * 5, TARGET_PER_TABLE * (5 + 25)


@query(
    "inst_reach",
    _duck(
        DB.LINEITEM_BY_SUPPLIER, replace(REACH, per_table=_REACH_ALL),
        f""", have AS (SELECT t.table_id, count(d.sql) FILTER (d.query_no < {_REACH_FIRST}) AS n1, count(d.sql) AS n2
                       FROM ctables t LEFT JOIN dd d ON d.table_id = t.table_id GROUP BY t.table_id)
        SELECT h.table_id, CAST(CASE WHEN n1 >= {TARGET_PER_TABLE} THEN {_REACH_FIRST} ELSE {_REACH_ALL} END AS BIGINT) AS n_drawn,
               CAST(least(n2, {TARGET_PER_TABLE}) AS BIGINT) AS n_kept, CAST(n2 >= {TARGET_PER_TABLE} AS INTEGER) AS reached, r.query_no, r.sql, r.answer
        FROM have h LEFT JOIN (SELECT * FROM rk WHERE rn <= {TARGET_PER_TABLE}) r ON r.table_id = h.table_id""",
    ),
)
def inst_reach(spark, sf_dir):
    """Queries drawn in rounds until every table has five that the rules let through, or is reported."""
    from tabqa.operators import quota as Q

    got = Q.queries_per_table(shared.corpus(spark, sf_dir, "supplier"), REACH, TARGET_PER_TABLE, rounds=REACH_ROUNDS)
    report = got.report.withColumn("reached", F.col("reached").cast("int"))
    return report.join(got.kept, "table_id", "left").select("table_id", "n_drawn", "n_kept", "reached", "query_no", "sql", "answer")


@query(
    "inst_fields",
    DB.exec_sql(
        DB.LINEITEM_BY_SUPPLIER, PC.SP,
        """SELECT s.table_id, s.query_no, s.sql, a.answer, s.multistep,
              array_to_string(list_transform(s.s_cols, lambda c: s.header[c + 1]), ',') AS select_cols,
              CASE WHEN s.g_col IS NULL THEN '' ELSE s.header[s.g_col + 1] END AS group_col,
              CAST(a.n_selected AS BIGINT) AS n_select_rows
       FROM specs s JOIN answers a USING (table_id, query_no)""",
    ),
)
def inst_fields(spark, sf_dir):
    """Output fields of an instance example: sql, answer, multistep, process columns."""
    specs = shared.specs(spark, sf_dir, "supplier", PC.SP)
    ex = shared.executed(spark, sf_dir, "supplier", PC.SP)
    j = specs.join(ex.answers.drop("n_rows", "sql"), ["table_id", "query_no"]).join(ex.whole(), ["table_id", "query_no"])
    return j.select(
        "table_id", "query_no", "sql", "answer", "multistep",
        F.array_join(F.transform("s_cols", lambda x: F.element_at("header", x + 1)), ",").alias("select_cols"),
        F.when(F.col("g_col").isNull(), F.lit("")).otherwise(F.element_at("header", F.col("g_col") + 1)).alias("group_col"),
        F.col("n_selected").cast("bigint").alias("n_select_rows"),
    )


# Number of fine and coarse templates shipped with the reference.
N_FINE_TEMPLATES = 15  # 4 easy + 11 where-condition lines; the long-context line is not drawn by proportion
N_COARSE_TEMPLATES = 13  # 8 single, 4 double, 1 triple


@query(
    "inst_mix",
    f"""SELECT c_custkey AS table_id,
              CASE WHEN {__import__('tabqa.plans.duck', fromlist=['x']).unit(__import__('tabqa.plans.duck', fromlist=['x']).key(SEED, 'c_custkey', "'mix'"))} < {N_FINE_TEMPLATES / (N_FINE_TEMPLATES + N_COARSE_TEMPLATES)!r}
                   THEN 'fine' ELSE 'coarse' END AS kind
       FROM customer""",
)
def inst_mix(spark, sf_dir):
    """Fine or coarse generation per table in proportion to template counts."""
    from tabqa.functions.hashing import key, weighted_choice

    cu = Tables(spark, sf_dir).customer
    return cu.select(
        F.col("c_custkey").alias("table_id"),
        weighted_choice(key(SEED, F.col("c_custkey"), "mix"), ["fine", "coarse"], [N_FINE_TEMPLATES, N_COARSE_TEMPLATES]).alias("kind"),
    )


@query(
    "inst_pick_table",
    f"""WITH t AS (SELECT l_suppkey AS table_id, row_number() OVER (ORDER BY l_suppkey) - 1 AS ti FROM (SELECT DISTINCT l_suppkey FROM lineitem)),
            nt AS (SELECT count(*) AS n FROM t),
            b AS (SELECT o_orderkey AS batch_id FROM orders)
       SELECT b.batch_id, t.table_id
       FROM b CROSS JOIN nt JOIN t ON t.ti = {__import__('tabqa.plans.duck', fromlist=['x']).h(__import__('tabqa.plans.duck', fromlist=['x']).key(SEED, 'b.batch_id', "'pick'"))} % nt.n""",
)
def inst_pick_table(spark, sf_dir):
    """For each generation batch (one per order row), a table drawn from the supplier corpus.

    Tables are numbered densely (skew-safe row index) and the draw is an
    equi-join on that number; nothing passes through the driver but the count.
    """
    from tabqa.functions.hashing import hk
    from tabqa.functions.indexing import row_index

    t = Tables(spark, sf_dir)
    ids = row_index(t.lineitem.select(F.col("l_suppkey").alias("table_id")).distinct(), [], ["table_id"], out="ti")
    n = ids.count()
    b = t.orders.select(F.col("o_orderkey").alias("batch_id"))
    b = b.select("batch_id", F.pmod(hk(SEED, F.col("batch_id"), "pick"), F.lit(n)).cast("int").alias("ti"))
    return b.join(F.broadcast(ids) if n <= 1_000_000 else ids, "ti").select("batch_id", "table_id")
