"""Sources, corpora and synthetic generation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabqa.functions.hashing import key
from tabqa.functions.tokens import count_tokens
from tabqa.operators import generate as G
from tabqa.operators import render as M
from tabqa.plans import duck as D
from tabqa.plans.registry import query
from tabqa.session import pin
from tabqa.sources import corpus as C
from tabqa.sources.tables import Tables, infer_types, role_profile

SEED = 42
# Shape used by the generation queries: one synthetic table per customer row.
GEN = G.Shape(col_min=3, col_max=9, row_min=5, row_max=25, seed=SEED)


def _join(arr):
    return F.array_join(arr, "|")


# ------------------------------------------------------------------ A: sources

_LI_COLS = [
    ("l_orderkey", "num"), ("l_partkey", "num"), ("l_suppkey", "num"), ("l_linenumber", "num"),
    ("l_quantity", "real"), ("l_extendedprice", "real"), ("l_discount", "real"), ("l_tax", "real"),
    ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "text"),
]


@query(
    "src_roles",
    " UNION ALL ".join(
        f"SELECT '{c}' AS col_name, {i} AS col_idx, '{r}' AS role, CAST(count({c}) AS BIGINT) AS n_values, "
        f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM lineitem"
        for i, (c, r) in enumerate(_LI_COLS)
    ),
)
def src_roles(spark, sf_dir):
    """Role profile of a table: role from the schema, value and distinct counts (A1)."""
    return role_profile(Tables(spark, sf_dir).lineitem)


_CU_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _duck_infer(c, i):
    v = f"trim(CAST({c} AS VARCHAR))"
    return (
        f"SELECT '{c}' AS col_name, {i} AS col_idx, CASE "
        f"WHEN coalesce(bool_and(CASE WHEN {c} IS NOT NULL THEN regexp_full_match({v}, '[+-]?[0-9]+') END), false) THEN 'INTEGER' "
        f"WHEN coalesce(bool_and(CASE WHEN {c} IS NOT NULL THEN try_cast({v} AS DOUBLE) IS NOT NULL END), false) THEN 'REAL' "
        f"ELSE 'TEXT' END AS col_type FROM customer"
    )


@query("src_infer_types", " UNION ALL ".join(_duck_infer(c, i) for i, c in enumerate(_CU_COLS)))
def src_infer_types(spark, sf_dir):
    """Type inference as one aggregate over text-cast columns (A2)."""
    return infer_types(Tables(spark, sf_dir).customer.select(*_CU_COLS))


@query(
    "src_corpus",
    """SELECT o_custkey AS table_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS row_idx,
              concat_ws('|', o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d'),
                        CAST(o_orderkey AS VARCHAR), CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR)) AS cells,
              CAST(o_orderkey + CAST(trunc(o_totalprice) AS BIGINT) AS BIGINT) AS num_sum
       FROM orders""",
)
def src_corpus(spark, sf_dir):
    """Orders split into one table per customer (A3)."""
    c = C.orders_by_customer(Tables(spark, sf_dir).orders)
    return c.rows.select(
        "table_id", "row_idx", _join("cells").alias("cells"),
        F.aggregate("nums", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("num_sum"),
    )


@query(
    "src_corpus_tables",
    """SELECT l_suppkey AS table_id, count(*) AS n_rows, 5 AS n_cols,
              'l_returnflag|l_linestatus|l_shipdate|l_linenumber|l_quantity' AS header,
              'TEXT|TEXT|DATE|INT|INT' AS types
       FROM lineitem GROUP BY l_suppkey""",
)
def src_corpus_tables(spark, sf_dir):
    """Table metadata of the lineitem-by-supplier corpus (A3)."""
    c = C.lineitem_by_supplier(Tables(spark, sf_dir).lineitem)
    return c.tables.select("table_id", "n_rows", "n_cols", _join("header").alias("header"), _join("types").alias("types"))


@query(
    "src_corpus_supplier",
    """SELECT l_suppkey AS table_id,
              CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber,
                   l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS BIGINT) AS row_idx,
              concat_ws('|', l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'), CAST(l_linenumber AS VARCHAR),
                        CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR)) AS cells
       FROM lineitem""",
)
def src_corpus_supplier(spark, sf_dir):
    """Lineitem split by supplier; the row order uses every column since the pair key repeats (A3)."""
    c = C.lineitem_by_supplier(Tables(spark, sf_dir).lineitem)
    return c.rows.select("table_id", "row_idx", _join("cells").alias("cells"))


# ------------------------------------------------------------------ B: generation

_SHP_SQL = f"""shp AS (
  SELECT c_custkey AS table_id,
         CAST({D.uniform(D.key(SEED, 'c_custkey', "'ncols'"), GEN.col_min, GEN.col_max)} AS INTEGER) AS n_cols,
         CAST({D.uniform(D.key(SEED, 'c_custkey', "'nrows'"), GEN.row_min, GEN.row_max)} AS BIGINT) AS n_rows
  FROM customer)"""


def _shapes(spark, sf_dir, shape=GEN):
    return G.shapes(Tables(spark, sf_dir).customer, "c_custkey", shape)


@query("gen_shapes", f"WITH {_SHP_SQL} SELECT table_id, n_cols, n_rows FROM shp")
def gen_shapes(spark, sf_dir):
    """Column and row counts drawn per table (B1)."""
    return _shapes(spark, sf_dir)


_KW_SQL = ", ".join(D.lit(w) for w in G.SQL_KEYWORDS)
_VOCAB_SQL = f"""words AS (
  SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents)
  WHERE length(w) BETWEEN 3 AND 8),
vocab AS (
  SELECT word, row_number() OVER (ORDER BY {D.h(D.key(SEED, "'vocab'", 'word'))}, word) - 1 AS widx
  FROM words WHERE word NOT IN ({_KW_SQL})),
nv AS (SELECT count(*) AS n FROM vocab)"""


def _vocab(spark, sf_dir):
    return G.vocabulary(Tables(spark, sf_dir).documents, "text", SEED)


@query(
    "gen_headers",
    f"""WITH {_SHP_SQL}, {_VOCAB_SQL},
    cols AS (SELECT table_id, unnest(range(0, n_cols)) AS j FROM shp),
    named AS (SELECT c.table_id, c.j, v.word FROM cols c CROSS JOIN nv
              JOIN vocab v ON v.widx = ({D.h(D.key(SEED, 'c.table_id', "'header'"))} + c.j) % nv.n)
    SELECT table_id, string_agg(word, '|' ORDER BY j) AS header FROM named GROUP BY table_id""",
)
def gen_headers(spark, sf_dir):
    """Unique column names per table from a vocabulary mined from ``documents`` (B2)."""
    hdr = G.headers(_shapes(spark, sf_dir), _vocab(spark, sf_dir), SEED)
    return hdr.select("table_id", _join("header").alias("header"))


def _duck_types(shape=GEN, tid="table_id", ncols="n_cols"):
    draw = D.weighted(D.key(shape.seed, tid, "'type'", "a", "j"), ["TEXT", "INT", "DATE"], shape.type_weights)
    attempts = f"list_transform(range(0, {shape.type_attempts}), lambda a: list_transform(range(0, {ncols}), lambda j: {draw}))"
    fallback = f"list_transform(range(0, {ncols}), lambda j: CASE WHEN j = 0 THEN 'TEXT' WHEN j = 1 THEN 'INT' ELSE 'TEXT' END)"
    valid = f"list_filter({attempts}, lambda t: list_contains(t, 'TEXT') AND list_contains(t, 'INT'))"
    return f"coalesce({valid}[1], {fallback})"


def _duck_pools(shape=GEN, tid="table_id", ncols="n_cols"):
    return f"list_transform(range(0, {ncols}), lambda j: {D.weighted(D.key(shape.seed, tid, 'j', chr(39) + 'mode' + chr(39)), G.POOL_SIZES, shape.repeat_weights)})"


@query("gen_types", f"WITH {_SHP_SQL} SELECT table_id, array_to_string({_duck_types()}, '|') AS types FROM shp")
def gen_types(spark, sf_dir):
    """Column types by weight with at least one TEXT and one INT."""
    return G.types(_shapes(spark, sf_dir), GEN).select("table_id", _join("types").alias("types"))


@query(
    "gen_cells_int",
    f"""SELECT o_orderkey, CAST({D.uniform(D.key(SEED, 'o_orderkey', "'int'"), 2, 327)} AS BIGINT) AS v_int,
              CAST({D.uniform(D.key(SEED, 'o_orderkey', "'big'"), 2, 1000)} AS BIGINT) AS v_big FROM orders""",
)
def gen_cells_int(spark, sf_dir):
    """Integer cells 2..327 and big integers 2..1000."""
    o = Tables(spark, sf_dir).orders
    return o.select(
        "o_orderkey",
        G.int_cell(key(SEED, F.col("o_orderkey"), "int")).alias("v_int"),
        G.int_cell(key(SEED, F.col("o_orderkey"), "big"), big=True).alias("v_big"),
    )


@query("gen_cells_real", f"SELECT o_orderkey, {D.real_cell(D.key(SEED, 'o_orderkey', chr(39) + 'real' + chr(39)))} AS v_real FROM orders")
def gen_cells_real(spark, sf_dir):
    """Real cells 1.10..20.00 as 2-decimal text."""
    o = Tables(spark, sf_dir).orders
    return o.select("o_orderkey", G.real_cell(key(SEED, F.col("o_orderkey"), "real")).alias("v_real"))


@query("gen_cells_date", f"SELECT o_orderkey, {D.date_cell(D.key(SEED, 'o_orderkey', chr(39) + 'date' + chr(39)))} AS v_date FROM orders")
def gen_cells_date(spark, sf_dir):
    """Date cells in [2001-02-13, 2023-08-31)."""
    o = Tables(spark, sf_dir).orders
    return o.select("o_orderkey", G.date_cell(key(SEED, F.col("o_orderkey"), "date")).alias("v_date"))


_AGE = D.uniform(D.key(SEED, "c_custkey", "'age'"), 18, 77)


@query(
    "gen_cells_dob",
    f"""SELECT c_custkey, CAST({_AGE} AS BIGINT) AS age,
              strftime(DATE '2024-01-01' - CAST(365 * ({_AGE} + 1) - {D.h(D.key(SEED, 'c_custkey', "'dob'"))} % 365 AS INTEGER), '%Y-%m-%d') AS dob
       FROM customer""",
)
def gen_cells_dob(spark, sf_dir):
    """Date of birth for a drawn age on a fixed reference date."""
    c = Tables(spark, sf_dir).customer
    age = G.uniform_int(key(SEED, F.col("c_custkey"), "age"), 18, 77)
    return c.select(
        "c_custkey", age.alias("age"), G.dob_cell(key(SEED, F.col("c_custkey"), "dob"), age, "2024-01-01").alias("dob")
    )


@query("gen_cells_text", f"SELECT o_orderkey, {D.word(D.key(SEED, 'o_orderkey', chr(39) + 'text' + chr(39)))} AS v_text FROM orders")
def gen_cells_text(spark, sf_dir):
    """Text cells of 4-9 lowercase letters."""
    o = Tables(spark, sf_dir).orders
    return o.select("o_orderkey", G.word(key(SEED, F.col("o_orderkey"), "text")).alias("v_text"))


_POOL = D.weighted(D.key(SEED, "o_custkey", 0, "'mode'"), G.POOL_SIZES, GEN.repeat_weights)


@query(
    "gen_cells_pool",
    f"""WITH p AS (SELECT o_custkey, o_orderkey, {_POOL} AS pool FROM orders)
       SELECT o_custkey, o_orderkey, pool,
              CASE WHEN pool > 0
                   THEN {D.word(D.key(SEED, 'o_custkey', 0, "'pool'", D.h(D.key(SEED, 'o_custkey', 0, 'o_orderkey', "'slot'")) + ' % greatest(pool, 1)'))}
                   ELSE {D.word(D.key(SEED, 'o_custkey', 0, 'o_orderkey', "'cell'"))} END AS cell
       FROM p""",
)
def gen_cells_pool(spark, sf_dir):
    """Cardinality-controlled text column: one per customer table, a row per order."""
    o = Tables(spark, sf_dir).orders
    tid, col = F.col("o_custkey"), F.lit(0)
    pool = G.pool_mode(SEED, tid, col, GEN)
    return o.select("o_custkey", "o_orderkey", pool.alias("pool")).select(
        "o_custkey", "o_orderkey", "pool", G.text_cell(SEED, tid, col, F.col("o_orderkey"), F.col("pool")).alias("cell")
    )


def _duck_fill(shape=GEN):
    int_c = f"CAST({D.uniform(D.key(shape.seed, 'table_id', 'j', 'row_idx', chr(39) + 'int' + chr(39)), 2, 327)} AS VARCHAR)"
    date_c = D.date_cell(D.key(shape.seed, "table_id", "j", "row_idx", "'date'"))
    slot = D.h(D.key(shape.seed, "table_id", "j", "row_idx", "'slot'")) + " % greatest(pools[j + 1], 1)"
    pool_c = D.word(D.key(shape.seed, "table_id", "j", "'pool'", slot))
    rand_c = D.word(D.key(shape.seed, "table_id", "j", "row_idx", "'cell'"))
    cell = (
        f"CASE WHEN types[j + 1] = 'INT' THEN {int_c} WHEN types[j + 1] = 'DATE' THEN {date_c} "
        f"WHEN pools[j + 1] > 0 THEN {pool_c} ELSE {rand_c} END"
    )
    return f"""{_SHP_SQL},
    meta AS (SELECT table_id, n_cols, n_rows, {_duck_types(shape)} AS types, {_duck_pools(shape)} AS pools FROM shp),
    r AS (SELECT table_id, n_cols, types, pools, unnest(range(0, n_rows)) AS row_idx FROM meta),
    cells AS (SELECT table_id, CAST(row_idx AS BIGINT) AS row_idx, list_transform(range(0, n_cols), lambda j: {cell}) AS cells, types FROM r)"""


@query(
    "gen_rows",
    f"""WITH {_duck_fill()}
    SELECT table_id, row_idx, array_to_string(cells, '|') AS cells,
           CAST(list_sum(list_transform(range(0, len(cells)), lambda j: CASE WHEN types[j + 1] = 'INT' THEN CAST(cells[j + 1] AS BIGINT) ELSE 0 END)) AS BIGINT) AS num_sum
    FROM cells""",
)
def gen_rows(spark, sf_dir):
    """Whole synthetic tables, one per customer row."""
    meta = G.table_meta(Tables(spark, sf_dir).customer, "c_custkey", GEN, None)  # rows need no header
    rows = G.fill(meta, GEN)
    return rows.select(
        "table_id", "row_idx", _join("cells").alias("cells"),
        F.aggregate("nums", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("num_sum"),
    )


def _duck_preset(name, shape):
    nc = D.uniform(D.key(shape.seed, "c_custkey", "'ncols'"), shape.col_min, shape.col_max)
    nr = D.uniform(D.key(shape.seed, "c_custkey", "'nrows'"), shape.row_min, shape.row_max)
    return (
        f"SELECT '{name}' AS preset, count(*) AS n_tables, CAST(sum({nr}) AS BIGINT) AS n_rows, "
        f"CAST(sum(({nr}) * ({nc})) AS BIGINT) AS n_cells FROM customer"
    )


@query("gen_presets", " UNION ALL ".join(_duck_preset(n, s) for n, s in G.PRESETS.items()))
def gen_presets(spark, sf_dir):
    """Table, row and cell counts per preset when one table is drawn per customer."""
    out = None
    for name, shape in G.PRESETS.items():
        s = _shapes(spark, sf_dir, shape).agg(
            F.lit(name).alias("preset"),
            F.count(F.lit(1)).alias("n_tables"),
            F.sum("n_rows").cast("bigint").alias("n_rows"),
            F.sum(F.col("n_rows") * F.col("n_cols")).cast("bigint").alias("n_cells"),
        )
        out = s if out is None else out.unionByName(s)
    return out


_OBC_HEADER = ["o_orderstatus", "o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice"]
_OBC_LINE = (
    "'row ' || CAST(rn + 1 AS VARCHAR) || ' : ' || "
    "'o_orderstatus is ' || lower(o_orderstatus) || '. ' || 'o_orderpriority is ' || lower(o_orderpriority) || '. ' || "
    "'o_orderdate is ' || strftime(o_orderdate, '%Y-%m-%d') || '. ' || 'o_orderkey is ' || CAST(o_orderkey AS VARCHAR) || '. ' || "
    "'o_totalprice is ' || CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) || '. ' || chr(10)"
)
_OBC_HEAD = "'The table have 5 columns: " + " | ".join(_OBC_HEADER) + "' || chr(10)"
_TOK = "len(regexp_extract_all({}, '\\w+|[^\\w\\s]'))"
_OBC_ROWS = f"""obc AS (
  SELECT o_custkey AS table_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rn, *
  FROM orders),
lines AS (SELECT table_id, rn, {_TOK.format(_OBC_LINE)} AS t FROM obc),
head AS (SELECT {_TOK.format(_OBC_HEAD)} AS ht)"""


def _obc(spark, sf_dir):
    return C.orders_by_customer(Tables(spark, sf_dir).orders)


@query(
    "feat_table_tokens",
    f"""WITH {_OBC_ROWS}
    SELECT table_id, CAST(max(ht) + sum(t) AS BIGINT) AS n_tokens FROM lines CROSS JOIN head GROUP BY table_id""",
)
def feat_table_tokens(spark, sf_dir):
    """Token length of each table in flatten form."""
    c = _obc(spark, sf_dir)
    return M.table_tokens(c.rows, c.tables)


BUDGET = 400


def fit_budget(rows, tables, budget: int, step: int = 5, counter=count_tokens):
    """Largest multiple of ``step`` rows whose flatten text fits ``budget`` tokens.

    One pass over the largest candidate: a running token sum per table,
    then one aggregate.  (Tables are prompt-sized, so the per-table window
    is bounded by the generation parameters.)
    """
    # Every line has at least one token, so rows past index ``budget`` can never
    # fit: pruning them first bounds each window partition by the budget.
    lines = M.with_meta(rows.where(F.col("row_idx") < budget), tables).select(
        "table_id", "row_idx", counter(M.flatten_line(F.col("header"), F.col("cells"), F.col("row_idx"))).alias("t")
    )
    head = tables.select("table_id", counter(M.flatten_header(F.col("header"))).alias("ht"))
    w = Window.partitionBy("table_id").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    cum = lines.withColumn("cum", F.sum("t").over(w)).join(head, "table_id")
    n = F.col("row_idx") + 1
    ok = (n % step == 0) & (F.col("ht") + F.col("cum") <= budget)
    fit = cum.groupBy("table_id").agg(F.max(F.when(ok, n)).alias("n_fit"))
    return fit.select("table_id", F.coalesce("n_fit", F.lit(0)).cast("int").alias("n_fit"))


@query(
    "gen_fit_budget",
    f"""WITH {_OBC_ROWS},
    cum AS (SELECT table_id, rn, sum(t) OVER (PARTITION BY table_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
            FROM lines)
    SELECT table_id, CAST(coalesce(max(CASE WHEN (rn + 1) % 5 = 0 AND ht + c <= {BUDGET} THEN rn + 1 END), 0) AS INTEGER) AS n_fit
    FROM cum CROSS JOIN head GROUP BY table_id""",
)
def gen_fit_budget(spark, sf_dir):
    """Rows per table that fit a 400-token budget, in steps of 5."""
    c = _obc(spark, sf_dir)
    return fit_budget(c.rows, c.tables, BUDGET)


TARGET = 300


@query(
    "gen_budget_filter",
    f"""WITH {_OBC_ROWS},
    tok AS (SELECT table_id, max(ht) + sum(t) AS n FROM lines CROSS JOIN head GROUP BY table_id)
    SELECT table_id, CAST(n AS BIGINT) AS n_tokens FROM tok WHERE abs(n - {TARGET}) <= 0.04 * {TARGET}""",
)
def gen_budget_filter(spark, sf_dir):
    """Keep tables within ±4 % of a 300-token target."""
    c = _obc(spark, sf_dir)
    t = M.table_tokens(c.rows, c.tables)
    return t.where(F.abs(F.col("n_tokens") - TARGET) <= 0.04 * TARGET)


REACH = G.preset("long2k", row_min=25, row_max=60)
REACH_TOKENS, REACH_TRIES, REACH_LEVELS = 800, 16, 4
_EVERY = REACH_TRIES * REACH_LEVELS
_REACH_N = " ".join(
    f"WHEN {lv} THEN {D.uniform(D.key(REACH.seed, 'id', chr(39) + 'nrows' + chr(39)), max(1, REACH.row_min - 5 * lv), REACH.row_max - 5 * lv)}" for lv in range(REACH_LEVELS)
)


@query(
    "gen_reach_budget",
    f"""WITH d AS (SELECT s_suppkey AS table_id, draw, s_suppkey * {_EVERY} + draw AS id FROM supplier, range(0, {_EVERY}) AS t(draw)),
    n AS (SELECT table_id, draw, draw // {REACH_TRIES} AS level, CASE draw // {REACH_TRIES} {_REACH_N} END AS n_rows FROM d),
    near AS (SELECT table_id, draw, level, 15 + 23 * n_rows AS n_tokens FROM n WHERE abs(15 + 23 * n_rows - {REACH_TOKENS}) <= 0.04 * {REACH_TOKENS}),
    hit AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY draw) = 1)
    SELECT s_suppkey AS table_id, CAST(draw AS BIGINT) AS draw, CAST(level AS INTEGER) AS level, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(draw IS NOT NULL AS INTEGER) AS reached
    FROM supplier LEFT JOIN hit ON table_id = s_suppkey""",
)
def gen_reach_budget(spark, sf_dir):
    """Synthetic tables drawn until each has 800 tokens within 4 %, with fewer rows after 16 misses."""
    from tabqa.operators import quota as Q

    got = Q.tables_near_budget(Tables(spark, sf_dir).supplier, "s_suppkey", REACH, pin(_vocab(spark, sf_dir), "vocabulary"), REACH_TOKENS, tries=REACH_TRIES, levels=REACH_LEVELS)
    return got.report.withColumn("reached", F.col("reached").cast("int"))



@query(
    "src_csv_folder",
    """SELECT CAST(0 AS BIGINT) AS table_id, row_number() OVER (ORDER BY n_nationkey) - 1 AS row_idx, 'n_nationkey|n_name|n_regionkey' AS header, 'INT|TEXT|INT' AS types,
              concat_ws('|', n_nationkey, n_name, n_regionkey) AS cells FROM nation
       UNION ALL
       SELECT 1, row_number() OVER (ORDER BY p_partkey) - 1, 'p_partkey|p_name|p_type|p_retailprice', 'INT|TEXT|TEXT|REAL',
              concat_ws('|', p_partkey, p_name, p_type, CAST(p_retailprice AS VARCHAR)) FROM part""",
)
def src_csv_folder(spark, sf_dir):
    """A folder of CSV files with different columns, one table per file, with a type per (file, column) (A2)."""
    from tabqa.operators.datasets import scratch_path
    from tabqa.sources.tables import read_csv_folder

    t, path = Tables(spark, sf_dir), scratch_path(spark, "csv")
    t.nation.select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").coalesce(1).write.option("header", True).csv(f"{path}/a")
    t.part.select("p_partkey", "p_name", "p_type", "p_retailprice").orderBy("p_partkey").coalesce(1).write.option("header", True).csv(f"{path}/b")
    c = read_csv_folder(spark, f"{path}/*")
    return c.rows.join(c.tables.drop("n_rows"), "table_id").select(
        "table_id", "row_idx", F.array_join("header", "|").alias("header"), F.array_join("types", "|").alias("types"), F.array_join("cells", "|").alias("cells")
    )
