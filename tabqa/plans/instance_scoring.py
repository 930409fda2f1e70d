"""Scores of generated instances by what their queries are like.

Predictions of eight models are derived from the answers of the kept queries
with the error pattern of ``plans.scoring``, so a better model is right more often.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabqa.functions import text as T
from tabqa.functions.hashing import hk
from tabqa.operators import controls as K
from tabqa.operators import datasets as DS
from tabqa.operators import render as M
from tabqa.operators import scoring as O
from tabqa.plans import controls as PC
from tabqa.plans import datasets as PD
from tabqa.plans import duck as D
from tabqa.plans import duck_batch as DB
from tabqa.plans import scoring as PS
from tabqa.plans import shared
from tabqa.plans.registry import query
from tabqa.session import pin

SEED, N_MODELS = 42, 8


def _predicted(kept):
    """(kept columns, model_id, pred, em) for eight models; ``answer`` is the gold text."""
    w = Window.partitionBy("table_id").orderBy("query_no")  # a table's queries are bounded by the draws per table
    g = kept.withColumn("other", F.coalesce(F.lead("answer").over(w), F.lag("answer").over(w), F.lit("None")))
    g = g.withColumn("gold_p", O.prepared(F.col("answer"))).select("*", F.explode(F.sequence(F.lit(1), F.lit(N_MODELS))).alias("model_id"))
    b, m = F.pmod(hk(SEED, F.col("model_id"), F.col("table_id"), F.col("query_no"), "ipred"), F.lit(16)), F.col("model_id")
    words = F.split("answer", " ")
    half = F.array_join(F.slice(words, 1, F.floor(F.size(words) / 2).cast("int")), " ")
    right = F.when(T.is_integer(F.col("answer")), F.concat("answer", F.lit(".0"))).otherwise(F.concat(F.lit("The "), F.col("answer"), F.lit(".")))
    pred = F.when(b < m + 4, right).when(b == m + 4, "").when(b == m + 5, half).when(b == m + 6, F.col("other")).otherwise("None")
    return g.withColumn("pred", pred).withColumn("em", O.match(O.prepared(F.col("pred")), F.col("gold_p"))).drop("gold_p")


def _kept(spark, sf_dir, name, p, position=True):
    """The queries that the rules keep, written once; with ``position`` the places of their answers, looked for among these alone."""
    c = shared.corpus(spark, sf_dir, name)
    checked = K.apply(shared.specs(spark, sf_dir, name, p), shared.executed(spark, sf_dir, name, p), c.rows, K.Controls())
    kept = pin(checked.where("rejected_by is null").drop("ans_row", "ans_col"), "inst-kept")
    return (kept.join(K.answer_position(kept, c.rows), ["table_id", "query_no"]) if position else kept), c


def _scored(spark, sf_dir, position=False):
    """Scored predictions of the kept supplier queries with their spec columns, with ``position`` also the answer row."""
    kept, c = _kept(spark, sf_dir, "supplier", PC.SP, position)
    return _predicted(kept), c


_B = f"({D.h(D.key(SEED, 'model_id', 'table_id', 'query_no', chr(39) + 'ipred' + chr(39)))} % 16)"


def _d_scored() -> str:
    words = "string_split(answer, ' ')"
    return f""", {PD.D_KEPT},
    kx AS (SELECT k.*, s.n_rows, s.w_n, s.g_col, s.h_kind, s.o_kind, s.s_kind, a.n_ans_rows,
                  coalesce(lead(k.answer) OVER w, lag(k.answer) OVER w, 'None') AS other
           FROM kept k JOIN specs s USING (table_id, query_no) JOIN answers a USING (table_id, query_no)
           WINDOW w AS (PARTITION BY k.table_id ORDER BY k.query_no)),
    pr AS (SELECT kx.*, CAST(m AS INTEGER) AS model_id FROM kx, range(1, {N_MODELS + 1}) AS t(m)),
    pd AS (SELECT *, CASE WHEN {_B} < model_id + 4 THEN CASE WHEN regexp_matches(trim(answer), '^[+-]?\\d+$') THEN answer || '.0' ELSE 'The ' || answer || '.' END
                          WHEN {_B} = model_id + 4 THEN '' WHEN {_B} = model_id + 5 THEN array_to_string({words}[1:len({words}) // 2], ' ')
                          WHEN {_B} = model_id + 6 THEN other ELSE 'None' END AS pred FROM pr),
    em AS (SELECT *, {PS.d_em('pred', 'answer')} AS em FROM pd)"""


def _duck(more: str) -> str:
    return DB.exec_sql(PC.CORPUS_SQL, PC.SP, _d_scored() + more)


@query(
    "evl_inst_by_row",
    _duck(
        """, cellx AS (SELECT table_id, row_idx, unnest(cells) AS v FROM crows),
        pos AS (SELECT k.table_id, k.query_no, min(c.row_idx) AS r FROM kx k JOIN cellx c ON c.table_id = k.table_id AND c.v = k.answer
                WHERE k.n_ans_rows = 1 GROUP BY k.table_id, k.query_no)
        SELECT model_id, CAST(CASE WHEN p.r IS NULL THEN -1 ELSE floor(10 * p.r / n_rows) END AS BIGINT) AS row_bucket, round(avg(em), 6) AS acc, count(*) AS n
        FROM em LEFT JOIN pos p USING (table_id, query_no) GROUP BY 1, 2"""
    ),
)
def evl_inst_by_row(spark, sf_dir):
    """Accuracy by the row that holds the answer, in tenths of the table; -1 where no cell does."""
    s, _ = _scored(spark, sf_dir, position=True)
    bucket = F.when(F.col("ans_row") < 0, -1).otherwise(F.floor(10 * F.col("ans_row") / F.col("n_rows"))).cast("bigint")
    return O.accuracy(s.withColumn("row_bucket", bucket), ["model_id", "row_bucket"])


@query(
    "evl_inst_by_tokens",
    _duck(
        f""", {PD._d_flatten_text()}, tk AS (SELECT table_id, len(regexp_extract_all(text, '\\w+|[^\\w\\s]')) AS n FROM ftab)
        SELECT model_id, CAST(floor(tk.n / 1000) AS BIGINT) AS kilotokens, round(avg(em), 6) AS acc, count(*) AS n
        FROM em JOIN tk USING (table_id) GROUP BY 1, 2"""
    ),
)
def evl_inst_by_tokens(spark, sf_dir):
    """Accuracy by the length of the table's text in thousands of tokens."""
    s, c = _scored(spark, sf_dir)
    s = s.join(M.table_tokens(c.rows, c.tables), "table_id").withColumn("kilotokens", F.floor(F.col("n_tokens") / 1000).cast("bigint"))
    return O.accuracy(s, ["model_id", "kilotokens"])


@query(
    "evl_inst_by_clause",
    _duck(
        """, fl AS (SELECT model_id, em, CAST(len(string_split(sql, 'select')) - 1 AS INTEGER) AS nest,
                       unnest(list_filter(['select', CASE WHEN w_n > 0 THEN 'where' END, CASE WHEN g_col IS NOT NULL THEN 'group by' END,
                              CASE WHEN h_kind IS NOT NULL THEN 'having' END, CASE WHEN o_kind <> 'none' THEN 'order by' END,
                              CASE WHEN s_kind = 'agg' THEN 'aggregate' END], lambda c: c IS NOT NULL)) AS clause FROM em)
        SELECT model_id, nest, clause, round(avg(em), 6) AS acc, count(*) AS n FROM fl GROUP BY 1, 2, 3"""
    ),
)
def evl_inst_by_clause(spark, sf_dir):
    """Accuracy by the clauses that a query has and its nest level."""
    s, _ = _scored(spark, sf_dir)
    has = [
        F.lit("select"), F.when(F.col("w_n") > 0, "where"), F.when(F.col("g_col").isNotNull(), "group by"),
        F.when(F.col("h_kind").isNotNull(), "having"), F.when(F.col("o_kind") != "none", "order by"), F.when(F.col("s_kind") == "agg", "aggregate"),
    ]
    nest = F.size(F.split("sql", "select")) - 1
    s = s.select("model_id", "em", nest.alias("nest"), F.explode(F.array_compact(F.array(*has))).alias("clause"))
    return O.accuracy(s, ["model_id", "nest", "clause"])


@query(
    "snk_results_full",
    DB.exec_sql(
        DB.ORDERS_BY_CUSTOMER, PD.OBC,
        _d_scored()
        + """, cellx AS (SELECT table_id, row_idx, unnest(cells) AS v FROM crows),
        pos AS (SELECT k.table_id, k.query_no, min(c.row_idx) AS r FROM kx k JOIN cellx c ON c.table_id = k.table_id AND c.v = k.answer
                WHERE k.n_ans_rows = 1 GROUP BY k.table_id, k.query_no),
        ct AS (SELECT table_id, string_agg(array_to_string(cells, '|'), chr(10) ORDER BY row_idx) AS contents FROM crows GROUP BY table_id)
        SELECT table_id, query_no, model_id, pred, answer AS gold, coalesce(p.r, -1) AS answer_row, sql, ct.contents
        FROM em JOIN ct USING (table_id) LEFT JOIN pos p USING (table_id, query_no)""",
    ),
)
def snk_results_full(spark, sf_dir):
    """Result rows {pred, gold, answer_row, sql, contents} written as JSON lines and read back whole.

    ``contents`` is a table's cells in one value, whatever its size.  Every result has them again, so the lines are gzipped.
    """
    kept, c = _kept(spark, sf_dir, "customer", PD.OBC)
    contents = c.rows.groupBy("table_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))), lambda s: s["cells"]).alias("contents")
    )
    res = _predicted(kept).join(pin(contents, "contents"), "table_id").select(
        "table_id", "query_no", "model_id", "pred", F.col("answer").alias("gold"), F.col("ans_row").cast("bigint").alias("answer_row"), "sql", "contents"
    )
    path = DS.scratch_path(spark, "results")
    DS.write_jsonl(res, path, "gzip")
    schema = "table_id BIGINT, query_no INT, model_id INT, pred STRING, gold STRING, answer_row BIGINT, sql STRING, contents ARRAY<ARRAY<STRING>>"
    back = DS.read_jsonl(spark, path, schema)
    return back.withColumn("contents", F.array_join(F.transform("contents", lambda r: F.array_join(r, "|")), "\n"))
