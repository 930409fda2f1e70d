"""Pinned intermediate results shared by the registered queries.

Several queries start from the same corpus, specs and answers.  Those are
written once (Parquet, under the session's checkpoint folder) and reused
within the session; the files are immutable, so sharing them is safe.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabqa.operators import batch as B
from tabqa.operators import controls as K
from tabqa.operators import quota as Q
from tabqa.operators import specs as S
from tabqa.session import pin
from tabqa.sources import corpus as C
from tabqa.sources.tables import Tables

_MEMO: dict = {}


def _key(spark, *parts):
    return (spark.sparkContext.applicationId, *parts)


def corpus(spark, sf_dir: str, name: str) -> C.Corpus:
    k = _key(spark, sf_dir, "corpus", name)
    if k not in _MEMO:
        t = Tables(spark, sf_dir)
        build = {
            "supplier": lambda: C.lineitem_by_supplier(t.lineitem),
            "customer": lambda: C.orders_by_customer(t.orders),
            "brand": lambda: C.parts_by_brand(t.part),
            "exact": lambda: C.orders_exact(t.orders),
            "hard": lambda: C.orders_hard(t.orders),
        }[name]
        _MEMO[k] = build().materialize()
    return _MEMO[k]


def specs(spark, sf_dir: str, name: str, p: S.SpecParams):
    k = _key(spark, sf_dir, "specs", name, p)
    if k not in _MEMO:
        c = corpus(spark, sf_dir, name)
        _MEMO[k] = S.draw(c.tables, c.rows, p)
    return _MEMO[k]


def executed(spark, sf_dir: str, name: str, p: S.SpecParams) -> B.Answers:
    k = _key(spark, sf_dir, "executed", name, p)
    if k not in _MEMO:
        c = corpus(spark, sf_dir, name)
        _MEMO[k] = B.execute(c.rows, specs(spark, sf_dir, name, p))
    return _MEMO[k]


def kept(spark, sf_dir: str, name: str, p: S.SpecParams, texts: bool = True):
    """``table_id, query_no, sql`` of the queries that the default rules let through, and the whole ``answer`` if ``texts``.

    Both are written once.  Queries whose rejection is foreseen are not answered for it; answers that were written before are read.
    """
    k = _key(spark, sf_dir, "kept", name, p)
    if k not in _MEMO:
        c, sp = corpus(spark, sf_dir, name), specs(spark, sf_dir, name, p)
        ans = _MEMO.get(_key(spark, sf_dir, "executed", name, p))
        if ans is None:
            sp = sp.where(~K.foreseen(K.Controls()))
            ans = B.execute(c.rows, sp)
        checked = K.apply(sp, ans, c.rows, K.Controls(), texts=False)
        _MEMO[k] = pin(checked.where(F.col("rejected_by").isNull()).select("table_id", "query_no", "sql"), "kept"), ans
    queries, ans = _MEMO[k]
    if not texts:
        return queries
    k = _key(spark, sf_dir, "kept-texts", name, p)
    if k not in _MEMO:
        _MEMO[k] = pin(queries.join(ans.only(queries).whole(), B.SPEC_KEY), "kept-texts")
    return _MEMO[k]


def kept_of_tables(spark, sf_dir: str, name: str, p: S.SpecParams, least: int):
    """Specs with their ``answer`` that the default rules let through, of the tables that have ``least`` different ones.

    What was written before is read; else queries are answered in steps, for the tables that can still reach ``least``.
    """
    k = _key(spark, sf_dir, "kept-of-tables", name, p, least)
    if k not in _MEMO:
        if _key(spark, sf_dir, "kept", name, p) in _MEMO or _key(spark, sf_dir, "executed", name, p) in _MEMO:
            q = kept(spark, sf_dir, name, p)
            several = q.select("table_id", "sql").distinct().groupBy("table_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
            q = q.join(several.select("table_id"), "table_id", "left_semi").drop("sql")
            found = specs(spark, sf_dir, name, p).join(q, B.SPEC_KEY)
        else:
            found = Q.tables_with(corpus(spark, sf_dir, name), p, least)
        _MEMO[k] = pin(found, "kept-of-tables")
    return _MEMO[k]


def answers(spark, sf_dir: str, name: str, p: S.SpecParams):
    """One row per spec, with the whole text of its answer."""
    return executed(spark, sf_dir, name, p).assembled().texts(lists=False)
