"""Sampling in rounds: every table reaches its number or is reported, and rounds change no draw."""

from dataclasses import replace

from pyspark.sql import functions as F

from conftest import SF
from tabqa.operators import generate as G
from tabqa.operators import quota as Q
from tabqa.operators import render as M


def test_tables_near_a_budget(spark):
    vocab = G.vocabulary(spark.read.parquet(f"{SF}/documents.parquet"), "text", 42)
    driver = spark.range(-3, 5).withColumnRenamed("id", "k").unionAll(spark.range(2))  # ids below zero, repeated ones
    shape = G.preset("long2k", row_min=10, row_max=30)
    got = Q.tables_near_budget(driver, "k", shape, vocab, 360, tries=3, step=5, levels=3)
    report = {r.table_id: r for r in got.report.collect()}
    assert sorted(report) == list(range(-3, 5))
    assert any(r.reached for r in report.values())
    c = Q.corpus_of(got.kept, shape, vocab, tries=3, step=5, levels=3)
    again = {r.table_id: r.n_tokens for r in M.table_tokens(c.rows, c.tables).collect()}
    assert again == {t: r.n_tokens for t, r in report.items() if r.reached} and all(345.6 <= n <= 374.4 for n in again.values())
    for t, r in report.items():  # by brute force: draw after draw
        first = None
        for d in range(9):
            s = replace(shape, row_min=max(1, 10 - 5 * (d // 3)), row_max=30 - 5 * (d // 3))
            n = G.shapes(spark.createDataFrame([(t * 9 + d,)], "id bigint"), "id", s).first().n_rows
            if first is None and abs(15 + 23 * n - 360) <= 14.4:
                first = d
        assert r.draw == first and r.reached == (first is not None) and (first is None or r.level == first // 3)


def test_nothing_near(spark):
    vocab = G.vocabulary(spark.read.parquet(f"{SF}/documents.parquet"), "text", 42)
    got = Q.tables_near_budget(spark.range(2), "id", G.preset("long2k", row_min=1, row_max=4), vocab, 10_000, tries=2)
    assert [tuple(r) for r in got.report.select("table_id", "draw", "reached").orderBy("table_id").collect()] == [(0, None, False), (1, None, False)]
    assert Q.tables_near_budget(spark.range(0), "id", G.preset("long2k"), vocab, 700, levels=1).report.count() == 0
