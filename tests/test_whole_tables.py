"""Tables above one part keep their pairs, prompts, traces and results: against the oracle SQL on a hot customer."""

import os

import pyarrow.parquet as pq
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tabqa.operators import prompts as P
from tabqa.operators import render as M

HOT = [1, 2, 4]


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """The smallest tables, with 10,050 orders and more of some customers."""
    folder = str(tmp_path_factory.mktemp("hot"))
    for f in os.listdir(SF):
        if f != "orders.parquet":
            os.symlink(f"{SF}/{f}", f"{folder}/{f}")
    o = spark.read.parquet(f"{SF}/orders.parquet")
    kind, n, keys = dict(o.dtypes), o.count(), o.agg(F.max("o_orderkey")).first()[0]
    copies = o.crossJoin(spark.range(len(HOT) * (10_050 // n + 1))).withColumn("o_custkey", F.element_at(F.array(*map(F.lit, HOT)), (F.col("id") % len(HOT) + 1).cast("int")).cast(kind["o_custkey"]))
    copies = copies.withColumn("o_orderkey", (F.col("o_orderkey") + (F.col("id") + 1) * (keys + 1)).cast(kind["o_orderkey"])).drop("id")
    pq.write_table(o.where("o_custkey < 20").unionByName(copies).toArrow(), f"{folder}/orders.parquet")
    return folder


@pytest.mark.parametrize("name", ["inst_ft_pairs", "prm_full", "snk_results_full"])
def test_hot_tables_are_whole(spark, hot, name):
    import __spark_entry__ as E
    from oracle_check import compare, duck_conn

    status, said, *_ = compare(spark, duck_conn(hot), name, E.queries()[name], E.oracle_sql()[name], hot)
    assert status == "ok", said[:500]
    if name != "prm_full":  # which needs six kept queries of a table
        assert E.queries()[name](spark, hot).where(F.col("table_id").isin(HOT)).count() > 0


def test_hot_tables_are_truncated(spark, hot):
    from tabqa.plans import datasets as PD
    from tabqa.sources import corpus as C
    from tabqa.sources.tables import Tables

    c = C.orders_by_customer(Tables(spark, hot).orders)
    want = P.truncate(M.joined(M.render(c.rows, c.tables, "flatten"), "flatten"), ["table_id"], "text", PD.BUDGET)
    got = {r.table_id: r.text for r in PD.prm_truncate(spark, hot).collect()}
    assert got == {r.table_id: r.text for r in want.collect()} and set(HOT) < set(got)


def test_traces_are_the_same_in_any_parts(spark, monkeypatch):
    from functools import partial

    from tabqa.operators import specs as S
    from tabqa.operators import traces as TR
    from tabqa.sources import corpus as C
    from tabqa.sources.tables import Tables

    c = C.orders_by_customer(Tables(spark, SF).orders.where("o_custkey < 20")).materialize()
    specs = S.draw(c.tables, c.rows, S.SpecParams(seed=11, per_table=4))
    want = sorted(map(tuple, TR.cot(c.rows, specs).select("table_id", "query_no", "cot").collect()))
    monkeypatch.setattr(M, "render", partial(M.render, part_rows=2))
    assert sorted(map(tuple, TR.cot(c.rows, specs).select("table_id", "query_no", "cot").collect())) == want and all(x[2] for x in want)


def test_tables_above_a_part_have_traces(spark):
    from tabqa.operators import specs as S
    from tabqa.operators import traces as TR

    n = M.PART_ROWS + 3
    rows = spark.range(n).select(F.lit(1).cast("bigint").alias("table_id"), F.col("id").alias("row_idx"), F.array(F.concat(F.lit("a"), F.col("id") % 5), F.col("id").cast("string")).alias("cells"), F.array(F.lit(None).cast("bigint"), F.col("id")).alias("nums"))
    tables = spark.createDataFrame([(1, ["t", "n"], ["TEXT", "INT"], n, 2)], "table_id bigint, header array<string>, types array<string>, n_rows bigint, n_cols int")
    got = TR.cot(rows, S.draw(tables, rows, S.SpecParams(seed=2, per_table=8))).select("query_no", F.length("cot").alias("n")).collect()
    assert len(got) == 8 and max(r.n for r in got) > n


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.createDataFrame([(t, i, [f"a{i} b", str(i)]) for t, n in ((1, 9), (2, 2)) for i in range(n)], "table_id bigint, row_idx bigint, cells array<string>")
    tables = spark.createDataFrame([(1, ["t", "n"], ["TEXT", "INT"], 9, 2), (2, ["t", "n"], ["TEXT", "INT"], 2, 2)], "table_id bigint, header array<string>, types array<string>, n_rows bigint, n_cols int")
    return rows, tables


@pytest.mark.parametrize("fmt", [f for f in M.FORMATS if f != "dfloader"])
def test_joined_parts_are_the_text(table, fmt):
    want = {r.table_id: r.text for r in M.render(*table, fmt).collect()}
    assert {r.table_id: r.text for r in M.joined(M.render(*table, fmt, part_rows=2), fmt).collect()} == want and len(want) == 2


@pytest.mark.parametrize("budget,step", [(1, 500), (30, 7), (50, 500), (60, 4), (1000, 500)])
def test_truncated_parts_are_the_truncated_text(table, budget, step):
    want = P.truncate(M.render(*table, "flatten").drop("chunk", "n_chunks"), ["table_id"], "text", budget, step)
    got = P.truncate_parts(M.render(*table, "flatten", part_rows=1), ["table_id"], "text", budget, step)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
