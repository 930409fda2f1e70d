"""Queries that no table waits for are not answered, and groups that fit a part are not numbered."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabqa.operators import batch as B
from tabqa.operators import controls as K
from tabqa.operators import quota as Q
from tabqa.operators import specs as S
from tabqa.sources import corpus as C
from tests.conftest import SF

P = S.SpecParams(seed=51)


@pytest.fixture(scope="module")
def customers(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").where("o_custkey < 60")
    single = o.where("o_custkey < 5").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))  # tables of one row
    return C.orders_by_customer(o.where("o_custkey >= 5").unionByName(o.join(single, ["o_custkey", "o_orderkey"], "left_semi"))).materialize()


def test_rounds_answer_what_is_short(spark, customers, monkeypatch):
    c, asked, execute = customers, [], B.execute

    def seen(rows, specs, *a, **k):
        asked.append(specs.select("table_id", "query_no", K.foreseen(K.Controls()).alias("no")).collect())
        return execute(rows, specs, *a, **k)

    monkeypatch.setattr(Q.B, "execute", seen)
    got = Q.queries_per_table(c, P, 3, rounds=2, multiple=2)  # 6 draws, then 12 in steps of 6 and 6
    kept, report = {tuple(r) for r in got.kept.select("table_id", "query_no", "sql", "answer").collect()}, {r.table_id: r for r in got.report.collect()}
    assert not any(r.no for rs in asked for r in rs)
    assert [(min(r.query_no for r in rs) >= a, max(r.query_no for r in rs) < b) for rs, (a, b) in zip(asked, [(0, 6), (6, 12), (12, 18)])] == [(True, True)] * len(asked)
    assert len(asked) == 3 and len({r.table_id for r in asked[2]}) < len({r.table_id for r in asked[1]}) < len({r.table_id for r in asked[0]})

    # All 18 at once, as the rules define it.
    monkeypatch.undo()
    specs = S.draw(c.tables, c.rows, S.SpecParams(seed=51, per_table=18))
    fine = K.apply(specs, B.execute(c.rows, specs), c.rows, K.Controls()).where("rejected_by is null")
    fine = fine.withColumn("n", F.row_number().over(Window.partitionBy("table_id", "sql").orderBy("query_no"))).where("n = 1")
    fine = fine.withColumn("n", F.row_number().over(Window.partitionBy("table_id").orderBy("query_no")))
    assert kept == {tuple(r) for r in fine.where("n <= 3").select("table_id", "query_no", "sql", "answer").collect()}
    early = {r[0]: r[1] for r in fine.where("query_no < 6").groupBy("table_id").count().collect()}
    every = {r[0]: r[1] for r in fine.groupBy("table_id").count().collect()}
    assert sorted(report) == sorted(r[0] for r in c.tables.select("table_id").collect())
    for t, r in report.items():
        assert (r.n_drawn, r.n_kept, r.reached) == (6 if early.get(t, 0) >= 3 else 18, min(every.get(t, 0), 3), every.get(t, 0) >= 3)


def test_foreseen_queries_are_rejected(spark, customers):
    c = customers
    specs = S.draw(c.tables, c.rows, S.SpecParams(seed=5, per_table=12))
    controls = K.Controls(exclude=["max"])
    checked = K.apply(specs, B.execute(c.rows, specs), c.rows, controls, texts=False).select("rejected_by", "n_rows", K.foreseen(controls).alias("no")).collect()
    assert any(r.no for r in checked) and all(r.rejected_by is not None for r in checked if r.no)
    assert any(r.n_rows == 1 for r in checked)


def test_groups_of_small_tables_are_not_numbered(spark, customers, monkeypatch):
    c = customers
    specs = S.draw(c.tables, c.rows, S.SpecParams(seed=9, per_table=6))
    numbered = {tuple(r) for r in B.execute(c.rows, specs, part_rows=2).whole().collect()}

    def never(*a, **k):
        raise AssertionError("numbered")

    monkeypatch.setattr(B, "row_index", never)
    assert {tuple(r) for r in B.execute(c.rows, specs).whole().collect()} == numbered
