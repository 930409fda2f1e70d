"""Answers of a split table are put together where their rows are, and texts are made without writing answers."""

import pytest
from pyspark.sql import functions as F

from tabqa.operators import batch as B
from tabqa.operators import specs as S
from tabqa.sources import corpus as C
from tests.conftest import SF


@pytest.fixture(scope="module")
def large(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    c = C.from_dataframe(li, F.lit(0), [("flag", "l_returnflag", C.TEXT), ("day", "l_shipdate", C.DATE), ("n", "l_linenumber", C.INT)], C.LINEITEM_ORDER).materialize()
    return c, S.draw(c.tables, c.rows, S.SpecParams(seed=7, per_table=30))


def test_answer_rows_of_a_split_table_are_not_shuffled(spark, large):
    c, specs = large
    ans = B.execute(c.rows, specs, salt_rows=500, part_rows=1000)
    assert ans.answers.where("n_parts > 1").count() > 0
    after_join = ans.plain(None)._jdf.queryExecution().executedPlan().toString().split("BroadcastHashJoin")[0]
    assert "collect_list" in after_join and "Exchange" not in after_join


def test_texts_write_no_answers(spark, large, monkeypatch):
    c, specs = large
    ans, written, pin = B.execute(c.rows, specs, salt_rows=500, part_rows=1000), [], B.pin
    monkeypatch.setattr(B, "pin", lambda df, name="pin": written.append(name) or pin(df, name))
    got = {(r.query_no, r.part): (r.answer, r.answer_list, r.n_ans_rows) for r in ans.texts().collect()}
    assert "answer-parts" not in written
    assert {q for q, _ in got} == {r.query_no for r in specs.collect()}
    ans.parts  # noqa: B018  from here on they are read
    assert "answer-parts" in written
    assert got == {(r.query_no, r.part): (r.answer, r.answer_list, r.n_ans_rows) for r in ans.texts().collect()}
    whole = {r.query_no: r.answer for r in ans.assembled().texts().collect()}
    one = {r.query_no: r.answer for r in B.execute(c.rows, specs).assembled().texts().collect()}
    assert whole == one and any(a == "" for a in one.values())


def test_answers_of_one_part_are_not_joined_again(spark, large):
    c, specs = large
    ans = B.execute(c.rows, specs)
    assert "Join LeftAnti" not in ans.assembled().parts._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("part_rows", [None, 1000])
def test_a_salt_is_a_run_of_rows(spark, large, part_rows):
    c, specs = large
    x = B._join_specs(c.rows, specs, 500, None, part_rows).where("w_n = 0")
    runs = x.select("salt", "row_idx").distinct().groupBy("salt").agg(F.min("row_idx").alias("a"), F.max("row_idx").alias("b"), F.count(F.lit(1)).alias("n"))
    n = c.rows.count()
    got = runs.collect()
    assert len(got) > 1 and sum(r.n for r in got) == n
    assert sum(r.b - r.a + 1 == r.n for r in got) >= len(got) - 1  # the last, short run joins the first salt


def test_written_steps_leave_no_shuffles(spark):
    import os

    from tabqa.session import SHUFFLES_GO, pin

    before = spark.conf.get(SHUFFLES_GO)
    assert pin(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count()).count() == 1000
    assert spark.conf.get(SHUFFLES_GO) == before
    folders = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    ids = {f.split("_")[1] for top in folders for _, _, fs in os.walk(top) for f in fs if f.startswith("shuffle_")}
    pin(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count())
    assert {f.split("_")[1] for top in folders for _, _, fs in os.walk(top) for f in fs if f.startswith("shuffle_")} <= ids


@pytest.mark.parametrize("part_rows", [1000, 10_000])
def test_texts_alone_are_the_same(spark, large, part_rows, monkeypatch):
    c, specs = large
    ans = B.execute(c.rows, specs, salt_rows=500, part_rows=part_rows)
    made, plain = [], ans.plain
    ans.plain = lambda some: made.append(some) or plain(some)
    got = sorted(map(str, ans.texts(lists=False).collect()))
    one = sorted(map(str, ans.assembled().texts(lists=False).collect())) if part_rows == 10_000 else []
    assert not made  # no answer rows
    assert got == sorted(map(str, ans.texts().drop("answer_list").collect())) and made
    assert one == (got if part_rows == 10_000 else [])


def test_a_column_shown_and_ordered_by_moves_once(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_suppkey < 4")
    columns = [("flag", "l_returnflag", C.TEXT), ("day", "l_shipdate", C.DATE), ("n", "l_linenumber", C.INT)]
    one = C.from_dataframe(li, "l_suppkey", columns, C.LINEITEM_ORDER)
    two = C.from_dataframe(li, "l_suppkey", [(n, F.col(e), t) for n, e, t in columns], C.LINEITEM_ORDER)
    assert sorted(map(str, one.rows.collect())) == sorted(map(str, two.rows.collect()))
    moved = lambda c: c.rows._jdf.queryExecution().optimizedPlan().toString().count("AS __c")
    assert "__c" not in one.rows._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)[1] and moved(two) == 3
