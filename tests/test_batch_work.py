"""How often rows meet specs, and the bounds that stand for comparisons."""

import pytest
from pyspark.sql import functions as F

from tabqa.operators import batch as B
from tabqa.operators import specs as S
from tabqa.plans import QUERIES, load_all, shared
from tabqa.sources import corpus as C
from tests.conftest import SF


@pytest.fixture(scope="module")
def drawn(spark):
    c = C.lineitem_by_supplier(spark.read.parquet(f"{SF}/lineitem.parquet")).materialize()
    return c, S.draw(c.tables, c.rows, S.SpecParams(seed=3, per_table=10))


def test_rows_meet_specs_once_and_plain_answers_when_read(spark, drawn, monkeypatch):
    c, specs = drawn
    calls, join = [], B._join_specs
    monkeypatch.setattr(B, "_join_specs", lambda *a: calls.append(a[1].count()) or join(*a))
    ans = B.execute(c.rows, specs)
    assert len(calls) == 1
    few = ans.answers.where("n_ans_rows between 1 and 3").select(*B.SPEC_KEY)
    got = {tuple(r) for r in ans.only(few).whole().collect()}
    assert len(calls) == 2 and calls[1] < specs.count() / 2
    assert got == {tuple(r) for r in ans.whole().join(few, B.SPEC_KEY, "left_semi").collect()}


def test_tables_that_fit_a_task_are_shuffled_once(spark, drawn):
    c, specs = drawn
    x = B._join_specs(c.rows, specs, B.SALT_ROWS).groupBy(*B.SPEC_KEY).agg(F.count(F.lit(1)))
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the rows, not the partial counts again


@pytest.mark.parametrize("kind", ["bigint", "decimal(25,6)"])
def test_bounds_are_the_comparison(spark, kind):
    top, low = str((1 << 63) - 1), str(-(1 << 63))
    texts = ["5", "-3", "0", top, low, "x", "None", None, " 7 ", "1.5"]
    values = [None, 5, -3, 6, 4, 0, 7, (1 << 63) - 1, -(1 << 63), (1 << 63) - 2]
    lits = spark.createDataFrame([(t,) for t in texts], "t string").crossJoin(spark.createDataFrame([(o,) for o in "<>="], "op string"))
    lo, hi = B._bounds(F.col("op"), F.col("t"), kind)
    x = lits.select("*", lo.alias("lo"), hi.alias("hi")).crossJoin(spark.createDataFrame([(v,) for v in values], "v bigint").select(F.col("v").cast(kind).alias("v")))
    x = x.select("*", ((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).alias("got"), B._cmp(F.col("v"), F.col("op"), F.col("t").try_cast(kind)).alias("want"))
    assert x.where("not (coalesce(got, false) <=> coalesce(want, false)) or (got is null and want is false)").count() == 0


def test_exact_sums(spark):
    big = (1 << 63) - 1
    for vs in ([big] * 3, [-big - 1] * 3, [1, -1, 5], [None, None], [None, -7, 1 << 42, -(1 << 21) - 1]):
        want = sum(v for v in vs if v is not None) if any(v is not None for v in vs) else None
        got = spark.createDataFrame([(v,) for v in vs], "v bigint").agg(B.total(F.col("v"))).first()[0]
        assert got == want


@pytest.mark.parametrize("name", ["feat_sql_len", "feat_has_dups", "feat_clause_columns", "ctl_filter_times", "ctl_length"])
def test_features_of_a_query_need_no_answers(spark, monkeypatch, name):
    load_all()

    def never(*a):
        raise AssertionError("executed")

    monkeypatch.setattr(shared, "executed", never)
    assert QUERIES[name](spark, SF).count() > 0


def test_steps_of_a_trace_read_what_was_written(spark, drawn):
    from tabqa.operators import traces as TR

    c, specs = drawn
    plan = TR.cot(c.rows, specs.where("query_no < 3"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # the numbers of groups and rows are not worked out again in each step
    assert plan.count("Join") < 20
