"""What the rules let through is worked out once, and its answers are put together where they are read."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tabqa.operators import batch as B
from tabqa.operators import controls as K
from tabqa.plans import QUERIES, load_all, shared
from tabqa.plans import controls as PC


@pytest.fixture
def fresh(monkeypatch):
    load_all()
    monkeypatch.setattr(shared, "_MEMO", {})


@pytest.mark.parametrize("name", ["inst_dedup_first", "inst_few_shot", "inst_cap", "inst_acceptance_rate"])
def test_queries_without_answers_put_none_together(spark, fresh, monkeypatch, name):
    def never(*a):
        raise AssertionError("put together")

    monkeypatch.setattr(B.Answers, "only", never)
    assert QUERIES[name](spark, SF).count() > 0


def test_instances_read_written_queries(spark, fresh):
    plan = QUERIES["inst_few_shot"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("tabqa-kept") == 0 and "w1_test" not in plan and "rejected_by" not in plan
    assert plan.count("Join") < 4  # of queries and shots, and of first texts; none with answers


def test_foreseen_queries_change_nothing(spark, fresh, monkeypatch):
    asked, execute = [], B.execute
    monkeypatch.setattr(B, "execute", lambda rows, specs, *a, **k: asked.append(specs.where(K.foreseen(K.Controls())).count()) or execute(rows, specs, *a, **k))
    got = sorted(map(str, shared.kept(spark, SF, "supplier", PC.SP).collect()))
    assert asked == [0]
    specs, ans = shared.specs(spark, SF, "supplier", PC.SP), shared.executed(spark, SF, "supplier", PC.SP)
    assert asked[1] > 0
    checked = K.apply(specs, ans, shared.corpus(spark, SF, "supplier").rows, K.Controls()).where(F.col("rejected_by").isNull())
    assert got and got == sorted(map(str, checked.select("table_id", "query_no", "sql", "answer").collect()))
