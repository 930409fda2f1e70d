"""Values that a sub-query admits go with their spec; only very many are joined with the cells."""

import pytest
from test_hard_values import hard

from tabqa.operators import batch as B
from tabqa.operators import nested as N
from tabqa.operators import specs as S


@pytest.fixture(scope="module")
def nested(spark):
    c = hard(spark).materialize()
    sub = S.draw(c.tables, c.rows, S.SpecParams(seed=21, per_table=40, templates=("s1", "s2", "s3", "s4"), flag="d"))
    outer = S.draw(c.tables, c.rows, S.SpecParams(seed=24, per_table=40, templates=("s2", "s3")))
    return c, sub, *N.where_nested(outer, sub, B.execute(c.rows, sub), 24)


def pairs(c, specs, values, salt_rows):
    return sorted(map(tuple, B.matched(c.rows, specs, salt_rows, values).select("table_id", "query_no", "row_idx").collect()))


def test_pairs_are_not_joined_with_values(spark, nested):
    c, _, specs, values = nested
    plan = B.matched(c.rows, specs, admitted=values)._jdf.queryExecution().optimizedPlan().toString()
    assert "__v" not in plan and "n_vals" in plan


@pytest.mark.parametrize("salt_rows", [B.SALT_ROWS, 4])
@pytest.mark.parametrize("most", [0, 1, 2])
def test_many_values_are_joined(spark, nested, monkeypatch, salt_rows, most):
    c, _, specs, values = nested
    want = pairs(c, specs, values, B.SALT_ROWS)
    monkeypatch.setattr(B, "LISTED_VALUES", most)
    monkeypatch.setattr(B, "BUCKET_VALUES", 1)
    assert values.groupBy(*B.SPEC_KEY).count().where(f"count > {most}").count() > 0
    assert want and pairs(c, specs, values, salt_rows) == want


def test_only_accepted_answers_are_put_together(spark, nested, monkeypatch):
    c, sub, specs, values = nested
    ans, asked = B.execute(c.rows, sub), []
    plain = ans.plain
    ans.plain = lambda some: asked.append(some) or plain(some)
    outer = S.draw(c.tables, c.rows, S.SpecParams(seed=24, per_table=40, templates=("s2", "s3")))
    _, again = N.where_nested(outer, sub, ans, 24)
    assert [a.count() for a in asked] == [specs.where("n_kind = 'text'").count()]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, values.select(again.columns).collect()))
