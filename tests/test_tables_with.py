"""Tables that cannot have their number of queries any more are neither answered nor rendered."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tabqa.operators import batch as B
from tabqa.operators import datasets as DS
from tabqa.operators import render as M
from tabqa.plans import QUERIES, load_all, shared
from tabqa.plans import datasets as D

LEAST = D.N_SHOT + 1


@pytest.fixture
def fresh(monkeypatch):
    load_all()
    monkeypatch.setattr(shared, "_MEMO", {})


def test_steps_give_what_all_at_once_gives(spark, fresh, monkeypatch):
    asked, execute = [], B.execute
    monkeypatch.setattr(B, "execute", lambda rows, specs, *a, **k: asked.append(specs.select("table_id").distinct().count()) or execute(rows, specs, *a, **k))
    cols = ["table_id", "query_no", "sql", "multistep", "answer"]
    steps = sorted(map(str, shared.kept_of_tables(spark, SF, "customer", D.OBC, LEAST).select(*cols).collect()))
    assert len(asked) == 3 and asked[0] > asked[1] > asked[2]

    shared._MEMO.clear()
    kept = shared.kept(spark, SF, "customer", D.OBC)
    n = DS.dedup_first(kept).groupBy("table_id").count().where(F.col("count") >= LEAST)
    want = kept.join(n, "table_id", "left_semi").join(shared.specs(spark, SF, "customer", D.OBC).select("table_id", "query_no", "multistep"), ["table_id", "query_no"])
    assert steps and steps == sorted(map(str, want.select(*cols).collect()))
    again = shared.kept_of_tables(spark, SF, "customer", D.OBC, LEAST)  # from what was written
    assert len(asked) == 4 and sorted(map(str, again.select(*cols).collect())) == steps


def test_prompts_render_their_tables_only(spark, fresh, monkeypatch):
    seen, render = [], M.render
    monkeypatch.setattr(M, "render", lambda rows, tables, *a, **k: seen.append((rows.select("table_id").distinct().count(), tables.count())) or render(rows, tables, *a, **k))
    n = QUERIES["prm_full"](spark, SF).select("table_id").distinct().count()
    assert n > 0 and seen == [(n, n)]
