"""Tables of a trace are put together where the rows of their spec are; large ones in parts, with the same texts."""

from test_hard_values import hard

from tabqa.operators import render as M
from tabqa.operators import specs as S
from tabqa.operators import traces as TR


def test_traces_in_place_are_those_in_parts(spark):
    c = hard(spark).materialize()
    specs = S.draw(c.tables, c.rows, S.SpecParams(seed=4, per_table=24))
    seen = [sorted(map(str, TR.cot(c.rows, specs, part_rows=n).collect())) for n in (0, 5, M.PART_ROWS)]
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == specs.count()
    assert any("new_table1:" in t for t in seen[0]) and any(M.NONE_TABLE in t for t in seen[0])


def test_rows_of_steps_are_dealt_once(spark):
    c = hard(spark).materialize()
    specs = S.draw(c.tables, c.rows, S.SpecParams(seed=4, per_table=6))
    plan = TR.cot(c.rows, specs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 3  # specs with their tables, group heads and global aggregates; no step looks its table up


def test_a_table_in_place_is_the_rendered_one(spark):
    rows = [("a", 0, ["x", None, "1"]), ("a", 1, [None, "long cell", "22"]), ("b", 0, ["é", "z", None])]
    rows = spark.createDataFrame(rows, "table_id string, row_idx bigint, cells array<string>")
    head = [(t, ["h", "some header", "n"], ["TEXT", "TEXT", "INT"], n, 3) for t, n in (("a", 2), ("b", 1), ("c", 0))]
    tables = spark.createDataFrame(head, "table_id string, header array<string>, types array<string>, n_rows bigint, n_cols int")
    want = {r.table_id: r.text for r in M.render(rows, tables, "markdown").collect()}
    listed = rows.selectExpr("table_id", "struct(row_idx, cells) AS r").groupBy("table_id").agg({"r": "collect_list"}).toDF("table_id", "rows")
    beside = tables.join(listed, "table_id", "left").selectExpr("*", "coalesce(rows, array()) AS rs").drop("rows")
    assert {r.table_id: r.text for r in M.in_place(beside, "rs").collect()} == want and want["c"] == M.NONE_TABLE
