"""Nested queries and their traces in split tables, and ties of top rows and groups, held against SQLite and whole tables."""

from pyspark.sql import functions as F
from test_distinct_and_origin import tables
from test_hard_values import hard

from tabqa.operators import batch as B
from tabqa.operators import nested as N
from tabqa.operators import specs as S
from tabqa.operators import traces as TR


def test_ties_are_named(spark):
    c = hard(spark).materialize()
    specs = S.draw(c.tables, c.rows, S.SpecParams(seed=4, per_table=40, templates=("s3", "s4", "s7", "s8")))
    got = {(r.table_id, r.query_no): r for r in B.execute(c.rows, specs, salt_rows=9).answers.collect()}
    con, seen = tables(c), set()
    for s in specs.collect():
        r = got[s.table_id, s.query_no]
        if r.failed or s.o_kind == "none":
            assert not r.ambiguous
            continue
        of = s.header[s.o_col] if s.o_kind == "col" else f"{s.h_agg} ( {s.header[s.h_col]} )"
        rows = con[s.table_id][0].execute(s.sql.replace("select ", f"select {of}, ", 1).replace(" limit 1", "")).fetchall()
        want = sum(x[0] == rows[0][0] for x in rows) > 1 if rows else False
        assert r.ambiguous == want, s.sql
        seen.add((s.o_kind, want))
    assert seen == {("col", True), ("col", False), ("agg", True), ("agg", False)}


def test_nested_queries_of_split_tables(spark):
    c = hard(spark).materialize()
    sub = S.draw(c.tables, c.rows, S.SpecParams(seed=21, per_table=60, templates=("s1", "s2", "s3", "s4"), flag="d"))
    outer = S.draw(c.tables, c.rows, S.SpecParams(seed=24, per_table=60, templates=("s2",)))
    specs, values = N.where_nested(outer, sub, B.execute(c.rows, sub), 24)
    assert {r.n_kind for r in specs.select("n_kind").distinct().collect()} == {"num", "text"}
    key = lambda df, *cols: sorted(map(str, df.select("table_id", "query_no", *cols).collect()))
    one, split = (N.answer_nested(specs, values, c.rows, n) for n in (B.SALT_ROWS, 4))
    assert key(one, "answer", "n_selected") == key(split, "answer", "n_selected")
    few = specs.where(F.col("query_no") < 15)
    one, split = (TR.cot(c.rows, few, values, n) for n in (B.SALT_ROWS, 4))
    assert key(one, "turn_input", "turn_output") == key(split, "turn_input", "turn_output")

    con, checked = tables(c), 0
    got = {(r.table_id, r.query_no): r for r in N.answer_nested(specs, values, c.rows).collect()}
    for s in specs.collect():
        r = got[s.table_id, s.query_no]
        if r.failed or s.s_kind != "cols" or len(s.s_cols) > 1:
            continue
        rows = con[s.table_id][0].execute(s.sql).fetchall()
        assert r.n_ans_rows == len(rows) and r.answer == (", ".join(str(x[0]) for x in rows)), s.sql
        checked += len(rows) > 0
    assert checked > 5


def test_a_pair_ends_with_its_answer(spark):
    pairs = spark.createDataFrame(
        [(1, 0, "q", "5", "+", 0, 1, None), (1, 1, "u", "a, O'B", "union", 2, 3, ["a", "O'B"])],
        "table_id long, pair int, sql string, answer string, op string, query_no1 int, query_no2 int, vs array<string>",
    )
    turns = spark.createDataFrame([(1, i, [f"i{i}"], [f"o{i}"]) for i in range(4)], "table_id long, query_no int, turn_input array<string>, turn_output array<string>")
    a, b = N.linked_pair(pairs, turns).orderBy("pair").collect()
    assert a.turn_input == [N.LINK_TWO, "i0", "i1", "Finally, calculate the sum of the answers to the first query and the second query."]
    assert a.turn_output == ["", "o0", "o1", "The answer is [(5,)]"]
    assert b.turn_input == [N.LINK_TWO, "i2", "i3"]
    assert b.turn_output == ["", "o2", "o3", """The answer is [('a',), ("O'B",)]"""]
