"""Distinct counts of groups and the places of aggregates, held against SQLite running the same SQL."""

import sqlite3

from pyspark.sql import functions as F

from tabqa.operators import batch as B
from tabqa.operators import controls as K
from tabqa.operators import specs as S
from test_hard_values import hard


def tables(c):
    out = {}
    for r in c.tables.collect():
        con = sqlite3.connect(":memory:")
        con.execute(f"create table my_table ({', '.join(f'{h} ' + ('INTEGER' if t == 'INT' else t) for h, t in zip(r.header, r.types, strict=True))})")
        cells = [x.cells for x in c.rows.where(F.col("table_id") == r.table_id).orderBy("row_idx").collect()]
        for x in cells:
            con.execute(f"insert into my_table values ({', '.join('?' * len(x))})", [None if v is None else int(v) if t == "INT" else v for v, t in zip(x, r.types, strict=True)])
        out[r.table_id] = (con, cells)
    return out


def test_distinct_counts(spark):
    c = hard(spark).materialize()
    drawn = S.draw(c.tables, c.rows, S.SpecParams(seed=6, per_table=150, templates=("s5", "s6", "s7", "s8"), profile="chinese"))
    specs = drawn.where("h_distinct")
    exact, sketch = (B.execute(c.rows, specs, **x) for x in ({}, {"sketch": 0.01}))
    failed = {(r.table_id, r.query_no) for r in exact.answers.where("failed").collect()}
    got = {(r.table_id, r.query_no): r.answer for r in exact.assembled().texts().collect()}
    near = {(r.table_id, r.query_no): r.answer for r in sketch.assembled().texts().collect()}
    con, checked, tops = tables(c), 0, 0
    for s in specs.collect():
        assert f"count ( distinct {s.header[s.h_col]} )" in s.sql
        if s.s_kind == "calc" or (s.s_kind == "agg" and s.s_agg in ("avg", "sum")):
            continue
        mine = got[s.table_id, s.query_no]
        if (s.table_id, s.query_no) in failed:
            assert mine == ""
            continue
        if s.o_kind == "agg":  # among the groups of the extreme count
            of = f"count ( distinct {s.header[s.h_col]} )"
            rows = con[s.table_id][0].execute(s.sql.replace("select ", f"select {of}, ", 1).replace(" limit 1", "")).fetchall()
            assert str(mine) in ([str(r[1]) for r in rows if r[0] == rows[0][0]] or [""]), s.sql
            tops += 1
            continue
        rows = con[s.table_id][0].execute(s.sql).fetchall()
        want = sorted(str(r[0] if len(r) == 1 else r) for r in rows)
        have = sorted(str(x) for x in [mine]) if len(rows) == 1 else str(mine)
        assert have == (want if len(rows) == 1 else ", ".join(str(r[0] if len(r) == 1 else r) for r in rows)), (s.sql, mine, want)
        checked += 1
    assert checked >= 40 and tops >= 10
    assert sum(near[k] == v for k, v in got.items()) >= 0.95 * len(got)


def test_places_of_aggregates(spark):
    c = hard(spark).materialize()
    specs = S.draw(c.tables, c.rows, S.SpecParams(seed=8, per_table=150, templates=("s1", "s2")))
    ans = B.execute(c.rows, specs)
    at = {(r.table_id, r.query_no): (r.ans_row, r.ans_col) for r in K.answer_position(ans.answers, c.rows, K.located_values(specs, ans, c.rows)).collect()}
    assert len(at) == specs.count()
    con, seen = tables(c), {}
    failed = {(r.table_id, r.query_no) for r in ans.answers.where("failed").collect()}
    for s in specs.where("s_kind = 'agg'").collect():
        if (s.table_id, s.query_no) in failed:
            assert at[s.table_id, s.query_no] == (-1, -1)
            continue
        col = s.header[s.s_cols[0]]
        db, cells = con[s.table_id]
        first = db.execute(s.sql.replace(f"{s.s_agg} ( {col} )", col, 1)).fetchone()
        value = None if first is None or first[0] is None else str(first[0])
        places = [(i, j) for i, row in enumerate(cells) for j, v in enumerate(row) if v == value and v is not None]
        assert at[s.table_id, s.query_no] == (places or [(-1, -1)])[0], s.sql
        seen[s.s_agg] = seen.get(s.s_agg, 0) + 1
    assert {"min", "max", "sum", "count"} <= set(seen)
