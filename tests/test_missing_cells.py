"""Hand-made goldens: missing cells, quotes, escapes, empty tables and parts in every format."""

import json

import pytest
from pyspark.sql import functions as F

from tabqa.operators import batch as B
from tabqa.operators import generate as G
from tabqa.operators import render as M
from tabqa.operators import specs as S
from tabqa.sources import corpus as C


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(
        [(1, 0, ["a", "5", "x"]), (1, 1, [None, None, "it's/é"]), (1, 2, ['q"t', "20", "t\tn\n\\"]), (3, 0, ["", "0", "\U0001f389'\""])],
        "table_id bigint, row_idx bigint, cells array<string>",
    )
    tables = spark.createDataFrame(
        [(i, ["s", "n", "t"], ["TEXT", "INT", "TEXT"], n, 3) for i, n in ((1, 3), (2, 0), (3, 1))],
        "table_id bigint, header array<string>, types array<string>, n_rows bigint, n_cols int",
    )
    return rows, tables


def texts(odd, fmt, **kw):
    return {r.table_id: r.text for r in M.whole(M.render(*odd, fmt, **kw)).collect()}


GOLDENS = {
    "markdown": "| s   |   n | t      |\n|:----|----:|:-------|\n| a   |   5 | x      |\n|     | nan | it's/é |\n| q\"t |  20 | t\tn\n\\  |",
    "dfloader": "pd.DataFrame({\n    's': ['a', None, 'q\"t'],\n    'n': [5, nan, 20],\n    't': ['x', \"it's/é\", 't\\tn\\n\\\\'],\n},\nindex=[0, 1, 2])",
    "json": '{"0":{"s":"a","n":5,"t":"x"},"1":{"s":null,"n":null,"t":"it\'s\\/\\u00e9"},"2":{"s":"q\\"t","n":20,"t":"t\\tn\\n\\\\"}}',
    "matrix": "[\n  ['', 's', 'n', 't']\n  [0, 'a', 5, 'x']\n  [1, None, None, \"it's/é\"]\n  [2, 'q\"t', 20, 't\\tn\\n\\\\']\n]",
    "csv": ',s,n,t\n0,a,5,x\n1,,,it\'s/é\n2,"q""t",20,"t\tn\n\\"\n',
    "flatten": "The table have 3 columns: s | n | t\nrow 1 : s is a. n is 5. t is x. \nrow 2 : s is . n is . t is it's/é. \nrow 3 : s is q\"t. n is 20. t is t\tn\n\\. \n",
    "tapex": "header: s | n | t\nrow 1 : a | 5 | x\nrow 2 :  |  | it's/é\nrow 3 : q\"t | 20 | t\tn\n\\\n",
}


@pytest.mark.parametrize("fmt", list(GOLDENS))
def test_goldens(odd, fmt):
    got = texts(odd, fmt)
    assert got[1] == GOLDENS[fmt]
    assert got[2] == "None Table"


def test_texts_read_back_as_python_and_json(odd):
    want = {1: [["a", 5, "x"], [None, None, "it's/é"], ['q"t', 20, "t\tn\n\\"]], 3: [["", 0, "\U0001f389'\""]]}
    for t, rows in want.items():
        matrix = eval(texts(odd, "matrix")[t].replace("]\n  [", "],\n  ["))  # noqa: S307
        assert [r[1:] for r in matrix[1:]] == rows
        assert [list(r.values()) for r in json.loads(texts(odd, "json")[t]).values()] == rows
        assert texts(odd, "json")[t].isascii()


@pytest.mark.parametrize("fmt", M.FORMATS)
def test_every_row_has_every_column(odd, fmt):
    got = texts(odd, fmt)
    assert set(got) == {1, 2, 3}
    if fmt == "html":
        assert got[1].count("<td>") == 9 and "<td>None</td>" in got[1] and "<td>NaN</td>" in got[1]
    if fmt == "tab":
        assert "None" in got[1] and "NaN" in got[1]


@pytest.mark.parametrize("fmt", M.FORMATS)
def test_parts_hold_the_whole_table(odd, fmt):
    parts = M.render(*odd, fmt, part_rows=1).where("table_id = 1").orderBy("chunk").collect()
    assert [r.chunk for r in parts] == [0, 1, 2] and {r.n_chunks for r in parts} == {3}
    assert M.whole(M.render(*odd, fmt, part_rows=1)).where("table_id = 1").count() == 0
    if fmt not in ("dfloader", "markdown", "markdown_index", "markdown_one_line", "tab", "json"):
        assert "".join(r.text for r in parts) == texts(odd, fmt)[1]


def number_corpus(spark):
    rows = spark.createDataFrame(
        [(1, 0, ["a", None], [None, None]), (1, 1, ["b", "5"], [None, 5]), (1, 2, ["c", "7"], [None, 7]), (2, 0, ["z", "1"], [None, 1])],
        "table_id bigint, row_idx bigint, cells array<string>, nums array<bigint>",
    )
    tables = spark.createDataFrame(
        [(1, ["t", "n"], ["TEXT", "INT"], 3, 2), (2, ["t", "n"], ["TEXT", "INT"], 1, 2)],
        "table_id bigint, header array<string>, types array<string>, n_rows bigint, n_cols int",
    )
    return rows, tables


@pytest.mark.parametrize("desc,first", [(False, "a"), (True, "c")])
def test_null_sorts_below_every_number(spark, desc, first):
    rows, tables = number_corpus(spark)
    specs = S.draw(tables, rows, S.SpecParams(seed=1, per_table=1, templates=("s3",)))
    specs = specs.withColumns({"s_kind": F.lit("cols"), "s_cols": F.array(F.lit(0)), "o_kind": F.lit("col"), "o_col": F.lit(1), "o_desc": F.lit(desc)})
    got = {r.table_id: r.first_value for r in B.execute(rows, specs).answers.collect()}
    assert got == {1: first, 2: "z"}


def test_answers_are_the_same_in_any_parts(spark):
    from conftest import SF
    from tabqa.operators import controls as K
    from tabqa.sources.tables import Tables

    c = C.lineitem_by_supplier(Tables(spark, SF).lineitem).materialize()
    specs = S.draw(c.tables, c.rows, S.SpecParams(seed=42, per_table=20))
    seen = []
    for n in (7, 10_000):
        ans = B.execute(c.rows, specs, part_rows=n)
        checked = K.apply(specs, ans, c.rows, K.Controls())
        kept = sorted((r.table_id, r.query_no) for r in checked.where("rejected_by is null").collect())
        rows = sorted((r.table_id, r.query_no, r.ord_i or 0, r.ord_s or "", str(r.vals)) for r in ans.answer_rows.collect())
        seen.append((kept, rows))
    assert seen[0] == seen[1] and seen[0][0]


def test_traces_of_many_specs_keep_apart(spark):
    from tabqa.operators import traces as TR

    rows, tables = number_corpus(spark)
    specs = S.draw(tables, rows, S.SpecParams(seed=2, per_table=70))
    got = TR.cot(rows, specs)
    assert got.count() == got.select("table_id", "query_no").distinct().count() == 140
    one = {r.query_no: r.cot for r in TR.cot(rows.where("table_id = 2"), specs.where("table_id = 2")).collect()}
    assert one == {r.query_no: r.cot for r in got.where("table_id = 2").collect()}


@pytest.mark.parametrize("n_cols,weights", [(1, (0.5, 0.4, 0.1)), (2, (0.9, 0.05, 0.05)), (3, (0.001, 0.001, 0.998)), (4, (0.5, 0.4, 0.1))])
def test_types_are_valid_and_distributed(spark, n_cols, weights):
    shape = G.Shape(col_min=n_cols, col_max=n_cols, type_weights=weights, type_attempts=2)
    shp = G.shapes(spark.range(4000), "id", shape)
    got = [r.types for r in G.types(shp, shape).collect()]
    assert len(got) == 4000 and all(len(t) == n_cols for t in got)
    if n_cols == 1:
        assert abs(sum(t[0] == "TEXT" for t in got) / 4000 - weights[0]) < 0.05
        return
    assert all("TEXT" in t and "INT" in t for t in got)
    from itertools import product

    p = dict(zip(("TEXT", "INT", "DATE"), weights, strict=True))
    valid = {t: 1.0 for t in product(p, repeat=n_cols) if "TEXT" in t and "INT" in t}
    for t in valid:
        for x in t:
            valid[t] *= p[x]
    total = sum(valid.values())
    for t, w in valid.items():
        assert abs(sum(tuple(g) == t for g in got) / 4000 - w / total) < 0.04
