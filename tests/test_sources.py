"""File sources and sinks: CSV folders, JSON arrays, template lines, aligned text pairs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tabqa.operators import datasets as DS
from tabqa.sources.tables import read_csv_folder


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


def test_csv_files_keep_their_own_columns(spark, tmp_path):
    d = str(tmp_path / "csv")
    write(d, "a.csv", "a,b\n1,x\n2,\n")
    write(d, "b.csv", 'p,q,r\n1.5,"u,v",7\nnan,w,8\n2,"q""t",9\n')
    write(d, "c.csv", "only\n")
    c = read_csv_folder(spark, d)
    tables = {os.path.basename(r.source_file): r for r in c.tables.collect()}
    assert {k: (r.header, r.types, r.n_rows) for k, r in tables.items()} == {
        "a.csv": (["a", "b"], ["INT", "TEXT"], 2), "b.csv": (["p", "q", "r"], ["REAL", "TEXT", "INT"], 3), "c.csv": (["only"], ["TEXT"], 0),
    }
    rows = sorted((r.table_id, r.row_idx, r.cells, r.nums) for r in c.rows.collect())
    a, b = tables["a.csv"].table_id, tables["b.csv"].table_id
    assert rows == [
        (a, 0, ["1", "x"], [1, None]), (a, 1, ["2", None], [2, None]),
        (b, 0, ["1.5", "u,v", "7"], [1.5, None, 7]), (b, 1, ["nan", "w", "8"], [None, None, 8]), (b, 2, ["2", 'q"t', "9"], [2, None, 9]),
    ]


def test_json_array(spark, tmp_path):
    write(str(tmp_path), "p.json", json.dumps([{"pred": "a", "gold": "b"}, {"pred": "c\n", "gold": None}], indent=1))
    got = DS.read_json_array(spark, str(tmp_path / "p.json"), "pred string, gold string").collect()
    assert [(r.pred, r.gold) for r in got] == [("a", "b"), ("c\n", None)]


def test_template_lines_kinds_and_nest(spark, tmp_path):
    write(str(tmp_path), "t.txt", "select <select_condition> from my_table \n\nselect <text_col1> from my_table where <int_col1> = <int_1>\nselect ( [s1,s2] ) <op_and_value>\nselect ( [s1] ) <op> ( [s2] )\n")
    rows = {r.template: (r.kind, r.nest) for r in DS.read_templates(spark, str(tmp_path / "t.txt")).collect()}
    assert sorted(rows.values()) == [("coarse", 1), ("coarse", 2), ("coarse", 3), ("fine", 1)]
    assert DS.read_templates(spark, str(tmp_path / "t.txt"), nest=[2]).count() == 1


@pytest.mark.parametrize("n", [1, 9])
def test_text_pairs_stay_aligned(spark, tmp_path, n):
    rows = [(i, f"select {i}\nfrom t", None if i % 7 == 0 else f"answer {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "k int, sql string, answer string").repartition(n)
    a, b = DS.write_text_pairs(df, str(tmp_path / f"pairs{n}"), ["k"])
    lines = lambda p: [r.value for r in spark.read.text(p).withColumn("f", F.col("_metadata.file_name")).withColumn("i", F.monotonically_increasing_id()).orderBy("f", "i").collect()]
    sql, answer = lines(a), lines(b)
    assert len(sql) == len(answer) == 500
    assert all(s.split()[1] == (t.split() or ["", s.split()[1]])[-1] for s, t in zip(sql, answer, strict=True))
