"""Occurrences of a text held against Python, and JSON arrays read in byte ranges held against ``json``."""

import json
import random

from pyspark.sql import functions as F

from tabqa.functions import text as T
from tabqa.operators import datasets as DS


def nth(s, sub, new, n):
    if s is None or not 1 <= n <= s.count(sub):
        return None
    at = -len(sub)
    for _ in range(n):
        at = s.find(sub, at + len(sub))
    return s[:at] + new + s[at + len(sub) :]


def test_occurrences(spark):
    cases = [(s, sub, n) for s in ("", "aaaa", "xaayaaz", "a.b.c.", r"\E\Q\E", "žaža", None) for sub in ("a", "aa", ".", r"\E", "ža") for n in range(4)]
    df = spark.createDataFrame(cases, "s string, sub string, n int")
    s, sub = F.col("s"), F.col("sub")
    got = df.select("s", "sub", "n", T.count_of(s, sub).alias("c"), T.replace_nth(s, sub, F.lit("<a>"), F.col("n")).alias("v")).collect()
    for r in got:
        assert r.c == (None if r.s is None else r.s.count(r.sub)) and r.v == nth(r.s, r.sub, "<a>", r.n), r
    empty = df.limit(1).select(T.count_of(F.lit("ab"), F.lit("")).alias("c")).first()
    assert empty.c is None or empty.c < 0


def test_replacements_one_after_the_other(spark):
    rows = [("? and ?", ["x?", "y"]), ("? and ?", ["x"]), ("none", []), (None, ["x"])]
    df = spark.createDataFrame(rows, "s string, news array<string>")
    got = [r[0] for r in df.select(T.replace_each(F.col("s"), F.lit("?"), F.col("news"))).collect()]
    assert got == ["xy and ?", None, "none", None]  # the first place left may lie in what was put before


def test_range(spark):
    rows = [(s, a, b) for s in ("eeee", "čečeče", "", None) for a in range(5) for b in range(7)]
    df = spark.createDataFrame(rows, "s string, a int, b int")
    got = df.select("s", "a", "b", T.replace_range(F.col("s"), F.col("a"), F.col("b"), F.lit("e"), F.lit("xx")).alias("v")).collect()
    assert all(r.v == (None if r.s is None else r.s[: r.a] + r.s[r.a : r.b].replace("e", "xx") + r.s[r.b :]) for r in got)


def test_arrays_are_read_by_many_tasks(spark, tmp_path):
    rnd = random.Random(1)
    parts = ["}", "{", "[", "]", '"', "\\", ",", "\n", "é", "x y", '\\"}', "}}"]
    word = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
    items = [{"id": i, "text": word(), "inner": {"a": [{"b": word()} for _ in range(rnd.randint(0, 3))]}} for i in range(1500)]
    (tmp_path / "one.json").write_text(json.dumps(items, indent=4, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "two.json").write_text(json.dumps(items[:3]))
    (tmp_path / "none.json").write_text(" [ ]\n")
    (tmp_path / "empty.json").write_text("")
    keys = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "one.json")).rdd.getNumPartitions() > 5
        schema = "id bigint, text string, inner struct<a: array<struct<b: string>>>"
        got = [r.asDict(recursive=True) for r in DS.read_json_array(spark, str(tmp_path), schema).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got, key=lambda r: (r["id"], r["text"])) == sorted(items + items[:3], key=lambda r: (r["id"], r["text"]))
    plain = spark.read.schema(schema).option("multiLine", True).json(str(tmp_path / "one.json"))
    assert plain.count() == 1500
