"""Answers that are not read are not put together, and lines that repeat a table are compressed."""

import glob

from conftest import SF

from tabqa.operators import batch as B
from tabqa.operators import datasets as DS
from tabqa.plans import QUERIES, load_all, shared


def test_only_single_answers_are_put_together(spark, monkeypatch):
    load_all()
    calls, join = [], B._join_specs
    monkeypatch.setattr(B, "_join_specs", lambda *a: calls.append(a[1].count()) or join(*a))
    monkeypatch.setattr(shared, "_MEMO", {})
    got = QUERIES["exec_answer_count"](spark, SF).collect()
    assert len(calls) == 2 and calls[1] <= len(got) < calls[0] / 2
    every = QUERIES["exec_batch_all"](spark, SF).where("n_ans_rows = 1").collect()
    assert sorted(map(str, got)) == sorted(map(str, every)) and got


def test_result_lines_are_compressed(spark, monkeypatch, tmp_path):
    load_all()
    monkeypatch.setattr(DS, "scratch_path", lambda *a: str(tmp_path / "lines"))
    got = QUERIES["snk_results_full"](spark, SF)
    files = glob.glob(str(tmp_path / "lines" / "part-*"))
    assert files and all(f.endswith(".json.gz") for f in files)
    assert got.where("contents is null or sql is null or gold is null").count() == 0 and got.count() > 0
