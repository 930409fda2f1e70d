"""The pipeline against a brute-force version on the smallest tables."""

import re

import corpus_pipeline as CP
import pytest
from test_documents_ops import brute_classes, brute_scan

from tabqa.llm import plans, toxicity
from tabqa.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, each stage fed with what the one before it kept."""
    docs = table(spark, SF, "documents")
    out = [docs]
    for name, stage in CP.STAGES[:-1]:
        out.append(CP.pin(stage(spark, out[-1], SF), f"test-{name}"))
        assert out[-1].columns == docs.columns
    return out


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_toxic_documents_go(spark, stages):
    before, after = stages[:2]
    model = toxicity.fit(before, toxicity.learnable(table(spark, SF, "labels")))
    p = toxicity.ToxicityParams()
    assert ids(after) == sorted(r.doc_id for r in before.collect() if model.score(r.text, p)[0] < p.threshold)


def test_one_document_of_each_class_stays(stages):
    before, after = stages[1:3]
    classes = brute_classes([(r.doc_id, r.text) for r in before.collect()])
    assert ids(after) == sorted({c[1] for c in classes})


def test_documents_with_benchmark_passages_go(spark, stages):
    before, after = stages[2:4]
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert ids(after) == sorted(r.doc_id for r in before.collect() if not brute_scan(r.text, bench)[1])


def test_mix_meets_its_targets(spark, stages):
    rows = CP.run(spark, SF).collect()
    left = {r.doc_id: r for r in stages[3].collect()}
    assert sorted(r.doc_id for r in rows) == sorted(left)
    taken, target = {}, {}
    for r in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", left[r.doc_id].text or ""))
        assert r["size"] == size and 0 <= r.taken <= 2 * size and r.source == left[r.doc_id].source
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 64 for s in taken)
    total = sum(r["size"] for r in rows)
    assert sum(target.values()) == pytest.approx(1.5 * total)


def test_stages_take_empty_tables_nulls_and_more_columns(spark, stages):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 0), (1, None, "en", None, 0), (2, "", None, "s", None)], stages[0].schema)
    odd = odd.selectExpr("*", "1 as node", "'x' as id", "2 as spans", "3 as size")
    for name, stage in CP.STAGES:
        out = stage(spark, odd, SF)
        assert name == "mix" or out.columns == odd.columns
        assert out.count() == (1 if name == "near_duplicates" else 4)  # null and empty texts are one class
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_every_query_is_registered():
    assert [n for n, _ in CP.STAGES] == ["toxicity", "near_duplicates", "decontaminate", "mix"] and CP.ORACLE_SQL is None
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in plans.QUERIES) == list(range(1, 11))
    assert set(plans.ORACLES) <= set(plans.QUERIES)
