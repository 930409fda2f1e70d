"""Tasks of the near-duplicate operator hold few texts at once, whatever the batches are."""

import pyarrow as pa

from tabqa.llm import minhash


def test_batches_are_taken_in_small_blocks():
    batches = [pa.RecordBatch.from_pydict({"text": [f"{k} {i}" for i in range(n)]}) for k, n in enumerate((2_500, 0, 7))]
    blocks = list(minhash._blocks(iter(batches), minhash.NearDupParams().slice_rows))
    assert max(b.num_rows for b in blocks) <= 1_000
    assert [t for b in blocks for t in b.column("text").to_pylist()] == [t for b in batches for t in b.column("text").to_pylist()]
    assert list(minhash._blocks(iter([]), 10)) == []


def test_signatures_do_not_depend_on_blocks(spark):
    df = spark.range(300).selectExpr("id", "cast(cast(id as string) as binary) as node", "repeat(concat('w', id % 7, ' x', id, ' '), cast(id % 40 as int)) as text").coalesce(1)
    by = [sorted((r.id, r["values"]) for r in minhash.sketch(df, minhash.NearDupParams(slice_rows=n, memo_words=m)).collect()) for n, m in ((1_000, 200_000), (7, 20))]
    assert by[0] == by[1] and len(by[0]) == 300
