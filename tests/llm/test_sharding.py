"""Jump consistent hashing against its published loop, and gapless slots."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tabqa.llm import plans, sharding
from tabqa.session import ensure_checkpoint_dir


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.FACTOR + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jumps_follow_the_published_loop(spark):
    r = random.Random(1)
    keys = [0, 1, 2**63, 2**64 - 1, 2**32 - 1, 2**32] + [r.getrandbits(64) for _ in range(1500)]
    df = spark.createDataFrame([(i, k >> 32, k & 0xFFFFFFFF) for i, k in enumerate(keys)], "i int, hi bigint, lo bigint")
    counts = [1, 2, 16, 17, 500]
    got = df.select("i", sharding.jump(F.col("hi"), F.col("lo"), counts).alias("x")).select("i", "x.*").collect()
    assert {x.i: tuple(x)[1:] for x in got} == {i: tuple(jump(k, n) for n in counts) for i, k in enumerate(keys)}
    with pytest.raises(Exception, match="not settled"):
        df.select(sharding.jump(F.col("hi"), F.col("lo"), [10**9], 3)).collect()


def rows():
    r = random.Random(2)
    out = [(i, "word " * r.randint(0, 30) + "é" * (i % 3)) for i in range(900)]
    return out + [(None, f"null {i}") for i in range(60)] + [(None, None)] * 300 + [(7, "same")] * 500 + [(901, ""), (902, None), (903, "long " * 100000), (904, "🎉")]


@pytest.mark.parametrize("p", [sharding.ShardParams(), sharding.ShardParams(shards=3, more=2, cell_rows=20, chunk=40), sharding.ShardParams(shards=1)])
def test_slots_have_no_gaps_and_growth_moves_rows_to_new_shards_only(spark, p):
    df = spark.createDataFrame(rows(), "doc_id bigint, text string").selectExpr("*", "1 as shard", "2 as slot", "3 as size", "4 as id", "5 as copies")
    got = sharding.place(df, p).collect()
    b = lambda t: (t or "").encode()
    assert sorted(((r.id, r.size, r.text_crc32) for r in got), key=str) == sorted(((i, len(b(t)) + 1, zlib.crc32(b(t))) for i, t in rows()), key=str)
    by, of = {}, {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        of.setdefault(r.id, set()).add((r.shard, r.grown_shard))
        assert r.grown_shard == r.shard or r.grown_shard >= p.shards
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and all(len(s) == 1 for s in of.values())
    assert set(by) == set(range(p.shards))
    again = sharding.place(df.repartition(7), p).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)
    assert sharding.place(df.limit(0), p).count() == 0


def test_files_by_shard(spark):
    import uuid

    df = spark.createDataFrame(rows(), "doc_id bigint, text string").withColumn("grown_shard", F.lit("x"))
    path = f"{ensure_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    sharding.write(df, path)
    back = spark.read.parquet(path)
    assert back.count() == len(rows())
    want = sharding.assign(df.select("doc_id"), ["doc_id"]).distinct()
    assert back.select("doc_id", "shard").distinct().exceptAll(want.select("doc_id", "shard")).count() == 0
    moved = sharding.moved(sharding.assign(spark.range(20000).withColumnRenamed("id", "doc_id"), ["doc_id"])).collect()
    assert {r.grown_shard for r in moved} == {16} and abs(sum(r.rows for r in moved) / 20000 - 1 / 17) < 0.01


def test_query_names_its_law(spark, sf="/root/testdata/sf0.001"):
    got = plans.op13_shard(spark, sf)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and got.select("law").distinct().collect()[0][0] == "key"
