"""Row numbering must not depend on the hot-group split."""

from pyspark.sql import functions as F

from tabqa.functions.indexing import row_index


def test_hot_and_cold_paths_agree(spark):
    df = spark.range(0, 5000).select(
        (F.when(F.col("id") < 4000, F.lit(1)).otherwise(F.col("id") % 7)).alias("g"), F.col("id").alias("k")
    )
    cold = {(r.g, r.k): r.row_idx for r in row_index(df, ["g"], ["k"]).collect()}
    hot = {(r.g, r.k): r.row_idx for r in row_index(df, ["g"], ["k"], hot_rows=1000, partitions=6).collect()}
    assert cold == hot
    # dense 0..n-1 per group
    by_g = {}
    for (g, _), i in hot.items():
        by_g.setdefault(g, []).append(i)
    assert all(sorted(v) == list(range(len(v))) for v in by_g.values())


def test_global_index(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = sorted((r.k, r.row_idx) for r in row_index(df, [], ["k"]).collect())
    assert got == [(k, k) for k in range(1000)]
