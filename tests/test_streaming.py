"""Streaming scoring agrees with the batch scoring on the same predictions."""

import os
import tempfile

from pyspark.sql import functions as F

from tabqa.operators import scoring as O
from tabqa.plans import scoring as PS
from tabqa.sources.tables import Tables
from tabqa.streaming.scoring import running_accuracy

from conftest import SF


def test_stream_matches_batch(spark):
    preds = PS.predictions(spark, SF).select("model_id", "conv_id", "turn", "pred", "gold")
    gold = Tables(spark, SF).conversations.select("conv_id", "turn", F.col("text").alias("gold"))
    d = tempfile.mkdtemp(prefix="tabqa-stream-")
    for m in (1, 2):  # two arrival batches
        preds.where(F.col("model_id").between(4 * m - 3, 4 * m)).drop("gold").write.json(os.path.join(d, "in", f"b{m}"))
    out = os.path.join(d, "acc")
    q = running_accuracy(
        spark, os.path.join(d, "in", "*"), gold, lambda batch, _: batch.write.mode("overwrite").parquet(out), os.path.join(d, "chk")
    )
    q.awaitTermination(300)
    got = {r.model_id: (round(r.acc, 6), r.n) for r in spark.read.parquet(out).collect()}
    batch = O.accuracy(preds.select("model_id", O.exact_match(F.col("pred"), F.col("gold")).alias("em")), ["model_id"])
    want = {r.model_id: (r.acc, r.n) for r in batch.collect()}
    assert got == want
