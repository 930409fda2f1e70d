"""Scoring predictions as they arrive (Structured Streaming).

Prediction files (JSON lines: model_id, instance key, pred) land in a folder;
each micro-batch is joined to the static gold table (stream-static join)
and scored with the same exact-match expression as the batch path.  The
running accuracy per model is stateful (one small state row per model), so
complete output mode is bounded by the number of models.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabqa.operators.scoring import exact_match

PRED_SCHEMA = "model_id INT, conv_id BIGINT, turn BIGINT, pred STRING"


def scored_stream(spark: SparkSession, pred_dir: str, gold: DataFrame, key=("conv_id", "turn")) -> DataFrame:
    """Streaming DataFrame of (model_id, key..., em)."""
    preds = spark.readStream.schema(PRED_SCHEMA).json(pred_dir)
    j = preds.join(gold, list(key))
    return j.select("model_id", *key, exact_match(F.col("pred"), F.col("gold")).alias("em"))


def running_accuracy(
    spark: SparkSession,
    pred_dir: str,
    gold: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Start a query that hands accuracy and count per model to ``sink(batch, batch_id)`` after each micro-batch.

    The batch is the complete state, one row per model; the caller's sink writes it
    where it likes, so nothing gathers in the driver.
    """
    s = scored_stream(spark, pred_dir, gold)
    acc = s.groupBy("model_id").agg(F.avg("em").alias("acc"), F.count(F.lit(1)).alias("n"))
    w = acc.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
