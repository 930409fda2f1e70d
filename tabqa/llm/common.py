"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the corpus: a run of anything but ASCII white space (one pattern for Java, Python and RE2).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(module: str) -> None:
    """Send a module's functions to the workers with each job, so that the package need not be installed there."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module])


def bounded_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The ``n`` rows of the smallest hashes of ``keys``, all rows if fewer.

    The limit is found on hashes alone, so wide rows move only once they are chosen.
    """
    x = df.withColumn("_at", F.xxhash64(*keys))
    last = x.select("_at").orderBy("_at").limit(n).agg(F.max("_at")).first()[0]
    return x.where(F.col("_at") <= F.lit(last)).orderBy("_at").limit(n).drop("_at")
