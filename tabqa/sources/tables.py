"""Reading tables and describing their columns (A1, A2)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabqa.functions.indexing import row_index
from tabqa.session import pin
from tabqa.sources.corpus import REAL_TYPE, Corpus

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Lazy access to the parquet tables of one data folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.root, f"{name}.parquet"))


# Role of a column for query drawing: text (TEXT/DATE), num (INT/INTEGER), real.
def role_of(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "num"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "real"
    if isinstance(dtype, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
        return "text"
    return "other"


def roles(df: DataFrame) -> dict[str, list[str]]:
    """Split columns by role from the schema (no data is read)."""
    out: dict[str, list[str]] = {"text": [], "num": [], "real": [], "other": []}
    for f in df.schema.fields:
        out[role_of(f.dataType)].append(f.name)
    return out


def role_profile(df: DataFrame) -> DataFrame:
    """Long-form profile: one row per column with its role, non-null count and distinct count.

    The table is unpivoted into (col, value) and aggregated twice; both
    aggregations are partial (map-side) so the shuffle carries at most one
    row per (column, distinct value) per task.
    """
    cols = [f.name for f in df.schema.fields]
    role_rows = [(f.name, i, role_of(f.dataType)) for i, f in enumerate(df.schema.fields)]
    long = df.select([F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "col_name", "value"
    )
    per_value = long.where(F.col("value").isNotNull()).groupBy("col_name", "value").agg(F.count(F.lit(1)).alias("c"))
    prof = per_value.groupBy("col_name").agg(
        F.sum("c").cast("bigint").alias("n_values"), F.count(F.lit(1)).alias("n_distinct")
    )
    meta = df.sparkSession.createDataFrame(role_rows, "col_name string, col_idx int, role string")
    return (
        F.broadcast(meta)
        .join(prof, "col_name", "left")
        .select(
            "col_name",
            "col_idx",
            "role",
            F.coalesce("n_values", F.lit(0)).cast("bigint").alias("n_values"),
            F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct"),
        )
    )


INTEGER_PATTERN = r"^[+-]?[0-9]+$"


def infer_types(df: DataFrame) -> DataFrame:
    """Type inference over text columns as one aggregate (A2).

    A column is INTEGER when every non-null value is an optionally signed
    digit string (what a CSV reader infers as int64), REAL when
    every value casts to DOUBLE, else TEXT.  One pass, partial aggregation,
    one output row per column.
    """
    cols = [f.name for f in df.schema.fields]
    s = df.select([F.col(c).cast("string").alias(c) for c in cols])
    aggs = []
    for c in cols:
        v = F.trim(F.col(c))
        aggs.append(F.bool_and(F.when(v.isNotNull(), v.rlike(INTEGER_PATTERN))).alias(f"i__{c}"))
        aggs.append(F.bool_and(F.when(v.isNotNull(), F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)").isNotNull())).alias(f"r__{c}"))
    wide = s.agg(*aggs)
    stack = ", ".join(f"'{c}', {i}, `i__{c}`, `r__{c}`" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {stack}) AS (col_name, col_idx, is_int, is_real)").select(
        "col_name",
        F.col("col_idx").cast("int").alias("col_idx"),
        F.when(F.coalesce("is_int", F.lit(False)), "INTEGER")
        .when(F.coalesce("is_real", F.lit(False)), "REAL")
        .otherwise("TEXT")
        .alias("col_type"),
    )


def read_csv_folder(spark: SparkSession, path: str) -> Corpus:
    """CSV folder ingest, one table per file (A2).

    Files may differ in their columns: values are read by position as text,
    into as many positions as any line has fields at most, and a file's first line
    names its own.  The type of a (file, column) comes from its values, as in
    ``infer_types``: INT, REAL or TEXT; empty values are NULL.  ``tables`` has the file's path as
    ``source_file``; table ids number the paths in order.
    """
    commas = F.length("value") - F.length(F.replace("value", F.lit(","), F.lit("")))
    width = (spark.read.text(path).agg(F.max(commas)).first()[0] or 0) + 1
    fields = [f"_c{i}" for i in range(width)]
    raw = spark.read.schema(", ".join(f"{c} string" for c in fields)).option("header", False).option("escape", "\"").csv(path)
    raw = raw.select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.array(*fields).alias("cells"),
    )
    raw = pin(raw, "csv")  # numbered once
    numbered = row_index(raw, ["source_file"], ["block", "at"], out="line")
    n_named = F.size("cells") - F.coalesce(F.array_position(F.transform(F.reverse("cells"), lambda c: c.isNotNull()), True), F.size("cells") + 1) + 1
    heads = numbered.where("line = 0").select("source_file", F.slice("cells", 1, n_named.cast("int")).alias("header"))
    heads = pin(row_index(heads, [], ["source_file"], out="table_id"), "csv-headers")
    rows = numbered.where("line > 0").join(heads, "source_file").select(
        "table_id", (F.col("line") - 1).alias("row_idx"), F.slice("cells", 1, F.size("header")).alias("cells")
    )
    v = F.trim(F.col("v"))
    kinds = rows.select("table_id", F.posexplode("cells").alias("j", "v")).groupBy("table_id", "j").agg(
        F.bool_and(F.when(v.isNotNull(), v.rlike(INTEGER_PATTERN))).alias("i"), F.bool_and(F.when(v.isNotNull(), v.try_cast("double").isNotNull())).alias("r")
    )
    kind = F.when(F.coalesce("i", F.lit(False)), "INT").when(F.coalesce("r", F.lit(False)), "REAL").otherwise("TEXT")
    types = kinds.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", kind.alias("t")))), lambda s: s["t"]).alias("types"))
    sizes = rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_rows"))
    tables = heads.join(types, "table_id", "left").join(sizes, "table_id", "left").select(
        "table_id", "header", F.coalesce("types", F.transform("header", lambda _: F.lit("TEXT"))).alias("types"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.size("header").alias("n_cols"), "source_file",
    )
    rows = rows.join(tables.select("table_id", "types"), "table_id")
    nums = F.transform("cells", lambda c, j: F.when(F.get("types", j).isin("INT", "REAL"), F.trim(c).try_cast(REAL_TYPE)))
    return Corpus(rows.select("table_id", "row_idx", "cells", nums.alias("nums")), tables)
