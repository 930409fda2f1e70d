"""Assembling benchmark instances from kept queries.

All steps are keyed by table: de-duplication is an aggregate, few-shot
assembly ranks at most ``per_table`` queries per table, and outputs are
written as JSON lines in a seeded (hash) order, not a driver shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabqa.functions.hashing import hk
from tabqa.session import ensure_checkpoint_dir, pin

KEY = ["table_id", "query_no"]


def dedup_first(kept: DataFrame) -> DataFrame:
    """Per table, keep the first query (lowest query_no) of each distinct SQL text.

    An aggregate (min per (table, sql)) plus a semi join, not a window.
    """
    first = kept.groupBy("table_id", "sql").agg(F.min("query_no").alias("query_no"))
    return kept.join(first.select(*KEY), KEY, "left_semi")


def few_shot(kept: DataFrame, n_shot: int, fields: tuple[str, ...] = ("sql", "answer")) -> DataFrame:
    """The first ``n_shot`` queries of a table are shared examples; every other
    query becomes a target with ``examples = [target] + shots``.  Tables with at
    most ``n_shot`` queries yield nothing.

    ``kept`` has table_id, query_no and the ``fields`` of an example.  The per-table
    window ranks the table's queries, which are bounded by the queries drawn per table.
    """
    w = Window.partitionBy("table_id").orderBy("query_no")
    ranked = kept.withColumn("rn", F.row_number().over(w))
    ex = F.struct("query_no", *fields)
    shots = ranked.where(F.col("rn") <= n_shot).groupBy("table_id").agg(
        F.transform(F.array_sort(F.collect_list(ex)), lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("shots"),
        F.count(F.lit(1)).alias("n_shots"),
    )
    targets = ranked.where(F.col("rn") > n_shot).select("table_id", "query_no", "rn", F.struct(*fields).alias("target"))
    return targets.join(shots.where(F.col("n_shots") == n_shot), "table_id").select(
        "table_id", "query_no", "rn", F.concat(F.array("target"), F.col("shots")).alias("examples")
    )


def cap(instances: DataFrame, num_queries: int, order: str = "rn") -> DataFrame:
    """At most ``num_queries`` instances per table, in order."""
    w = Window.partitionBy("table_id").orderBy(order)
    return instances.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= num_queries).drop("__k")


FT_FORMAT = "{}\nExecute this SQL based on the above table: {}"


def ft_pairs(kept: DataFrame, table_text: DataFrame) -> DataFrame:
    """Fine-tuning pairs {input, output, sql, answer}; input = table text + instruction + SQL."""
    pre, _, post = FT_FORMAT.partition("{}")
    mid, _, end = post.partition("{}")
    j = kept.join(table_text.select("table_id", "text"), "table_id")
    return j.select(
        *KEY,
        F.concat(F.lit(pre), F.col("text"), F.lit(mid), F.col("sql"), F.lit(end)).alias("input"),
        F.col("answer").alias("output"), "sql", "answer",
    )


def shuffled(df: DataFrame, seed, *cols: str) -> DataFrame:
    """Seeded global order (hash of the key), independent of partitioning."""
    return df.orderBy(hk(seed, "shuffle", *[F.col(c) for c in cols]), *cols)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint folder (shared on a cluster)."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/tabqa-{name}-{uuid.uuid4().hex}"


def write_jsonl(df: DataFrame, path: str, compression: str | None = None) -> None:
    """JSON lines; parallel part files, order kept within the written order; ``compression`` as Spark names it."""
    df.write.mode("overwrite").json(path, compression=compression)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, first_n: int | None = None, order: list[str] | None = None) -> DataFrame:
    """A4: read JSON lines with an explicit schema; optional first-N by a key order."""
    r = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    if first_n is not None:
        r = r.orderBy(*(order or r.columns[:1])).limit(first_n)
    return r


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """``file, element, text`` of every object in files that hold one JSON array of objects each.

    Files are read in byte ranges by many tasks, cut after every ``}``.  Whether such a piece
    starts inside a string is the parity of the quotes before it, and the brackets outside
    strings sum up to its depth; both are prefix sums, first over the ranges of a file (one
    row each), then within each.  An object ends where the depth is back at the array's.

    Elements that aren't objects are no rows; a file without an array, or an empty one, has none.
    """
    text = spark.read.option("lineSep", "}").text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    pieces = pin(text.select(*place, "value"), "json-pieces")
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    many = lambda s, chars: F.length(s) - F.length(F.translate(s, chars, ""))
    facts = pieces.select("file", "block", "at", many(bare, '"').alias("quotes"), bare.alias("bare"))

    def delta(s: Column) -> Column:
        outside = F.regexp_replace(s, '"[^"]*("|$)', "")
        return many(outside, "{[") - many(outside, "}]")

    inside = F.concat(F.lit('"'), F.col("bare"))
    facts = pin(facts.select("file", "block", "at", "quotes", delta(F.col("bare")).alias("out"), delta(inside).alias("in")), "json-facts")
    x = _prefix(facts, "quotes").withColumn("starts_in", F.pmod("before", F.lit(2)) == 1).withColumn("ends_in", F.pmod(F.col("before") + F.col("quotes"), F.lit(2)) == 1)
    closed = F.when(F.col("ends_in"), 0).otherwise(1)  # the bracket that the cut took away
    x = x.select("file", "block", "at", "ends_in", (F.when(F.col("starts_in"), F.col("in")).otherwise(F.col("out")) - closed).alias("d"))
    x = _prefix(x, "d").withColumn("ends", ((F.col("before") + F.col("d") == 1) & ~F.col("ends_in")).cast("int"))
    x = _prefix(x.select("file", "block", "at", "ends"), "ends").select("file", "block", "at", "ends", F.col("before").alias("element"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda p: F.concat(p["value"], F.lit("}")))
    whole = x.join(pieces, ["file", "block", "at"]).groupBy("file", "element").agg(F.array_join(parts, "").alias("text"), F.max("ends").alias("ends"))
    return whole.where("ends = 1").select("file", "element", F.regexp_replace("text", r"^[^{]*", "").alias("text"))


def _prefix(x: DataFrame, value: str) -> DataFrame:
    """``before``: sum of ``value`` over all earlier pieces of the file."""
    blocks = x.groupBy("file", "block").agg(F.sum(value).alias("__n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a byte range
    blocks = blocks.select("file", "block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__from"))
    within = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    y = x.join(blocks, ["file", "block"]).withColumn("before", F.col("__from") + F.coalesce(F.sum(value).over(within), F.lit(0)))
    return y.drop("__from")


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A5: one JSON array of objects per file; with a schema, a file is read by many tasks."""
    if schema is None:
        return spark.read.option("multiLine", True).json(path)
    return json_elements(spark, path).select(F.from_json("text", schema).alias("x")).select("x.*")


def write_text_pairs(df: DataFrame, path: str, order: list[str]) -> tuple[str, str]:
    """Target SQL and answer as two text outputs, aligned line by line.

    The pairs are written once, range-partitioned and sorted by ``order``; both texts
    come from that copy, so part files of one number hold the same rows in the same order.
    """
    line = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[\r\n]", " ")
    n = df.sparkSession.sparkContext.defaultParallelism
    keys = [F.col(c) for c in order]
    pairs = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select(F.col("sql"), F.col("answer").cast("string").alias("answer"))
    copy = f"{path}/pairs"
    pairs.select(line(F.col("sql")).alias("sql"), line(F.col("answer")).alias("answer")).write.mode("overwrite").parquet(copy)
    written = df.sparkSession.read.parquet(copy)
    a, b = f"{path}/sql", f"{path}/answer"
    written.select(F.col("sql").alias("value")).write.mode("overwrite").text(a)
    written.select(F.col("answer").alias("value")).write.mode("overwrite").text(b)
    return a, b


def read_templates(spark: SparkSession, path: str, nest: list[int] | None = None) -> DataFrame:
    """Template lines, stripped; fine if they use int/text column slots, else coarse;
    nest level = number of '(' + 1; optional filter on nest levels (K15)."""
    t = spark.read.text(path).select(F.trim("value").alias("template")).where(F.col("template") != "")
    t = t.select(
        "template",
        F.when(F.col("template").contains("int_col") | F.col("template").contains("text_col"), "fine").otherwise("coarse").alias("kind"),
        (F.length("template") - F.length(F.replace("template", F.lit("("), F.lit(""))) + 1).alias("nest"),
    )
    return t.where(F.col("nest").isin(nest)) if nest else t
