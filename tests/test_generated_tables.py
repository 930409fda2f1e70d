"""Generated tables are made in place: none is joined with itself, so no table is broadcast, however small it looks before it is exploded."""

from conftest import SF
from pyspark.sql import functions as F

from tabqa.operators import generate as G
from tabqa.operators import render as M
from tabqa.session import pin
from tabqa.sources.tables import Tables

SHAPE = G.preset("long2k", row_min=2, row_max=9)


def test_tables_are_not_joined_with_themselves(spark):
    vocab = pin(G.vocabulary(Tables(spark, SF).documents, "text", 42), "vocabulary")
    draws = spark.range(20).select(F.explode(F.sequence(F.col("id") * 8, F.col("id") * 8 + 7)).alias("id"))
    for shape in (SHAPE, G.Shape(col_min=1, col_max=6, seed=3)):
        meta = G.table_meta(draws, "id", shape, vocab)
        rows = G.fill(meta, shape, ("header",))
        size = M.table_tokens(rows, meta)
        plan = size._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join Inner") == 1 and "widx" in plan.split("Join Inner", 1)[1]  # the words alone
        # The same numbers as by joins, and the same names and types as drawn one by one.
        assert sorted(map(tuple, size.collect())) == sorted(map(tuple, M.table_tokens(G.fill(meta, shape), meta).collect()))
        shp = G.shapes(draws, "id", shape)
        joined = shp.join(G.types(shp, shape), "table_id").join(G.headers(shp, vocab, shape.seed), "table_id").select("table_id", "header", "types", "n_rows", "n_cols")
        assert sorted(map(str, meta.drop("pools").collect())) == sorted(map(str, joined.collect()))


def test_generation_has_tasks_for_its_work(spark):
    meta = G.table_meta(spark.range(50), "id", SHAPE, None)
    assert G.fill(meta, SHAPE).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
