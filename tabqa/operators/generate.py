"""Synthetic table corpora as column expressions.

No driver loops: the tables to generate are rows of a driving DataFrame
(one synthetic table per row), every cell is a hash of a key naming it, and
rows are produced by exploding row ranges.  Output is a ``Corpus``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabqa.functions.hashing import h, hk, key, uniform_int, unit, weighted_choice
from tabqa.functions.indexing import row_index
from tabqa.sources.corpus import DATE, INT, TEXT, Corpus

# Fixed values that must equal the reference's.
SQL_KEYWORDS = [
    "select", "insert", "update", "delete", "create", "alter", "drop", "truncate", "from", "where",
    "join", "on", "group by", "order by", "having", "distinct", "as", "case", "when", "then", "else",
    "end", "and", "or", "not", "null", "is", "in", "between", "like", "exists", "count", "sum", "avg",
    "max", "min", "union", "intersect", "except", "commit", "rollback", "savepoint", "grant", "revoke",
    "index", "constraint", "primary key", "group", "foreign", "primary", "key", "foreign key",
    "references", "unique", "check", "default", "order", "values", "limit",
]
# Pool sizes of the text-repetition modes, in the reference's order:
# single, double, triple, 4th, 5th, 6th, 8th, 10th, 15th, random (0 = all random).
POOL_SIZES = [1, 2, 3, 4, 5, 6, 8, 10, 15, 0]
INT_RANGE = (2, 327)
BIG_INT_RANGE = (2, 1000)
REAL_CENTS = (110, 2000)  # 1.10 .. 20.00
DATE_START, DATE_END = "2001-02-13", "2023-08-31"  # end excluded
WORD_LEN = (4, 9)
COLUMN_NAME_LEN = (3, 8)


@dataclass(frozen=True)
class Shape:
    """Table shape parameters (the reference's database config)."""

    col_min: int = 8
    col_max: int = 8
    row_min: int = 15
    row_max: int = 15
    type_weights: tuple = (0.5, 0.4, 0.1)  # TEXT, INT, DATE
    repeat_weights: tuple = (0, 0.2, 0.3, 0, 0, 0, 0, 0, 0, 0.5)
    seed: int = 42
    type_attempts: int = 24
    chunk_rows: int = 100_000


# Presets.  long* keep 5 all-random TEXT columns.
PRESETS: dict[str, Shape] = {
    "default": Shape(),
    "general": Shape(type_weights=(0.5, 0.45, 0.05), repeat_weights=(0, 0, 0, 0, 0, 0, 0, 0, 0, 1)),
    "easy": Shape(type_weights=(0.5, 0.45, 0.05), repeat_weights=(0, 0, 0, 0, 0, 0, 0, 0, 0, 1)),
    **{
        name: Shape(col_min=5, col_max=5, row_min=rows, row_max=rows, type_weights=(1, 0, 0),
                    repeat_weights=(0, 0, 0, 0, 0, 0, 0, 0, 0, 1))
        for name, rows in [("long2k", 30), ("long4k", 65), ("long8k", 140), ("long16k", 290),
                           ("long32k", 600), ("long64k", 1200), ("long128k", 2400)]
    },
}


def preset(name: str, **overrides) -> Shape:
    return replace(PRESETS[name], **overrides)


# ---------------------------------------------------------------- cells


# The digits of ``conv`` in base 26 and the letters they stand for.
_DIGITS, _LETTERS = "0123456789ABCDEFGHIJKLMNOP", "abcdefghijklmnopqrstuvwxyz"


def word(k: Column) -> Column:
    """4-9 lowercase letters from one MD5 (B8): 60 bits read as base-26 digits, lowest first.

    The digest is bound once (one element of an array), since expressions inside
    a higher-order function are not shared otherwise.
    """

    def spelt(d: Column) -> Column:
        digits = F.reverse(F.translate(F.conv(F.substring(d, 1, 15), 16, 26), _DIGITS, _LETTERS))
        n = F.lit(WORD_LEN[0]) + F.pmod(F.conv(F.substring(d, 16, 8), 16, 10).cast("bigint"), F.lit(WORD_LEN[1] - WORD_LEN[0] + 1))
        return F.rpad(digits, 13, "a").substr(F.lit(1), n.cast("int"))

    return F.get(F.transform(F.array(F.md5(k)), spelt), F.lit(0))


def int_cell(k: Column, big: bool = False) -> Column:
    lo, hi = BIG_INT_RANGE if big else INT_RANGE
    return uniform_int(k, lo, hi)


def real_cell(k: Column) -> Column:
    """Uniform 1.10..20.00 on a cent grid, as 2-decimal text."""
    cents = uniform_int(k, REAL_CENTS[0], REAL_CENTS[1])
    return F.format_string("%.2f", cents / F.lit(100.0))


def date_cell(k: Column) -> Column:
    """Date in [2001-02-13, 2023-08-31) as text."""
    span = F.datediff(F.lit(DATE_END).cast("date"), F.lit(DATE_START).cast("date"))
    return F.date_format(F.date_add(F.lit(DATE_START).cast("date"), F.pmod(h(k), span).cast("int")), "yyyy-MM-dd")


def dob_cell(k: Column, age: Column, ref_date: str) -> Column:
    """Birth date for an age on ``ref_date`` (B7): in [ref - 365(age+1), ref - 365 age)."""
    back = F.lit(365) * (age + 1) - F.pmod(h(k), F.lit(365))
    return F.date_format(F.date_sub(F.lit(ref_date).cast("date"), back.cast("int")), "yyyy-MM-dd")


def instant_between(k: Column, start: Column, end: Column) -> Column:
    """Uniform instant in [start, end) at second resolution."""
    a, b = F.unix_timestamp(start), F.unix_timestamp(end)
    return F.timestamp_seconds(a + F.pmod(h(k), F.greatest(b - a, F.lit(1))))


def pool_mode(seed, table_id: Column, col: Column, shape: Shape) -> Column:
    """Pool size of a text column: 0 means every cell random."""
    return weighted_choice(key(seed, table_id, col, "mode"), POOL_SIZES, shape.repeat_weights)


def text_cell(seed, table_id: Column, col: Column, row: Column, pool: Column) -> Column:
    """Cell of a cardinality-controlled text column (B9); the pool is never materialised."""
    slot = F.pmod(hk(seed, table_id, col, row, "slot"), F.greatest(pool, F.lit(1)))
    return word(F.when(pool > 0, key(seed, table_id, col, "pool", slot)).otherwise(key(seed, table_id, col, row, "cell")))


# ---------------------------------------------------------------- tables


def shapes(driver: DataFrame, id_col: str, shape: Shape) -> DataFrame:
    """One synthetic table per driver row with drawn sizes (B1)."""
    tid = F.col(id_col).cast("bigint")
    return driver.select(tid.alias("table_id")).select(
        "table_id",
        uniform_int(key(shape.seed, F.col("table_id"), "ncols"), shape.col_min, shape.col_max).cast("int").alias("n_cols"),
        uniform_int(key(shape.seed, F.col("table_id"), "nrows"), shape.row_min, shape.row_max).cast("bigint").alias("n_rows"),
    )


def vocabulary(texts: DataFrame, text_col: str, seed) -> DataFrame:
    """Column-name vocabulary mined from a text column (B2).

    Words of 3-8 ASCII letters, lowercased, minus SQL keywords; numbered
    0..V-1 in hashed order so consecutive indices are unrelated words.
    """
    lo, hi = COLUMN_NAME_LEN
    words = (
        texts.select(F.explode(F.split(F.lower(F.col(text_col)), "[^a-z]+")).alias("word"))
        .where(F.length("word").between(lo, hi))
        .distinct()
    )
    kw = texts.sparkSession.createDataFrame([(w,) for w in SQL_KEYWORDS], "word string")
    words = words.join(F.broadcast(kw), "word", "left_anti")
    words = words.withColumn("__o", hk(seed, "vocab", F.col("word")))
    return row_index(words, [], ["__o", "word"], out="widx").select("word", "widx")


BROADCAST_WORDS = 200_000


def headers(shp: DataFrame, vocab: DataFrame, seed, carried: Sequence[str] = ()) -> DataFrame:
    """Distinct column names per table: consecutive words of the hashed vocabulary (B2); ``carried`` columns of ``shp`` go along."""
    n_vocab = vocab.count()  # scalar; names are unique while n_cols <= n_vocab
    key_cols = ["table_id", *carried]
    cols = shp.select(
        *key_cols,
        F.posexplode(F.array_repeat(F.lit(0), F.col("n_cols"))).alias("j", "__z"),
    ).select(
        *key_cols,
        "j",
        F.pmod(hk(seed, F.col("table_id"), "header") + F.col("j"), F.lit(n_vocab)).alias("widx"),
    )
    v = F.broadcast(vocab) if n_vocab <= BROADCAST_WORDS else vocab
    named = cols.join(v, "widx")
    return named.groupBy(*key_cols).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "word"))), lambda s: s["word"]).alias("header")
    )


def _type_draw(seed, tid: Column, attempt: int, j: Column, shape: Shape) -> Column:
    return weighted_choice(key(seed, tid, "type", attempt, j), [TEXT, INT, DATE], shape.type_weights)


def types(shp: DataFrame, shape: Shape) -> DataFrame:
    """``table_id, types`` of ``drawn_types``."""
    return shp.select("table_id", drawn_types(shape).alias("types"))


def drawn_types(shape: Shape) -> Column:
    """Column types of a table (B3), from its ``table_id`` and ``n_cols``.

    Needs at least one TEXT and one INT unless two weights are zero.  The
    reference redraws until it holds; here attempts are drawn one after the
    other, the first valid one is kept, and a table without any walks its
    columns with the weights that a valid rest gives them — the same
    conditional distribution.  One column cannot hold both types; it is drawn freely.
    """
    seed = shape.seed
    waived = sum(1 for w in shape.type_weights if w == 0) == 2
    tid = F.col("table_id")
    seq = F.sequence(F.lit(0), F.col("n_cols") - 1)

    def attempt(a):
        return F.transform(seq, lambda j: _type_draw(seed, tid, a, j, shape))

    if waived:
        return attempt(0)
    valid = lambda t: F.array_contains(t, TEXT) & F.array_contains(t, INT)
    drawn = F.coalesce(*[F.get(F.filter(F.array(attempt(a)), valid), F.lit(0)) for a in range(shape.type_attempts)], _walk(seed, tid, seq, shape))
    return F.when(F.col("n_cols") < 2, attempt(0)).otherwise(drawn)


def _walk(seed, tid: Column, seq: Column, shape: Shape) -> Column:
    """Types drawn column by column, each weighted by the chance that the rest makes the table valid."""
    total = sum(shape.type_weights)
    p_text, p_int, p_date = (w / total for w in shape.type_weights)

    def chance(has_text: Column, has_int: Column, left: Column) -> Column:
        no_text, no_int, neither = (F.pow(F.lit(1 - p_text), left), F.pow(F.lit(1 - p_int), left), F.pow(F.lit(p_date), left))
        return F.when(has_text & has_int, 1.0).when(has_text, 1 - no_int).when(has_int, 1 - no_text).otherwise(1 - no_text - no_int + neither)

    def step(a: Column, j: Column) -> Column:
        left = F.size(seq) - 1 - j
        text = F.lit(p_text) * chance(F.lit(True), a["i"], left)
        number = F.lit(p_int) * chance(a["t"], F.lit(True), left)
        date = F.lit(p_date) * chance(a["t"], a["i"], left)
        u = unit(key(seed, tid, "type", "walk", j)) * (text + number + date)
        pick = F.when(u < text, TEXT).when(u < text + number, INT).otherwise(DATE)
        return F.get(F.transform(F.array(pick), lambda t: F.struct((a["t"] | (t == TEXT)).alias("t"), (a["i"] | (t == INT)).alias("i"), F.concat(a["out"], F.array(t)).alias("out"))), F.lit(0))

    start = F.struct(F.lit(False).alias("t"), F.lit(False).alias("i"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(seq, start, step, lambda a: a["out"])


def table_meta(driver: DataFrame, id_col: str, shape: Shape, vocab: DataFrame | None) -> DataFrame:
    """tables(table_id, header, types, n_rows, n_cols, pools) for a synthetic corpus.

    Without a vocabulary the header is left NULL (enough to generate rows).  All but the
    header is worked out in place: a table is not joined with itself, so nothing of the tables is broadcast."""
    t = shapes(driver, id_col, shape)
    if vocab is not None:
        t = headers(t, vocab, shape.seed, ("n_cols", "n_rows"))
    else:
        t = t.withColumn("header", F.lit(None).cast("array<string>"))
    pools = F.transform(
        F.sequence(F.lit(0), F.col("n_cols") - 1), lambda j: pool_mode(shape.seed, F.col("table_id"), j, shape)
    )
    return t.select("table_id", "header", drawn_types(shape).alias("types"), "n_rows", "n_cols", pools.alias("pools"))


def fill(meta: DataFrame, shape: Shape, carried: Sequence[str] = ()) -> DataFrame:
    """Rows of every table (B10), with ``carried`` columns of ``meta``.

    Row ranges are exploded in two steps, chunks first and rows inside a
    chunk after a repartition, so one huge table is generated by many tasks.
    Their number is given, since the few bytes of a chunk do not show the work in it.
    """
    seed, spark = shape.seed, meta.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunk = shape.chunk_rows
    n_chunks = F.floor((F.col("n_rows") + chunk - 1) / chunk).cast("bigint")
    chunks = meta.select(
        "table_id", "types", "pools", "n_rows", "n_cols", *carried,
        F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("chunk"),
    ).repartition(tasks, "table_id", "chunk")
    rows = chunks.select(
        "table_id", "types", "pools", "n_cols", *carried,
        F.explode(
            F.sequence(F.col("chunk") * chunk, F.least(F.col("n_rows"), (F.col("chunk") + 1) * chunk) - 1)
        ).alias("row_idx"),
    )
    tid, r = F.col("table_id"), F.col("row_idx")
    idx = F.sequence(F.lit(0), F.col("n_cols") - 1)

    def cell(j):
        typ = F.element_at(F.col("types"), j + 1)
        return (
            F.when(typ == INT, int_cell(key(seed, tid, j, r, "int")).cast("string"))
            .when(typ == DATE, date_cell(key(seed, tid, j, r, "date")))
            .otherwise(text_cell(seed, tid, j, r, F.element_at(F.col("pools"), j + 1)))
        )

    with_cells = rows.select("table_id", F.col("row_idx").cast("bigint").alias("row_idx"), "types", F.transform(idx, cell).alias("cells"), *carried)
    nums = F.transform(
        F.col("cells"),
        lambda c, j: F.when(F.element_at(F.col("types"), j + 1) == INT, c.cast("bigint")),
    )
    return with_cells.select("table_id", "row_idx", "cells", nums.alias("nums"), *carried)


def synthetic(driver: DataFrame, id_col: str, shape: Shape, vocab: DataFrame) -> Corpus:
    meta = table_meta(driver, id_col, shape, vocab)
    return Corpus(fill(meta, shape), meta.drop("pools"))
