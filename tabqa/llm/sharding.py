"""Sharding by jump consistent hashing.

A row's key (any columns) is hashed to 64 bits, the start of a fixed linear generator
(Lamping and Veach).  Each draw names the next shard count at which the row would move
to the newest shard; the last such jump below the shard count is the row's shard.  No
ring and no table is kept: the keys and the count decide, and with more shards a row
either stays or goes to a new shard, ``1 / (n + 1)`` of them for one shard more.

The generator's 64-bit products are taken in two halves of 32 bits, since longs raise
an error on overflow.  A draw always moves on, so ``n`` draws would do; a row needs about
``ln n``, and ``draws`` of them are made at most, with an error, not a wrong shard, beyond.

``place`` numbers the rows of each shard without a gap.  The order is by a hash of the
row, so a shard is cut into cells by ranges of that hash, every cell is numbered by its
own task, and the counts of the cells give their first numbers.  Rows equal in all that is
kept are one row with a count until they have their numbers; counts above ``chunk`` are
spread over tasks before they become rows, so neither a large shard nor a row repeated
without end is one task.  ``write`` lays the rows out as files by shard.

Only DataFrame functions are used; rows move as (key, size, checksum), never with texts.

Defined results: a null key is a key like any other; a null text has no bytes (size 1,
checksum 0); rows that repeat a key share its shard and have slots of their own; an empty
table gives no rows; extra columns are ignored.  Reruns agree under any partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabqa.llm.common import n_partitions
from tabqa.session import pin

#: Fixed values of jump consistent hashing: the generator's factor.
FACTOR = 2862933555777941757
_MASK = 0xFFFFFFFF


@dataclass(frozen=True)
class ShardParams:
    shards: int = 16
    more: int = 1  # shards that the grown layout has besides
    draws: int = 200  # of a row; an error beyond
    cell_rows: int = 200_000  # rows that one task numbers
    chunk: int = 10_000  # equal rows that one task numbers
    seed: str = "shard"


def _digest(seed: str, keys: list[Column]) -> Column:
    """MD5 of the keys' text forms, null apart from every text."""
    named = [F.coalesce(F.concat(F.lit("v"), k.cast("string")), F.lit("n")) for k in keys]
    sized = [F.concat(F.length(k).cast("string"), F.lit(":"), k) for k in named]  # no two lists of keys read the same
    return F.md5(F.concat_ws("|", F.lit(seed), *sized))


def _word(digest: Column, no: int) -> Column:
    """32 bits of an MD5 digest, unsigned."""
    return F.conv(F.substring(digest, 1 + 8 * no, 8), 16, 10).cast("bigint")


def _low_product(x: Column, y: int) -> Column:
    """``x * y mod 2^32`` of two unsigned 32-bit numbers."""
    return (x.bitwiseAND(0xFFFF) * y + F.shiftleft((F.shiftright(x, 16) * y).bitwiseAND(0xFFFF), 16)).bitwiseAND(_MASK)


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The halves of ``key * FACTOR + 1 mod 2^64``."""
    f_hi, f_lo = FACTOR >> 32, FACTOR & _MASK
    outer = F.shiftright(lo, 16) * f_lo  # counts 2^16
    low = lo.bitwiseAND(0xFFFF) * f_lo + F.shiftleft(outer.bitwiseAND(0xFFFF), 16) + 1
    high = F.shiftright(low, 32) + F.shiftright(outer, 16) + _low_product(hi, f_lo) + _low_product(lo, f_hi)
    return high.bitwiseAND(_MASK), low.bitwiseAND(_MASK)


def jump(hi: Column, lo: Column, counts: list[int], draws: int = 200) -> Column:
    """The shard of a key (its halves) for each of ``counts`` shards: a struct with a field ``s<count>`` each."""
    top = max(counts)
    state = F.struct(hi.alias("hi"), lo.alias("lo"), F.lit(0).cast("bigint").alias("next"), *[F.lit(0).cast("bigint").alias(f"s{n}") for n in counts])

    def draw(a: Column, _: Column) -> Column:
        h, low = _step(a["hi"], a["lo"])
        # The upper 31 bits of the key are those of the upper half.
        after = F.floor((a["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(h, 1) + 1).cast("double"))).cast("bigint")
        last = [F.when(a["next"] < n, a["next"]).otherwise(a[f"s{n}"]).alias(f"s{n}") for n in counts]
        return F.when(a["next"] >= top, a).otherwise(F.struct(h.alias("hi"), low.alias("lo"), after.alias("next"), *last))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(min(top, draws))), state, draw)
    if draws < top:
        done = F.when(done["next"] >= top, done).otherwise(F.raise_error(F.lit(f"a key has not settled after {draws} draws")))
    return F.struct(*[done[f"s{n}"].cast("int").alias(f"s{n}") for n in counts])


def assign(rows: DataFrame, keys: list[str], p: ShardParams = ShardParams()) -> DataFrame:
    """``rows`` with ``shard`` and ``grown_shard`` (among ``shards`` and ``shards + more``)."""
    digest = _digest(p.seed, [F.col(k) for k in keys])
    own = rows.columns
    x = rows.withColumn("_sh", digest)
    x = x.withColumn("_sj", jump(_word(F.col("_sh"), 0), _word(F.col("_sh"), 1), sorted({p.shards, p.shards + p.more}), p.draws))
    return x.select(*[F.col(c) for c in own if c not in ("shard", "grown_shard")], F.col(f"_sj.s{p.shards}").alias("shard"), F.col(f"_sj.s{p.shards + p.more}").alias("grown_shard"))


def place(docs: DataFrame, p: ShardParams = ShardParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, text_crc32, shard, grown_shard, slot`` for every row of ``docs``."""
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    x = docs.select(F.col(id_col).alias("id"), (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    x = assign(x, ["id"], p)
    slim = pin(x.groupBy(*x.columns).agg(F.count(F.lit(1)).alias("copies")), "shard-rows")
    n = slim.count()
    cells = max(-(-n // (p.shards * p.cell_rows)), -(-2 * n_partitions(docs.sparkSession) // p.shards))
    at = _word(_digest(f"{p.seed}-slot", [F.col(c) for c in ("id", "size", "text_crc32")]), 0)
    x = slim.withColumn("_at", at).withColumn("_cell", F.shiftright(F.col("_at") * cells, 32))
    line = Window.partitionBy("shard", "_cell").orderBy("_at", "id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_in", F.coalesce(F.sum("copies").over(line), F.lit(0)))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = slim.withColumn("_at", at).groupBy("shard", F.shiftright(F.col("_at") * cells, 32).alias("_cell")).agg(F.sum("copies").alias("_n"))
    firsts = firsts.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    x = pin(x.join(firsts, ["shard", "_cell"]).select("id", "size", "text_crc32", "shard", "grown_shard", "copies", (F.col("_first") + F.col("_in")).alias("_begin")), "shard-slots")
    out = ["id", "size", "text_crc32", "shard", "grown_shard"]
    few = x.where(F.col("copies") <= p.chunk).select(*out, F.explode(F.sequence("_begin", F.col("_begin") + F.col("copies") - 1)).alias("slot"))
    many = x.where(F.col("copies") > p.chunk)
    many = many.select(*out, (F.col("_begin") + F.col("copies")).alias("_end"), F.explode(F.sequence(F.col("_begin"), F.col("_begin") + F.col("copies") - 1, F.lit(p.chunk).cast("bigint"))).alias("_from"))
    many = many.repartition("shard", "_from").select(*out, F.explode(F.sequence("_from", F.least(F.col("_from") + p.chunk, F.col("_end")) - 1)).alias("slot"))
    return few.unionByName(many)


def write(docs: DataFrame, path: str, p: ShardParams = ShardParams(), id_col: str = "doc_id") -> None:
    """Lay the rows of ``docs`` out as Parquet under ``path``, a folder ``shard=N`` each.

    A shard's rows are dealt over as many tasks as it has cells, so a shard is written by several.
    """
    x = assign(docs, [id_col], p)
    cells = max(1, -(-2 * n_partitions(docs.sparkSession) // p.shards))
    others = [F.col(c) for c in docs.columns if c not in ("shard", "grown_shard")]
    dealt = F.pmod(F.xxhash64(*others), F.lit(cells))
    x.drop("grown_shard").withColumn("_cell", dealt).repartition("shard", "_cell").drop("_cell").write.mode("error").partitionBy("shard").parquet(path)


def moved(rows: DataFrame) -> DataFrame:
    """``shard, grown_shard, rows`` of the rows that a grown layout moves."""
    return rows.where("shard != grown_shard").groupBy("shard", "grown_shard").agg(F.count(F.lit(1)).alias("rows"))
