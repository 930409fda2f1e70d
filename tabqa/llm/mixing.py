"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The mix wants ``share`` times all words of the corpus.  Sources get targets by
weight; a target stops at ``cap`` times its source's words and the excess goes
to the others by weight (water filling, in closed form over the sorted ratios
cap / weight).  The words are handed out in blocks of ``block_tokens``: a block
goes to the source with the highest quotient ``target / (2 k + 1)``, then, the
same way, to the source's shards by their sizes.  A shard lays its documents on
one line of words in a seeded order; its quota takes every block of the line
``quota div blocks`` times and, by a seeded systematic draw, ``quota mod blocks``
of them once more.  What a document gives is a difference of two prefix values of
that line, so blocks never become rows.

Only slim rows (id, source, size) are shuffled.  The tables of sources and shards
have at most one row per source and ``max_shards`` rows per source.

Defined results: null text has size 0 and takes 0; a null source is a source of
its own, last in order; sources without words get target 0; rows that repeat a
doc_id are separate documents; an empty table gives no rows; extra columns are
ignored.  Reruns agree under any partitioning, as every choice is a hash of the id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabqa.functions.hashing import hk
from tabqa.llm.common import word_count
from tabqa.session import pin


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)  # by source in code-point order, repeating
    share: float = 1.5  # words of the mix per word of the corpus
    cap: int = 2  # a source gives at most so many times its words
    block_tokens: int = 32
    shard_tokens: int = 1_000_000  # words a shard aims at
    max_shards: int = 4096  # per source; beyond that shards grow
    seed: str = "mix"


def targets(sizes: DataFrame, p: MixParams) -> DataFrame:
    """Targets per source from ``(source, source_size)``: adds ``no``, ``target``."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("_ratio", "no")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weights = F.array(*[F.lit(float(w)) for w in p.weights])
    x = sizes.withColumn("no", F.row_number().over(by_name).cast("bigint"))
    x = x.withColumn("_w", F.element_at(weights, (F.pmod(F.col("no") - 1, F.lit(len(p.weights))) + 1).cast("int")))
    x = x.withColumn("_cap", F.lit(float(p.cap)) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    x = x.withColumn("_total", F.lit(p.share) * F.sum("source_size").over(everything)).withColumn("_all_w", F.sum("_w").over(everything))
    # What a unit of weight gets if all sources of a lower ratio stop at their caps.
    x = x.withColumn("_unit", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.col("_all_w") - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    x = x.withColumn("_stops", F.col("_ratio") <= F.col("_unit"))
    level = (F.col("_total") - F.sum(F.when(F.col("_stops"), F.col("_cap")).otherwise(0.0)).over(everything)) / F.sum(
        F.when(~F.col("_stops"), F.col("_w"))
    ).over(everything)
    x = x.withColumn("_level", level)
    target = F.when(F.col("_stops"), F.col("_cap")).otherwise(F.col("_w") * F.col("_level"))
    return x.withColumn("target", target).select("no", "source", "source_size", "target")


def apportion(claims: DataFrame, group: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """Sainte-Lague seats per claim: adds ``quota``; ``seats`` (a column, constant in a group) are handed out.

    With the divisor at its proportional value, rounding gives a total within
    n / 2 seats of the right one, so each claim's seats lie near its share and
    only quotients around that need to be ranked: about 4 n rows, whatever the
    number of seats.
    """
    of = Window.partitionBy(*group)
    x = claims.withColumn("_n", F.sum(F.when(F.col(weight) > 0, 1).otherwise(0)).over(of)).withColumn("_sum", F.sum(weight).over(of))
    x = x.withColumn("_q", F.when(F.col("_sum") > 0, F.col(weight) / F.col("_sum") * F.col(seats)).otherwise(F.lit(0.0)))
    x = x.withColumn("_slack", F.when(F.col("_sum") > 0, F.col(weight) / F.col("_sum") * F.col("_n") / 2).otherwise(F.lit(0.0)) + 2)
    x = x.withColumn("_lo", F.greatest(F.lit(0), F.floor(F.col("_q") - F.col("_slack"))).cast("bigint"))
    x = x.withColumn("_hi", F.ceil(F.col("_q") + F.col("_slack")).cast("bigint"))
    x = x.withColumn("_left", F.col(seats) - F.sum("_lo").over(of))
    tries = x.where(F.col(weight) > 0).select(*group, key, weight, "_left", F.explode(F.sequence("_lo", "_hi")).alias("_k"))
    tries = tries.withColumn("_rank", F.row_number().over(of.orderBy((F.col(weight) / (2 * F.col("_k") + 1)).desc(), key)))
    won = tries.where(F.col("_rank") <= F.col("_left")).groupBy(*group, key).agg(F.count(F.lit(1)).alias("_won"))
    out = x.join(won, [*group, key], "left").withColumn("quota", F.when(F.col(weight) > 0, F.col("_lo") + F.coalesce("_won", F.lit(0))).otherwise(F.lit(0)).cast("bigint"))
    return out.drop("_n", "_sum", "_q", "_slack", "_lo", "_hi", "_left", "_won")


def mix(docs: DataFrame, p: MixParams = MixParams(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every document of ``docs``."""
    slim = pin(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), hk(p.seed, F.col(id_col)).alias("_at")),
        "mix-sizes",
    )
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = targets(sizes, p)
    blocks = F.greatest(F.lit(1), F.round(F.sum("target").over(Window.partitionBy()) / p.block_tokens)).cast("bigint")
    src = src.withColumn("_seats", blocks).withColumn("_one", F.lit(1))
    src = apportion(src, ["_one"], "no", "target", "_seats").withColumnRenamed("quota", "_blocks")
    shards = F.least(F.lit(p.max_shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / p.shard_tokens))).cast("int")
    src = pin(src.select("no", "source", "source_size", "target", "_blocks", shards.alias("_shards")), "mix-sources")

    placed = slim.join(src, slim["source"].eqNullSafe(src["source"])).drop(src["source"])
    placed = placed.withColumn("_shard", F.pmod(F.col("_at"), F.col("_shards")).cast("int"))
    per_shard = placed.groupBy("no", "_shard", "_blocks").agg(F.sum("size").alias("_line"))
    per_shard = per_shard.withColumn("_weight", F.col("_line").cast("double"))
    quotas = apportion(per_shard, ["no"], "_shard", "_weight", "_blocks")
    cells = F.ceil(F.col("_line") / p.block_tokens).cast("bigint")
    quotas = pin(quotas.select("no", "_shard", F.least(F.col("quota"), p.cap * cells).alias("_quota"), cells.alias("_cells")), "mix-quotas")

    line = Window.partitionBy("no", "_shard").orderBy("_at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    x = placed.join(quotas, ["no", "_shard"]).withColumn("_end", F.sum("size").over(line))
    x = x.withColumn("_base", F.when(F.col("_cells") > 0, F.expr("_quota div _cells")).otherwise(F.lit(0)))
    x = x.withColumn("_more", F.col("_quota") - F.col("_base") * F.col("_cells"))
    x = x.withColumn("_phase", F.when(F.col("_cells") > 0, F.pmod(hk(p.seed, "phase", F.col("no"), F.col("_shard")), F.col("_cells"))).otherwise(F.lit(0)))
    b = p.block_tokens

    def drawn(at: str) -> str:
        """Words of drawn blocks among the first ``at`` words of the line."""
        upto = f"(((({at}) div {b}) * _more + _phase) div _cells)"
        here = f"((((({at}) div {b}) + 1) * _more + _phase) div _cells)"
        return f"({b} * {upto} + ({here} - {upto}) * (({at}) % {b}))"

    taken = F.expr(f"CASE WHEN size = 0 OR _cells = 0 THEN 0L ELSE _base * size + {drawn('_end')} - {drawn('_end - size')} END")
    return x.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"))
