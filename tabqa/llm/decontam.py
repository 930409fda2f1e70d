"""Benchmark decontamination: test n-grams in a broadcast hash set, scanned over training texts.

Texts are lower-cased (A-Z) and cut into words (``SEPARATOR`` splits them).  A
window is ``n`` consecutive words of a benchmark item; an item of fewer words is
one window.  Each distinct window names one of its words, the longest, as its
anchor.  A document is scanned once: words in the hash set of anchors are the only
places where a window can lie, and each such place is looked up in the broadcast
table of windows and verified word by word.  What comes out per document are the
spans of words that lie in an occurrence and the items they come from; documents
without any pass through as slim rows.  ``clean`` drops the documents or cuts the spans.

The anchors and windows grow with the benchmark only.  Up to ``max_ngrams`` windows
go out at once; a larger benchmark is taken in blocks of that size over a written
copy of the words, so no broadcast outgrows the bound and no window is left out.

Defined results: null or wordless text has no words and no hits; an empty benchmark
hits nothing; rows that repeat a doc_id are judged each by its own text; a null
item_id counts as an item named by the empty string; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabqa.session import pin

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of a lower-cased text
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class DecontamParams:
    n: int = 10
    max_ngrams: int = 200_000  # windows broadcast at once


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else; the fast path holds for texts of ASCII alone."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def pieces(text: Column) -> Column:
    """Words in order, with an empty string before (after) them if the text begins (ends) between words."""
    return F.split(text, SEPARATOR)


def windows(bench: DataFrame, p: DecontamParams, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: ``words, len, items, anchor, at`` (place of the anchor in the window)."""
    words = F.filter(pieces(ascii_lower(F.coalesce(F.col(text_col), F.lit("")))), lambda w: w != "")
    x = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (p.n - 1)))
    x = x.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), p.n).alias("words"))
    x = x.groupBy("words").agg(F.collect_set("item").alias("items"))
    best = F.array_max(F.transform("words", lambda w, i: F.struct(F.length(w).alias("size"), w.alias("word"), (-i).alias("back"))))
    x = x.withColumn("_b", best)
    return x.select("words", F.size("words").alias("len"), "items", F.col("_b.word").alias("anchor"), (-F.col("_b.back")).alias("at"))


def _occurrences(x: DataFrame, block: DataFrame, p: DecontamParams) -> DataFrame:
    """Rows ``_uid, id, n_words`` with ``span`` and ``items`` of each occurrence, and at least one row a document."""
    anchors = [r[0] for r in block.select("anchor").distinct().collect()]  # bounded: at most max_ngrams
    is_anchor = (lambda w: w.isin(anchors)) if anchors else (lambda w: F.lit(False))
    reach = p.n - 1
    spots = F.transform(
        F.filter(F.transform("_words", lambda w, i: F.when(is_anchor(w), i)), lambda i: i.isNotNull()),
        lambda i: F.struct(
            i.alias("i"),
            F.get(F.col("_words"), i).alias("anchor"),
            F.greatest(F.lit(0), i - reach).alias("from"),
            F.slice(F.col("_words"), F.greatest(F.lit(1), i + 1 - reach), F.lit(2 * reach + 1)).alias("near"),
        ),
    )
    x = x.select("_uid", "id", "n_words", F.explode_outer(spots).alias("_s"))
    x = x.select("_uid", "id", "n_words", F.col("_s.i").alias("_i"), F.col("_s.anchor").alias("_a"), F.col("_s.from").alias("_from"), F.col("_s.near").alias("_near"))
    begin = F.col("_i") - F.col("at")
    same = F.when(begin >= F.col("_from"), F.slice("_near", begin - F.col("_from") + 1, F.col("len")) == F.col("words")).otherwise(False)
    y = x.join(F.broadcast(block), (F.col("_a") == F.col("anchor")) & same, "left")
    return y.select("_uid", "id", "n_words", F.when(F.col("len").isNotNull(), F.struct(begin.alias("start"), (begin + F.col("len")).alias("end"))).alias("span"), "items")


def scan(docs: DataFrame, bench: DataFrame, p: DecontamParams = DecontamParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id, n_words, n_hit, spans, items``.

    ``spans`` are [start, end) places in ``pieces`` of the text, one for each
    occurrence; ``items`` are the ids, sorted as strings.
    """
    grams = pin(windows(bench, p), "decontam-grams")
    n_blocks = -(-grams.count() // p.max_ngrams) or 1
    text = F.coalesce(F.col(text_col), F.lit(""))
    x = docs.select(F.col(id_col).alias("id"), pieces(ascii_lower(text)).alias("_words"))
    ends = (F.get("_words", F.lit(0)) == "").cast("int") + ((F.size("_words") > 1) & (F.element_at("_words", -1) == "")).cast("int")
    x = x.withColumn("n_words", (F.size("_words") - ends).cast("bigint")).withColumn("_uid", F.monotonically_increasing_id())
    if n_blocks > 1:
        x = pin(x, "decontam-words")
    of = F.pmod(F.xxhash64("words"), F.lit(n_blocks))
    hits = reduce(DataFrame.unionByName, [_occurrences(x, grams.where(of == k) if n_blocks > 1 else grams, p) for k in range(n_blocks)])
    y = hits.groupBy("_uid", "id", "n_words").agg(F.collect_set("span").alias("spans"), F.collect_set("items").alias("items"))
    covered = F.aggregate(
        F.sort_array("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
        lambda a: a["n"].cast("bigint"),
    )
    return y.select("id", "n_words", covered.alias("n_hit"), F.sort_array("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def cut_spans(text: Column, spans: Column) -> Column:
    """The text without the words of ``spans`` and what follows each of them up to the next word."""
    word, gap = r"[0-9a-zA-Z\x{80}-\x{10FFFF}]", r"[^0-9a-zA-Z\x{80}-\x{10FFFF}]"
    # What stands before the first word is a part of its own, where pieces() has its empty string.
    parts = F.regexp_extract_all(text, F.lit(f"(^{gap}+|{word}+{gap}*)"), F.lit(1))
    return F.array_join(F.filter(parts, lambda part, i: ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["end"]))), "")


def clean(docs: DataFrame, bench: DataFrame, p: DecontamParams = DecontamParams(), mode: str = "drop", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated rows (``drop``) or without their hit words (``cut``); other rows stay as they are."""
    keyed = docs.withColumn("_dc_key", F.xxhash64(F.col(text_col))).withColumn("_dc_id", F.struct(F.col(id_col).alias("i"), F.col("_dc_key").alias("k")))
    bad = scan(keyed, bench, p, "_dc_id", text_col).where(F.size("spans") > 0).groupBy(F.col("id.i").alias("_bi"), F.col("id.k").alias("_bk")).agg(F.first("spans").alias("_bs"))
    on = F.col(id_col).eqNullSafe(F.col("_bi")) & (F.col("_dc_key") == F.col("_bk"))
    if mode == "drop":
        bad = pin(bad.select("_bi", "_bk"), "decontam-bad")  # its size is known, so that a small one is broadcast and texts stay where they are
        return keyed.join(bad, on, "left_anti").select(*docs.columns)
    out = keyed.join(bad, on, "left").withColumn("_cut", F.when(F.col("_bs").isNull(), F.col(text_col)).otherwise(cut_spans(F.col(text_col), F.col("_bs"))))
    return out.select(*[F.col("_cut").alias(c) if c == text_col else F.col(c) for c in docs.columns])
