"""Scoring predictions (O1-O14) as joins and aggregates.

Exact match is a column expression.  Token F1 needs the multiset overlap
of two token lists: tokens are exploded, counted per (pair, token, side)
and reduced with ``least`` — partial aggregation, no per-pair Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabqa.functions import text as T
from tabqa.session import pin


def exact_match(pred: Column, gold: Column) -> Column:
    """O3: both numeric → equal as floats (NaN never equal); else normalised equality."""
    p, g = T.to_float(pred), T.to_float(gold)
    both = T.is_numeric(pred) & T.is_numeric(gold)
    num_eq = (p == g) & ~F.isnan(p) & ~F.isnan(g)
    return F.when(both, num_eq.cast("int")).otherwise((T.normalize(pred) == T.normalize(gold)).cast("int"))


def prepared(text: Column) -> Column:
    """What exact match needs of a text; a text that meets many others is prepared once."""
    return F.struct(T.is_numeric(text).alias("numeric"), T.to_float(text).alias("value"), T.normalize(text).alias("norm"))


def match(pred: Column, gold: Column) -> Column:
    """O3 over prepared texts."""
    same = (pred["value"] == gold["value"]) & ~F.isnan(pred["value"]) & ~F.isnan(gold["value"])
    return F.when(pred["numeric"] & gold["numeric"], same.cast("int")).otherwise((pred["norm"] == gold["norm"]).cast("int"))


def f1(pairs: DataFrame, key: list[str], pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Token F1 per pair; numeric pairs score 1/0 like exact match."""
    base = pairs.select(
        *key,
        T.py_split(T.normalize(F.col(pred))).alias("pt"),
        T.py_split(T.normalize(F.col(gold))).alias("gt"),
        (T.is_numeric(F.col(pred)) & T.is_numeric(F.col(gold))).alias("both_num"),
        exact_match(F.col(pred), F.col(gold)).alias("em"),
    )
    toks = base.select(*key, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("pt").alias("t")), F.struct(F.lit(1).alias("side"), F.col("gt").alias("t"))
    )).alias("s")).select(*key, "s.side", F.explode("s.t").alias("tok"))
    per_tok = toks.groupBy(*key, "tok").agg(
        F.count(F.when(F.col("side") == 0, 1)).alias("cp"), F.count(F.when(F.col("side") == 1, 1)).alias("cg")
    )
    same = per_tok.groupBy(*key).agg(F.sum(F.least("cp", "cg")).alias("num_same"))
    j = base.join(same, key, "left")
    ns = F.coalesce(F.col("num_same"), F.lit(0))
    prec = ns / F.size("pt")
    rec = ns / F.size("gt")
    score = F.when(F.col("both_num"), F.col("em").cast("double")).when(ns == 0, F.lit(0.0)).otherwise(
        2 * prec * rec / (prec + rec)
    )
    return j.select(*key, "em", F.round(score, 6).alias("f1"))


def stop_cut(s: Column, markers: list[str]) -> Column:
    """Cut at the first marker, in list order, that occurs."""
    out = None
    for m in markers:
        cond = F.locate(m, s) > 0
        cut = F.substring(s, F.lit(1), F.locate(m, s) - 1)
        out = F.when(cond, cut) if out is None else out.when(cond, cut)
    return out.otherwise(s) if out is not None else s


def cot_answer(s: Column, marker: str = "Answer:", parity: bool = False) -> Column:
    """Text after the marker; without it the whole text (``parity`` drops 6 chars like the reference)."""
    pos = F.locate(marker, s)
    after = F.substring(s, pos + len(marker), 1 << 30)
    # Python's s[s.find(m) + len(m):] with find = -1 drops len(m) - 1 characters.
    missing = F.substring(s, len(marker), 1 << 30) if parity else s
    return F.when(pos > 0, after).otherwise(missing)


def accuracy(scored: DataFrame, by: list[str], score: str = "em") -> DataFrame:
    """Mean score and count per group."""
    return scored.groupBy(*by).agg(F.round(F.avg(score), 6).alias("acc"), F.count(F.lit(1)).alias("n"))


def pearson(per_model: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson r of two score sets over models."""
    return per_model.agg(F.round(F.corr(a, b), 6).alias("pearson_r"))


def kendall_tau_b(per_model: DataFrame, model: str, a: str, b: str) -> DataFrame:
    """Kendall τ-b over models.

    The input is one row per model, written once; τ is a sum over pairs of models.
    """
    per_model = pin(per_model.select(model, a, b), "kendall")
    x = per_model.select(F.col(model).alias("m1"), F.col(a).alias("x1"), F.col(b).alias("y1"))
    y = per_model.select(F.col(model).alias("m2"), F.col(a).alias("x2"), F.col(b).alias("y2"))
    pairs = x.join(y, F.col("m1") < F.col("m2"))
    sx = F.signum(F.col("x1") - F.col("x2"))
    sy = F.signum(F.col("y1") - F.col("y2"))
    s = pairs.agg(
        F.sum(sx * sy).alias("s"),
        F.sum(F.when(sx != 0, 1).otherwise(0)).alias("nx"),
        F.sum(F.when(sy != 0, 1).otherwise(0)).alias("ny"),
    )
    return s.select(F.round(F.col("s") / F.sqrt(F.col("nx") * F.col("ny")), 6).alias("kendall_tau_b"))


def leaderboard(per_model: DataFrame, model: str, acc: str = "acc") -> DataFrame:
    """Dense rank by accuracy (one row per model; the window is over that small table)."""
    w = Window.orderBy(F.col(acc).desc())
    return per_model.select(model, acc, F.dense_rank().over(w).alias("rank"))
