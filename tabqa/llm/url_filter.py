"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

A rule is a host and a path prefix, to allow or to block; it fits its host and every
subdomain if the url's path begins with its path, and the longest that fits wins.
Urls that a rule decides are the labelled ones.  Of them a bounded, seeded sample
trains Spark's gradient-boosted trees on features of the url's text alone: lengths,
depth, digit ratio, character entropy, numbers of parameters, dots and hyphens, and for
the last one, two and three labels of the host how often the sample blocks them
(smoothed; a training url is left out of its own statistics).  The trees judge every
url that no rule decides.  Features are DataFrame expressions; the statistics are
bounded by the sample and are broadcast.

Defined results: a null url or one without ``://`` has an empty host and path, which no
rule fits; repeated rows are judged each; labelled urls of one kind only make that
kind the verdict of the rest, none makes it ``allow``; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabqa.llm.common import bounded_sample
from tabqa.session import pin

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str  # begins with "/"

    def __str__(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlFilterParams:
    max_labelled: int = 20_000  # labelled urls that train: the bound of the fitted sample
    trees: int = 20
    depth: int = 4
    smoothing: float = 10.0  # weight of the overall rate in a suffix's rate
    seed: int = 7


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.locate("://", url) + 3)
    found = F.when(F.locate("://", url) > 0, F.regexp_extract(rest, "^[^/?#]*", 0))
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.substr(url, F.locate("://", url) + 3)
    return F.coalesce(F.when(F.locate("://", url) > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def matched(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The rule that decides and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(str(r))):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, str(r)).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def _suffixes(host: Column) -> Column:
    """The last one, two and three labels of a host, each named by how many were asked for."""
    return F.transform(F.array(*[F.lit(n) for n in (1, 2, 3)]), lambda n: F.concat(n.cast("string"), F.lit(" "), F.array_join(F.slice(F.reverse(F.split(host, r"\.")), F.lit(1), n), ".")))


def lexical(url: Column, host: Column, path: Column) -> Column:
    """Features of a url's text: array of doubles."""
    u = F.coalesce(url, F.lit(""))
    n = F.length(u)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    digits = F.regexp_count(u, F.lit("[0-9]"))
    per = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.filter(F.split(u, ""), lambda c: c != "")), F.lit(0.0), lambda a, c: a - per(c) * F.log2(per(c)))
    of = lambda c, what: F.regexp_count(c, F.lit(what))
    values = [
        n, F.length(host), F.length(path), F.length(query), of(path, "/"), F.when(n > 0, digits / n).otherwise(0.0), F.when(n > 0, entropy).otherwise(0.0),
        F.when(query == "", 0).otherwise(of(query, "&") + 1), of(query, "="), of(host, r"\."), of(host, "-"), of(host, "[0-9]"),
        u.startswith("https").cast("int"), u.contains("#").cast("int"), F.length(F.substring_index(path, "/", -1)), of(path, "[A-Z]"),
    ]
    return F.array(*[v.cast("double") for v in values])


def judge(pages: DataFrame, rules: list[Rule], p: UrlFilterParams = UrlFilterParams(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row, and ``score``, the trees' probability of block (null where a rule decides)."""
    x = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    x = x.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = matched(rules, F.col("host"), F.col("path"))
    x = x.withColumn("rule", rule).withColumn("by_rule", verdict)

    labelled = x.where(F.col("by_rule").isNotNull()).select("page_id", "url", "host", "path", (F.col("by_rule") == "block").cast("double").alias("label"))
    sample = pin(bounded_sample(labelled, p.max_labelled, "page_id", "url"), "urls-labelled")
    n, blocked = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if blocked in (0, n):
        rest = F.lit("block" if blocked else "allow")
        return x.select("page_id", "host", "path", "rule", F.coalesce("by_rule", rest).alias("verdict"), F.lit(None).cast("double").alias("score"))

    rate = blocked / n
    counted = pin(sample.select("label", F.explode(_suffixes(F.col("host"))).alias("suffix")).groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked")), "urls-suffixes")

    def vectors(rows: DataFrame, own: Column, one: Column) -> DataFrame:
        """Adds ``features``; ``own`` and ``one`` are what a row itself has added to its suffixes' statistics."""
        y = rows.withColumn("_s", _suffixes(F.col("host")))
        values = [lexical(F.col("url"), F.col("host"), F.col("path"))]
        for j in (0, 1, 2):
            found = F.broadcast(counted.select(F.col("suffix").alias(f"_k{j}"), F.col("n").alias(f"_n{j}"), F.col("blocked").alias(f"_b{j}")))
            y = y.join(found, F.get("_s", F.lit(j)) == F.col(f"_k{j}"), "left")
            known = F.coalesce(F.col(f"_n{j}") - one, F.lit(0.0))
            values.append(F.array((F.coalesce(F.col(f"_b{j}") - own, F.lit(0.0)) + rate * p.smoothing) / (known + p.smoothing), F.log1p(known)))
        return y.withColumn("features", array_to_vector(F.concat(*values)))

    # One partition of bounded size: the same trees whatever the cluster.
    train = vectors(sample, F.col("label"), F.lit(1.0)).coalesce(1).sortWithinPartitions("page_id", "url").select("features", "label")
    model = GBTClassifier(maxIter=p.trees, maxDepth=p.depth, seed=p.seed).fit(pin(train, "urls-train").coalesce(1))
    scored = model.transform(vectors(x, F.lit(0.0), F.lit(0.0)))
    score = F.get(vector_to_array(F.col("probability")), F.lit(1))
    rest = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", rest).alias("verdict"), F.when(F.col("by_rule").isNull(), score).alias("score"))
