"""Sampling until a number is reached.

Both loops are rounds of one plan each over all tables that still miss their number: a
table's deficit decides whether it draws again, and draws are numbered on, so a later round
repeats none of an earlier one and a lost run can be taken up at any round.  A table that
misses its number in all rounds is reported, never left out.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tabqa.operators import batch as B
from tabqa.operators import controls as K
from tabqa.operators import generate as G
from tabqa.operators import render as M
from tabqa.operators import specs as S
from tabqa.session import pin
from tabqa.sources.corpus import Corpus


@dataclass
class Reached:
    kept: DataFrame  # what was kept, at most the number asked for of each table
    report: DataFrame  # one row per table: what it drew and kept, and whether it reached its number


def queries_per_table(c: Corpus, p: S.SpecParams, target: int, controls: K.Controls = K.Controls(), rounds: int = 2, multiple: int = 5) -> Reached:
    """The first ``target`` different queries of every table that the rules let through.

    Round r allots ``target * multiple ** r`` queries (r from 1) to each table that is short.  A query is a function
    of its number and the first ones by number are kept, so a later round makes and answers as many as
    there were before, then the rest for the tables that are still short.  A query that is rejected whatever the cells are (``controls.foreseen``) is not answered.
    ``kept``: table_id, query_no, sql, answer; ``report``: table_id, n_drawn (allotted by the rounds a table took part in), n_kept, reached.
    """
    key = ["table_id", "sql"]
    short, rows, tables, drawn, accepted, history = None, c.rows, c.tables, 0, None, None
    for r in range(1, rounds + 1):
        allotted = drawn + target * multiple**r
        step = drawn or allotted
        while drawn < allotted:
            if short is not None:
                rows, tables = c.rows.join(short, "table_id", "left_semi"), c.tables.join(short, "table_id", "left_semi")
            n = min(step, allotted - drawn)
            specs = S.draw(tables, rows, replace(p, per_table=n, first=drawn))
            drawn, step = drawn + n, allotted
            specs = specs.where(~K.foreseen(controls))
            checked = K.apply(specs, B.execute(rows, specs), rows, controls)
            now = pin(checked.where(F.col("rejected_by").isNull()).select("table_id", "query_no", "sql", "answer"), f"quota-kept-{drawn}")
            accepted = now if accepted is None else accepted.unionByName(now)
            different = accepted.select(*key).distinct().groupBy("table_id").agg(F.count(F.lit(1)).alias("n"))
            state = tables.select("table_id").join(different, "table_id", "left").select("table_id", F.lit(allotted).cast("bigint").alias("n_drawn"), F.coalesce("n", F.lit(0)).alias("n"))
            state = pin(state, f"quota-state-{drawn}")
            history = state if history is None else history.unionByName(state)
            short = state.where(F.col("n") < target).select("table_id")
            if short.isEmpty():
                break
        if short.isEmpty():
            break
    first = accepted.groupBy(*key).agg(F.min("query_no").alias("query_no")).select("table_id", "query_no")
    # A table has at most as many rows here as it has drawn.
    place = F.row_number().over(Window.partitionBy("table_id").orderBy("query_no"))
    kept = accepted.join(first, ["table_id", "query_no"], "left_semi").withColumn("place", place).where(F.col("place") <= target).drop("place")
    last = history.groupBy("table_id").agg(F.max("n_drawn").alias("n_drawn"), F.max("n").alias("n"))
    report = last.select("table_id", "n_drawn", F.least("n", F.lit(target)).alias("n_kept"), (F.col("n") >= target).alias("reached"))
    return Reached(kept, report)


def tables_with(c: Corpus, p: S.SpecParams, least: int, controls: K.Controls = K.Controls(), steps: tuple[int, ...] = (4, 2, 2)) -> DataFrame:
    """Specs, with their whole ``answer``, that the rules let through, of every table that has ``least`` different ones among its ``per_table``.

    Queries are made and answered in steps (the last one goes on); a table takes no further part once those left cannot
    bring it to ``least``.  Answers are put together in the end, for the tables that have their number.
    """
    rows, tables, drawn, accepted, answered = c.rows, c.tables, 0, None, []
    while drawn < p.per_table:
        n = min(steps[min(len(answered), len(steps) - 1)], p.per_table - drawn)
        specs = S.draw(tables, rows, replace(p, per_table=n, first=p.first + drawn)).where(~K.foreseen(controls))
        drawn += n
        ans = B.execute(rows, specs)
        fine = K.apply(specs, ans, rows, controls, texts=False).where(F.col("rejected_by").isNull())
        now = pin(fine.select("table_id", "query_no", "sql"), f"several-kept-{drawn}")
        answered.append((specs, ans, now))
        accepted = now if accepted is None else accepted.unionByName(now)
        left = p.per_table - drawn
        different = accepted.select("table_id", "sql").distinct().groupBy("table_id").agg(F.count(F.lit(1)).alias("n"))
        enough = different.where(F.col("n") >= least - left).select("table_id") if least > left else tables.select("table_id")
        enough = pin(enough, f"several-tables-{drawn}")
        if left:
            rows, tables = pin(rows.join(enough, "table_id", "left_semi"), f"several-rows-{drawn}"), tables.join(enough, "table_id", "left_semi")
    out = None
    for specs, ans, now in answered:
        queries = pin(now.join(enough, "table_id", "left_semi").select("table_id", "query_no"), "several-queries")
        part = specs.join(ans.only(queries).whole(), ["table_id", "query_no"])
        out = part if out is None else out.unionByName(part)
    return out


def tables_near_budget(driver: DataFrame, id_col: str, shape: G.Shape, vocab: DataFrame, budget: int, tolerance: float = 0.04, tries: int = 16, step: int = 5, levels: int | None = None) -> Reached:
    """Synthetic tables whose flatten text has ``budget`` tokens, give or take ``tolerance``.

    A table that misses is drawn anew, ``tries`` times; then its row numbers come down by
    ``step``, and so on while any row is left (or for ``levels`` such steps).  All tries but a
    level's first are one plan.  Only numbers of tokens are kept of a try: the table itself
    is a function of its draw number, and is made again by ``corpus_of``.

    ``kept``: table_id, draw, level, n_tokens; ``report`` has these for every table, and ``reached``.
    """
    most = -(-shape.row_max // step)
    levels = most if levels is None else min(levels, most)
    asked = driver.select(F.col(id_col).cast("bigint").alias("table_id")).where(F.col("table_id").isNotNull()).distinct()
    left, hits = asked, None
    every = levels * tries
    for level in range(levels):
        smaller = _lower(shape, level, step)
        for a, b in ((0, 1), (1, tries)):
            if a == b:
                continue
            at = F.explode(F.sequence(F.lit(level * tries + a).cast("bigint"), F.lit(level * tries + b - 1).cast("bigint")))
            draws = left.select("table_id", at.alias("draw")).select((F.col("table_id") * every + F.col("draw")).alias("table_id"))
            meta = G.table_meta(draws, "table_id", smaller, vocab)
            size = M.table_tokens(G.fill(meta, smaller, ("header",)), meta).where(F.abs(F.col("n_tokens") - budget) <= tolerance * budget)
            draw = F.pmod("table_id", F.lit(every).cast("bigint"))
            near = size.select(F.floor((F.col("table_id") - draw) / every).cast("bigint").alias("table_id"), draw.alias("draw"), "n_tokens")
            near = near.groupBy("table_id").agg(F.min("draw").alias("draw"), F.min_by("n_tokens", "draw").alias("n_tokens"))
            near = pin(near.select("table_id", "draw", F.lit(level).alias("level"), "n_tokens"), f"budget-{level}-{a}")
            hits = near if hits is None else hits.unionByName(near)
            left = pin(left.join(near, "table_id", "left_anti"), f"budget-left-{level}-{a}")
            if left.isEmpty():
                break
        if left.isEmpty():
            break
    report = asked.join(hits, "table_id", "left").withColumn("reached", F.col("draw").isNotNull())
    return Reached(hits, report)


def _lower(shape: G.Shape, level: int, step: int) -> G.Shape:
    return replace(shape, row_min=max(1, shape.row_min - step * level), row_max=max(1, shape.row_max - step * level))


def corpus_of(kept: DataFrame, shape: G.Shape, vocab: DataFrame, tries: int = 16, step: int = 5, levels: int | None = None) -> Corpus:
    """The tables that ``tables_near_budget`` kept, made from their draw numbers."""
    most = -(-shape.row_max // step)
    every = (most if levels is None else min(levels, most)) * tries
    by_level = [r[0] for r in kept.select("level").distinct().orderBy("level").collect()]  # at most one a step
    rows = tables = None
    for level in by_level:
        smaller = _lower(shape, level, step)
        ids = kept.where(F.col("level") == level).select((F.col("table_id") * every + F.col("draw")).alias("id"))
        meta = G.table_meta(ids, "id", smaller, vocab)
        back = F.floor((F.col("table_id") - F.pmod("table_id", F.lit(every).cast("bigint"))) / every).cast("bigint")
        r, t = G.fill(meta, smaller).withColumn("table_id", back), meta.drop("pools").withColumn("table_id", back)
        rows, tables = (r, t) if rows is None else (rows.unionByName(r), tables.unionByName(t))
    return Corpus(rows, tables)
