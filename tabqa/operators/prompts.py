"""Prompt building (N1-N6): header by task, few-shot block, table text,
optional truncation to a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabqa.functions import text as T
from tabqa.functions.tokens import count_tokens

# Prompt headers by task, with and without shots ("{}" = table, then examples).
HEADERS = {
    ("qa", True): "You need to obtain the final answer based on the table and questions. Only give me the answer and do not output any other words. \nTable:\n{}\nNow you need to get the answer based on the question, only give me the answer and do not output any other words.\nThe following are some examples.\n\n{}",
    ("qa", False): "You need to obtain the final answer based on the table and questions. Only give me the answer and do not output any other words. \nTable:\n{}\nNow you need to get the answer based on the question, only give me the answer and do not output any other words.\n{}",
    ("sql", True): "You are an SQL executor, you need to execute SQL based on the give table and SQL statement to obtain the execution results. Only give me the execution results and do not output any other words. \nTable:\n{}\nNow you need to execute SQL based on the given table and SQL statement to obtain the execution result. Only give me the result and do not output any other words or SQL statement.\nThe following are some examples.\n\n{}",
    ("sql", False): "You are an SQL executor, you need to execute SQL based on the give table and SQL statement to obtain the execution results. Only give me the execution results and do not output any other words. \nTable:\n{}\nNow you need to execute SQL based on the given table and SQL statement to obtain the execution result. Only give me the result and do not output any other words or SQL statement.\n{}",
    ("cot", True): "You are an SQL executor, you need to output the execution process and the final answer based on the table and SQL. \nTable:\n{}\nNow you need to get the answer based on the SQL, only give me the intermedium results and the final answer.\nThe following are some examples.\n\n{}",
}
HEADERS[("cot", False)] = HEADERS[("cot", True)]
HEADERS[("ins", True)] = "You need to obtain the final answer based on the table and instructions. Only give me the result and do not output any other words. \nTable:\n{}\nNow you need to get the answer based on the instruction, only give me the result and do not output any other words.\nThe following are some examples.\n\n{}"
HEADERS[("ins", False)] = "You need to obtain the final answer based on the table and instructions. Only give me the result and do not output any other words. \nTable:\n{}\nNow you need to get the answer based on the instruction, only give me the result and do not output any other words.\n{}"

# By task, the words before what is asked, the field asked, the words before what is answered,
# the field answered, and what follows it.
SHOTS = {
    "qa": ("Question:", "question", "\nAnswer:", "answer", "\n"),
    "ins": ("Instruction:", "multistep", "\nAnswer:", "answer", "\n"),
    "sql": ("SQL:", "sql", "\nAnswer:", "answer", "\n"),
    "cot": ("SQL:", "sql", "\nExecution process:\n", "sql_cot", "\n\n"),
}


def header(task: str, n_shot: int) -> tuple[str, str, str]:
    """(before table, between table and examples, after examples)."""
    h = HEADERS[(task, n_shot != 0)]
    a, _, rest = h.partition("{}")
    b, _, c = rest.partition("{}")
    return a, b, c


def few_shot_block(examples: Column, n_shot: int, task: str = "sql", answer_prompt: bool = False, list_answers: bool = False) -> Column:
    """Shots ``examples[1..n]`` then the target ``examples[0]``.

    The examples carry the fields of their task (``SHOTS``).  ``answer_prompt``
    ends the target where its answer begins, as one of the reference's runners
    does; the execution process of ``cot`` always does.  ``list_answers`` says that
    answers are arrays, which are joined with ','.
    """
    ask, asked, before, answered, after = SHOTS[task]

    def said(e: Column) -> Column:
        v = F.array_join(e[answered], ",") if list_answers and answered == "answer" else e[answered]
        return F.coalesce(v, F.lit("None"))

    shots = F.slice(examples, 2, max(n_shot, 0))
    item = lambda e: F.concat(F.lit(ask), e[asked], F.lit(before), said(e), F.lit(after))
    last = F.concat(F.lit(ask), F.element_at(examples, 1)[asked], F.lit(before if answer_prompt or task == "cot" else ""))
    return F.concat(F.array_join(F.transform(shots, item), ""), last)


def full_prompt(table_text: Column, block: Column, task: str, n_shot: int) -> Column:
    """Header with the table and the examples filled in."""
    a, b, c = header(task, n_shot)
    return F.concat(F.lit(a), table_text, F.lit(b), block, F.lit(c))


def truncate(texts: DataFrame, key: list[str], text: str, max_tokens: int, step: int = 500, counter=count_tokens) -> DataFrame:
    """Fit a text to ``max_tokens``.

    Unchanged when it fits.  Otherwise keep the first ``k`` whitespace words
    joined by single spaces, ``k`` the largest of max_tokens, max_tokens-step,
    ... whose words fit (0 if none does) — the fixed point of the reference's
    cut-and-retry loop.  Words are exploded, their token counts summed by a
    per-text running window, and one aggregate picks ``k``.
    """
    words = texts.select(*key, F.posexplode(T.py_split(F.col(text))).alias("p", "w")).select(
        *key, "p", counter(F.col("w")).alias("t")
    )
    # The whole text's count is a plain (partial) sum; the running sum is only
    # needed for the first ``max_tokens`` words (k never exceeds it), which
    # bounds each window partition by the budget, not by the text.
    total = words.groupBy(*key).agg(F.sum("t").alias("total"))
    w = Window.partitionBy(*key).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    cum = words.where(F.col("p") < max_tokens).select(*key, "p", F.sum("t").over(w).alias("cum"))
    n = F.col("p") + 1
    on_grid = (n <= max_tokens) & (F.pmod(F.lit(max_tokens) - n, F.lit(step)) == 0)
    best = cum.groupBy(*key).agg(F.max(F.when(on_grid & (F.col("cum") <= max_tokens), n)).alias("k")).join(
        total, key, "right"
    )
    j = texts.join(best, key, "left")
    cut = F.array_join(F.slice(T.py_split(F.col(text)), 1, F.coalesce(F.col("k"), F.lit(0)).cast("int")), " ")
    out = F.when(F.coalesce(F.col("total"), F.lit(0)) <= max_tokens, F.col(text)).otherwise(cut)
    return j.select(*key, out.alias(text))


def truncate_parts(parts: DataFrame, key: list[str], text: str, max_tokens: int, step: int = 500, counter=count_tokens) -> DataFrame:
    """N4 over texts in ordered parts (``chunk`` from 0 on) that end in white space and have a word each.

    What ``truncate`` gives for the joined text.  Tokens are summed over all parts; words
    are read from the first ``max_tokens`` words of the first ``max_tokens`` parts, which
    hold the first ``max_tokens`` words of the text.  Texts that fit have no more parts.
    """
    words = parts.select(*key, "chunk", F.posexplode(T.py_split(F.col(text))).alias("p", "w")).withColumn("t", counter(F.col("w")))
    large = words.groupBy(*key).agg(F.sum("t").alias("total")).where(F.col("total") > max_tokens).select(*key)
    w = Window.partitionBy(*key).orderBy("chunk", "p")
    lead = words.where((F.col("chunk") < max_tokens) & (F.col("p") < max_tokens)).join(large, key, "left_semi")
    lead = lead.select(*key, "w", F.row_number().over(w).alias("n"), F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
    n = F.col("n")
    on_grid = (n <= max_tokens) & (F.pmod(F.lit(max_tokens) - n, F.lit(step)) == 0)
    best = lead.where(n <= max_tokens).groupBy(*key).agg(
        F.coalesce(F.max(F.when(on_grid & (F.col("cum") <= max_tokens), n)), F.lit(0)).alias("k"), F.array_sort(F.collect_list(F.struct("n", "w"))).alias("ws")
    )
    cut = best.select(*key, F.array_join(F.transform(F.slice("ws", 1, F.col("k")), lambda s: s["w"]), " ").alias(text))
    fits = parts.join(large, key, "left_anti").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("chunk", text))).alias("ps"))
    return cut.unionByName(fits.select(*key, F.array_join(F.transform("ps", lambda s: s[text]), "").alias(text)))
