"""Chat formatting in budgeted windows of whole turns, and reading the windows back.

A conversation's turns are laid on a line of tokens.  Prefix sums choose the spans:
with a stride of half of what the budget leaves beside the system turn and the
history, a span is the run of turns that begin in one stride, so a span of turns no
longer than the stride fits the budget; a longer turn is a span of its own, whole.
Each window repeats the system turn (a first turn with role ``system``) and up to
``history_turns`` turns before its span, as far as ``history_tokens`` go.  Loss spans
cover the texts of assistant turns in the span itself, never the repeated ones, so
every target counts once.

Template of a turn: ``<|im_start|>`` role newline text ``<|im_end|>`` newline.  Texts cannot
forge it: a backslash goes after the ``<`` of each ``<|`` (and ``<\\|``, ...), and comes off on
reading.  In roles a backslash and a newline are written as backslash b and backslash n.

Only DataFrame functions are used.  A window holds a bounded number of turns.  The
digests of ``read_back`` are over whole conversations, so there, and only there, a
conversation's text meets in one row.

Defined results: null text and role are empty; turns are ordered by turn, role and
text, nulls first, so repeated rows are turns of their own; rows with a null conv_id are
one conversation; an empty table gives no windows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabqa.llm.common import word_count

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class ChatParams:
    budget: int = 1024  # tokens of a window
    history_turns: int = 2
    history_tokens: int = 128
    turn_tokens: int = 4  # tokens of a turn's markers, besides the words of its text


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def windows(turns: DataFrame, p: ChatParams = ChatParams(), id_col: str = "conv_id") -> DataFrame:
    """``conv_id, window, text, repeated, n_turns, loss`` from rows ``conv_id, turn, role, text``.

    ``repeated`` counts the leading turns of ``text`` that are repeats, ``loss`` holds
    [start, end) in code points of ``text``.
    """
    x = turns.select(F.col(id_col).alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    x = x.withColumn("tokens", word_count(F.col("text")) + p.turn_tokens).withColumn("no", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    line = Window.partitionBy("conv_id").orderBy("no")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("is_system", (F.col("no") == 1) & (F.col("role") == "system"))
    part = F.struct(escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), ((F.col("role") == "assistant") & ~F.col("is_system")).alias("target"), "tokens", "is_system")
    x = x.select("conv_id", "no", "tokens", "is_system", part.alias("part"))
    x = x.withColumn("system", F.first(F.when(F.col("is_system"), F.col("part"))).over(so_far))
    room = F.lit(p.budget - p.history_tokens) - F.coalesce("system.tokens", F.lit(0))
    x = x.withColumn("stride", F.greatest(F.floor(room / 2), F.lit(max(1, p.budget // 8))).cast("bigint"))
    x = x.withColumn("begin", F.coalesce(F.sum(F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))).over(before), F.lit(0)))
    x = x.withColumn("cell", F.floor(F.col("begin") / F.col("stride"))).withColumn("long", (F.col("tokens") > F.col("stride")) & ~F.col("is_system"))
    opens = (F.col("no") == 1) | (F.col("cell") != F.lag("cell").over(line)) | F.col("long") | F.lag("long").over(line)
    x = x.withColumn("opens", opens)
    earlier = F.filter(F.array(*[F.lag("part", k).over(line) for k in range(1, p.history_turns + 1)]), lambda t: t.isNotNull() & ~t["is_system"])
    # Nearest first; a turn is repeated while the tokens up to it fit.
    fits = F.filter(earlier, lambda t, i: F.aggregate(F.slice(earlier, 1, i + 1), F.lit(0).cast("bigint"), lambda a, u: a + u["tokens"]) <= p.history_tokens)
    x = x.withColumn("history", F.when(F.col("opens") & (F.col("no") > 1), F.reverse(fits)))
    x = x.withColumn("window", F.sum(F.col("opens").cast("bigint")).over(so_far) - 1)

    y = x.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("no", "part"))).alias("span"),
        F.first("history", ignorenulls=True).alias("history"),
        F.first("system", ignorenulls=True).alias("system"),
    )
    own = F.transform("span", lambda s: s["part"])
    past = F.transform(F.coalesce("history", F.slice(own, 1, 0)), lambda t: t.withField("target", F.lit(False)))
    lead = F.when((F.col("window") > 0) & F.col("system").isNotNull(), F.array("system")).otherwise(F.slice(own, 1, 0))
    y = y.select("conv_id", "window", F.size("span").alias("n_turns"), (F.size(lead) + F.size(past)).alias("repeated"), F.concat(lead, past, own).alias("parts"))
    head = lambda t: F.length(t["role"]) + len(START) + 1
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")),
        lambda a, t: F.struct(
            (a["at"] + head(t) + F.length(t["text"]) + len(END) + 1).alias("at"),
            F.when(t["target"], F.concat(a["loss"], F.array(F.struct((a["at"] + head(t)).alias("start"), (a["at"] + head(t) + F.length(t["text"])).alias("end"))))).otherwise(a["loss"]).alias("loss"),
        ),
        lambda a: a["loss"],
    )
    text = F.array_join(F.transform("parts", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")
    return y.select("conv_id", "window", text.alias("text"), "repeated", "n_turns", spans.alias("loss"))


def parse(text: Column) -> Column:
    """Turns of a window's text: array of (role, text), unescaped."""
    bodies = F.filter(F.split(text, r"<\|im_start\|>"), lambda b, i: i > 0)
    cut = F.transform(bodies, lambda b: F.left(b, F.length(b) - len(END) - 1))
    return F.transform(
        cut,
        lambda b: F.struct(
            unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
            unescape(F.substr(b, F.locate("\n", b) + 1)).alias("text"),
        ),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, from ``text``, ``repeated`` and ``loss`` of its windows alone."""
    turns = F.filter(parse(F.col("text")), lambda t, i: i >= F.col("repeated"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"]))), "")
    x = formatted.select("conv_id", "window", F.size(turns).alias("n"), said.alias("said"), learnt.alias("learnt"), F.length("text").alias("chars"))
    y = x.groupBy("conv_id").agg(
        F.sum("n").cast("bigint").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", "said", "learnt"))).alias("w"),
        F.sum("chars").cast("bigint").alias("formatted_chars"),
    )
    whole = lambda f: F.array_join(F.transform("w", lambda w: w[f]), "")
    y = y.select("conv_id", "n_turns", whole("said").alias("said"), whole("learnt").alias("learnt"), "formatted_chars")
    return y.select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learnt").cast("bigint").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars"
    )
