"""Batched execution of many specs over many tables.

One plan answers every spec: corpus rows are joined to the specs of their
table, each row is tested against the spec's WHERE with plain CASE
expressions (codegen-friendly), and results come from a single
aggregation keyed by (table_id, query_no[, group key]).

Scale notes
* The join key is (table_id, salt).  A table with more than ``salt_rows``
  rows is cut into contiguous row ranges (salt = row_idx div salt_rows) and
  its specs are replicated once per range, so a hot table spreads over many
  tasks instead of one.
* Every aggregate is algebraic (count/sum/min/max/min_by/bool_and), so the
  shuffle after the join carries partial aggregates, not rows.  Where no table is
  split, rows are dealt by table, and aggregates need no shuffle at all.
* Rows are joined to all specs once, for aggregates: those that were asked for, the place of a
  top row, and of plain answers their number of rows and first row.  Only the plain answers that are read
  (``Answers.parts``, after ``Answers.only``) are joined again, dealt by parts, so that no answer row is shuffled.
* What a WHERE or HAVING compares with is worked out once a spec (``_tests``): a code of the comparison,
  bounds of a number, a lower-case prefix.  A pair of row and spec costs a few comparisons, in code
  small enough for the JVM to compile.
* Answers of every size have one shape: ordered parts.  A part holds the
  answer rows of one range of ``PART_ROWS`` table rows (or of so many groups),
  so no answer meets in one task and none is cut short.  Facts that rules
  need (size, first value, whether a 0 or 1 is listed) are aggregates over
  the parts, never over a list.
* Numbers are longs, or exact decimals in a corpus with REAL columns.  Sums and row
  arithmetic are decimals, so no value of one table ends the job of all (J4): a query that
  the SQL engine would refuse (a sum of whole numbers beyond BIGINT, a missing literal beside a
  number) is ``failed`` and has no answer; the others keep theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabqa.functions.indexing import row_index
from tabqa.session import pin
from tabqa.sources.corpus import REAL_PLACES, number_type, real_text

SALT_ROWS = 1_000_000
PART_ROWS = 10_000
BROADCAST_BYTES = 64 << 20
SPEC_BYTES = 600  # about what a spec takes in a broadcast table
TABLE_BYTES = 40
BUILD_BYTES = 16 << 20  # specs of a join task, where they are no broadcast
LISTED_VALUES = 10_000  # admitted values that go with a spec
BUCKET_VALUES = 8
VALUE_BYTES = 48  # about what an admitted value takes beside its spec


@dataclass
class Answers:
    answers: DataFrame  # one row per spec: sizes, first value, facts for the rules
    few: DataFrame  # the answer rows, in ordered parts, of specs that aggregate or take a top row
    plain: Callable[[DataFrame | None], DataFrame]  # the same of plain specs, or of some of them (``table_id, query_no``)
    origin: DataFrame | None = None  # of specs that select an aggregate: the first row (``row_idx``) of the same query without it
    lines: Callable[[DataFrame | None], DataFrame] | None = None  # as ``plain``, with the ``text`` of a part in place of its rows

    @cached_property
    def parts(self) -> DataFrame:
        """The answer rows of every spec, in ordered parts, written when first asked for."""
        return pin(self.few.unionByName(self.plain(None)), "answer-parts")

    @property
    def answer_rows(self) -> DataFrame:
        """Every answer row of every spec."""
        return self.parts.select(*SPEC_KEY, F.explode("rows").alias("r")).select(*SPEC_KEY, "r.ord_i", "r.ord_s", "r.vals", "r.tup")

    def texts(self, lists: bool = True) -> DataFrame:
        """One row per spec and part with the part's text (J6): '' / first cell / ', '-joined values / joined tuples.

        ``assembled().texts()`` has one row per spec with the whole text.  Without ``lists`` there is no
        ``answer_list``, and answers that nobody has written are put together as text.

        Parts are numbered by their ranges; the only part of an answer is part 0.
        """
        first = F.transform("rows", lambda r: F.coalesce(F.try_element_at(r["vals"], F.lit(1)), F.lit("None")))
        wide = F.size(F.get("rows", F.lit(0))["vals"]) > 1
        text = F.when(wide, F.array_join(F.transform("rows", lambda r: r["tup"]), ", ")).otherwise(F.array_join(first, ", "))
        more = ["answer_list"] if lists else []
        said = lambda parts: parts.select(*SPEC_KEY, "part", text.alias("text"), first.alias("answer_list")).select(*SPEC_KEY, "part", "text", *more)
        if lists or self.lines is None or "parts" in self.__dict__:
            parts = said(self._once())
        else:
            parts = said(self.few).unionByName(self.lines(None))
        # Texts meet their facts, not rows of answers; without a part there is nothing to meet.
        found = self.answers.join(parts, SPEC_KEY)
        none = self.answers.where(F.col("n_parts") == 0).select("*", F.lit(0).cast("bigint").alias("part"), F.lit("").alias("text"), F.array().cast("array<string>").alias("answer_list"))
        answer = F.when(F.col("n_ans_rows") == 1, F.col("first_value")).otherwise(F.col("text"))
        part = F.when(F.col("n_parts") > 1, F.col("part")).otherwise(F.lit(0)).cast("bigint")
        return found.unionByName(none.select(*found.columns)).select(*self.answers.columns, part.alias("part"), answer.alias("answer"), *more)

    def _once(self) -> DataFrame:
        """The parts for one reader: written ones if there are, else made while they are read."""
        return self.parts if "parts" in self.__dict__ else self.few.unionByName(self.plain(None))

    def only(self, specs: DataFrame) -> Answers:
        """The answers of some specs (``table_id, query_no``)."""
        specs = pin(specs.select(*SPEC_KEY), "answers-asked")  # read here and by the plain answers
        return Answers(
            self.answers.join(specs, SPEC_KEY, "left_semi"), self.few.join(specs, SPEC_KEY, "left_semi"),
            lambda some: self.plain(specs if some is None else specs.join(some, SPEC_KEY, "left_semi")), self.origin,
            self.lines and (lambda some: self.lines(specs if some is None else specs.join(some, SPEC_KEY, "left_semi"))),
        )

    def assembled(self) -> Answers:
        """The same answers with the parts of each put together in order, as one part."""
        several = self.answers.where(F.col("n_parts") > 1).select(*SPEC_KEY)
        whole = Answers(self.answers.withColumn("n_parts", F.least("n_parts", F.lit(1))), self.few, self.plain, self.origin)
        if several.isEmpty():  # one part each
            first = lambda parts: parts.withColumn("part", F.lit(0).cast("bigint"))
            whole.few, whole.plain, whole.lines = first(self.few), lambda some: first(self.plain(some)), self.lines and (lambda some: first(self.lines(some)))
            if "parts" in self.__dict__:
                whole.parts = first(self.parts)
            return whole
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("part", "rows"))), lambda p: p["rows"])
        merged = self.parts.join(several, SPEC_KEY, "left_semi").groupBy(*SPEC_KEY).agg(F.flatten(in_order).alias("rows"))
        parts = self.parts.join(several, SPEC_KEY, "left_anti").select(*SPEC_KEY, "rows").unionByName(merged)
        whole.parts = parts.select(*_part(F.col("rows"), F.lit(0)))
        return whole

    def whole(self) -> DataFrame:
        """``table_id, query_no, answer``: the whole text of every answer, for consumers that need one text."""
        return self.assembled().texts(lists=False).select(*SPEC_KEY, "answer")


def _cell(i: Column) -> Column:
    return F.get(F.col("cells"), i.cast("int"))


def _num(i: Column) -> Column:
    return F.get(F.col("nums"), i.cast("int"))


def _cmp(a: Column, op: Column, b: Column) -> Column:
    return F.when(op == ">", a > b).when(op == "<", a < b).when(op == "=", a == b)


def _type(i: Column) -> Column:
    return F.try_element_at(F.col("types"), (i + 1).cast("int"))


def calculated(op: Column, a: Column, b: Column, kind: str = "bigint", real: Column | None = None) -> Column:
    """Arithmetic of two columns as an exact decimal; division of whole numbers truncates, by zero it gives NULL.

    ``real`` tells where one of the two is REAL: products and quotients are then rounded to six places.
    """
    divisor = F.nullif(b, F.lit(0).cast(kind))
    whole = F.when(b != -1, F.call_function("div", a, divisor).cast("decimal(38,0)")).otherwise(-a.cast("decimal(38,0)"))
    if kind == "bigint":
        x, y = a.cast("decimal(20,0)"), b.cast("decimal(20,0)")
        return F.when(op == "+", x + y).when(op == "-", x - y).when(op == "*", F.try_multiply(x, y)).when(op == "/", whole).cast("decimal(38,0)")
    wide = f"decimal(38,{REAL_PLACES})"
    quotient = F.when(real, F.round(F.try_divide(a, divisor), REAL_PLACES).try_cast(wide)).otherwise(whole.cast(wide))
    return F.when(op == "+", (a + b).try_cast(wide)).when(op == "-", (a - b).try_cast(wide)).when(op == "*", F.try_multiply(a, b).try_cast(wide)).when(op == "/", quotient)


def calc_is_real() -> Column:
    """Whether the row arithmetic of a spec has a REAL operand."""
    return F.coalesce((_type(F.get("s_cols", F.lit(0))) == "REAL") | (_type(F.get("s_cols", F.lit(1))) == "REAL"), F.lit(False))


def total(v: Column, kind: str = "bigint") -> Column:
    """Exact sum of numbers, as a decimal; whole ones are summed as three longs of 21 bits or so."""
    if kind != "bigint":
        return F.sum(v.cast(kind))
    low = lambda x: F.sum(x.bitwiseAND(F.lit((1 << 21) - 1))).cast("decimal(20,0)")
    scaled = lambda x, bits: x * F.lit(1 << bits).cast("decimal(13,0)")
    high = F.sum(F.shiftright(v, 42)).cast("decimal(20,0)")
    return (scaled(high, 42) + scaled(low(F.shiftright(v, 21)), 21) + low(v)).cast("decimal(30,0)")


def number_text(v: Column, kind: str = "bigint", real: Column | None = None) -> Column:
    """A number as the answer prints it: whole numbers bare, REAL ones with a place at least."""
    if kind == "bigint":
        return v.cast("string")
    return F.when(real, real_text(v)).otherwise(v.cast("decimal(38,0)").cast("string"))


def average(sums: Column, n: Column, kind: str = "bigint", real: Column | None = None) -> Column:
    """Text of an average: a double for whole numbers, rounded to six places for REAL ones."""
    n = F.nullif(n, F.lit(0).cast("bigint"))
    plain = (sums.cast("double") / n).cast("string")
    if kind == "bigint":
        return plain
    return F.when(real, real_text(F.round(sums / n.cast("decimal(20,0)"), REAL_PLACES))).otherwise(plain)


def order_key(value: Column, desc: Column) -> Column:
    """Place of a number of any size in an ORDER, smallest first: NULL is below every number."""
    v = value.try_cast(f"decimal(38,{REAL_PLACES})")
    return F.struct(F.when(v.isNull() == desc, 1).otherwise(0).alias("last"), F.when(desc, -v).otherwise(v).alias("v"))


def unanswerable() -> Column:
    """Specs that no engine runs: a missing literal beside a number."""
    none = lambda c: F.coalesce(F.col(c) == "None", F.lit(False))
    first = (F.col("w_n") >= 1) & ~F.col("w_cc") & F.col("w1_num") & none("w1_v1")
    second = (F.col("w_n") == 2) & F.col("w2_num") & none("w2_v1")
    return first | second | (F.coalesce(F.col("h_kind"), F.lit("")).isin("agg", "bare") & none("h_lit"))


def _bounds(op: Column, lit: Column, kind: str) -> tuple[Column, Column]:
    """Least and greatest number that meets ``op`` with a literal; NULL if the literal is none."""
    if kind == "bigint":
        least, most, step, wide = -(1 << 63), (1 << 63) - 1, F.lit(1).cast(kind), kind
    else:  # a place more than the numbers have, so that a step beyond them fits
        step, wide, most = F.expr(f"CAST(1e-{REAL_PLACES} AS {kind})"), f"decimal(26,{REAL_PLACES})", "9" * 20
        least = "-" + most
    x, least, most = lit.try_cast(kind).cast(wide), F.lit(least).cast(wide), F.lit(most).cast(wide)
    lo = F.when(op == "=", x).when(op == ">", F.when(x == most, most).otherwise((x + step).cast(wide))).when(op == "<", F.when(x.isNotNull(), least))
    hi = F.when(op == "=", x).when(op == "<", F.when(x == least, least).otherwise((x - step).cast(wide))).when(op == ">", F.when(x.isNotNull(), most))
    # Nothing is above the greatest number, or below the least.
    none = F.coalesce(((op == ">") & (x == most)) | ((op == "<") & (x == least)), F.lit(False))
    return F.when(none, most).otherwise(lo), F.when(none, least).otherwise(hi)


#: Codes of conditions: none; a number in bounds; a text; two columns.
ANY, NUMBER, TEXT_OPS, COLUMN_OPS = 0, 1, {"=": 2, "like": 3, "in": 4, ">": 5, "<": 6}, {">": 7, "<": 8, "=": 9}


def _code(op: Column, codes: dict) -> Column:
    e = F
    for k, v in codes.items():
        e = e.when(op == k, F.lit(v))
    return e


def _tests(kind: str) -> list[Column]:
    """Columns of a spec that ``where_ok`` and the HAVING of rows read."""
    out = []
    for n in (1, 2):
        op, text = F.col(f"w{n}_op"), F.col(f"w{n}_v1")
        by_value = F.when(F.col(f"w{n}_num"), F.lit(NUMBER)).otherwise(_code(op, TEXT_OPS))
        test = F.when(F.col("w_cc"), _code(op, COLUMN_OPS)).otherwise(by_value) if n == 1 else by_value
        lo, hi = _bounds(op, text, kind)
        number = F.col(f"w{n}_num")
        out += [
            F.when(F.col("w_n") < n, F.lit(ANY)).otherwise(test).alias(f"w{n}_test"), F.when(number, lo).alias(f"w{n}_lo"), F.when(number, hi).alias(f"w{n}_hi"),
            F.when(op == "like", F.lower(F.substring(text, 1, 3))).otherwise(text).alias(f"w{n}_text"),
        ]
    lo, hi = _bounds(F.col("h_op"), F.col("h_lit"), kind)
    h_test = F.when(F.col("h_kind") == "bare", F.lit(NUMBER)).when(F.col("h_kind") == "colcol", _code(F.col("h_op"), COLUMN_OPS))
    return [*out, F.coalesce(h_test, F.lit(ANY)).alias("h_test"), lo.alias("h_lo"), hi.alias("h_hi")]


def _two_columns(test: Column, a: Column, b: Column) -> Column:
    return F.when(test == COLUMN_OPS[">"], a > b).when(test == COLUMN_OPS["<"], a < b).otherwise(a == b)


def _within(v: Column, prefix: str) -> Column:
    return (v >= F.col(f"{prefix}_lo")) & (v <= F.col(f"{prefix}_hi"))


def _where_cond(n: int) -> Column:
    test, c, t = F.col(f"w{n}_test"), _cell(F.col(f"w{n}_col")), F.col(f"w{n}_text")
    in_list = (c == t) | (c == F.col(f"w{n}_v2")) | ((F.col(f"w{n}_nin") == 3) & (c == F.col(f"w{n}_v3")))
    e = F.when(test == ANY, F.lit(True)).when(test == NUMBER, _within(_num(F.col(f"w{n}_col")), f"w{n}"))
    e = e.when(test == TEXT_OPS["="], c == t).when(test == TEXT_OPS["like"], F.lower(c).startswith(t)).when(test == TEXT_OPS["in"], in_list)
    e = e.when(test == TEXT_OPS[">"], c > t).when(test == TEXT_OPS["<"], c < t)
    if n == 1:
        e = e.when(test >= min(COLUMN_OPS.values()), _two_columns(test, _num(F.col("w1_col")), _num(F.col("w1_rcol"))))
    return F.coalesce(e, F.lit(False))


def where_ok() -> Column:
    """Whether a row meets the WHERE of a spec with ``_tests``; a missing value never does."""
    return _where_cond(1) & _where_cond(2)


WORK_PER_TASK = 2_000_000  # row x spec evaluations per join task


def _nested_number(kind: str) -> Column:
    """Whether a row meets the numeric condition with a sub-query's answer, where a spec has one."""
    met = _cmp(_num(F.col("n_col")), F.col("n_op"), F.col("n_val").try_cast(kind))
    return F.when(F.col("n_kind") == "num", F.coalesce(met, F.lit(False))).otherwise(F.lit(True))


def _join_specs(rows: DataFrame, specs: DataFrame, salt_rows: int, admitted: DataFrame | None = None, part_rows: int | None = None) -> DataFrame:
    """rows x specs of the same table, spread by expansion work.

    A table gets ``n_salt = max(ceil(rows*specs / WORK_PER_TASK), ceil(rows / salt_rows))``
    salts; its rows are dealt to them in runs of ``PART_ROWS`` rows at most, so that what is
    grouped by parts of an answer meets few salts, and repartitioned on
    (table_id, salt) with an explicit partition count (AQE keeps explicit
    counts).  Specs that are no broadcast are replicated once per salt.  A hot table — or one
    big table with many specs — is thus evaluated by many tasks.  With ``part_rows`` a salt is
    a range of so many rows: its answers are a part, which needs no other task.

    A spec with ``NEST_COLS`` has a condition more, on the answer of its sub-query: a number to compare with, or
    ``admitted`` values (``table_id, query_no, value``, each once).  Up to ``LISTED_VALUES`` of these go with their
    spec, dealt by hash so that a cell is compared with a few, and pairs stay where they are; more are a join on the cell by the same salts.
    """
    spark = rows.sparkSession
    many, spec_bytes = None, F.lit(SPEC_BYTES)
    if admitted is not None:
        listed, many = _listed(admitted)
        specs = specs.join(listed, SPEC_KEY, "left")
        spec_bytes = spec_bytes + F.coalesce(F.col("n_values") * VALUE_BYTES, F.lit(0))
        many = None if many.isEmpty() else many
    per_table = specs.groupBy("table_id").agg(F.count(F.lit(1)).alias("__k"), F.max("n_rows").alias("__n"), F.sum(spec_bytes).alias("__b"))
    by_work = F.greatest(F.lit(1), F.ceil(F.col("__n") * F.col("__k") / F.lit(WORK_PER_TASK)), F.ceil(F.col("__n") / F.lit(salt_rows)))
    n_salt = (by_work if part_rows is None else F.greatest(F.lit(1), F.ceil(F.col("__n") / F.lit(part_rows)))).cast("bigint")
    run = F.greatest(F.lit(1), F.least(F.lit(PART_ROWS), F.floor(F.col("__n") / n_salt))) if part_rows is None else F.lit(part_rows)
    per_table = per_table.select("table_id", n_salt.alias("__s"), run.cast("bigint").alias("__run"), (F.col("__n") * F.col("__k")).alias("__w"), "__b")
    stats = per_table.agg(
        F.count(F.lit(1)).alias("t"), F.sum("__s").alias("s"), F.sum("__w").alias("w"), F.sum(F.col("__b") * F.col("__s")).alias("b"), F.sum("__b").alias("o")
    ).first()  # five scalars, one job
    n_tables, n_salts, work, replicated = (stats["t"] or 0), (stats["s"] or 0), (stats["w"] or 0), (stats["b"] or 0)
    per_table = per_table.drop("__w", "__b")
    pt = F.broadcast(per_table) if n_tables * TABLE_BYTES <= BROADCAST_BYTES else per_table
    small = (stats["o"] or 0) <= BROADCAST_BYTES  # every task has them all: no copies for salts
    # Partitions follow the expansion work, not the number of tables; specs that are no broadcast fit into a task.
    parts = max(spark.sparkContext.defaultParallelism, -(-int(work) // WORK_PER_TASK), 0 if small else -(-int(replicated) // BUILD_BYTES), 1)
    kind = number_type(rows)
    sp = specs.select("*", *_tests(kind)).withColumnRenamed("table_id", "__tid")
    same_table = F.col("table_id") == F.col("__tid")
    split = n_salts > n_tables
    if split:  # a table's specs go to each of its salts
        salt = F.pmod(F.floor(F.col("row_idx") / F.col("__run")), F.col("__s")).cast("bigint")
        r = rows.join(pt, "table_id").withColumn("salt", salt).drop("__s", "__run").repartition(parts, "table_id", "salt")
        pt = pt.drop("__run")
        if not small:
            s_of = pt.withColumnRenamed("table_id", "__tid")
            sp = sp.join(s_of, "__tid").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__s") - 1))).drop("__s")
            same_table = same_table & (F.col("salt") == F.col("__salt"))
    else:  # what follows is grouped by table, too: rows dealt so are not shuffled again
        r = rows.repartition(parts, "table_id")
    sp = F.broadcast(sp) if small else sp.hint("shuffle_hash")
    # WHERE is part of the join condition: it is tested on the joined-row view,
    # so only matching (row, spec) pairs are materialised.
    cond = same_table & where_ok()
    if "n_kind" in specs.columns:
        cond = cond & _nested_number(kind)
    pairs = lambda some, also: r.join(some, cond & also).drop("__tid", "__salt", "n_values", "n_vals")
    if admitted is None:
        return pairs(sp, F.lit(True))
    cell = F.when(F.col("n_kind") == "text", _cell(F.col("n_col")))
    bucket = F.get("n_vals", F.pmod(F.xxhash64(cell), F.size("n_vals")).cast("int"))
    lets = F.when(F.col("n_kind") == "text", F.coalesce(F.array_contains(bucket, cell), F.lit(False))).otherwise(F.lit(True))
    x = pairs(sp, lets)
    if many is None:
        return x
    joined = admitted.join(many, SPEC_KEY, "left_semi")
    v = joined.select(F.col("table_id").alias("__vt"), F.col("query_no").alias("__vq"), F.col("value").alias("__v"))
    found = (F.col("table_id") == F.col("__vt")) & (F.col("query_no") == F.col("__vq")) & (cell == F.col("__v"))
    if split:
        v = v.join(pt.withColumnRenamed("table_id", "__vt"), "__vt").select("__vt", "__vq", "__v", F.explode(F.sequence(F.lit(0), F.col("__s") - 1)).alias("__vs"))
        found = found & (F.col("salt") == F.col("__vs"))
    large = sp.join(many.withColumnRenamed("table_id", "__tid"), ["__tid", "query_no"], "left_semi")
    return x.unionByName(pairs(large, F.lit(True)).join(v, found).drop("__vt", "__vq", "__vs", "__v"))


def _listed(admitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of specs with at most ``LISTED_VALUES`` admitted values, their number ``n_values`` and, by hash, ``n_vals``; and the keys of the others."""
    counts = admitted.groupBy(*SPEC_KEY).agg(F.count(F.lit(1)).alias("n_values"))
    few = counts.where(F.col("n_values") <= LISTED_VALUES).withColumn("n_buckets", F.ceil(F.col("n_values") / BUCKET_VALUES))
    dealt = admitted.join(few, SPEC_KEY).select(*SPEC_KEY, F.pmod(F.xxhash64("value"), "n_buckets").alias("b"), "value")
    empty = few.select(*SPEC_KEY, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_buckets") - 1)).alias("b"), F.lit(None).cast("string").alias("value"))
    buckets = dealt.unionByName(empty).groupBy(*SPEC_KEY, "b").agg(F.collect_list("value").alias("vs"))  # a list takes no NULL
    listed = buckets.groupBy(*SPEC_KEY).agg(
        F.sum(F.size("vs")).alias("n_values"), F.transform(F.array_sort(F.collect_list(F.struct("b", "vs"))), lambda x: x["vs"]).alias("n_vals")
    )
    return listed, counts.where(F.col("n_values") > LISTED_VALUES).select(*SPEC_KEY)


EXEC_COLS = [
    "table_id", "query_no", "n_rows", "types", "w_n", "w_cc", "w1_col", "w1_rcol", "w1_op", "w1_num", "w1_nin",
    "w1_v1", "w1_v2", "w1_v3", "w2_col", "w2_op", "w2_num", "w2_nin", "w2_v1", "w2_v2", "w2_v3",
    "g_col", "h_kind", "h_col", "h_rcol", "h_op", "h_agg", "h_distinct", "h_lit", "s_kind", "s_cols", "s_op", "s_agg",
    "o_kind", "o_col", "o_desc",
]
SPEC_KEY = ["table_id", "query_no"]
#: Of specs with a sub-query in their WHERE: "num" or "text", the column, and for numbers the operator and the sub-query's answer.
NEST_COLS = ["n_kind", "n_col", "n_op", "n_val"]


def exec_columns(specs: DataFrame) -> list[str]:
    """The columns of specs that execution reads."""
    return [*EXEC_COLS, *(c for c in NEST_COLS if c in specs.columns)]


def _top_key(value: Column, desc: Column, kind: str) -> Column:
    """Place of a row by an ORDER column as one whole decimal, smallest first: NULL is below every number."""
    least = "9300000000000000000"  # beyond BIGINT
    if kind == "bigint":
        v, wide = value.cast("decimal(20,0)"), "decimal(20,0)"
    else:
        v, wide, least = (value * 10**REAL_PLACES).cast("decimal(25,0)"), "decimal(25,0)", least + "0" * REAL_PLACES
    return F.when(desc, F.coalesce(-v, F.lit(least).cast(wide))).otherwise(F.coalesce(v, F.lit("-" + least).cast(wide))).cast(wide)


ROW_LIMIT = 10**13  # row numbers are below it


#: What the groups of a spec need of it, as one number: values of each column, the first for NULL.
CARRIED = {
    "plain": (False, True), "top": (False, True), "grouped": (False, True), "h_kind": (None, "agg", "bare", "colcol"), "h_op": (None, ">", "<", "="),
    "h_agg": (None, "count", "max", "min", "sum"), "h_distinct": (False, True), "s_kind": (None, "cols", "calc", "agg", "group", "group_agg"),
    "s_agg": (None, "count", "max", "min", "sum", "avg"), "o_kind": ("none", "col", "agg"), "o_desc": (False, True),
    "h_real": (False, True), "s_real": (False, True), "calc_real": (False, True), "wide": (False, True),
}


def _packed() -> Column:
    code, base = F.lit(0), 1
    for c, values in CARRIED.items():
        e = F.lit(0)
        for i, v in list(enumerate(values))[1:]:
            e = F.when(F.col(c) == F.lit(v), F.lit(i * base)).otherwise(e)
        code, base = code + e, base * len(values)
    return code


def _carried() -> list[Column]:
    """The columns of ``CARRIED`` from their number ``code``."""
    out, base = [], 1
    for c, values in CARRIED.items():
        i = F.pmod(F.floor(F.col("code") / base), F.lit(len(values))).cast("int")
        out.append((i == 1 if values == (False, True) else F.get(F.array(*[F.lit(v) for v in values]), i)).alias(c))
        base *= len(values)
    return out


def _part(rows: Column, part: Column) -> list[Column]:
    return [*[F.col(k) for k in SPEC_KEY], part.cast("bigint").alias("part"), rows.alias("rows")]


def execute(rows: DataFrame, specs: DataFrame, salt_rows: int = SALT_ROWS, part_rows: int = PART_ROWS, sketch: float | None = None, admitted: DataFrame | None = None) -> Answers:
    """Answer every spec; ``admitted`` holds the values that a sub-query lets through, for specs that have one.

    Rows meet all specs in one join and one aggregation, keyed by (spec, part, group value) with fixed-width
    buffers (HashAggregate, partial):
    * aggregates (global or grouped): the aggregates asked for.  ``count ( distinct c )``
      adds a level keyed by (spec, group value, value), so a group of any size spreads over
      tasks; with ``sketch``, a relative error, it is a mergeable HyperLogLog++ instead;
    * top row (``ORDER BY ... LIMIT 1`` over rows): one partial minimum per spec of
      (ORDER value, row number), then a lookup of that row;
    * plain rows (no group, no aggregate): their number and the first row of each part.  The rows
      themselves are the answer; they are joined and put into parts for the specs whose answers are read.
    """
    from tabqa.operators.render import _py_repr

    kind = number_type(rows)
    refused = specs.where(unanswerable()).select(*SPEC_KEY)
    sp = specs.where(~unanswerable()).select(*exec_columns(specs))
    is_row = F.col("g_col").isNull() & F.col("s_kind").isin("cols", "calc")

    s1 = F.try_element_at(F.col("s_cols"), F.lit(1))
    s2 = F.try_element_at(F.col("s_cols"), F.lit(2))
    calc = calculated(F.col("s_op"), _num(s1), _num(s2), kind, calc_is_real())

    def answer_row(most: int) -> Column:
        """The answer row of a table row, for specs that select ``most`` columns at most: written out, as a loop over columns is not compiled."""
        cols = [F.get("s_cols", F.lit(i)) for i in range(most)]
        of = lambda each: F.slice(F.array(*each), F.lit(1), F.size("s_cols"))
        quoted = of([_py_repr(_cell(c), _type(c).isin("INT", "REAL")) for c in cols])
        calculation = F.array(number_text(calc, kind, calc_is_real()))
        return F.struct(
            F.col("row_idx").cast("bigint").alias("ord_i"), F.lit(None).cast("string").alias("ord_s"),
            F.when(F.col("s_kind") == "calc", calculation).otherwise(of([_cell(c) for c in cols])).alias("vals"),
            F.when(F.size("s_cols") > 1, F.concat(F.lit("("), F.array_join(quoted, ", "), F.lit(")"))).alias("tup"),
        )

    widest = lambda some: some.agg(F.max(F.size("s_cols"))).first()[0] or 1  # noqa: E731  one number
    is_top = F.coalesce(is_row & (F.col("o_kind") == "col"), F.lit(False))
    is_plain = F.coalesce(is_row & (F.col("o_kind") != "col"), F.lit(False))
    wide = F.coalesce(F.col("n_rows") > part_rows, F.lit(True))

    def line(most: int) -> Column:
        """What the answer row of a table row adds to the text of an answer of several rows."""
        cols = [F.get("s_cols", F.lit(i)) for i in range(most)]
        quoted = F.slice(F.array(*[_py_repr(_cell(c), _type(c).isin("INT", "REAL")) for c in cols]), F.lit(1), F.size("s_cols"))
        several = F.concat(F.lit("("), F.array_join(quoted, ", "), F.lit(")"))
        one = F.when(F.col("s_kind") == "calc", number_text(calc, kind, calc_is_real())).otherwise(_cell(cols[0]))
        text = F.when((F.col("s_kind") != "calc") & (F.size("s_cols") > 1), several).otherwise(F.coalesce(one, F.lit("None")))
        return F.struct(F.col("row_idx").cast("bigint").alias("ord_i"), text.alias("text"))

    def plain(wanted: DataFrame | None) -> DataFrame:
        return of_parts(wanted, answer_row).select(*_part(F.col("rows"), F.col("part")))

    def lines(wanted: DataFrame | None) -> DataFrame:
        return of_parts(wanted, line).select(*SPEC_KEY, "part", F.array_join(F.transform("rows", lambda r: r["text"]), ", ").alias("text"))

    def of_parts(wanted: DataFrame | None, row: Callable[[int], Column]) -> DataFrame:
        asked = sp.where(is_plain) if wanted is None else sp.where(is_plain).join(wanted, SPEC_KEY, "left_semi")
        x = _join_specs(rows, asked, salt_rows, admitted, part_rows)  # the rows of a part are in one task: answers are not shuffled
        x = x.select(*SPEC_KEY, (F.col("salt") if "salt" in x.columns else F.lit(0)).cast("bigint").alias("part"), row(widest(asked)).alias("r"))
        return x.groupBy(*SPEC_KEY, "part").agg(F.sort_array(F.collect_list("r")).alias("rows"))

    # ---- one pass: rows x specs
    wanted = lambda used, agg: F.coalesce(used & F.col(agg).isin("sum", "avg"), F.lit(False))
    is_real = lambda c: F.coalesce(_type(c) == "REAL", F.lit(False))
    flagged = sp.withColumns({
        "plain": is_plain, "top": is_top, "grouped": F.col("g_col").isNotNull(), "h_real": is_real(F.col("h_col")), "s_real": is_real(s1), "calc_real": calc_is_real(),
        "s1": s1, "s2": s2, "o_kind": F.coalesce("o_kind", F.lit("none")), "wide": wide,
    })
    flagged = flagged.withColumn("code", _packed()).withColumns({"h_sums": wanted(F.col("h_kind") == "agg", "h_agg"), "s_sums": wanted(F.col("s_kind") == "agg", "s_agg")})
    flagged = flagged.withColumn("h_num", F.col("h_lit").try_cast(kind)).withColumn("calcs", F.col("s_kind") == "calc")
    x = _join_specs(rows, flagged, salt_rows, admitted)
    hv, hc = _num(F.col("h_col")), _cell(F.col("h_col"))
    sc, sv = _cell(F.col("s1")), _num(F.col("s1"))
    calc_of = calculated(F.col("s_op"), sv, _num(F.col("s2")), kind, F.col("calc_real"))
    h_row_ok = F.when(F.col("h_test") == ANY, F.lit(True)).when(F.col("h_test") == NUMBER, _within(hv, "h")).otherwise(_two_columns(F.col("h_test"), hv, _num(F.col("h_rcol"))))
    gk = F.when(F.col("g_col").isNotNull(), _cell(F.col("g_col"))).otherwise(F.lit(""))
    part = F.when(F.col("plain"), F.floor(F.col("row_idx") / part_rows)).otherwise(F.lit(0).cast("bigint"))
    zero_one = F.when(F.col("plain"), F.when(F.col("calcs"), number_text(calc_of, kind, F.col("calc_real"))).otherwise(sc).isin("0", "1"))
    at = _top_key(_num(F.col("o_col")), F.col("o_desc"), kind) * F.lit(ROW_LIMIT).cast("decimal(14,0)")
    place = F.when(F.col("top"), at + F.col("row_idx").cast("decimal(13,0)")).cast("decimal(38,0)")
    # The same with rows counted from behind finds the last row of the least value: another one means a tie.
    behind = F.when(F.col("top"), at + (F.lit(ROW_LIMIT - 1) - F.col("row_idx")).cast("decimal(13,0)")).cast("decimal(38,0)")
    row_of = lambda c: F.pmod(F.col(c), F.lit(ROW_LIMIT).cast("decimal(38,0)")).cast("bigint")
    unlike = F.when(F.col("h_distinct"), hc)
    if sketch is not None:
        different = F.approx_count_distinct(unlike, sketch)
    else:  # the extra level only if some spec asks for it
        different = F.lit(None).cast("bigint") if specs.where("h_distinct").isEmpty() else F.count_distinct(unlike)
    g = x.groupBy(*SPEC_KEY, "code", "h_num", part.alias("part"), gk.alias("gk")).agg(
        F.count(F.lit(1)).alias("cnt"), F.min("row_idx").cast("bigint").alias("first_row"),
        F.max(zero_one).alias("has_01"), F.min(place).alias("place"), F.min(behind).alias("behind"),
        F.count(hc).alias("h_every_cnt"), different.alias("h_different"), F.max(hv).alias("h_max"), F.min(hv).alias("h_min"), total(F.when(F.col("h_sums"), hv), kind).alias("h_sum"),
        F.bool_and(F.coalesce(h_row_ok, F.lit(True))).alias("h_every"),
        F.count(sc).alias("s_cnt"), F.max(sv).alias("s_max"), F.min(sv).alias("s_min"), total(F.when(F.col("s_sums"), sv), kind).alias("s_sum"), F.count(sv).alias("s_nums"),
        F.min_by(F.when(F.col("calcs"), calc_of), F.col("row_idx")).alias("calc_first"),
    )
    every = pin(g.select("*", *_carried()).drop("code").withColumnRenamed("grouped", "by_group"), "answer-groups")
    every = every.withColumn("h_cnt", F.when(F.col("h_distinct"), F.col("h_different")).otherwise(F.col("h_every_cnt")))

    # ---- plain and top rows: what is known of them, and a lookup of the first or top row
    found = every.where(F.col("plain") | F.col("top")).groupBy(*SPEC_KEY, "plain").agg(
        F.sum("cnt").alias("n_selected"), F.count(F.lit(1)).alias("n_parts"), F.coalesce(F.bool_or("has_01"), F.lit(False)).alias("has_01"),
        F.min("first_row").alias("first_row"), F.min("place").alias("place"), F.min("behind").alias("behind"),
    )
    found = found.select(
        *SPEC_KEY, "plain", "n_selected", "n_parts", "has_01", F.when(F.col("plain"), F.col("first_row")).otherwise(row_of("place")).alias("row_idx"),
        F.coalesce(row_of("place") != F.lit(ROW_LIMIT - 1) - row_of("behind"), F.lit(False)).alias("ambiguous"),
    )
    looked_up = found.join(sp.select(*SPEC_KEY, "types", "s_kind", "s_cols", "s_op"), SPEC_KEY).join(rows, ["table_id", "row_idx"])
    best = pin(looked_up.select(*SPEC_KEY, "plain", "n_selected", "n_parts", "has_01", "ambiguous", answer_row(widest(sp.where(is_row))).alias("r")), "answer-rows")
    top = best.where(~F.col("plain")).select(*_part(F.array("r"), F.lit(0)))
    first_of = best.where("plain").select(
        *SPEC_KEY, F.col("n_selected").alias("n_ans_rows"), F.size("r.vals").alias("n_ans_cols"), "n_parts", "has_01", F.try_element_at("r.vals", F.lit(1)).alias("first_value")
    )

    # ---- aggregates
    h_lit = F.col("h_num")
    g = every.where(~F.col("plain") & ~F.col("top"))
    # A sum of whole numbers beyond BIGINT is an error there: the query has no answer.
    beyond = lambda used, real, v: used & ~real & ((v > (1 << 63) - 1) | (v < -(1 << 63)))
    over = beyond((F.col("s_kind") == "agg") & (F.col("s_agg") == "sum"), F.col("s_real"), F.col("s_sum"))
    over = F.coalesce(over, F.lit(False)) | F.coalesce(beyond((F.col("h_kind") == "agg") & (F.col("h_agg") == "sum"), F.col("h_real"), F.col("h_sum")), F.lit(False))
    failed = pin(g.where(over).select(*SPEC_KEY).distinct(), "answer-failed")
    fine = g.join(failed, SPEC_KEY, "left_anti")
    no_group = ~F.col("by_group")

    def pick(agg: Column, prefix: str) -> Column:
        return (
            F.when(agg == "count", F.coalesce(F.col(f"{prefix}_cnt"), F.lit(0)))
            .when(agg == "max", F.col(f"{prefix}_max"))
            .when(agg == "min", F.col(f"{prefix}_min"))
            .when(agg == "sum", F.col(f"{prefix}_sum"))
        )

    counted = lambda agg, real: F.col(real) & (F.col(agg) != "count")
    s_val = F.when(F.col("s_agg") == "avg", average(F.col("s_sum"), F.col("s_nums"), kind, F.col("s_real"))).otherwise(
        number_text(pick(F.col("s_agg"), "s"), kind, counted("s_agg", "s_real"))
    )
    h_val = pick(F.col("h_agg"), "h")
    h_text = number_text(h_val, kind, counted("h_agg", "h_real"))
    having = F.when(F.col("h_kind") == "agg", _cmp(h_val, F.col("h_op"), h_lit)).otherwise(
        F.col("h_every")
    )
    kept_group = F.col("by_group") & F.coalesce(having, F.lit(False))
    grp_out = fine.where(kept_group).select(
        *SPEC_KEY, "o_kind", "wide",
        F.lit(None).cast("bigint").alias("ord_i"), F.col("gk").alias("ord_s"),
        F.when(F.col("s_kind") == "group", F.array("gk"))
        .when(F.col("s_kind") == "group_agg", F.array(F.col("gk"), h_text))
        .when(F.col("s_kind") == "agg", F.array(s_val))
        .otherwise(F.array(number_text(F.col("calc_first"), kind, F.col("calc_real")))).alias("vals"),
        F.when(F.col("s_kind") == "group_agg", F.concat(F.lit("("), _py_repr(F.col("gk"), F.lit(False)), F.lit(", "), F.coalesce(h_text, F.lit("None")), F.lit(")"))).alias("tup"),
        F.when(F.col("o_kind") == "agg", h_val).alias("okey"), "o_desc",
    )
    grp_out = pin(grp_out, "answer-kept")
    # Global aggregates answer one row even over no rows: left join from the specs.
    gspec = sp.where(F.col("g_col").isNull() & (F.col("s_kind") == "agg")).select(*SPEC_KEY, "s_agg").join(failed, SPEC_KEY, "left_anti")
    gl = gspec.join(
        fine.where(no_group).drop("s_agg"), SPEC_KEY, "left"
    ).select(
        *SPEC_KEY, F.lit(0).cast("bigint").alias("ord_i"), F.lit(None).cast("string").alias("ord_s"),
        F.array(s_val).alias("vals"), F.lit(None).cast("string").alias("tup"),
    )

    # Of the groups a spec orders, the first by (NULL below every number, value, group).
    group_row = F.struct("ord_i", "ord_s", "vals", "tup")
    is_first = F.col("o_kind") == "agg"
    by = F.struct(order_key(F.col("okey"), F.col("o_desc")).alias("k"), "ord_s", group_row.alias("r"))
    top_group = grp_out.where(is_first).groupBy(*SPEC_KEY).agg(F.min(by).alias("m")).select(*_part(F.array("m.r"), F.lit(0)))
    # A table has no more groups than rows: those of a table that fits a part are one part, and need no numbers.
    in_parts = lambda some, part: some.groupBy(*SPEC_KEY, part.alias("part")).agg(F.sort_array(F.collect_list(group_row)).alias("rows"))
    listed = in_parts(grp_out.where(~is_first & ~F.col("wide")), F.lit(0).cast("bigint"))
    if not sp.where(F.col("g_col").isNotNull() & wide).isEmpty():
        numbered = row_index(grp_out.where(~is_first & F.col("wide")), SPEC_KEY, ["ord_s"])
        listed = listed.unionByName(in_parts(numbered, F.floor(F.col("row_idx") / part_rows)))
    listed = listed.select(*_part(F.col("rows"), F.col("part")))
    single = gl.select(*_part(F.array(group_row), F.lit(0)))

    few = pin(top.unionByName(top_group).unionByName(listed).unionByName(single), "answer-few")
    ties = grp_out.where(is_first).groupBy(*SPEC_KEY, order_key(F.col("okey"), F.col("o_desc")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    ties = ties.groupBy(*SPEC_KEY).agg(F.min(F.struct("k", "n")).alias("m")).select(*SPEC_KEY, (F.col("m.n") > 1).alias("ambiguous"))
    grouped = g.groupBy(*SPEC_KEY).agg(F.sum("cnt").alias("n_selected")).join(ties, SPEC_KEY, "left")
    # The first row of an aggregate's plain query: the first row of its first group (a missing group value comes first).
    origin = fine.where((F.col("s_kind") == "agg") & (no_group | kept_group)).groupBy(*SPEC_KEY).agg(F.min(F.struct("gk", "first_row")).alias("m"))
    origin = origin.select(*SPEC_KEY, F.col("m.first_row").alias("row_idx"))
    selected = best.where(~F.col("plain")).select(*SPEC_KEY, "n_selected", "ambiguous").unionByName(grouped)
    return Answers(pin(_facts(specs, few, first_of, selected, refused.unionByName(failed)), "answers"), few, plain, origin, lines)


def selected_rows(rows: DataFrame, specs: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``table_id, query_no, row_idx`` of every row that a spec's WHERE selects."""
    return _join_specs(rows, specs.select(*EXEC_COLS), salt_rows).select(*SPEC_KEY, "row_idx")


def matched(rows: DataFrame, specs: DataFrame, salt_rows: int = SALT_ROWS, admitted: DataFrame | None = None, also: Sequence[str] = ()) -> DataFrame:
    """``table_id, query_no, row_idx, cells, nums`` of every row that a spec's whole WHERE selects, ``also`` columns of the spec."""
    return _join_specs(rows, specs.select(*exec_columns(specs)), salt_rows, admitted).select(*SPEC_KEY, "row_idx", "cells", "nums", *also)


def _facts(specs: DataFrame, few: DataFrame, first_of: DataFrame, selected: DataFrame, failed: DataFrame) -> DataFrame:
    """One row per spec with what rules and texts need to know of its answer; a failed one has none.

    ``few`` are parts, ``first_of`` the facts of plain answers, whose parts need not be there.
    ``selected`` has the matched rows of specs that keep fewer, of the others every
    matched row is an answer row, and whether a top-1 spec is ``ambiguous``: other rows
    or groups have the same ORDER value (G5).
    """
    first = lambda r: F.try_element_at(r["vals"], F.lit(1))
    one = few.select(
        *SPEC_KEY, "part", F.size("rows").alias("n"), F.size(F.try_element_at("rows", F.lit(1))["vals"]).alias("c"),
        F.exists("rows", lambda r: F.coalesce(first(r), F.lit("None")).isin("0", "1")).alias("has_01"), first(F.try_element_at("rows", F.lit(1))).alias("v"),
    )
    found = one.groupBy(*SPEC_KEY).agg(
        F.sum("n").alias("n_ans_rows"), F.max("c").alias("n_ans_cols"), F.count(F.lit(1)).alias("n_parts"),
        F.bool_or("has_01").alias("has_01"), F.min_by("v", "part").alias("first_value"),
    ).unionByName(first_of)
    plain = F.col("g_col").isNull() & F.col("s_kind").isin("cols", "calc") & (F.col("o_kind") != "col")
    x = specs.select(*SPEC_KEY, "n_rows", "sql", plain.alias("plain")).join(found, SPEC_KEY, "left").join(selected, SPEC_KEY, "left")
    x = x.join(failed.withColumn("failed", F.lit(True)), SPEC_KEY, "left")
    n = F.coalesce("n_ans_rows", F.lit(0))
    return x.select(
        *SPEC_KEY, "n_rows", "sql", n.alias("n_ans_rows"), F.coalesce("n_ans_cols", F.lit(0)).alias("n_ans_cols"),
        F.coalesce("n_parts", F.lit(0)).alias("n_parts"), F.coalesce("has_01", F.lit(False)).alias("has_01"), "first_value",
        F.when(F.col("failed"), 0).when(F.col("plain"), n).otherwise(F.coalesce("n_selected", F.lit(0))).alias("n_selected"), F.coalesce("failed", F.lit(False)).alias("failed"),
        F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"),
    )


def group_aggregate(header: Column) -> Column:
    """The aggregate of a group as the SQL names it: ``count ( h )``, ``count ( distinct h )``."""
    return F.concat(F.col("h_agg"), F.when(F.col("h_distinct"), " ( distinct ").otherwise(" ( "), F.try_element_at(header, F.col("h_col") + 1), F.lit(" )"))


def answer_tables(ans: Answers, specs: DataFrame, fmt: str = "markdown") -> DataFrame:
    """Every answer as a formatted table, ``(table_id, query_no, chunk, text)``.

    Headers are the select expressions as the SQL names them (``max ( x )``,
    ``a + b``, ``g, count ( h )``); rows keep the answer order.  Rows are
    numbered with the skew-safe index and rendered by ``render`` (chunked
    past its row bound), so no answer passes through one task whole.
    """
    from tabqa.operators import render as M

    name = lambda c: F.try_element_at(F.col("header"), c + 1)
    s1 = F.try_element_at(F.col("s_cols"), F.lit(1))
    s2 = F.try_element_at(F.col("s_cols"), F.lit(2))
    hdr = (
        F.when(F.col("s_kind") == "calc", F.array(F.concat(name(s1), F.lit(" "), F.col("s_op"), F.lit(" "), name(s2))))
        .when(F.col("s_kind") == "agg", F.array(F.concat(F.col("s_agg"), F.lit(" ( "), name(s1), F.lit(" )"))))
        .when(F.col("s_kind") == "group", F.array(name(F.col("g_col"))))
        .when(F.col("s_kind") == "group_agg", F.array(name(F.col("g_col")), group_aggregate(F.col("header"))))
        .otherwise(F.transform("s_cols", lambda c: name(c)))
    )
    typ = (
        F.when(F.col("s_kind").isin("calc", "agg"), F.array(F.lit("INT")))  # a number
        .when(F.col("s_kind") == "group", F.array(F.lit("TEXT")))
        .when(F.col("s_kind") == "group_agg", F.array(F.lit("TEXT"), F.lit("INT")))
        .otherwise(F.transform("s_cols", lambda c: F.try_element_at(F.col("types"), c + 1)))
    )
    meta0 = specs.select("table_id", "query_no", hdr.alias("header"), typ.alias("types"))
    r = ans.answer_rows.select("table_id", "query_no", F.coalesce("ord_i", F.lit(0)).alias("oi"), F.coalesce("ord_s", F.lit("")).alias("os"),
                               F.transform("vals", lambda v: F.coalesce(v, F.lit("None"))).alias("cells"))
    r = row_index(r, SPEC_KEY, ["oi", "os"])
    n = r.groupBy(*SPEC_KEY).agg(F.count(F.lit(1)).alias("n_rows"))
    meta = meta0.join(n, SPEC_KEY, "left").select(*SPEC_KEY, "header", "types", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.size("header").alias("n_cols"))
    return M.render(r.select(*SPEC_KEY, "row_idx", "cells"), meta, fmt, key=SPEC_KEY)
