"""Multi-turn instruction of a query, read from its SQL text (M19), in English and Chinese.

One sentence per clause present (where, group by, having, select, order by),
joined without a separator.  Columns are found by name as substrings of a
clause, in header order, as the reference does; its swap of the largest and
smallest value in the Chinese order sentence and an unfilled place there are mended.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AGGS = ["sum", "count", "min", "max", "avg"]

# The sentences ({} = what the clause names).
EN = {
    "where": "Filter the row according to the condition, the cells of the specified column in the row need to meet:{}.",
    "group": "Then group all rows by the value of the '{}' in each row.",
    "having": "The filtering is then done by group, the filtering conditions are: {}.",
    "having_rows": "Number of rows in group {}",
    "having_agg": "The rows in the group satisfy {} {}",
    "having_other": "The rows in the group satisfy {}",
    "having_of": {"sum": "the sum of '{}'", "count": "the number '{}'", "min": "the smallest of '{}'", "max": "the largest of '{}'", "avg": "the average of '{}'"},
    "rows": "The final answer is the number of filtered rows.",
    "rows_agg": "Select all column of filtered rows and then {} to get the final answer.",
    "select": "Select cell of '{}' column in filtered rows.",
    "select_agg": "Select cell of '{}' column in filtered rows and then {}.",
    "select_of": {"sum": "calculate their sum", "count": "count them", "min": "find the smallest of them", "max": "find the largest of them", "avg": "calculate their average"},
    "order_of": {"sum": "the sum of {}", "count": "the number of {}", "min": "the min of {}", "max": "the max of {}", "avg": "the avg of {}"},
    "difference": "the difference of {} and {}",
    "asc": ("ascending", "smallest"),
    "desc": ("descending", "largest"),
}
ZH = {
    "where": "根据条件筛选行，行中指定列的单元格需要满足：{}.",
    "group": "然后根据每行中 '{}' 的值对所有行进行分组。",
    "having": "然后按组进行筛选，筛选条件为: {}.",
    "having_rows": "{}组中行的数量",
    "having_agg": "组中的行满足 {} {}",
    "having_other": "组中的行满足 {}",
    "having_of": {"sum": "'{}'的和", "count": "'{}'的数量", "min": "'{}'的最小值", "max": "'{}'的最大值", "avg": "'{}'的平均值"},
    "rows": "最终的答案，是筛选的到的行的数量",
    "rows_agg": "选择已筛选的行中的所有列，然后求它们{}作为答案",
    "select": "选择已筛选的行中的 '{}' 列的值作为答案",
    "select_agg": "选择已筛选的行中的 '{}' 列的值，然后求它们{}作为答案.",
    "select_of": {"sum": "的和", "count": "的数量", "min": "的最小值", "max": "的最大值", "avg": "的平均值"},
    "order_of": {"sum": "{}的和", "count": "{}的数量", "min": "{}的最小值", "max": "{}的最大值", "avg": "{}的平均值"},
    "difference": " {} 和 {} 之差",
    "asc": ("升序", "最小值"),
    "desc": ("降序", "最大值"),
}


def _say(template: str, *values: Column) -> Column:
    """A sentence with its places filled in."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for v, rest in zip(values, parts[1:], strict=True):
        out += [v, F.lit(rest)]
    return F.concat(*out)


def _columns(text: Column, header: Column) -> Column:
    """Header names that occur in a clause, or ``*`` if it has one."""
    return F.when(text.contains("*"), F.array(F.lit("*"))).otherwise(F.filter(header, lambda h: text.contains(h)))


def _by_agg(text: Column, words: dict[str, str], *values: Column, spaced: bool = False, last: bool = False) -> Column:
    """The phrase of the first (or last) aggregate word that a clause contains; null without any."""
    out = F.lit(None).cast("string")
    for agg in AGGS if last else reversed(AGGS):
        phrase = _say(words[agg], *values[: words[agg].count("{}")])
        out = F.when(text.contains(f" {agg} " if spaced else agg), phrase).otherwise(out)
    return out


def multiturn(sql: Column, header: Column, zh: bool = False) -> Column:
    """The instruction text of a query."""
    say = ZH if zh else EN
    clause = lambda pattern: F.regexp_extract(sql, pattern, 1)
    where = F.concat(F.lit(" "), F.trim(clause(r"where(.*?)(?:group by|having|order by|$)")))
    group = clause(r"\bgroup\s+by\b\s+(\w+)")
    having = F.concat(F.lit(" "), F.trim(clause(r"having(.*?)(?:order by|$)")))
    select = F.trim(clause(r"(select.*?)from"))
    order = clause(r"(order\sby.*)")

    first = lambda text: F.get(_columns(text, header), F.lit(0))
    ends = F.array_join(F.slice(F.split(having, " "), -2, 2), " ")
    having_of = _by_agg(having, say["having_of"], first(having))
    condition = (
        F.when(having.contains("count ( * )"), _say(say["having_rows"], F.substring_index(having, "count ( * )", -1)))
        .when(having_of.isNotNull(), _say(say["having_agg"], having_of, ends))
        .otherwise(_say(say["having_other"], having))
    )
    column = first(select)
    # Of several aggregate words the last in the list counts in a select, as each overwrites the one before.
    select_of = _by_agg(select, say["select_of"], spaced=True, last=True)
    chosen = (
        F.when((column == "*") & select_of.isNull(), F.lit(say["rows"]))
        .when(column == "*", _say(say["rows_agg"], select_of))
        .when(select_of.isNull(), _say(say["select"], column))
        .otherwise(_say(say["select_agg"], column, select_of))
    )
    named = _columns(order, header)
    by = F.when(F.size(named) > 1, _say(say["difference"], F.get(named, F.lit(0)), F.get(named, F.lit(1)))).otherwise(F.get(named, F.lit(0)))
    down = order.contains("desc")
    sort, top = (F.when(down, say["desc"][k]).otherwise(say["asc"][k]) for k in (0, 1))
    order_of = _by_agg(order, say["order_of"], F.concat(by, F.lit("的值")) if zh else by, last=True)
    if zh:
        ordered = (
            F.when(order_of.isNull(), _say("最终, 这些值按 它们所在行的'{}'列的值 {} 排序，然后选择 {}", by, sort, top))
            .when(by == "*", _say("最终, 这些值按 它们所在行的数量{} 排序，然后选择 {}", sort, top))
            .otherwise(_say("最终, 这些值按 它们所在行的 '{}' {} 排序，然后选择 {}", order_of, sort, top))
        )
    else:
        whole = "Finally, these cells are sorted in {} order according to '{}' of the row they are located, and the cell of '{}' column that corresponds to the {} '{}' in each row is the final answer."
        count = "Finally, these cells are sorted in {} order according to total number of each group, and the cell of '{}' column with the {} number is selected."
        ordered = (
            F.when(order_of.isNull(), _say(whole, sort, by, column, top, by))
            .when(by == "*", _say(count, sort, column, top))
            .otherwise(_say(whole, sort, order_of, column, top, order_of))
        )
    nothing = F.lit("")
    return F.concat(
        F.when(where != " ", _say(say["where"], where)).otherwise(nothing),
        F.when(group != "", _say(say["group"], group)).otherwise(nothing),
        F.when(having != " ", _say(say["having"], condition)).otherwise(nothing),
        chosen,
        F.when(order != "", ordered).otherwise(nothing),
    )
