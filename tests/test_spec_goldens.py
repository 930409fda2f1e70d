"""Hand-made goldens: SQL text and instructions of fixed specs, one per template and clause form."""

import pytest

from tabqa.functions.dialect import SPARK
from tabqa.operators import specs as S

HEADER, TYPES = ["name", "day", "age", "pay"], ["TEXT", "DATE", "INT", "INT"]
COLUMNS = {
    "table_id": "bigint", "query_no": "int", "tpl": "string", "n_rows": "bigint", "n_cols": "int", "header": "array<string>", "types": "array<string>", "ic": "array<int>",
    "w_n": "int", "w_cc": "boolean", "w1_col": "int", "w1_rcol": "int", "w1_op": "string", "w1_num": "boolean", "w1_nin": "int", "w2_col": "int", "w2_op": "string",
    "w2_num": "boolean", "w2_nin": "int", "g_col": "int", "h_kind": "string", "h_col": "int", "h_rcol": "int", "h_op": "string", "h_agg": "string", "h_distinct": "boolean", "h_n1": "int",
    "s_kind": "string", "s_cols": "array<int>", "s_op": "string", "s_agg": "string", "o_kind": "string", "o_col": "int", "o_desc": "boolean",
    "w1_v1": "string", "w1_v2": "string", "w1_v3": "string", "w2_v1": "string", "w2_v2": "string", "w2_v3": "string", "h_lit": "string",
}
BASE = {"table_id": 1, "query_no": 0, "n_rows": 9, "n_cols": 4, "header": HEADER, "types": TYPES, "ic": [2, 3], "w_n": 0, "w_cc": False, "w1_num": False, "w2_num": False, "w1_nin": 2, "w2_nin": 2,
        "h_distinct": False, "h_n1": 1, "s_kind": "cols", "s_cols": [0], "o_kind": "none", "o_desc": False}
FILTER = "Please filter the rows by the column conditions, which need to be met: "
GROUP = "The rows are then grouped according to the value of the name in the remaining rows.\n"
HAVING = "Then filter some groups by the following condition:"

CASES = [
    ({"tpl": "s1", "s_cols": [0, 2]}, "select name,age from my_table", "Select values of ['name', 'age'] column in filtered rows."),
    ({"tpl": "s1", "s_kind": "calc", "s_cols": [2, 3], "s_op": "+"}, "select age + pay from my_table", "Select calculate sum of the values in columns age and pay in filtered rows."),
    ({"tpl": "s1", "s_kind": "calc", "s_cols": [2, 3], "s_op": "-"}, "select age - pay from my_table", "Select calculate difference between the values in columns age and pay in filtered rows."),
    ({"tpl": "s1", "s_kind": "agg", "s_agg": "max", "s_cols": [3]}, "select max ( pay ) from my_table", "Select the maximum value of values of pay column in filtered rows."),
    ({"tpl": "s1", "s_kind": "agg", "s_agg": "count", "s_cols": [0]}, "select count ( name ) from my_table", "Select the number of cells of name column in filtered rows."),
    ({"tpl": "s2", "w_n": 1, "w1_col": 0, "w1_op": "=", "w1_v1": "Al"}, "select name from my_table where name = 'Al'", FILTER + "The value of column name is 'Al'.\nSelect values of ['name'] column in filtered rows."),
    ({"tpl": "s2", "w_n": 1, "w1_col": 1, "w1_op": "like", "w1_v1": "2001-02-03"}, "select name from my_table where day like '200%'", FILTER + "The value of column day is required to fuzzy match '200%'.\nSelect values of ['name'] column in filtered rows."),
    ({"tpl": "s2", "w_n": 1, "w1_col": 0, "w1_op": "in", "w1_v1": "a", "w1_v2": "b", "w1_v3": "c"}, "select name from my_table where name in ( 'a' , 'b' )", FILTER + "The value of column name is either 'a' or 'b'.\nSelect values of ['name'] column in filtered rows."),
    ({"tpl": "s2", "w_n": 1, "w1_col": 0, "w1_op": "in", "w1_nin": 3, "w1_v1": "a", "w1_v2": "b", "w1_v3": "c"}, "select name from my_table where name in ( 'a' , 'b' , 'c' )", FILTER + "The value of column name is either 'a' or 'b' or 'c'.\nSelect values of ['name'] column in filtered rows."),
    ({"tpl": "s2", "w_n": 2, "w1_col": 2, "w1_op": ">", "w1_num": True, "w1_v1": "7", "w2_col": 0, "w2_op": "=", "w2_v1": "x"}, "select name from my_table where age > 7 and name = 'x'", FILTER + "The value of column age needs to be greater than 7. The value of column name is 'x'.\nSelect values of ['name'] column in filtered rows."),
    ({"tpl": "s2", "w_n": 1, "w_cc": True, "w1_col": 2, "w1_rcol": 3, "w1_op": "<", "w1_num": True}, "select name from my_table where age < pay", FILTER + "The value of column age needs to be less than the value of column pay.\nSelect values of ['name'] column in filtered rows."),
    ({"tpl": "s3", "o_kind": "col", "o_col": 2}, "select name from my_table order by age asc limit 1", "Select values of ['name'] column in filtered rows.Sort the obtained values in ascending order of age and select the smallest value to get the answer.\n"),
    ({"tpl": "s4", "w_n": 1, "w1_col": 2, "w1_op": "=", "w1_num": True, "w1_v1": "5", "o_kind": "col", "o_col": 3, "o_desc": True}, "select name from my_table where age = 5 order by pay desc limit 1", FILTER + "The value of column age needs to be equal to 5.\nSelect values of ['name'] column in filtered rows.Sort the obtained values in descending order of pay and select the largest value to get the answer.\n"),
    ({"tpl": "s5", "g_col": 0, "h_kind": "agg", "h_agg": "count", "h_col": 1, "h_op": ">", "h_lit": "2", "s_kind": "group"}, "select name from my_table group by name having count ( day ) > 2", GROUP + HAVING + "the number of column day is greater than 2.\nSelect values of ['name'] column in filtered rows."),
    ({"tpl": "s5", "g_col": 0, "h_kind": "agg", "h_agg": "sum", "h_col": 3, "h_op": "<", "h_lit": "40", "s_kind": "group_agg", "s_cols": [0, 3]}, "select name, sum ( pay ) from my_table group by name having sum ( pay ) < 40", GROUP + HAVING + "the sum of the values of column pay is less than 40.\nSelect values of name column and the sum of the values of pay in filtered rows."),
    ({"tpl": "s6", "w_n": 1, "w1_col": 2, "w1_op": ">", "w1_num": True, "w1_v1": "1", "g_col": 0, "h_kind": "bare", "h_col": 3, "h_op": ">", "h_lit": "9", "s_kind": "group"}, "select name from my_table where age > 1 group by name having pay > 9", FILTER + "The value of column age needs to be greater than 1.\n" + GROUP + HAVING + "the column pay is greater than 9.\nSelect values of ['name'] column in filtered rows."),
    ({"tpl": "s5", "g_col": 0, "h_kind": "colcol", "h_col": 2, "h_rcol": 3, "h_op": "<", "s_kind": "group"}, "select name from my_table group by name having age < pay", None),
    ({"tpl": "s7", "w_n": 1, "w1_col": 2, "w1_op": "<", "w1_num": True, "w1_v1": "8", "g_col": 0, "h_kind": "agg", "h_agg": "min", "h_col": 3, "h_op": ">", "h_lit": "3", "s_kind": "group", "o_kind": "agg", "o_col": 3, "o_desc": True}, "select name from my_table where age < 8 group by name having min ( pay ) > 3 order by min ( pay ) desc limit 1", FILTER + "The value of column age needs to be less than 8.\n" + GROUP + HAVING + "the minimum value of column pay is greater than 3.\nSelect values of ['name'] column in filtered rows.Sort the obtained values in descending order of the minimum value of pay and select the largest value to get the answer.\n"),
    ({"tpl": "s8", "g_col": 0, "h_kind": "agg", "h_agg": "count", "h_col": 2, "h_op": "<", "h_lit": "4", "s_kind": "group", "o_kind": "agg", "o_col": 2}, "select name from my_table group by name having count ( age ) < 4 order by count ( age ) asc limit 1", GROUP + HAVING + "the number of column age is less than 4.\nSelect values of ['name'] column in filtered rows.Sort the obtained values in ascending order of the number of age and select the smallest value to get the answer.\n"),
    ({"tpl": "s8", "g_col": 0, "h_kind": "agg", "h_agg": "count", "h_distinct": True, "h_col": 2, "h_op": "=", "h_lit": "4", "s_kind": "group", "o_kind": "agg", "o_col": 2, "o_desc": True}, "select name from my_table group by name having count ( distinct age ) = 4 order by count ( distinct age ) desc limit 1", None),
    ({"tpl": "s5", "g_col": 0, "h_kind": "agg", "h_agg": "count", "h_distinct": True, "h_col": 1, "h_op": ">", "h_lit": "2", "s_kind": "group"}, "select name from my_table group by name having count ( distinct day ) > 2", GROUP + HAVING + "the number of distinct values of column day is greater than 2.\nSelect values of ['name'] column in filtered rows."),
]
# The Chinese instruction of some of these, by place in CASES: where, group, having, select and order, a line each.
CHINESE = {
    0: "\n\n\n选择，已筛选行中的 name, age 列\n",
    3: "\n\n\n选择，已筛选行中的pay 列，并求最大值\n",
    4: "\n\n\n选择，已筛选行中的name 列的数量\n",
    5: "请按需要满足的列条件筛选行： 列 name 的值是 'Al'.\n\n\n选择，已筛选行中的 name 列\n",
    9: "请按需要满足的列条件筛选行： 列 age 的值 大于 7. 列 name 的值是 'x'.\n\n\n选择，已筛选行中的 name 列\n",
    11: "\n\n\n选择，已筛选行中的 name 列\n将已选择的值按 升序 age排序，并且选择最小的值。",
    13: "\n然后根据剩余行中name的值对行进行分组.\n然后根据以下条件筛选某些组：day 列的数量 大于 2.\n选择，已筛选行中的 name 列\n",
    15: "请按需要满足的列条件筛选行： 列 age 的值 大于 1.\n然后根据剩余行中name的值对行进行分组.\n然后根据以下条件筛选某些组：pay 列 大于 9.\n选择，已筛选行中的 name 列\n",
    18: "\n然后根据剩余行中name的值对行进行分组.\n然后根据以下条件筛选某些组：age 列的数量 小于 4.\n选择，已筛选行中的 name 列\n将已选择的值按 age 列的数量 升序排序，并且选择最小的值。",
    19: "\n然后根据剩余行中name的值对行进行分组.\n然后根据以下条件筛选某些组：age 列未重复的数量 等于 4.\n选择，已筛选行中的 name 列\n将已选择的值按 age 列未重复的数量 降序排序，并且选择最大的值。",
    20: "\n然后根据剩余行中name的值对行进行分组.\n然后根据以下条件筛选某些组：day 列未重复的数量 大于 2\n选择，已筛选行中的 name 列\n",
}


@pytest.fixture(scope="module")
def written(spark):
    rows = [tuple({**BASE, **c[0]}.get(k) for k in COLUMNS) for c in CASES]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} {t}" for k, t in COLUMNS.items()))
    out = S._run_stages(df, S.render_sql(SPARK) + S.instruction_sql(SPARK) + S.instruction_zh_sql(SPARK))
    return {r.table_id: (r.sql, r.multistep, r.multistep_zh) for r in out.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_sql_and_instruction(written, i):
    _, sql, text = CASES[i]
    assert written[i][0] == sql
    if text is not None:
        assert written[i][1] == text
    if i in CHINESE:
        assert written[i][2] == CHINESE[i]
