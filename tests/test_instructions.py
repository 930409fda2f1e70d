"""Hand-made goldens of the multi-turn instruction."""

import pytest
from pyspark.sql import functions as F

from tabqa.operators.instructions import multiturn

HEADER = ["name", "city", "n", "size"]
CASES = [
    (
        "select name from my_table where city = 'x' and n > 3",
        "Filter the row according to the condition, the cells of the specified column in the row need to meet: city = 'x' and n > 3.Select cell of 'name' column in filtered rows.",
        "根据条件筛选行，行中指定列的单元格需要满足： city = 'x' and n > 3.选择已筛选的行中的 'name' 列的值作为答案",
    ),
    (
        "select sum ( size ) from my_table",
        "Select cell of 'size' column in filtered rows and then calculate their sum.",
        "选择已筛选的行中的 'size' 列的值，然后求它们的和作为答案.",
    ),
    (
        "select city from my_table group by city having count ( size ) > 2 order by size desc limit 1",
        "Then group all rows by the value of the 'city' in each row.The filtering is then done by group, the filtering conditions are: The rows in the group satisfy the number 'size' > 2."
        "Select cell of 'city' column in filtered rows.Finally, these cells are sorted in descending order according to 'size' of the row they are located, and the cell of 'city' column that corresponds to the largest 'size' in each row is the final answer.",
        "然后根据每行中 'city' 的值对所有行进行分组。然后按组进行筛选，筛选条件为: 组中的行满足 'size'的数量 > 2.选择已筛选的行中的 'city' 列的值作为答案最终, 这些值按 它们所在行的'size'列的值 降序 排序，然后选择 最大值",
    ),
    (
        "select city from my_table group by city having count ( * ) > 2 order by count ( * ) asc limit 1",
        "Then group all rows by the value of the 'city' in each row.The filtering is then done by group, the filtering conditions are: Number of rows in group  > 2."
        "Select cell of 'city' column in filtered rows.Finally, these cells are sorted in ascending order according to total number of each group, and the cell of 'city' column with the smallest number is selected.",
        "然后根据每行中 'city' 的值对所有行进行分组。然后按组进行筛选，筛选条件为:  > 2组中行的数量.选择已筛选的行中的 'city' 列的值作为答案最终, 这些值按 它们所在行的数量升序 排序，然后选择 最小值",
    ),
]


@pytest.mark.parametrize("sql,en,zh", CASES)
def test_sentences(spark, sql, en, zh):
    # Names are found as substrings, so "n" would be found in "count"; a header without it.
    header = [h for h in HEADER if h != "n"]
    df = spark.createDataFrame([(sql, header)], "sql string, header array<string>")
    r = df.select(multiturn(F.col("sql"), F.col("header")).alias("en"), multiturn(F.col("sql"), F.col("header"), zh=True).alias("zh")).first()
    assert (r.en, r.zh) == (en, zh)
