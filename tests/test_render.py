"""Hand-made goldens for the text formats (FIXTURES §5)."""

import pytest

from tabqa.operators import render as M


@pytest.fixture(scope="module")
def tiny(spark):
    rows = spark.createDataFrame(
        [(1, 0, ["Ab", "1"], [None, 1]), (1, 1, ["c", "20"], [None, 20])],
        "table_id bigint, row_idx int, cells array<string>, nums array<bigint>",
    )
    tables = spark.createDataFrame(
        [(1, ["name", "n"], ["TEXT", "INT"], 2, 2)],
        "table_id bigint, header array<string>, types array<string>, n_rows int, n_cols int",
    )
    return rows, tables


def text(tiny, fmt):
    rows, tables = tiny
    return M.render(rows, tables, fmt).collect()[0]["text"]


def test_markdown(tiny):
    assert text(tiny, "markdown") == "| name   |   n |\n|:-------|----:|\n| Ab     |   1 |\n| c      |  20 |"


def test_flatten(tiny):
    assert text(tiny, "flatten") == (
        "The table have 2 columns: name | n\nrow 1 : name is ab. n is 1. \nrow 2 : name is c. n is 20. \n"
    )


def test_tapex(tiny):
    assert text(tiny, "tapex") == "header: name | n\nrow 1 : ab | 1\nrow 2 : c | 20\n"


def test_matrix(tiny):
    assert text(tiny, "matrix") == "[\n  ['', 'name', 'n']\n  [0, 'Ab', 1]\n  [1, 'c', 20]\n]"


def test_json(tiny):
    assert text(tiny, "json") == '{"0":{"name":"Ab","n":1},"1":{"name":"c","n":20}}'


def test_csv(tiny):
    assert text(tiny, "csv") == ",name,n\n0,Ab,1\n1,c,20\n"


def test_tab(tiny):
    assert text(tiny, "tab") == "  name   n\n0   Ab   1\n1    c  20"


def test_dfloader(tiny):
    assert text(tiny, "dfloader") == "pd.DataFrame({\n    'name': ['Ab', 'c'],\n    'n': [1, 20],\n},\nindex=[0, 1])"


def test_tab_wide_index(spark):
    rows = spark.createDataFrame(
        [(1, i, ["Abcdef", "1"], [None, 1]) for i in range(12)],
        "table_id bigint, row_idx int, cells array<string>, nums array<bigint>",
    )
    tables = spark.createDataFrame(
        [(1, ["name", "n"], ["TEXT", "INT"], 12, 2)],
        "table_id bigint, header array<string>, types array<string>, n_rows int, n_cols int",
    )
    t = M.render(rows, tables, "tab").collect()[0]["text"]
    assert t.split("\n")[:2] == ["      name  n", "0   Abcdef  1"]
    assert t.split("\n")[-1] == "11  Abcdef  1"


def test_markdown_index(tiny):
    assert text(tiny, "markdown_index") == (
        "|    | name   |   n |\n|---:|:-------|----:|\n|  0 | Ab     |   1 |\n|  1 | c      |  20 |"
    )


def test_html(tiny):
    t = text(tiny, "html")
    assert t.startswith('<table border="1" class="dataframe">\n  <thead>\n    <tr style="text-align: right;">\n      <th></th>\n')
    assert "    <tr>\n      <th>1</th>\n      <td>c</td>\n      <td>20</td>\n    </tr>\n" in t
    assert t.endswith("  </tbody>\n</table>")


def test_chunks_keep_every_row(spark, tiny):
    rows, tables = tiny
    out = M.render(rows, tables, "tapex", part_rows=1).orderBy("chunk").collect()
    assert [r["text"] for r in out] == ["header: name | n\nrow 1 : ab | 1\n", "row 2 : c | 20\n"]
