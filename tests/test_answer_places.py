"""The place of an answer: asked of kept queries alone, and found without a row per cell."""

from tabqa.operators import controls as K
from tabqa.plans import instance_scoring as IS
from tabqa.plans import load_all

SF = "/root/testdata/sf0.001"


def test_places_equal_brute_force_and_cells_stay_in_their_rows(spark):
    tables = {1: [["a", "b"], ["b", None], ["x", "a"]], 2: [["b", "q"], [None, "a"]], 3: [[None, None]]}
    rows = spark.createDataFrame([(t, i, cells) for t, rs in tables.items() for i, cells in enumerate(rs)], "table_id bigint, row_idx bigint, cells array<string>")
    asked = [(1, 0, 1, "a"), (1, 1, 1, "b"), (1, 2, 1, "zz"), (1, 3, 2, "x"), (2, 0, 1, "a"), (2, 1, 1, None), (3, 0, 1, "a"), (4, 0, 1, "a")]
    answers = spark.createDataFrame(asked, "table_id bigint, query_no int, n_ans_rows bigint, first_value string")
    found = K.answer_position(answers, rows)

    def place(t, n, v):
        return next(((i, j) for i, cells in enumerate(tables.get(t, [])) for j, c in enumerate(cells) if n == 1 and v is not None and c == v), (-1, -1))

    assert {(r.table_id, r.query_no): (r.ans_row, r.ans_col) for r in found.collect()} == {(t, q): place(t, n, v) for t, q, n, v in asked}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("arrays_overlap")  # cells become rows above the join with the values


def test_only_scores_by_row_look_for_places(spark, monkeypatch):
    load_all()
    calls = []
    real = K.answer_position
    monkeypatch.setattr(K, "answer_position", lambda answers, *a: calls.append(answers.columns) or real(answers, *a))
    assert IS.evl_inst_by_clause(spark, SF).count() and IS.evl_inst_by_tokens(spark, SF).count() and not calls
    assert IS.evl_inst_by_row(spark, SF).count() and "rejected_by" in calls[0]
