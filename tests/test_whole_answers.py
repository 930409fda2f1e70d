"""An answer is whole wherever its rows lie in the table."""

from conftest import SF

from tabqa.operators import batch as B
from tabqa.operators import controls as K
from tabqa.operators import specs as S
from tabqa.sources import corpus as C
from tabqa.sources.tables import Tables


def test_answer_texts_are_the_same_in_any_parts(spark):
    c = C.lineitem_by_supplier(Tables(spark, SF).lineitem).materialize()
    specs = S.draw(c.tables, c.rows, S.SpecParams(seed=42, per_table=20))
    seen = []
    for n in (7, 10_000):
        ans = B.execute(c.rows, specs, part_rows=n)
        whole = sorted(((r.table_id, r.query_no, r.answer, r.answer_list) for r in ans.assembled().texts().collect()), key=str)
        kept = K.apply(specs, ans, c.rows, K.Controls()).where("rejected_by is null").select("table_id", "query_no", "answer").collect()
        seen.append((whole, sorted(map(tuple, kept), key=str)))
        assert (ans.answers.where("n_parts > 1").count() > 0) == (n == 7)
    assert seen[0] == seen[1] and len(seen[0][0]) == specs.count() and all(k[2] is not None for k in seen[0][1])
