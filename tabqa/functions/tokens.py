"""Token counting for budgets.

The default counter is a word/punctuation split, ``\\w+|[^\\w\\s]``, run
JVM-side.  A model tokenizer can be plugged in as any Column function,
e.g. an Arrow-batched ``pandas_udf`` wrapping a local tokenizer; because
tokens never cross whitespace with the default counter, a table's count is
the sum of its lines' counts (an algebraic aggregate).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"\w+|[^\w\s]"

Counter = Callable[[Column], Column]


def count_tokens(s: Column) -> Column:
    return F.size(F.regexp_extract_all(s, F.lit(TOKEN_PATTERN), 0))


def pandas_counter(encode: Callable[[str], list]) -> Counter:
    """Wrap a Python tokenizer as an Arrow-batched counter (slow path, opt-in)."""
    import pandas as pd

    @F.pandas_udf("int")
    def _count(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else len(encode(x))).astype("Int32")

    return _count
