"""Spellings of the few SQL constructs that differ between Spark SQL and
DuckDB: the hash, array access, lambdas and ranges.

Query-spec drawing is a chain of column expressions; writing each
expression once against this adapter lets Spark run it (``selectExpr``)
and lets the DuckDB oracle run the same draws independently.
"""

from __future__ import annotations


class SparkDialect:
    name = "spark"

    def h(self, k: str) -> str:
        return f"CAST(conv(substr(md5({k}), 1, 8), 16, 10) AS BIGINT)"

    def key(self, *parts: str) -> str:
        return "concat_ws('|', " + ", ".join(f"CAST({p} AS STRING)" for p in parts) + ")"

    def at(self, arr: str, i1: str) -> str:  # 1-based, NULL when out of range
        return f"try_element_at({arr}, CAST({i1} AS INT))"

    def size(self, arr: str) -> str:
        return f"size({arr})"

    def filt(self, arr: str, v: str, cond: str) -> str:
        return f"filter({arr}, {v} -> {cond})"

    def tr(self, arr: str, v: str, expr: str) -> str:
        return f"transform({arr}, {v} -> {expr})"

    def rng(self, n: str) -> str:  # 0 .. n-1, empty when n <= 0
        return f"slice(sequence(0, greatest({n}, 1) - 1), 1, greatest({n}, 0))"

    def rng1(self, lo: str, hi: str) -> str:  # lo .. hi-1
        return f"slice(sequence({lo}, greatest({hi}, {lo} + 1) - 1), 1, greatest({hi} - {lo}, 0))"

    def contains(self, arr: str, x: str) -> str:
        return f"array_contains({arr}, {x})"

    def arr(self, *xs: str) -> str:
        return "array(" + ", ".join(xs) + ")"

    def cat(self, a: str, b: str) -> str:
        return f"concat({a}, {b})"

    def join(self, arr: str, sep: str) -> str:
        return f"array_join({arr}, {sep})"

    def s(self, x: str) -> str:
        return f"CAST({x} AS STRING)"

    def squeeze(self, x: str) -> str:
        return f"regexp_replace({x}, ' {{2}}', ' ')"

    def slice(self, arr: str, n: str) -> str:
        return f"slice({arr}, 1, {n})"

    def lowest(self, arr: str, rank, n: str) -> str:
        """The ``n`` elements of least ``rank(element)``, then least element, in the array's order; ranks are worked out once an element."""
        ranked = f"array_sort(transform({arr}, y -> struct({rank('y')} AS r, y AS y)))"
        return f"array_intersect({arr}, slice(transform({ranked}, z -> z.y), 1, {n}))"

    def sum_arr(self, arr: str) -> str:
        return f"aggregate({arr}, CAST(0 AS BIGINT), (a, x) -> a + x)"


class DuckDialect(SparkDialect):
    name = "duckdb"

    def h(self, k: str) -> str:
        return f"(('0x' || substr(md5({k}), 1, 8))::BIGINT)"

    def key(self, *parts: str) -> str:
        return "concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"

    def at(self, arr: str, i1: str) -> str:
        return f"({arr})[{i1}]"

    def size(self, arr: str) -> str:
        return f"len({arr})"

    def filt(self, arr: str, v: str, cond: str) -> str:
        return f"list_filter({arr}, lambda {v}: {cond})"

    def tr(self, arr: str, v: str, expr: str) -> str:
        return f"list_transform({arr}, lambda {v}: {expr})"

    def rng(self, n: str) -> str:
        return f"CAST(range(0, {n}) AS INTEGER[])"

    def rng1(self, lo: str, hi: str) -> str:
        return f"CAST(range({lo}, {hi}) AS INTEGER[])"

    def contains(self, arr: str, x: str) -> str:
        return f"list_contains({arr}, {x})"

    def arr(self, *xs: str) -> str:
        return "[" + ", ".join(xs) + "]"

    def cat(self, a: str, b: str) -> str:
        return f"list_concat({a}, {b})"

    def join(self, arr: str, sep: str) -> str:
        return f"array_to_string({arr}, {sep})"

    def s(self, x: str) -> str:
        return f"CAST({x} AS VARCHAR)"

    def squeeze(self, x: str) -> str:
        return f"regexp_replace({x}, ' {{2}}', ' ', 'g')"

    def slice(self, arr: str, n: str) -> str:
        return f"({arr})[1:{n}]"

    def lowest(self, arr: str, rank, n: str) -> str:
        before = self.filt(arr, "y", f"{rank('y')} < {rank('v')} OR ({rank('y')} = {rank('v')} AND y < v)")
        return self.filt(arr, "v", f"{self.size(before)} < {n}")

    def sum_arr(self, arr: str) -> str:
        return f"CAST(coalesce(list_sum({arr}), 0) AS BIGINT)"


SPARK = SparkDialect()
DUCK = DuckDialect()
