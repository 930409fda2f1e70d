"""Compare column types of every query with its DuckDB oracle (no execution of results).

Usage: python tests/schema_check.py [sf_dir] [prefix ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle_check import duck_conn  # noqa: E402

SPARK_TO_DUCK = {
    "LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
    "BooleanType": "BOOLEAN", "ShortType": "SMALLINT", "ByteType": "TINYINT", "FloatType": "FLOAT",
    "DateType": "DATE", "TimestampNTZType": "TIMESTAMP",
}


def spark_type(dt) -> str:
    n = type(dt).__name__
    if n == "ArrayType":
        return spark_type(dt.elementType) + "[]"
    if n == "DecimalType":
        return f"DECIMAL({dt.precision},{dt.scale})"
    return SPARK_TO_DUCK.get(n, n)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.001"
    prefixes = argv[2:]
    from tabqa.session import get_session
    import __spark_entry__ as E

    spark = get_session()
    con = duck_conn(sf_dir)
    bad = 0
    for name, sql in E.oracle_sql().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            sp = {f.name: spark_type(f.dataType) for f in E.queries()[name](spark, sf_dir).schema.fields}
            dk = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
        except Exception as e:  # noqa: BLE001
            print(f"ERROR {name}: {repr(e)[:200]}", flush=True)
            bad += 1
            continue
        diff = {c: (sp.get(c), dk.get(c)) for c in set(sp) | set(dk) if sp.get(c) != dk.get(c)}
        if diff:
            bad += 1
            print(f"TYPES {name}: {diff}", flush=True)
    print(f"SCHEMA-SUMMARY bad={bad}")


if __name__ == "__main__":
    main(sys.argv)
