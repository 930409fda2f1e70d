"""DuckDB spellings of the hash draws, for oracle SQL only."""

from __future__ import annotations

from tabqa.functions.hashing import thresholds


def lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def key(*parts) -> str:
    """concat_ws('|', ...): str parts are SQL expressions, ints are literals."""
    out = []
    for p in parts:
        if isinstance(p, int):
            out.append(f"'{p}'")
        else:
            out.append(f"CAST({p} AS VARCHAR)")
    return "concat_ws('|', " + ", ".join(out) + ")"


def h(k: str) -> str:
    return f"(('0x' || substr(md5({k}), 1, 8))::BIGINT)"


def unit(k: str) -> str:
    return f"({h(k)} / 4294967296.0)"


def uniform(k: str, lo, hi) -> str:
    return f"({lo} + {h(k)} % (({hi}) - ({lo}) + 1))"


def weighted(k: str, elements, weights) -> str:
    steps = thresholds(elements, weights)
    if len(steps) == 1:
        return lit(steps[0][0])
    u = unit(k)
    whens = " ".join(f"WHEN {u} < {acc!r} THEN {lit(el)}" for el, acc in steps[:-1])
    return f"(CASE {whens} ELSE {lit(steps[-1][0])} END)"


def word(k: str) -> str:
    x = f"(('0x' || substr(md5({k}), 1, 15))::BIGINT)"
    n = f"(4 + (('0x' || substr(md5({k}), 16, 8))::BIGINT) % 6)"
    letters = ", ".join(f"chr(97 + (({x} // {26**i}) % 26)::INTEGER)" for i in range(9))
    return f"substr(concat({letters}), 1, {n})"


def date_cell(k: str) -> str:
    span = "datediff('day', DATE '2001-02-13', DATE '2023-08-31')"
    return f"strftime(DATE '2001-02-13' + CAST({h(k)} % {span} AS INTEGER), '%Y-%m-%d')"


def real_cell(k: str) -> str:
    return f"printf('%.2f', {uniform(k, 110, 2000)} / 100.0)"
