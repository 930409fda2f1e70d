"""Conversation repair against a plain shortest-path search, row by row."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabqa.llm import repair

sys.setrecursionlimit(20000)
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def hurt(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            out += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", x)
        out.append("blank" if not words else "duplicate" if (r, x) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def cheapest(initials, fault):
    """(cost, audit) by trying every edit from every state, from the end backwards."""

    @lru_cache(None)
    def best(i, state, inserted):
        options = []
        if i == len(initials) and state in (0, 3):
            options.append((0, ""))
        made = 3 if state == 2 else 2
        if inserted < 2:
            c, a = best(i, made, inserted + 1)
            options.append((c + 5, "I" + a))
        if i < len(initials):
            c, a = best(i + 1, state, 0)
            options.append((c + 2, "D" + a))
            if fault[i] not in ("blank", "duplicate"):
                more = 5 * (fault[i] == "truncated")
                c, a = best(i + 1, made, 0)
                options.append((c + 1 + more, "R" + a))
                to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(initials[i], {}).get(state)
                if to is not None:
                    c, a = best(i + 1, to, 0)
                    options.append((c + more, "K" + a))
        return min(options, default=(1 << 60, ""))

    return best(0, 0, 0)


def brute(rows, already=False):
    by = {r[0]: [] for r in rows}
    for r in rows if already else hurt(rows):
        by[r[0]].append(r)
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
        kinds, initials = faults(turns), [r[2][:1] for r in turns]
        cost, audit = cheapest(tuple(initials), tuple(kinds))
        said, state, at = [], 0, 0
        for e in audit:
            if e != "D":
                if e == "K":
                    role, text, state = turns[at][2], turns[at][3], 1 + "sua".index(initials[at])
                else:
                    role, text, state = ("assistant", "", 3) if state == 2 else ("user", "", 2)
                    text = turns[at][3] if e == "R" else ""
                said.append(f"{role}:{text}")
            at += e != "I"
        made = "".join(x[:1] for x in said)
        assert re.fullmatch("(s?(ua)+)?", made)
        whole = [r[1] for r in turns if r[1] is not None]
        gaps = max(whole) - min(whole) + 1 - len(set(whole)) if whole else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[c] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def conversations():
    r = random.Random(11)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "sage", "udo"]
    texts = ["a.", "b!", "c", " ", "", None, "d.  \n", "e. x", "f?\x0b", "g.\xa0", "?"]
    rows = []
    for c in range(120):
        for t in range(r.randint(1, 14)):
            rows.append((c, r.choice([t, t, t, 2 * t, None]), r.choice(roles[:5] if c % 2 else roles), r.choice(texts) if c % 3 else f"text {t}."))
    rows += [(None, t, ("user", "assistant")[t % 2], f"n{t}.") for t in range(6)]
    hot = [(500, t, r.choice(roles[:5]), r.choice([f"h{t}.", f"h{t}", "", "same."])) for t in range(700)]
    return rows + hot + [(600, 1, "user", "again.")] * 5 + [(700, 0, "user", "long " * 50000 + "."), (700, 1, "assistant", "ok.")]


def table(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("p", [repair.RepairParams(), repair.RepairParams(segment=3, max_rules=7, round_rules=2), repair.RepairParams(segment=50, max_rules=0)])
def test_repair_is_the_cheapest(spark, p):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as k", "2 as kind", "3 as digest", "4 as id").repartition(5)
    assert table(repair.repair(df, p)) == brute(rows)


def test_conversations_that_lose_every_row(spark):
    gone = [(c, 0, "user", "x.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = table(repair.repair(spark.createDataFrame(gone, SCHEMA)))
    assert len(got) > 3 and set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_matrices_of_rules_agree_with_the_search():
    r = random.Random(3)
    seqs = [bytes(r.choice([0, 2, 2, 4, 4, 3, 5, 6, 7, 8]) for _ in range(r.randint(0, 24))) for _ in range(300)]
    rounds, new, line = [], repair.N_TERMINALS, [np.frombuffer(s, np.uint8).astype(np.int64) for s in seqs]
    for _ in range(9):
        found = sorted(repair.pair_counts(line, np.ones(len(line), np.int64)).items(), key=lambda x: -x[1])
        rules = [(*found[0][0], new)]
        new += 1
        rounds.append(rules)
        line = repair.squeeze(line, rules)
    g = repair.Grammar(rounds)
    assert any(len(g.compress(s)) < 0.7 * len(s) for s in seqs)
    for s in seqs:
        initials = tuple("x" if c >= 6 else "sua"[c // 2] for c in s)
        fault = tuple("blank" if c == repair.GONE else "truncated" if c % 2 else "" for c in s)
        f = repair.Fold(g)
        f.add(g.compress(s))
        assert f.result() == cheapest(initials, fault)


def test_pairs_are_counted_and_replaced_without_overlap():
    r = random.Random(4)
    for _ in range(200):
        seqs = [np.array([r.randint(0, 2) for _ in range(r.randint(1, 12))], np.int64) for _ in range(4)]
        weights = np.array([1, 2, 3, 4])
        got = repair.pair_counts(seqs, weights)
        for a, b in [(0, 0), (0, 1), (2, 1)]:
            text = [" ".join(map(str, s)) for s in seqs]
            want = sum(len(re.findall(f"{a} {b}", t)) * w for t, w in zip(text, weights, strict=True))
            assert got.get((a, b), 0) == want
            assert [x.tolist() for x in repair.squeeze(seqs, [(a, b, 9)])] == [[int(v) for v in t.replace(f"{a} {b}", "9").split()] for t in text]


def test_query_rows_follow_the_contract(spark, sf="/root/testdata/sf0.001"):
    from tabqa.llm import plans

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = plans.op12_repair(spark, sf)
    assert table(got) == brute(rows)
    assert got.select(F.count(F.when(F.length("audit") > 0, 1))).first()[0] > 0
