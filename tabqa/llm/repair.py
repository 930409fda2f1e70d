"""Conversation structure repair by dynamic programming over a grammar of role/fault sequences.

After ``damage`` (a deterministic corruption that the operator is tried on) each row is one
symbol: the initial of its role (s, u, a, other) and whether it is truncated, or that it must go
(blank, duplicate).  The cheapest edits that leave roles ``(s?(ua)+)?`` are a shortest path
through four states (nothing yet, after s, after u, after a): Keep 0, Rerole 1, Delete 2, Insert
5, and 5 more for a truncated row that stays.

* ``learn`` compresses the symbol sequences of all conversations with Re-Pair: Spark counts the
  adjacent pairs over the distinct sequences, weighted by how often they occur; the most frequent
  pairs become rules and are replaced, round after round, until none is worth a rule.  What the
  driver holds is the grammar, ``max_rules`` rules at most; it decides the cost, never a result.
* ``Grammar`` evaluates the rules bottom-up: one 4 x 4 min-plus transfer matrix per rule, shared by
  all conversations.  Its audit rope is the middle state of each entry, from which the
  edits unfold.  Of equal costs the ASCII-least edits win: the edit strings that lead from one state
  to different ones are never prefixes of one another (inserts stand before an edit, and a string
  decides its path), so a rank per entry orders them and no strings are compared.
* A conversation's edits are the product of its symbols' matrices, from left to right.

Rows are sorted as slim rows (conversation, turn, role, digest of the text) by ranges, so a
conversation with a third of all rows is cut into segments by many tasks; pieces meet again as
segments of ``segment`` symbols.  Texts move once, for the digest of the repaired text, which runs
over a conversation's rows in order (one after another, none held), as a digest must.

Defined results: null role and text are one space, as are null ids and turns in the key of the
damage; rows with a null id are one conversation; null turns stand first and count in no gap;
rows of one turn stand by role, then by the digest of their text; a conversation without rows after damage has zeros,
an empty audit and the digest of the empty text; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabqa.llm.common import n_partitions, ship
from tabqa.session import pin

ship(__name__)

SPACE = " \t\n\x0b\x0c\r"
#: A symbol is 2 * role + truncated, roles in this order; GONE for rows that must be deleted.
ROLES, GONE = "sua", 8
N_TERMINALS = 9
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 60


@dataclass(frozen=True)
class RepairParams:
    segment: int = 4096  # symbols of a conversation that are one sequence
    max_rules: int = 2048
    round_rules: int = 64  # rules of a round
    least_count: int = 2  # occurrences of a pair that becomes a rule
    least_share: float = 0.0005  # of the symbols left: rarer pairs are not worth a rule


def key(conv_id: Column) -> Column:
    """The id as text that is never null; a null id apart from every other."""
    return F.coalesce(F.concat(F.lit("v"), conv_id.cast("string")), F.lit("n"))


def damage(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``k, turn, role, text``: rows as crc32(`id:turn`) % 20 leaves them."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    x = rows.select(F.col(id_col).alias("id"), "turn", blank(F.col("role")).alias("role"), blank(F.col("text")).alias("text"))
    x = x.withColumn("kind", F.crc32(F.concat(blank(F.col("id")), F.lit(":"), blank(F.col("turn"))).cast("binary")) % 20).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    x = x.select(key(F.col("id")).alias("k"), "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return x.drop("copy")


def _slim(damaged: DataFrame) -> DataFrame:
    """``k, turn, role, digest, first, blank, cut``: ``first`` if no earlier turn has the role and text."""
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    x = pin(damaged.select("k", "turn", "role", F.md5("text").alias("digest"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut")), "repair-rows")
    of = ["k", "role", "digest"]
    said = x.groupBy(*of).agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    y = x.join(said.select(*of, F.col("least.turn").alias("first_turn"), F.lit(True).alias("again")), of, "left")
    return y.select("k", "turn", "role", "digest", "blank", "cut", (F.col("again").isNull() | F.col("turn").eqNullSafe(F.col("first_turn"))).alias("first"))


_SEGMENT = (
    "k string, task int, no int, syms binary, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string, "
    "turns bigint, first_turn bigint, last_turn bigint"
)
_LEGAL = {"su", "ua", "au"}


def _segments(size: int):
    """Segments of the rows of a task, which come sorted by conversation, turn, role and digest."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, before, seg = [], None, None

        def close():
            if seg is not None:
                out.append((seg["k"], seg["task"], len(out) + done[0], bytes(seg["syms"]), *seg["n"], seg["first"], seg["last"], seg["turns"], seg["from"], seg["to"]))

        done = [0]
        for b in parts:
            for k, turn, role, digest, blank, cut, first, task in zip(*[b.column(n).to_pylist() for n in ("k", "turn", "role", "digest", "blank", "cut", "first", "task")], strict=True):
                if seg is None or seg["k"] != k or len(seg["syms"]) >= size:
                    close()
                    seg = {"k": k, "task": task, "syms": bytearray(), "n": [0, 0, 0, 0], "first": role[:1], "last": None, "turns": 0, "from": None, "to": None}
                at, n = (k, turn, role, digest), seg["n"]
                sym = 2 * ROLES.index(role[0]) if role and role[0] in ROLES else 6
                if blank:
                    n[0] += 1
                    sym = GONE
                elif not first or at == before:
                    n[1] += 1
                    sym = GONE
                elif cut:
                    n[2] += 1
                    sym += 1
                seg["syms"].append(sym)
                if seg["last"] is not None and seg["last"] + role[:1] not in _LEGAL:
                    n[3] += 1
                seg["last"] = role[:1]
                if turn is not None and turn != seg["to"]:
                    seg["turns"] += 1
                    seg["from"] = turn if seg["from"] is None else seg["from"]
                    seg["to"] = turn
                before = at
            if len(out) >= 1000:
                yield _batch(out)
                done[0] += len(out)
                out.clear()
        close()
        if out:
            yield _batch(out)

    def _batch(rows) -> pa.RecordBatch:
        types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3]
        names = [f.split()[0] for f in _SEGMENT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def segments(damaged: DataFrame, p: RepairParams = RepairParams()) -> DataFrame:
    """Sequences of at most ``segment`` symbols with what they count, in order of (``task``, ``no``)."""
    order = ["k", "turn", "role", "digest"]
    x = pin(_slim(damaged), "repair-slim")
    x = x.repartitionByRange(n_partitions(damaged.sparkSession), *order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id())
    return pin(x.mapInArrow(_segments(p.segment), _SEGMENT), "repair-segments")


# The grammar


def squeeze(seqs: list[np.ndarray], rules: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """Sequences with the pairs of one round replaced; no pair begins with a symbol that another ends with."""
    if not seqs or not rules:
        return seqs
    n = np.array([len(s) for s in seqs])
    line = np.concatenate(seqs).astype(np.int64)
    ends = np.cumsum(n)
    if len(line) < 2:
        return seqs
    inner = np.ones(len(line) - 1, bool)
    inner[[e - 1 for e in ends[:-1] if 0 < e < len(line)]] = False
    width = int(max(line.max(), max(max(r) for r in rules))) + 1
    code = line[:-1] * width + line[1:]
    keys = np.array([a * width + b for a, b, _ in rules])
    by = np.argsort(keys)
    at = np.searchsorted(keys[by], code).clip(max=len(keys) - 1)
    hit = inner & (keys[by][at] == code)
    twin = hit & (line[:-1] == line[1:])
    if twin.any():  # in a run of one symbol every other pair, from its start
        begins = twin & ~np.r_[False, twin[:-1]]
        place = np.arange(len(twin)) - np.maximum.accumulate(np.where(begins, np.arange(len(twin)), 0))
        hit &= ~(twin & (place % 2 == 1))
    new = np.array([r[2] for r in rules])[by][at]
    line[:-1][hit] = new[hit]
    keep = np.r_[True, ~hit]
    lengths = np.bincount(np.repeat(np.arange(len(seqs)), n)[keep], minlength=len(seqs))
    return np.split(line[keep], np.cumsum(lengths)[:-1])


def pair_counts(seqs: list[np.ndarray], weights: np.ndarray) -> dict[tuple[int, int], int]:
    """How often pairs occur without overlap, by the weights of the sequences."""
    n = np.array([len(s) for s in seqs])
    line = np.concatenate(seqs).astype(np.int64) if len(seqs) else np.zeros(0, np.int64)
    if len(line) < 2:
        return {}
    of = np.repeat(np.arange(len(seqs)), n)
    fits = of[:-1] == of[1:]
    twin = fits & (line[:-1] == line[1:])
    begins = twin & ~np.r_[False, twin[:-1] & fits[:-1]]
    place = np.arange(len(twin)) - np.maximum.accumulate(np.where(begins, np.arange(len(twin)), 0))
    fits &= ~(twin & (place % 2 == 1))
    width = int(line.max()) + 1
    codes, inverse = np.unique((line[:-1] * width + line[1:])[fits], return_inverse=True)
    total = np.zeros(len(codes), np.int64)
    np.add.at(total, inverse, weights[of[:-1][fits]])
    return {(int(c) // width, int(c) % width): int(t) for c, t in zip(codes, total, strict=True)}


def _sequences(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in b.column("seq").to_pylist()]


def learn(segs: DataFrame, p: RepairParams = RepairParams()) -> list[list[tuple[int, int, int]]]:
    """Rules of Re-Pair, (left, right, new symbol), in rounds; later rules may use earlier ones."""

    def widen(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            seqs = [np.frombuffer(x, np.uint8).astype(np.int32).tobytes() for x in b.column("syms").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.binary()), b.column("n")], names=["seq", "n"])

    def tally(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            found = pair_counts(_sequences(b), b.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["a", "b", "n"])

    def replace(rules):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                seqs = [s.astype(np.int32).tobytes() for s in squeeze(_sequences(b), rules)]
                yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.binary()), b.column("n")], names=["seq", "n"])

        return run

    shape, n_rules = "seq binary, n bigint", 0
    x = pin(segs.groupBy("syms").agg(F.count(F.lit(1)).alias("n")).mapInArrow(widen, shape), "repair-sequences")
    rounds: list[list[tuple[int, int, int]]] = []
    while n_rules < p.max_rules:
        left = x.agg(F.sum(F.octet_length("seq") / 4 * F.col("n"))).first()[0] or 0
        least = max(p.least_count, p.least_share * left)
        top = x.mapInArrow(tally, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        pairs = top.orderBy(F.desc("n"), "a", "b").limit(4 * p.round_rules).collect()
        rules, heads, tails = [], set(), set()
        for r in pairs:
            if len(rules) < min(p.round_rules, p.max_rules - n_rules) and r.a not in tails and r.b not in heads and not (r.a == r.b and r.a in heads | tails):
                rules.append((r.a, r.b, N_TERMINALS + n_rules + len(rules)))
                heads.add(r.a)
                tails.add(r.b)
        if not rules:
            break
        rounds.append(rules)
        n_rules += len(rules)
        x = pin(x.mapInArrow(replace(rules), shape), "repair-sequences")
    return rounds


def _terminal(sym: int) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest edits of one row from state to state, inserts before it included."""
    before = {(q, q): (0, "") for q in range(4)} | {(0, 2): (INSERT, "I"), (1, 2): (INSERT, "I"), (2, 3): (INSERT, "I"), (3, 2): (INSERT, "I"), (0, 3): (2 * INSERT, "II"), (1, 3): (2 * INSERT, "II")}
    row = {(q, q): (DELETE, "D") for q in range(4)}
    options = []
    if sym != GONE:
        more = TRUNCATED if sym % 2 else 0
        own = {0: [(0, 1)], 1: [(0, 2), (1, 2), (3, 2)], 2: [(2, 3)], 3: []}[sym // 2]
        options = [(step, KEEP + more, "K") for step in own] + [(step, REROLE + more, "R") for step in ((0, 2), (1, 2), (3, 2), (2, 3))]
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for (a, m), (c, s) in before.items():
        for (n, b), cost, edit in [*((step, *e) for step, e in row.items()), *options]:
            if m == n:
                best[a, b] = min(best.get((a, b), (NEVER, "")), (c + cost, s + edit))
    return best


class Grammar:
    """Transfer matrices of all symbols: cost, rank and middle state of each entry."""

    def __init__(self, rounds: list[list[tuple[int, int, int]]]):
        self.rounds = rounds
        self.cost: list[list[list[int]]] = []
        self.rank: list[list[list[int]]] = []
        self.edits: list = []  # of a terminal the strings, of a rule (left, right, middles)
        for sym in range(N_TERMINALS):
            m = _terminal(sym)
            strings = [[m.get((a, b), (NEVER, "~"))[1] for b in range(4)] for a in range(4)]
            self.cost.append([[m.get((a, b), (NEVER, ""))[0] for b in range(4)] for a in range(4)])
            self.rank.append([[sorted(set(row)).index(s) for s in row] for row in strings])
            self.edits.append(strings)
        for rules in rounds:
            for left, right, new in rules:
                assert new == len(self.cost)
                self._rule(left, right)

    def _rule(self, left: int, right: int) -> None:
        cl, rl, cr, rr = self.cost[left], self.rank[left], self.cost[right], self.rank[right]
        cost, mid, rank = [], [], []
        for a in range(4):
            through = [min((cl[a][m] + cr[m][b], rl[a][m], m) for m in range(4)) for b in range(4)]
            cost.append([min(t[0], NEVER) for t in through])
            mid.append([t[2] for t in through])
            place = [(t[1], rr[t[2]][b]) if t[0] < NEVER else (9, 9) for b, t in enumerate(through)]
            rank.append([sorted(set(place)).index(x) for x in place])
        self.cost.append(cost)
        self.rank.append(rank)
        self.edits.append((left, right, mid))

    def compress(self, syms: bytes) -> list[int]:
        seq = [np.frombuffer(syms, np.uint8).astype(np.int64)]
        for rules in self.rounds:
            seq = squeeze(seq, rules)
        return seq[0].tolist()

    def unfold(self, sym: int, a: int, b: int) -> str:
        """The edits of a symbol from state ``a`` to ``b``."""
        out, todo = [], [(sym, a, b)]
        while todo:
            s, a, b = todo.pop()
            if s < N_TERMINALS:
                out.append(self.edits[s][a][b])
            else:
                left, right, mid = self.edits[s]
                todo += [(right, mid[a][b], b), (left, a, mid[a][b])]
        return "".join(out)


class Fold:
    """Product of the matrices of a conversation's symbols, in order."""

    def __init__(self, g: Grammar):
        self.g = g
        self.cost, self.rank = [0, NEVER, NEVER, NEVER], [0, 9, 9, 9]
        self.syms: list[int] = []
        self.back = bytearray()  # of each symbol, for each state after it, the state before it

    def add(self, syms: list[int]) -> None:
        for s in syms:
            c, r = self.g.cost[s], self.g.rank[s]
            step = [min((self.cost[a] + c[a][b], self.rank[a], a) for a in range(4)) for b in range(4)]
            place = [(t[1], r[t[2]][b]) if t[0] < NEVER else (99, 99) for b, t in enumerate(step)]
            order = sorted(set(place))
            self.cost, self.rank = [min(t[0], NEVER) for t in step], [order.index(x) for x in place]
            self.back += bytes(t[2] for t in step)
            self.syms.append(s)

    def result(self) -> tuple[int, str]:
        """Least cost and the ASCII-least edits that have it."""
        last = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}
        cost, _, at = min((self.cost[q] + c, self.rank[q], q) for q, (c, _) in last.items())
        out = [last[at][1]]
        for i in range(len(self.syms) - 1, -1, -1):
            before = self.back[4 * i + at]
            out.append(self.g.unfold(self.syms[i], before, at))
            at = before
        return cost, "".join(reversed(out))


_COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def edits(segs: DataFrame, rounds: list[list[tuple[int, int, int]]]) -> DataFrame:
    """``k``, counts, ``cost`` and ``audit`` of each conversation, from its segments."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, known, out = Grammar(rounds), {}, []

        def close(x):
            if x is None:
                return
            if x["fold"] is not None:
                cost, audit = x["fold"].result()
            else:  # conversations of one segment are often alike
                if x["first"] not in known:
                    if len(known) >= 20000:
                        known.clear()
                    f = Fold(g)
                    f.add(g.compress(x["first"]))
                    known[x["first"]] = f.result()
                cost, audit = known[x["first"]]
            gaps = x["to"] - x["from"] + 1 - x["turns"] if x["from"] is not None else 0
            out.append((x["k"], gaps, *x["n"], cost, audit))

        now = None
        for b in parts:
            for r in b.to_pylist():
                if now is None or now["k"] != r["k"]:
                    close(now)
                    now = {"k": r["k"], "n": [0, 0, 0, 0], "last": None, "turns": 0, "from": None, "to": None, "first": None, "fold": None}
                pair = None if now["last"] is None else now["last"] + r["first_initial"]
                now["n"] = [a + r[c] for a, c in zip(now["n"], ("blank", "duplicate", "truncated", "illegal"), strict=True)]
                now["n"][3] += pair is not None and pair not in _LEGAL
                now["last"] = r["last_initial"]
                if r["turns"]:
                    now["turns"] += r["turns"] - (r["first_turn"] == now["to"])
                    now["from"] = r["first_turn"] if now["from"] is None else now["from"]
                    now["to"] = r["last_turn"]
                if now["first"] is None:
                    now["first"] = r["syms"]
                else:
                    if now["fold"] is None:
                        now["fold"] = Fold(g)
                        now["fold"].add(g.compress(now["first"]))
                    now["fold"].add(g.compress(r["syms"]))
            if len(out) >= 1000:
                yield batch(out)
                out.clear()
        close(now)
        if out:
            yield batch(out)

    def batch(rows) -> pa.RecordBatch:
        types = [pa.string(), *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["k", *[f.split()[0] for f in _COUNTS.split(", ")]])

    x = segs.select("k", "task", "no", "syms", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "turns", "first_turn", "last_turn")
    x = x.repartition(n_partitions(segs.sparkSession), "k").sortWithinPartitions("k", "task", "no")
    return x.mapInArrow(run, f"k string, {_COUNTS}")


def _in_order(damaged: DataFrame, audits: DataFrame) -> DataFrame:
    """``k, kind, role, text`` by conversation: its audit (kind 0, as text) first, then its rows in order."""
    rows = damaged.select("k", F.lit(1).alias("kind"), "turn", "role", F.md5("text").alias("digest"), "text")
    lead = audits.select("k", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"))
    order = ["k", "kind", "turn", "role", "digest"]
    return rows.unionByName(lead).repartition(n_partitions(damaged.sparkSession), "k").sortWithinPartitions(*order).select("k", "kind", "role", "text")


class Editor:
    """Applies an audit to the rows of a conversation, one after another."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _made(self) -> str:
        self.state = 3 if self.state == 2 else 2
        return "assistant" if self.state == 3 else "user"

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._made(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self._made(), text
        elif edit == "K":
            self.state = 1 + ROLES.index(role[0])
            yield role, text


def digests(damaged: DataFrame, audits: DataFrame) -> DataFrame:
    """``k, repaired_sha256`` of each conversation that has an audit."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, str]] = []
        k, editor, sha, begun = None, None, None, False

        def put(turns):
            nonlocal begun
            for role, text in turns:
                sha.update((("\n" if begun else "") + role + ":" + text).encode())
                begun = True

        for b in parts:
            for key_, kind, role, text in zip(*[b.column(n).to_pylist() for n in ("k", "kind", "role", "text")], strict=True):
                if kind == 0:
                    if k is not None:
                        put(editor.inserts())
                        out.append((k, sha.hexdigest()))
                    k, editor, sha, begun = key_, Editor(text), hashlib.sha256(), False
                else:
                    put(editor.row(role, text))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["k", "repaired_sha256"])
                out.clear()
        if k is not None:
            put(editor.inserts())
            out.append((k, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["k", "repaired_sha256"])

    return _in_order(damaged, audits).mapInArrow(run, "k string, repaired_sha256 string")


def repair(rows: DataFrame, p: RepairParams = RepairParams(), id_col: str = "conv_id", damaged: DataFrame | None = None) -> DataFrame:
    """A row per conversation of ``rows``: its id, counts of faults, ``cost``, ``audit`` and ``repaired_sha256``.

    ``damaged`` (``k, turn, role, text``) stands in for ``damage(rows)``.
    """
    hurt = damage(rows, id_col) if damaged is None else damaged
    segs = segments(hurt, p)
    found = pin(edits(segs, learn(segs, p)), "repair-edits")
    out = found.join(digests(hurt, found.select("k", "audit")), "k")
    ids = rows.select(F.col(id_col).alias("conv_id")).distinct().withColumn("k", key(F.col("conv_id")))
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return ids.join(out, "k", "left").select("conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
