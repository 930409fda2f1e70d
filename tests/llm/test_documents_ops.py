"""Mixing, toxicity, token counts, decontamination and near duplicates on small documents."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest

from tabqa.llm import decontam, minhash, mixing, plans, token_count, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = "size string, node string, id string, no int, target string, span string, items int, label int, score string, at int"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = words(1, 60)
    near = base.replace(base.split()[30], "changed", 1)
    rows = [
        (1, base, "en", "b", 1), (2, base, "en", "a", 1), (3, near, "en", "b", 1), (4, None, None, None, None), (5, "", "en", "b", 0), (6, "one two", "en", None, 7),
        (6, "one two", "en", None, 7), (7, "one two", "fr", "c", 7), (None, words(2, 40), "en", "b", 1), (8, words(3, 20000), "en", "long", 1), (9, "é \t\n x", "fr", "é", 1), (10, "   ", "en", "b", 3),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    for c in CLASH.split(", "):
        name, kind = c.split()
        df = df.selectExpr("*", f"cast(7 as {kind}) as {name}")
    return df


def mixed(df, **kw):
    return sorted(map(tuple, mixing.mix(df, mixing.MixParams(**kw)).collect()), key=str)


def test_mix_sizes_targets_and_caps(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    size = {}
    for r in docs.collect():
        size.setdefault(r.source, 0)
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted([s for s in size if s is not None]) + [None]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(size.values()), set(order), {}
    while True:  # the rule as it is told: give, stop at the cap, share the rest again
        unit = left / sum(w[s] for s in open_)
        above = {s for s in open_ if w[s] * unit > 2 * size[s]}
        if not above:
            target |= {s: w[s] * unit for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in above}
        left -= sum(2 * size[s] for s in above)
        open_ -= above
    taken = dict.fromkeys(order, 0)
    for r in rows:
        assert r["source_size"] == size[r.source] and r["target"] == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 64 for s in order)


def test_mix_is_the_same_under_any_partitioning_and_with_more_columns(docs):
    assert mixed(docs) == mixed(clashing(docs).repartition(7)) == mixed(docs.coalesce(1))
    assert mixed(docs.limit(0)) == []


def test_apportion_is_highest_quotients(spark):
    r = random.Random(5)
    for seats in (1, 7, 100, 1000):
        claims = [(1, i, float(r.choice([0, 1, 3, 10, 500])), seats) for i in range(12)]
        if not any(c[2] for c in claims):
            continue
        got = {x.k: x.quota for x in mixing.apportion(spark.createDataFrame(claims, "g int, k int, w double, seats bigint"), ["g"], "k", "w", "seats").collect()}
        quotients = sorted(((-w / (2 * j + 1), i) for _, i, w, _ in claims if w for j in range(seats)))[:seats]
        assert got == {c[1]: sum(1 for _, i in quotients if i == c[1]) for c in claims}


def test_token_counts_are_the_librarys(spark, docs):
    from tokenizers import Tokenizer

    path = plans.tokenizer_path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    odd = ["a<|endoftext|>b <|startoftext|>", "it's we'LL é ́x", "\x1c\x85a\x0bb\x0cc", "日本 🎉🎉", "ΣΑΣ Σ", "a" * 500, None, "", "<|ENDOFTEXT|>", " \n\t"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id bigint, text string").unionByName(docs.select("doc_id", "text"))
    p = token_count.TokenParams(path, limit=5, batch_bytes=64, memo_pieces=20)
    want = sorted((r.doc_id, len((r.text or "").encode()), len(whole.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect() if r.doc_id is not None)
    got = [tuple(r) for r in token_count.count_tokens(df, p).collect() if r.id is not None]
    assert sorted(g[:3] for g in got) == want and all(g[3] == (g[2] > 5) for g in got)
    assert token_count.count_tokens(clashing(docs), p).count() == docs.count()
    assert token_count.count_tokens(docs.limit(0), p).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts_of_whole_texts(docs, name):
    path = plans.tokenizer_path(name)
    p = token_count.TokenParams(path, safe_split=False, batch_bytes=64)
    encode = token_count.encoder(path)
    got = {r.id: r.n_tokens for r in token_count.count_tokens(docs, p).collect()}
    assert all(got[r.doc_id] == encode([r.text or ""])[0] for r in docs.collect())


BENCH = "item_id bigint, text string"


def brute_scan(text, bench, n=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, items = cut(text), set(), set()
    for item, t in bench:
        b = cut(t)
        for win in {tuple(b[k : k + n]) for k in range(max(1, len(b) - n + 1))} if b else ():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    items.add("" if item is None else str(item))
    return len(w), len(hit), sorted(items)


@pytest.fixture(scope="module")
def leaky(spark):
    passage = words(11, 25)
    bench = [(1, passage), (2, "Short É item"), (3, None), (4, "..."), (10, passage), (None, words(12, 14)), (5, "zum ZUM zum"), (6, "ΛΟΓΟΣΛΟΓΟΣ"), (7, "İçeriği ΑΣ ǅungla")]
    low = passage.upper().replace(" ", ", ")
    texts = [
        "before it " + passage + " after", low, " ".join(passage.split()[3:13]), " ".join(passage.split()[3:12]), "a short É ITEM! b", "a short é item b", None, "", "zum zum zum zum",
        words(12, 14) + " " + words(13, 9000) + " " + passage, words(14, 50), passage + " " + passage, "x ΛΟΓΟΣΛΟΓΟΣ.Β y", "ΛΟΓΟΣΛΟΓΟΣ", "λογοσλογος", "the İçeriği ΑΣ' ǅungla.",
    ]
    rows = [(i // 2 * 2 if i in (4, 5) else i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(bench, BENCH), rows, bench


@pytest.mark.parametrize("at_once", [200_000, 5])
def test_scan_finds_what_brute_force_finds(leaky, at_once):
    docs, bench, rows, items = leaky
    got = sorted((r.id, r.n_words, r.n_hit, list(r["items"])) for r in decontam.scan(docs, bench, decontam.DecontamParams(max_ngrams=at_once)).collect())
    assert got == sorted((i, *brute_scan(t, items)) for i, t in rows)


def test_clean_drops_or_cuts(leaky):
    docs, bench, rows, items = leaky
    clean_rows = sorted((i, t or "") for i, t in rows if not brute_scan(t, items)[1])
    assert sorted((r.doc_id, r.text or "") for r in decontam.clean(clashing(docs), bench).collect()) == clean_rows
    cut = {(r.doc_id, r.text) for r in decontam.clean(docs, bench, mode="cut").collect()}
    assert (0, "before it after") in cut and {(i, t) for i, t in rows if not brute_scan(t, items)[1]} <= cut and len(cut) == len(rows)
    assert decontam.scan(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.scan(docs.limit(0), bench).count() == 0


def brute_classes(rows, s=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if (rows[a][1] or "") == (rows[b][1] or "") or (sets[a] and len(sets[a] & sets[b]) >= s * len(sets[a] | sets[b])):
            up[top(b)] = top(a)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    out = {}
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            out[i] = (min(ids, default=None), len(g))
    return sorted(((rows[i][0], *out[i]) for i in out), key=str)


def test_classes_are_those_of_brute_force(spark, docs):
    base = words(21, 120).split()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    r = random.Random(3)
    for i in range(60):  # near copies of different distance: a star, a chain, and some too far from all
        w = list(base)
        for k in r.sample(range(120), r.choice([0, 1, 2, 3, 4, 6])):
            w[k] = f"x{i}y{k}"
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    p = minhash.NearDupParams(slice_words=500, memo_words=50)
    got = sorted(((x.id, x.class_id, x.class_docs) for x in minhash.classes(clashing(df).drop("text2"), p).collect()), key=str)
    assert got == brute_classes(rows)
    kept = minhash.deduplicate(clashing(df), p).collect()
    assert len(kept) == len({c[1:] if c[1] is not None else c for c in got})
    assert sorted(x.doc_id for x in kept if x.doc_id is not None) == sorted({c[1] for c in got if c[1] is not None})
    assert minhash.classes(df.limit(0), p).count() == 0 and minhash.deduplicate(df.limit(0), p).count() == 0


def test_signatures_agree_as_often_as_weighted_jaccard_says():
    import numpy as np

    k, r = 4000, np.random.default_rng(1)
    element = r.integers(0, 2**63, 60).astype(np.uint64)
    w1, w2 = r.integers(0, 4, 60) * 1.0, r.integers(0, 4, 60) * 0.75
    doc = np.repeat([0, 1], 60)
    s = minhash.darts(doc, np.tile(element, 2), np.concatenate([w1, w2]), 3, k)
    want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((s[0] == s[1]).mean() - want) < 4 * (want * (1 - want) / k) ** 0.5
    assert not s[2].any()


def test_count_weights_see_repeats(spark):
    a = words(31, 30)
    df = spark.createDataFrame([(1, a), (2, a + " " + a + " " + a)], "doc_id bigint, text string")
    whole = minhash.sketch(df.selectExpr("doc_id as id", "cast(text as binary) as node", "text"), minhash.NearDupParams(weights="count")).collect()
    sets = minhash.sketch(df.selectExpr("doc_id as id", "cast(text as binary) as node", "text"), minhash.NearDupParams()).collect()
    same = lambda x: sum(u == v for u, v in zip(x[0]["values"], x[1]["values"], strict=True))
    assert same(whole) < same(sets)


def brute_nearest(index, t, n, k):
    q = dict(zip(t.tolist(), index.vector(t, n).tolist(), strict=True))
    score = [0.0] * len(index.ids)
    for term in q:
        for b in range(index.n_blocks):
            c = term * index.n_blocks + b
            for j in range(index.ptr[c], index.ptr[c + 1]):
                score[index.row[j]] += q[term] * index.weight[j]
    best = sorted((-round(s, 12), index.ids[j]) for j, s in enumerate(score) if s > 0)[:k]
    return [i for _, i in best]


def test_nearest_examples_are_exact():
    import numpy as np

    r = np.random.default_rng(2)
    examples = [(i, int(r.random() < 0.3), *np.unique(r.integers(0, 40, r.integers(0, 9)), return_counts=True)) for i in range(500)]
    p = toxicity.ToxicityParams(block=8, k=7)
    m = toxicity.build([(f"t{j}", 20) for j in range(40)], examples, {0: 700, 1: 300}, p)
    for i, _, t, n in examples:
        if len(t):
            assert [m.index.ids[j] for j in m.index.nearest(t, n)[0]] == brute_nearest(m.index, t, n, 7), i


def test_toxicity_learns_and_holds_out(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        t = words(i + 1000, 40).split()
        if bad:
            t[r.randrange(40)] = r.choice(["vilest", "rotten"])
            t[r.randrange(40)] = "Vilest,"
        rows.append((i, " ".join(t), "en"))
        labels.append((i, int(bad)))
    rows += [(1000, None, None), (1001, "", "x"), (0, "words only", "x"), (None, "vilest rotten", None), (1002, "vilest " * 50000, "en")]
    labels += [(5, 0), (None, 1), (7, None), (9999, 1), (8, 3)]
    docs, lab = spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    held = [x for x in lab.where(toxicity.held_out("doc_id")).collect()]
    assert held and all(zlib.crc32(str(x.doc_id).encode()) % 4 == 2 for x in held)
    model = toxicity.fit(clashing(docs), clashing(toxicity.learnable(lab)))
    got = toxicity.score(clashing(docs), model).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    wrong = sum(x.predicted != (x.id % 5 == 0) for x in got if x.id is not None and 0 < x.id < 1000)
    assert wrong <= 6
    by = {x.id: x for x in got}
    assert by[None].predicted == 1 and by[1002].predicted == 1 and by[1000].predicted == by[1001].predicted == 0 and by[1000].near == []
    kept = toxicity.score(clashing(docs), model, keep=True)
    assert kept.columns == clashing(docs).columns and kept.count() == sum(1 - x.predicted for x in got)
    for some in (lab.limit(0), lab.where("toxic = 0")):
        assert {x.score for x in toxicity.score(docs, toxicity.fit(docs, some)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_digest_query_columns(spark):
    d = "/root/testdata/sf0.001"
    rows = plans.QUERIES["op9_decontaminate"](spark, d).collect()
    assert all(r.items_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if r.n_items == 0) and len(rows) == 200


def test_the_model_travels_as_plain_arrays():
    import pickle

    p = toxicity.ToxicityParams(k=2)
    words_of = [(1, 1, [0, 1], [1, 2]), (2, 1, [1], [1]), (3, 0, [2], [1]), (4, 0, [0, 2], [1, 1])]
    model = toxicity.build([("a", 2), ("b", 2), ("c", 2)], [(i, y, np.array(t), np.array(n)) for i, y, t, n in words_of], {0: 2, 1: 2}, p)
    state = pickle.dumps(toxicity._state(model))
    assert b"tabqa" not in state
    back = toxicity._restored(pickle.loads(state), p)
    assert all(back.score(t, p) == model.score(t, p) for t in ("a b", "c", "none", None, "a a c"))
