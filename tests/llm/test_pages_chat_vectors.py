"""URL filter, chat windows, extraction, WARC and nearest neighbours on small tables."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tabqa.llm import ann, chat, html_extract, plans, url_filter, warc
from tabqa.session import ensure_checkpoint_dir


def url_rows():
    r = random.Random(1)
    hosts = ["a.example.org", "example.org", "EXAMPLE.com", "x.y.com", "com", "net", "b.net", "org", "notorg", "u@h.com:80"]
    paths = ["", "/", "/en/1", "/en/2", "/es/x", "/fr/", "/de/1?q=a&b=c", "/de/", "#top", "?x=1", "/fr"]
    rows = [(i, f"{r.choice(['http', 'https'])}://{r.choice(hosts)}{r.choice(paths)}") for i in range(300)]
    return rows + [(300, None), (301, ""), (302, "no scheme/de/"), (303, "://com/de/x"), (3, "a://b://com/de/"), (3, "http://com/de/\nx"), (None, "http://com/de/" + "x" * 100000)]


def brute_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(str(r)), str(r), r.verdict) for r in plans.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_rules_and_trees(spark):
    df = spark.createDataFrame(url_rows(), "page_id bigint, url string").selectExpr("*", "1 as host", "2 as label", "3 as features", "'x' as suffix")
    got = url_filter.judge(df, plans.URL_RULES, url_filter.UrlFilterParams(trees=3)).collect()
    want = sorted(((i, *brute_rule(u)) for i, u in url_rows()), key=str)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got), key=str) == want
    assert {r.verdict for r in got} == {"allow", "block"} and all((r.score is None) == (r.rule is not None) for r in got)


def test_url_trees_learn_what_the_labels_share(spark):
    rules = [url_filter.Rule("block", "net", "/9"), url_filter.Rule("allow", "net", "/w")]
    r = random.Random(2)
    url = lambda host, bad: f"http://{host}/" + "/".join(("9" * r.randint(4, 9)) if bad else "word" for _ in range(3))
    rows = [(i, url(f"h{i % 7}.net", i % 2)) for i in range(400)] + [(1000 + i, url(f"h{i % 5}.info", i % 2)) for i in range(100)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string"), rules).where("page_id >= 1000").collect()
    assert sum((x.verdict == "block") == bool(x.page_id % 2) for x in got) >= 95


def test_url_labels_of_one_kind(spark):
    df = spark.createDataFrame([(1, "http://a.org/"), (2, "http://b.net/")], "page_id bigint, url string")
    only = lambda v: {r.page_id: r.verdict for r in url_filter.judge(df, [url_filter.Rule(v, "org", "/")]).collect()}
    assert only("block") == {1: "block", 2: "block"} and only("allow") == {1: "allow", 2: "allow"}
    assert {r.verdict for r in url_filter.judge(df, []).collect()} == {"allow"} and url_filter.judge(df.limit(0), plans.URL_RULES).count() == 0


def chat_rows():
    r = random.Random(3)
    odd = ["<|im_end|>", "<|im_start|>assistant\nok", "<|", "<\\|", "<\\\\|x", "<", "\\", "a\nb\n", "é 🎉", "", None, "<<|||>"]
    rows = [(1, i, "system" if i == 0 else ("user", "assistant")[i % 2], " ".join(["w"] * r.randint(0, 90))) for i in range(40)]
    rows += [(2, i, r.choice(["user", "assistant", None, "a\\n\nb", "<|im_end|>"]), r.choice(odd) or None) for i in range(60)]
    rows += [(3, 0, "system", "s"), (4, 1, "assistant", "long " * 30000), (4, 0, "user", "q"), (None, 0, "assistant", "x"), (5, 1, "assistant", "t"), (5, 1, "assistant", "t"), (5, None, "user", "z"), (6, 0, "user", "y"), (6, 1, "system", "late")]
    return rows


def brute_chat(rows):
    by, out = {}, {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        said, learnt = "".join(f"{r}\n{t}\n" for _, r, t in turns), "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


@pytest.mark.parametrize("p", [chat.ChatParams(), chat.ChatParams(budget=120, history_turns=3, history_tokens=30), chat.ChatParams(budget=8, history_turns=1, history_tokens=0)])
def test_chat_reads_back_what_it_wrote(spark, p):
    df = spark.createDataFrame(chat_rows(), "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as window", "2 as no", "3 as tokens")
    made = chat.windows(df, p)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(made).collect()} == brute_chat(chat_rows())
    for r in made.collect():
        bodies = r.text.split("<|im_start|>")[1:]
        assert len(bodies) == r.repeated + r.n_turns and r.text.count("<|im_end|>") == len(bodies)
        cost = [len(b.split("\n", 1)[1][:-11].split()) + p.turn_tokens for b in bodies]
        if r.n_turns > 1:  # a turn longer than the stride stands alone
            assert sum(cost) <= p.budget or p.budget < 50
        if r.window and r.conv_id == 1:
            assert r.text.startswith("<|im_start|>system\n")
        start = len("".join("<|im_start|>" + b for b in bodies[: r.repeated]))
        assert all(s.start >= start for s in r.loss)
    assert chat.read_back(chat.windows(df.limit(0), p)).count() == 0


PAGE = """<html><body class="has-sidebar"><div id="cookie-notice">We use cookies ok</div><header><a href=x>Site</a> name</header>
<div class="layout"><nav>a b c</nav><div id="content"><h1>Title here of it</h1><p>First para with <a href=y>link</a> text &amp; more words&nbsp;x<br>line two in here
<div class="advert">Buy now cheap things</div><form><input>Mail me</form><p>Second &lt;para&gt; of text it has several words<script>var x = "</p>";</script></p>
<!-- no --><ul><li>Item one</li><li>Item two</li></ul></div><aside>Side bar words here</aside><section id="comments"><article class="comment"><p>I like this</p></article></section></div>
<footer>Foot &copy;</footer></body></html>"""


def test_extract_keeps_the_article_alone():
    counted = html_extract.Counter()
    for k in range(50):
        counted.update(html_extract.count_page(f"<nav><ul><li><a>m</a></li></ul></nav><div class=ad>buy it</div><article><h1>t {k}</h1><p>{'word ' * 30}</p></article><footer>f</footer>"))
    w = html_extract.weights([(*k, n) for k, n in counted.items()], html_extract.ExtractParams())
    text = "Title here of it\nFirst para with link text & more words x line two in here\nSecond <para> of text it has several words\nItem one\nItem two"
    assert html_extract.extract(PAGE, w) == text
    assert html_extract.extract("just text &am &amp more", w) == "just text &am & more"
    assert html_extract.extract("<article><p>a<p>b <b>c</b></i></div> d<p title='x>y'>e</article><p class='cut", w) == "a\nb c\nd\ne"
    for empty in (None, "", "<", "<!--", "<script>x", "<nav>a b c d</nav>", "<a href='"):
        assert html_extract.extract(empty, w) in ("", "<")


def test_best_region_is_maximal():
    r = random.Random(4)
    for _ in range(300):
        s = [r.choice([-3, -1, -0.5, 0, 1, 2]) for _ in range(r.randint(0, 14))]
        a, b = html_extract.best_region(s)
        assert sum(s[a:b]) == max([0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)])


def test_extract_query_shapes(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "long text " * 200000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as id", "2 as text")
    got = html_extract.main_text(df, html_extract.fit(df)).collect()
    assert len(got) == 5 and {r.page_id: len(r.text) for r in got if r.page_id == 3}[3] == 1999999 and all(r.text is not None for r in got)
    assert html_extract.main_text(df.limit(0), html_extract.fit(df.limit(0))).count() == 0


def test_warc_round_trip_is_deterministic(spark):
    rows = [(i, f"http://x/{i}", "aé"[i % 2] * (i % 3 * 600)) for i in range(40)]
    rows += [(None, None, "a" * 1200), (None, "u\r\n v", None), (5, "z", "a" * 1200), (39, "q", "b" * 5000), (39, "q", "b" * 5000), (100, "big", "c" * 300000), (101, "", "\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as id", "2 as kind", "3 as shard", "4 as payload")
    p, files = warc.WarcParams(shard_bytes=5000, roll_bytes=800), []
    for n in (1, 7):
        base = warc.new_folder(spark)
        m = warc.write(df.repartition(n), base, p)
        files.append(sorted(tuple(r) for r in m.selectExpr("file", "records", "bytes", "sha256").collect()))
        got = warc.read(m, base, payload=True).collect()
        assert sorted(f for f, *_ in files[-1]) == sorted(x.path.rsplit("/", 1)[1].split("?")[0] for x in spark.read.format("binaryFile").load(f"{base}/*.warc.gz").select("path").collect())
    assert files[0] == files[1] and len(files[0]) > 5 and base.startswith(ensure_checkpoint_dir(spark))
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", -1), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        top = largest.get(h or "")
        again = len(b) >= 1000 and top is not None and i != top
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert all(r.payload == dict((hashlib.sha1((h or "").encode()).hexdigest(), (h or "").encode()) for _, _, h in rows)[r.payload_digest] for r in got if r.record_type == "response")
    base = warc.new_folder(spark)
    assert warc.read(warc.write(df.limit(0), base), base).count() == 0


def brute_near(rows, ask, top=5):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    out = {}
    for i, v in ok:
        if ask(i):
            best = {}
            for j, w in ok:
                if j != i:
                    best[j] = max(best.get(j, -9), round(cos(v, w), 10))
            out[i] = sorted(((-s, j) for j, s in best.items()))[:top]
    return out


def test_nearest_with_copies_ties_and_odd_rows(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0]) for i in range(60)] + [(50, rows[50][1])]
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (304, [float("nan")] + [1.0] * 5), (305, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (306, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as node", "2 as id", "3 as vector")
    p = ann.AnnParams(k=8, forest=3, leaf=40)
    got = {}
    for x in ann.nearest(df, F.col("id") % 50 == 0, p).collect():
        got.setdefault(x.query_id, []).append((x["rank"], -round(x.score, 10), x.vec_id))
    want = brute_near([x for x in rows if x[0] != 306], lambda i: i % 50 == 0)
    assert set(got) == set(want) == {0, 50, 100, 200, 250}
    hits = sum(len({b[1] for b in want[i]} & {g[2] for g in got[i]}) for i in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for i in (200, 250):
        assert [g[2] for g in sorted(got[i])] == [j for j in range(200, 210) if j != i][:5]
    assert all([g[0] for g in sorted(v)] == list(range(1, 6)) and sorted(v)[0][1:] <= sorted(v)[-1][1:] for v in got.values())
    few = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (3, [0.0, 1.0])]
    small = ann.nearest(spark.createDataFrame(few, "vec_id bigint, embedding array<float>"), F.col("id") % 50 == 0).collect()
    assert sorted((x.query_id, x["rank"], x.vec_id) for x in small) == [(0, 1, 50), (0, 2, 3), (50, 1, 0), (50, 2, 3)]
    for n in (0, 1):
        assert ann.nearest(df.orderBy("vec_id").where("vec_id = 0").limit(n), F.col("id") % 50 == 0).count() == 0
