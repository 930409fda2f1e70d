"""Main text of web pages: the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags.  Words score by where they stand (in the
article, in plain body text, in a menu, an advert, a form, a comment, ...), tags cost
what their kind costs; the weights are log odds counted on labelled pages, pages
whose markup names the article (``<article>`` or ``<main>``), of which at most
``labelled`` are taken.  Boilerplate elements never come out, so their words and tags
score nothing, however many there are.  One linear scan finds the contiguous region of
the largest score; where it begins or ends in an element that names the article, it is
taken to that element's ends.  From it come the blocks, without the boilerplate elements.

Blocks end at block-level tags.  Character references are decoded, white space in a
block becomes one space, blocks are trimmed and joined by one newline.

Defined results: null, empty and text-less pages give the empty string; broken markup
(unclosed or crossed tags, a tag cut off at the end) is read as far as it goes;
without labelled pages prior weights hold; rows that repeat a page_id are extracted
each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabqa.llm.common import bounded_sample, ship
from tabqa.session import pin

ship(__name__)


@dataclass(frozen=True)
class ExtractParams:
    labelled: int = 2000  # labelled pages that weights are counted on
    kinds: int = 300  # tag names with a weight of their own; the others share one
    word_cap: float = 2.0
    tag_cap: float = 1.5


# Elements of HTML by their role on a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr br "
    "math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace semantics".split()
)
CLOSES_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
RAW = "script|style|noscript|textarea|title|template|iframe|xmp|noembed|noframes|svg|select|button|object|canvas|audio|video"
#: Raw elements that stand inside a line or are not shown: the text around them is one block.
UNBROKEN = set("script style template svg select button object canvas audio video textarea noscript".split())
BOILERPLATE = set("nav footer aside form dialog menu head".split())
CONTAINERS = ("article", "main")
# Words of class, id and role attributes that name boilerplate.
HINTS = set(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup login sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs "
    "masthead footer comment comments disqus respond reply replies share sharing social related recommended recommendations teaser teasers pagination pager toolbar "
    "search skip hidden disclaimer complementary contentinfo header topbar".split()
)
# Words that may stand beside them in one name without changing what it names.
BESIDE = set(
    "a all area aside bar block body bottom box btn button buttons card cards center col column container content desktop el element fixed float floating "
    "footer form global group head heading holder icon icons id inline inner item items js large latest left link links list main mobile module more note outer "
    "page pane panel post posts primary region right row secondary section site slot small social static sticky strip tab text this title to tools top unit up us "
    "view wide wrap wrapper zone article articles story stories news our of and the x".split()
)
#: Elements that are boxes of a page: only these go by their names; marks, cells and items of an article stay.
BOXES = set("div section ul ol dl table details figure fieldset center nav aside header footer form iframe".split())

_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)
    |<(?P<raw>{RAW})\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)
    |<[!?/][^>]*+(?:>|\Z)
    |(?P<text>[^<]++|<)""",
    re.S | re.I | re.X,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


def attributes(attrs: str) -> dict[str, str]:
    """Attributes of a tag by their whole names, the first of a name counting."""
    found: dict[str, str] = {}
    for name, *value in _ATTRIBUTE.findall(attrs):
        found.setdefault(name.lower(), "".join(value))
    return found


def names_boilerplate(name: str) -> bool:
    """Whether one class, id or role names boilerplate: a hint, alone or among words that change nothing (``share-bar``, not ``share-price``)."""
    words = {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w}
    hints = words & HINTS
    if hints == {"skip"} and words & {"list", "lists"}:
        return False
    return bool(hints) and words <= HINTS | BESIDE and not (hints == {"header"} and words & {"article", "post", "entry", "content", "title"})


def unseen(found: dict[str, str]) -> bool:
    """Whether an element is not shown."""
    return "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", ""), re.I))


def hinted(attrs: str) -> bool:
    """Whether an element's attributes name boilerplate."""
    if not attrs.strip():
        return False
    found = attributes(attrs)
    return any(names_boilerplate(n) for key in ("class", "id", "role") for n in found.get(key, "").split())


def tokens(page: str, hints: bool = True) -> Iterator[tuple[str, str, str, str, int]]:
    """Words and tags in order: (kind, where or name, text, where, box).

    kind is ``words``, ``tag`` or ``end`` (of a block); box numbers the innermost element
    that names an article, 0 outside of any and in boilerplate.
    """
    stack: list[tuple[str, str, int]] = []
    open_names: Counter = Counter()
    boxes = 0

    def place() -> tuple[str, int]:
        return stack[-1][1:] if stack else ("plain", 0)

    def shut(to: int) -> None:
        for name, *_ in stack[to:]:
            open_names[name] -= 1
        del stack[to:]

    def last(name: str) -> int:
        return next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)

    for m in _TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            yield "words", place()[0], text, *place()
            continue
        if m["raw"]:
            yield "tag", m["raw"].lower(), "", *place()
            if m["raw"].lower() not in UNBROKEN:
                yield "end", "", "", *place()
            continue
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, closing, attrs = name.lower(), m["close"] or m["close2"], m["attrs"] or m["attrs2"] or ""
        if name not in INLINE:
            yield "end", "", "", *place()
        if closing:
            at = place()
            if open_names[name] > 0:
                shut(last(name))
            yield "tag", "/" + name, "", *at
            continue
        if name in CLOSES_P and open_names["p"] > 0:
            shut(last("p"))
        if name in VOID or attrs.endswith("/"):
            yield "tag", name, "", *place()
            if name == "br":
                yield "words", place()[0], " ", *place()
            continue
        outer, box = place()
        if outer.startswith("-"):
            where = outer
        elif name in BOILERPLATE:
            where = "-" + name
        elif name == "header" and not open_names["article"] and not open_names["main"]:
            where = "-header"
        elif name not in ("html", "body") and unseen(attributes(attrs)):
            where = "-hidden"
        elif hints and name in BOXES and hinted(attrs):
            where = "-hint"
        elif name in CONTAINERS:
            where = "article"
        else:
            where = outer
        if where.startswith("-"):
            box = 0
        elif name in CONTAINERS:
            box = boxes = boxes + 1
        yield "tag", name, "", where, box
        stack.append((name, where, box))
        open_names[name] += 1


def count_page(page: str) -> Counter:
    """Words by place and tags by name, inside and outside of the labelled article."""
    found: Counter = Counter()
    inside = False
    for kind, name, text, _, _ in tokens(page):
        if kind == "words":
            found["w", name, name == "article"] += len(text.split())
            inside = name == "article"
        elif kind == "tag":
            found["t", name.lstrip("/"), inside or name in CONTAINERS] += 1
            inside = (inside or name in CONTAINERS) and name.lstrip("/") not in BOILERPLATE and name not in ("/article", "/main")
    return found


@dataclass(frozen=True)
class Weights:
    words: dict[str, float]
    tags: dict[str, float]
    rare: float


def weights(counted: list[tuple[str, str, bool, int]], p: ExtractParams) -> Weights:
    """Log odds from (``w`` or ``t``, name, inside, number); without counts the priors: words 1, tags -1."""
    by: dict[tuple[str, str], list[float]] = {}
    for kind, name, inside, n in counted:
        by.setdefault((kind, name), [0.0, 0.0])[bool(inside)] += n
    words = {"article": 1.0, "plain": -1.0}
    tags = {}
    for (kind, name), (out, in_) in by.items():
        if kind == "w" and name.startswith("-"):
            continue
        odds = float(np.log((in_ + 1) / (out + 1)))
        if kind == "w":
            words[name] = float(np.clip(odds, 0.5, p.word_cap) if name == "article" else np.clip(odds, -p.word_cap, p.word_cap))
        else:
            tags[name] = float(-np.clip(1 - odds, 0.1, p.tag_cap))
    return Weights(words, tags, -1.0)


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest sum, the first of the longest; (0, 0) if no sum is above 0."""
    best, at, start, run = 0.0, (0, 0), 0, 0.0
    for i, s in enumerate(scores):
        if run <= 0:
            start, run = i, 0.0
        run += s
        if run > best:
            best, at = run, (start, i + 1)
    return at


def to_ends(seen: list[tuple[str, str, str, str, int]], start: int, end: int) -> tuple[int, int]:
    """The region, from the start of the article element of its first words to the end of that of its last."""
    boxes = [box for kind, _, text, where, box in seen[start:end] if kind == "words" and text.strip() and not where.startswith("-")]
    if boxes and boxes[0]:
        start = min(start, next(i for i, x in enumerate(seen) if x[4] == boxes[0]))
    if boxes and boxes[-1]:
        end = max(end, next(i for i in range(len(seen), 0, -1) if seen[i - 1][4] == boxes[-1]))
    return start, end


def extract(page: str | None, w: Weights) -> str:
    """The main text of a page."""
    if not page:
        return ""
    for hints in (True, False):
        seen = list(tokens(page, hints))
        # Where the markup names no article, plain body text is what an article is made of.
        plain = w.words["plain"] if any(k == "words" and where == "article" and t.strip() for k, where, t, _, _ in seen) else w.words["article"]
        scores = []
        for kind, name, text, where, _ in seen:
            if where.startswith("-"):
                scores.append(0.0)
            elif kind == "words":
                scores.append((plain if name == "plain" else w.words[name]) * len(text.split()))
            else:
                scores.append(w.tags.get(name.lstrip("/"), w.rare) if kind == "tag" else 0.0)
        start, end = to_ends(seen, *best_region(scores))
        blocks, block = [], []
        for kind, name, text, _, _ in seen[start:end] + [("end", "", "", "", 0)]:
            if kind == "words" and not name.startswith("-"):
                block.append(text)
            elif kind == "end" and block:
                # References are decoded piece by piece: markup between two pieces ends a reference.
                if line := " ".join("".join(html.unescape(t) for t in block).split()):
                    blocks.append(line)
                block = []
        if blocks:
            return "\n".join(blocks)
    return ""


def fit(pages: DataFrame, p: ExtractParams = ExtractParams(), id_col: str = "page_id", html_col: str = "html") -> Weights:
    """Weights from a bounded, seeded sample of the pages whose markup names the article."""
    named = pages.where(F.col(html_col).rlike("(?i)<(article|main)[\\s>]")).select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    sample = pin(bounded_sample(named, p.labelled, "id", "html"), "extract-labelled")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in parts:
            for t in b.column("html").to_pylist():
                total.update(count_page(t))
        cols = [list(x) for x in zip(*[(*k, n) for k, n in total.items()], strict=True)] or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.int64()), strict=True)], names=["kind", "name", "inside", "n"])

    counted = sample.mapInArrow(run, "kind string, name string, inside boolean, n bigint").groupBy("kind", "name", "inside").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "kind", "name", "inside").limit(2 * p.kinds).collect()
    return weights([(r["kind"], r["name"], r["inside"], r["n"]) for r in top], p)


def main_text(pages: DataFrame, w: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` for every row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts = pa.array((extract(t.as_py(), w) for t in b.column("html")), pa.string(), size=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), texts], names=["page_id", "url", "text"])

    x = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return x.mapInArrow(run, f"page_id {dict(x.dtypes)['page_id']}, url string, text string")
