"""An article keeps its text whatever its elements' attributes say of other things; boilerplate boxes go by their names."""

import random
from itertools import combinations

import pytest

from tabqa.llm import html_extract

KEPT = [
    '<div class="share-price">kept here now</div>', '<div class="related-work">kept here now</div>', '<div class="search-algorithm">kept here now</div>',
    '<div id="skip-list">kept here now</div>', '<table><tr><td class="alert">kept here now</td></tr></table>', '<pre><span class="comment">kept here now</span></pre>',
    '<a title="a hidden gem">kept here now</a>', '<div title="the hidden figures">kept here now</div>', '<div data-id="menu">kept here now</div>', '<div data-x=\'class="menu"\'>kept here now</div>',
    '<ul><li class="widget">kept here now</li></ul>',
]
GONE = [
    '<div class="share-bar">gone here now</div>', '<div class="comments">gone here now</div>', '<section id="related-posts">gone here now</section>', '<div class="x adBanner">gone here now</div>',
    '<div hidden>gone here now</div>', '<span aria-hidden="true">gone here now</span>', '<p style="color:red; display : none">gone here now</p>', '<div role=navigation>gone here now</div>', '<form class=box>gone here now</form>',
]


@pytest.fixture(scope="module")
def weights():
    counted = html_extract.Counter()
    for k in range(50):
        counted.update(html_extract.count_page(f"<nav><ul><li><a>m</a></li></ul></nav><div class=ad>buy it</div><article><h1>t {k}</h1><p>{'word ' * 30}</p></article><footer>f</footer>"))
    return html_extract.weights([(*k, n) for k, n in counted.items()], html_extract.ExtractParams())


def page(inner):
    return f"<html><body><nav><a>m</a></nav><article><h1>Title of it</h1><p>{'word ' * 40}</p>{inner}<p>{'more ' * 40}</p></article><footer>f</footer></body></html>"


@pytest.mark.parametrize("inner", KEPT)
def test_text_of_the_article_stays(weights, inner):
    got = html_extract.extract(page(inner), weights)
    assert got.split("\n") == ["Title of it", ("word " * 40).strip(), "kept here now", ("more " * 40).strip()]


@pytest.mark.parametrize("inner", GONE)
def test_boxes_named_as_boilerplate_go(weights, inner):
    assert html_extract.extract(page(inner), weights).split("\n") == ["Title of it", ("word " * 40).strip(), ("more " * 40).strip()]


def test_a_sentence_with_formulas_and_buttons_is_one_block(weights):
    inner = "<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds <button>b</button> and<script>var a;</script> ends</p>"
    assert "so x=1 holds and ends" in html_extract.extract(page(inner), weights).split("\n")


def test_the_region_is_that_of_brute_force(weights):
    """Of flat pages of paragraphs and link lists: no other run of blocks scores higher by the same weights."""
    r = random.Random(9)
    for _ in range(40):
        blocks = [r.choice(["<p>" + "word " * r.randint(1, 12) + "</p>", "<ul>" + "<li><a>l</a></li>" * r.randint(1, 9) + "</ul>"]) for _ in range(r.randint(2, 7))]
        got = html_extract.extract("<html><body>" + "".join(blocks) + "</body></html>", weights)
        worth = lambda s: sum(2.0 * b.count("word") for b in s)
        runs = ["".join(blocks[i:j]) for i, j in combinations(range(len(blocks) + 1), 2)]
        longest = max((b for b in blocks if b.startswith("<p>")), key=worth, default="")
        assert any(got.count("word") == run.count("word") for run in runs) and got.count("word") >= longest.count("word")
