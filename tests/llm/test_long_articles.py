"""Articles that go on after boxes of boilerplate, or begin and end with links and tables."""

from tabqa.llm import html_extract


def learnt() -> html_extract.Weights:
    counted = html_extract.Counter()
    for k in range(50):
        menu = "<nav><ul>" + "<li><a>two words</a></li>" * 20 + "</ul></nav>"
        counted.update(html_extract.count_page(f"{menu}<div class=ad>buy it</div><article><h1>t {k}</h1><p>{'word ' * 30}</p></article>{menu}<table><tr><td>x</td></tr></table><footer>f</footer>"))
    return html_extract.weights([(*k, n) for k, n in counted.items()], html_extract.ExtractParams())


LINKS = "<li><a href=x>two words</a></li>" * 20
FIRST, LAST = " ".join(["first"] * 90), " ".join(["last"] * 12)


def test_articles_go_on_after_a_box():
    for box in (f"<ul class=related>{LINKS}</ul>", f"<nav><ul>{LINKS}</ul></nav>", f"<div class=comments>{'<div><p>i say so</p>' * 50}{'</div>' * 50}</div>", f"<aside>{'word ' * 900}</aside>"):
        for page in (f"<body><article><p>{FIRST}</p>{box}<p>{LAST}</p></article></body>", f"<body><div><p>{FIRST}</p>{box}<p>{LAST}</p></div></body>"):
            assert html_extract.extract(page, learnt()) == f"{FIRST}\n{LAST}"


def test_articles_keep_first_and_last_blocks_of_links_and_cells():
    cells = "<table>" + "<tr><td>a</td><td>b</td></tr>" * 9 + "</table>"
    page = f"<body><nav>{LINKS}</nav><article><ul>{LINKS}</ul><p>{FIRST}</p>{cells}</article><article><p>no</p></article><p>tail</p></body>"
    text = html_extract.extract(page, learnt()).split("\n")
    assert text[:20] == ["two words"] * 20 and text[20] == FIRST and text[21:39] == ["a", "b"] * 9
