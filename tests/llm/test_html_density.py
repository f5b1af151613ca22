import math
import random
import time
from xml.etree import ElementTree

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.html_density import extract, main_text, parse, select

BODY = "".join(f"<p>Sentence number {w} of the article, long enough to be dense &amp; read.</p>" for w in ("one", "two", "three"))
WANT = "\n".join(f"Sentence number {w} of the article, long enough to be dense & read." for w in ("one", "two", "three"))


def test_page_furniture_goes():
    page = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body class="page">
    <div id="cookie-notice">We use cookies on this long, long text of a notice about cookies.</div><header><h1>Site</h1></header>
    <nav><ul><li><a href="/">Home</a></li><li><a href="/b">B</a></li></ul></nav><script>var t="</p>";</script>
    <div class="wrap has-sidebar"><article><header><h1>Heading</h1></header>{BODY}<form>Mail <input></form>
    <section class="comments"><p>A reader says something quite long here, indeed much longer than all of the article together.</p></section></article>
    <aside class="sidebar"><p>Other things that are not the article at all.</p></aside></div>
    <div class="ad">Buy this now.</div><footer>&copy; a site</footer></body></html>"""
    assert extract(page) == "Heading\n" + WANT


def test_density_finds_the_text_without_names():
    links = "".join(f'<li><a href="/{i}">link {i}</a></li>' for i in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><div><h2>Heading</h2>{BODY}</div></div><div><a href='/x'>more</a> <a href='/y'>about</a></div></body>"
    assert extract(page) == "Heading\n" + WANT


def test_markup_errors():
    assert extract(f"<article><p><b>One  two<br><p>three</b> four<p>five &lt;b&gt;</article><footer>x</footer>") == "One two\nthree four\nfive <b>"
    assert extract('<p class="x>unclosed</p><p>rest') in ("unclosed\nrest", "rest")
    assert extract("no markup  at\nall") == "no markup at all"
    assert extract(None) == extract("") == extract("<html></html>") == extract("<!-- x -->") == extract("<script>x") == ""
    assert extract("<p>a < b and c</p>") == "a < b and c"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/pabdiv \"'=&;!-\n", max_size=80))
def test_any_markup_gives_a_text(page):
    assert extract(page) == extract(page)


def test_long_and_odd_rows(spark):
    rows = [(1, "u", "<p>" + "word " * 200000 + "</p>", 1), (2, None, None, 1), (2, "u", "", 1), (2, "u", "", 1), (None, "u", "<div>" * 3000 + "deep", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {(r.page_id, r.url): len(r.text) for r in main_text(df).collect()}
    assert main_text(df).count() == 5 and got[1, "u"] == 999999 and got[2, None] == 0 and got[None, "u"] == 4
    assert main_text(df.limit(0)).collect() == []


def test_attribute_words_leave_article_text():
    text = """<p title="a hidden gem">A gem, see <a href="/wiki/Hidden_Markov_model">hidden Markov model</a>.</p><p data-hidden="false">Shown.</p>
    <section id="search-algorithms"><h2 id="related-work" class="header">Related work</h2><p>On <span id="Social_history">social history</span>.</p></section>"""
    head = '<div class="entry-header"><h1>Title</h1></div>'
    gone = '<p hidden>h1</p><div HIDDEN="">h2</div><div aria-hidden="true">h3</div><p style="display: none">h4</p><div role="search">h5</div><div class="x comments-area">h6</div><div class=\'ad\'>h7</div>'
    want = "Title\nA gem, see hidden Markov model.\nShown.\nRelated work\nOn social history.\n" + WANT
    for name in ("article", "main"):
        assert extract(f"<body><{name}>{head}{text}{BODY}{gone}</{name}></body>") == want
    assert extract(f'<body><div class="post">{text.replace("section", "div").replace("search-", "")}{BODY}</div></body>') == want.removeprefix("Title\n")


LINKS = "".join(f'<li><a href="/{i}">link number {i} to another page</a></li>' for i in range(40))


@pytest.mark.parametrize("around", ["div", "main"])
def test_names_do_not_decide(around):
    assert extract(f'<body><div class="layout has-sidebar no-ads"><div class="post"><div class="entry-header"><h2>Title</h2></div>{BODY}</div></div></body>') == "Title\n" + WANT
    assert extract(f"<body><{around}><ul>{LINKS}</ul><div><h2>Title</h2>{BODY}</div></{around}></body>") == "Title\n" + WANT
    assert extract(f"<body><{around}><article><h1>Title</h1>{BODY}</article><ul>{LINKS}</ul></{around}></body>") == "Title\n" + WANT
    sections = "".join(f"<section><h3>Part {w}</h3>{BODY}</section>" for w in "ab")
    assert extract(f"<body><{around}><div><header><h1>Title</h1></header></div>{sections}</{around}></body>") in (f"Title\nPart a\n{WANT}\nPart b\n{WANT}", f"Part a\n{WANT}\nPart b\n{WANT}")


def test_one_paragraph_stands_for_its_container():
    page = '<body><div class="ad">Buy our very dense and long advert now, today or tomorrow.</div><div><h1>Title</h1><p><b>A very long lone paragraph that outweighs all the rest of this page, sentence by sentence.<br></p><p>End.</p></div></body>'
    assert extract(page) == "Title\nA very long lone paragraph that outweighs all the rest of this page, sentence by sentence.\nEnd."
    assert extract("<body><h1>Title</h1><div><p>One long paragraph of the article.</p><p>Short.</p></div></body>") == "Title\nOne long paragraph of the article.\nShort."


@pytest.mark.parametrize("mark", ['class="ad"', 'id="sidebar"', 'class="box cookie-notice"', 'class="comments-area"', 'id="site-footer"', 'class="main-menu"', 'class="related-posts"', 'role="banner"'])
def test_what_the_contract_lists_goes(mark):
    other = f"<div {mark}><p>Something else that has a lot of text, more than any paragraph of the article itself has.</p></div>"
    assert extract(f"<body>{other}<div><h1>Title</h1>{BODY}</div></body>") == "Title\n" + WANT
    assert extract(f"<body><article><h1>Title</h1>{BODY}{other}</article></body>") == "Title\n" + WANT


def _plain_select(tree):
    """The selection by the formula, node by node over the whole tree, without anything carried from node to node."""
    length = lambda e: len("".join("".join(e.itertext()).split()))
    body_links = sum(length(a) for a in tree.iter("a"))

    def density(e):
        c, t = length(e), max(sum(1 for _ in e.iter()) - 1, 1)
        if not c or e.tag == "a":
            return 0.0
        links = [x for x in e.iter("a")]
        lc = sum(length(a) for a in links)
        lt = len(links)
        base = math.log(c / max(c - lc, 1) * lc + body_links / length(tree) * c + math.e)
        value = math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0))
        return max(0.0, c / t * (value / math.log(base) if base > 1 + 1e-9 else value))

    nodes = list(tree.iter())
    above = {child: e for e in nodes for child in e}
    total = {e: sum(map(density, e)) or density(e) for e in nodes}
    best = max(nodes, key=total.get)
    threshold, up = density(best), best
    while up in above:
        up = above[up]
        threshold = min(threshold, density(up))
    return [e for e in nodes if density(e) >= threshold and total[e] >= max(total[x] for x in nodes if density(x) >= threshold) * (1 - 1e-9)]


def test_density_against_a_plain_version():
    r = random.Random(5)

    def made(depth):
        text = lambda n: " ".join(r.choice(("of", "the", "density", "paragraph", "article", "sums")) for _ in range(r.randint(0, n)))
        if depth == 0:
            return text(30)
        inner = "".join(made(depth - 1) if r.random() < 0.7 else f'<a href="/x">{text(6)}</a>' for _ in range(r.randint(1, 4)))
        name = r.choice(("div", "section", "ul", "blockquote"))
        return f"{text(3)}<{name}>{inner}</{name}>{text(3)}"

    checked = 0
    for _ in range(300):
        page = f"<body>{made(r.randint(1, 4))}</body>"
        tree = ElementTree.fromstring(page)
        best = select(parse(page))
        if best is None:
            assert not "".join(tree.itertext()).strip()
            continue
        texts = {"".join("".join(e.itertext()).split()) for e in _plain_select(tree)}

        def text(node):
            return "".join(x if isinstance(x, str) else text(x) for x in node.items)

        assert "".join(text(best).split()) in texts
        checked += 1
    assert checked > 200


def test_time_is_proportional_to_length():
    def took(n):
        pages = ["<div>" * n + "</b></i></span>" * n + "x", "<i>" * n + "<p>x" * n, "<b><div>" * n + "</b>" * n, "<article class=x>" * n + "x</q>" * n, "<table><tr><td>" * n + "<li>x" * n]
        began = time.process_time()
        for page in pages:
            extract(page)
        return time.process_time() - began

    took(500)
    assert took(8000) < 20 * max(took(1000), 0.02)
