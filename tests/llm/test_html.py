import html as entities
import re

import pytest
from pyspark.sql import functions as F

from callweave.llm import html, queries
from callweave.llm.html import extract_main_text, main_text

SF = "/root/testdata/sf0.01"
P = "A long sentence of the article that goes on for a good while, as articles do. " * 3
LINKS = "".join(f'<li><a href="/{i}">topic number {i}</a></li>' for i in range(12))

PAGES = {
    "": "",
    "plain &amp; simple": "plain & simple",
    "<p>a<p>b": "a\nb",
    "<p>a\n  b&nbsp;<b>c</b>d<br>e</p>": "a b cd e",
    "<p>x</p><script>if (a < b) { y = '</p><p>no'; }</script><p>&eacute;&#x41;&#66;</p>": "x\néAB",
    "<div>one<!-- <p>no</p> --> two</div><style>p { }</style>": "one two",
    f"<body><nav><ul>{LINKS}</ul></nav><article><h1>T</h1><p>{P}</article><footer>f</footer>": "T\n" + P.strip(),
    f'<div id="menu">{LINKS}</div><div class="x1"><h2>T</h2><div><p>{P}</p><p>{P}</p></div></div><div class="cookie-notice">We use cookies</div>': f"T\n{P.strip()}\n{P.strip()}",
    f'<main><p>{P}</p><p>{P}</p><section class="comments"><p>{P}{P}</p><p>{P}{P}</p></section></main>': f"{P.strip()}\n{P.strip()}",
    f"<form><label>Name</label><input><button>Go</button></form><div><p>{P}</p></div>": P.strip(),
    '<div title="a>b">q</div><p data-x=\'<p>\'>r</p>': "q\nr",
    "<ul><li>one<li>two<ul><li>in</ul><li>three</ul>": "one\ntwo\nin\nthree",
    "<table><tr><td>1<td>2<tr><td>3</table>": "1\n2\n3",
    "<p>cut <b": "cut <b",
    "<p hidden>no</p><p aria-hidden='true'>no</p><p>yes</p>": "yes",
    "3 < 4 and 5 > 4": "3 < 4 and 5 > 4",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert main_text(page) == PAGES[page]


TEXT = f"<p>{P}</p><p>{P}</p>"
BOTH = f"{P.strip()}\n{P.strip()}"
KEPT = {
    # words inside values are no attributes
    f'<div style="overflow:hidden">{TEXT}</div>': BOTH,
    f'<div><p title="the hidden coast">{P}</p><p>{P}</p></div>': BOTH,
    f'<div><p>go to <a href="/hidden-bay">the bay</a></p>{TEXT}</div>': f"go to the bay\n{BOTH}",
    f'<div><p>go to <a href="/x?id=ad">the bay</a></p>{TEXT}</div>': f"go to the bay\n{BOTH}",
    f'<div data-id="menu" data-class=ad data-hidden aria-hidden="false">{TEXT}</div>': BOTH,
    f'<div x="1" class="a" class="ad">{TEXT}</div>': BOTH,
    # a mark in a longer name
    f'<div class="page has-sidebar">{TEXT}</div>': BOTH,
    f'<div class="no-header"><p>{P}</p></div><div><p>{P}</p></div>': BOTH,
    # marked, but the page has no other text
    f'<form id="aspnetForm"><div class="menu">{LINKS}</div><div>{TEXT}<form>Your name</form></div></form>': BOTH,
    f'<div class="sidebar"><form><div id="widget">{TEXT}</div></form></div><p>by us</p>': BOTH,
    f'<div class="comment"><p>{P}</p></div><div class="comment"><p>{P}</p></div><div class="ad">buy</div>': BOTH,
    # still cut out
    f'<p HIDDEN>no</p><p class="x" hidden="">no</p><p aria-hidden=true>no</p><p class=ad>no</p><div>{TEXT}</div>': BOTH,
    f'<form><div class="comments">{TEXT}{TEXT}</div><div>{TEXT}</div></form>': BOTH,
    f'<div>{TEXT}<div class="x ad-banner2"><p>{P}</p></div></div>': BOTH,
}


@pytest.mark.parametrize("page", KEPT)
def test_attributes_and_marks(page):
    assert main_text(page) == KEPT[page]


def test_nested_marks_end():
    assert main_text("<form>" * 1000 + '<div class="ad">' * 1000 + P) == P.strip()


@pytest.mark.parametrize("page", ["<div>" * 50_000, "<p>a" * 50_000, '<a "' * 50_000, "</b>" * 50_000 + "<b>" * 50_000, "<" * 50_000, "<!--" * 20_000])
def test_odd_pages_end(page):
    main_text(page)


def test_rows_with_nulls_repeats_and_clashes(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>a"), (3, "u", "<p>a"), (None, "u", "<p>" + "w " * 100_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    out = extract_main_text(df).collect()
    assert sorted((r.page_id or 0, r.url, len(r.text)) for r in out if r.url) == [(0, "u", 199_999), (1, "u", 0), (3, "u", 1), (3, "u", 1)]
    assert extract_main_text(df.limit(0)).collect() == []


def test_query_equals_the_article_of_every_page(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = queries.op6_html_main_text(spark, SF).collect()
    assert sorted(r.page_id for r in out) == sorted(pages)
    for r in out:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", article))
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in parts]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


ARTICLE = "<h1>On hills</h1><p>" + "A long and quiet walk over the hills of the north. " * 6 + "</p>"
AD = "<p>" + "Buy the new thing now, it is better than all the other things. " * 6 + "</p>"


@pytest.mark.parametrize(
    "mark",
    "comment-list comments-area comment-body user-comments post-comments site-footer ad-container ad-slot ad-box share-buttons cookie-bar "
    "newsletter-signup widget-area sidebar-right left-sidebar related-posts main-nav comment-1 cookie-notice cookie_banner".split(),
)
def test_marked_blocks_go_however_long(mark):
    page = f"<body><article>{ARTICLE}<div class='{mark}'>{AD * 6}</div></article></body>"
    assert html.main_text(page).split("\n")[0] == "On hills" and "Buy" not in html.main_text(page)


@pytest.mark.parametrize("name", "has-sidebar no-header ad-free page-with-menu article-header without-comments".split())
def test_other_names_stay(name):
    assert "quiet walk" in html.main_text(f"<body><div class='{name}'>{ARTICLE}</div></body>")


def test_short_article_beside_long_adverts_and_comments():
    one = "<p>Only one short paragraph stands here.</p>"
    assert html.main_text(f"<body><div><h2>T</h2>{one}<div class='ad'>{AD * 6}</div></div></body>") == "T\nOnly one short paragraph stands here."
    page = f"<main>{ARTICLE}<article class='comment'>{AD}</article><article class='comment'>{AD}</article></main>"
    assert "Buy" not in html.main_text(page)


def test_page_in_a_form_or_a_named_box():
    assert "quiet walk" in html.main_text(f"<form action=x>{ARTICLE}<input name=q></form><div>Copyright</div>")
    assert "quiet walk" in html.main_text(f"<div id=sidebar>{ARTICLE.replace('h1', 'h2')}</div>")


def brute_density(node):
    """Density and sum of children from the definitions, by recursion over the whole tree."""
    chars = tags = link_chars = link_tags = 0

    def count(n, in_link):
        nonlocal chars, tags, link_chars, link_tags
        for p in n.parts:
            if isinstance(p, str):
                chars += len("".join(p.split()))
                link_chars += len("".join(p.split())) if in_link else 0
            elif not p.out:
                tags += 1
                link_tags += 1 if in_link or p.name == "a" else 0
                count(p, in_link or p.name == "a")

    count(node, node.name == "a")
    if node.name == "a":
        link_tags = tags
    return chars / max(1, tags) * (1 - link_chars / max(1, chars)) * (1 - link_tags / max(1, tags + 1))


def test_densities_and_choice_equal_brute_force(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(40).collect()]
    for page in pages:
        body = html.parse(page)
        html.clear_doubts(body)
        html.measure(body)
        nodes, todo = [], [body]
        while todo:
            n = todo.pop()
            nodes.append(n)
            todo.extend(p for p in n.parts if isinstance(p, html.Node) and not p.out)
        for n in nodes:
            assert n.density == pytest.approx(brute_density(n))
            assert n.sum == pytest.approx(sum(brute_density(p) for p in n.parts if isinstance(p, html.Node) and not p.out))
        assert html.densest(body).sum == max(n.sum for n in nodes)
