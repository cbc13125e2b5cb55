import html
import re

from loomstone.llm.html_text import extract, main_text, op6_html_text

LONG = "The story of the town is that it was built on a hill and the people of the valley came to it for the market, " * 3
LONG = LONG.strip()


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_article_page():
    src = page(
        f"<header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy now the best of it.</div>"
        f"<article><h1>Title &amp; more</h1><p>{LONG}<p>Short &lt;one&gt;.<br>next\n line<p><b>Bold</b> a < b &nbsp; c.</p><script>var t='</p>'</script>"
        f"<aside>{LONG}</aside><div id='cookie-notice'>{LONG}</div><form>{LONG}</form><section class='comments'><article><p>{LONG}</p></article></section></article>"
        f"<div class='sidebar'>{LONG}</div><footer>&copy; {LONG}</footer>"
    )
    assert main_text(src) == f"Title & more\n\n{LONG}\n\nShort <one>. next line\n\nBold a < b c."


def test_page_without_article():
    src = page(f"<div>Menu</div><div><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div><div><a href='x'>{LONG}</a></div><p><a href='y'>more</a></p>")
    assert main_text(src) == f"{LONG}\n\nShort one.\n\n{LONG}"


def test_names_of_wrappers():
    src = page(f"<div class='page has-sidebar'><article class='post share'><p>{LONG}</p><div class='share'>{LONG}</div></article><div class='sidebar'>{LONG}</div></div>")
    assert main_text(src) == LONG
    src = page(f"<main><p>{LONG}</p></main><div id='comments'><article><p>{LONG}</p></article></div>")
    assert main_text(src) == LONG


def test_odd_pages():
    assert main_text(None) == "" and main_text("") == "" and main_text("<p") == ""
    assert main_text("<article>a &am b &amp c</article>") == "a &am b & c"
    assert main_text("<article><p title='a>b'>x</p><!-- <p>no</p> --><p>y") == "x\n\ny"
    main_text("<div class='" * 20000)
    main_text("<a \"" * 50000)
    main_text("<div>" * 20000 + "x")


def test_quotes_in_unquoted_values():
    assert main_text(f"<article><p>{LONG}</p><p>a <a title=John's href=x>second</a> part</p><p>It's the third.</p></article>") == f"{LONG}\n\na second part\n\nIt's the third."
    assert main_text("<article><p data-x='a>b' title=\"c>d\" y = z>one</p><p ' \" q=>two</p><p x=\"open>three</p></article>") == "one\n\ntwo\n\nthree"


def test_pages_that_are_not_articles():
    listing = page(f"<div class='results'><div><h2>First</h2><p>{LONG}</p></div><div><h2>Second</h2><p>{LONG}</p></div></div>")
    assert main_text(listing) == f"First\n\n{LONG}\n\nSecond\n\n{LONG}"
    table = page(f"<table><tr><td><a href='/a'>A</a></td><td><p>{LONG}</p></td></tr></table><table><tr><td><a href='/b'>B</a> | <a href='/c'>C</a></td></tr></table>")
    assert main_text(table) == LONG
    assert main_text(page("<ul><li><a href='/a'>A</a></li><li><a href='/b'>B</a></li></ul>")) == ""


ITALIAN = ("La storia della città è che venne costruita su una collina e la gente della valle saliva fino al mercato per vendere il grano. " * 3).strip()
FINNISH = ("Kaupunki rakennettiin kukkulalle vanhan linnan viereen, ja laakson asukkaat kulkivat sinne torille myymään viljaa ja villaa. " * 3).strip()
JAPANESE = "町は丘の上に建てられ、谷の人々は市場に来て穀物を売りました。" * 8


def test_articles_that_were_lost():
    """Whole pages with one article of text, in wrappers and languages that say nothing about it."""
    for text in (LONG, ITALIAN, FINNISH, JAPANESE):
        for before, after in (
            ("<div class='page no-sidebar'>", "</div>"),
            ("<div class='has-sidebar layout'>", "</div>"),
            ("<div id='sidebar-layout'>", "</div>"),  # named like boilerplate, and nothing else is there
            ("<div title='hidden gems of Paris'>", "</div>"),
            ("<div data-hidden='false'>", "</div>"),
            ("<div data-class=sidebar aria-hidden=false>", "</div>"),
            ("<form action='/x' method=post>", "</form>"),
            ("<div>", "</div>"),
            ("<article>", "</article>"),
            ("<nav><ul><li><a href='/'>Home</a><article>", "</article>"),
            ("<header><h1>Site</h1><main>", "</main>"),
        ):
            got = main_text(page(f"{before}<p>{text}</p><p>{text}</p>{after}"))
            assert got == f"{text}\n\n{text}", (before, got[:80])
    src = page(f"<form><nav><a href='/'>Home</a></nav><article><p>{LONG}</p></article><p>Search the site</p></form>")
    assert main_text(src) == LONG


def test_boilerplate_stays_out():
    src = page(f"<div class='sidebar'>{LONG}</div><form>{LONG}</form><div hidden>{LONG}</div><div><p>{LONG} End.</p></div><div style='display: none'>{LONG}</div>")
    assert main_text(src) == f"{LONG} End."
    assert main_text(page(f"<div hidden><p>{LONG}</p></div><div aria-hidden=true><p>{LONG}</p></div><nav>{LONG}</nav><div class=comments><p>{LONG}</p></div>")) == ""


def test_links_over_blocks():
    src = page(f"<div><p>{LONG}</p></div><a href='/x'><div><p>{LONG}</p><div>{LONG}</div></div></a><div><p>{LONG} End.</p></div>")
    assert main_text(src) == f"{LONG}\n\n{LONG} End."
    src = page(f"<ul><li><a href='/x'>Home<li><a href='/y'>Far</ul><a name='top'><div><p>{LONG}</p><p>See <a href='/z'>more</p><p>{LONG} End.</p></div>")
    assert main_text(src).startswith(LONG) and main_text(src).endswith("End.")


def brute(src):  # the article of the generated pages
    art = re.search(r"<article>(.*?)</article>", src, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", art))]
    return "\n\n".join(p for p in parts if p)


def test_table(spark, sf):
    src = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op6_html_text(spark, sf).collect()
    assert len(got) == len(src)
    for r in got:
        assert r.text == brute(src[r.page_id].html)
        assert r.n_chars == len(r.text) and r.url == src[r.page_id].url


def test_nulls_and_empty(spark):
    schema = "page_id long, url string, html string, text string"
    out = extract(spark.createDataFrame([(None, None, None, "x"), (1, "u", "<article>a</article>", None), (2**53 + 1, "u", "<article>a</article>", None)], schema)).collect()
    assert sorted((r.text, r.n_chars) for r in out) == [("", 0), ("a", 1), ("a", 1)]
    assert {r.page_id for r in out} == {None, 1, 2**53 + 1}
    assert extract(spark.createDataFrame([], schema)).count() == 0
