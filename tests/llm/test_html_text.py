"""Main text of pages: rules on hand-made pages, odd pages, and the registered query on the given ones."""

import html as entities
import re
import time

import pytest

from brickledger.llm.html_text import extract_text, main_text
from brickledger.llm.queries import QUERIES

LONG = "The people of the town went to the river and they were told that it was not far from the old mill by the road."
OTHER = "It is said that the keeper of the house had all the keys with him, but this was not what they were looking for."


def page(body, head=""):
    return f"<!DOCTYPE html><html lang='en'><head><title>T</title>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "around",
    [
        f"<nav><p>{OTHER}</p></nav>",
        f"<header><p>{OTHER}</p></header>",
        f"<footer><p>{OTHER}</p></footer>",
        f"<aside>{OTHER}</aside>",
        f"<div class='sidebar'><p>{OTHER}</p></div>",
        f"<div id='cookie-consent'>{OTHER}</div>",
        f"<div class='notice'>{OTHER}</div>",
        f"<p class='ad'>{OTHER}",
        f"<div class='adsbygoogle'><section>{OTHER}</section></div>",
        f"<form action='/s'><p>{OTHER}</p><input value='x'><select><option>Red</option></select><button>Go</button></form>",
        f"<script>var t = '<p>{OTHER}</p>';</script><style>p{{}}</style><noscript>{OTHER}</noscript>",
        f"<!-- <p>{OTHER}</p> -->",
        f"<section id='comments'><article class='comment'><p>{OTHER}</p></article></section>",
        f"<ol class='commentList'><li>{OTHER}<li>{OTHER}</ol>",
        f"<div hidden><p>{OTHER}</p></div><div style='display: none'>{OTHER}</div><div role='navigation'>{OTHER}</div>",
        "<ul><li><a href='/a'>One link</a></li><li><a href='/b'>Another link</a></li></ul>",
    ],
)
def test_what_is_none_of_the_article_goes(around):
    article = f"<h1>Title here</h1><p>{LONG}</p><p>Short.</p>"
    want = f"Title here\n{LONG}\nShort."
    for wrapped in (f"<article>{article}</article>", f"<main><div>{article}</div></main>"):
        assert main_text(page(around + wrapped)) == want
        assert main_text(page(wrapped + around)) == want
    if not around.startswith("<header"):  # that of an article belongs to it
        assert main_text(page(f"<article>{article}{around}<p>{LONG}</p></article>")) == f"{want}\n{LONG}"
    assert main_text(page(f"{around}<div>{article}</div>{around}")) == want


def test_short_blocks_inherit():
    first, second = f"<p>{LONG}</p>", f"<p>{OTHER}</p>"
    links = "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(5))
    # No article element: a heading goes with what it stands above, a short paragraph with its nearest neighbour.
    assert main_text(page(f"<ul>{links}</ul><h1>Head</h1>{first}<p>Short.</p>{second}<h2>More</h2><ul>{links}</ul>")) == (
        f"Head\n{LONG}\nShort.\n{OTHER}"
    )
    # The edge of the article element decides where it holds nothing but short blocks.
    assert main_text(page(f"<ul>{links}</ul><article><h1>Head</h1><p>Only this.</p></article><ul>{links}</ul>")) == "Head\nOnly this."
    assert main_text(page(f"<article>{first}<ul><li><a href='/x'>Read more of this</a></li></ul>{second}</article>")) == f"{LONG}\n{OTHER}"


def test_header_of_the_article_and_linked_heading_stay():
    assert main_text(page(f"<header>Site</header><article><header><h1><a href='/x'>Head</a></h1></header><p>{LONG}</p><footer>Tags</footer></article>")) == f"Head\n{LONG}"


def test_article_in_a_form_or_in_an_unclosed_menu():
    assert main_text(page(f"<form><nav>Menu</nav><article><p>{LONG}</p></article></form>")) == LONG
    assert main_text(page(f"<nav><ul><li>Menu<article><p>{LONG}</p></article>")) == LONG


def test_text_of_a_block():
    body = f"<article><p> a&amp;b &lt;i&gt; &eacute;&nbsp;\n\t<b>c</b>d<br>e <a href='/x'>f</a>&#x41;&notanentity; <i>{LONG}</p></article>"
    assert main_text(page(body)) == f"a&b <i> é cd e fA¬anentity; {LONG}"
    assert main_text("<article><p>1 < 2 and 3 > 2</p><p>x <3 y</p></article>") == "1 < 2 and 3 > 2\nx <3 y"
    assert main_text(f"<article><p title='a > b' class=\"x\">{LONG}<div>More</div>rest<p>{OTHER}") == f"{LONG}\nMore\nrest\n{OTHER}"


def test_languages():
    unknown = "Lorem ipsumque dolorem sitamet consectetuerque adipiscingelit seddo eiusmodtempor incididuntut laboreet doloremagna"
    assert main_text(page(f"<nav>Menu</nav><div><p>{unknown}</p><p>Brevis.</p></div>")) == f"{unknown}\nBrevis."
    german = "Der Mann und die Frau gingen mit dem Kind nach Hause, als es in der Stadt nicht mehr hell war, und das ist alles."
    assert main_text(page(f"<div>{german}</div><div>{unknown}</div>")) == german


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<!--") == main_text("<p") == main_text("<nav>x</nav>") == ""
    assert main_text("<") == "<" and main_text("plain text") == "plain text" and main_text("\x00 a</b></article>") == "\x00 a"
    assert main_text("<article><p>kept<p title='never closed>lost</p>") == "kept\nlost"
    assert main_text("<article><script>never closed <p>x</p>") == "never closed\nx"


@pytest.mark.parametrize("piece", ["<a \"", "<script", "<script>", "<!--", "<div class='x", "<p>a", "<li>", "</div>", "&", "<"])
def test_very_long_pages_take_linear_time(piece):
    start = time.perf_counter()
    main_text(f"<article><p>{LONG}</p>" + piece * 100_000)
    assert time.perf_counter() - start < 20


def test_rows_of_a_table(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "c", "d"), (1, "u", None, "c", "d"), (None, None, "", None, None)]
    table = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, text string, row string")
    found = sorted((r.row.page_id or 0, r.text, r.row.text or "") for r in extract_text(table).collect())
    assert found == sorted([(1, LONG, "c"), (1, LONG, "c"), (1, "", "c"), (0, "", "")])
    assert extract_text(table.limit(0)).collect() == []


def test_query_on_the_given_pages(spark):
    """The pages' one article, read by its known markup alone."""

    def plain(page):
        article = page.split("<article>", 1)[1].split("</article>", 1)[0]
        parts = [re.sub(r"</?b>", "", part).replace("<br>", " ") for part in re.split(r"</?(?:p|h1)>", article)]
        return "\n".join(" ".join(entities.unescape(part).split()) for part in parts if entities.unescape(part).split())

    folder = "/root/testdata/sf0.01"
    given = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    found = QUERIES["op11_html_text"](spark, folder).collect()
    assert len(found) == len(given)
    for r in found:
        assert (r.url, r.text, r.n_chars) == (given[r.page_id].url, plain(given[r.page_id].html), len(r.text))
