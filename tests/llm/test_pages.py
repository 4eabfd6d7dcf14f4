"""Main text of pages: generated articles beside plain cutting, written pages that the tree has not seen, broken markup."""

import html
import re
import time

import pytest

from evigraph.llm import pages
from evigraph.llm.queries import QUERIES

LONG = " ".join(["word"] * 40)


def article(page):
    """Blocks between <article> and </article> of the generated pages."""
    inner = page[page.index("<article>") : page.index("</article>")]
    cut = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:h1|p|article)>", re.sub("<br>", " ", inner))]
    return "\n\n".join(b for b in cut if b)


def test_every_generated_page(spark, sf_dir):
    want = {r.page_id: (r.url, article(r.html)) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = QUERIES["op13_main_text"](spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (*want[r.page_id], len(want[r.page_id][1]))


def test_tree_learns_its_table_and_is_small():
    rows, labels = pages.labelled_rows()
    assert [pages.tree().says(r) for r in rows] == labels

    def size(node):
        return 1 if node.low is None else 1 + size(node.low) + size(node.high)

    assert 5 <= size(pages.tree()) <= 61 and 0.2 < sum(labels) / len(labels) < 0.8


def test_the_tree_uses_words_and_links_of_neighbours():
    used = set()

    def walk(node):
        if node.low is not None:
            used.add(pages.FEATURES[node.feature])
            walk(node.low)
            walk(node.high)

    walk(pages.tree())
    assert used & {"words", "links"} and used & {"words before", "links before", "words after", "links after"}


# Pages outside the labelled table: main blocks start with "yes", all others with "no".
UNSEEN = {
    "news": f"""<html><body class="has-sidebar"><div id="cookie-banner"><p>no cookies {LONG}</p></div><header class="site"><a href=/>no logo</a></header>
        <main><article class="post"><header><h1>yes title</h1><p class="byline">yes by A</p></header><p>yes {LONG}</p><figure><img src=x><figcaption>yes caption</figcaption></figure>
        <blockquote>yes quote</blockquote><div class="advert">no buy {LONG}</div><p>yes</p></article><section id="comments"><h2>no comments</h2><article class="comment"><p>no {LONG}</p></article></section></main>
        <aside><h3>no more</h3><ul><li><a href=1>no one</a></li></ul></aside><footer>no &copy; {LONG}</footer></body></html>""",
    "soup": f"""<body><div id="topbar">no {LONG}</div><div class="nav-menu"><a>no a</a><a>no b</a></div><div class="layout no-sidebar"><div class="entry-content"><h1>yes t</h1><p>yes {LONG}</p><p>yes short</p>
        <p>yes {LONG}</p><form><label>no mail</label><input></form></div><div class="sidebar-right"><p>no {LONG}</p></div></div><div class="siteFooter">no foot</div></body>""",
    "plain": f"<p>yes {LONG}<p>yes {LONG} {LONG}<p>yes {LONG}",
    "hidden": f'<article><p>yes {LONG}</p><div style="display: none">no {LONG}</div><p hidden>no x</p><template><p>no t</p></template><select><option>no s</select><p>yes end</p></article>',
    "links": f"""<p>no top</p><article><p><a href=1>yes one</a></p><p>yes</p><p><a href=2>yes two</a></p><p>yes x</p><ol><li><a>yes</a><li>yes {LONG}<li><a>yes z</a></ol><p>yes</p></article><p>no {LONG}</p>""",
    "roles": f'<div role="navigation">no {LONG}</div><div role="main"><p>yes {LONG}</p><div role="complementary">no x</div><p>yes z</p></div><div role="contentinfo">no {LONG}</div>',
}


@pytest.mark.parametrize("name", sorted(UNSEEN))
def test_unseen_pages(name):
    found = [b.text for b in pages.blocks(UNSEEN[name])]
    got = pages.main_text(UNSEEN[name])
    assert all(b.startswith(("yes", "no")) for b in found) and len(found) > 1
    assert got == "\n\n".join(b for b in found if b.startswith("yes"))


@pytest.mark.parametrize("page, want", [
    ("", []), ("  \n", []), ("just text", ["just text"]), ("a < b &lt; c <3 >", ["a < b < c <3 >"]), ("<p>a<p>b", ["a", "b"]),
    ("x<!-- <p>no</p> -->y<!-->z", ["xyz"]), ("x<!-- never closed <p>", ["x"]), ("a<script>var t='</p>';if(a<b){}</SCRIPT >b", ["ab"]),
    ("a<style>never closed", ["a"]), ("a<br>b<br/>c", ["a b c"]), ('<p title="a > b">c</p>', ["c"]), ("<p title='x>y</p>", ["y"]), ("a<p", ["a"]),
    ("&nbsp; a&#x41;&amp;lt;&bogus; \t b&amp", ["aA&lt;&bogus; b&"]), ("<b>f</b>oo <i>b</i>ar", ["foo bar"]), ("</p></div></x>a", ["a"]),
    ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("<td>a<td>b<tr><td>c", ["a", "b", "c"]), ("<?xml version='1'?><![CDATA[x]]>y", ["y"]), ("<DIV>A</Div>B", ["A", "B"]),
    ("<head><title>no</title><p>a", ["a"]), ("﻿a　b\x00", ["﻿a b\x00"]),
])
def test_blocks(page, want):
    assert [b.text for b in pages.blocks(page)] == want


def test_linear_time_on_hostile_pages():
    started = time.time()
    for page in ("<div>" * 200_000 + "</section>" * 200_000, "<" * 500_000, '<a href="' * 100_000, "<p><b>" * 100_000, "a" * 3_000_000, "&amp" * 300_000, "<!--" * 300_000, "<p x=" * 100_000):
        pages.main_text(page)
    assert time.time() - started < 30


def test_odd_rows(spark):
    schema = "text string, page_id long, url string, html string, n_chars string"
    data = [("t", 1, "u", "<article><p>Hi &amp; ho</p></article>", "x"), ("t", 1, "u", "<article><p>Hi &amp; ho</p></article>", "x"), ("t", None, None, None, None), ("t", 2, "u", "", "x"), ("t", 3, "u", "<article><p>\U0001f600é</p></article>", "x")]
    frame = spark.createDataFrame(data, schema).repartition(3)
    got = sorted((tuple(r) for r in pages.extract(frame).collect()), key=repr)
    assert got == sorted([(1, "u", "Hi & ho", 7), (1, "u", "Hi & ho", 7), (None, None, "", 0), (2, "u", "", 0), (3, "u", "\U0001f600é", 2)], key=repr)
    assert pages.extract(frame.limit(0)).collect() == []
