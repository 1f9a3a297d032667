"""License scans and main texts of pages."""

import random
import re

import pytest
from llm_helpers import by_id, prose
from linkloom.llm import html_text as H
from linkloom.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def edit(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(1, len(out) - 1)
        kind = rng.choice("sid")
        if kind == "s":
            out[i] = rng.choice("qz")
        elif kind == "i":
            out.insert(i, rng.choice("qz"))
        elif " " not in (out[i - 1], out[i + 1]):  # two spaces would become one
            del out[i]
    return "".join(out)


def test_base_equals_brute_force(spark, odd_docs, odd_rows, no_docs):
    cols = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    want = sorted(((r[0], *brute_base(r[1])) for r in odd_rows), key=lambda t: [(x is not None, str(type(x)), x if x is not None else 0) for x in t])
    assert by_id(L.license_scan(odd_docs), *cols) == want
    texts = ["Under the MIT License; under-the-mit-license under the mit license", "cc by nc cc by nc", "CC BY-NC 4.0", "apache licenses version 2", "Apache License, Version 2.0",
             "thunder the mit license", "é under the mit license é", "under the mit licenseé", "under", "the mit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert by_id(L.license_scan(df), *cols) == sorted((i, *brute_base(t)) for i, t in enumerate(texts))
    assert L.license_scan(no_docs).count() == 0


def test_every_notice_is_found_within_its_edits():
    rng, base, notices = random.Random(7), tuple(L.BASE.items()), tuple(L.NOTICES.items())
    for notice, label in notices:
        for _ in range(25):
            n = rng.randrange(0, L.edits_allowed(notice) + 1)
            text = L.normalised(f"{prose(rng, 30)} {edit(rng, notice, n)} {prose(rng, 30)}".encode())
            found = L.scan_text(text, base, notices)
            assert label in found["labels"].split(",") and found["score"] >= 1 - n / len(notice) - 1e-9, (notice, text)
    for _ in range(50):
        assert L.scan_text(prose(rng, 300), base, notices)["labels"] == ""


def test_span_and_edits_are_reported():
    notices = tuple(L.NOTICES.items())
    text = L.normalised(b"one two Licnsed under the Apache Licence, Version 2.0 end")
    assert L.scan_text(text, tuple(L.BASE.items()), notices)["spans"] == [{"label": "apache-2", "first_word": 2, "n_words": 8, "edits": 2}]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site to make things better for everybody who comes here to read.</p></div>
<div class="ad">Buy now</div>%s<aside><p>Side text that is long enough to look like a paragraph of its own, but is a side bar.</p></aside>
<section id="comments"><article class="comment"><p>A reader says something long that must not be part of the main text of this page.</p></article></section>
<form><label>Name</label><textarea>x</textarea></form><footer>&copy; me</footer>%s"""


@pytest.mark.parametrize("tail", ["</body></html>", ""])
def test_article_and_nothing_else(tail):
    body = "<h1>Head &amp; line</h1><p>First\n   para <b>bold</b>&nbsp;text.<br>next</p><!-- <p>hidden</p> --><p>x<div class='ad'>Ad</div><p>1 &lt; 2<ul><li>item</li></ul>"
    want = "Head & line\nFirst para bold text. next\nx\n1 < 2\nitem"
    assert H.main_text(PAGE % (f"<article>{body}</article>", tail)) == want
    assert H.main_text(PAGE % (f"<main>{body}</main>", tail)) == want


def test_pages_without_an_article_keep_text_between_surge_and_dive():
    words = prose(random.Random(1), 30)
    menu = "".join(f"<div><a href=/{i}>link number {i}</a></div>" for i in range(8))
    page = f"<body>{menu}<div>{words}</div><div>short</div><div>{words}</div>{menu}<div>end</div></body>"
    assert H.main_text(page) == f"{words}\nshort\n{words}"
    assert H.main_text("<p>tiny</p>") == "tiny"


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain text"), (3, "u", "<"), (3, "u", "a < b <p"), (4, "u", "<p title='x"), (5, "u", "<script>never closed"), (6, "u", "<nav>never closed<p>x</p>"),
            (7, "u", "&am &amp &#8364; &bogus;"), (8, "u", "<article><p>" + "long " * 200_000 + "</p></article>"), (8, "u", "<article></article><p>out</p>"), (9, "u", "</p></div></article>x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = H.extract(df.selectExpr("*", "1 as text", "2 as n_chars")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    texts = sorted(r.text[:40] for r in got)
    assert texts == sorted(["", "", "plain text", "<", "a < b", "", "", "", "&am & € &bogus;", ("long " * 200_000)[:40], "out", "x"])
    assert H.extract(df.limit(0)).count() == 0


def test_marked_articles_of_the_small_table(spark):
    import html

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert H.main_text(r.html) == "\n".join(b for b in blocks if b)


LONG = "This paragraph is long enough to surge on its own, since it holds far more than the characters that a window needs."


def test_a_removed_block_does_not_end_its_containers_text():
    page = f"<body><div class=content><p>{LONG}</p><div class=ad>Buy</div><p>Short closing.</p></div><aside>x</aside><div>end</div></body>"
    assert H.main_text(page) == f"{LONG}\nShort closing."
    links = "".join(f"<p><a href=/{i}>link {i}</a></p>" for i in range(4))
    assert H.main_text(f"<div><p>{LONG}</p>{links}<p>Short.</p></div>") == f"{LONG}\nlink 0\nlink 1\nlink 2\nlink 3\nShort."
    assert H.main_text(f"<div><p>{LONG}</p></div><aside>x</aside><div>other</div>") == LONG


@pytest.mark.parametrize("page", ["<article><p class=ad>Buy<p>Real text</p></article>", "<article><ul><li class=ad>Buy<li>Real text</ul></article>",
                                  "<article><dl><dt class=ad>Buy<dd>Real text</dl></article>", "<article><table><tr><td class=ad>Buy<td>Real text</table></article>",
                                  "<article><div><p class=ad>Buy</div>Real text</article>", "<article><table><tr class=ad><td>Buy<td>x<tr><td>Real text</table></article>",
                                  "<article><p class=ad>Buy <span>now</span><br><img src=x><div>Real text</div></article>"])
def test_a_removed_element_ends_where_html_implies_it(page):
    assert H.main_text(page) == "Real text"


def test_names_of_a_wrapper_do_not_remove_the_article():
    for attrs in ('class="layout has-sidebar"', 'id=page class="no-comments"', 'class="layout sidebar"', 'class="with-footer"'):
        assert H.main_text(f"<div {attrs}><article><p>Real text</p></article><div class=sidebar>x</div></div>") == "Real text"
        assert H.main_text(f"<div {attrs}><p>{LONG}</p></div>") == LONG
    assert H.main_text('<article class="post share related"><p>Real text</p></article><div>x</div>') == "Real text"
    assert H.main_text('<article><p>Real text</p></article><article class="comment"><p>No</p></article><section id=comments><article id=c1>No</article></section>') == "Real text"
