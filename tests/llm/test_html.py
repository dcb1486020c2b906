import html as entities
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from keystrata.llm import html_labels, html_text

ART = "The report was read by all of the people who had come to the hall on that cold evening."


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("plain words only, with no markup at all but enough of them.", "plain words only, with no markup at all but enough of them."),
        (f"<article><h1>Title</h1><p>{ART}</p></article>", f"Title\n{ART}"),
        (f"<ARTICLE><P>a &lt;b&gt; &amp;amp; &eacute;&#233;&#xe9; &copy &nosuch; 1 < 2{' ' * 9}\n\t x<P>{ART}", f"a <b> &amp; ééé © &nosuch; 1 < 2 x\n{ART}"),
        (f"<article><p>x<b>y</b>z <i>w</i><br>v</p><!-- <p>no</p> --><p>{ART}</p></article>", f"xyz w v\n{ART}"),
        (f"<article><script>var t='</p>';</script><style>p{{}}</style><p title='a>b'>{ART}</p></article>", ART),
        (f"<nav><a>Home</a></nav><main><p>{ART}</p><aside>Buy</aside><p>Yes.</p></main><footer>f</footer>", f"{ART}\nYes."),
        (f"<article><p>{ART}</p></article><section id=comments><article class=comment><p>{ART}</p></article></section>", ART),
        (f"<div class='cookie-banner'>We use cookies on this site to make it better for you.</div><article><p>{ART}</p><form><p>{ART}</p></form></article>", ART),
        (f"<body class='has-sidebar with-ads'><div class='sidebar-layout'><article><p>{ART}</p></article><div class=sidebar>{ART}</div></div></body>", ART),
        (f"<div class='content-sidebar-wrap'><div class=content><p>{ART}</p></div><div class='ad-container'>{ART}</div><div id=page-footer><p>{ART}</p></div></div>", ART),
        (f"<div class=site-notice><p>{ART}</p></div><div class='site-header'><p>{ART}</p></div><div id=main><p>{ART}</p><p>Yes.</p></div><ol class=comment-list><li>{ART}</li></ol>", f"{ART}\nYes."),
        (f"<header><h1>The site</h1></header><article><header><h1>Its title</h1></header><p>{ART}</p></article>", f"Its title\n{ART}"),
        (f"<article><p>{ART}</p><ul><li><a href=1>{ART}</a></li><li><a href=2>{ART}</a></li><li><a href=3>{ART}</a></li></ul></article>", ART),
        (f"<article><p>{ART}</p><p><a href=1>{ART}</a></p><p>{ART}</p></article>", f"{ART}\n{ART}\n{ART}"),
        (f"<article><p>{ART}</p><p>cut off <a hre", f"{ART}\ncut off"),
        (f"<article><p>{ART}</p><!-- never closed <p>x</p>", ART),
        (f"<article><p>{ART}</p><script>never closed <p>x</p>", ART),
        (f"<p>{ART}</p>", ART),
    ],
)
def test_cases(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("tag", ['<script src="/a.js"/></script>', "<script src=//cdn.x/lib/></script>", "<script src=//cdn.x/lib/>var t='<p>no</p>';</SCRIPT >", "<style media=a/>p{}</style>", "<title/>Site</title>", "<textarea name=a/>no</textarea>", "<script src='/a.js' />"])
def test_slash_in_the_start_tag_of_an_unparsed_element(tag):
    page = f"<head>{tag}</head><article><p>{ART}</p></article>"
    assert html_text.main_text(page) == ART
    # a later element's end tag isn't this one's
    name = re.match(r"<(\w+)", tag)[1]
    assert html_text.main_text(f"{page}<{name}>no</{name}>") == ART


def test_slashed_unparsed_elements_stay_linear():
    for tail in ("", "</script>"):
        assert html_text.main_text("<script/>" * 100_000 + ART + tail) in (ART, "")


@pytest.mark.parametrize("n", [10, 10_000])
def test_attributes_of_any_length_are_read(n):
    style = f"style='background:url(data:image/png;base64,{'A' * n})'"
    for one in ("class=sidebar", "class=ad", "class='cookie-banner'", "id=comments", "role=navigation"):
        for attrs in (f"{one} {style}", f"{style} {one}"):
            assert html_text.main_text(f"<article><p>{ART}</p></article><div {attrs}><p>{ART}</p></div>") == ART
            assert html_text.blocks(f"<div {attrs}>x</div>")[0].bad
    for one in ("id=content", "role=main"):
        assert html_text.blocks(f"<div {one} data-x='{'y' * n}'>x</div>")[0].good
    # not an attribute: part of another one's value
    assert not html_text.blocks(f"""<div data-html="<p class='ad' id=footer>{'y' * n}">x</div>""")[0].bad


def test_long_attributes_stay_linear():
    for attrs in ("id " * 100_000, "id=" * 100_000, 'id="' * 100_000, "id = '" * 100_000, "id" + " " * 300_000, "a'\"" * 100_000, "=" * 300_000):
        assert isinstance(html_text.main_text(f"<div {attrs}>{ART}</div>"), str)


def test_tree_fits_its_table_and_holds_out():
    x, y = html_labels.labelled_table()
    assert (html_text.default_tree().predict(x) == y).mean() > 0.96
    fold = np.arange(len(y)) % 5
    right = sum((html_text.train(x[fold != k], y[fold != k]).predict(x[fold == k]) == y[fold == k]).sum() for k in range(5))
    assert right / len(y) > 0.85


def test_pages_held_out_by_page():
    """Hand-written and drawn pages, each page wholly inside or outside the training part; and pages of another draw."""
    x, y, page = html_labels.labelled_blocks((*html_labels.PAGES, *html_labels.drawn_pages()))
    for k in range(5):
        out = page % 5 == k
        assert (html_text.train(x[~out], y[~out]).predict(x[out]) == y[out]).mean() > 0.97
    x, y, _ = html_labels.labelled_blocks(tuple(html_labels.drawn_pages(150, seed=99)))
    assert (html_text.default_tree().predict(x) == y).mean() > 0.98
    used = {html_text.FEATURES[f] for f in html_text.default_tree().feature if f >= 0}
    assert {"words", "before_words", "after_words"} <= used and used & {"before_density", "after_density", "near_density"}


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<article class='post side-by-side'><h1>T</h1><p>{ART}</p></article>", f"T\n{ART}"),
        (f"<article class='category-discussion tag-legal'><p>{ART}</p></article>", ART),
        (f"<article id='notice-of-sale'><p>{ART}</p><p>Yes.</p></article>", f"{ART}\nYes."),
        (f"<div class='notice-of-sale'><p>{ART}</p><p>{ART}</p><p>{ART}</p></div><div class=footer>Imprint</div>", f"{ART}\n{ART}\n{ART}"),
        (f"<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul><article><p>{ART}</p><p>{ART}</p></article>", f"{ART}\n{ART}"),
        (f"<body><div><nav><a href=/>Home</a></div><main><p>{ART}</p></main></body>", ART),
        (f"<article><p>Call <label>me</label> now. {ART}</p></article>", f"Call me now. {ART}"),
        (f"<article><p>{ART} Where <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article>", f"{ART} Where x=2 holds."),
        (f"<article><p>{ART}</p></article><section class=comments><article class=comment><p>{ART}</p><p>{ART}</p><p>{ART}</p></article></section>", ART),
    ],
)
def test_misleading_names_and_missing_tags(page, want):
    assert html_text.main_text(page) == want


def test_unclosed_elements_are_linear():
    for unit in ("<p>x<iframe>", "<p>x<svg>", "<nav><p>x", "<div class=ad><p>x", "<article><nav>x"):
        began = time.process_time()
        html_text.main_text(unit * ((1 << 20) // len(unit)))
        assert time.process_time() - began < 10


def test_held_out_pages():
    """Pages of the test tables, whose article element holds the text."""
    for h in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        article = re.search(r"<article>(.*)</article>", h, re.S)[1].replace("<br>", " ")
        parts = (" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert html_text.main_text(h) == "\n".join(b for b in parts if b)


def test_long_and_broken_pages_stay_linear():
    for page in ("<div>" * 50_000 + ART, "</div>" * 50_000 + ART, "<" * 200_000, "<!--" * 100_000, '<a b="' * 50_000, "&" * 200_000, "<p>x" * 50_000, "<script>" * 50_000):
        assert isinstance(html_text.main_text(page), str)


def test_frame(spark):
    rows = [(1, "u", f"<article><p>{ART}é</p></article>", "x"), (1, "u", f"<article><p>{ART}é</p></article>", "x"), (None, None, None, None), (2, "v", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.url, r.text, r.n_chars) for r in html_text.extract(df).collect())
    assert got == [("1", "u", ART + "é", len(ART) + 1)] * 2 + [("2", "v", "", 0), ("None", None, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0
