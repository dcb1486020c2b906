"""A small labelled table of text blocks, as pages: a block whose text begins with ``+`` is main text, with ``-`` it is not.

``PAGES`` are written by hand; ``drawn_pages`` are put together from parts of known label, with and without element
names and classes that say what they hold, with misleading ones and with end tags that are missing.
"""

from __future__ import annotations

import random

import numpy as np

#: Pages drawn from parts.
DRAWN = 300

LONG = "+ The council met on Tuesday to discuss the plan for the old harbour, which has been closed to large ships since the storm of last winter, and agreed to ask the public."
MEDIUM = "+ Work will begin in spring, the mayor said, and should take two years."
SHORT = "+ Nobody objected."

PAGES = (
    # an article element between a menu and a footer
    f"<nav><ul><li><a href=/>- Home</a></li><li><a href=/n>- News</a></li><li><a href=/s>- Sport today</a></li></ul></nav><article><h1>+ Harbour plan agreed</h1><p>{LONG}</p><p>{SHORT}</p><p>{MEDIUM}</p><p>+ Yes.</p></article><footer>- &copy; harbour.example. All rights reserved by the publisher.</footer>",
    # paragraphs left open, adverts inside and around
    f"<div class=ad>- Buy shoes now at half the price.</div><article><h1>+ Old boats</h1><p><b>{LONG}<br><p>{MEDIUM}<div class='ad-slot'>- Best insurance for your boat, call today and save a lot of money on it.</div><p>{SHORT}<p>+ End</article><footer>- Imprint</footer>",
    # no article element: long blocks without links are the text
    f"<div><a href=/>- Home</a> <a href=/a>- About</a> <a href=/c>- Contact</a></div><div><h2>+ The storm and the town</h2></div><div>{LONG}</div><div>{MEDIUM} {MEDIUM[2:]}</div><div>{LONG}</div>",
    f"<table><tr><td><a href=1>- One page</a> <a href=2>- Another page</a></td></tr><tr><td>{LONG}</td></tr><tr><td>{LONG}</td></tr><tr><td><a href=3>- Next</a></td></tr></table>",
    # sidebar, related links, comments
    f"<header class=site-header><h1>- The Daily Harbour</h1><p>- News from the coast since the year of the great flood, every day but Sunday.</p></header><main><h1>+ Ships return</h1><p>{LONG}</p><ul><li>+ first the ferry</li><li>+ then the pilots</li></ul><p>{MEDIUM}</p></main><aside><h3>- Most read</h3><p>- The council met on Monday to discuss the plan for the new road through the town.</p></aside>"
    f"<section class=comments><h3>- Three comments</h3><div class=comment><p>- I was there on that day and the storm took the roof off my house, so I know what I am talking about here.</p></div><div class=comment><p>- Agreed.</p></div></section>",
    f"<div id=sidebar><ul><li><a href=1>- Ten best walks along the coast</a></li><li><a href=2>- Where to eat</a></li></ul></div><div class=entry-content><p>{MEDIUM}</p><p>{SHORT}</p><blockquote>{LONG}</blockquote><p>+ Why?</p></div><div id=disqus_thread><p>- First! What a good piece of writing this is, thank you very much for it.</p></div>",
    # notices and forms
    f"<div class=cookie-notice>- We use cookies to make this site work and to learn how it is used by its readers every day.<button>- Accept</button></div><main><p>{LONG}</p><p>{SHORT}</p></main><form><label>- Your name</label><p>- Leave your address and we will send you a letter each week with all the news of the coast.</p><button>- Send</button></form>",
    f"<div role=alert>- This page has moved to a new address, please change your bookmarks as soon as you can.</div><div role=main><h1>+ Tides</h1><p>{MEDIUM}</p><p>{MEDIUM}</p></div><div role=contentinfo>- Harbour Press, 12 Quay Street</div>",
    # lists of links inside an article; a link in running text stays
    f"<article><h1>+ Guide to the coast</h1><p>{LONG[:90]} <a href=x>as we reported</a> {LONG[90:]}</p><p>{SHORT}</p><ul><li><a href=1>- Five beaches you should see</a></li><li><a href=2>- The best lighthouses</a></li><li><a href=3>- A weekend by the sea</a></li></ul></article>",
    f"<article><header><h1>+ Two boats lost</h1></header><p>{MEDIUM}</p><h2>+ What happened</h2><p>{LONG}</p><p><a href=s>+ Read the full report of the harbour master</a></p><p>{SHORT}</p><footer>- Filed under boats</footer></article>",
    f"<article class=post><div class=share>- Share this</div><p>{SHORT}</p><p>+ It rained.</p><p>{LONG}</p><div class=newsletter>- Get our letter in your inbox each morning before you have had your coffee.</div><p>{MEDIUM}</p></article><div class=related><p>- Harbour plan agreed after a long night of talks between the town and the owners.</p></div>",
    f"<div class=content><h1>+ Notes</h1><p>+ One.</p><p>+ Two of them.</p><p>{MEDIUM}</p></div><div class=footer>- Back to top</div><div class=copyright>- All words on this page belong to those who wrote them and may not be copied.</div>",
    f"<div><a href=/>- Start</a></div><p>{LONG}</p><p>{LONG}</p><p>{MEDIUM}</p><p>+ He agreed.</p><p>{LONG}</p><div><a href=/p>- Privacy</a> | <a href=/t>- Terms</a></div>",
    f"<article><h1>+ A short one</h1><p>+ Closed.</p></article><footer>- Made by hand in the town of the old harbour by people who care.</footer>",
    # an article's own header: the title is text, what stands beside it is not
    f"<article><header><h1>+ The old lighthouse</h1><p>- By our reporter on the coast</p></header><p>{LONG}</p><p>{MEDIUM}</p></article>",
    f"<header><h1>- Coast and Harbour</h1><p>- All the news by the sea</p></header><main><header class=entry-header><h1>+ A new ferry</h1></header><p>{MEDIUM}</p><p>{LONG}</p></main>",
    f"<header class=site-header><h1>- Harbour Press</h1></header><article class=post><header><h2>+ Storm on the coast</h2><p>- Posted this morning</p></header><p>{SHORT}</p><p>{LONG}</p></article>",
    f"<header><h2>- The Quay</h2></header><article><header><h1>+ Night at sea</h1></header><p>{LONG}</p></article>",
    # headlines that link away, long ones too; a linked paragraph among others stays
    f"<article><p>{LONG}</p><p>{MEDIUM}</p><ul><li><a href=1>- Seven things that the council has not told you about the new harbour</a></li><li><a href=2>- Why the ferry to the islands was late on each day of last week</a></li><li><a href=3>- The woman who has painted every ship on this coast since the war</a></li></ul></article>",
    f"<p>{LONG}</p><p>{LONG}</p><div><a href=1>- What the owners of the shipyard said when they were asked about the fire</a></div><div><a href=2>- Ten years on, the families of the lost crew still ask for answers</a></div><div><a href=3>- How to get to the islands when the ferry does not run in winter</a></div>",
    f"<article><p>{MEDIUM}</p><p><a href=1>+ The whole letter of the harbour master to the council can be read here</a></p><p>{LONG}</p><p>{MEDIUM}</p></article>",
    f"<article><p>{LONG}</p><p><a href=1>+ A map of the coast with all the places named in this report is here</a></p><p>{SHORT}</p></article>",
    f"<div><a href=1>- The council has agreed on a plan for the harbour at last</a></div><div><a href=2>- The ferry will run again from the first day of spring on</a></div><div><a href=3>- Storm takes the roof off the old school by the sea</a></div><p>{LONG}</p><p>{MEDIUM}</p>",
    f"<article><p>{SHORT}</p><p><a href=1>+ The list of all ships that the storm has taken is kept by the town</a></p><p>{SHORT}</p></article>",
    f"<article><h1>+ Ships</h1><p><a href=1>+ We wrote about the first of these ships a year ago in a long report</a></p><p>{SHORT}</p><p><a href=2>+ What became of her crew is told in this second one</a></p><p>{MEDIUM}</p></article>",
    f"<article><p>+ It was cold.</p><p><a href=1>+ The song that they sang on the way home</a></p><p>+ Nobody slept.</p></article>",
    f"<article><p>{MEDIUM}</p><p><a href=1>+ As the harbour master wrote to us in the spring</a></p><p>{SHORT}</p></article>",
    f"<article><p>{LONG}</p><div><a href=1>- Read on: the plan for the harbour and what it will cost the town</a></div><div><a href=2>- Read on: the storm of last winter in pictures from our readers</a></div></article>",
    f"<article><p>{LONG}</p><ul><li><a href=1>- A walk to the lighthouse and back with the whole family</a></li><li><a href=2>- Where to sleep when all the houses by the sea are full</a></li></ul><p>{LONG}</p></article>",
    f"<p>{MEDIUM}</p><p>{LONG}</p><ul><li><a href=1>- The council and the shipyard have come to terms at last</a></li><li><a href=2>- The islands will have a doctor of their own again</a></li><li><a href=3>- More</a></li></ul>",
    # hardly any markup
    f"<p>{LONG}</p>",
    f"<html><body>{MEDIUM} {SHORT[2:]}</body></html>",
    f"<p>{SHORT}</p><p>{LONG}</p>",
    f"<h1>+ Boats</h1><p>{MEDIUM}</p><p>{SHORT}</p>",
    f"<div><a href=1>- Boats</a></div><div>{MEDIUM}</div><div>{SHORT}</div>",
    f"<article><p>{LONG}</p><p><a href=s>+ The harbour master wrote a longer report on this</a></p><p>{MEDIUM}</p></article>",
    f"<article><p>{LONG}</p><ul><li><a href=1>- More on ships</a></li><li><a href=2>- More on storms and tides</a></li><li><a href=3>- More</a></li></ul><p>{MEDIUM}</p></article>",
    f"<article><p>+ Seen.</p><p>{SHORT}</p></article><div class=sidebar><p>- Follow us on all the channels that you like to read every day.</p></div>",
    f"<article><h1>+ Poem</h1><p>+ The sea</p><p>+ the sky</p><p>+ and I</p></article><div class=promo>- Order the book with all poems today and get a free pen with it.</div>",
)


NAV = ("menu", "top-nav", "navbar", "main-navigation", "breadcrumbs", "toc")
SIDE = ("sidebar", "side-rail", "widget widget_recent", "related-posts", "recommended-for-you")
ADS = ("ad", "ad-slot", "promo-box", "sponsored", "banner top", "adsense-unit", "newsletter-signup", "cookie-notice", "alert alert-info", "subscribe-bar")
FEET = ("footer", "site-footer", "copyright", "foot-links", "legal-links")
TALK = ("comments", "comment-list", "responses", "reader-comments", "discussion-thread", "disqus_thread")
#: Names that hint at boilerplate and hold the article, or say nothing.
ODD = ("post side-by-side", "category-discussion tag-legal", "notice-of-sale", "search-engines-explained", "menu-of-the-week", "banner-year-review", "social-policy", "alert-fatigue-essay", "x17", "shell", "hero", "c-3")
#: Names with a word that nobody knows, which hold boilerplate.
HINTED = ("promo-summer", "acme-ad-2", "share-acme", "x-newsletter-z", "foo-related-bar")


def drawn_pages(n: int = DRAWN, seed: int = 7) -> list[str]:
    """The same pages whenever they are drawn."""
    r = random.Random(seed)

    def words(low: int, high: int, end: str = "") -> str:
        return " ".join(r.choice(("sea", "harbour", "of", "the", "council", "a", "ship", "was", "storm", "and")) for _ in range(r.randint(low, high))) + end

    def links(label: str, low: int, high: int, size: tuple[int, int], item: str = "li") -> str:
        return "".join(f"<{item}><a href=/{k}>{label} {words(*size)}</a></{item}>" for k in range(r.randint(low, high)))

    def said(element: str, names: tuple[str, ...], how: str, inner: str) -> str:
        """The inner part in a container that says what it holds, or in one that doesn't."""
        if how == "elements":
            return f"<{element}>{inner}</{element}>"
        return f"<div class='{r.choice(names)}'>{inner}</div>" if how == "classes" else f"<div>{inner}</div>"

    def paragraph(label: str) -> str:
        size = r.choice(((1, 4), (5, 14), (15, 40), (30, 110), (30, 110)))
        text = words(*size, r.choice((".", ".", ".", "?", ":", "")))
        kind = r.random()
        if kind < 0.12 and size[1] > 14:
            text = f"{text} <a href=x>{words(1, 5)}</a> {words(4, 20, '.')}"
        elif kind < 0.16:
            text = f"{text} <label>{words(1, 2)}</label> {words(2, 5, '.')}"
        if kind > 0.97 and label == "+":
            return f"<p><a href=y>{label} {words(5, 16)}</a></p>"
        return f"<p>{label} {text}" + r.choice(("</p>", "</p>", ""))

    def article(how: str) -> str:
        body = [f"<h1>+ {words(2, 10)}</h1>"] * (r.random() < 0.8)
        if r.random() < 0.2 and body:
            body = [f"<header>{body[0]}<p>- {words(3, 7)}</p></header>"]
        for _ in range(r.choice((1, 2, 3, 5, 8, 12))):
            body.append(paragraph("+"))
            x = r.random()
            if x < 0.08:
                body.append(f"<h2>+ {words(1, 6)}</h2>" + paragraph("+"))
            elif x < 0.14:
                body.append("<ul>" + "".join(f"<li>+ {words(1, 14, r.choice(('', '.')))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.18:
                body.append(f"<blockquote>+ {words(8, 40, '.')}</blockquote>")
            elif x < 0.28 and how != "plain":
                body.append(f"<div class='{r.choice(ADS + HINTED)}'>- {words(3, 18, r.choice(('.', '')))}</div>")
        if r.random() < 0.25:
            body.append("<ul>" + links("-", 3, 5, (4, 13)) + "</ul>")
        inner = "".join(body)
        if how == "elements":
            return f"<{(e := r.choice(('article', 'article', 'main')))}{r.choice(('', '', ' class=' + chr(39) + r.choice(ODD) + chr(39)))}>{inner}</{e}>"
        if how == "classes":
            return f"<div class='{r.choice(('content', 'entry-content', 'post', 'article-body', 'story', *ODD))}'>{inner}</div>"
        return r.choice((f"<div>{inner}</div>", inner, f"<table><tr><td>{inner}</td></tr></table>", f"<div class='{r.choice(ODD)}'>{inner}</div>"))

    out = []
    for _ in range(n):
        how = r.choice(("elements", "elements", "classes", "classes", "plain"))
        parts = []
        menu = "<ul>" + links("-", 3, 9, (1, 3)) + "</ul>" if r.random() < 0.7 else links("-", 3, 6, (1, 3), r.choice(("div", "span")))
        if r.random() < 0.25 and how != "plain":
            parts.append(f"<div class='{r.choice(('site-notice', 'cookie-bar', 'alert', 'top-banner'))}'><p>- {words(3, 30, '.')}</p></div>")
        if r.random() < 0.6:
            parts.append(said("header", ("site-header", "masthead", "header"), how if how != "plain" else "classes", (f"<h1>- {words(1, 4)}</h1>" if r.random() < 0.6 else "") + f"<p>- {words(3, r.choice((8, 40)), r.choice(('', '.')))}</p>"))
        if r.random() < 0.85:
            nav = said("nav", NAV, how, menu)
            parts.append(nav.replace("</nav>", "") if r.random() < 0.25 else nav)
        if r.random() < 0.5 and how != "plain":
            parts.append(f"<div class='{r.choice(ADS)}'>- {words(3, 25, r.choice(('.', '')))}</div>")
        parts.append(article(how))
        if r.random() < 0.4:
            parts.append(said("aside", SIDE, how, f"<h3>- {words(1, 3)}</h3><ul>{links('-', 3, 7, (2, 12))}</ul>"))
        elif r.random() < 0.3 and how != "plain":
            parts.append(said("aside", SIDE, how, f"<h3>- {words(1, 3)}</h3><p>- {words(8, 40, '.')}</p>"))
        if r.random() < 0.4:
            talk = "".join(f"<div class=comment><p>- {words(2, 60, '.')}</p></div>" for _ in range(r.randint(1, 9)))
            parts.append(f"<section id='{r.choice(TALK)}'><h3>- {words(1, 3)}</h3>{talk}</section>")
        if r.random() < 0.2:
            parts.append(f"<form><label>- {words(1, 3)}</label><p>- {words(8, 30, '.')}</p><button>- {words(1, 2)}</button></form>")
        if r.random() < 0.85:
            foot = f"<p>- {words(2, 14, r.choice(('', '.')))}</p>" if how != "plain" else ""
            parts.append(said("footer", FEET, how, foot + links("-", 0 if foot else 2, 5, (1, 2), "span")))
        out.append("<html><body>" + "".join(parts) + "</body></html>")
    return out


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks."""
    return labelled_blocks((*PAGES, *drawn_pages()))[:2]


def labelled_blocks(pages: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and page numbers of all blocks.  The marks at the front of the texts go before features are taken."""
    from .html_text import blocks, features

    xs, ys, of = [], [], []
    for number, page in enumerate(pages):
        rows, label = [], []
        for b in blocks(page):
            marks = b.text.count("+ ") + b.text.count("- ")
            linked = b.linked - (marks if b.linked > marks and b.linked == b.words else 0)
            label.append(b.text[0] == "+")
            text = b.text[2:] or "."
            rows.append(b._replace(text=text, words=max(1, b.words - marks), linked=max(0, min(linked, b.words - marks))))
        xs.append(features(rows))
        ys.append(label)
        of += [number] * len(rows)
    return np.vstack(xs), np.concatenate(ys).astype(int), np.array(of)
