"""Pages with hand-made truth, and what the cut decides over plain thresholds."""

import re

import numpy as np
import pytest

from vecstrata.llm import html_extract as H

ONE, TWO = "First paragraph of some length, with a comma and an end.", "Second one follows, and it is about as long as the first one."
COOKIES = "We use cookies to improve your experience on this site. By going on you accept our policy."
PAGES = {
    "title in an article's header": (f'<article><header class="entry-header"><h1 class="entry-title">The real title</h1></header><p>{ONE}</p><p>{TWO}</p></article>', ["The real title", ONE, TWO]),
    "prose of an odd class": (f'<article><h1>A title here</h1><p>{ONE}</p><p class="form">This paragraph is prose too, whatever its class may say.</p><p>{TWO}</p></article>', ["A title here", ONE, "This paragraph is prose too, whatever its class may say.", TWO]),
    "byline": (f'<article><h1>A title here</h1><p class="byline">By Jane Doe</p><p>{ONE}</p><p>{TWO}</p></article>', ["A title here", "By Jane Doe", ONE, TWO]),
    "no article, plain divs": (f'<body><div><h1>A title here</h1><p>{ONE}</p><p>Ok.</p><p>{TWO}</p></div><div class="footer"><p>About us and how to reach us, any day of the week.</p></div></body>', ["A title here", ONE, "Ok.", TWO]),
    "no names at all": (f"<body><div><a href=/>Home</a> <a href=/n>News</a> <a href=/c>Contact</a></div><div><h1>Title words of the story</h1><p>{ONE}</p><p>{TWO}</p><p>Third.</p></div><div><p>&copy; 2020 Someone</p></div></body>", ["Title words of the story", ONE, TWO, "Third."]),
    "comments in the article": (f'<article><h1>Title words</h1><p>{ONE}</p><p>{TWO}</p><div class="comments"><h3>Comments</h3><div class="comment-body"><p class="text">I liked this very much, thanks for writing it all down for us.</p></div></div></article>', ["Title words", ONE, TWO]),
    "advert of prose in the article": (f'<article><h1>Title words</h1><p>{ONE}</p><div class="ad">Buy a new car now, it is the best one that you can get.</div><p>{TWO}</p></article>', ["Title words", ONE, TWO]),
    "a whole page with a sidebar": (f'<div class="page with-sidebar"><div id="menu"><a href=a>Home</a> <a href=b>News</a></div><div class="content"><h1>Title words</h1><p>{ONE}</p><p>Yes.</p><p>{TWO}</p></div><div class="sidebar"><h3>Latest</h3><ul><li><a href=1>One thing</a><li><a href=2>Another</a></ul></div></div>', ["Title words", ONE, "Yes.", TWO]),
    "notice outside": (f'<body><div class="notice"><p>We use cookies on all of these pages, as everyone does.</p></div><article><h1>Title words</h1><p>{ONE}</p><p>{TWO}</p></article></body>', ["Title words", ONE, TWO]),
    "data table in the article": (f"<article><h1>Title words</h1><p>{ONE}</p><table><tr><th>Name</th><th>Count</th></tr><tr><td>alpha</td><td>12</td></tr></table><p>{TWO}</p></article>", ["Title words", ONE, "Name", "Count", "alpha", "12", TWO]),
    "list of short items": (f"<article><h1>Title words</h1><p>{ONE}</p><ul><li>alpha</li><li>beta</li><li>gamma</li></ul><p>{TWO}</p></article>", ["Title words", ONE, "alpha", "beta", "gamma", TWO]),
    "section with an odd name": (f'<main><h1>Title words</h1><section class="social-history"><h2>Social history</h2><p>{ONE}</p><p>{TWO}</p></section></main>', ["Title words", "Social history", ONE, TWO]),
    "links with the same word": (f'<main><h1>Title words</h1><p>{ONE}</p><p>{TWO}</p><div class="social-links"><p>Follow us, and tell all of your friends to do so as well.</p></div></main>', ["Title words", ONE, TWO]),
    "prose of boilerplate classes": (f'<article><h1>Title words</h1><p>{ONE}</p><p class="related">{TWO}</p><p>{ONE}</p><p class="share-story">{TWO}</p><p>{ONE}</p></article>', ["Title words", ONE, TWO, ONE, TWO, ONE]),
    "notice without a name": (f"<body><div>{COOKIES}</div><div><h1>Title words</h1><p>{ONE}</p><p>{TWO}</p></div></body>", ["Title words", ONE, TWO]),
    "notice without a name in the article": (f"<article><h1>Title words</h1><p>{ONE}</p><div>{COOKIES}</div><p>{TWO}</p></article>", ["Title words", ONE, TWO]),
    "prose on cookies": (f"<article><h1>Baking at home</h1><p>{ONE}</p><p>The cookies are done when they are brown, and we like them warm.</p><p>{TWO}</p></article>", ["Baking at home", ONE, "The cookies are done when they are brown, and we like them warm.", TWO]),
    "comments of another name": (f'<article><h1>Title words</h1><p>{ONE}</p><p>{TWO}</p><div class="thread"><div><p>I liked this very much, thanks for writing it all down for us.</p></div><div><p>So did I, and I will come back for more of it.</p></div></div></article>', ["Title words", ONE, TWO]),
    "a forum's thread": (f'<body><div class="thread"><h1>Title words of the thread</h1><p>{ONE}</p><p>{TWO}</p></div></body>', ["Title words of the thread", ONE, TWO]),
    "rights line in the article": (f"<article><h1>Title words</h1><p>{ONE}</p><p>All rights reserved.</p><p>{TWO}</p></article><footer>&copy; us</footer>", ["Title words", ONE, "All rights reserved.", TWO]),
}


@pytest.mark.parametrize("name", PAGES)
@pytest.mark.parametrize("weights", ["prior", "trained"])
def test_hand_made_pages(name, weights, trained):
    page, want = PAGES[name]
    assert H.main_text(page, H.PRIOR if weights == "prior" else trained) == "\n\n".join(want)


def bare(page):
    """The page without class, id or role, its sectioning elements turned into plain ones."""
    page = re.sub(r"""\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", page)
    return re.sub(r"<(/?)(article|main|nav|aside|footer|header|section)\b[^>]*>", r"<\1div>", page)


def test_pages_without_names(trained):
    """Labels by text and neighbours alone against those of the ``<article>``; the given adverts are prose, and only their name tells."""
    import duckdb

    right = wrong = lost = 0
    for (page,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet' order by page_id").fetchall():
        named, nameless = H.blocks(page), H.blocks(bare(page))
        assert [b.text for b in named] == [b.text for b in nameless]
        for b, kept in zip(named, H.label(nameless, trained), strict=True):
            if "boiler name" not in b.hints:
                right += kept == (b.says > 0)
                wrong += kept != (b.says > 0)
                lost += b.says > 0 and not kept
    assert right / (right + wrong) > 0.99 and lost / (right + wrong) < 0.002


def test_repeated_rows_ties_and_other_columns(spark):
    page = PAGES["byline"][0]
    rows = spark.createDataFrame([(7, "u", page, "t", 1), (7, "u", page, "t", 2), (7, "v", None, "t", 3)], "page_id bigint, url string, html string, text string, n_chars int")
    found = sorted((r.page_id, r.url, r.text, r.n_chars) for r in H.extract(rows).collect())
    text = "\n\n".join(PAGES["byline"][1])
    assert found == [(7, "u", text, len(text))] * 2 + [(7, "v", "", 0)]
    assert H.extract(rows.limit(0)).count() == 0


@pytest.fixture(scope="module")
def trained():
    import duckdb

    return H.train([r[0] for r in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet' order by page_id").fetchall()])


def decided(pages, weights):
    """(blocks, blocks that the cut labels otherwise than the sign of their odds)."""
    n = other = 0
    for page in pages:
        found = H.blocks(page)
        kept = H.label(found, weights)
        n += len(found)
        other += sum((x > 0) != y for x, y in zip(H.capacities(found, weights), kept, strict=True))
    return n, other


def test_the_cut_decides(trained):
    n, other = decided([p for p, _ in PAGES.values()], trained)
    assert 0 < other < n / 4
    n, other = decided([p for p, _ in PAGES.values()], H.PRIOR)
    assert 0 < other < n / 4


def test_labels_are_those_of_the_whole_cut(trained):
    """Fixing sure blocks first changes no label: compare with a minimum cut over all blocks."""
    rng = np.random.default_rng(5)
    for page, _ in PAGES.values():
        found = H.blocks(page)
        weights = trained + rng.normal(size=len(trained))
        kept, odds, edges = H.label(found, weights), H.capacities(found, weights), H.smoothness(found)
        assert kept == H.minimum_cut([max(0.0, x) for x in odds], [max(0.0, -x) for x in odds], edges)


def test_long_page_and_null_ids(spark):
    page = "<article>" + "".join(f"<p>Paragraph number {k} of a page that is very long.</p>" for k in range(5000)) + "</article>"
    rows = H.extract(spark.createDataFrame([(None, "u", page), (None, None, "<p>x"), (1, "", None)], "page_id bigint, url string, html string")).collect()
    assert sorted((r.page_id is None, r.text.count("Paragraph")) for r in rows) == [(False, 0), (True, 0), (True, 5000)]


def test_sample_without_labelled_blocks(spark):
    pages = spark.createDataFrame([(1, "u", "<div>some text</div>"), (2, "u", "")], "page_id bigint, url string, html string")
    assert H.extract(pages).count() == 2 and (H.train(["<div>some text</div>", None]) == H.PRIOR).all()
