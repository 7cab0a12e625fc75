"""Main text of pages with links after the article, ordinary class names, comments, and no article element."""

import pytest

from lumenbank.llm import html_text

LONG = " ".join(["plain words of an article that goes on"] * 8)
LINKS = "<li><a href='/a'>Home</a></li><li><a href='/b'>All the news</a></li><li><a href='/c'>Contact</a></li>"


def page(inner, before="", after=""):
    return f"<html><body>{before}<article>{inner}</article>{after}</body></html>"


PAGES = {
    "nav after": (page(f"<h1>Title here</h1><p>{LONG}</p>", after=f"<nav>{LINKS}</nav>"), ["Title here", LONG]),
    "one paragraph before a linked footer": (page("<h1>Title</h1><p>Only this.</p>", after=f"<footer><p>{LINKS}</p></footer>"), ["Title", "Only this."]),
    "bare links after": (page(f"<h1>Title</h1><p>{LONG}</p><p>End.</p>", after=f"<div><h3>More</h3><ul>{LINKS}</ul></div>"), ["Title", LONG, "End."]),
    "header of the article": (page(f"<header class='article-header'><h1>A title</h1></header><p class='notice-board'>{LONG}</p><p class='share-price'>Up 4 %.</p><div id='tags-history'><p>Tags are old.</p></div>"), ["A title", LONG, "Up 4 %.", "Tags are old."]),
    "links in the article": (page(f"<p>{LONG}</p><p>Sources:</p><ul>{LINKS}</ul><p>The end.</p>", after=f"<nav>{LINKS}</nav>"), [LONG, "Sources:", "Home", "All the news", "Contact", "The end."]),
    "comments": (page(f"<h1>T</h1><p>{LONG}</p><section id='comments'><p>{LONG}</p></section>", after=f"<div class='comment-list'><article class='comment'><p>{LONG} me too</p></article></div>"), ["T", LONG]),
    "furniture by name": (page(f"<h1>T</h1><p>{LONG}</p><div class='related-posts'><p>Read this too, it is good</p></div>", before="<div class='site-header'><p>My site of words</p></div><div class='cookie-notice'><p>We use cookies on this site to make it better for everyone who reads it.</p></div>"), ["T", LONG]),
    "names of layouts": (f"<body class='has-sidebar'><div class='content-sidebar-wrap'><main><h1>T</h1><p>{LONG}</p></main></div><div class='sidebar'><p>{LONG}</p></div></body>", ["T", LONG]),
    "data attributes": (page(f"<div data-class='share' data-hidden='x'><p>{LONG}</p></div>"), [LONG]),
    "no article": (f"<body><div>{LINKS}</div><div><h1>About the garden of the house</h1><p>{LONG}</p><p>{LONG} again</p></div><div>{LINKS}</div></body>", ["About the garden of the house", LONG, f"{LONG} again"]),
    "no article, a paragraph before links": (f"<body><div>{LINKS}</div><div><p>{LONG}</p><p>Seven words are here before the links.</p></div><div><ul><li><a href='/n'>Other news of the day</a></li>{LINKS}</ul></div></body>", [LONG, "Seven words are here before the links."]),
    "words in attribute values": (page(f'<p title="the hidden truth">{LONG}</p><p data-note="my class=ad here">One more.</p><p alt=\'id="sidebar" style="display:none"\' class=intro>And one.</p>'), [LONG, "One more.", "And one."]),
    "article in a layout column": (f"<body><div class='sidebar-left'>{LINKS}</div><div class='sidebar-right'><article><h1>T</h1><p>{LONG}</p><div class='share'><p>Share this text now</p></div></article></div></body>", ["T", LONG]),
    "article in a shared post": (f"<body><nav>{LINKS}</nav><div class='post share'><article><p>{LONG}</p></article></div></body>", [LONG]),
    "most words in a layout column": (f"<body><div class='menu'>{LINKS}</div><div class='sidebar-content'><p>{LONG}</p><p>{LONG} again</p></div></body>", [LONG, f"{LONG} again"]),
    "a sidebar beside the article": (page(f"<p>{LONG}</p>", after=f"<div class='sidebar'><p>{LONG} {LONG} {LONG}</p></div>"), [LONG]),
    "run-together comments": (f"<body><div class='post'><p>{LONG}</p><p>{LONG} more</p></div><ol class='commentlist'><li>{LONG} me too</li></ol><div class='comment-respond'><p>Leave a reply to this text right here</p></div></body>", [LONG, f"{LONG} more"]),
    "commentary": (page(f"<div class='commentary'><p>{LONG}</p></div>"), [LONG]),
    "notices and sponsors": (page(f"<p>{LONG}</p><div class='sponsored-content'><p>A text from our sponsor about things to buy</p></div>", before="<div class='cc-window'><p>This site uses cookies to be a better one for all</p></div>"), [LONG]),
    "text outside the article": (page(f"<p>{LONG}</p>", before="<div>Skip to the text</div>", after="<div>A word from nobody at all in this place</div>"), [LONG]),
}


@pytest.fixture(scope="module")
def extracted(spark):
    pages = spark.createDataFrame([(i, f"u{i}", h, "x", 1) for i, (h, _) in enumerate(PAGES.values())], "page_id long, url string, html string, text string, blocks int")
    return {r.page_id: r.text for r in html_text.extract(pages).collect()}


@pytest.mark.parametrize("name", PAGES)
def test_page(extracted, name):
    assert extracted[list(PAGES).index(name)].split("\n") == PAGES[name][1]


def test_tree_uses_words_and_density(spark):
    model = html_text.fitted_tree(spark)
    importance = dict(zip(html_text.FEATURES, model.featureImportances.toArray()))
    assert importance["density"] > 0.02 and importance["words"] > 0.02
    assert importance["after_density"] < 0.1
    root = model._call_java("rootNode")
    assert html_text.FEATURES[root.split().featureIndex()] != "after_density"


def test_labels_have_every_block(spark):
    for html, labels in html_text.labelled_pages():
        assert len(html_text.blocks(html)) == len(labels)


def test_long_page(spark):
    words = " ".join(f"w{i}" for i in range(200_000))
    pages = spark.createDataFrame([(1, "u", page(f"<p>{words}</p>" + "<p>x</p>" * 20_000))], "page_id long, url string, html string")
    assert html_text.extract(pages).first().text == "\n".join([words] + ["x"] * 20_000)
