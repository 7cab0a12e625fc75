"""Main text of web pages: flat text blocks with neighbour features, kept or dropped by a trained decision tree."""

from __future__ import annotations

import re
from html import unescape

from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbank.llm.common import map_rows

# How tags behave.
BLOCK_TAGS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
UNREAD_TAGS = set("script style noscript template iframe textarea title svg math object canvas audio video".split())
BOILER_TAGS = set("nav footer aside form dialog menu button select fieldset label head search".split())
BOILER_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs cc comment comments consent cookie cookies disqus footer gdpr login masthead "
    "menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion recommended related replies reply share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription toolbar topbar".split()
)
#: Words that may stand beside one of these in a class name without making it another thing.
PLACE_WORDS = set(
    "area articles bar block blocks body bottom box button buttons column container content count footer form global group header holder inner item items left link links list main menu "
    "message news outer page panel posts primary reader respond right row secondary section site slot social stories strip tags thread top unit user users widget widgets window wrap wrapper".split()
)
#: Names that layouts also give to columns and wrappers around an article.
LAYOUT_NAMES = set("banner masthead menu modal nav navbar panel popup share sharing sidebar social toolbar topbar".split())
#: Run-together names of readers' comments; a commentary is a text.
COMMENT_NAME = re.compile(r"^(?:user)?comments?(?!ar(?:y|ies))[a-z]*$")
BOILER_ROLES = set("navigation banner contentinfo complementary search form dialog alert".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|[^<]++|<""", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: Attributes one after the other, each with its whole value, so that none is read inside a value.
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")

BLOCKS = "array<struct<text:string,words:double,linked:double,boiler:double,main:double,heading:double>>"


def furniture(name: str) -> bool:
    """Whether a class or id names page furniture: one of BOILER_NAMES, beside PLACE_WORDS and numbers at most.

    So ``ad-slot`` and ``related-posts`` do, and ``article-header``, ``notice-board`` and ``share-price`` do not.
    """
    parts = [p for p in re.split(r"[^a-z]+", name) if p]
    named = [p in BOILER_NAMES or bool(COMMENT_NAME.match(p)) for p in parts]
    return any(named) and all(n or p in PLACE_WORDS for n, p in zip(named, parts))


#: How an element is kept out: not at all, by a name that layouts use too, or for good.
OPEN, BY_LAYOUT, CLOSED = 0, 1, 2


def boilerplate(tag: str, attributes: str, in_main: bool) -> int:
    """Whether an element holds no main text, by its tag, role, class or id; the page itself and ``main`` always may."""
    if tag in ("html", "body", "main"):
        return OPEN
    if tag in BOILER_TAGS or tag == "header" and not in_main:
        return CLOSED
    found = OPEN
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        if name == "hidden" or name == "style" and "display:none" in value.replace(" ", "") or name == "role" and value in BOILER_ROLES:
            return CLOSED
        for x in filter(furniture, value.split()) if name in ("class", "id") else ():
            parts = [p for p in re.split(r"[^a-z]+", x) if p]
            found = max(found, BY_LAYOUT if all(p in LAYOUT_NAMES or p in PLACE_WORDS for p in parts) else CLOSED)
    return found


def reopened(found: list[tuple]) -> set[int]:
    """The containers kept out by a layout name whose text is the page's main text after all.

    Only where no other main element has text: those around main elements, or
    else the one with more than half of the words that aren't kept out for good.
    """
    if any(main and kept == OPEN for _, _, _, kept, main, _, _ in found):
        return set()
    around = {root for _, _, _, kept, main, _, root in found if kept == BY_LAYOUT and main and root}
    if around:
        return around
    words: dict[int, float] = {}
    for _, n, _, kept, _, _, root in found:
        if kept != CLOSED:
            words[root if kept == BY_LAYOUT else 0] = words.get(root if kept == BY_LAYOUT else 0, 0.0) + n
    return {root for root, n in words.items() if root and 2 * n > sum(words.values())}


def blocks(html: str | None) -> list[tuple]:
    """Text blocks of one page in order: text, words, words in links, and flags of where it stands.

    One pass over tags and texts with a stack of the open elements. A block
    ends at the border of a block-level element; ``br`` is white space.
    """
    out, piece, linked = [], [], 0
    stack: list[tuple[str, int, bool, int]] = []  # tag, how kept out, below main, number of the layout container
    count: dict[str, int] = {}
    links = heading = containers = 0

    def close(kept: int, main: bool, root: int) -> None:
        nonlocal linked
        text = " ".join("".join(piece).split())
        if text:
            n = text.count(" ") + 1
            out.append((text, float(n), float(min(linked, n)), kept, main, float(heading), root))
        piece.clear()
        linked = 0

    def pop(tag: str) -> None:
        nonlocal links
        while stack:
            name, *_ = stack.pop()
            count[name] -= 1
            links -= name == "a"
            if name == tag:
                return

    html, at = html or "", 0
    while at < len(html):
        m = TOKEN.match(html, at)
        token, at = m[0], m.end()
        kept, main, root = stack[-1][1:] if stack else (OPEN, False, 0)
        if token[0] != "<" or token == "<":
            text = unescape(token)
            piece.append(text)
            if links:
                linked += len(text.split())
            continue
        if not (named := NAME.match(token)) or token[-1] != ">":
            continue
        tag = named[1].lower()
        if tag in BLOCK_TAGS and tag not in UNREAD_TAGS:
            close(kept, main, root)
            heading = int(tag in ("h1", "h2", "h3", "h4", "h5", "h6") and token[1] != "/")
        elif tag == "br":
            piece.append(" ")
        if token[1] == "/":
            if count.get(tag):
                pop(tag)
            continue
        if tag in UNREAD_TAGS:
            if not token.endswith("/>"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag in VOID_TAGS or token.endswith("/>") and tag not in BLOCK_TAGS:
            continue
        for same, inside in (("p", BLOCK_TAGS), ("li", {"li"}), ("td", {"td", "th", "tr"}), ("tr", {"tr"}), ("dd", {"dd", "dt"}), ("option", {"option"})):
            if tag in inside and count.get(same):
                # An open element of this kind ends here, unless a container in between holds the new one.
                for name, *_ in reversed(stack):
                    if name == same:
                        pop(same)
                        break
                    if name in BLOCK_TAGS:
                        break
        kept, main, root = stack[-1][1:] if stack else (OPEN, False, 0)
        own = boilerplate(tag, token[len(tag) + 1 : -1], main or tag == "article")
        if own == BY_LAYOUT:
            # Within a main element a layout name is no wrapper of it, and has no number to be opened by.
            containers += 1
            root = 0 if main else containers
        main = main or tag in ("article", "main")
        stack.append((tag, max(kept, own), main, root))
        count[tag] = count.get(tag, 0) + 1
        links += tag == "a"
    close(*(stack[-1][1:] if stack else (OPEN, False, 0)))
    opened = reopened(out)
    return [(text, n, in_links, float(kept == CLOSED or kept == BY_LAYOUT and root not in opened), float(main), head) for text, n, in_links, kept, main, head, root in out]


def block_frame(pages: DataFrame) -> DataFrame:
    """page_id, url and ``blocks``, an array in page order."""
    return map_rows(pages.select("page_id", "url", "html"), lambda: lambda i, u, h: [(i, u, blocks(h))], f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, blocks {BLOCKS}")


FEATURES = ["words", "density", "before_words", "before_density", "after_words", "after_density", "boiler", "main", "elsewhere", "heading"]

# Parts of the labelled pages. Each is a tag, its words and how many of them are linked.
BODY = [("h1", 8, 0), ("p", 25, 0), ("p", 6, 0), ("p", 60, 4), ("h2", 3, 0), ("li", 10, 0), ("li", 14, 5), ("p", 140, 0), ("blockquote", 18, 0), ("p", 1, 0), ("p", 35, 12), ("p", 90, 2)]
#: Links that belong to an article: sources, a table of contents, a line that is one link.
BODY_LINKS = [("p", 5, 5), ("li", 3, 3), ("li", 4, 4), ("li", 2, 2)]
#: Furniture: what it is called, its own tag or none, and its blocks.
FURNITURE = [
    ("menu", "nav", [("li", 1, 1)] * 5),
    ("breadcrumbs", "nav", [("li", 1, 1), ("li", 2, 2)]),
    ("sidebar", "aside", [("h3", 2, 0), ("li", 6, 6), ("li", 4, 4)]),
    ("related-posts", "aside", [("h3", 2, 0), ("li", 9, 9), ("li", 7, 7), ("li", 12, 12)]),
    ("share-buttons", "", [("li", 1, 1)] * 3),
    ("recommended", "aside", [("li", 5, 5), ("li", 8, 8), ("li", 3, 3)]),
    ("site-footer", "footer", [("p", 6, 1), ("li", 2, 2), ("li", 1, 1)]),
]
#: Furniture without links: only its name or its place tells it from a text.
WORDY = [("cookie-notice", "dialog", [("p", 24, 2), ("p", 1, 1)]), ("ad", "aside", [("p", 9, 0)]), ("comments", "", [("h3", 2, 0), ("p", 45, 0), ("p", 20, 0)]), ("newsletter", "form", [("p", 14, 0), ("p", 2, 0)])]


#: Markups in which class names tell furniture.
NAMED = ("names", "names without article")


def labelled_pages() -> list[tuple[str, list[int]]]:
    """The small labelled table: pages made of the parts above, and for each block of them whether it is main text.

    Five markups: ``article`` with tags that tell furniture, ``article`` with class names, class names without
    ``article``, ``article`` with bare furniture outside it, and bare elements alone. Orders turn, so that every kind of block stands before and after
    every other. Where names and places tell nothing, only furniture of links and texts of six words or more are in the pages.
    """

    def block(tag: str, words: int, linked: int) -> str:
        link = f"<a href='/x'>{' '.join(['word'] * linked)}</a>" if linked else ""
        return f"<{tag}>{' '.join(['word'] * (words - linked))} {link}</{tag}>"

    def place(some, markup):
        html, labels = "", []
        for name, tag, held in some:
            tag, mark = (tag, "") if markup == "tags" and tag else ("div", f" class='{name}'" if markup in ("tags", *NAMED) else "")
            html += f"<{tag}{mark}>" + "".join(block(*b) for b in held) + f"</{tag}>"
            labels += [0] * len(held)
        return html, labels

    def page(before, body, inside, after, markup):
        (start, b), (end, a), (under, i) = (place(x, markup) for x in (before, after, inside))
        around = "div" if markup.endswith("without article") else "article"
        return f"<body>{start}<{around}>{''.join(block(*x) for x in body)}{under}</{around}>{end}</body>", b + [1] * len(body) + i + a

    out = []
    for turn in range(len(BODY)):
        for markup in ("tags", "names", "bare", "names without article"):
            body = [BODY[0]] + BODY[1 + turn :] + BODY[1 : 1 + turn]
            body = body[: 2 + 3 * turn % len(body)]
            if markup != "names without article":  # there a bare list of links may be either
                body = body + BODY_LINKS[turn % 2 :] if turn % 3 else body[:1] + BODY_LINKS[: 1 + turn % 3] + body[1:]
            parts = FURNITURE + WORDY
            parts = parts[turn % len(parts) :] + parts[: turn % len(parts)]
            cut = 1 + turn % (len(parts) - 1)
            comments = [WORDY[2]] if markup != "bare" and turn % 2 else []  # under the text, within the article
            out.append(page(parts[:cut], body, comments, parts[cut:], markup))
        # Every text next to every kind of furniture, in two orders, with nothing else to tell them apart.
        for k, part in enumerate(FURNITURE):
            body = [BODY[turn], BODY[(turn + k) % len(BODY)], BODY[turn]]
            out.append(page([FURNITURE[k - 1]], body if body[0][1] > 5 else body[1:] if body[1][1] > 5 else BODY[1:2], [], [part], "bare without article"))
    return out


def fitted_tree(spark: SparkSession, depth: int = 10) -> DecisionTreeClassificationModel:
    """The Spark model that learned from the blocks of :func:`labelled_pages`, a few hundred rows."""
    pages = spark.createDataFrame([(blocks(html), labels) for html, labels in labelled_pages()], f"blocks {BLOCKS}, labels array<int>").coalesce(1)
    rows = pages.select(F.explode(F.arrays_zip(with_features(F.col("blocks")).alias("x"), F.col("labels").alias("y"))).alias("z")).select("z.x.*", F.col("z.y").cast("double").alias("label"))
    frame = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, seed=7, maxBins=64).fit(frame)


def train_tree(spark: SparkSession, depth: int = 10):
    """A decision tree from the labelled pages, as a function from a struct of features to a boolean column."""
    model = fitted_tree(spark, depth)

    def column(node, x) -> Column:
        if node.subtreeDepth() == 0:
            return F.lit(node.prediction() == 1.0)
        split = node.split()
        return F.when(x[FEATURES[split.featureIndex()]] <= split.threshold(), column(node.leftChild(), x)).otherwise(column(node.rightChild(), x))

    root = model._call_java("rootNode")
    return lambda x: column(root, x)


def with_features(found: Column) -> Column:
    """The blocks' features with those of the neighbours before and after; outside the page they are zero.

    ``elsewhere``: the page has main elements with text, and the block stands outside them.
    """
    words = lambda b: F.coalesce(b["words"], F.lit(0.0))
    density = lambda b: F.coalesce(b["linked"] / b["words"], F.lit(0.0))
    marked = F.exists(found, lambda b: (b["main"] == 1) & (b["boiler"] == 0))

    def one(b, i):
        before, after = F.when(i > 0, F.get(found, i - 1)), F.get(found, i + 1)
        values = [words(b), density(b), words(before), density(before), words(after), density(after), b["boiler"], b["main"], F.when(marked & (b["main"] == 0), 1.0).otherwise(0.0), b["heading"]]
        return F.struct(b["text"].alias("text"), *[v.alias(n) for v, n in zip(values, FEATURES)])

    return F.transform(found, one)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and ``text``: the blocks that the tree keeps, joined by newlines.

    Null or empty html gives an empty text. Repeated pages stay repeated, an
    empty table gives no rows, and other columns are ignored. No page is cut.
    """
    keep = train_tree(pages.sparkSession)
    ready = block_frame(pages).withColumn("blocks", with_features(F.col("blocks")))
    kept = F.transform(F.filter("blocks", keep), lambda b: b["text"])
    return ready.select("page_id", "url", F.array_join(kept, "\n").alias("text"))
