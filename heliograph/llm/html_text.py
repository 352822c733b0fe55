"""Main text of web pages.

A page is cut into flat text blocks at block-level tags. Every block has its
word count and link density, those of its neighbours, and two marks: whether it lies in an
article element, and in an element named as boilerplate, plainly (by its tag or a name
like ``ad`` or ``comments``) or loosely (``related``, ``search``, ``widget``: names that an
article's own parts bear as well). A decision tree, trained on the blocks of the
small labelled pages below, tells text from boilerplate. Words and links alone cannot
tell a paragraph from a long advert or a reader's comment, so plain marks go before
them; elsewhere, so in loosely named parts and on pages without marks, words and
links of a block and its neighbours decide. The kept blocks, white space made single, are joined by one space.

Scripts, styles, forms' controls, comments and the head never give blocks. Pages
of any length and of any markup are read whole, in time that grows with their
length. A tag runs to its closing ``>``, which may stand in quoted values; from
the first tag on that never closes in this way, every tag ends at the next
``>``. What follows the last ``>`` of a page is text.

Null and empty pages have no text. Rows may repeat; other columns than
``page_id``, ``url`` and ``html`` are not read. An empty table gives an empty
result.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What opens markup, and what ends a tag or opens a quoted value in it.
OPENS = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|!--|[!?])")
ENDS = re.compile(r"""=\s*+(["'])|>""")
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
#: Elements whose content is no text of the page.
RAW = frozenset("script style textarea title".split())
OPAQUE = frozenset("script style noscript template svg math title textarea select option button iframe object canvas audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are kept on the stack of open elements; others may lack an end tag.
NESTED = frozenset("html head body article main section nav header footer aside form div ul ol dl table figure blockquote fieldset dialog menu details".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog head fieldset".split())
ARTICLE_TAGS = frozenset("article main".split())
HINT = re.compile(r"""(?<![\w-])(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
BOILERPLATE_WORD = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|menu|nav\w*|footer|masthead|breadcrumbs?|comments?|replies|disqus|cookies?|consent|notice|popup|modal|newsletter|subscribe|copyright|contentinfo|complementary)(?:$|[^a-z])", re.I)
LOOSE_WORD = re.compile(r"(?:^|[^a-z])(?:share|sharing|social|related|recommended|widget|search|login|signup|toolbar|pagination|pager)(?:$|[^a-z])", re.I)
ARTICLE_WORD = re.compile(r"(?:^|[^a-z])(?:articlebody|article|post-?content|entry-?content|post-?body|story(?:-?body)?|main-?content)(?:$|[^a-z])", re.I)
#: ``inside``: 1 in an article element, 0 on a page without one, -1 outside the page's article. ``named``: 2 in plain, 1 in loosely named boilerplate, else 0.
FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "inside", "named"]
PLAIN, LOOSE = 2, 1

#: Labelled pages of several shapes. ``[+60/5]`` is a block of main text with 60 words, 5 of them in links; ``[-3/3]`` is boilerplate.
LABELLED = [
    # an article element, marked boilerplate
    "<nav><ul><li>[-1/1]<li>[-1/1]<li>[-2/2]<li>[-1/1]</ul></nav><div class=ad>[-12]</div><article><h1>[+8]</h1><p>[+60]<p>[+45/2]<p>[+2]<p>[+30]<p>[+9]<p>[+1]</article><footer>[-14]</footer>",
    "<header>[-3]<p>[-6/4]</header><article><header><h1>[+6]</h1><p>[+4]</header><p>[+90/9]<ul><li>[+4/4]<li>[+6]<li>[+3/3]<li>[+8]<li>[+2/2]<li>[+3]<li>[+1/1]<li>[+5]<li>[+2]</ul><p>[+20/20]<p>[+15/9]<h2>[+3]</h2><p>[+120/20]<aside>[-25]<p>[-5/5]</aside><p>[+40]<div class=comments>[-60]<p>[-8]<p>[-30/3]</div><footer>[-3/3]</footer></article><aside>[-20/8]<p>[-60]</aside><form>[-12]</form><footer>[-9/5]</footer>",
    "<div id=cookie-notice>[-22]</div><main><h1>[+5]</h1><p>[+35]<p>[+5]<p>[+6]<p>[+12]<div class=share-buttons>[-1/1]<p>[-1/1]</div><p>[+50/3]<form>[-8]</form><p>[+25]</main><p>[-9]<p>[-40]<p>[-70/7]<p>[-2]<p>[-3/3]",
    "<div class=menu>[-2/2]<p>[-2/2]</div><div class=post-content><p>[+1]</div>",
    "<nav>[-6/6]</nav><article><p>[+30]<p>[+4/4]<p>[+9]</article>",
    "<article><p>[+5/5]<p>[+2]</article>",
    "<article><p>[+30]<p>[+3/3]<p>[+6]</article>",
    "<p>[-5]<article><p>[+1/1]<p>[+1]<p>[+2/2]<p>[+7/1]<p>[+30/30]</article><p>[-30]<p>[-5/3]<p>[-4/4]",
    # marked boilerplate around text without an article element
    "<nav>[-1/1]<p>[-1/1]<p>[-9]</nav><h1>[+7]</h1><p>[+40]<p>[+55/3]<p>[+3]<p>[+30/3]<p>[+18]<p>[+22/4]<div class=sidebar>[-30]<p>[-60/6]<p>[-4/4]</div><footer>[-20]</footer>",
    "<div class=banner>[-15]</div><p>[+25]<p>[+6]<p>[+28]<div id=comments>[-45]<p>[-3]<p>[-80]</div>",
    # loosely named parts, which may be the article's own
    "<article><p>[+40]<section id=related-work><h2>[+2]</h2><p>[+60]<p>[+45/4]</section><div class=widget>[+50]</div><p>[+30]</article>",
    "<article><p>[+60]<div class=related>[-5/5]<p>[-6/6]<p>[-4/4]</div><p>[+35]<div class=share>[-1/1]<p>[-2]<p>[-1/1]</div></article>",
    "<article><p>[+25]<div class=search>[-3]</div><div class=widget><h3>[-2]</h3><p>[-9/9]<p>[-8/8]</div><p>[+48]</article><div class=widget>[-40]<p>[-5/5]</div>",
    "<article><h1>[+7]</h1><p>[+33]<div class=search-engines>[+38]<p>[+25/2]</div><p>[+51]<div class=social>[-4/3]<p>[-12/11]</div></article>",
    "<nav>[-2/2]</nav><h1>[+5]</h1><p>[+44]<div class=recommended>[-8/8]<p>[-12/12]</div><div class=search-results>[+70]<p>[+38/3]</div><p>[+29]",
    # no marks at all
    "<p>[-1/1]<p>[-1/1]<p>[-2/2]<p>[-1/1]<h1>[+7]</h1><p>[+40]<p>[+55/3]<p>[+4]<p>[+48]<p>[+30/3]<p>[-3/3]<p>[-4/4]<p>[-3/3]<p>[-6]",
    "<p>[-2]<p>[-1/1]<p>[-1/1]<p>[-2]<p>[-1/1]<h1>[+8]</h1><p>[+50]<p>[+45]<p>[+26]<p>[-3]<p>[-4/4]<p>[-2]<p>[-2/2]",
    "<p>[-3/3]<p>[-2/2]<p>[-2/2]<h1>[+5]</h1><p>[+90/8]<p>[+18]<p>[+60]<p>[+16]<p>[-8/7]<p>[-9/8]<p>[-7/7]<p>[-5/3]",
    "<p>[-4/2]<p>[-5/5]<p>[+30]<p>[+12]<p>[+12]<p>[+25/2]<p>[-1/1]<p>[-5]<p>[-2/2]",
    "<p>[+25]",
    "<p>[+3]<p>[+4]<p>[+3]",
    "<p>[+12]<p>[+12]<p>[+12]<p>[+9]",
    "<p>[-5/4]<p>[-15/11]<p>[-30/24]<p>[-12/11]<p>[-9/9]<p>[-1/1]<p>[-2]<p>[-1/1]<p>[-3]<p>[-2/2]",
    "<h1>[+6]</h1><p>[+28]<p>[+5]<p>[+35/2]<h2>[+2]</h2><p>[+80]<ul><li>[+9]<li>[+8]<li>[+11]</ul><p>[+33]<p>[-1/1]<p>[-1/1]<p>[-4]<p>[-1/1]",
    "<p>[-2/2]<p>[-4]<p>[-2/2]<p>[-3]<p>[-3/3]<h1>[+9]</h1><p>[+20]<p>[+21/3]<p>[+70/15]<p>[-6/5]<p>[-3]<p>[-5/5]",
]
SLOT = re.compile(r"\[([+-])(\d+)(?:/(\d+))?\]")

Tree = tuple  # (feature, threshold, tree if at most, tree if above), or (prediction,)


def features(found: list[tuple[str, int, int, bool, int]]) -> list[tuple[float, ...]]:
    """``FEATURES`` of every block of a page."""
    outside = -1.0 if any(b[3] for b in found) else 0.0
    sizes = [(0.0, 0.0), *((float(n), linked / n) for _, n, linked, _, _ in found), (0.0, 0.0)]
    return [(*sizes[i + 1], *sizes[i], *sizes[i + 2], 1.0 if b[3] else outside, float(b[4])) for i, b in enumerate(found)]


def labelled_blocks(pages: Sequence[str] = LABELLED) -> list[tuple[float, ...]]:
    """Features and label (1 for text) of all blocks of the labelled pages."""
    out = []
    for page in pages:
        words = lambda m: "w " * (int(m[2]) - int(m[3] or 0)) + f"<a>{'w ' * int(m[3] or 0)}</a>"
        labels = [float(m[1] == "+") for m in SLOT.finditer(page)]
        out += [(*f, y) for f, y in zip(features(blocks(SLOT.sub(words, page))), labels, strict=True)]
    return out


def trained_tree(spark: SparkSession) -> Tree:
    """The decision tree for the labelled blocks as nested tuples."""
    rows = spark.createDataFrame(labelled_blocks(), [*FEATURES, "label"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=10, minInstancesPerNode=1, maxBins=64, seed=1).fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))

    def walk(node) -> Tree:  # noqa: ANN001
        if node.subtreeDepth() == 0:
            return (node.prediction(),)
        return node.split().featureIndex(), node.split().threshold(), walk(node.leftChild()), walk(node.rightChild())

    return walk(model._call_java("rootNode"))


def is_text(tree: Tree, features: tuple[float, ...]) -> bool:
    """The tree's decision."""
    while len(tree) > 1:
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree[0] == 1.0


def hinted(hints: Sequence[str]) -> int:
    """What names of an element say: plainly or loosely boilerplate, or nothing."""
    return PLAIN if any(BOILERPLATE_WORD.search(h) for h in hints) else LOOSE if any(LOOSE_WORD.search(h) for h in hints) else 0


def blocks(page: str) -> list[tuple[str, int, int, bool, int]]:
    """Text blocks in page order: text, words, words in links, in an article, and how boilerplate around it is named."""
    found: list[tuple[str, int, int, bool, int]] = []
    stack: list[tuple[str, int, int]] = []
    open_tags: Counter[str] = Counter()  # of the stack
    article, named = 0, [0, 0, 0]  # open elements by what their names say
    own_mark, own_named = "", 0  # tag of an unnested block whose class marks it as boilerplate
    link = False
    text: list[tuple[str, bool]] = []

    last = page.rfind(">")
    quoted = True  # tags end at a > outside quotes
    unclosed: set[str] = set()  # opaque tags that are not closed any more

    def tag_end(at: int) -> int:
        nonlocal quoted
        while quoted:
            m = ENDS.search(page, at)
            if m is not None and not m[1]:
                return m.end()
            at = 0 if m is None else page.find(m[1], m.end()) + 1
            quoted = at > 0
        return 0

    def close() -> None:
        joined = " ".join("".join(t for t, _ in text).split())
        if joined:
            linked = len("".join(t if k else " " for t, k in text).split())
            n = joined.count(" ") + 1
            found.append((joined, n, min(linked, n), article > 0, PLAIN if named[PLAIN] or own_named == PLAIN else LOOSE if named[LOOSE] or own_named else 0))
        text.clear()

    at, size = 0, len(page)
    while at < size:
        m = OPENS.search(page, at, last + 1)
        if m is None:
            text.append((references.unescape(page[at:]), link))
            break
        if m.start() > at:
            text.append((references.unescape(page[at : m.start()]), link))
        end, tag = m[1], m[2]
        if not tag:
            if page.startswith("<!--", m.start()):
                at = next((m.end() + len(x) for x in (">", "->") if page.startswith(x, m.end())), page.find("-->", m.end()) + 3)
                at = at if at > 2 else size
            else:
                at = page.find(">", m.end()) + 1
            continue
        at = tag_end(m.end()) or page.find(">", m.end()) + 1
        attributes = page[m.end() : at - 1]
        tag = tag.lower()
        if tag in OPAQUE:
            if not end and tag not in unclosed and (tag in RAW or not SELF_CLOSED.search(attributes)):
                closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                if closing:
                    at = closing.end()
                elif tag in RAW:
                    at = size
                else:
                    unclosed.add(tag)
            if tag not in INLINE:
                close()
            continue
        if tag == "a":
            link = not end
        if tag in INLINE:
            continue
        close()
        if tag == "br" or tag in VOID:
            continue
        if not end or tag == own_mark:
            own_mark, own_named = "", 0
        if tag not in NESTED:
            if not end and attributes and (says := hinted(HINT.findall(attributes))):
                own_mark, own_named = tag, says
            continue
        link = False
        if not end:
            hints = HINT.findall(attributes) if attributes else ()
            is_article = int(tag in ARTICLE_TAGS or tag not in ("html", "body") and any(ARTICLE_WORD.search(h) for h in hints))
            says = PLAIN if tag in BOILERPLATE_TAGS or tag == "header" and not article else hinted(hints) if tag not in ("html", "body", *ARTICLE_TAGS) and not is_article else 0
            stack.append((tag, is_article, says))
            open_tags[tag] += 1
            article += is_article
            named[says] += 1
        elif open_tags[tag]:
            while True:
                name, is_article, says = stack.pop()
                open_tags[name] -= 1
                article -= is_article
                named[says] -= 1
                if name == tag:
                    break
    close()
    return found


def main_text(page: str | None, tree: Tree) -> str:
    """The kept blocks of a page, joined by a space."""
    if not page:
        return ""
    found = blocks(page)
    return " ".join(b[0] for b, f in zip(found, features(found), strict=True) if is_text(tree, f))


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page. Map only."""
    shared = pages.sparkSession.sparkContext.broadcast(trained_tree(pages.sparkSession))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                texts = [main_text(x, shared.value) for x in rows.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(kernel, "page_id bigint, url string, text string, n_chars bigint")
