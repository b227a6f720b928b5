"""Main text of web pages by gradient-boosted trees over DOM-node features.

A page becomes a list of nodes (a small scanner, lenient with tags that are never
closed). Each element has features of its subtree (text length, link and markup
density, tag counts), attribute tokens, depth and siblings. The trees are Spark's
GBTClassifier, fitted on a bounded sample of pages (and variants of them, made
as other sites name the same parts) whose nodes are labelled by
what markup says outright (semantic tags, and class or role words) and by text
density where it says nothing. Hierarchical decoding walks from the root: a node
is judged within what its ancestors were judged to be, so no descendant of a
rejected node is kept, and a node that is kept is cut only where a descendant is
clearly not text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formproof.llm.common import WHITE

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "xmp", "iframe"))
#: Elements whose text is no part of a page's words at all.
SILENT = frozenset(("script", "style", "noscript", "template", "iframe", "head", "title", "svg", "math", "object", "select", "button", "textarea"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open element of the named kinds, unless one of the stops lies between.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-label|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
_SPACE = re.compile(f"[{WHITE}]+")

# Words in attributes that mark a part of a page.
OFF = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner\w*|promo\w*|sponsor\w*|cookie\w*|consent|notice|gdpr|popup|modal|newsletter|subscribe|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|aside|footer\w*|masthead|site-header|page-header|top-?bar|alert|disclaimer|comment\w*|disqus|reply|replies|related|share|social|widget\w*|toolbar|pagination|pager|login|signup|search|skip|hidden|copyright|legal|tags?)(?:$|[\s_-])", re.I)
ON = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|body|post|entry|story|text|prose)(?:$|[\s_-])", re.I)
_OFF_TAGS = frozenset(("nav", "aside", "footer", "form", "menu", "dialog"))
_TAGS = ("nav", "aside", "footer", "header", "form", "article", "main", "section", "div", "p", "ul", "li", "a", "table", "blockquote", "pre")
FEATURES = ("depth", "text", "link_share", "text_share", "tags_per_text", "children", "siblings", "place", "same_siblings", "sentences", "paragraphs",
            "off_words", "on_words", "in_article", "off_tag", "heading", *(f"is_{t}" for t in _TAGS))


class Page:
    """Elements in document order: tag, parent, attributes; texts: (element, text)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attrs, self.after = ["html"], [-1], [""], []
        self.texts: list[tuple[int, str]] = []
        self.breaks: list[int] = []
        stack, at = [0], 0
        for m in iter(lambda: _TAG.search(source, at), None):
            self._text(stack[-1], source[at:m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if tag in ("html", "body"):
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        del stack[k:]
                        break
                    if self.tag[stack[k]] not in INLINE and tag in INLINE:
                        break
                self.breaks.append(len(self.texts)) if tag not in INLINE else None
                continue
            if tag == "html":
                continue
            self._close(stack, tag)
            if tag not in INLINE:
                self.breaks.append(len(self.texts))
            if tag in VOID or m[3].endswith("/"):
                continue
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.attrs.append(m[3])
            if tag in RAW:
                closing = _RAW_END[tag].search(source, at)
                end = closing.start() if closing else len(source)
                self._text(len(self.tag) - 1, source[at:end])
                at = end
                stack.append(len(self.tag) - 1)
            else:
                stack.append(len(self.tag) - 1)
        self._text(stack[-1], source[at:])

    def _close(self, stack: list[int], tag: str) -> None:
        kinds, stops = _CLOSES.get(tag, ((), ()))
        if tag in _ENDS_P:
            kinds, stops = ("p",), ("table", "td", "th", "button", "object")
        for k in range(len(stack) - 1, 0, -1):
            here = self.tag[stack[k]]
            if here in stops:
                return
            if here in kinds:
                del stack[k:]
                if tag not in ("tr", "td", "th"):
                    return

    def _text(self, node: int, raw: str) -> None:
        if raw:
            self.texts.append((node, raw if self.tag[node] in ("script", "style") else entities.unescape(raw)))

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own, links, marks, sentences = (np.zeros(n) for _ in range(4))
        depth, children, place, article = (np.zeros(n) for _ in range(4))
        off_words, on_words, paragraphs = np.zeros(n), np.zeros(n), np.zeros(n)
        inside = [0] * n
        for i in range(1, n):
            p = self.parent[i]
            depth[i] = depth[p] + 1
            place[i] = children[p]
            children[p] += 1
            inside[i] = inside[p] or self.tag[i] == "a"
            article[i] = article[p] or self.tag[i] in ("article", "main")
            if self.attrs[i]:
                said = " ".join((v or k).strip("\"'") for k, v in _ATTR.findall(self.attrs[i]))
                off_words[i], on_words[i] = bool(OFF.search(said)), bool(ON.search(said))
                article[i] = article[i] or on_words[i] and not off_words[i]
        for node, text in self.texts:
            if self.tag[node] not in SILENT:
                size = len(text) - text.count(" ")
                own[node] += size
                links[node] += size if inside[node] else 0
                sentences[node] += text.count(". ") + text.count(".\n") + text.rstrip().endswith((".", "!", "?"))
        total, linked, tags, ends = own.copy(), links.copy(), np.ones(n), sentences.copy()
        paragraphs += np.array([t == "p" for t in self.tag])
        same: dict[tuple[int, str], int] = {}
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            for column in (total, linked, tags, ends, paragraphs):
                column[p] += column[i]
            same[p, self.tag[i]] = same.get((p, self.tag[i]), 0) + 1
        parents = np.maximum(0, np.array(self.parent))
        columns = [
            depth, np.log1p(total), linked / np.maximum(1, total), total / max(1.0, total[0]), tags / np.maximum(1, total), children,
            children[parents], place, np.array([same.get((p, t), 1) for p, t in zip(self.parent, self.tag, strict=True)], dtype=float),
            np.log1p(ends), np.log1p(paragraphs), off_words, on_words, article, np.array([t in _OFF_TAGS for t in self.tag], dtype=float),
            np.array([len(t) == 2 and t[0] == "h" and t[1].isdigit() for t in self.tag], dtype=float),
            *(np.array([t == k for t in self.tag], dtype=float) for k in _TAGS)]
        return np.stack(columns, axis=1)

    def weak_labels(self, x: np.ndarray) -> np.ndarray:
        """1 text, 0 not, -1 nothing to learn from, by what the markup says of a node or of an ancestor."""
        label = np.full(len(self.tag), -1)
        off, on = FEATURES.index("off_words"), FEATURES.index("on_words")
        link, sentences = FEATURES.index("link_share"), FEATURES.index("sentences")
        for i in range(1, len(self.tag)):
            up = label[self.parent[i]]
            tag = self.tag[i]
            if up == 0 or tag in _OFF_TAGS or x[i, off] or tag == "header" and not x[i, FEATURES.index("in_article")]:
                label[i] = 0
            elif up == 1 or tag in ("article", "main") or x[i, on]:
                label[i] = 1
            elif tag in ("p", "div", "blockquote", "section"):
                label[i] = int(x[i, link] < 0.4 and x[i, sentences] > 1)
            elif tag in ("ul", "table") and x[i, link] > 0.6:
                label[i] = 0
        return label

    def decode(self, margin: np.ndarray) -> str:
        """Text of the nodes kept from the root down.

        A node takes its margin and a quarter of what its parent took; from the first node that is rejected nothing below is kept.
        """
        n = len(self.tag)
        mind, out = np.zeros(n), np.zeros(n, dtype=bool)
        for i in range(1, n):
            p = self.parent[i]
            inline = self.tag[i] in INLINE or self.tag[i] in ("br",)
            mind[i] = mind[p] if inline else margin[i] + 0.25 * mind[p]
            out[i] = out[p] or self.tag[i] in SILENT or (not inline and self.tag[i] not in ("html", "body") and mind[i] < 0)
        pieces, begin, cut = [], 0, [*self.breaks, len(self.texts)]
        for end in cut:
            if end > begin:
                block = _SPACE.sub(" ", "".join(t for node, t in self.texts[begin:end] if not out[node])).strip(" ")
                if block:
                    pieces.append(block)
                begin = end
        return " ".join(pieces)


class Trees:
    """A fitted ensemble as flat arrays; margin() is its raw score."""

    def __init__(self, model):
        self.trees = [(self._flat(t._call_java("rootNode")), w) for t, w in zip(model.trees, model.treeWeights, strict=True)]

    @staticmethod
    def _flat(root) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, value = [], [], [], [], []

        def add(node) -> int:
            at = len(feature)
            inner = node.getClass().getSimpleName() == "InternalNode"
            feature.append(node.split().featureIndex() if inner else -1)
            cut.append(float(node.split().threshold()) if inner else 0.0)
            value.append(float(node.prediction()))
            left.append(0)
            right.append(0)
            if inner:
                left[at], right[at] = add(node.leftChild()), add(node.rightChild())
            return at

        add(root)
        return tuple(np.array(x) for x in (feature, cut, left, right, value))

    def margin(self, x: np.ndarray) -> np.ndarray:
        score = np.zeros(len(x))
        rows = np.arange(len(x))
        for (feature, cut, left, right, value), weight in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                at = np.where(inner, np.where(x[rows, f] <= cut[at], left[at], right[at]), at)
            score += weight * value[at]
        return score


#: Ways in which other pages name the same parts: (element, opening tag in its place).
_RENAMED = (
    (("article", '<div class="post-content">'), ("nav", '<div class="menu">'), ("footer", '<div id="footer">')),
    (("article", '<main><div class="entry">'), ("nav", '<div id="main-nav">'), ("footer", '<div class="site-footer">')),
    (("article", "<div>"), ("nav", '<ul class="breadcrumbs">'), ("footer", '<section class="copyright">')))
_PARTS = ("<header><div>{}</div></header>", '<aside><p>{}</p></aside>', '<div class="sidebar"><p>{}</p><p>{}</p></div>',
          '<section id="comments"><div class="comment"><p>{}</p></div><p>{}</p></section>', "<form><p>{}</p></form>",
          '<div class="cookie-notice"><p>{}</p></div>', '<div class="banner"><p>{}</p></div>', '<div class="related-posts"><p>{}</p></div>')


def variants(source: str) -> Iterator[str]:
    """The page, and pages of other make with the same words: parts renamed, and further parts put about and into the article."""
    yield source
    words = [w for w in re.sub("<[^>]*>", "\n", source).split("\n") if len(w) > 40][:12] or ["Read more. See all of it."]
    for turn, renamed in enumerate(_RENAMED):
        made = source
        for tag, opening in renamed:
            name = re.match(r"<(\w+)", opening)[1]
            made = re.sub(rf"<{tag}\b[^>]*>", opening, made).replace(f"</{tag}>", f"</{name}>")
        parts = [p.replace("{}", words[(turn + 3 * k) % len(words)][:300]) for k, p in enumerate(_PARTS)]
        name = re.match(r"<(\w+)", renamed[0][1])[1]
        head, opening, body = made.partition(renamed[0][1])
        inner, closing, tail = body.rpartition(f"</{name}>")
        yield head + "".join(parts[:3]) + opening + inner + parts[3] + closing + "".join(parts[4:]) + tail
        yield source.replace("<h1>", "<header><h1>").replace("</h1>", "</h1></header>").replace("</article>", "".join(parts[2:]) + "</article>")


def labelled_nodes(pages: DataFrame) -> DataFrame:
    """(label, features) of nodes with a weak label, in pages and their variants; none below a node that is out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                for made in variants(source or ""):
                    page = Page(made)
                    x = page.features()
                    y = page.weak_labels(x)
                    up = np.array([y[p] if p >= 0 else -1 for p in page.parent])
                    decided = (y >= 0) & (up != 0)
                    x, y = x[decided], y[decided]
                    yield pa.RecordBatch.from_arrays([pa.array(y.astype(float)), *(pa.array(c) for c in x.T)], names=["label", *FEATURES])

    return pages.select("html").mapInArrow(run, ", ".join(f"`{c}` double" for c in ("label", *FEATURES)))


def fit_trees(pages: DataFrame, sample_pages: int = 200, trees: int = 12, depth: int = 5) -> Trees | None:
    """Boosted trees fitted on the sample_pages pages with the smallest hash; None without both labels."""
    some = pages.select("html").orderBy(F.xxhash64("html")).limit(sample_pages)
    nodes = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled_nodes(some)).select("label", "features").cache()
    try:
        if nodes.select("label").distinct().count() < 2:
            return None
        return Trees(GBTClassifier(maxIter=trees, maxDepth=depth, seed=5).fit(nodes))
    finally:
        nodes.unpersist()


def main_text(pages: DataFrame, **settings) -> DataFrame:
    """pages with text (the article's words, empty if none) and n_chars (its code points).

    Blocks join in page order by one space, white space in a block becomes one
    space; character references are decoded. A null or empty page has no text.
    Row by row: repeated rows and other columns pass through, text and n_chars
    are replaced. Without labelled nodes of both kinds (as in an empty table),
    the weak labels decide instead of trees.
    """
    model = pages.sparkSession.sparkContext.broadcast(fit_trees(pages, **settings))
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    at = kept.index("html")
    schema = T.StructType([*pages.select(*kept).schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                read = [Page(s or "") for s in batch.column(at).to_pylist()]
                tables = [p.features() for p in read]
                stacked = np.concatenate(tables)
                if model.value is not None:
                    margins = model.value.margin(stacked)
                else:
                    margins = np.concatenate([np.where(p.weak_labels(x) == 1, 1.0, -1.0) for p, x in zip(read, tables, strict=True)])
                ends = np.cumsum([0, *map(len, tables)])
                texts = [p.decode(margins[a:b]) for p, a, b in zip(read, ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, "text"])

    return pages.select(*kept).mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
