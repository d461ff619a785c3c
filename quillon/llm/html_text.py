"""Main text of web pages: a linear-chain CRF over the DOM's leaf blocks.

A page becomes the sequence of its leaf blocks (runs of text without a block
tag between).  Each block has features from its ancestors' tags, classes and
ids and from its text; a conditional random field with two labels (main text
or not) is trained on labelled pages and decoded by Viterbi.

The labelled pages are made here by a rule (``labelled_pages``): layouts with
menus, notices, adverts, forms, sidebars, reader comments, articles and
footers, whose label is known because each part is placed on purpose.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_table

# HTML tags by what they do to the flow of text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt"
    " fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li"
    " main menu nav ol optgroup option p pre search section select summary table tbody td tfoot"
    " th thead tr ul".split()
)
HIDDEN_TAGS = frozenset(
    "script style template noscript head title textarea svg math iframe object".split()
)
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: tag -> open tags that it ends, up to the first of the listed scopes
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCK_TAGS - {"html", "body", "button", "caption", "td", "th", "tr", "option", "legend"}


#: What may stand in a head; any other tag, and text, ends it.
HEAD_TAGS = frozenset("base basefont bgsound link meta title style script noscript template".split())


class Node:
    """An open element; the elements around it are shared by all that it holds."""

    __slots__ = ("tag", "names", "outer", "features")

    def __init__(self, tag: str, names: tuple[str, ...], outer: "Node | None"):
        self.tag, self.names, self.outer = tag, names, outer
        self.features: frozenset[str] | None = None

    def inherited(self, known=None) -> frozenset[str]:
        """Features of the elements from here out, those in ``known`` alone if it
        is given; a set is made anew only where an element adds to it."""
        chain = []
        node = self
        while node is not None and node.features is None:
            chain.append(node)
            node = node.outer
        found = node.features if node is not None else frozenset()
        for node in reversed(chain):
            own = {f"name:{x}" for x in node.names}
            if node.tag in BLOCK_TAGS:
                own.add(f"in:{node.tag}")
            if known is not None:
                own = {f for f in own if f in known}
            found = found if own <= found else found | own
            node.features = found
        return found


class LeafBlocks(HTMLParser):
    """Leaf blocks of a page: text, innermost element, characters inside links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[Node] = []
        self.hidden = 0
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[str, Node | None, int]] = []

    def flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((text, self.stack[-1] if self.stack else None, self.linked))
        self.parts, self.linked = [], 0

    def _pop(self):
        tag = self.stack.pop().tag
        if tag in HIDDEN_TAGS:
            self.hidden -= 1
        elif tag == "a":
            self.links -= 1

    def _close(self, names, scopes):
        for at in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[at].tag
            if tag in names:
                while len(self.stack) > at:
                    self._pop()
                return
            if tag in scopes:
                return

    def _end_head(self):
        """The end tag of a head may be left out."""
        if self.hidden and self.stack[-1].tag == "head":
            self._pop()

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD_TAGS:
            self._end_head()
        if tag in BLOCK_TAGS:
            self.flush()
            if tag in ENDS_P:
                self._close({"p"}, {"article", "div", "section", "td", "li", "body", "button"})
            if tag in IMPLIED_ENDS:
                self._close(*IMPLIED_ENDS[tag])
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID_TAGS:
            return
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        names = tuple(re.findall(r"[a-z]+", names.lower())) if names else ()
        self.stack.append(Node(tag, names, self.stack[-1] if self.stack else None))
        if tag in HIDDEN_TAGS:
            self.hidden += 1
        elif tag == "a":
            self.links += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS or tag in HIDDEN_TAGS:
            self.flush()
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag == tag:
                while len(self.stack) > at:
                    self._pop()
                return
            if tag not in BLOCK_TAGS and self.stack[at].tag in BLOCK_TAGS:
                return  # an inline end tag does not end a block

    def handle_data(self, data):
        if self.hidden and data.strip():
            self._end_head()
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def leaf_blocks(html: str) -> list[tuple[str, Node | None, int]]:
    """The blocks of a page in order, in memory that grows with its text and its
    tags; optional end tags may be left out, and broken markup is read on."""
    parser = LeafBlocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def block_features(blocks: list[tuple[str, Node | None, int]], known=None) -> list[list[str]]:
    """Names of the features that hold for each block, those in ``known`` alone if
    it is given."""
    out = []
    for text, node, linked in blocks:
        n = len(text)
        words = text.count(" ") + 1
        found = {"bias", f"own:{node.tag if node else 'none'}"}
        share = linked / n
        found.add("links:all" if share > 0.8 else "links:some" if share > 0.3 else "links:few")
        found.add("long" if words >= 25 else "middle" if words >= 8 else "short")
        if text[-1] in ".!?…:\"”»":
            found.add("ends")
        if "©" in text or "|" in text:
            found.add("mark")
        if known is not None:
            found = {f for f in found if f in known}
        out.append(sorted(found | node.inherited(known) if node else found))
    return out


class ChainCRF:
    """Two labels, indicator features, first-order transitions."""

    def __init__(self, feature_weights: dict[str, np.ndarray], transition: np.ndarray):
        self.weights = feature_weights
        self.transition = transition

    def emissions(self, features: list[list[str]]) -> np.ndarray:
        none = np.zeros(2)
        return np.array([sum((self.weights.get(f, none) for f in fs), none) for fs in features])

    def decode(self, features: list[list[str]]) -> list[int]:
        """Viterbi: the best label sequence."""
        e = self.emissions(features).tolist()
        if not e:
            return []
        (t00, t01), (t10, t11) = self.transition.tolist()
        a, b = e[0]
        back = []
        for x, y in e[1:]:
            from0, from1 = (a + t00 >= b + t10), (a + t01 >= b + t11)
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + t00 if from0 else b + t10) + x, (a + t01 if from1 else b + t11) + y
        label = 0 if a >= b else 1
        labels = [label]
        for choice in reversed(back):
            label = choice[label]
            labels.append(label)
        return labels[::-1]


def train_crf(
    pages: list[tuple[list[list[str]], list[int]]], rounds: int = 60, rate: float = 0.3
) -> ChainCRF:
    """Maximum likelihood with an L2 penalty, by Adam on all pages at once.

    Pages are padded to one length, so forward and backward sums are numpy
    operations over all pages."""
    names = sorted({f for fs, _ in pages for x in fs for f in x})
    index = {f: i for i, f in enumerate(names)}
    longest = max(len(y) for _, y in pages)
    n = len(pages)
    gold = np.zeros((n, longest), int)
    mask = np.zeros((n, longest))
    cells, columns = [], []
    for p, (features, labels) in enumerate(pages):
        gold[p, : len(labels)] = labels
        mask[p, : len(labels)] = 1
        for t, fs in enumerate(features):
            cells += [p * longest + t] * len(fs)
            columns += [index[f] for f in fs]
    cells, columns = np.array(cells), np.array(columns)
    w, t = np.zeros((len(names), 2)), np.zeros((2, 2))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, t)]

    def add(a, axis):
        top = a.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))

    one_hot = np.eye(2)[gold] * mask[..., None]
    pairs = mask[:, 1:]
    seen = np.einsum("pta,ptb->ab", one_hot[:, :-1] * pairs[..., None], one_hot[:, 1:])
    for step in range(1, rounds + 1):
        e = np.stack(
            [np.bincount(cells, w[columns, k], n * longest) for k in (0, 1)], axis=1
        ).reshape(n, longest, 2)
        ahead = np.zeros((n, longest, 2))
        ahead[:, 0] = e[:, 0]
        for s in range(1, longest):
            new = add(ahead[:, s - 1, :, None] + t, 1) + e[:, s]
            ahead[:, s] = np.where(mask[:, s, None] > 0, new, ahead[:, s - 1])
        behind = np.zeros((n, longest, 2))
        for s in range(longest - 2, -1, -1):
            new = add(t + (e[:, s + 1] + behind[:, s + 1])[:, None, :], 2)
            behind[:, s] = np.where(mask[:, s + 1, None] > 0, new, 0)
        z = add(ahead[:, -1], 1)
        unary = np.exp(ahead + behind - z[:, None, None]) * mask[..., None]
        joint = np.exp(
            ahead[:, :-1, :, None]
            + t
            + (e[:, 1:] + behind[:, 1:])[:, :, None, :]
            - z[:, None, None, None]
        )
        expected = (joint * pairs[..., None, None]).sum(axis=(0, 1))
        gap = (unary - one_hot).reshape(-1, 2)
        g_w = np.stack([np.bincount(columns, gap[cells, k], len(names)) for k in (0, 1)], axis=1)
        for x, g, (m1, m2) in ((w, g_w / n + 1e-3 * w, state[0]), (t, (expected - seen) / n, state[1])):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            x -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return ChainCRF({f: w[i] for f, i in index.items()}, t)


# Names that page parts other than the article go by.
PART_NAMES = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs toc pagination pager tabs",
    "head": "header masthead topbar banner logo site branding",
    "foot": "footer bottom copyright colophon legal disclaimer",
    "side": "sidebar aside widget related recommended popular trending rail archive tags share"
    " social sharing",
    "notice": "cookie consent notice gdpr alert popup modal newsletter subscribe signup paywall"
    " overlay",
    "advert": "ad ads advert advertisement adsense sponsored promo promotion sponsor advertising",
    "form": "form search login register contact searchbox",
    "talk": "comments comment reply replies respond discussion disqus responses reader",
    "main": "content article post entry story main body text page prose maincontent",
    "meta": "byline author date meta timestamp posted",
}


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Pages made by a rule, with the label of each leaf block in page order."""
    rnd = random.Random(seed)
    names = {k: v.split() for k, v in PART_NAMES.items()}
    syllables = "an en th re on at ed ti es in ing er la le que de ci ón ver ich ung ou ai".split()

    def words(low, high):
        return ["".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(rnd.randint(low, high))]

    def sentence(low=5, high=60):
        return " ".join(words(low, high)).capitalize() + rnd.choice("....!?")

    def tagged(tag, part, inner, attribute=True):
        mark = f' {rnd.choice(["class", "id"])}="{rnd.choice(names[part])}"' if attribute else ""
        return f"<{tag}{mark}>{inner}</{tag}>"

    pages = []
    for _ in range(n):
        html, labels = [], []

        def menu(part="menu", tag=None):
            k = rnd.randint(2, 7)
            labels.extend([0] * k)
            items = "".join(f'<li><a href="/x">{" ".join(words(1, 2))}</a></li>' for _ in range(k))
            tag = tag or rnd.choice(["nav", "nav", "div", "header"])
            return tagged(tag, part, f"<ul>{items}</ul>", tag == "div" or rnd.random() < 0.3)

        def small(part, tag, low=2, high=25):
            k = rnd.randint(1, 3)
            labels.extend([0] * k)
            inner = "".join(f"<p>{sentence(low, high)}</p>" for _ in range(k))
            plain = tag in ("footer", "aside", "header", "form") and rnd.random() < 0.5
            return tagged(tag, part, inner, not plain)

        def article():
            parts = []
            if rnd.random() < 0.8:
                parts.append(f"<h1>{' '.join(words(2, 9))}</h1>")
                labels.append(1)
            if rnd.random() < 0.2:
                parts.append(tagged("div", "advert", sentence(3, 15)))
                labels.append(0)
            for _ in range(rnd.randint(1, 8)):
                kind = rnd.random()
                if kind < 0.75:
                    link = f' <a href="/y">{" ".join(words(1, 3))}</a> ' if rnd.random() < 0.3 else " "
                    parts.append(f"<p>{sentence()}{link}{sentence(2, 40)}</p>")
                    labels.append(1)
                elif kind < 0.83:
                    parts.append(f"<h2>{' '.join(words(1, 6))}</h2>")
                    labels.append(1)
                elif kind < 0.9:
                    k = rnd.randint(2, 4)
                    parts.append("<ul>" + "".join(f"<li>{sentence(2, 14)}</li>" for _ in range(k)) + "</ul>")
                    labels.extend([1] * k)
                elif kind < 0.95:
                    parts.append(f"<blockquote><p>{sentence(4, 25)}</p></blockquote>")
                    labels.append(1)
                else:
                    parts.append(tagged(rnd.choice(["aside", "div"]), "side", sentence(3, 15)))
                    labels.append(0)
            shape = rnd.random()
            inner = "".join(parts)
            if shape < 0.5:
                return f"<article>{inner}</article>"
            if shape < 0.7:
                return f"<main>{inner}</main>"
            return tagged(rnd.choice(["div", "section", "article"]), "main", inner)

        if rnd.random() < 0.2:
            html.append(small("notice", "div"))
        if rnd.random() < 0.3:
            html.append(small("head", rnd.choice(["header", "div"]), 1, 8))
        if rnd.random() < 0.9:
            html.append(menu())
        if rnd.random() < 0.5:
            html.append(small("advert", "div", 2, 30))
        if rnd.random() < 0.2:
            html.append(small("side", rnd.choice(["aside", "div"])))
        html.append(article())
        if rnd.random() < 0.3:
            html.append(small("side", rnd.choice(["aside", "div", "section"])))
        if rnd.random() < 0.3:
            html.append(menu("side", rnd.choice(["aside", "div"])))
        if rnd.random() < 0.2:
            html.append(small("form", rnd.choice(["form", "form", "div"]), 1, 8))
        if rnd.random() < 0.35:
            html.append(small("talk", rnd.choice(["section", "div"]), 3, 50))
        if rnd.random() < 0.2:
            html.append(small("notice", rnd.choice(["div", "aside"])))
        if rnd.random() < 0.9:
            text = rnd.choice(["&copy; 2020 ", "", "&copy; "]) + sentence(2, 20)
            html.append(tagged("footer" if rnd.random() < 0.8 else "div", "foot", text, True)
                        if rnd.random() < 0.5 else f"<footer>{text}</footer>")
            labels.append(0)
        pages.append(("<html><body>" + "".join(html) + "</body></html>", labels))
    return pages


@lru_cache(maxsize=1)
def page_model() -> ChainCRF:
    data = []
    for html, labels in labelled_pages():
        features = block_features(leaf_blocks(html))
        if len(features) != len(labels):
            raise AssertionError("a labelled page has other blocks than its labels")
        data.append((features, labels))
    return train_crf(data)


def main_text(html: str | None, model: ChainCRF) -> str:
    blocks = leaf_blocks(html or "")
    labels = model.decode(block_features(blocks, model.weights))
    return " ".join(text for (text, _, _), label in zip(blocks, labels) if label)


def extract_pages(pages: DataFrame, model: ChainCRF | None = None) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html, ...).

    Returns page_id, url, text and n_chars (code points).  A null or empty
    html, and a page without a block of main text, give the empty text;
    repeated rows each give a row; an empty table gives an empty result; other
    columns are not read.  Optional tags may be left out, and broken markup is read
    as far as it goes: nothing is dropped but what the field labels as not main
    text and what is never shown (head, scripts, styles and the like).
    """
    model = model or page_model()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), model) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(
        extract, "page_id long, url string, text string, n_chars long"
    )


def op4_crf_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))
