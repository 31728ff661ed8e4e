"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A leaf block is a run of text between the starts and ends of block elements. Each block is main text
or not. What speaks for either are its features: the tags of its ancestors, the words of their
class, id, role and itemprop attributes, and the text's length, share of links, punctuation, place
behind the heading and short phrases. What speaks for a change between neighbours depends on whether
they stand in one container. The field is fitted to PAGES labelled pages (`labelled_pages`), a
bounded sample made by rule, by gradient steps on the exact likelihood; Viterbi finds each page's
best labels. Pages are taken one by one in tasks, whole; nothing is shuffled.

White space is what Unicode says it is, no-break spaces included; <br> is one.

Cases. A null or empty html, and a page without main text, give an empty text. Rows of one page_id
are pages of their own. A null page_id or url is carried. Markup that is cut off or never closed
ends with the page. Other columns take no part. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import column, lean, table
from lodestack.llm.labelled_pages import labelled_pages

PAGES, SEED, STEPS, RATE, DECAY, LEAST_COUNT = 1000, 7, 140, 0.15, 2e-4, 6

# HTML's kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym area b bdi bdo big br cite code data del dfn em font i img input ins kbd label map mark nobr picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("script style title template noscript svg math iframe object canvas audio video noframes head textarea".split())
ENDS_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption tr td th tbody thead tfoot table caption center".split())
CLOSES = {  # a start tag: what it ends, and what it does not look beyond
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
}
CELLS = frozenset("td th caption".split())
TABLES = frozenset("table tr td th tbody thead tfoot caption".split())

_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("text", "features", "container", "gold")

    def __init__(self, text: str, features: list[str], container: int, gold: bool):
        self.text, self.features, self.container, self.gold = text, features, container, gold


class Blocks(HTMLParser):
    """The leaf blocks of a page, in its order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[Block] = []
        self.stack: list[tuple[str, tuple[str, ...], int, bool]] = []  # tag, names, container, gold
        self.open: Counter[str] = Counter()
        self.active: Counter[str] = Counter()
        self.text: list[str] = []
        self.linked = self.containers = self.gold = 0
        self.title: list[str] = []
        self.heading = False

    def _push(self, tag: str, attrs: list) -> None:
        names = [] if tag in INLINE else ["a:" + tag]
        gold = False
        for key, value in attrs:
            if key in ("class", "id", "role", "itemprop") and value and tag not in INLINE:
                names += {"c:" + w.lower() for w in _NAME.findall(value)}
            elif key == "data-gold":
                gold = True
        container = self.stack[-1][2] if self.stack else 0
        if tag not in TEXTUAL and tag not in INLINE:
            self.containers += 1
            container = self.containers
        for n in names:
            self.active[n] += 1
        self.stack.append((tag, tuple(names), container, gold))
        self.open[tag] += 1
        self.gold += gold

    def _pop(self) -> None:
        tag, names, _, gold = self.stack.pop()
        self.open[tag] -= 1
        self.gold -= gold
        for n in names:
            if self.active[n] == 1:
                del self.active[n]
            else:
                self.active[n] -= 1

    def _cut(self, tags, stop) -> None:
        """End the innermost open element of `tags` that is not beyond one of `stop`."""
        if not any(self.open[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[k][0]
            if tag in tags:
                while len(self.stack) > k:
                    self._pop()
                return
            if tag in stop:
                return

    def _end_block(self) -> None:
        words = "".join(self.text).split()
        if words:
            self._add(" ".join(words), words)
        self.text, self.linked = [], 0

    def _add(self, text: str, words: list[str]) -> None:
        n, near = len(words), next((s[0] for s in reversed(self.stack) if s[0] not in INLINE), "")
        features = [*self.active, "bias", "t:" + near]
        features.append("n:" + next(name for most, name in ((1, "1"), (3, "3"), (9, "9"), (24, "24"), (59, "59"), (n, "60")) if n <= most))
        share = self.linked / max(1, sum(map(len, words)))
        features.append("l:" + ("none" if not self.linked else "some" if share < 0.3 else "half" if share < 0.7 else "all"))
        features.append("e:" + ("stop" if text[-1] in ".!?…\"”»" else "none"))
        features += [name for name, held in (("s:comma", "," in text), ("s:copyright", "©" in text), ("s:bar", "|" in text or "·" in text or "»" in text), ("s:digit", any(c.isdigit() for c in text[:200])), ("s:lower", text[0].islower())) if held]
        if self.heading:
            features.append("x:behind heading")
        if near == "h1":
            self.heading = True
        title = " ".join("".join(self.title).split())
        if title and (text.startswith(title) or title.startswith(text)):
            features.append("x:title")
        if n <= 8:
            features += {"w:" + w for w in _WORD.findall(text.lower())}
        self.found.append(Block(text, features, self.stack[-1][2] if self.stack else 0, self.gold > 0))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.text.append(" ")
        if tag not in INLINE:
            self._end_block()
            if tag == "body":
                self._cut({"head"}, ())
            if tag in ENDS_P:
                self._cut({"p"}, CELLS | {"button"})
            if tag in CLOSES:
                self._cut(*CLOSES[tag])
        elif tag == "a":
            self._cut({"a"}, CELLS)
        if tag not in VOID:
            self._push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do, <div/> opens an element

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_block()
            self._cut({tag}, () if tag in TABLES or tag in ("body", "html") else CELLS)
        elif self.open[tag]:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] not in INLINE:
                    return
                if self.stack[k][0] == tag:
                    while len(self.stack) > k:
                        self._pop()
                    return

    def handle_data(self, data: str) -> None:
        if self.open["title"] and not self.open["svg"]:
            self.title.append(data)
        elif not any(self.open[t] for t in SILENT if t in self.open):
            self.text.append(data)
            if self.open["a"]:
                self.linked += sum(map(len, data.split()))

    def close(self) -> None:
        super().close()
        self._end_block()


def blocks(html: str | None) -> list[Block]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    return parser.found


class Field:
    """Weights of the features for main text, and of neighbours: change[same container][before][after]."""

    def __init__(self, weights: dict[str, float], change: np.ndarray):
        self.weights, self.change = weights, change.tolist()

    def labels(self, found: list[Block]) -> list[bool]:
        """Viterbi's best labels; main text gives way at a tie."""
        weights, back = self.weights, []
        none = main = 0.0
        container = None
        for k, b in enumerate(found):
            own = sum(weights.get(f, 0.0) for f in b.features)
            if k:
                c = self.change[b.container == container]
                a0, a1, b0, b1 = none + c[0][0], main + c[1][0], none + c[0][1], main + c[1][1]
                back.append((a1 > a0, b1 > b0))
                none, main = max(a0, a1), max(b0, b1)
            main += own
            container = b.container
        if not found:
            return []
        out = [main > none]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def fitted(pages: list[list[Block]]) -> Field:
    """The field of greatest penalised likelihood, by Adam steps over all pages at once."""
    pages = [p for p in pages if p]
    counts = Counter(f for p in pages for b in p for f in b.features)
    index = {f: k for k, f in enumerate(sorted(f for f, n in counts.items() if n >= LEAST_COUNT))}
    n, longest = len(pages), max(map(len, pages))
    cell, feature, gold = [], [], np.zeros((longest, n))
    there, same = np.zeros((longest, n), bool), np.zeros((longest, n), int)
    for j, p in enumerate(pages):
        for i, b in enumerate(p):
            there[i, j], gold[i, j] = True, b.gold
            same[i, j] = bool(i) and b.container == p[i - 1].container
            own = [index[f] for f in b.features if f in index]
            feature += own
            cell += [i * n + j] * len(own)
    cell, feature = np.array(cell), np.array(feature)
    both = there[1:] & there[:-1]
    g = gold.astype(int)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (same[1:][both], g[:-1][both], g[1:][both]), 1)
    theta = np.zeros(len(index) + 8)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    last = there.sum(0) - 1
    for step in range(1, STEPS + 1):
        change = theta[-8:].reshape(2, 2, 2)
        own = np.zeros((longest, n, 2))
        own[:, :, 1] = np.bincount(cell, theta[feature], longest * n).reshape(longest, n)
        ahead, behind = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        ahead[0] = own[0]
        for i in range(1, longest):
            ahead[i] = np.logaddexp.reduce(ahead[i - 1][:, :, None] + change[same[i]], 1) + own[i]
        for i in range(longest - 2, -1, -1):
            further = np.logaddexp.reduce(change[same[i + 1]] + (own[i + 1] + behind[i + 1])[:, None, :], 2)
            behind[i] = np.where((there[i + 1])[:, None], further, 0.0)
        whole = np.logaddexp.reduce(ahead[last, np.arange(n)], 1)
        main = np.where(there, np.exp(ahead[:, :, 1] + behind[:, :, 1] - whole), 0.0)
        pair = ahead[:-1][..., None] + change[same[1:]] + (own[1:] + behind[1:])[:, :, None, :] - whole[:, None, None]
        pair = np.exp(np.where(both[..., None, None], pair, -np.inf))
        expected = np.stack([pair[same[1:] == s].sum(0) for s in (0, 1)])
        slope = np.empty_like(theta)
        slope[:-8] = np.bincount(feature, (gold - main).ravel()[cell], len(index)) / n
        slope[-8:] = (seen - expected).ravel() / n
        slope -= DECAY * theta
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        theta += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Field({f: float(theta[k]) for f, k in index.items()}, theta[-8:].reshape(2, 2, 2))


@cache
def field() -> Field:
    return fitted([blocks(html) for html in labelled_pages(PAGES, SEED)])


def main_text(html: str | None, model: Field) -> str:
    found = blocks(html)
    return "\n\n".join(b.text for b, main in zip(found, model.labels(found)) if main)


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row of `pages` (page_id, url, html)."""
    held = pages.sparkSession.sparkContext.broadcast(model or field())  # some thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py(), held.value) for html in batch.column("html")]
            own = [batch.column("page_id"), batch.column("url"), column(texts, pa.string()), column([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(own, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
