"""Main text of web pages by a linear-chain conditional random field.

A page is cut into its leaf blocks: runs of text that no block element divides.
Each block has features of its ancestors (tags, words of their classes and ids)
and of its text (length, share of links, punctuation, place in the page).  A
chain of two labels, main and other, runs over the blocks; its weights are
learned from labelled pages by stochastic gradient ascent on the likelihood,
and a page is decoded by Viterbi's algorithm.

Labelled pages come from the corpus: a bounded sample of pages whose article is
marked as such, each used as it is and in made variants that put the same blocks
into other containers, among notices, forms, adverts, sidebars and comments.

Defined cases: null and empty pages have the empty text; a page without a
block, or whose blocks are all labelled other, has the empty text; cut-off and
unclosed markup is read to the end, only script, style, title, textarea and
iframe without an end tag hide what follows, as in a browser; math and the text
in an object are read as part of their block; repeated rows give repeated results; other
columns are ignored; an empty table gives an empty result; without a page to
learn from, blocks of ``article`` and ``main`` elements are the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import column, map_arrow, slices, texts

#: Pages to learn from, made variants of each, and passes over them.
TRAIN_PAGES, VARIANTS, PASSES = 150, 3, 4

#: Element classes of HTML.
BLOCK = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section
select summary table tbody td tfoot th thead title tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe".split())
#: Elements that are left out if they have an end tag; else only their start tag.
HIDDEN = set("noscript template svg head select".split())
FOREIGN = {"svg", "math"}  # elements that a start tag in /> closes
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# a quote opens a value only behind an equals sign and if it is closed somewhere
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}
_PAIR = {tag: re.compile(rf"""<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\b|\Z)|<(/?){tag}(?=[\s/>])((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*)(?:>|\Z)""", re.I | re.S)
         for tag in HIDDEN}
_BODY = re.compile(r"<body\b", re.I)


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    words: frozenset[str]
    linked: int  # characters inside links


def closed(page: str, name: str) -> dict[int, int]:
    """Where the elements of a name that have an end tag begin and end."""
    out, open_ = {}, []
    for found in _PAIR[name].finditer(page):
        if found[3] is None:
            continue
        if not found[2]:
            if not (name in FOREIGN and found[3].endswith("/")):
                open_.append(found.start())
        elif open_:
            out[open_.pop()] = found.end()
    return out


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page in order; hidden elements are left out."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    parts: list[str] = []
    linked, links = 0, 0
    ends: dict[str, dict[int, int]] = {}

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, tuple(t for t, _ in stack), frozenset().union(*(w for _, w in stack)), linked))
            parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            linked += len(raw) if links else 0

    def drop(depth: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t, _ in stack[depth:])
        del stack[depth:]

    at = 0
    while True:
        found = _TAG.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at:found.start()])
        at = found.end()
        closing, name = found[1], (found[2] or "").lower()
        if not name:
            continue
        if closing:
            if name in BLOCK:
                flush()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                drop(depth)
            continue
        if name in RAW:
            if name in BLOCK:
                flush()
            end = _END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        empty = found[3].endswith("/") and (name in FOREIGN or any(t == "math" for t, _ in stack))
        if name in HIDDEN:
            if name in BLOCK or name == "head":
                flush()
            if not empty:
                if name not in ends:
                    ends[name] = closed(page, name)
                end = ends[name].get(found.start(), at)
                if name != "head" or not _BODY.search(page, at, end):  # an unclosed head ends where the body begins
                    at = end
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            flush()
            if any(t == "p" for t, _ in stack):  # a block ends an open paragraph
                drop(next(i for i, (t, _) in enumerate(stack) if t == "p"))
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in CLOSES.get(name, ()):
                    drop(depth)
                    break
                if stack[depth][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        if name not in VOID and not empty:
            words = frozenset(w for a in _NAMED.findall(found[3]) for w in _PART.findall("".join(a).lower())) if found[3] else frozenset()
            if links and name == "a":
                drop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "a"))
            stack.append((name, words))
            links += name == "a"
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        size = len(b.text)
        f = ["any", f"leaf={next((t for t in reversed(b.tags) if t in BLOCK), '')}", f"size={min(9, size.bit_length())}",
             f"links={b.linked * 4 // max(1, size)}", f"stop={b.text[-1] in '.!?…:;'}", f"place={i * 5 // n}"]
        f += [f"in={t}" for t in set(b.tags)]
        f += [f"word={w}" for w in b.words]
        if "©" in b.text:
            f.append("copyright")
        if sum(map(b.text.count, ".,;")) * 40 > size:
            f.append("pointed")
        out.append(f)
    return out


class Chain:
    """A two-label chain with weights of (feature, label) and of transitions."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: list[list[float]]):
        self.weights, self.moves = weights, moves

    def decode(self, feats: list[list[str]]) -> list[bool]:
        """The likeliest labels (true: main), by Viterbi's algorithm."""
        get, none, (m, back) = self.weights.get, (0.0, 0.0), (self.moves, [])
        best = None
        for names in feats:
            a = b = 0.0
            for x in names:
                p, q = get(x, none)
                a += p
                b += q
            if best is None:
                best = a, b
                continue
            stay, leave = best[0] + m[0][0], best[1] + m[1][0]
            enter, remain = best[0] + m[0][1], best[1] + m[1][1]
            back.append((leave > stay, remain > enter))
            best = max(stay, leave) + a, max(enter, remain) + b
        if best is None:
            return []
        label = best[1] > best[0]
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


#: What marks the text when there is no page to learn from.
PLAIN = Chain({"any": (0.5, 0.0), "in=article": (0.0, 1.0), "in=main": (0.0, 1.0)}, [[0.0, 0.0], [0.0, 0.0]])


def learn(pages: list[tuple[list[list[str]], list[bool]]], passes: int = PASSES, seed: int = 1) -> Chain:
    """Weights that make the labels of the pages likely, with Adagrad steps on
    the likelihood's gradient (forward-backward) and a slight pull to zero."""
    index = {x: i for i, x in enumerate(sorted({x for f, _ in pages for names in f for x in names}))}
    data = [([np.array([index[x] for x in names]) for names in f], np.array(y, int)) for f, y in pages if f]
    w, g = np.zeros((len(index), 2)), np.full((len(index), 2), 1e-6)
    m, gm = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for k in rng.permutation(len(data)):
            ids, y = data[k]
            n = len(ids)
            u = np.array([w[i].sum(axis=0) for i in ids])
            alpha, beta = np.empty((n, 2)), np.zeros((n, 2))
            alpha[0] = u[0]
            for t in range(1, n):
                alpha[t] = u[t] + np.logaddexp(alpha[t - 1, 0] + m[0], alpha[t - 1, 1] + m[1])
            for t in range(n - 2, -1, -1):
                v = u[t + 1] + beta[t + 1]
                beta[t] = np.logaddexp(m[:, 0] + v[0], m[:, 1] + v[1])
            total = np.logaddexp(*alpha[-1])
            error = np.eye(2)[y] - np.exp(alpha + beta - total)
            slope = np.zeros_like(m)
            if n > 1:
                pair = np.exp(alpha[:-1, :, None] + m + (u[1:] + beta[1:])[:, None, :] - total)
                np.add.at(slope, (y[:-1], y[1:]), 1)
                slope -= pair.sum(axis=0)
            flat, sizes = np.concatenate(ids), [len(i) for i in ids]
            step = np.zeros_like(w)
            np.add.at(step, flat, np.repeat(error, sizes, axis=0))
            used = np.unique(flat)
            s = step[used] - 1e-3 * w[used]
            g[used] += s * s
            w[used] += 0.3 * s / np.sqrt(g[used])
            slope -= 1e-3 * m
            gm += slope * slope
            m += 0.3 * slope / np.sqrt(gm)
    return Chain({x: (float(w[i, 0]), float(w[i, 1])) for x, i in index.items()}, m.tolist())


# --- labelled pages ------------------------------------------------------------

#: Containers that pages use for their parts.
MAIN_BOXES = """article|main|section class="article-body"|div class="content"|div id="main-content"|div class="post"|
div class="entry-content"|div class="article"|div class="story-body"|div role="main"|div""".replace("\n", "").split("|")
OTHER_BOXES = """nav|nav class="menu"|header|footer|aside|aside class="sidebar"|div class="sidebar"|div class="menu"|div id="nav"|
div class="ad"|div class="ads"|div class="advert"|div class="advertisement"|div class="sponsored"|div class="banner"|div class="promo"|
div class="cookie-notice"|div class="cookie-consent"|div class="notice"|div role="alert" class="alert"|div class="consent"|form|
form class="newsletter"|div class="newsletter subscribe"|div class="comments"|section class="comments"|section id="comments"|
div class="comment"|ol class="comment-list"|div id="disqus-thread"|div class="related"|div class="share social"|div class="breadcrumb"|
div class="footer"|div id="footer"|div class="header"|div id="header"|div class="widget"|div class="popup modal"|div class="login"|
div class="search"|div class="tags"|div class="author-bio"|div class="replies"|div class="user-comment reply"
""".replace("\n", "").split("|")
MARKED, UNMARKED = {"article", "main"}, set("nav header footer aside form button dialog search menu".split())
UNMARKED_WORDS = set("""ad ads advert advertisement sponsored promo banner sidebar menu nav navigation breadcrumb footer cookie consent notice
newsletter subscribe comment comments disqus reply replies related share social widget popup modal login""".split())


def marked_labels(blocks: list[Block]) -> list[bool]:
    """Labels of a page whose article is marked as such."""
    return [bool(MARKED & set(b.tags)) and not UNMARKED & set(b.tags) and not UNMARKED_WORDS & b.words for b in blocks]


def variant(blocks: list[Block], labels: list[bool], rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page with the same main blocks in another container, among other
    blocks in containers of their kinds, and its labels."""
    text = [b for b, y in zip(blocks, labels, strict=True) if y]
    rest = [b.text for b, y in zip(blocks, labels, strict=True) if not y] + [b.text for b in text[1:4]]
    out, y = ["<html><body>"], []
    pick = lambda names: names[int(rng.integers(len(names)))]

    def other() -> None:
        box = pick(OTHER_BOXES)
        tag = box.split()[0]
        out.append(f"<{box}>")
        for _ in range(int(rng.integers(1, 4))):
            line = html.escape(pick(rest)) if rest else "x"
            line = " ".join(line.split()[:int(rng.integers(1, 40))])
            style = int(rng.integers(4))
            out.append((f"<p>{line}</p>", f"<ul><li><a href='#'>{line}</a></li></ul>", f"<div>{line}</div>", f"<label>{line}</label><p><a href='#'>{line}</a></p>")[style])
            y.extend([False] * (2 if style == 3 else 1))
        out.append(f"</{tag}>")

    for _ in range(int(rng.integers(1, 4))):
        other()
    box = pick(MAIN_BOXES)
    wrap = rng.random() < 0.3
    out.append(f"<div class='wrapper page container'><{box}>" if wrap else f"<{box}>")
    for b in text:
        leaf = next((t for t in reversed(b.tags) if t in BLOCK), "p")
        leaf = leaf if leaf in ("h1", "h2", "h3", "blockquote", "li", "pre") else "p"
        out.append(f"<{leaf}>{html.escape(b.text)}</{leaf}>")
        y.append(True)
        if rng.random() < 0.05:
            other()
    if rng.random() < 0.4:
        other()
    out.append(f"</{box.split()[0]}>" + ("</div>" if wrap else ""))
    for _ in range(int(rng.integers(1, 4))):
        other()
    return "".join([*out, "</body></html>"]), y


def fit(pages: DataFrame, text: str = "html", rows: int = TRAIN_PAGES) -> Chain:
    """Learn from ``rows`` pages at most, those with the smallest hashes."""
    marked = pages.filter(F.col(text).rlike("(?i)<(article|main)[ >]")).select(F.col(text).alias("page"), F.xxhash64(text).alias("h"))
    least = [r["h"] for r in marked.select("h").distinct().orderBy("h").limit(rows).collect()]
    sample = [r["page"] for r in marked.filter(F.col("h").isin(least)).distinct().orderBy("h").collect()] if least else []
    rng = np.random.default_rng(7)
    data = []
    for page in sample:
        blocks = leaf_blocks(page)
        labels = marked_labels(blocks)
        data.append((features(blocks), labels))
        for _ in range(VARIANTS):
            made, y = variant(blocks, labels, rng)
            found = leaf_blocks(made)
            if len(found) == len(y):
                data.append((features(found), y))
    return learn(data) if data else PLAIN


def main_text(page: str, chain: Chain) -> str:
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, y in zip(blocks, chain.decode(features(blocks)), strict=True) if y)


def extracted(pages: DataFrame, chain: Chain, keep: list[str], text: str = "html") -> DataFrame:
    """Columns ``keep``, ``text`` and ``n_chars`` of each page."""
    whole = pages.select(*[F.col(k) for k in keep], F.col(text).alias("__page"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.select(*keep).schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "__page"):
            found = [main_text(t, chain) for t in texts(column(piece, "__page"))]
            yield pa.RecordBatch.from_arrays([*(column(piece, k) for k in keep), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())],
                                             [*keep, "text", "n_chars"])

    return map_arrow(whole, read, f"{schema}, text string, n_chars long")
