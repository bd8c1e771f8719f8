"""Main text of web pages by a tree-structured graphical model (operator 4).

A page's element tree is the graph: block elements and text blocks are nodes labelled content
or not. Node evidence is a logistic model over tags, class and id words, length and links;
parent-child potentials tie an element to its parent. Sum-product messages run from the leaves
up and from the root down, for the pages of a slice at once, level by level; text blocks with
a content marginal of at least one half make the text.

Training pages label themselves: those with an article or main element. What is outside is noise.
What is inside counts as content, but for blocks that several of the training pages repeat word by
word; parts inside that a tag or class word calls navigation, form, comments and the like are left
out of the fit, so those words don't label what they are a feature of. Every page is
learned twice, the second time without its article and main tags and without class words, so that
tags, lengths and links have to tell. Evidence and potentials are fitted together by pseudo-likelihood (each node given its
neighbours), so that a list inside a menu doesn't speak against lists. The weights start from
priors that say what such marks mean and stay there for marks that the pages don't show.

A page is parsed whole, whatever its length; slices end after ``SLICE_NODES`` nodes, so a task
needs memory in proportion to that or to its largest page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the training sample; pages are chosen by the hash of their id.
TRAIN_PAGES = 300
#: Nodes whose messages run together, about.
SLICE_NODES = 50_000
#: A block that so many training pages repeat is no content.
REPEATED = 3

#: Quotes hold a tag open only behind an equals sign. The groups are possessive, so a tag is read once; a value
#: without a closing quote can occur once for each kind of quote.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.S)
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACES = re.compile(r"\s+")
_HEADING = re.compile("h[1-6]")

_RAW = frozenset("script style template noscript title textarea svg iframe object".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that a start tag of the same group closes first.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_SCOPES = frozenset("ul ol dl table select".split())

_CONTENT_TAGS = ("article", "main")
_NOISE_TAGS = ("nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset", "head")
#: Words of class, id and role attributes that mark content and what is not (fixed values).
_CONTENT_WORDS = ("article", "content", "main", "post", "entry", "story", "body")
_NOISE_WORDS = ("nav", "navigation", "menu", "navbar", "header", "footer", "sidebar", "aside", "ad", "ads", "advert", "advertisement", "banner", "promo", "sponsor", "sponsored", "cookie", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "signup", "login", "form", "search", "share", "social", "related", "recommended", "comment", "comments", "reply", "replies", "disqus", "breadcrumb", "breadcrumbs", "pagination", "pager", "widget", "toolbar", "copyright", "legal", "skip", "adsbygoogle", "werbung", "anzeige", "anzeigen", "kommentar", "kommentare", "seitenleiste", "hinweis", "fusszeile", "kopfzeile", "publicite", "commentaire", "commentaires", "pied", "entete", "publicidad", "anuncio", "anuncios", "comentario", "comentarios", "pie", "cabecera", "barra")

#: Marks that tell content from noise outside of an article, but not inside, where lists and links are content, too.
_LOOKS = ("<p>", "<h>", "<li>", "<div>", "<table>", "<pre>", "links", "long", "short", "stops")
#: Headings of reader comments have at most so many words, one of them from this list (fixed values).
_COMMENT_HEADING = 4
_COMMENT_WORDS = frozenset("comment comments reply replies discussion responses kommentar kommentare commentaire commentaires comentario comentarios".split())

_FEATURES = ["bias", "text", "within", *(f"<{t}>" for t in _CONTENT_TAGS), *(f"<{t}>" for t in _NOISE_TAGS), "<p>", "<h>", "<li>", "<div>", "<table>", "<pre>", *(f"+{w}" for w in _CONTENT_WORDS), *(f"-{w}" for w in _NOISE_WORDS), "links", "long", "short", "stops"]
_AT = {name: i for i, name in enumerate(_FEATURES)}


def _prior() -> np.ndarray:
    w = np.zeros(len(_FEATURES))
    for name in _FEATURES:
        if name.strip("<>") in _NOISE_TAGS:
            w[_AT[name]] = -20.0
        elif name[0] == "-":
            w[_AT[name]] = -8.0
        elif name[0] == "+":
            w[_AT[name]] = 2.5
    for name, value in (("<article>", 20.0), ("<main>", 15.0), ("within", 2.0), ("<p>", 0.8), ("<h>", 0.4), ("<pre>", 0.8), ("links", -1.2), ("long", 1.0), ("short", -0.2), ("stops", 0.5)):
        w[_AT[name]] = value
    return w


@dataclass
class Page:
    """Nodes in document order: parent index, depth, features, whether an element of noise or of
    content holds them, and the text of text blocks."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    features: list[list[tuple[int, float]]] = field(default_factory=list)
    noise: list[bool] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)

    def add(self, parent: int, features: list[tuple[int, float]], noise: bool, inside: bool, text: str | None = None) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.features.append(features)
        self.noise.append(noise or (parent >= 0 and self.noise[parent]))
        self.inside.append(inside or (parent >= 0 and self.inside[parent]))
        self.text.append(text)
        return len(self.parent) - 1


@lru_cache(maxsize=4096)
def _element_features(tag: str, attributes: str) -> tuple[list[tuple[int, float]], bool]:
    names = {f"<{'h' if _HEADING.fullmatch(tag) else tag}>"}
    for m in _MARKS.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = {word.lower() for word in _WORD.findall(name)}
            names |= {f"+{word}" for word in words}
            # "entry-header" is the head of an entry, and an article is one whatever else it is called
            if tag not in (*_CONTENT_TAGS, "body", "html") and not (words & {"header", "title"} and words & set(_CONTENT_WORDS)):
                names |= {f"-{word}" for word in words}
    known = [(_AT[n], 1.0) for n in sorted(names) if n in _AT]
    return [(_AT["bias"], 1.0), *known], tag in _NOISE_TAGS or any(_FEATURES[i][0] == "-" for i, _ in known)


def parse(html: str) -> Page:
    """The element tree of a page with its text blocks."""
    page = Page()
    page.add(-1, [(_AT["bias"], 1.0)], False, False)
    stack: list[tuple[str, int]] = [("", 0)]  # open elements and the node each stands for
    opened: dict[str, list[int]] = {}  # where in the stack each open tag is
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            block = _SPACES.sub(" ", unescape("".join(parts))).strip()
            if block:
                n = len(block)
                if len(stack) > 2 and _HEADING.fullmatch(stack[-1][0]) and stack[-2][0] not in (*_CONTENT_TAGS, "body", "html"):
                    words = block.lower().split(None, _COMMENT_HEADING)
                    if len(words) <= _COMMENT_HEADING and _COMMENT_WORDS & {w.strip("():,.!?") for w in words}:
                        for node in (stack[-2][1], stack[-1][1]):
                            page.features[node] = [*page.features[node], (_AT["-comments"], 1.0)]
                            page.noise[node] = True
                page.add(stack[-1][1], [(_AT["bias"], 1.0), (_AT["text"], 1.0), (_AT["links"], min(1.0, linked / n)), (_AT["long"], float(n >= 100)), (_AT["short"], float(n < 25)), (_AT["stops"], float(block[-1] in ".!?…:\"”"))], False, False, block)
            parts.clear()
        linked = 0

    def close(names: tuple[str, ...], stops: frozenset[str]) -> None:
        last = max((opened[n][-1] for n in names if opened.get(n)), default=0)
        if last and last > max((opened[n][-1] for n in stops if n not in names and opened.get(n)), default=0):
            flush()
            for name, _ in stack[last:]:
                opened[name].pop()
            del stack[last:]

    at = 0
    while m := _TAG.search(html, at):
        if m.start() > at:
            parts.append(html[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag not in _INLINE and tag != "br":
                close((tag,), frozenset())
        elif tag in _RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
        elif tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
        elif tag in _INLINE:
            links += tag == "a"
        else:
            flush()
            links = 0
            close(("p",), _SCOPES | {"div", "article", "section", "li", "td", "body"})
            if tag in _CLOSES:
                close(_CLOSES[tag], _SCOPES)
            features, noise = _element_features(tag, m[3])
            opened.setdefault(tag, []).append(len(stack))
            stack.append((tag, page.add(stack[-1][1], features, noise, tag in _CONTENT_TAGS)))
    parts.append(html[at:])
    flush()
    return page


@dataclass
class Model:
    weights: np.ndarray
    edge: np.ndarray  # [kind of child][parent label][child label], log potentials


@dataclass
class Forest:
    """The nodes of some pages: evidence as (node, feature, value), parents, depths, and kinds:
    element, text, and element with a noise mark. The last says little about what holds it."""

    node: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray

    def score(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.node, weights[self.feature] * self.value, len(self.parent))


def _forest(pages: list[Page]) -> Forest:
    sizes = np.cumsum([0] + [len(p.parent) for p in pages])
    parent = np.array([up + base if up >= 0 else -1 for base, p in zip(sizes.tolist(), pages) for up in p.parent], dtype=np.int64)
    marks = [(base + i, j, v) for base, p in zip(sizes.tolist(), pages) for i, features in enumerate(p.features) for j, v in features if v]
    node, feature, value = (np.array(c) for c in zip(*marks)) if marks else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    depth = np.array([d for p in pages for d in p.depth], dtype=np.int64)
    kind = np.array([1 if t is not None else 2 * any(_FEATURES[j][0] == "-" or _FEATURES[j][1:-1] in _NOISE_TAGS for j, _ in features) for p in pages for t, features in zip(p.text, p.features)], dtype=np.int64)
    return Forest(node, feature, value, parent, depth, kind)


def _told(page: Page) -> Page:
    """The page as it is judged: inside an article looks don't count, so a list there is no menu."""
    looks = {_AT[name] for name in _LOOKS}
    within = [inside and not noise for inside, noise in zip(page.inside, page.noise)]
    features = [[*(f for f in own if f[0] not in looks), (_AT["within"], 1.0)] if w else own for own, w in zip(page.features, within)]
    return Page(page.parent, page.depth, features, page.noise, page.inside, page.text)


def _blind(page: Page) -> Page:
    """The page without its article and main tags and its class and id words."""
    hidden = {_AT[f"<{t}>"] for t in _CONTENT_TAGS} | {i for i, name in enumerate(_FEATURES) if name[0] in "+-"}
    return Page(page.parent, page.depth, [[f for f in features if f[0] not in hidden] for features in page.features], page.noise, page.inside, page.text)


def train(pages: list[Page], steps: int = 200, rate: float = 1.0, pull: float = 0.02) -> Model:
    """Evidence weights and potentials near their priors that fit the pages with an article or main
    element, by gradient descent on the pseudo-likelihood."""
    weights = _prior()
    edge = np.log(np.array([[[60.0, 1.0], [1.0, 120.0]], [[60.0, 1.0], [1.0, 60.0]], [[1.0, 1.0], [1.0, 1.0]]]))
    shown = [p for p in pages if any(p.inside)]
    if not shown:
        return Model(weights, edge)
    seen = Counter(t for p in shown for t in {t for t in p.text if t is not None})
    label = np.array([inside and not noise and not (text is not None and seen[text] >= REPEATED) for p in shown for inside, noise, text in zip(p.inside, p.noise, p.text)] * 2, dtype=np.int64)
    told = np.array([not (inside and noise) for p in shown for inside, noise in zip(p.inside, p.noise)] * 2)
    f = _forest([_told(p) for p in shown] + [_blind(p) for p in shown])
    child = np.flatnonzero((f.parent >= 0) & told)
    up, text = f.parent[child], f.kind[child]
    used = told[f.node]
    mass = np.bincount(f.feature[used], f.value[used], len(weights)) + 1
    first, tied = weights.copy(), edge.copy()
    each = np.zeros_like(edge)
    np.add.at(each, (text, label[up], label[child]), 1)
    each = each.sum(axis=2, keepdims=True) + 1
    n = len(label)
    for _ in range(steps):
        logit = f.score(weights)
        logit[child] += edge[text, label[up], 1] - edge[text, label[up], 0]
        logit += np.bincount(up, edge[text, 1, label[child]] - edge[text, 0, label[child]], n)
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label) * told
        # every parameter moves by the mean error of the nodes that have it
        weights -= rate * (np.bincount(f.feature, error[f.node] * f.value, len(weights)) / mass + pull * (weights - first))
        slope = np.zeros_like(edge)
        np.add.at(slope, (text, label[up], 1), error[child])
        np.add.at(slope, (text, label[up], 0), -error[child])
        np.add.at(slope, (text, 1, label[child]), error[up])
        np.add.at(slope, (text, 0, label[child]), -error[up])
        slope[2] = 0  # inside an article such elements are left out, so the sample can't tell
        edge -= rate * (slope / each / 4 + 0.3 * (edge - tied))
    return Model(weights, edge)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(pages: list[Page], model: Model) -> np.ndarray:
    """Content marginals of all nodes by one pass of messages up and one down."""
    f = _forest([_told(p) for p in pages])
    parent, depth, kind = f.parent, f.depth, f.kind
    score = f.score(model.weights)
    belief = np.stack([-score / 2, score / 2], axis=1)
    up = np.zeros_like(belief)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    for nodes in reversed(levels[1:]):
        up[nodes] = _lse(model.edge[kind[nodes]] + belief[nodes][:, None, :], 2)
        np.add.at(belief, parent[nodes], up[nodes])
    for nodes in levels[1:]:
        rest = belief[parent[nodes]] - up[nodes]
        rest -= _lse(rest, 1)[:, None]
        belief[nodes] += _lse(model.edge[kind[nodes]] + rest[:, :, None], 1)
    return np.exp(belief[:, 1] - _lse(belief, 1))


def _slices(htmls: list[str | None]) -> Iterator[list[Page]]:
    held: list[Page] = []
    nodes = 0
    for html in htmls:
        held.append(parse(html or ""))
        nodes += len(held[-1].parent)
        if nodes >= SLICE_NODES:
            yield held
            held, nodes = [], 0
    if held:
        yield held


def page_texts(htmls: list[str | None], model: Model) -> list[str]:
    out = []
    for pages in _slices(htmls):
        chance, at = marginals(pages, model), 0
        for page in pages:
            own = chance[at : at + len(page.text)]
            at += len(page.text)
            out.append("\n".join(page.text[i] for i in _chosen(page, own)))
    return out


def _chosen(page: Page, chance: np.ndarray) -> list[int]:
    """The text blocks of a page: those more likely content than not. A page without any falls back to
    the element whose blocks outweigh half of the page's mean chance the most; blocks in parts that a tag or
    class word calls noise, and mere links, don't count for it."""
    blocks = [i for i, t in enumerate(page.text) if t is not None]
    sure = [i for i in blocks if chance[i] >= 0.5]
    links = _AT["links"]
    open_ = [i for i in blocks if not page.noise[i] and not any(j == links and v > 0.5 for j, v in page.features[i])]
    if sure or not open_:
        return sure
    size = np.array([len(page.text[i]) for i in open_], dtype=float)
    odds = np.log(np.maximum(chance[open_], 1e-300))
    worth = np.zeros(len(page.parent))
    worth[open_] = size * (odds - (odds * size).sum() / size.sum() + np.log(2))
    parent = page.parent
    for i in range(len(parent) - 1, 0, -1):
        worth[parent[i]] += worth[i]
    elements = [i for i in range(len(parent)) if page.text[i] is None]
    best = max(elements, key=lambda i: (worth[i], -i))
    held = np.zeros(len(parent), dtype=bool)
    held[best] = True
    for i in range(best + 1, len(parent)):
        held[i] = held[parent[i]]
    return [i for i in open_ if held[i]]


def train_on(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", bound: int = TRAIN_PAGES) -> Model:
    """Fit the model on at most ``bound`` pages; an empty table leaves the priors.

    The pages' ids are chosen first, so tasks send only ids besides the chosen pages."""
    rows = pages.select(F.col(id_col).cast("long").alias("k"), F.col(html_col).cast("string").alias("h")).where("h is not null and k is not null")
    chosen = rows.select("k", F.xxhash64("k").alias("o")).orderBy("o", "k").limit(bound).select("k").distinct()
    picked = rows.join(F.broadcast(chosen), "k").orderBy(F.xxhash64("k"), "h").limit(bound).collect()
    return train([parse(row.h) for row in picked])


def extract_text(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row; null and empty pages have an empty
    text. Null and repeated ids stay as they are; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = page_texts(batch.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
