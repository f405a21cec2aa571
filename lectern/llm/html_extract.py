"""Main text of web pages with a tree-structured graphical model over DOM nodes.

Every block-level element (and every inline element with a class or id) is a node that is content or not; inline
nodes do not end a block, they only mark their part of its text. A
node's own potential comes from its tag, its class, id and role words, its text and its shape: how much of the page's and of its
parent's text is below it, how much of that is links, how long its pieces are, where it stands and how often its kind repeats
beside it. Parent-child potentials connect it with its parent. Sum-product messages go up and down the tree, so marginals are exact: a paragraph
in a sidebar is told from one in the article by its ancestors, an advert in the article by itself. Weights are
fitted by the likelihood of labelled pages, whose elements carry ``data-content="1"`` or ``"0"`` (inherited;
the attribute is never a feature). Fitting takes at most about ``TRAIN_PAGES`` labelled pages, in one task; the weights of the query lie in a
file that :mod:`lectern.llm.fit_html_weights` makes.

Blocks end where a block-level element begins or ends, nowhere else; ``br`` is white space. A block is what its content
nodes have of it. Null or empty html gives an
empty text. Every input row has a result row, also if page_id is null or repeated. Other columns are ignored.
"""

from __future__ import annotations

import html
import itertools
import json
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.parallelism import spread

FEATURES = 1 << 16
TRAIN_PAGES = 2_000
STEPS = 400
#: Pages whose surest text is less sure than this have no article.
LEAST_CONTENT = 0.15
#: Weights fitted to ``example_pages`` by :mod:`lectern.llm.fit_html_weights`.
WEIGHTS = Path(__file__).with_name("html_weights.json")
EXAMPLES = 2_000
DATA_CONTENT = "data-content"
BLOCK_CHARS = 1 << 21

BLOCK = frozenset(
    "html head body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption form fieldset legend button select option textarea label address details summary dialog menu hr title "
    "noscript iframe center template".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
#: Open elements that a start tag ends by itself, up to the given border.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}), "body": ({"head"}, {"html"}),
}
ENDS_P = BLOCK - {"html", "head", "body", "title", "button", "label", "option", "select", "textarea", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
P_BORDER = frozenset("td th table button article section div body aside nav header footer main li blockquote form".split())
SECTIONING = frozenset("main article section header footer nav aside form dialog menu".split())
#: Quotes count only right after ``=``; a quoted value without an end, or with text right behind it, ends at the next ``>``.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:=\s*+\"[^\"]*+\"(?=[\s/>]|\Z)|=\s*+'[^']*+'(?=[\s/>]|\Z)|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Such as ``5 replies``, ``(12) Kommentare`` or ``Comments (3)``.
COUNTED = re.compile(r"\(?\d+\)?(?: \w+){1,2}\Z|\w+(?: \w+)? \(\d+\)\Z")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    """Nodes in page order (parents first) and blocks of text."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    link_chars: list[int] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)
    counted: list[int] = field(default_factory=list)  # whether the first text of its own is a number and a word or two
    blocks: list[list[tuple[int, str]]] = field(default_factory=list)  # (node, text as written) of each part

    def add(self, parent: int, tag: str, names: tuple[str, ...], label: int) -> int:
        for values, value in zip((self.parent, self.tag, self.names, self.label, self.chars, self.link_chars, self.marks, self.counted), (parent, tag, names, label, 0, 0, 0, 0), strict=True):
            values.append(value)
        return len(self.parent) - 1


def parse(source: str | None) -> Page:
    page = Page()
    root = page.add(-1, "#page", (), 0)
    stack: list[tuple[str, int]] = [("#page", root)]  # open elements and their node
    places: dict[str, list[int]] = {}  # where the open elements of each tag are in the stack
    sections: list[int] = []
    run: list[tuple[int, str]] = []
    links = 0

    def flush() -> None:
        parts: list[tuple[int, str]] = []
        for node, pieces in itertools.groupby(run, key=lambda x: x[0]):
            text = "".join(t for _, t in pieces)
            parts.append((node, text))
            plain = " ".join(text.split())
            if not page.chars[node]:
                page.counted[node] = int(COUNTED.match(plain) is not None)
            page.chars[node] += len(plain)
            page.marks[node] += sum(text.count(c) for c in ".,;:!?")
        run.clear()
        if any(not t.isspace() for _, t in parts):
            page.blocks.append(parts)

    def push(tag: str, node: int) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag in SECTIONING:
            sections.append(len(stack))
        stack.append((tag, node))

    def pop_to(k: int) -> None:
        nonlocal links
        if any(t in BLOCK for t, _ in stack[k:]):
            flush()
        for t, _ in reversed(stack[k:]):
            places[t].pop()
            if t in SECTIONING:
                sections.pop()
            links -= t == "a"
        del stack[k:]

    def last(tags) -> int:
        """Place of the innermost open element of some tags; 0 if none is open. No walk: each tag knows its own."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags: set[str] | frozenset[str], border: set[str] | frozenset[str]) -> None:
        while (k := last(tags)) > last(border):
            pop_to(k)

    source = source or ""
    at, size = 0, len(source)
    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            text = html.unescape(source[at:lt])
            run.append((stack[-1][1], text))
            if links:
                page.link_chars[stack[-1][1]] += len(text)
        if lt == size:
            break
        m = TAG.match(source, lt)
        if not m:
            run.append((stack[-1][1], "<"))
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            k = last((tag,))
            if k and (tag in BLOCK or not sections or k > sections[-1]):
                pop_to(k)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
            at = end.end() if end else size
            continue
        if tag in ENDS_P:
            close({"p"}, P_BORDER)
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag == "br":
            run.append((stack[-1][1], " "))
        names, label = (), page.label[stack[-1][1]]
        if m[3].strip():
            found = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(m[3])}
            names = tuple(p.lower() for k in ("class", "id", "role") for p in NAME_PART.findall(found.get(k, "")))
            label = int(found.get(DATA_CONTENT, label) == "1") if DATA_CONTENT in found else label
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        node = page.add(stack[-1][1], tag, names, label) if tag in BLOCK or names else stack[-1][1]
        push(tag, node)
        links += tag == "a"
    pop_to(1)
    flush()
    return page


def _bin(value: float, borders: tuple[float, ...]) -> int:
    return sum(value >= b for b in borders)


def _code(name: str) -> int:
    """Feature number of a name."""
    return zlib.crc32(name.encode()) % FEATURES


@dataclass
class Shape:
    """What surrounds each node of a page: sums over its subtree, the text before it, and how often its kind repeats beside it."""

    chars: list[int]
    links: list[int]
    texts: list[int]
    before: list[int]
    alike: list[int]
    children: list[int]
    counted: list[int]

    @classmethod
    def of(cls, page: Page) -> Shape:
        n = len(page.parent)
        chars, links, texts, children, counted = list(page.chars), list(page.link_chars), [int(c > 0) for c in page.chars], [0] * n, list(page.counted)
        before, so_far = [0] * n, 0
        kinds: dict[tuple, int] = {}
        for i in range(n):
            before[i] = so_far
            so_far += page.chars[i]
            kind = (page.parent[i], page.tag[i], page.names[i])
            kinds[kind] = kinds.get(kind, 0) + 1
        for i in range(n - 1, 0, -1):
            up = page.parent[i]
            chars[up] += chars[i]
            links[up] += links[i]
            texts[up] += texts[i]
            children[up] += 1
            if up == i - 1 and not page.chars[up]:  # its first child tells for it
                counted[up] = counted[i]
        return cls(chars, links, texts, before, [kinds[page.parent[i], page.tag[i], page.names[i]] for i in range(n)], children, counted)


def node_features(page: Page, i: int, shape: Shape) -> list[int]:
    chars, linked, tag = page.chars[i], page.link_chars[i], page.tag[i]
    whole, below, up = max(1, shape.chars[0]), shape.chars[i], max(page.parent[i], 0)
    leaf = "t" if chars else "n"
    names = [f"tag={tag}", f"tag={tag},{leaf}", f"tag={tag},named={bool(page.names[i])}", f"chars={_bin(chars, (1, 20, 60, 150, 400))}"]
    if chars:
        names += [f"links={_bin(linked / chars, (0.01, 0.3, 0.7))}", f"marks={_bin(100 * page.marks[i] / chars, (0.5, 1, 2, 4))}"]
    if tag not in BLOCK:  # an inline element is a part of its block
        names.append("inline")
    elif below:
        share, dense = _bin(below / whole, (0.03, 0.15, 0.35, 0.6)), _bin(shape.links[i] / below, (0.05, 0.3, 0.6))
        each, place = _bin(below / max(1, shape.texts[i]), (12, 30, 70, 150)), _bin(shape.before[i] / whole, (0.01, 0.15, 0.5, 0.85))
        of_parent = _bin(below / max(1, shape.chars[up]), (0.1, 0.4, 0.7))
        kind = "sec" if tag in SECTIONING else "div" if tag == "div" else "list" if tag in ("ul", "ol", "dl", "table") else leaf
        names += [
            f"share={share}", f"dense={dense},{kind}", f"each={each},{kind}", f"place={place},{kind}", f"ofparent={of_parent},{kind}", f"share={share},dense={dense}", f"each={each},dense={dense},{kind}",
            f"alike={_bin(shape.alike[i], (2, 3, 6))},{kind}", f"children={_bin(shape.children[i], (1, 2, 4))},{kind}",
            f"counted={shape.counted[i]},{kind},{place > 1}",
        ]
    else:
        names.append("below=0")
    names += [f"name={n}" for n in page.names[i]]
    return [_code(n) for n in names]


def edge_kind(tag: str, chars: int) -> int:
    """0 sectioning, 1 div, 2 block with text of its own, 3 other."""
    return 0 if tag in SECTIONING else 1 if tag == "div" else 2 if chars else 3


@dataclass
class Forest:
    """Nodes of many pages in arrays, by depth, so that each level is a slice; node 0 of each page is its root."""

    parent: np.ndarray
    kind: np.ndarray
    feature: np.ndarray
    owner: np.ndarray
    label: np.ndarray
    place: np.ndarray  # of each node in page order
    borders: np.ndarray  # of the levels

    @classmethod
    def of(cls, pages: list[Page]) -> Forest:
        parent, depth, kind, feature, owner, label = [], [], [], [], [], []
        for page in pages:
            base, shape = len(parent), Shape.of(page)
            for i, p in enumerate(page.parent):
                parent.append(base + p if p >= 0 else -1)
                depth.append(depth[base + p] + 1 if p >= 0 else 0)
                kind.append(edge_kind(page.tag[i], page.chars[i]))
                found = node_features(page, i, shape)
                feature += found
                owner += [base + i] * len(found)
                label.append(page.label[i])
        parent, depth, kind, feature, owner, label = (np.array(x, dtype=np.int64) for x in (parent, depth, kind, feature, owner, label))
        order = np.argsort(depth, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        above = np.where(parent < 0, -1, place[parent]) if len(parent) else parent
        borders = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if len(order) else np.zeros(1, np.int64)
        return cls(above[order], kind[order], feature, place[owner] if len(owner) else owner, label[order], place, borders)

    def levels(self) -> list[tuple[slice, slice, np.ndarray]]:
        """(nodes, nodes of the level above, parents' places in that level) of each level below the roots."""
        b = self.borders
        return [(slice(b[k], b[k + 1]), slice(b[k - 1], b[k]), self.parent[b[k] : b[k + 1]] - b[k - 1]) for k in range(1, len(b) - 1)]


@dataclass
class TreeModel:
    own: np.ndarray  # FEATURES: log potential of content
    pair: np.ndarray  # edge kind x parent state x child state

    def marginals(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """(content marginal of each node, joint marginals of each node and its parent, parent state first)."""
        n = len(forest.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(forest.owner, weights=self.own[forest.feature], minlength=n)
        below, up = own.copy(), np.zeros((n, 2))
        levels, edge = forest.levels(), self.pair[forest.kind]
        for nodes, above, at in reversed(levels):
            both = edge[nodes] + below[nodes][:, None, :]
            up[nodes] = np.logaddexp(both[:, :, 0], both[:, :, 1])
            for state in (0, 1):
                below[above, state] += np.bincount(at, weights=up[nodes, state], minlength=above.stop - above.start)
        whole, joint = below.copy(), np.zeros((n, 2, 2))
        for nodes, above, at in levels:
            outside = whole[above][at] - up[nodes]
            joint[nodes] = both = outside[:, :, None] + edge[nodes] + below[nodes][:, None, :]
            whole[nodes] = np.logaddexp(both[:, 0], both[:, 1])
        joint = np.exp(joint - np.logaddexp(whole[:, 0], whole[:, 1])[:, None, None])
        return 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -50, 50))), joint

    @classmethod
    def fit(cls, pages: list[Page], steps: int = STEPS, rate: float = 0.3, decay: float = 1e-3) -> TreeModel:
        """Maximises the pages' likelihood: gradients are counts under the labels less counts under the model."""
        model, forest = cls(np.zeros(FEATURES), np.zeros((4, 2, 2))), Forest.of(pages)
        child = np.flatnonzero(forest.parent >= 0)
        seen_own = np.bincount(forest.feature, weights=forest.label[forest.owner], minlength=FEATURES)
        of_kind = [child[forest.kind[child] == k] for k in range(4)]
        seen_pair = np.array([np.bincount(2 * forest.label[forest.parent[c]] + forest.label[c], minlength=4).reshape(2, 2) for c in of_kind], float)
        n = max(1, len(pages))
        moments = [np.zeros(FEATURES), np.zeros((4, 2, 2))]
        for _ in range(steps):
            p, joint = model.marginals(forest)
            g_own = (seen_own - np.bincount(forest.feature, weights=p[forest.owner], minlength=FEATURES)) / n - decay * model.own
            g_pair = (seen_pair - np.array([joint[c].sum(axis=0) for c in of_kind])) / n - decay * model.pair
            for value, g, m in zip((model.own, model.pair), (g_own, g_pair), moments, strict=True):
                m += g * g
                value += rate * g / (np.sqrt(m) + 1e-8)
        return model


def chosen_nodes(page: Page, marginals: np.ndarray) -> np.ndarray:
    """Nodes that are content: marginals of one half or more.

    Where no text has that, but some has ``LEAST_CONTENT``, the page is judged given that it has an article at all: its nodes'
    marginals are taken over the largest of its texts.
    """
    best = max((marginals[i] for i, c in enumerate(page.chars) if c), default=0.0)
    return marginals >= (0.5 if best >= 0.5 or best < LEAST_CONTENT else 0.5 * best)


def _text_of(page: Page, content: np.ndarray) -> str:
    blocks = (" ".join("".join(t for node, t in parts if content[node]).split()) for parts in page.blocks)
    return "\n".join(b for b in blocks if b)


def extract_texts(model: TreeModel, sources: list[str | None]) -> list[str]:
    pages = [parse(s) for s in sources]
    forest = Forest.of(pages)
    p = model.marginals(forest)[0][forest.place]
    cuts = np.cumsum([len(page.parent) for page in pages])[:-1]
    return [_text_of(page, chosen_nodes(page, own)) for page, own in zip(pages, np.split(p, cuts), strict=True)]


def _extract_batches(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("html")
            first, last, size, sources = 0, 0, 0, []
            for value in batch.column(place):
                sources.append(value.as_py())
                size += len(sources[-1] or "")
                last += 1
                if size < BLOCK_CHARS and last < batch.num_rows:
                    continue
                texts = extract_texts(broadcast.value, sources)
                rest = batch.slice(first, last - first)
                columns = [c for k, c in enumerate(rest.columns) if k != place]
                names = [f.name for k, f in enumerate(rest.schema) if k != place]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*names, "text"])
                first, size, sources = last, 0, []

    return run


def extract(pages: DataFrame, model: TreeModel, *keep: str) -> DataFrame:
    """``keep`` columns of every row and the main text."""
    broadcast = pages.sparkSession.sparkContext.broadcast(model)
    chosen = pages.select(*keep, F.col("html").cast("string").alias("html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "html")
    return chosen.mapInArrow(_extract_batches(broadcast), ", ".join(filter(None, (fields, "text string"))))


def _fit_group(rows: pd.DataFrame) -> pd.DataFrame:
    model = TreeModel.fit([parse(s) for s in sorted(rows["html"])])
    return pd.DataFrame({"own": [model.own.tobytes()], "pair": [model.pair.tobytes()]})


def train(labelled: DataFrame, max_pages: int = TRAIN_PAGES) -> TreeModel:
    """From a bounded, hash-chosen sample of pages whose elements carry ``data-content``."""
    labelled = labelled.select("html").filter("html IS NOT NULL")
    share = min(1.0, max_pages / max(1, labelled.count()))
    sample = labelled.filter(F.pmod(F.xxhash64("html"), F.lit(1_000_003)) < 1_000_003 * share)
    fitted = sample.groupBy(F.lit(0).alias("one")).applyInPandas(_fit_group, "own binary, pair binary").first()
    if fitted is None:
        return TreeModel(np.zeros(FEATURES), np.zeros((4, 2, 2)))
    return TreeModel(np.frombuffer(fitted["own"]), np.frombuffer(fitted["pair"]).reshape(4, 2, 2))


#: What the example pages call their parts.
CONTENT_NAMES = "content article post entry main story text body page-content post-body article-text entry-content prose".split()
CLUTTER = {
    "nav": "nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs pagination tabs toc".split(),
    "header": "header masthead site-header top topbar branding banner hero logo".split(),
    "footer": "footer site-footer bottom copyright colophon legal imprint".split(),
    "aside": "sidebar aside rail widget related recommended trending popular more-stories tags".split(),
    "notice": "notice cookie cookies consent gdpr alert warning message popup modal overlay paywall".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsense".split(),
    "form": "form newsletter subscribe signup login search search-form contact-form survey".split(),
    "comment": "comment comments discussion replies reply responses disqus respond thread opinions reviews feedback".split(),
    "share": "share social sharing share-buttons follow".split(),
}


def example_pages(n: int = EXAMPLES, seed: int = 11) -> list[str]:
    """Labelled pages made up from templates; words are random syllables."""
    rng = random.Random(seed)
    syllables = "an be co da el fi go hu in jo ka le mo nu or pa qu re si ta un ve wi xo ya zu é ß ñ".split()

    def words(lo: int, hi: int) -> str:
        made = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(lo, hi))]
        for k in range(0, len(made), 9):
            made[k] = made[k].capitalize()
            if k:
                made[k - 1] += rng.choice([".", ",", "."])
        return " ".join(made)

    def noise() -> str:
        return rng.choice(["", "", f' id="{words(1, 1)}"', f' class="{words(1, 1)} {words(1, 1)}"', f' class="c{rng.randint(1, 99)}"'])

    plain = False  # whether the page's names say nothing, so that only shape and tags tell

    def named(kind: str) -> str:
        if plain:
            return noise()
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(CLUTTER[kind])}"'

    def link_list(tag: str = "ul") -> str:
        return f"<{tag}>" + "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(rng.randint(2, 8))) + f"</{tag}>"

    def paragraph(sizes: tuple = ((1, 4), (8, 40), (30, 120), (60, 250))) -> str:
        text = words(*rng.choice(sizes))
        if rng.random() < 0.1:
            text = text.replace(" ", rng.choice([" | ", "!! ", "*** ", " "])) if rng.random() < 0.6 else " ".join([text.split()[0]] * rng.randint(2, 60))
        return rng.choice([f"<p{noise()}>{text}</p>"] * 6 + [f"<p>{text} <a{noise()} href='/x'>{words(1, 3)}</a> {words(3, 20)}.</p>", f"<p>{words(2, 9)} <span{noise()}>{words(1, 2)}</span> {text}</p>", f"<p><b>{text}<br>", f"<p>{text}", f"<p><em>{text}</em></p>"])

    def heading() -> str:
        tag = rng.choice(["h2", "h3", "h3", "h4"])
        return f"<{tag}>{words(1, 3)}</{tag}>"

    def counted_heading() -> str:
        n, tag = rng.randint(1, 240), rng.choice(["h2", "h3", "h4"])
        return rng.choice([heading(), f"<{tag}>{n} {words(1, 1)}</{tag}>", f"<{tag}>{words(1, 1).strip('.,')} ({n})</{tag}>"])

    def clutter(kind: str) -> str:
        if plain and kind in ("ad", "notice", "header"):
            kind = rng.choice(["nav", "share", "form"])  # text in a box without a name is not told from an article
        tag = {"nav": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "aside", "div", "section"], "form": ["form", "form", "div"]}.get(kind, ["div", "div", "section", "aside", "p"])
        tag = rng.choice(tag)
        attribute = "" if tag in {"nav", "footer", "header", "aside", "form"} and rng.random() < 0.5 else named(kind)
        one = noise() if plain else " class='comment'"
        inner = {
            "nav": lambda: link_list(),
            "header": lambda: rng.choice([f"<a href='/'>{words(1, 2)}</a>", f"<h1>{words(1, 3)}</h1><p>{words(3, 9)}</p>", link_list(), words(2, 8)]),
            "footer": lambda: rng.choice([f"&copy; {words(1, 2)}.example &middot; {words(4, 14)}.", f"<p>{words(5, 25)}</p>" + link_list(), f"<p>&copy; {words(1, 4)}</p>"]),
            "aside": lambda: heading() + (link_list() if plain else rng.choice([link_list(), paragraph(), f"<p>{words(10, 40)}</p><p>{words(10, 40)}</p>"])),
            "notice": lambda: rng.choice([words(5, 25), f"<p>{words(8, 30)}</p><button>{words(1, 2)}</button>"]),
            "ad": lambda: rng.choice([words(3, 25), f"<a href='/'>{words(3, 9)}</a>", f"<p>{words(5, 25)}</p>"]),
            "form": lambda: f"<label>{words(1, 3)}</label><input name='q'><button>{words(1, 2)}</button>" + rng.choice(["", f"<p>{words(5, 20)}</p>", f"<select><option>{words(1, 2)}<option>{words(1, 2)}</select>"]),
            "comment": lambda: counted_heading() + "".join(rng.choice([f"<div{one}><b>{words(1, 2)}</b><p>{words(5, 50)}</p></div>", f"<article{one}><p>{words(5, 50)}</p></article>", f"<ol><li><p>{words(5, 40)}</p></li></ol>", f"<p>{words(2, 30)}.</p>"]) for _ in range(rng.randint(1, 4))),
            "share": lambda: rng.choice([link_list(), f"<a href='/'>{words(1, 1)}</a> <a href='/'>{words(1, 1)}</a>"]),
        }[kind]()
        return f'<{tag}{attribute} {DATA_CONTENT}="0">{inner}</{tag}>'

    def article() -> str:
        parts = [rng.choice([f"<h1>{words(3, 12)}</h1>", f"<header><h1>{words(3, 12)}</h1></header>", f"<h2>{words(3, 10)}</h2>", ""])]
        sizes = rng.choice([((1, 4), (8, 40), (30, 120), (60, 250)), ((1, 3), (1, 6)), ((1, 2), (20, 200)), ((30, 200),)])
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 12, 24])):
            extra = [f"<h2>{words(2, 7)}</h2>", "<ul>" + "".join(f"<li>{words(3, 20)}</li>" for _ in range(4)) + "</ul>", f"<blockquote><p>{words(8, 40)}</p></blockquote>", f"<pre>{words(4, 30)}</pre>", f"<figure><img src='x'><figcaption>{words(3, 14)}</figcaption></figure>", f"<table><tr><td>{words(1, 4)}<td>{words(1, 4)}</table>", f"<div>{words(10, 60)}</div>", f"<section><h3>{words(2, 6)}</h3>{paragraph()}</section>"]
            parts.append(paragraph(sizes) if rng.random() < 0.75 else rng.choice(extra))
            if rng.random() < 0.08:
                parts.append(clutter(rng.choice(["ad", "share", "notice", "aside", "form"])))
        if rng.random() < 0.25:
            parts.append(clutter(rng.choice(["comment", "comment", "nav", "footer", "share", "form"])))
        if rng.random() < 0.3:  # the body in wrappers of its own
            parts = [parts[0], f'<div{rng.choice(["", noise()])} class="{rng.choice(CONTENT_NAMES)}">', *parts[1:], "</div>"]
        if plain:
            tag, attribute = rng.choice([("div", noise()), ("div", noise()), ("section", noise()), ("main", ""), ("article", "")])
            return f'<{tag}{attribute} {DATA_CONTENT}="1">{"".join(parts)}</{tag}>'
        tag, attribute = rng.choice([("article", ""), ("article", ""), ("article", noise()), ("article", f' class="{rng.choice(CONTENT_NAMES)}"'), ("main", ""), ("div", f' class="{rng.choice(CONTENT_NAMES)}"'), ("div", f' id="{rng.choice(CONTENT_NAMES)}"'), ("section", f' class="{rng.choice(CONTENT_NAMES)}"')])
        return f'<{tag}{attribute} {DATA_CONTENT}="1">{"".join(parts)}</{tag}>'

    def columns(core: str, side: str) -> str:
        if rng.random() < 0.4:
            cells = [f"<td>{core}</td>", f'<td {DATA_CONTENT}="0">{side}</td>']
            rng.shuffle(cells)
            return f"<table><tr>{''.join(cells)}</tr></table>"
        return f'<div{noise()}><div{noise()}>{core}</div><div{noise()} {DATA_CONTENT}="0">{side}</div></div>'

    def page(shaped: bool) -> str:
        nonlocal plain
        plain = shaped
        head = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{words(2, 9)}</title><style>p{{}}</style><script>var t='</p>';</script></head>"
        before = [clutter(k) for k in ("header", "nav", "notice", "ad", "form", "share") if rng.random() < 0.5]
        after = [clutter(k) for k in ("comment", "aside", "ad", "nav", "form", "share", "footer") if rng.random() < 0.5]
        rng.shuffle(before)
        core = "".join(before[:2]) + article() + "".join(after[:2])
        if plain and rng.random() < 0.15:  # a page that is nearly nothing but its article
            before, after, core = [], [], article()
        if plain and rng.random() < 0.5:
            core = columns(core, rng.choice([link_list(), f"<h3>{words(1, 3)}</h3>" + link_list(), "".join(f'<a href="/{words(1, 1)}">{words(1, 3)}</a>' for _ in range(rng.randint(3, 9)))]))
        elif plain and rng.random() < 0.5:  # short and bare: some paragraphs in a box or cell, beside links
            outer, inner = rng.choice([("div", "div"), ("div", "div"), ("div", "section"), ("tr", "td")])
            side = rng.choice([link_list(), "".join(f'<a href="/{words(1, 1)}">{words(1, 2)}</a> ' for _ in range(rng.randint(2, 7)))])
            boxes = [f'<{inner}{noise()} {DATA_CONTENT}="1">{"".join(f"<p>{words(6, 40)}.</p>" for _ in range(rng.randint(1, 5)))}</{inner}>', f'<{inner}{noise()} {DATA_CONTENT}="0">{side}</{inner}>']
            rng.shuffle(boxes)
            core = f"<{outer}{noise()}>{''.join(boxes)}</{outer}>"
            core = f"<table>{core}</table>" if outer == "tr" else core
            before, after = ([], []) if rng.random() < 0.5 else (before, after)
        elif plain and rng.random() < 0.6:
            core = f"<main {DATA_CONTENT}=\"1\"><h1>{words(2, 8)}</h1>{''.join(paragraph() for _ in range(rng.randint(1, 8)))}{clutter('comment')}</main>"
        wrapped = rng.choice([core, f"<main>{core}</main>", f"<div{noise()}>{core}</div>", f'<div class="wrapper container"><div class="row">{core}</div></div>'])
        return f"{head}<body{noise()}>{''.join(before[2:])}{wrapped}{''.join(after[2:])}</body></html>"

    return [page(k % 2 == 1) for k in range(n)]


def example_frame(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    return spark.createDataFrame([(p,) for p in example_pages(n)], "html string")


def stored_model() -> TreeModel:
    """The model of the weights file, so that no run fits it again."""
    held = json.loads(_weights_text())
    own = np.zeros(FEATURES)
    own[[int(k) for k in held["own"]]] = list(held["own"].values())
    return TreeModel(own, np.array(held["pair"]))


def _weights_text() -> str:
    import importlib.resources

    return importlib.resources.files("lectern.llm").joinpath(WEIGHTS.name).read_text()


def op5_html_extract(spark, sf_dir: str) -> DataFrame:
    found = extract(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")), stored_model(), "page_id", "url")
    return found.withColumn("n_chars", F.length("text").cast("long"))
