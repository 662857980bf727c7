"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements with its text blocks as leaves. Every node is content or
not; potentials join each node with its parent and with what is seen at it (tag, class and id
words, length, links, punctuation). Sum-product message passing, once upward and once downward,
gives each text block's content marginal. All potentials are relative frequencies counted on
labelled pages: HTML whose elements carry ``data-label="1"`` (content) or ``"0"``, inherited downward.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .textkernel import slices

# Element groups of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
INLINE |= frozenset("canvas math mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover noscript object semantics slot svg g text tspan".split())
UNSHOWN = ("script", "style", "title", "template", "textarea", "iframe", "annotation", "annotation-xml", "desc", "metadata")
CLOSED_BY_BLOCK = frozenset(["p"])
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSE_BARRIER = frozenset("ul ol dl table body html article section div main aside nav footer header form".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>|</([a-zA-Z][^\s>]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_LABEL = re.compile(r'data-label="([01])"')
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in UNSHOWN}


@dataclass
class Tree:
    """Parallel lists over the nodes, parents before children; ``text`` is None for an element."""

    parent: list[int] = field(default_factory=list)
    seen: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    label: list[int] = field(default_factory=list)


@functools.lru_cache(1 << 14)
def _element_evidence(tag: str, attributes: str) -> tuple[str, ...]:
    words = {w.lower() for _, v in _NAMES.findall(attributes) for w in _PART.findall(v)} if attributes else ()
    return (f"tag:{tag}", *(f"name:{w}" for w in sorted(words)))


def _text_evidence(text: str, linked: int) -> tuple[str, ...]:
    size = len(text)
    share = linked / size
    return (
        f"size:{min(4, int(math.log(size, 4)))}",
        "links:" + ("none" if share == 0 else "some" if share < 0.5 else "most"),
        f"stop:{text[-1] in '.!?:;…\"”'}",
    )


def parse(page: str) -> Tree:
    """The tree of a page: block elements, and leaves for the text between block boundaries (``br`` is one)."""
    tree = Tree([-1], [("tag:#page",)], [None], [0])
    stack = [("#page", 0)]
    pieces: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                at = stack[-1][1]
                tree.parent.append(at)
                tree.seen.append(_text_evidence(text, min(linked, len(text))))
                tree.text.append(text)
                tree.label.append(tree.label[at])
            linked = 0

    def close(tags: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return
            if stack[k][0] in CLOSE_BARRIER:
                return

    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        upto = m.start() if m else end
        if upto > at:
            piece = page[at:upto]
            pieces.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in INLINE:
                links += tag == "a"
                continue
            if tag in _ENDS:  # nothing of it shows, and it ends no block
                if not m[2].endswith("/"):
                    stop = _ENDS[tag].search(page, at)
                    at = stop.end() if stop else end
                continue
            flush()
            if tag in VOID:
                continue
            close(SAME_CLOSES.get(tag, ("p",)) if tag in SAME_CLOSES else ("p",))
            links = 0
            parent = stack[-1][1]
            own = _LABEL.search(m[2]) if "data-label" in m[2] else None
            tree.parent.append(parent)
            tree.seen.append(_element_evidence(tag, m[2]))
            tree.text.append(None)
            tree.label.append(int(own[1]) if own else tree.label[parent])
            if not m[2].endswith("/"):
                stack.append((tag, len(tree.parent) - 1))
        elif m[3]:
            tag = m[3].lower()
            if tag in INLINE:
                links = max(0, links - (tag == "a"))
                continue
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    links = 0
                    break
    flush()
    return tree


def _edge(tree: Tree, v: int) -> str:
    """The kind of a node's edge to its parent: a text, a part of the body, or an element further down."""
    if tree.text[v] is not None:
        return "text"
    return "part" if tree.seen[tree.parent[v]][0] == "tag:body" else "element"


@dataclass
class TreeModel:
    """Log evidence ratios by what is seen, and P(child is content | parent is content or not) by kind of edge."""

    evidence: dict[str, float]
    edges: dict[str, tuple[float, float]]

    def marginals(self, tree: Tree) -> list[float]:
        """P(content) of every node, by one upward and one downward pass over the tree."""
        n = len(tree.parent)
        weigh = self.evidence.get
        up = [math.exp(max(-60.0, min(60.0, sum(weigh(x, 0.0) for x in s)))) for s in tree.seen]
        message = [1.0] * n
        trans = [self.edges[_edge(tree, v)] for v in range(n)]
        for v in range(n - 1, 0, -1):
            if_not, if_so = trans[v]
            r = up[v]
            message[v] = (if_so * r + 1 - if_so) / (if_not * r + 1 - if_not)
            u = tree.parent[v]
            up[u] = min(1e30, max(1e-30, up[u] * message[v]))
        belief = [0.0] * n
        belief[0] = up[0] * 0.1
        for v in range(1, n):
            if_not, if_so = trans[v]
            rest = min(1e30, max(1e-30, belief[tree.parent[v]] / message[v]))
            belief[v] = min(1e30, max(1e-30, up[v] * (rest * if_so + if_not) / (rest * (1 - if_so) + 1 - if_not)))
        return [b / (1 + b) for b in belief]


def train(pages: list[str], smoothing: float = 0.5) -> TreeModel:
    """Count the potentials on labelled pages."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    total = [0, 0]
    pairs: Counter = Counter()
    for page in pages:
        tree = parse(page)
        for v in range(1, len(tree.parent)):
            label = tree.label[v]
            total[label] += 1
            seen[label].update(tree.seen[v])
            pairs[_edge(tree, v), tree.label[tree.parent[v]], label] += 1

    def ratio(x: str) -> float:
        return math.log((seen[1][x] + smoothing) / (total[1] + 2 * smoothing)) - math.log((seen[0][x] + smoothing) / (total[0] + 2 * smoothing))

    def chance(kind: str, parent: int) -> float:
        return (pairs[kind, parent, 1] + smoothing) / (pairs[kind, parent, 0] + pairs[kind, parent, 1] + 2 * smoothing)

    return TreeModel({x: ratio(x) for x in {*seen[0], *seen[1]}}, {k: (chance(k, 0), chance(k, 1)) for k in ("text", "part", "element")})


# Names that page parts go by, by part.
PARTS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav tabs pagination pager toc",
    "header": "header masthead top topbar branding logo hero",
    "footer": "footer bottom colophon copyright legal imprint",
    "aside": "sidebar aside side rail widget related recommended popular trending tags recent archive",
    "notice": "notice cookie cookies consent alert gdpr popup modal overlay warning message toast newsletter subscribe paywall",
    "ad": "ad ads advert adverts advertisement sponsored sponsor promo promotion banner adsense",
    "form": "form search login signup register contact",
    "comments": "comments comment commentlist reply replies discussion disqus respond feedback reviews",
    "share": "share social sharing follow buttons author byline meta",
}
BODY_NAMES = "content article post entry main story text body articlebody prose page copy"


def labelled_pages(count: int = 600, seed: int = 5) -> list[str]:
    """Labelled training pages of many layouts, from a seeded generator."""
    r = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(r.choice("bcdfghlmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi)))

    def sentence(lo: int = 1, hi: int = 25) -> str:
        return words(lo, hi).capitalize() + r.choice([".", ".", ".", "!", "?", ""])

    def prose() -> str:
        text = " ".join(sentence() for _ in range(r.choice([1, 1, 1, 2, 4, 8])))
        if r.random() < 0.15:
            text += f' <a href="/{words(1, 1)}">{words(1, 4)}</a> {words(1, 6)}.'
        return text

    def named(part: str) -> str:
        name = r.choice(PARTS[part].split())
        name = r.choice([name, name, f"{name}-{r.choice('box wrap list item area inner'.split())}", f"{r.choice('site page main'.split())}-{name}"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def part(kind: str) -> str:
        tags = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}
        plain = kind in tags and r.random() < 0.6
        tag = tags[kind] if plain else r.choice(["div", "div", "section"])
        head = f"<{tag}{'' if plain and r.random() < 0.6 else named(kind)} data-label=\"0\">"
        if kind == "nav" or kind == "aside" and r.random() < 0.5:
            inner = "<ul>" + "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(r.randint(2, 8))) + "</ul>"
        elif kind == "form":
            inner = f'<label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button>' + (f"<p>{prose()}</p>" if r.random() < 0.3 else "")
        elif kind == "comments":
            inner = f"<h3>{words(1, 3)}</h3>" + "".join(f'<div class="{r.choice(["comment", "reply", "item"])}"><p>{prose()}</p></div>' for _ in range(r.randint(1, 6)))
        elif kind == "header":
            inner = r.choice([f"<h1>{words(1, 4)}</h1>", f"<p>{words(1, 6)}</p>", words(1, 5)])
        else:
            inner = r.choice([prose(), f"<p>{prose()}</p>", f"<p>{prose()}</p><p>{prose()}</p>", f"<h4>{words(1, 4)}</h4><p>{prose()}</p>", f'{words(1, 4)} <a href="/x">{words(1, 3)}</a>'])
        return f"{head}{inner}</{tag}>"

    def article() -> str:
        out = [f"<h1>{words(1, 9)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            x = r.random()
            if x < 0.78:
                out.append(f"<p>{prose()}</p>")
            elif x < 0.84:
                level = r.randint(2, 4)
                out.append(f"<h{level}>{words(1, 7)}</h{level}>")
            elif x < 0.88:
                out.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif x < 0.91:
                out.append(f"<blockquote><p>{prose()}</p></blockquote>")
            elif x < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.95:
                out.append(f"<pre>{words(2, 12)}</pre>")
            elif x < 0.97:
                out.append(f"<div>{prose()}</div>")
            else:
                out.append(part(r.choice(["ad", "aside", "share", "notice", "form"])))
        if r.random() < 0.15:
            out.append(part("comments"))
        return "".join(out)

    pages = []
    for _ in range(count):
        name = r.choice(BODY_NAMES.split())
        kind = r.random()
        if kind < 0.5:
            main = f'<article data-label="1">{article()}</article>'
        elif kind < 0.65:
            main = f'<main data-label="1">{article()}</main>'
        elif kind < 0.92:
            main = f'<{r.choice(["div", "section"])} {r.choice(["class", "id"])}="{r.choice([name, "post-" + name, name + "-body"])}" data-label="1">{article()}</div>'
        else:
            main = None
        if main and r.random() < 0.3:
            main = f'<div class="{r.choice("container wrapper page layout row".split())}" data-label="{int(r.random() < 0.5)}">{main}</div>'
        before = [part(k) for k in ("notice", "header", "nav", "ad") if r.random() < 0.6]
        after = [part(k) for k in ("aside", "comments", "ad", "form", "footer") if r.random() < 0.5]
        if r.random() < 0.7:
            after.append(part("footer"))
        body = "".join(before) + (main if main else article()) + "".join(after)
        pages.append(f'<html><head><title>{words(1, 5)}</title></head><body data-label="{int(main is None)}">{body}</body></html>')
    return pages


@functools.lru_cache(1)
def default_model() -> TreeModel:
    return train(labelled_pages())


def main_text(page: str | None, model: TreeModel | None = None) -> str:
    """The content blocks of a page, in order, joined by newlines."""
    if not page:
        return ""
    tree = parse(page)
    chances = (model or default_model()).marginals(tree)
    return "\n".join(t for t, c in zip(tree.text, chances, strict=True) if t is not None and c > 0.5)


def extract_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    ``pages`` needs page_id, url and html. Null or empty html, or a page without content: empty
    text. Malformed markup is read as far as it goes. Repeated rows are extracted each; an empty
    table gives no rows. The whole html is used. One scan, no shuffle.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())  # as large as the training pages' vocabulary
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h, shared.value) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(run, schema)
