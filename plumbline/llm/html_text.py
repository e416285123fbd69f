"""Main text of web pages by a tree-structured graphical model over the DOM.

Block elements and runs of text are the nodes. Each node is content or not: potentials between parent and child, and
of a node's tag, class words and those of the two elements around it, length and link share, are estimated from labelled
pages. What a list or table is told from is the share of links in it, and a run of text is judged among runs in elements
of its kind, so that short items of an article's list are not taken for a menu. Sum-product messages, up and then down
the tree, give each run of text its probability of being content; runs at 0.5 or more are kept. Where none is, those are
that no tag, class word or link speaks against.

A null or empty page gives an empty text; pages of any length are read whole. Broken markup is read as browsers do in
simple cases: unclosed elements end with their parents or where the next of their kind begins, seen or not, and a quote
opens a value only behind an equals sign. An unseen element that ends nowhere on the page hides nothing. Repeated rows
get equal texts; other columns are kept, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from plumbline.llm import labelled_pages

# Element names of HTML, by how they are laid out.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("audio button canvas datalist iframe noscript object option script select style svg template textarea title video".split())
RAW = frozenset("iframe noscript script style textarea title".split())
ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"}
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("dd dl dt li ol table tbody td th tr ul".split())
KINDS = {"li": "l", "dd": "l", "dt": "l", "td": "c", "th": "c", "p": "p", "blockquote": "p", "figcaption": "f"} | {f"h{i}": "h" for i in range(1, 7)}
HOLDERS = frozenset("article aside blockquote body dl div footer form header html main nav ol section table tbody td th thead ul".split())

PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)|([^<]+|<)", re.DOTALL)
NAMED = re.compile(r"""\b(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
MAY_HIDE = re.compile(r"hidden|style", re.IGNORECASE)
ASIDE = re.compile(r"""/\*.*?(?:\*/|\Z)|"[^"]*"|'[^']*'|\([^)]*\)""", re.DOTALL)  # in CSS: no place for declarations
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
UNQUOTED = re.compile(r"""=\s*[^\s"'>]+\Z""")
UNSEEN_END = re.compile(rf"</({'|'.join(sorted(UNSEEN))})", re.IGNORECASE)

#: Elements up to which class words are taken from around a node; elements that stand beside an article.
AROUND, BESIDE = 2, frozenset(("<nav", "<aside", "<footer", "<header", "<form", "<dialog", "<menu"))


class Node:
    """A block element, or (tag "") a run of text in one; parents come before children."""

    __slots__ = ("children", "features", "label", "linked", "parent", "text")

    def __init__(self, parent: int, features: list[str], label: int):
        self.parent, self.features, self.label = parent, features, label
        self.text, self.linked, self.children = "", 0, []


def parse(page: str) -> list[Node]:
    """The page's nodes in document order; the first is the root. label: of data-main, inherited, else 0."""
    nodes = [Node(-1, ["<html"], 0)]
    last_end = {m[1].lower(): m.start() for m in UNSEEN_END.finditer(page)}
    open_tags: list[tuple[str, int]] = [("html", 0)]  # (tag, node that holds its text; -1: it is not seen)
    run: list[str] = []
    state = {"links": 0, "linked": 0}

    def end_run() -> None:
        text = " ".join(html.unescape("".join(run)).split()) if run else ""
        run.clear()
        if text:
            at = next(at for _, at in reversed(open_tags) if at >= 0)
            node = Node(at, [], nodes[at].label)
            node.text, node.linked = text, state["linked"]
            nodes.append(node)
        state["linked"] = 0

    def close(upto: int) -> None:
        if any(tag in BLOCKS and at >= 0 for tag, at in open_tags[upto:]):
            end_run()
        state["links"] -= sum(tag == "a" for tag, _ in open_tags[upto:])
        del open_tags[upto:]

    at, size = 0, len(page)
    while at < size:
        m = PIECE.match(page, at)
        if not m:  # an unclosed quote: the sign is text
            if open_tags[-1][1] >= 0:
                run.append(page[at])
            at += 1
            continue
        at = m.end()
        text, name = m[4], m[2]
        if text is not None:
            if open_tags[-1][1] < 0:
                continue
            run.append(text)
            if state["links"] > 0:
                state["linked"] += len(text)
            continue
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            for i in range(len(open_tags) - 1, 0, -1):
                if open_tags[i][0] == name:
                    close(i)
                    break
                if name not in BLOCKS and name not in UNSEEN and (open_tags[i][0] in HOLDERS or open_tags[i][0] in UNSEEN):
                    break
            continue
        attributes = m[3]
        if name in RAW and not closed(attributes):
            end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        if name == "template":
            at = after(page, name, at)
            continue
        if name == "head":  # its tags may be left out, and what is not seen in it says so by itself
            continue
        if name in ENDS_P:
            ends(open_tags, close, ("p",))
        elif name in SIBLINGS:
            if name != "option":
                ends(open_tags, close, ("p",))
            ends(open_tags, close, SIBLINGS[name])
            if name == "tr":  # after a cell, its row
                ends(open_tags, close, ("tr",))
        unseen = name in UNSEEN
        if unseen and name not in RAW and name != "option" and last_end.get(name, -1) < at:
            continue
        if open_tags[-1][1] < 0 or unseen or attributes and hides(attributes):
            if name not in VOID and not closed(attributes):
                state["links"] += name == "a"
                open_tags.append((name, -1))
            continue
        if name == "br" or name == "hr":
            run.append(" ")
        if name in BLOCKS:
            end_run()
            if name in VOID or name in ("html", "body") and any(tag == name for tag, _ in open_tags):
                continue
            parent = open_tags[-1][1]
            node = Node(parent, ["<" + name], nodes[parent].label)
            if attributes:
                for key, *values in NAMED.findall(attributes):
                    value = next((v for v in values if v), "")
                    if key.lower() == "data-main":
                        node.label = int(value == "1")
                    else:
                        node.features += {"." + w.lower() for w in WORD.findall(value) if len(w) > 1}
            nodes.append(node)
            open_tags.append((name, len(nodes) - 1))
        elif name not in VOID and not closed(attributes):
            state["links"] += name == "a"
            open_tags.append((name, open_tags[-1][1]))
    end_run()
    for i, node in enumerate(nodes[1:], 1):
        nodes[node.parent].children.append(i)
    describe(nodes)
    return nodes


def describe(nodes: list[Node]) -> None:
    """Adds the features that need a node's surroundings or what is in it."""
    size, linked = [len(n.text) for n in nodes], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        size[nodes[i].parent] += size[i]
        linked[nodes[i].parent] += linked[i]
    words = [[f for f in n.features if f[0] == "."] for n in nodes]
    tags = [n.features[0][1:] if n.features else "" for n in nodes]
    for i, node in enumerate(nodes[1:], 1):
        if node.text:
            node.features = text_features(node, KINDS.get(tags[node.parent], "d"))
        elif tags[i] in LISTS:
            node.features[0] += f"|{share_class(linked[i], size[i])}"
        around, at = set(), node.parent
        for _ in range(AROUND):
            if at > 0 and tags[at] not in ("html", "body"):
                around.update("^" + w[1:] for w in words[at])
                at = nodes[at].parent
        node.features += sorted(around)


def share_class(linked: int, size: int) -> int:
    share = linked / max(1, size)
    return 0 if share < 0.1 else 1 if share < 0.6 else 2


def closed(attributes: str) -> bool:
    """Of a slash at the end of a tag that is not part of an unquoted value."""
    return attributes.endswith("/") and not UNQUOTED.search(attributes)


def hides(attributes: str) -> bool:
    """Of an attribute `hidden` (but for until-found), or a style that ends up with display: none."""
    if not MAY_HIDE.search(attributes):
        return False
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    if found.get("hidden", "until-found").strip().lower() != "until-found":
        return True
    display, firm = "", False
    for declaration in ASIDE.sub(" ", found.get("style", "")).lower().split(";"):
        name, _, value = declaration.partition(":")
        value, _, important = value.partition("!")
        if name.strip() == "display" and value.strip() and (important.strip() == "important" or not firm):
            display, firm = value.strip(), important.strip() == "important"
    return display == "none"


def after(page: str, name: str, at: int) -> int:
    """Where the element called name, opened before at, ends; nested ones of its name are passed."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(name)}\b[^>]*>", re.IGNORECASE).finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return len(page)


def ends(open_tags: list, close, names: tuple[str, ...]) -> None:
    """Close the innermost open element of these names that no holder of blocks or unseen element stands between."""
    for i in range(len(open_tags) - 1, 0, -1):
        if open_tags[i][0] in names:
            close(i)
            return
        if open_tags[i][0] in HOLDERS or open_tags[i][0] in UNSEEN and open_tags[i][0] != "option":
            return


def text_features(node: Node, kind: str) -> list[str]:
    """Of a run in an element of a kind: how many words, how much of it links and how it ends, taken together."""
    words = min(5, int(math.log2(node.text.count(" ") + 1)))
    links = share_class(node.linked, len(node.text))
    stop = int(node.text[-1] in ".!?\"'»”…:。！？")
    return [f"{kind}{links}{words}{stop}"] + ["©"] * ("©" in node.text)


class Model(NamedTuple):
    """edge[is text][parent][child] and emit[feature] = (if not content, if content), as probabilities."""

    edge: tuple
    emit: dict[str, tuple[float, float]]


def train(pages: Iterable[str]) -> Model:
    """Potentials from pages whose elements say data-main="1" (content from here down) or "0" (not)."""
    edges, features, seen = Counter(), Counter(), Counter()
    for page in pages:
        nodes = parse(page)
        for node in nodes[1:]:
            edges[bool(node.text), nodes[node.parent].label, node.label] += 1
            seen[bool(node.text), node.label] += 1
            features.update((bool(node.text), node.label, f) for f in node.features)
    edge = tuple(tuple(tuple((edges[t, p, c] + 0.5) / (edges[t, p, 0] + edges[t, p, 1] + 1) for c in (0, 1)) for p in (0, 1)) for t in (False, True))
    emit = {f: tuple((features[t, y, f] + 0.5) / (seen[t, y] + 1) for y in (0, 1)) for t, _, f in features}
    return Model(edge, emit)


def marginals(nodes: list[Node], model: Model) -> list[float]:
    """Each node's probability of being content: sum-product messages from the leaves to the root and back."""
    n = len(nodes)
    up, message, emit = [(1.0, 0.0)] * n, [(1.0, 1.0)] * n, model.emit
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        a = b = 1.0
        for f in node.features:
            if f in emit:
                x, y = emit[f]
                a, b = a * x, b * y
                if a + b < 1e-200:
                    a, b = a * 1e200, b * 1e200
        for c in node.children:
            x, y = message[c]
            a, b = a * x, b * y
            total = a + b
            a, b = a / total, b / total
        if i == 0:
            b = 0.0  # the root is not content
        total = a + b
        up[i] = a, b = a / total, b / total
        (n0, n1), (c0, c1) = model.edge[bool(node.text)]
        x, y = n0 * a + n1 * b, c0 * a + c1 * b
        message[i] = x / (x + y), y / (x + y)
    belief = [up[0]] * n
    for i in range(1, n):
        node = nodes[i]
        pa_, pb = belief[node.parent]
        x, y = message[i]
        qa, qb = pa_ / x, pb / y  # the parent's belief without this child
        (n0, n1), (c0, c1) = model.edge[bool(node.text)]
        a, b = up[i][0] * (n0 * qa + c0 * qb), up[i][1] * (n1 * qa + c1 * qb)
        belief[i] = a / (a + b), b / (a + b)
    return [b for _, b in belief]


@lru_cache(1)
def default_model() -> Model:
    return train(labelled_pages.pages())


def main_text(page: str | None, model: Model) -> str:
    if not page:
        return ""
    nodes = parse(page)
    chances = marginals(nodes, model)
    kept = [i for i, n in enumerate(nodes) if n.text and chances[i] >= 0.5]
    return "\n".join(nodes[i].text for i in kept or unopposed(nodes, model))


def unopposed(nodes: list[Node], model: Model) -> list[int]:
    """The runs of text that no tag, class word or links around them speak against; for pages without anything else."""
    against = [False]
    for node in nodes[1:]:
        known = [model.emit[f] for f in node.features if f in model.emit and f[0] == "."]
        named = bool(node.features) and node.features[0].split("|")[0] in BESIDE
        against.append(against[node.parent] or named or any(a > 3 * b for a, b in known) or "©" in node.features or bool(node.text) and 2 * node.linked > len(node.text))
    return [i for i, n in enumerate(nodes) if n.text and not against[i]]


def extract(pages: DataFrame, model: Model | None = None, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with out_col, the main text; it takes the place of a column of that name."""
    model = model or default_model()
    others = [f for f in pages.schema.fields if f.name != out_col]
    schema = T.StructType([*others, T.StructField(out_col, T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, model) for page in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return pages.select(*(f.name for f in others)).mapInArrow(read, schema)
