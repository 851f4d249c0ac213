"""HTML extraction by a tree-structured graphical model over the DOM."""

from __future__ import annotations

import math
import random
import re
import uuid
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

from pyspark.sql import DataFrame

from chorale.llm.common import built, map_rows

#: An attribute: its name, and a value in double quotes, in single quotes or in none. A quote anywhere else is a character like others.
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+)(?:>|\Z)"
    r"|([^<]++)|<",
    re.S,
)
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
NAMED = frozenset("class id role type".split())
WORD = re.compile(r"[a-z]+")
#: Kinds of elements in HTML.
INLINE = frozenset("a abbr acronym annotation b bdi bdo big cite code data del dfn em font i ins kbd mark math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover q rp rt ruby s samp semantics small span strike strong sub sup time tt u var wbr".split())
INLINE_BOX = frozenset("audio button canvas iframe label map noscript object picture select svg template textarea video".split())
VOID = frozenset("area base col embed hr img input link meta param source track".split())
RAW = frozenset("script style".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
P_BOUNDS = frozenset("button caption object table td template th".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table select".split())


class Node:
    __slots__ = ("links", "mark", "names", "parent", "tag", "text")

    def __init__(self, tag: str, parent: int, names: list[str], mark: str | None):
        self.tag, self.parent, self.names, self.mark = tag, parent, names, mark
        self.text = 0  # characters of its own, inline elements included
        self.links = 0


class _Open:
    """The elements that are open, with the places of each tag among them, so that none is searched for."""

    def __init__(self):
        self.tags, self.nodes = ["#root"], [0]
        self.where: dict[str, list[int]] = defaultdict(list)
        self.holds: list[int] = [0]
        self.p_bounds: list[int] = [0]

    def push(self, tag: str, node: int) -> None:
        at = len(self.tags)
        self.tags.append(tag)
        self.nodes.append(node)
        self.where[tag].append(at)
        if tag in HOLDS:
            self.holds.append(at)
        if tag in P_BOUNDS:
            self.p_bounds.append(at)

    def cut(self, at: int) -> None:
        while len(self.tags) > at:
            tag = self.tags.pop()
            self.nodes.pop()
            self.where[tag].pop()
            if tag in HOLDS:
                self.holds.pop()
            if tag in P_BOUNDS:
                self.p_bounds.pop()

    def close(self, tag: str) -> None:
        places = self.where.get(tag)
        if places and not (tag in SIBLINGS and self.holds[-1] > places[-1]):
            self.cut(places[-1])

    def make_room(self, tag: str) -> None:
        """Close what ``tag`` ends by opening: a paragraph, or the items and cells before it."""
        if tag in CLOSES_P:
            if places := self.where.get("svg"):  # a drawing holds no blocks, so it ends here
                self.cut(places[0])
            places = self.where.get("p")
            if places and places[-1] > self.p_bounds[-1]:
                self.cut(places[-1])
        elif tag in SIBLINGS:
            ends = [places[k] for t in SIBLINGS[tag] if (places := self.where.get(t)) and (k := bisect_right(places, self.holds[-1])) < len(places)]
            if ends:
                self.cut(min(ends))


def parse(html: str) -> tuple[list[Node], list[list[tuple[int, str]]]]:
    """Elements in page order, parents first, and the runs of text between block boundaries.

    A run is a list of pieces of text, each with the element that it stands in. Elements of inline
    kinds are no nodes of their own; boxes that stand in a line, such as pictures, buttons and
    ``noscript``, are nodes but part no run. Scripts and styles are left out up to their own closing
    tag. Every tag is handled in time that does not grow with the depth of the page.
    """
    nodes = [Node("#root", -1, [], None)]
    stack = _Open()
    runs: list[list[tuple[int, str]]] = []
    held: list[tuple[int, str]] = []
    linked, at = 0, 0

    def flush() -> None:
        if held:
            if any(not text.isspace() for _, text in held):
                runs.append(held[:])
            held.clear()

    while m := TOKEN.match(html, at):
        at = m.end()
        close, tag, attributes, text = m.groups()
        if text is not None:
            text = unescape(text) if "&" in text else text
            node = nodes[stack.nodes[-1]]
            held.append((stack.nodes[-1], text))
            node.text += len(text)
            if linked:
                node.links += len(text)
            continue
        if tag is None:
            if m.group() == "<":
                held.append((stack.nodes[-1], "<"))
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                linked = 0 if close else 1
            continue
        if tag == "br":
            held.append((stack.nodes[-1], " "))
            continue
        if close:
            if not stack.where["svg"] and (tag not in INLINE_BOX or stack.tags[-1] not in INLINE_BOX):
                flush()
            if tag not in ("body", "html"):  # what stands behind them belongs to the body too
                stack.close(tag)
            continue
        shut = SELF_CLOSED.search(attributes) is not None
        if tag in RAW:
            if not shut:  # what it holds is no markup, up to its own closing tag
                end = RAW_END[tag].search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag in CLOSES_P or not (tag in VOID or tag in INLINE_BOX or stack.where["svg"]):
            flush()
        stack.make_room(tag)
        names, mark = [], None
        if attributes:
            for key, *value in ATTRIBUTE.findall(attributes):
                key = key.lower()
                if key in NAMED:
                    names.extend(WORD.findall("".join(value).lower()))
                elif key == "data-content":
                    mark = "".join(value)
        nodes.append(Node(tag, stack.nodes[-1], names, mark))
        if tag not in VOID and not shut:
            stack.push(tag, len(nodes) - 1)
            if tag not in INLINE_BOX:
                linked = 0
    flush()
    return nodes, runs


def features(nodes: list[Node]) -> Iterator[tuple[str, ...]]:
    for n in nodes:
        share = n.links / n.text if n.text else -1
        yield (
            f"tag {n.tag}",
            f"in {nodes[n.parent].tag if n.parent >= 0 else ''}",
            f"size {min(7, n.text.bit_length() // 2 + (n.text > 0))}",
            f"links {-1 if share < 0 else 0 if share == 0 else 1 if share < 0.5 else 2}",
            *{f"name {w}" for w in n.names},
        )


class TreeModel:
    """A label, content or not, for each node. A node's features depend on its label, and its label
    on its parent's by a potential for each tag. Both are learned from counts."""

    def __init__(self, pages: Iterable[str], smoothing: float = 0.5):
        """``pages`` have an attribute data-content, 1 or 0, where the label differs from the parent's."""
        seen: dict[str, list[float]] = defaultdict(lambda: [smoothing, smoothing])
        totals = [smoothing, smoothing]
        pairs: dict[str, list[list[float]]] = defaultdict(lambda: [[0.0, 0.0], [0.0, 0.0]])
        for html in pages:
            nodes, _ = parse(html)
            labels: list[int] = []
            for n, found in zip(nodes, features(nodes)):
                label = int(n.mark) if n.mark else labels[n.parent] if n.parent >= 0 else 0
                labels.append(label)
                totals[label] += 1
                for f in found:
                    seen[f][label] += 1
                if n.parent >= 0:
                    pairs[n.tag][labels[n.parent]][label] += 1
                    pairs[""][labels[n.parent]][label] += 1
        self.weights = {f: math.log(c[1] / totals[1]) - math.log(c[0] / totals[0]) for f, c in seen.items()}
        share = [[(row[x] + 1) / (sum(row) + 2) for x in (0, 1)] for row in pairs[""]]
        self.pairs = {t: tuple(tuple((row[x] + 4 * share[p][x]) / (sum(row) + 4) for x in (0, 1)) for p, row in enumerate(rows)) for t, rows in pairs.items()}

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for each node: messages go up from the leaves, then down from the root.

        Everything is a ratio, content to not, kept within bounds that floats hold.
        """
        weight, default = self.weights.get, self.pairs[""]
        up = [math.exp(max(-30.0, min(30.0, sum([weight(f, 0.0) for f in found])))) for found in features(nodes)]
        sent = [1.0] * len(nodes)
        pair = [self.pairs.get(n.tag, default) for n in nodes]
        for k in range(len(nodes) - 1, 0, -1):
            (a, b), (c, d) = pair[k]
            sent[k] = (c + d * up[k]) / (a + b * up[k])
            p = nodes[k].parent
            up[p] = max(1e-60, min(1e60, up[p] * sent[k]))
        up[0] *= 1e-3  # the root is no content
        full = up[:]
        for k in range(1, len(nodes)):
            (a, b), (c, d) = pair[k]
            rest = full[nodes[k].parent] / sent[k]
            full[k] = max(1e-60, min(1e60, up[k] * (b + d * rest) / (a + c * rest)))
        return [r / (1 + r) for r in full]

    def extract(self, html: str) -> str:
        nodes, runs = parse(html)
        if not runs:
            return ""
        content = self.marginals(nodes)
        kept = (" ".join("".join([text for node, text in run if content[node] > 0.5]).split()) for run in runs)
        return "\n".join(filter(None, kept))


#: Words that pages commonly use as names of their parts.
MAIN = "article post entry content main story body text page".split()
ASIDE = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc".split(),
    "header": "header masthead banner branding topbar logo title".split(),
    "footer": "footer copyright colophon legal bottom".split(),
    "aside": "sidebar aside widget related recommended trending popular archive tags categories".split(),
    "notice": "notice cookie consent gdpr alert popup modal overlay newsletter subscribe paywall".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner".split(),
    "form": "form search login signup contact comment".split(),
    "comments": "comments comment replies reply discussion disqus respond reader".split(),
    "share": "share social buttons follow meta byline author".split(),
}


#: Names that say nothing of what a part holds.
PLAIN = "a b x y z row col block inner wrap section paragraph lead intro part one two".split()
#: What stands in a line of a page: formulas and fallbacks belong to the text around them, the rest does not.
BOXES = [
    "<img src='x' alt='y'>",
    "<math><mi>{}</mi></math>",
    "<object>{}</object>",
    '<svg data-content="0"><title>{}</title></svg>',
    '<noscript data-content="0">{}</noscript>',
    '<iframe data-content="0">{}</iframe>',
    '<video data-content="0">{}</video>',
    '<canvas data-content="0">{}</canvas>',
    '<template data-content="0">{}</template>',
    '<button data-content="0">{}</button>',
]


def labelled_pages(n: int, seed: int = 7) -> Iterator[str]:
    """Made-up pages with labels, in many layouts. Words are arbitrary; only their number matters."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(low, high)))

    def sentence(low: int, high: int) -> str:
        return words(low, high).capitalize() + rng.choice([".", ".", ".", "!", "", "?"])

    def names(kind: str) -> str:
        some = rng.sample(ASIDE.get(kind, MAIN), rng.randint(1, 2))
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(["-", "_", " "]).join(some)}"'

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(k)) + "</ul>"

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.1:
            return f"<h2>{words(2, 8)}</h2>"
        if kind < 0.17:
            return "<ul>" + "".join(f"<li>{sentence(3, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.22:
            return f"<blockquote><p>{sentence(5, 40)}</p></blockquote>"
        if kind < 0.25:
            return f"<table><tr><th>{words(1, 3)}</th></tr><tr><td>{words(1, 6)}</td></tr></table>"
        if kind < 0.28:
            return f"<pre>{words(3, 30)}</pre>"
        if kind < 0.38:
            return f"<p><b>{sentence(2, 12)}<br>"
        if kind < 0.44:
            return f"<p>{words(1, 9)} {rng.choice(BOXES).format(words(1, 9))} {sentence(1, 20)}</p>"
        if kind < 0.46:
            return rng.choice(BOXES).format(words(1, 12))
        if kind < 0.56:
            some = "" if rng.random() < 0.4 else f' class="{rng.choice(PLAIN)}"'
            inner = rng.choice([sentence(2, 12), sentence(5, 60), f"<p>{sentence(2, 40)}</p><p>{sentence(2, 40)}</p>", f"<h3>{words(1, 6)}</h3>{sentence(2, 40)}"])
            return f"<{(t := rng.choice(['div', 'div', 'section', 'figure']))}{some}>{inner}</{t}>"
        link = f' <a href="/y">{words(1, 3)}</a>' if rng.random() < 0.2 else ""
        return f"<p>{sentence(1, rng.choice([6, 40, 120]))}{link}" + ("</p>" if rng.random() < 0.9 else "")

    def boilerplate(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        if rng.random() < 0.35:
            tag = rng.choice(["div", "section"])
        name = names(kind) if tag in ("div", "section") or rng.random() < 0.5 else ""
        inner = {
            "nav": lambda: links(rng.randint(2, 8)),
            "header": lambda: rng.choice([f"<h1>{words(1, 4)}</h1>", f"<p>{words(1, 6)}</p>", words(1, 4)]) + (links(4) if rng.random() < 0.4 else ""),
            "footer": lambda: rng.choice(["&copy; " + sentence(2, 14), f"<p>&copy; {sentence(2, 12)}</p>", links(4)]),
            "aside": lambda: f"<h3>{words(1, 4)}</h3>" + rng.choice([links(4), f"<p>{sentence(4, 30)}</p>"]),
            "notice": lambda: rng.choice([sentence(5, 30), f"<noscript>{sentence(3, 20)}</noscript>", f"<p>{sentence(5, 30)}</p><button>{words(1, 2)}</button>"]),
            "ad": lambda: rng.choice([sentence(3, 25), f"<p>{sentence(3, 25)}</p>", f'<a href="/z">{words(2, 6)}</a>']),
            "form": lambda: f"<label>{words(1, 3)}</label><input type=\"text\"><button>{words(1, 2)}</button>" + (f"<p>{sentence(3, 15)}</p>" if rng.random() < 0.5 else ""),
            "comments": lambda: f"<h3>{words(1, 3)}</h3>" + "".join(f'<div class="comment"><p>{sentence(3, 60)}</p></div>' if rng.random() < 0.6 else f"<p>{sentence(3, 60)}</p>" for _ in range(rng.randint(1, 4))),
            "share": lambda: rng.choice([links(3), words(2, 6), f'<span>{words(1, 3)}</span><a href="/s">{words(1, 2)}</a>']),
        }[kind]()
        return f'<{tag}{name} data-content="0">{inner}</{tag}>'

    for _ in range(n):
        tag = rng.choice(["article", "article", "article", "main", "div", "div", "section"])
        name = names("main") if tag in ("div", "section") or rng.random() < 0.3 else ""
        story = [f"<h1>{words(2, 12)}</h1>"] if rng.random() < 0.85 else []
        story += [paragraph() for _ in range(rng.choice([0, 1, 2, 4, 8, 16]))] or [paragraph()]
        for kind in ("share", "ad", "aside", "comments", "form", "notice"):
            if rng.random() < 0.15:
                story.insert(rng.randint(0, len(story)), boilerplate(kind))
        core = f'<{tag}{name} data-content="1">{"".join(story)}</{tag}>'
        before = [boilerplate(k) for k in ("header", "nav", "notice", "ad", "form") if rng.random() < 0.6]
        after = [boilerplate(k) for k in ("aside", "comments", "ad", "share", "form", "footer") if rng.random() < 0.6]
        rng.shuffle(before)
        wrap = rng.random()
        page = "".join(before) + core + "".join(after)
        if wrap < 0.3:
            page = f'<div class="{rng.choice(["wrapper", "container", "page", "layout"])}">{page}</div>'
        yield f"<html><head><title>{words(1, 8)}</title></head><body>{page}</body></html>"


def extract(
    pages: DataFrame,
    labelled: Iterable[str] | None = None,
    id_col: str = "page_id",
    html_col: str = "html",
    also: tuple[str, ...] = ("url",),
) -> DataFrame:
    """Main text of every page: id, the columns in ``also``, text and n_chars.

    The model is trained on ``labelled`` pages (see `TreeModel`), by default 1,500 made-up ones. A
    block is the text between two block boundaries, white space turned into single spaces and
    character references decoded; blocks whose element is content with a probability over 1/2 are
    joined by line breaks in page order; a piece of a block that stands in an element of its own,
    such as a button, is judged by that element. Scripts, styles and comments are no text. Null and
    empty pages, and pages without content, give an empty text. Repeated rows are read one by one,
    an empty table gives no rows, other columns are not read, and broken, deep or cut-off markup is
    read as far as it goes, in time in proportion to a page's length.
    """
    sent = pages.sparkSession.sparkContext.broadcast(TreeModel(labelled if labelled is not None else labelled_pages(1500)))
    token = uuid.uuid4().hex

    def run(keys, htmls, *rest) -> Iterator[tuple]:
        model = built(token, lambda: sent.value)
        for key, html, *more in zip(keys, htmls, *rest):
            text = model.extract(html or "")
            yield key, *more, text, len(text)

    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, *also)]
    return map_rows(pages, [id_col, html_col, *also], ", ".join(kinds) + ", text string, n_chars long", run)
