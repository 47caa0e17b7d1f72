"""Operator 9: main text of web pages by a tree-structured graphical model.

Block elements of a page form a tree. Each has a hidden label, content or not; an element's own features and the label of its
parent make up the potentials. Sum-product messages go up from the leaves and down from the root, which yields the marginal of
every element exactly, in time linear in the page. Weights maximise the likelihood of labelled pages, whose gradient needs the
same marginals. The labelled pages come from layout rules below (`labelled_pages`): articles in several containers among menus,
headers, footers, sidebars, notices, adverts, forms and comments.

Text belongs to the nearest element around it that is a block or has a name (class, id, role) and is kept where that element's
marginal is at least 0.5; elements within a line, named or not, don't end it. Text that a browser doesn't show (the `hidden`
attribute, closed dialogs, styles that hide) is no text. Attributes are never read as labels outside of training. Null, empty
and text-free pages give an empty text; a tag or comment that the page's end cuts off is no text; elements that are never closed
end with the page; repeated rows and ids stay; columns other than page_id, url and html are left behind.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import sliced, strings

# Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style title head noscript template svg math iframe object textarea select option button canvas noembed noframes datalist".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var ins del wbr img input br".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SECTIONS = frozenset("form nav aside footer header section article main".split())
SCOPE = frozenset("ul ol dl table td th body html article div section".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    tag: str
    parent: int
    names: tuple[str, ...]
    #: The attribute `data-label` as it stands, the parent's where there is none; only training reads a meaning into it.
    mark: str | None
    hidden: bool
    #: Runs of text, by their line and their place in the page.
    runs: dict[tuple[int, int], list[str]] = field(default_factory=lambda: defaultdict(list))
    chars: int = 0
    linked: int = 0
    stops: int = 0


def blocks(page: str) -> list[Block]:
    """The page's block elements, each after its parent; the first is the document."""
    found = [Block("#document", -1, (), None, False)]
    stack: list[tuple[str, int]] = [("#document", 0)]  # open elements with the block that their text goes to
    links = at = run = line = 0
    end = len(page)

    def say(raw: str) -> None:
        block = found[stack[-1][1]]
        if raw and not block.hidden:
            text = entities.unescape(raw) if "&" in raw else raw
            block.runs[line, run].append(text)
            n = len(text.strip())
            block.chars += n
            block.linked += n * (links > 0)
            block.stops += text.count(". ") + text.count(".")

    def close(to: int) -> None:
        nonlocal links, run, line
        while len(stack) > to:
            name, b = stack.pop()
            links -= name == "a"
            if b != stack[-1][1]:
                run += 1
                line += name not in INLINE

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if slash:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in SCOPE and name in INLINE | {"p", "li"}:
                    break
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        for k in range(len(stack) - 1, 0, -1):
            if name not in CLOSES or stack[k][0] in SCOPE - {"td", "th"}:
                break
            if stack[k][0] in CLOSES[name]:
                close(k)
                break
        marks = {a.lower(): b or c or d for a, b, c, d in reversed(ATTRIBUTE.findall(attributes))} if attributes else {}  # the first of equal names counts
        names = tuple(dict.fromkeys(t.lower() for a in ("class", "id", "role") for t in TOKEN.findall(marks.get(a, ""))))
        if name == "br":
            say(" ")
            continue
        if name in VOID:
            continue
        parent = stack[-1][1]
        unseen = name in HIDDEN or "hidden" in marks or (name == "dialog" and "open" not in marks) or bool(UNSEEN.search(marks.get("style", "")))
        if name in INLINE and not names and not unseen:
            stack.append((name, parent))
        else:
            run += 1
            line += name not in INLINE
            found.append(Block(name, parent, names, marks.get("data-label", found[parent].mark), found[parent].hidden or unseen))
            stack.append((name, len(found) - 1))
        links += name == "a"
        if name in RAW:
            rest = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = rest.end() if rest else end
            close(len(stack) - 1)
        elif attributes.endswith("/") and name in ("svg", "path"):
            close(len(stack) - 1)
    return found


def features(tree: list[Block]) -> list[tuple[str, ...]]:
    """Names of the features that hold for each block."""
    chars, linked = [b.chars for b in tree], [b.linked for b in tree]
    for i in range(len(tree) - 1, 0, -1):
        chars[tree[i].parent] += chars[i]
        linked[tree[i].parent] += linked[i]
    out = []
    for b, n, k in zip(tree, chars, linked, strict=True):
        share = k / n if n else 0.0
        out.append(("bias", f"tag {b.tag}", *(f"name {t}" for t in b.names), f"size {min(4, int(math.log1p(n) / 1.6))}", f"links {0 if share < 0.1 else 1 if share < 0.5 else 2}", "sentences" if b.stops else "no sentence", *(("hidden",) if b.hidden else ())))
    return out


@dataclass
class TreeModel:
    weight: dict[str, float]
    #: Log potentials of (parent's label, own label), and those that a kind of element has besides.
    edge: list[list[float]]
    kinds: dict[str, list[list[float]]]

    def potentials(self, tree: list[Block], own: list[tuple[str, ...]]) -> tuple[list[float], list[list[list[float]]]]:
        get = self.weight.get
        both = {k: [[self.edge[p][c] + e[p][c] for c in (0, 1)] for p in (0, 1)] for k, e in self.kinds.items()}
        return [sum([get(f, 0.0) for f in fs]) for fs in own], [APART if b.hidden else both.get(kind(b), self.edge) for b in tree]

    def marginals(self, tree: list[Block], own: list[tuple[str, ...]]) -> tuple[list[float], list[list[float]]]:
        """P(content) of every block, and P(parent's label, own label) as [00, 01, 10, 11]."""
        unary, edge = self.potentials(tree, own)
        n = len(tree)
        low, high = [0.0] * n, list(unary)  # log belief of a block's subtree under label 0 and 1
        up: list[tuple[float, float]] = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):
            e, a, b = edge[i], low[i], high[i]
            up[i] = (_lse(e[0][0] + a, e[0][1] + b), _lse(e[1][0] + a, e[1][1] + b))
            p = tree[i].parent
            low[p] += up[i][0]
            high[p] += up[i][1]
        root = _sigmoid(high[0] - low[0])
        content, pair = [root] + [0.0] * (n - 1), [[0.0] * 4 for _ in range(n)]
        down = [(0.0, 0.0)] * n
        for i in range(1, n):
            p, e = tree[i].parent, edge[i]
            # what the parent believes without this block
            a, b = low[p] + down[p][0] - up[i][0], high[p] + down[p][1] - up[i][1]
            down[i] = (_lse(a + e[0][0], b + e[1][0]), _lse(a + e[0][1], b + e[1][1]))
            joint = [a + e[0][0] + low[i], a + e[0][1] + high[i], b + e[1][0] + low[i], b + e[1][1] + high[i]]
            top = max(joint)
            joint = [math.exp(x - top) for x in joint]
            total = sum(joint)
            pair[i] = [x / total for x in joint]
            content[i] = pair[i][1] + pair[i][3]
            m = max(down[i])
            down[i] = (down[i][0] - m, down[i][1] - m)
        return content, pair


#: What is hidden tells nothing about what is around it.
APART = [[0.0, 0.0], [0.0, 0.0]]


def kind(b: Block) -> str:
    """Elements whose label tells less about their parent's: those with a name, and sections of a page."""
    return "named" if b.names else b.tag if b.tag in SECTIONS else ""


def _lse(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > 0 else math.exp(x) / (1 + math.exp(x))


def label(b: Block) -> int:
    """What a labelled page says of a block: content where the mark is 1."""
    return int(b.mark == "1")


def train(pages: list[str], rounds: int = 80, rate: float = 0.6, decay: float = 2e-4) -> TreeModel:
    """Weights by gradient steps on the likelihood of the labels (data-label attributes; what has none inherits)."""
    model = TreeModel({}, [[0.5, -0.5], [-0.5, 0.5]], {})
    trees = [(t, features(t)) for t in map(blocks, pages)]
    size: dict = defaultdict(float)
    for _ in range(rounds):
        slope: dict[str, float] = defaultdict(float)
        edges: dict[tuple[str, int], float] = defaultdict(float)
        for tree, own in trees:
            content, pair = model.marginals(tree, own)
            for i, (b, fs) in enumerate(zip(tree, own, strict=True)):
                for f in fs:
                    slope[f] += label(b) - content[i]
                if i and not b.hidden:
                    seen = 2 * label(tree[b.parent]) + label(b)
                    for k in range(4):
                        d = (k == seen) - pair[i][k]
                        edges["", k] += d
                        if name := kind(b):
                            edges[name, k] += d
        for key, g in [*slope.items(), *edges.items()]:
            size[key] += g * g  # steps shrink with what a weight has moved already
            step = rate * g / (1e-6 + math.sqrt(size[key]))
            if isinstance(key, str):
                model.weight[key] = (1 - decay) * model.weight.get(key, 0.0) + step
            else:
                where = model.kinds.setdefault(key[0], [[0.0, 0.0], [0.0, 0.0]]) if key[0] else model.edge
                where[key[1] // 2][key[1] % 2] += step
    return model


def labelled_pages(n: int = 120, seed: int = 7) -> list[str]:
    """Pages by layout rules; data-label="1" marks content, "0" what is not, inside or outside of it."""
    r = random.Random(seed)

    def words(low: int, high: int) -> str:
        out = " ".join("".join(r.choice("aeioustrnlmd") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high)))
        return out.capitalize() + ("." if r.random() < 0.8 else "")

    def items(k: int, link: bool) -> str:
        return "".join(f"<li>{f'<a href=/x>{words(1, 3)}</a>' if link else words(2, 25)}</li>" for _ in range(k))

    def prose() -> str:
        many = 1 if r.random() < 0.2 else r.randint(2, 8)
        parts = []
        for _ in range(many):
            size = r.choice([(1, 6), (5, 30), (20, 120)])
            kind = r.random()
            if kind < 0.72:
                parts.append(f"<p>{words(*size)}</p>")
            elif kind < 0.75:
                parts.append(f"<p>{words(*size)} <a href=/y>{words(1, 3)}</a> {words(1, 9)}")
            elif kind < 0.79:
                name = r.choice("term highlight name lead dropcap emphasis quote date place caps small".split())
                parts.append(f'<p>{words(1, 9)} <{(t := r.choice(["span", "em", "a", "code"]))} class="{name}">{words(1, 4)}</{t}> {words(*size)}</p>')
            elif kind < 0.84:
                parts.append(f"<ul>{items(r.randint(1, 5), False)}</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote>{words(*size)}</blockquote>")
            elif kind < 0.95:
                parts.append(f"<h2>{words(1, 6)}</h2>")
            else:
                parts.append(f"<table><tr><td>{words(1, 9)}</td><td>{words(1, 9)}</td></tr></table>")
        return "".join(parts)

    def aside() -> str:
        """One piece that is not content."""
        text = words(*r.choice([(2, 8), (8, 40), (30, 90)]))
        para = r.choice([text, f"<p>{text}</p>", f"<h3>{words(1, 4)}</h3><p>{text}</p>", f"<ul>{items(r.randint(2, 6), True)}</ul>"])
        name = r.choice("ad ads advert advertisement sponsor promo banner sidebar side-bar widget related share social newsletter subscribe cookie cookie-notice notice consent menu navbar breadcrumb pagination comments comment-list reader-comments replies discussion footer site-header masthead login search popup disclaimer copyright tags author-box recommended".split())
        return r.choice(
            [
                f'<div class="{name}" data-label="0">{para}</div>',
                f'<div id="{name}" data-label="0">{para}</div>',
                f'<section class="{name}" data-label="0">{para}<div class="comment"><p>{words(5, 60)}</p></div></section>',
                f'<aside data-label="0">{para}</aside>',
                f'<form data-label="0"><label>{words(1, 3)}</label><p>{text}</p><button>{words(1, 2)}</button></form>',
                f'<nav data-label="0"><ul>{items(r.randint(2, 7), True)}</ul></nav>',
                f'<footer data-label="0">{para}</footer>',
                f'<div class="ad" data-label="0">{text}</div>',
            ]
        )

    out = []
    for _ in range(n):
        title = words(2, 9)
        head = r.choice([f"<h1>{title}</h1>", f"<h2>{title}</h2>", f"<header><h1>{title}</h1></header>" if r.random() < 0.3 else "", ""])
        inner = head + "".join(r.choice([prose(), prose(), aside() if r.random() < 0.5 else ""]) for _ in range(r.randint(1, 3)))
        box = r.choice(["article", "article", "main", 'div class="content"', 'div class="article-body"', 'div class="post"', 'div class="entry-content"', 'div id="main"', 'div class="story"', 'section class="article"', "div", 'div class="text"'])
        name = box.split()[0]
        body = f'<{box} data-label="1">{inner}' + (f"</{name}>" if r.random() < 0.95 else "")
        if r.random() < 0.3:
            body = f'<main data-label="1">{body}</main>'
        if r.random() < 0.25:
            body = f'<div class="{r.choice(["wrapper", "container", "page", "row"])}" data-label="0">{aside()}{body}{aside()}</div>'
        top = f'<header data-label="0"><h1>{words(1, 3)}</h1><p>{words(2, 9)}</p></header>' if r.random() < 0.4 else ""
        nav = f'<nav data-label="0"><ul>{items(r.randint(2, 9), True)}</ul></nav>' if r.random() < 0.7 else ""
        foot = f'<footer data-label="0">&copy; {words(3, 30)}</footer>' if r.random() < 0.8 else ""
        out.append(f'<html data-label="0"><head><title>{title}</title></head><body>{top}{nav}{"".join(aside() for _ in range(r.randint(0, 2)))}{body}{"".join(aside() for _ in range(r.randint(0, 3)))}{foot}</body></html>')
    return out


@lru_cache(maxsize=1)
def trained() -> TreeModel:
    return train(labelled_pages())


def main_text(page: str, model: TreeModel) -> str:
    tree = blocks(page)
    content, _ = model.marginals(tree, features(tree))
    kept = sorted((place, "".join(parts)) for b, p in zip(tree, content, strict=True) if p >= 0.5 and not b.hidden for place, parts in b.runs.items())
    lines: dict[int, list[str]] = {}
    for (line, _), text in kept:
        lines.setdefault(line, []).append(text)
    return "\n".join(text for parts in lines.values() if (text := " ".join("".join(parts).split())))


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    model = model or trained()

    def run(batches):
        for b in sliced(batches, "html"):
            out = [main_text(p, model) for p in strings(b.column("html"))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
