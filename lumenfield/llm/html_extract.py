"""Main text of web pages by a tree-structured graphical model over their DOM.

Each block element of a page is a node that is content or not. Its features (tag, class and id words, text length,
share of link text, sentence marks, depth) depend on its state, and its state on that of its parent by a potential for its
tag. Sum-product messages go up and down the tree, once each, and give each node's marginal; the text of nodes
with a marginal of a half or more is the page's main text.

The potentials are counts over labelled pages. Where no labels are given, pages that mark their parts themselves
(an article or main element) label their own nodes: what is in it is content, but for menus, notices, forms and the like, and
what is outside is not. The model then serves all pages, also those without such marks. Counts are summed in each task and then by key;
the model has at most some thousand numbers, as class words and unknown tags are hashed into buckets. Without labels and without pages that
mark their parts, fixed weights of length, links and sentence marks stand in for the counts.

Text: blocks are in page order, character references are decoded, white space inside a block is one space (a line
break element is white space), blocks are joined by one space. Scripts, styles, comments, heads and hidden parts are never text.

Defined results: null or empty pages, and pages without content, have an empty text; unclosed and stray tags are closed
as browsers close them; a tag that the end of the page cuts is dropped; repeated rows are extracted each; an empty table
gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1024
TAG_BUCKETS = 64
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>]+)))?""")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math select object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp output picture audio video canvas map".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th", "tbody"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = frozenset("ul ol dl table article section main aside nav body html div form blockquote".split())
TAGS = VOID | RAW | INLINE | CLOSES_P | SCOPE | frozenset(SIBLINGS)
#: Words by which pages name what is not their article; tags and roles of the same meaning.
NOT_CONTENT = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer form header legal login masthead menu nav navbar navigation newsletter notice pager pagination popup promo promotion related reply replies share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split())
NOT_TAGS = frozenset("nav footer aside form button dialog menu fieldset search".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary dialog alert search form".split())


class Node:
    __slots__ = ("tag", "parent", "depth", "names", "role", "chars", "links", "marks", "texts", "hidden")

    def __init__(self, tag, parent, depth, names=(), role="", hidden=False):
        self.tag, self.parent, self.depth, self.names, self.role, self.hidden = tag, parent, depth, names, role, hidden
        self.chars = self.links = self.marks = 0
        self.texts = []  # (order, text) of the blocks of this node


def parse(page: str) -> list[Node]:
    """Block elements in page order; a parent comes before its children."""
    nodes = [Node("#", -1, 0)]
    stack = [("#", 0)]  # open elements with their block
    run: list[str] = []
    blocks = 0
    at, n, link = 0, len(page), 0

    def text(a: int, b: int) -> None:
        if b > a:
            t = html.unescape(page[a:b])
            run.append(t)
            node = nodes[stack[-1][1]]
            size = len(t.strip())
            node.chars += size
            if link:
                node.links += size
            else:
                node.marks += t.count(". ") + t.count(", ") + t.rstrip().endswith(".")

    def end_block() -> None:
        nonlocal blocks
        if run:
            t = " ".join("".join(run).split())
            run.clear()
            if t:
                nodes[stack[-1][1]].texts.append((blocks, t))
                blocks += 1

    def pop_to(k: int) -> None:
        nonlocal link
        while len(stack) > k:
            tag, _ = stack[-1]
            if tag not in INLINE:
                end_block()
            if tag == "a":
                link -= 1
            stack.pop()

    def open_at(tags, stop) -> int | None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in stop:
                return None
        return None

    for m in iter(lambda: TOKEN.search(page, at), None):
        text(at, m.start())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag or (m[5] and at == n and page[-1] != ">"):
            continue
        if m[1] or m[4]:
            if tag == "br":
                run.append("\n")
            elif (k := open_at({tag}, ())) is not None:
                pop_to(k)
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW and not attributes.endswith("/"):
            if tag not in ("svg", "math", "object"):
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else n
                continue
        if tag == "br":
            run.append("\n")
            continue
        if tag in CLOSES_P and (k := open_at({"p"}, SCOPE)) is not None:
            pop_to(k)
        if tag in SIBLINGS and (k := open_at(SIBLINGS[tag], SCOPE - {"div"})) is not None:
            while (j := open_at(SIBLINGS[tag], SCOPE - {"div"})) is not None:
                pop_to(j)
        if tag in VOID:
            if tag == "hr":
                end_block()
            continue
        if tag == "a":
            link += 1
        if tag in INLINE:
            stack.append((tag, stack[-1][1]))
            continue
        end_block()
        names, role, hidden = [], "", tag == "head" or tag in RAW
        for kind, *value in ATTRIBUTE.findall(attributes):
            kind, value = kind.lower(), next((v for v in value if v), "").lower()
            if kind == "role":
                role = value
            elif kind == "hidden" or (kind == "aria-hidden" and value.strip() == "true") or (kind == "style" and NO_DISPLAY.search(value)):
                hidden = True
            elif kind in ("class", "id"):
                names += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value))
        up = stack[-1][1]
        nodes.append(Node(tag, up, nodes[up].depth + 1, names, role, nodes[up].hidden or hidden))
        stack.append((tag, len(nodes) - 1))
    text(at, n)
    pop_to(1)
    end_block()
    return nodes


def tag_name(tag: str) -> str:
    """Tags of the standard, and a bucket for any other."""
    return tag if tag in TAGS or tag == "#" else f"other{zlib.crc32(tag.encode()) % TAG_BUCKETS}"


def features(node: Node) -> list[str]:
    out = [f"tag {tag_name(node.tag)}", f"length {min(9, int(math.log2(node.chars + 1)))}", f"links {0 if not node.links else 1 + int(3 * node.links / max(1, node.chars))}", f"marks {min(4, node.marks)}", f"depth {min(node.depth, 8)}"]
    out += {f"name {zlib.crc32(w.encode()) % BUCKETS}" for w in node.names}
    out += [f"word {w}" for w in node.names if w in NOT_CONTENT]
    if node.role:
        out.append(f"role {node.role if node.role in NOT_ROLES else 'other'}")
    return out


def seeds(nodes: list[Node]) -> list[int] | None:
    """States of the nodes of a page that marks its article itself, else None."""
    if not any(x.tag in ("article", "main") for x in nodes):
        return None
    state, off = [0] * len(nodes), [False] * len(nodes)
    for i, x in enumerate(nodes):
        up = x.parent
        off[i] = (up >= 0 and off[up]) or x.hidden or x.tag in NOT_TAGS or x.role in NOT_ROLES or any(w in NOT_CONTENT for w in x.names if x.tag not in ("article", "main", "body", "html"))
        state[i] = int(not off[i] and (x.tag in ("article", "main") or (up >= 0 and state[up] == 1)))
    return state


def labelled(nodes: list[Node], main: str) -> list[int]:
    """States of the nodes of a page whose main text is known: a block is content if its text stands there, an element without text of
    its own if most of the text in it is."""
    main = " ".join(main.split())
    state, good, whole = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):  # children come after their parents
        x = nodes[i]
        size = sum(len(t) for _, t in x.texts)
        here = sum(len(t) for _, t in x.texts if t in main)
        state[i] = int(not x.hidden and (2 * here > size if size else 2 * good[i] > whole[i]))
        if x.parent >= 0:
            good[x.parent] += good[i] + here
            whole[x.parent] += whole[i] + size
    return state


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for page, main in zip(batch.column(0), batch.column(1).to_pylist()):
            nodes = parse(page.as_py() or "")
            state = seeds(nodes) if main is None else labelled(nodes, main)
            for i, x in enumerate(nodes if state else ()):
                for f in features(x):
                    seen[f"{f}|{state[i]}"] += 1
                if x.parent >= 0:
                    seen[f"edge {tag_name(x.tag)} {state[x.parent]}|{state[i]}"] += 1
                    seen[f"any {state[x.parent]}|{state[i]}"] += 1
                seen[f"all|{state[i]}"] += 1
    yield pa.RecordBatch.from_pydict({"key": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})


def train(pages: DataFrame, main: str | None = None) -> dict[str, int]:
    """Potentials as counts, from pages whose main text is in the column ``main``, and where that is null or not given, from pages that mark their parts."""
    label = F.lit(None).cast("string") if main is None else F.col(main)
    counted = pages.select("html", label.alias("main")).mapInArrow(_counts, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return {r["key"]: r["n"] for r in counted.collect()}  # tags and class words are hashed: at most some thousand keys


class Model:
    """Log potentials. What counts don't cover falls back on what the tags and words mean; without any counts, text that is long, has the
    marks of sentences and few links is content."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.all = [counts.get("all|0", 0) + 1.0, counts.get("all|1", 0) + 1.0]
        self.unary: dict[str, float] = {}
        self.edges: dict[tuple[str, int], tuple[float, float]] = {}

    def weight(self, f: str) -> float:
        """log P(feature | content) - log P(feature | not)"""
        if f not in self.unary:
            kind, _, word = f.partition(" ")
            off = (kind == "tag" and word in NOT_TAGS) or kind == "word" or (kind == "role" and word != "other")
            a, b = self.counts.get(f"{f}|1", 0) + 0.5, self.counts.get(f"{f}|0", 0) + 0.5 + 20 * off
            w = math.log(a / self.all[1] * self.all[0] / b) if min(self.all) > 1 or off else untrained(kind, word)
            self.unary[f] = max(-12.0, min(4.0, w)) if off else max(-4.0, min(4.0, w))
        return self.unary[f]

    def edge(self, tag: str, up: int) -> tuple[float, float]:
        """log P(not | parent), log P(content | parent)"""
        tag = tag_name(tag)
        if (tag, up) not in self.edges:
            base = [self.counts.get(f"any {up}|{s}", 0) + 2.0 * (s == up) + 0.5 for s in (0, 1)]
            n = [self.counts.get(f"edge {tag} {up}|{s}", 0) + 2 * base[s] / sum(base) for s in (0, 1)]
            self.edges[tag, up] = (math.log(n[0] / sum(n)), math.log(n[1] / sum(n)))
        return self.edges[tag, up]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node, by sum-product up and down the tree."""
        n = len(nodes)
        own = [[0.0, sum(map(self.weight, features(x)))] for x in nodes]
        down_ = [[0.0, 0.0] for _ in nodes]
        up = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            x, e0, e1 = nodes[i], self.edge(nodes[i].tag, 0), self.edge(nodes[i].tag, 1)
            up[i] = (_add(e0[0] + own[i][0], e0[1] + own[i][1]), _add(e1[0] + own[i][0], e1[1] + own[i][1]))
            own[x.parent][0] += up[i][0]
            own[x.parent][1] += up[i][1]
        down_[0] = [math.log(0.9), math.log(0.1)]
        out = [0.0] * n
        for i in range(n):
            if i:
                p = nodes[i].parent
                rest = [down_[p][s] + own[p][s] - up[i][s] for s in (0, 1)]  # all that the parent knows but from this child
                e0, e1 = self.edge(nodes[i].tag, 0), self.edge(nodes[i].tag, 1)
                d = [_add(rest[0] + e0[s], rest[1] + e1[s]) for s in (0, 1)]
                top = max(d)
                down_[i] = [d[0] - top, d[1] - top]
            a, b = down_[i][0] + own[i][0], down_[i][1] + own[i][1]
            out[i] = 1 / (1 + math.exp(min(700.0, a - b)))
        return out


def untrained(kind: str, value: str) -> float:
    """The weight of a feature that no page was counted for."""
    if kind == "length":
        return 0.7 * (int(value) - 5) if int(value) else 0.0
    return {"marks": 0.6, "links": -1.5}.get(kind, 0.0) * (int(value) if kind in ("marks", "links") else 0)


def _add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def main_text(page: str | None, model: Model) -> str:
    nodes = parse(page or "")
    found = [t for x, p in zip(nodes, model.marginals(nodes)) if p >= 0.5 and not x.hidden for t in x.texts]
    return " ".join(t for _, t in sorted(found))


def extract(pages: DataFrame, counts: dict[str, int] | None = None) -> DataFrame:
    """``pages`` with the column text; ``counts`` are those of ``train``, which is called on ``pages`` where they are not given."""
    counts = train(pages) if counts is None else counts
    pages = pages.drop("text")
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(counts)
        for batch in batches:
            text = [main_text(x.as_py(), model) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "text"])

    return pages.mapInArrow(run, schema)
