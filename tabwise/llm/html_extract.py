"""Main text of HTML pages by a tree-structured graphical model.

Every element of a page is a node with the label content or boilerplate. Its unary potential comes from its tag,
class words, text length and link share; parent-child potentials couple it with its parent (one table for inline,
one for block elements). Sum-product messages go upward and then downward, which is exact on a tree, and give each
element's marginal probability of being content; text whose element reaches one half is kept. The potentials are
fitted to labelled pages (``training_pages``) by gradient ascent on their likelihood, with the same messages.

Scale: map-only; the model is a few hundred numbers; a page costs one linear scan and two sweeps over its nodes.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .html_training import training_pages

# fixed values: element classes of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol p pre search
section summary table tbody td tfoot th thead title tr ul""".split())
SCOPE = frozenset("button caption html object table td template th".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
LIST = frozenset("ul ol menu dl table tbody thead tfoot select".split())

_TOKEN = r"""<!--(?:.*?-->|.*)|%s<[!?][^>]*>
    |</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*>
    |<(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<loose>[a-zA-Z][^\s/>]*+)(?P<rest>[^>]*+)>
    |(?P<text>[^<]++|<)"""
# CDATA sections are looked for where one can still end, tags where a > is left: else every < would scan the rest of the page
TOKEN, NO_CDATA = (re.compile(_TOKEN % cdata, re.S | re.X) for cdata in (r"<!\[CDATA\[.*?\]\]>|", ""))
LAST = re.compile("<!--.*|(?P<text>[^<]++|<)(?P<end>(?!))?(?P<tag>(?!))?(?P<loose>(?!))?", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|itemprop|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Tree:
    """Nodes in page order; parent[i] < i. Node 0 is the page itself. items: (node, text) or (node, None) for a
    block border."""

    tag: list[str] = field(default_factory=lambda: [""])
    attrs: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    items: list[tuple[int, str | None]] = field(default_factory=list)


def parse(page: str) -> Tree:
    """A forgiving parse: paragraphs, list items and cells close each other, an end tag closes what is open inside
    it unless an inline tag would close a block, unknown end tags are ignored. The places of open elements are kept by tag,
    so no tag walks the stack."""
    t, stack, pos, n = Tree(), [0], 0, len(page)
    open_at: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack by tag
    blocks, borders = [0], [0]  # places of block elements; of these and scopes
    last_cdata, last_tag = page.rfind("]]>"), page.rfind(">")

    def close(upto: int):
        for i in stack[upto:]:
            if t.tag[i] in BLOCK:
                t.items.append((t.parent[i], None))
                break
        for i in stack[upto:]:
            open_at[t.tag[i]].pop()
        del stack[upto:]
        for places in (blocks, borders):
            while places[-1] >= upto:
                places.pop()

    def last(tags) -> int:
        return max((open_at[g][-1] for g in tags if open_at[g]), default=0)

    while pos < n:
        m = (LAST if pos > last_tag else TOKEN if pos <= last_cdata else NO_CDATA).match(page, pos)
        if m is None:  # a lone character
            t.items.append((stack[-1], page[pos]))
            pos += 1
            continue
        pos = m.end()
        text = m["text"]
        if text is not None:
            t.items.append((stack[-1], text))
            continue
        end, tag = m["end"], m["tag"] or m["loose"]
        if tag:
            tag = tag.lower()
            if tag in BLOCK and t.tag[stack[borders[-1]]] == "p":
                close(borders[-1])
            if tag in SAME:
                upto = last(SAME[tag])
                if upto > last(LIST - SAME[tag]):
                    while t.tag[stack[upto - 1]] in SAME[tag]:
                        upto -= 1
                    close(upto)
            if tag == "br":
                t.items.append((stack[-1], " "))
                continue
            node = len(t.tag)
            t.tag.append(tag)
            t.attrs.append(m["attrs"] or m["rest"] or "")
            t.parent.append(stack[-1])
            if tag in BLOCK:
                t.items.append((node, None))
            if tag in RAW:  # its text is no markup
                shut = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, pos)
                t.items.append((node, page[pos:shut.start() if shut else n]))
                pos = n if shut is None else (page.find(">", shut.end()) + 1 or n)
                if tag in BLOCK:
                    t.items.append((t.parent[node], None))
            elif tag not in VOID and not (m["attrs"] or "").endswith("/"):
                place = len(stack)
                open_at[tag].append(place)
                if tag in BLOCK:
                    blocks.append(place)
                if tag in BLOCK or tag in SCOPE:
                    borders.append(place)
                stack.append(node)
        elif end:
            end = end.lower()
            place = last((end,))
            if place and (end in BLOCK or place > blocks[-1]):
                close(place)
    return t


def names(attrs: str) -> tuple[list[str], str | None]:
    """Lower-case words of class, id, role and itemprop; the value of data-label."""
    words, label = [], None
    if "=" in attrs:
        for key, a, b, c in NAMED.findall(attrs):
            if key.lower() == "data-label":
                label = a or b or c
            else:
                words += [w.lower() for w in WORD.findall(a or b or c)]
    return words, label


def features(t: Tree) -> list[list[str]]:
    """Features of every node."""
    n = len(t.tag)
    chars, linked = [0] * n, [0] * n
    for node, text in t.items:
        if text and t.tag[node] not in RAW:
            chars[node] += len(text) if not text.isspace() else 0
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[t.parent[i]] or t.tag[i] == "a"
        if in_link[i]:
            linked[i] = chars[i]
    for i in range(n - 1, 0, -1):
        chars[t.parent[i]] += chars[i]
        linked[t.parent[i]] += linked[i]
    out = []
    for i in range(n):
        size = min(int(math.log2(chars[i] + 1)) // 2, 5)
        share = 0 if not linked[i] else 1 + min(int(3 * linked[i] / chars[i]), 2)
        words, _ = names(t.attrs[i])
        out.append(["all", "tag=" + t.tag[i], f"size={size}", f"link={share}"] + ["name=" + w for w in set(words)]
                   + ["stem=" + w[:6] for w in {w[:6] for w in words if len(w) > 3}])
    return out


def labels(t: Tree) -> list[int]:
    """1 inside an element with data-label=1, 0 inside one with data-label=0; the nearest counts."""
    out = [0] * len(t.tag)
    for i in range(1, len(t.tag)):
        mark = names(t.attrs[i])[1]
        out[i] = int(mark) if mark is not None else out[t.parent[i]]
    return out


@dataclass
class TreeModel:
    """weight: log-odds of each feature; couple[inline][parent][child]: log-potential of the two labels."""

    weight: dict[str, float]
    couple: list[list[list[float]]]

    def beliefs(self, t: Tree, fs: list[list[str]]) -> list[tuple[float, ...]]:
        """For every node the joint probabilities of (parent's label, its label): 00, 01, 10, 11."""
        n, get = len(t.tag), self.weight.get
        table = [[[math.exp(v) for v in row] for row in side] for side in self.couple]
        table = [table[0 if tag in BLOCK else 1] for tag in t.tag]
        up = []
        for f in fs:  # unary potential (boilerplate, content)
            z = max(-30.0, min(30.0, sum([get(x, 0.0) for x in f])))
            p = 1 / (1 + math.exp(-z))
            up.append([1 - p, p])
        message: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            (a, b), (c, d) = table[i]
            x, y = up[i]
            m0, m1 = a * x + b * y, c * x + d * y
            s = m0 + m1
            message[i] = m0, m1 = m0 / s, m1 / s
            q = up[t.parent[i]]
            q0, q1 = q[0] * m0, q[1] * m1
            s = q0 + q1
            q[0], q[1] = q0 / s, q1 / s
        belief = [(1.0, 0.0)] * n  # the page itself is no content
        out: list[tuple[float, ...]] = [(1.0, 0.0, 0.0, 0.0)] * n
        for i in range(1, n):
            b0, b1 = belief[t.parent[i]]
            b0, b1 = b0 / max(message[i][0], 1e-300), b1 / max(message[i][1], 1e-300)  # the parent without this child
            (a, b), (c, d) = table[i]
            x, y = up[i]
            j = (b0 * a * x, b0 * b * y, b1 * c * x, b1 * d * y)
            s = sum(j)
            j00, j01, j10, j11 = out[i] = (j[0] / s, j[1] / s, j[2] / s, j[3] / s)
            belief[i] = (j00 + j10, j01 + j11)
        return out

    def marginals(self, t: Tree) -> list[float]:
        """Probability of content for every node."""
        return [j[1] + j[3] for j in self.beliefs(t, features(t))]

    def extract(self, page: str | None) -> str:
        """Kept text, one line a block."""
        if not page:
            return ""
        t = parse(page)
        keep = [p >= 0.5 for p in self.marginals(t)]
        blocks, run = [], []
        for node, text in t.items:
            if text is None:
                blocks.append(run)
                run = []
            elif keep[node]:
                run.append(text)
            elif t.tag[node] not in BLOCK:
                run.append(" ")  # dropped inline text still parts words
        blocks.append(run)
        lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks if b)
        return "\n".join(x for x in lines if x)


def train(pages: list[str], rounds: int = 60, rate: float = 0.5, decay: float = 0.02) -> TreeModel:
    """Fit to labelled pages (elements carry data-label): adaptive gradient steps on the log-likelihood of the
    labels less ``decay`` times half the squared weights."""
    trees = [parse(page) for page in pages]
    known = [(t, features(t), labels(t)) for t in trees]
    model = TreeModel({}, [[[0.0, 0.0], [0.0, 0.0]] for _ in range(2)])
    seen: Counter = Counter()
    for _ in range(rounds):
        grad: Counter = Counter()
        pair: Counter = Counter()
        for t, fs, y in known:
            for i, j in enumerate(model.beliefs(t, fs)):
                if not i:
                    continue
                error = y[i] - j[1] - j[3]
                if abs(error) > 1e-4:
                    for f in fs[i]:
                        grad[f] += error
                side = 0 if t.tag[i] in BLOCK else 1
                for k in range(4):
                    pair[side, k >> 1, k & 1] += (k == 2 * y[t.parent[i]] + y[i]) - j[k]
        for f, g in grad.items():
            g -= decay * model.weight.get(f, 0.0)
            seen[f] += g * g
            model.weight[f] = model.weight.get(f, 0.0) + rate * g / (1e-6 + seen[f]) ** 0.5
        for (side, a, b), g in pair.items():
            g -= decay * model.couple[side][a][b]
            seen[side, a, b] += g * g
            model.couple[side][a][b] += rate * g / (1e-6 + seen[side, a, b]) ** 0.5
    return model


def extract_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """pages (page_id, url, html, …) → page_id, url, text; one row per input row, repeated rows included. Null and
    empty html, and pages without content, give an empty text; null ids and urls stay null; extra columns are
    ignored; an empty table gives no rows."""
    model = model or train(training_pages())
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                text = [model.extract(h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url").cast(pa.string()),
                                                  pa.array(text, pa.string())], schema=schema)

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
            .mapInArrow(run, "page_id long, url string, text string"))
