"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A page is read into blocks: text between block-level tags, with the tags and class names above it, how much of it is
link text, and how it looks. The field labels the row of blocks as main text or not: each block by its features, each neighbour pair by
a learned transition, decoded by Viterbi.

It is trained on about `most_pages` labelled pages at most (chosen by a hash of page_id): pages that mark their article with <article>,
<main> or an equal role or item type label themselves. Inside the mark a block is main text unless it lies in an element that is never
article text (navigation, forms, comments and the like); outside it is not. Every page is learned twice, once with
the mark's own features hidden, so that the field also works on pages without the mark. Labels are used for training only.

A page is handled whole, in one row: nothing is dropped or capped. Character references are decoded, white space within
a block becomes one space, blocks are joined by an empty line.

Defined results: null and empty pages, and pages without main blocks, give an empty text; unclosed and stray tags are closed or
skipped as browsers do; without any labelled page all blocks of the body count as main text. Repeated rows get equal results. Other columns pass through.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import share_of
from .words import slices

_END = re.compile(r"[>\"']")
_NAME_END = re.compile(r"[\s/>]")
_ATTRIBUTE = re.compile(r"""(class|id|role|itemtype|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# tags of the HTML standard
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_RAW = set("script style textarea title noscript template iframe svg".split())
_BLOCK = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td
    tfoot th thead tr ul""".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = set("article aside body div dl fieldset footer form header html main nav ol section table ul".split())
MOST_TRAINED = 1_000_000  # features of one training page
# what marks main text, and what is never main text, in the labels
_MARKS = {"<article", "<main", "article", "main", "articlebody"}
_NEVER_TAGS = set("nav header footer aside form menu button select dialog script style noscript template head".split())
_NEVER_NAMES = re.compile(r"^(ad|ads|advert\w*|banner|sponsor\w*|sidebar|side|comments?|replies|reply|disqus|cookies?|consent|notices?|alert|promo\w*|share|sharing|"
                          r"social|related|recommend\w*|breadcrumbs?|menu|nav\w*|newsletter|subscribe|signup|login|popup|modal|overlay|widget|footer|header|toolbar|pager|pagination)$")


class Node:
    """An open element: its tag, and what it adds to the features of those above it."""

    __slots__ = ("above", "tag", "fresh", "all", "marked", "never", "head", "score")

    def __init__(self, above: Node | None, tag: str, words: list[str], open_features: Counter) -> None:
        self.above, self.tag = above, tag
        self.all = [f"under {tag}", *(f"named {w}" for w in dict.fromkeys(words))]
        self.fresh = [f for f in self.all if not open_features[f]]
        never = tag in _NEVER_TAGS or any(_NEVER_NAMES.match(w) for w in words)
        self.marked = bool(above and above.marked) or "<" + tag in _MARKS or any(w in _MARKS for w in words)
        self.fresh += ["never"] * (never and not (above and above.never))
        self.never = never or bool(above and above.never)
        self.head = tag == "head" or bool(above and above.head)
        self.score: tuple[float, float] | None = None


@dataclass
class Block:
    text: str
    node: Node | None  # the element it lies in
    linked: int  # characters inside links


class _Ends:
    """Where tags end: the first `>` outside quotes, for every place of a page at once, so that no tag is looked for twice."""

    def __init__(self, page: str) -> None:
        self.places = [m.start() for m in _END.finditer(page)]
        self.ends = [-1] * (len(self.places) + 1)
        partner = {'"': -1, "'": -1}  # the next quote of a kind, as an index
        for k in range(len(self.places) - 1, -1, -1):
            at = self.places[k]
            c = page[at]
            if c == ">":
                self.ends[k] = at + 1
            else:
                self.ends[k] = self.ends[partner[c] + 1] if partner[c] >= 0 else -1
                partner[c] = k

    def after(self, at: int) -> int:
        return self.ends[bisect_left(self.places, at)]


def _unescape(text: str) -> str:
    try:
        return html.unescape(text)
    except ValueError:  # a number of thousands of digits: no character
        text = re.sub(r"&#0*[1-9][0-9]{7,};?", "\ufffd", text)
        return html.unescape(re.sub(r"&#0+(?=[0-9])", "&#", text))


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page with text, in order. One pass: work grows with the page's length, whatever its tags."""
    out: list[Block] = []
    stack: list[Node] = []
    places: dict[str, list[int]] = {}  # of each tag, where it is open
    blocks: list[int] = []  # where block-level tags are open
    features: Counter = Counter()
    pieces: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(text, stack[-1] if stack else None, min(linked, len(text))))
        pieces.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked
        if raw:
            text = _unescape(raw)
            pieces.append(text)
            if places.get("a"):
                linked += len(" ".join(text.split()))

    def push(tag: str, words: list[str]):
        node = Node(stack[-1] if stack else None, tag, words, features)
        places.setdefault(tag, []).append(len(stack))
        if tag in _BLOCK:
            blocks.append(len(stack))
        features.update(node.all)
        stack.append(node)

    def cut(to: int):
        while len(stack) > to:
            node = stack.pop()
            places[node.tag].pop()
            if node.tag in _BLOCK:
                blocks.pop()
            features.subtract(node.all)

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def close(names: set[str], fence: set[str]):
        at = last(names)
        if at >= 0 and at >= last(fence - names):
            flush()
            cut(at)

    ends, final, at, start, name_end, closers = _Ends(page), page.rfind(">"), 0, 0, -1, {}
    while True:
        lt = page.find("<", at)
        if lt < 0:
            add(page[start:])
            break
        at, c = lt + 1, page[lt + 1:lt + 2]
        if page.startswith("<!--", lt) or page.startswith("<![CDATA[", lt):
            opened, closed = (4, "-->") if page[lt + 2] == "-" else (9, "]]>")
            end = page.find(closed, lt + opened)
            add(page[start:lt])
            if opened == 9:
                pieces.append(page[lt + 9:end if end >= 0 else len(page)])
            start = at = len(page) if end < 0 else end + 3
            continue
        if c in ("!", "?"):
            end = page.find(">", lt) + 1 if lt < final else 0
            if end:
                add(page[start:lt])
                start = at = end
            continue
        first = lt + 2 if c == "/" else lt + 1
        if not (page[first:first + 1].isascii() and page[first:first + 1].isalpha()):
            continue
        if name_end < first:
            m = _NAME_END.search(page, first)
            name_end = m.start() if m else len(page)
        end = ends.after(name_end)
        if end < 0:
            continue
        add(page[start:lt])
        start = at = end
        tag = page[first:name_end].lower()
        if c == "/":
            if tag in _BLOCK:
                flush()
            i = places[tag][-1] if places.get(tag) else -1
            if i >= 0:
                if blocks and blocks[-1] >= i:
                    flush()
                cut(i)
            continue
        inside = page[name_end:end - 1]
        if tag in _BLOCK:
            flush()
            close({"p"}, _FENCE | {"li", "td", "th"})
            close(_CLOSES.get(tag, set()), {"ul", "ol", "dl", "table"} if tag in ("li", "dt", "dd") else {"table", "select"})
        if tag == "br":
            pieces.append(" ")
        if tag in _VOID or inside.endswith("/") and tag not in _BLOCK:
            continue
        if tag in _RAW:
            if tag not in closers:
                closers[tag] = re.compile(rf"</{re.escape(tag)}\s*>", re.I)
            m = closers[tag].search(page, end)
            start = at = m.end() if m else len(page)
            continue
        push(tag, [w for k, x, y, z in _ATTRIBUTE.findall(inside) for w in re.split(r"[\s/_:.-]+", (x or y or z).lower()) if w])
    flush()
    return out


def labels_of(blocks: list[Block]) -> list[int] | None:
    """1 for main text, 0 for the rest, by the page's own mark; None without one."""
    marked = [bool(b.node and b.node.marked) for b in blocks]
    if not any(marked):
        return None
    return [int(m and not b.node.never) for m, b in zip(marked, blocks)]


def own_features(blocks: list[Block]) -> Iterator[list[str]]:
    """What the block itself looks like."""
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        marks = sum(b.text.count(c) for c in ".,;!?")
        yield ["bias", f"parent {b.node.tag if b.node else ''}", f"words {min(words.bit_length(), 8)}", f"links {round(4 * b.linked / len(b.text))}",
               f"marks {min(4, round(20 * marks / words))}", f"ends {b.text[-1] if b.text[-1] in '.!?:' else 'x'}", f"place {min(3, 4 * i // len(blocks))}",
               f"digits {min(3, round(10 * sum(c.isdigit() for c in b.text) / len(b.text)))}", f"rights {'©' in b.text or 'copyright' in b.text.lower()}"]


def features_of(blocks: list[Block]) -> list[list[str]]:
    """All features of each block, those of the elements around it included: for training."""
    out = []
    for b, f in zip(blocks, own_features(blocks)):
        node = b.node
        while node is not None:
            f += node.fresh
            node = node.above
        out.append(f)
    return out


def _hidden(name: str) -> bool:
    kind, _, word = name.partition(" ")
    return kind == "under" and "<" + word in _MARKS or kind == "named" and word in _MARKS


@dataclass
class Field:
    weights: dict[str, tuple[float, float]]
    change: np.ndarray

    def scores(self, blocks: list[Block]) -> list[tuple[float, float]]:
        """Weights of each block's features. Those of the elements around it are added up once per element."""
        none = (0.0, 0.0)
        out = []
        for b, row in zip(blocks, own_features(blocks)):
            path, node = [], b.node
            while node is not None and node.score is None:
                path.append(node)
                node = node.above
            x, y = node.score if node is not None else none
            for node in reversed(path):
                for w in (self.weights.get(f, none) for f in node.fresh):
                    x, y = x + w[0], y + w[1]
                node.score = (x, y)
            for w in (self.weights.get(f, none) for f in row):
                x, y = x + w[0], y + w[1]
            out.append((x, y))
        return out

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The likeliest row of labels of blocks given by their features."""
        none = (0.0, 0.0)
        return self.viterbi([tuple(map(sum, zip(*(self.weights.get(f, none) for f in row)))) if row else none for row in rows])

    def viterbi(self, scores: list[tuple[float, float]]) -> list[int]:
        (a, b), (c, d) = self.change.tolist()
        back, s, t = [], 0.0, 0.0
        for i, (x, y) in enumerate(scores):
            if i:
                to_0, to_1 = (s + a >= t + c), (s + b > t + d)
                back.append((0 if to_0 else 1, 0 if to_1 else 1))
                s, t = max(s + a, t + c) + x, max(s + b, t + d) + y
            else:
                s, t = x, y
        label = int(t > s)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1] if scores else []


def fit(pages: list[str], rounds: int = 60) -> Field | None:
    """Maximum likelihood of the labelled pages by adaptive gradient steps."""
    rows, gold, first = [], [], [0]
    for page in pages:
        blocks = blocks_of(page)
        labels = labels_of(blocks)
        if not blocks or labels is None:
            continue
        depth = 0
        for b in blocks:
            node = b.node
            while node is not None and depth <= MOST_TRAINED:
                depth, node = depth + len(node.fresh) + 1, node.above
        if depth > MOST_TRAINED:  # nested beyond reason: not a page to learn from
            continue
        full = features_of(blocks)
        for f in (full, [[x for x in r if not _hidden(x)] for r in full]):
            rows += f
            gold += labels
            first.append(len(rows))
    if not rows:
        return None
    names = {n: i for i, n in enumerate(sorted({x for r in rows for x in r}))}
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    which = np.array([names[x] for r in rows for x in r])
    y, first = np.array(gold), np.array(first)
    size = np.diff(first)
    longest = int(size.max())
    grid = np.minimum(first[:-1, None] + np.arange(longest), len(rows) - 1)
    live = np.arange(longest) < size[:, None]
    w, change = np.zeros((len(names), 2)), np.zeros((2, 2))
    gw, gc = np.full(w.shape, 1e-8), np.full((2, 2), 1e-8)
    onehot = np.eye(2)[y]
    seen = sum((np.eye(2)[y[grid[live[:, t], t - 1]]].T @ onehot[grid[live[:, t], t]] for t in range(1, longest)), np.zeros((2, 2)))
    for _ in range(rounds):
        score = np.stack([np.bincount(at, w[which, k], len(rows)) for k in (0, 1)], axis=1)
        p = np.where(live[:, :, None], np.exp(score[grid] - score[grid].max(axis=2, keepdims=True)), 1.0)
        step = np.exp(change)
        ahead = np.empty_like(p)
        v = np.full((len(size), 2), 0.5)
        for t in range(longest):
            n = ((v @ step) if t else v) * p[:, t]
            v = np.where(live[:, t, None], n / n.sum(axis=1, keepdims=True), v)
            ahead[:, t] = v
        back, miss, pairs = np.ones((len(size), 2)), onehot.copy(), np.zeros((2, 2))
        for t in range(longest - 1, -1, -1):
            on = live[:, t]
            g = ahead[:, t] * back
            miss[grid[on, t]] -= (g / g.sum(axis=1, keepdims=True))[on]
            if t:
                x = ahead[:, t - 1][:, :, None] * step * (p[:, t] * back)[:, None, :]
                pairs += (x / x.sum(axis=(1, 2), keepdims=True))[on].sum(axis=0)
            n = (p[:, t] * back) @ step.T
            back = np.where(on[:, None], n / n.sum(axis=1, keepdims=True), back)
        slope = np.stack([np.bincount(which, miss[at, k], len(names)) for k in (0, 1)], axis=1) - 0.02 * w
        slope_c = seen - pairs - 0.02 * change
        gw += slope ** 2
        gc += slope_c ** 2
        w += 0.3 * slope / np.sqrt(gw)
        change += 0.3 * slope_c / np.sqrt(gc)
    return Field({n: (float(w[i, 0]), float(w[i, 1])) for n, i in names.items()}, change)


def learn(pages: DataFrame, most_pages: int = 400) -> Field | None:
    """Fit on a bounded sample of the pages that mark their article."""
    marked = pages.filter(F.lower("html").rlike(r"<article|<main|role\s*=\s*.?(article|main)|articlebody"))
    rows = marked.filter(share_of("page_id", most_pages, marked.count())).select("page_id", "html").collect()
    return fit([r["html"] for r in sorted(rows, key=lambda r: (r["page_id"] is None, r["page_id"], r["html"]))])


def extract(pages: DataFrame, field: Field | None) -> DataFrame:
    """`pages` without html, with text and n_chars."""
    others = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def main_text(page: str) -> str:
        blocks = blocks_of(page)
        own = shared.value
        keep = own.viterbi(own.scores(blocks)) if own else [int(not (b.node and b.node.head)) for b in blocks]
        return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                text = [main_text(x.as_py() or "") for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                                                 [*others, "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select(*others, "html").mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in others], "text string, n_chars bigint"]))
