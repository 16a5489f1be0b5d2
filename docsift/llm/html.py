"""Main text of web pages by minimum-cut labelling.

A page is read once into blocks (runs of text between block-level tags). A linear classifier gives each block the log-odds of
being content, from its length, links, ending and kind of element; what the elements around it are and are called adds to them.
Odds for content are the capacity from the source, odds against it the capacity to the sink. Neighbours in page order, and blocks
of one parent element, are joined by edges whose capacity falls with their distance in the element tree; an element that sets a
part of the page off (a menu, an advert) counts as several steps. The minimum cut, found by maximum flow, labels all blocks of
the page together: source side is content.

The classifier is a logistic regression, fitted on a bounded sample of pages. Blocks inside an article or main element are its
content rows, blocks inside a menu, footer, form or the like the others; those elements are not among its features. Its rows are
counts of the few hundred patterns that features can have, summed on the executors. A prior keeps it near fixed weights where
pages teach little, and its odds are bounded, so neighbours can outvote a doubtful block.

A block whose odds outweigh all its edges has its label in every minimum cut; such blocks are settled first and their edges
become capacities of their neighbours, so on a long page the flow runs over the doubtful blocks alone, with the same result.

Reader comments go even where no class says so: an article inside an article, and what follows a heading that says "Comments".

Defined results: null or blank html gives empty text; broken markup never fails (an open tag without an end is text, a close
tag without a start is ignored); without a block to learn from the weights are the prior's; repeated rows each get a row; columns
other than those named are not read.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.llm.shared import slices, table

# What HTML says of its elements.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe object svg math canvas audio video head select button".split())
ENDED_BY = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}

# Log-odds of what stands around a block. Names are words of class, id and role.
ELEMENTS = {"article": 2.0, "main": 1.5, "nav": -8.0, "footer": -8.0, "header": -8.0, "aside": -8.0, "form": -8.0, "menu": -8.0, "dialog": -8.0, "search": -8.0, "fieldset": -6.0, "address": -1.0}
#: A header inside an article holds its headline as a rule; an article inside an article is a comment on it.
HEADER_IN_ARTICLE, COMMENT = -0.5, -8.0
NAMED, MAYBE, MIXED, FOR = -8.0, -3.0, -2.0, 1.0
AGAINST_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense adbox banner banners sponsor sponsored menu menus nav navbar navigation sidebar sidebars footer masthead topbar toolbar comment comments commentlist respond disqus cookie cookies consent gdpr popup modal overlay notice notices share sharing social breadcrumb breadcrumbs pagination pager newsletter subscribe subscription signup login signin complementary contentinfo form".split())
MAYBE_WORDS = frozenset("promo promotion promoted side reply replies discussion notification alert warning related recommended recommendations widget widgets search copyright legal disclaimer hidden dialog".split())
FOR_WORDS = frozenset("article content entry post story main body text".split())
#: Bounds of what surroundings add, and the odds below which nothing inside counts for content any more.
LOWEST, HIGHEST, LOST = -12.0, 2.0, -3.0
#: What text has that stands in no element but the body.
BARE = 1.4
_COMMENTS = re.compile(r"(?:\d+ )?(?:reader |user )?(?:comments?|responses|replies|kommentare?|leserkommentare|commentaires?|comentarios?|commenti)(?: \(?\d+\)?)?:?|(?:leave|post|write|add) an? (?:comment|reply)\.?:?", re.I)

# The linear classifier: features of a block are few enough to number all their patterns.
WORDS, LINKS, KINDS = 8, 4, ("other", "paragraph", "item", "heading")
KIND = {**dict.fromkeys(("p", "blockquote", "pre"), 1), **dict.fromkeys(("li", "dt", "dd", "td", "th", "option", "label", "figcaption", "caption"), 2), **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 3)}
# The prior's weights of a constant, doublings of words, share of linked characters, an end of sentence, and the kinds after the first.
PRIOR = (-0.7, 0.45, -4.5, 0.4, 0.8, 0.0, 0.8)
#: Weight of the prior, rows that the labelled blocks weigh together at most, and the bound of the classifier's odds.
HOLD, WEIGH, BOUND = 10.0, 1000.0, 2.5
#: Pages that the classifier is fitted on, about; those of the least hash of their id.
SAMPLE = 20_000
#: Capacities of edges: next to each other and of one parent, divided by one more than their distance in the tree, and the steps
#: that the border of an element set off counts as.
NEXT, SIBLING, BORDER = 3.0, 1.5, 5
#: Flow is counted in whole numbers.
SCALE = 1000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)[^>]*>", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _patterns() -> np.ndarray:
    """The features of every pattern, in the order of their numbers."""
    rows = [(1, w, k / LINKS, e, *(float(kind == j) for j in range(1, len(KINDS)))) for w in range(WORDS) for k in range(LINKS + 1) for e in (0, 1) for kind in range(len(KINDS))]
    return np.array(rows, float)


PATTERNS = _patterns()


def _pattern(words: int, linked: float, ends: bool, kind: int) -> int:
    return (((min(WORDS, words.bit_length()) - 1) * (LINKS + 1) + int(np.ceil(LINKS * min(1.0, linked)))) * 2 + ends) * len(KINDS) + kind


def odds_of(weights=PRIOR) -> list[float]:
    """Bounded log-odds by pattern."""
    return np.clip(PATTERNS @ np.array(weights), -BOUND, BOUND).tolist()


def regression(content: np.ndarray, other: np.ndarray) -> tuple[float, ...]:
    """Weights of the classifier from counts by pattern: Newton steps on the logistic loss with a normal prior around PRIOR."""
    n = content + other
    prior = np.array(PRIOR)
    if not n.sum():
        return PRIOR
    scale = min(1.0, WEIGH / n.sum())
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(PATTERNS @ w, -30, 30)))
        slope = PATTERNS.T @ (scale * (content - n * p)) - HOLD * (w - prior)
        curve = (PATTERNS * (scale * n * p * (1 - p))[:, None]).T @ PATTERNS + HOLD * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def _by_names(attributes: str) -> float:
    if "=" not in attributes and "idden" not in attributes:
        return 0.0
    if _HIDDEN.search(attributes):
        return NAMED
    words = {w.lower() for m in _NAMED.finditer(attributes) for w in _WORDS.findall(m[1] or m[2] or m[3] or "")}
    if words & FOR_WORDS:
        return FOR + MIXED * bool(words & AGAINST_WORDS or words & MAYBE_WORDS)
    return NAMED if words & AGAINST_WORDS else MAYBE if words & MAYBE_WORDS else 0.0


class Block:
    """Text, number of its features' pattern, odds of its surroundings, and the numbers of the elements around it.

    Numbers of elements that set a part of the page off are negative.
    """

    __slots__ = ("text", "pattern", "around", "path")

    def __init__(self, text: str, pattern: int, around: float, path: tuple):
        self.text, self.pattern, self.around, self.path = text, pattern, around, path


def blocks(html: str) -> list[Block]:
    """The blocks of a page, in order."""
    out: list[Block] = []
    tags: list[str] = []
    odds: list[float] = [0.0]
    path: list[int] = []
    parts: list[str] = []
    linked = in_article = number = 0
    link = False

    def flush() -> None:
        nonlocal linked
        text = "".join(parts)
        parts.clear()
        if text and not text.isspace():
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                kind = KIND.get(tags[-1], 0) if tags else 0
                if kind == 3 and tags[-1] != "h1" and _COMMENTS.fullmatch(text):
                    odds[-2:] = [max(LOWEST, x + COMMENT) for x in odds[-2:]]  # the heading and the rest of its parent
                around = odds[-1] if any(t not in ("html", "body") for t in tags) else BARE
                out.append(Block(text, _pattern(text.count(" ") + 1, linked / len(text), text[-1] in ".!?…:;\"”»", kind), around, tuple(path)))
        linked = 0

    def close(to: int) -> None:
        nonlocal in_article
        in_article -= tags[to:].count("article")
        del tags[to:], odds[to + 1 :], path[to:]

    at, size = 0, len(html)
    while at < size:
        m = _TAG.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece:
            parts.append(piece)
            if link:
                linked += len(piece.strip())
        if m is None:
            break
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name == "a":
                link = False
            elif name in BLOCK:
                flush()
                for i in range(len(tags) - 1, -1, -1):
                    if tags[i] == name:
                        close(i)
                        break
            continue
        name = m[2] or m[4]
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if name in ("head", "svg", "math", "select", "object", "video", "audio"):
                flush()
            if not (m[3] or "").endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                body = re.compile(r"<body[\s>]", re.I).search(html, at) if name == "head" else None
                at = min([x for x in (end and end.end(), body and body.start()) if x], default=at if name not in ("script", "style") else size)
            parts.append(" ")
        elif name == "a":
            link = True
        elif name in VOID:
            if name == "hr":
                flush()
            parts.append(" ")
        elif name in BLOCK:
            flush()
            if tags and tags[-1] == "p":
                close(len(tags) - 1)
            if stop := ENDED_BY.get(name):
                for i in range(len(tags) - 1, -1, -1):
                    if tags[i] in stop:
                        break
                    if tags[i] == name or tags[i] in SAME.get(name, ()):
                        close(i)
                        break
            own = ELEMENTS.get(name, 0.0)
            if in_article and name in ("header", "article"):
                own = HEADER_IN_ARTICLE if name == "header" else COMMENT
            if m[3] and name not in ("html", "body"):
                own += _by_names(m[3])
            in_article += name == "article"
            if odds[-1] <= LOST:
                own = min(own, 0.0)
            number += 1
            tags.append(name)
            odds.append(min(HIGHEST, max(LOWEST, odds[-1] + own)))
            path.append(-number if own <= LOST else number)
    flush()
    return out


def _apart(a: tuple, b: tuple) -> int:
    """Steps between two elements of the tree."""
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    return sum(1 if x > 0 else BORDER for x in a[same:]) + sum(1 if x > 0 else BORDER for x in b[same:])


def edges(page: list[Block]) -> dict[tuple[int, int], int]:
    """Smoothness: each block to the next one, and to the next one under the same parent element."""
    out: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(page):
        if i:
            out[i - 1, i] = int(SCALE * NEXT / (1 + _apart(page[i - 1].path, b.path)))
        parent = b.path[-2] if len(b.path) > 1 else 0
        if (j := last.get(parent)) is not None:
            out[j, i] = out.get((j, i), 0) + int(SCALE * SIBLING / (1 + _apart(page[j].path, b.path)))
        last[parent] = i
    return out


def settle(unary: list[int], joined: dict[tuple[int, int], int]) -> tuple[list[int], list[bool | None], dict[int, dict[int, int]]]:
    """Labels of blocks that outweigh their edges; the odds and edges that are left."""
    unary, label = list(unary), [None] * len(unary)
    near: dict[int, dict[int, int]] = {i: {} for i in range(len(unary))}
    for (i, j), c in joined.items():
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
    todo = deque(range(len(unary)))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(unary[i]) > sum(near[i].values()):
            label[i] = unary[i] > 0
            for j, c in near.pop(i).items():
                del near[j][i]
                unary[j] += c if label[i] else -c
                todo.append(j)
    return unary, label, near


def min_cut(unary: list[int], joined: dict[tuple[int, int], int]) -> list[bool]:
    """True for the source side of a minimum cut; unary: source capacity if positive, sink capacity if negative."""
    unary, label, near = settle(unary, joined)
    for first, x in enumerate(label):
        if x is None:  # the doubtful blocks that hang together
            part = [first]
            label[first] = False
            for i in part:
                for j in near[i]:
                    if label[j] is None:
                        label[j] = False
                        part.append(j)
            for i in _source_side(part, unary, near):
                label[i] = True
    return label


def _source_side(part: list[int], unary: list[int], near: dict[int, dict[int, int]]) -> list[int]:
    """Maximum flow over some blocks; those that the source still reaches."""
    source, sink = -1, -2
    cap: dict[int, dict[int, int]] = {i: dict(near[i]) for i in part}
    cap[source], cap[sink] = {}, {}
    for i in part:
        a, b, c = (source, i, unary[i]) if unary[i] > 0 else (i, sink, -unary[i])
        cap[a][b], cap[b][a] = c, 0

    def levels() -> dict[int, int]:
        level, todo = {source: 0}, deque([source])
        while todo:
            u = todo.popleft()
            for v, c in cap[u].items():
                if c > 0 and v not in level:
                    level[v] = level[u] + 1
                    todo.append(v)
        return level

    while sink in (level := levels()):  # blocking flow in the level graph; a way is passed over once it is of no more use
        ways, at = {u: list(vs) for u, vs in cap.items()}, dict.fromkeys(cap, 0)
        trail = [source]
        while trail:
            u = trail[-1]
            if u == sink:
                flow = min(cap[a][b] for a, b in zip(trail, trail[1:], strict=False))
                cut = 0
                for k in range(len(trail) - 2, -1, -1):
                    a, b = trail[k], trail[k + 1]
                    cap[a][b] -= flow
                    cap[b][a] += flow
                    if not cap[a][b]:
                        cut = k
                del trail[cut + 1 :]
                continue
            to, k = ways[u], at[u]
            while k < len(to) and not (cap[u][to[k]] > 0 and level.get(to[k], 0) == level[u] + 1):
                k += 1
            at[u] = k
            if k < len(to):
                trail.append(to[k])
            else:
                trail.pop()
                if trail:
                    at[trail[-1]] += 1
    return [i for i in part if i in level]


def main_text(html: str | None, odds: list[float] | None = None) -> str:
    """Content blocks in page order, one a line; ``odds`` by pattern are the prior's if not given."""
    page = blocks(html) if html else []
    odds = odds_of() if odds is None else odds
    keep = min_cut([int(SCALE * (odds[b.pattern] + b.around)) for b in page], edges(page))
    return "\n".join(b.text for b, k in zip(page, keep, strict=True) if k)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> tuple[float, ...]:
    """Weights of the classifier, from about ``sample`` pages; the driver gets one row a pattern at most."""
    h = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(9)), F.lit(1 << 30))
    bound = min(1 << 30, (1 << 30) * sample // max(1, pages.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, other = np.zeros(len(PATTERNS), np.int64), np.zeros(len(PATTERNS), np.int64)
        for b in slices(batches):
            for html in b.column(0):
                for x in blocks(html.as_py() or ""):
                    if x.around >= ELEMENTS["main"]:
                        content[x.pattern] += 1
                    elif x.around <= LOST:
                        other[x.pattern] += 1
        at = np.flatnonzero(content + other)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(content[at]), pa.array(other[at])], names=["pattern", "content", "other"])

    counted = pages.where(h < bound).select(html_col).mapInArrow(run, "pattern int, content bigint, other bigint")
    content, other = np.zeros(len(PATTERNS)), np.zeros(len(PATTERNS))
    for r in counted.groupBy("pattern").agg(F.sum("content").alias("content"), F.sum("other").alias("other")).collect():
        content[r.pattern], other[r.pattern] = r.content, r.other
    return regression(content, other)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), weights: tuple[float, ...] | None = None) -> DataFrame:
    """The columns kept, and ``text``; a pass without a shuffle. Without ``weights`` they are fitted first, by the first column kept."""
    odds = odds_of(fit(pages, keep[0], html_col) if weights is None else weights)
    rows = pages.select(*[F.col(k) for k in keep], F.col(html_col).alias("_html"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            text = pa.array([main_text(x.as_py(), odds) for x in b.column(b.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text], names=schema.names)

    return rows.mapInArrow(run, schema)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
