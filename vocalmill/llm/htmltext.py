"""Main text of web pages by minimum-cut labelling of text blocks.

A page is cut into blocks: stretches of text between block-level boundaries, each with its place in the element
tree.  A logistic classifier over shape features (length, links, punctuation, tag, place) gives each block a cost
of being called content or boilerplate; these are its capacities to the two terminals.  Elements and attributes
that say what a part is (navigation, footer, advert, comments, article ...) shift these by bounded amounts, see
:class:`Element`; only hidden parts never count.  Neighbouring blocks, and blocks that follow one another under one parent element,
are joined by edges, stronger the closer they are in the tree.  The minimum cut is the labelling; blocks whose
terminal capacity exceeds all their edges are settled first, and augmenting paths find the rest.

The classifier is trained on at most ``TRAIN_PAGES`` pages (those with the least hash), ``TRAIN_BLOCKS`` blocks of each,
on blocks that elements of the HTML standard mark: inside an article or main element, or inside navigation and the
like.  Class words give no labels, so what they mark is judged by what was learned elsewhere.  Pages are independent,
so nothing but that sample is moved.

Defined cases: a null or empty page, and one without text or content, gives an empty text; a very long page is cut
whole; a block for which both labels cost the same is boilerplate; unclosed and misplaced tags are closed as browsers
do for paragraphs, list items and table cells; hidden parts don't count; without a trainable sample built-in weights
apply; repeated rows get repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

TRAIN_PAGES = 1_000
#: Blocks of a training page that the classifier learns from, the first ones.
TRAIN_BLOCKS = 1_000
SURE = 1000.0
#: Shifts of the terminal capacity.  The classifier part is at most ODDS either way, edges are at most 3 each: no mark outweighs both.
ODDS, IN_SHIFT, OUT_SHIFT, CLASS_SHIFT, GOOD_SHIFT, FRAME_SHIFT = 4.0, 4.0, -5.5, -5.5, 0.75, -4.0

# Fixed sets of the HTML standard: elements without content, elements whose content isn't page text, block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style noscript template svg math iframe object canvas audio video textarea select button title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
FENCES = frozenset("ul ol dl table div article section body main aside nav form".split())

#: Elements and words of class, id and role that mark boilerplate, and those that mark content.
NOT_CONTENT = frozenset("nav footer aside dialog menu".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar aside footer header masthead topbar banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login "
    "register form search searchbox share sharing social follow related recommended recommendations trending popular teaser comment comments commentlist reply replies respond disqus discussion "
    "widget widgets pagination pager paging toolbar skip copyright legal disclaimer contentinfo complementary".split()
)
GOOD_WORDS = frozenset("article content main post entry body story text page prose".split())
HEADER_FREE = frozenset(("article", "main"))
#: Words of a class name that tell how a page is laid out, as in no-sidebar and page-with-comments.
LAYOUT_WORDS = frozenset("no without with has".split())

_TAG = re.compile(r"""<(?:!--(?s:.*?)(?:-->|\Z)|([/!?]?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|([/!?]?)([A-Za-z][^\s/>]*+)([^>]*+)>|[!?/][^>]*+>)""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
_CUT_OFF = re.compile(r"<[A-Za-z/!?]")
#: A heading over what readers wrote.
_COMMENTS = re.compile(r"\W*(?:\d+\W+)?(?:comments?|repl(?:y|ies)|responses?|discussion|(?:leave|post|write) an? (?:comment|reply)|kommentare?|commentaires?|comentarios?)\b\W*(?:\d+)?\W*", re.I)
#: A heading that counts comments or calls for them; one that names them; and what stands with a comment.
_COUNTED = re.compile(r"\d|leave|post|write", re.I)
_NAMED = re.compile(r"comment|kommentar|comentario", re.I)
_REPLY = re.compile(r"\W*(?:reply|respond|report|like|quote|antworten|melden|répondre|signaler|responder)\W*", re.I)
_WHEN = re.compile(r"\b\d{1,2}:\d{2}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d{1,2}\.? [A-Za-zäéû]{3,9}\.? \d{4}\b|\b[A-Z][a-z]{2,8} \d{1,2}, \d{4}\b|\b\d+ (?:second|minute|hour|day|week|month|year)s? ago\b|\bvor \d+ |\bil y a \d+ |\bhace \d+ ")
_SAYS = re.compile(r"\b(?:says|said|wrote|writes|schrieb|sagt|dice|escribió|a écrit|dit)\s*:", re.I)
_LEGAL = re.compile(r"©|\(c\)|copyright\b|all rights reserved", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Element:
    """An element and what it says about its text: ``mark`` is "in", "out", "class" or none, by the innermost rule.

    ``article`` and ``main`` mark "in", and so undo a mark from around them, unless an outer article holds that mark;
    an article whose own class, id or role has words for boilerplate is marked "class" if it has no word for content
    or its surroundings are marked.  Elements for boilerplate, and headers outside articles, mark "out".  Other
    elements with words for boilerplate but none for content mark "class", where nothing marks "out" already; so do
    forms, as some systems wrap whole pages in one.
    Names with a layout word (no-sidebar) say nothing.
    """

    __slots__ = ("tag", "parent", "mark", "hidden", "good", "in_article", "nested", "link", "depth")

    def __init__(self, tag: str, parent: Element | None, attributes: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.mark = parent.mark if parent else None
        self.hidden = parent.hidden if parent else False
        self.good = parent.good if parent else False
        self.in_article = (parent.in_article if parent else False) or tag in HEADER_FREE
        self.nested = (parent.nested if parent else False) or tag == "article"
        self.link = (parent.link if parent else False) or tag == "a"
        words: set[str] = set()
        if attributes:
            found = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)}
            if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
                self.hidden = True
            names = ({w.lower() for w in _WORD.findall(name)} for key in ("class", "id", "role") for name in found.get(key, "").split())
            words = {w for name in names if LAYOUT_WORDS.isdisjoint(name) for w in name}
        bad, good = not words.isdisjoint(BAD_WORDS), not words.isdisjoint(GOOD_WORDS)
        if tag in HEADER_FREE:
            bad = not words.isdisjoint(BAD_WORDS - {"header"})
            if bad and (not good or self.mark in ("out", "class")):
                self.mark = "class"
            elif not (tag == "article" and parent and parent.nested and parent.mark != "in"):
                self.mark = "in"
            self.good = True
        elif tag in NOT_CONTENT or (tag == "header" and not self.in_article):
            self.mark = "out"
        elif (words or tag == "form") and tag not in ("html", "body"):
            bad = bad or tag == "form"
            if self.in_article and (tag == "header" or (words & {"header"} and not words & (BAD_WORDS - {"header"}))):
                bad = False
            if bad and not good and self.mark != "out":
                self.mark = "class"
            self.good = self.good or good

    @property
    def bad(self) -> bool:
        """Marked as boilerplate, or hidden."""
        return self.hidden or self.mark in ("out", "class")


@dataclass
class Block:
    """A stretch of text: its element (the nearest block-level one), its text, and how much of it is in links."""

    element: Element
    text: str
    linked: int
    bad: bool
    hidden: bool


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    root = here = Element("#root", None, "")
    texts: list[str] = []
    linked: list[str] = []
    at, size, last_close = 0, len(page), page.rfind(">")

    def flush() -> None:
        if texts:
            text = " ".join(entities.unescape("".join(texts)).split())
            if text:
                holder = here
                while holder.parent and holder.tag not in BLOCK:
                    holder = holder.parent
                out.append(Block(holder, text, len(" ".join(entities.unescape("".join(linked)).split())), here.bad and holder.bad, here.hidden and holder.hidden))
            texts.clear()
            linked.clear()

    def add(piece: str) -> None:
        if piece:
            texts.append(piece)
            if here.link:
                linked.append(piece)

    while at < size:
        start = page.find("<", at)
        if start < 0 or start > last_close:  # no whole tag can follow; one that is cut off is no text
            cut = _CUT_OFF.search(page, at)
            add(page[at : cut.start() if cut else size])
            break
        if start > at:
            add(page[at:start])
        m = _TAG.match(page, start)
        if m is None:
            add("<")
            at = start + 1
            continue
        at = m.end()
        sign, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name or sign in ("!", "?"):
            continue
        tag = name.lower()
        if sign == "/":
            if tag == "p" or tag in BLOCK:
                flush()
            node, fenced = here, False
            while node is not root and node.tag != tag:
                fenced = fenced or (tag not in BLOCK and node.tag in BLOCK) or (tag in ("p", "li") and node.tag in FENCES)
                node = node.parent
            if node is not root and not fenced:
                here = node.parent
            continue
        if tag in OPAQUE:
            if tag not in ("svg", "math") or not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                close = page.find(">", end.start()) if end else -1
                at = close + 1 if close >= 0 else size
            texts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            node = here
            while node is not root and node.tag not in FENCES and node.tag != "p":
                node = node.parent
            if node is not root and node.tag == "p":
                here = node.parent
            if wanted := CLOSES.get(tag):
                node = here
                while node is not root and node.tag not in wanted and not (node.tag in FENCES and node.tag not in wanted):
                    node = node.parent
                while node is not root and node.tag in wanted:
                    here = node.parent
                    node = here
        if tag in VOID:
            if tag in ("br", "hr", "img"):
                texts.append(" ")
            continue
        here = Element(tag, here, rest)
    flush()
    return out


FEATURES = ("bias", "log_length", "log_words", "link_share", "punctuation", "is_paragraph", "is_heading", "is_item", "place", "long", "legal")
#: Weights for when no sample can be trained on.
DEFAULT = (-1.0, 0.3, 0.3, -4.0, 1.0, 0.8, 0.2, -0.8, 0.0, 1.0, -6.0)


def features(blocks: list[Block]) -> np.ndarray:
    """A row of shape features for each block."""
    n = len(blocks)
    rows = np.empty((n, len(FEATURES)))
    for i, b in enumerate(blocks):
        size, words = len(b.text), b.text.count(" ") + 1
        marks = sum(map(b.text.count, ".,;:!?"))
        tag = b.element.tag
        rows[i] = (1, math.log1p(size), math.log1p(words), min(1.0, b.linked / size), min(1.0, 5 * marks / words), tag == "p", tag[0] == "h" and tag[1:].isdigit(), tag in ("li", "td", "th", "dt", "dd"), abs(2 * i / max(1, n - 1) - 1), size > 200, _LEGAL.match(b.text) is not None)
    return rows


def _level(block: Block) -> int:
    """The level of a heading, 0 for other blocks."""
    tag = block.element.tag
    return int(tag[1:]) if tag[0] == "h" and tag[1:].isdigit() else 0


def _inside(element: Element | None, parent: Element | None) -> bool:
    while element is not None and element is not parent:
        element = element.parent
    return element is parent


def _readers_wrote(heading: str, part: list[Block]) -> bool:
    """Whether what stands under a heading looks like readers' comments: a count or a call in the heading, or names with
    times, links to reply, a form, or several like pieces that begin with a short line."""
    if _COUNTED.search(heading):
        return True
    if any(len(b.text) <= 80 and (_REPLY.fullmatch(b.text) or _WHEN.search(b.text) or _SAYS.search(b.text)) for b in part):
        return True
    if any(b.element.tag in ("form", "label", "fieldset") or b.element.mark == "class" for b in part):
        return True
    holders: dict[int, list[Block]] = {}
    for b in part:
        holders.setdefault(id(b.element.parent), []).append(b)
    named = [g for g in holders.values() if len(g) > 1 and len(g[0].text) <= 40 and not g[0].text.endswith((".", "!", "?")) and len(g[0].text) < len(g[1].text)]
    return len(named) > 1


def comment_blocks(blocks: list[Block]) -> list[bool]:
    """Whether a block is a heading over readers' comments, or stands in the part under it.

    A part goes on inside the heading's parent element to the next heading there of the same level or above.  Its heading
    may be that of an article's section, too: so the part must look like comments, or be headed by that very word and be
    the last in its parent.
    """
    out = [False] * len(blocks)
    for i, b in enumerate(blocks):
        level = _level(b)
        if not level or not i or out[i] or not _COMMENTS.fullmatch(b.text):
            continue
        parent, end = b.element.parent, i + 1
        while end < len(blocks) and _inside(blocks[end].element, parent) and not (0 < _level(blocks[end]) <= level and blocks[end].element.parent is parent):
            end += 1
        last = end == len(blocks) or not _inside(blocks[end].element, parent)
        if _readers_wrote(b.text, blocks[i + 1 : end]) or (last and _NAMED.search(b.text)):
            out[i:end] = [True] * (end - i)
    return out


def terminals(blocks: list[Block], weights: np.ndarray) -> list[float]:
    """Content capacity less boilerplate capacity of each block."""
    said = comment_blocks(blocks)
    odds = np.clip(features(blocks) @ weights, -ODDS, ODDS).tolist()
    framed = any(b.element.mark == "in" and not b.bad for b in blocks)
    # class words say nothing if all that looks like content is under them: then they name a wrapper of the page
    told = any(not b.bad and (z > 0 or b.element.mark == "in") for b, z in zip(blocks, odds, strict=True))
    out = []
    for b, z, comment in zip(blocks, odds, said, strict=True):
        mark = b.element.mark
        if b.hidden:
            out.append(-SURE)
        elif comment:
            out.append(min(z, 0.0) + OUT_SHIFT + FRAME_SHIFT)
        elif mark == "in":
            out.append(z + IN_SHIFT)
        else:
            # where an article is marked, what stands outside it needs a strong case
            shift = OUT_SHIFT if mark == "out" else CLASS_SHIFT if mark == "class" and told else GOOD_SHIFT * b.element.good
            out.append(z + shift + FRAME_SHIFT * framed)
    return out


def closeness(a: Element, b: Element) -> float:
    """Edge capacity of two blocks by their distance in the element tree."""
    distance = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        distance += 1
    return 3.0 / (1 + distance)


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in page order, and consecutive blocks under one parent element."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            out[i - 1, i] = closeness(blocks[i - 1].element, b.element)
        parent = id(b.element.parent)
        before = last.get(parent)
        if before is not None and before != i - 1:
            out[before, i] = 1.0
        last[parent] = i
    return [(a, b, c) for (a, b), c in out.items()]


def minimum_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The side of each node: true for the source.  Positive terminals pull to the source, negative to the sink.

    Of several minimum cuts it is the one with the fewest source nodes.
    """
    n = len(terminal)
    pull, near = list(terminal), [dict() for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # settle what its neighbours can't turn
        i = queue.popleft()
        if side[i] is not None:
            continue
        around = sum(near[i].values())
        if pull[i] > around or pull[i] <= -around:
            side[i] = pull[i] > around
            for j, c in near[i].items():
                pull[j] += c if side[i] else -c
                del near[j][i]
                queue.append(j)
            near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if left:
        for i in _source_side(left, pull, near):
            side[i] = True
    return [bool(s) for s in side]


def _source_side(nodes: list[int], pull: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes that the source still reaches after the maximum flow, by shortest augmenting paths."""
    source, sink = -1, -2
    rest: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    rest[source], rest[sink] = {}, {}
    for i in nodes:
        if pull[i] > 0:
            rest[source][i], rest[i][source] = pull[i], 0.0
        elif pull[i] < 0:
            rest[i][sink], rest[sink][i] = -pull[i], 0.0
    while True:
        came = {source: source}
        queue = deque((source,))
        while queue and sink not in came:
            i = queue.popleft()
            for j, c in rest[i].items():
                if c > 1e-9 and j not in came:
                    came[j] = i
                    queue.append(j)
        if sink not in came:
            return {i for i in came if i >= 0}
        path, j = [], sink
        while j != source:
            path.append((came[j], j))
            j = came[j]
        flow = min(rest[a][b] for a, b in path)
        for a, b in path:
            rest[a][b] -= flow
            rest[b][a] = rest[b].get(a, 0.0) + flow


def main_text(page: str | None, weights: np.ndarray) -> str:
    """The page's main text: content blocks in page order, joined by a space."""
    if not page:
        return ""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    chosen = minimum_cut(terminals(blocks, weights), edges_of(blocks))
    return " ".join(b.text for b, c in zip(blocks, chosen, strict=True) if c)


def train(pages: DataFrame, html_col: str = "html", train_pages: int = TRAIN_PAGES) -> np.ndarray:
    """Weights of the block classifier from a bounded sample of pages; the driver gets sums for each page's blocks."""
    chosen = pages.select(F.xxhash64(F.col(html_col).cast("string")).alias("h")).distinct().orderBy("h").limit(train_pages)
    sample = pages.select(F.col(html_col).cast("string").alias("page"), F.xxhash64(F.col(html_col).cast("string")).alias("h")).where("page IS NOT NULL")
    sample = sample.join(F.broadcast(chosen), "h").dropDuplicates(["h"])  # one number for each of train_pages pages

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.text_slices(batches):
            keys, raw, labels = [], [], []
            for h, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                blocks = blocks_of(page)
                known = [i for i, b in enumerate(blocks) if not b.hidden and b.element.mark in ("in", "out")][:TRAIN_BLOCKS]
                if known:
                    keys.append(h)
                    raw.append(features(blocks)[known].astype(np.float32).tobytes())
                    labels.append(np.array([blocks[i].element.mark == "in" for i in known], np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(raw, pa.binary()), pa.array(labels, pa.binary())], names=["h", "x", "y"])

    got = sample.select("h", "page").mapInArrow(rows, "h bigint, x binary, y binary").toArrow().sort_by("h")
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, len(FEATURES)).astype(float)
    y = np.frombuffer(b"".join(got.column("y").to_pylist()), np.uint8).astype(float)
    if not len(y) or y.min() == y.max():
        return np.array(DEFAULT)
    w = np.zeros(x.shape[1])
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (balance * p * (1 - p) + 1e-9)[:, None]).T @ x + np.eye(len(w)), x.T @ (balance * (y - p)) - w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def extract(pages: DataFrame, weights: np.ndarray, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The id columns, ``text`` and ``n_chars`` (code points) of every page."""
    source = pages.select(*(F.col(c).alias(f"k{k}") for k, c in enumerate(id_cols)), F.col(html_col).cast("string").alias("page"))
    schema = source.drop("page").withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("bigint")).schema
    at, given = len(id_cols), [float(w) for w in weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array(given)
        for part in C.text_slices(batches, at):
            texts = [main_text(p, own) for p in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema).select(*(F.col(f"k{k}").alias(c) for k, c in enumerate(id_cols)), "text", "n_chars")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages")
    return extract(pages, train(pages))


QUERIES = {"op7_html_extraction": op7_html_extraction}
ORACLE: dict[str, str] = {}
