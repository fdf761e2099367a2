"""Main-text extraction by minimum-cut labelling of page blocks.

A page is read into blocks, the runs of text between block-level tags, each with
the elements around it.  A linear classifier turns what a block's text looks like
into log-odds of being content, at most ``TEXT_MOST`` either way, and what the
names of the elements around it hint at is added with the fixed weights of
``HINTS``; the sum is cut at ``MOST``.  Positive odds become the capacity of the
edge from the source, negative odds of the edge to the sink.  Neighbouring blocks
are joined by smoothness edges, the stronger the more of their enclosing elements
they share, and further edges join the closest blocks under one parent.  The
minimum cut, found by max-flow, keeps the blocks on the source side.  The name of a
paragraph, heading, item or cell alone decides nothing: with an odd class it goes
with its neighbours unless its text stands apart too.  A name of a larger element
weighs as boilerplate only where its other words are known (``social-links``, not
``social-history``).  Items of one list or table share the doubt of one text, and
the wording of consent notices counts against a block without any name.

Blocks whose own odds outweigh all their smoothness edges have the same label in
every minimum cut; they are fixed first and the flow runs on what is left.

The classifier is trained on a bounded sample of pages (``SAMPLE`` rows of least
id hash).  Its labels come from elements that say what they hold (article,
main, nav, footer and so on) and it sees the text only.  Where the sample has
blocks of one kind only, prior weights serve.

Defined cases: null and empty pages have an empty text; text outside any
element is a block; unclosed elements end where HTML ends them or with the
page; unclosed comments, scripts and tags run to the end of the page; pages of
any length are read whole; repeated rows are reported each; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the classifier is trained on, at most.
SAMPLE = 1000
#: Smoothness of two neighbouring blocks: the least, and what grows with the share of enclosing elements in common.
LEAST, SHARED, SIBLING = 0.1, 1.6, 0.3
#: Log-odds that a block's text and the block as a whole have at most, either way.
TEXT_MOST, MOST = 1.2, 4.0

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z)))", re.S)
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|href)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WORD = re.compile(r"[a-z]+|[0-9]+")

# Element names of HTML and what they say about their text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "template", "svg", "math", "object", "canvas", "audio", "video", "select", "button", "noscript", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold one block by themselves; their names say little about it.
LEAVES = HEADINGS | {"p", "li", "dt", "dd", "td", "th", "pre", "blockquote"}
ROOTS = {"html", "body"}
CONTENT_TAGS = {"article", "main"}
BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "search"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar"}
CONTENT_NAMES = {"article", "content", "post", "entry", "story", "main", "body", "text", "prose"}
BOILER_NAMES = {
    "ad", "adbox", "ads", "adsense", "advert", "advertisement", "adverts", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "overlay", "pager", "pagination", "popup",
    "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "topbar", "trending", "widget", "widgets",
}
#: Names of reader comments inside a content tag; elsewhere they may name the content itself, as in a forum.
COMMENT_NAMES = {"discussion", "guestbook", "reactions", "responses", "thread", "threads"}
#: Words that leave a boilerplate name as certain as it is by itself; beside any other word it is doubtful, as in ``social-history``.
COMPANIONS = {
    "area", "article", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "card", "cards", "column", "container", "content", "entry",
    "feed", "form", "global", "group", "header", "icon", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "media", "module",
    "outer", "page", "panel", "policy", "post", "posts", "primary", "reader", "right", "row", "secondary", "section", "side", "site", "slot", "small",
    "stories", "story", "text", "title", "top", "unit", "user", "wrap", "wrapper",
}
DOUBTFUL_NAMES = {
    "banner", "bottombar", "copyright", "disclaimer", "dropdown", "feedback", "form", "header", "notice", "notices", "privacy", "reply", "rss", "tagcloud", "tags", "teaser",
}
#: Names with one of these words say what a whole page has, as ``with-sidebar``.
LAYOUT_NAMES = {"has", "no", "with", "without"}
#: What an element's tag and names hint at, and the log-odds of the innermost element with a hint and of those around it.
HINTS = {"content tag": (0.7, 0.3), "content name": (0.7, 0.3), "boiler tag": (-3.0, -2.5), "boiler name": (-4.0, -2.5), "doubtful name": (-0.9, -0.3), "named leaf": (-1.8, -0.3), "doubtful leaf": (-0.5, -0.3)}
#: Log-odds of a block outside of all content tags, on a page that has some.
OUTSIDE = -1.5
# Wording of consent notices, and what each says against its block; what all say counts from ``NOTICE_LEAST`` on.
NOTICE_WORDING = [
    (3.0, re.compile(r"^\W*(?:we|this (?:web)?site|our (?:web)?site)\b.{0,40}?\buses? (?:\w+ )?cookies\b", re.I)),
    (1.0, re.compile(r"\bcookies?\b", re.I)),
    (1.0, re.compile(r"\b(?:accept|agree|consent|allow|reject|decline)\w*\b", re.I)),
    (1.0, re.compile(r"\b(?:policy|settings|preferences|options)\b", re.I)),
    (1.0, re.compile(r"\b(?:your (?:browsing )?experience|by (?:continuing|using|going on|clicking|browsing))\b", re.I)),
    (1.0, re.compile(r"\b(?:we|our|this (?:web)?site)\b", re.I)),
]
NOTICE_LEAST = 3.0
#: Lists and tables, and the elements that are their items.
GROUPS = {"ul", "ol", "dl", "table"}
ITEMS = {"li", "dt", "dd", "td", "th"}
#: A start tag of the first kind ends an open element of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "nav", "aside", "main", "td", "th"}


class Block:
    __slots__ = ("text", "path", "tag", "linked", "hints", "group")

    def __init__(self, text: str, path: tuple[int, ...], tag: str, linked: int, hints: tuple[str, ...], group: int = 0):
        self.text, self.path, self.tag, self.linked, self.hints, self.group = text, path, tag, linked, hints, group

    @property
    def says(self) -> int:
        """What the elements around it say for certain: 1 content, -1 boilerplate or 0."""
        if any(h.startswith("boiler") for h in self.hints):
            return -1
        return int("content tag" in self.hints)

    def evidence(self, has_content: bool) -> float:
        """Log-odds by the elements around it; ``has_content``: whether the page has content tags."""
        odds = OUTSIDE if has_content and "content tag" not in self.hints else 0.0
        if self.hints:
            odds += HINTS[self.hints[-1]][0] + sum(HINTS[h][1] for h in set(self.hints[:-1]) - {self.hints[-1]})
        return odds - notice(self.text)


def notice(text: str) -> float:
    """How strongly the wording is that of a consent notice; 0 for texts without the word."""
    if "cookie" not in text.lower():
        return 0.0
    said = sum(weight for weight, pattern in NOTICE_WORDING if pattern.search(text))
    return said if said >= NOTICE_LEAST else 0.0


def _hint(tag: str, attrs: str, inside_content: bool) -> tuple[str, bool]:
    """(what one element hints at, hidden)."""
    hint, hidden = "", False
    if tag in CONTENT_TAGS:
        hint = "content tag"
    elif tag in BOILER_TAGS or tag == "header" and not inside_content:
        hint = "boiler tag"
    if attrs and "=" in attrs or "hidden" in attrs:
        words: set[str] = set()
        certain = False
        for m in ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name in ("class", "id"):
                for token in value.split():
                    parts = set(WORD.findall(token))
                    if parts.isdisjoint(LAYOUT_NAMES):
                        words |= parts
                        sure = BOILER_NAMES | COMMENT_NAMES if inside_content else BOILER_NAMES
                        certain |= not parts.isdisjoint(sure) and all(len(w) < 3 or w.isdigit() or w in sure or w in COMPANIONS for w in parts)
            elif name == "role" and value in BOILER_ROLES:
                hint = "boiler tag"
            elif name == "role" and value in CONTENT_TAGS:
                hint = "content tag"
            elif name == "hidden" or name == "aria-hidden" and value == "true" and tag not in ("body", "main", "article") or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
        if tag not in ROOTS and hint != "boiler tag":
            content = not words.isdisjoint(CONTENT_NAMES)
            named = not words.isdisjoint(BOILER_NAMES)
            if certain:
                hint = "named leaf" if tag in LEAVES else "boiler name"
            elif tag in LEAVES:
                hint = hint or "doubtful leaf" * (named or not content and not words.isdisjoint(DOUBTFUL_NAMES))
            elif named or not words.isdisjoint(DOUBTFUL_NAMES):
                hint = hint or "doubtful name" * (not content)
            elif content:
                hint = hint or "content name"
    return hint, hidden


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    found: list[Block] = []
    # open elements: (tag, path, hints, hidden, list or table around)
    stack: list[tuple[str, tuple[int, ...], tuple[str, ...], bool, int]] = [("", (), (), False, 0)]
    number, text, linked, in_link, at = 0, [], 0, False, 0

    def end_block() -> None:
        nonlocal text, linked
        if text:
            said = " ".join(html.unescape("".join(text)).split())
            tag, path, hints, hidden, group = stack[-1]
            if said and not hidden:
                found.append(Block(said, path, tag, linked, hints, group))
            text, linked = [], 0

    def close(to: int) -> None:
        nonlocal in_link
        end_block()
        del stack[to:]
        in_link = False

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            piece, at = page[at:], len(page)
        else:
            piece, at = page[at : m.start()], m.end()
        if piece:
            text.append(piece)
            if in_link:
                linked += len(piece.strip())
        if m is None or m[2] is None:
            continue
        tag = m[2].lower()
        if tag in RAW and not m[1]:
            if not m[3].rstrip(">").endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)|</{re.escape(tag)}\Z", re.I).search(page, at)
                if tag == "head" and end is None:
                    end = re.compile(r"(?=<body[\s>])", re.I).search(page, at)
                    at = end.end() if end else at
                else:
                    at = end.end() if end else len(page)
            text.append(" ")
        elif tag == "a":
            in_link = not m[1]
        elif tag == "br" or tag in VOID and tag != "hr":
            text.append(" ")
        elif tag in BLOCK:
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag or tag in HEADINGS and stack[k][0] in HEADINGS:
                        close(k)
                        break
                else:
                    end_block()
                continue
            if stack[-1][0] == "p":
                close(len(stack) - 1)
            elif tag in ENDS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ENDS[tag]:
                        close(k)
                        if tag != "tr" or stack[-1][0] != "tr":
                            break
                    elif stack[k][0] in SCOPE:
                        break
            end_block()
            if tag == "hr":
                continue
            number += 1
            _, path, hints, hidden, group = stack[-1]
            boiler = any(h.startswith("boiler") for h in hints)
            hint, own_hidden = _hint(tag, m[3].rstrip("/>"), "content tag" in hints)
            if hint.startswith("content") and boiler:
                hint = ""  # an article among related links or comments is no main text
            stack.append((tag, path if tag in ROOTS else (*path, number), (*hints, hint) if hint else hints, hidden or own_hidden, number if tag in GROUPS else group))
    end_block()
    return found


def features(block: Block, place: float) -> list[float]:
    """What the classifier sees of a block besides the names around it."""
    text = block.text
    n, words = len(text), text.count(" ") + 1
    return [
        1.0,
        min(words, 100) / 20,
        1.0 if words >= 10 else 0.0,
        min(1.0, block.linked / n),
        min(3, sum(text.count(c) for c in ".!?;:")) / 3,
        1.0 if text[-1] in ".!?:;\"'”»)" else 0.0,
        1.0 if block.tag in HEADINGS else 0.0,
        min(1.0, 5 * text.count(",") / words),
        1.0 if text[0].isupper() else 0.0,
        1.0 if "©" in text or "all rights reserved" in text.lower() else 0.0,
        2 * abs(place - 0.5),
    ]


#: Weights for want of a sample with both kinds of blocks, in the order of ``features``.
PRIOR = np.array([-1.5, 1.0, 1.0, -3.0, 0.8, 0.8, 0.8, 0.5, 0.2, -3.0, -0.3])


def train(pages: list[str | None], steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression on the blocks whose enclosing elements say what they hold."""
    rows, labels = [], []
    for page in pages:
        found = blocks(page or "")
        for k, b in enumerate(found):
            if b.says:
                rows.append(features(b, k / max(1, len(found) - 1)))
                labels.append(b.says > 0)
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return PRIOR
    x, w = np.array(rows), PRIOR.copy()
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())  # both kinds weigh the same
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ ((p - y) * share) + decay * (w - PRIOR))
    return w


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut (the smallest such set), by shortest augmenting levels."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for k in range(n):
        if source[k] > 0:
            join(s, k, source[k], 0.0)
        if sink[k] > 0:
            join(k, t, sink[k], 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        walk: list[int] = []
        at = s
        while True:
            if at == t:
                flow = min(room[e] for e in walk)
                for e in walk:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(walk) if room[e] <= 1e-9)
                at = to[walk[cut] ^ 1]
                del walk[cut:]
            while turn[at] < len(out[at]):
                e = out[at][turn[at]]
                if room[e] > 1e-9 and level[to[e]] == level[at] + 1:
                    break
                turn[at] += 1
            if turn[at] < len(out[at]):
                walk.append(out[at][turn[at]])
                at = to[walk[-1]]
            elif walk:
                at = to[walk.pop() ^ 1]
                turn[at] += 1
            else:
                break


def capacities(found: list[Block], weights: np.ndarray) -> list[float]:
    """The log-odds of each block being content.

    Items of a list or table that hold more than links share the doubt of one text:
    what speaks against short ones is divided by their number.
    """
    text = np.clip(np.array([features(b, k / max(1, len(found) - 1)) for k, b in enumerate(found)]) @ weights, -TEXT_MOST, TEXT_MOST)
    items = [b.group if b.tag in ITEMS and 2 * b.linked < len(b.text) else 0 for b in found]
    share = Counter(items)
    text = [t / share[g] if g and t < 0 else t for t, g in zip(text.tolist(), items, strict=True)]
    has_content = any("content tag" in b.hints for b in found)
    return np.clip(np.array(text) + [b.evidence(has_content) for b in found], -MOST, MOST).tolist()


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges (block, block, weight) between neighbours in the page and between the closest blocks under one parent."""
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for k, b in enumerate(found):
        if k:
            a = found[k - 1].path
            common = 0
            for x, y in zip(a, b.path, strict=False):
                if x != y:
                    break
                common += 1
            edges.append((k - 1, k, LEAST + SHARED * 2 * common / max(1, len(a) + len(b.path))))
        parent = b.path[-2] if len(b.path) > 1 else -1
        if parent in last and last[parent] < k - 1:
            edges.append((last[parent], k, SIBLING))
        last[parent] = k
    return edges


def label(found: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks are main text."""
    n = len(found)
    if not n:
        return []
    odds = capacities(found, weights)
    edges = smoothness(found)
    smooth = [0.0] * n
    for a, b, w in edges:
        smooth[a] += w
        smooth[b] += w
    sure = [None if abs(o) <= s else o > 0 for o, s in zip(odds, smooth, strict=True)]
    rest = {k: at for at, k in enumerate(k for k in range(n) if sure[k] is None)}
    if rest:
        source, sink, inner = [max(0.0, odds[k]) for k in rest], [max(0.0, -odds[k]) for k in rest], []
        for a, b, w in edges:
            if a in rest and b in rest:
                inner.append((rest[a], rest[b], w))
            elif a in rest or b in rest:
                free, fixed = (a, b) if a in rest else (b, a)
                (source if sure[fixed] else sink)[rest[free]] += w
        for k, kept in zip(rest, minimum_cut(source, sink, inner), strict=True):
            sure[k] = kept
    return [bool(x) for x in sure]


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    """The kept blocks in page order, joined by an empty line."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, kept in zip(found, label(found, weights), strict=True) if kept)


def _extract_batches(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), weights) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    taken = rows.select("page_id", F.xxhash64("page_id").alias("k")).orderBy("k", "page_id").limit(sample).select("page_id").distinct()
    seen = rows.join(F.broadcast(taken.withColumnRenamed("page_id", "wanted")), F.col("page_id") == F.col("wanted"), "left_semi")
    weights = train([r.html for r in seen.select("html").limit(sample).toLocalIterator()])
    return rows.mapInArrow(_extract_batches(weights), "page_id bigint, url string, text string, n_chars bigint")
