"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each with
its ancestors. Markup, comments, scripts, styles and other elements without
readable text are no blocks. Every block is labelled content or boilerplate by a
chain field whose features are ancestor tags, words of class / id / role
attributes, and the text itself (length, link share, punctuation, cue words,
place in the page); Viterbi picks the labels of a page jointly.

Training pages come labelled from two places: layouts written out below, and a
bounded hash sample of the table's own pages whose semantic tags label their
blocks (inside article or main and outside nav, header, footer and the like).
Sampled pages are also shown without those tags, so text features earn weight.

Defined cases: null or empty html has the empty text. Unclosed tags, a page cut
off inside a tag, and unknown character references are read as browsers do; a
partial tag at the end is markup. An unclosed script, style, textarea, iframe or
noscript hides the rest of the page, another unclosed element without readable
text the rest of its parent. Every row is judged alone, so repeated rows repeat their
result; an empty table gives an empty one. Long pages are read whole, in time and memory
that grow with their length, whatever is nested or left open in them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 300          # pages of the table that the field is trained on, about
SAMPLE_PAGE_CHARS = 200_000     # longer pages are not used for training
SAMPLE_DEPTH = 500              # nor are those with a block below so many open elements
EPOCHS = 6

# ---- fixed values: tag classes, attribute words, cue words, labelled layouts ----
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split())
RAW_TAGS = frozenset("script style textarea iframe noscript".split())      # silent; tags inside are text
SILENT_TAGS = RAW_TAGS | frozenset("template svg object canvas audio video select annotation annotation-xml".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SEMANTIC = frozenset("article main nav header footer aside form".split())
HINTS = (
    "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "sidebar", "side", "widget", "related", "recommended", "share", "social", "footer", "header",
    "masthead", "topbar", "cookie", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup",
    "login", "search", "form", "comment", "comments", "reply", "disqus", "pagination", "pager", "tags", "copyright", "legal",
    "article", "content", "post", "entry", "story", "text", "body", "main", "page", "hidden", "toolbar", "skip",
)
CUES = (
    "cookie", "cookies", "subscribe", "newsletter", "copyright", "©", "rights", "privacy", "terms", "menu", "search", "login",
    "log", "sign", "register", "share", "tweet", "comment", "comments", "reply", "replies", "advertisement", "sponsored",
    "related", "read", "more", "home", "contact", "accept", "back", "next", "previous", "email", "password",
)
_P1 = "The river rose again in the night, and by morning the lower road was gone under a sheet of brown water."
_P2 = ("Engineers said on Tuesday that the old bridge would need new piers before it could carry heavy traffic. Work is "
       "expected to begin in spring, once the council has agreed how to share the cost with the two villages.")
_P3 = "It was not the first time."
_P4 = ("What the survey shows, according to its authors, is that small towns keep their shops when people can walk to them. "
       "They looked at forty places over ten years; in most of them, rents had little to do with it, while pavements did.")
# one line a block: label (1 content), path of tags from the body with .class and #id, text
LAYOUTS = tuple(tuple(page.strip().splitlines()) for page in (
    f"""0 header.site-header div.logo | The Valley Post
    0 nav#main-nav ul li a | Home
    0 nav#main-nav ul li a | News
    0 nav#main-nav ul li a | Sport
    1 article h1 | Bridge closed after flood
    1 article p | {_P1}
    1 article p | {_P2}
    0 article div.ad | Buy one pair of boots, get one free. Only this week!
    1 article table tr th | Pier
    1 article table tr td | 3
    1 article p | {_P4}
    1 article p | {_P3}
    0 article div.share | Share this story
    0 section#comments h3 | 2 comments
    0 section#comments div.comment p | I drove there yesterday and it was already closed. Nobody had put up a sign.
    0 section#comments div.comment p | Same as every year.
    0 aside.sidebar h4 | Most read
    0 aside.sidebar ul li a | Ten walks for the weekend
    0 footer p | © 2020 The Valley Post. All rights reserved.""",
    f"""0 div.cookie-notice p | We use cookies to make this site work. By using it you accept our cookies.
    0 div#menu ul li a | Start
    0 div#menu ul li a | About us
    1 div#content div.post h1 | How small towns keep their shops
    1 div#content div.post p | {_P4}
    1 div#content div.post p | {_P2}
    1 div#content div.post blockquote p | {_P3}
    1 div#content div.post ul li | shops within a short walk
    1 div#content div.post ul li | a bus that runs on Sundays
    0 div#content div.related h3 | Related posts
    0 div#content div.related ul li a | Why the market moved
    0 div#content form.newsletter p | Subscribe to our newsletter
    0 div#content form.newsletter label | Your email
    0 div#sidebar div.widget h3 | Archive
    0 div#sidebar div.widget ul li a | March
    0 div#footer | Copyright 2019. Privacy. Terms.""",
    f"""0 div.topbar a | Log in
    0 div.alert | This service will be closed on Monday from 8 to 10.
    1 main h1 | The survey
    1 main h2 | What they asked
    1 main p | {_P2}
    1 main table tr td | Pavements
    1 main table tr td | 40 towns
    1 main p | {_P1}
    1 main figure figcaption | The lower road on Monday
    0 main nav.pagination a | Next
    0 main aside p | Sign up for more stories like this one.
    0 main ol.comment-list li p | Thank you for writing about this, I had no idea that it was so old.
    0 footer div | Valley Press, 4 Mill Lane
    0 footer ul li a | Contact""",
    f"""0 table tr td a | Home
    0 table tr td a | Links
    1 table tr td h1 | Bridge closed
    1 table tr td p | {_P1}
    1 table tr td p | {_P2}
    1 table tr td p | {_P4}
    0 table tr td | Copyright 1999""",
    f"""0 div div a | News
    0 div div a | Sport
    0 div div a | Weather
    1 div h1 | After the flood
    1 div p | {_P2}
    1 div p | {_P1}
    1 div div p | {_P4}
    1 div p | {_P3}
    0 div ul li a | Read more
    0 div p | © Valley Press""",
    f"""0 header p | The Valley Post, since 1898
    0 header form label | Search
    0 div.banner | Sale! Everything must go.
    1 article header h1 | Bridge closed after flood
    1 article section h2 | The night
    1 article section p | {_P1}
    1 article section p | {_P3}
    1 article section h2 | The plan
    1 article section p | {_P2}
    0 article section div.advertisement p | Sponsored: a warm coat for every winter, now with free delivery to your door.
    1 article section p | {_P4}
    0 article aside p | Also in this issue: ten walks for the weekend.
    0 article form p | Write a comment
    0 article footer p | Filed under news
    0 div.comments p | They should have started years ago, when it was cheap. Now everybody pays.
    0 div.modal p | Do not miss a story. Subscribe now.
    0 div.legal p | The publisher is not liable for the content of other sites.""",
    f"""0 div.skip a | Skip to content
    0 nav a | Home
    0 div.breadcrumb a | Sport
    1 main article h1 | Ten walks for the weekend
    0 main article div.social a | Share
    1 main article p | {_P4}
    0 main article div.popup p | Get our stories by mail every morning, free for the first month.
    1 main article p | {_P1}
    0 main form.search label | Find a walk
    0 main form p | Your name
    0 main form p | Send
    1 main article p | {_P3}
    1 main article ol li | Down to the mill, then left along the water.
    1 main article table tr td | Length
    1 main article table tr td | 7 km
    0 main article div#disqus p | Lovely walk, but the second stile is broken and there is a bull in the field.
    0 main article ul.tags li a | walks
    0 main div.promo div | Maps, half price until Sunday
    0 aside div.recommended p | Why the market moved
    0 footer.footer p | Terms and privacy""",
))
# ---- end of fixed values ----

_HINT = frozenset(HINTS)
_CUE = frozenset(CUES)
# a quote is one after "=" only, and only if it is closed; any other character up to ">" belongs to a name
_VALUE = r"=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+"
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+{_VALUE})?+)*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?+)?+")
_HIDDEN = re.compile(r"(?i)\bhidden\b")
_NOT_SHOWN = re.compile(r"(?i)display\s*:\s*none")
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+|©")


class Place:
    """An open element: blocks below share it, and it shares what it can with its parent."""

    __slots__ = ("parent", "tag", "inside", "hints", "depth")

    def __init__(self, parent: Place | None, tag: str, hints: frozenset[str]):
        self.parent, self.tag = parent, tag
        above = parent.inside if parent else _NO_HINTS
        self.inside = above if tag in above else above | {tag}             # tags of it and its ancestors
        known = parent.hints if parent else _NO_HINTS
        self.hints = known if hints <= known else known | hints
        self.depth = parent.depth + 1 if parent else 1


_NO_HINTS: frozenset[str] = frozenset()


@dataclass
class Block:
    text: str
    place: Place | None
    linked: float = 0.0             # share of the characters inside links

    @property
    def tags(self) -> tuple[str, ...]:
        """Ancestors, outermost first."""
        out, at = [], self.place
        while at:
            out.append(at.tag)
            at = at.parent
        return tuple(reversed(out))

    @property
    def inside(self) -> frozenset[str]:
        return self.place.inside if self.place else _NO_HINTS

    @property
    def hints(self) -> frozenset[str]:
        return self.place.hints if self.place else _NO_HINTS


def block(text: str, tags: Iterable[str], hints: frozenset[str], linked: float) -> Block:
    """A block below new elements ``tags`` that hold ``hints``."""
    at = None
    for tag in tags:
        at = Place(at, tag, hints)
    return Block(text, at, linked)


def _hints(attributes: str) -> frozenset[str]:
    """Known words of the class, id and role attributes."""
    out = set()
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            out.update(map(str.lower, _NAME.findall(value)))
        if _HIDDEN.search(name) and value.lower() != "false" or name == "style" and _NOT_SHOWN.search(value):
            out.add("hidden")
    return frozenset(out & _HINT)


_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
           "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset(("ul", "ol", "dl", "table", "div", "section", "article", "body"))


def _after_raw(page: str, tag: str, at: int) -> int:
    """The place behind the end tag of a raw-text element; without one, the page's end."""
    end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
    return end.end() if end else len(page)


def silent_ends(page: str) -> dict[int, int]:
    """Where silent elements with ordinary content end, by the place behind their start tag.

    That is behind their own end tag, else where their parent ends: at its end tag, or where the start
    of a block implies that end. One that nothing ends, or only body or html, is its start tag alone.
    """
    ends: dict[int, int] = {}
    stack: list[tuple[str, int, str]] = []  # open elements, the places behind their start tags, their blocks
    count: Counter[str] = Counter()
    silent: list[int] = []                  # indexes in the stack of the silent ones
    implied: dict[int, int] = {}
    at = 0
    while m := _TAG.search(page, at):
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if closing:
            if not count[tag]:
                continue
            while True:
                open_, start, _ = stack.pop()
                count[open_] -= 1
                if silent and silent[-1] == len(stack):
                    silent.pop()
                    ends[start] = m.end() if open_ == tag else implied.get(start, m.start())
                if open_ == tag:
                    break
            continue
        if tag in RAW_TAGS:
            if not m[3].endswith("/"):
                at = _after_raw(page, tag, at)
            continue
        if tag in VOID_TAGS or tag in ("html", "body") or m[3].endswith("/") and (silent or tag in SILENT_TAGS):
            continue
        if tag in BLOCK_TAGS and tag != "option":
            if silent:
                _, start, block = stack[silent[-1]]
                if block == "p" or block in _CLOSES.get(tag, ()):
                    implied.setdefault(start, m.start())
            elif stack and stack[-1][0] == "p":
                stack.pop()
                count["p"] -= 1
        if tag in SILENT_TAGS:
            silent.append(len(stack))
        stack.append((tag, at, tag if tag in BLOCK_TAGS else stack[-1][2] if stack else ""))
        count[tag] += 1
    for k in silent:
        if (start := stack[k][1]) in implied:
            ends[start] = implied[start]
    return ends


def leaf_blocks(page: str) -> list[Block]:
    """The readable blocks of a page in order."""
    out: list[Block] = []
    stack: list[Place] = []                             # open block-level elements
    where: dict[str, list[int]] = {}                    # their indexes by tag
    inline: Counter[str] = Counter()                    # open inline elements of the block
    parts: list[str] = []
    links = 0
    at, n = 0, len(page)
    ends: dict[int, int] | None = None

    def flush():
        nonlocal links
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, stack[-1] if stack else None, min(1.0, links / max(1, len(raw.strip())))))
            parts.clear()
        links = 0

    def innermost(tags: Iterable[str]) -> int:
        return max((k[-1] for t in tags if (k := where.get(t))), default=-1)

    def cut(k: int):
        while len(stack) > k:
            where[stack.pop().tag].pop()

    while m := _TAG.search(page, at):
        if m.start() > at:
            chunk = page[at:m.start()]
            parts.append(chunk)
            if inline["a"]:
                links += len(chunk.strip())
        at = m.end()
        if not m[2]:
            continue
        tag, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if tag in SILENT_TAGS and not closing:
            if tag in RAW_TAGS:
                at = at if attributes.endswith("/") else _after_raw(page, tag, at)
            else:
                ends = silent_ends(page) if ends is None else ends
                at = ends.get(at, at)
        elif tag in BLOCK_TAGS:
            if closing and tag != "p" and not where.get(tag):
                continue                                # a stray end tag
            flush()
            inline.clear()
            if closing:
                if where.get(tag):
                    cut(where[tag][-1])
                continue
            closes = ("p", *_CLOSES.get(tag, ()))       # implied end tags, up to the innermost scope
            while stack and (k := innermost(closes)) > innermost(_SCOPE):
                open_ = stack[k].tag
                cut(k)
                if open_ != "p":
                    break
            if tag not in VOID_TAGS:
                where.setdefault(tag, []).append(len(stack))
                stack.append(Place(stack[-1] if stack else None, tag, _hints(attributes) if attributes else _NO_HINTS))
        elif tag == "br":
            parts.append(" ")
        elif closing:
            if inline[tag]:
                inline[tag] -= 1
        elif tag not in VOID_TAGS:
            inline[tag] += 1
    parts.append(page[at:])                             # a tag cut off at the end is no part of it
    flush()
    return out


# ------------------------------------------------------------------- features
def _key(place: Place | None) -> tuple[frozenset[str], str, str, frozenset[str]]:
    """All that the features of a place depend on."""
    if not place:
        return _NO_HINTS, "", "", _NO_HINTS
    return place.inside, place.tag, place.parent.tag if place.parent else "", place.hints


def _of_place(inside: frozenset[str], inner: str, above: str, hints: frozenset[str]) -> list[str]:
    return [*(f"in {t}" for t in inside), f"tag {inner}", f"above {above} {inner}", *(f"hint {h}" for h in hints)]


def _of_text(block: Block, i: int, n: int) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    out = [f"words {min(7, words.bit_length())}", f"linked {int(block.linked * 3.99)}",
           f"place {0 if i == 0 else 3 if i == n - 1 else 1 if i * 2 < n else 2}"]
    if text[-1] in ".!?…":
        out.append("ends")
    if text[-1] in ".!?…" and words > 8:
        out.append("prose")
    if "|" in text or "·" in text:
        out.append("bars")
    if words <= 25:
        out += [f"cue {w}" for w in set(map(str.lower, _WORD.findall(text))) & _CUE]
    return out


class ChainField:
    """Two-label linear chain: weights are of content against boilerplate."""

    def __init__(self, weights: dict[str, float] | None = None, turn: np.ndarray | None = None):
        self.weights = weights or {}
        self.turn = np.zeros((2, 2)) if turn is None else turn
        self._by_place: dict[tuple, float] = {}

    def scores(self, blocks: list[Block]) -> list[float]:
        get, out = self.weights.get, []
        for i, b in enumerate(blocks):
            key = _key(b.place)
            if (s := self._by_place.get(key)) is None:
                if len(self._by_place) > 50_000:
                    self._by_place.clear()
                s = self._by_place[key] = sum(get(f, 0.0) for f in _of_place(*key))
            out.append(s + sum(get(f, 0.0) for f in _of_text(b, i, len(blocks))))
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi labels."""
        if not blocks:
            return []
        (t00, t01), (t10, t11) = self.turn.tolist()
        e = self.scores(blocks)
        a, b = 0.0, e[0]
        back: list[tuple[int, int]] = []
        for s in e[1:]:
            from_a, from_b = (0, 0), (0, 0)
            a0, a1, b0, b1 = a + t00, b + t10, a + t01 + s, b + t11 + s
            from_a, from_b = (0 if a0 >= a1 else 1), (0 if b0 >= b1 else 1)
            back.append((from_a, from_b))
            a, b = max(a0, a1), max(b0, b1)
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def fit(self, pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS) -> "ChainField":
        """Stochastic gradient (Adagrad) on the conditional log-likelihood, by forward-backward."""
        rows = [([_of_place(*_key(b.place)) + _of_text(b, i, len(bs)) for i, b in enumerate(bs)], ys) for bs, ys in pages if bs]
        names = sorted({f for fs, _ in rows for block in fs for f in block})
        index = {f: i for i, f in enumerate(names)}
        data = [([np.array([index[f] for f in block]) for block in fs], np.array(ys)) for fs, ys in rows]
        w, size = np.zeros(len(names)), np.full(len(names), 1e-6)
        turn, turn_size = np.zeros((2, 2)), np.full((2, 2), 1e-6)
        rng = np.random.default_rng(5)
        for _ in range(epochs):
            for k in rng.permutation(len(data)):
                ids, y = data[k]
                node = np.zeros((len(ids), 2))
                node[:, 1] = [w[i].sum() for i in ids]
                node_p, pair_p = _marginals(node, turn)
                flat = np.concatenate(ids)
                g = np.zeros(len(names))
                np.add.at(g, flat, np.repeat(y - node_p[:, 1], [len(i) for i in ids]))
                g -= 1e-5 * w
                size += g * g
                w += 0.5 * g / np.sqrt(size)
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[:-1], y[1:]), 1)
                gt = seen - pair_p - 1e-3 * turn
                turn_size += gt * gt
                turn += 0.3 * gt / np.sqrt(turn_size)
        self.weights = {f: float(w[i]) for f, i in index.items()}
        self.turn, self._by_place = turn, {}
        return self


def _marginals(node: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals of each block and the expected label pairs of the chain."""
    n = len(node)
    e, t = np.exp(node - node.max(axis=1, keepdims=True)), np.exp(turn)
    fwd, back = np.empty((n, 2)), np.ones((n, 2))
    fwd[0] = e[0] / e[0].sum()
    for i in range(1, n):
        f = (fwd[i - 1] @ t) * e[i]
        fwd[i] = f / f.sum()
    for i in range(n - 2, -1, -1):
        b = t @ (e[i + 1] * back[i + 1])
        back[i] = b / b.sum()
    p = fwd * back
    p /= p.sum(axis=1, keepdims=True)
    if n == 1:
        return p, np.zeros((2, 2))
    pair = fwd[:-1, :, None] * t[None] * (e[1:] * back[1:])[:, None, :]
    return p, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


# ------------------------------------------------------------- labelled pages
def layout_page(lines: tuple[str, ...]) -> tuple[list[Block], list[int]]:
    blocks, labels = [], []
    for line in lines:
        head, _, text = line.strip().partition(" | ")
        label, *path = head.split()
        tags = tuple(re.match(r"[a-z0-9]+", p)[0] for p in path)
        hints = frozenset(w for p in path for w in re.findall(r"[a-z]+", p[len(re.match(r"[a-z0-9]+", p)[0]):])) & _HINT
        link = tags[-1] == "a"
        blocks.append(block(text, (t for t in ("html", "body", *tags) if t in BLOCK_TAGS), frozenset(hints), float(link)))
        labels.append(int(label))
    return blocks, labels


_OUTSIDE = frozenset("nav footer aside form head title menu".split())
_BAD_HINTS = frozenset(HINTS[:HINTS.index("article")]) - {"text", "header", "side"}


def own_labels(blocks: list[Block]) -> list[int] | None:
    """Labels that a page's semantic tags give; None for a page without article or main."""
    if not any("article" in b.inside or "main" in b.inside for b in blocks):
        return None
    return [int(("article" in b.inside or "main" in b.inside) and not _OUTSIDE & b.inside and not _BAD_HINTS & b.hints)
            for b in blocks]


def plain(blocks: list[Block]) -> list[Block]:
    """The same blocks with semantic tags read as div and no attribute words."""
    return [block(b.text, ("div" if t in SEMANTIC else t for t in b.tags), _NO_HINTS, b.linked) for b in blocks]


def with_insertions(blocks: list[Block], labels: list[int], extra: list[Block], rng: np.random.Generator):
    """The page with a few boilerplate blocks of the layouts inside its content."""
    out, ys = [], []
    for b, y in zip(blocks, labels):
        out.append(b)
        ys.append(y)
        if y and rng.random() < 0.25:
            around = b.tags[:-1]
            for e in extra[int(rng.integers(len(extra))):][:int(rng.integers(1, 4))]:
                out.append(block(e.text, (*around, *(t for t in e.tags if t not in ("html", "body", "article", "main"))),
                                 b.hints | e.hints, e.linked))
                ys.append(0)
    return out, ys


def train_field(sample: list[str]) -> ChainField:
    rng = np.random.default_rng(9)
    layouts = [layout_page(p) for p in LAYOUTS]
    extra = [b for blocks, labels in layouts for b, y in zip(blocks, labels) if not y and (
        b.hints & _BAD_HINTS or b.inside & (_OUTSIDE | {"aside"}))]
    pages = layouts + [(plain(b), y) for b, y in layouts[3:5]]
    pages = pages * max(10, len(sample) // len(pages))
    for k, page in enumerate(sample):
        blocks = leaf_blocks(page)
        if any(b.place and b.place.depth > SAMPLE_DEPTH for b in blocks):
            continue
        labels = own_labels(blocks)
        if labels:
            pages.append((plain(blocks), labels) if k % 4 == 0 else with_insertions(blocks, labels, extra, rng) if k % 4 == 1
                         else (blocks, labels))
    return ChainField().fit(pages)


def main_text(page: str | None, model: ChainField) -> str:
    blocks = leaf_blocks(page or "")
    return " ".join(b.text for b, y in zip(blocks, model.decode(blocks)) if y)


def extract(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    total = max(1, pages.count())
    chosen = rows.where((F.length("html") < SAMPLE_PAGE_CHARS) & (
        F.pmod(F.xxhash64("page_id", "url"), F.lit(1_000_000)) < int(min(1.0, sample_pages / total) * 1e6)))
    model = train_field(sorted(r["html"] for r in chosen.select("html").distinct().collect()))     # repeated rows teach nothing new

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h, model) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
