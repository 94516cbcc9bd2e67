"""Operator 7: main text of web pages by a recurrent block labeller.

A page is read as the sequence of its leaf blocks, each with the hashed names of
the elements around it and its hashed words. A bidirectional LSTM, in numpy,
labels every block with the whole page in view. It is trained on pages made up
here (see training_pages), as the tables label none.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, Words, ship, slices, text_bytes

# Elements that do not end a block, that have no content, and whose content is no text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr img br svg path".split()) | frozenset("math semantics mrow mi mn mo ms mtext mfrac msqrt mroot msup msub msubsup munder mover munderover mfenced menclose mpadded mphantom mspace mstyle merror mtable mtr mtd mmultiscripts mprescripts annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe noembed noframes svg annotation annotation-xml".split())
CLOSES_ITSELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select", "datalist"), "p": ()}
ALIKE = {"dt": ("dd",), "dd": ("dt",), "td": ("th",), "th": ("td",)}

PATH, LEAF, WORDS, NUMBERS, HIDDEN = 1024, 512, 1024, 10, 16
SLOTS = PATH + LEAF + WORDS + 1  # rows of the embedding table; every block has the last one
SHORT = 12  # words of a block whose words are read; longer ones are prose, which its numbers tell
STEPS = 2048  # blocks whose inputs are held at once

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.\-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


@functools.lru_cache(100_000)
def _names(tag: str, attributes: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Slots of an element among the ancestors and as the innermost one: its tag, and the words of its class, id, role and label."""
    tokens = {f"<{tag}>"}
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            tokens.update(p.lower() for p in _PART.findall(value))
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            tokens.add("hidden")
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes):
        tokens.add("hidden")
    tokens = sorted(tokens)
    return tuple(_slot(t, PATH) for t in tokens), tuple(_slot("leaf " + t, LEAF) for t in tokens)


@dataclass
class Blocks:
    """Leaf blocks of a page, in order."""

    text: list[str] = field(default_factory=list)
    path: list[tuple[int, ...]] = field(default_factory=list)
    leaf: list[tuple[int, ...]] = field(default_factory=list)
    linked: list[float] = field(default_factory=list)  # share of the characters inside links
    heading: list[bool] = field(default_factory=list)


def blocks(page: str) -> Blocks:
    """Blocks with text: character references decoded, white space turned into one space. A line break inside a block is white space."""
    out = Blocks()
    stack: list[tuple[str, tuple, tuple]] = []
    opened: Counter[str] = Counter()  # elements of the stack by tag
    around: Counter[int] = Counter()  # and the slots of their names
    known: dict[tuple[int, ...], tuple[int, ...]] = {}
    parts: list[str] = []
    linked = total = 0
    in_link = False

    def push(element: tuple[str, tuple, tuple]) -> None:
        stack.append(element)
        opened[element[0]] += 1
        around.update(element[1])

    def cut(at: int) -> None:
        for tag, names, _ in stack[at:]:
            opened[tag] -= 1
            for slot in names:
                around[slot] -= 1
                if not around[slot]:
                    del around[slot]
        del stack[at:]

    def flush() -> None:
        nonlocal parts, linked, total, in_link
        in_link = False
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.text.append(text)
                path = tuple(around)
                out.path.append(known.setdefault(path, path))
                out.leaf.append(stack[-1][2] if stack else ())
                out.linked.append(linked / max(total, 1))
                out.heading.append(bool(stack) and len(stack[-1][0]) == 2 and stack[-1][0][0] == "h" and stack[-1][0][1].isdigit())
        parts, linked, total = [], 0, 0

    def add(text: str) -> None:
        nonlocal linked, total
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        size = len(text) - text.count(" ")
        total += size
        linked += size if in_link else 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        closing = bool(m[1] or m[4])
        attributes = (m[3] if m[2] else m[6]) or ""
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = close.end() if close else end
            if tag not in INLINE:
                flush()
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append("\n")
            elif tag == "a":
                in_link = not closing
            continue
        flush()
        if closing:
            if opened[tag]:
                cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if stack and stack[-1][0] == "p":
            cut(len(stack) - 1)
        if tag in CLOSES_ITSELF and any(opened[t] for t in (tag, *ALIKE.get(tag, ()))):
            scope = CLOSES_ITSELF[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in scope:
                    break
                if stack[i][0] == tag or stack[i][0] in ALIKE.get(tag, ()):
                    cut(i)
                    break
                if tag == "p":
                    break
        if tag not in VOID and not attributes.endswith("/"):
            push((tag, *_names(tag, attributes)))
    flush()
    return out


class Inputs:
    """Blocks of pages as the model reads them: slots of names and words with weights, block after block, and a few numbers."""

    def __init__(self, pages: list[Blocks]):
        text = [t for p in pages for t in p.text]
        n = len(text)
        words = Words(*text_bytes(pa.array(text, pa.large_string())), ALNUM)
        brief = words.count[words.row] <= SHORT
        parts = [(np.arange(n), np.full(n, SLOTS - 1), np.ones(n, np.float32))]
        for offset, rows in ((0, [s for p in pages for s in p.path]), (PATH, [s for p in pages for s in p.leaf])):
            size = np.fromiter(map(len, rows), np.int64, n)
            slot = offset + np.fromiter((s for r in rows for s in r), np.int64, int(size.sum()))
            parts.append((np.repeat(np.arange(n), size), slot, np.ones(len(slot), np.float32)))
        row = words.row[brief]
        parts.append((row, PATH + LEAF + (words.hash[brief] % np.uint64(WORDS)).astype(np.int64), (1 / np.sqrt(np.maximum(words.count[row], 1))).astype(np.float32)))
        row, slot, weight = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.argsort(row, kind="stable")
        self.slot, self.weight = slot[order], weight[order]
        self.end = np.cumsum(np.bincount(row, minlength=n))
        self.size = np.diff(self.end, prepend=0)
        x = self.numbers = np.zeros((n, NUMBERS), np.float32)
        if not n:
            return
        length = np.fromiter(map(len, text), np.float64, n)
        x[:, 0] = np.log1p(length) / 6
        x[:, 1] = np.log1p(words.count) / 5
        x[:, 2] = np.fromiter((s for p in pages for s in p.linked), np.float64, n)
        x[:, 3] = np.fromiter((t[-1] in ".!?…\"”»" for t in text), bool, n)
        x[:, 4] = np.fromiter((t.count(",") + t.count(".") for t in text), np.float64, n) / np.maximum(words.count, 1)
        x[:, 5] = np.fromiter((h for p in pages for h in p.heading), bool, n)
        x[:, 6] = words.count < 6
        x[:, 7] = words.count > 25
        x[:, 8] = np.fromiter(("©" in t or "|" in t or "·" in t for t in text), bool, n)
        x[:, 9] = np.fromiter((any(c.isdigit() for c in t) for t in text), bool, n)

    def entries(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in slot and weight of the given blocks, one block after the other, and where each begins."""
        size = self.size[blocks]
        begin = np.cumsum(size) - size
        return np.repeat(self.end[blocks] - size - begin, size) + np.arange(int(size.sum())), begin


class Labeller:
    """Bidirectional LSTM and a linear path from the inputs; gives the log-odds that a block is main text."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(min(shape[0], 64)) * 0.5).astype(np.float32)
        self.w = {"out": draw(2 * HIDDEN, 1), "skip": np.zeros((NUMBERS, 1), np.float32), "slot_skip": np.zeros((SLOTS, 1), np.float32)}
        for d in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.w |= {f"x{d}": draw(NUMBERS, 4 * HIDDEN), f"slot_x{d}": draw(SLOTS, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN), f"c{d}": bias}

    def _sum(self, name: str, x: Inputs, blocks: np.ndarray, drop: np.ndarray | float = 1.0) -> np.ndarray:
        """Weighted sums of table rows for the given blocks, with their numbers' share."""
        at, begin = x.entries(blocks)
        return np.add.reduceat(self.w[f"slot_{name}"][x.slot[at]] * (x.weight[at] * drop)[:, None], begin) + x.numbers[blocks] @ self.w[name]

    def _run(self, z: np.ndarray, live: np.ndarray, d: str, state: tuple[np.ndarray, np.ndarray] | None = None, keep: bool = True):
        """z: (steps, pages, 4 HIDDEN) of inputs; live: (steps, pages). Hidden states, what the gradient needs if it is kept, and the last state."""
        steps, pages, _ = z.shape
        h, c = state if state is not None else (np.zeros((pages, HIDDEN), np.float32),) * 2
        out, kept = np.zeros((steps, pages, HIDDEN), z.dtype), []
        for t in range(steps):
            g = z[t] + h @ self.w[f"h{d}"]
            s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            u = np.tanh(g[:, 3 * HIDDEN :])
            new = f * c + i * u
            th = np.tanh(new)
            m = live[t][:, None]
            if keep:
                kept.append((h, c, i, f, o, u, th, m))
            h, c = np.where(m, o * th, h), np.where(m, new, c)
            out[t] = h
        return out, kept, (h, c)

    def _back(self, grad: np.ndarray, kept: list, d: str):
        """Gradients of the gates' inputs and of the recurrent weights."""
        dz, dw = np.zeros((*grad.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(self.w[f"h{d}"])
        dh = dc = np.zeros(grad.shape[1:], np.float32)
        for t in range(len(kept) - 1, -1, -1):
            h, c, i, f, o, u, th, m = kept[t]
            total = grad[t] + dh
            dn = np.where(m, total, 0)
            cell = np.where(m, dc, 0) + dn * o * (1 - th * th)
            g = np.concatenate([cell * u * i * (1 - i), cell * c * f * (1 - f), dn * th * o * (1 - o), cell * i * (1 - u * u)], axis=1)
            dz[t] = g
            dw += h.T @ g
            dh = g @ self.w[f"h{d}"].T + np.where(m, 0, total)
            dc = np.where(m, cell * f, dc)
        return dz, dw

    def logits(self, x: Inputs, pages: np.ndarray, first: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """Log-odds of the blocks of the given pages (with blocks each), which lie from first[p] on. Inputs are built for about STEPS blocks at a time, so a page can be of any length."""
        n, start = counts[pages], first[pages]
        total = [np.zeros(k, np.float32) for k in n.tolist()]
        deep = int(n.max())
        chunk = max(1, STEPS // len(pages))
        for d, side in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            state = None
            for t in range(0, deep, chunk):
                step = np.arange(t, min(t + chunk, deep))[:, None]
                live = step < n[None, :]
                place = step if d == "f" else n[None, :] - 1 - step
                z = np.zeros((*live.shape, 4 * HIDDEN), np.float32)
                z[live] = self._sum(f"x{d}", x, (start[None, :] + place)[live]) + self.w[f"c{d}"]
                h, _, state = self._run(z, live, d, state, keep=False)
                said = h @ self.w["out"][side, 0]
                for p, own in enumerate(total):
                    rows = place[live[:, p], p] if d == "b" else step[live[:, p], 0]
                    own[rows] += said[live[:, p], p]
        for p, own in enumerate(total):
            for a in range(0, len(own), STEPS):
                own[a : a + STEPS] += self._sum("skip", x, start[p] + np.arange(a, min(a + STEPS, len(own))))[:, 0]
        return total

    def fit(self, x: Inputs, counts: np.ndarray, labels: np.ndarray, rounds: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 0) -> None:
        """Adam on the blocks' cross-entropy; names and words are left out at random, and all names of a page now and then, so that no single one decides."""
        rng = np.random.default_rng(seed)
        first = np.cumsum(counts) - counts
        m1, m2, tick = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        for _ in range(rounds):
            order = np.argsort(counts * (1 + 0.2 * rng.random(len(counts))))  # pages of like length side by side
            for at in (rng.permutation(-(-len(order) // batch)) * batch).tolist():
                some = order[at : at + batch]
                n = counts[some]
                rows = np.concatenate([np.arange(first[p], first[p] + counts[p]) for p in some])
                entry, begin = x.entries(rows)
                slot = x.slot[entry]
                nameless = np.repeat(rng.random(len(some)) < 0.1, n)  # pages that are read without names
                drop = (rng.random(len(entry)) > 0.1) & ~((slot < PATH + LEAF) & np.repeat(nameless, x.size[rows]))
                drop = (drop | (slot == SLOTS - 1)).astype(np.float32)
                y = labels[rows]
                own = np.cumsum(n) - n
                step = np.arange(int(n.max()))[:, None]
                live = step < n[None, :]
                front, back = np.where(live, own + step, 0), np.where(live, own + n - 1 - step, 0)
                total = self._sum("skip", x, rows, drop)[:, 0]
                saved = {}
                for d, where, side in (("f", front, slice(0, HIDDEN)), ("b", back, slice(HIDDEN, 2 * HIDDEN))):
                    h, kept, _ = self._run((self._sum(f"x{d}", x, rows, drop) + self.w[f"c{d}"])[where], live, d)
                    saved[d] = (h, kept, where, side)
                    total[where[live]] += (h @ self.w["out"][side, 0])[live]
                gap = ((1 / (1 + np.exp(-np.clip(total, -30, 30))) - y) / len(rows)).astype(np.float32)
                by_slot = np.argsort(slot, kind="stable")
                heads = np.flatnonzero(np.append(True, np.diff(slot[by_slot]) != 0))
                of, weight = np.repeat(np.arange(len(rows)), x.size[rows])[by_slot], (x.weight[entry] * drop)[by_slot][:, None]

                def to_slots(flat: np.ndarray) -> np.ndarray:
                    out = np.zeros((SLOTS, flat.shape[1]), np.float32)
                    out[slot[by_slot][heads]] = np.add.reduceat(flat[of] * weight, heads)  # noqa: B023
                    return out

                grads = {"skip": x.numbers[rows].T @ gap[:, None], "slot_skip": to_slots(gap[:, None]) + 1e-4 * self.w["slot_skip"], "out": np.zeros_like(self.w["out"])}
                for d, (h, kept, where, side) in saved.items():
                    local = np.where(live, gap[where], 0).astype(np.float32)
                    grads["out"][side, 0] = np.einsum("tph,tp->h", h, local)
                    dz, grads[f"h{d}"] = self._back(local[:, :, None] * self.w["out"][side, 0], kept, d)
                    flat = np.zeros((len(rows), 4 * HIDDEN), np.float32)
                    flat[where[live]] = dz[live]
                    grads[f"x{d}"], grads[f"slot_x{d}"], grads[f"c{d}"] = x.numbers[rows].T @ flat, to_slots(flat), flat.sum(axis=0)
                tick += 1
                for k, g in grads.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    self.w[k] -= rate * (m1[k] / (1 - 0.9**tick)) / (np.sqrt(m2[k] / (1 - 0.999**tick)) + 1e-8)


# Names that page authors give to parts of a page.
MAIN_NAMES = "article content post entry story main body text article-body post-content entry-content main-content page-content article__body blog-post single".split()
SIDE_NAMES = {
    "menu": "nav menu navigation navbar topnav main-menu breadcrumbs breadcrumb pagination pager toc-nav links submenu".split(),
    "header": "header site-header masthead top banner-top branding logo site-title page-header topbar tagline".split(),
    "footer": "footer site-footer bottom copyright legal colophon page-footer imprint footer-links".split(),
    "sidebar": "sidebar side aside widget related recommended more-stories trending popular rail secondary tags archive author-box share social".split(),
    "notice": "notice cookie cookie-notice consent gdpr alert warning-bar popup modal overlay banner newsletter subscribe paywall disclaimer message announcement cookie-banner".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adslot commercial ad-container partner".split(),
    "form": "form search login signup contact-form search-form subscribe-form poll feedback".split(),
    "comments": "comments comment comment-list discussion responses replies reader-comments respond thread comment-section feedback-list user-comments disqus disqus_thread disqus-thread fb-comments giscus utterances livefyre cusdis isso commento talkback reviews guestbook remarks opinions".split(),
}
# Words that menus, footers, comment sections and notices are made of.
MENU_WORDS = "Home|About|About us|Contact|Contact us|News|Blog|Products|Services|Shop|Login|Log in|Sign in|Sign up|Register|Help|FAQ|Search|Archive|Sitemap|Sports|Business|Politics|Weather|World|Local|Opinion|Travel|Books|Videos|Photos|Store|Careers|Support|Downloads|Next|Previous|More".split("|")
FOOT_WORDS = "Contact us|Terms|Terms of use|Terms of service|Privacy|Privacy policy|Imprint|Legal notice|Cookies|Accessibility|Advertise|Sitemap|All rights reserved|Copyright|Disclaimer|Back to top|Powered by|RSS".split("|")
TALK_WORDS = "Comments|Reader comments|Leave a comment|Leave a reply|Responses|Discussion|Join the discussion|What readers say|Add your comment|Thoughts on this|Comments are closed".split("|")
TALK_LINES = "Reply|Like|Report|Posted by|says:|wrote:|hours ago|days ago|Permalink|Share|Upvote".split("|")
MARK = ("zqmainqz", "zqsideqz")


def training_pages(count: int, seed: int = 7) -> list[str]:
    """Made-up pages. Every block begins with a word of MARK that tells whether it is main text; train() takes it off again."""
    rng = random.Random(seed)
    pick = rng.choice
    chance = lambda p: rng.random() < p
    letters = ["abcdefghijklmnoprstuv", "aeiouéèàçñóäöüßlnrst"]

    pool = ["".join(pick(pick(letters)) for _ in range(rng.randrange(2, 9))) for _ in range(20_000)]

    def word() -> str:
        return pick(pool)

    def sentence(low: int, high: int) -> str:
        words = [word() for _ in range(rng.randrange(low, high))]
        return " ".join(words).capitalize() + pick([".", ".", ".", "!", "?", ""])

    def prose(low: int = 1, high: int = 6) -> str:
        out = " ".join(sentence(3, 22) for _ in range(rng.randrange(low, high)))
        if chance(0.15):
            out = out.replace(" ", f' <a href="/{word()}">{word()}</a> ', 1)
        if chance(0.15):
            out = out.replace(" ", f" <b>{word()}</b> &amp; ", 1)
        return out

    def stock() -> str:
        """A line as menus, footers and comment sections have it, or of signs and numbers, which can stand in an article too."""
        if chance(0.5):
            between = pick([" | ", " | ", " · ", " - ", ", ", " "])
            line = between.join(pick([word(), word().capitalize() + ".", str(rng.randrange(10_000)), f"{word()}@{word()}.com", f"https://{word()}.org/{word()}"]) for _ in range(rng.randrange(1, 9)))
            return line + pick(["", " |", "."])
        return pick(pick([MENU_WORDS, FOOT_WORDS, FOOT_WORDS, TALK_WORDS])) + pick([".", ".", "", "!"])

    def attributes(names: list[str]) -> str:
        kind = pick(["class", "class", "class", "id", "role"])
        extra = [word()] if chance(0.3) else []
        value = " ".join([pick(names), *extra])
        if chance(0.2):
            value = pick(["site-", "page-", "x-", "l-"]) + value
        return f' {kind}="{value}"'

    def block(tag: str, text: str, main: bool, more: str = "") -> str:
        close = "" if tag == "p" and chance(0.15) else f"</{tag}>"
        return f"<{tag}{more}>{MARK[0 if main else 1]} {text}{close}"

    def links(main: bool = False) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{MARK[0 if main else 1]} {" ".join(word() for _ in range(rng.randrange(1, 5)))}</a></li>' for _ in range(rng.randrange(2, 9))) + "</ul>"

    def side(kind: str, inside: bool = False) -> str:
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind, "div")
        named = attributes(SIDE_NAMES[kind])
        if chance(0.4):
            tag = "section" if kind == "comments" and chance(0.5) else "div"
        elif chance(0.5) and tag != "div":
            named = ""
        if kind == "menu":
            body = links() if chance(0.8) else " | ".join(block("span", word(), False) for _ in range(4))
        elif kind == "header":
            body = block(pick(["h1", "h2", "p", "div"]), sentence(1, 6), False) + (links() if chance(0.4) else "")
        elif kind == "footer":
            body = block(pick(["p", "div", "span"]), pick(["&copy; ", "© 2024 ", ""]) + prose(1, 3), False) + (links() if chance(0.4) else "")
            if chance(0.5):
                body = f"{MARK[1]} &copy; {word()}.example &middot; {sentence(2, 12)}"
        elif kind == "sidebar":
            body = block(pick(["h2", "h3", "h4", "div"]), sentence(1, 5), False) + (links() if chance(0.6) else "".join(block("p", prose(1, 4), False) for _ in range(rng.randrange(1, 4))))
        elif kind == "form":
            body = f"<label>{MARK[1]} {word()}</label><input name={word()}>" + (f"<select><option>{MARK[1]} {word()}<option>{MARK[1]} {word()}</select>" if chance(0.4) else "") + block("p", prose(1, 3), False) * int(chance(0.4)) + block("button", word(), False)
        elif kind == "comments":
            inner = pick(["div", "li", "article", "p"])
            one = lambda: f"<{inner}{attributes(['comment', 'comment-body', 'reply', 'comment-item'])}>" + block(pick(["span", "h4", "cite", "div"]), word(), False) * int(chance(0.5)) + block("p", prose(1, 4), False) + f"</{inner}>" if inner != "p" else block("p", prose(1, 4), False)
            body = block(pick(["h2", "h3", "h4"]), sentence(1, 4), False) * int(chance(0.7)) + "".join(one() for _ in range(rng.randrange(1, 7)))
        else:
            plain = chance(0.6)
            body = f"{MARK[1]} {prose(1, 3)}" if plain else "".join(block("p", prose(1, 3), False) for _ in range(rng.randrange(1, 3))) + block("button", word(), False) * int(chance(0.3))
        return f"<{tag}{named}>{body}</{tag}>"

    def main() -> str:
        body = [block("h1", sentence(2, 10) if chance(0.9) else stock(), True)] if chance(0.85) else []
        if body and chance(0.2):
            body = [f"<header>{body[0]}{block('p', sentence(4, 14), True) * int(chance(0.4))}</header>"]
        if chance(0.3):
            body.append(f"<p><b>{MARK[0]} {prose()}<br>")
        for _ in range(rng.randrange(1, 14)):
            kind = rng.random()
            if kind < 0.72:
                body.append(block("p", prose() if chance(0.78) else stock() if chance(0.5) else sentence(1, 4), True))
            elif kind < 0.8:
                body.append(block(pick(["h2", "h3"]), sentence(1, 6), True))
            elif kind < 0.85:
                body.append("<ul>" + "".join(block("li", sentence(2, 14), True) for _ in range(3)) + "</ul>")
            elif kind < 0.88:
                body.append(f"<blockquote>{block('p', prose(1, 3), True)}</blockquote>")
            elif kind < 0.9:
                body.append("<table>" + "".join("<tr>" + block("td", word(), True) + block("td", word(), True) + "</tr>" for _ in range(3)) + "</table>")
            elif kind < 0.92:
                body.append(block("pre", prose(1, 3), True))
            elif kind < 0.97:
                body.append(side(pick(["advert", "advert", "sidebar", "notice", "form"]), True))
            else:
                body.append(f"<div>{block('p', prose(), True)}</div>")
        tag = pick(["article", "article", "article", "main", "div", "div", "section"])
        named = attributes(MAIN_NAMES) if tag in ("div", "section") or chance(0.3) else ""
        out = f"<{tag}{named}>" + "".join(body)
        if chance(0.12):
            out += side("comments")
        out += f"</{tag}>"
        if chance(0.3):
            out = f"<{pick(['main', 'div'])}{attributes(['wrapper', 'container', 'page', 'layout', 'main'])}>{out}"
        return out

    def row(words: list[str], least: int = 2, most: int = 7) -> str:
        """Links of a menu or a footer in one block or several."""
        items = [pick(words) if chance(0.7) else word().capitalize() for _ in range(rng.randrange(least, most))]
        linked = [f'<a href="/{word()}">{t}</a>' if chance(0.85) else t for t in items]
        between = pick([" | ", " | ", " ", " · ", " - ", "&nbsp;&nbsp;", " &middot; ", "<br>"])
        if chance(0.6):
            return f"{MARK[1]} {between.join(linked)}"
        tag = pick(["li", "div", "p", "td"])
        rows = "".join(f"<{tag}>{MARK[1]} {t}</{tag}>" for t in linked)
        return f"<ul>{rows}</ul>" if tag == "li" else f"<table><tr>{rows}</tr></table>" if tag == "td" else rows

    def foot() -> str:
        owner = pick(["© 2024 ", "&copy; 2019-2023 ", "Copyright 2021 ", "Copyright (c) "]) + word().capitalize() + pick([".", " Ltd.", ". All rights reserved.", ", Inc."])
        return pick([f"{MARK[1]} {owner}", row(FOOT_WORDS, 1, 5), row(FOOT_WORDS, 2, 5) + f"<div>{MARK[1]} {owner}</div>", f"<p>{MARK[1]} {owner} {pick(FOOT_WORDS)} | {pick(FOOT_WORDS)}</p>"])

    def talk(named: bool) -> str:
        """Comments of readers in a part of any name, or of none."""
        head = f"{rng.randrange(1, 90)} {pick(['Comments', 'comments', 'Responses', 'replies'])}" if chance(0.4) else pick(TALK_WORDS)
        out = f"<{(t := pick(['h2', 'h3', 'h4', 'div', 'p', 'b']))}>{MARK[1]} {head}</{t}>" if chance(0.8) or not named else ""
        tag = pick(["div", "p", "li", "div"])
        for _ in range(rng.randrange(1, 7)):
            who = f"{word().capitalize()}{pick(['', ' ' + word().capitalize(), str(rng.randrange(1, 99))])}"
            style = rng.random()
            said = prose(1, 4) if chance(0.85) else sentence(1, 6)
            if style < 0.35:
                out += f"<{tag}>{MARK[1]} {who}{pick([':', ' says:', ' wrote:', ',', ' -'])} {said}</{tag}>"
            elif style < 0.7:
                out += f"<{tag}><{(t := pick(['b', 'div', 'p', 'span', 'h5']))}>{MARK[1]} {who} {pick([*TALK_LINES, '12 May 2020', '3 hours ago', ''])}</{t}><p>{MARK[1]} {said}</p>" + f"<div>{MARK[1]} {pick(TALK_LINES)}</div>" * int(chance(0.4)) + f"</{tag}>"
            else:
                out += f"<{tag}>{MARK[1]} {said}</{tag}>"
        names = pick([attributes(SIDE_NAMES["comments"]), f' id="{pick(SIDE_NAMES["comments"])}"', f' id={pick(SIDE_NAMES["comments"])}'])
        return f"<{(t := pick(['div', 'div', 'section', 'ul']))}{names if named else ''}>{out}</{t}>"

    def plain_main() -> str:
        """An article without telling names: paragraphs, or bare blocks."""
        out = f"<{(t := pick(['h1', 'h1', 'h2', 'h3', 'b', 'div']))}>{MARK[0]} {sentence(2, 10)}</{t}>" if chance(0.75) else ""
        tag = pick(["p", "p", "p", "div"])
        for k in range(rng.randrange(1, 10)):
            out += block(tag, prose(1, 7) if chance(0.8) or not k else stock() if chance(0.3) else sentence(2, 8), True)
            if chance(0.08):
                out += block(pick(["h2", "h3", "h4"]), sentence(1, 6), True)
            if chance(0.05):
                out += "<ul>" + "".join(block("li", sentence(2, 12), True) for _ in range(3)) + "</ul>"
        return out

    def plain_page() -> str:
        """Parts in boxes without names, one after the other, in a layout table, or with nothing around them."""
        style = rng.random()
        title = f"<{(t := pick(['div', 'b', 'p', 'h1', 'h2']))}>{MARK[1]} {word().capitalize()} {word()}</{t}>" if chance(0.3) else ""
        top = [title + (row(MENU_WORDS) if chance(0.8) else "")] if chance(0.85) else []
        rest = [talk(chance(0.6))] if chance(0.45) else []
        rest += [foot()] if chance(0.8) else []
        aside = [row(MENU_WORDS, 3, 9) if chance(0.7) else block("h4", sentence(1, 4), False) + links()] if chance(0.4) else []
        if style < 0.45:
            box = lambda t: f"<div>{t}</div>"
            inner = [box(t) for t in (*top, *(aside if chance(0.5) else []), plain_main(), *rest)]
            body = "".join(inner)
            return f"<div>{body}</div>" if chance(0.3) else body
        if style < 0.8:
            cell = lambda t: f"<td{pick(['', ' valign=top', ' width=150'])}>{t}</td>"
            middle = [cell(t) for t in (*aside, plain_main())] if chance(0.7) else [cell(t) for t in (plain_main(), *aside)]
            lines = [*[cell(t) for t in top], "".join(middle), *[cell(t) for t in rest]]
            return f"<table{pick(['', ' border=0 cellpadding=4', ' width=100%'])}>" + "".join(f"<tr>{t}</tr>" for t in lines) + "</table>"
        return "".join([*top, plain_main(), *rest])

    pages = []
    for _ in range(count):
        head = f"<head><title>{MARK[1]} {sentence(2, 10)}</title><style>p{{margin:0}}</style></head>"
        if chance(0.4):
            pages.append(f"<html>{head}<body>{plain_page()}" + "</body></html>" * int(chance(0.9)))
            continue
        above = [side(k) for k in ("notice", "header", "menu", "advert", "form") if chance(0.5)]
        below = [talk(True) if k == "comments" and chance(0.4) else side(k) for k in ("sidebar", "comments", "advert", "form", "notice") if chance(0.4)]
        if chance(0.3):
            above, below = [*above, *(b for b in below[:1])], below[1:]
        last = [side("footer")] if chance(0.85) else []
        rng.shuffle(below)
        page = f'<!DOCTYPE html><html lang="{word()[:2]}">{head}<body>' + "".join([*above, main(), *below, *last])
        pages.append(page + "</body></html>" * int(chance(0.9)))
    return pages


@functools.lru_cache(1)
def trained(pages: int = 3000) -> Labeller:
    """The model, from a fixed number of made-up pages and fixed seeds: always the same."""
    read = [blocks(p) for p in training_pages(pages)]
    labels = []
    for b in read:
        kept = [i for i, t in enumerate(b.text) if MARK[0] in t or MARK[1] in t]
        labels += [MARK[0] in b.text[i] for i in kept]
        for name in ("path", "leaf", "linked", "heading"):
            setattr(b, name, [getattr(b, name)[i] for i in kept])
        b.text = [" ".join(w for w in b.text[i].split() if w not in MARK) or "-" for i in kept]
    read = [b for b in read if b.text]
    model = Labeller()
    model.fit(Inputs(read), np.array([len(b.text) for b in read]), np.array(labels, np.float32))
    return model


def labelled(read: list[Blocks], model: Labeller) -> list[np.ndarray]:
    """Which blocks of each page are main text. Pages of like length are run side by side, about STEPS blocks at a time."""
    counts = np.array([len(b.text) for b in read], np.int64)
    keep = [np.zeros(0, bool)] * len(read)
    order = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
    x, first = Inputs(read), np.cumsum(counts) - counts
    at = 0
    while at < len(order):
        some = order[at : at + max(1, min(256, 4 * STEPS // int(counts[order[at]])))]
        for i, said in zip(some.tolist(), model.logits(x, some, first, counts), strict=True):
            keep[i] = said > 0
        at += len(some)
    return keep


def main_texts(pages: list[str], model: Labeller) -> list[str]:
    """Main text of each page: its blocks that the model takes, two line ends between them."""
    read = [blocks(p) for p in pages]
    return ["\n\n".join(t for t, k in zip(b.text, keep.tolist(), strict=True) if k) for b, keep in zip(read, labelled(read, model), strict=True)]


def extract(pages: DataFrame, carry: list[str] | None = None, html_column: str = "html") -> DataFrame:
    """pages' columns (or those of `carry`; never the HTML) with main_text and n_chars (its code points).

    Null and empty pages give an empty text, and so do pages without main text.
    Whole pages are read, repeated rows alike; nesting may be of any depth, and
    memory grows with a page's length only by its own blocks and text. Columns of
    pages with the results' names are replaced.
    """
    carry = [c for c in carry or pages.columns if c not in ("main_text", "n_chars", html_column)]
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trained().w)

    def run(batches):
        model = Labeller()
        model.w = shared.value
        for batch in slices(batches, "html_to_read", 2 << 20):
            texts = main_texts([t or "" for t in batch.column("html_to_read").to_pylist()], model)
            yield pa.record_batch([*[batch.column(c) for c in carry], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*carry, "main_text", "n_chars"])

    schema = pages.select(*carry).schema.add("main_text", "string").add("n_chars", "long")
    return pages.select(*carry, F.col(html_column).alias("html_to_read")).mapInArrow(run, schema)


def op7_block_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, ["page_id", "url"]).select("page_id", "url", F.col("main_text").alias("text"), "n_chars")
