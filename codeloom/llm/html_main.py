"""HTML extraction by a recurrent block labeller.

A page is cut into blocks: runs of text between tags that start a new line. Every block becomes a
vector of its tag path, its hashed words and a few numbers, and a bidirectional LSTM in numpy reads
the blocks of a page in order and gives each the probability of being main text.

The labeller is trained on a bounded sample of pages. Their own structure gives the labels: blocks
in an article or main element are main text, unless an element between has another role. So that
it does not depend on one layout, every sampled page is also laid out anew in other common ways,
with other names for the containers and with more kinds of blocks around and inside the article.
Where no page has such an element, plain text blocks of the sampled pages are laid out so.

A block's place in the page is a node of the tree of open elements, which holds the hashed names of
all elements around it as the bits of one number, so deep pages take memory in proportion to their
tags. The part of the input that comes from the path is the same for all blocks of a node and is
multiplied once; long pages go through the network in steps that carry its state on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import log1p, sqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import in_slices, smallest_hashes
from codeloom.sources.tables import read_table

# Elements that do not start a new block (formulas among them), that have no end tag, and whose content is no text.
INLINE = frozenset(
    """a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
    math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template svg annotation annotation-xml iframe object title textarea select option datalist canvas audio video".split())
#: Elements that every page has, whether their tags are there or not: these start no block and close nothing.
IMPLIED = frozenset("html head body".split())
#: An open element that one of these start tags closes.
CLOSED_BY = {"p": frozenset("p h1 h2 h3 h4 h5 h6 ul ol table div section article aside nav footer header form blockquote pre hr main".split()), "li": frozenset(["li"]), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "tr": frozenset(["tr"]), "td": frozenset("td th tr".split()), "th": frozenset("td th tr".split()), "option": frozenset(["option"])}

RAW = frozenset("script style textarea title noscript iframe".split())

#: A comment, a tag with its attributes, or another declaration.
MARKUP = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">]+)*+|[^>]*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME = re.compile(r"[a-z]+")
PATH_BITS, WORD_BITS, NUMBERS = 9, 5, 8
DENSE = (1 << WORD_BITS) + NUMBERS
WIDTH = (1 << PATH_BITS) + DENSE


@lru_cache(maxsize=50_000)
def _bit(name: str) -> int:
    return 1 << (crc32(name.encode()) >> (32 - PATH_BITS))


class Node:
    """An open element: its names (the tag and, after a dot each, the words of its class, id and role) and what holds of all names around it and its own."""

    __slots__ = ("parent", "names", "bits", "depth", "main", "role")

    def __init__(self, parent: Node | None, names: tuple[str, ...]):
        self.parent, self.names = parent, names
        self.bits, self.depth, self.main, self.role = (parent.bits, parent.depth, parent.main, parent.role) if parent else (0, 0, False, False)
        for name in names:
            self.bits |= _bit(name)
            self.main = self.main or name in ("article", "main")
            self.role = self.role or name in ROLES
        self.depth += len(names)

    def path(self) -> tuple[str, ...]:
        """All names from the outermost on."""
        own, node = [], self
        while node:
            own.append(node.names)
            node = node.parent
        return tuple(x for names in reversed(own) for x in names)


def node_of(spec: str, parent: Node | None = None) -> Node | None:
    """The node that a path such as ``div.main p`` leads to."""
    for part in spec.split():
        tag, *words = part.split(".")
        parent = Node(parent, (tag, *("." + w for w in words)))
    return parent


Block = tuple[Node | None, str, int]


def blocks(html: str | None) -> list[Block]:
    """(node, text, characters in links) for every block of a page in order.

    A null or empty page has no blocks; broken markup is read as far as it goes: end tags without a
    start are ignored, and open elements end with the one around them, those without text too. All
    content is in the body, as the tags of html, head and body may be left out. A CDATA section is a
    comment up to the first ``>``, as in HTML.
    """
    html = html or ""
    found: list[Block] = []
    open_: list[tuple[str, Node]] = [("body", Node(None, ("body",)))]
    n_open: Counter[str] = Counter()
    inner: Counter[str] = Counter()  # what is open from the dropped element on
    parts: list[str] = []
    linked, in_link, dropped, in_body = 0, False, "", False

    def end_block() -> None:
        nonlocal linked, in_link
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append((open_[-1][1], text, linked))
            parts.clear()
        linked, in_link = 0, False

    def add(text: str) -> None:
        nonlocal linked
        if not dropped and text:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            linked += len(text) if in_link else 0

    def close_last() -> str:
        tag = open_.pop()[0]
        n_open[tag] -= 1
        return tag

    at = 0
    while m := MARKUP.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if dropped and inner[tag]:
                inner[tag] -= 1
                dropped = dropped if inner[dropped] else ""
                continue
            if dropped and not n_open[tag]:
                continue
            dropped = ""
            if tag == "a":
                in_link = False
            elif tag not in INLINE:
                end_block()
                while n_open[tag] and close_last() != tag:
                    pass
        elif tag in IMPLIED:
            if tag == "body" and not in_body:
                in_body, dropped = True, ""
        elif dropped:
            if tag not in VOID and not m[3].endswith("/"):
                inner[tag] += 1
        elif tag in DROPPED:
            parts.append(" ")
            if tag in RAW:
                end = _raw_end(tag).search(html, at)
                at = end.start() if end else len(html)
            if not m[3].endswith("/"):
                dropped, inner = tag, Counter([tag])
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = True
        elif tag not in INLINE:
            end_block()
            while tag in CLOSED_BY.get(open_[-1][0], ()):
                close_last()
            if tag not in VOID:
                words = tuple("." + x for v in ATTRIBUTE.findall(m[3]) for x in NAME.findall(v.lower())) if m[3] else ()
                open_.append((tag, Node(open_[-1][1], (tag, *words))))
                n_open[tag] += 1
    add(html[at:])
    end_block()
    return found


@lru_cache(maxsize=16)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}", re.I)


class _WordPlaces(dict):
    """The place of a word's count, kept for words seen before."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        place = self[word] = crc32(word.encode("utf-8", "surrogatepass")) & ((1 << WORD_BITS) - 1)
        return place


_word_places = _WordPlaces()
_DIGIT = re.compile(r"[0-9]")


class Vectors:
    """The input for the blocks of a page: of each block its path as a number, of each distinct path its places as a row of zeros and ones, and of each block 40 more numbers."""

    def __init__(self, page: list[Block]):
        known: dict[int, int] = {}
        self.path = np.array([known.setdefault(node.bits if node else 0, len(known)) for node, _, _ in page], np.int64)
        size = (1 << PATH_BITS) // 8
        packed = np.frombuffer(b"".join(bits.to_bytes(size, "little") for bits in known), np.uint8).reshape(-1, size)
        self.paths = np.unpackbits(packed, axis=1, bitorder="little")
        self.dense = np.zeros((len(page), DENSE), np.float32)
        for i, (node, text, linked) in enumerate(page):
            words = text.split(" ")
            counts = np.bincount(list(map(_word_places.__getitem__, words)), minlength=1 << WORD_BITS)
            self.dense[i, :-NUMBERS] = counts / sqrt(counts @ counts)
            self.dense[i, -NUMBERS:] = (
                log1p(len(text)) / 8, log1p(len(words)) / 6, linked / len(text), text[-1] in ".!?", (node.depth if node else 0) / 10,
                i / len(page), (text.count(".") + text.count(",")) / len(words), _DIGIT.search(text) is not None,
            )

    def __len__(self) -> int:
        return len(self.path)

    def rows(self) -> np.ndarray:
        """All numbers of every block in one row, for training."""
        return np.concatenate([self.paths[self.path].astype(np.float32), self.dense], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM and a logistic output, over padded batches of pages (page, block, feature)."""

    def __init__(self, hidden: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for way in "fb":
            self.p["x" + way] = (rng.standard_normal((WIDTH, 4 * hidden)) / 8).astype(np.float32)
            self.p["h" + way] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.p["c" + way] = np.repeat(np.float32([0, 1, 0, 0]), hidden)
        self.p["o"] = (rng.standard_normal((2 * hidden, 1)) / np.sqrt(hidden)).astype(np.float32)
        self.p["d"] = np.zeros(1, np.float32)

    def _steps(self, gates: np.ndarray, mask: np.ndarray, way: str, h: np.ndarray, c: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(outputs, last output, last cell) for inputs to the gates (page, block, gate), from a state on."""
        n, steps, _ = gates.shape
        k = self.hidden
        out = np.zeros((n, steps, k), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            m = mask[:, t, None]
            z = gates[:, t] + h @ self.p["h" + way]
            s, g = _sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
            i, f, o = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :]
            new_c = (f * c + i * g) * m
            tanh_c = np.tanh(new_c)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tanh_c, m))
            h, c = o * tanh_c * m, new_c
            out[:, t] = h
        return out, h, c

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        n, steps, _ = x.shape
        gates = (x.reshape(n * steps, -1) @ self.p["x" + way] + self.p["c" + way]).reshape(n, steps, -1)
        zero = np.zeros((n, self.hidden), np.float32)
        return self._steps(gates, mask, way, zero, zero, keep)[0]

    def _output(self, both: np.ndarray) -> np.ndarray:
        return _sigmoid(both @ self.p["o"] + self.p["d"])[..., 0]

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self._output(np.concatenate([self._run(x, mask, w, None) for w in "fb"], axis=2))

    def _gates(self, page: Vectors, way: str, part: slice) -> np.ndarray:
        weights = self.p["x" + way]
        of_path = page.paths.astype(np.float32) @ weights[: 1 << PATH_BITS] + self.p["c" + way]
        return of_path[page.path[part]] + page.dense[part] @ weights[1 << PATH_BITS :]

    def label(self, pages: list[Vectors], at_once: int = 8192) -> list[np.ndarray]:
        """The probabilities of the blocks of several pages, which are padded to the longest; a page of over ``at_once`` blocks comes alone and goes through in steps."""
        steps, n = max(map(len, pages)), len(pages)
        both = []
        for way in "fb":
            h = c = np.zeros((n, self.hidden), np.float32)
            out = np.zeros((n, steps, self.hidden), np.float32)
            parts = range(0, steps, at_once)
            for first in parts if way == "f" else reversed(parts):
                width = min(at_once, steps - first)
                gates, mask = np.zeros((n, width, 4 * self.hidden), np.float32), np.zeros((n, width), np.float32)
                for i, page in enumerate(pages):
                    own = self._gates(page, way, slice(first, first + width))
                    gates[i, : len(own)], mask[i, : len(own)] = own, 1
                out[:, first : first + width], h, c = self._steps(gates, mask, way, h, c)
            both.append(out)
        found = self._output(np.concatenate(both, axis=2))
        return [found[i, : len(page)] for i, page in enumerate(pages)]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of the blocks."""
        kept = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, w, kept[w]) for w in "fb"], axis=2)
        error = ((self._output(both) - y) * mask / mask.sum())[..., None].astype(np.float32)
        k = self.hidden
        grad = {"o": np.einsum("nti,ntj->ij", both, error), "d": error.sum((0, 1))}
        back = error @ self.p["o"].T
        for w, part in (("f", back[..., :k]), ("b", back[..., k:])):
            dh, dc = np.zeros((len(x), k), np.float32), np.zeros((len(x), k), np.float32)
            dz_all = np.zeros((*x.shape[:2], 4 * k), np.float32)
            grad["h" + w] = np.zeros_like(self.p["h" + w])
            for t, h, c, i, f, o, g, tanh_c, m in reversed(kept[w]):
                dh = (dh + part[:, t]) * m
                dc = (dc + dh * o * (1 - tanh_c**2)) * m
                dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tanh_c * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                grad["h" + w] += h.T @ dz
                dz_all[:, t] = dz
                dh, dc = dz @ self.p["h" + w].T, dc * f
            grad["x" + w] = x.reshape(-1, WIDTH).T @ dz_all.reshape(-1, 4 * k)
            grad["c" + w] = dz_all.sum((0, 1))
        return grad


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((len(pages), steps, WIDTH), np.float32), np.zeros((len(pages), steps), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask


def fit(pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 24, batch: int = 64, rate: float = 0.01, seed: int = 0) -> Labeller:
    """By Adam, with steps that shrink to nothing, on (vectors, labels) of pages."""
    rng, net = np.random.default_rng(seed), Labeller(seed=seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step, steps = 0, rounds * -(-len(pages) // batch)
    for _ in range(rounds):
        order = sorted(rng.permutation(len(pages)).tolist(), key=lambda i: len(pages[i][0]))  # pages of one batch are about as long
        for at in rng.permutation(range(0, len(order), batch)).tolist():
            own = [pages[i] for i in order[at : at + batch]]
            x, mask = padded([p for p, _ in own])
            y = np.zeros_like(mask)
            for i, (_, label) in enumerate(own):
                y[i, : len(label)] = label
            step += 1
            for k, g in net.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.p[k] -= (rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


# Containers of main text, and surroundings by their role, as they occur on web pages.
CONTAINERS = ["article", "main", "main article", "div.content", "div.main.content", "div.post article", "div.entry.content", "section.article", "div.article.body", "div.story", "div.wrapper article.post", "main div.container", "div.page div.text", "section", "div", "article div.section", "article section", "div.blog.post"]
OTHERS = ["nav ul li", "nav", "div.nav", "ul.menu li", "div.menu ul li", "header", "header h1", "header div.logo", "div.header", "header.site.header p", "div.masthead", "footer", "footer p", "div.footer", "footer ul li", "div.copyright", "aside", "aside p", "aside h3", "aside.sidebar p", "aside ul li", "div.sidebar", "div.sidebar p", "div.sidebar ul li", "div.widget", "div.ad", "div.ads", "div.advert p", "div.advertisement", "section.sponsored p", "div.sponsor", "div.promo", "div.banner", "div.cookie", "div.cookie.notice p", "div.cookie.consent p", "div.notice", "div.notice p", "div.alert", "div.gdpr p", "div.consent", "div.popup", "div.modal p", "form", "form p", "form.search", "form div", "div.newsletter", "div.newsletter form p", "div.subscribe p", "div.signup", "div.comments p", "section.comments", "section.comments p", "section.comments h2", "section.comments div.comment p", "div.comment", "div.comment.body p", "ol.comment.list li p", "ul.comments li", "div.discussion p", "div.replies p", "div.related", "div.related ul li", "section.related h3", "div.recommended li", "div.breadcrumb", "div.breadcrumbs", "nav.breadcrumb", "div.share", "div.social", "ul.social li", "div.tags", "div.pagination", "div.login form p", "div.skip", "div.disclaimer p", "div.legal", "table.menu td", "dialog p", "button", "div.author.bio p", "div.teaser"]
OWN = ["p", "p", "p", "p", "h2", "h3", "ul li", "ol li", "blockquote", "blockquote p", "pre", "table tr td", "div", "figure figcaption", "dl dd", "p"]
ROLES = frozenset(x for o in OTHERS for x in o.replace(".", " .").split() if x not in {"ul", "li", "p", "h1", "h2", "h3", "div", "section", "ol", "table", "td", "article", ".body", ".list", ".site", ".author", ".skip"})


def own_labels(page: list[Block]) -> np.ndarray:
    """By the page's own structure: inside article or main, and in nothing of another role there."""
    return np.array([node is not None and node.main and not node.role for node, _, _ in page], np.float32)


def plain_labels(page: list[Block]) -> np.ndarray:
    """For pages without such structure: blocks of 80 characters or more, mostly outside links, in nothing of another role; or else the longest block."""
    out = np.array([len(text) >= 80 and 2 * linked < len(text) and not (node and node.role) for node, text, linked in page], np.float32)
    if not out.any():
        out[max(range(len(page)), key=lambda i: (not (page[i][0] and page[i][0].role), len(page[i][1])))] = 1
    return out


def laid_out(page: list[Block], label: np.ndarray, rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The page's blocks under other paths, with more surroundings, of which some hold whole sentences as main text does."""
    main = [b for b, y in zip(page, label, strict=True) if y]
    first = rng.integers(len(main))
    main = main[first : first + 8]
    rest = [b for b, y in zip(page, label, strict=True) if not y][:200]
    outer = node_of("html body" + ["", " div", " div.container", " div.wrapper", " div.page"][rng.integers(5)])
    own = node_of(CONTAINERS[rng.integers(len(CONTAINERS))], outer)
    texts = [b[1] for b in rest] + [b[1] for b in main]

    def other(inside: Node) -> list[Block]:
        node = node_of(OTHERS[rng.integers(len(OTHERS))], inside)
        out = []
        for _ in range(rng.integers(1, 4)):
            text = texts[rng.integers(len(texts))]
            if rng.random() < 0.4:
                text = " ".join(text.split(" ")[: rng.integers(1, 6)])
            out.append((node, text, len(text) if rng.random() < 0.3 else 0))
        return out

    before = [b for _ in range(rng.integers(1, 5)) for b in other(outer)]
    after = [b for _ in range(rng.integers(1, 5)) for b in other(outer)]
    middle, y = [], []
    for k, (node, text, linked) in enumerate(main):
        kind = "h1" if node and node.names[:1] == ("h1",) or k == 0 and rng.random() < 0.5 else OWN[rng.integers(len(OWN))]
        if rng.random() < 0.15:
            text = " ".join(text.split(" ")[: rng.integers(1, 8)])
        middle.append((node_of(kind, own), text, min(linked, len(text))))
        y.append(1)
        if rng.random() < 0.35:
            extra = other(own)[:1]
            middle += extra
            y += [0] * len(extra)
    return [*before, *middle, *after], np.array([0] * len(before) + y + [0] * len(after), np.float32)


HAS_MAIN = r"(?i)<(article|main)[\s>]"


def train(pages: DataFrame, html: str = "html", page_id: str = "page_id", sample: int = 150, layouts: int = 8, longest: int = 60_000, most_blocks: int = 400) -> Labeller | None:
    """Fit on the ``sample`` pages with an article or main element whose ids have the smallest hashes, and on ``layouts`` other layouts of each.

    Of each page the first ``longest`` characters and ``most_blocks`` blocks count here, so the
    sample's size is bounded. Where no page has such an element, or none in that part, other pages
    are sampled and their plain text blocks stand for main text. A small sample is laid out more
    often. None only where no page has a block of text.
    """
    own = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.substring(F.col(f"`{html}`").cast("string"), 1, longest).alias("html"))

    def sampled(rows: DataFrame) -> list[list[Block]]:
        few = smallest_hashes(rows, "page_id", sample).orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html")).limit(sample).collect()
        return [found for r in few if (found := blocks(r.html)[:most_blocks])]

    marked = sampled(own.where(F.col("html").rlike(HAS_MAIN)))
    labelled = [(page, label) for page in marked if (label := own_labels(page)).any()]
    if labelled:
        data = [(Vectors(page), label) for page, label in labelled]
    else:
        labelled = [(page, plain_labels(page)) for page in sampled(own.where(F.col("html").rlike(r"[^\s<>]")))]
        data = []
    rng = np.random.default_rng(0)
    for page, label in labelled:
        for _ in range(max(layouts, -(-600 // len(labelled)))):
            new, y = laid_out(page, label, rng)
            data.append((Vectors(new), y))
    return fit([(v.rows(), y) for v, y in data]) if data else None


def main_texts(htmls: list[str | None], net: Labeller | None, threshold: float = 0.5, at_once: int = 4000) -> list[str]:
    """The main text of each page; pages of similar numbers of blocks are labelled together."""
    pages = [blocks(h) for h in htmls]
    out = [""] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    if order and net is None:
        raise ValueError("pages with text need a labeller")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= at_once:
            end += 1
        own = order[at:end]
        for i, p in zip(own, net.label([Vectors(pages[i]) for i in own]), strict=True):
            out[i] = "\n".join(text for (_, text, _), y in zip(pages[i], p, strict=True) if y >= threshold)
        at = end
    return out


def extract(pages: DataFrame, net: Labeller | None, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, text, n_chars) for every page. Null and empty pages have an empty text.

    Without a labeller, which ``train`` gives whenever a page has text, a page that has text is an
    error. A block whose probability is just a half is main text. Repeated rows give repeated
    results; an empty table gives no rows; other columns do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 500):
            texts = main_texts(batch.column(2).to_pylist(), net)
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_block_lstm(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = read_table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
