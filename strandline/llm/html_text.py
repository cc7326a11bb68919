"""Main text of web pages by a recurrent block labeller in numpy.

A page is cut into its leaf blocks, the texts between block-level tags. A block is a vector of its hashed
tag path (names, classes and ids of what encloses it), its hashed words and its size; a
bidirectional LSTM reads the blocks of the whole page and labels each as main text or not. It is
trained when the operator is built, on pages made from a fixed seed whose blocks are labelled by their making. Pages are
labelled where they lie, in batches of similar length; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm import kernels as K

PATH, WORDS, SIZES, HIDDEN = 128, 32, 4, 16
INPUT = PATH + WORDS + SIZES
#: Enclosing elements, the innermost, that a block is told by; deeper pages than any author writes would else take quadratic memory. No text is lost by it.
DEPTH = 64
# Elements whose content is never text, that hold nothing, and that start a block.
RAW = "script|style|noscript|template|svg|iframe|textarea|title"
FOREIGN = frozenset(("svg",))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul button label".split()
)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
BARE = re.compile(r"[^\s>]*")
#: An attribute up to its value, or what stands between attributes.
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?|[\s/=]+")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW.split("|")}


class Tags:
    """The markup of a page in order: (start, end, closing, name, attributes), found in time linear in its length.

    What begins like a tag and never ends is text, as is a lone ``<``. A quoted value counts as one only if a blank, a
    slash or the end of the tag follows its closing quote, so that a stray quote hides no text.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quotes: dict[str, int] = {q: page.rfind(q) for q in "\"'"}

    def _value(self, at: int) -> tuple[str, int]:
        q = self.page[at : at + 1]
        if q and q in self.quotes and self.quotes[q] > at:
            to = self.page.find(q, at + 1)
            if self.page[to + 1 : to + 2] in ("", ">", "/") or self.page[to + 1].isspace():
                return self.page[at + 1 : to], to + 1
        m = BARE.match(self.page, at)
        return m[0], m.end()

    def _attributes(self, at: int) -> tuple[list[tuple[str, str]], int]:
        out = []
        while at <= self.last and self.page[at] != ">":
            m = ATTRIBUTE.match(self.page, at)
            at = m.end()
            if m[1]:
                value = ""
                if m[2]:
                    value, at = self._value(at)
                out.append((m[1].lower(), value))
        return out, at

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, list[tuple[str, str]]]]:
        page, at = self.page, 0
        while 0 <= (at := page.find("<", at)) <= self.last:
            begin, nxt = at, page[at + 1 : at + 2]
            if page.startswith("<!--", at):
                to = page.find("-->", at + 4)
                at = to + 3 if to >= 0 else len(page)
                yield begin, at, False, "", []
            elif nxt in ("!", "?"):
                at = page.find(">", at) + 1
                yield begin, at, False, "", []
            elif m := NAME.match(page, at + 1 + (nxt == "/")):
                name, closing = m[0].lower(), nxt == "/"
                attributes, to = self._attributes(m.end())
                if to > self.last:  # it never ends
                    return
                at = to + 1
                if name in ENDS and not closing:
                    # foreign content may close itself, and what has no end there ends nothing else
                    alone = name in FOREIGN and page[to - 1] == "/" and not (attributes and attributes[-1][1].endswith("/"))
                    end = None if alone else ENDS[name].search(page, at)
                    to = page.find(">", end.end()) if end else -1
                    at = to + 1 if to >= 0 else at if name in FOREIGN else len(page)
                    yield begin, at, False, "", []
                else:
                    yield begin, at, closing, name, attributes
            else:
                at += 1


#: Elements that the start of another one of the same group closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}


def blocks(page: str) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, tag path, characters in links) of the non-empty leaf blocks, in page order."""
    out: list[tuple[str, tuple[str, ...], int]] = []
    path: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked, in_link, at = 0, 0, 0

    def close() -> None:
        nonlocal linked
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            out.append((joined, tuple(x for _, names in path[-DEPTH:] for x in names), linked))
        text.clear()
        linked = 0

    def take(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            linked += len(piece) * (in_link > 0)

    for begin, end, closing, name, attributes in Tags(page):
        take(page[at:begin])
        at = end
        if name == "a":
            in_link = max(0, in_link + (-1 if closing else 1))
        elif name == "br":
            text.append(" ")
        elif name in BLOCK:
            close()
            if closing:
                depth = next((i for i in range(len(path) - 1, -1, -1) if path[i][0] == name), None)
                if depth is not None:
                    del path[depth:]
            else:
                shut = CLOSES.get(name) or ({"p"} if path and path[-1][0] == "p" else set())
                while path and path[-1][0] in shut:
                    path.pop()
                if name not in VOID:
                    named = [w for key, x in attributes if key in ("class", "id", "role") for w in re.split(r"[\s_-]+", x.lower()) if w]
                    path.append((name, (f"<{name}>", *(f".{w}" for w in named))))
            in_link = 0
    take(page[at:])
    close()
    return out


@lru_cache(maxsize=4096)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH, np.float32)
    for x in path:
        out[zlib.crc32(x.encode()) % PATH] = 1
    return out


def features(found: list[tuple[str, tuple[str, ...], int]]) -> np.ndarray:
    """One row a block: hashed tag path, hashed words, length, share of links, share of capitals and of marks."""
    out = np.zeros((len(found), INPUT), np.float32)
    if not found:
        return out
    raw = [t.encode() for t, _, _ in found]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    low = K.LOWER[data]
    starts, ends, first = K.tokens(low, off, K.ALNUM[low])
    slot = np.repeat(np.arange(len(found)), np.diff(first)) * WORDS + (K.span(K.prefix(low), starts, ends) % np.uint64(WORDS)).astype(np.int64)
    words = np.bincount(slot, minlength=len(found) * WORDS).reshape(-1, WORDS)
    n = np.diff(off)
    out[:, :PATH] = [_path_vector(p) for _, p, _ in found]
    out[:, PATH : PATH + WORDS] = 0.3 * np.sqrt(words / np.maximum(1, words.sum(1, keepdims=True)))
    marks = np.add.reduceat((data == 46) | (data == 44), off[:-1]) / n
    capital = np.add.reduceat((data >= 65) & (data <= 90), off[:-1]) / n
    out[:, PATH + WORDS :] = np.stack([np.log1p(n) / 6, [link / max(1, len(t)) for t, _, link in found], marks * 10, capital], 1)
    return out


class Labeller:
    """Bidirectional LSTM with a logistic output at every block."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": r.normal(0, 0.2, (INPUT, 4 * HIDDEN)), f"h{d}": r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        self.p |= {"o": r.normal(0, 0.2, 2 * HIDDEN), "ob": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _direction(self, x: np.ndarray, mask: np.ndarray, d: str):
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        gates_in, kept = x @ self.p[f"x{d}"] + self.p[f"b{d}"], []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = gates_in[t] + h @ self.p[f"h{d}"]
            s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            k = mask[t][:, None]
            tc = np.tanh(new)
            kept.append((t, h, c, i, f, o, g, tc))
            h, c = k * o * tc + (1 - k) * h, k * new + (1 - k) * c
            kept[-1] += (h,)
        return kept

    def probability(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: blocks, pages, input; mask: blocks, pages."""
        both = [self._direction(x, mask, d) for d in "fb"]
        hidden = np.zeros((*mask.shape, 2 * HIDDEN), np.float32)
        for k, kept in enumerate(both):
            for step in kept:
                hidden[step[0], :, k * HIDDEN : (k + 1) * HIDDEN] = step[-1]
        p = 1 / (1 + np.exp(-(hidden @ self.p["o"] + self.p["ob"])))
        return (p, hidden, both) if keep else p

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, hidden, both = self.probability(x, mask, True)
        dz = ((p - y) * mask / mask.sum()).astype(np.float32)
        out = {"o": np.einsum("tb,tbh->h", dz, hidden), "ob": dz.sum(keepdims=True).reshape(1)}
        for n, d in enumerate("fb"):
            wh = self.p[f"h{d}"]
            gx, gh, gb = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(wh), np.zeros_like(self.p[f"b{d}"])
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h0, c0, i, f, o, g, tc, _ in reversed(both[n]):
                k = mask[t][:, None]
                dh = dh + dz[t][:, None] * self.p["o"][n * HIDDEN : (n + 1) * HIDDEN]
                do, dnew = k * dh * tc, k * (dc + dh * o * (1 - tc * tc))
                dgate = np.concatenate([dnew * g * i * (1 - i), dnew * c0 * f * (1 - f), do * o * (1 - o), dnew * i * (1 - g * g)], 1)
                gx += x[t].T @ dgate
                gh += h0.T @ dgate
                gb += dgate.sum(0)
                dh, dc = (1 - k) * dh + dgate @ wh.T, (1 - k) * dc + dnew * f
            out |= {f"x{d}": gx, f"h{d}": gh, f"b{d}": gb}
        return out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, seed: int) -> None:
        r, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = r.permutation(len(pages))
            for i in range(0, len(pages), 20):
                some = [pages[k] for k in order[i : i + 20]]
                x, mask = padded([x for x, _ in some])
                y = np.zeros(mask.shape, np.float32)
                for k, (_, label) in enumerate(some):
                    y[: len(label), k] = label
                step += 1
                for k, g in self.gradient(x, mask, y).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= (0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max((len(p) for p in pages), default=0)
    x, mask = np.zeros((longest, len(pages), INPUT), np.float32), np.zeros((longest, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[int]]]:
    """``n`` pages and the labels of their blocks, 1 for main text."""
    r = np.random.default_rng(seed)
    one = lambda s: s[int(r.integers(0, len(s)))]
    word = lambda: "".join(one("bcdfghlmnprst") + one("aeiou") for _ in range(r.integers(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.integers(a, b))).capitalize()
    odd = lambda t: " ".join(w + one(("", "###", "$$$", "***")) for w in t.split()) if r.random() < 0.15 else t
    pages = []
    for _ in range(n):
        parts: list[str] = ["<!DOCTYPE html><html><head><title>x</title></head><body>"]
        labels: list[int] = []

        def block(tag: str, text: str, label: int, parts: list[str] = parts, labels: list[int] = labels) -> None:
            end = "" if tag == "p" and r.random() < 0.2 else f"</{tag.split()[0]}>"
            parts.append(f"<{tag}>{text}{end}")
            labels.append(label)

        def menu(parts: list[str] = parts) -> None:
            wrap = one((f'<div class="{word()}">', "<ul>", "<nav>", "<nav><ul>", "<nav><ul>", "<header><nav><ul>", '<div class="menu"><ul>', '<div class="menu">', '<ul class="nav">', "<header>", '<div id="header">', '<div class="breadcrumb">'))
            parts.append(wrap)
            for _ in range(r.integers(1, 8)):
                block(one(("li", "li", "div", "p")), f'<a href="/{word()}">{one((word(), words(1, 4)))}{one(("", "", ",", "."))}</a>', 0)
            parts.append(f"</{re.split('[ >]', wrap[1:])[0]}>")

        def side(parts: list[str] = parts) -> None:
            names = ("ad", "ads advert", "sidebar", "promo banner", "cookie notice", "related", "share", "comments", "comment", "newsletter", "popup", "widget", "comment list", "user comments", "reply")
            wrap = one([f'<div class="{x}">' for x in names] + [f'<div class="{one(names)} {word()}">', f'<div id="{word()}-{one(names).split()[0]}">',"<aside>", '<div id="comments">', '<section class="comments">', "<form>", '<div id="sidebar">', '<div role="complementary">'])
            parts.append(wrap)
            linked = r.random() < 0.3
            inner = one(("ul", "ol", "div")) if linked else ""
            parts.append(f"<{inner}>" if inner else "")
            for _ in range(r.integers(1, 5)):
                text = odd(words(2, 40) if not linked else words(1, 8))
                block(one(("p", "div", "h3", "li")) if not linked else one(("li", "li", "p")), f'<a href="/{word()}">{text}</a>' if linked else text, 0)
            parts.append((f"</{inner}>" if inner else "") + f"</{re.split('[ >]', wrap[1:])[0]}>")

        def with_links(text: str) -> str:
            """Some stretches of a text as links, at least one."""
            some, out = text.split(" "), []
            while some:
                n = int(r.integers(1, 5))
                piece, some = " ".join(some[:n]), some[n:]
                out.append(f'<a href="/{word()}">{piece}</a>' if r.random() < 0.25 or not (some or any("<a" in x for x in out)) else piece)
            return " ".join(out)

        def body() -> None:
            """A piece of an article: a paragraph or heading, a paragraph with links, a list, a table or a line that tells the author or the date."""
            kind = r.random()
            if kind < 0.1:
                block(one(("h2", "h3", "h3", "h4")), words(1, 9), 1)
            elif kind < 0.62:
                text = odd(words(1, 60)) + "."
                block(one(("p", "p", "p", "p", "h2", "blockquote", "li", "pre", "td")), f"<b>{text}<br>" if r.random() < 0.15 else text, 1)
            elif kind < 0.76:
                block(one(("p", "p", "p", "blockquote", "h2")), with_links(words(3, 40) + "."), 1)
            elif kind < 0.88:
                outer = one(("ul", "ol", "dl"))
                parts.append(f"<{outer}>")
                for _ in range(r.integers(2, 8)):
                    text = words(1, 25) + one(("", ".", ";"))
                    block("li" if outer != "dl" else one(("dt", "dd")), with_links(text) if r.random() < 0.2 else text, 1)
                parts.append(f"</{outer}>")
            elif kind < 0.95:
                parts.append("<table>" + one(("", "<tbody>")))
                columns = int(r.integers(1, 4))
                for row in range(int(r.integers(2, 5))):
                    parts.append("<tr>")
                    for _ in range(columns):
                        block("th" if row == 0 and r.random() < 0.8 else "td", one((words(1, 6), str(r.integers(0, 9999)), words(4, 12))), 1)
                    parts.append("</tr>")
                parts.append("</table>")
            else:
                block(one(("p", "p", "div", "address", 'p class="byline"', 'div class="meta"', 'div class="author"', 'p class="date"')), one((f"By {words(1, 4)}", f"By <a href='/{word()}'>{words(1, 3)}</a>", f"{r.integers(1, 29)} {words(1, 2)} {r.integers(1990, 2027)}", f"{words(1, 3)}, {words(1, 3)}")), 1)

        def main(parts: list[str] = parts) -> None:
            wrap = one(("<article>", "<article>", "<main>", "<div>", "<div>", f'<div class="{word()}">', f'<section id="{word()}-{word()}">', '<div class="content">', '<div id="content">', '<div class="post entry">', '<article class="post">', '<section class="article body">', '<div id="main">', '<div class="story text">'))
            parts.append(wrap)
            inner = r.random() < 0.3
            parts.append("<div>" * inner)
            block("h1", odd(words(3, 12)), 1)
            for _ in range(r.integers(1, 12)):
                if r.random() < 0.08:
                    side()
                body()
            if r.random() < 0.35:
                block("p", with_links(words(3, 25) + one((".", ""))), 1)
            parts.append("</div>" * inner + f"</{re.split('[ >]', wrap[1:])[0]}>")

        def foot(parts: list[str] = parts) -> None:
            wrap = one(("footer", "footer", 'div class="footer"', 'div id="footer"', 'div class="copyright legal"'))
            parts.append(f"<{wrap}>")
            for _ in range(r.integers(1, 3)):
                block("p", f"&copy; {words(3, 25)}", 0)
            parts.append(f"</{wrap.split()[0]}>")

        for make, chance in ((menu, 0.9), (side, 0.6), (side, 0.3), (main, 1), (side, 0.4), (foot, 0.9)):
            if r.random() < chance:
                make()
        parts.append("</body></html>")
        pages.append(("".join(parts), labels))
    return pages


@lru_cache(maxsize=2)
def trained(seed: int = 5, pages: int = 1200, epochs: int = 10) -> Labeller:
    net, data = Labeller(seed), []
    for page, labels in labelled_pages(pages, seed):
        found = blocks(page)
        if len(found) == len(labels):
            data.append((features(found), np.array(labels, np.float32)))
    net.fit(data, epochs, seed)
    return net


def main_texts(pages: list[str], net: Labeller) -> list[str]:
    """Main text of each page; pages of similar length are read side by side."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if found[k]), key=lambda k: len(found[k]))
    at = 0
    while at < len(order):
        to = at + 1  # at most about 4096 blocks with their padding, or one page
        while to < len(order) and (to + 1 - at) * len(found[order[to]]) <= 4096:
            to += 1
        rows = order[at:to]
        p = net.probability(*padded([features(found[k]) for k in rows]))
        for j, k in enumerate(rows):
            out[k] = "\n".join(t for i, (t, _, _) in enumerate(found[k]) if p[i, j] >= 0.5)
        at = to
    return out


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    The text holds the blocks labelled as main text, character references decoded, white space within a block as
    one space, one line a block. A null or empty page, or one without main text, has an empty text and
    0 characters. Very long and malformed pages are read in time linear in their length; a tag that never ends is text.
    Repeated rows come back each; extra columns are ignored; an empty table gives no rows.
    """
    net = trained()
    pages = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 128):
                part = batch.slice(a, 128)
                texts = main_texts([h or "" for h in part.column(2).to_pylist()], net)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
