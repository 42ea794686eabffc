"""Main text of web pages by a recurrent block labeller.

A page is read into leaf blocks: stretches of text between block-level tags. Each block has a vector
of its tag path (hashed tags, classes and ids of the open elements), of its words (hashed) and of its
form (length, links, punctuation, place). A bidirectional LSTM in numpy reads a page's blocks in
order and labels each as main text or not, with the whole page as context.

The labeller is trained here, on pages from a generator whose parts are known: menus, headers,
notices, adverts, forms, sidebars, comments and footers around and inside articles, under usual and
under meaningless names. `TRAIN_PAGES` bounds it; the seed is fixed, so all machines get one model.
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

from .words import slices, texts_of

PATH, WORDS, FORM = 256, 64, 10
SIZE = PATH + WORDS + FORM
HIDDEN = 16
TRAIN_PAGES, EPOCHS, BATCH, RATE, SEED = 900, 8, 16, 0.02, 5
GROUP = 8192  # blocks whose vectors are held at a time

# Names of elements.
SKIPPED = frozenset("script style title noscript template svg iframe object math canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul video audio".split())
CLOSES_P = BLOCKS - {"br", "button", "label", "select", "option", "optgroup", "textarea", "body", "html", "head", "video", "audio"}

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|title|noscript|template|svg|iframe|object|math|canvas|textarea)\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S | re.I)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[a-z]+")

Block = tuple[int, tuple[str, ...], str, int]


@lru_cache(100_000)
def path_place(name: str) -> int:
    return zlib.crc32(name.encode()) % PATH


class Open:
    """The elements that are open, the innermost last; every step takes constant time, whatever the depth.

    `places` has a bit for each hashed name of an open element.
    """

    def __init__(self):
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.by_tag: dict[str, list[int]] = {}  # where the open elements of each name stand
        self.blocks: list[int] = []
        self.held, self.places = [0] * PATH, 0

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.by_tag.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, names))
        for name in names:
            k = path_place(name)
            self.held[k] += 1
            self.places |= 1 << k

    def cut(self, at: int) -> None:
        """Closes the elements from a place on."""
        while len(self.stack) > at:
            tag, names = self.stack.pop()
            self.by_tag[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            for name in names:
                k = path_place(name)
                self.held[k] -= 1
                if not self.held[k]:
                    self.places ^= 1 << k

    def end(self, tag: str) -> None:
        """An end tag: the innermost element of the name closes, but an inline one not through a block."""
        at = self.by_tag.get(tag)
        if at and (tag in BLOCKS or not self.blocks or self.blocks[-1] < at[-1]):
            self.cut(at[-1])

    def begins(self, tag: str) -> None:
        """A block that begins closes what it ends by itself."""
        closing = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
        for k in range(len(self.stack) - 1, max(-1, len(self.stack) - 8), -1):
            if self.stack[k][0] == "p" or self.stack[k][0] in closing:
                self.cut(k)
                break
            if self.stack[k][0] in CLOSES_P:
                break

    def innermost(self) -> tuple[str, ...]:
        """The last two names of the path."""
        if not self.stack:
            return ()
        names = self.stack[-1][1]
        return names[-2:] if len(names) > 1 or len(self.stack) == 1 else (self.stack[-2][1][-1], *names)


def read_blocks(page: str) -> list[Block]:
    """The path (a bit for each hashed name, and the innermost names), text and number of characters inside links of each block, in page order.

    Takes time and memory in proportion to the page, however deeply it is nested.
    """
    out: list[Block] = []
    path = Open()
    parts: list[str] = []
    links = inside = 0

    def close() -> None:
        nonlocal links
        if parts:
            text = "".join(parts)
            parts.clear()
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                out.append((path.places, path.innermost(), text, links))
        links = 0

    end = page.rfind(">") + 1  # behind it no tag can be complete; looking for its end from every < would take the square of the page
    unclosed = False
    for m in TOKEN.finditer(page, 0, end):
        tag = m.group(3)
        if tag is None:
            whole = m.group()
            if m.group(1) is None:
                if whole[0] != "<" or len(whole) == 1:
                    parts.append(whole)
                    if inside:
                        links += len(whole)
                else:
                    unclosed = whole.startswith("<!--") and not whole.endswith("-->")
            else:
                unclosed = "</" not in whole[-len(m.group(1)) - 64 :]
            continue
        tag = tag.lower()
        if m.group(2):
            if tag in BLOCKS:
                close()
            if tag == "a":
                inside = max(0, inside - 1)
            path.end(tag)
            continue
        if tag in BLOCKS:
            close()
            if tag in CLOSES_P:
                path.begins(tag)
        if tag in VOID or m.group(4).endswith("/"):
            continue
        names = [f"<{tag}>"]
        for _, a, b, c in NAMES.findall(m.group(4)):
            names += PARTS.findall((a or b or c).lower())
        if tag == "a":
            inside += 1
        path.push(tag, tuple(names))
    rest = page[end:]
    if rest and not unclosed:
        cut = rest.find("<!--")
        rest = rest if cut < 0 else rest[:cut]
        parts.append(rest)
        links += len(rest) if inside else 0
    close()
    return out


@lru_cache(20_000)
def path_vector(places: int, innermost: tuple[str, ...]) -> np.ndarray:
    v = np.unpackbits(np.frombuffer(places.to_bytes(PATH // 8, "little"), np.uint8), bitorder="little").astype(np.float32)
    for name in innermost:  # the innermost names once more, as such
        v[zlib.crc32(b"in " + name.encode()) % PATH] = 1.0
    return v


@lru_cache(200_000)
def word_place(word: str) -> int:
    return zlib.crc32(word.lower().strip(".,:;!?").encode()) % WORDS


def vectors(blocks: list[Block], first: int = 0, total: int = 0) -> np.ndarray:
    """A row for each block; first and total: where they stand in a page of which they are a part."""
    out = np.zeros((len(blocks), SIZE), np.float32)
    total = total or len(blocks)
    for i, (places, innermost, text, links) in enumerate(blocks):
        out[i, :PATH] = path_vector(places, innermost)
        words = text.split()
        n = len(words)
        out[i, PATH : PATH + WORDS] = np.bincount([word_place(w) for w in words], minlength=WORDS) / n
        out[i, PATH + WORDS :] = (
            np.log1p(n) / 4, min(1.0, links / len(text)), text[-1] in ".!?\"", n <= 3, n <= 10, n >= 40,
            len(text) / n / 10, (first + i) / total, text.count(",") / n, "|" in text or "©" in text,
        )
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output; `weights` is the whole model."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        r = np.random.RandomState(SEED)
        g = 4 * HIDDEN
        self.w = weights or {
            **{f"{k}{d}": (r.randn(*shape) * scale).astype(np.float32) for d in "fb" for k, shape, scale in (("x", (SIZE, g), 0.08), ("h", (HIDDEN, g), 0.15), ("c", (g,), 0.0))},
            "o": (r.randn(2 * HIDDEN) * 0.2).astype(np.float32), "p": np.zeros(1, np.float32),
        }

    def _direction(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None, state: list | None = None) -> np.ndarray:
        """The hidden states; `state` carries the last one from a part of a page to the next."""
        steps, n, _ = x.shape
        inputs = x @ self.w["x" + d] + self.w["c" + d]
        h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        out = np.zeros((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inputs[t] + h @ self.w["h" + d]
            gates = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, u = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * u
            tc = np.tanh(new)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, c, i, f, o, u, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, new, c)
            out[t] = h
        if state is not None:
            state[:] = h, c
        return out

    def long_scores(self, blocks: list[Block], part: int) -> np.ndarray:
        """The scores of one page, with vectors for `part` blocks at a time: each direction walks the parts in its order."""
        n, hidden = len(blocks), {d: np.zeros((len(blocks), HIDDEN), np.float32) for d in "fb"}
        starts = range(0, n, part)
        for d, order in (("f", starts), ("b", reversed(starts))):
            state: list = []
            for a in order:
                x = vectors(blocks[a : a + part], a, n)[:, None]
                hidden[d][a : a + part] = self._direction(x, np.ones(x.shape[:2], bool), d, None, state)[:, 0]
        return sigmoid(np.concatenate((hidden["f"], hidden["b"]), axis=1) @ self.w["o"] + self.w["p"])

    def scores(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Chances of being main text; x: steps, pages, SIZE."""
        hf = self._direction(x, mask, "f", None if keep is None else keep.setdefault("f", []))
        hb = self._direction(x, mask, "b", None if keep is None else keep.setdefault("b", []))
        both = np.concatenate((hf, hb), axis=2)
        if keep is not None:
            keep["both"] = both
        return sigmoid(both @ self.w["o"] + self.w["p"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        d_out = (self.scores(x, mask, keep) - y) * mask / max(1, mask.sum())
        grads = {"o": np.tensordot(d_out, keep["both"], ((0, 1), (0, 1))), "p": d_out.sum(keepdims=True).reshape(1)}
        d_both = d_out[:, :, None] * self.w["o"]
        for d, part in (("f", d_both[:, :, :HIDDEN]), ("b", d_both[:, :, HIDDEN:])):
            dh, dc = np.zeros_like(part[0]), np.zeros_like(part[0])
            dz_all, gh = np.zeros((*part.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(self.w["h" + d])
            for t, h, c, i, f, o, u, tc, m in reversed(keep[d]):
                dh = dh + part[t]
                own_h = dh * m
                own_c = dc * m + own_h * o * (1 - tc * tc)
                dz = np.concatenate((own_c * u * i * (1 - i), own_c * c * f * (1 - f), own_h * tc * o * (1 - o), own_c * i * (1 - u * u)), axis=1)
                dz_all[t] = dz
                gh += h.T @ dz
                dh = np.where(m, dz @ self.w["h" + d].T, dh)
                dc = np.where(m, own_c * f, dc)
            grads["x" + d] = np.tensordot(x, dz_all, ((0, 1), (0, 1)))
            grads["h" + d], grads["c" + d] = gh, dz_all.sum(axis=(0, 1))
        return grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), SIZE), np.float32), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


class Pages:
    """Pages with known main text."""

    MENU = "home about contact products services news blog login register search archive help shop careers privacy terms sitemap faq support events team press jobs subscribe".split()
    CONSENT = "we use cookies to improve your experience accept all cookies decline settings this site uses cookies read our privacy policy sign up for our newsletter please disable your ad blocker notice maintenance".split()
    ADVERT = "buy now sponsored advertisement limited offer sale save click here best price free shipping shop deal discount order today".split()
    REPLY = "reply posted by comments anonymous says great post thanks i agree wrote on like report share leave a comment".split()
    FOOT = "copyright all rights reserved © terms of use privacy policy contact imprint powered by 2023 2024 company inc".split()
    FORM = "name email message send submit subscribe your e-mail password search username select country enter remember me".split()
    SIDE = "related posts popular articles recent tags categories archives most read trending recommended you may also like follow us".split()

    def __init__(self, seed: int):
        self.r = np.random.RandomState(seed)
        self.syllables = ["".join(self.pick(list("bcdfghklmnprstvwzäöéè"))[0] + self.pick(list("aeiou"))[0] for _ in range(self.r.randint(1, 3))) for _ in range(300)]

    def pick(self, items: list, n: int = 1) -> list:
        return [items[self.r.randint(len(items))] for _ in range(n)]

    def chance(self, p: float) -> bool:
        return self.r.rand() < p

    def word(self) -> str:
        return "".join(self.pick(self.syllables, self.r.randint(1, 4)))

    def prose(self, low: int, high: int) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        for k in range(0, len(words), self.r.randint(5, 15)):
            words[k] = words[k].capitalize()
            if k:
                words[k - 1] += self.pick([".", ".", ",", "?", "!"])[0]
        odd = self.r.rand()
        if odd < 0.06:
            words = [words[0]] * len(words)
        elif odd < 0.1:
            return " | ".join(words) + self.pick(["", " |"])[0]
        elif odd < 0.14:
            return " ".join(words).lower()
        if self.chance(0.06):
            words = [w + self.pick(["%%%", "***", "###", "$$$", "|"])[0] for w in words]
        return " ".join(words) + ("." if self.chance(0.9) else "")

    def element(self, tag: str, names: list[str], inner: str) -> str:
        if names and self.chance(0.85):
            name = self.pick(names)[0] if not self.plain else self.word()
            if self.chance(0.15):
                name += self.pick([" clearfix", "-wrapper", "-box", " col-4", "-1"])[0]
            return f'<{tag} {self.pick(["class", "class", "class", "id"])[0]}="{name}">{inner}</{tag}>'
        return f"<{tag}>{inner}</{tag}>"

    def links(self, words: list[str], n: int) -> str:
        own = self.pick(words, n) if self.chance(0.5) else [self.word() for _ in range(n)]
        items = "".join(f'<li><a href="/{w}">{w}</a></li>' if self.mode else f'<a href="/{w}">{w}</a> ' for w in own)
        return f"<ul>{items}</ul>" if self.mode else items

    def boiler(self, words: list[str], low: int = 3, high: int = 14) -> str:
        own = self.pick(words, self.r.randint(low, high))
        if self.chance(0.5):
            own = self.prose(low, high).split()
        return " ".join(own)

    def menu(self) -> str:
        return self.element(*self.pick([("nav", ["menu", "navbar", "main-nav"]), ("div", ["menu", "nav", "navigation", "breadcrumb", "topbar"])])[0], self.links(self.MENU, self.r.randint(2, 9)))

    def advert(self) -> str:
        return self.element(*self.pick([("div", ["ad", "ads", "advert", "banner", "promo", "sponsor", "sponsored"]), ("aside", ["ad", "promo", "advertisement"]), ("section", ["ad", "promo"])])[0], self.pick([self.boiler(self.ADVERT), f"<p>{self.boiler(self.ADVERT, 5, 40)}</p>", f'<a href="/x">{self.boiler(self.ADVERT)}</a>'])[0])

    def notice(self) -> str:
        return self.element("div", ["cookie", "notice", "consent", "alert", "gdpr", "banner", "popup", "modal", "newsletter"], f"<p>{self.boiler(self.CONSENT, 5, 30)}</p>" + ("<button>OK</button>" if self.chance(0.5) else ""))

    def form(self) -> str:
        return self.element("form", ["search", "login", "subscribe", "contact"], "".join(f"<label>{self.boiler(self.FORM, 1, 4)}</label><input type=text>" for _ in range(self.r.randint(1, 4))) + f"<button>{self.boiler(self.FORM, 1, 2)}</button>" + ("<select><option>aa</option><option>bb</option></select>" if self.chance(0.2) else ""))

    def side(self) -> str:
        inner = "".join(self.element("div", ["widget", "box"], f"<h3>{self.boiler(self.SIDE, 1, 4)}</h3>" + (self.links(self.SIDE, self.r.randint(2, 7)) if self.chance(0.7) else f"<p>{self.prose(8, 40)}</p>")) for _ in range(self.r.randint(1, 4)))
        return self.element(*self.pick([("aside", ["sidebar", "related"]), ("div", ["sidebar", "side", "related", "widgets", "recommended", "rail"])])[0], inner)

    def comments(self) -> str:
        one = lambda: self.element(*self.pick([("div", ["comment", "reply"]), ("li", ["comment"]), ("article", ["comment"])])[0], (f"<span>{self.word()}</span> " if self.chance(0.5) else "") + f"<p>{self.prose(4, 60) if self.chance(0.8) else self.boiler(self.REPLY)}</p>")
        return self.element(*self.pick([("section", ["comments", "responses", "discussion"]), ("div", ["comments", "comment-list", "replies", "disqus"]), ("ol", ["comments", "commentlist"])])[0], (f"<h3>{self.boiler(self.REPLY, 1, 4)}</h3>" if self.chance(0.6) else "") + "".join(one() for _ in range(self.r.randint(1, 6))))

    def article(self) -> str:
        """Main text; what belongs to it is inside \x01 and \x02."""
        parts, own = [], lambda x: f"\x01{x}\x02"
        title = own(self.prose(2, 10))
        parts.append(f"<h1>{title}</h1>" if self.chance(0.7) else f"<header><h1>{title}</h1></header>" if self.chance(0.5) else "")
        many, short = self.chance(0.12), self.pick([0.15, 0.15, 0.9])[0]
        again = self.prose(1, 6) if self.chance(0.15) else None  # a page may repeat one line
        for _ in range(self.r.randint(12, 50) if many else self.r.randint(1, 12)):
            kind = self.r.rand()
            text = own(again if again and self.chance(0.9) else self.prose(1, 8) if self.chance(short) else self.prose(8, 90))
            if kind < 0.62:
                parts.append(f"<p>{text}</p>" if self.chance(0.85) else f"<p>{text}")
            elif kind < 0.72:
                parts.append(f"<p><b>{text}<br>")
            elif kind < 0.78:
                parts.append(f"<h2>{own(self.prose(1, 8))}</h2>")
            elif kind < 0.84:
                parts.append("<ul>" + "".join(f"<li>{own(self.prose(2, 20))}</li>" for _ in range(self.r.randint(1, 5))) + "</ul>")
            elif kind < 0.88:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.91:
                parts.append("<table>" + "".join(f"<tr><td>{own(self.prose(1, 4))}</td><td>{own(self.prose(1, 4))}</td></tr>" for _ in range(2)) + "</table>")
            elif kind < 0.94:
                parts.append(f"<div>{text}</div>")
            elif kind < 0.97:
                parts.append(self.advert())
            else:
                parts.append(self.pick([self.form(), self.notice(), self.element("div", ["share", "social", "tags", "related"], self.links(self.SIDE, 3))])[0])
        return "".join(parts)

    def page(self) -> tuple[str, list[bool], list]:
        self.plain, self.mode = self.chance(0.15), self.chance(0.7)
        kind = self.r.randint(6)
        inner = self.article()
        main = {
            0: lambda: f"<article>{inner}</article>", 1: lambda: f"<main>{inner}</main>", 2: lambda: f"<main><article>{inner}</article></main>",
            3: lambda: self.element("div", ["content", "post", "entry", "article", "story", "main", "body", "text"], inner),
            4: lambda: self.element("section", ["content", "post", "article"], inner), 5: lambda: f"<article>{inner}</article>",
        }[kind]()
        before = [f() for f, p in ((lambda: self.element(*self.pick([("header", ["header", "site-header"]), ("div", ["header", "top", "masthead", "logo"])])[0], f"<a href=/>{self.word()}</a>" + (self.menu() if self.chance(0.5) else f"<p>{self.prose(2, 12)}</p>")), 0.5), (self.menu, 0.7), (self.notice, 0.3), (self.advert, 0.5), (self.form, 0.15), (self.side, 0.15)) if self.chance(p)]
        after = [f() for f, p in ((self.advert, 0.2), (self.comments, 0.35), (self.side, 0.35), (self.form, 0.2), (self.notice, 0.2), (lambda: self.element(*self.pick([("footer", ["footer"]), ("div", ["footer", "copyright", "bottom"])])[0], self.boiler(self.FOOT, 3, 15) + (self.links(self.MENU, 3) if self.chance(0.4) else "")), 0.85)) if self.chance(p)]
        text = "<html><body>" + "".join(before) + main + "".join(after) + "</body></html>"
        if self.chance(0.2):
            text = text.replace("<body>", "<body><div class=wrap>").replace("</body>", "</div></body>")
        blocks = read_blocks(text)
        labels = ["\x01" in t or "\x02" in t for _, _, t, _ in blocks]
        blocks = [(p, q, t.replace("\x01", "").replace("\x02", "").strip(), n) for p, q, t, n in blocks]
        full = [i for i, b in enumerate(blocks) if b[2]]
        return text, [labels[i] for i in full], [blocks[i] for i in full]


def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """A labeller fitted to `pages` generated pages, with Adam."""
    source, data = Pages(seed), []
    while len(data) < pages:
        _, labels, blocks = source.page()
        if blocks:
            data.append((vectors(blocks), np.array(labels, np.float32)))
    model, order = Labeller(), np.random.RandomState(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in model.w.items()}, {k: np.zeros_like(v) for k, v in model.w.items()}, 0
    data.sort(key=lambda d: len(d[0]))
    groups = [data[i : i + BATCH] for i in range(0, len(data), BATCH)]
    for epoch in range(epochs):
        for k in order.permutation(len(groups)):
            x, mask = padded([d[0] for d in groups[k]])
            y = np.zeros(mask.shape, np.float32)
            for j, (_, labels) in enumerate(groups[k]):
                y[: len(labels), j] = labels
            step += 1
            rate = RATE * (1 - epoch / (epochs + 1))
            for name, g in model.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1).astype(np.float32)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                model.w[name] = model.w[name] - (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def main_texts(pages: list[str], model: Labeller) -> list[str]:
    """The main text of each page."""
    out = [""] * len(pages)
    read = [(i, read_blocks(p)) for i, p in enumerate(pages)]
    read = sorted((x for x in read if x[1]), key=lambda x: len(x[1]))
    start = 0
    while start < len(read):
        end = start + 1
        while end < len(read) and end - start < 128 and (end - start + 1) * len(read[end][1]) <= GROUP:
            end += 1
        group = read[start:end]
        if len(group[0][1]) > GROUP:
            main = model.long_scores(group[0][1], GROUP)[:, None] >= 0.5
        else:
            x, mask = padded([vectors(b) for _, b in group])
            main = model.scores(x, mask) >= 0.5
        for k, (i, blocks) in enumerate(group):
            out[i] = " ".join(t for j, (_, _, t, _) in enumerate(blocks) if main[j, k])
        start = end
    return out


def extract_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", model: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row.

    Character references are decoded, white space inside a block becomes one space, blocks are joined
    by one space in page order. A null or empty page, or one without main text, gives an empty text.
    A block whose score is exactly a half is main text. Pages of any length and depth are read whole, a long one's blocks in
    parts that carry the hidden state on. Null ids and urls stay null; repeated rows are read one by one; an empty table
    gives no rows; other columns are ignored. A map over the rows: no shuffle.
    """
    weights = (model or train()).w
    spread = pages.sparkSession.sparkContext.broadcast(weights)  # SIZE * 8 * HIDDEN numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(spread.value)
        for batch in slices(batches, "html", 2 << 20):
            texts = main_texts(texts_of(batch, "html").to_pylist(), labeller)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    plain = pages.select(pages[id_column].cast("long").alias("page_id"), pages[url_column].cast("string").alias("url"), pages[html_column].cast("string").alias("html"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")
