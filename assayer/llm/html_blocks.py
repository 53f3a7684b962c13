"""Main text of web pages by a recurrent block labeller.

A page is split into its leaf blocks: runs of text between block-level tags.  A block
is a vector of its tag path (tags, class, id and role words of all ancestors, hashed),
of its words (hashed) and of a few measures.  A bidirectional LSTM in numpy reads the
blocks of the whole page in order and says for each whether it belongs to the article,
so a block is judged by what stands around it.  No tag or name decides by itself.

The network is trained here, on the driver, on ``TRAINING_PAGES`` pages written by a
small grammar of page layouts (articles, and menus, headers, footers, sidebars,
notices, adverts, forms and comments around and inside them) whose blocks are known.
Their words are invented, so that the network learns layouts rather than a language.

Defined results
  NULL or empty html, no blocks   empty text
  broken markup                   read as it comes: open paragraphs, items and cells are closed by the next one,
                                  a quote that is not closed ends with its tag, stray end tags are ignored, comments and scripts without end reach to the end
  very long pages, blocks         whole; nothing is cut
  repeated rows, ties             each row by itself; a block of probability 0.5 stays
  empty table                     no rows
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.bpe import slices
from assayer.llm.shared import by_value

PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN = 128, 32, 6, 16
TRAINING_PAGES, EPOCHS, RATE, BATCH, SEED = 1200, 10, 0.01, 32, 7
#: Blocks that are scored together.
TOGETHER = 8192

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
    "pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"),
            "tr": ("tr", "td", "th"), "option": ("option",)}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"""|<(?P<raw>script|style|noscript|template|title|textarea|iframe)(?=[\s/>])(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attributes>(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>"""
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*+)(?P<attributes2>[^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)", re.S | re.I)
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
NAME = re.compile(r"[a-z]+")


def _slot(token: str, size: int) -> tuple[int, float]:
    code = zlib.crc32(token.encode("utf-8", "surrogatepass"))
    return code % size, 1.0 if code >> 16 & 1 else -1.0


@lru_cache(maxsize=20_000)
def _own(tag: str, attributes: str) -> tuple[np.ndarray, np.ndarray]:
    """What an element adds to the path of its blocks, and what it says of its own text."""
    words = {tag}
    for found in NAMED.findall(attributes):
        words.update(NAME.findall("".join(found).lower()))
    path, leaf = np.zeros(PATH_SIZE, np.float32), np.zeros(PATH_SIZE, np.float32)
    for word in words:
        for copy in "ab":
            slot, sign = _slot(copy + word, PATH_SIZE)
            path[slot] += sign
        slot, sign = _slot("leaf " + word, PATH_SIZE)
        leaf[slot] += sign
    return path, leaf


class _Slots(dict):
    """Slot of a word, remembered while it is in use."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_SIZE
        return value


def leaf_blocks(page: str | None) -> list[tuple[str, np.ndarray, float]]:
    """Text, path vector and share of link text of every block, in page order."""
    out: list[tuple[str, np.ndarray, float]] = []
    root = np.zeros(PATH_SIZE, np.float32)
    stack: list[tuple[str, np.ndarray, np.ndarray]] = [("", root, root)]
    run: list[str] = []
    linked, total, in_link, where = 0, 0, False, None

    def close() -> None:
        nonlocal linked, total, in_link, where
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append((text, np.clip(where[1], -3, 3) + where[2], linked / max(total, 1)))
        run.clear()
        linked, total, in_link, where = 0, 0, False, None

    for m in TOKEN.finditer(page or ""):
        text = m["text"]
        if text is not None:
            if where is None and not text.isspace():
                where = stack[-1]
            run.append(text)
            total += len(text)
            linked += len(text) if in_link else 0
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, ends = tag.lower(), m["end"] or m["end2"]
        if tag in INLINE:
            if tag == "a":
                in_link = not ends
            elif tag == "br":
                run.append(" ")
            continue
        close()
        if ends:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
            continue
        if tag in CLOSES_PARAGRAPH and stack[-1][0] == "p":
            stack.pop()
        while stack[-1][0] in SIBLINGS.get(tag, ()):
            stack.pop()
        if tag not in VOID:
            path, leaf = _own(tag, m["attributes"] or m["attributes2"] or "")
            stack.append((tag, stack[-1][1] + path, leaf))
    close()
    return out


def features(blocks: list[tuple[str, np.ndarray, float]], slots: dict[str, int]) -> np.ndarray:
    """One row per block."""
    out = np.zeros((len(blocks), PATH_SIZE + WORD_SIZE + MEASURES), np.float32)
    for k, (text, path, links) in enumerate(blocks):
        out[k, :PATH_SIZE] = path
        words = text.lower().split()
        counts = np.bincount([slots[w] for w in words], minlength=WORD_SIZE)
        out[k, PATH_SIZE:-MEASURES] = counts / np.sqrt((counts ** 2).sum())
        stops = sum(map(text.count, ".,;!?"))
        out[k, -MEASURES:] = (np.log1p(len(words)) / 5, np.log1p(len(text)) / 8, links, stops / len(words),
                              k / len(blocks), 1 / (1 + len(blocks)))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """Two LSTMs, one in each direction, under a logistic output that also sees the block itself."""

    def __init__(self, inputs: int = PATH_SIZE + WORD_SIZE + MEASURES, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {"out": np.zeros(2 * hidden + inputs, np.float32), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p[d + "x"] = (rng.normal(size=(inputs, 4 * hidden)) * 0.1).astype(np.float32)
            self.p[d + "h"] = (rng.normal(size=(hidden, 4 * hidden)) * 0.2).astype(np.float32)
            self.p[d + "c"] = np.repeat([0.0, 1.0, 0.0, 0.0], hidden).astype(np.float32)

    def _run(self, x: np.ndarray, live: np.ndarray, d: str, keep: bool):
        """States over time; the gates too if they are needed for learning.  Steps that are not live change nothing."""
        n, steps, h = x.shape[0], x.shape[1], self.hidden
        given = x @ self.p[d + "x"] + self.p[d + "c"]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, saved = np.zeros((n, steps, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[:, t] + state @ self.p[d + "h"]
            gates = _sigmoid(z[:, :3 * h])
            i, f, o, g = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:], np.tanh(z[:, 3 * h:])
            m = live[:, t, None]
            new = f * cell + i * g
            squashed = np.tanh(new)
            if keep:
                saved.append((t, state, cell, i, f, o, g, squashed, m))
            cell = np.where(m, new, cell)
            state = np.where(m, o * squashed, state)
            out[:, t] = state
        return out, saved

    def forward(self, x: np.ndarray, live: np.ndarray, keep: bool = False):
        fw, saved_f = self._run(x, live, "f", keep)
        bw, saved_b = self._run(x, live, "b", keep)
        joined = np.concatenate([fw, bw, x], axis=2)
        return _sigmoid(joined @ self.p["out"] + self.p["bias"]), joined, saved_f, saved_b

    def gradients(self, x: np.ndarray, y: np.ndarray, live: np.ndarray) -> dict[str, np.ndarray]:
        p, joined, saved_f, saved_b = self.forward(x, live, keep=True)
        h, error = self.hidden, (p - y) * live / live.sum()
        g = {"out": np.einsum("nt,ntk->k", error, joined), "bias": np.array([error.sum()], np.float32)}
        for d, saved, part in (("f", saved_f, slice(0, h)), ("b", saved_b, slice(h, 2 * h))):
            top = error[:, :, None] * self.p["out"][part]
            dz_all = np.zeros((*x.shape[:2], 4 * h), np.float32)
            dh, dc = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
            wh = np.zeros_like(self.p[d + "h"])
            for t, state, cell, i, f, o, c, squashed, m in reversed(saved):
                dh = dh + top[:, t]
                live_dh = np.where(m, dh, 0)
                dnew = np.where(m, dc, 0) + live_dh * o * (1 - squashed ** 2)
                dz = np.concatenate([dnew * c * i * (1 - i), dnew * cell * f * (1 - f),
                                     live_dh * squashed * o * (1 - o), dnew * i * (1 - c ** 2)], axis=1)
                dz_all[:, t] = dz
                wh += state.T @ dz
                dh = np.where(m, dz @ self.p[d + "h"].T, dh)
                dc = np.where(m, dnew * f, dc)
            g[d + "h"], g[d + "c"] = wh, dz_all.sum(axis=(0, 1))
            g[d + "x"] = np.einsum("ntk,ntz->kz", x, dz_all, optimize=True)
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, rate: float, seed: int) -> None:
        """Adam over batches of pages of similar length."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        by_length = sorted(range(len(pages)), key=lambda i: len(pages[i][1]))
        batches = [by_length[i:i + BATCH] for i in range(0, len(pages), BATCH)]
        step = 0
        for epoch in range(epochs):
            for b in rng.permutation(len(batches)):
                x, live = padded([pages[i][0] for i in batches[b]])
                y = np.zeros(live.shape, np.float32)
                for k, i in enumerate(batches[b]):
                    y[k, :len(pages[i][1])] = pages[i][1]
                step += 1
                pace = rate * (0.2 if epoch >= epochs - 2 else 1.0)
                for k, g in self.gradients(x, y, live).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g ** 2
                    self.p[k] = (self.p[k] - pace * (first[k] / (1 - 0.9 ** step))
                                 / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((len(pages), steps, pages[0].shape[1]), np.float32)
    live = np.zeros((len(pages), steps), bool)
    for k, p in enumerate(pages):
        x[k, :len(p)], live[k, :len(p)] = p, True
    return x, live


# Fixed values of the page grammar: names that sites commonly give to their parts, and words in them.
PARTS = {
    "menu": ("nav menu navbar navigation topnav breadcrumb breadcrumbs pagination tabs".split(), "home about contact menu next previous".split()),
    "header": ("header masthead banner logo branding topbar site-header".split(), "welcome official site login".split()),
    "footer": ("footer site-footer bottom copyright legal colophon".split(), "© copyright rights reserved privacy terms imprint".split()),
    "side": ("sidebar aside widget rail related recommended trending popular more-stories tags".split(), "related popular latest most read".split()),
    "notice": ("cookie consent notice alert gdpr banner-message paywall popup modal disclaimer".split(), "cookies accept privacy notice settings agree".split()),
    "advert": ("ad ads advert advertisement sponsored promo sponsor banner-ad adsbygoogle".split(), "advertisement sponsored buy now offer".split()),
    "form": ("form search newsletter subscribe signup login contact-form".split(), "email subscribe search submit password send".split()),
    "share": ("share social share-buttons follow".split(), "share tweet follow like".split()),
    "comments": ("comments comment commentlist discussion replies responses disqus".split(), "reply says comment report".split()),
}
ARTICLE_NAMES = "article content post entry story main body text post-content entry-content article-body page single prose".split()
WRAPPERS = "wrapper container row col page site layout inner grid outer section block".split()
SYLLABLES = "an ba che der en fo gra hin ing jo ka lo mer ne or pre que ren sta ti un ver wo xi ya zu é ü ñ ой 的".split()


class _Author:
    """Writes pages and knows which blocks are the article's."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.html: list[str] = []
        self.labels: list[int] = []

    def words(self, low: int, high: int, extra=()) -> str:
        rng = self.rng
        n = int(round(low * (high / low) ** rng.random()))
        out = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]
        for _ in range(rng.randint(0, 2) if extra else 0):
            out.insert(rng.randrange(len(out) + 1), rng.choice(extra))
        text, ends = " ".join(out), rng.random()
        if ends < 0.7 and n > 3:
            text = text.capitalize() + rng.choice(".?!.")
            cut = rng.randrange(len(text))
            text = text[:cut].rstrip() + rng.choice([",", ".", "&amp;", ""]) + text[cut:]
        return text

    def block(self, open_: str, text: str, close: str, label: int) -> None:
        self.html.append(f"{open_}{text}{close}")
        self.labels.append(label)

    def named(self, names, tags) -> tuple[str, str]:
        tag, name = self.rng.choice(tags), self.rng.choice(names)
        kind = self.rng.choice(["class", "class", "id", "role" if tag != "div" else "class"])
        return f'<{tag} {kind}="{name}">', f"</{tag}>"

    def links(self, extra) -> None:
        bare = self.rng.random() < 0.3
        self.html.append("<div>" if bare else "<ul>")
        for _ in range(self.rng.randint(2, 7)):
            link = f'<a href="#">{self.words(1, 4, extra if self.rng.random() < 0.3 else ())}</a>'
            self.block("<p>" if bare else "<li>", link, "</p>" if bare else "</li>", 0)
        self.html.append("</div>" if bare else "</ul>")

    def part(self, kind: str) -> None:
        """Something that is not the article."""
        rng, (names, extra) = self.rng, PARTS[kind]
        tags = {"menu": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "footer", "div"],
                "side": ["aside", "aside", "div", "section"], "form": ["form", "form", "div"]}.get(kind, ["div", "div", "section", "aside"])
        tag = rng.choice(tags)
        semantic = tag in ("nav", "header", "footer", "aside", "form") and kind not in ("notice", "advert", "share", "comments")
        open_, close = (f"<{tag}>", f"</{tag}>") if semantic and rng.random() < 0.6 else self.named(names, [tag])
        self.html.append(open_)
        if kind == "comments":
            if rng.random() < 0.6:
                self.block("<h3>", self.words(1, 3, extra), "</h3>", 0)
            for _ in range(rng.randint(1, 6)):
                self.html.append(rng.choice(["<div class=comment>", "<li>", "<div>", "<article class='comment'>"]))
                inner = self.html[-1][1:].split()[0].strip(">")
                if rng.random() < 0.5:
                    self.block("<span>", self.words(1, 3, extra), "</span><hr>", 0)
                self.block("<p>", self.words(3, 80, extra), "</p>", 0)
                self.html.append(f"</{inner}>")
        elif kind == "form":
            for _ in range(rng.randint(1, 4)):
                self.block(*rng.choice([("<label>", "x", "</label><hr>"), ("<button>", "x", "</button>"), ("<p>", "x", "</p>"),
                                        ("<select><option>", "x", "</select>")])[:1], self.words(1, 8, extra),
                           rng.choice(["</p><hr>", "<hr>"]), 0)
            self.html.append("</label></button></select>")
        elif kind == "menu" or rng.random() < 0.35:
            if rng.random() < 0.3:
                self.block("<h4>", self.words(1, 4, extra), "</h4>", 0)
            self.links(extra)
        elif rng.random() < 0.5:
            self.block("", self.words(2, 40, extra), "", 0)
        else:
            for _ in range(rng.randint(1, 4)):
                self.block(*rng.choice([("<p>", 1), ("<h4>", 1), ("<div>", 1), ("<span>", 1)])[:1], self.words(2, 50, extra), "<hr>", 0)
            self.html.append("</div></h4>")
        self.html.append(close)

    def story(self) -> None:
        rng = self.rng
        n = int(round(2 * 15 ** rng.random()))
        inside = rng.choice([(), (), ("advert",), ("share", "side"), ("form",), ("notice", "advert")])
        if rng.random() < 0.9:
            wrap = rng.random() < 0.2
            self.block("<header><h1>" if wrap else "<h1>", self.words(2, 14), "</h1></header>" if wrap else "</h1>", 1)
        for k in range(n):
            kind, bold = rng.random(), rng.random() < 0.15
            text = self.words(1, 160) if rng.random() < 0.8 else self.words(1, 4)
            if rng.random() < 0.2:
                text += f" <a href='/x'>{self.words(1, 5)}</a> " + self.words(1, 20)
            if bold:
                text = rng.choice([f"<b>{text}<br>", f"<b>{text}</b>", f"<em>{text}</em><br>{self.words(1, 9)}"])
            if kind < 0.7:
                self.block("<p>", text, rng.choice(["</p>", "</p>", "</p>", ""]), 1)
            elif kind < 0.8:
                self.block("<h2>" if rng.random() < 0.7 else "<h3>", self.words(1, 9), rng.choice(["</h2>", "</h3></h2>"]), 1)
                self.html.append("</h3></h2>")
            elif kind < 0.88:
                self.html.append("<ul>" if rng.random() < 0.6 else "<ol>")
                for _ in range(rng.randint(1, 5)):
                    self.block("<li>", self.words(1, 25), rng.choice(["</li>", ""]), 1)
                self.html.append("</li></ul></ol>")
            elif kind < 0.94:
                tag = rng.choice(["blockquote", "pre", "figcaption", "div", "section"])
                self.block(f"<{tag}>", self.words(2, 60), f"</{tag}>", 1)
            else:
                self.html.append("<table>")
                for _ in range(rng.randint(1, 4)):
                    self.block("<tr><td>", self.words(1, 6), "</td>", 1)
                    self.block("<td>", self.words(1, 6), "</td></tr>", 1)
                self.html.append("</table>")
            if inside and rng.random() < 0.25:
                self.html.append("</p>")
                self.part(rng.choice(inside))
        self.html.append("</p>")

    def page(self) -> str:
        rng = self.rng
        self.html.append("<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>")
        wrappers = [self.named(WRAPPERS, ["div"]) for _ in range(rng.randint(0, 3))]
        self.html += [w[0] for w in wrappers]
        for kind in ("header", "menu", "notice", "advert", "form", "side", "menu"):
            if rng.random() < (0.6 if kind in ("menu", "advert") else 0.35):
                self.part(kind)
        style = rng.random()
        if style < 0.4:
            open_, close = "<article>", "</article>"
        elif style < 0.5:
            open_, close = "<main>", "</main>"
        elif style < 0.88:
            open_, close = self.named(ARTICLE_NAMES, ["div", "div", "section", "article", "main"])
        else:
            open_, close = "", ""
        if rng.random() < 0.96:
            self.html.append(open_)
            self.story()
            self.html.append(close)
        for kind in ("share", "advert", "comments", "side", "form", "notice", "menu"):
            if rng.random() < 0.35:
                self.part(kind)
        self.html += [w[1] for w in reversed(wrappers)]
        if rng.random() < 0.8:
            self.part("footer")
        self.html.append("</body></html>")
        return "".join(self.html)


def written_pages(count: int, seed: int) -> list[tuple[str, list[int]]]:
    """Pages of the grammar with the labels of their blocks."""
    out = []
    for k in range(count):
        author = _Author(random.Random(seed * 1_000_003 + k))
        out.append((author.page(), author.labels))
    return out


@lru_cache(maxsize=4)
def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    slots = _Slots()
    rows = []
    for page, labels in written_pages(pages, seed):
        blocks = leaf_blocks(page)
        if len(blocks) != len(labels):
            raise ValueError("the grammar and the splitter disagree")
        if blocks:
            rows.append((features(blocks, slots), np.array(labels, np.float32)))
    model = Labeller(seed=seed)
    model.fit(rows, epochs, RATE, seed)
    return model


def _extracted(model: Labeller):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in batches:
            for part in slices(batch, "html"):
                pages = [leaf_blocks(p) for p in part.column("html").to_pylist()]
                texts = [""] * len(pages)
                order = sorted((k for k, b in enumerate(pages) if b), key=lambda k: len(pages[k]))
                while order:
                    size = max(1, min(64, TOGETHER // len(pages[order[-1]])))
                    group, order = order[-size:], order[:-size]
                    x, live = padded([features(pages[k], slots) for k in group])
                    belongs = model.forward(x, live)[0] >= 0.5
                    for row, k in enumerate(group):
                        texts[k] = "\n\n".join(b[0] for b, keep in zip(pages[k], belongs[row]) if keep)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
    return work


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(_extracted(model or trained()), "page_id long, url string, text string, n_chars long")


by_value(__name__)
