"""HTML main-text extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block has the names, classes and ids on its tag path and its words, both hashed,
and a few ratios; a bidirectional LSTM in numpy reads the whole sequence and labels every block. It is trained
here, on pages that `generated` makes up, with many ways of marking up articles and what surrounds them.

Defined results: a null or empty page gives the empty text, as does a page without a block of the article; scripts,
styles, comments and titles in the head never are blocks; unclosed elements end with what surrounds them; `<br>` is white space; a page cut off
inside a tag ends before it; pages of any length are labelled whole; repeated rows give equal texts; an input column named as the output is
replaced; empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, put, table, texts

PATHS, WORDS, RATIOS = 1024, 256, 6
EMBEDDED, HIDDEN = 24, 16
#: Generated pages that the labeller is fitted on.
TRAIN_PAGES, EPOCHS = 1600, 6
#: Innermost elements of a tag path, and parts of an element's names, that the labeller looks at.
DEPTH, NAMES = 48, 32
#: Pages read together, by length.
TOGETHER = 64

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)""", re.DOTALL)
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
RAW = frozenset("script style template noscript iframe textarea title svg object".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose start ends an open one of the same kind.
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that such an implied end does not reach out of.
SCOPE = frozenset("html body article section main div nav aside header footer form ul ol dl table tbody blockquote td th".split())


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, and the parts of its classes, id and role."""
    out = [tag]
    for m in _NAMED.finditer(attributes) if attributes else ():
        for word in (m[1] or m[2] or m[3] or "").split():
            out += [f".{p.lower()}" for p in _PARTS.findall(word)]
            if len(out) > NAMES:
                return tuple(out[: NAMES + 1])
    return tuple(out)


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(tag path, text, share of its characters in links) of each leaf block with text."""
    out: list = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked = 0
    path: tuple[str, ...] = ()
    at = 0
    opened: Counter[str] = Counter()  # how many of each tag are on the stack

    def end_block() -> None:
        nonlocal linked
        if pieces:
            raw = "".join(pieces)
            text = " ".join(raw.split())
            if text:
                out.append((path, text, min(1.0, linked / len(raw))))
            pieces.clear()
            linked = 0

    def add(chunk: str) -> None:
        nonlocal linked, path
        if not chunk:
            return
        if "&" in chunk:
            chunk = unescape(chunk)
        if not pieces:
            if chunk.isspace():
                return
            path = tuple(x for _, names in stack[-DEPTH:] for x in names)
        pieces.append(chunk)
        if opened["a"]:
            linked += len(chunk)

    def end_from(k: int) -> None:
        for t, _ in stack[k:]:
            opened[t] -= 1
        del stack[k:]

    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            end_block()
        elif tag == "br" and pieces:
            pieces.append(" ")
        if m[1]:
            k = len(stack) - 1
            while opened[tag] and stack[k][0] != tag:
                k -= 1
            if opened[tag]:
                end_from(k)
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = close.end() if close else len(page)
            continue
        ends = SIBLING.get(tag, ()) if tag in SIBLING else () if tag in INLINE else ("p",)
        if any(opened[t] for t in ends):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    end_from(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        if tag not in VOID and not m[3].endswith("/"):
            stack.append((tag, _names(tag, m[3])))
            opened[tag] += 1
    add(page[at:])
    end_block()
    return out


class Features:
    """Hashed path parts and words of blocks, as flat indices with offsets, and ratios."""

    def __init__(self):
        self.path = Memo(lambda p: zlib.crc32(p.encode()) % PATHS, 20_000)
        self.word = Memo(lambda w: PATHS + zlib.crc32(w.lower().encode()) % WORDS, 100_000)

    def of(self, page: list) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        paths, words, ratios = [], [], np.empty((len(page), RATIOS), np.float32)
        for i, (path, text, linked) in enumerate(page):
            own = text.split()
            n = len(text)
            # each part, and each with what it stands in
            parts = [*path, *(f"{a}>{b}" for a, b in zip(path, path[1:], strict=False))]
            paths.append(np.fromiter(map(self.path.__getitem__, parts), np.int32, len(parts)) if parts else np.zeros(1, np.int32))
            words.append(np.fromiter(map(self.word.__getitem__, own), np.int32, len(own)))
            ratios[i] = (linked, min(1.0, np.log1p(len(own)) / 6), text.count(".") / n, sum(text.count(c) for c in "|©·»") / n, i / len(page), 1.0)
        return paths, words, ratios


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """Embedding bags of paths and words, one LSTM in each direction, and a logistic output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        inputs = 2 * EMBEDDED + RATIOS
        self.p = {"embed": rng.normal(0, 0.3, (PATHS + WORDS, EMBEDDED)), "out": rng.normal(0, 0.3, 2 * HIDDEN), "out_b": np.zeros(1)}
        for d in "fb":
            self.p[f"w{d}"] = rng.normal(0, 0.2, (inputs + HIDDEN, 4 * HIDDEN))
            bias = np.zeros(4 * HIDDEN)
            bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            self.p[f"b{d}"] = bias
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, pages: list) -> tuple[np.ndarray, np.ndarray]:
        """(steps, pages, inputs) and the mask of steps that pages have."""
        steps = max(len(p[0]) for p in pages)
        x = np.zeros((steps, len(pages), 2 * EMBEDDED + RATIOS), np.float32)
        mask = np.zeros((steps, len(pages), 1), np.float32)
        for j, (paths, words, ratios) in enumerate(pages):
            n = len(paths)
            for k, bags in enumerate((paths, words)):
                flat, size = np.concatenate(bags), np.array([len(b) for b in bags])
                x[:n, j, k * EMBEDDED : (k + 1) * EMBEDDED] = np.add.reduceat(self.p["embed"][flat], np.cumsum(size) - size, axis=0) / size[:, None]
            x[:n, j, 2 * EMBEDDED :] = ratios
            mask[:n, j] = 1
        return x, mask

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        w, b = self.p[f"w{d}"], self.p[f"b{d}"]
        steps, n, _ = x.shape
        given = x @ w[: x.shape[2]] + b
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ w[x.shape[2] :]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            new_c = (f * c + i * g) * mask[t]
            tc = np.tanh(new_c)
            new_h = o * tc * mask[t]
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc))
            h, c = new_h, new_c
            out[t] = h
        return out

    def scores(self, pages: list) -> np.ndarray:
        """Logits (steps, pages)."""
        x, mask = self.inputs(pages)
        h = np.concatenate([self._pass(x, mask, "f"), self._pass(x, mask, "b")], 2)
        return h @ self.p["out"] + self.p["out_b"]

    def label(self, pages: list) -> list[np.ndarray]:
        """Which blocks belong to the article; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i][0])), key=lambda i: len(pages[i][0]))
        for at in range(0, len(order), TOGETHER):
            some = order[at : at + TOGETHER]
            s = self.scores([pages[i] for i in some])
            for j, i in enumerate(some):
                out[i] = s[: len(pages[i][0]), j] > 0
        return out

    def gradient(self, pages: list, labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, mask = self.inputs(pages)
        kept = {"f": [], "b": []}
        h = np.concatenate([self._pass(x, mask, d, kept[d]) for d in "fb"], 2)
        y = np.zeros(h.shape[:2], np.float32)
        for j, own in enumerate(labels):
            y[: len(own), j] = own
        wrong = (_sigmoid(h @ self.p["out"] + self.p["out_b"]) - y) * mask[:, :, 0] / mask.sum()
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["out_b"] = np.einsum("tn,tnh->h", wrong, h), np.array([wrong.sum()], np.float32)
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            w = self.p[f"w{d}"]
            dh, dc = np.zeros_like(h[0, :, :HIDDEN]), np.zeros_like(h[0, :, :HIDDEN])
            for t, before, cell, i, f, o, new, tc in reversed(kept[d]):
                dh = (dh + wrong[t][:, None] * self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]) * mask[t]
                dc = (dc + dh * o * (1 - tc * tc)) * mask[t]
                dz = np.concatenate([dc * new * i * (1 - i), dc * cell * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - new * new)], 1)
                g[f"w{d}"] += np.concatenate([x[t], before], 1).T @ dz
                g[f"b{d}"] += dz.sum(0)
                back = dz @ w.T
                dx[t] += back[:, : x.shape[2]]
                dh, dc = back[:, x.shape[2] :], dc * f
        for j, (paths, words, _) in enumerate(pages):
            for k, bags in enumerate((paths, words)):
                size = np.array([len(b) for b in bags])
                np.add.at(g["embed"], np.concatenate(bags), np.repeat(dx[: len(bags), j, k * EMBEDDED : (k + 1) * EMBEDDED] / size[:, None], size, axis=0))
        return g

    def fit(self, pages: list, labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 1) -> Labeller:
        """Adam over shuffled batches of pages of like length."""
        rng = np.random.default_rng(seed)
        first, second, n = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        order = np.argsort([len(p[0]) for p in pages], kind="stable")
        batches = [order[i : i + 16] for i in range(0, len(order), 16)]
        for epoch in range(epochs):
            for b in rng.permutation(len(batches)):
                g = self.gradient([pages[i] for i in batches[b]], [labels[i] for i in batches[b]])
                n += 1
                for k, v in self.p.items():
                    first[k] = 0.9 * first[k] + 0.1 * g[k]
                    second[k] = 0.999 * second[k] + 0.001 * g[k] * g[k]
                    v -= rate * 0.7**epoch * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)
        return self


_ARTICLE = ("article", "main", "article.post", "div#content", "div.post-content", "div.entry-content", "section.article-body", "div.story", "div.main-content", "main>article", "div#main>article", "div.page>article", "section>article", "div.text", "div.article")
_OUTSIDE = (
    "nav", "header", "footer", "aside", "form", "div.ad", "div.ads", "div.advert", "div.advertisement", "div.banner", "div.sponsored", "div.promo", "div.sidebar", "div#sidebar", "div.widget", "div.related", "section.related", "div.menu", "ul.menu",
    "div.navbar", "div.breadcrumb", "nav.breadcrumbs", "div.cookie-notice", "div.cookie", "div.notice", "section.notice", "div.popup", "div.modal", "div.newsletter", "div.subscribe", "div.social", "div.share", "div.login", "div.search", "form.search",
    "div#comments", "section.comments", "div.comments", "div.comment", "ol.comment-list>li.comment", "ul.comments>li", "div.reply", "footer.site-footer", "div#footer", "div.footer", "div#header", "div.header", "header.site-header", "div.top-bar", "aside.sidebar",
    "aside.related", "div.copyright", "div.toolbar", "div.pagination", "div.tags", "div.alert", "dialog.cookie-consent", "section#comments>article.comment", "div#respond>form", "div.advert-box", "div#nav", "div.consent", "div.disclaimer", "nav.main-menu",
)
_INSIDE = ("aside", "div.ad", "div.related", "div.share", "div.social", "div.comments", "section.comments", "form", "div.newsletter", "nav", "footer", "aside.notice", "div.advert", "div.promo", "ul.tags", "div.sponsored", "section#comments>article.comment", "div.notice")
_BOILER = "home about contact login subscribe share cookies accept privacy terms copyright © reserved rights menu search reply comment advertisement sponsored newsletter follow next previous more related tags archive posted ago |".split()


def generated(seed: int) -> tuple[str, set[str]]:
    """A made-up page, and the texts of its article's blocks. Every block's text is unlike all others."""
    rng = np.random.default_rng(seed)
    made = 0

    def pick(some):
        return some[int(rng.integers(len(some)))]

    def words(n: int, boiler: float = 0.0) -> str:
        nonlocal made
        made += 1
        letters = "abcdefghijklmnopqrstuvwxyzéüñ"
        out = [pick(_BOILER) if rng.random() < boiler else "".join(letters[k] for k in rng.integers(0, len(letters), int(rng.integers(2, 9)))) for _ in range(n)]
        text = " ".join([*out, f"q{made}"])
        return f"{text.capitalize()}." if rng.random() < 0.8 - boiler / 2 else text

    def wrap(path: str, inner: str) -> str:
        """`inner` in the elements of a path such as div.a>ul#b."""
        for step in reversed(path.split(">")):
            tag, mark, name = re.match(r"(\w+)([.#]?)([\w-]*)", step).groups()
            attribute = f' {"class" if mark == "." else "id"}="{name}"' if mark else ""
            inner = f"<{tag}{attribute}>{inner}</{tag}>"
        return inner

    def outside(paths) -> str:
        path, n = pick(paths), int(rng.integers(1, 6))
        boiler = pick((0.0, 0.0, 0.2, 0.5))
        # any length, so that markup decides more than size
        parts = [words(int(rng.integers(1, pick((5, 12, 40)))), boiler) for _ in range(n)]
        kind = int(rng.integers(6))
        if kind == 0:
            inner = "<ul>" + "".join(f'<li><a href="/{i}">{p}</a></li>' for i, p in enumerate(parts)) + "</ul>"
        elif kind == 1:
            inner = "".join(f"<p>{p}</p>" for p in parts)
        elif kind == 2:
            inner = parts[0]
        elif kind == 5:
            inner = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{p}</p>" for p in parts[1:])
        elif kind == 3:
            inner = f"<h3>{parts[0]}</h3>" + "".join(f"<div>{p}</div>" for p in parts[1:])
        else:
            inner = "".join(f"<p><a href='#'>{p}</a></p>" for p in parts)
        return wrap(path, inner)

    kept: set[str] = set()

    def own(n: int) -> str:
        text = words(n)
        kept.add(text)
        return text

    inner = [f"<h1>{own(int(rng.integers(1, 12)))}</h1>"] if rng.random() < 0.85 else []
    if inner and rng.random() < 0.15:
        inner = [f"<header>{inner[0]}</header>"]
    for _ in range(int(rng.integers(1, 14))):
        kind, n = rng.random(), int(rng.integers(1, pick((4, 30, 90))))
        if kind < 0.62:
            text = own(n)
            inner.append(pick((f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p><em>{text}</em></p>", f"<p>{text}</p>")))
        elif kind < 0.70:
            inner.append(f"<{(h := pick(('h2', 'h3', 'h4')))}>{own(min(n, 9))}</{h}>")
        elif kind < 0.78:
            inner.append("<ul>" + "".join(f"<li>{own(min(n, 20))}</li>" for _ in range(int(rng.integers(1, 4)))) + "</ul>")
        elif kind < 0.82:
            inner.append(f"<blockquote><p>{own(n)}</p></blockquote>")
        elif kind < 0.85:
            inner.append(f"<div>{own(n)}</div>")
        elif kind < 0.87:
            inner.append("<table><tr>" + "".join(f"<td>{own(min(n, 6))}</td>" for _ in range(3)) + "</tr></table>")
        elif kind < 0.89:
            inner.append(f"<pre>{own(n)}</pre>")
        elif kind < 0.91:
            inner.append(f"<figure><figcaption>{own(min(n, 12))}</figcaption></figure>")
        else:
            inner.append(outside(_INSIDE))
    if rng.random() < 0.15:
        inner.append(outside(_INSIDE))
    parts = [outside(_OUTSIDE) for _ in range(int(rng.integers(0, 5)))] + [wrap(pick(("article", "article", pick(_ARTICLE))), "".join(inner))] + [outside(_OUTSIDE) for _ in range(int(rng.integers(0, 5)))]
    body = "".join(parts)
    if rng.random() < 0.3:
        body = wrap(pick(("div", "div.wrapper", "div.container", "div#page")), body)
    return f"<!DOCTYPE html><html><head><title>{words(3)}</title></head><body>{body}</body></html>", kept


@lru_cache(1)
def trained() -> Labeller:
    features, pages, labels = Features(), [], []
    for seed in range(TRAIN_PAGES):
        page, kept = generated(seed)
        own = blocks(page)
        pages.append(features.of(own))
        labels.append(np.array([b[1] in kept for b in own], np.float32))
    return Labeller().fit(pages, labels)


@lru_cache(1)
def _features() -> Features:
    return Features()


def main_texts(pages: list[str], labeller: Labeller) -> list[str]:
    own = [blocks(p) for p in pages]
    labels = labeller.label([_features().of(b) for b in own])
    return ["\n".join(x[1] for x, keep in zip(b, label, strict=True) if keep) for b, label in zip(own, labels, strict=True)]


def extract(pages: DataFrame, html: str = "html", out: str = "text", labeller: Labeller | None = None) -> DataFrame:
    """`pages` with the main text as a string column `out`."""
    labeller = labeller or trained()

    def run(column: pa.Array) -> pa.Array:
        own = texts(column)
        return pa.array([t for at in range(0, len(own), 512) for t in main_texts(own[at : at + 512], labeller)], pa.string())

    return put(pages, out, F.arrow_udf(run, T.StringType()).asNondeterministic()(F.col(f"`{html}`")))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op7_html": op7_html}
ORACLE_SQL: dict[str, str] = {}
