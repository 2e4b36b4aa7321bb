"""Main text of pages by a recurrent block labeller: a bidirectional LSTM over each page's blocks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorfisc.llm.common import bounded_sample, table
from motorfisc.llm.markup import Block, blocks

#: Pages that the labeller is fitted on at most, and the longest of them in characters.
TRAIN_ROWS, TRAIN_CHARS = 240, 60_000
#: Widths of the hashed path and word vectors, of the other numbers, and of each direction's state.
PATH, WORDS, OTHER, STATE = 128, 32, 6, 16
EPOCHS, BATCH, RATE, SEED = 14, 24, 0.01, 42
#: Blocks of pages that are labelled at once.
_HELD = 40_000

# Weak labels of given pages: what stands in these elements is content, unless one of those stands between.
_CONTENT = {"article", "main"}
_NOT_CONTENT = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "select", "textarea"}

# Layouts of pages made for training: names that page makers give to parts of a page.
_BODY_NAMES = ["article", "content", "main content", "post body", "entry content", "story", "article-body", "text", "post", "page-text", ""]
_PARTS = {
    "nav": ["nav", "menu", "navbar", "breadcrumb", "main-menu", "navigation", "topnav", "links"],
    "header": ["header", "masthead", "site-header", "top", "banner", "branding"],
    "footer": ["footer", "site-footer", "copyright", "bottom", "colophon"],
    "aside": ["sidebar", "aside", "related", "widget", "right-rail", "recommended", "popular", "tags"],
    "notice": ["cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "newsletter", "subscribe", "popup", "modal"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "adsense"],
    "form": ["search", "login", "signup", "contact-form", "search-form", "subscribe-form"],
    "comments": ["comments", "comment", "comment-list", "discussion", "responses", "replies", "reader-comments", "disqus"],
    "share": ["share", "social", "share-buttons", "social-links"],
}
_TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "notice": ["div", "section", "dialog"], "ad": ["div", "section", "aside"], "form": ["form"], "comments": ["section", "div", "ol", "ul"], "share": ["div", "ul"]}


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def made_page(texts: list[str], rng: np.random.Generator) -> str:
    """A page of a random layout around given texts, each part marked as content or not."""
    words = " ".join(texts).split()[:4000] or ["text"]
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    short = lambda n: " ".join(words[i] for i in rng.integers(len(words), size=int(rng.integers(1, n + 1))))
    long = lambda: _escape(pick(texts) if texts and rng.random() < 0.7 else short(60))

    def part(kind: str) -> str:
        tag, name = pick(_TAGS[kind]), pick(_PARTS[kind])
        named = f' {pick(["class", "id"])}="{name}"' if tag in ("div", "section", "ol", "ul") or rng.random() < 0.6 else ""
        n = int(rng.integers(1, 7))
        if tag in ("ul", "ol") and kind != "comments":
            inner = "".join(f'<li><a href="/{i}">{_escape(short(2))}</a></li>' for i in range(n + 1))
        elif kind in ("nav", "share"):
            inner = "<ul>" + "".join(f'<li><a href="/{i}">{_escape(short(2))}</a></li>' for i in range(n + 1)) + "</ul>" if rng.random() < 0.8 else "".join(f'<a href="/{i}">{_escape(short(2))}</a> ' for i in range(n + 1))
        elif kind == "comments":
            item = pick(["li", "div", "p", "article"])
            inner = "".join(f'<{item} class="{pick(["comment", "reply", "user", ""])}">{"<h4>" + _escape(short(2)) + "</h4>" if rng.random() < 0.3 else ""}{long()}</{item}>' for _ in range(n))
            inner = (f"<h3>{_escape(short(2))}</h3>" if rng.random() < 0.5 else "") + inner
        elif kind == "form":
            inner = f"<label>{_escape(short(3))}</label><input><p>{_escape(short(8))}</p><button>{_escape(short(2))}</button>"
        elif rng.random() < 0.4:
            inner = _escape(short(20))
        else:
            inner = "".join(pick(["<p>{}</p>", "<div>{}</div>", "<h3>{}</h3>", '<p><a href="#">{}</a></p>']).format(_escape(short(14))) for _ in range(n))
        return f'<{tag}{named} data-content="0">{inner}</{tag}>'

    body = [f"<h1>{_escape(short(9))}</h1>"] if rng.random() < 0.8 else []
    for _ in range(int(rng.integers(1, 14))):
        shape = rng.random()
        text = long()
        body.append(f"<h2>{_escape(short(7))}</h2>" if shape < 0.1 else f"<ul><li>{text}</li><li>{long()}</li></ul>" if shape < 0.16 else f"<blockquote>{text}</blockquote>" if shape < 0.2 else f"<p><b>{text}<br>" if shape < 0.3 else f"<pre>{text}</pre>" if shape < 0.32 else f"<p>{text}</p>")
        if rng.random() < 0.12:
            body.append(part(pick(["ad", "aside", "share", "notice"])))
    tail = [part(k) for k in ("share", "comments", "aside", "ad") if rng.random() < 0.3]
    tag = pick(["article", "article", "main", "div", "section"])
    name = pick(_BODY_NAMES)
    named = f' {pick(["class", "id"])}="{name}"' if name and (tag not in ("article", "main") or rng.random() < 0.4) else ""
    inside = rng.random() < 0.5
    middle = f'<{tag}{named} data-content="1">{"".join(body)}{"".join(tail) if inside else ""}</{tag}>{"" if inside else "".join(tail)}'
    if rng.random() < 0.3:
        middle = f'<div class="{pick(["wrapper", "container", "page", "row"])}">{middle}</div>'
    before = [part(k) for k in ("notice", "header", "nav", "ad", "aside", "form") if rng.random() < 0.4]
    after = [part(k) for k in ("aside", "comments", "form", "notice", "footer") if rng.random() < 0.4]
    return f'<html><body data-content="0">{"".join(before)}{middle}{"".join(after)}</body></html>'


def _weak(block: Block) -> int:
    tags = [p.split(" ")[0] for p in block.path]
    inner = max((i for i, t in enumerate(tags) if t in _CONTENT), default=None)
    return int(inner is not None and not _NOT_CONTENT.intersection(tags[inner:]))


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH, dtype=np.float32)
    for i, element in enumerate(path):
        tag, *names = element.split(" ")
        for word in [tag, *[f".{n}" for n in names], *(["leaf " + tag] if i == len(path) - 1 else [])]:
            for salt in (1, 2):
                h = zlib.crc32(word.encode("utf-8", "replace"), salt)
                out[h % PATH] += 1 if h & 0x10000 else -1
    return np.clip(out, -3, 3)


class _Places(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = zlib.crc32(word.encode("utf-8", "replace")) % WORDS
        return h


def features(page: list[Block], places: _Places) -> np.ndarray:
    """A row for each block: its hashed path, its hashed words (as shares) and a few sizes."""
    n = len(page)
    out = np.zeros((n, PATH + WORDS + OTHER), dtype=np.float32)
    words = [b.text.split(" ") for b in page]
    counts = np.fromiter(map(len, words), dtype=np.int64, count=n)
    flat = np.fromiter((places[w] for ws in words for w in ws), dtype=np.int64, count=counts.sum())
    if len(places) > 300_000:
        places.clear()
    rows = np.repeat(np.arange(n), counts)
    out[:, PATH : PATH + WORDS] = np.bincount(rows * WORDS + flat, minlength=n * WORDS).reshape(n, WORDS) / np.maximum(counts, 1)[:, None]
    size = np.fromiter((len(b.text) for b in page), dtype=float, count=n)
    for i, b in enumerate(page):
        out[i, :PATH] = _path_vector(b.path)
    end = np.fromiter((b.text[-1] in ".!?:;" for b in page), dtype=float, count=n)
    out[:, PATH + WORDS :] = np.stack([np.log1p(size) / 6, np.log1p(counts) / 4, [b.linked / len(b.text) for b in page], end, np.arange(n) / max(1, n), np.full(n, min(1.0, n / 50))], axis=1)
    return out


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None) -> None:
        rng, width = np.random.default_rng(SEED), PATH + WORDS + OTHER
        self.w = weights or {}
        for way in ("f", "b") if weights is None else ():
            self.w |= {way + "x": rng.standard_normal((width, 4 * STATE)) / np.sqrt(width), way + "h": rng.standard_normal((STATE, 4 * STATE)) / np.sqrt(STATE), way + "0": np.r_[np.zeros(STATE), np.ones(STATE), np.zeros(2 * STATE)]}
        if weights is None:
            self.w |= {"o": rng.standard_normal(2 * STATE) / 4, "o0": np.zeros(1)}

    @staticmethod
    def _turned(lengths: np.ndarray, longest: int) -> np.ndarray:
        """Places that turn each sequence round within its own length."""
        at = np.arange(longest)
        return np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)

    def _run(self, x: np.ndarray, way: str, lengths: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (pages, blocks, STATE) of one direction; pages stand in order of falling length."""
        gates = x @ self.w[way + "x"].astype(x.dtype) + self.w[way + "0"].astype(x.dtype)
        wh = self.w[way + "h"].astype(x.dtype)
        h = np.zeros((len(x), STATE), dtype=x.dtype)
        c, out = h.copy(), np.zeros((len(x), x.shape[1], STATE), dtype=x.dtype)
        for t in range(x.shape[1]):
            n = int((lengths > t).sum()) if keep is None else len(x)
            a = gates[:n, t] + h[:n] @ wh
            s = 1 / (1 + np.exp(-np.clip(a[:, : 3 * STATE], -30, 30)))
            i, f, o, g = s[:, :STATE], s[:, STATE : 2 * STATE], s[:, 2 * STATE :], np.tanh(a[:, 3 * STATE :])
            if keep is not None:
                keep.append((i, f, o, g, c.copy(), h.copy()))
            c[:n] = f * c[:n] + i * g
            h[:n] = o * np.tanh(c[:n])
            out[:n, t] = h[:n]
        return out

    def _back(self, x: np.ndarray, way: str, kept: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        wh, dgates = self.w[way + "h"], np.zeros((*x.shape[:2], 4 * STATE))
        dh, dc, dwh = np.zeros((len(x), STATE)), np.zeros((len(x), STATE)), np.zeros_like(wh)
        for t in range(x.shape[1] - 1, -1, -1):
            i, f, o, g, before, h = kept[t]
            c = f * before + i * g
            tc = np.tanh(c)
            dh = dh + grad[:, t]
            dc = dc + dh * o * (1 - tc**2)
            d = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            dgates[:, t] = d
            dwh += h.T @ d
            dh, dc = d @ wh.T, dc * f
        flat = dgates.reshape(-1, 4 * STATE)
        return {way + "x": x.reshape(-1, x.shape[2]).T @ flat, way + "h": dwh, way + "0": flat.sum(0)}

    def logits(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """One number for each block of each page, over 0 for content."""
        order = sorted(range(len(pages)), key=lambda i: -len(pages[i]))
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        at = 0
        while at < len(order) and len(pages[order[at]]):
            longest = len(pages[order[at]])
            group = [i for i in order[at : at + max(1, _HELD // longest)] if len(pages[i])]
            at += len(group)
            lengths = np.array([len(pages[i]) for i in group])
            x = np.zeros((len(group), longest, PATH + WORDS + OTHER), dtype=np.float32)
            for row, i in enumerate(group):
                x[row, : lengths[row]] = pages[i]
            turned = self._turned(lengths, longest)
            ahead = self._run(x, "f", lengths)
            back = np.take_along_axis(self._run(np.take_along_axis(x, turned[:, :, None], 1), "b", lengths), turned[:, :, None], 1)
            z = np.concatenate([ahead, back], axis=2) @ self.w["o"].astype(np.float32) + self.w["o0"][0]
            for row, i in enumerate(group):
                out[i] = z[row, : lengths[row]]
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> None:
        """Adam over batches of pages of like length."""
        rng = np.random.default_rng(SEED)
        mean, square, step = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        by_length = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        batches = [by_length[i : i + BATCH] for i in range(0, len(by_length), BATCH)]
        for epoch in range(EPOCHS):
            for b in rng.permutation(len(batches)):
                group = batches[b]
                lengths = np.array([len(pages[i]) for i in group])
                longest = int(lengths.max())
                x, y = np.zeros((len(group), longest, PATH + WORDS + OTHER)), np.zeros((len(group), longest))
                for row, i in enumerate(group):
                    x[row, : lengths[row]], y[row, : lengths[row]] = pages[i], labels[i]
                shown = np.arange(longest) < lengths[:, None]
                turned = self._turned(lengths, longest)[:, :, None]
                kf: list = []
                kb: list = []
                ahead, xb = self._run(x, "f", lengths, kf), np.take_along_axis(x, turned, 1)
                back = np.take_along_axis(self._run(xb, "b", lengths, kb), turned, 1)
                both = np.concatenate([ahead, back], axis=2)
                d = (1 / (1 + np.exp(-np.clip(both @ self.w["o"] + self.w["o0"][0], -30, 30))) - y) * shown / shown.sum()
                dboth = d[:, :, None] * self.w["o"]
                grads = {"o": np.einsum("bt,bts->s", d, both), "o0": np.array([d.sum()])}
                grads |= self._back(x, "f", kf, dboth[:, :, :STATE]) | self._back(xb, "b", kb, np.take_along_axis(dboth[:, :, STATE:], turned, 1))
                norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
                step += 1
                rate = RATE * (1 - 0.9 * epoch / EPOCHS)
                for k, g in grads.items():
                    g = g * min(1.0, 1.0 / max(norm, 1e-12))
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    self.w[k] = self.w[k] - rate * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)


def train(pages: DataFrame, rows: int = TRAIN_ROWS) -> Labeller:
    """Fits on at most ``rows`` pages with their weak labels, and on twice as many pages made of their texts."""
    chosen = bounded_sample(pages.where(F.length("html").between(1, TRAIN_CHARS)).select("html"), rows, "pages", "html")
    got = sorted(r["html"] for r in chosen.collect())
    rng, places = np.random.default_rng(SEED), _Places()
    read = [blocks(page) for page in got]
    made = []
    for i in range(2 * max(rows // 2, len(read))):
        own = [b.text for b in read[i % len(read)] if len(b.text) > 40][:40] if read else []
        made.append(blocks(made_page(own, rng)))
    model = Labeller()
    model.fit([features(p, places) for p in [*read, *made]], [*[np.array([_weak(b) for b in p]) for p in read], *[np.array([b.truth or 0 for b in p]) for p in made]])
    return model


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """``pages`` with text and n_chars (code points) added; columns of those names are replaced.

    The text has the blocks that the labeller takes for content, in page order, one a line. A page that is null, empty
    or without content has an empty text. Pages are read whole; very long ones are labelled by themselves. Repeated
    rows get the same text; an empty table gives an empty one.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model.w)

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, places = Labeller(shared.value), _Places()
        for batch in batches:
            texts, held, size = [], [], 0
            for page in [*batch, ...]:
                if page is not ...:
                    held.append(blocks(page))
                    size += len(held[-1])
                if held and (page is ... or size > _HELD):
                    for read, z in zip(held, own.logits([features(p, places) for p in held]), strict=True):
                        texts.append("\n".join(b.text for b, x in zip(read, z, strict=True) if x > 0))
                    held, size = [], 0
            yield pd.Series(texts, dtype=object)

    return pages.drop("text", "n_chars").withColumn("text", extracted("html")).withColumn("n_chars", F.length("text").cast("long"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages)).select("page_id", "url", "text", "n_chars")
