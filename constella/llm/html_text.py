"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A page is scanned once into leaf blocks, runs of text between block-level tags, each with its chain of open elements
(with ids, classes and roles). Scripts, styles, comments and the head are never text; text of math, svg, object and noscript is like any other. Features of a block come from
its ancestors and its text; the chain gives every block the label ``main`` or ``other`` (Viterbi). The field is trained
in numpy on labelled pages that ``labelled_pages`` makes from a rule: articles in varied page layouts among menus, headers,
footers, sidebars, notices, adverts, forms and reader comments.

Defined results: a null or empty page has empty text. Repeated rows give equal rows. Broken markup is read as far as it goes: an
unclosed element ends with its parent, a tag that is never closed by ``>`` is text, a quote without an end is no quote. Work and memory grow
with the page, however deep or broken it is. An empty table gives an empty table. Extra
columns are left out. Nothing is cut: white space inside a block becomes one space, blocks are joined by one line end.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from constella.llm import common

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style head template iframe select option textarea title".split())
RAW = frozenset("script style textarea title".split())
#: Elements that a head may hold; any other start tag ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 "
    "h5 h6 header hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An element that ends an open one of the same row when it opens.
CLOSES = {
    "p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}),
}
ENDS_P = BLOCK - {"br", "label", "button"}

#: Elements out of which an inline element isn't closed.
FENCES = frozenset({"td", "th", "table", "article", "body"})

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_IN_TAG = re.compile(r"[>=]")
_VALUE = re.compile(r"\s*([\"'])?")
_BARE = re.compile(r"[^\s>]*")
_LONG_NUMBER = re.compile(r"&#([xX]?)([0-9a-fA-F]{7,});?")
_ATTRIBUTE = re.compile(r"\b(id|class|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Words in ids, classes and roles, by what they tell.
HINTS = {
    "menu": "nav menu navigation navbar breadcrumb breadcrumbs toc pagination pager tabs sitemap links".split(),
    "frame": "header footer masthead banner topbar bottom copyright legal colophon site".split(),
    "side": "sidebar side aside rail widget related recommended recommendations trending popular more promo teaser".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup paywall toast".split(),
    "advert": "ad ads advert adverts advertisement sponsor sponsored promoted dfp banner".split(),
    "comment": "comment comments reply replies respond discussion disqus thread reader reviews".split(),
    "form": "form search login contact feedback share sharing social".split(),
    "main": "article content main post entry story body text prose page".split(),
}


_TAGS = "article main section div p h1 h2 h3 li ul ol nav header footer aside form table td blockquote pre figure figcaption button label details dl a span body".split()
_KINDS = [*HINTS, "hidden"]
_TAG_BIT = {t: 1 << i for i, t in enumerate(_TAGS)}
_KIND_BIT = {k: 1 << i for i, k in enumerate(_KINDS)}


@dataclass
class Block:
    """Text of a leaf block and what its ancestors are: tags and hints as bits, the innermost block-level tag, their number."""

    text: str
    tags: int
    hints: int
    inner: str
    depth: int
    linked: int


def _hints_of(attributes: str) -> int:
    found = 0
    if len(attributes) > 3:
        for name, value in _ATTRIBUTE.findall(attributes):
            words = set(_WORDS.findall(_CAMEL.sub(" ", value.strip("\"'")).lower()))
            if name.lower() in ("hidden",) or (name.lower() == "aria-hidden" and "true" in words) or {"display", "none"} <= words:
                found |= _KIND_BIT["hidden"]
            elif name.lower() != "style":
                for kind, known in HINTS.items():
                    if not words.isdisjoint(known):
                        found |= _KIND_BIT[kind]
    return found


_hints = lru_cache(maxsize=20000)(_hints_of)


def _shorter(m: re.Match) -> str:
    """A long number without its leading zeros; one beyond all characters becomes the replacement character."""
    digits = m[2] if m[1] else re.match("[0-9]*", m[2])[0]
    short = digits.lstrip("0")
    return ("\ufffd" if len(short) > 7 else f"&#{m[1]}{short or 0};") + m[2][len(digits) :] + (";" if len(digits) < len(m[2]) and m[0][-1] == ";" else "")


def _decoded(text: str) -> str:
    """Text with its character references decoded."""
    if "&" not in text:
        return text
    return html.unescape(_LONG_NUMBER.sub(_shorter, text) if "&#" in text else text)


class _Scanner:
    """Tags, comments and text of a page in order. What is searched for in vain once isn't searched for again, so work grows with the page."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        out = self.page.find(what, at)
        if out < 0:
            self.gone.add(what)
        return out

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose attributes start at ``at``, or -1. A quote counts where a value begins and has an end."""
        while True:
            if ">" in self.gone:
                return -1
            m = _IN_TAG.search(self.page, at)
            if not m:
                self.gone.add(">")
                return -1
            if m[0] == ">":
                return m.start()
            value = _VALUE.match(self.page, m.end())
            close = self.find(value[1], value.end()) if value[1] else -1
            at = close + 1 if close >= 0 else _BARE.match(self.page, value.end()).end()

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        """(kind, name or text, attributes): kinds are text, raw (text as it stands), start and end."""
        page, at, start = self.page, 0, 0
        while (start := page.find("<", start)) >= 0:
            ahead = page[start + 1 : start + 2]
            closing = ahead == "/"
            name = _NAME.match(page, start + 1 + closing)
            raw = ""
            if name:
                end = self.tag_end(name.end())
            elif ahead == "!" and page.startswith("!--", start + 1):
                end = self.find("-->", start + 4)
                end = end + 2 if end >= 0 else len(page)
            elif ahead == "!" and page.startswith("![CDATA[", start + 1) and (close := self.find("]]>", start + 9)) >= 0:
                raw, end = page[start + 9 : close], close + 2
            elif ahead in ("!", "?"):
                end = self.find(">", start)
            else:
                end = -1
            if end < 0:
                start += 1
                continue
            if start > at:
                yield "text", page[at:start], ""
            if raw:
                yield "raw", raw, ""
            at = start = end + 1
            if name:
                tag = name[0].lower()
                yield ("end" if closing else "start"), tag, page[name.end() : end]
                if tag in RAW and not closing:
                    close = _RAW_END[tag].search(page, at)
                    at = start = close.start() if close else len(page)
        if at < len(page):
            yield "text", page[at:], ""


_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW}


class _Stack:
    """Open elements, with what all of them together are, and where each kind of tag was opened last."""

    def __init__(self):
        self.tags: list[str] = []
        self.facts: list[tuple[int, int, str]] = [(0, 0, "")]
        self.places: dict[str, list[int]] = {}

    def last(self, group: str) -> int:
        """Depth of the innermost open element of a tag or group, or -1."""
        places = self.places.get(group)
        return places[-1] if places else -1

    @staticmethod
    def groups(tag: str) -> list[str]:
        return [tag, *(["*block"] if tag in BLOCK else []), *(["*fence"] if tag in FENCES else [])]

    def push(self, tag: str, hints: int) -> None:
        for group in self.groups(tag):
            self.places.setdefault(group, []).append(len(self.tags))
        bits, kinds, inner = self.facts[-1]
        self.tags.append(tag)
        self.facts.append((bits | _TAG_BIT.get(tag, 0), kinds | hints, tag if tag in BLOCK else inner))

    def pop(self) -> str:
        tag = self.tags.pop()
        self.facts.pop()
        for group in self.groups(tag):
            self.places[group].pop()
        return tag


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks in page order. Line breaks and block-level tags end a block, inline elements don't, skipped ones among them."""
    out: list[Block] = []
    stack, texts = _Stack(), []
    linked = skipping = 0

    def flush() -> None:
        nonlocal linked
        if texts:
            text = _SPACES.sub(" ", "".join(texts)).strip()
            if text:
                tags, hints, inner = stack.facts[-1]
                out.append(Block(text, tags, hints, inner, len(stack.tags), min(linked, len(text))))
            texts.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal skipping
        while len(stack.tags) > depth:
            if stack.tags[-1] in BLOCK:
                flush()
            if stack.pop() in SKIPPED:
                skipping -= 1

    for kind, name, attributes in _Scanner(page):
        if kind in ("text", "raw"):
            if not skipping:
                piece = _decoded(name) if kind == "text" else name
                texts.append(piece)
                if stack.last("a") >= 0:
                    linked += len(piece)
            continue
        depth = stack.last(name)
        if kind == "end":
            if depth < 0 and name in ("br", "p"):
                flush()
            elif depth >= 0 and (name in BLOCK or depth >= stack.last("*fence")):
                close(depth)
            continue
        if name not in IN_HEAD and stack.last("head") > stack.last("template"):
            # The end tag of a head is optional: the first element that can't be in it, such as the body, ends it.
            close(stack.last("head"))
        if name in BLOCK:
            flush()
        if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
            continue
        if stack.tags and stack.tags[-1] in CLOSES.get(name, ()):
            close(len(stack.tags) - 1)
        elif name in ENDS_P or name in CLOSES:
            # An open paragraph, and the inline elements that were left open in it, end before a block-level element.
            target = max(stack.last(t) for t in (*(["p"] if name in ENDS_P else []), *CLOSES.get(name, ())))
            if target >= 0 and target >= stack.last("*block"):
                close(target)
        if name in SKIPPED:
            skipping += 1
        stack.push(name, _hints(attributes))
    close(0)
    flush()
    return out


# --- features ----------------------------------------------------------------------------------

_LENGTHS = (10, 25, 50, 100, 200, 400)
N_FEATURES = 2 + len(_TAGS) * 2 + len(_KINDS) + len(_LENGTHS) + 9
_AT = {t: i for i, t in enumerate(_TAGS)}


def block_features(blocks: list[Block]) -> np.ndarray:
    """One row of numbers in 0 to 1 for each block: ancestors' tags and hints, length, links and marks."""
    out = np.zeros((len(blocks), N_FEATURES), np.float64)
    inner, hints, lengths = 1 + len(_TAGS), 1 + 2 * len(_TAGS), 1 + 2 * len(_TAGS) + len(_KINDS)
    rest = lengths + len(_LENGTHS)
    for row, b in enumerate(blocks):
        x, n = out[row], len(b.text)
        x[0] = 1
        for i in range(len(_TAGS)):
            x[1 + i] = b.tags >> i & 1
        if b.inner in _AT:
            x[inner + _AT[b.inner]] = 1
        for i in range(len(_KINDS)):
            x[hints + i] = b.hints >> i & 1
        for i, size in enumerate(_LENGTHS):
            x[lengths + i] = n >= size
        words = b.text.count(" ") + 1
        x[rest] = b.linked / n
        x[rest + 1] = b.linked >= n * 0.8
        x[rest + 2] = b.text[-1] in ".!?…\"'”»"
        x[rest + 3] = min(1.0, sum(map(b.text.count, ".,;:")) / words)
        x[rest + 4] = words <= 3
        x[rest + 5] = "©" in b.text or "@" in b.text
        x[rest + 6] = min(1.0, b.depth / 20)
        x[rest + 7] = "|" in b.text or "»" in b.text or "·" in b.text
        x[rest + 8] = not (b.tags & (_TAG_BIT["article"] | _TAG_BIT["main"])) and not b.hints & _KIND_BIT["main"]
    return out


# --- the field ---------------------------------------------------------------------------------


@dataclass
class Chain:
    """Weights of features for both labels (0 other, 1 main), of label pairs, and of the first label."""

    weights: np.ndarray
    pairs: np.ndarray
    first: np.ndarray

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        score = x @ self.weights
        n = len(score)
        if not n:
            return np.zeros(0, np.int64)
        back = np.zeros((n, 2), np.int64)
        a0, a1 = (score[0] + self.first).tolist()
        (p00, p01), (p10, p11) = self.pairs.tolist()
        for i, (s0, s1) in enumerate(score[1:].tolist(), 1):
            x0, y0, x1, y1 = a0 + p00, a1 + p10, a0 + p01, a1 + p11
            back[i] = y0 > x0, y1 > x1
            a0, a1 = s0 + max(x0, y0), s1 + max(x1, y1)
        out = np.zeros(n, np.int64)
        out[-1] = a1 > a0
        for i in range(n - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out


def _log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=-1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=-1, keepdims=True)))[..., 0]


def train_chain(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 30, rate: float = 0.5, ridge: float = 1e-4) -> Chain:
    """Gradient ascent (AdaGrad) on the conditional likelihood; forward and backward sums run over all pages in step."""
    longest = max(len(y) for _, y in pages)
    n, width = len(pages), pages[0][0].shape[1]
    x = np.zeros((n, longest, width))
    y = np.zeros((n, longest), np.int64)
    mask = np.zeros((n, longest), bool)
    for i, (f, label) in enumerate(pages):
        x[i, : len(label)], y[i, : len(label)], mask[i, : len(label)] = f, label, True
    model = Chain(np.zeros((width, 2)), np.zeros((2, 2)), np.zeros(2))
    total = [np.full_like(w, 1e-6) for w in (model.weights, model.pairs, model.first)]
    truth = np.eye(2)[y] * mask[..., None]
    true_pairs = np.einsum("nla,nlb->ab", truth[:, :-1], truth[:, 1:])
    for _ in range(epochs):
        score = x @ model.weights
        score[:, 0] += model.first
        forward = np.zeros_like(score)
        backward = np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for i in range(1, longest):
            step = _log_sum((forward[:, i - 1, :, None] + model.pairs).transpose(0, 2, 1)) + score[:, i]
            forward[:, i] = np.where(mask[:, i, None], step, forward[:, i - 1])
        z = _log_sum(forward[:, -1])
        for i in range(longest - 2, -1, -1):
            step = _log_sum(model.pairs + (score[:, i + 1] + backward[:, i + 1])[:, None, :])
            backward[:, i] = np.where(mask[:, i + 1, None], step, 0.0)
        node = np.exp(forward + backward - z[:, None, None]) * mask[..., None]
        edge = forward[:, :-1, :, None] + model.pairs + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]
        edge = np.exp(np.minimum(edge, 0)) * mask[:, 1:, None, None]
        gaps = truth - node
        slopes = (
            np.einsum("nlf,nla->fa", x, gaps) / n - ridge * model.weights,
            (true_pairs - edge.sum(axis=(0, 1))) / n - ridge * model.pairs,
            gaps[:, 0].sum(axis=0) / n,
        )
        for w, g, t in zip((model.weights, model.pairs, model.first), slopes, total, strict=True):
            t += g * g
            w += rate * g / np.sqrt(t)
    return model


# --- labelled pages ----------------------------------------------------------------------------

#: A mark that labelled pages carry at the start of every block of the article.
MARK = "⁣"


def labelled_pages(count: int = 200, seed: int = 5) -> list[str]:
    """Pages made from a rule, with ``MARK`` before the text of each block that belongs to the article."""
    rng = np.random.default_rng(seed)
    letters = [c + v for c in "bcdfglmnprstv" for v in "aeiou"]
    word = lambda: "".join(rng.choice(letters, rng.integers(1, 5)))
    pick = lambda *options: options[int(rng.integers(len(options)))]
    words = lambda lo, hi: " ".join(word() for _ in range(int(rng.integers(lo, hi))))
    sentence = lambda lo=4, hi=18: words(lo, hi).capitalize() + pick(".", ".", ".", "!", "?", "")
    link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'
    named = lambda *options: f' {pick("class", "class", "id")}="{pick(*options)}"'

    def menu() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(int(rng.integers(3, 9))))
        return pick(f"<nav><ul>{items}</ul></nav>", f"<div{named('menu', 'navbar', 'site-nav', 'breadcrumbs')}><ul>{items}</ul></div>", f"<nav>{' | '.join(link() for _ in range(4))}</nav>")

    def footer() -> str:
        text = f"&copy; {word()}.example &middot; {sentence()}"
        return pick(f"<footer>{text}</footer>", f"<div{named('footer', 'site-footer', 'copyright')}><p>{text}</p>{link()}</div>")

    def other() -> str:
        return pick(
            f"<div{named('ad', 'ads', 'advert', 'sponsored', 'ad-slot')}>{sentence()}</div>",
            f"<aside><h3>{words(1, 4)}</h3><p>{sentence()}</p></aside>",
            f"<div{named('sidebar', 'related', 'widget', 'trending')}><h3>{words(1, 4)}</h3><ul><li>{link()}</li><li>{link()}</li></ul><p>{sentence()}</p></div>",
            f"<div{named('cookie-notice', 'consent', 'newsletter', 'popup', 'alert')}><p>{sentence(6, 25)}</p><button>{words(1, 3)}</button></div>",
            f"<form><label>{words(1, 3)}</label><input type=text><button>{word()}</button></form>",
            f"<div{named('share', 'social')}>{link()} {link()}</div>",
            menu(),
        )

    def comments() -> str:
        rows = "".join(f"<div{named('comment', 'reply')}><p>{sentence()}</p><p>{sentence(8, 40)}</p></div>" for _ in range(int(rng.integers(1, 6))))
        return pick(f'<section id="comments"><h2>{words(1, 3)}</h2>{rows}</section>', f'<div class="comments"><h3>{words(1, 3)}</h3><ul><li>{sentence(6, 30)}</li></ul>{rows}</div>')

    def paragraph() -> str:
        body = " ".join(sentence() for _ in range(int(rng.integers(1, 8))))
        if rng.random() < 0.25:
            body = sentence(1, 4)
        # Articles in the wild hold lists of words between bars, shouting and stray marks.
        if rng.random() < 0.15:
            body = pick(body.replace(" ", " | "), body.upper(), body.replace(" ", pick("!! ", "### ", " · ")), f"{words(1, 3)} |", f"© {body}")
        if rng.random() < 0.2:
            body += f" {link()} {sentence()}"
        kind = rng.random()
        if kind < 0.72:
            return f"<p>{pick('', '<b>', '<em>')}{MARK}{body}{pick('', '<br>' + MARK + sentence())}</p>"
        if kind < 0.8:
            return f"<ul>{''.join(f'<li>{MARK}{sentence()}</li>' for _ in range(int(rng.integers(2, 6))))}</ul>"
        if kind < 0.86:
            return f"<blockquote>{MARK}{body}</blockquote>"
        if kind < 0.94:
            return f"<h2>{MARK}{words(1, 7)}</h2>"
        return f"<table><tr><td>{MARK}{words(1, 4)}</td><td>{MARK}{sentence()}</td></tr></table>"

    out = []
    for _ in range(count):
        title = sentence(2, 12)
        body = f"<h1>{MARK}{title}</h1>" + "".join(paragraph() + (other() if rng.random() < 0.08 else "") for _ in range(int(rng.integers(1, 14))))
        if rng.random() < 0.15:
            body += comments()
        article = pick(
            f"<article>{body}</article>", f"<article>{body}</article>", f"<main><article>{body}</article></main>", f"<main>{body}</main>",
            f"<div{named('article-body', 'post', 'entry-content', 'story', 'content')}>{body}</div>", f'<div id="content"><div>{body}</div></div>',
        )
        before = menu() + "".join(other() for _ in range(int(rng.integers(0, 3))))
        if rng.random() < 0.4:
            before = f"<header><a href=/>{words(1, 3)}</a><p>{sentence(2, 8)}</p></header>" + before
        after = "".join(other() for _ in range(int(rng.integers(0, 3)))) + (comments() if rng.random() < 0.35 else "") + footer()
        out.append(f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{before}<!-- {word()} -->{article}{after}</body></html>")
    return out


def training_set(pages: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of labelled pages; the marks are taken off before features are computed."""
    out = []
    for page in pages:
        blocks = leaf_blocks(page)
        labels = np.array([MARK in b.text for b in blocks], np.int64)
        plain = [replace(b, text=b.text.replace(MARK, "").strip() or " ") for b in blocks]
        out.append((block_features(plain), labels))
    return out


@lru_cache(maxsize=1)
def default_chain() -> Chain:
    return train_chain(training_set(labelled_pages()))


def main_text(page: str | None, model: Chain) -> str:
    blocks = leaf_blocks(page or "")
    if not blocks:
        return ""
    keep = model.viterbi(block_features(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep.tolist(), strict=True) if k)


def extract_text(df: DataFrame, id_col: str, url_col: str, html_col: str, model: Chain | None = None) -> DataFrame:
    """page_id, url, text (main text of the whole page) and n_chars (its code points)."""
    chain = model or default_chain()
    source = common.pick(df, page_id=id_col, url=url_col, html=html_col).withColumn("html", F.col("html").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            texts = [main_text(p, chain) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def op4_crf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(common.table(spark, sf_dir, "pages"), "page_id", "url", "html")
