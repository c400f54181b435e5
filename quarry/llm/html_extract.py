"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a row of tokens: tags, and segments of text between the borders of blocks. The words of a segment score by
the log-odds of being content, given the elements, roles and class names around them, the share of links and the form of
the text; a tag scores the log of its share within content, which is never above zero. All of these weights are learned from
labelled pages (``labelled_pages``); no name or tag decides alone. A segment whose words score below zero counts once, as a tag does, and yields no text. One linear
scan finds the contiguous run of tokens of greatest sum, the content region, and the words in it that score above zero are
the main text.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.labelled_pages import MARK, pages

#: Labelled pages to learn from, and their seed.
LABELLED, SEED = 1000, 7
#: Elements whose content is no text of the page.
_RAW = frozenset("script style noscript template textarea iframe svg canvas select title xmp".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_TAG_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
_WORDS = re.compile(r"[a-z]+")
#: Elements that don't end a word or a block.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Inline elements that are tracked while open, as they can be links or have names.
_NAMED = frozenset("a span".split())
_CELLS = frozenset("li td th dt dd tr".split())
_HIDDEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden")


def markup(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", text), ("open", tag, attributes) and ("close", tag, "") in page order, in time linear in its length.

    A quote opens an attribute's value only after "="; a value that is never closed ends with the tag's first ">". Where
    no ">" follows a tag's start, the page ends there, as it does where a comment or a script is never closed.
    """
    at, n = 0, len(html)
    last = {c: html.rfind(c) for c in "\"'"}
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", "", html[at:]
            return
        if lt > at:
            yield "text", "", html[at:lt]
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            if end < 0:
                return
            at = end + 3
            continue
        closing = html.startswith("/", lt + 1)
        name = _NAME.match(html, lt + 1 + closing)
        if not name:
            if closing or html[lt + 1 : lt + 2] in ("!", "?"):
                end = html.find(">", lt)
                if end < 0:
                    return
                at = end + 1
            else:
                yield "text", "", "<"
                at = lt + 1
            continue
        end, i = -1, name.end()
        while m := _TAG_STOP.search(html, i):
            i = m.start()
            if html[i] == ">":
                end = i
                break
            k = i - 1
            while html[k].isspace():
                k -= 1
            if html[k] != "=":
                i += 1
            elif i < last[html[i]]:
                i = html.find(html[i], i + 1) + 1
            else:
                end = html.find(">", i)
                break
        if end < 0:
            return
        tag, at = name[0].lower(), end + 1
        if closing:
            yield "close", tag, ""
            continue
        raw = html[name.end() : end]
        yield "open", tag, raw
        if tag in _RAW and not raw.endswith("/"):
            m = _RAW_END[tag].search(html, at)
            if not m:
                return
            at = m.start()


def _element(tag: str, raw: str) -> tuple[str, ...]:
    """Features of an element: its tag, role, names and their parts."""
    out = [f"<{tag}"] if tag not in ("html", "body", "div", "span", "a") else []
    if not raw.strip(" /"):
        return tuple(out)
    attrs: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        attrs.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if tag == "a" and "href" in attrs:
        out.append("href")
    if tag in ("html", "body"):
        return ()
    for whole in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        parts = _WORDS.findall(whole)
        out += [f"={'-'.join(parts)}", *(f"~{p}" for p in parts)]
    for a in ("role", "itemprop"):
        if a in attrs:
            out.append(f"{a}:{attrs[a].lower()}")
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", "")):
        out.append("hidden")
    return tuple(dict.fromkeys(out))


_cached_element = lru_cache(4096)(_element)


class Segment:
    """Text of a block, or a part of it with names of its own, under one set of open elements."""

    __slots__ = ("text", "words", "features", "inside", "space")

    def __init__(self, text: str, features: frozenset[str], inside: bool, space: bool):
        self.text, self.words, self.features, self.inside, self.space = text, len(text.split()), features, inside, space


def _form(tag: str, text: str, words: int, links: int) -> set[str]:
    """Features of a block's text: the element it stands in, its size, the share of links, and marks of sentences."""
    share = links / max(1, words)
    size = "1" if words < 2 else "3" if words < 4 else "8" if words < 9 else "long"
    form = "all" if share > 0.9 else "most" if share > 0.5 else "some" if share > 0.15 else "few"
    return {f"in:{tag}", f"words:{size}", f"links:{form}", f"links:{form}:{size}", f"marks:{any(c in text for c in '.?!;')}"}


class Page:
    """Reads markup into ``tokens``: Segments, and names of opened blocks."""

    def __init__(self, html: str, known: dict[str, float] | None = None):
        self.known, self.tokens, self.content = known, [], False
        # open elements: (tag, features, within article or main, within a link)
        self.stack: list[tuple[str, frozenset[str], bool, bool]] = [("", frozenset(), False, False)]
        # texts since the last border, and parts of the block so far
        self.parts: list[tuple[str, bool]] = []
        self.block: list[tuple[str, int, frozenset[str], bool]] = []
        self.space = True
        #: Places of the open elements by tag, and of those that aren't inline.
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks = [0]
        for kind, tag, raw in markup(html):
            if kind == "text":
                self.parts.append((unescape(raw), self.stack[-1][3]))
            elif kind == "open":
                self._open(tag, raw)
            else:
                self._close(tag)
        self._flush()

    def _split(self) -> None:
        """Ends a part of a block."""
        if self.parts:
            _, features, inside, _ = self.stack[-1]
            links = sum(len(t.split()) for t, linked in self.parts if linked)
            self.block.append(("".join(t for t, _ in self.parts), links, features, inside))
            self.parts = []

    def _flush(self) -> None:
        """Ends a block."""
        self._split()
        if not self.block:
            return
        whole = "".join(b[0] for b in self.block)
        if not whole.isspace():
            tag = self.stack[self.blocks[-1]][0]
            form = _form(tag, whole, len(whole.split()), sum(b[1] for b in self.block))
            for text, _, features, inside in self.block:
                self.content |= inside
                self.tokens.append(Segment(text, features | form, inside, self.space))
                self.space = False
        self.block = []

    def _drop(self, i: int) -> None:
        """Closes the open elements from place ``i`` on."""
        for e in self.stack[i:]:
            self.at[e[0]].pop()
        del self.stack[i:]
        while self.blocks[-1] >= i:
            self.blocks.pop()

    def _open(self, tag: str, raw: str) -> None:
        inline = tag in _INLINE
        if not inline:
            self._flush()
            self.space = True
            self.tokens.append(tag)
        if tag in _VOID or raw.endswith("/") or tag in _RAW or inline and tag not in _NAMED:
            return
        if not inline:
            # a paragraph ends where a block begins
            i = self.blocks[-1]
            if self.stack[i][0] == "p":
                self._drop(i)
            elif tag in _CELLS and self.stack[i][0] in _CELLS and self.stack[i][0] != "tr":
                self._drop(i)
        elif tag == "a" and self.stack[-1][0] == "a":
            self._split()
            self._drop(len(self.stack) - 1)
        if tag in ("article", "main"):
            # a block of the page's head that was left open
            left_open = [self.at[t][0] for t in ("nav", "head", "header") if self.at[t]]
            if left_open:
                self._drop(min(left_open))
        _, features, inside, linked = self.stack[-1]
        own = (_cached_element if len(raw) < 300 else _element)(tag, raw)
        if "href" in own:
            linked, own = True, [f for f in own if f != "href"]
        if inside:
            own = [f"{f}@" if f[0] == "<" else f for f in own]
        if self.known is not None:
            own = [f for f in own if f in self.known]
        inside = inside or tag in ("article", "main")
        if not features.issuperset(own):
            if inline:
                self._split()  # a part with a name of its own, in the middle of a block
            features = features.union(own)
        self.at[tag].append(len(self.stack))
        if tag not in _NAMED:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, features, inside, linked))

    def _close(self, tag: str) -> None:
        if tag in _INLINE:
            # a link may be closed across blocks, other inline elements within theirs only
            if tag in _NAMED and self.at[tag] and (tag == "a" or self.at[tag][-1] > self.blocks[-1]):
                i = self.at[tag][-1]
                if self.stack[i][1] is not self.stack[i - 1][1]:
                    self._split()
                self._drop(i)
            return
        self._flush()
        self.space = True
        if not self.at[tag] or tag == "p" and self.stack[-1][0] not in ("p", *_NAMED):
            return
        self._drop(self.at[tag][-1])

    def features(self, s: Segment) -> frozenset[str]:
        return s.features | {"outside"} if self.content and not s.inside else s.features


def _train(rows: Counter, ridge: float = 1.0, steps: int = 25) -> dict[str, float]:
    """Weights of a ridge logistic regression on sets of features, the bias under "", by Newton steps; ``rows`` counts
    each (set, is content)."""
    seen = Counter(f for (r, _), n in rows.items() for f in r for _ in range(min(n, 3)))
    names = sorted(f for f, n in seen.items() if n > 2)
    at = {f: i + 1 for i, f in enumerate(names)}
    x, y, n = np.zeros((len(rows), len(names) + 1), np.float32), np.zeros(len(rows)), np.zeros(len(rows))
    x[:, 0] = 1
    for k, ((row, good), times) in enumerate(sorted(rows.items(), key=lambda r: (sorted(r[0][0]), r[0][1]))):
        x[k, [at[f] for f in row if f in at]] = 1
        y[k], n[k] = good, times
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        g = x.T @ (n * (p - y)).astype(np.float32) + ridge * w
        h = (x * (n * p * (1 - p) + 1e-5)[:, None].astype(np.float32)).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-3:
            break
    return {"": round(float(w[0]), 4)} | {f: round(float(w[i]), 4) for f, i in at.items()}


@lru_cache(1)
def weights() -> tuple[dict[str, float], dict[str, float]]:
    """Weights of the features of words, and those of tags, from the labelled pages."""
    rows, inside, all_ = Counter(), Counter(), Counter()
    for html in pages(LABELLED, SEED):
        page = Page(html)
        content = [i for i, t in enumerate(page.tokens) if isinstance(t, Segment) and MARK in t.text]
        first = content[0] if content else 0
        while first and isinstance(page.tokens[first - 1], str):
            first -= 1  # the tags before it open the first block
        for i, t in enumerate(page.tokens):
            if isinstance(t, Segment):
                rows[page.features(t), MARK in t.text] += 1
            else:
                all_[t] += 1
                inside[t] += bool(content) and first <= i <= content[-1]
    tags = {t: round(log((inside[t] + 0.5) / (all_[t] + 1)), 4) for t in all_}
    total = round(log((sum(inside.values()) + 0.5) / (sum(all_.values()) + 1)), 4)
    return _train(rows), tags | {"": total}


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the contiguous run of greatest sum, the first of equals; (0, 0) if none is positive."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, found = run, (start, i + 1)
    return found


def scored(page: Page, words: dict[str, float], tags: dict[str, float]) -> list[float]:
    """The score of each token; that of a word times their number, where it is above zero."""
    out, bias, other = [], words[""], tags[""]
    for t in page.tokens:
        if isinstance(t, Segment):
            s = bias + sum(words.get(f, 0.0) for f in sorted(page.features(t)))
            out.append(s * t.words if s > 0 else other)
        else:
            out.append(tags.get(t, other))
    return out


def main_text(html: str | None, learned: tuple[dict[str, float], dict[str, float]] | None = None) -> str:
    if not html:
        return ""
    words, tags = learned or weights()
    page = Page(html, words)
    scores = scored(page, words, tags)
    a, b = best_run(scores)
    out, space = [], True
    for t, s in zip(page.tokens[a:b], scores[a:b], strict=True):
        if isinstance(t, str):
            space = True
            continue
        space = space or t.space
        if s > 0:
            out.append(" " + t.text if space else t.text)
            space = False
    return " ".join("".join(out).split())


def _extract(learned: tuple[dict[str, float], dict[str, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), learned) for h in batch.column("html")]
            sizes = pa.array([*map(len, texts)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes],
                ["page_id", "url", "text", "n_chars"],
            )

    return run


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; one pass, no shuffle.

    Defined cases: a null or empty page, and one without content, has the empty text; tags left open, raw ``<`` and
    character references without ";" are read as browsers do; an element left open ends with its parent; time and memory are
    linear in a page's length, whatever its markup; equal pages have equal texts and repeated rows are read each; of runs of equal
    sums the first counts; an empty table gives an empty result; other columns are ignored.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(
        _extract(weights()), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
