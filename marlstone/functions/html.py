"""Title, description and main text of HTML pages: one parse a page, in batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlstone.functions import fixed

_SKIP = {"script", "style", "noscript", "template", "svg", "nav", "footer", "aside", "form", "iframe"}
_BLOCK = {"p", "div", "section", "article", "main", "li", "ul", "ol", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "br", "pre", "figure", "header", "body"}
_VOID = {"br", "img", "meta", "link", "input", "hr", "source", "area", "base", "col", "embed", "track", "wbr"}
_SPACE = re.compile(r"\s+")
_GLUED = re.compile(fixed.GLUED)


class Page(HTMLParser):
    """What a page says of itself, and the text of its blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.h1: list[str] = []
        self.title = ""
        self.contained = False  # whether there is an article, a main part or a part of that role
        self.scripts: list[str] = []
        self.blocks: list[tuple[str, int, str]] = []  # tag, container (0: none), text
        self._stack: list[str] = []
        self._skip = 0
        self.containers: list[int] = []  # of the open tags
        self._text: list[str] = []
        self._in: str | None = None
        self._raw: list[str] = []
        self._kind = "body"

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self._text)).strip()
        if text:
            self.blocks.append((self._kind, min((c for c in self.containers if c), default=0), text))
        self._text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = _clean(a.get("name") or a.get("property") or a.get("itemprop") or a.get("http-equiv")).lower()
            if name and (value := _clean(a.get("content"))):
                self.meta.setdefault(name, value)
        if tag in ("title", "script"):
            self._in, self._raw = (tag if tag == "title" or "ld+json" in a.get("type", "") else "drop"), []
        if tag in _BLOCK:
            self._flush()
            self._kind = tag
        if tag in _VOID:
            return
        self._stack.append(tag)
        self._skip += tag in _SKIP
        self.containers.append(1 if tag == "article" else 2 if tag == "main" else 3 if a.get("role") == "main" else 0)
        self.contained = self.contained or self.containers[-1] > 0

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("title", "script") and self._in:
            raw = "".join(self._raw)
            if self._in == "title" and not self.title:
                self.title = _SPACE.sub(" ", raw).strip()
            elif self._in == "script":
                self.scripts.append(raw)
            self._in = None
        if tag in _BLOCK:
            self._flush()
        if tag in self._stack:
            while self._stack:  # a closing tag closes what was left open inside
                top = self._stack.pop()
                self._skip -= top in _SKIP
                self.containers.pop()
                if top == tag:
                    break
        self._kind = next((t for t in reversed(self._stack) if t in _BLOCK), "body")

    def handle_data(self, data: str) -> None:
        if self._in:
            self._raw.append(data)
        elif not self._skip:
            self._text.append(data)

    def done(self) -> Page:
        self.close()
        self._flush()
        self.h1 = [t for kind, _, t in self.blocks if kind == "h1"]
        return self


def _ld(page: Page, keys: tuple[str, ...]) -> str | None:
    """First text of the keys in the page's JSON-LD: an object, the objects of a list, or those of a graph."""
    for raw in page.scripts:
        try:
            told = json.loads(raw)
        except ValueError:
            continue
        items = told if isinstance(told, list) else told.get("@graph") if isinstance(told, dict) and isinstance(told.get("@graph"), list) else [told]
        for x in items:
            for k in keys if isinstance(x, dict) else ():
                if isinstance(x.get(k), str) and x[k].strip():
                    return x[k].strip()
    return None


def _clean(x: str | None) -> str:
    return _SPACE.sub(" ", re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "", x or "")).strip()


def _plain(x: str | None) -> str:
    """Without Markdown's images, links and addresses."""
    x = re.sub(r"\[([^\]]+)\]\([^)]*\)", r"\1", re.sub(r"!\[[^\]]*\]\([^)]*\)", "", _clean(x)))
    return _SPACE.sub(" ", re.sub(r"https?://\S+|\bwww\.\S+", "", x)).strip()


def _site_off(title: str) -> str:
    left = re.split(r"\s+[|\-—–:]\s+", title, maxsplit=1)[0].strip()
    return left if len(left) >= 8 else title


def _sentence(x: str) -> bool:
    return re.search("[.!?。！？]", x) is not None


def is_player(line: str) -> bool:
    """A line of a player's or a caption menu's interface; markdown.is_player for one value."""
    low = line.lower()
    count = lambda words: sum(w in low for w in words)
    if _GLUED.search(line):
        return True
    if _sentence(line):
        return False
    percents = len(re.findall(r"\b\d{1,3}%(?=\w)", line))
    hits = count(fixed.INTERFACE)
    return (len(line) >= 90 and (hits >= 4 or (hits >= 3 and count(fixed.COLORS) >= 3))) or (percents >= 2 and ("font" in low or "opacity" in low))


def pick_title(page: Page) -> str | None:
    """Best of the first heading, meta titles and headlines, the JSON-LD headline and the title, by marks for its place, its length and its signs; the first of equals."""
    found = [(t, 2.0) for t in page.h1[:1]] + [(v, 0.0) for k, v in page.meta.items() if "title" in k or "headline" in k] + [(_ld(page, ("headline", "name", "title")), 0.0), (page.title, 0.0)]
    best: tuple[float, str] | None = None
    for raw, points in found:
        t = _site_off(_clean(raw))
        if len(t) < 8 or any(n in t.lower() for n in fixed.TITLE_NOISE) or is_player(t):
            continue
        points += -2.0 if len(t) > 120 else -1.0 if len(t) > 90 else 0.0
        points += min(1.5, 1.5 * len(re.findall(fixed.WORDLIKE[:-1], t)) / len(t)) - 0.7 * t.count("|") - 0.5 * t.count(" - ")
        if best is None or points > best[0]:
            best = (points, t)
    return best[1] if best else None


def pick_description(page: Page) -> str | None:
    """The best meta description, summary or abstract; else the JSON-LD's; else the first paragraph of 80 characters in an article, a main part, a part of that role, or,
    if the page has none of these, the body. At most 240 characters."""
    best: tuple[float, str] | None = None
    for d in (_plain(v) for k, v in page.meta.items() if "description" in k or "summary" in k or "abstract" in k):
        if 40 <= len(d) <= 1200:
            points = (1.0 if _sentence(d) else 0.0) + (1.0 if 80 <= len(d) <= 240 else 0.0) - (0.5 if len(d) > 400 else 0.0)
            if best is None or points > best[0]:
                best = (points, d)
    first = next((t for c in ((1, 2, 3) if page.contained else (0,)) for kind, where, t in page.blocks if kind == "p" and where == c and len(t) >= 80), None)
    told = best[1] if best else _plain(_ld(page, ("description", "abstract"))) or _plain(first)
    return told[:240].rstrip() or None


def main_text(page: Page) -> str:
    """Blocks of the main part, or of the whole page if it has none, a line each."""
    inner = [t for _, where, t in page.blocks if where]
    return "\n".join(inner or [t for _, _, t in page.blocks])


def read(html: str | None) -> Page:
    page = Page()
    page.feed(html or "")
    return page.done()


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """Adds title, description, main_text and n_blocks to every row; null and empty pages have null titles and empty texts."""
    new = ["title", "description", "main_text", "n_blocks"]
    keep = [c for c in df.columns if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = [read(x) for x in b.column(html).to_pylist()]
            cols = [pa.array([pick_title(p) for p in pages], pa.string()), pa.array([pick_description(p) for p in pages], pa.string()), pa.array([main_text(p) for p in pages], pa.string()), pa.array([len(p.blocks) for p in pages], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + cols, names=[*keep, *new])

    fields = [df.schema[k] for k in keep] + [T.StructField(n, T.StringType()) for n in new[:3]] + [T.StructField("n_blocks", T.LongType())]
    return df.select(*dict.fromkeys([*keep, html])).mapInArrow(run, T.StructType(fields))
