"""Web pages as clean HTML, Markdown and article fields, by the standard parser inside Arrow-batched functions.

A page is parsed to a small tree once a row; null pages give nulls, broken markup is closed where it ends.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements without a place in an article, elements without an end, and blanks that become spaces (fixed values).
DROPPED = {"script", "style", "iframe", "noscript", "input", "button", "form", "svg", "img", "figure", "picture", "nav", "footer"}
SKIPPED_CLASSES = ("nota-incrustada", "component", "social-embed", "tags-container", "author-info")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLANKS = str.maketrans(dict.fromkeys("\xa0\u2009\u200a\u202f", " "))
KEPT = ("id", "class")
#: Spanish month names by their first three letters (fixed values).
MONTHS = {"ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "sep": 9, "oct": 10, "nov": 11, "dic": 12}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parts: list = field(default_factory=list)

    def text(self) -> str:
        return "".join(p if isinstance(p, str) else p.text() for p in self.parts)

    def walk(self):
        yield self
        for p in self.parts:
            if isinstance(p, Node):
                yield from p.walk()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def tree(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


def _cleaned(node: Node) -> list:
    """The parts of a node without dropped elements; font elements dissolve, empty elements go."""
    out: list = []
    for p in node.parts:
        if isinstance(p, str):
            out.append(p.translate(BLANKS))
        elif p.tag not in DROPPED:
            inner = _cleaned(p)
            if p.tag == "font":
                out += inner
            elif any(not isinstance(x, str) or x.strip() for x in inner):
                keep = {k: v for k, v in p.attrs.items() if k in KEPT or (k == "href" and p.tag == "a")}
                out.append(Node(p.tag, keep, inner))
    return out


def _markup(parts: list) -> str:
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(escape(p, quote=False))
        else:
            attrs = "".join(f' {k}="{escape(v)}"' for k, v in p.attrs.items())
            out.append(f"<{p.tag}{attrs}>" + ("" if p.tag in VOID else f"{_markup(p.parts)}</{p.tag}>"))
    return "".join(out)


def clean_html(page: str | None) -> str | None:
    """The page's body without scripts, comments, furniture elements, presentation attributes and empty elements."""
    if page is None:
        return None
    root = tree(page)
    body = next((n for n in root.walk() if n.tag == "body"), root)
    return _markup(_cleaned(body)).strip()


def inline(node: Node) -> str:
    """The text of a node with ** for strong, * for emphasis and links as bold links; blanks move outside the marks."""
    out = []
    for p in node.parts:
        if isinstance(p, str):
            out.append(p)
            continue
        text = inline(p)
        core = text.strip()
        if core and p.tag in ("strong", "b", "em", "i", "a"):
            mark = {"strong": "**", "b": "**", "em": "*", "i": "*", "a": "**"}[p.tag]
            shown = f"[{core}]({p.attrs.get('href', '')})" if p.tag == "a" else core
            text = text[: len(text) - len(text.lstrip())] + mark + shown + mark + text[len(text.rstrip()) :]
        out.append(text)
    text = re.sub(r"\s+", " ", "".join(out).translate(BLANKS))
    return re.sub(r"\(\s+", "(", re.sub(r"\s+([.,;:!?)])", r"\1", text))


def markdown(page: str | None, path: str = "article", skipped: tuple[str, ...] = SKIPPED_CLASSES) -> str | None:
    """The paragraphs, headings, quotations and lists directly inside the first element of a path (else the body), without skipped classes."""
    if page is None:
        return None
    root = tree(page)
    home = next(iter(select(root, path)), None) or next((n for n in root.walk() if n.tag == "body"), root)
    blocks = []
    for p in home.parts:
        if isinstance(p, str) or set(p.attrs.get("class", "").split()) & set(skipped):
            continue
        text = inline(p).strip()
        if not text:
            continue
        if p.tag == "p":
            blocks.append(text)
        elif re.fullmatch(r"h[1-6]", p.tag):
            blocks.append("#" * int(p.tag[1]) + " " + text)
        elif p.tag == "blockquote":
            blocks.append("> " + text)
        elif p.tag in ("ul", "ol"):
            items = [inline(i).strip() for i in p.parts if isinstance(i, Node) and i.tag == "li"]
            blocks.append("\n".join(f"- {i if i[-1:] in '.!?…:;)]' else i + '.'}" for i in items if i))
    return "\n\n".join(blocks)


STEP = re.compile(r"(>\s*)?([a-z0-9]*)(?:#([\w-]+))?((?:\.[\w-]+)*)\s*")


def select(root: Node, path: str) -> list[Node]:
    """The elements of a path of steps ``tag#id.class``, each below the one before, or directly below it after ``>``."""
    found = [root]
    for m in STEP.finditer(path):
        if not m[0].strip():
            continue
        wanted = set(m[4].split(".")[1:])
        fits = lambda n, m=m, wanted=wanted: (not m[2] or n.tag == m[2]) and (not m[3] or n.attrs.get("id") == m[3]) and wanted <= set(n.attrs.get("class", "").split())
        below = (lambda n: [p for p in n.parts if isinstance(p, Node)]) if m[1] else (lambda n: [x for x in n.walk() if x is not n])
        unique: dict[int, Node] = {id(x): x for n in found for x in below(n) if fits(x)}
        found = list(unique.values())
    return found


def texts(page: str | None, path: str) -> list[str]:
    """The texts of the elements of a path, without the blank ones."""
    if page is None:
        return []
    return [t for n in select(tree(page), path) if (t := re.sub(r"\s+", " ", n.text().translate(BLANKS)).strip())]


DATE = re.compile(r"([a-z]{3})[a-z]*\.?\s+(\d{1,2}),\s*(\d{4})(?:\s*\|\s*(\d{1,2}):(\d{2})\s*([ap]))?", re.IGNORECASE)


def site_date(text: str | None) -> str:
    """``nov. 15, 2025 | 12:01 a. m.`` as ISO with the offset -04:00; unknown months are January, no match is the empty text."""
    m = DATE.search(text or "")
    if not m:
        return ""
    hour = int(m[4] or 0) % 12 + (12 if (m[6] or "").lower() == "p" else 0)
    return f"{m[3]}-{MONTHS.get(m[1].lower(), 1):02d}-{int(m[2]):02d}T{hour:02d}:{m[5] or '00'}:00-04:00"


#: Where the known layout keeps its fields (fixed values).
PATHS = {"title": "h1", "subtitle": "div.subtitle > p", "author": "address.author strong", "date": "time#detail-datetime", "location": "time#detail-datetime a", "content": "div.detail-body", "tags": "div.tags-container a", "breadcrumb": "ul.breadcrumb li"}


def fields(page: str | None) -> dict:
    """title, subtitle, author, date, location, content, tags and category of a page of the known layout; what it lacks is null."""
    one = lambda name: next(iter(texts(page, PATHS[name])), None)
    crumbs = texts(page, PATHS["breadcrumb"])[1:]
    return {"title": one("title"), "subtitle": one("subtitle"), "author": one("author"), "published_date": site_date(one("date")), "location": one("location"), "content": markdown(page, PATHS["content"]), "tags": texts(page, PATHS["tags"]), "category": "/".join(crumbs) or None}


FIELDS = "title string, subtitle string, author string, published_date string, location string, content string, tags array<string>, category string"
#: Layouts by domain; a domain without one has no extractor.
EXTRACTORS: dict[str, Callable[[str | None], dict]] = {"default": fields}


def _column(function: Callable, kind: str) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def batch(pages: pd.Series) -> pd.Series:
        return pages.map(function, na_action="ignore")

    return batch


def clean_html_column(page: Column) -> Column:
    return _column(clean_html, "string")(page)


def markdown_column(page: Column) -> Column:
    return _column(markdown, "string")(page)


def fields_column(page: Column, layout: str = "default") -> Column:
    extract = EXTRACTORS[layout]

    @F.pandas_udf(FIELDS)
    def batch(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(p) for p in pages], columns=[f.split()[0] for f in FIELDS.split(", ")])

    return batch(page)
