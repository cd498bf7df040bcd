"""HTML and Markdown as blocks of text with their section, links, tables and metadata; standard library only."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

HIDDEN = {"script", "style", "noscript", "template", "svg", "iframe", "form", "button"}
FURNITURE = {"nav", "footer", "aside", "header"}
BLOCKS = {"p", "li", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "dd", "dt", "figcaption", "div", "section", "article", "main", "body", "table", "tr", "ul", "ol", "dl", "figure"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"br", "img", "meta", "link", "input", "hr", "source", "wbr", "col", "area", "base", "embed", "track", "param"}
# Names under which pages state their metadata, the best first.
META = {
    "title": ("citation_title", "dc.title", "og:title", "twitter:title"),
    "author": ("citation_author", "author", "dc.creator", "article:author"),
    "publication_date": ("citation_publication_date", "citation_date", "article:published_time", "dc.date", "date", "pubdate"),
}


class Page(HTMLParser):
    """Collects text in document order. Regions are kept apart, so that an article or main element can be preferred."""

    def __init__(self, base: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.meta, self.title = base or "", {}, ""
        self.stack: list[str] = []
        self.buffer: list[str] = []
        self.blocks: list[tuple[str, str, str | None, frozenset[str]]] = []
        self.links: list[tuple[str, frozenset[str]]] = []
        self.tables: list[tuple[list[list[str]], frozenset[str]]] = []
        self.open_tables: list[list[list[str]]] = []

    def around(self) -> frozenset[str]:
        return frozenset(t for t in self.stack if t in ("article", "main", "body") or t in FURNITURE)

    def flush(self, tag: str | None = None) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        if text:
            kind = next((t for t in reversed(self.stack) if t in HEADINGS), "")
            self.blocks.append((text, kind, tag, self.around()))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name, content = (a.get("name") or a.get("property") or "").lower(), a.get("content", "").strip()
            if content:
                self.meta.setdefault(name, []).append(content)
        if tag in ("br", "a"):
            self.buffer.append(" ")
        if tag in BLOCKS:
            self.flush()
        if tag == "p" and "p" in self.stack:
            self._close("p")
        if tag == "li" and self.stack[-1:] == ["li"]:
            self._close("li")
        if tag == "table":
            self.open_tables.append([])
        if self.open_tables and tag == "tr":
            self.open_tables[-1].append([])
        if self.open_tables and tag in ("td", "th"):
            if not self.open_tables[-1]:
                self.open_tables[-1].append([])
            self.open_tables[-1][-1].append("")
        if tag == "a" and (href := a.get("href", "").strip()) and not href.startswith(("javascript:", "mailto:", "#", "data:")):
            self.links.append((urljoin(self.base, href), self.around()))
        if tag not in VOID:
            self.stack.append(tag)

    def _close(self, tag: str) -> None:
        while self.stack and self.stack.pop() != tag:
            pass

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        if tag in BLOCKS:
            self.flush()
        if tag == "table" and self.open_tables:
            rows = [r for r in self.open_tables.pop() if any(r)]
            if rows:
                self.tables.append((rows, self.around()))
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.stack[-1:] == ["title"]:
            self.title += data
        elif not HIDDEN.intersection(self.stack):
            self.buffer.append(data)
            if self.open_tables and self.open_tables[-1] and self.open_tables[-1][-1]:
                cell = self.open_tables[-1][-1]
                cell[-1] = " ".join((cell[-1] + " " + data).split())


def parse_html(text: str, base: str | None = None) -> dict:
    """metadata, blocks [(text, section)], links and tables of a page, of its article or main element where it has one."""
    page = Page(base)
    page.feed(text)
    page.close()
    page.flush()
    meta = {}
    for key, names in META.items():
        values = next((page.meta[n] for n in names if page.meta.get(n)), [])
        if values:
            meta[key] = "; ".join(dict.fromkeys(values)) if key == "author" else values[0]
    if "title" not in meta and page.title.strip():
        meta["title"] = " ".join(page.title.split())
    region = next((r for r in ("article", "main") if any(r in around for *_, around in page.blocks)), None)
    inside = lambda around: (region is None or region in around) and not around & FURNITURE
    blocks, section = [], None
    for said, heading, _, around in page.blocks:
        if inside(around):
            section = said[:200] if heading else section
            blocks.append((said, section))
    links = page.meta.get("citation_pdf_url", []) + [u for u, around in page.links if inside(around)]
    return {"metadata": meta, "blocks": blocks, "links": list(dict.fromkeys(links)), "tables": [rows for rows, around in page.tables if inside(around)]}


def parse_markdown(text: str) -> dict:
    """Blocks split before each heading, whose text is the section; the first heading of level one is the title."""
    meta, blocks, section, start = {}, [], None, 0
    lines = text.splitlines()
    heads = [(k, m) for k, line in enumerate(lines) if (m := re.match(r"^(#{1,6})\s+(.+?)\s*#*$", line))]
    for k, m in [*heads, (len(lines), None)]:
        body = "\n".join(lines[start:k]).strip()
        if body:
            blocks.append((body, section))
        if m:
            section, start = m[2], k
            if len(m[1]) == 1:
                meta.setdefault("title", section)
    return {"metadata": meta, "blocks": blocks, "links": [], "tables": []}
