"""Word, PowerPoint, Excel and EPUB files, read from their XML parts without expanding entities."""

from __future__ import annotations

import posixpath
import re
import xml.etree.ElementTree as ET

from docloom.sources.formats import Archive, decode_text
from docloom.sources.markup import parse_html

MAX_ROWS, TEXT_ROWS = 5000, 200


def tree(data: bytes) -> ET.Element:
    """Parsed XML; documents that declare entities are refused, since none of these formats needs any."""
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", data[:4096], re.I) and re.search(rb"<!ENTITY", data, re.I):
        raise ValueError("entity declarations")
    return ET.fromstring(data)


def local(el: ET.Element) -> str:
    return el.tag.rsplit("}", 1)[-1]


def attr(el: ET.Element, name: str) -> str | None:
    return next((v for k, v in el.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def every(el: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in el.iter() if local(e) == name]


def said(el: ET.Element) -> str:
    return "".join(e.text or "" if local(e) == "t" else "\t" if local(e) == "tab" else "\n" if local(e) == "br" else "" for e in el.iter()).strip()


def core(z: Archive) -> dict:
    """Title and author that the package states."""
    if "docProps/core.xml" not in z.names:
        return {}
    root, out = tree(z.read("docProps/core.xml")), {}
    for key, name in (("title", "title"), ("author", "creator"), ("file_created_date", "created")):
        text = next((e.text.strip() for e in every(root, name) if e.text and e.text.strip()), None)
        if text:
            out[key] = text[:10] if key == "file_created_date" else text
    return out


def relations(z: Archive, part: str) -> dict[str, tuple[str, str]]:
    path = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
    if path not in z.names:
        return {}
    return {attr(r, "Id"): (attr(r, "Type") or "", attr(r, "Target") or "") for r in every(tree(z.read(path)), "Relationship")}


def links_of(z: Archive, part: str) -> list[str]:
    return [target for kind, target in relations(z, part).values() if kind.endswith("/hyperlink") and re.match(r"https?:", target)]


def macros(z: Archive) -> list[str]:
    return ["MACRO_CONTAINER: macros are not run"] if any(n.lower().endswith("vbaproject.bin") for n in z.names) else []


def parse_docx(z: Archive) -> dict:
    body, blocks, tables, section = tree(z.read("word/document.xml")), [], [], None
    in_tables = {id(p) for t in every(body, "tbl") for p in every(t, "p")}
    for p in every(body, "p"):
        text = said(p)
        if not text or id(p) in in_tables:
            continue
        style = next((attr(s, "val") or "" for s in every(p, "pStyle")), "")
        if style.lower().startswith(("heading", "title")):
            section = text[:200]
        blocks.append({"text": text, "section": section})
    for t in every(body, "tbl"):
        tables.append([[said(c) for c in every(r, "tc")] for r in every(t, "tr")])
    return {"metadata": core(z), "blocks": blocks, "links": links_of(z, "word/document.xml"), "tables": tables, "limitations": macros(z)}


def parse_pptx(z: Archive) -> dict:
    blocks, tables, links, notes = [], [], [], macros(z)
    slides = sorted((n for n in z.names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    for k, name in enumerate(slides, 1):
        root = tree(z.read(name))
        shapes = every(root, "sp")
        is_title = lambda sp: any((attr(ph, "type") or "") in ("title", "ctrTitle") for ph in every(sp, "ph"))
        text_of = lambda sp: "\n".join(t for p in every(sp, "p") if (t := said(p)))
        title = next((text_of(sp) for sp in shapes if is_title(sp)), None) or None
        for sp in shapes:
            if text := text_of(sp):
                blocks.append({"text": text, "slide": k, "section": title})
        for t in every(root, "tbl"):
            tables.append([[said(c) for c in every(r, "tc")] for r in every(t, "tr")])
        if every(root, "chart"):
            notes.append(f"UNREADABLE_CHART_DATA: slide {k}")
        links += links_of(z, name)
        for kind, target in relations(z, name).values():
            part = posixpath.normpath(posixpath.join("ppt/slides", target))
            if kind.endswith("/notesSlide") and part in z.names:
                body = [sp for sp in every(tree(z.read(part)), "sp") if any(attr(ph, "type") == "body" for ph in every(sp, "ph"))]
                if text := "\n".join(text_of(sp) for sp in body).strip():
                    blocks.append({"text": text, "slide": k, "section": title, "item": "notes"})
    return {"metadata": core(z), "blocks": blocks, "links": links, "tables": tables, "limitations": notes}


def column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def rows_text(rows: list[list[str]]) -> str:
    return "\n".join(" | ".join(r) for r in rows[:TEXT_ROWS])


def parse_xlsx(z: Archive) -> dict:
    """Cached values of each sheet; formulas are never evaluated."""
    shared = [said(si) for si in every(tree(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in z.names else []
    book, rels = tree(z.read("xl/workbook.xml")), relations(z, "xl/workbook.xml")
    blocks, tables, notes = [], [], macros(z)
    for sheet in every(book, "sheet"):
        name, target = attr(sheet, "name"), rels.get(attr(sheet, "id") or "", ("", ""))[1]
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
        if path not in z.names:
            continue
        rows: list[list[str]] = []
        for k, row in enumerate(every(tree(z.read(path)), "row")):
            if k >= MAX_ROWS:
                notes.append(f"TRUNCATED: sheet {name}: first {MAX_ROWS} rows")
                break
            cells: list[str] = []
            for c in every(row, "c"):
                value = next((v.text or "" for v in every(c, "v")), "")
                if attr(c, "t") == "s" and value.isdigit() and int(value) < len(shared):
                    value = shared[int(value)]
                elif attr(c, "t") == "inlineStr":
                    value = said(c)
                at = column(attr(c, "r") or "") if attr(c, "r") else len(cells)
                cells += [""] * (at + 1 - len(cells))
                cells[at] = value
            if any(cells):
                rows.append(cells)
        if rows:
            tables.append(rows)
            blocks.append({"text": rows_text(rows), "sheet": name})
    return {"metadata": core(z), "blocks": blocks, "links": [], "tables": tables, "limitations": notes}


def parse_epub(z: Archive) -> dict:
    """Chapters in the order of the spine; protected books are refused, not opened."""
    if {"META-INF/encryption.xml", "META-INF/rights.xml"} & set(z.names):
        return {"metadata": {}, "blocks": [], "links": [], "tables": [], "limitations": ["DRM_PROTECTED: not opened"], "access_status": "ACCESS_RESTRICTED"}
    opf = attr(every(tree(z.read("META-INF/container.xml")), "rootfile")[0], "full-path")
    root, base, meta = tree(z.read(opf)), posixpath.dirname(opf), {}
    for key, name in (("title", "title"), ("author", "creator"), ("publication_date", "date")):
        values = [e.text.strip() for e in every(root, name) if e.text and e.text.strip()]
        if values:
            meta[key] = "; ".join(values) if key == "author" else values[0]
    parts = {attr(i, "id"): attr(i, "href") for i in every(root, "item")}
    blocks, links, tables = [], [], []
    for ref in every(root, "itemref"):
        href = parts.get(attr(ref, "idref"))
        path = posixpath.normpath(posixpath.join(base, href)) if href else None
        if path in z.names:
            page = parse_html(decode_text(z.read(path))[0])
            blocks += [{"text": t, "section": s, "item": href} for t, s in page["blocks"]]
            links += page["links"]
            tables += page["tables"]
    return {"metadata": meta, "blocks": blocks, "links": links, "tables": tables, "limitations": []}
