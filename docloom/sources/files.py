"""Files of any supported format as rows of located text blocks."""

from __future__ import annotations

import csv
import hashlib
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.captions import caption_lines, paragraphs
from docloom.sources.formats import Archive, UnsafeArchive, decode_text, detect_format
from docloom.sources.markup import parse_html, parse_markdown
from docloom.sources.office import MAX_ROWS, parse_docx, parse_epub, parse_pptx, parse_xlsx, rows_text

LOCATION = ("page", "slide", "section", "sheet", "item")
SCHEMA = (
    "path string, format string, sha256 string, size long, access_status string, metadata map<string,string>, "
    "blocks array<struct<text:string,page:int,slide:int,section:string,sheet:string,item:string>>, tables array<array<array<string>>>, "
    "links array<string>, refs array<string>, limitations array<string>"
)
URL = re.compile(r"https?://[^\s<>\"')\]]+")
REFS = (("doi", re.compile(r"\b10\.\d{4,9}/[^\s\"<>]+"), 0), ("arxiv", re.compile(r"arxiv(?:\.org/(?:abs|pdf)/|:)\s*(\d{4}\.\d{4,5})", re.I), 1), ("ssrn", re.compile(r"ssrn[^\d]{0,30}(\d{6,8})", re.I), 1))
PACKAGES = {"docx": parse_docx, "pptx": parse_pptx, "xlsx": parse_xlsx, "epub": parse_epub}
ARCHIVE_MEMBERS = 200


def _plain(blocks: list[str | None], **more) -> dict:
    return {"metadata": {}, "blocks": [{"text": b} for b in blocks], "links": [], "tables": [], "limitations": [], **more}


def _csv(text: str) -> dict:
    try:
        dialect = csv.Sniffer().sniff(text[:4096])
    except csv.Error:
        dialect = csv.excel
    rows, notes = [], []
    for row in csv.reader(io.StringIO(text), dialect):
        if len(rows) == MAX_ROWS:
            notes.append(f"TRUNCATED: first {MAX_ROWS} rows")
            break
        rows.append([c.strip() for c in row])
    return {**_plain([]), "blocks": [{"text": rows_text(rows), "sheet": "csv"}], "tables": [rows], "limitations": notes}


def _archive(data: bytes) -> dict:
    """Members of an archive, one level deep; their name goes before their own location."""
    z, out, parsed = Archive(data), _plain([]), 0
    for name in z.names:
        member = z.read(name)
        fmt = detect_format(name, member)
        if fmt in ("zip", "unknown", "doc", "rtf", "odt", "ppt", "xls", "mobi", "azw", "azw3", "image", "audio", "video", "pdf"):
            out["limitations"].append(f"SKIPPED_MEMBER: {name} ({fmt})")
        elif parsed == ARCHIVE_MEMBERS:
            out["limitations"].append(f"TRUNCATED: first {ARCHIVE_MEMBERS} members")
            break
        else:
            parsed += 1
            sub = parse_file(name, member)
            out["blocks"] += [{**b, "item": f"{name} {b['item']}" if b.get("item") else name} for b in sub["blocks"]]
            out["tables"] += sub["tables"]
            out["links"] += sub["links"]
            out["limitations"] += [f"{name}: {x}" for x in sub["limitations"]]
    return out


def parse_file(path: str | None, data: bytes, content_type: str | None = None) -> dict:
    """One file as a row of SCHEMA. Whatever fails becomes a limitation; a format is never guessed at."""
    fmt = detect_format(path, data, content_type)
    status, note = "OK", None
    try:
        if fmt in PACKAGES:
            out = PACKAGES[fmt](Archive(data))
        elif fmt == "zip":
            out = _archive(data)
        elif fmt in ("html", "md", "csv", "vtt", "txt", "json", "xml", "code"):
            text, note = decode_text(data)
            if fmt == "html":
                page = parse_html(text, path if path and re.match(r"https?:", path) else None)
                out = {**page, "blocks": [{"text": t, "section": s} for t, s in page["blocks"]], "limitations": []}
            elif fmt == "md":
                page = parse_markdown(text)
                out = {**page, "blocks": [{"text": t, "section": s} for t, s in page["blocks"]], "links": URL.findall(text), "limitations": []}
            elif fmt == "csv":
                out = _csv(text)
            elif fmt == "vtt":
                out = _plain(paragraphs(caption_lines(text)))
            else:
                out = _plain([text], links=URL.findall(text))
        else:
            status, out = "UNSUPPORTED_FORMAT", _plain([], limitations=[f"UNSUPPORTED_FORMAT: {fmt}"])
    except UnsafeArchive as e:
        status, out = "ERROR", _plain([], limitations=[f"UNSAFE_ARCHIVE: {e}"])
    except Exception as e:
        status, out = "ERROR", _plain([], limitations=[f"PARSE_ERROR: {type(e).__name__}: {str(e)[:200]}"])
    if note:
        out["limitations"].append(note)
    links = list(dict.fromkeys(x for x in out["links"] if x))
    text = "\n".join([b["text"] or "" for b in out["blocks"]] + links)
    refs = sorted({f"{kind}:{m[group].rstrip('.,;')}" for kind, rx, group in REFS for m in rx.finditer(text)})
    return {
        "path": path, "format": fmt, "sha256": hashlib.sha256(data).hexdigest(), "size": len(data), "access_status": out.get("access_status", status), "metadata": out["metadata"],
        "blocks": [{"text": b["text"], **{k: b.get(k) for k in LOCATION}} for b in out["blocks"]], "tables": out["tables"], "links": links, "refs": refs, "limitations": list(dict.fromkeys(out["limitations"])),
    }


def parse_files(files: DataFrame, max_bytes: int = 200 << 20) -> DataFrame:
    """Rows of SCHEMA for ``files`` (path string, content binary), as ``spark.read.format("binaryFile")`` gives them.

    Null or empty contents give an unsupported or empty result; files above ``max_bytes`` are reported, not read; repeated
    files are parsed each; an empty input gives no rows; other columns are ignored.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [parse_file(p, bytes(c) if c is not None else b"") for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("path", "format", "sha256", "size", "access_status", "metadata", "blocks", "tables", "links", "refs", "limitations")])

    small = files.where(F.coalesce(F.length("content"), F.lit(0)) <= max_bytes).select("path", "content")
    big = files.where(F.length("content") > max_bytes)
    none = lambda kind: F.lit(None).cast(kind)
    too_big = big.select("path", none("string").alias("format"), none("string").alias("sha256"), F.length("content").cast("long").alias("size"), F.lit("ERROR").alias("access_status"), none("map<string,string>").alias("metadata"), none("array<struct<text:string,page:int,slide:int,section:string,sheet:string,item:string>>").alias("blocks"), none("array<array<array<string>>>").alias("tables"), none("array<string>").alias("links"), none("array<string>").alias("refs"), F.array(F.lit("FILE_TOO_LARGE")).alias("limitations"))
    return small.mapInPandas(parse, SCHEMA).unionByName(too_big)


def candidate_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files below ``folder`` without those in hidden or build folders, with size, time and hash; bodies stay unread by
    queries that drop them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    skip = r"/(?:\.[^/]+|__pycache__|node_modules|venv|build|dist)/"
    return files.where(~F.col("path").rlike(skip) & ~F.col("path").rlike(r"/\.[^/]+$")).withColumn("sha256", F.sha2("content", 256))


def scan_changes(known: DataFrame, files: DataFrame) -> DataFrame:
    """(path, state): added, updated (other hash), unchanged, touched (other time or size, same hash) or gone.

    ``known`` and ``files``: path, length, modificationTime, sha256; one row a path.
    """
    k, f = known.select("path", *[F.col(c).alias(f"k_{c}") for c in ("length", "modificationTime", "sha256")]), files.select("path", "length", "modificationTime", "sha256")
    same = (F.col("length") == F.col("k_length")) & (F.col("modificationTime") == F.col("k_modificationTime"))
    state = F.when(F.col("k_length").isNull(), "added").when(F.col("length").isNull(), "gone").when(same, "unchanged").when(F.col("sha256") == F.col("k_sha256"), "touched").otherwise("updated")
    return k.join(f, "path", "full").select("path", state.alias("state"))


def parse_source_list(lines: DataFrame) -> DataFrame:
    """Sources listed one a line (column value, with line number ``line``): kind, target, title, n and problem.

    '#' begins a comment; options follow '|': n:25 (1 to 200) or a title of at most 300 characters.
    """
    raw = F.trim(F.regexp_replace("value", "^﻿", ""))
    rows = lines.withColumn("raw", raw).where("raw <> '' AND NOT startswith(raw, '#')")
    parts = F.transform(F.split("raw", r"\|"), lambda p: F.trim(p))
    rows = rows.withColumns({"main": F.regexp_replace(F.get(parts, F.lit(0)), '^"|"$', ""), "opts": F.slice(parts, 2, 1000)})
    number = F.get(F.filter(F.transform("opts", lambda o: F.regexp_extract(o, r"(?i)^n\s*:\s*(\d+)$", 1)), lambda x: x != ""), F.lit(0))
    title = F.get(F.filter("opts", lambda o: (o != "") & ~o.rlike(r"(?i)^n\s*:\s*\d+$")), F.lit(0))
    video = F.regexp_extract("main", r"(?i)(?:youtube\.com/watch\?(?:.*&)?v=|youtu\.be/|youtube\.com/shorts/)([\w\-]{11})", 1)
    channel = F.regexp_extract("main", r"(?i)youtube\.com/(@[\w.\-]+|channel/UC[\w\-]{22}|c/[\w.\-]+|user/[\w.\-]+)", 1)
    web = F.col("main").rlike(r"(?i)^https?://")
    kind = F.when(F.col("main") == "", None).when(web & (video != ""), "youtube_video").when(web & (channel != ""), "youtube_channel").when(web, "url").when(F.col("main").rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), None).otherwise("path")
    target = F.when(kind == "youtube_video", video).when(kind == "youtube_channel", channel).otherwise(F.col("main"))
    n = F.when(kind == "youtube_channel", F.greatest(F.lit(1), F.least(F.lit(200), F.coalesce(number.try_cast("int"), F.lit(10)))))
    problem = F.when(F.col("main") == "", "empty source").when(kind.isNull(), "only http(s) links are supported")
    return rows.select("line", kind.alias("kind"), F.when(kind.isNotNull(), target).alias("target"), F.substring(title, 1, 300).alias("title"), n.alias("n"), problem.alias("problem"))
