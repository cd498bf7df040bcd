"""Recognition of file formats by content, declared type and name, and guarded opening of archives."""

from __future__ import annotations

import io
import posixpath
import stat
import zipfile
from dataclasses import dataclass

# Formats by file extension.
FORMAT_OF = {
    "txt": "txt", "text": "txt", "log": "txt", "rst": "txt", "md": "md", "markdown": "md", "json": "json",
    "ipynb": "json", "xml": "xml", "rss": "xml", "atom": "xml", "py": "code", "r": "code", "pine": "code",
    "mq4": "code", "mq5": "code", "mqh": "code", "cpp": "code", "h": "code", "js": "code", "ts": "code",
    "html": "html", "htm": "html", "xhtml": "html", "pdf": "pdf", "docx": "docx", "docm": "docx", "pptx": "pptx",
    "pptm": "pptx", "csv": "csv", "xlsx": "xlsx", "xlsm": "xlsx", "epub": "epub", "zip": "zip", "vtt": "vtt",
    "srt": "vtt", "doc": "doc", "rtf": "rtf", "odt": "odt", "ppt": "ppt", "xls": "xls", "mobi": "mobi", "azw": "azw",
    "azw3": "azw3", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image", "tif": "image", "tiff": "image",
    "mp3": "audio", "wav": "audio", "m4a": "audio", "aac": "audio", "flac": "audio", "ogg": "audio", "mp4": "video",
    "mov": "video", "mkv": "video", "webm": "video", "avi": "video", "m4v": "video",
}
TYPES = {"application/pdf": "pdf", "application/json": "json", "application/xml": "xml", "text/xml": "xml", "application/rss+xml": "xml", "application/atom+xml": "xml"}
PACKAGES = (("docx", "word/document.xml"), ("pptx", "ppt/presentation.xml"), ("xlsx", "xl/workbook.xml"))


class UnsafeArchive(ValueError):
    """An archive that breaks a limit or names a path outside itself."""


@dataclass(frozen=True)
class Limits:
    members: int = 2000
    total: int = 300 << 20
    member: int = 100 << 20
    ratio: float = 200.0


class Archive:
    """A ZIP file in memory whose members were checked before any is read."""

    def __init__(self, data: bytes, limits: Limits = Limits()) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise UnsafeArchive(f"no valid archive: {e}") from e
        self.limits, infos = limits, self.zip.infolist()
        if len(infos) > limits.members:
            raise UnsafeArchive(f"{len(infos)} members")
        for i in infos:
            path = i.filename.replace("\\", "/")
            if path.startswith("/") or path[1:2] == ":" or ".." in path.split("/"):
                raise UnsafeArchive(f"path outside the archive: {i.filename!r}")
            if stat.S_ISLNK(i.external_attr >> 16):
                raise UnsafeArchive(f"link: {i.filename!r}")
            if i.file_size > limits.member or (i.compress_size and i.file_size / i.compress_size > limits.ratio):
                raise UnsafeArchive(f"member expands too far: {i.filename!r}")
        if sum(i.file_size for i in infos) > limits.total:
            raise UnsafeArchive("expands too far")
        self.names = [i.filename for i in infos if not i.is_dir()]

    def read(self, name: str) -> bytes:
        with self.zip.open(name) as member:  # headers may state less than there is
            data = member.read(self.limits.member + 1)
        if len(data) > self.limits.member:
            raise UnsafeArchive(f"member expands too far: {name!r}")
        return data


def detect_format(name: str | None, data: bytes, content_type: str | None = None) -> str:
    """Content first, since names and declared types may be wrong; then the declared type, then the name's extension."""
    if data.startswith(b"%PDF-"):
        return "pdf"
    if data.startswith(b"PK\x03\x04"):
        try:
            names = set(Archive(data).names)
        except UnsafeArchive:
            return "zip"
        if {"mimetype", "META-INF/container.xml"} <= names:
            return "epub"
        return next((fmt for fmt, part in PACKAGES if part in names), "zip")
    declared = (content_type or "").split(";")[0].strip().lower()
    head = data[:1024].lstrip().lower()
    if declared in ("text/html", "application/xhtml+xml") or head.startswith((b"<!doctype html", b"<html")):
        return "html"
    if head.startswith(b"webvtt"):
        return "vtt"
    if declared == "application/pdf":
        return "pdf"
    ext = posixpath.splitext(name or "")[1][1:].lower()
    return FORMAT_OF.get(ext) or TYPES.get(declared) or ("txt" if declared.startswith("text/") else "unknown")


def decode_text(data: bytes) -> tuple[str, str | None]:
    """Text of ``data`` and a note where it had to be guessed."""
    for codec in ("utf-8-sig", "utf-16") if data[:2] in (b"\xff\xfe", b"\xfe\xff") else ("utf-8-sig",):
        try:
            return data.decode(codec), None
        except UnicodeDecodeError:
            continue
    return data.decode("cp1252", errors="replace"), "ENCODING_FALLBACK: read as cp1252"
