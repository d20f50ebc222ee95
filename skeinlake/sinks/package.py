"""Web-archive packages: one ZIP file, staged beside its destination and published without overwriting."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import BinaryIO

SAFE = re.compile(r"(?!.*\\)(?!(?:.*/)?\.{0,2}(?:/|\Z)).+", re.DOTALL)
NAME = re.compile(r"[a-z0-9._-]+")
WARC_PATH, INDEX_PATH = re.compile(r"archive/[^/]+\.warc(\.gz)?"), re.compile(r"indexes/[^/]+\.cdxj?(\.gz)?")
MANIFEST, DIGEST = "datapackage.json", "datapackage-digest.json"
PAGES_FORMAT = "json-pages-1.0"
ROLES = frozenset(("author", "publisher", "maintainer", "wrangler", "contributor"))
MODELLED = ("profile", "wacz_version", "resources", "name", "id", "title", "description", "keywords", "homepage", "image", "version", "sources", "licenses", "contributors",
            "created", "modified", "software", "mainPageUrl", "mainPageDate")


class PackageError(ValueError):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class WriterOptions:
    """Levels of the ZIP file above 9 ask for a compressor that the standard library lacks; they count as 9."""

    page_id_length: int = 24
    zipnum_lines: int | None = None
    zip_level: int = 6
    gzip_level: int = 6

    def __post_init__(self) -> None:
        for ok, code in ((1 <= self.zip_level <= 264, "ZIP_LEVEL"), (0 <= self.gzip_level <= 9, "GZIP_LEVEL"), (self.zipnum_lines is None or self.zipnum_lines > 0, "ZIPNUM_LINES"),
                         (self.page_id_length > 0, "PAGE_ID_LENGTH")):
            if not ok:
                raise PackageError(code)


def safe(path: str) -> bool:
    return "\\" not in path and all(s not in ("", ".", "..") for s in path.split("/"))


def resource_name(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "extra-pages.jsonl" if name == "extraPages.jsonl" else name


@dataclass
class PackageWriter:
    """Members go in one after the other; a failed one makes the writer unusable. ``finish`` publishes."""

    dest: str | BinaryIO
    options: WriterOptions = field(default_factory=WriterOptions)

    def __post_init__(self) -> None:
        self._resources: list[dict] = []
        self._poisoned = False
        self._temp = None
        if not isinstance(self.dest, str):  # a seekable stream of the caller's, which stays open
            self._file = self.dest
            self._zip = zipfile.ZipFile(self._file, "w", allowZip64=True)
            return
        if not self.dest.endswith(".wacz"):
            raise PackageError("EXTENSION", self.dest)
        if os.path.exists(self.dest):
            raise PackageError("EXISTS", self.dest)
        fd, self._temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(self.dest)), suffix=".partial")
        self._file = os.fdopen(fd, "w+b")
        self._zip = zipfile.ZipFile(self._file, "w", allowZip64=True)

    def __enter__(self) -> PackageWriter:
        return self

    def __exit__(self, *_: object) -> None:
        self.discard()

    def discard(self) -> None:
        if self._zip.fp is not None:
            try:
                self._zip.close()
            except ValueError:  # a member was still open
                self._zip.fp = None
        if self._temp is None:
            return
        self._file.close()
        if os.path.exists(self._temp):
            os.unlink(self._temp)

    def add(self, path: str, chunks: Iterable[bytes], name: str | None = None) -> dict:
        """One member from a stream of bytes; its digest and size are taken on the way."""
        if self._poisoned:
            raise PackageError("POISONED")
        name = name or resource_name(path)
        if not safe(path) or path in (MANIFEST, DIGEST):
            raise PackageError("PATH", path)
        if not NAME.fullmatch(name) or any(r["path"] == path or r["name"] == name for r in self._resources):
            raise PackageError("NAME", path)
        info = zipfile.ZipInfo(path, datetime.now(UTC).timetuple()[:6])
        stored = path.startswith("archive/") or path.endswith(".gz")
        info.compress_type = zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED
        if not stored:
            info.compress_level = min(self.options.zip_level, 9)
        digest, size = hashlib.sha256(), 0
        self._poisoned = True
        with self._zip.open(info, "w", force_zip64=True) as out:
            for c in chunks:
                out.write(c)
                digest.update(c)
                size += len(c)
        self._poisoned = False
        at = {"name": name, "path": path, "hash": "sha256:" + digest.hexdigest(), "bytes": size}
        self._resources.append(at)
        return at

    def add_resource(self, path: str, chunks: Iterable[bytes], name: str | None = None) -> dict:
        """A resource of the caller's own; the folders of WARCs, indexes and page lists are refused."""
        if path.startswith(("archive/", "indexes/", "pages/")):
            raise PackageError("RESERVED_PREFIX", path)
        return self.add(path, chunks, name)

    def add_warc(self, source: str | Iterable[bytes], name: str | None = None) -> dict:
        """WARC bytes as they are, from a file under its own name or from chunks under ``name``."""
        if isinstance(source, str):
            with open(source, "rb") as f:
                return self._warc(name or os.path.basename(source), iter(lambda: f.read(1 << 20), b""))
        return self._warc(name or "", source)

    def _warc(self, name: str, chunks: Iterable[bytes]) -> dict:
        if "/" in name or not name.endswith((".warc", ".warc.gz")) or name.startswith("."):
            raise PackageError("WARC_NAME", name)
        return self.add(f"archive/{name}", chunks)

    def write_records(self, name: str, records: Iterable[bytes]) -> list[tuple[int, int, str]]:
        """A WARC member from whole records; (offset, length, digest) of the stored bytes of each. For ``.warc.gz`` each record
        is a gzip member of its own."""
        from skeinlake.sources.formats import gzip_member

        placed: list[tuple[int, int, str]] = []

        def chunks() -> Iterator[bytes]:
            at = 0
            for r in records:
                stored = gzip_member(r, self.options.gzip_level) if name.endswith(".gz") else r
                placed.append((at, len(stored), "sha256:" + hashlib.sha256(stored).hexdigest()))
                at += len(stored)
                yield stored

        self._warc(name, chunks())
        return placed

    def add_page_list_file(self, path: str, text: BinaryIO) -> dict:
        """A page list that is rendered already, from the stream's position on. It is checked to its end before a byte is written."""
        from skeinlake.sources.readers import page_row

        if not path.startswith("pages/") or "/" in path[6:] or not path.endswith(".jsonl"):
            raise PackageError("PAGES_NAME", path)
        start, n = text.tell(), 0
        for n, raw in enumerate(iter(text.readline, b""), 1):
            line = raw.decode().rstrip("\r\n")
            if not line.strip() or page_row("", path, n, line, n == 1, strict=True)[-1]:
                raise PackageError("PAGE_LINE", str(n))
        if not n:
            raise PackageError("PAGE_LINE", "0")
        text.seek(start)
        return self.add(path, iter(lambda: text.read(1 << 20), b""))

    def add_sorted_index_file(self, name: str, text: BinaryIO) -> dict:
        """An index whose lines are in order already, from the stream's position on; repetitions stay. It is checked to its end
        before a byte is written."""
        if "/" in name or not safe(name) or not name.endswith(".cdx"):
            raise PackageError("INDEX_NAME", name)
        start = text.tell()
        for _ in sorted_index(raw.decode().rstrip("\n") for raw in iter(text.readline, b"")):
            pass
        text.seek(start)
        return self.add(f"indexes/{name}", iter(lambda: text.read(1 << 20), b""))

    def finish(self, metadata: dict | None = None) -> dict:
        """Writes manifest and digest and publishes. Needs a WARC, an index and a page list."""
        paths = [r["path"] for r in self._resources]
        for code, ok in (("MISSING_WARC", any(WARC_PATH.fullmatch(p) for p in paths)), ("MISSING_INDEX", any(INDEX_PATH.fullmatch(p) for p in paths)), ("MISSING_PAGES", "pages/pages.jsonl" in paths)):
            if not ok:
                raise PackageError(code)
        if self._poisoned:
            raise PackageError("POISONED")
        metadata = {k: v for k, v in (metadata or {}).items() if v is not None}
        now = datetime.now(UTC)
        created = metadata.setdefault("created", now.strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z")
        metadata.setdefault("modified", created)
        metadata.setdefault("software", "skeinlake")
        manifest = {"profile": "data-package", "wacz_version": "1.1.1", "resources": self._resources}
        manifest |= {k: metadata[k] for k in MODELLED if k in metadata and k not in manifest} | {k: v for k, v in metadata.items() if k not in MODELLED}
        raw = json.dumps(manifest, indent=2, ensure_ascii=False).encode()
        level = min(self.options.zip_level, 9)
        self._zip.writestr(MANIFEST, raw, zipfile.ZIP_DEFLATED, level)
        self._zip.writestr(DIGEST, json.dumps({"path": MANIFEST, "hash": "sha256:" + hashlib.sha256(raw).hexdigest()}, indent=2), zipfile.ZIP_DEFLATED, level)
        self._zip.close()
        self._file.flush()
        if self._temp is None:
            return manifest
        os.fsync(self._file.fileno())
        self._file.close()
        try:
            os.link(self._temp, self.dest)  # fails where the destination exists
        except FileExistsError as e:
            raise PackageError("EXISTS", self.dest) from e
        finally:
            os.unlink(self._temp)
        return manifest


def page_list(pages: Iterable[dict], page_id_length: int = 24, check: bool = False, **header: str) -> Iterator[bytes]:
    """Header line and one line a page; pages without id get a synthetic one. With ``check`` all pages are checked before the
    first byte comes out, so they must be a list; else each before its own line."""
    rows = list(pages) if check else pages
    for p in rows if check else ():
        _page(p, page_id_length)
    yield (json.dumps({"format": PAGES_FORMAT, **header}, ensure_ascii=False) + "\n").encode()
    for p in rows:
        yield _page(p, page_id_length)


def _page(p: dict, page_id_length: int) -> bytes:
    if not p.get("url") or not p.get("ts"):
        raise PackageError("PAGE", str(p)[:100])
    made = hashlib.sha256((p["ts"] + p["url"]).encode()).hexdigest()[: min(page_id_length, 64)]
    row = {"url": p["url"], "ts": p["ts"], "id": p.get("id") or made, **{k: p[k] for k in ("title", "text", "size") if p.get(k) is not None}}
    row |= {k: v for k, v in (p.get("extra") or {}).items() if k not in row}
    return (json.dumps(row, ensure_ascii=False) + "\n").encode()


def sorted_index(lines: Iterable[str]) -> Iterator[bytes]:
    """Lines that are in order already, checked on the way; repetitions stay."""
    from skeinlake.sources.formats import conforming, parse_index_line

    before = None
    for n, line in enumerate(lines, 1):
        at = parse_index_line(line)
        if at is None or not conforming(at[2]):
            raise PackageError("INDEX_LINE", str(n))
        if before is not None and before > at[:2]:
            raise PackageError("INDEX_ORDER", str(n))
        before = at[:2]
        yield line.encode() + b"\n"
