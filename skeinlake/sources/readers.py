"""Spark data sources over the physical formats. Register them with ``register(spark)``.

``zipmembers``  the listing of packages, without content
``zipcontent``  the same with content, for a prefix; view=stored as in the ZIP, raw (default) decompressed, decoded also without gzip
``zipdigests``  members with the SHA-256 of their content, read in chunks
``warc``        records of WARC files (with option raw=true also as they stand, with their digest), or of the WARC members of packages; filters on record_type reach the reader
``cdxj``        index lines of packages; filters on key prune the blocks of block-compressed indexes
``pagelist``    page lists of packages, one row a line
Each takes ``path``: a file, a folder or a glob. One file is one partition; of block-compressed indexes
neighbouring blocks up to BLOCK_BYTES are one. ``warc`` and ``cdxj`` raise at malformed input; with option
mode=permissive they give a row with ``error``, and for ``warc`` end the member there. ``cdxj`` and ``pagelist``
pass over blank lines; with strict=true those are errors, and so are page times that are not RFC 3339.
Lines of a block are numbered in it, from 1; ``numbered_lines`` numbers them in their index.
"""

from __future__ import annotations

import glob
import hashlib
import io
import json
import os
import re
import zipfile
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from skeinlake.functions.instants import parse_instant
from skeinlake.sources import formats as W

MEMBERS = "package string, ordinal int, path string, compression string, compressed_size long, size long, crc32 long, is_dir boolean, is_duplicate boolean"
RECORDS = ("package string, member string, ordinal long, offset long, length long, record_digest string, record_type string, record_id string, warc_date string, "
           "target_uri string, headers map<string,array<string>>, refers_to string, concurrent_to array<string>, payload_digest string, identified_payload_type string, body binary, raw binary, error string")
LINES = "package string, index_path string, line_no long, line string, key string, ts_raw string, url string, digest string, mime string, status int, offset long, length long, filename string, record_digest string, extra string, block int, error string"
PAGES = "package string, list_path string, line_no long, is_header boolean, line string, url string, ts_text string, id string, title string, text string, size long, extra string, malformed boolean"
INDEX_WIDTH = len(LINES.split(", "))
#: Stored bytes of neighbouring index blocks that are one partition.
BLOCK_BYTES = 16 << 20
_INDEX_FIELDS = ("url", "digest", "mime", "status", "offset", "length", "filename", "recordDigest")


def files(path: str, suffixes: tuple[str, ...]) -> list[str]:
    path = path.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(os.path.join(path, "**"), recursive=True) if p.endswith(suffixes) and os.path.isfile(p))
    return sorted(glob.glob(path)) if any(c in path for c in "*?[") else [path]


class Part(InputPartition):
    def __init__(self, file: str, member: str = "", lo: int = 0, hi: int = 0, **more: object):
        self.file, self.member, self.lo, self.hi, self.more = file, member, lo, hi, more


def entries(z: zipfile.ZipFile) -> list[tuple[int, zipfile.ZipInfo, bool]]:
    """(ordinal, entry, repeats an earlier name) of the central directory."""
    seen: set[str] = set()
    out = []
    for i, e in enumerate(z.infolist()):
        out.append((i, e, e.filename in seen))
        seen.add(e.filename)
    return out


_COMPRESSION = {0: "stored", 8: "deflated", 12: "bzip2", 14: "lzma"}


class _Reader(DataSourceReader):
    suffixes: tuple[str, ...] = (".wacz", ".zip")

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Part]:
        return [Part(f) for f in files(self.options["path"], self.suffixes)]


class MembersReader(_Reader):
    content = False

    def read(self, part: Part) -> Iterator[tuple]:
        prefix, view = self.options.get("prefix", ""), self.options.get("view", "raw")
        with zipfile.ZipFile(part.file) as z:
            for i, e, again in entries(z):
                if not e.filename.startswith(prefix):
                    continue
                row = (part.file, i, e.filename, _COMPRESSION.get(e.compress_type, str(e.compress_type)), e.compress_size, e.file_size, e.CRC, e.is_dir(), again)
                if not self.content:
                    yield row
                    continue
                data, error = None, None
                try:
                    data = b"".join(member_chunks(z, e, view))
                except (zipfile.BadZipFile, W.FormatError, OSError, ValueError, zipfile.zlib.error) as x:
                    data, error = None, type(x).__name__
                yield (*row, data, error)


class ContentReader(MembersReader):
    content = True


class DigestReader(_Reader):
    """Members with the SHA-256 and size of their bytes, which pass by in chunks."""

    def read(self, part: Part) -> Iterator[tuple]:
        with zipfile.ZipFile(part.file) as z:
            for i, e, again in entries(z):
                if e.is_dir():
                    continue
                digest, size, error = hashlib.sha256(), 0, None
                try:
                    for chunk in member_chunks(z, e):
                        digest.update(chunk)
                        size += len(chunk)
                except (zipfile.BadZipFile, OSError, ValueError, zipfile.zlib.error) as x:
                    error = type(x).__name__
                yield part.file, i, e.filename, again, None if error else digest.hexdigest(), None if error else size, error


def member_chunks(z: zipfile.ZipFile, entry: zipfile.ZipInfo | str, view: str = "raw", size: int = 1 << 20) -> Iterator[bytes]:
    """A member's bytes in chunks: ``raw`` undoes the ZIP's compression, ``decoded`` also gzip by content, ``stored`` neither."""
    e = z.getinfo(entry) if isinstance(entry, str) else entry
    if view == "stored":
        with open(z.filename, "rb") as f:
            f.seek(e.header_offset)
            head = f.read(30)
            if head[:4] != b"PK\x03\x04":
                raise zipfile.BadZipFile("local header")
            f.seek(int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"), 1)
            left = e.compress_size
            while left > 0 and (chunk := f.read(min(size, left))):
                left -= len(chunk)
                yield chunk
        return
    with z.open(e) as s:
        if view == "decoded" and W.is_gzip(s.peek(2)[:2]):
            for _, _, data in W.iter_members(s, size):
                yield data
            return
        while chunk := s.read(size):
            yield chunk


def record_row(package: str, member: str, ordinal: int, offset: int, length: int, h: dict, body: bytes, stored: bytes | None = None) -> tuple:
    digest = "sha256:" + hashlib.sha256(stored).hexdigest() if stored is not None else None
    return (package, member, ordinal, offset, length, digest, W.one(h, "warc-type"), W.one(h, "warc-record-id"), W.one(h, "warc-date"), W.one(h, "warc-target-uri"), h,
            W.one(h, "warc-refers-to"), h.get("warc-concurrent-to", []), W.one(h, "warc-payload-digest"), W.one(h, "warc-identified-payload-type"), body, stored, None)


def error_row(width: int, code: str, *first: object) -> tuple:
    """A row that holds ``first`` and, in its last place, ``code``."""
    return (*first, *[None] * (width - len(first) - 1), code)


class WarcReader(_Reader):
    suffixes = (".wacz", ".zip", ".warc", ".warc.gz")
    kinds: frozenset[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            at = getattr(f, "attribute", None)
            if at == ("record_type",) and isinstance(f, EqualTo | In):
                found = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.kinds = found if self.kinds is None else self.kinds & found
            else:
                yield f

    def partitions(self) -> list[Part]:
        out = []
        for f in files(self.options["path"], self.suffixes):
            if zipfile.is_zipfile(f):
                with zipfile.ZipFile(f) as z:
                    out += [Part(f, n) for n in dict.fromkeys(z.namelist()) if n.startswith("archive/") and n.endswith((".warc", ".warc.gz"))]
            else:
                out.append(Part(f))
        return out

    def read(self, part: Part) -> Iterator[tuple]:
        name, permissive = part.member or os.path.basename(part.file), self.options.get("mode", "failfast") == "permissive"

        def rows(stream) -> Iterator[tuple]:
            raw = self.options.get("raw", "false") == "true"
            for i, (offset, length, h, body, record) in enumerate(W.iter_records(stream)):
                if self.kinds is None or W.one(h, "warc-type") in self.kinds:
                    yield record_row(part.file, name, i, offset, length, h, body, record if raw else None)

        try:
            if part.member:
                with zipfile.ZipFile(part.file) as z, z.open(part.member) as s:
                    yield from rows(s)
            else:
                with open(part.file, "rb") as s:
                    yield from rows(s)
        except (W.FormatError, zipfile.BadZipFile, zipfile.zlib.error, OSError) as e:
            if not permissive:
                raise
            yield error_row(len(RECORDS.split(", ")), getattr(e, "code", type(e).__name__.upper()), part.file, name)


def index_row(package: str, path: str, n: int, line: str) -> tuple:
    at = W.parse_index_line(line)
    if at is None:
        return error_row(INDEX_WIDTH, "INDEX_LINE", package, path, n, line)
    key, ts, f = at
    num = lambda v: int(v) if str(v).lstrip("-").isdigit() and abs(int(v)) < 1 << 63 else None
    extra = {k: v for k, v in f.items() if k not in _INDEX_FIELDS}
    text = lambda v: None if v is None else str(v)
    return (package, path, n, line, key, ts, text(f.get("url")), text(f.get("digest")), text(f.get("mime")), num(f.get("status")), num(f.get("offset")), num(f.get("length")),
            text(f.get("filename")), text(f.get("recordDigest")), json.dumps(extra, ensure_ascii=False) if extra else None, None, None)


class CdxjReader(_Reader):
    """Blocks are partitions; of a summary only those that may hold the keys asked for are read."""

    keys: frozenset[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("key",) and isinstance(f, EqualTo | In):
                found = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.keys = found if self.keys is None else self.keys & found
            yield f  # Spark tests rows again: a block holds other keys too

    def partitions(self) -> list[Part]:
        out = []
        for f in files(self.options["path"], self.suffixes):
            with zipfile.ZipFile(f) as z:
                names = list(dict.fromkeys(z.namelist()))
                data = set()
                for n in names:
                    if n.startswith("indexes/") and n.endswith(".idx"):
                        try:
                            header, blocks = W.parse_summary(z.read(n).decode())
                        except (W.FormatError, UnicodeDecodeError):
                            if self.options.get("lenient", "true") == "true":
                                continue
                            raise
                        target = n.rpartition("/")[0] + "/" + header["filename"]
                        data.add(target)
                        firsts = [b[0] for b in blocks]
                        wanted = [i for i in range(len(blocks)) if self.keys is None or any(firsts[i] <= k and (i + 1 == len(firsts) or firsts[i + 1] >= k) for k in self.keys)]
                        run: list[tuple] = []
                        for i in wanted:
                            at = blocks[i][2]
                            run.append((i, int(at["offset"]), int(at["length"]), at["digest"]))
                            if sum(x[2] for x in run) >= BLOCK_BYTES or i == wanted[-1]:
                                out.append(Part(f, target, blocks=run, index=n))
                                run = []
                for n in names:
                    if n.startswith("indexes/") and n not in data and n.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
                        out.append(Part(f, n))
        return out

    def read(self, part: Part) -> Iterator[tuple]:
        path = part.more.get("index", part.member)
        with zipfile.ZipFile(part.file) as z:
            for block, offset, length, digest in part.more.get("blocks", [(None, 0, 0, None)]):
                try:
                    if block is None:
                        raw = z.read(part.member)
                        text = (W.gunzip(raw) if part.member.endswith(".gz") else raw).decode()
                    else:
                        text = read_block(part.file, part.member, offset, length, digest, z).decode()
                except (W.FormatError, zipfile.BadZipFile, zipfile.zlib.error, OSError, UnicodeDecodeError) as e:
                    if self.options.get("mode", "failfast") != "permissive":
                        raise
                    yield (*error_row(INDEX_WIDTH - 2, None, part.file, path), block, getattr(e, "code", type(e).__name__.upper()))
                    continue
                for row in self.lines(part.file, path, text):
                    yield (*row[:-2], block, row[-1])

    def lines(self, file: str, path: str, text: str) -> Iterator[tuple]:
        lines, base, strict = text.split("\n"), 0, self.options.get("strict", "false") == "true"
        if lines and not lines[-1]:
            lines.pop()
        if self.keys is not None and len(self.keys) == 1 and all(a <= b for a, b in pairwise(lines)):
            key = next(iter(self.keys))
            base, stop = bisect_left(lines, key + " "), bisect_left(lines, key + "!")
            lines = lines[base:stop]
        for n, line in enumerate(lines, base + 1):
            line = line.rstrip("\r")
            if line.strip():
                yield index_row(file, path, n, line)
            elif strict:
                yield error_row(INDEX_WIDTH, "BLANK_LINE", file, path, n, line)


def read_block(file: str, member: str, offset: int, length: int, digest: str, z: zipfile.ZipFile | None = None) -> bytes:
    """One index block, its stored bytes checked against ``digest``."""
    raw = member_range(file, member, offset, length, z)
    if not W.digest_matches(digest, raw):
        raise W.FormatError("BLOCK_DIGEST", f"{member} {offset}")
    return W.gunzip(raw)


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``lines`` of ``cdxj`` with ``line_no`` counted from the start of the index, where blocks precede.

    The lines of the blocks before are one row a block.
    """
    at = ["package", "index_path"]
    before = Window.partitionBy(*at).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.where(F.col("block").isNotNull()).groupBy(*at, "block").agg(F.max("line_no").alias("n"))
    sizes = sizes.select(*at, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return lines.join(sizes, [*at, "block"], "left").withColumn("line_no", F.col("line_no") + F.coalesce("__before", F.lit(0))).select(*lines.columns)


def member_range(file: str, member: str, offset: int, length: int, z: zipfile.ZipFile | None = None) -> bytes:
    """Bytes of a stored member. Compressed members and ranges beyond it are errors."""
    archive = z or zipfile.ZipFile(file)
    try:
        e = archive.getinfo(member)
        if e.compress_type != zipfile.ZIP_STORED:
            raise W.FormatError("MEMBER_COMPRESSED", member)
        if offset < 0 or length < 0 or offset + length > e.file_size:
            raise W.FormatError("RANGE_OUT_OF_BOUNDS", member)
        with archive.open(e) as s:
            s.seek(offset)
            return s.read(length)
    finally:
        if z is None:
            archive.close()


RFC3339 = re.compile(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d{1,9})?(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)")


def strict_instant(text: object) -> bool:
    """Is ``text`` an RFC 3339 time that exists?"""
    return isinstance(text, str) and RFC3339.fullmatch(text) is not None and parse_instant(text) is not None


def page_row(package: str, path: str, n: int, line: str, header: bool, strict: bool = False) -> tuple:
    try:
        f = json.loads(line)
        bad = not isinstance(f, dict) or (not header and not (isinstance(f.get("url"), str) and isinstance(f.get("ts"), str)))
    except ValueError:
        f, bad = {}, True
    f = f if isinstance(f, dict) else {}
    if header:
        bad = bad or f.get("format") != "json-pages-1.0"
    elif strict:
        bad = bad or not strict_instant(f.get("ts"))
    text = lambda k: f[k] if isinstance(f.get(k), str) else None
    extra = {k: v for k, v in f.items() if k not in ("url", "ts", "id", "title", "text", "size")}
    size = f.get("size")
    return (package, path, n, header, line, text("url"), text("ts"), text("id"), text("title"), text("text"), size if isinstance(size, int) and 0 <= size < 1 << 63 else None,
            json.dumps(extra, ensure_ascii=False) if extra else None, bad)


class PageListReader(_Reader):
    def read(self, part: Part) -> Iterator[tuple]:
        with zipfile.ZipFile(part.file) as z:
            for n in dict.fromkeys(z.namelist()):
                if not n.startswith("pages/") or n.endswith("/"):
                    continue
                header = True
                for no, raw in enumerate(io.TextIOWrapper(z.open(n), "utf-8", newline="\n"), 1):
                    line = raw.rstrip("\r\n")
                    strict = self.options.get("strict", "false") == "true"
                    if strict or line.strip():
                        yield page_row(part.file, n, no, line, header, strict)
                        header = False


def _source(source: str, columns: str, reader: type[_Reader]) -> type[DataSource]:
    class Reader(reader):
        def read(self, part: Part | None) -> Iterator[tuple]:
            return iter(()) if part is None else super().read(part)  # Spark asks for a partition where there is none

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return source

        def schema(self) -> str:
            return columns

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(dict(self.options))

    return Source


SOURCES = [
    _source("zipmembers", MEMBERS, MembersReader), _source("zipcontent", MEMBERS + ", content binary, error string", ContentReader),
    _source("zipdigests", "package string, ordinal int, path string, is_duplicate boolean, sha256 string, size long, error string", DigestReader),
    _source("warc", RECORDS, WarcReader), _source("cdxj", LINES, CdxjReader), _source("pagelist", PAGES, PageListReader),
]


def register(spark: SparkSession) -> None:
    for s in SOURCES:
        spark.dataSource.register(s)
