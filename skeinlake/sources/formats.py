"""Readers of the byte formats: WARC records, HTTP messages, gzip members, capture index lines. Standard library only."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

CEILING = 1 << 30  # bytes that one range or block may decompress to


class FormatError(ValueError):
    """A malformed record or file; ``code`` is stable."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


ALGORITHMS = ("md5", "sha1", "sha256", "sha512")


def parse_digest(text: str) -> tuple[str, bytes] | None:
    """(algorithm, value) of a labelled digest in hexadecimal, base32 or base64; None where it cannot be read. Text
    without a label is SHA-1."""
    label, sep, value = text.partition(":") if ":" in text else ("sha1", ":", text)
    label = label.lower().replace("-", "")
    if label not in ALGORITHMS:
        return None
    size, bare = hashlib.new(label).digest_size, value.rstrip("=")
    try:
        if len(value) == 2 * size and re.fullmatch(r"[0-9A-Fa-f]+", value):
            return label, bytes.fromhex(value)
        if len(bare) == -(-size * 8 // 5) and re.fullmatch(r"[A-Za-z2-7]+", bare):
            return label, base64.b32decode(bare.upper() + "=" * (-len(bare) % 8))
        if len(bare) == -(-size * 4 // 3) and re.fullmatch(r"[A-Za-z0-9+/_-]+", bare):
            return label, base64.urlsafe_b64decode(bare.replace("+", "-").replace("/", "_") + "=" * (-len(bare) % 4))
    except ValueError:
        pass
    return None


def digest_matches(text: str, data: bytes) -> bool:
    """Is ``text`` the digest of ``data``, by the algorithm that it names?"""
    at = parse_digest(text)
    return at is not None and hashlib.new(at[0], data).digest() == at[1]


def is_gzip(head: bytes) -> bool:
    """By content, never by name; fewer than two bytes are not gzip."""
    return head[:2] == b"\x1f\x8b"


def gunzip(data: bytes, ceiling: int = CEILING) -> bytes:
    """All gzip members of ``data``; output beyond ``ceiling`` is an error, not cut off."""
    out, left = [], ceiling
    while data:
        d = zlib.decompressobj(31)
        try:
            got = d.decompress(data, left + 1)
        except zlib.error as e:
            raise FormatError("GZIP_MALFORMED") from e
        if len(got) > left:
            raise FormatError("DECOMPRESSION_LIMIT")
        if not d.eof:
            raise FormatError("GZIP_TRUNCATED")
        out.append(got)
        left -= len(got)
        data = d.unused_data
    return b"".join(out)


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One member without time stamp; byte 8 tells the slowest and the two fastest levels, byte 9 no system."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    flag = 2 if level == 9 else 4 if level in (0, 1) else 0
    head = bytes((0x1F, 0x8B, 8, 0, 0, 0, 0, 0, flag, 255))
    return head + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def _headers(block: bytes) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    last = None
    for raw in block.split(b"\r\n" if b"\r\n" in block else b"\n"):
        line = raw.decode("utf-8", "replace")
        if not line:
            continue
        if line[0] in " \t" and last:  # folded
            out[last][-1] += " " + line.strip()
            continue
        name, sep, value = line.partition(":")
        if not sep:
            raise FormatError("HEADER_MALFORMED", line[:80])
        last = name.strip().lower()
        out.setdefault(last, []).append(value.strip())
    return out


def one(headers: dict[str, list[str]], name: str) -> str | None:
    """Case-insensitive first value of a header."""
    return (headers.get(name.lower()) or [None])[0]


def read_record(data: bytes, at: int = 0) -> tuple[dict[str, list[str]], bytes, int]:
    """(headers, body, end) of the record at ``at``; the two line ends behind it are its own."""
    if not data.startswith(b"WARC/", at):
        raise FormatError("WARC_VERSION", repr(data[at : at + 16]))
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise FormatError("WARC_HEADER_TRUNCATED")
    first = data.find(b"\r\n", at)
    headers = _headers(data[first + 2 : end + 2])
    length = one(headers, "content-length")
    if length is None or not length.isdigit():
        raise FormatError("WARC_LENGTH")
    start, stop = end + 4, end + 4 + int(length)
    if stop > len(data):
        raise FormatError("WARC_BODY_TRUNCATED")
    after = stop
    for _ in range(2):
        if data.startswith(b"\r\n", after):
            after += 2
    return headers, data[start:stop], after


def iter_members(stream: BinaryIO, size: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, decompressed bytes) of each gzip member of a stream."""
    offset, pending = 0, b""
    while True:
        if not pending:
            pending = stream.read(size)
            if not pending:
                return
        d, parts, used, left = zlib.decompressobj(31), [], 0, CEILING
        while not d.eof:
            if not pending:
                pending = stream.read(size)
                if not pending:
                    raise FormatError("GZIP_TRUNCATED")
            try:
                got = d.decompress(pending, left + 1)
            except zlib.error as e:
                raise FormatError("GZIP_MALFORMED") from e
            if len(got) > left:
                raise FormatError("DECOMPRESSION_LIMIT")
            left -= len(got)
            parts.append(got)
            rest = d.unused_data if d.eof else d.unconsumed_tail
            used += len(pending) - len(rest)
            pending = rest
        yield offset, used, b"".join(parts)
        offset += used


def iter_records(stream: BinaryIO) -> Iterator[tuple[int, int, dict[str, list[str]], bytes, bytes]]:
    """(offset, stored length, headers, body, record as it stands) in file order, plain or gzip by content.

    In plain files records are read one after the other, so memory holds one record. Gzip members
    may hold several records; those share the member's range.
    """
    head = stream.read(2)
    stream.seek(0)
    if is_gzip(head):
        for offset, length, data in iter_members(stream):
            at = 0
            while at < len(data):
                start = at
                headers, body, at = read_record(data, at)
                yield offset, length, headers, body, data[start:at]
        return
    buffer, base = b"", 0
    while True:
        while b"\r\n\r\n" not in buffer:
            more = stream.read(1 << 16)
            if not more:
                break
            buffer += more
        if not buffer.strip():
            return
        end = buffer.find(b"\r\n\r\n")
        if end < 0:
            raise FormatError("WARC_HEADER_TRUNCATED")
        length = one(_headers(buffer[buffer.find(b"\r\n") + 2 : end + 2]), "content-length")
        need = end + 8 + int(length or 0)
        while len(buffer) < need:
            more = stream.read(max(1 << 16, need - len(buffer)))
            if not more:
                break
            buffer += more
        headers, body, after = read_record(buffer)
        yield base, after, headers, body, buffer[:after]
        buffer, base = buffer[after:], base + after


def dechunk(body: bytes) -> bytes:
    """Body of a chunked message; bodies that were decoded before, and missing last chunks, are tolerated."""
    out, at = [], 0
    while at < len(body):
        end = body.find(b"\n", at)
        line = body[at : end if end >= 0 else len(body)].split(b";")[0].strip()
        if end < 0 or not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", line):
            return b"".join(out) if out else body
        n = int(line, 16)
        if n == 0:
            break
        out.append(body[end + 1 : end + 1 + n])
        at = end + 1 + n
        for mark in (b"\r\n", b"\n"):
            if body.startswith(mark, at):
                at += len(mark)
                break
    return b"".join(out)


def http_response(message: bytes) -> tuple[int, dict[str, list[str]], bytes] | None:
    """(status, headers, payload) of an HTTP response, or None. Folded header lines are joined, chunks undone."""
    cut = min((p for p in (message.find(b"\r\n\r\n"), message.find(b"\n\n")) if p >= 0), default=-1)
    head = message if cut < 0 else message[:cut]
    m = re.match(rb"HTTP/\d(?:\.\d)? (\d{3})(?: [^\r\n]*)?(?:\r?\n|$)", head)
    if not m:
        return None
    body = b"" if cut < 0 else message[cut + (4 if message.startswith(b"\r\n\r\n", cut) else 2) :]
    try:
        headers = _headers(head[m.end() :])
    except FormatError:
        return None
    if "chunked" in (one(headers, "transfer-encoding") or "").lower():
        body = dechunk(body)
    return int(m[1]), headers, body


def field_lines(body: bytes) -> dict[str, list[str]] | None:
    """Fields of a warcinfo or metadata body; None where it has none."""
    try:
        return _headers(body)
    except FormatError:
        return None


def parse_index_line(line: str) -> tuple[str, str, dict] | None:
    """(key, timestamp, fields), cut at the second blank; None for malformed lines."""
    parts = line.split(" ", 2)
    if len(parts) < 3 or not parts[0] or not re.fullmatch(r"\d{14}(?:\d{3})?", parts[1]):
        return None
    try:
        fields = json.loads(parts[2])
    except ValueError:
        return None
    return (parts[0], parts[1], fields) if isinstance(fields, dict) else None


REQUIRED_FIELDS = ("url", "digest", "mime", "status", "offset", "length", "filename")


def conforming(fields: dict) -> bool:
    return all(fields.get(f) is not None for f in REQUIRED_FIELDS) and all(str(fields[f]).isdigit() for f in ("status", "offset", "length"))


def parse_summary(text: str) -> tuple[dict, list[tuple[str, str, dict]]]:
    """(header, blocks) of a block summary; a malformed or unsorted one is an error."""
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines or not lines[0].startswith("!meta 0 "):
        raise FormatError("SUMMARY_HEADER")
    try:
        header = json.loads(lines[0][8:])
    except ValueError as e:
        raise FormatError("SUMMARY_HEADER") from e
    if header.get("format") != "cdxj-gzip-1.0" or not header.get("filename"):
        raise FormatError("SUMMARY_FORMAT")
    blocks = []
    for n, line in enumerate(lines[1:], 2):
        at = parse_index_line(line)
        if at is None or not all(k in at[2] for k in ("offset", "length", "digest")):
            raise FormatError("SUMMARY_LINE", str(n))
        if blocks and blocks[-1][:2] > at[:2]:
            raise FormatError("SUMMARY_ORDER", str(n))
        blocks.append(at)
    return header, blocks
