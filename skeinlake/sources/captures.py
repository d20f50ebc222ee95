"""Capture records by the byte range that an index line names: nothing else of a WARC file is read."""

from __future__ import annotations

import hashlib
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.sources import formats as W
from skeinlake.sources.readers import member_range

RECORD = ("read_error string, record_type string, record_id string, target_uri string, warc_date string, payload_digest string, computed_digest string, "
          "identified_payload_type string, http_status int, content_type string, body binary")
_N = len(RECORD.split(", "))


def capture_bytes(package: str, filename: str | None, offset: int | None, length: int | None, record_digest: str | None = None, z: zipfile.ZipFile | None = None) -> bytes:
    """The stored bytes that an index line locates, checked against ``record_digest`` where there is one; gzip stays as it is."""
    for name, value in (("filename", filename), ("offset", offset), ("length", length)):
        if value is None:
            raise W.FormatError("MISSING_FIELD", name)
    path = filename if filename.startswith("archive/") else "archive/" + filename
    try:
        raw = member_range(package, path, int(offset), int(length), z)
    except KeyError as e:
        raise W.FormatError("MISSING_MEMBER", path) from e
    if len(raw) != length:
        raise W.FormatError("RANGE_TRUNCATED", path)
    if record_digest is not None:
        if W.parse_digest(record_digest) is None:
            raise W.FormatError("RECORD_DIGEST_INVALID", record_digest)
        if not W.digest_matches(record_digest, raw):
            raise W.FormatError("RECORD_DIGEST", path)
    return raw


def single_record(raw: bytes) -> tuple[dict[str, list[str]], bytes]:
    """(headers, body) of the one record in ``raw``, plain or gzip by content; none or several are errors."""
    data = W.gunzip(raw) if W.is_gzip(raw) else raw
    if not data.strip():
        raise W.FormatError("NO_RECORD")
    headers, body, end = W.read_record(data)
    if data[end:].strip():
        raise W.FormatError("SEVERAL_RECORDS")
    return headers, body


def _row(raw: bytes, digest: str | None) -> tuple:
    h, body = single_record(raw)
    kind, declared = (W.one(h, "warc-type") or "").lower(), W.one(h, "warc-payload-digest")
    got = W.http_response(body) if kind in ("response", "revisit") else None
    status, headers, payload = got if got is not None else (None, {}, None)
    # what the record doesn't declare is computed by the algorithm of the line's digest
    at = W.parse_digest(digest) if digest is not None and declared is None and payload is not None and kind != "revisit" else None
    computed = f"{at[0]}:{hashlib.new(at[0], payload).hexdigest()}" if at else None
    return (None, kind or None, W.one(h, "warc-record-id"), W.one(h, "warc-target-uri"), W.one(h, "warc-date"), declared, computed, W.one(h, "warc-identified-payload-type"), status, W.one(headers, "content-type"), body)


def _inside(z: zipfile.ZipFile, filename: str, offset: int, length: int) -> bytes:
    """A range of a member that the ZIP compresses, for comparisons only: everything before it is decompressed."""
    with z.open(filename if filename.startswith("archive/") else "archive/" + filename) as s:
        s.seek(offset)
        return s.read(length)


def read_captures(lines: DataFrame, compressed: bool = False) -> DataFrame:
    """``lines`` (package, filename, offset, length, record_digest, digest and more) with the record that each names.

    A range that cannot be read, whose digest differs, or that holds no or several records gives ``read_error`` and
    nulls; no line is lost and none raises. With ``compressed`` a range of a compressed member has its error and its record.
    Lines are read in the order of their ranges, each package opened once a batch.
    """
    columns = lines.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields) + ", " + RECORD

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, z = None, None
        for pdf in batches:
            rows = []
            for package, name, offset, length, record_digest, digest in zip(*(pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("package", "filename", "offset", "length", "record_digest", "digest")), strict=True):
                try:
                    if package != file:
                        if z is not None:
                            z.close()
                        file, z = package, None
                        z = zipfile.ZipFile(package)
                    rows.append(_row(capture_bytes(package, name, offset, length, record_digest, z), digest))
                except (W.FormatError, zipfile.BadZipFile, zipfile.zlib.error, OSError) as e:
                    if compressed and getattr(e, "code", "") == "MEMBER_COMPRESSED":
                        try:
                            rows.append((e.code, *_row(_inside(z, name, int(offset), int(length)), digest)[1:]))
                            continue
                        except (W.FormatError, zipfile.BadZipFile, zipfile.zlib.error, OSError):
                            pass
                    rows.append((getattr(e, "code", type(e).__name__.upper()), *[None] * (_N - 1)))
            got = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in RECORD.split(", ")], index=pdf.index).astype({"http_status": "Int32"})
            yield pd.concat([pdf[columns], got], axis=1)
        if z is not None:
            z.close()

    return lines.sortWithinPartitions("package", "filename", F.col("offset")).mapInPandas(run, schema)
