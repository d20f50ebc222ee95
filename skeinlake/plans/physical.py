"""Queries that go through real files: WARC and package files made from the tables, written, read back and checked.

Their results are the rows read back; SQL cannot express them. The files lie in the shared
checkpoint folder, or in a temporary one of a local session. What was written from the tables must be read back as it
stands in them, so most have SQL over the same tables.
"""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.functions import urls as U
from skeinlake.operators.validate import captures_of, layer_report, package_lookup, validate
from skeinlake.session import shared_folder, table
from skeinlake.sinks.convert import Conversion
from skeinlake.sinks.package import WriterOptions
from skeinlake.sources.readers import register


def _folder(spark: SparkSession) -> str:
    base = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    made = os.path.join(base, f"packages-{uuid.uuid4().hex}")
    os.makedirs(made)
    atexit.register(shutil.rmtree, made, ignore_errors=True)  # results are lazy, so the files stay as long as the process
    return made


def page_records(spark: SparkSession, d: str) -> DataFrame:
    """(ord, record): a WARC response for each page that has a text."""
    c = F.col
    crlf = F.lit("\r\n")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<title>"), F.coalesce("title", F.lit("")), F.lit("</title>"), c("text"))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), c("page_id").cast("string"), F.lit(">\r\nWARC-Date: "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
                    F.lit("\r\nWARC-Target-URI: "), c("url"), F.lit("\r\nContent-Length: "), F.octet_length(http).cast("string"), crlf, crlf)
    return table(spark, d, "wacz_pages").where(c("text").isNotNull()).select(c("page_id").alias("ord"), F.concat(head, http, crlf, crlf).alias("record"))


def write_warc(records: DataFrame, folder: str) -> int:
    """Writes (ord, record) as WARC files of ``folder``, one a task, in order from file to file; the number of files comes back.

    A file is written under another name and put in its place at its end, so a task that runs twice leaves one.
    """
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        at = TaskContext.get()
        name = os.path.join(folder, f"part-{at.partitionId():06d}.warc")
        temp = f"{name}.{at.taskAttemptId()}"
        n = 0
        with open(temp, "wb") as f:
            for pdf in batches:
                for r in pdf["record"]:
                    f.write(r.encode())
                    n += 1
        os.replace(temp, name)
        yield pd.DataFrame({"n": [n]})

    return records.repartitionByRange("ord").sortWithinPartitions("ord").mapInPandas(run, "n long").count()


def _package(spark: SparkSession, d: str, **options: int) -> str:
    folder = _folder(spark)
    write_warc(page_records(spark, d), os.path.join(folder, "parts"))
    source = os.path.join(folder, "pages.warc")
    with open(source, "wb") as out:  # one package is one file, so its parts are put together here
        out.write(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:info>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: 14\r\n\r\ntitle: Pages\r\n\r\n\r\n")
        for part in sorted(os.listdir(os.path.join(folder, "parts"))):
            with open(os.path.join(folder, "parts", part), "rb") as f:
                shutil.copyfileobj(f, out, 1 << 20)
    dest = os.path.join(folder, "pages.wacz")
    Conversion(spark, source, dest, WriterOptions(**options)).run()
    register(spark)
    return dest


def warc_scan(spark: SparkSession, d: str) -> DataFrame:
    at = spark.read.format("warc").load(_package(spark, d)).where(F.col("record_type") == "response")
    return at.select("ordinal", "record_id", "target_uri", F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("sha"))


def zip_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.format("zipmembers").load(_package(spark, d)).select("path", "compression", "is_duplicate")


def zipnum_lines(spark: SparkSession, d: str) -> DataFrame:
    at = spark.read.format("cdxj").load(_package(spark, d, zipnum_lines=256))
    return at.select("index_path", "key", "ts_raw", "url", "digest", "mime", "status")


def page_list_scan(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.format("pagelist").load(_package(spark, d)).where(~F.col("is_header")).select("list_path", "line_no", "url", "ts_text", "id", "title", "malformed")


def package_validate(spark: SparkSession, d: str) -> DataFrame:
    """Findings of each layer: none for a package just written."""
    return layer_report(validate(spark, _package(spark, d, zipnum_lines=256)))


def capture_records(spark: SparkSession, d: str) -> DataFrame:
    """The records of one URL, found in a block-compressed index and read by their ranges."""
    url = table(spark, d, "wacz_pages").where(F.col("text").isNotNull()).agg(F.min("url")).first()[0]
    found = captures_of(spark, _package(spark, d, zipnum_lines=256), url or "http://none.test/")
    return found.select("ts_raw", F.col("target_uri").alias("url"), "record_id", F.col("http_status").alias("status"), F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("sha"), "read_error")


def package_lookups(spark: SparkSession, d: str) -> DataFrame:
    """The same URL in a plain index and in a block-compressed one: both give the same lines."""
    url = table(spark, d, "wacz_pages").where(F.col("text").isNotNull()).agg(F.min("url")).first()[0] or "http://none.test/"
    plain, blocks = (package_lookup(spark, _package(spark, d, **o), url, "2000-01-01", "2100-01-01") for o in ({}, {"zipnum_lines": 64}))
    rows = plain.select("index_path", "ts_raw", "url").unionByName(blocks.select("index_path", "ts_raw", "url"))
    return rows.groupBy("index_path").agg(F.count(F.lit(1)).alias("n"), F.min("ts_raw").alias("first_ts"), F.max("ts_raw").alias("last_ts"))


QUERIES = {f.__name__: f for f in (warc_scan, zip_round_trip, zipnum_lines, page_list_scan, package_validate, capture_records, package_lookups)}

# --- the same from the tables ------------------------------------------------------------------------------------------------

_HTTP = r"""'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || '<title>' || coalesce(title, '') || '</title>' || text"""
_RECORDS = f"""WITH r AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, strftime(ts, '%Y%m%d%H%M%S') || '000' AS ts_raw, {_HTTP} AS http,
    '<title>' || coalesce(title, '') || '</title>' || text AS payload FROM wacz_pages WHERE text IS NOT NULL)
"""
_ASKED = f"{U.key_sql('url', False)} IN (SELECT unnest([{U.key_sql('asked', False)}, {U.key_sql('asked', True)}]) FROM (SELECT min(url) AS asked FROM r))"
SQL = {
    "warc_scan": _RECORDS + """SELECT row_number() OVER (ORDER BY page_id) AS ordinal, '<urn:page:' || page_id || '>' AS record_id, url AS target_uri,
      octet_length(encode(http)) AS bytes, sha256(http) AS sha FROM r""",
    "zip_round_trip": """SELECT * FROM (VALUES ('archive/data.warc.gz', 'stored', false), ('indexes/index.cdx', 'deflated', false), ('pages/pages.jsonl', 'deflated', false),
      ('datapackage.json', 'deflated', false), ('datapackage-digest.json', 'deflated', false)) AS t(path, compression, is_duplicate)""",
    "zipnum_lines": _RECORDS + f"""SELECT 'indexes/index.idx' AS index_path, {U.key_sql('url', False)} AS key, ts_raw, url, 'sha256:' || sha256(payload) AS digest,
      'text/html' AS mime, 200 AS status FROM r WHERE regexp_matches(url, '(?i)^https?://[^/]')""",
    "page_list_scan": _RECORDS + """SELECT 'pages/pages.jsonl' AS list_path, row_number() OVER (ORDER BY page_id) + 1 AS line_no, url, stamp AS ts_text, substr(sha256(stamp || url), 1, 24) AS id,
      nullif(trim(regexp_replace(title, '\\s+', ' ', 'g')), '') AS title, false AS malformed FROM r WHERE regexp_matches(url, '(?i)^https?://[^/]')""",
    "package_validate": "SELECT layer, 0::BIGINT AS findings FROM (VALUES ('layout'), ('manifest'), ('signature'), ('fixity'), ('content'), ('index')) AS t(layer)",
    "capture_records": _RECORDS + f"""SELECT ts_raw, url, '<urn:page:' || page_id || '>' AS record_id, 200 AS status, octet_length(encode(http)) AS bytes, sha256(http) AS sha, NULL::VARCHAR AS read_error
      FROM r WHERE {_ASKED}""",
    "package_lookups": _RECORDS + f"""SELECT index_path, count(*) AS n, min(ts_raw) AS first_ts, max(ts_raw) AS last_ts
      FROM r, (VALUES ('indexes/index.cdx'), ('indexes/index.idx')) AS i(index_path) WHERE {_ASKED} GROUP BY index_path""",
}
