"""One WARC file to one package: records, captures, index, page lists and manifest as DataFrames, assembled into a ZIP."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.functions.paths import content_type_essence
from skeinlake.functions.stamps import cdx_timestamp, parse_rfc3339
from skeinlake.functions.urls import is_http, surt_wayback
from skeinlake.operators.index import cdxj_line
from skeinlake.operators.ordered import running_offset
from skeinlake.operators.pages import annotate, main_page, merge_annotations, mime_type, skip_reason
from skeinlake.session import cut_lineage, ensure_session
from skeinlake.sinks.package import PackageWriter, WriterOptions, page_list
from skeinlake.sources import formats as W
from skeinlake.sources.readers import register

INSPECTED = ("warcinfo", "metadata", "response", "revisit")
HTTP = "struct<status:int,content_type:string,payload_digest:string,title:string>"
LAST_INSTANT = "9999-12-30T22:00:00Z"


def _stored(gzip: bool, level: int):
    @F.pandas_udf("binary")
    def stored(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: W.gzip_member(b, level)) if gzip else raw

    return stored


def _http(title: Callable[[dict], str | None] | None):
    @F.pandas_udf(HTTP)
    def parse(url: pd.Series, kind: pd.Series, body: pd.Series) -> pd.DataFrame:
        rows = []
        for u, k, b in zip(url, kind, body, strict=True):
            got = W.http_response(bytes(b)) if b is not None else None
            if got is None:
                rows.append((None, None, None, None))
                continue
            status, headers, payload = got
            kind_type = W.one(headers, "content-type")
            made = title({"url": u, "status": status, "content_type": kind_type, "entity": b"" if k == "revisit" else payload}) if title else None
            rows.append((status, kind_type, None if k == "revisit" else "sha256:" + hashlib.sha256(payload).hexdigest(), made))
        return pd.DataFrame(rows, columns=["status", "content_type", "payload_digest", "title"]).astype({"status": "Int32"})

    return parse


def _fields():
    @F.pandas_udf("map<string,string>")
    def fields(body: pd.Series) -> pd.Series:
        return body.map(lambda b: {k: v[-1] for k, v in (W.field_lines(bytes(b)) or {}).items()})

    return fields


def html_title(capture: dict) -> str | None:
    """A title generator: the title element of an HTML entity. Calls come in no order."""
    import html
    import re

    if "html" not in (capture["content_type"] or ""):
        return None
    m = re.search(rb"<title[^>]*>(.*?)</title>", capture["entity"], re.IGNORECASE | re.DOTALL)
    return html.unescape(re.sub(r"[ \t\n\f\r]+", " ", m[1].decode("utf-8", "replace")).strip(" ")) or None if m else None  # white space as HTML has it


@dataclass
class Summary:
    records: int
    captures: int
    pages: int
    extra_pages: int
    warnings: list[tuple[str, str]]


@dataclass
class Conversion:
    """``Conversion(spark, "in.warc", "out.wacz").run()``. Gzip by content is always written again record by record."""

    spark: SparkSession
    source: str
    dest: str
    options: WriterOptions = WriterOptions()
    gzip_warc: bool = True
    title: Callable[[dict], str | None] | None = html_title

    def records(self) -> DataFrame:
        """Every record with its place in the member to be written."""
        register(ensure_session(self.spark))
        with open(self.source, "rb") as f:
            self.gzip_warc = self.gzip_warc or W.is_gzip(f.read(2))
        rows = self.spark.read.format("warc").option("raw", "true").load(self.source)
        rows = rows.withColumn("stored", _stored(self.gzip_warc, self.options.gzip_level)("raw")).drop("raw").withColumn("stored_length", F.octet_length("stored").cast("long"))
        rows = rows.withColumn("record_digest", F.concat(F.lit("sha256:"), F.sha2("stored", 256)))
        return cut_lineage(running_offset(rows, [F.col("ordinal")], "stored_length", "stored_offset"))

    def captures(self, records: DataFrame) -> DataFrame:
        """Records that are captures, with their index fields and the reason where one is left out."""
        kind = F.lower(F.trim("record_type"))
        at = records.where(kind.isin("response", "revisit") & F.col("target_uri").isNotNull() & is_http(F.col("target_uri"))).withColumn("kind", kind)
        at = at.withColumn("http", _http(self.title)("target_uri", "kind", "body"))
        ts = F.when(F.col("warc_date") < LAST_INSTANT, parse_rfc3339(F.col("warc_date")))
        digest = F.coalesce("payload_digest", "http.payload_digest")
        at = at.select("ordinal", "record_id", F.col("target_uri").alias("url"), surt_wayback(F.col("target_uri")).alias("key"), "warc_date", ts.alias("ts"), F.col("http.status").alias("status"),
                       digest.alias("digest"), mime_type(F.col("kind"), F.col("http.content_type"), content_type_essence(F.col("identified_payload_type"))).alias("mime"),
                       F.col("http.title").alias("title"), "stored_offset", "stored_length", "record_digest")
        return at.withColumn("reason", skip_reason(F.col("status"), F.col("digest"), F.col("ts")))

    def annotations(self, records: DataFrame) -> DataFrame:
        f = _fields()
        rows = records.where(F.lower(F.trim("record_type")) == "metadata").select("ordinal", f("body").alias("f"), F.array_compact(F.concat(F.array("refers_to"), "concurrent_to")).alias("of"))
        rows = rows.select(F.col("ordinal").alias("ord"), F.explode("of").alias("record_id"), F.col("f")["title"].alias("title"), F.col("f")["via"].isNotNull().alias("via"), F.col("f")["pageurl"].alias("page_url"))
        return merge_annotations(rows)

    def run(self) -> Summary:
        records = self.records()
        name = "data.warc.gz" if self.gzip_warc else "data.warc"
        captures = cut_lineage(self.captures(records))
        infos = records.where(F.lower(F.trim("record_type")) == "warcinfo").select("ordinal", "record_id", _fields()("body").alias("f")).orderBy("ordinal").collect()
        info = infos[0]["f"] or {} if infos else {}
        good = captures.where(F.col("reason").isNull())
        c = F.col
        line = cdxj_line(c("key"), cdx_timestamp(c("ts")), url=c("url"), digest=c("digest"), mime=c("mime"), status=c("status"),
                         offset=c("stored_offset"), length=c("stored_length"), filename=F.lit(name), recordDigest=c("record_digest"))
        lines = cut_lineage(good.select(line.alias("line")).distinct().orderBy("line"))
        drafts = good.select(c("ordinal").alias("ord"), "record_id", "url", c("warc_date").alias("ts_text"), "title")
        pages = cut_lineage(annotate(drafts, self.annotations(records), info.get("pagelist") == "metadata"))
        first = main_page(pages).first()

        def listed(via: bool) -> Iterator[dict]:
            for r in pages.where(c("via") == via).orderBy("ord").toLocalIterator():
                yield {"url": r["url"], "ts": r["ts_text"], "title": r["title"]}

        counts = pages.agg(F.count(F.lit(1)).alias("n"), F.count_if("via").alias("extra")).first()
        with PackageWriter(self.dest, self.options) as out:
            out.add(f"archive/{name}", (bytes(r["stored"]) for r in records.select("ordinal", "stored").orderBy("ordinal").toLocalIterator()))
            rows = (r["line"] for r in lines.orderBy("line").toLocalIterator())
            if self.options.zipnum_lines:
                self._zipnum(out, rows)
            else:
                out.add("indexes/index.cdx", (x.encode() + b"\n" for x in rows))
            out.add("pages/pages.jsonl", page_list(listed(False), self.options.page_id_length, id="pages", title="All Pages"))
            if counts["extra"]:
                out.add("pages/extraPages.jsonl", page_list(listed(True), self.options.page_id_length, id="extra-pages", title="Extra Pages"))
            out.finish({"title": info.get("title") or info.get("ispartof"), "description": info.get("description"), "mainPageUrl": first["url"] if first else None, "mainPageDate": first["ts_text"] if first else None})
        warnings = [("MULTIPLE_WARCINFO", r["record_id"] or "") for r in infos[1:]]
        warnings += [(r["reason"], r["record_id"] or "") for r in captures.where(c("reason").isNotNull()).orderBy("ordinal").toLocalIterator()]
        return Summary(records.count(), good.count(), counts["n"], counts["extra"], warnings)

    def _zipnum(self, out: PackageWriter, lines: Iterator[str]) -> None:
        """Blocks as gzip members of their own; an empty index is one empty member."""
        summary = ['!meta 0 {"format": "cdxj-gzip-1.0", "filename": "index.cdx.gz"}']

        def blocks() -> Iterator[bytes]:
            offset, block = 0, []

            def member() -> bytes:
                nonlocal offset
                data = W.gzip_member("".join(x + "\n" for x in block).encode(), self.options.gzip_level)
                if block:
                    key, ts = block[0].split(" ", 2)[:2]
                    summary.append(f"{key} {ts} " + json.dumps({"offset": offset, "length": len(data), "digest": "sha256:" + hashlib.sha256(data).hexdigest()}))
                offset += len(data)
                return data

            for x in lines:
                block.append(x)
                if len(block) == self.options.zipnum_lines:
                    yield member()
                    block = []
            if block or offset == 0:
                yield member()

        out.add("indexes/index.cdx.gz", blocks())
        out.add("indexes/index.idx", [("\n".join(summary) + "\n").encode()])
