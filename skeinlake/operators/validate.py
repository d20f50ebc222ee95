"""Layered checks of packages on disk. Findings: (package_id, layer, code, path)."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.functions import paths as P
from skeinlake.functions.instants import parse_instant
from skeinlake.functions.stamps import parse_rfc3339
from skeinlake.operators import checks
from skeinlake.sinks.manifest import stamp
from skeinlake.sinks.package import DIGEST, MANIFEST, NAME, ROLES, safe
from skeinlake.sources import formats as W
from skeinlake.sources.captures import read_captures
from skeinlake.sources.readers import numbered_lines, page_row, register, strict_instant

LAYERS = ("layout", "manifest", "signature", "fixity", "content", "index")
FINDINGS = "package_id string, layer string, code string, path string"
ANONYMOUS = frozenset(("hash", "created", "software", "version", "signature", "publicKey"))
DOMAIN = frozenset(("hash", "created", "software", "version", "signature", "domain", "domainCert", "timeSignature", "timestampCert", "crossSignedCert"))
DATES = ("created", "modified", "mainPageDate")
COMPATIBLE = re.compile(r"\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d(?:\.\d{1,9})?)?)?")


def manifest_problems(raw: bytes) -> tuple[list[tuple[str, str | None]], list[dict]]:
    """(findings of a manifest by itself, its resources)."""
    try:
        m = json.loads(raw)
        if not isinstance(m, dict):
            raise ValueError
    except ValueError:
        return [("MANIFEST_UNPARSEABLE", MANIFEST)], []
    out: list[tuple[str, str | None]] = [(f"MANIFEST_DATE_{'NONCONFORMING' if to is not None else 'INVALID'}", k) for k, _, to in repair_dates(m)[1]]
    if m.get("profile") != "data-package":
        out.append(("MANIFEST_PROFILE", None))
    if m.get("wacz_version") != "1.1.1":
        out.append(("MANIFEST_VERSION", None))
    if m.get("name") is not None and not NAME.fullmatch(str(m["name"])):
        out.append(("MANIFEST_NAME", None))
    resources = [r for r in m.get("resources") or [] if isinstance(r, dict)]
    if not resources:
        out.append(("MANIFEST_NO_RESOURCES", None))
    for owner in (m, *resources):
        out += [("MANIFEST_SOURCE", owner.get("path")) for s in owner.get("sources") or [] if not (isinstance(s, dict) and s.get("title"))]
        out += [("MANIFEST_LICENSE", owner.get("path")) for s in owner.get("licenses") or [] if not (isinstance(s, dict) and (s.get("name") or s.get("path")))]
    for s in m.get("contributors") or []:
        if not (isinstance(s, dict) and s.get("title")):
            out.append(("MANIFEST_CONTRIBUTOR", None))
        elif s.get("role") is not None and s["role"] not in ROLES:
            out.append(("MANIFEST_ROLE", str(s["role"])))
    return out, resources


def repair_dates(manifest: dict) -> tuple[dict, list[tuple[str, object, str | None]]]:
    """(the manifest with its dates as RFC 3339, what was repaired: property, value as written, repaired value).

    Text without a zone, seconds or a time of day is read as UTC. What names no instant stays as it is, with None.
    """
    out, repairs = dict(manifest), []
    for k in DATES:
        v = manifest.get(k)
        if v is None or strict_instant(v):
            continue
        us = parse_instant(v) if isinstance(v, str) and COMPATIBLE.fullmatch(v) else None
        to = None if us is None else stamp(datetime.fromtimestamp(0, UTC) + timedelta(microseconds=us))
        repairs.append((k, v, to))
        if to is not None:
            out[k] = to
    return out, repairs


def parse_manifest(raw: bytes) -> tuple[dict, list[tuple[str, object, str | None]]]:
    """As repair_dates, from the manifest's bytes; no JSON object is an error."""
    try:
        m = json.loads(raw)
    except ValueError as e:
        raise W.FormatError("MANIFEST_UNPARSEABLE") from e
    if not isinstance(m, dict):
        raise W.FormatError("MANIFEST_UNPARSEABLE")
    return repair_dates(m)


def signature_fields(digest: bytes) -> dict[str, str | None]:
    """hash, created, software, version and signature of a digest file's signed data, and of which kind it is: None, anonymous or domain."""
    d = json.loads(digest)
    s = d.get("signedData") if isinstance(d, dict) else None
    s = s if isinstance(s, dict) else {}
    kind = "domain" if "domain" in s else "anonymous" if "publicKey" in s else None
    return {"kind": kind, **{k: s[k] if isinstance(s.get(k), str) else None for k in ("hash", "created", "software", "version", "signature")}}


def resource_problems(resources: list[dict], members: set[str]) -> list[tuple[str, str | None]]:
    out: list[tuple[str, str | None]] = []
    names, paths = set(), set()
    for r in resources:
        name, path = str(r.get("name", "")), str(r.get("path", ""))
        if not NAME.fullmatch(name):
            out.append(("MANIFEST_BAD_NAME", path))
        if name in names:
            out.append(("MANIFEST_DUPLICATE_NAME", path))
        if path in paths:
            out.append(("MANIFEST_DUPLICATE_PATH", path))
        names.add(name)
        paths.add(path)
        if path in (MANIFEST, DIGEST):
            out.append(("MANIFEST_RESERVED_PATH", path))
            continue
        if not safe(path):
            out.append(("MANIFEST_UNSAFE_PATH", path))
        if path not in members:
            out.append(("MANIFEST_MISSING_MEMBER", path))
    return out + [("MANIFEST_UNLISTED_MEMBER", p) for p in sorted(members - paths - {MANIFEST, DIGEST}) if not p.endswith("/")]


def signature_state(digest: bytes | None, manifest: bytes | None) -> tuple[str, list[str]]:
    """(absent, unsigned, unverified or invalid; codes of what is invalid). No cryptography: the envelope's form and its hash."""
    if digest is None:
        return "absent", []
    try:
        d = json.loads(digest)
        if not isinstance(d, dict) or not isinstance(d.get("hash"), str):
            raise ValueError
    except ValueError:
        return "invalid", ["SIGNATURE_UNPARSEABLE"]
    bad = []
    if d.get("path") != MANIFEST:
        bad.append("SIGNATURE_PATH")
    if manifest is not None and d["hash"].lower() != "sha256:" + hashlib.sha256(manifest).hexdigest():
        bad.append("SIGNATURE_MANIFEST_HASH")
    s = d.get("signedData")
    if s is None:
        return ("invalid", bad) if bad else ("unsigned", [])
    keys = frozenset(s) if isinstance(s, dict) else frozenset()
    required = frozenset(("hash", "created", "software", "signature"))
    if not (required <= keys and (keys <= ANONYMOUS and "publicKey" in keys or keys <= DOMAIN and "domain" in keys)):
        bad.append("SIGNATURE_VARIANT")
    elif s["hash"] != d["hash"]:
        bad.append("SIGNATURE_HASH")
    return ("invalid", bad) if bad else ("unverified", [])


def _member_error(path: str, data: bytes | None, error: str | None) -> str | None:
    """First content problem of a member, or None."""
    if data is None:
        return "CONTENT_" + (error or "UNREADABLE").upper()
    try:
        if path.startswith("pages/"):
            for n, line in enumerate(data.decode().split("\n")[: -1 if data.endswith(b"\n") else None], 1):
                if not line.strip() or page_row("", path, n, line, n == 1, strict=True)[-1]:
                    return f"CONTENT_PAGE_LINE:{n}"
        elif path.startswith("indexes/") and path.endswith(".idx"):
            W.parse_summary(data.decode())
        elif path.startswith("indexes/"):
            before = None
            text = (W.gunzip(data) if path.endswith(".gz") else data).decode()
            for n, line in enumerate(text.split("\n")[: -1 if text.endswith("\n") else None], 1):
                at = W.parse_index_line(line)
                if at is None or not W.conforming(at[2]):
                    return f"CONTENT_INDEX_LINE:{n}"
                if before is not None and before > at[:2]:
                    return f"CONTENT_INDEX_ORDER:{n}"
                before = at[:2]
    except (W.FormatError, UnicodeDecodeError, ValueError) as e:
        return "CONTENT_" + getattr(e, "code", type(e).__name__.upper())
    return None


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Manifest, signature and resource findings of a package from its two manifest files and member names."""
    for pdf in batches:
        rows = []
        for package, names, manifest, digest in zip(pdf["package"], pdf["names"], pdf["manifest"], pdf["digest"], strict=True):
            manifest, digest = (None if x is None else bytes(x) for x in (manifest, digest))
            if manifest is not None:
                found, resources = manifest_problems(manifest)
                rows += [(package, "manifest", c, p) for c, p in found + resource_problems(resources, set(names))]
            state, bad = signature_state(digest, manifest)
            rows += [(package, "signature", c, None) for c in bad]
        yield pd.DataFrame(rows, columns=["package_id", "layer", "code", "path"])


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for package, manifest in zip(pdf["package"], pdf["manifest"], strict=True):
            for r in manifest_problems(bytes(manifest))[1] if manifest is not None else ():
                rows.append((package, str(r.get("path")), str(r.get("hash")), r.get("bytes") if isinstance(r.get("bytes"), int) else -1))
        yield pd.DataFrame(rows, columns=["package", "path", "hash", "bytes"])


def _content(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for package, path, data, error in zip(pdf["package"], pdf["path"], pdf["content"], pdf["error"], strict=True):
            code = _member_error(path, None if data is None else bytes(data), error)
            if code:
                rows.append((package, "content", code, path))
        yield pd.DataFrame(rows, columns=["package_id", "layer", "code", "path"])


def capture_error(read: bool = True) -> Column:
    """First disagreement of an index line with the record that ``read_captures`` found for it, or null; errors of reading
    come first unless ``read`` is false.

    Status, type and digest are compared where the line has them, a digest by its own algorithm."""
    c = F.col
    mime = F.when(c("record_type") == "revisit", "warc/revisit").otherwise(F.coalesce(P.content_type_essence(c("content_type")), P.content_type_essence(c("identified_payload_type")), F.lit("unk")))
    where = lambda entry, record: F.when(entry.isNotNull(), record)
    error = checks.match_error(c("url"), c("target_uri"), c("key"), c("ts_raw"), parse_rfc3339(c("warc_date")), c("status"), where(c("status"), F.coalesce("http_status", F.lit(-1))),
                               c("mime"), where(c("mime"), mime), c("digest"), where(c("digest"), F.coalesce("payload_digest", "computed_digest", F.lit("none"))))
    first = F.when(c("read_error").isNotNull() & F.lit(read), c("read_error")).when(~F.coalesce(c("record_type").isin("response", "revisit"), F.lit(False)), "RECORD_TYPE")
    return first.when(error.isin("URL", "KEY", "TIMESTAMP"), error).when(c("http_status").isNull(), "HTTP").otherwise(error)


def index_findings(spark: SparkSession, path: str) -> DataFrame:
    """First disagreement of each index line with the record in its range, and blocks that cannot be read.

    Only the ranges that lines name are read. Lines that don't parse belong to the content layer."""
    lines = spark.read.format("cdxj").option("mode", "permissive").load(path)
    lost = lines.where(F.col("line").isNull() & F.col("block").isNotNull()).select(F.col("package").alias("package_id"), F.concat(F.lit("INDEX_"), "error").alias("code"), F.concat_ws(":", "index_path", F.concat(F.lit("block "), F.col("block").cast("string"))).alias("path"))
    at = numbered_lines(lines.where(F.col("error").isNull())).select("package", "index_path", "line_no", "key", "ts_raw", "url", "digest", "mime", "status", "offset", "length", "filename", "record_digest")
    read = read_captures(at, compressed=True)
    # a member that the ZIP compresses is one finding for each of its lines, what disagrees in it another
    also = F.when((F.col("read_error") == "MEMBER_COMPRESSED") & F.col("record_type").isNotNull(), capture_error(read=False))
    found = read.withColumn("code", F.explode(F.array_compact(F.array(capture_error(), also)))).withColumn("code", F.concat(F.lit("INDEX_"), "code"))
    found = found.select(F.col("package").alias("package_id"), "code", F.concat_ws(":", "index_path", F.col("line_no").cast("string")).alias("path"))
    return found.unionByName(lost).select("package_id", F.lit("index").alias("layer"), "code", "path")


def layers_run(layers: tuple[str, ...] = LAYERS) -> tuple[str, ...]:
    """The layers that ``validate`` runs when asked for ``layers``: an index layer brings the content layer along. What is not
    among them is unknown, not clean."""
    return tuple(x for x in LAYERS if x in layers or (x == "content" and "index" in layers))


def layer_report(findings: DataFrame, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """(layer, findings): the number of findings of each layer, null for layers that were not run."""
    ran = layers_run(layers)
    rows = findings.sparkSession.createDataFrame([(x, x in ran) for x in LAYERS], "layer string, ran boolean")
    n = findings.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(n, "layer", "left").select("layer", F.when(F.col("ran"), F.coalesce("n", F.lit(0))).alias("findings"))


def validate(spark: SparkSession, path: str, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """Findings of the layers asked for; others are not built. An index layer brings the content layer along."""
    register(spark)
    members = spark.read.format("zipmembers").load(path)
    named = members.where(~F.col("is_dir")).select(F.col("package").alias("package_id"), "path", "compression")
    out = []
    if "layout" in layers:
        found = checks.layout(named)
        out.append(found.select("package_id", F.lit("layout").alias("layer"), "code", "path"))
    both = spark.read.format("zipcontent").option("prefix", "datapackage").load(path)
    pick = lambda p: F.max_by("content", F.when(F.col("path") == p, F.col("ordinal")))
    manifests = both.groupBy("package").agg(pick(MANIFEST).alias("manifest"), pick(DIGEST).alias("digest"))
    if {"manifest", "signature"} & set(layers):
        names = members.where(~F.col("is_dir")).groupBy("package").agg(F.collect_set("path").alias("names"))
        found = names.join(manifests, "package", "left").select("package", "names", "manifest", "digest").mapInPandas(_whole, FINDINGS)
        out.append(found.where(F.col("layer").isin(*layers)))
    if "fixity" in layers:
        listed = manifests.mapInPandas(_listed, "package string, path string, hash string, bytes long")
        hashed = spark.read.format("zipdigests").load(path).groupBy("package", "path").agg(F.max_by(F.struct(F.col("sha256").alias("sha"), F.col("size").alias("n")), "ordinal").alias("m"))
        at = listed.join(hashed, ["package", "path"])
        same = (F.lower("hash") == F.concat(F.lit("sha256:"), F.col("m.sha"))) & (F.col("bytes") == F.col("m.n"))
        out.append(at.where(~F.coalesce(same, F.lit(False))).select(F.col("package").alias("package_id"), F.lit("fixity").alias("layer"), F.lit("FIXITY_MISMATCH").alias("code"), "path"))
    if {"content", "index"} & set(layers):
        for prefix in ("pages/", "indexes/"):
            content = spark.read.format("zipcontent").option("prefix", prefix).load(path).where(~F.col("is_dir"))
            out.append(content.select("package", "path", "content", "error").mapInPandas(_content, FINDINGS))
        broken = spark.read.format("warc").option("mode", "permissive").load(path).where(F.col("error").isNotNull())
        out.append(broken.select(F.col("package").alias("package_id"), F.lit("content").alias("layer"), F.concat(F.lit("CONTENT_"), "error").alias("code"), F.col("member").alias("path")))
    if "index" in layers:
        out.append(index_findings(spark, path))
    return checks.union(out)


def resource_bytes(spark: SparkSession, path: str, resource: str) -> DataFrame:
    """(package, content) of a resource that the manifest lists with the size and digest its member has; no row otherwise."""
    register(spark)
    both = spark.read.format("zipcontent").option("prefix", "datapackage").load(path).where(F.col("path") == MANIFEST)
    manifests = both.groupBy("package").agg(F.max_by("content", "ordinal").alias("manifest"))
    listed = manifests.mapInPandas(_listed, "package string, path string, hash string, bytes long").where(F.col("path") == resource)
    content = spark.read.format("zipcontent").option("prefix", resource).load(path).where(F.col("path") == resource)
    last = content.groupBy("package", "path").agg(F.max_by("content", "ordinal").alias("content"))
    same = (F.lower("hash") == F.concat(F.lit("sha256:"), F.sha2("content", 256))) & (F.col("bytes") == F.octet_length("content"))
    return last.join(listed, ["package", "path"]).where(same).select("package", "content")


def conformant(findings: DataFrame) -> bool:
    return findings.isEmpty()


def package_lookup(spark: SparkSession, path: str, url: str, lo: str | None = None, hi: str | None = None, index_path: str | None = None) -> DataFrame:
    """Index lines of a URL in a time range over all indexes of the packages, plain and in blocks, ordered by time, key and
    index; of one index only with ``index_path``, in no order. Keys prune the blocks that are read."""
    from skeinlake.functions.stamps import parse_cdx
    from skeinlake.operators.index import in_range, url_keys

    register(spark)
    lines = spark.read.format("cdxj").load(path)
    lines = lines.where(F.col("key").isin(url_keys(lines, url))).withColumn("ts", parse_cdx(F.col("ts_raw")))
    lines = lines.where(in_range(F.col("ts"), lo, hi)) if lo or hi else lines
    return lines.where(F.col("index_path") == index_path) if index_path is not None else lines.orderBy("ts", "key", "index_path")


def captures_of(spark: SparkSession, path: str, url: str, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """``package_lookup`` with the record of each line, read by its range and checked against its digest."""
    return read_captures(package_lookup(spark, path, url, lo, hi))


__all__ = ["LAYERS", "capture_error", "captures_of", "conformant", "index_findings", "layer_report", "layers_run", "manifest_problems", "package_lookup", "parse_manifest", "repair_dates", "resource_bytes",
           "signature_fields", "signature_state", "validate"]
