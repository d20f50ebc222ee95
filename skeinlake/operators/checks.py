"""Constraint queries over members, manifests and indexes. Each gives findings: (package_id, code, path)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlake.functions import paths as P
from skeinlake.functions.stamps import canonical_sha256, digest_parts, same_precision
from skeinlake.functions.urls import surt_warcio, surt_wayback

MANIFEST, DIGEST = "datapackage.json", "datapackage-digest.json"
ROLES = ("author", "publisher", "maintainer", "wrangler", "contributor")
EXPECTED_VERSION = "1.1.1"


def _finding(df: DataFrame, code: str, path: Column | None = None) -> DataFrame:
    return df.select("package_id", F.lit(code).alias("code"), (F.col("path") if path is None else path).alias("path"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def layout(members: DataFrame) -> DataFrame:
    """Duplicate members, required members that are absent, misplaced names, unpaired block files, members that must be stored."""
    p = F.col("path")
    distinct = members.select("package_id", "path").distinct()
    has = distinct.groupBy("package_id").agg(
        F.bool_or(p == MANIFEST).alias("manifest"), F.bool_or(p == "pages/pages.jsonl").alias("pages"),
        F.bool_or(P.is_warc(p)).alias("warc"), F.bool_or(P.is_cdxj_index(p)).alias("index"))
    absent = F.explode(F.filter(F.array(*[F.when(~F.col(c), F.lit(f"LAYOUT_MISSING_{c.upper()}")) for c in ("manifest", "pages", "warc", "index")]), lambda c: c.isNotNull()))
    partner = distinct.select("package_id", p.alias("partner"))
    summaries = distinct.where(P.is_zipnum_summary(p)).withColumn("partner", P.zipnum_partner(p))
    return union([
        _finding(duplicates(members, ["package_id", "path"]), "LAYOUT_DUPLICATE"),
        has.select("package_id", absent.alias("code"), F.lit(None).cast("string").alias("path")),
        _finding(distinct.where(p.startswith("archive/") & ~P.is_warc(p)), "LAYOUT_BAD_WARC_PATH"),
        _finding(distinct.where(p.startswith("indexes/") & ~P.is_cdxj_index(p) & ~P.is_zipnum_summary(p)), "LAYOUT_BAD_INDEX_PATH"),
        _finding(summaries.join(partner, ["package_id", "partner"], "left_anti"), "LAYOUT_INCOMPLETE_INDEX"),
        _finding(members.where(P.requires_stored(p) & (F.col("compression") != "stored")).select("package_id", "path").distinct(), "LAYOUT_NOT_STORED"),
    ])


def manifest_resources(resources: DataFrame, members: DataFrame) -> DataFrame:
    """Bad names, repeated names and paths (each repetition), reserved or unsafe paths, resources without a member and members without a resource."""
    p = F.col("path")
    reserved = p.isin(MANIFEST, DIGEST)
    seen = members.select("package_id", "path").distinct()
    # a repetition is a row behind the first of its group; the group's first is an aggregate, so no group is sorted
    firsts = lambda c: resources.groupBy("package_id", c).agg(F.min("ord").alias("__first"))
    repeated = lambda c: resources.join(firsts(c), ["package_id", c]).where(F.col("ord") > F.col("__first"))
    listed = resources.select("package_id", "path").distinct()
    return union([
        _finding(resources.where(~P.valid_name(F.col("name"))), "MANIFEST_BAD_NAME"),
        _finding(repeated("name"), "MANIFEST_DUPLICATE_NAME"),
        _finding(repeated("path"), "MANIFEST_DUPLICATE_PATH"),
        _finding(resources.where(reserved), "MANIFEST_RESERVED_PATH"),
        _finding(resources.where(~reserved & ~P.is_safe(p)), "MANIFEST_UNSAFE_PATH"),
        _finding(resources.where(~reserved).join(seen, ["package_id", "path"], "left_anti"), "MANIFEST_MISSING_MEMBER"),
        _finding(seen.where(~reserved).join(listed, ["package_id", "path"], "left_anti"), "MANIFEST_UNLISTED_MEMBER"),
    ])


def fixity(resources: DataFrame, members: DataFrame) -> DataFrame:
    """(package_id, path, status) of each distinct resource: verified, mismatched or missing. Where a path is listed more than
    once the row listed last counts; digests are compared by value."""
    last = members.groupBy("package_id", "path").agg(F.max_by(F.struct("hash", "size"), F.struct("listed_at", "member_id")).alias("m"))
    same = (canonical_sha256(F.col("hash")) == canonical_sha256(F.col("m.hash"))) & (F.col("bytes") == F.col("m.size"))
    status = F.when(F.col("m").isNull(), "missing").when(F.coalesce(same, F.lit(False)), "verified").otherwise("mismatched")
    return resources.join(last, ["package_id", "path"], "left").select("package_id", "path", status.alias("status")).distinct()


def conformance(findings: DataFrame, packages: DataFrame) -> DataFrame:
    """(package_id, conformant) for every package."""
    bad = findings.select("package_id").distinct().withColumn("__bad", F.lit(True))
    return packages.select("package_id").distinct().join(bad, "package_id", "left").select("package_id", F.col("__bad").isNull().alias("conformant"))


def match_error(url: Column, target: Column, key: Column, ts_raw: Column, record_ts: Column, status: Column, record_status: Column, mime: Column, record_mime: Column, digest: Column, record_digest: Column) -> Column:
    """First of the checks of an index entry against its record that fails, in the order identity, HTTP, digest; null if none does."""
    a, b = digest_parts(digest), digest_parts(record_digest)
    # a digest that cannot be read equals none, not even itself
    same = F.when(digest.isNull() | record_digest.isNull(), digest.isNull() & record_digest.isNull()).otherwise(F.coalesce((a.algorithm == b.algorithm) & (a.hex == b.hex), F.lit(False)))
    return (
        F.when(~url.eqNullSafe(target), "URL").when(~key.isin(surt_wayback(target), surt_warcio(target)), "KEY")
        .when(~F.coalesce(same_precision(ts_raw, record_ts), F.lit(False)), "TIMESTAMP").when(~status.eqNullSafe(record_status), "STATUS")
        .when(~F.lower(mime).eqNullSafe(F.lower(record_mime)), "MIME").when(~same, "DIGEST")
    )
