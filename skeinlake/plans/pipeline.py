"""Queries over the core pipeline operators (problems 2, 3 and 4) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.operators.instants import DATE_TEXTS, date_texts, nonconforming_instants, normalise_instants
from skeinlake.operators.orphans import REFERENCES, orphan_counts, orphan_references
from skeinlake.operators.skew import heavy_keys, key_statistics, tagged
from skeinlake.session import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(table(spark, d, "members"), {n: table(spark, d, n) for n in REFERENCES})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "row_id", "reason")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(_orphans(spark, d))


def _dates(spark: SparkSession, d: str) -> DataFrame:
    return date_texts({n: table(spark, d, n) for n in DATE_TEXTS})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nonconforming_instants(_dates(spark, d), table(spark, d, "packages"))


def p3_instants(spark: SparkSession, d: str) -> DataFrame:
    return normalise_instants(_dates(spark, d), table(spark, d, "packages")).select("src_table", "row_id", "epoch_us")


def _keyed(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in ("captures", "zipnum_blocks")}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(_keyed(spark, d)).select("src_table", "key")


def p4_key_statistics(spark: SparkSession, d: str) -> DataFrame:
    return key_statistics(tagged(_keyed(spark, d), ["key", "digest", "ts_raw"]), ["src_table", "key"])


QUERIES = {
    "p2_found": p2_found, "p2_counts": p2_counts, "p3_found": p3_found, "p3_instants": p3_instants,
    "p4_found": p4_found, "p4_key_statistics": p4_key_statistics,
}

_REFS = """
  WITH refs AS (
    SELECT 'captures' AS ref_table, capture_id AS row_id, package_id, index_path AS path, seen_at FROM captures
    UNION ALL SELECT 'zipnum_blocks', block_id, package_id, data_path, seen_at FROM zipnum_blocks
    UNION ALL SELECT 'resources', resource_id, package_id, path, seen_at FROM resources),
  clean AS (
    SELECT ref_table, row_id, package_id, seen_at,
      array_to_string(list_filter(string_split(path, '/'), lambda s: s <> '' AND s <> '.'), '/') AS path
    FROM refs WHERE path IS NOT NULL),
  judged AS (
    SELECT c.ref_table, c.row_id, any_value(c.seen_at) AS seen_at, count(m.member_id) AS n_any,
      count(*) FILTER (m.listed_at <= c.seen_at) AS n_listed,
      count(*) FILTER (m.listed_at <= c.seen_at AND (m.removed_at IS NULL OR m.removed_at > c.seen_at)) AS n_live
    FROM clean c LEFT JOIN members m ON m.package_id = c.package_id AND m.path = c.path
    GROUP BY c.ref_table, c.row_id),
  orphans AS (
    SELECT ref_table, row_id, seen_at, CASE WHEN n_any = 0 THEN 'missing' WHEN n_listed > 0 THEN 'deleted' ELSE 'late' END AS reason
    FROM judged WHERE n_live = 0)
"""
_KEYED = """
  WITH keyed AS (SELECT 'captures' AS src_table, key, digest, ts_raw FROM captures
    UNION ALL SELECT 'zipnum_blocks', key, digest, ts_raw FROM zipnum_blocks)
"""
SQL = {
    "p2_found": _REFS + "SELECT ref_table, row_id, reason FROM orphans",
    "p2_counts": _REFS + "SELECT ref_table, strftime(seen_at, '%Y-%m') AS month, reason, count(*) AS orphans FROM orphans GROUP BY ALL",
    "p4_found": _KEYED + """, n AS (SELECT src_table, key, count(*) AS n FROM keyed GROUP BY ALL)
      SELECT src_table, key FROM (SELECT *, sum(n) OVER (PARTITION BY src_table) AS total FROM n) WHERE key IS NOT NULL AND n > 0.02 * total""",
    "p4_key_statistics": _KEYED + """SELECT src_table, key, count(*) AS n_rows, min(ts_raw) AS first_ts, max(ts_raw) AS last_ts,
      count(DISTINCT digest) AS n_digests FROM keyed GROUP BY src_table, key""",
}
