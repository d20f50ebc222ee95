"""Capture indexes: lines, sorted and deduplicated files, compressed blocks, and lookups over both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.functions.stamps import parse_cdx
from skeinlake.functions.urls import lookup_keys
from skeinlake.operators.ordered import numbered, running_offset, with_previous

BLOCK_LINES = 1024


def cdxj_line(key: Column, ts_raw: Column, **fields: Column) -> Column:
    """``key SP timestamp SP json``; fields that are null are left out."""
    body = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return F.concat_ws(" ", key, ts_raw, body)


def capture_lines(captures: DataFrame) -> DataFrame:
    """(line): the index line of each capture."""
    c = F.col
    return captures.select(cdxj_line(c("key"), c("ts_raw"), url=c("url"), digest=c("digest"), mime=c("mime"), status=c("status"), offset=c("byte_offset"),
                                     length=c("byte_length"), filename=c("filename"), recordDigest=c("record_digest")).alias("line"))


def build_index(lines: DataFrame) -> DataFrame:
    """(line): distinct lines in byte order. Repeated lines go in the map tasks already; the sort spills."""
    return lines.select("line").where(F.col("line").isNotNull()).distinct().orderBy("line")


def assign_blocks(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(line, ordinal, block_no) of distinct lines: each ``block_lines`` lines in order are a block."""
    return numbered(lines.select("line").where(F.col("line").isNotNull()).distinct(), [F.col("line")]).withColumn("block_no", F.floor(F.col("ordinal") / block_lines))


def block_summary(blocks: DataFrame) -> DataFrame:
    """(block_no, first_prefix, n_lines, n_bytes) of assigned blocks; a prefix is key and timestamp."""
    first = F.min("line")
    return blocks.groupBy("block_no").agg(F.substring_index(first, " ", 2).alias("first_prefix"), F.count(F.lit(1)).alias("n_lines"), F.sum(F.octet_length("line") + 1).alias("n_bytes"))


def order_violations(lines: DataFrame, group: list[str], position: list[str]) -> DataFrame:
    """Rows whose (key, ts_raw) is below that of the row before them in their index."""
    at = with_previous(lines, group, position, ["key", "ts_raw"])
    return at.where(F.col("previous") > F.struct("key", "ts_raw"))


def first_violation(violations: DataFrame, group: list[str], position: str) -> DataFrame:
    return violations.groupBy(*group).agg(F.min(position).alias(position))


def candidate_blocks(blocks: DataFrame, keys: DataFrame, group: list[str]) -> DataFrame:
    """(group, block_no, k) of blocks that may hold lines of a key: block i whose first key is at most k and whose
    successor's first key is at least k, or that has no successor.

    The successor comes from a window over one summary file, whose size its writer bounds.
    """
    upper = F.lead("key").over(Window.partitionBy(*group).orderBy("block_no"))
    ranged = blocks.withColumn("__upper", upper)
    return ranged.join(keys.select(F.col("k")).distinct(), (F.col("key") <= F.col("k")) & (F.col("__upper").isNull() | (F.col("__upper") >= F.col("k")))).select(*group, "block_no", "k")


def in_range(ts: Column, lo: str | None = None, hi: str | None = None, lo_inclusive: bool = True, hi_inclusive: bool = False) -> Column:
    """Predicate of a time range with any kind of bound, on instants."""
    out = F.lit(True)
    if lo is not None:
        out = out & ((ts >= F.lit(lo).cast("timestamp")) if lo_inclusive else (ts > F.lit(lo).cast("timestamp")))
    if hi is not None:
        out = out & ((ts <= F.lit(hi).cast("timestamp")) if hi_inclusive else (ts < F.lit(hi).cast("timestamp")))
    return out


def url_keys(df: DataFrame, url: str) -> list[str]:
    """The one or two lookup keys of a URL, evaluated on one row."""
    return df.sparkSession.range(1).select(lookup_keys(F.lit(url)).alias("k")).first()["k"]


def lookup(captures: DataFrame, url: str, lo: str | None = None, hi: str | None = None, index_path: str | None = None) -> DataFrame:
    """Captures of a URL in a time range, ordered by time, key and index. The keys are literals, so they reach the scan."""
    at = captures.where(F.col("key").isin(url_keys(captures, url)))
    if index_path is not None:
        at = at.where(F.col("index_path") == index_path)
    at = at.withColumn("ts", parse_cdx(F.col("ts_raw"))).where(in_range(F.col("ts"), lo, hi) if lo or hi else F.lit(True))
    return at.orderBy("ts", "key", "index_path")


def lookup_many(captures: DataFrame, urls: DataFrame) -> DataFrame:
    """Captures of every URL of ``urls`` (column url): an equality join on keys, broadcast only where the planner finds one side small."""
    keys = urls.select(F.col("url").alias("asked"), F.explode(lookup_keys(F.col("url"))).alias("key")).distinct()
    return captures.join(keys, "key")


def block_offsets(summary: DataFrame) -> DataFrame:
    """Byte offset of each block: the running sum of the lengths before it."""
    return running_offset(summary, [F.col("block_no")], "n_bytes", "byte_offset")
