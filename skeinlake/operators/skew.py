"""Per-key results where a few keys hold most rows (problem 4).

A tree instead of one reducer a key. The chunks are the input's partitions, whose size the scan fixes:
each map task combines its own rows to one state a key. Then ``fan_in`` neighbouring chunks meet, then
``fan_in`` of those, until one state a key is left, so the rounds are logarithmic in the input and no
reducer gets more than ``fan_in`` states of a key, however many rows the key has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_IN = 16


def tree_aggregate(df: DataFrame, keys: list[str], first: dict[str, Column], merge: dict[str, Callable[[str], Column]],
                   chunks: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """``first`` makes the state of a chunk, ``merge`` combines states; one row a key comes out.

    ``chunks`` is the number of partitions of ``df``, at most; it is asked of ``df`` where it is not given, which
    costs nothing for scans. Null keys form a group of their own, as in GROUP BY; an empty input gives no row.
    """
    nodes = -(-max(chunks or df.rdd.getNumPartitions(), 1) // fan_in)
    at = df.withColumn("__node", F.floor(F.spark_partition_id() / fan_in).cast("int")).groupBy(*keys, "__node").agg(*[c.alias(n) for n, c in first.items()])
    while nodes > 1:
        up = F.floor(F.col("__node") / fan_in).cast("int")
        nodes = -(-nodes // fan_in)
        at = at.groupBy(*keys, up.alias("__node")).agg(*[m(n).alias(n) for n, m in merge.items()])
    return at.drop("__node")


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_rows)."""
    return tree_aggregate(df.select(*keys), keys, {"n_rows": F.count(F.lit(1))}, {"n_rows": F.sum})


def key_statistics(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_rows, first_ts, last_ts, n_digests), all exact.

    Distinct digests are counted by making the digest part of the first grouping, which spreads
    a heavy key over its digests; each digest is then in one chunk, so that partial counts add up.
    ``ts_raw`` is compared as text; nulls in it or in ``digest`` are skipped, the rows still count.
    """
    by_digest = df.select(*keys, "digest", "ts_raw").groupBy(*keys, "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_raw").alias("lo"), F.max("ts_raw").alias("hi"))
    return tree_aggregate(
        by_digest, keys,
        {"n_rows": F.sum("n"), "first_ts": F.min("lo"), "last_ts": F.max("hi"), "n_digests": F.count("digest")},
        {"n_rows": F.sum, "first_ts": F.min, "last_ts": F.max, "n_digests": F.sum},
        chunks=int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
    )


def tagged(tables: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """The tables under each other with their name as ``src_table``."""
    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("src_table"), *columns)
        out = part if out is None else out.unionByName(part)
    return out


def heavy_keys(tables: dict[str, DataFrame], share: float = 0.02) -> DataFrame:
    """(src_table, key, n_rows) of keys with more than ``share`` of their table's rows; null is no key."""
    counts = key_counts(tagged(tables, ["key"]), ["src_table", "key"])
    totals = counts.groupBy("src_table").agg(F.sum("n_rows").alias("total"))
    # one row a table: its size is the number of tables named by the caller
    return counts.join(F.broadcast(totals), "src_table").where(F.col("key").isNotNull() & (F.col("n_rows") > F.lit(share) * F.col("total"))).select("src_table", "key", "n_rows")
