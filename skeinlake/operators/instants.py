"""Normalised instants for tables of date texts (problem 3)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.functions.instants import parse_instant

#: src_table -> (id column, text column)
DATE_TEXTS = {"raw_pages": ("raw_id", "ts"), "manifest_dates": ("date_id", "value")}


def _udf():
    @F.pandas_udf("long")
    def epoch_us(text: pd.Series, zone: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        out = [
            parse_instant(t, z or None, None if a is None else int(a), None if b is None else int(b))
            for t, z, a, b in zip(*(s.astype(object).where(s.notna(), None) for s in (text, zone, lo, hi)), strict=True)
        ]
        return pd.Series(out, dtype="Int64")

    return epoch_us


def date_texts(tables: dict[str, DataFrame]) -> DataFrame:
    """(src_table, row_id, package_id, value) of all rows that hold a text."""
    out = None
    for name, df in tables.items():
        row_id, column = DATE_TEXTS[name]
        part = df.where(F.col(column).isNotNull()).select(F.lit(name).alias("src_table"), F.col(row_id).cast("long").alias("row_id"), "package_id", F.col(column).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def normalise_instants(rows: DataFrame, packages: DataFrame) -> DataFrame:
    """(src_table, row_id, value, epoch_us); epoch_us is null where the text names no instant.

    Rows of unknown packages are kept and read as UTC without a crawl. Repeated package ids
    count once (the least zone, the widest crawl), so no row is repeated.
    """
    day = lambda c: F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))
    known = packages.where(F.col("package_id").isNotNull()).groupBy("package_id").agg(
        F.min("zone").alias("zone"), F.min(day(F.col("crawl_start"))).alias("lo"), F.max(day(F.col("crawl_end"))).alias("hi"))
    return rows.join(known, "package_id", "left").select(
        "src_table", "row_id", "value", _udf()("value", "zone", "lo", "hi").alias("epoch_us"))


def nonconforming_instants(rows: DataFrame, packages: DataFrame) -> DataFrame:
    """(src_table, row_id, epoch_us) of texts that name an instant without being ``YYYY-MM-DDTHH:MM:SSZ``."""
    loose = rows.where(~F.col("value").rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z"))
    return normalise_instants(loose, packages).where(F.col("epoch_us").isNotNull()).select("src_table", "row_id", "epoch_us")
