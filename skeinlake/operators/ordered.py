"""Positions, running sums and predecessors over one global order, without a single-task window.

Rows are range-partitioned and sorted; each partition is numbered by itself, and what a partition
needs from those before it (a count, a sum, a last row) is one row a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.session import cut_lineage

_MASK = (1 << 33) - 1


def sorted_parts(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """``df`` in order, with ``__part`` and ``__row`` (from 0 in its part). Cut from its lineage, so that both stay."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    done = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return cut_lineage(done.withColumn("__at", at).select("*", F.shiftright("__at", 33).cast("int").alias("__part"), F.col("__at").bitwiseAND(F.lit(_MASK)).alias("__row")).drop("__at"))


def _before(totals: DataFrame, column: str) -> DataFrame:
    """Sum of ``column`` over earlier parts; one row a part, as many as there are partitions."""
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select("__part", F.coalesce(F.sum(column).over(w), F.lit(0)).alias("__before")))


def numbered(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """``df`` with its position in ``order``, from 0."""
    parts = sorted_parts(df, order)
    totals = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    return parts.join(_before(totals, "n"), "__part").withColumn(name, F.col("__before") + F.col("__row")).drop("__part", "__row", "__before")


def running_offset(df: DataFrame, order: list[Column], length: str, name: str = "running_offset") -> DataFrame:
    """``df`` with the sum of ``length`` over the rows before, 0 for the first; null lengths count as 0."""
    parts = sorted_parts(df, order)
    totals = parts.groupBy("__part").agg(F.sum(length).alias("n")).fillna(0, ["n"])
    w = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum(length).over(w), F.lit(0))
    return parts.withColumn("__here", here).join(_before(totals, "n"), "__part").withColumn(name, F.col("__before") + F.col("__here")).drop("__part", "__row", "__before", "__here")


def with_previous(df: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``df`` with ``previous`` : a struct of ``columns`` of the row before it in its group, null for the first.

    A group may span parts; the last row of each part is carried over.
    """
    parts = sorted_parts(df, [F.col(c) for c in (*group, *order)])
    value = F.struct(*columns)
    w = Window.partitionBy("__part").orderBy("__row")
    key = F.struct(*group)
    last = parts.groupBy("__part").agg(F.max_by(F.struct(key.alias("k"), value.alias("v")), "__row").alias("last"))
    carried = F.lag("last").over(Window.orderBy("__part"))
    before = F.broadcast(last.select("__part", carried.alias("__carried")))
    at = parts.withColumn("__prev", F.coalesce(F.lag(F.struct(key.alias("k"), value.alias("v"))).over(w)))
    at = at.join(before, "__part").withColumn("__prev", F.when(F.col("__row") == 0, F.col("__carried")).otherwise(F.col("__prev")))
    return at.withColumn("previous", F.when(F.col("__prev.k").eqNullSafe(key), F.col("__prev.v"))).drop("__part", "__row", "__prev", "__carried")
