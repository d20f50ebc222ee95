"""References to records that do not exist at the time of the reference (problem 2).

Parent and child keys are put into one long table, tagged by side, and grouped by key. Children
enter it already reduced to one row a key, so a key that owns a third of all references sends one
row per map task. Groups that some listing covers for the whole span of their references end
there; the others (no parent flag, or a gap in the cover) carry the listing's intervals back to
the references, which never move in groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ref_table -> (id column, column that names a path)
REFERENCES = {
    "captures": ("capture_id", "index_path"),
    "zipnum_blocks": ("block_id", "data_path"),
    "resources": ("resource_id", "path"),
}


def clean_path(path: Column) -> Column:
    """``path`` without empty and ``.`` segments; ``..`` and case stay as they are."""
    dirty = path.rlike(r"(^|/)\.?(/|$)")
    kept = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    return F.when(dirty, F.array_join(kept, "/")).otherwise(path)


def child_rows(children: dict[str, DataFrame]) -> DataFrame:
    """(ref_table, row_id, package_id, path, seen_at) of every non-null reference."""
    parts = []
    for name, df in children.items():
        row_id, column = REFERENCES[name]
        parts.append(
            df.where(F.col(column).isNotNull()).select(
                F.lit(name).alias("ref_table"), F.col(row_id).cast("long").alias("row_id"), "package_id",
                clean_path(F.col(column)).alias("path"), F.col("seen_at"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def key_states(members: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each referenced key that is not covered throughout: the long-form group.

    ``spans`` holds the distinct listing intervals of the key. Rows that differ only in
    ``listed_at`` are one interval from the earliest of them, so repeated listings add nothing;
    its length is the number of distinct removal times of one path in one package.
    """
    parents = (
        members.where(F.col("path").isNotNull())
        .groupBy("package_id", "path", "removed_at").agg(F.min("listed_at").alias("listed_at"))
        .select("package_id", "path", F.lit(True).alias("is_parent"), "listed_at", "removed_at",
                F.lit(None).cast("timestamp_ntz").alias("lo"), F.lit(None).cast("timestamp_ntz").alias("hi"))
    )
    keys = (
        rows.groupBy("package_id", "path").agg(F.min("seen_at").alias("lo"), F.max("seen_at").alias("hi"))
        .select("package_id", "path", F.lit(False).alias("is_parent"), F.lit(None).cast("timestamp_ntz").alias("listed_at"),
                F.lit(None).cast("timestamp_ntz").alias("removed_at"), "lo", "hi")
    )
    span = F.when(F.col("is_parent"), F.struct("listed_at", "removed_at"))
    grouped = parents.unionByName(keys).groupBy("package_id", "path").agg(
        F.max("is_parent").alias("has_parent"), F.collect_list(span).alias("spans"), F.max("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    covered = F.exists("spans", lambda s: (s.listed_at <= F.col("lo")) & (s.removed_at.isNull() | (s.removed_at > F.col("hi"))))
    return grouped.where(F.col("lo").isNotNull() & ~(F.col("has_parent") & F.coalesce(covered, F.lit(False)))).select("package_id", "path", "has_parent", "spans")


def orphan_references(members: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """(ref_table, row_id, reason, seen_at) of every reference without a live member row.

    Null paths are no references. A reference of a row without ``package_id`` is ``missing``. A
    row without ``seen_at`` finds no member listed by then: ``missing`` or ``late``. Repeated ids
    give one row for each repetition. Columns beside those named above are ignored.
    """
    rows = child_rows(children)
    states = key_states(members.where(F.col("package_id").isNotNull()), rows.where(F.col("package_id").isNotNull()))
    bare = rows.where(F.col("package_id").isNull()).select("ref_table", "row_id", F.lit("missing").alias("reason"), "seen_at")
    timeless = rows.where(F.col("package_id").isNotNull() & F.col("seen_at").isNull())
    known = members.where(F.col("path").isNotNull() & F.col("package_id").isNotNull()).select("package_id", "path").distinct().withColumn("known", F.lit(True))
    timeless = timeless.join(known, ["package_id", "path"], "left").select(
        "ref_table", "row_id", F.when(F.col("known"), "late").otherwise("missing").alias("reason"), "seen_at")
    joined = rows.where(F.col("seen_at").isNotNull()).join(states, ["package_id", "path"])
    listed = F.exists("spans", lambda s: s.listed_at <= F.col("seen_at"))
    live = F.exists("spans", lambda s: (s.listed_at <= F.col("seen_at")) & (s.removed_at.isNull() | (s.removed_at > F.col("seen_at"))))
    reason = F.when(~F.col("has_parent"), "missing").when(listed, "deleted").otherwise("late")
    found = joined.where(~F.coalesce(live, F.lit(False))).select("ref_table", "row_id", reason.alias("reason"), "seen_at")
    return found.unionByName(bare).unionByName(timeless)


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans by table, month of ``seen_at`` and reason."""
    month = F.date_format("seen_at", "yyyy-MM")
    return orphans.groupBy("ref_table", month.alias("month"), "reason").agg(F.count("*").alias("orphans"))
