"""Page lists: annotations merged by record, joined to page drafts, routed and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_annotations(metadata: DataFrame) -> DataFrame:
    """(record_id, title, via, page_url) of rows (ord, record_id, title, via, page_url): the last title that is not
    empty, the last page_url that is not null, and whether any row has via. Partial aggregates carry one state a record."""
    has_title = F.when(F.col("title").isNotNull() & (F.col("title") != ""), F.col("ord"))
    return metadata.groupBy("record_id").agg(
        F.max_by("title", has_title).alias("title"), F.bool_or(F.coalesce("via", F.lit(False))).alias("via"),
        F.max_by("page_url", F.when(F.col("page_url").isNotNull(), F.col("ord"))).alias("page_url"),
    )


def annotate(drafts: DataFrame, annotations: DataFrame, only_annotated: bool = False) -> DataFrame:
    """Drafts (ord, record_id, url, ts_text, title) with their annotations: a recorded title beats the draft's, a
    recorded URL replaces it, even an empty one. Drafts keep their order and their repetitions."""
    a = annotations.select("record_id", F.col("title").alias("__title"), F.coalesce("via", F.lit(False)).alias("__via"), "page_url")
    at = drafts.join(a, "record_id", "left")
    if only_annotated:
        at = at.where(F.col("page_url").isNotNull())
    return at.select("ord", "record_id", F.coalesce("page_url", "url").alias("url"), "ts_text", F.coalesce("__title", "title").alias("title"), F.coalesce("__via", F.lit(False)).alias("via"))


def main_page(pages: DataFrame) -> DataFrame:
    """One row (url, ts_text): the first page in order that is no extra page; none where there is none."""
    return pages.where(~F.col("via")).agg(F.min_by(F.struct("url", "ts_text"), "ord").alias("m")).where(F.col("m").isNotNull()).select("m.*")


def first_record(rows: DataFrame, group: list[str], order: str, columns: list[str]) -> DataFrame:
    """The first row of each group in order."""
    return rows.groupBy(*group).agg(F.min_by(F.struct(*columns), order).alias("f")).select(*group, "f.*")


def mime_type(record_type: Column, content_type: Column, identified: Column) -> Column:
    from skeinlake.functions.paths import content_type_essence

    return F.when(record_type == "revisit", "warc/revisit").otherwise(F.coalesce(content_type_essence(content_type), identified, F.lit("unk")))


def skip_reason(status: Column, payload: Column, ts: Column) -> Column:
    """Why a capture is rejected, the first reason that holds; null for accepted ones."""
    return F.when(status.isNull(), "HTTP_UNPARSEABLE").when(payload.isNull(), "PAYLOAD_UNDETERMINED").when(ts.isNull(), "TIMESTAMP_UNREPRESENTABLE")
