"""Queries over the text operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.llm.boilerplate import boilerplate_lines, main_body
from skeinlake.llm.garble import garbled_fields
from skeinlake.llm.leakage import LEAK, leaks
from skeinlake.llm.near_dup import near_duplicate_groups, near_duplicate_pairs
from skeinlake.llm.packing import pack
from skeinlake.llm.residue import residue_fields
from skeinlake.llm.sentences import sentences
from skeinlake.session import spread, table


#: Columns of wacz_pages that the operators read; no others move.
PAGE = ("page_id", "url", "title", "text")


def _wide(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return spread(table(spark, d, name).select(*columns))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(_wide(spark, d, "wacz_pages", *PAGE)).toDF("page_id_a", "page_id_b", "similarity").select("page_id_a", "page_id_b")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Class of every page, of any language and length: five words, a similarity of 0.8."""
    return near_duplicate_groups(_wide(spark, d, "wacz_pages", *PAGE)).toDF("page_id", "class_id", "links")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled_fields(_wide(spark, d, "wacz_pages", *PAGE), restore=False).select(F.col("id").alias("page_id"), "field").distinct()


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled_fields(_wide(spark, d, "wacz_pages", *PAGE)).withColumnRenamed("id", "page_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return residue_fields(_wide(spark, d, "wacz_pages", *PAGE)).select(F.col("id").alias("page_id"), "field").distinct()


def _content_pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(pages whose text is no case of problem 6, ids of the others)."""
    pages = _wide(spark, d, "wacz_pages", *PAGE)
    residue = residue_fields(pages.select("page_id", "title", "text"), ("text",), counted=("title", "text")).select(F.col("id").alias("page_id")).distinct()
    return pages.select("page_id", "url", "text").join(residue, "page_id", "left_anti"), residue


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate_lines(_content_pages(spark, d)[0]).distinct()


def p7_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Main bodies; pages whose text is a case of problem 6 keep it whole and are marked ``is_residue``."""
    pages, residue = _content_pages(spark, d)
    kept = table(spark, d, "wacz_pages").select("page_id", F.col("text").alias("body")).join(residue, "page_id", "left_semi")
    return main_body(pages).withColumn("is_residue", F.lit(False)).unionByName(kept.withColumn("is_residue", F.lit(True)))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences(_wide(spark, d, "documents", "doc_id", "text")).distinct()


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(_wide(spark, d, "documents", "doc_id", "text"), table(spark, d, "pack_targets"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(_wide(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items").select("item_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where(F.col("run_words") >= LEAK).select("doc_id", "item_id").distinct()


def p9_alignments(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


QUERIES = {"p8_packed": p8_packed, "p9_found": p9_found, "p9_alignments": p9_alignments, "p10_found": p10_found, "p7_found": p7_found, "p7_bodies": p7_bodies, "p6_found": p6_found, "p1_found": p1_found, "p1_groups": p1_groups, "p5_found": p5_found, "p5_restored": p5_restored}

SQL: dict[str, str] = {}
