"""Streams over files, run to their end."""

from skeinlake.session import table
from skeinlake.streaming.ingest import annotated_pages, captures_per_window, distinct_captures

ROOT = "/root/testdata/sf0.001"


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_captures(spark, tmp_path):
    rows = table(spark, ROOT, "captures").limit(300)
    rows.unionByName(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    keys = ["package_id", "index_path", "key", "ts_raw", "digest"]
    assert drain(distinct_captures(stream, "4000 days"), "caps").count() == rows.select(*keys).distinct().count()
    total = drain(captures_per_window(stream, late="4000 days"), "win", "complete").agg({"n": "sum"}).first()[0]
    assert total == 600


def test_annotations_before_and_after(spark, tmp_path):
    spark.sql("select 1L record_id, 'http://a.test/x' url, timestamp'2024-01-01 10:00:00' at union all select 2, 'http://a.test/y', timestamp'2024-01-01 10:00:00'").write.parquet(str(tmp_path / "d"))
    spark.sql("select 1L record_id, 'early' title, timestamp'2024-01-01 09:30:00' at union all select 2, 'too late', timestamp'2024-01-01 12:00:00'").write.parquet(str(tmp_path / "a"))
    d = spark.readStream.schema("record_id long, url string, at timestamp").parquet(str(tmp_path / "d"))
    a = spark.readStream.schema("record_id long, title string, at timestamp").parquet(str(tmp_path / "a"))
    got = {(r["record_id"], r["title"]) for r in drain(annotated_pages(d, a), "pages_out").collect()}
    assert (1, "early") in got and (2, "too late") not in got
