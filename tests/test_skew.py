"""Tree aggregation against one plain group-by."""

from pyspark.sql import functions as F

from skeinlake.operators.skew import heavy_keys, key_statistics, tree_aggregate


def test_tree_has_as_many_rounds_as_the_input_needs(spark):
    df = spark.range(0, 20000, 1, 40).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), F.col("id").alias("n_rows"))
    want = {tuple(r) for r in df.groupBy("key").agg(F.count("*"), F.sum("n_rows")).collect()}
    for fan_in in (2, 16, 64):
        got = tree_aggregate(df, ["key"], {"rows": F.count("*"), "total": F.sum("n_rows")}, {"rows": F.sum, "total": F.sum}, fan_in=fan_in)
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    rounds = lambda k: tree_aggregate(df, ["key"], {"rows": F.count("*")}, {"rows": F.sum}, fan_in=k)._jdf.queryExecution().analyzed().toString().count("Aggregate")
    assert (rounds(64), rounds(16), rounds(2)) == (1, 2, 6)
    assert tree_aggregate(df.limit(0), ["key"], {"rows": F.count("*")}, {"rows": F.sum}).count() == 0


def test_statistics_of_awkward_rows(spark):
    rows = [("a", "d1", "2020"), ("a", None, None), ("a", "d1", "2019"), (None, "d2", "2021"), ("b", None, None)] + [("hot", f"d{i % 5}", str(3000 + i)) for i in range(400)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "key string, digest string, ts_raw string, n int")
    got = {r["key"]: tuple(r)[1:] for r in key_statistics(df, ["key"]).collect()}
    assert got == {"a": (3, "2019", "2020", 1), None: (1, "2021", "2021", 1), "b": (1, None, None, 0), "hot": (400, "3000", "3399", 5)}
    assert [(r["src_table"], r["key"]) for r in heavy_keys({"t": df}, 0.02).collect()] == [("t", "hot")]
