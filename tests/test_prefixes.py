"""Running sizes: rows until a limit, however the input is dealt."""

from pyspark.sql import functions as F

from terrace.operators.relational import greedy_prefix


def test_row_that_goes_over_in_its_own_part_still_counts_for_later_rows_of_other_parts(spark):
    one = spark.createDataFrame([("a", 1, 8), ("a", 2, 5)], "k string, n int, size int").coalesce(1)
    two = spark.createDataFrame([("a", 3, 1), ("a", 4, 1)], "k string, n int, size int").coalesce(1)
    out = greedy_prefix(one.unionByName(two), ["k"], [F.col("n")], F.col("size"), 10)
    assert [tuple(r) for r in out.select("n", "used").collect()] == [(1, 8)]


def test_equal_rows_and_null_sizes_count_as_in_sql(spark):
    rows = spark.createDataFrame([(1, None), (2, 4), (3, None), (4, 3), (4, 4), (5, 0)], "n int, size int").withColumn("k", F.lit(0))
    out = greedy_prefix(rows, ["k"], [F.col("n")], F.col("size"), 10)
    assert sorted(tuple(r) for r in out.select("n", "used").collect()) == [(2, 4), (3, 4)]
