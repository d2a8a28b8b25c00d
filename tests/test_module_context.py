"""Names of the units below a module."""

from pyspark.sql import functions as F

from terrace.operators import explain


def test_module_context_of_ids_with_the_same_and_with_several_modules(spark):
    units = spark.createDataFrame([(f"env/{m}/{n:03}", n, "x" * 98) for m in "ab" for n in range(40)], "path string, ord int, name string")
    links = spark.createDataFrame([(1, "env/a/"), (2, "env/a"), (3, "env/a"), (3, "env/b"), (4, "env/none"), (5, "env")], "id int, module string")
    out = explain.module_context(units, links)
    got = {}
    for r in out.collect():
        got.setdefault(r["id"], []).append(r["context"])
    unit = "x" * 98 + "; "
    assert got == {1: [unit * 18], 2: [unit * 18], 3: [unit * 18] * 2, 4: [""], 5: [unit * 18]}


def test_module_context_carries_each_module_once_not_once_an_id(spark):
    """Many ids of one module must not each meet all its units."""
    units = spark.range(20_000).select(F.concat(F.lit("env/a/"), F.col("id").cast("string")).alias("path"), F.col("id").alias("ord"), F.lit("unit").alias("name"))
    links = spark.range(20_000).select("id", F.lit("env/a").alias("module"))  # 400 million pairs
    out = explain.module_context(units, links).agg(F.count(F.lit(1)), F.count_distinct("context")).first()
    assert tuple(out) == (20_000, 1)
