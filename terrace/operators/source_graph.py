"""The relationship graph of a source tree: files and units to nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import go_types, graph
from .relational import union_all

#: What a call outside the module tells about its caller; an empty name is any function.
BOUNDARY = [
    ("net/http", "", "network boundary"), ("net", "", "network boundary"), ("net/rpc", "", "network boundary"), ("database/sql", "", "storage boundary"),
    *(("os", name, "configuration") for name in ("Getenv", "LookupEnv")), *(("os", name, "storage boundary") for name in ("Open", "OpenFile", "ReadFile", "WriteFile", "Create")),
]
TEST_NAME = r"^func (Test|Fuzz|Benchmark|Example)"


ORIGIN = ["provider", "origin", "first", "last", "detail"]


def origin(provider: Column, path: str, first: Column | str, last: Column | str, detail: Column) -> list[Column]:
    """Where a node or edge comes from: what read it, in which lines of which file, and what it saw there."""
    number = lambda x: (F.col(x) if isinstance(x, str) else x).cast("long")
    return [provider.alias("provider"), F.col(path).alias("origin"), number(first).alias("first"), number(last).alias("last"), detail.alias("detail")]


def diagnostics(refs: DataFrame) -> DataFrame:
    """path, message of each file whose relationships aren't known."""
    return refs.filter("kind = 'diagnostic'").select("path", F.col("target").alias("message"))


def build(files: DataFrame, units: DataFrame, refs: DataFrame, module: str = "") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), scored; files: path, source; units and refs as parsed; module: the module's import path.

    Calls of functions resolve by equi joins on (package, name), those of methods by
    the types of the values they are called on; what resolves to nothing, to more than
    one function, or through an interface, is left out. Nodes and edges say where they
    come from: provider, origin (a path), first and last line, detail; of equal edges the first one's stay.
    """
    spark = files.sparkSession
    kinds = units.groupBy(F.col("path").alias("k_path")).agg(F.first("file_kind").alias("language"))
    known = files.join(kinds, F.col("path") == F.col("k_path"))
    lines = F.length("source") - F.length(F.replace("source", F.lit("\n"))) + 1
    file_nodes = known.select(F.concat(F.lit("file:"), "path").alias("id"), F.col("path").alias("name"), F.lit("file").alias("kind"), "path", "language", F.lit(1).cast("long").alias("start"), F.lit(False).alias("is_unit"), F.lit(0).alias("ord"), *origin(F.concat("language", F.lit(" reader")), "path", F.lit(1), lines, F.lit("a file of the tree")))
    unit_nodes = units.select(F.concat(F.lit("unit:"), "unit_id").alias("id"), "name", "kind", "path", F.col("file_kind").alias("language"), F.col("start").cast("long").alias("start"), F.lit(True).alias("is_unit"), F.lit(1).alias("ord"), *origin(F.concat("file_kind", F.lit(" reader")), "path", "start", "end", F.lit("declared here")))
    package = refs.filter("kind <> 'diagnostic'").select("path", "dir", "package", "scope").distinct()
    package_id = F.concat(F.lit("package:"), "dir", F.lit(":"), "package")
    package_nodes = package.groupBy("dir", "package").agg(F.min("path").alias("path")).select(package_id.alias("id"), F.col("package").alias("name"), F.lit("package").alias("kind"), "path", F.lit("go").alias("language"), F.lit(1).cast("long").alias("start"), F.lit(False).alias("is_unit"), F.lit(2).alias("ord"), *origin(F.lit("go declarations"), "path", F.lit(1), F.lit(1), F.lit("names its package")))
    nodes = graph.add_nodes(union_all([file_nodes, unit_nodes, package_nodes]))

    contains = units.select(F.concat(F.lit("file:"), "path").alias("src"), F.concat(F.lit("unit:"), "unit_id").alias("dst"), F.lit("contains").alias("kind"), F.col("start").alias("ord"), *origin(F.concat("file_kind", F.lit(" reader")), "path", "start", "end", F.lit("declared in this file")))
    in_package = package.select(package_id.alias("src"), F.concat(F.lit("file:"), "path").alias("dst"), F.lit("contains").alias("kind"), F.lit(0).alias("ord"), *origin(F.lit("go declarations"), "path", F.lit(1), F.lit(1), F.lit("a file of this package")))
    targets = units.filter("file_kind = 'terraform'").select(F.concat(F.lit("unit:"), "unit_id").alias("id"), F.regexp_replace(F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1), "^$", ".").alias("dir"))
    at = units.select(F.concat(F.lit("unit:"), "unit_id").alias("src"), *origin(F.lit("terraform blocks"), "path", "start", "end", F.lit("source names a folder of the tree")))
    modules = graph.module_links(units.select(F.concat(F.lit("unit:"), "unit_id").alias("id"), "links"), targets).select("src", "dst", F.lit("local-module-source").alias("kind"), F.lit(0).alias("ord")).join(at, "src")

    ids = units.filter("file_kind = 'go' AND kind = 'function'").select(F.col("path").alias("u_path"), F.col("name").alias("u_name"), F.col("start").alias("u_start"), F.concat(F.lit("unit:"), "unit_id").alias("unit"))
    defs = refs.filter("kind = 'def' AND target <> ''").join(ids, (F.col("path") == F.col("u_path")) & (F.col("owner") == F.col("u_name")) & (F.col("line") == F.col("u_start")))
    defs = defs.groupBy(F.col("scope").alias("d_scope"), F.col("target").alias("d_name")).agg(F.min("unit").alias("target_unit"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    inside = F.when(F.lit(bool(module)) & F.col("target_package").startswith(module + "/"), F.expr(f"substring(target_package, {len(module) + 2})")).when(F.lit(bool(module)) & (F.col("target_package") == module), ".")
    calls = refs.filter(F.col("kind").isin("call", "external", "route call", "route external")).withColumn("to_scope", F.when(F.col("kind").endswith("external"), inside).otherwise(F.col("target_package")))
    spans = units.filter("file_kind = 'go'").select("path", F.concat(F.lit("unit:"), "unit_id").alias("unit"), "start", "end", F.col("start").alias("ord"))
    by_type = go_types.method_targets(refs, module)
    placed = by_type.select(F.col("to_path").alias("path"), F.col("to_line").alias("line")).distinct()
    placed = graph.owner(placed, spans, ["path"], "line", "").filter("owner <> ''").select(F.col("path").alias("to_path"), F.col("line").alias("to_line"), F.col("owner").alias("target_unit"))
    uses = calls.select("kind", "path", "line", "last", "target_package", "target", "to_scope", F.lit(None).cast("string").alias("target_unit"))
    uses = uses.unionByName(by_type.join(placed, ["to_path", "to_line"]).select("kind", "path", "line", "last", F.lit("").alias("target_package"), "target", F.lit(None).cast("string").alias("to_scope"), "target_unit"))
    owned = graph.owner(uses, spans, ["path"], "line", "")
    owned = owned.withColumn("owner_id", F.when(F.col("owner") == "", F.concat(F.lit("file:"), "path")).otherwise(F.col("owner")))
    resolved = owned.join(defs.withColumnRenamed("target_unit", "by_name"), (F.col("to_scope") == F.col("d_scope")) & (F.col("target") == F.col("d_name")), "left").withColumn("target_unit", F.coalesce("target_unit", "by_name")).filter("target_unit IS NOT NULL")
    said = F.when(F.col("kind").startswith("route"), F.lit("hands over a handler")).otherwise(F.lit("calls it by a name or type of this module"))
    call_edges = resolved.select(F.col("owner_id").alias("src"), F.col("target_unit").alias("dst"), F.when(F.col("kind").startswith("route"), "route-to-handler").otherwise("calls").alias("kind"), F.col("line").alias("ord"), *origin(F.lit("go types"), "path", "line", "last", said))
    tests = units.filter("path LIKE '%_test.go'").filter(F.col("name").rlike(TEST_NAME)).select(F.concat(F.lit("unit:"), "unit_id").alias("test"))
    tested = call_edges.filter("kind = 'calls' AND src <> dst").join(tests, F.col("src") == F.col("test"), "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("tested-by").alias("kind"), "ord", *ORIGIN)
    by_package = refs.filter("kind = 'import'").withColumn("to_dir", inside)
    there = package.filter("path NOT LIKE '%_test.go'").select(F.col("dir").alias("t_dir"), F.col("path").alias("t_path"))
    imported = by_package.join(there, F.col("to_dir") == F.col("t_dir")).select(F.concat(F.lit("file:"), "path").alias("src"), F.concat(F.lit("file:"), "t_path").alias("dst"), F.lit("imports").alias("kind"), F.lit(0).alias("ord"), *origin(F.lit("go declarations"), "path", "line", "last", F.concat(F.lit("imports "), "target_package")))

    rules = spark.createDataFrame(BOUNDARY, "b_package string, b_name string, role string")
    touched = owned.filter("kind = 'external'").join(F.broadcast(rules), (F.col("target_package") == F.col("b_package")) & ((F.col("b_name") == "") | (F.col("target") == F.col("b_name"))))
    unit_id = F.concat(F.lit("unit:"), "unit_id").alias("id")
    roles = union_all([
        touched.select(F.col("owner_id").alias("id"), "role"),
        tests.select(F.col("test").alias("id"), F.lit("test").alias("role")),
        units.filter("path LIKE '%_test.go'").select(unit_id, F.lit("test support").alias("role")),
        units.filter("file_kind = 'terraform' AND kind IN ('resource', 'module', 'variable', 'output')").select(unit_id, F.col("kind").alias("role")),
        refs.filter("kind = 'def' AND package = 'main' AND owner = 'func main'").join(ids, (F.col("path") == F.col("u_path")) & (F.col("owner") == F.col("u_name"))).select(F.col("unit").alias("id"), F.lit("entry point").alias("role")),
    ])
    nodes = graph.with_roles(nodes, roles)
    edges = graph.add_edges(union_all([contains, in_package, modules, call_edges, tested, imported]), nodes)
    return graph.scored(nodes, edges), edges
