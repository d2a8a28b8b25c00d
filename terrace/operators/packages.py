"""Packages in the order in which they can be read: strongly connected components and levels.

Packages that import each other in a ring are one component. All rings are found at
once: what can lie on no ring is trimmed; then each package learns the greatest name
that leads to it, and a ring holds what its greatest name reaches forwards and
backwards. Edges between different names can lie on no ring and are cut, so what is
left falls apart round by round. Levels number the components: one comes after all
that it imports. Every round is a join over the edges that are left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage, unstage


def trimmed(edges: DataFrame) -> DataFrame:
    """Written table: the edges between nodes that are both led to and left by an edge, again and again."""
    edges = stage(edges, "rings")
    n = edges.count()
    while n:
        held = edges.select(F.col("src").alias("id")).intersect(edges.select(F.col("dst").alias("id")))
        kept = edges.join(held.withColumnRenamed("id", "src"), "src", "left_semi").join(held.withColumnRenamed("id", "dst"), "dst", "left_semi")
        kept = stage(kept.select("src", "dst"), "rings")
        unstage(edges)
        edges, before, n = kept, n, kept.count()
        if n == before:
            break
    return edges


def greatest(edges: DataFrame) -> DataFrame:
    """Written table id, label: the greatest id that leads to each node, itself among them; only labels that grew go on."""
    labels = stage(edges.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    grown = labels
    while True:
        handed = grown.join(edges, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.max("label").alias("more"))
        met = stage(labels.join(handed, F.col("id") == F.col("to"), "left").select("id", F.greatest("label", "more").alias("label"), F.coalesce(F.col("more") > F.col("label"), F.lit(False)).alias("grew")), "labels")
        labels, grown = met.select("id", "label"), met.filter("grew").select("id", "label")
        if grown.isEmpty():
            return labels


def reached(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """id, label of the nodes that lead back to their label, over edges within it."""
    found = front = stage(labels.filter("id = label"), "reached")
    while True:
        on = front.select(F.col("id").alias("dst"), "label").join(edges, ["dst", "label"]).select(F.col("src").alias("id"), "label").distinct()
        front = stage(on.join(found, ["id", "label"], "left_anti"), "reached")
        if front.isEmpty():
            return found
        found = found.unionByName(front)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the least id of the ring, or rings, that a node lies on; its own, on none.

    nodes: id; edges: src, dst. Edges to unknown nodes, of a node to itself, and
    repeated ones make no difference; null ids are dropped.
    """
    nodes = nodes.select("id").filter("id IS NOT NULL").distinct()
    known = lambda c: nodes.withColumnRenamed("id", c)
    left = edges.filter("src <> dst").select("src", "dst").distinct().join(known("src"), "src", "left_semi").join(known("dst"), "dst", "left_semi")
    left, rings = trimmed(left.select("src", "dst")), []
    while not left.isEmpty():
        labels = greatest(left)
        of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))  # noqa: E731, B023
        within = stage(left.join(of("src"), "src").join(of("dst"), "dst").filter("src_label = dst_label").select("src", "dst", F.col("src_label").alias("label")), "within")
        ring = stage(reached(within, labels), "ring")
        rings.append(ring)
        gone = lambda c: ring.select(F.col("id").alias(c))  # noqa: E731, B023
        left = trimmed(within.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti").select("src", "dst"))
    if not rings:
        return nodes.withColumn("component", F.col("id"))
    on_ring = reduce(DataFrame.unionByName, rings)
    least = on_ring.groupBy("label").agg(F.min("id").alias("component"))
    placed = on_ring.join(least, "label").select("id", "component")
    return nodes.join(placed, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, level: 0 for what imports nothing, else one more than the highest level imported. ``edges`` hold no ring."""
    left, todo, done, n = stage(edges.select("src", "dst").distinct(), "imports"), stage(nodes.select("id").distinct(), "unread"), [], 0
    while not todo.isEmpty():
        waiting = left.select(F.col("src").alias("id")).distinct()
        ready = stage(todo.join(waiting, "id", "left_anti"), "ready")
        if ready.isEmpty():
            raise ValueError("edges form a ring")
        done.append(ready.withColumn("level", F.lit(n)))
        left = stage(left.join(ready.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "imports")
        todo = stage(todo.join(waiting, "id", "left_semi"), "unread")
        n += 1
    return reduce(DataFrame.unionByName, done) if done else nodes.select("id", F.lit(0).alias("level"))


def package_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component, level of each package; edges lead from a package to what it imports."""
    own = stage(components(nodes, edges), "components")
    of = lambda c: own.select(F.col("id").alias(c), F.col("component").alias(f"{c}_component"))
    between = edges.join(of("src"), "src").join(of("dst"), "dst").filter("src_component <> dst_component").select(F.col("src_component").alias("src"), F.col("dst_component").alias("dst"))
    placed = levels(own.select(F.col("component").alias("id")), between)
    return own.join(placed.withColumnRenamed("id", "component"), "component").select("id", "component", "level")


def imports(refs: DataFrame, module: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the packages of a module, by folder, from what its files import; files of tests are left out."""
    own = refs.filter("kind <> 'diagnostic' AND path NOT LIKE '%_test.go'")
    to = F.when(F.col("target_package") == module, ".").when(F.col("target_package").startswith(module + "/"), F.expr(f"substring(target_package, {len(module) + 2})"))
    edges = own.filter("kind = 'import'").select(F.col("dir").alias("src"), to.alias("dst")).filter("dst IS NOT NULL").distinct()
    return own.select(F.col("dir").alias("id")).distinct(), edges
