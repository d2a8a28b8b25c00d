"""The relationship graph: nodes, edges, scores, ranking and neighbours.

nodes: id, name, kind, path, language, start, roles (array).
edges: src, dst, kind, ord; ord tells which of two equal edges comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import bounded
from .ranges import first_range
from .relational import first_wins, top_k, top_overall, union_all

#: Weights of roles, and the order they are told in.
ROLE_WEIGHTS = {"entry point": 100, "network boundary": 25, "storage boundary": 25, "configuration": 25, "test": 5, "resource": 20, "module": 20}
ROLE_REASONS = {"entry point": "starts the program", "test": "is a test", "resource": "declares a resource", "module": "declares a module"}
NO_REASON = "no role is known"
#: How near a relationship is to what is read.
PRIORITY = {"route-to-handler": 0, "calls": 1, "local-module-source": 2, "tested-by": 3, "called-by": 4, "tests": 5, "imports": 6, "contains": 7}
FOLLOWED = ("calls", "local-module-source", "route-to-handler")


def add_nodes(nodes: DataFrame) -> DataFrame:
    """One node an id, the first by ord."""
    return first_wins(nodes, ["id"], ["ord"])


def add_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between known nodes; of equal (src, dst, kind) the first by ord."""
    ids = known_ids(nodes)
    return first_edges(known_end(known_end(edges, "dst", ids), "src", ids))


def known_ids(nodes: DataFrame) -> DataFrame:
    return bounded(nodes.select(F.col("id").alias("known")))


def known_end(edges: DataFrame, end: str, ids: DataFrame) -> DataFrame:
    """Edges whose ``end`` is among ``ids`` (known)."""
    return edges.join(ids, F.col(end) == F.col("known"), "left_semi")


def first_edges(edges: DataFrame, keys: tuple[str, ...] = ("src", "dst", "kind")) -> DataFrame:
    """Of edges with equal ``keys`` the first by ord. Where src was looked up by a shuffle, equal edges are in one place already."""
    if [c for c in edges.columns if c not in (*keys, "ord")]:
        return first_wins(edges, list(keys), ["ord"])
    return edges.groupBy(*keys).agg(F.min("ord").alias("ord"))


def with_roles(nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """nodes with the distinct roles of (id, role), sorted."""
    gathered = roles.groupBy(F.col("id").alias("r_id")).agg(F.sort_array(F.collect_set("role")).alias("roles"))
    return nodes.join(gathered, nodes["id"] == gathered["r_id"], "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>"))).drop("r_id")


def connected(nodes: DataFrame, edges: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """nodes with callers (outside tests) and dependencies: one pass over the edges, each counted at both ends; ``support``: ids of test support, once each, where they are at hand."""
    support = nodes.filter(F.array_contains("roles", "test support")) if support is None else support
    support = bounded(support.select(F.col("id").alias("support")))
    kept = edges.filter(F.col("kind").isin("calls", "local-module-source")).join(support, F.col("src") == F.col("support"), "left")
    called = (F.col("kind") == "calls") & F.col("support").isNull()
    end = lambda node, callers, dependencies: F.struct(node.alias("end"), F.lit(callers).alias("callers"), F.lit(dependencies).alias("dependencies"))
    each = kept.select(F.explode(F.array(end(F.col("src"), 0, 1), end(F.when(called, F.col("dst")), 1, 0))).alias("e")).select("e.*").filter("end IS NOT NULL")
    counts = each.groupBy("end").agg(F.sum("callers").alias("callers"), F.sum("dependencies").alias("dependencies"))
    zero = F.lit(0).cast("long")
    return nodes.join(counts, F.col("id") == F.col("end"), "left").drop("end").withColumn("callers", F.coalesce("callers", zero)).withColumn("dependencies", F.coalesce("dependencies", zero))


def connection_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, callers (outside tests), dependencies."""
    return connected(nodes, edges).select("id", "callers", "dependencies")


def role_score(roles: Column) -> Column:
    weight = F.lit(0)
    for role, w in ROLE_WEIGHTS.items():
        weight = weight + F.when(F.array_contains(roles, role), w).otherwise(0)
    return weight


def scored(nodes: DataFrame, edges: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """nodes with callers, dependencies, score and reasons; files and packages score 0 and have no reasons."""
    unit = F.col("is_unit")
    score = role_score(F.col("roles")) + 4 * F.least("callers", F.lit(10)) + 2 * F.least("dependencies", F.lit(10))
    told = F.transform(F.filter(F.array_sort("roles"), lambda r: r.isin(*ROLE_WEIGHTS)), _reason)
    told = F.concat(
        told,
        F.when(F.col("callers") > 0, F.array(F.concat(F.col("callers").cast("string"), F.lit(" production callers")))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("dependencies") > 0, F.array(F.concat(F.col("dependencies").cast("string"), F.lit(" local dependencies")))).otherwise(F.array().cast("array<string>")),
    )
    told = F.when(F.size(told) == 0, F.array(F.lit(NO_REASON))).otherwise(told)
    return connected(nodes, edges, support).withColumn("score", F.when(unit, score).otherwise(0).cast("long")).withColumn("reasons", F.when(unit, told).otherwise(F.array().cast("array<string>")))


def _reason(role: Column) -> Column:
    out = role
    for name, text in ROLE_REASONS.items():
        out = F.when(role == name, text).otherwise(out)
    return out


def ranked(nodes: DataFrame) -> DataFrame:
    """The units that are ranked: all but documents'."""
    return nodes.filter(F.col("is_unit") & (F.col("language") != "document"))


def rank_order() -> list[Column]:
    return [F.col("score").desc(), F.col("path"), F.col("start"), F.col("id")]


def overview(nodes: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` best-ranked units outside tests, with their rank and the number of ranked units."""
    units = ranked(nodes)
    total = units.agg(F.count(F.lit(1)).alias("units"))
    best = top_overall(units.filter(~F.array_contains("roles", "test support")), rank_order(), k, "rank")
    return best.crossJoin(F.broadcast(total))  # one row


def neighbours(edges: DataFrame) -> DataFrame:
    """id, target, relationship: what is near each node, along and against edges."""
    out = edges.filter(F.col("kind").isin(list(PRIORITY))).select(F.col("src").alias("id"), F.col("dst").alias("target"), F.col("kind").alias("relationship"))
    back = edges.filter(F.col("kind").isin("calls", "tested-by")).select(F.col("dst").alias("id"), F.col("src").alias("target"), F.when(F.col("kind") == "calls", "called-by").otherwise("tests").alias("relationship"))
    return out.unionByName(back).filter("id <> target")


def read_next(nodes: DataFrame, edges: DataFrame, k: int = 12, of: DataFrame | None = None) -> DataFrame:
    """id, rank, target, relationship, score: the ``k`` nearest neighbours of each node, or of those that ``of`` (id) names.

    A target that is near in two ways keeps the one met first in edge order; then
    nearness, score and id order them.
    """
    near = neighbours(edges)
    if of is not None:
        near = near.join(of.select(F.col("id").alias("wanted")), F.col("id") == F.col("wanted"), "left_semi")
    scores = nodes.select(F.col("id").alias("t_id"), "score")
    # Pairs meet their target's score first: a pair that is near in two ways is then in one place, and falls together without a shuffle of its own.
    met = near.select("id", "target", order_of(F.col("relationship")).alias("met")).join(scores, F.col("target") == F.col("t_id"))
    once = met.groupBy("id", "target", "score").agg(F.min("met").alias("met"))
    priority = F.element_at(F.array(*(F.lit(PRIORITY[name]) for name in MET)), F.col("met"))
    first = top_k(once.select("id", "target", "score", priority.alias("priority")), ["id"], [F.col("priority"), F.col("score").desc(), F.col("target")], k, "rank")
    names = F.array(*map(F.lit, sorted(PRIORITY, key=PRIORITY.get)))
    return first.select("id", "rank", "target", F.element_at(names, F.col("priority") + 1).alias("relationship"), "score")


#: Relationships in the order in which edges between the same two nodes are met: outgoing by kind, then incoming.
MET = ("calls", "contains", "imports", "local-module-source", "route-to-handler", "tested-by", "called-by", "tests")


def order_of(relationship: Column) -> Column:
    """Place in MET, from 1: a number, which aggregates in place where a name would be sorted."""
    return F.array_position(F.array(*map(F.lit, MET)), relationship).cast("int")


def orient(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, incoming, outgoing, next: how much there is around each node."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("outgoing"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("incoming"))
    near = neighbours(edges).select("id", "target").distinct().groupBy("id").agg(F.least(F.count(F.lit(1)), F.lit(12)).alias("next"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return nodes.select("id").join(into, "id", "left").join(out, "id", "left").join(near, "id", "left").select("id", zero("incoming"), zero("outgoing"), zero("next"))


def owner(points: DataFrame, ranges: DataFrame, keys: list[str], at: str = "line", fallback: str = "file") -> DataFrame:
    """Each point once with ``owner``: the first range of its key by ord that holds it, else ``fallback``."""
    found = first_range(points.distinct(), ranges, keys, at)
    return found.select(*points.columns, F.coalesce("unit", F.lit(fallback)).alias("owner"))


def module_links(units: DataFrame, targets: DataFrame) -> DataFrame:
    """src, dst: units whose links name the directory of a target unit; units: id, links; targets: id, dir."""
    links = units.select(F.col("id").alias("src"), F.explode("links").alias("link"))
    return links.join(targets, links["link"] == targets["dir"]).select("src", F.col("id").alias("dst")).distinct()


__all__ = [n for n in dir() if not n.startswith("_") and n != "union_all"]
