"""Bounded scans: what may be indexed, and whether it still is what it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError, Kind
from ..functions.text import content_digest, folders_above, path_prefixes
from ..staging import bounded

#: Limits of a scan, and names that are never indexed.
MAX_FILE_BYTES, MAX_TOTAL_BYTES, MAX_FILES, MAX_ENTRIES, MAX_DEPTH = 262_144, 33_554_432, 4_096, 50_000, 64
EXCLUDED_DIRS = (".git", ".terraform", "node_modules", "vendor", ".venv", "dist", "build", ".dockerbuild", ".ssh", ".aws", ".terrace")
EXCLUDED_SUFFIXES = (".tfvars", ".tfvars.json", ".tfstate", ".tfplan", ".lock.hcl", ".min.js", ".pem", ".key", ".p12", ".pfx")


def excluded(path: Column) -> Column:
    """Whether a path is never indexed, for a directory above it or for its own name."""
    parts = F.split(path, "/")
    dirs, name = F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1)
    hit = F.arrays_overlap(dirs, F.array(*map(F.lit, EXCLUDED_DIRS)))
    for suffix in EXCLUDED_SUFFIXES:
        hit = hit | name.endswith(suffix)
    return hit | name.contains(".tfstate.") | (name == "config.json") | (name == ".env") | name.startswith(".env.")


def excluded_name(name: str, is_dir: bool) -> bool:
    """The same for one name, for walks that prune before they descend."""
    if is_dir:
        return name in EXCLUDED_DIRS
    return name.endswith(EXCLUDED_SUFFIXES) or ".tfstate." in name or name in ("config.json", ".env") or name.startswith(".env.")


def scan_bounded(files: DataFrame, most_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files (path, source) that may be indexed: no excluded part, not over the size bound."""
    return files.filter(~excluded(F.col("path")) & (F.octet_length("source") <= most_bytes))


def check_limits(files: DataFrame, most_files: int = MAX_FILES, most_bytes: int = MAX_TOTAL_BYTES) -> None:
    """Raise rather than index a part of what is too large."""
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    if n > most_files or size > most_bytes:
        raise EngineError(Kind.TOO_LARGE, f"{n} files of {size} bytes are more than {most_files} of {most_bytes}")


def ignore_verdicts(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path, ignored; rules: dir, depth, ord, regex, negate, dir_only.

    Every prefix of a path meets the rules of the directories above it, by an equi join
    on these, and no others; the last rule that matches has the say over a prefix, and a
    path is ignored when any of its prefixes is.
    """
    ruled = bounded(rules.select(F.col("dir").alias("above")).distinct())
    own = paths.select("path").distinct()
    each = own.select("path", F.posexplode(path_prefixes(F.col("path"))).alias("n", "prefix")).withColumn("is_dir", F.col("prefix") != F.col("path"))
    met = each.withColumn("above", F.explode(folders_above(F.col("prefix")))).join(ruled, "above", "left_semi").join(bounded(rules, 10_000), F.col("above") == F.col("dir"))
    hits = met.filter((F.col("is_dir") | ~F.col("dir_only")) & F.expr("(CASE WHEN dir = '' THEN prefix ELSE substring(prefix, length(dir) + 2) END) RLIKE regex"))
    verdict = hits.groupBy("path", "n").agg(F.max_by(~F.col("negate"), F.struct("depth", "ord")).alias("hit")).groupBy("path").agg(F.bool_or("hit").alias("hit"))
    return paths.select("path").distinct().join(verdict, "path", "left").select("path", F.coalesce("hit", F.lit(False)).alias("ignored"))


def permitted(paths: DataFrame, denied: DataFrame) -> DataFrame:
    """Paths none of whose prefixes is denied (denied: path)."""
    each = paths.select("path", F.explode(path_prefixes(F.col("path"))).alias("prefix"))
    bad = each.join(denied.select(F.col("path").alias("prefix")), "prefix", "left_semi").select("path").distinct()
    return paths.join(bad, "path", "left_anti")


def snapshot_revision(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, revision: one digest over the paths and contents of a group.

    Paths are dealt into 4,096 parts by the start of their own digest; each part has
    a digest over its files in path order, and the group one over those of its parts.
    """
    each = files.select(*keys, F.substring(F.sha2("path", 256), 1, 3).alias("part"), "path", content_digest(F.col("path"), F.col("source")).alias("digest"))
    joined = lambda order, of: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, of))), lambda x: x[of]), ""), 256)
    parts = each.groupBy(*keys, "part").agg(joined("path", "digest").alias("revision"))
    return parts.groupBy(*keys).agg(joined("part", "revision").alias("revision"))


def changed_policy(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose digest (path, digest) differs between two sides, a missing one included."""
    b, a = before.select("path", F.col("digest").alias("old")), after.select("path", F.col("digest").alias("new"))
    return b.join(a, "path", "full").filter(~F.col("old").eqNullSafe(F.col("new"))).select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("status"))


def check_policy(before: DataFrame, after: DataFrame) -> None:
    if not changed_policy(before, after).isEmpty():
        raise EngineError(Kind.STALE, "what decides which files are indexed has changed")


def classify(paths: DataFrame, rules: list[tuple[str, int, str]], fallback: str = "document") -> DataFrame:
    """paths with ``kind``: of the (kind, priority, regex) that match, the one of highest priority."""
    out = F.lit(fallback)
    for kind, _, regex in sorted(rules, key=lambda r: r[1]):
        out = F.when(F.col("path").rlike(regex), kind).otherwise(out)
    return paths.withColumn("kind", out)


def unique_ids(units: DataFrame, keys: list[str]) -> DataFrame:
    """units with ``unit_id``: keys joined by colons, and ``#n`` from the second of equal ones on, in ``ord``."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    base = F.concat_ws(":", *(F.col(k).cast("string") for k in keys))
    return units.withColumn("n", n).withColumn("unit_id", F.when(F.col("n") == 1, base).otherwise(F.concat(base, F.lit("#"), F.col("n").cast("string")))).drop("n")


def whole_file_fallback(files: DataFrame, units: DataFrame) -> DataFrame:
    """path, name, start, end: a file's units, or one that covers it where there are none."""
    from ..functions.text import count_lines

    u = units.select(F.col("path").alias("u_path"), "name", "start", "end")
    joined = files.join(u, files["path"] == u["u_path"], "left")
    none = F.col("u_path").isNull()
    return joined.select("path", F.when(none, F.element_at(F.split("path", "/"), -1)).otherwise(F.col("name")).alias("name"), F.when(none, 1).otherwise(F.col("start")).alias("start"), F.when(none, count_lines(F.col("source"))).otherwise(F.col("end")).cast("int").alias("end"))
