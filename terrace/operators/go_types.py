"""Methods of Go values, by joins over what the files of a module declare.

Members of a type are its fields and methods and, round by round, those that
embedded types lend it. Terms (see functions.go_reader) are resolved one step a
round, each round a join of all open terms with the members. Rounds end when no
term is open; there are as many as the longest chain has steps.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage, unstage

WRAPPED = r"^(\(\)|\[\]|<-)"


def settled(kind: Column, module: str) -> Column:
    """A type with packages of the module written as their folders; others keep their ``@``."""
    if not module:
        return kind
    own = re.escape(module)
    return F.regexp_replace(F.regexp_replace(kind, rf"@{own}/([^|@]*)\|", r"$1|"), rf"@{own}\|", ".|")


def named(scope: str, name: str) -> Column:
    return F.concat_ws("|", scope, name)


def underlying(refs: DataFrame, module: str) -> DataFrame:
    """t, under: what each declared type is made of; names of other types are followed, twice as far each round."""
    own = refs.filter("kind = 'type'").groupBy(named("scope", "target").alias("t")).agg(F.min(settled(F.col("base"), module)).alias("under"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    own = stage(own, "under")
    for _ in range(max(1, own.count().bit_length())):  # a ring of names never ends, and keeps its names
        onward = own.select(F.col("t").alias("u"), F.col("under").alias("further"))
        step = stage(own.join(onward, F.col("under") == F.col("u"), "left").select("t", F.coalesce("further", "under").alias("under"), F.col("further").isNotNull().alias("moved")), "under")
        unstage(own)
        own = step.select("t", "under")
        object.__setattr__(own, "stage_path", step.__dict__["stage_path"])
        if step.filter("moved").isEmpty():
            break
    return own


def members(refs: DataFrame, module: str) -> DataFrame:
    """Written table t, name, result, method, path, line: the fields and methods of each type, its own before lent ones.

    A name that two embedded types lend at one depth is no member, and hides deeper ones.
    """
    t, base = named("scope", "owner").alias("t"), settled(F.col("base"), module)
    declared = refs.filter("kind IN ('field', 'imethod') OR (kind = 'func' AND owner <> '')").select(t, F.col("target").alias("name"), base.alias("result"), (F.col("kind") != "field").alias("method"), "path", "line")
    lends = refs.filter("kind = 'embed'").select(t, base.alias("e"), F.lit(True).alias("methods"), F.col("target").alias("as"), "path", "line")
    declared = declared.unionByName(lends.select("t", F.col("as").alias("name"), F.col("e").alias("result"), F.lit(False).alias("method"), "path", "line"))
    # A type made of another one has its fields, an alias its methods as well, and one made of an interface too.
    faces = refs.filter("kind = 'type' AND base = 'interface'").select(named("scope", "target").alias("face"))
    made = refs.filter("kind = 'type' AND base NOT IN ('struct', 'interface')").select(named("scope", "target").alias("t"), base.alias("e"), (F.element_at("steps", 1) == "alias").alias("alias"))
    made = made.filter(~F.col("e").rlike(WRAPPED)).join(faces, F.col("e") == F.col("face"), "left").select("t", "e", (F.col("alias") | F.col("face").isNotNull()).alias("methods"))
    lends = stage(lends.select("t", "e", "methods").unionByName(made).distinct(), "lends")
    one = F.when(F.countDistinct("path", "line", "result") == 1, F.min(F.struct("result", "method", "path", "line"))).alias("m")
    fresh = stage(declared.groupBy("t", "name").agg(one).select("t", "name", "m.*"), "members")
    known = fresh
    while True:
        lent = lends.join(fresh.withColumnRenamed("t", "e"), "e").filter(F.col("methods") | ~F.coalesce("method", F.lit(False)))
        lent = lent.groupBy("t", "name").agg(one).select("t", "name", "m.*").join(known.select("t", "name"), ["t", "name"], "left_anti")
        fresh = stage(lent, "members")
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)


def resolved(terms: DataFrame, names: DataFrame, own: DataFrame, under: DataFrame, module: str) -> DataFrame:
    """``terms`` (base, steps and other columns) whose type can be told, with it as ``type``."""
    rest = [c for c in terms.columns if c not in ("base", "steps")]
    base = settled(F.substring_index("base", " ", -1), module)
    start = terms.withColumn("value", F.col("base").startswith("of ")).withColumn("base", base).join(names.select(F.col("n_name").alias("k_name"), F.col("n_type").alias("k_type")), (F.col("base") == F.col("k_name")) & ~F.col("value"), "left")
    todo = start.select(*rest, F.when(F.col("value"), F.col("base")).otherwise(F.col("k_type")).alias("type"), "steps").filter("type IS NOT NULL")
    done: DataFrame | None = None
    lookup, made = own.filter("result IS NOT NULL").select(F.col("t").alias("m_t"), F.col("name").alias("m_name"), "result"), under.select(F.col("t").alias("u_t"), "under")
    while True:
        todo = stage(todo, "terms")
        ended = todo.filter("size(steps) = 0").select(*rest, "type")
        done = ended if done is None else done.unionByName(ended)
        todo = todo.filter("size(steps) > 0").withColumn("step", F.element_at("steps", 1))
        if todo.isEmpty():
            return done
        kind, step = F.col("type"), F.col("step")
        plain = F.regexp_replace(kind, "^type:", "")
        member = F.when(step.startswith("."), F.concat_ws("\0", plain, F.expr("substring(step, 2)")))
        wrapped = kind.rlike(WRAPPED) | kind.startswith("type:") | kind.startswith("tuple:")
        opened = F.when(~step.startswith(".") & ~step.startswith("#") & ~wrapped, kind)
        met = todo.withColumn("member", member).join(lookup.select(F.concat_ws("\0", "m_t", "m_name").alias("member"), "result"), "member", "left")
        met = met.withColumn("opened", opened).join(made, F.col("opened") == F.col("u_t"), "left")
        part = F.get(F.split(F.regexp_replace(kind, "^tuple:", ""), "\x1f"), F.expr("cast(substring(step, 2) as int)"))
        after = (
            F.when(step.startswith("."), F.col("result"))
            .when(step.startswith("#"), F.when(kind.startswith("tuple:"), part).when(step == "#0", kind))
            .when(kind.startswith("type:"), F.when(step == "()", plain).when(step == "[]", kind))
            .when(kind.startswith("()") & (step == "[]"), kind)  # type arguments
            .when(kind.substr(F.lit(1), F.lit(2)) == step, F.expr("substring(type, 3)"))
            .when(F.col("opened").isNotNull() & F.col("under").rlike(WRAPPED), F.col("under"))
        )
        stays = F.col("opened").isNotNull()  # the step is taken in the next round, from what the type is made of
        todo = met.withColumn("after", after).filter("after IS NOT NULL").select(*rest, F.col("after").alias("type"), F.when(stays, F.col("steps")).otherwise(F.expr("slice(steps, 2, size(steps))")).alias("steps"))


def method_targets(refs: DataFrame, module: str = "") -> DataFrame:
    """The rows of ``refs`` that call a method, or hand one over, with the place where it is declared (to_path, to_line).

    A call whose target is settled only at run time, through an interface, is left out.
    """
    funcs = refs.filter("kind = 'func' AND owner = ''").select(named("scope", "target").alias("n_name"), settled(F.col("base"), module).alias("n_type"))
    types = refs.filter("kind = 'type'").select(named("scope", "target").alias("n_name"), F.concat(F.lit("type:"), named("scope", "target")).alias("n_type"))
    once = lambda df: df.groupBy("n_name").agg(F.min("n_type").alias("n_type"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    names = stage(once(funcs.unionByName(types)), "names")
    under, own = underlying(refs, module), members(refs, module)
    values = refs.filter("kind = 'var'").select(named("scope", "target").alias("n_name"), "base", "steps")
    while not (found := stage(once(resolved(values, names, own, under, module).withColumnRenamed("type", "n_type")).join(names.select("n_name"), "n_name", "left_anti"), "values")).isEmpty():
        names = stage(names.unionByName(found), "names")  # a value may stand on another one
        values = values.join(found.select("n_name"), "n_name", "left_anti")
    uses = refs.filter("kind IN ('method', 'route method')").select("kind", "path", "dir", "package", "line", "last", "owner", "target", "base", "steps")
    got = resolved(uses, names, own, under, module).withColumn("type", F.regexp_replace("type", "^type:", ""))
    faces = under.filter("under = 'interface'").select(F.col("t").alias("type"))
    targets = own.filter("method").select(F.col("t").alias("type"), F.col("name").alias("target"), F.col("path").alias("to_path"), F.col("line").alias("to_line"))
    return got.join(faces, "type", "left_anti").join(targets, ["type", "target"]).drop("type")
