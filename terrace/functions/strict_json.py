"""JSON objects read with a check of their keys and types; what is wrong is told, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strictly(df: DataFrame, text: str, fields: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``value``, a struct of ``fields`` (name to SQL type), and ``reason``, why there is none; one of both is null.

    A text is refused where it is null or no JSON, no object, has a key that isn't among
    the fields or has one twice, lacks a required one, or holds a value of another type. A
    JSON null counts as absent. All of it is decided in the expression; nothing is collected.
    """
    raw, parsed, keys = F.col(text), F.try_parse_json(F.col(text)), F.json_object_keys(F.col(text))
    unknown = F.array_except(keys, F.array(*map(F.lit, fields)))
    at = {name: F.try_variant_get(parsed, f"$.{name}", "variant") for name in fields}
    got = {name: F.try_variant_get(parsed, f"$.{name}", kind) for name, kind in fields.items()}
    there = {name: at[name].isNotNull() & ~F.is_variant_null(at[name]) for name in fields}

    reason: Column = F.lit(None).cast("string")
    for name, kind in reversed(fields.items()):
        fits = got[name].isNotNull() & F.schema_of_variant(at[name]).isin(*KINDS[kind])
        reason = F.when(there[name] & ~fits, f"{name} is no {kind}").otherwise(reason)
    for name in reversed(required):
        reason = F.when(~F.coalesce(there[name], F.lit(False)), f"{name} is missing").otherwise(reason)
    reason = F.when(F.size(unknown) > 0, F.concat(F.lit("unknown key "), F.array_min(unknown))).otherwise(reason)
    reason = F.when(F.size(keys) != F.size(F.array_distinct(keys)), "a key stands twice").otherwise(reason)
    reason = F.when(keys.isNull(), "no object").otherwise(reason)
    reason = F.when(raw.isNull() | parsed.isNull(), "no JSON").otherwise(reason)
    value = F.struct(*(got[name].alias(name) for name in fields))
    return df.withColumn("reason", reason).withColumn("value", F.when(F.col("reason").isNull(), value))


#: Types of JSON values that count as each SQL type.
KINDS = {"bigint": ("BIGINT",), "double": ("BIGINT", "DOUBLE") + tuple(f"DECIMAL({p},{s})" for p in range(1, 39) for s in range(p + 1)), "string": ("STRING",), "boolean": ("BOOLEAN",)}
