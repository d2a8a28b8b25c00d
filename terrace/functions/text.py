"""Scalar text functions, as Column expressions that stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What white space separates, as Unicode has it.
SPACE = r"(?U)\s+"


def count_lines(text: Column) -> Column:
    """Newlines, and one."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def content_digest(*parts: Column) -> Column:
    """SHA-256 of the parts, each followed by a NUL."""
    return F.sha2(F.concat(*(F.concat(p, F.lit("\0")) for p in parts)), 256)


def blob_identity(text: Column) -> Column:
    """The object id that version control gives to a file of this content."""
    return F.sha1(F.concat(F.lit("blob "), F.octet_length(text).cast("string"), F.lit("\0"), text))


def blob_identity_sha256(text: Column) -> Column:
    return F.sha2(F.concat(F.lit("blob "), F.octet_length(text).cast("string"), F.lit("\0"), text), 256)


def short_name(name: Column) -> Column:
    """The last word, after its last dot."""
    word = F.element_at(F.split(F.trim(F.regexp_replace(name, SPACE, " ")), " "), -1)
    return F.element_at(F.split(word, r"\."), -1)


def split_words(name: Column) -> Column:
    """Lower-cased words of a camel-case or underscored name, joined by blanks."""
    spaced = F.regexp_replace(name, r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(spaced, "_", " "), " +", " ")))


def display_text(text: Column, limit: int) -> Column:
    """Without control characters, white space collapsed, cut to ``limit`` code points with an ellipsis."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}]", ""))
    return F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit - 1), F.lit("…"))).otherwise(clean)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def whitespace_only(before: Column, after: Column) -> Column:
    """Both there, different, and the same once white space is collapsed."""
    return (before != after) & (before != "") & (after != "") & (collapse(before) == collapse(after))


def replace_identifier(text: Column, old: str, new: str) -> Column:
    """Whole-word occurrences of a name replaced."""
    if not old or old == new:
        return text
    edge = r"[\p{L}\p{Nd}_]"
    return F.regexp_replace(text, f"(?<!{edge}){re.sub(r'([^0-9A-Za-z_])', r'\\\1', old)}(?!{edge})", new.replace("\\", "\\\\").replace("$", "\\$"))


def token_estimate(text: Column) -> Column:
    """A third of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 3).cast("long")


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def dirname(path: Column) -> Column:
    """The part before the last slash, or ``.``."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def folders_above(path: Column) -> Column:
    """Every directory above a path; the root is the empty one."""
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.array_union(F.array(F.lit("")), path_prefixes(folder)))


def path_prefixes(path: Column) -> Column:
    """Every ancestor of a path, from the root, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
