"""Ignore rules: lines of an ignore file to regular expressions.

Rules become rows (dir, depth, ord, regex, negate, dir_only), and evaluation is a join;
see operators.scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    regex: str
    negate: bool
    dir_only: bool


def glob_class(glob: str, at: int) -> tuple[str, int] | None:
    """The regex of a bracket class that starts at ``at``, and the place after it; None if it is malformed."""
    end = at + 1
    negate = end < len(glob) and glob[end] in "!^"
    end += negate
    first = end
    while end < len(glob) and (glob[end] != "]" or end == first):
        end += 2 if glob[end] == "\\" else 1
    if end >= len(glob) or end == first:
        return None
    body = re.sub(r"([\[&])", r"\\\1", glob[first:end].replace("\\", "\\\\"))
    out = f"[{'^/' if negate else ''}{body}]"
    try:
        re.compile(out)
    except re.error:
        return None
    return out, end + 1


def segment_regex(segment: str) -> str:
    """One path segment: ``*`` and ``?`` don't match a slash; a malformed class is literal."""
    out, at = [], 0
    while at < len(segment):
        c = segment[at]
        if c == "*":
            while at < len(segment) and segment[at] == "*":
                at += 1
            out.append("[^/]*")
            continue
        if c == "?":
            out.append("[^/]")
        elif c == "[" and (found := glob_class(segment, at)):
            out.append(found[0])
            at = found[1]
            continue
        elif c == "\\" and at + 1 < len(segment):
            at += 1
            out.append(re.escape(segment[at]))
        else:
            out.append(re.escape(c))
        at += 1
    return "".join(out)


def parse_line(line: str) -> Rule | None:
    """A rule, or None for a blank line or a comment."""
    line = line.rstrip("\r")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negate = line.startswith("!")
    if negate:
        line = line[1:]
    elif line.startswith(("\\#", "\\!")):
        line = line[1:]
    dir_only = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    parts = line.removeprefix("/").split("/")
    out = "" if anchored else "(?:.*/)?"
    for n, part in enumerate(parts):
        last = n == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:.*/)?"
        else:
            out += segment_regex(part) + ("" if last else "/")
    return Rule(f"^{out}$", negate, dir_only)


def parse(text: str) -> list[Rule]:
    return [r for line in text.split("\n") if (r := parse_line(line)) is not None]


def ignored(path: str, is_dir: bool, layers: dict[str, list[Rule]]) -> bool:
    """Whether the rules of a path's ancestors ignore it, or any directory above it; layers: directory -> rules."""
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        here, directory, verdict = "/".join(parts[:n]), n < len(parts) or is_dir, False
        for depth in range(n):
            base = "/".join(parts[:depth])
            rest = here[len(base) + 1 :] if base else here
            for rule in layers.get(base, ()):
                if (directory or not rule.dir_only) and re.match(rule.regex, rest):
                    verdict = not rule.negate
        if verdict:
            return True
    return False
