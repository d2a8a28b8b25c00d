"""Language parsers: table functions from a file to its units.

A parser is a kind, a priority, a test of (path, first bytes) and a function that
lists units. The registry hands a file to the first parser by priority that
claims it; a file without units is one unit. Structure only: nothing is run,
and what can't be told for sure is left out.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ..staging import slices

#: Fixed values.
PEEK, MAX_DOCUMENTS = 4096, 256
TASK_KEYWORDS = set("""always any_errors_fatal args async become become_exe become_flags become_method become_user block changed_when check_mode collections connection debugger delay
delegate_facts delegate_to diff environment failed_when ignore_errors ignore_unreachable listen loop loop_control module_defaults name no_log notify poll port register remote_user rescue
retries run_once tags throttle timeout until vars when""".split())
TASK_ACTIONS = set("""action add_host apt apt_key apt_repository assemble assert async_status blockinfile command copy cron debconf debug dnf dnf5 dpkg_selections expect fail fetch file find
gather_facts get_url getent git group group_by hostname import_role import_tasks include include_role include_tasks include_vars iptables known_hosts lineinfile local_action meta package
package_facts pause ping pip raw reboot replace rpm_key script service service_facts set_fact set_stats setup shell slurp stat subversion systemd systemd_service sysvinit tempfile template
unarchive uri user validate_argument_spec wait_for wait_for_connection yum yum_repository""".split())
COLLECTION_ACTION = re.compile(r"[a-z0-9_]+\.[a-z0-9_]+\.[a-z0-9_.]+")
IMPORT_KEYS = ("import_playbook", "ansible.builtin.import_playbook")


@dataclass
class Unit:
    kind: str
    name: str
    start: int
    end: int
    links: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Parser:
    kind: str
    priority: int
    match: Callable[[str, str], bool]
    units: Callable[[str, str], list[Unit]]


class Registry:
    def __init__(self, *parsers: Parser):
        if len({p.kind for p in parsers}) < len(parsers) or len({p.priority for p in parsers}) < len(parsers):
            raise ValueError("each parser needs a kind and a priority of its own")
        self.parsers = sorted(parsers, key=lambda p: -p.priority)

    def parse(self, path: str, source: str) -> tuple[str, list[Unit]] | None:
        """Kind and units of a file; None if no parser claims it."""
        peek = source.encode()[:PEEK].decode(errors="ignore")
        for p in self.parsers:
            if p.match(path, peek):
                found = p.units(path, source)
                return p.kind, found or [Unit(p.kind, posixpath.basename(path), 1, source.count("\n") + 1)]
        return None


def extension(path: str) -> str:
    name = posixpath.basename(path)
    return "." + name.rpartition(".")[2].lower() if "." in name else ""


def by_extension(*names: str) -> Callable[[str, str], bool]:
    return lambda path, _: extension(path) in names


# Python: top-level statements by column


def python_units(path: str, source: str) -> list[Unit]:
    """Top-level functions and classes, from their first decorator to the line before the next statement."""
    lines = source.split("\n")
    starts = list(_python_statements(lines))
    out, pending = [], None
    for n, (at, kind, name) in enumerate(starts):
        if kind == "decorator":
            pending = pending or at
            continue
        if kind in ("function", "type"):
            end = starts[n + 1][0] - 1 if n + 1 < len(starts) else len(lines)
            out.append(Unit(kind, name, pending or at, end))
        pending = None
    return out


def _python_statements(lines: list[str]) -> Iterator[tuple[int, str, str]]:
    """(line, kind, name) of each statement in the first column, outside triple-quoted strings."""
    closing = ""
    for n, line in enumerate(lines, 1):
        if closing:
            closing = "" if closing in line else closing
            continue
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        closing = next((q for q in ('"""', "\'\'\'") if line.count(q) % 2), "")
        if line[0] in " \t)]}":
            continue
        if text.startswith("@"):
            yield n, "decorator", ""
        elif m := re.match(r"(?:(async\s+def|def)|class)\s+([A-Za-z_]\w*)", text, re.ASCII):
            yield n, "function" if m[1] else "type", f"{'func' if m[1] else 'class'} {m[2]}"
        else:
            yield n, "statement", ""


# Shell: functions by brace depth

SHELL_FUNCTION = re.compile(r"\s*(?P<word>function\s+)?(?P<name>[A-Za-z_][\w:.-]*)\s*(?P<parens>\(\s*\))?\s*\{(?P<rest>.*)$", re.ASCII)
HEREDOC = re.compile(r"(?:^|[^<])<<(?P<tabs>-?)\s*(?:'(?P<a>[^']+)'|\"(?P<b>[^\"]+)\"|\\?(?P<c>[A-Za-z_]\w*))", re.ASCII)
#: What a line has besides braces: quoted parts, a comment at the start of a word.
SHELL_TOKEN = re.compile(r"'(?:\\.|[^'\\])*(?:'|$)|\"(?:\\.|[^\"\\])*(?:\"|$)|(?:^|(?<=[ \t]))#.*$|[{}]", re.S)


def shell_match(path: str, peek: str) -> bool:
    ext = extension(path)
    if ext:
        return ext in (".sh", ".bash")
    first = peek.split("\n", 1)[0].strip()
    words = first[2:].split() if first.startswith("#!") else []
    return bool(words) and posixpath.basename(words[-1]) in ("sh", "bash")


def brace_delta(line: str) -> int:
    return sum({"{": 1, "}": -1}.get(t, 0) for t in SHELL_TOKEN.findall(line))


def heredoc_lines(lines: list[str]) -> set[int]:
    """Places, from 0, of here-document bodies and their ends; one that never ends marks nothing."""
    inside: set[int] = set()
    n = 0
    while n < len(lines):
        m = HEREDOC.search(lines[n])
        if m:
            end = m["a"] or m["b"] or m["c"]
            clean = (lambda s: s.rstrip("\r").lstrip("\t")) if m["tabs"] else (lambda s: s.rstrip("\r"))
            close = next((k for k in range(n + 1, len(lines)) if clean(lines[k]) == end), None)
            if close is not None:
                inside.update(range(n + 1, close + 1))
                n = close
        n += 1
    return inside


def shell_units(path: str, source: str) -> list[Unit]:
    lines = source.split("\n")
    skipped, out = heredoc_lines(lines), []
    for n, line in enumerate(lines):
        m = None if n in skipped else SHELL_FUNCTION.match(line)
        if not m or not (m["word"] or m["parens"]):
            continue
        depth, end = 1 + brace_delta(m["rest"]), n
        while depth > 0 and end + 1 < len(lines):
            end += 1
            depth += 0 if end in skipped else brace_delta(lines[end])
        out.append(Unit("function", f"function {m['name']}", n + 1, end + 1))
    return out


# Go and Terraform: a scanner that blanks out comments and strings

GO_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
HCL_BLANK = re.compile(r"#[^\n]*|//[^\n]*|/\*.*?\*/|<<-?(?P<tag>\w+)\n.*?\n\s*(?P=tag)(?=\n|$)|\"(?:\\.|[^\"\\\n])*\"", re.S)


def blank(source: str, pattern: re.Pattern, keep: Callable[[str], bool] = lambda s: False) -> str:
    """The source with what the pattern matches turned to spaces, lines kept."""
    return pattern.sub(lambda m: m[0] if keep(m[0]) else re.sub(r"[^\n]", " ", m[0]), source)


def block_end(text: str, at: int, pairs: str = "{}") -> int | None:
    """Place of the brace that closes the one at ``at``."""
    depth = 0
    for m in re.compile(f"[{re.escape(pairs)}]").finditer(text, at):
        depth += 1 if m[0] == pairs[0] else -1
        if depth == 0:
            return m.start()
    return None


GO_FUNC = re.compile(r"^func\s*(?:\(\s*(?:\w+\s+)?\*?\s*(?P<recv>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>\w+)", re.M)
GO_TYPE = re.compile(r"^type\s+(?:(?P<name>\w+)|(?P<group>\())", re.M)


def balanced(text: str) -> bool:
    """Whether all brackets close in order, as they do in a file that parses."""
    stack: list[str] = []
    for c in re.findall(r"[(){}\[\]]", text):
        if c in "({[":
            stack.append(c)
        elif not stack or stack.pop() + c not in ("()", "{}", "[]"):
            return False
    return not stack


def go_units(path: str, source: str) -> list[Unit]:
    """Functions, methods and types; none of a file that can't parse."""
    text = blank(source, GO_BLANK)
    if not re.search(r"^package \w+", text, re.M) or not balanced(text):
        return []
    line = lambda at: text.count("\n", 0, at) + 1
    found: list[tuple[int, Unit]] = []
    for m in GO_FUNC.finditer(text):
        body = go_body(text, m.end())
        end = body[1] if body else text.find("\n", m.end()) % (len(text) + 1)
        name = f"method {m['recv']}.{m['name']}" if m["recv"] else f"func {m['name']}"
        found.append((m.start(), Unit("function", name, line(m.start()), line(end))))
    for m in GO_TYPE.finditer(text):
        specs = [(m.start("name"), m["name"])] if m["name"] else _grouped_types(text, m.start("group"))
        found += [(at, Unit("type", f"type {name}", line(at), line(_spec_end(text, at)))) for at, name in specs]
    return [u for _, u in sorted(found, key=lambda x: x[0])]


def go_body(text: str, at: int) -> tuple[int, int] | None:
    """Places of the braces of a function whose name ends at ``at``, past parameters and results."""
    depth = 0
    for m in re.compile(r"[()\[\]{}\n]").finditer(text, at):
        c = m[0]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "\n" and depth == 0:
            return None
        elif c == "{" and depth == 0:
            if re.search(r"\b(interface|struct)\s*$", text[at : m.start()]):
                close = block_end(text, m.start())
                return go_body(text, close + 1) if close is not None else None
            close = block_end(text, m.start())
            return (m.start(), close) if close is not None else None
    return None


def _grouped_types(text: str, at: int) -> list[tuple[int, str]]:
    close, out, depth = block_end(text, at, "()"), [], 0
    for m in re.compile(r"[{}()\[\]]|(?m:^[ \t]*(\w+)\s)").finditer(text, at + 1, close):
        if m[1] and depth == 0:
            out.append((m.start(1), m[1]))
        elif m[0] in ("{", "(", "["):
            depth += 1
        elif m[0] in ("}", ")", "]"):
            depth -= 1
    return out


def _spec_end(text: str, at: int) -> int:
    stop = text.find("\n", at)
    stop = len(text) if stop < 0 else stop
    brace = text.find("{", at, stop)
    if brace >= 0 and (close := block_end(text, brace)) is not None:
        return close
    return stop


HCL_BLOCK = re.compile(r"^(?P<type>[A-Za-z_][\w-]*)(?P<labels>(?:[ \t]+(?:\"[^\"\n]*\"|[A-Za-z_][\w-]*))*)[ \t]*\{", re.M)


def terraform_units(path: str, source: str) -> list[Unit]:
    """Top-level blocks; a module's literal relative source becomes a link to its directory."""
    text, bare = blank(source, HCL_BLANK, lambda s: s.startswith('"')), blank(source, HCL_BLANK)
    out, past = [], 0
    for m in HCL_BLOCK.finditer(text):
        if m.start() < past or bare[m.end() - 1] != "{":
            continue
        close = block_end(bare, m.end() - 1)
        if close is None:
            break
        past = close
        labels = [x.strip('"') for x in re.findall(r'"[^"\n]*"|[A-Za-z_][\w-]*', m["labels"])]
        unit = Unit(m["type"], " ".join([m["type"], ".".join(labels)]).strip(), source.count("\n", 0, m.start()) + 1, source.count("\n", 0, close) + 1)
        s = re.search(r'^\s*source\s*=\s*"(\.\.?/[^"$]*)"\s*$', text[m.end() : close], re.M)
        if unit.kind == "module" and s:
            unit.links = [posixpath.normpath(posixpath.join(posixpath.dirname(path), s[1]))]
        out.append(unit)
    return out


# YAML: playbooks and task lists, by content


def yaml_roots(source: str) -> list | None:
    """Root nodes of the documents, None if the text is no YAML or has too many documents."""
    import yaml

    try:
        roots = []
        for root in yaml.compose_all(source, Loader=yaml.SafeLoader):
            if len(roots) == MAX_DOCUMENTS:
                return None
            if root is not None:
                roots.append(root)
        return roots
    except (yaml.YAMLError, RecursionError):
        return None


def _value(mapping, *keys: str):
    return next((v for want in keys for k, v in mapping.value if getattr(k, "value", None) == want), None)


def _is(node, kind: str) -> bool:
    return type(node).__name__ == f"{kind}Node"


def task_action(task) -> str | None:
    """The one key that is no keyword; None if there are none or several. A block is its own action."""
    keys = [k.value for k, _ in task.value if isinstance(k.value, str)]
    if "block" in keys:
        return "block"
    actions = [k for k in keys if k not in TASK_KEYWORDS and not k.startswith("with_")]
    return actions[0] if len(actions) == 1 else None


def yaml_flavor(roots: list) -> str:
    """kubernetes, playbook, tasks or plain."""
    if any(_is(r, "Mapping") and _value(r, "apiVersion") and _value(r, "kind") for r in roots):
        return "kubernetes"
    items = roots[0].value if roots and _is(roots[0], "Sequence") else []
    if not items or not all(_is(i, "Mapping") for i in items):
        return "plain"
    if any(_value(i, "hosts") or _value(i, *IMPORT_KEYS) for i in items):
        return "playbook"
    actions = [task_action(i) for i in items]
    known = any(a and (a == "block" or a in TASK_ACTIONS or COLLECTION_ACTION.fullmatch(a)) for a in actions)
    return "tasks" if None not in actions and known else "plain"


def ansible_match(path: str, peek: str) -> bool:
    if extension(path) not in (".yml", ".yaml"):
        return False
    if len(peek.encode()) >= PEEK - 3:  # the peek may end within a line
        peek = peek[: peek.rfind("\n") + 1]
    roots = yaml_roots(peek)
    return bool(roots) and yaml_flavor(roots) in ("playbook", "tasks")


def _label(node) -> str:
    return " ".join(node.value.split()) if node is not None and _is(node, "Scalar") else ""


def ansible_units(path: str, source: str) -> list[Unit]:
    """A unit for each play or task, without the blank lines and comments that follow it."""
    roots = yaml_roots(source)
    flavor = yaml_flavor(roots) if roots else "plain"
    if flavor not in ("playbook", "tasks"):
        return []
    lines, out = source.split("\n"), []
    for r, root in enumerate(roots):
        if not _is(root, "Sequence"):
            continue
        limit = roots[r + 1].start_mark.line if r + 1 < len(roots) else len(lines)
        stops = [i.start_mark.line for i in root.value[1:]] + [limit]
        for n, (item, end) in enumerate(zip(root.value, stops)):
            if not _is(item, "Mapping"):
                continue
            start = item.start_mark.line + 1
            while end > start and ((text := lines[end - 1].strip()) in ("", "---", "...") or text.startswith("#")):
                end -= 1
            if flavor == "playbook":
                label = next((x for x in (_label(_value(item, "name")), _label(_value(item, "hosts")), _label(_value(item, *IMPORT_KEYS))) if x), f"#{n + 1}")
                out.append(Unit("play", f"play {label}", start, end))
            else:
                out.append(Unit("task", f"task {_label(_value(item, 'name')) or task_action(item) or f'#{n + 1}'}", start, end))
    return out


def vault_encrypted(path: str, source: str) -> bool:
    """Encrypted as a whole, or a YAML file with an encrypted value."""
    return source.startswith("$ANSIBLE_VAULT;") or extension(path) in (".yml", ".yaml") and re.search(r"^[ \t]+\$ANSIBLE_VAULT;", source, re.M) is not None


def no_units(path: str, source: str) -> list[Unit]:
    return []


def default_registry() -> Registry:
    """Kinds, priorities and extensions."""
    return Registry(
        Parser("terraform", 100, by_extension(".tf"), terraform_units), Parser("go", 90, by_extension(".go"), go_units), Parser("python", 85, by_extension(".py"), python_units),
        Parser("shell", 84, shell_match, shell_units), Parser("ansible", 83, ansible_match, ansible_units), Parser("frontend", 80, by_extension(".js", ".jsx", ".ts", ".tsx", ".html", ".css"), no_units),
        Parser("yaml", 20, by_extension(".yml", ".yaml"), no_units), Parser("document", 10, by_extension(".md", ".mdx", ".txt"), no_units),
    )


UNITS = "path string, file_kind string, unit_id string, kind string, name string, start int, end int, links array<string>"


def parse_file(registry: Registry, path: str, source: str) -> list[tuple]:
    """Rows of UNITS; repeated ids get ``#2``, ``#3`` and so on."""
    got = None if vault_encrypted(path, source) else registry.parse(path, source)
    rows, seen = [], {}
    for u in got[1] if got else ():
        base = f"{path}:{u.name}"
        seen[base] = seen.get(base, 0) + 1
        rows.append((path, got[0], base if seen[base] == 1 else f"{base}#{seen[base]}", u.kind, u.name, u.start, u.end, u.links))
    return rows


def parse_units(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Units of files (path, source), as UNITS; files that no parser claims have none."""
    registry = registry or default_registry()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(UNITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):  # a file may have many units
            rows = [r for path, source in zip(*(c.to_pylist() for c in part.columns)) for r in parse_file(registry, path, source or "")]
            columns = list(zip(*rows)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, arrow.types)], schema=arrow)

    return files.select("path", "source").mapInArrow(run, UNITS)


def register_udtf(spark, registry: Registry | None = None) -> None:
    """``parse_units(path, source)`` as a table function for SQL."""
    from pyspark.sql.functions import udtf

    parsers = registry or default_registry()

    class ParseUnits:
        def eval(self, path: str, source: str):
            yield from parse_file(parsers, path, source)

    spark.udtf.register("parse_units", udtf(ParseUnits, returnType=UNITS))
