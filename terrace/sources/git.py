"""Version control as tables, by read-only commands with bounded output and time.

``terrace_git_log``: commit, ts (seconds), parents, subject, paths.
``terrace_git_tree``: path, blob_id, mode, of a revision or of the index.
``terrace_git_blob``: blob_id, content, of the ids given, dealt over partitions.
``terrace_git_blame``: line, commit, ts, text, of a file.
``terrace_git_status``: path, place (staged, unstaged or untracked), of the tree as it is; place ``note``: why a listing failed.
``terrace_git_commits``: n, commit, parents, day, author, subject, files, of the newest commits.
``terrace_git_refs``: ref, tip, day, fork, ahead, of branches that are ahead of ``base``.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import EngineError, Kind

#: Bytes and seconds of one call, ids and bytes of a batch.
MAX_OUTPUT, SECONDS, LIST_SECONDS, MAX_BLOBS, MAX_BLOB_BYTES, MAX_BATCH_BYTES = 262_144, 2, 5, 8_192, 262_144, 33_554_432
OBJECT_ID = re.compile(r"[0-9a-f]{40}(?:[0-9a-f]{24})?")
REVISION = re.compile(r"(?!-)[\w./@{}^~+-]{1,200}")


def git(root: str, *args: str, feed: bytes | None = None, most: int = MAX_OUTPUT, seconds: float = SECONDS) -> bytes:
    """Output of a read-only command; an error if it fails, takes too long or says too much."""
    env = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")} | {"GIT_OPTIONAL_LOCKS": "0", "GIT_TERMINAL_PROMPT": "0", "GIT_CONFIG_NOSYSTEM": "1", "LC_ALL": "C"}
    command = ["git", "--no-pager", "-c", "core.fsmonitor=false", "-c", "core.quotePath=false", "-c", f"safe.directory={os.path.abspath(root)}", "-C", root, *args]
    try:
        run = subprocess.Popen(command, stdin=subprocess.PIPE if feed is not None else subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=env)
    except OSError as e:
        raise EngineError(Kind.NOT_FOUND, "version control isn't available") from e
    try:
        out, _ = run.communicate(feed, timeout=seconds)
    except subprocess.TimeoutExpired as e:
        run.kill()
        run.communicate()
        raise EngineError(Kind.TOO_LARGE, f"{args[0]} took more than {seconds} s") from e
    if run.returncode:
        raise EngineError(Kind.NOT_FOUND, f"{args[0]} failed")
    if len(out) > most:
        raise EngineError(Kind.TOO_LARGE, f"{args[0]} gave more than {most} bytes")
    return out


def resolve(root: str, revision: str) -> str:
    """The commit that a revision names."""
    if not REVISION.fullmatch(revision):
        raise EngineError(Kind.INVALID, f"not a revision: {revision!r}")
    return git(root, "rev-parse", "--verify", "--end-of-options", f"{revision}^{{commit}}").decode().strip()


def first_parent(root: str, commit: str) -> str:
    """A commit's first parent, or the empty tree's id."""
    parents = git(root, "rev-list", "--parents", "-n", "1", commit).decode().split()[1:]
    return parents[0] if parents else git(root, "hash-object", "-t", "tree", "--stdin", feed=b"").decode().strip()


#: Names of sides that are no commit, and what they are called.
WORKTREE, INDEX, EMPTY = ":worktree", ":index", ":empty"
LABELS = {WORKTREE: "indexed working tree", INDEX: "staged index", EMPTY: "empty tree"}
#: Commits listed, refs looked at.
MAX_COMMITS, MAX_REFS = 30, 200
NAMES_ONLY = ("--name-only", "-z", "--relative", "--no-renames", "--no-ext-diff", "--no-textconv")
PLACES = {"staged": ("diff", "--cached", *NAMES_ONLY), "unstaged": ("diff", *NAMES_ONLY), "untracked": ("ls-files", "--others", "--exclude-standard", "-z")}


@dataclass(frozen=True)
class Side:
    """One side of a comparison: a commit, or the work tree, the index or the empty tree."""

    id: str
    label: str

    @classmethod
    def named(cls, root: str, name: str) -> Side:
        if name in LABELS:
            return cls(name, LABELS[name])
        try:
            commit = resolve(root, name)
        except EngineError as e:
            raise EngineError(Kind.INVALID, f"not a commit at hand: {name!r}") from e
        return cls(commit, f"commit {commit[:12]}")


def parse_revision(text: str) -> dict[str, str] | None:
    """What a typed revision selects: ``A..B`` two sides, other text one commit; None where it is neither."""
    text = text.strip()
    if not 0 < len(text) <= 256 or re.search(r"\s", text):
        return None
    base, dots, head = text.partition("..")
    if not dots:
        return {"commit": text}
    return {"base": base, "head": head} if base and head and head[0] != "." else None


def select_sides(root: str, base: str = "", head: str = "", commit: str = "") -> tuple[Side, Side]:
    """The two sides of a review: a commit and its first parent (or the empty tree), or a base and a head, by default the last commit and the work tree."""
    if commit and (base or head):
        raise EngineError(Kind.INVALID, "a commit stands alone, without base or head")
    if commit:
        if commit in LABELS:
            raise EngineError(Kind.INVALID, f"not a commit: {commit}")
        after = Side.named(root, commit)
        parents = git(root, "rev-list", "--parents", "-n", "1", after.id).decode().split()[1:]
        return (Side.named(root, parents[0]) if parents else Side(EMPTY, LABELS[EMPTY])), after
    before, after = Side.named(root, base or "HEAD"), Side.named(root, head or WORKTREE)
    if before.id == WORKTREE or after.id == EMPTY or before == after:
        raise EngineError(Kind.INVALID, "the sides must differ, the work tree can only be the head, and the empty tree only the base")
    return before, after


def succeeds(root: str, *args: str) -> bool:
    try:
        git(root, *args)
    except EngineError:
        return False
    return True


def said(root: str, *args: str) -> str:
    """What a command says, in one line; empty if it fails."""
    try:
        return git(root, *args).decode(errors="replace").strip()
    except EngineError:
        return ""


def default_branch(root: str) -> str:
    """The remote's default as last known, else main or master; empty if there is none. Nothing is fetched."""
    known = said(root, "symbolic-ref", "--quiet", "--short", "refs/remotes/origin/HEAD")
    if known and len(known) <= 200:
        return known
    return next((n for n in ("main", "master") if succeeds(root, "rev-parse", "--verify", "--quiet", f"refs/heads/{n}^{{commit}}")), "")


def status_rows(root: str) -> list[tuple]:
    """(path, place) of what has changed; of a listing that fails, or says too much, a row with the reason in place of ``note``."""
    rows = []
    for place, command in PLACES.items():
        try:
            out = git(root, *command, most=4 * MAX_OUTPUT, seconds=LIST_SECONDS)
        except EngineError as e:
            rows.append((f"{place} files could not be listed: {e}", "note"))
            continue
        rows += [(path, place) for path in out.decode(errors="replace").split("\0") if path]
    return rows


def commit_rows(root: str, count: int = MAX_COMMITS) -> list[tuple]:
    """(n, commit, parents, day, author, subject, files); merges list no files."""
    out = git(root, "log", f"-{count}", "--no-show-signature", "--no-renames", "--no-ext-diff", "--no-textconv", "--relative", "--shortstat", "--format=%x01%H%x00%P%x00%as%x00%an%x00%s%x00", most=4 * MAX_OUTPUT, seconds=LIST_SECONDS)
    rows = []
    for n, record in enumerate(out.decode(errors="replace").split("\x01")[1:], 1):
        commit, parents, day, author, subject, stat = record.split("\0", 5)
        files = re.search(r"(\d+) files? changed", stat)
        rows.append((n, commit, parents.split(), day, author, subject, int(files[1]) if files else 0))
    return rows


def ref_rows(root: str, base: str) -> list[tuple]:
    """(ref, tip, day, fork, ahead) of branches with commits that ``base`` lacks; one ref a tip, the first by name."""
    base_id = resolve(root, base)
    out = git(root, "for-each-ref", "--sort=refname", f"--count={MAX_REFS}", "--format=%(refname)%00%(objectname)%00%(committerdate:short)", "refs/heads", "refs/remotes", most=4 * MAX_OUTPUT, seconds=LIST_SECONDS)
    rows, seen = [], {base_id}
    for line in out.decode(errors="replace").split("\n"):
        ref, tip, day = (line.split("\0") + ["", ""])[:3]
        if tip in seen or not OBJECT_ID.fullmatch(tip) or ref.endswith("/HEAD"):
            continue
        seen.add(tip)
        fork = said(root, "merge-base", base_id, tip)
        ahead = said(root, "rev-list", "--count", f"{fork}..{tip}") if OBJECT_ID.fullmatch(fork) and fork != tip else ""
        if ahead.isdigit():
            rows.append((re.sub("^refs/(heads|remotes)/", "", ref), tip, day, fork, int(ahead)))
    return rows


def line_history(root: str, path: str, start: int, end: int, count: int = 5) -> list[tuple]:
    """(commit, day, subject) of the newest commits that changed these lines of the last commit's file."""
    out = git(root, "log", f"-{count}", "--no-show-signature", "-s", "--format=%H%x00%cd%x00%s", "--date=format-local:%Y-%m-%d", "-L", f"{start},{end}:./{path}", "HEAD")
    rows = [line.split("\0", 2) for line in out.decode(errors="replace").split("\n")]
    return [tuple(r) for r in rows if len(r) == 3 and OBJECT_ID.fullmatch(r[0])]


def committed_range(root: str, path: str, lines: list[str], start: int, end: int) -> tuple[int, int, bool] | None:
    """Where a unit stands in the last commit, and whether it reads otherwise now; None if it isn't there.

    It is found by its first line, nearest to where it is now.
    """
    try:
        head = git(root, "show", f"HEAD:./{path}", most=2 * MAX_OUTPUT).decode(errors="replace").split("\n")
    except EngineError:
        return None
    first = lines[start - 1]
    at = min((n for n, line in enumerate(head, 1) if line == first and first.strip()), key=lambda n: (abs(n - start), n), default=None)
    if at is None:
        return None
    last = min(at + end - start, len(head))
    return at, last, head[at - 1 : last] != lines[start - 1 : end]


def log_rows(root: str, count: int, path: str | None = None) -> list[tuple]:
    out = git(root, "log", f"-{count}", "--no-renames", "--no-show-signature", "-m", "--first-parent", "--name-only", "-z", "--format=%x01%H%x00%ct%x00%P%x00%s%x00", "HEAD", "--", *([path] if path else []), most=8 * MAX_OUTPUT, seconds=LIST_SECONDS)
    rows = []
    for record in out.decode(errors="replace").split("\x01")[1:]:
        commit, ts, parents, subject, *paths = record.split("\0")
        if OBJECT_ID.fullmatch(commit) and ts.isdigit():
            rows.append((commit, int(ts), parents.split(), subject[:240], [p.strip("\n") for p in paths if p.strip("\n")]))
    return rows


def tree_rows(root: str, revision: str | None) -> list[tuple]:
    """Regular files of a revision, or of the index if none is given; entries in conflict are left out."""
    if revision is None:
        out = git(root, "ls-files", "--stage", "-z", most=MAX_BATCH_BYTES, seconds=LIST_SECONDS)
        found = re.findall(r"(\d+) ([0-9a-f]+) (\d)\t([^\0]*)\0", out.decode(errors="replace"))
        return [(path, blob, mode) for mode, blob, stage, path in found if stage == "0" and mode in ("100644", "100755")]
    out = git(root, "ls-tree", "-r", "-z", "--full-tree", revision, most=MAX_BATCH_BYTES, seconds=LIST_SECONDS)
    found = re.findall(r"(\d+) (\w+) ([0-9a-f]+)\t([^\0]*)\0", out.decode(errors="replace"))
    return [(path, blob, mode) for mode, kind, blob, path in found if kind == "blob" and mode in ("100644", "100755")]


def blobs(root: str, ids: list[str]) -> dict[str, bytes]:
    """Contents of distinct ids; those over the size bound are left out, too many are an error."""
    wanted = sorted(set(ids))
    if len(wanted) > MAX_BLOBS or not all(OBJECT_ID.fullmatch(i) for i in wanted):
        raise EngineError(Kind.TOO_LARGE if len(wanted) > MAX_BLOBS else Kind.INVALID, "ids of blobs")
    if not wanted:
        return {}
    sizes = git(root, "cat-file", "--batch-check", feed="".join(f"{i}\n" for i in wanted).encode(), most=MAX_BATCH_BYTES, seconds=10).decode().split("\n")
    fit = [w[0] for line in sizes if len(w := line.split()) == 3 and w[1] == "blob" and int(w[2]) <= MAX_BLOB_BYTES]
    data, out, at = git(root, "cat-file", "--batch", feed="".join(f"{i}\n" for i in fit).encode(), most=MAX_BATCH_BYTES, seconds=10), {}, 0
    while at < len(data):
        end = data.index(b"\n", at)
        ident, _, size = data[at:end].decode().split()
        out[ident] = data[end + 1 : end + 1 + int(size)]
        at = end + 2 + int(size)
    return out


def blame_rows(root: str, path: str, revision: str | None = "HEAD") -> list[tuple]:
    """(line, commit, ts, text) of a file in a revision, or as it is now if none is given."""
    out, rows, times = git(root, "blame", "--porcelain", *([revision] if revision else []), "--", path, most=16 * MAX_OUTPUT, seconds=LIST_SECONDS).decode(errors="replace"), [], {}
    commit = line = None
    for text in out.split("\n"):
        if m := re.match(r"([0-9a-f]{40,64}) \d+ (\d+)", text):
            commit, line = m[1], int(m[2])
        elif text.startswith("author-time "):
            times[commit] = int(text.split()[1])
        elif text.startswith("\t"):
            rows.append((line, commit, times.get(commit), text[1:]))
    return rows


@dataclass
class Ids(InputPartition):
    ids: list[str]


class _Rows(DataSourceReader):
    """A reader of one partition."""

    def __init__(self, rows):
        self.rows = rows

    def read(self, partition) -> Iterator[tuple]:
        yield from self.rows()


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "terrace_git_log"

    def schema(self) -> str:
        return "commit string, ts bigint, parents array<string>, subject string, paths array<string>"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Rows(lambda: log_rows(o["path"], int(o.get("count", "30")), o.get("file")))


class GitTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "terrace_git_tree"

    def schema(self) -> str:
        return "path string, blob_id string, mode string"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Rows(lambda: tree_rows(o["path"], resolve(o["path"], o["revision"]) if "revision" in o else None))


class GitBlame(DataSource):
    @classmethod
    def name(cls) -> str:
        return "terrace_git_blame"

    def schema(self) -> str:
        return "line int, commit string, ts bigint, text string"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Rows(lambda: blame_rows(o["path"], o["file"]))


class GitStatus(DataSource):
    @classmethod
    def name(cls) -> str:
        return "terrace_git_status"

    def schema(self) -> str:
        return "path string, place string"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Rows(lambda: status_rows(o["path"]))


class GitCommits(DataSource):
    @classmethod
    def name(cls) -> str:
        return "terrace_git_commits"

    def schema(self) -> str:
        return "n int, commit string, parents array<string>, day string, author string, subject string, files bigint"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Rows(lambda: commit_rows(o["path"], int(o.get("count", MAX_COMMITS))))


class GitRefs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "terrace_git_refs"

    def schema(self) -> str:
        return "ref string, tip string, day string, fork string, ahead bigint"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Rows(lambda: ref_rows(o["path"], o["base"]))


class BlobReader(DataSourceReader):
    def __init__(self, root: str, ids: list[str]):
        self.root, self.ids = root, ids

    def partitions(self) -> list[Ids]:
        return [Ids(self.ids[n : n + 256]) for n in range(0, len(self.ids), 256)] or [Ids([])]

    def read(self, partition: Ids) -> Iterator[tuple]:
        yield from blobs(self.root, partition.ids).items()


class GitBlob(DataSource):
    @classmethod
    def name(cls) -> str:
        return "terrace_git_blob"

    def schema(self) -> str:
        return "blob_id string, content binary"

    def reader(self, schema) -> BlobReader:
        return BlobReader(self.options["path"], [i for i in self.options.get("ids", "").split(",") if i])


def register(spark) -> None:
    """Make all sources known to a session."""
    from .repository import RepositorySource

    for source in (RepositorySource, GitLog, GitTree, GitBlame, GitBlob, GitStatus, GitCommits, GitRefs):
        spark.dataSource.register(source)
