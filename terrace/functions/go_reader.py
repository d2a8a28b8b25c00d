"""Facts of a Go file, read by recursive descent: what it declares, and what its calls stand on.

A value is a term: a base and the steps taken from it. The base is a type that the
text names (``of T``) or a name of a package (``name p|x``); steps are ``.x``, ``()``,
``[]`` (an element), ``<-`` (a received value) and ``#n`` (the n-th result). Local
names are resolved here, in their scopes; all else is left to joins, which have the
whole module before them. What can't be told from the text is None.

Types are written as wrappers, each ``()`` (a function of that result), ``[]`` (a
container of those elements) or ``<-`` (a channel of them), and a package and name.
"""

from __future__ import annotations

import posixpath
import re
from typing import NamedTuple

from .parsers import GO_BLANK

#: The words of the language that matter here.
KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
BUILTINS = set("append cap clear close complex copy delete imag len make max min new panic print println real recover".split())
BINARY = set("+ - * / % & | ^ << >> && || == != < > <= >= &^ <-".split())
OPENS_TYPE = {"*", "[", "map", "chan", "<-", "func", "struct", "interface", "("}
TOKEN = re.compile(r"(?P<space>[^\S\n]+)|(?P<line>\n)|(?P<name>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<op>:=|\.\.\.|<-|&&|\|\||&\^=?|<<=?|>>=?|\+\+|--|[-+*/%&|^<>=!]=|.)", re.S)

Term = tuple[str, tuple[str, ...]]


class Row(NamedTuple):
    """kind: import, def, diagnostic, a use (call, external, method, each also as a route's handler), or a fact (type, embed, field, imethod, func, var)."""

    kind: str
    line: int
    last: int
    owner: str
    target_package: str
    target: str
    base: str
    steps: tuple[str, ...]


def more(term: Term | None, step: str) -> Term | None:
    return (term[0], (*term[1], step)) if term else None


def wrap(mark: str, inner: str | None) -> str | None:
    return None if inner is None else mark + inner


class Reader:
    def __init__(self, source: str, folder: str):
        text = GO_BLANK.sub(lambda m: ("0" if m[0][0] in "\"'`" else " ") + re.sub(r"[^\n]", " ", m[0][1:]), source)
        self.tokens: list[tuple[str, str, int]] = []
        line = 1
        for m in TOKEN.finditer(text):
            kind, word = m.lastgroup, m[0]
            if kind == "line":
                last = self.tokens[-1] if self.tokens else ("", "", 0)
                if last[0] == "number" or (last[0] == "name" and (last[1] not in KEYWORDS or last[1] in ("break", "continue", "fallthrough", "return"))) or last[1] in (")", "]", "}", "++", "--"):
                    self.tokens.append(("op", ";", line))
                line += 1
            elif kind != "space":
                self.tokens.append((kind, word, line))
        self.at, self.rows, self.imports, self.owner = 0, [], {}, ""
        self.env: list[dict[str, Term | None]] = []
        self.bare = False  # in the header of a statement, where a brace opens its block
        self.switched: Term | None = None
        self.arguments: list[str] = []
        package = next((self.tokens[n + 1][1] for n, t in enumerate(self.tokens[:-1]) if t[1] == "package"), "")
        self.package, self.scope = package, folder + ("#" + package if package.endswith("_test") else "")

    # Tokens

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def kind(self, ahead: int = 0) -> str:
        n = self.at + ahead
        return self.tokens[n][0] if n < len(self.tokens) and self.tokens[n][1] not in KEYWORDS else ""

    def line(self) -> int:
        return self.tokens[min(self.at, len(self.tokens) - 1)][2]

    def next(self) -> str:
        self.at += 1
        return self.peek(-1)

    def accept(self, word: str) -> bool:
        hit = self.peek() == word
        self.at += hit
        return hit

    def skip(self) -> None:
        """Past the bracket that closes the one here."""
        depth = 0
        while self.peek():
            depth += self.peek() in ("(", "[", "{")
            depth -= self.peek() in (")", "]", "}")
            self.at += 1
            if not depth:
                return

    def emit(self, kind: str, line: int, target: str = "", package: str = "", base: str = "", steps: tuple[str, ...] = (), owner: str | None = None) -> None:
        self.rows.append(Row(kind, line, max(line, self.tokens[self.at - 1][2] if self.at else line), self.owner if owner is None else owner, package, target, base, steps))

    # Types

    def known(self, name: str) -> bool:
        return any(name in scope for scope in self.env)

    def type(self) -> str | None:
        word = self.peek()
        if word in ("*", "..."):
            self.at += 1
            return self.type() if word == "*" else wrap("[]", self.type())
        if word == "(":
            self.at += 1
            inner = self.type()
            self.accept(")")
            return inner
        if word == "[":
            self.skip()
            return wrap("[]", self.type())
        if word == "map":
            self.at += 1
            self.skip()
            return wrap("[]", self.type())
        if word in ("chan", "<-"):
            self.at += 1
            self.accept("chan")
            self.accept("<-")
            return wrap("<-", self.type())
        if word == "func":
            self.at += 1
            return "()" + (self.signature()[1] or "?")
        if word in ("struct", "interface"):
            self.at += 1
            self.skip()
            return None
        if self.kind() != "name":
            return None
        name = self.next()
        out = None if self.known(name) else f"{self.scope}|{name}"
        if self.peek() == "." and self.kind(1) == "name":
            self.at += 1
            member = self.next()
            out = f"@{self.imports[name]}|{member}" if name in self.imports and not self.known(name) else None
        self.arguments = []
        if self.peek() == "[":
            start = self.at
            self.skip()
            self.arguments = [w for k, w, _ in self.tokens[start : self.at] if k == "name"]
        return out

    def parameters(self) -> list[tuple[str | None, str | None]]:
        """(name, type) of each parameter between brackets; names are None where only types stand."""
        self.accept("(")
        entries: list[tuple[int, bool]] = []
        out: list[tuple[str | None, str | None]] = []
        while self.peek() and self.peek() != ")":
            if self.accept(",") or self.accept(";"):
                continue
            start = self.at
            generic = self.peek(1) == "[" and self.kind(2) == "name" and self._after_bracket() in (",", ")")
            named = self.kind() == "name" and self.peek(1) not in (",", ")", ".", "") and not generic
            if named:
                name = self.next()
                out.append((name, self.type()))
            else:
                out.append((None, self.type()))
            entries.append((start, named))
            if self.at == start:
                self.at += 1
        self.accept(")")
        if any(named for _, named in entries):  # names before a type share it
            kind: str | None = None
            for n in range(len(out) - 1, -1, -1):
                if entries[n][1]:
                    kind = out[n][1]
                else:
                    out[n] = (self.tokens[entries[n][0]][1], kind)
        return out

    def _after_bracket(self) -> str:
        depth, n = 0, self.at + 1
        while n < len(self.tokens):
            depth += self.tokens[n][1] in ("(", "[", "{")
            depth -= self.tokens[n][1] in (")", "]", "}")
            n += 1
            if not depth:
                break
        return self.tokens[n][1] if n < len(self.tokens) else ""

    def signature(self) -> tuple[list[tuple[str | None, str | None]], str | None]:
        """Parameters with named results, and the type of the result."""
        found = self.parameters()
        if self.peek() == "(":
            results = self.parameters()
            types = [t or "?" for _, t in results]
            return found + [r for r in results if r[0]], types[0] if len(types) == 1 else "tuple:" + "\x1f".join(types)
        if self.peek() in OPENS_TYPE or self.kind() == "name":
            return found, self.type()
        return found, None

    # Declarations

    def file(self) -> list[Row]:
        while self.peek():
            start, word = self.at, self.peek()
            if word == "import":
                self.at += 1
                while self.peek() and self.peek() != ";":  # paths were taken from the text
                    if self.peek() == "(":
                        self.skip()
                    else:
                        self.at += 1
            elif word == "func":
                self.function()
            elif word == "type":
                self.group(self.type_spec)
            elif word in ("var", "const"):
                self.group(self.value_spec)
            if self.at == start:
                self.at += 1
        return self.rows

    def group(self, spec) -> None:
        self.at += 1
        if self.accept("("):
            while self.peek() and not self.accept(")"):
                start = self.at
                if not self.accept(";"):
                    spec()
                if self.at == start:
                    self.at += 1
        else:
            spec()

    def type_parameters(self) -> dict[str, Term | None]:
        """Names of type parameters, where brackets hold any."""
        if self.peek() != "[" or self.kind(1) != "name" or self.peek(2) == "]":
            return {}
        start = self.at
        self.skip()
        words = self.tokens[start : self.at]
        return {w: None for n, (k, w, _) in enumerate(words) if k == "name" and words[n - 1][1] in ("[", ",")}

    def function(self) -> None:
        line = self.line()
        self.at += 1
        hidden: dict[str, Term | None] = {}
        receiver, own = "", []
        if self.peek() == "(":
            own = self.parameters()
            hidden = dict.fromkeys(self.arguments)
            if len(own) != 1 or not own[0][1]:
                self.emit("diagnostic", line, "a receiver that is no type")
                return
            receiver = own[0][1].partition("|")[2]
        name = self.next()
        self.env.append(hidden | self.type_parameters())
        found, result = self.signature()
        self.owner = f"method {receiver}.{name}" if receiver else f"func {name}"
        self.emit("def", line, "" if receiver else name, self.scope)
        self.emit("func", line, name, self.scope, "()" + (result or "?"), owner=receiver)
        self.env.append({n: ("of " + t, ()) if t else None for n, t in [*own, *found] if n})
        if self.accept("{"):
            self.block()
        self.env, self.owner = [], ""

    def type_spec(self) -> None:
        line, name = self.line(), self.next()
        if self.env:  # a local type hides what has its name
            self.env[-1][name] = None
            self.type_parameters()
            self.accept("=")
            self.type()
            return
        self.env.append(self.type_parameters())
        alias = "alias" if self.accept("=") else ""
        word = self.peek()
        if word in ("struct", "interface"):
            self.at += 1
            self.emit("type", line, name, self.scope, word, (alias,))
            self.members(name, word)
        else:
            self.emit("type", line, name, self.scope, self.type() or "?", (alias,))
        self.env = []

    def members(self, owner: str, of: str) -> None:
        self.accept("{")
        while self.peek() and not self.accept("}"):
            start, line = self.at, self.line()
            if of == "interface" and self.kind() == "name" and self.peek(1) == "(":
                name = self.next()
                self.emit("imethod", line, name, self.scope, "()" + (self.signature()[1] or "?"), owner=owner)
            elif of == "struct" and self.kind() == "name" and self.peek(1) not in (".", ";", "}") and self.kind(1) != "number" and not (self.peek(1) == "[" and self._after_bracket() in (";", "}")):
                names = [self.next()]
                while self.accept(","):
                    names.append(self.next())
                kind = self.type()
                for name in names:
                    self.emit("field", line, name, self.scope, kind or "?", owner=owner)
            elif self.peek() == "*" or self.kind() == "name":
                kind = self.type()
                if kind:
                    self.emit("embed", line, kind.rpartition("|")[2], self.scope, kind, owner=owner)
            while self.peek() and self.peek() not in (";", "}"):
                if self.peek() in ("(", "[", "{"):
                    self.skip()
                else:
                    self.at += 1
            self.accept(";")
            if self.at == start:
                self.at += 1

    def value_spec(self) -> None:
        line, names = self.line(), [self.next()]
        while self.accept(","):
            names.append(self.next())
        kind = self.type() if self.peek() not in ("=", ";", ")") else None
        terms: list[Term | None] = [("of " + kind, ()) if kind else None] * len(names)
        if self.accept("="):
            terms = self.spread(names, self.list()) if kind is None else (self.list(), terms)[1]
        for name, term in zip(names, terms):
            if self.env:
                self.env[-1][name] = term
            elif term and name != "_":
                self.emit("var", line, name, self.scope, *term)

    def spread(self, names: list[str], values: list[Term | None]) -> list[Term | None]:
        if len(values) == 1 and len(names) > 1:
            called = values[0] and values[0][1] and values[0][1][-1] == "()"
            return [more(values[0], f"#{n}") if called else values[0] if n == 0 else None for n in range(len(names))]
        return (values + [None] * len(names))[: len(names)]

    # Statements

    def block(self, switch: tuple[str, Term | None] | None = None) -> None:
        """Statements up to the closing brace, whose opening one has been read."""
        bare, self.bare = self.bare, False
        self.env.append({})
        while self.peek() and not self.accept("}"):
            start = self.at
            if self.peek() in ("case", "default"):
                self.case(switch)
            else:
                self.statement()
            if self.at == start:
                self.at += 1
        self.env.pop()
        self.bare = bare

    def case(self, switch: tuple[str, Term | None] | None) -> None:
        self.env[-1] = {}
        if self.next() == "case":
            if switch:
                types = [self.type()]
                while self.accept(","):
                    types.append(self.type())
                self.env[-1][switch[0]] = switch[1] if len(types) > 1 else ("of " + types[0], ()) if types[0] else None
            else:
                self.simple()
        elif switch:
            self.env[-1][switch[0]] = switch[1]
        self.accept(":")

    def statement(self) -> None:
        word = self.peek()
        if word == ";":
            self.at += 1
        elif word == "{":
            self.at += 1
            self.block()
        elif word in ("if", "for", "switch", "select"):
            self.headed(word)
        elif word in ("var", "const"):
            self.group(self.value_spec)
        elif word == "type":
            self.group(self.type_spec)
        elif word in ("return", "go", "defer", "goto", "break", "continue", "fallthrough"):
            self.at += 1
            if self.peek() not in (";", "}"):
                self.simple()
        elif self.kind() == "name" and self.peek(1) == ":":
            self.at += 2
        else:
            self.simple()

    def headed(self, word: str) -> None:
        self.at += 1
        self.env.append({})
        bare, self.bare, switch = self.bare, True, None
        while self.peek() and self.peek() != "{":
            start = self.at
            if not self.accept(";"):
                self.switched = None
                names = self.simple()
                if self.switched is not None and word == "switch":
                    switch = (names[0] if names else "_", self.switched)
            if self.at == start:
                self.at += 1
        self.bare = bare
        if self.accept("{"):
            self.block(switch)
        if word == "if" and self.accept("else"):
            self.statement()
        self.env.pop()

    def simple(self) -> list[str]:
        """An expression, an assignment or a definition; the names it defines."""
        n, names = self.at, []
        while n < len(self.tokens) and self.tokens[n][0] == "name" and self.tokens[n][1] not in KEYWORDS:
            names.append(self.tokens[n][1])
            n += 1
            if n < len(self.tokens) and self.tokens[n][1] == ",":
                n += 1
                continue
            break
        if names and n < len(self.tokens) and self.tokens[n][1] == ":=":
            self.at = n + 1
            if self.accept("range"):
                over = self.expression()[0]
                terms = [more(over, "<-")] if len(names) == 1 else [None, more(over, "[]")]
            else:
                terms = self.spread(names, self.list())
            for name, term in zip(names, terms):
                self.env[-1][name] = term
            return names
        if not self.accept("range"):
            self.list()
        if self.peek() in ("=", "++", "--") or (self.peek().endswith("=") and self.peek() not in BINARY):
            self.at += 1
            self.accept("range")
            if self.peek() not in (";", "{", "}", ")"):
                self.list()
        return []

    # Expressions: each gives its term and, where it names a function or method, that reference

    def list(self) -> list[Term | None]:
        out = [self.expression()[0]]
        while self.accept(","):
            out.append(self.expression()[0])
        return out

    def expression(self) -> tuple[Term | None, tuple | None]:
        out = self.unary()
        while self.peek() in BINARY:
            self.at += 1
            self.unary()
            out = (None, None)
        return out

    def unary(self) -> tuple[Term | None, tuple | None]:
        word = self.peek()
        if word in ("&", "*"):
            self.at += 1
            return self.unary()
        if word == "<-":
            self.at += 1
            return more(self.unary()[0], "<-"), None
        if word in ("-", "+", "!", "^", "~"):
            self.at += 1
            self.unary()
            return None, None
        return self.primary()

    def primary(self) -> tuple[Term | None, tuple | None]:
        line, word, term, ref = self.line(), self.peek(), None, None
        if word == "(":
            bare, self.bare = self.bare, False
            self.at += 1
            term, ref = self.expression()
            self.accept(")")
            self.bare = bare
        elif word == "func":
            self.at += 1
            found, result = self.signature()
            term = ("of ()" + (result or "?"), ())
            if self.accept("{"):
                self.env.append({n: ("of " + t, ()) if t else None for n, t in found if n})
                self.block()
                self.env.pop()
        elif word in ("[", "map", "chan", "struct", "interface"):
            kind = self.type()
            if self.peek() == "{":
                self.literal()
                term = ("of " + kind, ()) if kind else None
            else:  # a conversion
                term = ("of ()" + kind, ()) if kind else None
        elif self.tokens[self.at : self.at + 1] and self.tokens[self.at][0] == "number":
            self.at += 1
        elif self.kind() == "name":
            name = self.next()
            local = next((scope for scope in reversed(self.env) if name in scope), None)
            if local is not None:
                term = local[name]
            elif name in self.imports and self.peek() == "." and self.kind(1) == "name":
                self.at += 1
                member = self.next()
                term, ref = (f"name @{self.imports[name]}|{member}", ()), ("external", self.imports[name], member)
            elif name in BUILTINS and self.peek() == "(":
                term = self.builtin(name)
            else:
                term, ref = (f"name {self.scope}|{name}", ()), ("call", self.scope, name)
        return self.postfix(line, term, ref)

    def builtin(self, name: str) -> Term | None:
        bare, self.bare = self.bare, False
        self.at += 1
        term = None
        if name in ("new", "make"):
            kind = self.type()
            term = ("of " + kind, ()) if kind else None
        elif self.peek() != ")":
            term = self.expression()[0] if name == "append" else (self.expression(), None)[1]
        while self.peek() and self.peek() != ")":
            start = self.at
            if not (self.accept(",") or self.accept("...")):
                self.expression()
            if self.at == start:
                self.at += 1
        self.accept(")")
        self.bare = bare
        return term

    def literal(self) -> None:
        """The elements of a composite literal between braces."""
        bare, self.bare = self.bare, False
        self.accept("{")
        while self.peek() and not self.accept("}"):
            start = self.at
            if self.peek() == "{":
                self.literal()
            elif not (self.accept(",") or self.accept(":") or self.accept(";")):
                if self.kind() == "name" and self.peek(1) == ":":
                    self.at += 2  # a field's name, or a key
                else:
                    self.expression()
            if self.at == start:
                self.at += 1
        self.bare = bare

    def postfix(self, line: int, term: Term | None, ref: tuple | None) -> tuple[Term | None, tuple | None]:
        while True:
            word = self.peek()
            if word == ".":
                self.at += 1
                if self.accept("("):
                    if self.accept("type"):
                        self.switched = term or ("of ?", ())
                    else:
                        kind = self.type()
                        term = ("of " + kind, ()) if kind else None
                    self.accept(")")
                    ref = None
                else:
                    name = self.next()
                    ref, term = ("method", term, name) if term else None, more(term, "." + name)
            elif word == "(":
                bare, self.bare = self.bare, False
                self.at += 1
                refs = []
                while self.peek() and not self.accept(")"):
                    start = self.at
                    if not (self.accept(",") or self.accept("...")):
                        refs.append(self.expression()[1])
                    if self.at == start:
                        self.at += 1
                self.bare = bare
                self.called(line, ref, refs)
                term, ref = more(term, "()"), None
            elif word == "[":
                bare, self.bare = self.bare, False
                self.at += 1
                cut = False
                while self.peek() and not self.accept("]"):
                    start = self.at
                    cut |= self.peek() == ":"
                    if not (self.accept(":") or self.accept(",")):
                        self.expression()
                    if self.at == start:
                        self.at += 1
                self.bare = bare
                term = term if cut else more(term, "[]")
            elif word == "{" and not self.bare and term and term[0].startswith("name ") and set(term[1]) <= {"[]"}:
                self.literal()
                term, ref = ("of " + term[0][5:], ()), None
            else:
                return term, ref

    def called(self, line: int, ref: tuple | None, refs: list[tuple | None]) -> None:
        self.reference("", line, ref)
        if ref and ref[0] == "external" and ref[1] == "net/http" and ref[2] in ("HandleFunc", "Handle") and len(refs) == 2:
            self.reference("route ", line, refs[1])

    def reference(self, prefix: str, line: int, ref: tuple | None) -> None:
        if not self.owner:  # a value of a package, in no function
            return
        if ref and ref[0] == "method":
            self.emit(prefix + "method", line, ref[2], "", *ref[1])
        elif ref:
            self.emit(prefix + ref[0], line, ref[2], ref[1])


IMPORT = re.compile(r"^import\s+(?:(?P<one>(?:[\w.]+\s+)?\"[^\"]+\")|\((?P<many>[^)]*)\))", re.M)


def imports(source: str) -> dict[str, str]:
    """Alias -> import path; blank and dot imports are left out."""
    out = {}
    for m in IMPORT.finditer(source):
        for alias, path in re.findall(r"(?:([\w.]+)\s+)?\"([^\"]+)\"", m["one"] or m["many"]):
            out[alias or posixpath.basename(path)] = path
    return {a: p for a, p in out.items() if a not in ("_", ".")}


def read(source: str, folder: str) -> tuple[str, str, list[Row]]:
    """Package, scope and rows of a file whose brackets close."""
    reader = Reader(source, folder)
    reader.imports = imports(source)
    rows = [Row("import", 1, 1, "", path, "", "", ()) for path in reader.imports.values()]
    return reader.package, reader.scope, rows + reader.file()
