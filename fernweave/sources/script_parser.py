"""JavaScript and TypeScript by a tokenizer and a brace-matching scanner.

It knows declarations (classes, interfaces, enums, type aliases, functions, arrow functions, methods, fields,
variables), imports and exports, calls, member and index accesses, and types by name, in annotations and in expressions
(`as`, `satisfies`, type arguments). A destructuring pattern is one variable named by its text, with the names that it
binds as metadata; a computed member is named by its text in brackets. Code inside `${}` of a template is code.
What it does not model: `<T>value` casts, which look like markup.
"""

from __future__ import annotations

import re

from fernweave.sources import parsing

_TOKEN = re.compile(
    rb"""(?P<space>\s+)|(?P<doc>/\*\*(?!/).*?\*/)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')"""
    rb"""|(?P<number>\d[\w.]*)|(?P<word>[A-Za-z_$\x80-\xff#][\w$\x80-\xff]*)|(?P<op>=>|\?\.|\.\.\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|[-+*/%&|^]=|.)""",
    re.S,
)
_MODIFIERS = {"public", "private", "protected", "static", "abstract", "declare", "override", "readonly", "async", "get", "set", "accessor"}
_VISIBILITY = ("public", "private", "protected")
_IN_TYPES = {b"<", b">", b",", b".", b"|", b"&", b"[", b"]", b"{", b"}", b"(", b")", b":", b";", b"?", b"=>"}
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "in", "of", "void", "delete", "throw", "case", "do", "else", "yield", "with", "const", "let", "var"}
_PAIRS = {b"(": b")", b"[": b"]", b"{": b"}", b"${": b"}"}
_REGEX_BEFORE = {b"(", b",", b"=", b":", b"[", b"!", b"&", b"|", b"?", b"{", b"${", b"}", b";", b"=>", b"&&", b"||", b"??", b"return", b"typeof", b"case", b"in", b"of"}
#: A piece of a template: up to its end or to code inside it.
_PIECE = re.compile(rb"(?:\\.|\$(?!\{)|[^`\\$])*(`|\$\{)", re.S)
_REGEX = re.compile(rb"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


class _Scanner:
    def __init__(self, source: bytes):
        self.source, self.nodes, self.problems = source, [], []
        self.kind, self.value, self.start, self.end, self.doc = [], [], [], [], []
        self._tokens()
        self.match = self._pairs()
        self.closing = self._angles()

    def _piece(self, at: int, start: int, doc: str | None, depths: list[int]) -> int | None:
        """Past the piece of a template whose token starts at `start` and whose text at `at`; None if nothing ends it."""
        m = _PIECE.match(self.source, at)
        if m is None:
            return None
        code = m[1] == b"${"
        end = m.end() - 2 * code
        if end > start:
            self._token("string", start, end, doc)
        if code:
            self._token("op", end, m.end(), None)
            depths.append(0)
        return m.end()

    def _token(self, kind: str, start: int, end: int, doc: str | None) -> None:
        self.kind.append(kind)
        self.value.append(self.source[start:end])
        self.start.append(start)
        self.end.append(end)
        self.doc.append(doc)

    def _tokens(self) -> None:
        at, doc = 0, None
        depths: list[int] = []  # of the templates around: braces that are open in their code
        source, size, match = self.source, len(self.source), _TOKEN.match
        while at < size:
            m, first = None, source[at]
            if first == 0x60 and (past := self._piece(at + 1, at, doc, depths)) is not None:
                at, doc = past, None
                continue
            if first == 0x2F and source[at : at + 2] not in (b"//", b"/*") and (not self.value or self.value[-1] in _REGEX_BEFORE):
                m = _REGEX.match(source, at)
                kind = "string"
            if m is None:
                m = match(source, at)
                kind = m.lastgroup
            at = m.end()
            if kind == "space":
                continue
            if kind == "doc":
                doc = m[0].decode("utf-8", "replace")
            elif kind != "comment":
                self._token(kind, m.start(), at, doc)
                doc = None
                if depths and m[0] == b"{":
                    depths[-1] += 1
                elif depths and m[0] == b"}":
                    depths[-1] -= 1
                    if depths[-1] < 0:
                        depths.pop()
                        at = self._piece(at, at, None, depths) or at

    def _pairs(self) -> dict[int, int]:
        match, stack = {}, []
        for i, v in enumerate(self.value):
            if self.kind[i] != "op":
                continue
            if v in _PAIRS:
                stack.append(i)
            elif v in _PAIRS.values():
                # A closer ends what it fits; brackets that are still open inside are missing theirs, and lose no more than that.
                at = next((k for k in range(len(stack) - 1, -1, -1) if _PAIRS[self.value[stack[k]]] == v), None)
                if at is None:
                    self.problems.append(("syntax_error", f"unmatched {v.decode()}", self.start[i], self.end[i]))
                    continue
                for k in reversed(stack[at + 1 :]):
                    self.missing(k, self.start[i])
                    match[k] = i - 1 if i - 1 > k else i
                match[stack[at]] = i
                del stack[at:]
        for i in stack:
            self.missing(i, len(self.source))
            match[i] = len(self.value) - 1
        return match

    def _angles(self) -> dict[int, int]:
        """Pairs of < and > with nothing between them but what types are made of."""
        closing, stack, other = {}, [], -1
        for i, v in enumerate(self.value):
            if self.kind[i] != "op":
                continue
            if v not in _IN_TYPES:
                other = i
            elif v == b"<" or v in _PAIRS:
                stack.append(i)
            elif v == b">" and stack and self.value[stack[-1]] == b"<":
                first = stack.pop()
                if first > other:
                    closing[first] = i
            elif v in _PAIRS.values():
                while stack and self.value[stack.pop()] == b"<":
                    pass
        return closing

    def missing(self, i: int, at: int) -> None:
        self.problems.append(("missing_node", f"{self.value[i].decode()} is not closed", at, at))

    def past(self, i: int, end: int) -> int:
        """The partner of the bracket at i; without one, the last token of the span."""
        return self.match.get(i, max(i, min(end, len(self.value)) - 1))

    def word(self, i: int) -> str | None:
        return self.value[i].decode("utf-8", "replace") if i < len(self.value) and self.kind[i] == "word" else None

    def op(self, i: int, v: str) -> bool:
        return i < len(self.value) and self.kind[i] == "op" and self.value[i] == v.encode()

    def text(self, i: int, j: int) -> str:
        """Source of tokens i to j, j not included."""
        return self.source[self.start[i] : self.end[j - 1]].decode("utf-8", "replace") if i < j else ""

    def add(self, i: int, j: int, parent: int | None, type_: str, **more) -> int:
        self.nodes.append({"type": type_, "start": self.start[i], "end": self.end[max(i, min(j, len(self.end)) - 1)], "parent": parent, **more})
        return len(self.nodes) - 1

    def until(self, i: int, stops: tuple[str, ...], end: int) -> int:
        """The first token from i that is one of stops outside brackets."""
        while i < end:
            if self.kind[i] == "op":
                if self.value[i].decode("latin-1") in stops:
                    return i
                if i in self.match:
                    i = self.match[i]
            i = self.type_arguments(i, end) if self.type_arguments(i, end) > i else i + 1
        return end

    def angle(self, i: int, end: int) -> int:
        """Past type arguments, if any start at i."""
        if not self.op(i, "<"):
            return i
        depth = 0
        while i < end:
            depth += self.op(i, "<") - self.op(i, ">")
            i += 1
            if not depth:
                break
        return i

    def statement_end(self, i: int, end: int) -> int:
        """Past the expression that starts at i: at a semicolon, a comma, or a new line where it may end."""
        first = i
        while i < end:
            if self.kind[i] == "op" and self.value[i] in (b";", b",", b"}", b")"):
                break
            if i > first and b"\n" in self.source[self.end[i - 1] : self.start[i]] and self.kind[i] == "word" and (self.kind[i - 1] != "op" or self.value[i - 1] in (b")", b"]", b"}")):
                break
            if self.word(i) in ("as", "satisfies") and i > first and self.valued(i - 1):
                i = max(i + 1, self.type_end(i + 1, end))
            else:
                i = max(self.match.get(i, i) + 1, self.type_arguments(i, end))
        return i

    def valued(self, i: int) -> bool:
        """Whether a value may end with token i."""
        return self.kind[i] != "op" or self.value[i] in (b")", b"]", b"}", b"!")

    def comma_list(self, i: int, end: int) -> list[tuple[int, int]]:
        parts, first, depth = [], i, 0
        while i < end:
            depth += self.op(i, "<") - self.op(i, ">")
            if self.op(i, ",") and depth <= 0:
                parts.append((first, i))
                first = i + 1
            i = self.match.get(i, i) + 1
        return [p for p in [*parts, (first, end)] if p[0] < p[1]]

    def parameters(self, i: int, parent: int) -> list[dict]:
        out = []
        for a, b in self.comma_list(i + 1, self.match.get(i, i)):
            modifiers = []
            while self.word(a) in _MODIFIERS and a + 1 < b and self.kind[a + 1] == "word":
                modifiers.append(self.word(a))
                a += 1
            rest = self.op(a, "...")
            name_at = a + rest
            colon, equals = self.until(name_at, (":",), b), self.until(name_at, ("=",), b)
            stop = min(colon, equals)
            optional = stop > name_at and self.op(stop - 1, "?")
            name = self.text(name_at, stop - optional) or self.text(a, b)
            row = {"name": name, "type": self.text(colon + 1, equals) if colon < equals else None, "value": self.text(equals + 1, b) if equals < b else None}
            out.append(row)
            at = self.add(a, b, parent, "variable", kind="parameter", name=name, data_type=row["type"], initial_value=row["value"], visibility=next((m for m in modifiers if m in _VISIBILITY), None), modifiers=["optional"] * optional + ["rest"] * rest + modifiers)
            metadata = {"optional": "true"} if optional else {"rest": "true"} if rest else {}
            if self.op(name_at, "{") or self.op(name_at, "["):
                metadata["bindings"] = ",".join(self.bindings(name_at, stop, at))
            self.nodes[at]["metadata"] = metadata or None
            if row["type"]:
                self.types(colon + 1, equals, at)
            if equals < b:
                self.expressions(equals + 1, b, at)
        return out

    def bindings(self, i: int, end: int, parent: int | None) -> list[str]:
        """The names that the pattern at i binds. Its defaults and computed keys are expressions below parent."""
        if not (self.op(i, "{") or self.op(i, "[")):
            return [self.word(i)] if self.word(i) else []
        keyed, out = self.op(i, "{"), []
        for a, b in self.comma_list(i + 1, min(self.match.get(i, i), end)):
            a += self.op(a, "...")
            if keyed and (colon := self.until(a, (":", "="), b)) < b and self.op(colon, ":"):
                if self.op(a, "["):
                    self.expressions(a + 1, self.past(a, b), parent)
                a = colon + 1
            equals = self.until(a, ("=",), b)
            out += self.bindings(a, equals, parent)
            if equals < b:
                self.expressions(equals + 1, b, parent)
        return out

    def type_end(self, i: int, end: int) -> int:
        """Past the type that starts at i."""
        while i < end:
            while self.word(i) in ("typeof", "keyof", "readonly", "infer", "unique") and i + 1 < end:
                i += 1
            if self.op(i, "(") and i in self.match and self.op(self.match[i] + 1, "=>"):
                i = self.match[i] + 2
                continue
            if not (self.word(i) or self.kind[i] in ("string", "number") or i in self.match):
                return i
            i = self.match.get(i, i) + 1
            while self.op(i, ".") and self.word(i + 1):
                i += 2
            i = self.angle(i, end)
            while self.op(i, "[") and i in self.match:
                i = self.match[i] + 1
            if not (self.op(i, "|") or self.op(i, "&")):
                return min(i, end)
            i += 1
        return end

    def type_arguments(self, i: int, end: int) -> int:
        """Past type arguments at i that a call takes; i itself, if these are none but a comparison."""
        stop = self.closing.get(i, i) + 1
        return stop if i + 2 < stop < end and (self.op(stop, "(") or self._template(stop)) else i

    def _template(self, i: int) -> bool:
        return i < len(self.value) and self.kind[i] == "string" and self.value[i][:1] == b"`"

    def types(self, i: int, end: int, parent: int | None) -> None:
        for k in range(i, end):
            w = self.word(k)
            if w and w[0].isupper() and not self.op(k - 1, "."):
                self.add(k, k + 1, parent, "type_reference", name=w)

    def function(self, i: int, at: int, end: int, parent: int | None, **more) -> int:
        """A function whose parameter list opens at token `at`; i is its first token. Returns the token past it."""
        close = self.match.get(at, at)
        body = close + 1
        return_type = None
        if self.op(body, ":"):
            stop = body + 1
            while stop < end and not (self.op(stop, "{") and stop > body + 1) and not self.op(stop, "=>") and not self.op(stop, ";"):
                if self.op(stop, "{"):
                    stop = self.match.get(stop, stop)
                stop += 1
            return_type, body = self.text(body + 1, stop), stop
        arrow = self.op(body, "=>")
        body += arrow
        if self.op(body, "{"):
            stop = self.match.get(body, end - 1) + 1
        else:
            stop = self.statement_end(body, end) if arrow else body
        me = self.add(i, max(stop, close + 1), parent, "function", return_type=return_type, **more)
        self.nodes[me]["params"] = self.parameters(at, me)
        if return_type:
            self.types(close + 2, body - arrow, me)
        if self.op(body, "{"):
            self.block(body + 1, stop - 1, me)
        else:
            self.expressions(body, stop, me)
        return max(stop, close + 1)

    def decorators(self, i: int) -> tuple[int, list[str]]:
        out = []
        while self.op(i, "@"):
            j = i + 2
            while self.op(j, "."):
                j += 2
            if self.op(j, "("):
                j = self.past(j, len(self.value)) + 1
            out.append(self.text(i, min(j, len(self.value))))
            i = j
        return i, out

    def block(self, i: int, end: int, parent: int | None) -> None:
        end = min(end, len(self.value))
        while i < end:
            i = max(i + 1, self.statement(i, end, parent))

    def statement(self, i: int, end: int, parent: int | None) -> int:
        first, doc = i, self.doc[i]
        i, decorators = self.decorators(i)
        exported = i < end and self.word(i) == "export"
        if exported:
            i += 1 + (self.word(i + 1) == "default")
            default = self.word(i - 1) == "default"
            i, more = self.decorators(i)
            decorators += more
            doc = doc or (self.doc[i] if i < end else None)
            if default and self.op(i, "{"):
                self.expressions(i, self.past(i, end), parent)
                return self.past(i, end) + 1
            if self.op(i, "{") or self.op(i, "*"):
                stop = self.until(i, (";",), end) if self.op(i, "*") else self.match.get(i, i) + 1
                source = next((self.value[k].decode().strip("\"'`") for k in range(i, min(end, stop + 2)) if self.kind[k] == "string"), None)
                names = [self.word(a) for a, b in self.comma_list(i + 1, self.past(i, end))] if self.op(i, "{") else ["*"]
                stop = min(end, stop + 2 * (source is not None and self.op(i, "{")))
                self.add(first, stop, parent, "import" if source else "export", module_path=source, imported_names=names if source else None, metadata=None if source else {"exported_names": ",".join(n or "" for n in names)})
                return stop
        modifiers = []
        while self.word(i) in {"declare", "abstract", "async"} and self.word(i + 1):
            modifiers.append(self.word(i))
            i += 1
        w = self.word(i)
        more = {"docstring": doc, "decorators": decorators, "modifiers": modifiers}
        if w in ("class", "interface", "enum") or (w == "const" and self.word(i + 1) == "enum"):
            return self.type_definition(first, i + (w == "const"), end, parent, more)
        if w == "type" and self.word(i + 1) and (self.op(i + 2, "=") or self.op(i + 2, "<")):
            equals = self.until(i + 2, ("=",), end)
            stop = self.until(equals, (";",), end)
            line = next((k for k in range(equals + 2, stop) if b"\n" in self.source[self.end[k - 1] : self.start[k]] and self.value[k] not in (b"|", b"&") and self.value[k - 1] not in (b"|", b"&", b"=")), stop)
            me = self.add(first, line, parent, "type-definition", kind="type_alias", name=self.word(i + 1), metadata={"aliased_type": self.text(equals + 1, line)}, **more)
            self.types(equals + 1, line, me)
            return line + 1
        if w == "function":
            star = self.op(i + 1, "*")
            name = self.word(i + 1 + star)
            at = self.angle(i + 1 + star + (name is not None), end)
            return self.function(first, at, end, parent, kind="function", name=name, is_async="async" in modifiers, is_generator=star, **more)
        if w in ("const", "let", "var"):
            return self.variables(first, i, end, parent, more)
        if w == "import" and not self.op(i + 1, "(") and not self.op(i + 1, "."):
            return self.imports(first, i, end, parent)
        if w in ("namespace", "module") and self.op(i + 2, "{"):
            self.block(i + 3, self.past(i + 2, end), parent)
            return self.past(i + 2, end) + 1
        if self.op(i, "{"):
            self.block(i + 1, self.past(i, end), parent)
            return self.past(i, end) + 1
        if w == "for" and self.word(i + 1) == "await":
            i += 1
        if w == "for" and self.op(i + 1, "(") and self.word(i + 2) in ("const", "let", "var") and self.until(i + 3, (";",), self.past(i + 1, end)) < self.past(i + 1, end):
            self.block(i + 2, self.past(i + 1, end), parent)
            return self.past(i + 1, end) + 1
        if (w in ("if", "for", "while", "switch", "catch", "with") or (w == "for" and self.word(i) == "await")) and self.op(i + 1, "("):
            self.expressions(i + 2, self.past(i + 1, end), parent)
            return self.past(i + 1, end) + 1
        if w in ("else", "try", "do", "finally", "return", "throw", "await", "case", "default", "yield"):
            return i + 1
        stop = max(i + 1, self.statement_end(i, end))
        self.expressions(i, stop, parent)
        return stop

    def imports(self, first: int, i: int, end: int, parent: int | None) -> int:
        stop = next((k for k in range(i, end) if self.kind[k] == "string"), end - 1) + 1
        names, alias, k = [], {}, i + 1 + (self.word(i + 1) == "type" and not self.op(i + 2, ","))
        if self.word(k) and self.word(k) != "from":
            names.append("default")
            alias["default"] = self.word(k)
        for b in range(k, stop):
            if self.op(b, "*") and self.word(b + 1) == "as":
                names.append("*")
                alias["*"] = self.word(b + 2)
            if self.op(b, "{"):
                for a, z in self.comma_list(b + 1, self.past(b, stop)):
                    a += self.word(a) == "type" and z - a > 1
                    names.append(self.word(a))
                    if self.word(a + 1) == "as":
                        alias[self.word(a)] = self.word(a + 2)
        self.add(first, stop, parent, "import", module_path=self.value[stop - 1].decode().strip("\"'`"), imported_names=names, alias=alias)
        return stop

    def variables(self, first: int, i: int, end: int, parent: int | None, more: dict) -> int:
        kind, later = "constant" if self.word(i) == "const" else "variable", False
        while True:
            i += 1
            start = i
            pattern = (self.op(i, "{") or self.op(i, "[")) and self.match.get(i, i) > i
            stop_name = self.past(i, end) + 1 if pattern else i + 1
            name = self.text(i, stop_name) if pattern else self.word(i)
            stop_name += self.op(stop_name, "!") and self.op(stop_name + 1, ":")
            equals = stop_name
            while equals < end and not self.op(equals, "=") and self.value[equals] not in (b",", b";") and self.word(equals) not in ("of", "in") and not (b"\n" in self.source[self.end[equals - 1] : self.start[equals]] and not self.op(equals, ":")):
                equals = self.match.get(equals, equals) + 1
            type_ = self.text(stop_name + 1, equals) if self.op(stop_name, ":") else None
            value_at = equals + 1
            at = self.arrow_at(value_at, end) if self.op(equals, "=") else None
            if name and at is not None and not pattern:
                flags = {self.word(k) for k in range(value_at, at)}
                stop = self.function(first, at, end, parent, kind="function", name=name, is_async="async" in flags, is_generator=any(self.op(k, "*") for k in range(value_at, at)), **more) if self.op(at, "(") else self.single_arrow(first, at, end, parent, name, flags, more)
            else:
                stop = self.statement_end(value_at, end) if self.op(equals, "=") else equals
                me = parent
                if name:
                    me = self.add(start if later else first, max(stop, i + 1), parent, "variable", kind=kind, name=name, data_type=type_, initial_value=self.text(value_at, stop) if self.op(equals, "=") else None, **more)
                    if pattern:
                        self.nodes[me]["metadata"] = {"bindings": ",".join(self.bindings(i, stop_name, me))}
                    if type_:
                        self.types(stop_name + 1, equals, me)
                    if self.op(equals, "=") and self.word(value_at) == "require" and self.op(value_at + 1, "(") and value_at + 2 < stop and self.kind[value_at + 2] == "string":
                        taken = self.renamed(i) if pattern else {}
                        call_end = self.past(value_at + 1, stop) + 1
                        self.add(value_at, call_end, me, "import", module_path=self.value[value_at + 2].decode("utf-8", "replace").strip("\"'`"), imported_names=list(taken), alias={k: v for k, v in taken.items() if k != v} if pattern else {"*": name})
                        value_at = call_end
                if self.op(equals, "="):
                    self.expressions(value_at, stop, me)
            if not self.op(stop, ",") or stop >= end:
                return max(stop, i + 1)
            i, later = stop, True

    def renamed(self, i: int) -> dict[str, str]:
        """Keys of an object pattern and the names that they get."""
        if not self.op(i, "{"):
            return {}
        parts = [(self.word(a), self.word(a + 2) if self.op(a + 1, ":") else self.word(a)) for a, _ in self.comma_list(i + 1, self.past(i, len(self.value)))]
        return {k: v for k, v in parts if k and v}

    def arrow_at(self, i: int, end: int) -> int | None:
        """Where a function expression's parameters start, if one starts at i."""
        if self.word(i) == "async" and (self.op(i + 1, "(") or self.word(i + 1)):
            i += 1
        if self.word(i) == "function":
            i += 1 + self.op(i + 1, "*")
            i += self.word(i) is not None
            i = self.angle(i, end)
            return i if self.op(i, "(") else None
        i = self.angle(i, end)
        if self.op(i, "(") and i in self.match:
            k = self.match[i] + 1
            if self.op(k, ":"):
                k = self.until(k, ("=>", ";", ","), end)
            return i if self.op(k, "=>") else None
        return i if self.word(i) and self.op(i + 1, "=>") else None

    def single_arrow(self, first: int, at: int, end: int, parent, name: str | None, flags: set, more: dict, kind: str = "function") -> int:
        body = at + 2
        stop = self.past(body, end) + 1 if self.op(body, "{") else self.statement_end(body, end)
        me = self.add(first, stop, parent, "function", kind=kind, name=name, is_async="async" in flags, is_generator=False, params=[{"name": self.word(at), "type": None, "value": None}], **more)
        self.add(at, at + 1, me, "variable", kind="parameter", name=self.word(at))
        self.block(body + 1, stop - 1, me) if self.op(body, "{") else self.expressions(body, stop, me)
        return stop

    def type_definition(self, first: int, i: int, end: int, parent: int | None, more: dict) -> int:
        kind, name = self.word(i), self.word(i + 1)
        if name in ("extends", "implements"):
            name, i = None, i - 1
        brace = i + 1
        while brace < end and not self.op(brace, "{"):
            brace += 1
        bases = []
        k = self.angle(i + 2, brace)
        while k < brace:
            if self.word(k) in ("extends", "implements"):
                stop = next((x for x in range(k + 1, brace) if self.word(x) in ("extends", "implements")), brace)
                bases += [self.text(a, b) for a, b in self.comma_list(k + 1, stop)]
                k = stop
            else:
                k += 1
        close = self.match.get(brace, end - 1)
        values = [self.word(a) or self.text(a, a + 1).strip("\"'") for a, _ in self.comma_list(brace + 1, close)] if kind == "enum" else None
        me = self.add(first, close + 1, parent, "type-definition", kind=kind, name=name, base_types=bases, enum_values=values, is_abstract="abstract" in more["modifiers"], **more)
        self.types(i + 2, brace, me)
        if kind == "class":
            self.members(brace + 1, close, me)
        elif kind == "interface":
            self.types(brace + 1, close, me)
        return close + 1

    def members(self, i: int, end: int, parent: int) -> None:
        while i < end:
            if self.op(i, ";"):
                i += 1
                continue
            first, doc = i, self.doc[i]
            i, decorators = self.decorators(i)
            modifiers = []
            while self.word(i) in _MODIFIERS and i + 1 < end and (self.kind[i + 1] in ("word", "string") or self.op(i + 1, "*") or self.op(i + 1, "[")):
                modifiers.append(self.word(i))
                i += 1
            star = self.op(i, "*")
            i += star
            name = self.word(i) or (self.value[i].decode("utf-8", "replace").strip("\"'") if i < end and self.kind[i] == "string" else None)
            if self.word(i) == "static" and self.op(i + 1, "{"):
                self.block(i + 2, self.past(i + 1, end), parent)
                i = self.past(i + 1, end) + 1
                continue
            computed = None
            if name is None:
                if not self.op(i, "[") or self.match.get(i, i) == i or self.op(i + 2, ":"):
                    i = max(i + 1, self.statement_end(self.match.get(i, i) + 1, end) if self.op(i, "[") else self.match.get(i, i) + 1)
                    continue
                computed, close = i, self.match[i]
                name, i = self.text(i, close + 1), close
            flags = {"visibility": next((m for m in modifiers if m in _VISIBILITY), "private" if (name or "").startswith("#") else None), "modifiers": modifiers, "decorators": decorators, "docstring": doc, "is_static": "static" in modifiers, "is_abstract": "abstract" in modifiers, "is_override": "override" in modifiers}
            at = self.angle(i + 1 + self.op(i + 1, "?"), end)
            if computed is not None:
                self.expressions(computed + 1, i, parent)
            if self.op(at, "("):
                i = self.function(first, at, end, parent, kind="constructor" if name == "constructor" else "method", name=name, is_async="async" in modifiers, is_generator=star, **flags)
                continue
            colon = i + 1 + (self.op(i + 1, "?") or self.op(i + 1, "!"))
            equals = self.until(colon, ("=", ";"), end) if self.op(colon, ":") else colon
            line = next((k for k in range(colon + 1, equals) if b"\n" in self.source[self.end[k - 1] : self.start[k]] and self.value[k - 1] not in (b":", b"|", b"&", b"<", b",")), equals) if self.op(colon, ":") else equals
            equals = min(equals, line)
            type_ = self.text(colon + 1, equals) if self.op(colon, ":") else None
            if self.op(equals, "=") and (arrow := self.arrow_at(equals + 1, end)) is not None and self.op(arrow, "("):
                words = {self.word(k) for k in range(equals + 1, arrow)}
                i = self.function(first, arrow, end, parent, kind="method", name=name, is_async="async" in words, is_generator=False, **flags)
                continue
            stop = self.statement_end(equals + 1, end) if self.op(equals, "=") else equals
            plain = {k: v for k, v in flags.items() if k not in ("is_abstract", "is_override")}
            me = self.add(first, max(stop, i + 1), parent, "variable", kind="field", name=name, data_type=type_, initial_value=self.text(equals + 1, stop) if self.op(equals, "=") else None, **plain)
            if type_:
                self.types(colon + 1, equals, me)
            if self.op(equals, "="):
                self.expressions(equals + 1, stop, me)
            i = max(stop, i + 1)

    def expressions(self, i: int, end: int, parent: int | None) -> None:
        """Calls, accesses, functions, methods and types inside an expression."""
        first, end = i, min(end, len(self.value))
        while i < end:
            w = self.word(i)
            at = self.arrow_at(i, end) if w in ("async", "function") or self.op(i, "(") or (self.op(i, "<") and (i == first or (self.kind[i - 1] == "op" and self.value[i - 1] not in (b")", b"]", b"}", b">")))) or (w and self.op(i + 1, "=>")) else None
            if at is not None and at < end:
                flags = {self.word(k) for k in range(i, at)}
                star = any(self.op(k, "*") for k in range(i, at))
                past = self.function(i, at, end, parent, kind="lambda", name=None, is_async="async" in flags, is_generator=star) if self.op(at, "(") else self.single_arrow(i, at, end, parent, None, flags, {}, "lambda")
                i = max(i + 1, past)
            elif w in ("as", "satisfies") and i > first and self.valued(i - 1):
                stop = self.type_end(i + 1, end)
                self.types(i + 1, stop, parent)
                i = max(i + 1, stop)
            elif w == "class":
                brace = self.until(i + 1, ("{",), end)
                self.members(brace + 1, self.past(brace, end), parent)
                i = max(i, self.past(brace, end)) + 1
            elif w and (w not in _NOT_CALLS) and not (w in ("super", "import") and not (self.op(i + 1, "(") or self.op(i + 1, "."))):
                i = self.chain(i, end, parent)
            elif self.op(i, "{") and i in self.match:
                inside = self.block if self.op(i - 1, "=>") or self.op(i - 1, ")") or self.word(i - 1) in ("else", "try", "finally", "do") else self.literal
                inside(i + 1, min(self.match[i], end), parent)
                i = self.links(i, self.match[i] + 1, end, parent, None)
            elif (self.op(i, "(") or self.op(i, "[")) and i in self.match:
                self.expressions(i + 1, min(self.match[i], end), parent)
                i = self.links(i, self.match[i] + 1, end, parent, None)
            elif self._template(i):
                stop = self.quoted(i, end) + 1
                self.expressions(i + 1, stop, parent)
                i = self.links(i, stop, end, parent, None)
            elif self.kind[i] == "string" and i + 1 < end and (self.op(i + 1, ".") or self.op(i + 1, "[")):
                i = self.links(i, i + 1, end, parent, None)
            else:
                i += 1

    def literal(self, i: int, end: int, parent: int | None) -> None:
        """The properties of an object literal; its methods are methods."""
        while i < end:
            stop = self.until(i, (",",), end)
            k, flags = i, []
            while self.word(k) in ("async", "get", "set") and k + 1 < stop and (self.kind[k + 1] in ("word", "string") or self.op(k + 1, "*") or self.op(k + 1, "[")):
                flags.append(self.word(k))
                k += 1
            star = self.op(k, "*")
            k += star
            if k < stop and (self.kind[k] in ("word", "string", "number") or (self.op(k, "[") and k in self.match)):
                close = self.match.get(k, k)
                at = self.angle(close + 1, stop)
                after = self.match.get(at, at) + 1
                if at < stop and self.op(at, "(") and (self.op(after, "{") or self.op(after, ":")) and self.word(k) != "function":
                    name = self.word(k) or (self.text(k, close + 1).strip("\"'") if k == close else self.text(k, close + 1))
                    self.function(i, at, stop, parent, kind="method", name=name, is_async="async" in flags, is_generator=star, modifiers=flags, docstring=self.doc[i])
                    i = stop + 1
                    continue
                if self.op(close + 1, ":"):
                    if k < close:
                        self.expressions(k + 1, close, parent)
                    i = close + 2
            self.expressions(i, stop, parent)
            i = stop + 1

    def chain(self, i: int, end: int, parent: int | None) -> int:
        """A name with the members, indexes and calls after it: a.b[c](x).d"""
        if self.word(i) == "new" and self.word(i + 1) and self.word(i + 1) not in _NOT_CALLS:
            return self.links(i, i + 2, end, parent, i + 1)
        return self.links(i, i + 1, end, parent, None)

    def links(self, first: int, i: int, end: int, parent: int | None, made: int | None) -> int:
        """What follows the value of tokens first to i. made is where the constructor's name starts, if `new` does.

        A call is named by its last member or index, and what is before that is its subject; without either its name is all
        that is called, if this is short enough to be one line.
        """
        name = subject = None  # spans of tokens of the last member or index, and of what it is taken from
        access = None
        begin = first if made is None else made

        def accessed(stop: int) -> None:
            if access is not None:
                self.add(begin, stop, parent, "attribute_access", name=self.text(*name), metadata={"subject": self.text(*subject)})

        while i < end:
            at = i + (self.op(i, "!") and (self.op(i + 1, ".") or self.op(i + 1, "?.") or self.op(i + 1, "[") or self.op(i + 1, "(")))
            at += self.op(at, "?.") and (self.op(at + 1, "[") or self.op(at + 1, "(") or self.op(at + 1, "<"))
            if self.kind[at] == "op" and b"\n" in self.source[self.end[i - 1] : self.start[i]] and self.op(at, "["):
                break
            args = self.type_arguments(at, end)
            if (self.op(at, ".") or self.op(at, "?.")) and self.word(at + 1):
                accessed(i)
                access, name, subject, i = at, (at + 1, at + 2), (begin, at), at + 2
            elif self.op(at, "[") and at in self.match and self.match[at] < end:
                accessed(i)
                access, name, subject, i = at, (at + 1, self.match[at]), (begin, i), self.match[at] + 1
                self.expressions(at + 1, self.match[at], parent)
            elif args < end and ((self.op(args, "(") and args in self.match) or (self._template(args) and self.start[args] == self.end[args - 1])):
                close = self.match[args] if self.op(args, "(") else self.quoted(args, end)
                callee = (begin, i)
                me = self.add(first, close + 1, parent, "call", name=self.text(*(name or callee)).split("\n")[0], subject=self.text(*subject) if name else None)
                if access is not None:
                    self.add(begin, i, me, "attribute_access", name=self.text(*name), metadata={"subject": self.text(*subject)})
                self.types(at, args, me)
                self.expressions(args + 1 if self.op(args, "(") else args, close, me)
                access = name = subject = made = None
                begin, i = first, close + 1
            else:
                break
        accessed(i)
        if made is not None:
            self.add(first, i, parent, "call", name=self.text(*(name or (begin, i))), subject=self.text(*subject) if name else None)
        return i

    def quoted(self, i: int, end: int) -> int:
        """The last token of the template that starts at i."""
        while i + 1 < end and self.op(i + 1, "${") and i + 1 in self.match:
            i = self.match[i + 1]
            i += i + 1 < end and self.kind[i + 1] == "string" and self.start[i + 1] == self.end[i]
        return i


def parse(source: bytes):
    scanner = _Scanner(source)
    scanner.block(0, len(scanner.value), None)
    return scanner.nodes, scanner.problems


parsing.register("javascript", parse)
parsing.register("typescript", parse)
