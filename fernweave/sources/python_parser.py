"""Python sources through the standard library's syntax tree."""

from __future__ import annotations

import ast
import re

from fernweave.sources import parsing


class _Walk:
    def __init__(self, source: bytes):
        self.source, self.nodes = source, []
        self.lines = [0, *(m.end() for m in re.finditer(b"\n", source))]

    def at(self, line: int, column: int) -> int:
        return self.lines[line - 1] + column

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)

    def text(self, node: ast.AST | None) -> str | None:
        if node is None:
            return None
        a, b = self.span(node)
        return self.source[a:b].decode("utf-8", "replace")

    def add(self, node: ast.AST, parent: int | None, type_: str, **more) -> int:
        a, b = self.span(node)
        self.nodes.append({"type": type_, "start": a, "end": b, "parent": parent, **more})
        return len(self.nodes) - 1

    def doc(self, body: list[ast.stmt]) -> str | None:
        first = body[0] if body else None
        return self.text(first.value) if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str) else None

    def params(self, a: ast.arguments) -> list[dict]:
        plain = [*a.posonlyargs, *a.args]
        defaults = [None] * (len(plain) - len(a.defaults)) + a.defaults
        rows = [*zip(plain, defaults, strict=True), *([(a.vararg, None)] if a.vararg else []), *zip(a.kwonlyargs, a.kw_defaults, strict=True), *([(a.kwarg, None)] if a.kwarg else [])]
        return [(p, d) for p, d in rows]

    def visit(self, node: ast.AST, parent: int | None, in_class: bool) -> None:
        if isinstance(node, ast.ClassDef):
            bases = [self.text(b) for b in node.bases]
            me = self.add(node, parent, "type-definition", kind="class", name=node.name, base_types=bases, decorators=["@" + self.text(d) for d in node.decorator_list], docstring=self.doc(node.body), is_abstract=False)
            for child in (*node.decorator_list, *node.bases, *(k.value for k in node.keywords)):
                self.visit(child, me, False)
            for child in node.body:
                self.visit(child, me, True)
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda):
            self.function(node, parent, in_class)
        elif isinstance(node, ast.Import | ast.ImportFrom):
            module = None if isinstance(node, ast.Import) else "." * node.level + (node.module or "")
            for name in node.names if module is None else [None]:
                names = [name] if name else node.names
                self.add(node, parent, "import", module_path=name.name if name else module, imported_names=[] if name else [n.name for n in names], alias={n.name: n.asname for n in names if n.asname})
        elif isinstance(node, ast.Call):
            f = node.func
            me = self.add(node, parent, "call", name=f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None, subject=self.text(f.value) if isinstance(f, ast.Attribute) else None)
            if not isinstance(f, ast.Name):
                self.visit(f, me, False)
            for child in (*node.args, *(k.value for k in node.keywords)):
                self.visit(child, me, False)
        elif isinstance(node, ast.Attribute):
            me = self.add(node, parent, "attribute_access", name=node.attr, metadata={"subject": self.text(node.value)})
            self.visit(node.value, me, False)
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            if len(targets) == 1 and isinstance(targets[0], ast.Name):
                name, note = targets[0].id, getattr(node, "annotation", None)
                kind = "field" if in_class else "constant" if name.isupper() else "variable"
                me = self.add(node, parent, "variable", kind=kind, name=name, data_type=self.text(note), initial_value=self.text(node.value))
                self.annotation(note, me)
            else:
                me = parent
                for t in targets:
                    self.visit(t, me, False)
            if node.value is not None:
                self.visit(node.value, me, False)
        else:
            for child in ast.iter_child_nodes(node):
                self.visit(child, parent, in_class and isinstance(node, ast.If | ast.Try | ast.With))

    def annotation(self, note: ast.AST | None, parent: int) -> None:
        if isinstance(note, ast.Name):
            self.add(note, parent, "type_reference", name=note.id)
        elif note is not None:
            for child in ast.iter_child_nodes(note):
                self.annotation(child, parent)

    def function(self, node, parent: int | None, in_class: bool) -> None:
        params = self.params(node.args)
        plain = [{"name": p.arg, "type": self.text(p.annotation), "value": self.text(d)} for p, d in params]
        if isinstance(node, ast.Lambda):
            me = self.add(node, parent, "function", kind="lambda", params=plain, is_async=False, is_generator=False)
        else:
            own = [x for s in node.body for x in _own(s)]
            decorators = [self.text(d) for d in node.decorator_list]
            kind = ("constructor" if node.name == "__init__" else "method") if in_class else "function"
            me = self.add(node, parent, "function", kind=kind, name=node.name, params=plain, return_type=self.text(node.returns), docstring=self.doc(node.body), decorators=["@" + d for d in decorators], is_async=isinstance(node, ast.AsyncFunctionDef), is_generator=any(isinstance(x, ast.Yield | ast.YieldFrom) for x in own), is_static="staticmethod" in decorators, is_abstract=any(d.rpartition(".")[2] == "abstractmethod" for d in decorators), is_override=any(d.rpartition(".")[2] == "override" for d in decorators))
            for d in node.decorator_list:
                self.visit(d, me, False)
        for (p, d), row in zip(params, plain, strict=True):
            at = self.add(p, me, "variable", kind="parameter", name=p.arg, data_type=row["type"], initial_value=row["value"])
            self.annotation(p.annotation, at)
            if d is not None:
                self.visit(d, at, False)
        self.annotation(getattr(node, "returns", None), me)
        for child in node.body if isinstance(node.body, list) else [node.body]:
            self.visit(child, me, False)


def _own(node: ast.AST):
    """Everything below a statement but what nested functions hold."""
    yield node
    if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda | ast.ClassDef):
        for child in ast.iter_child_nodes(node):
            yield from _own(child)


#: Problems of a file that are told one by one; what follows the last of so many is one more.
_PROBLEMS = 100
_GOES_ON = re.compile(rb"[ \t\r)\]}#]|(?:else|elif|except|finally)\b|$")


def _without(lines: list[bytes], first: int, last: int) -> list[bytes]:
    return [*lines[:first], *(b" " * len(x) for x in lines[first:last]), *lines[last:]]


def _statement(lines: list[bytes], line: int) -> tuple[int, int]:
    """The lines of the top-level statement around a line."""
    first = next((i for i in range(line, -1, -1) if not _GOES_ON.match(lines[i])), 0)
    last = next((i for i in range(line + 1, len(lines)) if not _GOES_ON.match(lines[i])), len(lines))
    return first, last


def recovered(text: bytes) -> tuple[ast.Module, list[tuple[str, str, int, int]]]:
    """The tree of text without what does not parse, and the problems. Places stay: what is taken out becomes blanks.

    A line at which parsing fails becomes `pass`, or a bare block's head, if then other lines are all right, so the rest of
    its block stays; else its whole top-level statement goes.
    """
    lines, problems = text.split(b"\n"), []
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)

    tree = None

    def failure(of: list[bytes]) -> tuple[int, str] | None:
        nonlocal tree
        try:
            tree = ast.parse(b"\n".join(of))
        except (SyntaxError, ValueError) as error:
            return min(max(1, getattr(error, "lineno", None) or 1), len(lines)) - 1, str(getattr(error, "msg", error))
        return None

    while (failed := failure(lines)) is not None:
        line, message = failed
        own = lines[line]
        indent = len(own) - len(own.lstrip())
        first, last = line, line + 1
        for plain in (b"if 1:", b"pass") if own.rstrip().endswith(b":") else (b"pass",):
            tried = [*lines[:line], (b" " * indent + plain).ljust(len(own)), *lines[line + 1 :]]
            if len(problems) < _PROBLEMS and own.strip() and len(own) == len(tried[line]) and own != tried[line]:
                after = failure(tried)
                # A line that only now fails, right below, is one that the change has broken.
                if after is None or after[0] not in (line, line + 1):
                    lines = tried
                    break
        else:
            first, last = _statement(lines, line) if len(problems) < _PROBLEMS else (line, len(lines))
            if not b"".join(lines[first:last]).strip():
                # Nothing is left around the line: what is wrong is before it.
                first, last = 0, len(lines)
            lines = _without(lines, first, last)
            while last > first + 1 and not text[starts[last - 1] : starts[last]].strip():
                last -= 1
        problems.append(("syntax_error", message, starts[first], min(len(text), starts[last] - 1)))
    problems.sort(key=lambda p: p[2:])
    return tree, problems


def parse(source: bytes):
    """The nodes of what parses, and the problems of what does not."""
    tree, problems = recovered(source.replace(b"\0", b" "))
    walk = _Walk(source)
    for child in tree.body:
        walk.visit(child, None, False)
    return walk.nodes, problems


parsing.register("python", parse)
