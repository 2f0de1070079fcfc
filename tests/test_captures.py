"""Captures by priority, handlers in their order, metadata, transparent nodes, and an adapter of one's own."""

from dataclasses import replace

import pytest

from fernweave.sources import captures

SOURCE = b'''import os
@cached
@app.route("/x", call(1))
class Box(Base, Generic[T]):
    def __init__(self, n):
        self.n = n

    async def load(self, q: str = "x") -> dict[str, int]:
        if q:
            return get(q.strip())

def outer():
    def inner():
        pass
    return inner
'''


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("a.py", bytearray(SOURCE)), ("b.py", bytearray(b"x = = 1\nok()\n")), ("c.js", bytearray(b"f()")), ("d.py", bytearray(b"")), ("e.py", None)], "file_path string, content binary")


@pytest.fixture(scope="module")
def tree(files):
    return captures.python_trees(files).cache()


def test_tree(tree):
    rows = tree.where("file_path = 'a.py'").orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(len(rows))) and rows[0].type == "Module" and rows[0].parent is None
    by = {r.ordinal: r for r in rows}
    for r in rows[1:]:
        p = by[r.parent]
        assert r.path == [*p.path, p.ordinal] and r.parent < r.ordinal
        assert p.start_byte <= r.start_byte or p.type == "ClassDef"  # a decorator stands before its class
    assert {SOURCE[r.start_byte : r.end_byte] for r in rows if r.type == "Name" and r.field == "decorator_list"} == {b"cached"}
    assert {r.file_path for r in tree.select("file_path").distinct().collect()} == {"a.py", "b.py", "d.py"}


def test_captures_come_by_priority(tree):
    got = {r.name: r.captures for r in captures.capture(tree, captures.PYTHON).where("type in ('FunctionDef', 'AsyncFunctionDef')").collect()}
    assert got == {"__init__": ["constructor", "method", "function"], "load": ["method", "function"], "outer": ["function"], "inner": ["function"]}
    turned = replace(captures.PYTHON, priorities={"function": 0})
    assert captures.capture(tree, turned).where("name = '__init__'").first().captures == ["function", "method", "constructor"]


def test_convert(tree, files):
    rows = captures.convert(tree, files, captures.PYTHON).where("file_path = 'a.py'").orderBy("ordinal").collect()
    by = {r.ordinal: r for r in rows}
    shown = [(r.node_type, r.capture, r.name, by[r.parent].name if r.parent is not None else None) for r in rows]
    assert shown == [
        ("import", "import", None, None),
        ("type-definition", "class", "Box", None),
        ("function", "constructor", "__init__", "Box"),
        ("variable", "parameter", "self", "__init__"),
        ("variable", "parameter", "n", "__init__"),
        ("attribute_access", "attribute_access", "n", "__init__"),
        ("function", "method", "load", "Box"),
        ("variable", "parameter", "self", "load"),
        ("variable", "parameter", "q", "load"),
        ("call", "call", None, "load"),
        ("call", "call", None, None),
        ("attribute_access", "attribute_access", "strip", None),
        ("function", "function", "outer", None),
        ("function", "function", "inner", "outer"),
    ]
    box = next(r for r in rows if r.name == "Box")
    # What is below metadata, as the call inside a decorator, is no node.
    assert box.attributes == {"decorators": ["cached", 'app.route("/x", call(1))'], "base_types": ["Base", "Generic[T]"]}
    assert next(r for r in rows if r.name == "load").attributes == {"return_type": ["dict[str, int]"]}


def test_handlers_go_in_their_order(tree, files):
    class Loud(captures.Handler):
        def takes(self, capture):
            return super().takes(capture) & ~capture.isin("method")

    own = captures.Adapter(patterns=captures.PYTHON.patterns, handlers=(Loud(("function", "method"), node_type="loud"), *captures.PYTHON.handlers))
    got = {r.name: (r.node_type, r.capture) for r in captures.convert(tree, files, own).where("capture in ('function', 'method', 'constructor')").collect()}
    assert got == {n: ("loud", "function") for n in ("__init__", "load", "outer", "inner")}
    none = captures.Adapter(patterns=captures.PYTHON.patterns[:3], handlers=(captures.Handler(("constructor",), node_type="function"),))
    assert [(r.name, r.parent) for r in captures.convert(tree, files, none).collect()] == [("__init__", None)]


def test_empty(spark, files):
    none = files.limit(0)
    assert not captures.convert(captures.python_trees(none), none, captures.PYTHON).collect()
