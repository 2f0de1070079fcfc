"""Syntax trees to nodes by patterns: captures for each tree node, in order of priority, and handlers that make of them what they are.

A tree is a table: file_path, ordinal (pre-order), parent, path (the ordinals above), field, place, type, name, start_byte,
end_byte. Patterns and handlers are columns over it, so matching is one projection of Spark's, whatever their number.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from fernweave.session import dealt, written
from fernweave.sources.python_parser import _Walk, recovered

TREE = "ordinal int, parent int, path array<int>, field string, place int, type string, name string, start_byte bigint, end_byte bigint"

#: Of captures that meet on one node, a constructor comes first, a method next, all others after.
PRIORITIES = {"constructor": 1, "method": 2}
DEFAULT_PRIORITY = 100


#: What the captures of an adapter are, as their readers ask: a capture may be of several kinds.
CATEGORIES = {
    "definition": ("class", "function", "method", "constructor", "parameter", "variable"),
    "type_definition": ("class",),
    "variable_like": ("parameter", "variable"),
    "function_like": ("function", "method", "constructor"),
    "dependency": ("import",),
    "reference": ("call", "attribute_access"),
    "metadata": ("decorator", "base_type", "return_type"),
}


def is_of(capture: Column, category: str) -> Column:
    """Whether a capture is of a category; false for null."""
    return F.coalesce(capture.isin(*CATEGORIES[category]), F.lit(False))


@udtf(returnType=TREE)
class PythonTree:
    """The tree of one Python source (bytes), a row for each node that has a place; what does not parse is left out."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is None:
            return
        walk = _Walk(bytes(content))
        tree, _ = recovered(walk.source.replace(b"\0", b" "))
        # An explicit stack: depth is the source's.
        stack, n = [(tree, None, (), None, 0)], 0
        while stack:
            node, parent, path, name_of_field, place = stack.pop()
            placed = hasattr(node, "lineno")
            start, end = walk.span(node) if placed else (0, len(walk.source))
            name = next((getattr(node, a) for a in ("name", "id", "attr", "arg") if isinstance(getattr(node, a, None), str)), None)
            if placed or parent is None:
                me, n = n, n + 1
                yield me, parent, list(path), name_of_field, place, type(node).__name__, name, start, end
                parent, path = me, (*path, me)
            children = []
            for own_field, value in ast.iter_fields(node):
                items = value if isinstance(value, list) else [value]
                children += [(c, parent, path, own_field if placed or isinstance(node, ast.Module) else name_of_field, i) for i, c in enumerate(items) if isinstance(c, ast.AST)]
            stack.extend(reversed(children))


def python_trees(files: DataFrame) -> DataFrame:
    """The trees of files (file_path, content) in Python."""
    sources = dealt(files.where(F.endswith("file_path", F.lit(".py"))).select("file_path", "content"), "file_path")
    return sources.lateralJoin(PythonTree(F.col("content").outer())).drop("content")


@dataclass(frozen=True)
class Pattern:
    """What a tree node must be to get a capture: its type, and optionally its field, its parent's type, and any condition."""

    capture: str
    types: tuple[str, ...]
    fields: tuple[str, ...] = ()
    parents: tuple[str, ...] = ()
    #: A condition over the tree's columns, parent_type and parent_name.
    where: str = "true"

    def test(self) -> Column:
        found = F.col("type").isin(*self.types) & F.expr(self.where)
        if self.fields:
            found &= F.col("field").isin(*self.fields)
        if self.parents:
            found &= F.col("parent_type").isin(*self.parents)
        return F.coalesce(found, F.lit(False))


@dataclass(frozen=True)
class Handler:
    """What becomes of a node with one of these captures: a node of its own (node_type), or metadata of the node around it.

    A node without a handler is transparent. What is below metadata is not looked at. Subclasses may override any part.
    """

    captures: tuple[str, ...]
    node_type: str | None = None
    attribute: str | None = None
    where: str = "true"

    def takes(self, capture: Column) -> Column:
        return capture.isin(*self.captures) & F.expr(self.where)


@dataclass(frozen=True)
class Adapter:
    """A language's patterns and handlers, and priorities of captures that differ from the default."""

    patterns: Sequence[Pattern]
    handlers: Sequence[Handler]
    priorities: dict[str, int] = field(default_factory=lambda: dict(PRIORITIES))

    def priority(self, capture: str) -> int:
        return self.priorities.get(capture, DEFAULT_PRIORITY)


def capture(tree: DataFrame, adapter: Adapter) -> DataFrame:
    """tree with captures: those of the patterns that fit, by priority; those of one priority in the order of the patterns."""
    parents = tree.select("file_path", F.col("ordinal").alias("parent"), F.col("type").alias("parent_type"), F.col("name").alias("parent_name"))
    rows = tree.join(parents, ["file_path", "parent"], "left")
    found = [F.when(p.test(), F.struct(F.lit(adapter.priority(p.capture)).alias("priority"), F.lit(i).alias("at"), F.lit(p.capture).alias("capture"))) for i, p in enumerate(adapter.patterns)]
    ordered = F.array_sort(F.array_compact(F.array(*found)))
    return rows.withColumn("captures", F.array_distinct(F.transform(ordered, lambda x: x["capture"])))


def handled(captured: DataFrame, adapter: Adapter) -> DataFrame:
    """captured with capture, node_type and attribute: by the first handler, and of its captures the first, that takes the node."""
    hits = [F.get(F.filter("captures", h.takes), F.lit(0)) for h in adapter.handlers]
    chosen = [F.when(hit.isNotNull(), F.struct(hit.alias("capture"), F.lit(h.node_type).cast("string").alias("node_type"), F.lit(h.attribute).cast("string").alias("attribute"))) for h, hit in zip(adapter.handlers, hits, strict=True)]
    return captured.withColumn("chosen", F.coalesce(*chosen)).select("*", "chosen.*").drop("chosen")


def convert(tree: DataFrame, files: DataFrame, adapter: Adapter) -> DataFrame:
    """file_path, ordinal, parent, node_type, capture, name, start_byte, end_byte, attributes of the nodes that handlers make.

    parent is the nearest node above that is one too. attributes maps each kind of metadata to the texts of its places, in
    order, from files (file_path, content). Each tree row meets the few above it: the work grows with rows times depth.
    The trees, and of them what is captured, are written: each source is parsed once.
    """
    rows = handled(capture(written(tree, "trees"), adapter), adapter)
    told = written(rows.where(F.col("capture").isNotNull()).select("file_path", "ordinal", "path", "start_byte", "end_byte", "name", "capture", "node_type", "attribute"), "captured")
    marks = told.select("file_path", F.col("ordinal").alias("above"), F.col("node_type").isNotNull().alias("is_node"))
    around = told.select("file_path", "ordinal", F.explode("path").alias("above")).join(marks, ["file_path", "above"])
    around = around.groupBy("file_path", "ordinal").agg(F.max(F.when(F.col("is_node"), F.col("above"))).alias("owner"), F.bool_or(~F.col("is_node")).alias("hidden"))
    shown = told.join(around, ["file_path", "ordinal"], "left").where(~F.coalesce("hidden", F.lit(False)))
    text = F.substring(F.col("content"), (F.col("start_byte") + 1).cast("int"), (F.col("end_byte") - F.col("start_byte")).cast("int")).cast("string")
    notes = shown.where(F.col("attribute").isNotNull()).join(files.select("file_path", F.col("content")), "file_path").select("file_path", "owner", "attribute", "ordinal", text.alias("text"))
    notes = notes.groupBy("file_path", "owner", "attribute").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]).alias("texts"))
    notes = notes.groupBy("file_path", F.col("owner").alias("ordinal")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", "texts")))).alias("attributes"))
    nodes = shown.where(F.col("node_type").isNotNull())
    return nodes.join(notes, ["file_path", "ordinal"], "left").select("file_path", "ordinal", F.col("owner").alias("parent"), "node_type", "capture", "name", "start_byte", "end_byte", "attributes")


_FUNCTIONS = ("FunctionDef", "AsyncFunctionDef")
#: Python's definitions, references and dependencies, with what belongs to them.
PYTHON = Adapter(
    patterns=(
        Pattern("function", _FUNCTIONS),
        Pattern("method", _FUNCTIONS, ("body",), ("ClassDef",)),
        Pattern("constructor", _FUNCTIONS, ("body",), ("ClassDef",), "name = '__init__'"),
        Pattern("class", ("ClassDef",)),
        Pattern("decorator", ("Name", "Attribute", "Call"), ("decorator_list",)),
        Pattern("base_type", ("Name", "Attribute", "Subscript", "Call"), ("bases",), ("ClassDef",)),
        Pattern("return_type", ("Name", "Attribute", "Subscript", "Constant", "BinOp"), ("returns",), _FUNCTIONS),
        Pattern("parameter", ("arg",)),
        Pattern("call", ("Call",)),
        Pattern("attribute_access", ("Attribute",)),
        Pattern("import", ("Import", "ImportFrom")),
    ),
    handlers=(
        Handler(("decorator",), attribute="decorators"),
        Handler(("base_type",), attribute="base_types"),
        Handler(("return_type",), attribute="return_type"),
        Handler(("constructor", "method", "function"), node_type="function"),
        Handler(("class",), node_type="type-definition"),
        Handler(("parameter",), node_type="variable"),
        Handler(("call",), node_type="call"),
        Handler(("attribute_access",), node_type="attribute_access"),
        Handler(("import",), node_type="import"),
    ),
)
