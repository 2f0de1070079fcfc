"""Chunks of source files: bounded spans along the syntax tree that cover every byte once.

The split is sequential inside a file and independent between files, so files are dealt out by path and each is one
call; a file's size is bounded by the scan. Coverage checks are plain relational plans.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.functions.measures import Measure, furthest, measure_of
from fernweave.functions.text import decode, word_size
from fernweave.schemas import CHUNKS
from fernweave.session import written

_WORDS = re.compile(r"\S+")
_FRAME_BYTES, _FRAME_ROWS = 4_000_000, 10_000


@dataclass(frozen=True)
class ChunkOptions:
    max_size: int = 500
    unit: str = "byte"
    merge: bool = True

    #: A registered measure; what it is goes along to the workers.
    measure: Measure = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        if self.max_size <= 0:
            raise ValueError("max_size must be greater than zero")
        object.__setattr__(self, "measure", measure_of(self.unit))


@dataclass
class Node:
    """A syntax node as the splitter needs it."""

    start: int
    end: int
    name: str | None = None
    kind: str | None = None
    children: list[Node] = field(default_factory=list)


Span = tuple[int, int, Node | None]


def split_plain(source: bytes, start: int, end: int, options: ChunkOptions, node: Node | None = None) -> list[Span]:
    """Spans of at most max_size; they end after a line if one fits, else after a blank, else where they must.

    Never inside a UTF-8 character, unless one alone is over the limit. Each step looks as far as one span reaches.
    """
    limits = _Limits(source, start, end, options)
    cuts = [start]
    while (reach := limits.furthest(cuts[-1])) < end:
        cuts.append(_break_before(source, cuts[-1], reach))
    if cuts[-1] < end:
        cuts.append(end)
    return [(a, b, node) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class _Limits:
    """How far a span from any place may reach."""

    def __init__(self, source: bytes, start: int, end: int, options: ChunkOptions):
        self.source, self.end, self.options = source, end, options
        self.starts: list[int] = []
        if options.unit == "word":
            # Where each word starts, in bytes: text before a word that is one too many still fits.
            text = source[start:end].decode("utf-8", "surrogateescape")
            at = place = 0
            for m in _WORDS.finditer(text):
                place += len(text[at : m.start()].encode("utf-8", "surrogateescape"))
                at = m.start()
                self.starts.append(start + place)

    def furthest(self, at: int) -> int:
        if self.options.unit == "byte":
            return min(self.end, at + self.options.max_size)
        if self.options.unit != "word":
            # One character at least, even if it alone is over the limit.
            return max(at + 1, furthest(self.options.measure, self.source, at, self.end, self.options.max_size))
        # A cut inside a word leaves its rest as a word of its own, which starts where the cut is.
        later = bisect_right(self.starts, at)
        inside = self.options.max_size if later < 1 or self.starts[later - 1] != at else self.options.max_size - 1
        n = later + inside
        return self.starts[n] if n < len(self.starts) else self.end


def _break_before(source: bytes, at: int, reach: int) -> int:
    """The best place to end a span that starts at `at` and may go to reach."""
    for marks in (b"\n", b"\t\r "):
        found = max(source.rfind(bytes([m]), at, reach) for m in marks)
        if found >= 0:
            return found + 1
    stop = reach
    while stop > at and stop < len(source) and source[stop] & 0xC0 == 0x80:
        stop -= 1
    return stop if stop > at else reach


def _parts(node: Node, source: bytes, start: int, end: int) -> list[Span]:
    """A span as its node's children and the gaps between them; a child takes the indent before it along.

    Of children that overlap the one that starts first stays, the shorter of two at one place; those that are empty or
    stand out of the span are left to the gaps.
    """
    inner = sorted((c for c in node.children if start <= c.start < c.end <= end), key=lambda c: (c.start, c.end))
    kept, free = [], start
    for child in inner:
        if child.start >= free:
            kept.append(child)
            free = child.end
    edges = [start, *(c.end for c in kept)]
    heads = [_with_indent(source, floor, c.start) for floor, c in zip(edges, kept, strict=False)]
    spans = [(a, b, None) for a, b in zip(edges, [*heads, end], strict=True) if a < b]
    return sorted([*spans, *((h, c.end, c) for h, c in zip(heads, kept, strict=True))], key=lambda s: s[0])


def _with_indent(source: bytes, floor: int, at: int) -> int:
    """Where a line's indent before `at` starts, if nothing else is before it on its line."""
    line = max(source.rfind(b"\n", floor, at), source.rfind(b"\r", floor, at)) + 1
    first = max(line, floor)
    return first if not source[first:at].strip(b" \t") else at


def split_tree(root: Node, source: bytes, options: ChunkOptions) -> list[Span]:
    """The spans of a file. A node over the limit is its parts, merged again as far as they fit. Trees of any depth."""
    done: list[list[Span]] = [[]]
    # Work still to do: a span to split, or (None) the parts of a node that are ready to be merged.
    todo: list[tuple[Node | None, int, int, Node | None]] = [(root, 0, len(source), None)]
    while todo:
        node, start, end, parent = todo.pop()
        if parent is not None:
            own = done.pop()
            done[-1] += merge(own, source, parent, options) if options.merge else own
        elif start < end:
            parts = None
            if node is not None and options.measure(source[start:end]) > options.max_size:
                parts = _parts(node, source, start, end)
            if parts is None:
                done[-1] += [(start, end, node)] if node is not None else split_plain(source, start, end, options)
            elif all(p[2] is None for p in parts):
                done[-1] += split_plain(source, start, end, options, node)
            else:
                done.append([])
                todo.append((None, 0, 0, node))
                todo += [(child, a, b, None) for a, b, child in reversed(parts)]
    return done[0]


def merge(spans: list[Span], source: bytes, parent: Node, options: ChunkOptions) -> list[Span]:
    """Greedy: a span joins the one before while both fit. Spans of two nodes become their parent's."""
    out: list[Span] = []
    for a, b, node in spans:
        if out and out[-1][1] == a and options.measure(source[out[-1][0] : b]) <= options.max_size:
            first, _, left = out[-1]
            out[-1] = (first, b, node if left is None else left if node is None or left is node else parent)
        else:
            out.append((a, b, node))
    return out


def build_tree(rows: list[dict]) -> Node:
    """rows (id, parent_id, start_byte, end_byte, name, kind); the one without a parent in them is the root."""
    nodes = {r["id"]: Node(int(r["start_byte"]), int(r["end_byte"]), r["name"], r["kind"]) for r in rows}
    root = None
    for r in rows:
        if r["parent_id"] in nodes:
            nodes[r["parent_id"]].children.append(nodes[r["id"]])
        else:
            root = nodes[r["id"]]
    return root or Node(0, 0)


def chunk_files(files: DataFrame, nodes: DataFrame | None = None, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Chunks of files (file_path, language, parser_name, content) along nodes (file_path, id, parent_id, ...), if given.

    An empty or null file has none.
    """
    rows = files.select("file_path", "language", "parser_name", F.coalesce("content", F.lit(b"")).alias("content"))
    if nodes is not None:
        trees = nodes.groupBy("file_path").agg(F.collect_list(F.struct("id", "parent_id", "start_byte", "end_byte", "name", F.coalesce("kind", "node_type").alias("kind"))).alias("nodes"))
        rows = rows.join(trees, "file_path", "left")
    else:
        rows = rows.withColumn("nodes", F.lit(None).cast("array<struct<id:string,parent_id:string,start_byte:bigint,end_byte:bigint,name:string,kind:string>>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        for batch in batches:
            out, held = [], 0
            for file in batch.itertuples(index=False):
                # A frame is bounded by bytes and by rows, not by the files that come at once.
                if held > _FRAME_BYTES or len(out) > _FRAME_ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
                source = bytes(file.content)
                held += len(source)
                root = build_tree([x if isinstance(x, dict) else x.asDict() for x in file.nodes]) if file.nodes is not None and len(file.nodes) else Node(0, len(source))
                root.start, root.end, root.kind, root.name = 0, len(source), None, None
                for i, (a, b, node) in enumerate(split_tree(root, source, options)):
                    symbol = (None, None) if node is None or node is root else (node.name, node.kind)
                    out.append((file.file_path, i, file.language, file.parser_name, a, b, options.measure(source[a:b]), source[a:b].decode("utf-8", "replace"), *symbol))
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, CHUNKS)


def mismatches(files: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """file_path, problem of files (file_path, parsed_path, content, content_hash, source_size_bytes) that must not be chunked."""
    tests = {
        "no content": F.col("content").isNull(),
        "path mismatch": ~F.col("file_path").eqNullSafe(F.col("parsed_path")),
        "size mismatch": ~F.col("source_size_bytes").eqNullSafe(F.octet_length("content").cast("bigint")),
        "hash mismatch": ~F.col("content_hash").eqNullSafe(F.sha2("content", 256)),
    }
    return files.select("file_path", F.explode(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))).alias("problem"))


def chunk_batch(changes: DataFrame, files: DataFrame, nodes: DataFrame | None = None, options: ChunkOptions = ChunkOptions()) -> dict[str, DataFrame]:
    """chunks of the added and modified files, and what goes along: unchanged and deleted paths, and the current snapshot.

    changes: as snapshot.diff() gives. files (file_path, content, ...): chunking a file whose content has another hash than
    its change says raises, and so does a changed file without content.
    """
    new = changes.where(F.col("change").isin("added", "modified")).select(F.col("relative_path").alias("file_path"), "current_hash")
    own = new.join(files, "file_path", "left")
    wrong = F.raise_error(F.concat(F.lit("content does not match its hash: "), "file_path")).cast("binary")
    own = own.withColumn("content", F.when(F.sha2("content", 256) == F.col("current_hash"), F.col("content")).otherwise(wrong)).drop("current_hash")
    paths_of = lambda change: changes.where(F.col("change") == change).select("relative_path")
    current = changes.where(F.col("current_hash").isNotNull()).select("relative_path", F.col("current_hash").alias("content_hash"))
    return {"chunks": chunk_files(own, nodes, options), "unchanged": paths_of("unchanged"), "deleted": paths_of("deleted"), "current": current}


def _measured(unit: str):
    """Sizes by a registered measure, a batch of texts at a time."""
    measure = measure_of(unit)

    @F.pandas_udf("bigint")
    def size(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: measure(t.encode()), na_action="ignore")

    return size


def chunk_parsed(files: DataFrame, results: DataFrame, nodes: DataFrame, options: ChunkOptions = ChunkOptions(), verify: bool = True) -> DataFrame:
    """Chunks of files (file_path, content, language, parser_name) that were parsed (results: file_path, source_size_bytes;
    nodes with a container as root of each).

    A file whose content is not as long as its result says, or that has no root that holds all of it, raises; with verify
    also one whose chunks do not cover every byte once.
    """
    roots = nodes.where("depth = 0 and node_type = 'container'").groupBy("file_path").agg(F.max(F.struct("end_byte", "start_byte")).alias("root"))
    known = files.join(results.select("file_path", F.col("source_size_bytes").alias("__said"), F.lit(True).alias("__parsed")), "file_path", "left").join(roots, "file_path", "left")
    length = F.octet_length("content").cast("bigint")
    problem = (
        F.when(F.col("__parsed").isNull() | F.col("content").isNull(), "not parsed: ")
        .when(~length.eqNullSafe(F.col("__said")), "content and parse result differ in length: ")
        .when(F.col("root").isNull(), "no root container: ")
        .when((F.col("root.start_byte") != 0) | (F.col("root.end_byte") != length), "the root does not hold the whole file: ")
    )
    checked = known.withColumn("content", F.when(problem.isNull(), F.col("content")).otherwise(F.raise_error(F.concat(problem, "file_path")).cast("binary"))).drop("__said", "__parsed", "root")
    chunks = chunk_files(checked, nodes, options)
    if not verify:
        return chunks
    # Looked at twice, made once; what was wrong with a file has raised by then.
    chunks = written(chunks, "chunks")
    exact = coverage(chunks, files, options.max_size, options.unit).select("file_path", "is_exact", "issues")
    inexact = F.raise_error(F.concat(F.lit("inexact coverage of "), "file_path", F.lit(": "), F.array_join("issues", ", "))).cast("string")
    # A character that alone is over the limit is no gap: only what is missing, doubled or wrong counts.
    wrong = F.size(F.array_except("issues", F.array(F.lit("exceeds max"), F.lit("content mismatch")))) > 0
    return chunks.join(exact, "file_path").withColumn("content", F.when(wrong, inexact).otherwise(F.col("content"))).select(*chunks.columns)


def coverage(chunks: DataFrame, files: DataFrame, max_size: int, unit: str = "byte") -> DataFrame:
    """file_path, total, covered, missing and overlap bytes, issues and is_exact, by windows over each file's chunks.

    A file's chunks become one row before they meet its source, which so is never copied to each.
    """
    order = Window.partitionBy("file_path").orderBy("chunk_index")
    source = files.select("file_path", F.col("content").alias("source"), F.octet_length("content").cast("bigint").alias("total_bytes"))
    size = F.octet_length("content").cast("bigint") if unit == "byte" else word_size(F.col("content")).cast("bigint") if unit == "word" else _measured(unit)("content")
    own = chunks.select("file_path", "chunk_index", F.col("start_byte").cast("bigint").alias("a"), F.col("end_byte").cast("bigint").alias("b"), "content", (F.col("size") != size).alias("other_size"), (F.col("size") > max_size).alias("large"))
    cursor = F.coalesce(F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.select("file_path", "a", "b", "content", "other_size", "large", cursor.alias("cursor"), (F.col("chunk_index") != F.row_number().over(order) - 1).alias("misplaced"), (F.col("a") < F.lag("a").over(order)).alias("unordered"))
    per = own.groupBy("file_path").agg(F.collect_list(F.struct("a", "b", "content", "other_size", "large", "cursor", "misplaced", "unordered")).alias("chunks"))
    both = source.join(per, "file_path", "left")
    n = F.col("total_bytes")

    def judged(c: Column) -> Column:
        at = F.least(c["cursor"], n)
        valid = (c["a"] >= 0) & (c["b"] > c["a"]) & (c["b"] <= n)
        gap = F.when(valid, F.greatest(c["a"] - at, F.lit(0))).otherwise(F.lit(0))
        overlap = F.when(valid, F.greatest(F.least(at, c["b"]) - c["a"], F.lit(0))).otherwise(F.lit(0))
        part = decode(F.substr("source", (c["a"] + 1).cast("int"), F.greatest(c["b"] - c["a"], F.lit(0)).cast("int")))
        tests = {
            "index mismatch": c["misplaced"],
            "unordered": c["unordered"],
            "invalid range": ~valid,
            "gap": gap > 0,
            "overlap": overlap > 0,
            "content mismatch": valid & (c["content"] != part),
            "size mismatch": c["other_size"],
            "exceeds max": c["large"],
        }
        issues = F.array_compact(F.array(*(F.when(t, F.lit(name)) for name, t in tests.items())))
        return F.struct(gap.cast("bigint").alias("gap"), overlap.cast("bigint").alias("overlap"), c["b"].alias("last"), issues.alias("issues"))

    told = both.select("file_path", "total_bytes", F.transform("chunks", judged).alias("told"))
    total = lambda name: F.coalesce(F.aggregate("told", F.lit(0).cast("bigint"), lambda x, c: x + c[name]), F.lit(0))
    last = F.array_max(F.transform("told", lambda c: c["last"]))
    tail = F.greatest(n - F.coalesce(last, F.lit(0)), F.lit(0))
    issues = F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("told", lambda c: c["issues"])))), F.array().cast("array<string>"))
    extra = F.when(last.isNull() & (n > 0), F.array(F.lit("no chunks"))).when(tail > 0, F.array(F.lit("trailing gap"))).otherwise(F.array().cast("array<string>"))
    told = told.select("file_path", "total_bytes", (total("gap") + tail).alias("missing_bytes"), total("overlap").alias("overlap_bytes"), F.concat(issues, extra).alias("issues"))
    return told.select("file_path", "total_bytes", (n - F.col("missing_bytes")).alias("covered_bytes"), "missing_bytes", "overlap_bytes", "issues", (F.size("issues") == 0).alias("is_exact"))


def totals(coverage_: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row over a batch: files, chunks, and whether every file is covered exactly."""
    files = coverage_.agg(F.count("*").alias("files"), F.coalesce(F.bool_and("is_exact"), F.lit(True)).alias("all_exact"))
    return files.crossJoin(chunks.agg(F.count("*").alias("chunks")))


def statistics(chunks: DataFrame, max_size: int) -> DataFrame:
    return chunks.groupBy("file_path").agg(F.count("*").alias("chunk_count"), F.count_if(F.col("size") > max_size).alias("over_limit_count"), F.min("size").alias("min_size"), F.max("size").alias("max_size"))
