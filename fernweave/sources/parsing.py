"""Source files to syntax nodes. Each file is one row in and its nodes out, in Python workers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fernweave.functions import paths
from fernweave.schemas import DEFINITIONS, DIAGNOSTICS, REFERENCES, UAST_NODES
from fernweave.session import dealt

COLUMNS = ("file_path", "id", "parent_id", "ordinal", "depth", "node_type", "kind", "name", "start_byte", "end_byte", "start_row", "start_column", "end_row", "end_column", "docstring", "visibility", "modifiers", "decorators", "base_types", "enum_values", "return_type", "data_type", "initial_value", "is_async", "is_generator", "is_static", "is_abstract", "is_override", "module_path", "imported_names", "alias", "subject", "params", "metadata")

#: parse(source) -> (nodes, problems): nodes are dicts with start, end, parent (index or None), type, and any of COLUMNS;
#: problems are (kind, message, start, end).
Parser = Callable[[bytes], tuple[list[dict], list[tuple[str, str, int, int]]]]
_PARSERS: dict[str, Parser] = {}


def register(language: str, parser: Parser) -> None:
    if language in _PARSERS:
        raise ValueError(f"a parser for {language} is registered")
    _PARSERS[language] = parser


def parser_of(language: str) -> Parser:
    from fernweave.sources import python_parser, script_parser  # noqa: F401  they register themselves

    if language not in _PARSERS:
        raise ValueError(f"no parser for {language}")
    return _PARSERS[language]


def _points(source: bytes) -> Callable[[int], tuple[int, int]]:
    from bisect import bisect_right

    starts = [0, *(m.end() for m in re.finditer(b"\n", source))]

    def point(at: int) -> tuple[int, int]:
        row = bisect_right(starts, at) - 1
        return row, at - starts[row]

    return point


def node_id(path: str, kind: str, start: int, end: int, ordinal: int) -> str:
    """The same file gives the same ids again."""
    return hashlib.sha256(f"{path}\0{kind}\0{start}\0{end}\0{ordinal}".encode()).hexdigest()[:32]


def parse(language: str, source: bytes) -> tuple[list[dict], list[tuple[str, str, int, int]]]:
    """A parser's nodes and problems. A file that is nested deeper than the parser can follow, or at which the parser fails,
    is one problem without nodes: it takes no other file with it.
    """
    parser = parser_of(language)
    try:
        return parser(source)
    except (RecursionError, MemoryError):
        return [], [("too_deep", "nested too deeply", 0, len(source))]
    except Exception as error:
        return [], [("parser_error", f"{type(error).__name__}: {error}", 0, len(source))]


def rows_of(path: str, language: str, source: bytes) -> list[dict]:
    nodes, _ = parse(language, source)
    point, out = _points(source), []
    root = {"type": "container", "kind": "file", "start": 0, "end": len(source), "parent": None, "name": path.rpartition("/")[2]}
    for ordinal, n in enumerate([root, *nodes]):
        parent = None if not ordinal else out[0 if n["parent"] is None else n["parent"] + 1]
        row = dict.fromkeys(COLUMNS)
        row |= {k: v for k, v in n.items() if k in row}
        row |= {"file_path": path, "ordinal": ordinal, "node_type": n["type"], "start_byte": n["start"], "end_byte": n["end"], "id": node_id(path, n["type"], n["start"], n["end"], ordinal), "parent_id": parent and parent["id"], "depth": parent["depth"] + 1 if parent else 0}
        (row["start_row"], row["start_column"]), (row["end_row"], row["end_column"]) = point(n["start"]), point(n["end"])
        out.append(row)
    return out


def _sources(files: DataFrame) -> DataFrame:
    rows = files.select("file_path", paths.language(F.col("file_path")).alias("language"), "content").where(F.col("language").isNotNull() & F.col("content").isNotNull())
    return dealt(rows, "file_path")


def parse_files(files: DataFrame) -> DataFrame:
    """files (file_path, content) to UAST_NODES, one row a node in pre-order; languages without a parser are left out."""
    schema = StructType.fromDDL(UAST_NODES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = to_arrow_schema(schema)

        def frame(nodes: list[dict]) -> pa.RecordBatch:
            columns = [[n[f.name] for n in nodes] for f in fields]
            columns = [[v and list(v.items()) for v in c] if pa.types.is_map(f.type) else c for f, c in zip(fields, columns, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(fields, columns, strict=True)], schema=fields)

        for batch in batches:
            out: list[dict] = []
            for path, language, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += rows_of(path, language, content)
                # Small files share a frame, for a frame costs more than they do.
                if len(out) >= 2_000:
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)

    return _sources(files).mapInArrow(run, schema)


def diagnostics(files: DataFrame) -> DataFrame:
    """DIAGNOSTICS of files; a file with any is only partly parsed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for f in batch.itertuples(index=False):
                source = bytes(f.content)
                for kind, message, start, end in sorted(parse(f.language, source)[1], key=lambda p: (p[2], p[3], p[0])):
                    part = source[start : min(end, start + 120)] if end > start else source[max(0, start - 40) : start + 40]
                    shown = part.decode("utf-8", "replace").replace("\r", "\\r").replace("\n", "\\n")
                    out.append((f.file_path, kind, "error", message, "MISSING" if kind == "missing_node" else "ERROR", start, end, shown or None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DIAGNOSTICS.split(", ")])

    return _sources(files).mapInPandas(run, DIAGNOSTICS)


def parse_results(files: DataFrame, problems: DataFrame) -> DataFrame:
    """file_path, language, parser_name, status, source_size_bytes, n_problems of every file.

    status: unsupported (no language), missing (no content), partial (with problems) or success.
    """
    n = problems.groupBy("file_path").agg(F.count("*").alias("n_problems"))
    path = F.col("file_path")
    rows = files.select("file_path", paths.language(path).alias("language"), paths.parser_name(path).alias("parser_name"), F.octet_length("content").cast("bigint").alias("source_size_bytes"))
    joined = rows.join(n, "file_path", "left").withColumn("n_problems", F.coalesce("n_problems", F.lit(0)))
    return joined.withColumn("status", F.when(F.col("language").isNull(), "unsupported").when(F.col("source_size_bytes").isNull(), "missing").when(F.col("n_problems") > 0, "partial").otherwise("success"))


def with_flags(results: DataFrame) -> DataFrame:
    """results with has_errors (a problem at all) and is_clean (parsed without any)."""
    return results.withColumn("has_errors", F.col("n_problems") > 0).withColumn("is_clean", F.col("status") == "success")


def counters(results: DataFrame) -> DataFrame:
    """One row: files that were processed, those of them with problems, and those that were skipped."""
    done = F.col("status").isin("success", "partial")
    return results.agg(F.count_if(done).alias("processed"), F.count_if(F.col("status") == "partial").alias("partial"), F.count_if(~done).alias("skipped"))


def modifiers_among(nodes: DataFrame, wanted: tuple[str, ...], name: str = "found") -> DataFrame:
    """nodes with those of their modifiers that are wanted, in the order of the source, once each; empty for none."""
    return nodes.withColumn(name, F.coalesce(F.array_intersect("modifiers", F.array(*map(F.lit, wanted))), F.array().cast("array<string>")))


def for_call_graph(nodes: DataFrame) -> DataFrame:
    """UAST_NODES as the call graph joins want them."""
    return nodes.select(F.col("file_path").alias("file"), "id", "name", "start_byte", "end_byte", F.col("ordinal").alias("node_ordinal"), F.col("node_type").isin(*DEFINITIONS).alias("is_definition"), F.col("node_type").isin(*REFERENCES).alias("is_reference"))
