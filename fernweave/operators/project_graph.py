"""From a project's files and its symbol index to its graph, in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.functions import paths
from fernweave.operators import callgraph, positions
from fernweave.session import dealt, written
from fernweave.sources import parsing, scip


def documents_of(files: DataFrame, occurrences: DataFrame) -> DataFrame:
    """occurrences with the file_path of files that their document_path means; both may have backslashes and one `./`.

    A document without a file is left out, and so is a file without content.
    """
    known = files.where(F.col("content").isNotNull()).select("file_path", paths.normalize_scip(F.col("file_path")).alias("__path"))
    return occurrences.withColumn("__path", paths.normalize_scip(F.col("document_path"))).join(known, "__path").drop("__path")


def document_paths(occurrences: DataFrame) -> DataFrame:
    return occurrences.select("document_path").distinct()


def is_defined(asked: DataFrame, occurrences: DataFrame) -> DataFrame:
    """asked (symbol) with is_defined: whether a document defines it."""
    defined = occurrences.where("is_definition").select("symbol").distinct().withColumn("__hit", F.lit(True))
    return asked.join(defined, "symbol", "left").withColumn("is_defined", F.coalesce("__hit", F.lit(False))).drop("__hit")


def located(files: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Occurrences as the call graph takes them: (file, symbol, text, start_byte, end_byte, ordinal, is_definition).

    text is what stands at the place in the file; bytes that are no UTF-8 are replaced.
    """
    own = documents_of(files, occurrences)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    found = positions.scip_spans(own, positions.line_table(files.where(F.col("content").isNotNull()).select("file_path", text.alias("text"))))
    source = files.select("file_path", "content")
    part = F.substr("content", (F.col("start_byte") + 1).cast("int"), F.greatest(F.col("end_byte") - F.col("start_byte"), F.lit(0)).cast("int"))
    rows = found.join(source, "file_path").withColumn("text", F.make_valid_utf8(part.cast("string")))
    return rows.select(F.col("file_path").alias("file"), "symbol", "text", "start_byte", "end_byte", "ordinal", "is_definition")


def build(files: DataFrame, index_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The syntax nodes of files (file_path, content), and the references between them that index files (content) tell: src, dst, type.

    Each file and each index is parsed once; what comes of it is written before it is joined, as tables whose size is known:
    guessed from the files' own, a table of nodes looks small enough to be broadcast and isn't.
    """
    nodes, occurrences = written(parsing.parse_files(files), "nodes"), written(scip.read_occurrences(dealt(index_files)), "occurrences")
    return nodes, callgraph.build(parsing.for_call_graph(nodes), written(located(written(files.select("file_path", "content"), "files"), occurrences), "located"))
