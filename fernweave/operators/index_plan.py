"""An index plan: documents to write and files to delete, checked before anything is applied."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernweave.functions import hashing, paths


def deletes(changes: DataFrame, repository_id: str, revision: str) -> DataFrame:
    """replace_file for added and modified paths, source_deleted for deleted ones."""
    reason = F.when(F.col("change").isin("added", "modified"), "replace_file").when(F.col("change") == "deleted", "source_deleted")
    rows = changes.select(F.lit(_named(repository_id)).alias("repository_id"), F.lit(_named(revision)).alias("revision"), F.col("relative_path").alias("file_path"), reason.alias("reason"))
    return rows.where(F.col("reason").isNotNull())


def documents(chunks: DataFrame, changes: DataFrame, repository_id: str, revision: str, size_unit: str = "byte") -> DataFrame:
    """One index document for each chunk of an added or modified file."""
    new = changes.where(F.col("change").isin("added", "modified")).select(F.col("relative_path").alias("file_path"), F.col("current_hash").alias("content_hash"), F.col("change").alias("source_change"))
    repo = F.lit(_named(repository_id))
    ident = hashing.document_id(repo, F.col("file_path"), F.col("content_hash"), F.col("chunk_index"), F.col("start_byte"), F.col("end_byte"))
    return chunks.join(new, "file_path").select(ident.alias("document_id"), repo.alias("repository_id"), F.lit(_named(revision)).alias("revision"), "file_path", "content_hash", "chunk_index", F.col("content").alias("text"), "language", "parser_name", "source_change", "start_byte", "end_byte", "size", F.lit(size_unit).alias("size_unit"), "symbol_name", "symbol_kind")


def problems(chunks: DataFrame, changes: DataFrame, coverage: DataFrame, max_size: int) -> DataFrame:
    """file_path, problem: why a plan must not be built. Empty for a sound one."""
    new = changes.where(F.col("change").isin("added", "modified")).select(F.col("relative_path").alias("file_path"), "current_hash")
    path, spelt = F.col("file_path"), F.col("language")
    places = Window.partitionBy("file_path").orderBy("chunk_index")
    numbered = chunks.select("file_path", "chunk_index", (F.row_number().over(places) - 1).alias("expected"))
    tests = {
        "chunk over limit": F.col("size") > max_size,
        "invalid path": ~path.eqNullSafe(paths.normalize(path)),
        "unknown language": paths.language(path).isNull(),
        "language mismatch": paths.language(path).isNotNull() & ~spelt.eqNullSafe(paths.language(path)),
        "parser mismatch": paths.language(path).isNotNull() & ~F.col("parser_name").eqNullSafe(paths.parser_name(path)),
        "empty chunk": F.coalesce(F.col("content"), F.lit("")) == "",
        "invalid span": (F.col("start_byte") < 0) | (F.col("end_byte") <= F.col("start_byte")),
    }
    of_chunks = chunks.select("file_path", F.explode(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))).alias("problem"))
    checks = [
        of_chunks,
        numbered.where(F.col("chunk_index") != F.col("expected")).select("file_path", F.lit("chunk index").alias("problem")),
        coverage.where(~F.col("is_exact")).select("file_path", F.lit("inexact coverage").alias("problem")),
        new.where(~F.coalesce(F.rlike("current_hash", F.lit("^[0-9a-f]{64}$")), F.lit(False))).select("file_path", F.lit("malformed hash").alias("problem")),
        new.join(coverage, "file_path", "left_anti").select("file_path", F.lit("not chunked").alias("problem")),
        chunks.join(new, "file_path", "left_anti").select("file_path", F.lit("unexpected chunks").alias("problem")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.distinct()


def check(chunks: DataFrame, changes: DataFrame, coverage: DataFrame, max_size: int) -> None:
    """Raises with some of the problems of a plan, if it has any."""
    some = problems(chunks, changes, coverage, max_size).orderBy("file_path", "problem").limit(10).collect()
    if some:
        raise ValueError("; ".join(f"{r['file_path']}: {r['problem']}" for r in some))


def counts(documents_: DataFrame, deletes_: DataFrame) -> DataFrame:
    """One row: documents, deletes, has_operations."""
    both = documents_.select(F.lit(1).alias("d"), F.lit(0).alias("x")).unionByName(deletes_.select(F.lit(0).alias("d"), F.lit(1).alias("x")))
    return both.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("documents"), F.coalesce(F.sum("x"), F.lit(0)).alias("deletes"), (F.count("*") > 0).alias("has_operations"))


def _named(value: str) -> str:
    if not value.strip():
        raise ValueError("repository id and revision must not be empty")
    return value.strip()
