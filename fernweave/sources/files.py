"""Repository scans: a directory tree as a table of files with the reason each is kept or left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.functions import hashing, paths
from fernweave.sources.repository import read_repository

#: Directories that a scan never enters, at any depth.
PRUNED = (
    ".git", ".hg", ".svn", ".venv", "venv", "env", "__pycache__", "node_modules", "dist", "build", "coverage",
    ".coverage", ".next", ".nuxt", ".output", ".turbo", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".idea", ".vscode",
)
STATUSES = ("ignored", "unsupported", "oversized", "binary", "included")


@dataclass(frozen=True)
class ScanOptions:
    max_bytes: int = 1_000_000
    probe_bytes: int = 8_192
    #: Lines of the root's ignore file.
    ignore: tuple[str, ...] = ()

    def __post_init__(self):
        if self.max_bytes <= 0 or self.probe_bytes <= 0:
            raise ValueError("max_bytes and probe_bytes must be greater than zero")


def read_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """relative_path, size_bytes, content of every file below root, but those that Spark never lists: names that start with
    `.` or `_`. read_mounted() has these too.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    plain = F.regexp_replace("path", r"^[a-z0-9]+:(?://[^/]*)?(?=/)", "")
    return rows.select(F.substr(plain, F.lit(len(base) + 2)).alias("relative_path"), F.col("length").alias("size_bytes"), "content")


def read_mounted(spark: SparkSession, root: str) -> DataFrame:
    """read_tree() of a folder that the driver and all executors have mounted, all names included; links are not followed.

    The data source of repositories lists folders in its parts; nothing is listed whole.
    """
    return read_repository(spark, root, whole="false").select("relative_path", "size_bytes", "content")


def is_binary(content: Column, probe: int) -> Column:
    return F.contains(F.substr(content, F.lit(1), F.lit(probe)), F.unhex(F.lit("00")))


def pruned_prefix(path: Column, options: ScanOptions = ScanOptions()) -> Column:
    """The outermost directory of a path that a scan does not enter; null if it enters all."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    shut = F.filter(above, lambda p: F.element_at(F.split(p, "/"), -1).isin(*PRUNED) | paths.ignored(F.concat(p, F.lit("/")), list(options.ignore)))
    return F.when(F.size(parts) > 1, F.get(shut, F.lit(0)))


def scan(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """files (relative_path, size_bytes, content) with pruned, status, language and content_hash.

    The first reason that holds: ignored, unsupported language, oversized, binary; else included.
    """
    path = F.col("relative_path")
    status = (
        F.when(paths.ignored(path, list(options.ignore)), "ignored")
        .when(paths.language(path).isNull(), "unsupported")
        .when(F.col("size_bytes") > options.max_bytes, "oversized")
        .when(is_binary(F.col("content"), options.probe_bytes), "binary")
        .otherwise("included")
    )
    pruned = pruned_prefix(path, options)
    return files.select("*", pruned.alias("pruned"), F.when(pruned.isNull(), status).alias("status"), paths.language(path).alias("language"), F.when(pruned.isNull(), hashing.content_hash(F.col("content"))).alias("content_hash"))


def scan_statistics(scanned: DataFrame) -> DataFrame:
    """One row: discovered files, pruned directories, and files of each status."""
    seen = F.col("pruned").isNull()
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return scanned.agg(F.count_if(seen).alias("discovered"), F.count_distinct("pruned").alias("pruned_directory"), *counts)


def included(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.col("status") == "included").drop("pruned", "status")


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """read_tree() of a folder, or the one row of a file; a missing path raises FileNotFoundError."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(base):
        raise FileNotFoundError(path)
    if system.getFileStatus(base).isDirectory():
        return read_tree(spark, path)
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("relative_path"), F.col("length").alias("size_bytes"), "content")


def unfiltered(files: DataFrame) -> DataFrame:
    """Files of a known language, as the indexing pipeline takes them: no ignore rules, no limits; in order of paths."""
    language = paths.language(F.col("relative_path"))
    return files.where(language.isNotNull()).withColumn("language", language).orderBy("relative_path")


#: Directories that a scan of Python files alone leaves out.
PYTHON_PRUNED = (".venv", "venv", "__pycache__", ".git", ".idea", ".pytest_cache", "build", "dist", "node_modules", ".gemini")


def python_files(files: DataFrame) -> DataFrame:
    above = F.slice(F.split("relative_path", "/"), F.lit(1), F.greatest(F.size(F.split("relative_path", "/")) - 1, F.lit(0)))
    return files.where(F.endswith("relative_path", F.lit(".py")) & ~F.arrays_overlap(above, F.array(*map(F.lit, PYTHON_PRUNED)))).orderBy("relative_path")
