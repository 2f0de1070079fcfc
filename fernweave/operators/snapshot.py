"""What changed between two snapshots, and checks of the sets that a change is told by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.functions import paths


def _keyed(snapshot: DataFrame, name: str) -> DataFrame:
    """One row for each path; an invalid path, or one that stands there twice, raises."""
    path = paths.normalize(F.col("relative_path"))
    path = F.coalesce(path, F.raise_error(F.concat(F.lit("invalid path: "), F.coalesce("relative_path", F.lit("null")))).cast("string"))
    rows = snapshot.select(path.alias("relative_path"), "content_hash").groupBy("relative_path").agg(F.count("*").alias("n"), F.max("content_hash").alias("hash"))
    once = F.when(F.col("n") == 1, F.col("hash")).otherwise(F.raise_error(F.concat(F.lit("more than one row of path: "), "relative_path")).cast("string"))
    return rows.select("relative_path", once.alias(name))


def violations(snapshot: DataFrame) -> DataFrame:
    """relative_path, problem: why diff() would raise. Empty for a sound snapshot."""
    path = paths.normalize(F.col("relative_path"))
    bad = snapshot.where(path.isNull()).select("relative_path", F.lit("invalid path").alias("problem"))
    twice = duplicates(snapshot.select(path.alias("relative_path")).where(F.col("relative_path").isNotNull()), "relative_path")
    return bad.unionByName(twice.select("relative_path", F.lit("more than one row").alias("problem")))


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """relative_path, previous_hash, current_hash, change over two tables (relative_path, content_hash).

    Paths are normalised first. An invalid path or a doubled one raises; violations() lists them.
    """
    both = _keyed(previous, "previous_hash").join(_keyed(current, "current_hash"), "relative_path", "full_outer")
    change = F.when(F.col("previous_hash").isNull(), "added").when(F.col("current_hash").isNull(), "deleted").when(F.col("previous_hash") == F.col("current_hash"), "unchanged").otherwise("modified")
    return both.withColumn("change", change)


def summary(changes: DataFrame) -> DataFrame:
    """One row: files of each change, and has_changes."""
    counts = [F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "unchanged", "deleted")]
    return changes.agg(*counts, F.coalesce(F.bool_or(F.col("change") != "unchanged"), F.lit(False)).alias("has_changes"))


def changed_paths(changes: DataFrame) -> DataFrame:
    """Paths that are added, modified or deleted."""
    return changes.where(F.col("change") != "unchanged").select("relative_path")


def current_hashes(changes: DataFrame, folder: int = 1) -> DataFrame:
    """folder, hashes: a map of path to current hash for each folder of that depth ("" for files above it), deleted ones left out.

    A map of a whole repository would be one row that grows with it; folders keep rows small.
    """
    above = F.array_join(F.slice(F.split("relative_path", "/"), F.lit(1), F.least(F.lit(folder), F.size(F.split("relative_path", "/")) - 1)), "/")
    rows = changes.where(F.col("current_hash").isNotNull()).groupBy(above.alias("folder"))
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relative_path", "current_hash")))).alias("hashes"))


def duplicates(table: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, with n."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def conflicts(snapshot: DataFrame) -> DataFrame:
    """Paths that name several contents once they are normalised."""
    rows = snapshot.select(paths.normalize(F.col("relative_path")).alias("relative_path"), "content_hash")
    return rows.groupBy("relative_path").agg(F.count_distinct("content_hash").alias("n_hashes")).where((F.col("n_hashes") > 1) & F.col("relative_path").isNotNull())


def overlaps(changes: DataFrame) -> DataFrame:
    """Paths that stand in more than one change set."""
    return changes.groupBy("relative_path").agg(F.array_sort(F.collect_set("change")).alias("changes")).where(F.size("changes") > 1)


def coverage_gaps(changes: DataFrame, current: DataFrame) -> DataFrame:
    """Where added, modified and unchanged paths together are not the current snapshot: relative_path, problem."""
    told = changes.where(F.col("change") != "deleted").select("relative_path")
    have = current.select("relative_path")
    missing = have.exceptAll(told).select("relative_path", F.lit("missing").alias("problem"))
    return missing.unionByName(told.exceptAll(have).select("relative_path", F.lit("unexpected").alias("problem")))


def stale(scanned: DataFrame, reread: DataFrame) -> DataFrame:
    """Files that changed between a scan and its parse: size or hash differ, or the file is gone."""
    now = reread.select("relative_path", F.col("size_bytes").alias("size_now"), F.col("content_hash").alias("hash_now"))
    return scanned.join(now, "relative_path", "left").where(~(F.col("size_bytes").eqNullSafe(F.col("size_now")) & F.col("content_hash").eqNullSafe(F.col("hash_now")))).select("relative_path", "content_hash", "hash_now")
