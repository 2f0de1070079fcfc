"""Indexing jobs: the latest of each branch, and what a request does to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.session import shared_folder

#: Progress at the end of each stage.
MILESTONES = {"clone": 20, "parse": 40, "graph": 70, "vectors": 90, "done": 100}


def latest(jobs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by order; the key's rows need not meet in one task first (a partial maximum)."""
    rest = [c for c in jobs.columns if c != key]
    top = jobs.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("top"))
    return top.select(key, *(F.col(f"top.{c}").alias(c) for c in rest))


def decision(status: Column, indexed_commit: Column, wanted_commit: Column, has_job: Column) -> Column:
    """What an index request does: reject, reindex, reuse_job or new_job."""
    same = wanted_commit.isNull() | (wanted_commit == indexed_commit)
    return F.when(status == "INDEXING", "reject").when((status == "INDEXED") & same, "reject").when(status == "INDEXED", "reindex").when((status == "FAILED") & has_job, "reuse_job").otherwise("new_job")


def outdated(status: Column, indexed_commit: Column, new_commit: Column) -> Column:
    return F.when((status == "INDEXED") & (new_commit != indexed_commit), "OUTDATED").otherwise(status)


def in_flight(jobs: DataFrame) -> DataFrame:
    return jobs.where((F.col("progress_pct") < 100) & F.col("error_message").isNull())


def transitions(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """events with `previous`, the state before, for rows where it changed."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("previous", before).where(F.col("previous").isNull() | (F.col("previous") != F.col(state)))


def batches(rows: DataFrame, key: str, order: list[str], size: int = 50) -> DataFrame:
    """rows with batch, from 0: `size` rows of a key each, in order. rows of one key may be in many tasks.

    Rows are dealt by ranges of (key, order) and written; a range knows its own places, and where it starts in a key
    follows from the counts of the ranges before, one number for each range and key.
    """
    shared_folder(rows.sparkSession)
    ranged = rows.repartitionByRange(key, *order).withColumn("__range", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy("__range", key).agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__range", F.col(key).alias("__key"), before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range", key).orderBy(*order)) - 1
    placed = ranged.withColumn("__own", own).join(starts.withColumnRenamed("__range", "__at"), (F.col("__range") == F.col("__at")) & F.col(key).eqNullSafe(F.col("__key")))
    return placed.withColumn("batch", F.floor((F.col("__before") + F.col("__own")) / size)).select(*rows.columns, "batch")


def newest(jobs: DataFrame, created: str = "created_at", id_column: str = "id") -> DataFrame:
    return jobs.orderBy(F.desc(created), F.desc(id_column))


def trigger_workspace(branches: DataFrame, workspace_id: int) -> DataFrame:
    """A new job for each branch (branch_id, workspace_id) of a workspace, whatever its state; a workspace without any raises."""
    own = branches.where(F.col("workspace_id") == workspace_id).select("branch_id").distinct()
    if own.isEmpty():
        raise LookupError(f"workspace {workspace_id} has no branches")
    return own.select("branch_id", F.lit("PENDING").alias("status"), F.lit(0).alias("progress_pct"))


def with_status(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """jobs (id, status, progress_pct, error_message, updated_at) with the last of the changes of each."""
    return latest(jobs.unionByName(changes, allowMissingColumns=True), "id", ["updated_at"])


def milestone(stage: Column) -> Column:
    """The progress at the end of a stage; null for an unknown one."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in MILESTONES.items() for x in pair)), stage)
