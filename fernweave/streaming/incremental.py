"""Indexing as a stream: new snapshots and job events arrive as files, each is handled once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fernweave.operators import snapshot


def file_stream(spark: SparkSession, folder: str, schema, format: str = "parquet", files_per_batch: int = 1_000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(format).load(folder)


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each key and window; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything that has come since the last run, once; where it got to is kept in checkpoint."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def once(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """events without those that were sent again while the watermark still holds the first one, and without later ones."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts_once(events: DataFrame, key: str = "event_id", by: str = "event_type", time: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """windowed_counts() of events that may be sent again: each counts once, and not at all once its time is past."""
    return once(events, key, time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"))


def snapshot_handler(state: str, out: str) -> Callable[[DataFrame, int], None]:
    """A handler of snapshots (snapshot, n_files, relative_path, content_hash) that may come in any number of batches.

    A snapshot is whole when n_files of its rows are there; in order of their ids, each whole one is compared with the one
    before and its changes written to its own folder below out. Kept below state are the rows of the last whole one and of
    those that are not whole yet, no others. An unfinished snapshot holds back those after it. A batch that comes again
    changes nothing; one with a new row of an id before the last whole one raises.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path
        system = path(state).getFileSystem(spark._jsc.hadoopConfiguration())
        listed = lambda pattern: [str(f.getPath().toString()) for f in system.globStatus(path(f"{state}/{pattern}")) or []]
        # The name says up to which snapshot all is compared, and which batch came to that.
        done = [tuple(map(int, p.rpartition("whole=")[2].split("-"))) for p in listed("whole=*") if system.exists(path(f"{p}/_SUCCESS"))]
        last, by = max(done, default=(None, None))
        if last is not None:
            if by < number and not batch.where(F.col("snapshot") <= last).isEmpty():
                raise ValueError(f"a row of a snapshot that is whole or older than {last}")
            batch = batch.where(F.col("snapshot") > last)
        batch.write.partitionBy("snapshot").mode("overwrite").parquet(f"{state}/batch={number}")
        parts = listed("batch=*/snapshot=*")
        if not parts:
            return
        of = lambda s: spark.read.schema(batch.schema).option("basePath", state).parquet(*[p for p in parts if p.endswith(f"/snapshot={s}")])
        # Few are unfinished at a time; each is counted from its own rows.
        for snapshot_id in sorted({int(p.rpartition("=")[2]) for p in parts}):
            rows = of(snapshot_id)
            n_files, n = rows.agg(F.max("n_files"), F.count("*")).first()
            if n < n_files:
                return
            current = rows.select("relative_path", "content_hash")
            previous = current.limit(0) if last is None else spark.read.parquet(f"{state}/whole={last}-{by}")
            snapshot.diff(previous, current).write.mode("overwrite").parquet(f"{out}/snapshot={snapshot_id}")
            current.write.mode("overwrite").parquet(f"{state}/whole={snapshot_id}-{number}")
            for old in [f"{state}/whole={last}-{by}", *(p for p in parts if p.endswith(f"/snapshot={snapshot_id}"))]:
                system.delete(path(old), True)
            last, by = snapshot_id, number

    return handle
