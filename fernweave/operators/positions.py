"""Lines and characters to byte offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """batch in slices of about `most` bytes of a column of texts: what is made of a slice is let go before the next."""
    before = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy().astype(np.int64))])
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(before, before[start] + most, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def line_table(files: DataFrame, path: str = "file_path", text: str = "text") -> DataFrame:
    """path, line (from 0), line_text, start_byte. Lines end with \\n only; a \\r stays in its line. A null text has none.

    Offsets are summed inside each file, on Arrow columns: no shuffle.
    """
    rows = files.select(F.col(path).alias("path"), F.col(text).alias("text")).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bounded(whole, 1)):
            lists = pc.split_pattern(batch.column(1), "\n")
            lines, n = lists.flatten(), lists.value_lengths().to_numpy()
            size = pc.binary_length(lines).to_numpy().astype(np.int64) + 1
            first = np.repeat(np.cumsum(n) - n, n)
            before = np.concatenate([[0], np.cumsum(size)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array((np.arange(len(lines)) - first).astype(np.int32)), lines, pa.array(before[:-1] - before[first])], ["path", "line", "line_text", "start_byte"])

    kind = rows.schema["path"].dataType.simpleString()
    return rows.mapInArrow(run, f"path {kind}, line int, line_text string, start_byte bigint").withColumnRenamed("path", path)


def to_bytes(places: DataFrame, lines: DataFrame, path: str = "file_path") -> DataFrame:
    """places (path, line, character) with byte: past a line's end its end, past the file its end."""
    ends = lines.groupBy(path).agg(F.max("line").alias("last"), F.max(F.col("start_byte") + F.octet_length("line_text")).alias("file_bytes"))
    found = places.join(ends, path).join(lines, [path, "line"], "left")
    inside = F.col("start_byte") + F.octet_length(F.substr("line_text", F.lit(1), F.col("character")))
    return found.select(*places.columns, F.when(F.col("line") > F.col("last"), F.col("file_bytes")).otherwise(inside).alias("byte"))


def scip_spans(occurrences: DataFrame, lines: DataFrame, path: str = "file_path") -> DataFrame:
    """occurrences (path, scip_range of 3 or 4 integers) with start_byte and end_byte; other ranges are dropped."""
    r = F.col("scip_range")
    rows = occurrences.where(F.size(r).isin(3, 4))
    short = F.size(r) == 3
    ends = F.array(F.struct(F.lit(0).alias("side"), r[0].alias("line"), r[1].alias("character")), F.struct(F.lit(1).alias("side"), F.when(short, r[0]).otherwise(F.get(r, F.lit(2))).alias("line"), F.when(short, r[2]).otherwise(F.get(r, F.lit(3))).alias("character")))
    keys = rows.select(path, "scip_range").distinct().select(path, "scip_range", F.explode(ends).alias("e")).select(path, "scip_range", "e.side", "e.line", "e.character")
    at = to_bytes(keys, lines, path).groupBy(path, "scip_range").agg(F.max(F.when(F.col("side") == 0, F.col("byte"))).alias("start_byte"), F.max(F.when(F.col("side") == 1, F.col("byte"))).alias("end_byte"))
    return rows.join(at, [path, "scip_range"])
