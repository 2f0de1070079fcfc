"""Token-id output: ORC files with integer run-length encoding, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernweave.llm.common import thrifty
from fernweave.llm.tokens import codec_of, id_lists, with_end


def write_token_orc(documents: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, stripe_bytes: int = 16 << 20, index_stride: int = 1_000, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write one row for each document, in ascending id order over the files and inside them.

    Columns: part (the file's number in that order), doc_id, part_start (ids before the document in its part),
    n_tokens, ids (array<int>, the end id last). ORC run-length encodes the integers; every stripe has row indexes
    and a Bloom filter on doc_id, so readers skip stripes by metadata and read them side by side.

    A null or empty text has the end id alone. A null document id comes first; rows of one id are ordered by the
    hash of their text, and stay separate rows. An empty table writes empty files. One shuffle: the range exchange.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        held = documents.sparkSession.sparkContext.broadcast(f.read())
    rows = documents.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie.asc()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie.asc())
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, before = codec_of(held.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, ids, sizes in codec.encode_slices(batch.column(1)):
                ids, sizes = with_end(ids, sizes, end_id)
                starts = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, part, np.int64)), batch.column(0).slice(a, b - a), pa.array(starts), pa.array(sizes), id_lists(ids, sizes)], ["part", "doc_id", "part_start", "n_tokens", "ids"])

    out = ordered.mapInArrow(thrifty(encode), f"part bigint, doc_id {kind}, part_start bigint, n_tokens bigint, ids array<int>")
    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(index_stride), "orc.stripe.size": str(stripe_bytes)}
    out.write.format("orc").options(**options).save(path)


def read_token_orc(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. Filters on doc_id prune stripes by metadata."""
    files = spark.read.schema(f"part bigint, doc_id {id_type}, part_start bigint, n_tokens bigint, ids array<int>").orc(path)
    # One row a file: the largest end in it is its total. So many rows as files (two longs each) are broadcast.
    totals = files.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(totals.select("part", before.alias("before")))
    return files.join(starts, "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_token_orc() gives; the count and the sum come from the ids."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip([0, *ends[:-1]], ends, strict=True)] if len(ends) else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends, prepend=0).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(sums, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
