"""What the operators of this folder share: written tables, word splitting, bounded caches."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fernweave.session import shared_folder

#: Words are runs of anything but the six ASCII white-space characters.
WORD = re.compile("[^\x20\x09-\x0d]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower(text: str) -> str:
    return text.translate(_LOWER) if not text.isascii() else text.lower()


def stash(df: DataFrame, name: str, format: str = "parquet", **options) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, lost executors cost nothing.

    The table must outlive this call (the result is lazy), so the job's owner clears the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fernweave/{name}-{uuid.uuid4().hex}"
    df.write.format(format).options(**options).save(path)
    out = spark.read.format(format).schema(df.schema).load(path)
    out.stash_path = path
    for kept in _records:
        kept.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that no later plan reads; those already deleted don't matter."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.stash_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_records: list[list[DataFrame]] = []


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """The tables that are stashed inside, so that their owner can discard them once nothing lazy reads them."""
    _records.append(made := [])
    try:
        yield made
    finally:
        _records[:] = [r for r in _records if r is not made]


#: A key of more rows than this, and than a ten-thousandth of all rows, is dealt to several tasks.
_HOT_ROWS = 50_000


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", most: int = _HOT_ROWS) -> DataFrame:
    """left joined with right on key, how being inner or left; right has few rows for each key.

    Keys of very many rows in left are dealt to salts, and their rows of right copied to each. There are at most ten
    thousand such keys, since each has more than a ten-thousandth of the rows, so their list is broadcast. left is read
    twice, three times if there are any.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__c"))
    largest, rows = counts.agg(F.max("__c"), F.sum("__c")).first()
    if not rows or largest <= max(most, rows // 10_000):
        return left.join(right, key, how)
    bound = max(most, rows // 10_000)
    hot = counts.where(F.col("__c") > bound).select(F.col(key).alias("__hot"), F.ceil(F.col("__c") / bound).alias("__salts")).collect()
    hot = F.broadcast(left.sparkSession.createDataFrame(hot, StructType([left.select(F.col(key).alias("__hot")).schema[0], StructField("__salts", LongType())])))
    salted = lambda rows: rows.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salts", F.coalesce("__salts", F.lit(1)))
    dealt = salted(left).withColumn("__salt", F.floor(F.rand(17) * F.col("__salts"))).drop("__hot", "__salts")
    copied = salted(right).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__salts") - 1))).drop("__hot", "__salts")
    return dealt.join(copied, [key, "__salt"], how).drop("__salt")


def map_beside(rows: DataFrame, run, added: dict[str, str]) -> DataFrame:
    """rows with the columns `added` (name to type) that run makes, by mapInArrow.

    run sees the columns by place, so any names will do; beside() makes its batches.
    """
    plain = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))
    new = StructType.fromDDL(", ".join(f"c{i} {kind}" for i, kind in enumerate(added.values(), len(plain.columns))))
    return plain.mapInArrow(thrifty(run), StructType([*plain.schema.fields, *new.fields])).toDF(*rows.columns, *added)


def beside(batch: pa.RecordBatch, *columns: pa.Array) -> pa.RecordBatch:
    every = [*batch.columns, *columns]
    return pa.RecordBatch.from_arrays(every, [f"c{i}" for i in range(len(every))])


def clear(spark: SparkSession) -> None:
    """Delete every table that this package has stashed in the session's shared folder. For the job's owner, when no result is lazy any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/fernweave")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Hand free memory back to the system: Python workers outlive their tasks, and the next one may be of another kind."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def thrifty(run):
    """run, which maps an iterator of batches, with give_back() at its end."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return mapped


class Memo:
    """A cache of two generations, at most 2 * size entries of 2 * chars characters: what is used often stays. Filled in bulk."""

    def __init__(self, compute_many, size: int = 400_000, chars: int = 16_000_000):
        self.compute_many, self.size, self.chars, self.held = compute_many, size, chars, 0
        self.old: dict = {}
        self.young: dict = {}

    def fill(self, keys: set) -> dict:
        """A mapping that holds all keys now; compute_many(list) gives the values of those not cached."""
        if len(self.young) > self.size or self.held > self.chars:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        missing, new = [], keys - young.keys()
        if not old:
            missing, new = list(new), ()
        for key in new:
            value = old.get(key)
            if value is None:
                missing.append(key)
            else:
                young[key] = value
        self.held += sum(map(len, new)) + sum(map(len, missing))
        if missing:
            young.update(zip(missing, self.compute_many(missing), strict=True))
        return young


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


_ODD = [np.uint64(int(x, 16) | 1) for x in ("9e3779b97f4a7c15", "c2b2ae3d27d4eb4f", "165667b19e3779f9", "d6e8feb86659fd93", "ff51afd7ed558ccd", "c4ceb9fe1a85ec53")]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * _ODD[3]
    x = x ^ (x >> np.uint64(29))
    x = x * _ODD[4]
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words than k are one shingle.

    words: a 64-bit hash for each word, in order.
    """
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    with np.errstate(over="ignore"):
        total = np.full(n - width + 1, n if n < k else k, np.uint64)
        for i in range(width):
            total = mix(total) * _ODD[0] + words[i : n - width + 1 + i]
        return np.unique(mix(total))
