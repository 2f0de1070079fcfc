"""A table of vectors in buckets of their ids: made if absent, and an upsert rewrites only the buckets that it touches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from fernweave.operators.search import upsert_points
from fernweave.session import shared_folder

#: Fixed value: the length of vectors where nothing else is said.
DIMENSIONS = 1024


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _about(spark: SparkSession, folder: str) -> dict | None:
    at, system = _file(spark, f"{folder}/about.json")
    return json.loads(spark.read.text(str(at), wholetext=True).first()[0]) if system.exists(at) else None


def ensure_table(spark: SparkSession, folder: str, dimensions: int = DIMENSIONS, buckets: int = 64) -> dict:
    """What the table in folder is, which is made if there is none. One of other dimensions raises."""
    if dimensions <= 0 or buckets <= 0:
        raise ValueError("dimensions and buckets must be greater than zero")
    found = _about(spark, folder)
    if found is None:
        found = {"dimensions": dimensions, "buckets": buckets, "distance": "cosine"}
        at, system = _file(spark, f"{folder}/about.json")
        # Of two that make it at once one fails, and finds it the next time.
        out = system.create(at, False)
        out.write(bytearray(json.dumps(found).encode()))
        out.close()
    if found["dimensions"] != dimensions:
        raise ValueError(f"the table has vectors of {found['dimensions']} components, not {dimensions}")
    return found


def _rows(spark: SparkSession, folder: str, schema) -> DataFrame:
    at, system = _file(spark, folder)
    made = [str(f.getPath().toString()) for f in system.globStatus(_file(spark, f"{folder}/bucket=*")[0]) or []]
    plain = StructType([*schema.fields, StructField("bucket", IntegerType())])
    return spark.read.schema(plain).option("basePath", folder).parquet(*made) if made else spark.createDataFrame([], plain)


def read_points(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The points, by a schema of their columns."""
    return _rows(spark, folder, schema).drop("bucket")


def upsert(folder: str, new: DataFrame, version: str = "version") -> int:
    """Adds points (point_id, vector, version, ...) or puts them in the place of older ones; the number that have a vector.

    Rows without a vector are left out; a vector of another length raises before anything is written. Only the buckets of
    the new ids are read and written again, each in one step, so the same upsert again, or after a failure, gives the same
    table. Of a point's versions the largest stays.
    """
    spark = new.sparkSession
    about = _about(spark, folder)
    if about is None:
        raise FileNotFoundError(f"no table of points in {folder}")
    rows = new.where(F.col("vector").isNotNull()).withColumn("bucket", F.pmod(F.xxhash64("point_id"), F.lit(about["buckets"])).cast("int"))
    shared_folder(spark)
    rows = rows.checkpoint()
    wrong = rows.where(F.size("vector") != about["dimensions"])
    if not wrong.isEmpty():
        raise ValueError(f"point {wrong.first()['point_id']} has not {about['dimensions']} components")
    touched = [r[0] for r in rows.select("bucket").distinct().collect()]
    if touched:
        old = _rows(spark, folder, new.schema).where(F.col("bucket").isin(touched))
        merged = upsert_points(old.select(*rows.columns), rows, version).checkpoint()
        merged.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)
    return rows.count()
