"""Places and running sums inside keys of any size: no key is gathered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.session import shared_folder


def running(rows: DataFrame, key: str, order: list[Column | str], value: Column | int, name: str) -> DataFrame:
    """rows with `name`: the sum of value over the rows of the same key that come before, by order, as a long.

    Rows are dealt by ranges of (key, order) and written. A range knows its own sums, and what comes before it in a key
    follows from one number for each range and key. Rows that order does not tell apart come in one range, in any order.
    """
    shared_folder(rows.sparkSession)
    value = (F.lit(value) if isinstance(value, int) else value).cast("long")
    ranged = rows.withColumn("__value", value).repartitionByRange(key, *order).withColumn("__range", F.spark_partition_id()).checkpoint()
    before = lambda c, window: F.coalesce(F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = ranged.groupBy("__range", key).agg(F.sum("__value").alias("__sum"))
    starts = sums.select(F.col("__range").alias("__at"), F.col(key).alias("__key"), before("__sum", Window.partitionBy(key).orderBy("__range")).alias("__before"))
    own = before("__value", Window.partitionBy("__range", key).orderBy(*order))
    placed = ranged.withColumn("__own", own).join(starts, (F.col("__range") == F.col("__at")) & F.col(key).eqNullSafe(F.col("__key")))
    return placed.select(*rows.columns, (F.col("__before") + F.col("__own")).alias(name))


def numbered(rows: DataFrame, key: str, order: list[Column | str], name: str) -> DataFrame:
    """rows with `name`: the place of each among the rows of its key, from 0."""
    return running(rows, key, order, 1, name)
