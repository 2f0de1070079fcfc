"""The catalogue's tables, from files or from a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The tables of the catalogue.
CATALOGUE = ("users", "workspaces", "members", "repositories", "workspace_repositories", "branches", "workspace_branches", "projects", "jobs", "tokens")


def from_files(spark: SparkSession, folder: str, names: tuple[str, ...] = CATALOGUE) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def from_database(spark: SparkSession, url: str, names: tuple[str, ...] = CATALOGUE, key: str = "id", parts: int = 8, **options: str) -> dict[str, DataFrame]:
    """Tables over JDBC. Those that have the numeric key are read in `parts` ranges of it side by side."""
    out = {}
    for name in names:
        reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
        whole = reader.load()
        if key in whole.columns:
            low, high = spark.read.format("jdbc").options(url=url, query=f"SELECT min({key}) AS low, max({key}) AS high FROM {name}", **options).load().first()
            if low is not None:
                whole = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(parts)).load()
        out[name] = whole
    return out
