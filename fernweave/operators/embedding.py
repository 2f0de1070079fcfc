"""From syntax nodes to vectors: what to embed, its text, and the vectors in batches."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.functions import hashing, text

#: The dimension of vectors, and nodes of a batch.
DIMENSION, BATCH = 1_024, 50

#: Texts to vectors, in order; texts to summaries, in order.
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Summarizer = Callable[[Sequence[str]], Sequence[str]]


def mock_vector(value: str, dimension: int = DIMENSION) -> list[float]:
    """The same text gives the same unit vector: uniform numbers of a generator that the text seeds."""
    draw = random.Random(value)
    v = np.array([draw.uniform(-1.0, 1.0) for _ in range(dimension)])
    return (v / (np.sqrt((v * v).sum()) or 1.0)).tolist()


def mock_embedder(texts: Sequence[str]) -> list[list[float]]:
    return [mock_vector(t) for t in texts]


def mock_summarizer(signatures: Sequence[str]) -> list[str]:
    """Stands for a model where there is none: it says what a node is."""
    return [f"Defines {s}." for s in signatures]


def candidates(nodes: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """Functions and types in pre-order inside each file, where place counts them from 0; the first max_nodes of all, if over 0.

    A file is bounded by the scan, so are its nodes.
    """
    keep = nodes.where(F.col("node_type").isin("function", "type-definition"))
    lists = keep.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id"))).alias("own"))
    places = lists.select("file_path", F.posexplode("own").alias("place", "one")).select("file_path", "place", F.col("one.id").alias("id"))
    if max_nodes is not None and max_nodes > 0:
        places = places.orderBy("file_path", "place").limit(max_nodes)
    return keep.join(places, ["file_path", "id"])


def enriched(found: DataFrame, names: DataFrame) -> DataFrame:
    """candidates() with signature, docstring (where it says something) and identifiers. names (id, names): what is below each node."""
    c = F.col
    rows = found.join(names, "id", "left")
    signature = text.node_signature(c("node_type"), c("name"), c("params"), c("return_type"), c("is_async"), c("base_types"))
    own = F.concat(F.when(c("name").isNotNull(), F.array("name")).otherwise(F.array().cast("array<string>")), F.coalesce("names", F.array().cast("array<string>")))
    return rows.select("id", "file_path", "place", "node_type", "kind", F.coalesce("name", F.lit("unnamed")).alias("name"), signature.alias("signature"), F.when(text.useful_docstring(c("docstring"), F.coalesce("name", F.lit(""))), text.bare_docstring(c("docstring"))).alias("docstring"), text.identifier_terms(own).alias("identifiers"))


def embed_nodes(rows: DataFrame, workspace_id: int, branch_id: int, embedder: Embedder = mock_embedder, summarizer: Summarizer = mock_summarizer, batch: int = BATCH) -> DataFrame:
    """enriched() rows as points: summary, the text embedded, vector and point_id. Models see `batch` rows at a time."""
    schema = "node_id string, place int, vector array<double>, summary string, formatted_embed_text string, name string, kind string, file_path string, signature string, docstring string, identifiers array<string>"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].copy()
                summaries = [s.strip() for s in summarizer(part["signature"].tolist())]
                part["summary"] = summaries
                part["formatted_embed_text"] = [f"{sig}\n\n{s}" if s else "" for sig, s in zip(part["signature"], summaries, strict=True)]
                shown = [t or s or sig for t, s, sig in zip(part["formatted_embed_text"], summaries, part["signature"], strict=True)]
                part["vector"] = [list(map(float, v)) for v in embedder(shown)]
                yield part.rename(columns={"id": "node_id"})[names]

    made = rows.select("id", "place", "name", "kind", "file_path", "signature", "docstring", "identifiers").mapInPandas(run, schema)
    return made.select(hashing.uuid5(F.col("node_id")).alias("point_id"), "*", F.lit(workspace_id).cast("bigint").alias("workspace_id"), F.lit(branch_id).cast("bigint").alias("branch_id"))
