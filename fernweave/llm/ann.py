"""Approximate nearest neighbours: inverted lists scanned by rotated dimension blocks with early abandoning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.llm.common import stash


@dataclass(frozen=True)
class Settings:
    k: int = 5
    #: Bound of the sample that the lists' centres are learned from; every row is indexed.
    sample: int = 20_000
    #: Lists: the root of the number of rows, but sample / rows_per_list at most.
    rows_per_list: int = 8
    #: Of the sample's nearest neighbours, the share that lies in the probed lists: so many lists are probed as this takes.
    #: Vectors without clusters need most of them, clustered ones few; measured recall: README.
    reach: float = 0.96
    #: Sample rows that this is measured on.
    trials: int = 512
    #: Dimensions read between two tests, and the tests' slack: in how many standard errors a partial distance may lie
    #: above the bar before its candidate is given up.
    block: int = 16
    slack: float = 2.1
    rounds: int = 8
    seed: int = 3
    #: Rows of a list in one task, about; queries that are measured side by side.
    part: int = 20_000
    queries: int = 64


def usable(vector: Column) -> Column:
    """Holds no null and no non-finite component, and isn't null, empty or zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@dataclass(frozen=True)
class Index:
    """rotation: a random orthogonal matrix; centres: of the lists, rotated unit vectors; probes: lists read for a query."""

    rotation: np.ndarray
    centres: np.ndarray
    probes: int
    settings: Settings

    def turn(self, vectors: np.ndarray) -> np.ndarray:
        return (_unit(vectors) @ self.rotation).astype(np.float32)


def fit(vectors: np.ndarray, rows: int, settings: Settings = Settings()) -> Index:
    """Spherical k-means on a bounded sample of rows, and the probes that the sample's own neighbours need."""
    s, rng = settings, np.random.default_rng(settings.seed)
    dim = vectors.shape[1]
    rotation, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    x = np.unique((_unit(vectors) @ rotation).astype(np.float32), axis=0)
    lists = max(1, min(int(np.sqrt(rows)), len(x) // s.rows_per_list))
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(s.rounds):
        of = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, of, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.maximum(norm, 1e-12), centres).astype(np.float32)
    asked = rng.choice(len(x), min(s.trials, len(x)), replace=False)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -np.inf
    k = min(s.k, len(x) - 1)
    if not k:
        return Index(rotation, centres, len(centres), s)
    found = np.argpartition(-near, k - 1, axis=1)[:, :k]
    # At which place of a query's order of lists each neighbour's list stands.
    order = np.argsort(-(x[asked] @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)[np.arange(len(asked))[:, None], (x @ centres.T).argmax(axis=1)[found]]
    return Index(rotation, centres, int(np.quantile(place, s.reach, method="higher")) + 1, s)


class Scan:
    """The candidates of one list part, rotated, in column blocks."""

    def __init__(self, index: Index, ids: np.ndarray, vectors: np.ndarray, turned: np.ndarray):
        s = index.settings
        self.s, self.ids = s, ids
        # A power of two takes no digit away, and squares don't overflow.
        self.vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        dim = turned.shape[1]
        self.edges = [*range(0, dim, s.block), dim]
        self.columns = [np.ascontiguousarray(turned[:, a:b]) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]
        self.lengths = [np.einsum("ij,ij->i", c, c) for c in self.columns]

    def nearest(self, queries: np.ndarray, turned: np.ndarray, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query ids and exact cosines of the k nearest that the tests let through."""
        s, n, dim = self.s, len(self.ids), self.edges[-1]
        queries = np.ldexp(queries, -np.frexp(np.abs(queries).max(axis=1, keepdims=True))[1])
        # The bar: the k-th distance among a first few, fully measured.
        first = np.arange(min(n, max(64, 4 * s.k)))
        bar = np.full(len(queries), np.inf)
        for i, query in enumerate(queries):
            scores = self._exact(query, first)
            scores[self.ids[first] == own[i]] = -2
            if len(first) >= s.k:
                bar[i] = 2 - 2 * np.sort(scores)[-s.k]
        partial, live = np.zeros((len(queries), n), np.float32), self.ids[None, :] != own[:, None]
        for at, block in enumerate(self.columns):
            left = np.flatnonzero(live.any(axis=0))
            part = turned[:, self.edges[at] : self.edges[at + 1]]
            partial[:, left] += np.maximum(0, self.lengths[at][left] - 2 * (part @ block[left].T) + np.einsum("ij,ij->i", part, part)[:, None])
            done = self.edges[at + 1]
            # Of a random rotation's first d of D coordinates, distance is partial * D / d but for a relative error
            # of about slack / sqrt(d): beyond it the hypothesis "nearer than the bar" is rejected.
            reach = bar * (done / dim) * (1 + s.slack / np.sqrt(done)) ** 2 + 1e-5 if done < dim else bar * (1 + 1e-4) + 2e-5
            live &= partial <= reach[:, None]
        return [self._best(query, np.flatnonzero(live[i]), partial[i]) for i, query in enumerate(queries)]

    def _best(self, query: np.ndarray, live: np.ndarray, partial: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Single-precision distances choose what to measure exactly; ties with the k-th stay in."""
        if len(live) > self.s.k:
            kth = np.partition(partial[live], self.s.k - 1)[self.s.k - 1]
            live = live[partial[live] <= kth * (1 + 1e-4) + 2e-5]
        scores = self._exact(query, live)
        best = np.lexsort((self.ids[live], -scores))[: self.s.k]
        return self.ids[live][best], scores[best]

    def _exact(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return (self.vectors[rows] * query).sum(axis=1) / (self.norms[rows] * np.sqrt((query * query).sum()))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _sample(vectors: DataFrame, s: Settings) -> np.ndarray:
    n = vectors.count()
    draw = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    rows = vectors.where(draw < 1.1 * s.sample / max(n, 1)).select("vec_id", "embedding").toPandas()
    rows = rows.sort_values("vec_id").head(s.sample)
    return np.array(rows["embedding"].tolist(), np.float64)


def search(vectors: DataFrame, queries: DataFrame, settings: Settings = Settings(), id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of queries the k rows of vectors of largest cosine found.

    Each vector is in the list of its nearest centre; a query scans the lists of its nearest centres. Within a list,
    dimensions are read in blocks of the rotated space, and a hypothesis test on the partial distance gives candidates
    up early. Scores are exact cosines in double precision on the original vectors; ties go to the smaller id.

    A candidate with the query's own id is left out. Vectors that are null, empty, zero, of another length than most
    (they have no cosine with the rest), or hold null or non-finite components take no part, on either side. Repeated rows of one id count once (the
    smallest vector). Fewer than k candidates give all. Empty tables give an empty result. Large lists are dealt out in
    parts; a query meets each part of its lists, and each part returns k rows for it.
    """
    s = settings
    spark = vectors.sparkSession
    tidy = lambda df: df.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = f"query_id {kind}, vec_id {kind}, score double"
    base = stash(tidy(vectors), "vectors")
    dims = base.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    same = F.size("embedding") == dims["dim"]
    base = base.where(same)
    asked = stash(tidy(queries).where(same), "asked")
    index = fit(_sample(base, s), dims["count"], s)
    held = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            turned = held.value.turn(x) if len(x) else np.zeros((0, dims["dim"]), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((turned @ held.value.centres.T).argmax(axis=1).astype(np.int32))], ["vec_id", "embedding", "list"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = held.value.turn(_matrix(batch.column(1))) @ held.value.centres.T
            few = min(held.value.probes, near.shape[1])
            lists = np.argsort(-near, axis=1, kind="stable")[:, :few].astype(np.int32)
            at = pa.array(np.repeat(np.arange(batch.num_rows), few))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(lists.ravel())], ["vec_id", "embedding", "list"])

    listed = stash(base.mapInArrow(assign, f"vec_id {kind}, embedding array<double>, list int"), "lists")
    # One row for each list, so 2,500 at most: a list is parted by its own size, however many vectors are alike.
    parts = F.broadcast(listed.groupBy("list").agg(F.ceil(F.count("*") / s.part).cast("int").alias("parts")))
    probes = asked.mapInArrow(probe, f"vec_id {kind}, embedding array<double>, list int").join(parts, "list")
    probes = probes.select("vec_id", "embedding", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    listed = listed.join(parts, "list").select("vec_id", "embedding", "list", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, ids, scores = [], [], []
        if left.num_rows and right.num_rows:
            left = left.sort_by("vec_id").combine_chunks()
            x = _matrix(left.column("embedding"))
            own = np.array(left.column("vec_id").to_pylist())
            part = Scan(held.value, own, x, held.value.turn(x))
            asked = _matrix(right.column("embedding"))
            names, turned = np.array(right.column("vec_id").to_pylist()), held.value.turn(asked)
            for at in range(0, len(names), s.queries):
                some = slice(at, at + s.queries)
                for q, (found, score) in zip(names[some].tolist(), part.nearest(asked[some], turned[some], names[some]), strict=True):
                    queries += [q] * len(found)
                    ids += found.tolist()
                    scores += score.tolist()
        return pa.table({"query_id": pa.array(queries, left.schema.field("vec_id").type), "vec_id": pa.array(ids, left.schema.field("vec_id").type), "score": pa.array(scores, pa.float64())})

    hits = listed.groupBy("list", "part").cogroup(probes.groupBy("list", "part")).applyInArrow(scan, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
