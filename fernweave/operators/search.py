"""Semantic search: exact cosine top-k behind payload filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.functions import hashing, vectors

#: The bounds of a request.
TOP_K_DEFAULT, TOP_K_MAX = 5, 50


def top_k(table: DataFrame, query: Sequence[float], k: int = TOP_K_DEFAULT, where: Column | None = None, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k rows of largest cosine, with score; ties go to the smaller id. No row for a null or zero vector."""
    if not 1 <= k <= TOP_K_MAX:
        raise ValueError(f"k must be from 1 to {TOP_K_MAX}")
    rows = table if where is None else table.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("score", vectors.cosine(F.col(vector_column), q)).where(F.col("score").isNotNull()).orderBy(F.desc("score"), id_column).limit(k)


#: Vectors that one task compares with a block of queries, beyond one block.
_PART = 50_000


def top_k_batch(table: DataFrame, queries: DataFrame, k: int = TOP_K_DEFAULT, id_column: str = "vec_id", vector_column: str = "embedding", max_queries: int = 10_000) -> DataFrame:
    """query_id, rank, id, score for each row of queries (query_id, query); ties go to the smaller id.

    Exact, so every vector meets every query. Up to max_queries of them are broadcast to where the vectors are; more stay a
    table, and blocks of queries meet parts of the vectors, of bounded size both. Either way a task multiplies matrices and
    keeps k rows a query. Scores that agree to 12 digits are ties. Null and zero vectors take no part, nor do those of
    another length than the queries.
    """
    spark, n = table.sparkSession, queries.count()
    key, kind = queries.schema["query_id"].dataType.simpleString(), table.schema[id_column].dataType.simpleString()
    rows = table.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull())
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query"))
    schema = f"query_id {key}, id {kind}, score double"
    if n <= max_queries:
        held = spark.sparkContext.broadcast(asked.toArrow())
        found = rows.mapInArrow(lambda batches: _nearest(held.value, batches, k), schema)
    else:
        # A quarter more than needed, as both are dealt by hash.
        blocks, parts = -(-5 * n // (4 * max_queries)), -(-5 * rows.count() // (4 * _PART)) or 1
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        of = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
        left = asked.withColumn("block", of("query_id", blocks)).select("*", every(parts).alias("part"))
        right = rows.withColumn("part", of("id", parts)).select("*", every(blocks).alias("block"))

        def meet(q: pa.Table, v: pa.Table) -> pa.Table:
            made = list(_nearest(q.select(["query_id", "query"]), v.select(["id", "vector"]).to_batches(4_096), k))
            empty = {"query_id": pa.array([], q.schema.field("query_id").type), "id": pa.array([], v.schema.field("id").type), "score": pa.array([], pa.float64())}
            return pa.Table.from_batches(made) if made else pa.table(empty)

        found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")


def _matrix(lists: pa.Array, dims: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the lists that are usable, and where they stand: without nulls, not zero, of dims components."""
    values = lists.to_pylist()
    at = [i for i, v in enumerate(values) if v and None not in v and len(v) == (dims or len(v))]
    if dims is None and at:
        at = [i for i in at if len(values[i]) == len(values[at[0]])]
    if not at:
        return np.zeros((0, dims or 0)), np.zeros(0, np.int64)
    x = np.array([values[i] for i in at], float)
    length = np.linalg.norm(x, axis=1)
    return x[length > 0] / length[length > 0, None], np.array(at, np.int64)[length > 0]


def _nearest(asked: pa.Table, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each query's k nearest of some vectors (id, vector), and those that tie with the last."""
    names = asked.column(0).combine_chunks()
    q, kept = _matrix(asked.column(1).combine_chunks(), None)
    if not len(q):
        return
    names, worst, best = names.take(pa.array(kept)), np.full(len(q), -np.inf), None
    for batch in batches:
        x, at = _matrix(batch.column(1), q.shape[1])
        own = batch.column(0).take(pa.array(at))
        for first in range(0, len(x), 4_096):
            score = q @ x[first : first + 4_096].T
            ids = own.slice(first, score.shape[1])
            few, close = min(k + 1, score.shape[1]), np.round(score, 12)
            # All that are not below the k-th, so that ties reach the order by id; one more, for a query may meet itself.
            bar = np.maximum(np.partition(close, -few, axis=1)[:, -few], worst)
            j, i = np.nonzero(close >= bar[:, None])
            new = pa.table({"j": j, "id": ids.take(pa.array(i)), "close": close[j, i], "score": score[j, i], "name": names.take(pa.array(j))})
            new = new.filter(pc.fill_null(pc.not_equal(new.column("name").cast(pa.string()), new.column("id").cast(pa.string())), True)).drop_columns("name")
            best = new if best is None else pa.concat_tables([best, new])
        if best is not None and best.num_rows > 8 * k * len(q):
            best, worst = _first(best, k, len(q))
    if best is not None:
        best, _ = _first(best, k, len(q))
        yield from pa.table({"query_id": names.take(best.column("j").combine_chunks()), "id": best.column("id"), "score": best.column("score")}).to_batches()


def _first(rows: pa.Table, k: int, n: int) -> tuple[pa.Table, np.ndarray]:
    """The first k rows of each query by score and id, and the k-th score of those that have so many."""
    rows = rows.sort_by([("j", "ascending"), ("close", "descending"), ("id", "ascending")])
    j = rows.column("j").to_numpy()
    place = np.arange(len(j)) - np.searchsorted(j, j)
    worst = np.full(n, -np.inf)
    last = place == k - 1
    worst[j[last]] = rows.column("close").to_numpy()[last]
    return rows.filter(pa.array(place < k)), worst


def payload_filter(workspace_id: int | None = None, branch_id: int | None = None) -> Column:
    out = F.lit(True)
    for name, value in (("workspace_id", workspace_id), ("branch_id", branch_id)):
        if value is not None:
            out = out & (F.col(name) == value)
    return out


def hits(found: DataFrame) -> DataFrame:
    """Search rows with the defaults of absent payload fields."""
    text = {"name": "unnamed", "kind": "unknown", "file_path": "", "signature": ""}
    return found.select("node_id", "score", *(F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in text.items()), "summary", "docstring", F.coalesce("identifiers", F.array().cast("array<string>")).alias("identifiers"))


def upsert_points(points: DataFrame, new: DataFrame, version: str = "version") -> DataFrame:
    """points and new keyed by point_id; the latest version stays (a partial maximum), rows without a vector are left out."""
    rows = points.unionByName(new.where(F.col("vector").isNotNull()))
    rest = [c for c in rows.columns if c != "point_id"]
    last = rows.groupBy("point_id").agg(F.max_by(F.struct(*rest), version).alias("last"))
    return last.select(*(F.col(c) if c == "point_id" else F.col(f"last.{c}").alias(c) for c in rows.columns))


def search(points: DataFrame, query: str, embed: Callable[[str], Sequence[float]], top_k_: int = TOP_K_DEFAULT, workspace_id: int | None = None, branch_id: int | None = None) -> DataFrame:
    """The hits of a query text among points, within a workspace or a branch if given. A blank query has none."""
    none = not query or not query.strip()
    rows = points.where(payload_filter(workspace_id, branch_id) & F.lit(not none))
    vector = embed(query) if not none else [1.0]
    found = top_k(rows, vector, top_k_, id_column="node_id", vector_column="vector")
    return hits(found)


def search_branch(points: DataFrame, branches: DataFrame, query: str, embed: Callable[[str], Sequence[float]], repository_id: int, branch_name: str, top_k_: int = TOP_K_DEFAULT) -> DataFrame:
    """search() within the branch of this repository and name; an unknown branch has no hits."""
    branch = branches.where((F.col("repository_id") == repository_id) & (F.col("name") == branch_name)).select(F.col("id").alias("branch_id"))
    return search(points.join(branch, "branch_id", "left_semi"), query, embed, top_k_)


def point_ids(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("point_id", hashing.uuid5(F.col("node_id")))
