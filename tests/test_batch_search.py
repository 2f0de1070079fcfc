"""Batch search against every pair: broadcast queries, and blocks of queries that meet parts of vectors."""

import numpy as np
import pytest

from fernweave.operators import search


@pytest.mark.parametrize(("most", "part"), [(100, 50_000), (7, 50_000), (5, 20)])
def test_every_pair(spark, monkeypatch, most, part):
    monkeypatch.setattr(search, "_PART", part)
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (90, 4)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 4), (202, [1.0, None, 2.0, 3.0]), (203, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = table.where("vec_id % 4 = 0 or vec_id > 200").withColumnsRenamed({"vec_id": "query_id", "embedding": "query"})
    got = {}
    for r in search.top_k_batch(table, asked, 6, max_queries=most).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and None not in v and len(v) == 4 and any(v)}
    want = {}
    for q in unit:
        if q % 4 == 0:
            near = sorted(((-round(float(unit[q] @ u), 12), i) for i, u in unit.items() if i != q))[:6]
            want[q] = [(n, i) for n, (_, i) in enumerate(near, 1)]
    assert {q: [r[:2] for r in sorted(v)] for q, v in got.items()} == want


def test_no_queries(spark):
    table = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    asked = table.where("vec_id > 1").withColumnsRenamed({"vec_id": "query_id", "embedding": "query"})
    assert not search.top_k_batch(table, asked).collect()
    names = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1])], "vec_id string, embedding array<double>")
    got = search.top_k_batch(names, names.withColumnsRenamed({"vec_id": "query_id", "embedding": "query"}), 1).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [("a", "b"), ("b", "a")]
