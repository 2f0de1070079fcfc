"""Interval labels, nested outlines and pre-order against walks in one process."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fernweave.operators import graph, ordering, trees

SCHEMA = "id long, parent_id long, name string, kind string, node_type string, rank int"


def forest(seed, n, roots=3):
    r = random.Random(seed)
    rows = [(i, None, f"f{i}", "file", "container", 0) for i in range(roots)]
    for i in range(roots, n):
        kind = r.choice(["class", "function", "variable"])
        rows.append((i, r.randrange(max(0, i - 12), i) if r.random() < 0.7 else r.randrange(roots), r.choice([f'n"{i}', None, "é"]), kind, {"class": "type-definition"}.get(kind, kind), r.randrange(3)))
    r.shuffle(rows)
    return rows


def walk(rows):
    """id to (tree, depth, first, last)."""
    children = {}
    for i, parent, *_, rank in rows:
        children.setdefault(parent, []).append((rank, i))
    out = {}

    def go(i, tree, depth, at):
        first = at
        at += 1
        for _, c in sorted(children.get(i, [])):
            at = go(c, tree, depth + 1, at)
        out[i] = (tree, depth, first, at)
        return at

    for _, root in children[None]:
        go(root, root, 0, 0)
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    rows = forest(1, 160)
    return rows, trees.label(spark.createDataFrame(rows, SCHEMA), ["rank", "id"]).checkpoint()


def test_labels(labelled):
    rows, labels = labelled
    assert {r.id: (r.tree, r.depth, r["first"], r["last"]) for r in labels.collect()} == walk(rows)


def test_below_and_above(spark, labelled, monkeypatch):
    rows, labels = labelled
    at = walk(rows)
    asked = spark.createDataFrame([(0,), (1,), (40,), (77,), (159,)], "id long")
    inside = lambda a, b: at[a][0] == at[b][0] and at[a][2] <= at[b][2] < at[a][3]
    for size in (4096, 7):
        monkeypatch.setattr(trees, "_BIN", size)
        got = sorted((r.root, r.id, r.level) for r in trees.below(labels, asked).collect())
        assert got == sorted((a, b, at[b][1] - at[a][1]) for a in (0, 1, 40, 77, 159) for b in at if inside(a, b))
        got = sorted((r.leaf, r.id, r.level) for r in trees.above(labels, asked).collect())
        assert got == sorted((b, a, at[b][1] - at[a][1]) for b in (0, 1, 40, 77, 159) for a in at if inside(a, b))


def test_callees_in_pre_order_with_doubles(spark, labelled):
    rows, labels = labelled
    at, r = walk(rows), random.Random(3)
    edges = [(r.randrange(160), r.randrange(160)) for _ in range(200)] + [(40, 5), (40, 5)]
    got = [tuple(x) for x in trees.callees(spark.createDataFrame(edges, "src long, dst long"), labels, spark.createDataFrame([(0,), (40,)], "id long")).collect()]
    for root in (0, 40):
        want = sorted((at[s][2], d, s) for s, d in edges if at[s][0] == at[root][0] and at[root][2] <= at[s][2] < at[root][3])
        assert sorted(x[1:] for x in got if x[0] == root) == [(i, s, d) for i, (_, d, s) in enumerate(want)]


def test_outline_json(labelled):
    rows, labels = labelled
    by_id = {row[0]: row for row in rows}
    children = {}
    for i, parent, *_, rank in rows:
        children.setdefault(parent, []).append((rank, i))

    def tree(i):
        return [{"id": c, "name": by_id[c][2], "type": by_id[c][3], "children": tree(c)} for _, c in sorted(children.get(i, [])) if by_id[c][4] in ("type-definition", "function")]

    got = {r.tree: json.loads(r.outline) for r in trees.outline_json(labels).collect()}
    assert got == {i: tree(i) for i in range(3)}


def test_deep_chain_and_lone_nodes(spark):
    rows = [(i, i - 1 if i else None, "x", "function", "function", 0) for i in range(40)] + [(100, 77, "no such parent", "k", "function", 0)]
    got = {r.id: (r.tree, r.depth, r["first"], r["last"]) for r in trees.label(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {**{i: (0, i, i, 40) for i in range(40)}, 100: (100, 0, 0, 1)}


def test_cycle_raises(spark):
    rows = [(1, 2, "", "", "", 0), (2, 3, "", "", "", 0), (3, 1, "", "", "", 0), (4, None, "", "", "", 0)]
    with pytest.raises(ValueError, match="cycle"):
        trees.label(spark.createDataFrame(rows, SCHEMA))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = trees.label(none)
    assert labels.columns == [*none.columns, "tree", "depth", "first", "last"] and not labels.collect()
    assert not trees.outline_json(labels).collect()


def test_running_sums_over_one_key(spark):
    rows = spark.range(1000).select(F.lit("k").alias("key"), F.col("id"), (F.col("id") % 7).alias("v")).repartition(5)
    got = {r.id: r.total for r in ordering.running(rows, "key", ["id"], F.col("v"), "total").collect()}
    assert got == {i: sum(j % 7 for j in range(i)) for i in range(1000)}


def test_subtree_has_no_depth_limit(spark):
    rows = [(1, None), (2, 1), (3, 2)]
    with pytest.raises(ValueError, match="cycle"):
        graph.subtree(spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id long, parent_id long"), spark.createDataFrame([(1,)], "id long")).collect()
    assert graph.subtree(spark.createDataFrame(rows, "id long, parent_id long"), spark.createDataFrame([(1,)], "id long")).count() == 3
