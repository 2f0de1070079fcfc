"""Circulant MinHash against all pairs; signatures estimate the similarity of sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernweave.llm import circulant_minhash as cm
from fernweave.llm.queries import QUERIES
from test_search_operators import components, corpus, shingles


@pytest.mark.parametrize(("seed", "k", "percent", "share"), [(1, 2, 80, 2000), (2, 5, 80, 3), (5, 1, 80, 2000), (6, 2, 80, 2)])
def test_components_equal_brute_force(spark, seed, k, percent, share):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("kept", F.lit("clash"))
    got = cm.link_documents(docs, cm.Settings(k=k, percent=percent, share=share)).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == components(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_registered_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op11_circulant_minhash"](spark, sf).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == components(docs, 2, 80)


def test_group_of_copies_that_all_differ(spark):
    """A chain of near copies: neighbours link, ends don't."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(120):
        rows.append((i, " ".join(words)))
        for _ in range(2):
            words[rng.randrange(200)] = f"w{rng.randrange(5000)}"
    rng.shuffle(rows)
    got = cm.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), cm.Settings()).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == components(rows, 2, 80)
    assert len({r.component_id for r in got}) == 1


def test_links_at_the_bound(spark):
    """8 of 10 shingles shared link, 79 of 100 don't, and sets too small to differ link with equal ones only."""
    word = lambda i: f"x{i}"
    rows = [(1, " ".join(map(word, range(9)))), (2, " ".join(map(word, range(11)))), (3, " ".join(word(100 + i) for i in range(80))), (4, " ".join(word(100 + i) for i in range(101))), (5, "p q r s"), (6, "p q r s t"), (7, "Q"), (8, "q")]
    got = {r.doc_id: r.component_id for r in cm.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7}


def test_empty_table(spark):
    out = cm.link_documents(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and not out.collect()


def test_signatures_estimate_similarity():
    rng, circulant = np.random.default_rng(1), cm.Circulant(cm.Settings())
    for share in (0.2, 0.5, 0.8, 0.95):
        errors = []
        for _ in range(30):
            n = 400
            both = round(2 * n * share / (1 + share))
            x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            a, b = x[:n], x[n - both :]
            errors.append((circulant.signature(a) == circulant.signature(b)).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    # Pairs just at the bound share a band.
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        assert (circulant.bands(x[:90]) == circulant.bands(x[10:])).any()


def test_signature_is_the_least_over_shifts():
    circulant = cm.Circulant(cm.Settings(bits=10, bands=3, rows=4))
    rng = np.random.default_rng(2)
    x, y = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (3000, 7))
    assert (circulant.signature(np.concatenate([x, y])) == np.minimum(circulant.signature(x), circulant.signature(y))).all()
    pi = circulant.shifted[:, 0]
    assert sorted(pi.tolist()) == list(range(1 << 10))
    assert all((circulant.shifted[:, i] == np.roll(pi, -i)).all() for i in range(12))
    assert shingles("a b", 3)


def test_buckets_of_the_same_nodes_name_the_same_heads(spark):
    rows = [(h, None, node, 100) for h in range(20) for node in [*range(30), 99]]
    blocks = spark.createDataFrame(rows, "block long, hot long, node long, place long")
    label = spark.createDataFrame([(node, 0) for node in range(30)], "node long, label long")
    hubs = []
    for turn in (0, 1):
        got = cm._open(blocks, label, turn)[1].collect()
        assert len(got) == 20 and all(r.main == 0 and r.c == 31 and r.others == 1 for r in got)
        hubs.append({x.hub for r in got for x in r.heads})
    # So an outsider meets three of them at most in all its buckets together, and others in the next turn.
    assert all(1 <= len(x) <= 3 for x in hubs) and hubs[0] != hubs[1]
