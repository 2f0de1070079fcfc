"""The Jaccard join and the vector search against brute force, and the pipeline's stages on a small corpus."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernweave.llm import ann, jaccard_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset() if not words else frozenset([tuple(words)]) if len(words) < k else frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(own) if sets[i] and own else doc))
    return sorted(out, key=str)


def corpus(seed, bases=6, copies=12):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = " ".join(r.choices(vocabulary, k=12))
    rows = []
    for _ in range(bases):
        base = r.choices(vocabulary, k=r.choice([9, 12, 40, 120]))
        for c in range(copies):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((" ".join(words).title() if c % 3 == 0 else " ".join(words)) + (" " + shared if c % 4 == 0 else ""))
    rows += [None, "", " \t\n", "one", "One", "one two", "one two", "A b c", "a B c", "é É", "É é"]
    ids = r.sample(range(1_000), len(rows))
    return [*zip(ids, rows, strict=True), (None, "one two"), (None, "lonely text here"), (ids[0], "same id other text")]


@pytest.mark.parametrize(("seed", "k", "percent", "settings"), [(1, 3, 90, {}), (2, 5, 80, {}), (3, 3, 90, {"block": 2, "sketch_bits": 15}), (4, 1, 60, {"sketch_bits": 15})])
def test_components_equal_brute_force(spark, seed, k, percent, settings):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = jaccard_join.link_documents(docs, jaccard_join.Settings(k=k, percent=percent, **settings)).collect()
    assert sorted((tuple(r) for r in got), key=str) == components(rows, k, percent)


def test_similar_pairs_equal_brute_force(spark):
    rows, k, percent = corpus(7), 3, 70
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links, members = jaccard_join.similar_pairs(docs, jaccard_join.Settings(k=k, percent=percent, share=7))
    sets, named = {}, {}
    for r in members.collect():
        named.setdefault(r.node, []).append(r.doc_id)
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, []).append(shingles(text, k))
    assert sorted((str(x) for m in named.values() for x in m)) == sorted(str(d) for d, _ in rows)
    for node, docs_ in named.items():
        own = set.intersection(*(set(texts[d]) for d in docs_))
        assert node is None and own == {frozenset()} or len(own) == 1 or len(docs_) == 1
        sets[node] = next(iter(own)) if len(own) == 1 else None
    got = {frozenset((r.node_a, r.node_b)): (r.shared, r.joint) for r in links.collect()}
    distinct = [(n, x) for n, x in sets.items() if n is not None and x]
    want = {frozenset((n, m)): (len(x & y), len(x | y)) for i, (n, x) in enumerate(distinct) for m, y in distinct[:i] if 100 * len(x & y) >= percent * len(x | y)}
    assert len(want) > 20 and {p: v for p, v in got.items() if all(sets[n] is not None for n in p)} == want


def test_components_of_long_chains(spark):
    names = list(range(1_003))
    random.Random(5).shuffle(names)
    chain, pair = names[:1_000], names[1_001:]
    links = spark.createDataFrame([*zip(chain, chain[1:]), tuple(pair), tuple(pair[::-1])], "a long, b long").coalesce(1)
    got = {r.node: r.label for r in jaccard_join.components(links).collect()}
    assert got == {**dict.fromkeys(chain, min(chain)), **dict.fromkeys(pair, min(pair))}
    assert jaccard_join.components(links.limit(0)).count() == 0


def test_many_copies_and_very_long_texts(spark):
    """50,000 copies of one text among variants of it, and texts of a megabyte that differ in a word."""
    r = random.Random(9)
    base = [f"w{r.randrange(500)}" for _ in range(60)]
    variants = [" ".join(base[:i] + ["new"] + base[i + 1 :]) for i in (0, 59)] + [" ".join(base[:30])]
    long = [f"v{r.randrange(10_000)}" for _ in range(160_000)]
    texts = [*variants, " ".join(long), " ".join(long[:-1] + ["other"]), " ".join(long[:80_000])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(spark.range(100, 50_100).select("id", F.lit(" ".join(base))))
    got = jaccard_join.link_documents(docs).groupBy("component_id").agg(F.count("*").alias("c"), F.min("doc_id").alias("least")).collect()
    assert sorted(tuple(x) for x in got) == [(0, 50_002, 0), (2, 1, 2), (3, 2, 3), (5, 1, 5)]
    pairs, members = jaccard_join.similar_pairs(docs)
    assert members.count() == 50_006 and pairs.count() == 4


def test_no_documents(spark):
    assert jaccard_join.link_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_filter_never_drops_a_match():
    rng = np.random.default_rng(0)
    for _ in range(200):
        universe = rng.integers(0, 1 << 63, 80, dtype=np.uint64) * np.uint64(2)
        a, b = (np.unique(rng.choice(universe, rng.integers(1, 60))) for _ in range(2))
        both = len(np.intersect1d(a, b))
        assert jaccard_join.overlap(a, b, both) == both


def vectors(seed, n=600, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[50:60] = x[49]
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


ODD = [(9_000, None), (9_001, []), (9_002, [0.0] * 16), (9_003, [float("nan")] * 16), (9_004, [1.0] * 3), (9_005, [float("inf")] + [1.0] * 15), (9_006, [None] * 16), (None, [1.0] * 16)]


def test_search_recall_scores_and_ties(spark):
    rows = vectors(1)
    table = spark.createDataFrame([*rows, *ODD, rows[7]], "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    asked = table.where("vec_id % 50 = 0")
    got = {}
    for r in ann.search(table, asked).collect():
        got.setdefault(r.query_id, []).append(r)
    x = np.array([v for _, v in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    assert set(got) == set(range(0, 600, 50))
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        exact = unit @ unit[q]
        exact[q] = -2
        best = sorted(range(len(rows)), key=lambda i: (-round(exact[i], 12), i))[:5]
        hits += len({r.vec_id for r in found} & set(best))
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5] and all(abs(r.score - exact[r.vec_id]) < 1e-12 for r in found)
        assert found == sorted(found, key=lambda r: (-r.score, r.vec_id))
    assert hits / (5 * len(got)) >= 0.9
    assert [r.vec_id for r in got[50]] == [49, 51, 52, 53, 54]


def test_search_of_parted_lists(spark):
    """A list of many like vectors is dealt out by its size; each part gives its own nearest."""
    rows = vectors(3, n=400)
    rows += [(1_000 + i, [1.0] + [0.0] * 15) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(table, table.where("vec_id IN (0, 1000)"), ann.Settings(part=40, reach=1.0)).collect()
    assert sorted(r.vec_id for r in got if r.query_id == 1_000) == [1_001, 1_002, 1_003, 1_004, 1_005]
    x = np.array([v for _, v in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = np.argsort(-(unit @ unit[0]))[1:6]
    assert len({r.vec_id for r in got if r.query_id == 0} & {rows[i][0] for i in best}) >= 4


def test_search_of_few_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in ann.search(table, table.where("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert ann.search(table.limit(0), table).count() == 0
    assert ann.search(table, table.limit(0)).count() == 0


def test_search_of_very_large_and_small_components(spark):
    rows = [(i, [float(np.cos(i)) * 10.0 ** (300 if i % 2 else -300), float(np.sin(i)) * 10.0 ** (300 if i % 2 else -300)]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(table, table.where("vec_id = 0"), ann.Settings(reach=1.0)).orderBy("rank").collect()
    want = sorted(range(1, 40), key=lambda i: -np.cos(i))[:5]
    assert [r.vec_id for r in got] == want and all(abs(r.score - np.cos(r.vec_id)) < 1e-12 for r in got)


ODD_DOCS = [(None, None, "en", "s", None), (None, "", None, None, 0), (7, "same words again and again", "en", "s", 1), (7, "same words again and again", "en", "t", 2), (8, None, "de", None, 3), (9, "x" * 200_000, "fr", "s", 4), (10, "12345 67890", "es", "s", 5)]


def test_pipeline_stages_of_odd_input(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, an empty table, and further columns with clashing names."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id >= 20").limit(60)
    odd = spark.createDataFrame(ODD_DOCS, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit(1) for c in ("node", "kept", "score", "rejected", "component_id", "m", "row", "n", "a.b", "label")}
    for name, docs in (("odd", real.unionByName(odd).withColumns(clash)), ("empty", real.limit(0).withColumns(clash))):
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.schema.names == docs.schema.names, stage_name
            out.write.parquet(path := str(tmp_path / f"{name}-{stage_name}"))
            kept = spark.read.parquet(path)
            if name == "empty":
                assert kept.count() == 0
            if stage_name == "pii" and name == "odd":
                assert kept.count() == docs.count()
            if stage_name == "near_duplicates" and name == "odd":
                assert kept.where("doc_id = 7").count() == 1 and kept.where("doc_id = 8").count() == 1
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert pieces.agg(F.sum("length")).first()[0] == (None if name == "empty" else pieces.select("doc_id", "doc_tokens", "start").where("start = 0").agg(F.sum("doc_tokens")).first()[0])


def test_pipeline_stages_against_one_process(spark, tmp_path):
    """Each stage against a plain version of it: the scorer and the forest row by row, all pairs, each surrogate's properties, all ids."""
    import corpus_pipeline
    import public_tokenizers
    from fernweave.llm import language_id, quality_rules
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema.names == docs.schema.names
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        before, after = {r.doc_id for r in rows}, {r.doc_id: r for r in kept.collect()}
        if name == "language_id":
            model = language_id.fit(docs)
            want = set()
            for r in rows:
                words = (r.text or "").split()
                grams = [language_id.subwords(language_id.letters_only([w]), 1 << 16, 4)[0] for w in words]
                grams = np.concatenate(grams) if grams else np.zeros(0, int)
                if len(grams) and model.probabilities(model.table[grams].astype(float).mean(axis=0) + model.bias).max() >= model.reject_below - 1e-9:
                    want.add(r.doc_id)
        elif name == "quality_rules":
            model = quality_rules.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            want = set()
            for r in rows:
                (n, _, _, _, repeated), features = quality_rules.statistics(r.text or "")
                if n >= 10 and 100 * repeated <= 20 * n and model.forest.score(features[None])[0] <= model.threshold:
                    want.add(r.doc_id)
        elif name == "near_duplicates":
            want = {c for _, _, c in components([(r.doc_id, r.text) for r in rows], 5, 80)}
        else:
            want = before
            changed = [(r.text, after[r.doc_id].text) for r in rows if r.text != after[r.doc_id].text]
            assert changed and all(after[r.doc_id].n_chars == len(after[r.doc_id].text) for r in rows)
            for old, new in changed:
                for mail in re.findall(r"[\w.]+@[\w.]+\.com", old):
                    assert mail not in new
        assert set(after) == want, name
        docs = kept
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for p in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect():
        pieces.setdefault(p.doc_id, []).append((p.start, p.ids))
    for r in docs.collect():
        assert [i for _, ids in sorted(pieces[r.doc_id]) for i in ids] == [*library.encode(r.text, add_special_tokens=False).ids, 1]
    assert corpus_pipeline.run(spark, sf).count() == sum(map(len, pieces.values()))


def test_packing_index_drops_used_pieces():
    import numpy as np

    from fernweave.llm import packing

    rng, s = np.random.default_rng(3), packing.Settings(window=64)
    pieces = [np.minimum(rng.zipf(1.3, rng.integers(1, 60)), 499).astype(np.uint32) for _ in range(200)]
    df = np.bincount(np.concatenate([np.unique(p) for p in pieces]), minlength=500)
    idf = np.log1p((200 - df + 0.5) / (df + 0.5))
    index = packing.ShardIndex(pieces, idf, 30.0, s)

    def plain(piece):
        out = np.zeros(200)
        for i, p in enumerate(pieces):
            ids, tf = np.unique(p, return_counts=True)
            both = np.isin(ids, pieces[piece])
            out[i] = (idf[ids] * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * len(p) / 30.0)))[both].sum()
        return out

    assert len(index.rows) and np.allclose(index.scores(7), plain(7))
    before = len(index.where)
    left = rng.random(200) < 0.4
    index.keep(left)
    assert index.held.tolist() == np.flatnonzero(left).tolist() and len(index.where) < 0.6 * before
    assert all(np.allclose(index.scores(i), plain(i)[left]) for i in (7, 50, 199))
    # All tokens are packed, each once, and every window but the last is full.
    windows = packing.pack_shard(pieces, idf, 30.0, s)
    assert all(sum(b - a for _, a, b in w) == 64 for w in windows[:-1])
    got = sorted((p, i) for w in windows for p, a, b in w for i in range(a, b))
    assert got == [(p, i) for p in range(200) for i in range(len(pieces[p]))]
