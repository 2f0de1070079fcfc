"""The registered queries that SQL cannot express, each on the smallest whole tables, against a version of one process."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fernweave.llm import language_id, quality_rules
from fernweave.llm.queries import QUERIES
from test_search_operators import components
from test_text_operators import brute_base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def little(ids):
    return np.array(ids, "<u4").tobytes()


def test_op1(spark, docs):
    got = [tuple(r) for r in QUERIES["op1_jaccard_join"](spark, SF).collect()]
    assert sorted(got, key=str) == components([(r.doc_id, r.text) for r in docs], 3, 90)


def test_op3(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = {}, {}
    for p in QUERIES["op3_packing"](spark, SF).collect():
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for r in docs:
        ids, at = [*ids_of(library, r.text), 1], 0
        for p in sorted(by_doc.pop(r.doc_id), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(little(ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    assert not by_doc
    total = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        total += at
    assert total > 0.98 * 2048 * (len(by_sequence) - 1)


def test_op4(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs:
        ids = ids_of(library, r.text)
        want[r.doc_id, len(ids), hashlib.sha256(little(ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op4_bpe"](spark, SF).collect()) == want


def test_op5(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None}
    rows = {i: v for i, v in rows.items() if np.isfinite(v).all() and v.any()}
    found = {}
    for r in QUERIES["op5_ann"](spark, SF).collect():
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == {i for i in rows if i % 50 == 0}
    hits = 0
    for q, got in found.items():
        score = {i: float(v @ rows[q] / (np.linalg.norm(v) * np.linalg.norm(rows[q]))) for i, v in rows.items() if i != q}
        best = sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]
        got.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and all(abs(r.score - score[r.vec_id]) < 1e-12 for r in got)
        hits += len(set(best) & {r.vec_id for r in got})
    assert hits >= 0.9 * 5 * len(found)


def test_op6(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in QUERIES["op6_token_orc"](spark, SF).collect()}
    at = 0
    for r in sorted(docs, key=lambda r: r.doc_id):
        ids = [*ids_of(library, r.text), 2]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(little(ids)))
        at += len(ids)


def test_op8(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, SF).collect()}
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    right = []
    for r in docs:
        x = got[r.doc_id]
        assert x.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        words = (r.text or "").split()
        grams = [language_id.subwords(language_id.letters_only([w]), model.settings.buckets, model.settings.longest)[0] for w in words]
        grams = np.concatenate(grams) if grams else np.zeros(0, int)
        if not len(grams):
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        p = model.probabilities(model.table[grams].astype(float).mean(axis=0) + model.bias)
        assert x.lang_pred == model.languages[p.argmax()] and abs(x.score - p.max()) < 1e-6
        if x.held_out and r.lang and len(words) > 3:
            right.append(x.lang_pred == r.lang)
    assert np.mean(right) > 0.95


def test_op9(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op9_quality_rules"](spark, SF).collect()}
    model = quality_rules.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    for r in docs:
        x, (n, *rest) = got[r.doc_id], brute_base(r.text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (n, *rest)
        failed = n < 10 or 100 * rest[3] > 20 * n
        anomaly = model.forest.score(quality_rules.statistics(r.text or "")[1][None])[0]
        assert x.base_failed == failed and x.kept == (not failed and anomaly <= model.threshold)


#: What tells personal data in the test tables, plainly written.
PLAIN = {"mail": r"[\w.]+@[\w.]+\.com", "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}", "secret": r'token = "([0-9a-f]{40})'}


def test_op10(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op10_pii"](spark, SF).collect()}
    assert set(got) == {r.doc_id for r in docs}
    image, found = {}, 0
    for r in docs:
        old, new = r.text or "", got[r.doc_id].text or ""
        if not got[r.doc_id].n_pii:
            assert old == new and not any(re.search(p, old) for p in PLAIN.values())
        for kind, pattern in PLAIN.items():
            before, after = re.findall(pattern, old), re.findall(pattern, new)
            assert len(before) == len(after)
            for a, b in zip(before, after, strict=True):
                found += 1
                assert a != b and image.setdefault((kind, a), b) == b
    assert found > 5 and len({(k, b) for (k, _), b in image.items()}) == len(image)
