"""What a worker holds at once is bounded: batches and slices of texts, and the codec only while texts are encoded."""

from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from fernweave.llm import packing, tokens

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("own, most", [(None, 5 << 20), ("1m", 2 << 20)])
def test_a_stage_hands_workers_short_batches(spark, own, most):
    import corpus_pipeline

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    docs = spark.range(0, 200, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 20000) AS text")
    before = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, own) if own else spark.conf.unset(BATCH)
        got = corpus_pipeline.stage(lambda _, rows, __: rows.mapInArrow(sizes, "n bigint, bytes bigint"))(spark, docs, "").collect()
    finally:
        spark.conf.set(BATCH, before)
    assert sum(r.n for r in got) == 200
    assert max(r.bytes for r in got) < most


@pytest.fixture(scope="module")
def tokenizer():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def test_slices_are_short_and_hold_every_text(tokenizer):
    codec = tokens.WordCodec(tokenizer)
    texts = pa.array([f"Text {i}: " + "one two, three " * 60_000 for i in range(5)] + [None, ""])
    parts = list(codec.encode_slices(texts))
    size = [len(t or "") for t in texts.to_pylist()]
    assert [a for a, *_ in parts] == [0, *(b for _, b, *_ in parts[:-1])] and parts[-1][1] == len(texts)
    assert all(sum(size[a:b]) <= 2 << 20 for a, b, *_ in parts)
    ids, sizes = codec.encode_array(texts)
    assert np.array_equal(np.concatenate([p[2] for p in parts]), ids) and np.array_equal(np.concatenate([p[3] for p in parts]), sizes)


def test_no_codec_is_left_when_keys_are_drawn(tokenizer):
    tokens.codec_of(tokenizer)
    stats = SimpleNamespace(value=(np.zeros(4), np.zeros(4, np.int64), 1.0))
    assert list(packing._keyed(stats, packing.Settings())(iter([]))) == []
    assert tokens.codec_of.cache_info().currsize == 0
