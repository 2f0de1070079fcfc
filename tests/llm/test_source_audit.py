"""The source audit against sums over whole vocabularies in exact integers, over tiles of a few terms and sources."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fernweave.llm import source_audit as sa

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, s):
    docs, groups = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        terms = Counter(t.translate(UPPER) for t in TERM.findall(text or ""))
        docs[lang or ""].update(terms.keys())
        groups[lang or "", source or ""].update(terms)
    out = set()
    for lang in docs:
        kept = sorted((t for t, n in docs[lang].items() if n >= s.documents), key=str.encode)
        own = {g[1]: c for g, c in groups.items() if g[0] == lang}
        p_of = {}
        for source, c in [*own.items(), (None, sum((Counter(c) for c in own.values()), Counter()))]:
            total = sum(c[t] for t in kept)
            p_of[source] = {t: 1 + s.scale * (c[t] + s.smoothing) // (total + s.smoothing * len(kept)) for t in kept}
        for source, c in own.items():
            pairs = [(-sum(abs(p_of[source][t] - p_of[o][t]) for t in kept), o.encode(), o) for o in own if o != source]
            terms = [(-(p_of[source][t] - p_of[None][t]), t.encode(), t) for t in kept if c[t] and p_of[source][t] > p_of[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[: s.top])):
                out |= {(lang, source, part, item, -value, i) for i, (value, _, item) in enumerate(found, 1)}
    return out


def made(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "été", "ÉTÉ", "naïve", "日本語", "x", "don't", "a1b2", "🙂x", "Zoo", "ßen", "under_score", "é", "z"] + [f"w{c}{d}" for c in "abcdefgh" for d in "xyz"]
    rows = []
    for i in range(n):
        text = rng.choice([None, "", " 123 "]) if rng.random() < 0.1 else " ".join(rng.choices(words, k=rng.randint(1, 12)))
        rows.append((i, text, rng.choice(["en", "en", "en", "de", "", None]), rng.choice(["s1", "s2", "S3", "é", "", None, "s4", "s5"]), 0, "clash"))
    return rows + rows[:3] + [(None, None, "fr", "only", 0, "clash"), (None, None, "fr", "other", 0, "clash"), (7, "alone", "xx", None, 0, "clash")]


@pytest.mark.parametrize("settings", [sa.Settings(documents=5), sa.Settings(documents=4, terms=3, sources=2, top=4, held=10), sa.Settings(documents=1, terms=7, sources=1)])
def test_small_tiles(spark, settings):
    rows = made(1, 160)
    got = [tuple(r) for r in sa.audit_sources(spark.createDataFrame(rows, SCHEMA), settings).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, settings)


def test_empty_table(spark):
    out = sa.audit_sources(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and not out.collect()


def test_pieces_of_long_texts():
    text = ("Straße und, " * 200_000 + "x" * 3_000_000 + " end").encode()
    assert sa.term_counts(text) == Counter({"straße".encode(): 200_000, b"und": 200_000, b"x" * 3_000_000: 1, b"end": 1})


def test_probability_is_exact_for_large_counts():
    s, rng = sa.Settings(), random.Random(2)
    for total in (1, 10**9, 10**13, 8 * 10**15):
        counts = [0, 1, total, *(rng.randint(0, total) for _ in range(200))]
        got = sa.probability(np.array(counts, np.int64), total, 1000, s)
        assert got.tolist() == [1 + s.scale * (c + 5) // (total + 5000) for c in counts]
