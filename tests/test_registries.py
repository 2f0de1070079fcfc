"""Measures of one's own, languages by pattern, the table of points, and chunking that refuses what does not fit."""

import fnmatch
import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fernweave.functions import measures
from fernweave.operators import chunking
from fernweave.sources import languages, parsing, points

_TOKEN = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff\s]")


#: A lambda, so that it goes to the workers as it is.
tokens = lambda part: len(_TOKEN.findall(part))
measures.register("token-of-tests", tokens)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80), st.integers(1, 6), st.data())
def test_furthest_end(source, most, data):
    at = data.draw(st.integers(0, len(source)))
    want = max(e for e in range(at, len(source) + 1) if tokens(source[at:e]) <= most)
    assert measures.furthest(tokens, source, at, len(source), most) == want


def test_names_are_given_once():
    for name in ("byte", "token-of-tests", ""):
        with pytest.raises(ValueError, match="measure"):
            measures.register(name, len)
    with pytest.raises(ValueError, match="unit is one of"):
        chunking.ChunkOptions(unit="page")


def test_chunks_by_a_registered_measure(spark):
    texts = {"a": "def f(x):\n    return x + 1\n\n" * 9, "b": "x" * 500, "c": "", "d": "é ü.ß\n" * 30}
    files = spark.createDataFrame([(k, "python", "python", bytearray(v.encode())) for k, v in texts.items()], "file_path string, language string, parser_name string, content binary")
    options = chunking.ChunkOptions(max_size=7, unit="token-of-tests")
    chunks = chunking.chunk_files(files, None, options)
    rows = chunks.orderBy("file_path", "chunk_index").collect()
    for k, v in texts.items():
        own = [r for r in rows if r.file_path == k]
        assert "".join(r.content for r in own) == v and all(r.size == tokens(r.content.encode()) <= 7 for r in own)
    assert all(r.is_exact for r in chunking.coverage(chunks, files, 7, "token-of-tests").collect())


def parsed(spark, source, **wrong):
    files = spark.createDataFrame([("a.py", "python", "python", bytearray(source))], "file_path string, language string, parser_name string, content binary")
    nodes = parsing.parse_files(files)
    return files, parsing.parse_results(files, parsing.diagnostics(files)), nodes


def test_chunking_of_parsed_files_raises_on_what_does_not_fit(spark):
    source = b"def f():\n    return 1\n\nclass C:\n    x = 1\n" * 5
    files, results, nodes = parsed(spark, source)
    options = chunking.ChunkOptions(max_size=40)
    got = chunking.chunk_parsed(files, results, nodes, options).orderBy("chunk_index").collect()
    assert "".join(r.content for r in got).encode() == source
    for bad, message in (
        ((files, results.withColumn("source_size_bytes", F.lit(3).cast("bigint")), nodes), "differ in length"),
        ((files, results.limit(0), nodes), "not parsed"),
        ((files, results, nodes.where("depth > 0")), "no root"),
        ((files, results, nodes.withColumn("end_byte", F.when(F.col("depth") == 0, F.lit(5)).otherwise(F.col("end_byte")).cast("bigint"))), "whole file"),
    ):
        with pytest.raises(Exception, match=message):
            chunking.chunk_parsed(*bad, options).collect()


def test_inexact_coverage_raises(spark, monkeypatch):
    files, results, nodes = parsed(spark, b"a = 1\nb = 2\n")
    whole = chunking.chunk_files(files, nodes)
    monkeypatch.setattr(chunking, "chunk_files", lambda *a: whole.withColumn("start_byte", F.col("start_byte") + 2))
    with pytest.raises(Exception, match="inexact coverage of a.py"):
        chunking.chunk_parsed(files, results, nodes).collect()
    assert chunking.chunk_parsed(files, results, nodes, verify=False).count() == 1


NAMES = ["a.py", "src/A.PY", "Dockerfile", "dockerfile.dev", "x.test.ts", "x.ts", "x.tsx", "y.d.ts", ".py", "py", "a.b.mjs", "q[1].py", "make", "a\\b\\c.js", " t.cts ", "", "x.py\n"]


def test_first_registered_wins(spark):
    own = languages.Registry((languages.Language("docker", ("Dockerfile*", "*.[Dd]ocker")), languages.Language("tests", ("*.test.ts", "?.test.js")), languages.Language("typescript", suffixes=(".ts", ".tsx")), languages.Language("late", ("x.ts",), (".py",))))
    got = {r.p: r.language for r in spark.createDataFrame([(n,) for n in NAMES], "p string").select("p", own.language(F.col("p")).alias("language")).collect()}

    def want(path):
        name = path.strip(" ").replace("\\", "/").rsplit("/", 1)[-1].lower()
        for x in own.languages:
            if any(fnmatch.fnmatchcase(name, p.lower()) for p in x.patterns) or any(name.endswith(s) and len(name) > len(s) for s in x.suffixes):
                return x.name
        return None

    assert got == {n: want(n) for n in NAMES} and got["x.ts"] == "typescript" and got["x.test.ts"] == "tests"
    got = {r.p: (r.a, r.b) for r in spark.createDataFrame([(n,) for n in NAMES], "p string").select("p", languages.DEFAULT.language(F.col("p")).alias("a"), languages.DEFAULT.parser_name(F.col("p")).alias("b")).collect()}
    assert got["x.tsx"] == ("typescript", "tsx") and got["x.ts"] == ("typescript", "typescript") and got["src/A.PY"] == ("python", "python") and got["make"] == (None, None)
    with pytest.raises(Exception, match="unsupported language: make"):
        spark.createDataFrame([("make",)], "p string").select(own.required(F.col("p"))).collect()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab*?[]!.^&-", max_size=7), st.lists(st.text(alphabet="ab.^&-![]", max_size=5), max_size=6))
def test_patterns_as_regular_expressions(glob, texts):
    if re.search(r"\[!?\]?[^\]]*-[^\]]*\]|\[[^\]]*$|\[!?\]|\[\^|&&|--", glob):
        return
    for t in texts:
        assert bool(re.fullmatch(languages.pattern(glob), t, re.S)) == fnmatch.fnmatchcase(t, glob)


def test_what_is_registered_twice(spark):
    own = languages.Registry((languages.Language("a", ("x*",), (".q",)), languages.Language("A", ("X*", "y"), (".r",)), languages.Language(" ", (), (".q",))))
    got = {(r.kind, r.value): r.languages for r in own.violations(spark).collect()}
    assert got == {("name", "a"): ["a", "A"], ("name", " "): [" "], ("pattern", "x*"): ["a", "A"], ("suffix", ".q"): ["a", " "]}
    assert not languages.DEFAULT.violations(spark).collect()


POINTS = "point_id string, vector array<float>, version long, name string"


def test_table_of_points(spark, tmp_path):
    folder = str(tmp_path / "points")
    with pytest.raises(FileNotFoundError):
        points.upsert(folder, spark.createDataFrame([], POINTS))
    assert points.ensure_table(spark, folder, 2, 8) == points.ensure_table(spark, folder, 2) == {"dimensions": 2, "buckets": 8, "distance": "cosine"}
    with pytest.raises(ValueError, match="2 components, not 3"):
        points.ensure_table(spark, folder, 3)
    first = spark.createDataFrame([(f"p{i}", [1.0, float(i)], 1, "old") for i in range(40)] + [("none", None, 1, "x")], POINTS)
    assert points.upsert(folder, first) == 40
    read = lambda: {r.point_id: (r.version, r.name) for r in points.read_points(spark, folder, first.schema).collect()}
    assert read() == {f"p{i}": (1, "old") for i in range(40)}
    before = {d: sorted(os.listdir(f"{folder}/{d}")) for d in os.listdir(folder) if d.startswith("bucket")}
    second = spark.createDataFrame([("p3", [0.0, 1.0], 2, "new"), ("p4", [0.0, 1.0], 0, "older"), ("q", [5.0, 5.0], 1, "added")], POINTS)
    for _ in range(2):
        assert points.upsert(folder, second) == 3
        assert read() == {**{f"p{i}": (1, "old") for i in range(40)}, "p3": (2, "new"), "q": (1, "added")}
    after = {d: sorted(os.listdir(f"{folder}/{d}")) for d in os.listdir(folder) if d.startswith("bucket")}
    assert 0 < sum(after[d] != before.get(d) for d in after) <= 3
    with pytest.raises(ValueError, match="point bad has not 2"):
        points.upsert(folder, spark.createDataFrame([("bad", [1.0], 9, "x"), ("p1", [9.0, 9.0], 9, "x")], POINTS))
    assert read()["p1"] == (1, "old")
