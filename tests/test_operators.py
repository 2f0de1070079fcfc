import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fernweave.functions import paths
from fernweave.operators import callgraph, catalog, chunking, embedding, graph, index_plan, jobs, positions, search, snapshot
from fernweave.sources import files as scans
from fernweave.sources import parsing, scip
from fernweave.sources.parsing import rows_of
from fernweave.streaming import incremental


def test_scan_says_why_a_file_is_left_out(spark, tmp_path):
    """Each row: a path, its content, and the status that a scan of at most 64 bytes gives it (None: never seen)."""
    cases = [
        ("app/main.ts", b"export {}", "included"),
        ("app/LEGACY.PY", b"print(1)", "included"),
        ("docs/notes.txt", b"plain", "unsupported"),
        ("Makefile", b"all:", "unsupported"),
        ("app/exactly.js", b"/" * 64, "included"),
        ("app/longer.js", b"/" * 65, "oversized"),
        ("app/blob.js", b"\x00\x01", "binary"),
        ("tmp/cache.py", b"x", "pruned"),
        ("tmp_not/cache.py", b"x", "included"),
        ("app/secret_keys.py", b"x", "ignored"),
        ("app/secret_public.py", b"x", "included"),
        ("web/node_modules/a/b.js", b"x", "pruned"),
        ("deep/venv/lib/c.py", b"x", "pruned"),
    ]
    for path, content, _ in cases:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    options = scans.ScanOptions(max_bytes=64, ignore=("tmp/", "secret_*", "!secret_public.py"))
    scanned = scans.scan(scans.read_source(spark, str(tmp_path)), options)
    got = {r.relative_path: r.status if r.pruned is None else "pruned" for r in scanned.collect()}
    assert got == {path: status for path, _, status in cases}
    counts = scans.scan_statistics(scanned).first().asDict()
    assert counts == {"discovered": 10, "pruned_directory": 3, "ignored": 1, "unsupported": 2, "oversized": 1, "binary": 1, "included": 5}
    assert {r.relative_path for r in scans.included(scanned).select("relative_path").collect()} == {p for p, _, s in cases if s == "included"}
    whole = scans.unfiltered(scans.read_source(spark, str(tmp_path)))
    assert [r.relative_path for r in whole.select("relative_path").collect()] == sorted(p for p, _, _ in cases if p not in ("docs/notes.txt", "Makefile"))
    assert [r.relative_path for r in scans.python_files(scans.read_source(spark, str(tmp_path))).collect()] == sorted(["app/secret_keys.py", "app/secret_public.py", "tmp/cache.py", "tmp_not/cache.py"])
    assert scans.read_source(spark, str(tmp_path / "app/main.ts")).first().relative_path == "main.ts"
    with pytest.raises(FileNotFoundError):
        scans.read_source(spark, str(tmp_path / "gone"))
    (tmp_path / "app/__init__.py").write_bytes(b"")
    mounted = {r.relative_path: bytes(r.content) for r in scans.read_mounted(spark, str(tmp_path)).collect()}
    assert mounted == {"app/__init__.py": b"", **{path: content for path, content, _ in cases}}
    for wrong in ({"max_bytes": 0}, {"probe_bytes": -1}):
        with pytest.raises(ValueError):
            scans.ScanOptions(**wrong)


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab é\n\t\r日", max_size=200), st.integers(4, 40), st.sampled_from(["byte", "word"]))
def test_plain_split_covers_and_keeps_the_limit(text, size, unit):
    source, options = text.encode(), chunking.ChunkOptions(size, unit)
    spans = chunking.split_plain(source, 0, len(source), options)
    assert b"".join(source[a:b] for a, b, _ in spans) == source
    assert all(0 < options.measure(source[a:b]) <= size or options.measure(source[a:b]) == 0 for a, b, _ in spans)
    if unit == "byte":
        for a, b, _ in spans:
            source[a:b].decode()


def test_tree_split_names_symbols(spark):
    source = b"def first(a):\n    return a + 1\n\n\ndef second(b):\n    return b * 2\n"
    files = spark.createDataFrame([("m.py", "python", "python", bytearray(source))], "file_path string, language string, parser_name string, content binary")
    chunks = chunking.chunk_files(files, parsing.parse_files(files), chunking.ChunkOptions(40))
    rows = chunks.orderBy("chunk_index").collect()
    assert b"".join(source[r.start_byte : r.end_byte] for r in rows) == source
    assert {"first", "second"} <= {r.symbol_name for r in rows}
    assert chunking.coverage(chunks, files, 40).first().is_exact


def test_coverage_tells_issues(spark):
    files = spark.createDataFrame([("f", bytearray(b"abcdef")), ("g", bytearray(b"abcdef")), ("h", bytearray(b"abc")), ("e", bytearray(b""))], "file_path string, content binary")
    rows = [("f", 0, 0, 2, 2, "ab"), ("f", 1, 3, 6, 3, "def"), ("g", 0, 0, 4, 4, "abcd"), ("g", 1, 3, 6, 999, "wrong")]
    chunks = spark.createDataFrame(rows, "file_path string, chunk_index int, start_byte long, end_byte long, size long, content string")
    got = {r.file_path: r for r in chunking.coverage(chunks, files, 500).collect()}
    assert (got["f"].missing_bytes, got["f"].overlap_bytes, got["f"].issues) == (1, 0, ["gap"])
    assert (got["g"].missing_bytes, got["g"].overlap_bytes) == (0, 1)
    assert set(got["g"].issues) == {"overlap", "content mismatch", "size mismatch", "exceeds max"}
    assert got["h"].issues == ["no chunks"] and got["e"].is_exact


def test_three_snapshots(spark):
    table = lambda rows: spark.createDataFrame(rows, "relative_path string, content_hash string")
    one = table([("alpha.py", "a1"), ("Card.tsx", "c1"), ("stable.js", "s1")])
    three = table([("alpha.py", "a2"), ("service.ts", "t1"), ("./stable.js", "s1")])
    assert {r.change for r in snapshot.diff(one.limit(0), one).collect()} == {"added"}
    assert {r.change for r in snapshot.diff(one, one).collect()} == {"unchanged"}
    got = {r.relative_path: r.change for r in snapshot.diff(one, three).collect()}
    assert got == {"alpha.py": "modified", "service.ts": "added", "stable.js": "unchanged", "Card.tsx": "deleted"}


def test_index_plan(spark):
    changes = spark.createDataFrame([("src/service.py", None, "a" * 64, "added"), ("old.py", "b" * 64, None, "deleted"), ("same.py", "c" * 64, "c" * 64, "unchanged")], "relative_path string, previous_hash string, current_hash string, change string")
    chunks = spark.createDataFrame([("src/service.py", 0, "python", "python", 0, 10, 10, "value = 1\n", "value", "variable")], "file_path string, chunk_index int, language string, parser_name string, start_byte long, end_byte long, size long, content string, symbol_name string, symbol_kind string")
    docs = [index_plan.documents(chunks, changes, "repository-1", r).first() for r in ("abc123", "def456")]
    assert docs[0].document_id == docs[1].document_id and docs[0].revision != docs[1].revision
    assert {(r.file_path, r.reason) for r in index_plan.deletes(changes, "repository-1", "abc").collect()} == {("src/service.py", "replace_file"), ("old.py", "source_deleted")}
    with pytest.raises(ValueError):
        index_plan.deletes(changes, " ", "abc")


def test_call_graph_of_sources(spark):
    source = b"class G:\n    def greet(self):\n        return 'hi'\n\ng = G()\nprint(g.greet())\n"
    files = spark.createDataFrame([("m.py", bytearray(source))], "file_path string, content binary")
    nodes = parsing.for_call_graph(parsing.parse_files(files))
    at = lambda word, n=0: [i for i in range(len(source)) if source.startswith(word, i)][n]
    rows = [("m.py", "G", b"G", 0, True), ("m.py", "greet", b"greet", 0, True), ("m.py", "greet", b"greet", 1, False), ("m.py", "print", b"print", 0, False)]
    occurrences = spark.createDataFrame([(f, s, w.decode(), at(w, n), at(w, n) + len(w), i, d) for i, (f, s, w, n, d) in enumerate(rows)], "file string, symbol string, text string, start_byte long, end_byte long, ordinal int, is_definition boolean")
    names = {r.id: (r.name, r.is_definition) for r in nodes.collect()}
    edges = callgraph.build(nodes, occurrences).collect()
    assert edges and all(names[e.dst] == ("greet", True) and names[e.src][0] == "greet" for e in edges)
    resolved = callgraph.resolve(callgraph.references(nodes, occurrences), callgraph.definitions(nodes, occurrences))
    counts = callgraph.link_counts(resolved).first()
    assert counts.connected == len(edges) and counts.external == 1


def test_cycles_are_closed(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    assert {r.id for r in graph.reachable(edges, spark.createDataFrame([(1,)], "id long")).collect()} == {1, 2, 3}


def test_positions_of_non_ascii_text(spark):
    text = "é = 1\r\nx日 = é\n"
    files = spark.createDataFrame([("f", text)], "file_path string, text string")
    occurrences = spark.createDataFrame([("f", [1, 0, 2]), ("f", [0, 0, 1, 99]), ("f", [9, 0, 1]), ("f", [1, 2])], "file_path string, scip_range array<int>")
    got = {tuple(r.scip_range): (r.start_byte, r.end_byte) for r in positions.scip_spans(occurrences, positions.line_table(files)).collect()}
    raw = text.encode()
    assert raw[slice(*got[1, 0, 2])].decode() == "x日"
    assert got[0, 0, 1, 99] == (0, len("é = 1\r\nx日 = é".encode())) and got[9, 0, 1] == (len(raw), len(raw))
    assert (1, 2) not in got


def _field(number, value):
    data = value if isinstance(value, bytes) else None
    return bytes([number << 3 | 2, len(data)]) + data if data is not None else bytes([number << 3, value])


def test_scip_index(spark):
    occurrence = _field(1, bytes([3, 4, 9])) + _field(2, b"local 1") + _field(3, 1)
    empty = _field(1, bytes([0, 0, 1]))
    info = _field(1, b"child") + _field(4, _field(1, b"parent") + _field(3, 1)) + _field(4, _field(1, b"other"))
    document = _field(1, b"a.py") + _field(2, occurrence) + _field(2, empty) + _field(3, info)
    index = spark.createDataFrame([(bytearray(_field(2, document) + _field(3, info)),)], "content binary")
    (o,) = scip.read_occurrences(index).collect()
    assert (o.document_path, o.ordinal, o.scip_range, o.symbol, o.is_definition) == ("a.py", 0, [3, 4, 9], "local 1@a.py", True)
    assert [tuple(r) for r in scip.read_inheritance(index).collect()] == [("child", "parent")] * 2


def test_python_parser():
    source = b'import os\n@cache\nasync def load(user_id: int, limit=10, *args, **kwargs) -> str:\n    """Doc of load."""\n    return client.users.get(user_id)\n\nclass A(B, C, metaclass=M):\n    X = 1\n    def __init__(self): self.v = str(1)\n'
    rows = rows_of("a.py", "python", source)
    load = next(r for r in rows if r["name"] == "load")
    assert (load["return_type"], load["is_async"], load["decorators"], load["docstring"]) == ("str", True, ["@cache"], '"""Doc of load."""')
    assert [p["name"] for p in load["params"]] == ["user_id", "limit", "args", "kwargs"]
    assert source[load["start_byte"] :].startswith(b"async def")
    calls = {(r["name"], r["subject"]) for r in rows if r["node_type"] == "call"}
    assert {("get", "client.users"), ("str", None)} <= calls
    a = next(r for r in rows if r["name"] == "A")
    assert a["base_types"] == ["B", "C"]
    assert {r["kind"] for r in rows if r["parent_id"] == a["id"] and r["node_type"] == "function"} == {"constructor"}


def test_typescript_parser():
    source = b'/** Doc */\nexport abstract class S<T> extends Base<T, K> implements I {\n  private readonly x: number = 1;\n  constructor(private a: Foo, b?: string) { super(a); }\n  static async get(id: string, ...r: any[]): Promise<T> { return this.repo.find(id); }\n}\nenum E { A, B = 2 }\ntype Al = string | Foo;\nimport d, { p as q } from "m";\nconst f = (x = 10) => x + g(x), LIM = 5;\n'
    rows = {r["name"]: r for r in rows_of("a.ts", "typescript", source) if r["node_type"] in ("type-definition", "function", "variable") and r["kind"] != "parameter"}
    assert rows["S"]["base_types"] == ["Base<T, K>", "I"] and rows["S"]["is_abstract"] and rows["S"]["docstring"] == "/** Doc */"
    assert (rows["x"]["kind"], rows["x"]["visibility"], rows["x"]["data_type"]) == ("field", "private", "number")
    assert rows["get"]["is_static"] and rows["get"]["is_async"] and rows["get"]["return_type"] == "Promise<T>"
    assert rows["E"]["enum_values"] == ["A", "B"] and rows["Al"]["kind"] == "type_alias"
    assert rows["f"]["node_type"] == "function" and rows["LIM"]["kind"] == "constant"
    broken = parsing.parser_of("typescript")(b"function f( { return (1; ")
    assert broken[1]


def test_broken_python_is_partly_parsed(spark):
    files = spark.createDataFrame([("a.py", bytearray(b"def ok():\n    return 1\n\ndef broken(:\n    pass\n")), ("b.py", bytearray(b"x = 1\n"))], "file_path string, content binary")
    problems = parsing.diagnostics(files)
    status = {r.file_path: r.status for r in parsing.parse_results(files, problems).collect()}
    assert status == {"a.py": "partial", "b.py": "success"}
    assert "ok" in {r.name for r in parsing.parse_files(files).collect()}


SNAPSHOT = "snapshot long, n_files long, relative_path string, content_hash string"


def test_snapshots_as_a_stream(spark, tmp_path):
    """A snapshot that comes in many batches is compared once it is whole, and two that come together are told apart."""
    folder, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    first = [(1, 6, f"f{i}", "1") for i in range(6)]
    second = [(2, 5, f"f{i}", "2" if i == 0 else "1") for i in range(4)] + [(2, 5, "new", "1")]
    third = [(3, 1, "f1", "1")]

    def arrive(rows, files):
        spark.createDataFrame(rows, SNAPSHOT).repartition(files).write.mode("append").parquet(folder)

    def run():
        stream = incremental.file_stream(spark, folder, SNAPSHOT, files_per_batch=1)
        incremental.run_once(stream, incremental.snapshot_handler(state, out), str(tmp_path / "check"))

    def changes(n):
        return {(r.relative_path, r.change) for r in spark.read.parquet(f"{out}/snapshot={n}").collect()}

    arrive(first[:4], 2)
    run()
    assert not (tmp_path / "out").exists()
    arrive(first[4:], 1)
    arrive(second, 3)
    arrive(third, 1)
    run()
    assert changes(1) == {(f"f{i}", "added") for i in range(6)}
    assert changes(2) == {("f0", "modified"), ("f1", "unchanged"), ("f2", "unchanged"), ("f3", "unchanged"), ("f4", "deleted"), ("f5", "deleted"), ("new", "added")}
    assert changes(3) == {("f1", "unchanged"), ("f0", "deleted"), ("f2", "deleted"), ("f3", "deleted"), ("new", "deleted")}


def test_bad_snapshots_raise(spark):
    table = lambda *rows: spark.createDataFrame(rows, "relative_path string, content_hash string")
    good = table(("a.py", "1"))
    for bad in (table(("../a.py", "1")), table(("a.py", "1"), ("./a.py", "1")), table((None, "1"))):
        assert snapshot.violations(bad).count() == 1
        with pytest.raises(Exception, match="invalid path|more than one row"):
            snapshot.diff(good, bad).collect()
    assert snapshot.violations(good).count() == 0
    assert snapshot.summary(snapshot.diff(good, good)).first().has_changes is False


def test_upsert_of_doubled_keys(spark):
    rows = spark.createDataFrame([(1, "old"), (2, "old")], "k long, v string")
    twice = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (3, "c", 1)], "k long, v string, at long")
    assert sorted(map(tuple, catalog.upsert(rows, twice, ["k"], ["at"]).collect())) == [(1, "a"), (2, "old"), (3, "c")]
    with pytest.raises(Exception, match="more than one change"):
        catalog.upsert(rows, twice, ["k"]).collect()
    with pytest.raises(LookupError):
        catalog.unlink(rows, spark.createDataFrame([(9,)], "k long"), "k")


def test_source_of_nodes(spark):
    nodes = spark.createDataFrame([("a", "f", 1, 4), ("b", "gone", 0, 1)], "id string, file_path string, start_byte long, end_byte long")
    files = spark.createDataFrame([("f", bytearray("xéy".encode()))], "file_path string, content binary")
    assert {r.id: r.source for r in graph.node_source(nodes, files).collect()} == {"a": "éy", "b": None}
    cut = nodes.withColumn("start_byte", F.lit(2).cast("long"))
    with pytest.raises(Exception, match="INVALID_UTF8"):
        graph.node_source(cut, files).collect()


def test_deep_trees(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(104)], "id long, parent_id long")
    got = graph.subtree(chain, spark.createDataFrame([(0,)], "id long"))
    assert got.count() == 104 and got.agg(F.max("depth")).first()[0] == 103


@pytest.mark.parametrize(("path", "source"), [("a.js", b"{" * 3_000 + b"}" * 3_000), ("a.py", b"x = " + b"-" * 60_000 + b"1\n"), ("b.py", b"x = a" + b".b" * 60_000 + b"\n")])
def test_deep_nesting_is_a_problem_of_its_file(spark, path, source):
    files = spark.createDataFrame([(path, bytearray(source)), ("fine.py", bytearray(b"def f(): pass\n"))], "file_path string, content binary")
    assert "f" in {r.name for r in parsing.parse_files(files).collect()}
    problems = parsing.diagnostics(files).collect()
    assert {p.file_path for p in problems} == {path}
    status = {r.file_path: r.status for r in parsing.parse_results(files, parsing.diagnostics(files)).collect()}
    assert status == {path: "partial", "fine.py": "success"}


def test_chunks_of_a_deep_tree():
    source = b"x" * 5_000
    root = inner = chunking.Node(0, len(source))
    for i in range(1, 2_000):
        child = chunking.Node(i, len(source) - i, f"n{i}")
        inner.children.append(child)
        inner = child
    spans = chunking.split_tree(root, source, chunking.ChunkOptions(100))
    assert spans[0][0] == 0 and spans[-1][1] == len(source) and all(x[1] == y[0] for x, y in zip(spans[:-1], spans[1:])) and all(b - a <= 100 for a, b, _ in spans)


def test_children_that_overlap_or_stand_out():
    source = b"aa\n  bbbb\n  cccc\ndd"
    node = chunking.Node(0, 20, children=[chunking.Node(12, 17, "c"), chunking.Node(5, 9, "b"), chunking.Node(7, 14, "over"), chunking.Node(18, 99, "out"), chunking.Node(6, 6, "none")])
    parts = chunking._parts(node, source, 0, 20)
    assert [(source[a:b], c and c.name) for a, b, c in parts] == [(b"aa\n", None), (b"  bbbb", "b"), (b"\n", None), (b"  cccc\n", "c"), (b"dd", None)]


def test_batches_number_rows_across_tasks(spark):
    rows = spark.range(0, 2_000).select(F.when(F.col("id") % 7 > 0, "hot").alias("key"), (F.col("id") * 37 % 2_003).alias("at"))
    got = jobs.batches(rows, "key", ["at"], 50).collect()
    assert len(got) == 2_000
    for key in ("hot", None):
        own = sorted((r.at, r.batch) for r in got if r.key == key)
        assert [b for _, b in own] == [i // 50 for i in range(len(own))]


def test_search_as_a_service(spark):
    points = spark.createDataFrame([(f"n{i}", [float(i == j) for j in range(4)], i % 2, i) for i in range(4)], "node_id string, vector array<double>, workspace_id long, branch_id long")
    none = F.lit(None).cast("string")
    points = points.select("*", *(none.alias(c) for c in ("name", "kind", "file_path", "signature", "summary", "docstring")), F.lit(None).cast("array<string>").alias("identifiers"))
    embed = lambda text: [float(text == f"n{j}") + 0.1 for j in range(4)]
    assert [r.node_id for r in search.search(points, "n2", embed).collect()] == ["n2", "n0", "n1", "n3"]
    assert [r.node_id for r in search.search(points, "n2", embed, workspace_id=1).collect()] == ["n1", "n3"]
    assert search.search(points, "  ", embed).count() == 0
    branches = spark.createDataFrame([(3, 7, "main")], "id long, repository_id long, name string")
    assert [r.node_id for r in search.search_branch(points, branches, "n2", embed, 7, "main").collect()] == ["n3"]
    assert search.search_branch(points, branches, "n2", embed, 8, "main").count() == 0
    with pytest.raises(ValueError):
        search.search(points, "n2", embed, 51)


def test_batch_search_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[100:110] = x[99]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [1.0] * 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = table.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for most in (10_000, 4):
        got = {}
        for r in search.top_k_batch(table, asked, 5, max_queries=most).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert set(got) == set(range(0, 300, 20))
        for q, found in got.items():
            score = np.round(unit @ unit[q], 12)
            best = sorted((i for i in range(300) if i != q), key=lambda i: (-score[i], i))[:5]
            assert [i for _, i, _ in sorted(found)] == best and all(abs(s - score[i]) < 1e-9 for _, i, s in found)


def test_indexing_from_sources_to_vectors(spark, tmp_path):
    """Scan, diff, parse, chunk, plan, embed and search one small project."""
    sources = {"pkg/a.py": b'class Store:\n    """Keeps rows of every table in memory for later."""\n    def load(self, name: str) -> int:\n        return len(name)\n\ndef main():\n    Store().load("x")\n', "web/b.js": b"export function draw(shape) { return shape; }\n", "notes.md": b"x"}
    for path, content in sources.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(content)
    files = scans.included(scans.scan(scans.read_source(spark, str(tmp_path)), scans.ScanOptions())).withColumn("file_path", F.col("relative_path"))
    changes = snapshot.diff(files.select("relative_path", "content_hash").limit(0), files.select("relative_path", "content_hash"))
    nodes = parsing.parse_files(files)
    named = files.select("file_path", "language", paths.parser_name(F.col("file_path")).alias("parser_name"), "content")
    parts = chunking.chunk_batch(changes, named, nodes, chunking.ChunkOptions(60))
    covered = chunking.coverage(parts["chunks"], files.select("file_path", "content"), 60)
    assert parts["current"].count() == 2 and parts["unchanged"].count() == parts["deleted"].count() == 0
    assert chunking.totals(covered, parts["chunks"]).first().all_exact
    index_plan.check(parts["chunks"], changes, covered, 60)
    docs = index_plan.documents(parts["chunks"], changes, "repo", "r1")
    counts = index_plan.counts(docs, index_plan.deletes(changes, "repo", "r1")).first()
    assert counts.documents == parts["chunks"].count() and counts.deletes == 2 and counts.has_operations
    with pytest.raises(ValueError, match="inexact coverage"):
        index_plan.check(parts["chunks"], changes, covered.withColumn("is_exact", F.lit(False)), 60)
    wrong = changes.withColumn("current_hash", F.sha2("relative_path", 256))
    with pytest.raises(Exception, match="does not match its hash"):
        chunking.chunk_batch(wrong, named, nodes)["chunks"].collect()

    found = embedding.candidates(nodes)
    order = [(r.file_path, r.name) for r in found.orderBy("file_path", "place").collect()]
    assert order == [("pkg/a.py", "Store"), ("pkg/a.py", "load"), ("pkg/a.py", "main"), ("web/b.js", "draw")]
    assert [r.name for r in embedding.candidates(nodes, 2).orderBy("file_path", "place").collect()] == ["Store", "load"]
    names = nodes.where("name IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.collect_list("name").alias("names"))
    points = embedding.embed_nodes(embedding.enriched(found, names).coalesce(1), 1, 2, embedding.mock_embedder, batch=3)
    rows = {r.name: r for r in points.collect()}
    assert rows["load"].signature == "def load(self: Any, name: str) -> int" and rows["Store"].docstring.startswith("Keeps rows")
    assert abs(sum(x * x for x in rows["main"].vector) - 1) < 1e-9 and len(rows["main"].vector) == embedding.DIMENSION
    assert rows["draw"].formatted_embed_text == f"{rows['draw'].signature}\n\nDefines {rows['draw'].signature}."
    again = search.search(points, rows["draw"].formatted_embed_text, embedding.mock_vector, 1, workspace_id=1).first()
    assert again.name == "draw" and again.score > 0.999
    graph.write_tree(nodes, files.select("file_path", "language", "content"), str(tmp_path / "tree"))
    assert spark.read.parquet(str(tmp_path / "tree/nodes")).count() == nodes.count()
    with pytest.raises(ValueError):
        graph.write_tree(nodes.where("kind <> 'file'"), files.select("file_path", "language", "content"), str(tmp_path / "other"))


def test_javascript_parser():
    source = b"""/** Loads users. */
async function load(id, limit = 10, ...flags) { return api.users.get(id); }
const add = (a, b) => a + b, LIMIT = 5;
let count = 0;
class Cart extends Base {
  static #total = 0;
  get size() { return this.items.length; }
  *each() { yield 1; }
  constructor(items) { super(items); }
}
const fs = require("fs");
import def, { one as two } from "./mod";
import * as all from "lib";
export { add, Cart };
export * from "./other";
function* gen() { yield load(1); }
"""
    rows = rows_of("a.js", "javascript", source)
    of = lambda name, *types: next(r for r in rows if r["name"] == name and r["node_type"] in types)
    load = of("load", "function")
    assert (load["docstring"], load["is_async"], load["is_generator"]) == ("/** Loads users. */", True, False)
    assert [(p["name"], p["value"]) for p in load["params"]] == [("id", None), ("limit", "10"), ("flags", None)]
    assert [p["name"] for p in of("add", "function")["params"]] == ["a", "b"]
    assert of("LIMIT", "variable")["kind"] == "constant" and of("count", "variable")["kind"] == "variable"
    assert of("Cart", "type-definition")["base_types"] == ["Base"]
    assert of("size", "function")["kind"] == "method" and of("each", "function")["is_generator"] and of("gen", "function")["is_generator"]
    assert of("constructor", "function")["kind"] == "constructor"
    assert ("get", "api.users") in {(r["name"], r["subject"]) for r in rows if r["node_type"] == "call"}
    imports = {r["module_path"]: r for r in rows if r["node_type"] == "import"}
    assert set(imports) == {"fs", "./mod", "lib", "./other"}
    assert imports["fs"]["alias"] == {"*": "fs"} and imports["./mod"]["imported_names"] == ["default", "one"] and imports["./mod"]["alias"]["one"] == "two"
    assert any(r["node_type"] == "export" for r in rows)
