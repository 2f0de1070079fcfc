"""What findings about cut, slow or swollen queries asked for, each in small."""

from pyspark.sql import functions as F

from fernweave.plans import queries

SF = "/root/testdata/sf0.001"


def test_call_graph_files_hold_the_rows_of_fifty_keys(spark):
    """Files grow with the tables: pairs that may meet are not cut down to those of 256 orders."""
    nodes, occurrences = queries._code(spark, SF)
    assert {r[0] for r in occurrences.select("file").distinct().collect()} == set(range(50))
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select((F.col("l_suppkey") % 50).alias("file"))
    assert sorted(nodes.groupBy("file").count().collect()) == sorted(lines.groupBy("file").count().collect())
    assert "l_suppkey % 50 AS file" in queries._NODES and "o_custkey % 50 AS file" in queries._OCCS


def test_sources_of_one_part_are_parsed_by_all_tasks(spark):
    """A table of small files is one part of a scan; parsing is what takes the time."""
    from fernweave.sources import captures, parsing

    files = spark.range(64).coalesce(1).select(F.concat(F.lit("p"), F.col("id").cast("string"), F.lit(".py")).alias("file_path"), F.lit(b"x = f(1)\n").alias("content"))
    for rows in (parsing.parse_files(files), parsing.diagnostics(files), captures.python_trees(files)):
        assert rows.rdd.getNumPartitions() == 4
    assert parsing.parse_files(files).where("node_type = 'call'").count() == 64


def test_reach_over_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """A chain of 600 nodes with a branch at its end, and a cycle."""
    from fernweave.operators import graph

    rounds = []
    checkpoint = type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda self, *a, **k: rounds.append(1) or checkpoint(self, *a, **k))
    pairs = [(i, i + 1) for i in range(600)] + [(600, 700), (600, 701), (701, 0), (7, 7), (800, 3)] + [(i, 2) for i in range(2, 600, 50)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = sorted(r[0] for r in graph.reachable(edges, spark.createDataFrame([(0,), (900,)], "id long")).collect())
    assert got == [*range(601), 700, 701, 900]
    assert len(rounds) < 60


def test_a_source_is_not_copied_to_its_chunks(spark):
    """Rows that a window sorts hold their own chunk only."""
    from fernweave.operators import chunking

    files = spark.createDataFrame([("a", bytearray(b"ab\ncd\n")), ("b", bytearray(b"")), ("c", bytearray(b"xyz"))], "file_path string, content binary")
    rows = [("a", 0, "p", "p", 0, 3, 3, "ab\n", None, None), ("a", 1, "p", "p", 2, 6, 4, "\nc??", None, None)]
    chunks = spark.createDataFrame(rows, chunking.CHUNKS)
    covered = chunking.coverage(chunks, files, 3)
    plan = covered._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window ") :]
    assert "source#" not in window[: window.index("Project") if "Project" in window else None]
    got = {r["file_path"]: (r["missing_bytes"], r["overlap_bytes"], r["issues"], r["is_exact"]) for r in covered.collect()}
    assert got == {"a": (0, 1, ["content mismatch", "exceeds max", "overlap"], False), "b": (0, 0, [], True), "c": (3, 0, ["no chunks", "trailing gap"][:1], False)}


def test_lines_are_made_of_bounded_slices():
    import pyarrow as pa

    from fernweave.operators import positions

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["aa", "b" * 9, None, "", "cc", "dddd"])], ["path", "text"])
    slices = [b.column(0).to_pylist() for b in positions.bounded(batch, 1, 4)]
    assert slices == [[0], [1], [2, 3, 4], [5]]


def test_sources_are_parsed_once_for_chunks_and_graphs(spark):
    """What is parsed is written before plans read it more than once, so no plan parses again or guesses its size."""
    from fernweave.plans import code

    for made in (code.chunked_sources(spark, SF), code.graph_from_sources(spark, SF)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and "MapInPandas" not in plan
