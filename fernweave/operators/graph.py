"""Questions about a tree of nodes and the references between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.session import shared_folder


def subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """root, id, depth of every node below each root, itself included. nodes (id, parent_id); roots (id).

    A level is one join with the nodes, written before the next: for a few roots of a table without labels. trees.label()
    makes it a range for any number. A node that is met again below itself is a cycle, and raises, whatever the depth.
    """
    shared_folder(nodes.sparkSession)
    below = nodes.select(F.col("id").alias("child"), F.col("parent_id").alias("id")).where(F.col("id").isNotNull())
    frontier = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).checkpoint()
    known, depth, looked = [frontier], 0, 64
    while True:
        depth += 1
        frontier = frontier.join(below, "id").select("root", F.col("child").alias("id"), F.lit(depth).alias("depth")).checkpoint()
        if frontier.isEmpty():
            return _together(known)
        if depth == looked:
            # A round that meets what it has met goes on for ever; looked for at depths that double.
            again = frontier.join(_together(known).select("root", "id"), ["root", "id"], "left_semi")
            if not again.isEmpty():
                raise ValueError(f"a cycle of parents through {again.first()['id']}")
            looked *= 2
        known = _merged([*known, frontier])


def _together(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _merged(tables: list[DataFrame], most: int = 16) -> list[DataFrame]:
    """The tables as they are, or as one, so that plans over them stay short: each row is rewritten every `most` rounds."""
    return [_together(tables).checkpoint()] if len(tables) >= most else tables


def outline(nodes: DataFrame, roots: DataFrame, kinds: tuple[str, ...] = ("type-definition", "function")) -> DataFrame:
    """subtree() over definitions only: a node shows if all between it and the root show."""
    shown = nodes.where(F.col("node_type").isin(*kinds))
    return subtree(shown, roots.join(shown.select("id"), "id", "left_semi")).join(shown, "id")


def usages(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """dst, and the node that refers to it."""
    return edges.select("src", "dst").join(nodes.withColumnRenamed("id", "src"), "src")


def callees(edges: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """root, src, dst: what a node and all below it refer to, one row for each reference."""
    return subtree(nodes, roots).select("root", F.col("id").alias("src"), "depth").join(edges.select("src", "dst"), "src").select("root", "src", "dst")


def node_source(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """id, source: the bytes of a node's span as text; null without the file. Malformed UTF-8 raises."""
    span = F.substr("content", (F.col("start_byte") + 1).cast("int"), (F.col("end_byte") - F.col("start_byte")).cast("int"))
    return nodes.join(files.select("file_path", "content"), "file_path", "left").select("id", F.validate_utf8(span.cast("string")).alias("source"))


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Every node that edges (src, dst) reach from roots (id), them included. Cycles are fine.

    A frontier grows by joins; what is known leaves it by an anti join. Each round writes its new nodes only, so lineage
    stays short and a lost executor costs one round. It ends when a round finds nothing new, however far that is. After
    each eight rounds chains are followed to their ends at once, so long ones cost rounds by the logarithm of their length.
    """
    shared_folder(edges.sparkSession)
    edges = edges.select("src", "dst").where("src <> dst").distinct().checkpoint()
    frontier = roots.select("id").distinct().checkpoint()
    known, rounds = [frontier], 0
    while not frontier.isEmpty():
        rounds += 1
        step = frontier.join(edges.select(F.col("src").alias("id"), "dst"), "id").select(F.col("dst").alias("id")).distinct()
        frontier = step.join(_together(known), "id", "left_anti").checkpoint()
        known = _merged([*known, frontier])
        if rounds % 8 == 0:
            known = [_together(known).checkpoint()]
            along = _along_chains(edges, known[0], frontier)
            frontier, known = frontier.unionByName(along), [*known, along]
    return _together(known)


def _along_chains(edges: DataFrame, known: DataFrame, frontier: DataFrame) -> DataFrame:
    """What is reached from frontier over nodes with one edge to what is not known.

    Each turn doubles the length of the steps: nodes at up to 2^i steps are found, then they and the next 2^i. At most one
    step a node, so a turn's work is that of the edges.
    """
    after = edges.join(known.select(F.col("id").alias("dst")), "dst", "left_anti").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("dst"), F.count("*").alias("n"))
    steps = after.where("n = 1").select("id", "dst").checkpoint()
    found, whole = [frontier], []
    while True:
        reached = _together(found)
        new = reached.join(steps, "id").select(F.col("dst").alias("id")).distinct().join(reached, "id", "left_anti").checkpoint()
        if new.isEmpty():
            return _together(whole) if whole else new
        whole.append(new)
        found.append(new)
        steps = steps.join(steps.select(F.col("id").alias("dst"), F.col("dst").alias("to")), "dst").select("id", F.col("to").alias("dst")).checkpoint()


def cascade(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes that stay when roots and all they reach are deleted."""
    return nodes.join(reachable(edges, roots), "id", "left_anti")


def by_id(table: DataFrame, id_: Column | str, column: str = "id") -> DataFrame:
    """The row of an id; raises if there is none."""
    found = table.where(F.col(column) == id_)
    if found.isEmpty():
        raise LookupError(f"no row of {column} {id_}")
    return found


def file_listing(files: DataFrame) -> DataFrame:
    """path and id of every file that has a path, in order of paths."""
    return files.where(F.col("path").isNotNull()).select("path", "id").orderBy("path", "id")


def node_info(nodes: DataFrame) -> DataFrame:
    """id, name, file_path and where a node stands: bytes, and points of row and column."""
    point = lambda side: F.struct(F.col(f"{side}_row").alias("row"), F.col(f"{side}_column").alias("column")).alias(f"{side}_point")
    return nodes.select("id", "name", "file_path", "start_byte", "end_byte", (F.col("end_byte") - F.col("start_byte")).alias("byte_size"), point("start"), point("end"))


def callers_of(edges: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """The nodes that refer to a function of this name."""
    wanted = nodes.where((F.col("name") == name) & (F.col("node_type") == "function")).select(F.col("id").alias("dst"))
    return usages(edges.join(wanted, "dst", "left_semi"), nodes)


def file_dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """file_path, depends_on: pairs of different files between which a reference leads."""
    of = lambda end, name: nodes.select(F.col("id").alias(end), F.col("file_path").alias(name))
    pairs = edges.join(of("src", "file_path"), "src").join(of("dst", "depends_on"), "dst")
    return pairs.where(F.col("file_path") != F.col("depends_on")).select("file_path", "depends_on").distinct()


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") == F.col("dst"))


def write_tree(nodes: DataFrame, files: DataFrame, folder: str) -> None:
    """Parsed files as two tables, files and nodes by language; nodes of a file without its root raise before anything is written."""
    roots = nodes.where((F.col("node_type") == "container") & (F.col("kind") == "file")).select("file_path")
    orphans = nodes.select("file_path").distinct().join(roots, "file_path", "left_anti")
    if not orphans.isEmpty():
        raise ValueError(f"no root node: {orphans.first()[0]}")
    files.write.mode("append").parquet(f"{folder}/files")
    nodes.join(files.select("file_path", "language"), "file_path").write.partitionBy("language").mode("append").parquet(f"{folder}/nodes")


def tree_text(nodes: DataFrame) -> DataFrame:
    """file_path, tree: a line for each node of a file in pre-order, indented by depth. A file is bounded by the scan."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.coalesce("kind", "node_type"), F.coalesce(F.concat(F.lit(" "), F.col("name")), F.lit("")))
    return nodes.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"]), "\n").alias("tree"))


def as_json(table: DataFrame, leave_out: tuple[str, ...] = ("content",)) -> DataFrame:
    """One JSON text for each row, large contents left out."""
    return table.select(F.to_json(F.struct(*(c for c in table.columns if c not in leave_out)), {"ignoreNullFields": "false"}).alias("json"))
