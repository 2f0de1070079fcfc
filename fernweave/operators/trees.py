"""Trees by intervals: each node's place in a walk and the end of its subtree, so that what is below it is a range."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.operators.ordering import numbered, running
from fernweave.session import shared_folder

#: Nodes of a tree that one row of a range join's key stands for.
_BIN = 4096


def path_sums(nodes: DataFrame, weight: Column) -> DataFrame:
    """id, tree, total: each node's root, and the sum of weight over it and those above it, the root aside.

    nodes (id, parent_id, ...). A node without a parent among the nodes is a root. Pointers double their reach in each
    round, so there are as many rounds as the depth has binary digits. A cycle raises.
    """
    shared_folder(nodes.sparkSession)
    known = nodes.select("id").distinct().withColumnRenamed("id", "__known")
    rows = nodes.select("id", "parent_id", weight.cast("long").alias("w")).join(known, F.col("parent_id") == F.col("__known"), "left")
    root = F.col("__known").isNull()
    rows = rows.select("id", F.when(root, F.col("id")).otherwise(F.col("parent_id")).alias("up"), F.when(root, 0).otherwise(F.col("w")).alias("total"), root.alias("done")).checkpoint()
    n, rounds = rows.count(), 0
    while not rows.where("not done").isEmpty():
        if rounds > n.bit_length() + 1:
            raise ValueError(f"a cycle of parents through {rows.where('not done').first()['id']}")
        target = rows.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("done").alias("ended"))
        moved = rows.where("not done").join(target, "up").select("id", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), F.col("ended").alias("done"))
        rows, rounds = rows.where("done").unionByName(moved).checkpoint(), rounds + 1
    return rows.select("id", F.col("up").alias("tree"), "total")


def _by_depth(rows: DataFrame) -> tuple[str, list[int]]:
    """rows, written in a folder for each depth, so that a level reads its own rows only; the depths from the deepest."""
    path = f"{shared_folder(rows.sparkSession)}/fernweave/levels-{uuid.uuid4().hex}"
    rows.repartition("depth").write.partitionBy("depth").parquet(path)
    return path, [r[0] for r in rows.select("depth").distinct().orderBy(F.desc("depth")).collect()]


def _level(rows: DataFrame, path: str, depth: int) -> DataFrame:
    return rows.sparkSession.read.schema(rows.drop("depth").schema).parquet(f"{path}/depth={depth}")


def label(nodes: DataFrame, order: list[Column | str] | None = None) -> DataFrame:
    """nodes with tree, depth, first and last: root, distance from it, place in pre-order from 0, end of the subtree.

    nodes (id, parent_id, ...) form trees; children come in `order` (id by default). b is below a, or a itself, if both
    are of one tree and first(a) <= first(b) < last(a). Sizes are summed from the deepest level up, each level reading its
    own rows; depths and places are path sums. Ids are unique and not null; a cycle raises.
    """
    order = order or ["id"]
    deep = path_sums(nodes, F.lit(1)).withColumnRenamed("total", "depth")
    placed = nodes.select("id", "parent_id").join(deep, "id").checkpoint()
    narrow = placed.select("id", "parent_id", "tree", F.col("depth").cast("int").alias("depth"))
    path, depths = _by_depth(narrow)
    sizes = done = None
    for depth in depths:
        level = _level(narrow, path, depth).select("id", "parent_id", "tree", F.lit(depth).alias("depth"))
        if sizes is None:
            sizes = level.withColumn("size", F.lit(1).cast("long"))
        else:
            inside = sizes.groupBy(F.col("parent_id").alias("id")).agg(F.sum("size").alias("inside"))
            sizes = level.join(inside, "id", "left").withColumn("size", F.coalesce("inside", F.lit(0)) + 1).drop("inside")
        sizes = sizes.checkpoint()
        done = sizes if done is None else done.unionByName(sizes)
    if done is None:
        return nodes.select("*", F.col("id").alias("tree"), *(F.lit(0).cast("long").alias(c) for c in ("depth", "first", "last")))
    sized = nodes.join(done.select("id", "tree", F.col("depth").cast("long").alias("depth"), "size"), "id").checkpoint()
    # A root's siblings are no part of its tree.
    family = F.when(F.col("depth") == 0, F.col("id")).otherwise(F.col("parent_id"))
    beside = running(sized.withColumn("__family", F.struct("tree", family.alias("of"), (F.col("depth") == 0).alias("is_root")).cast("string")), "__family", order, F.col("size"), "__before").drop("__family")
    firsts = path_sums(beside, F.col("__before") + 1).select("id", F.col("total").alias("first"))
    return beside.join(firsts, "id").select(*nodes.columns, "tree", "depth", "first", (F.col("first") + F.col("size")).alias("last"))


def _bins(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / _BIN), F.floor((last - 1) / _BIN)))


def below(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """root, level and the columns of labels: every node below each of the roots (id), itself included; level is the distance.

    One join on the bins of a walk that an interval covers, whatever the depth; a bin holds a bounded number of nodes.
    """
    tops = labels.join(roots.select("id"), "id").select(F.col("id").alias("root"), F.col("tree").alias("__tree"), F.col("first").alias("__first"), F.col("last").alias("__last"), F.col("depth").alias("__depth"))
    tops = tops.withColumn("__bin", _bins(F.col("__first"), F.col("__last")))
    rows = labels.withColumn("__at", F.floor(F.col("first") / _BIN))
    met = rows.join(tops, (F.col("tree") == F.col("__tree")) & (F.col("__at") == F.col("__bin")) & (F.col("first") >= F.col("__first")) & (F.col("first") < F.col("__last")))
    return met.select("root", (F.col("depth") - F.col("__depth")).alias("level"), *labels.columns)


def above(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """leaf, level and the columns of labels: every node above each of ids (id), itself included, by the same ranges."""
    ends = labels.join(ids.select("id"), "id").select(F.col("id").alias("leaf"), F.col("tree").alias("__tree"), F.col("first").alias("__first"), F.col("depth").alias("__depth"), F.floor(F.col("first") / _BIN).alias("__at"))
    rows = labels.withColumn("__bin", _bins(F.col("first"), F.col("last")))
    met = ends.join(rows, (F.col("tree") == F.col("__tree")) & (F.col("__at") == F.col("__bin")) & (F.col("first") <= F.col("__first")) & (F.col("last") > F.col("__first")))
    return met.select("leaf", (F.col("__depth") - F.col("depth")).alias("level"), *labels.columns)


def callees(edges: DataFrame, labels: DataFrame, roots: DataFrame) -> DataFrame:
    """root, place, src, dst: what each root and all below it refer to, a row for each reference, doubles included.

    place counts from 0 through the walk: a node's own references, by dst, then those of its children in their order.
    """
    rows = below(labels, roots).select("root", "first", F.col("id").alias("src")).join(edges.select("src", "dst"), "src")
    return numbered(rows, "root", ["first", "dst"], "place").select("root", "place", "src", "dst")


def outline_json(labels: DataFrame, kinds: tuple[str, ...] = ("type-definition", "function")) -> DataFrame:
    """tree, outline: the nested definitions of each root as one JSON array of {id, name, type, children}.

    labels (id, parent_id, name, kind, node_type and what label() adds). A node shows if all between it and its root show;
    the root itself does not. Children's texts are put into their parents' from the deepest level up. A tree is a file's,
    which the scan bounds. A root without definitions has an empty array.
    """
    shown = labels.where((F.col("depth") == 0) | F.col("node_type").isin(*kinds)).select("id", "parent_id", "tree", "first", "name", "kind", F.col("depth").cast("int").alias("depth"))
    path, depths = _by_depth(shown)
    inside = None
    for depth in depths:
        level = _level(shown, path, depth)
        if inside is None:
            level = level.withColumn("inside", F.lit(""))
        else:
            level = level.join(inside, "id", "left").withColumn("inside", F.coalesce("inside", F.lit("")))
        if depth == 0:
            return level.select("tree", F.concat(F.lit("["), F.col("inside"), F.lit("]")).alias("outline"))
        head = F.to_json(F.struct("id", "name", F.col("kind").alias("type")), {"ignoreNullFields": "false"})
        text = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"children":['), F.col("inside"), F.lit("]}"))
        own = level.select(F.col("parent_id").alias("id"), "first", text.alias("text"))
        # An array sorted by its first field keeps the order of the walk.
        inside = own.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: x["text"]), ",").alias("inside")).checkpoint()
    return labels.select("tree", F.lit("[]").alias("outline")).limit(0)
