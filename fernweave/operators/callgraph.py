"""The call graph: symbol occurrences joined with syntax nodes that contain them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.session import shared_folder

#: Columns: nodes (file, id, name, start_byte, end_byte, node_ordinal, is_definition, is_reference);
#: occurrences (file, symbol, text, start_byte, end_byte, ordinal, is_definition), bytes of the identifier.


def _nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("name") != "").select("file", F.col("name").alias("text"), F.col("id").alias("node"), F.col("start_byte").cast("bigint").alias("start"), F.col("end_byte").cast("bigint").alias("end"), F.col("node_ordinal").cast("bigint").alias("ord"), F.col("is_definition").alias("defines"), "is_reference")


def _occurrences(occurrences: DataFrame) -> DataFrame:
    return occurrences.where((F.col("symbol") != "") & (F.col("text") != "") & (F.col("start_byte") <= F.col("end_byte"))).select("file", "text", "symbol", F.col("ordinal").cast("bigint").alias("ord"), F.col("start_byte").cast("bigint").alias("start"), F.col("end_byte").cast("bigint").alias("end"), F.col("is_definition").alias("defines"))


def least_dominating(px: np.ndarray, py: np.ndarray, rank: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """For each query the least rank of the points with px <= qx and py >= qy, -1 without any. Ranks are 0 to n - 1.

    Points stand in the order of px, so a query asks a prefix of them: one block of each size that a binary digit of its
    length names. Blocks are kept ordered by py with the least rank from each place on. O((n + m) log(n)^2), in whole arrays.
    """
    n, none = len(px), len(px)
    best = np.full(len(qx), none, np.int64)
    if not n or not len(qx):
        return np.full(len(qx), -1, np.int64)
    order = np.argsort(px, kind="stable")
    prefix = np.searchsorted(px[order], qx, side="right")
    levels, place = np.unique(py, return_inverse=True)
    # Places of py are compared as integers; a query's is the first level that is large enough.
    asked, wide = np.searchsorted(levels, qy, side="left"), len(levels) + 1
    place, rank = place[order], rank[order]
    for digit in range(int(n).bit_length()):
        size = 1 << digit
        which = np.flatnonzero((prefix >> digit) & 1)
        if not len(which):
            continue
        key = (np.arange(n) // size) * wide + place
        by = np.argsort(key, kind="stable")
        least = np.full(-(-n // size) * size, none, np.int64)
        least[:n] = rank[by]
        least = np.minimum.accumulate(least.reshape(-1, size)[:, ::-1], axis=1)[:, ::-1].ravel()
        block = (prefix[which] >> (digit + 1)) << 1
        at = np.searchsorted(key[by], block * wide + asked[which], side="left")
        inside = at < (block + 1) * size
        best[which[inside]] = np.minimum(best[which[inside]], least[at[inside]])
    return np.where(best == none, -1, best)


def contained(nodes: DataFrame, occurrences: DataFrame) -> DataFrame:
    """What one look at each name of each file tells: rows (file, text, use, ordinal, symbol, defines, node).

    Where use is false: an occurrence and the node around it, definitions first, then the smallest. Where it is true: a
    reference node and the first occurrence inside it that does not define. Names of files are dealt to buckets, so that
    small files share a call and a large one is in several; a bucket's nodes and occurrences are two ordered sets, and each
    asks the other: n log(n)^2 instead of every pair.
    """
    buckets = 4 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda t: t.where(F.col("file").isNotNull()).withColumn("bucket", F.pmod(F.xxhash64(F.col("file").cast("string"), "text"), F.lit(buckets)))
    n, o = dealt(_nodes(nodes)), dealt(_occurrences(occurrences))
    file, node, ordinal = n.schema["file"].dataType.simpleString(), n.schema["node"].dataType.simpleString(), occurrences.schema["ordinal"].dataType.simpleString()
    schema = f"file {file}, text string, use boolean, ordinal bigint, symbol string, defines boolean, node {node}"

    def pair(key: tuple, own: pa.Table, seen: pa.Table) -> pa.Table:
        column = lambda t, c: t.column(c).to_numpy(zero_copy_only=False)
        flag = lambda t, c: t.column(c).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        # In the order in which a node is chosen, the first that holds an occurrence is the one.
        own = own.take(pa.array(np.lexsort((column(own, "ord"), column(own, "end") - column(own, "start"), ~flag(own, "defines")))))
        seen = seen.take(pa.array(np.argsort(column(seen, "ord"), kind="stable")))
        start, end, refers = column(own, "start"), column(own, "end"), flag(own, "is_reference")
        left, right, defines = column(seen, "start"), column(seen, "end"), flag(seen, "defines")
        # Only what has one file and name meets: with the pair's number in front of both places, no other dominates.
        coded = lambda c: pa.concat_arrays([t.column(c).cast("string").combine_chunks() for t in (own, seen)]).dictionary_encode().indices.to_numpy().astype(np.int64)
        names = coded("text")
        number = np.unique(coded("file") * (1 + names.max(initial=0)) + names, return_inverse=True)[1]
        spread = 1 + 2 * max((int(np.abs(x).max()) for x in (start, end, left, right) if len(x)), default=0)
        of_own, of_seen = number[: len(start)] * spread, number[len(start) :] * spread
        around = least_dominating(of_own + start, of_own + end, np.arange(len(start)), of_seen + left, of_seen + right)
        # A use inside a node is a point that dominates it in the other direction.
        using = np.flatnonzero(~defines)
        first = least_dominating(-(of_seen + left)[using], -(of_seen + right)[using], np.arange(len(using)), -(of_own + start), -(of_own + end))
        first = np.where(first >= 0, using[first] if len(using) else -1, -1)
        hit, used = np.flatnonzero(around >= 0), np.flatnonzero((first >= 0) & refers)
        k, m = len(hit), len(used)
        told = np.concatenate([hit, first[used]])
        some = seen.take(pa.array(told))
        return pa.table(
            {
                "file": some.column("file").cast(own.schema.field("file").type),
                "text": some.column("text"),
                "use": pa.array(np.arange(k + m) >= k),
                "ordinal": some.column("ord"),
                "symbol": some.column("symbol"),
                "defines": pa.array(defines[told], pa.bool_()),
                "node": own.column("node").take(pa.array(np.concatenate([around[hit], used]))),
            }
        )

    found = n.groupBy("bucket").cogroup(o.groupBy("bucket")).applyInArrow(pair, schema)
    return found.withColumn("ordinal", F.col("ordinal").cast(ordinal))


def innermost(nodes: DataFrame, occurrences: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """file, ordinal, symbol, node: for each occurrence the node around it, definitions first, then the smallest."""
    found = contained(nodes, occurrences) if found is None else found
    return found.where(~F.col("use")).select("file", "ordinal", "symbol", "node")


def definitions(nodes: DataFrame, occurrences: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """symbol, node: the definition of each symbol. The first in order of file, first appearance of the text, occurrence."""
    found = contained(nodes, occurrences) if found is None else found
    first_text = occurrences.where("is_definition").groupBy("file", "text").agg(F.min("ordinal").alias("text_ordinal"))
    own = found.where(~F.col("use") & F.col("defines")).join(first_text, ["file", "text"])
    return own.groupBy("symbol").agg(F.min_by("node", F.struct("file", "text_ordinal", "ordinal")).alias("node"))


def references(nodes: DataFrame, occurrences: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """node, symbol: for each reference node the first occurrence inside it that does not define."""
    found = contained(nodes, occurrences) if found is None else found
    return found.where("use").groupBy("file", "node").agg(F.min_by("symbol", "ordinal").alias("symbol")).select("node", "symbol")


def resolve(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """node, symbol, target: the definition that a reference means; null target: external. A node is no target of its own."""
    found = refs.join(defs.select("symbol", F.col("node").alias("target")), "symbol", "left")
    return found.where(F.col("target").isNull() | (F.col("target") != F.col("node"))).select("node", "symbol", "target")


def edges(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("target").isNotNull()).select(F.col("node").alias("src"), F.col("target").alias("dst"), F.lit("REFERENCE_TO").alias("type")).distinct()


def link_counts(resolved: DataFrame) -> DataFrame:
    return resolved.agg(F.count_if(F.col("target").isNotNull()).alias("connected"), F.count_if(F.col("target").isNull()).alias("external"))


def external_symbols(referenced: DataFrame, defined: DataFrame) -> DataFrame:
    """Symbols used and not defined here, local ones aside."""
    return referenced.select("symbol").distinct().join(defined.select("symbol"), "symbol", "left_anti").where(~F.col("symbol").startswith("local "))


def linked(nodes: DataFrame, occurrences: DataFrame) -> DataFrame:
    """resolve() of a project's references and definitions, from one look at its files, which is written in between."""
    shared_folder(nodes.sparkSession)
    found = contained(nodes, occurrences).checkpoint()
    return resolve(references(nodes, occurrences, found), definitions(nodes, occurrences, found))


def build(nodes: DataFrame, occurrences: DataFrame) -> DataFrame:
    """The REFERENCE_TO edges of a project."""
    return edges(linked(nodes, occurrences))
