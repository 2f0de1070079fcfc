"""Circulant MinHash: near duplicates by signatures from two permutations, banded, then verified on the full sets."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.llm import jaccard_join
from fernweave.llm.common import discard, give_back, mix, stash, thrifty
from fernweave.llm.jaccard_join import Hasher, _class_sizes, _node, _utf8


@dataclass(frozen=True)
class Settings:
    """Two sets link when 100 * |intersection| >= percent * |union|; sets are of k-word shingles.

    A pair of similarity x shares a band with the probability 1 - (1 - x ** rows) ** bands: 0.999995 at 0.8 for these.
    """

    k: int = 2
    percent: int = 80
    bands: int = 40
    rows: int = 6
    #: Places of the second permutation, as a power of two.
    bits: int = 20
    #: Hash classes whose sizes are kept for each set: the more, the more of the pairs below the bound the suffix filter tells.
    classes: int = 256
    #: Nodes of a bucket on each side of a comparison in one task.
    share: int = 1_000

    @property
    def join(self) -> jaccard_join.Settings:
        return jaccard_join.Settings(k=self.k, percent=self.percent)


class Circulant:
    """Coordinate i of a set's signature is the least of pi[(sigma(x) + i) mod places] over its members x.

    sigma is a bijection of 64-bit numbers, of which the upper bits name a place; pi is one permutation of the places,
    read from another place for each coordinate, that is circularly shifted. No other permutation is drawn.
    """

    def __init__(self, s: Settings):
        self.s, places = s, 1 << s.bits
        with np.errstate(over="ignore"):
            pi = np.argsort(mix(np.arange(places, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(1)), kind="stable").astype(np.uint32)
        shifts = s.bands * s.rows
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: shifts - 1]]), shifts)

    def signature(self, members: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            at = (mix(members + np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - self.s.bits)).astype(np.int64)
        return np.minimum.reduce([self.shifted[at[i : i + 512]].min(axis=0) for i in range(0, len(at), 512)])

    def bands(self, members: np.ndarray) -> np.ndarray:
        """A 64-bit name for each band of the signature."""
        rows = self.signature(members).astype(np.uint64).reshape(self.s.bands, self.s.rows)
        with np.errstate(over="ignore"):
            name = np.arange(1, self.s.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for i in range(self.s.rows):
                name = mix(name ^ rows[:, i]) * np.uint64(0xC2B2AE3D27D4EB4F)
        return mix(name)


#: Bytes of text that are hashed at once: a worker stays small beside a full heap.
_AT_ONCE = 1 << 18


def _sets_of(hasher: Hasher, texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in slices of bounded size."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) < _AT_ONCE:
            size += len(texts[end])
            end += 1
        yield from hasher.sets(texts[at:end], k)
        at = end


def _keys(s: Settings):
    """(doc_id, text) to (doc_id, key, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            sets = [(_node(x), len(x)) for x in _sets_of(hasher, _utf8(batch.column(1)), s.k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in sets], pa.binary()), pa.array([x[1] for x in sets], pa.int64())], ["doc_id", "key", "n"])

    return run


def _banded(s: Settings):
    """(doc_id, text) to (doc_id, key, n, classes, packed, bands) for texts with words; the last three where a set is large enough to link with others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, circulant, pack, least = Hasher(), Circulant(s), zstandard.ZstdCompressor(level=3).compress, s.join.least
        kinds = (pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        for batch in batches:
            texts, rows = _utf8(batch.column(1)), []
            for text, members in zip(texts, _sets_of(hasher, texts, s.k), strict=True):
                some = len(members) >= least
                rows.append((_node(members), len(members), _class_sizes(members, s.classes) if some else None, pack(text) if some else None, circulant.bands(members).view(np.int64) if some else None))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "key", "n", "classes", "packed", "bands"]).filter(columns[0].is_valid())

    return run


#: Nodes of a bucket's main component that the others meet at once.
_HEADS = 3


def _open(blocks: DataFrame, label: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Rows (h, node, place, label) of buckets, and for those with nodes of several labels (h, main, heads, c, others): the
    label of most, some nodes of it (others in each turn), and how many nodes the bucket has, of any label and of others.
    The order of heads is the same in all buckets, so buckets of the same texts mostly name the same ones.
    """
    named = jaccard_join._named(blocks, label)
    heads = [F.min(F.struct(F.xxhash64("node", F.lit(_HEADS * turn + i)).alias("x"), "node", "place")) for i in range(_HEADS)]
    labels = named.groupBy("h", "label").agg(F.count("*").alias("c"), F.array_distinct(F.transform(F.array(*heads), lambda x: F.struct(x["node"].alias("hub"), x["place"].alias("head_place")))).alias("heads"))
    split = labels.groupBy("h").agg(F.max_by(F.struct("label", "heads", "c"), F.struct("c", "label")).alias("top"), F.sum("c").alias("c"), F.count("*").alias("labels")).where("labels > 1")
    return named, split.select("h", F.col("top.label").alias("main"), F.col("top.heads").alias("heads"), "c", (F.col("c") - F.col("top.c")).alias("others"))


def _pairs(s: Settings):
    """Nodes of a bucket (h, x, other, label, main, node, n, classes, bands) to pairs that may link, of different labels.

    x tells the rows that are compared with the rest. A pair comes from the first band that it shares, and passes the
    length filter and the suffix filter: what the sizes of their hash classes differ by is not shared.
    """

    def run(table: pa.Table) -> pa.Table:
        h = table.column("h")[0].as_py()
        column = lambda t, c: t.column(c).to_numpy(zero_copy_only=False)
        matrix = lambda t: np.frombuffer(b"".join(t.column("classes").to_pylist()), np.uint8).reshape(len(t), -1).astype(np.int16)
        bands = lambda t: t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        is_x = column(table, "x").astype(bool)
        left, right = table.filter(pa.array(is_x)), table.filter(pa.array(~is_x))
        out = ([], [], [])
        if len(left) and len(right):
            label, node, n, classes, names = column(right, "label"), column(right, "node"), column(right, "n"), matrix(right), bands(right)
            in_main = label == column(right, "main")
            for own_label, own, size, sizes, own_names in zip(column(left, "label"), column(left, "node"), column(left, "n"), matrix(left), bands(left), strict=True):
                total = n + size
                need = -(-s.percent * total // (100 + s.percent))
                at = np.flatnonzero((label != own_label) & (in_main | (own < node)) & (np.minimum(n, size) >= need))
                same = names[at] == own_names
                first = same.argmax(axis=1) == np.flatnonzero(own_names == h)[0]
                at, same = at[first], same[first]
                close = np.abs(classes[at] - sizes).sum(axis=1) <= (total - 2 * need)[at]
                at = at[close]
                out[0].append(np.maximum(node[at], own))
                out[1].append(np.minimum(node[at], own))
                out[2].append(same[close].sum(axis=1))
        hub, other, shared = (np.concatenate([np.zeros(0, np.int64), *x]) for x in out)
        if table.nbytes > 1 << 20:
            del left, right, table
            give_back()
        return pa.table({"hub": hub, "node": other, "shared": shared.astype(np.int64), "must": np.zeros(len(hub), bool)})

    return run


def _left_over(nodes: DataFrame, blocks: DataFrame, s: Settings):
    """What connect() does between its first links and the pairs that are left."""
    join = s.join

    def run(label: DataFrame) -> tuple[DataFrame, DataFrame]:
        # Nodes outside a bucket's main component meet some of it, others each time, for as long as a quarter of the pairs link.
        for turn in itertools.count():
            named, split = _open(blocks, label, turn)
            met = named.join(split, "h").where(F.col("label") != F.col("main")).select("node", "place", F.explode("heads").alias("head")).select("node", "place", "head.hub", "head.head_place")
            met = met.where(jaccard_join._may_link(join, "place", "head_place"))
            near = jaccard_join._close(met.groupBy("hub", "node").agg(F.count("*").alias("shared"), F.lit(False).alias("must")), nodes, join)
            # Of the heads of its buckets, a bounded number, a node takes those that it shares most buckets with.
            likely = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("less"), "hub"))), 1, _HEADS)
            best = stash(near.groupBy("node").agg(likely.alias("top")).select("node", F.explode("top.hub").alias("hub")), "best")
            links = jaccard_join.verify_pairs(nodes, best, join)
            asked, found = best.count(), links.count()
            if found:
                label = jaccard_join.joined(label, links)
            discard(best, links)
            if 4 * found < asked or not found:
                break
        named, split = _open(blocks, label, 0)
        salts = lambda c: 1 + F.floor(F.col(c) / s.share)
        every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), salts(c) - 1))
        of = lambda c: F.pmod(F.xxhash64("node"), salts(c))
        rows = named.join(split.select("h", "main", "c", "others"), "h").join(nodes.select("node", "n", "classes", "bands"), "node")
        columns = ["h", "label", "main", "node", "n", "classes", "bands"]
        left = rows.where(F.col("label") != F.col("main")).select(*columns, F.lit(True).alias("x"), of("others").alias("i"), every("c").alias("j"))
        right = rows.select(*columns, F.lit(False).alias("x"), of("c").alias("j"), every("others").alias("i"))
        return label, stash(left.unionByName(right).groupBy("h", "i", "j").applyInArrow(_pairs(s), "hub bigint, node bigint, shared bigint, must boolean"), "cross")

    return run


def link_documents(documents: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row: the smallest document id reachable by links, its own included;
    kept where that is the row's own id.

    Texts with equal sets are one node from the start. The others meet in the buckets of their bands. A node is first
    compared with the smallest of the bucket that it shares most with, which joins most copies at one comparison each;
    those still outside a bucket's main component meet other nodes of it, as long as that joins many; then every pair that
    shares a bucket, passes the filters and is not connected yet is compared. All links are confirmed on the full sets of
    64-bit hashes of whole texts; a pair is missed only if no band agrees.

    A null or empty text, or one without words, has an empty set: n_shingles 0, linked with nothing, its own component. A
    null id takes part; it names no component unless all ids in it are null, and such rows are kept. Rows of one id are
    separate documents. Other columns are not read; an empty table gives an empty result.
    """
    s, join = settings, settings.join
    rows = documents.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    docs = stash(rows.mapInArrow(thrifty(_keys(s)), f"doc_id {kind}, key binary, n bigint"), "keys")
    sets = rows.mapInArrow(thrifty(_banded(s)), f"doc_id {kind}, key binary, n bigint, classes binary, packed binary, bands array<bigint>")
    nodes = sets.groupBy("key").agg(F.min("doc_id").alias("least"), F.first(F.struct("n", "classes", "packed", "bands")).alias("one"))
    nodes = stash(nodes.select(F.monotonically_increasing_id().alias("node"), "key", "least", "one.*"), "nodes")
    postings = nodes.where(F.col("bands").isNotNull()).select(F.explode("bands").alias("block"), "node", F.col("n").alias("place"))
    # Heads are partial minima, so no bucket is gathered; of the join that follows Spark splits a large one.
    heads = postings.groupBy("block").agg(F.min(F.struct("place", "node")).alias("head"), F.count("*").alias("c")).where("c > 1")
    met = postings.join(heads, "block").select("block", F.lit(None).cast("bigint").alias("hot"), "node", "place", F.col("head.node").alias("head"), F.col("head.place").alias("head_place"))
    blocks = stash(met, "blocks")
    pairs = blocks.select("node", "place", F.col("head").alias("hub"), "head_place", F.lit(False).alias("must")).where((F.col("node") != F.col("hub")) & jaccard_join._may_link(join, "place", "head_place"))
    found = jaccard_join.connect(docs, nodes, blocks, pairs, join, _left_over(nodes, blocks, s))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
