"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernweave.llm.common import discard, mix, shingle_hashes, stash, thrifty

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SLICE_BYTES = 1 << 20


@dataclass(frozen=True)
class Settings:
    """Two sets link when 100 * |intersection| >= percent * |union|; sets are of k-word shingles."""

    k: int = 3
    percent: int = 90
    #: Buckets of the frequency sketch, as a power of two. It only orders shingles: too few cost time, never links.
    sketch_bits: int = 22
    #: Blocks of a shingle estimated over this many documents are dealt out to several tasks.
    block: int = 20_000
    #: Rows of an open block that one task compares with the rest of it.
    share: int = 4_000

    def prefix(self, n: np.ndarray | int):
        return n - (self.percent * n + 99) // 100 + 1

    @property
    def least(self) -> int:
        """Smaller sets link with equal ones only."""
        return -(-self.percent // (100 - self.percent)) if self.percent < 100 else 1 << 30


class Hasher:
    """Word hashes of many texts at once: a polynomial over the bytes, from one running sum."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64)]))
                self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BACK, np.uint64)]))

    def words(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        """For each text the 64-bit hashes of its words, A-Z lower-cased."""
        raw = _FOLD[np.frombuffer(b"".join(x for t in texts for x in (b" ", t)) + b" ", np.uint8)]
        self._powers(len(raw))
        gap = _SPACES[raw]
        starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        with np.errstate(over="ignore"):
            run = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=run[1:])
            h = mix((run[ends] - run[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = np.searchsorted(starts, firsts)
        return [h[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def sets(self, texts: Sequence[bytes], k: int) -> Iterator[np.ndarray]:
        """Sorted distinct shingle hashes of each text, in slices of bounded size."""
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) < _SLICE_BYTES:
                size += len(texts[end])
                end += 1
            for words in self.words(texts[at:end]):
                yield shingle_hashes(words, k)
            at = end


def _node(shingles: np.ndarray) -> bytes | None:
    """The name of a set: texts with the same set are one node."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _utf8(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


_SKETCH_SLICE = 1 << 14
#: Hash classes whose sizes are kept for each set, for the suffix filter of pairs.
_CLASSES = 64


def _class_sizes(shingles: np.ndarray, classes: int = _CLASSES) -> bytes:
    return np.minimum(255, np.bincount((shingles & np.uint64(classes - 1)).astype(np.int64), minlength=classes)).astype(np.uint8).tobytes()


def _profile(s: Settings):
    """Rows of documents (doc_id, key, n), and at a partition's end rows of its sketch (slice, counts)."""
    names = ["doc_id", "key", "n", "slice", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = Hasher(), np.zeros(1 << s.sketch_bits, np.uint32)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            keys, sizes = [], []
            for shingles in hasher.sets(_utf8(batch.column(1)), s.k):
                keys.append(_node(shingles))
                sizes.append(len(shingles))
                at = shingles >> np.uint64(64 - s.sketch_bits)
                # Sorted, so equal buckets are neighbours.
                new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
                counts[at[new].astype(np.int64)] += np.diff(np.append(new, len(at))).astype(np.uint32)
            n = len(keys)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if kind is not None:
            rows = counts.reshape(-1, min(_SKETCH_SLICE, len(counts)))
            used = np.flatnonzero(rows.any(axis=1))
            shrink = zstandard.ZstdCompressor(level=1).compress
            n = len(used)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array(used.astype(np.int32)), pa.array([shrink(rows[i].tobytes()) for i in used], pa.binary())], names)

    return run


def _sets(s: Settings):
    """(doc_id, key, n, classes, packed text) of texts that have words; the last two only where a set is large enough to link with others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, pack = Hasher(), zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = _utf8(batch.column(1))
            rows = []
            for text, shingles in zip(texts, hasher.sets(texts, s.k), strict=True):
                some = len(shingles) >= s.least
                rows.append((_node(shingles), len(shingles), _class_sizes(shingles) if some else None, pack(text) if some else None))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.binary(), pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "key", "n", "classes", "packed"]).filter(columns[0].is_valid())

    return run


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice to one row for each: levels, eight for each doubling of the count. One slice in memory."""
    unpack, at, total = zstandard.ZstdDecompressor().decompress, None, None

    def row():
        levels = np.minimum(255, np.round(8 * np.log2(1.0 + total))).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([levels.tobytes()], pa.binary())], ["slice", "levels"])

    for batch in batches:
        for which, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(unpack(packed), np.uint32).astype(np.uint64)
            if which != at and at is not None:
                yield row()
                total = None
            at, total = which, counts if total is None else total + counts
    if at is not None:
        yield row()


def _postings(levels, s: Settings):
    """(block, hot, node, place) of each set's prefix: its rarest shingles by the sketch, ties by hash. Columns: node, packed.

    place is 2**32 * position + set size. A frequent shingle's block is parted by node; hot then holds the shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, level_of, unpack = Hasher(), np.frombuffer(levels.value, np.uint8), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            nodes, made = batch.column(0).to_numpy(), []
            for node, shingles in zip(nodes, hasher.sets([unpack(x) for x in batch.column(1).to_pylist()], s.k), strict=True):
                n = len(shingles)
                level = level_of[(shingles >> np.uint64(64 - s.sketch_bits)).astype(np.int64)]
                p = int(s.prefix(n))
                first = np.lexsort((shingles, level))[:p]
                spread = np.maximum(1, 2.0 ** (level[first] / 8.0) / s.block).astype(np.uint64)
                made.append((shingles[first], spread, n, p))
            if made:
                size = np.array([m[3] for m in made])
                ends = np.cumsum(size)
                h, spread = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
                of, pos = np.repeat(nodes, size), np.arange(ends[-1]) - np.repeat(ends - size, size)
                with np.errstate(over="ignore"):
                    part = mix(of.astype(np.uint64)) % spread
                    block = np.where(part > 0, mix(h + part * np.uint64(_BASE)), h)
                place = (pos << 32) + np.repeat(np.array([m[2] for m in made], np.int64), size)
                yield pa.RecordBatch.from_arrays([pa.array(block.view(np.int64)), pa.array(h.view(np.int64), mask=spread < 2), pa.array(of), pa.array(place)], ["block", "hot", "node", "place"])

    return run


def _size(place: str):
    return F.call_function("mod", F.col(place), F.lit(1 << 32))


def _may_link(s: Settings, place1: str, place2: str):
    """Length filter, and positional filter for a shingle that both hold at these places of their order."""
    n1, n2 = _size(place1), _size(place2)
    left = lambda n, place: n - F.shiftright(F.col(place), 32)
    need = F.ceil(F.lit(s.percent) * (n1 + n2) / F.lit(100 + s.percent))
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * s.percent) & (F.least(left(n1, place1), left(n2, place2)) >= need)


def _suffix_filter(s: Settings):
    """Pairs whose sets may link by the sizes of their hash classes: what they differ by in each is not shared.

    Columns: hub, node, shared, must, hub_n, hub_c, node_n, node_c; the first four stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1).astype(np.int16) for i in (5, 7)]
            total = batch.column(4).to_numpy() + batch.column(6).to_numpy()
            need = -(-s.percent * total // (100 + s.percent))
            near = np.abs(sizes[0] - sizes[1]).sum(axis=1) <= total - 2 * need
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)], batch.schema.names[:4]).filter(pa.array(near))

    return run


def _close(pairs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """The pairs (hub, node, shared, must) that the suffix filter lets through."""
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"), F.col("classes").alias(f"{name}_c"))
    rows = pairs.join(side("node"), "node").join(side("hub"), "hub").select("hub", "node", "shared", "must", "hub_n", "hub_c", "node_n", "node_c")
    return rows.mapInArrow(_suffix_filter(s), "hub bigint, node bigint, shared bigint, must boolean")


def overlap(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """|a & b| of sorted arrays, or -1 where the suffix filter shows that it is below need.

    The filter cuts both at the same pivots; each cut's difference in size is a lower bound of what the sets don't share.
    """
    allowed = len(a) + len(b) - 2 * need
    if allowed < 0:
        return -1
    pivots = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)
    apart = np.abs(np.diff(np.concatenate([[0], np.searchsorted(a, pivots), [len(a)]])) - np.diff(np.concatenate([[0], np.searchsorted(b, pivots), [len(b)]]))).sum()
    if apart > allowed:
        return -1
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum())


def _verify(s: Settings):
    """Rows sorted by (hub, salt, member first false): each member's set against its hub's. Two sets in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, unpack, hub, of = Hasher(), zstandard.ZstdDecompressor().decompress, None, None
        for batch in batches:
            left, right, shared, union = [], [], [], []
            sets = hasher.sets([unpack(x) for x in batch.column(2).to_pylist()], s.k)
            for h, node, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets, strict=True):
                if h == node:
                    hub, of = h, shingles
                elif h == hub:
                    a, b = len(of), len(shingles)
                    both = overlap(of, shingles, -(-s.percent * (a + b) // (100 + s.percent)))
                    if both >= 0 and 100 * both >= s.percent * (a + b - both):
                        left.append(h)
                        right.append(node)
                        shared.append(both)
                        union.append(a + b - both)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (left, right, shared, union)], ["a", "b", "shared", "joint"])

    return run


#: Bits of the filter that spares texts no pair asks for; full, it spares none and nothing is lost.
_ASKED_BITS = 1 << 23


def _asked(nodes: DataFrame) -> np.ndarray:
    """A one-hash Bloom filter of nodes, of fixed size, as 64-bit words."""
    bit = F.pmod(F.xxhash64("node"), F.lit(_ASKED_BITS))
    words = nodes.select(bit.alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(_ASKED_BITS // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _payloads(asked):
    """The rows (node, packed) that asked holds (and a few more); xxh64 as Spark's xxhash64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = asked.value
        for batch in batches:
            raw = batch.column(0).to_numpy().astype("<i8").tobytes()
            bit = np.array([xxhash.xxh64_intdigest(raw[i : i + 8], 42) % _ASKED_BITS for i in range(0, len(raw), 8)], np.uint64)
            yield batch.filter(pa.array((filled[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)))

    return run


def verify_pairs(nodes: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """The distinct pairs (hub, node) whose sets link, as (a, b, shared, joint): sizes of intersection and union.

    Each pair is compared once; a hub's text is sent once for each salt of its pairs, a member's once for each hub.
    """
    counts = pairs.groupBy("hub").agg((1 + F.floor(F.count("*") / 250)).alias("salts"))
    dealt = stash(pairs.join(counts, "hub").select("hub", F.pmod(F.xxhash64("node"), "salts").alias("salt"), "node"), "pairs")
    wanted = dealt.unionByName(dealt.select("hub", "salt", F.col("hub").alias("node")).distinct())
    asked = nodes.sparkSession.sparkContext.broadcast(_asked(wanted))
    payload = nodes.where(F.col("packed").isNotNull()).select("node", "packed").mapInArrow(_payloads(asked), "node bigint, packed binary")
    rows = wanted.join(payload, "node").select("hub", "node", "packed", "salt")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("node") != F.col("hub"), "node")
    links = stash(rows.select("hub", "node", "packed").mapInArrow(thrifty(_verify(s)), "a bigint, b bigint, shared bigint, joint bigint"), "links")
    discard(dealt)
    return links


def _small_star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, moved) sorted by u, v: u keeps its smallest neighbour, to which its others are tied. A run's least in memory."""
    last_u = last_v = least = None
    for batch in batches:
        u, v, moved = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(u):
            continue
        new = np.concatenate([[u[0] != last_u], u[1:] != u[:-1]])
        again = ~new & np.concatenate([[v[0] == last_v], v[1:] == v[:-1]])
        run = np.cumsum(new)
        mins = np.concatenate([[0 if least is None else least], v[new]])[run]
        last_u, last_v, least = u[-1], v[-1], mins[-1]
        keep = ~again
        yield pa.RecordBatch.from_arrays([pa.array(np.where(new, u, v)[keep]), pa.array(np.where(new, v, mins)[keep]), pa.array((moved | ~new)[keep])], batch.schema.names)


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of links (a, b), a and b distinct.

    Edges lead from larger to smaller nodes. Each round ties a node's neighbours to the smallest of them and moves every
    edge to its end's smallest neighbour, which halves paths, until nothing moves. No round holds a node's edges at once.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), F.lit(False).alias("moved"))
    edges = None
    while True:
        if edges is not None:
            up = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("up"))
            pairs = edges.select("u", "v").join(up, "v", "left").select("u", F.coalesce("up", "v").alias("v"), F.col("up").isNotNull().alias("moved"))
        pairs = pairs.repartition("u").sortWithinPartitions("u", "v", F.desc("moved"))
        new = stash(pairs.mapInArrow(_small_star, "u bigint, v bigint, moved boolean"), "edges")
        if edges is not None:
            discard(edges)
            if new.where("moved").isEmpty():
                out = new.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
                out.stash_path = new.stash_path
                return out
        edges = new


def joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components of those that components() gave and of further links; label is discarded."""
    out = components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a != b").unionByName(links.select("a", "b")))
    discard(label)
    return out


def _named(blocks: DataFrame, label: DataFrame | None) -> DataFrame:
    """Rows (h, node, place, label) of blocks; without labels each node is its own."""
    rows = blocks.select(F.coalesce("hot", "block").alias("h"), "node", "place")
    return rows.withColumn("label", F.col("node")) if label is None else rows.join(label, "node", "left").select("h", "node", "place", F.coalesce("label", "node").alias("label"))


def cross_pairs(named: DataFrame, s: Settings) -> DataFrame:
    """(hub, node, shared, must): pairs of nodes of other labels that meet in a block and pass length and positional filters.

    Of two labels in a block one is not its main one: nodes of the others meet those of like size (bands of the length
    filter), a share of a large block in each task.
    """
    labels = named.groupBy("h", "label").agg(F.count("*").alias("c"))
    split = labels.groupBy("h").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels"), (1 + F.floor(F.sum("c") / s.share)).alias("salts")).where("labels > 1").drop("labels")
    # Sizes of linked sets are in the same band or in neighbouring ones.
    band = F.floor(F.log(_size("place").cast("double")) / F.lit(math.log(100 / s.percent) * 1.000001))
    open_ = named.join(split, "h").withColumn("band", band)
    x = open_.where(F.col("label") != F.col("main")).select("h", "band", F.pmod(F.xxhash64("node"), "salts").alias("salt"), "main", *(F.col(c).alias(f"x_{c}") for c in ("node", "place", "label")))
    y = open_.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))).select("h", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "salt", "node", "place", "label")
    met = x.join(y, ["h", "band", "salt"]).where((F.col("x_label") != F.col("label")) & ((F.col("label") == F.col("main")) | (F.col("x_node") < F.col("node"))) & _may_link(s, "x_place", "place"))
    return met.groupBy(F.least("x_node", "node").alias("node"), F.greatest("x_node", "node").alias("hub")).agg(F.count("*").alias("shared")).select("hub", "node", "shared", F.lit(False).alias("must"))


def _profiled(documents: DataFrame, s: Settings, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of documents (doc_id, key, n), nodes (node, key, least, n, classes, packed) and blocks (block, hot, node, place, head, head_place)."""
    spark = documents.sparkSession
    rows = documents.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    profile = stash(rows.mapInArrow(thrifty(_profile(s)), f"doc_id {kind}, key binary, n bigint, slice int, counts binary"), "profile")
    docs = profile.where(F.col("slice").isNull()).select("doc_id", "key", "n")

    slices = profile.where(F.col("slice").isNotNull()).select("slice", "counts").repartition("slice").sortWithinPartitions("slice")
    levels = np.zeros(1 << s.sketch_bits, np.uint8)
    for r in slices.mapInArrow(_sum_slices, "slice int, levels binary").collect():
        part = np.frombuffer(r["levels"], np.uint8)
        levels[r["slice"] * len(part) : (r["slice"] + 1) * len(part)] = part
    held = spark.sparkContext.broadcast(levels.tobytes())

    # Equal sets are one node, with one text, from here on.
    sets = rows.mapInArrow(thrifty(_sets(s)), f"doc_id {kind}, key binary, n bigint, classes binary, packed binary")
    nodes = sets.groupBy("key").agg(F.min("doc_id").alias("least"), F.first(F.struct("n", "classes", "packed")).alias("one"))
    nodes = stash(nodes.select(F.monotonically_increasing_id().alias("node"), "key", "least", "one.*"), "nodes")
    postings = nodes.where(F.col("packed").isNotNull()).select("node", "packed").mapInArrow(thrifty(_postings(held, s)), "block bigint, hot bigint, node bigint, place bigint")
    ordered = Window.partitionBy("block").orderBy("place", "node")
    blocks = postings.withColumn("head", F.first(F.struct("node", "place")).over(ordered)).withColumn("next", F.lead("node").over(ordered))
    blocks = blocks.where(F.col("next").isNotNull() | (F.col("node") != F.col("head.node")) | F.col("hot").isNotNull())
    blocks = stash(blocks.select("block", "hot", "node", "place", F.col("head.node").alias("head"), F.col("head.place").alias("head_place")), "blocks")
    return docs, nodes, blocks


def link_documents(documents: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the smallest document id reachable by links, its own included.

    Texts with equal sets are one node from the start. Every node is then compared with the head of one of its blocks
    (the nodes that share a prefix shingle; the head has the fewest rarer shingles), which joins most copies; what
    is left are the pairs inside blocks that are not connected yet: all of them that pass the length, positional and
    suffix filters are verified. So components are exact, and a large group of copies costs a comparison for each copy
    instead of each pair.

    A null or empty text, or one without words, has an empty set: n_shingles 0, linked with nothing, its own
    component. A null id takes part; it names no component unless all ids in it are null (component_id null). Rows of
    one id are separate documents. Other columns are not read; an empty table gives an empty result. Sets are of
    64-bit hashes; whole texts count.
    """
    s = settings
    docs, nodes, blocks = _profiled(documents, s, id_column, text_column)
    pair = lambda rows: rows.select("node", "place", F.col("head").alias("hub"), "head_place", F.col("hot").isNotNull().alias("must"))
    # Heads of a parted block meet the first of them.
    heads = blocks.where(F.col("hot").isNotNull() & (F.col("node") == F.col("head"))).withColumn("first", F.min(F.struct("place", "node")).over(Window.partitionBy("hot")))
    heads = heads.select("block", "hot", "node", "place", F.col("first.node").alias("head"), F.col("first.place").alias("head_place"))
    met = pair(blocks).withColumn("must", F.lit(False)).unionByName(pair(heads)).where((F.col("node") != F.col("hub")) & _may_link(s, "place", "head_place"))
    return connect(docs, nodes, blocks, met, s)


def connect(docs: DataFrame, nodes: DataFrame, blocks: DataFrame, met: DataFrame, s: Settings, left_over=None) -> DataFrame:
    """The components of docs (doc_id, key, n), as link_documents returns them; nodes and blocks are discarded.

    met: pairs (node, place, hub, head_place, must) to begin with, some hub of a block for each of its nodes; those that
    must be compared are, of the others each node's likeliest. blocks (block, hot, node, place) then give all other pairs;
    left_over, if given, makes of the labels so far better ones and those pairs (hub, node, shared, must), as a stash.
    """
    near = _close(met.groupBy("hub", "node").agg(F.count("*").alias("shared"), F.max("must").alias("must")), nodes, s)
    # A node is compared with the head that it shares most blocks with.
    best = near.groupBy("node").agg(F.max(F.struct("shared", "hub")).alias("top"), F.array_distinct(F.collect_list(F.when(F.col("must"), F.col("hub")))).alias("also"))
    best = stash(best.select("node", F.explode(F.array_union(F.array("top.hub"), "also")).alias("hub")), "best")
    links = verify_pairs(nodes, best, s)
    label = components(links)
    discard(links)

    if left_over:
        label, cross = left_over(label)
    else:
        cross = stash(_close(cross_pairs(_named(blocks, label), s), nodes, s).join(best.select("hub", "node"), ["hub", "node"], "left_anti"), "cross")
    discard(best)
    while True:
        of = lambda name: label.select(F.col("node").alias(name), F.col("label").alias(f"{name}_l"))  # noqa: E731, B023
        ends = cross.join(of("node"), "node", "left").join(of("hub"), "hub", "left").withColumns({"node_l": F.coalesce("node_l", "node"), "hub_l": F.coalesce("hub_l", "hub")})
        apart = stash(ends.where("node_l != hub_l").select("hub", "node", "shared", "must", "node_l", "hub_l"), "apart")
        discard(cross)
        pairs, members = apart.agg(F.count("*"), F.approx_count_distinct("node")).first()
        if not pairs:
            discard(apart)
            break
        asked = apart
        if pairs > 8 * members:
            # Far more pairs than nodes: first each node with its likeliest partner in each other component.
            both = apart.union(apart.select("node", "hub", "shared", "must", "hub_l", "node_l"))
            top = both.groupBy("node", "hub_l").agg(F.max(F.struct("shared", "hub")).alias("top")).select("node", F.col("top.hub").alias("hub"))
            asked = stash(top.select(F.greatest("hub", "node").alias("hub"), F.least("hub", "node").alias("node")).distinct(), "asked")
        more = verify_pairs(nodes, asked.select("hub", "node"), s)
        if not more.isEmpty():
            label = joined(label, more)
        discard(more)
        if asked is apart:
            discard(apart)
            break
        cross = stash(apart.join(asked, ["hub", "node"], "left_anti").select("hub", "node", "shared", "must"), "cross")
        discard(apart, asked)
    named = nodes.select("node", "key", "least").join(label, "node", "left").select("key", "least", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    # The texts go as soon as the components stand.
    found = stash(named.join(least, "label").select("key", "component_id"), "components")
    discard(blocks, nodes, label)
    out = docs.join(found, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def similar_pairs(documents: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, and the members of each set: (node_a, node_b, shared, joint) and (doc_id, node).

    node is the set's 64-bit name within this result; null for an empty set. Each candidate pair is verified once; the
    result grows with the links, so with the square of a group of near copies that all differ. Rows, nulls and other
    columns as in link_documents.
    """
    s = settings
    docs, nodes, blocks = _profiled(documents, s, id_column, text_column)
    links = verify_pairs(nodes, _close(cross_pairs(_named(blocks, None), s), nodes, s).select("hub", "node"), s)
    discard(blocks)
    return links.select(F.least("a", "b").alias("node_a"), F.greatest("a", "b").alias("node_b"), "shared", "joint"), docs.join(nodes.select("key", "node"), "key", "left").select("doc_id", "node")
