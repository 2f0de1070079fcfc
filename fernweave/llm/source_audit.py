"""Source divergence audit: smoothed term probabilities of sources, compared in dense blocks of terms."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernweave.llm.common import discard, stash, thrifty

#: A term is a run of ASCII letters and of characters beyond ASCII: in UTF-8 a run of these bytes.
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")
_PIECE = 1 << 20


@dataclass(frozen=True)
class Settings:
    #: A language keeps the terms in at least so many of its documents.
    documents: int = 30
    #: p = 1 + floor(scale * (count + smoothing) / (total + smoothing * terms)).
    smoothing: int = 5
    scale: int = 1_000_000_000
    #: Terms of a tile, and sources on each of its sides.
    terms: int = 2048
    sources: int = 64
    #: Terms reported for each source.
    top: int = 50
    #: Distinct (language, source, term) counts that a task holds before it hands them on.
    held: int = 400_000


def term_counts(text: bytes) -> Counter:
    """The terms of a text, A-Z lower-cased, with their counts; long texts in pieces that end between terms."""
    if len(text) <= _PIECE:
        return Counter(_TERM.findall(text.lower()))
    out, at = Counter(), 0
    while at < len(text):
        gap = _GAP.search(text, at + _PIECE)
        end = gap.start() if gap else len(text)
        out.update(_TERM.findall(text[at:end].lower()))
        at = end
    return out


def _counted(s: Settings):
    """(lang, source, text) to partial (lang, source, term, n, docs); the empty term stands for the source itself."""

    def rows(counts: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(terms) + 1)), pa.array([source] * (len(terms) + 1)), pa.array(["", *(t.decode() for t in terms)]), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in terms)], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = defaultdict(lambda: (Counter(), Counter())), 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                n, docs = counts[lang, source]
                before, own = len(n), term_counts(text)
                n.update(own)
                docs.update(own.keys())
                held += len(n) - before
                if held > s.held:
                    yield from rows(counts)
                    counts.clear()
                    held = 0
        yield from rows(counts)

    return run


def probability(count: np.ndarray, total: int, terms: int, s: Settings) -> np.ndarray:
    """1 + floor(scale * (count + smoothing) / (total + smoothing * terms)), exact: a long division with a remainder."""
    under = total + s.smoothing * terms
    q, left = np.divmod(count + s.smoothing, under)
    for digits in _digits(s.scale):
        more, left = np.divmod(left * digits, under)
        q = q * digits + more
    return q + 1


def _digits(scale: int) -> list[int]:
    """Factors of scale, of at most 1000 each: a remainder below 9 * 10**15 times one of them stays a 64-bit integer."""
    out = []
    while scale > 1000:
        out.append(next(d for d in range(1000, 1, -1) if scale % d == 0))
        scale //= out[-1]
    return [*out, scale]


def _dense(lists: list, first: int, width: int) -> np.ndarray:
    """Rows of (terms, counts) as a matrix of counts over the terms of a block."""
    out = np.zeros((len(lists), width), np.int64)
    for row, (at, n) in enumerate(lists):
        if at is not None:
            out[row, np.asarray(at, np.int64) - first] = n
    return out


_TILE = "lang string, block bigint, a bigint, b bigint, gid bigint, terms bigint, total bigint, tids array<bigint>, counts array<bigint>"


def _width(terms: int, block: int, s: Settings) -> int:
    return min(s.terms, terms - block * s.terms)


def _pairs(s: Settings):
    """A tile's rows to its partial matrix of sums |p - q| over the block's terms: (lang, a, b, left, right, sums)."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lang, block, a, b, terms = (rows[0][c] for c in ("lang", "block", "a", "b", "terms"))
        width = _width(terms, block, s)
        sides = []
        for side in (a, b):
            own = sorted((r for r in rows if r["gid"] // s.sources == side), key=lambda r: r["gid"])
            counts = _dense([(r["tids"], r["counts"]) for r in own], block * s.terms, width)
            p = np.stack([probability(c, r["total"], terms, s) for c, r in zip(counts, own, strict=True)]) if terms else np.zeros((len(own), 0), np.int64)
            sides.append(([r["gid"] for r in own], p))
        (left, p), (right, q) = sides
        # One row of the left side against all of the right one at a time.
        sums = np.stack([np.abs(x[None, :] - q).sum(axis=1) for x in p])
        return pa.table({"lang": [lang], "a": [a], "b": [b], "left": pa.array([left], pa.list_(pa.int64())), "right": pa.array([right], pa.list_(pa.int64())), "sums": pa.array([sums.astype("<i8").tobytes()], pa.binary())})

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial matrices sorted by (lang, a, b) to rows (lang, gid, other, value), both ways. One matrix in memory."""
    key, now = None, None

    def done() -> pa.RecordBatch:
        lang, a, b = key
        left, right, total = now
        i, j = np.repeat(left, len(right)), np.tile(right, len(left))
        value = total.ravel()
        if a == b:
            i, j, value = (x[i != j] for x in (i, j, value))
        else:
            i, j, value = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(value, 2)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), *(pa.array(x, pa.int64()) for x in (i, j, value))], ["lang", "gid", "other", "value"])

    for batch in batches:
        for row in batch.to_pylist():
            part = np.frombuffer(row["sums"], "<i8").reshape(len(row["left"]), len(row["right"]))
            if (row["lang"], row["a"], row["b"]) != key:
                if key is not None:
                    yield done()
                key, now = (row["lang"], row["a"], row["b"]), (np.array(row["left"]), np.array(row["right"]), part.copy())
            else:
                now[2][:] += part
    if key is not None:
        yield done()


def _heaps(s: Settings):
    """Rows of one block, each source's counts beside its language's: (lang, gid, tid, value) of the block's best terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            lists = {c: columns.pop(c) for c in ("tids", "counts", "lang_counts")}
            for i, r in enumerate(pa.RecordBatch.from_arrays(list(columns.values()), list(columns)).to_pylist()):
                at, n, all_n = (x[i].values.to_numpy() for x in lists.values())
                lead = probability(n, r["total"], r["terms"], s) - probability(all_n, r["lang_total"], r["terms"], s)
                # Numbers of terms follow their order, so they settle ties.
                best = np.lexsort((at, -lead))[: s.top]
                best = best[lead[best] > 0]
                out.append((r["lang"], r["gid"], at[best], lead[best]))
            if not out:
                continue
            sizes = [len(x[2]) for x in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array([x[0] for x in out], object), sizes), pa.string()), pa.array(np.repeat([x[1] for x in out], sizes), pa.int64()), *(pa.array(np.concatenate([x[i] for x in out]), pa.int64()) for i in (2, 3))],
                ["lang", "gid", "tid", "value"],
            )

    return run


def _numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """rows (lang, by, ...) with the place of each, from 0, among its language's in the order of `by` (UTF-8), as `name`.

    Rows are dealt by ranges and written; a range knows its own places, and starts after the counts of those before.
    """
    dealt = rows.repartitionByRange("lang", by).sortWithinPartitions("lang", by)
    placed = stash(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), name)
    counts = placed.groupBy("lang", "part").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("lang", "part", (before - F.col("first")).alias("shift"))
    return placed.join(starts, ["lang", "part"]).withColumn(name, F.col("at") + F.col("shift")).drop("part", "at", "shift")


def audit_sources(documents: DataFrame, settings: Settings = Settings(), text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and by which terms.

    Part `pair`: the other sources by the sum of |p - q| over all kept terms, farthest first. Part `term`: the terms of the
    source that it has more often than its language, by how much, at most `top`. Ties go by the item's UTF-8 bytes.

    Counts are made in one pass and summed by (lang, source, term). Kept terms get numbers in their order; each tile is
    the sources of two groups over a block of terms as dense numpy int64 matrices, and all pairs of the tile are compared
    by broadcasting. Tiles of one pair of groups are added up, the best terms of a source in each block are merged. A task
    holds one tile, whatever the number of terms, sources or documents.

    Null text, lang and source are taken as empty; a source without kept terms still has its pairs; a language without any
    has pairs of value 0. Repeated rows count each; other columns are not read; an empty table gives an empty result.
    """
    s = settings
    cut = documents.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((lang_column, "lang"), (source_column, "source"), (text_column, "text"))))
    partial = cut.mapInArrow(thrifty(_counted(s)), "lang string, source string, term string, n bigint, docs bigint")
    counts = stash(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")

    sources = _numbered(counts.where("term = ''").select("lang", "source"), "source", "gid")
    vocabulary = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= s.documents)
    terms = stash(_numbered(vocabulary.select("lang", "term", "n"), "term", "tid"), "terms")
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    sources = stash(sources.join(langs, "lang", "left").select("lang", "source", "gid", F.coalesce("terms", F.lit(0)).cast("bigint").alias("terms"), F.coalesce("lang_total", F.lit(0)).cast("bigint").alias("lang_total")), "sources")

    cells = counts.where("term <> ''").select("lang", "source", "term", "n").join(terms.select("lang", "term", "tid", F.col("n").alias("lang_n")), ["lang", "term"])
    cells = cells.join(sources.select("lang", "source", "gid"), ["lang", "source"]).withColumn("block", F.floor(F.col("tid") / s.terms))
    packed = cells.groupBy("lang", "gid", "block").agg(F.array_sort(F.collect_list(F.struct("tid", "n", "lang_n"))).alias("x"), F.sum("n").alias("own"))
    packed = stash(packed.select("lang", "gid", "block", "own", *(F.col(f"x.{c}").alias(n) for c, n in (("tid", "tids"), ("n", "counts"), ("lang_n", "lang_counts")))), "packed")
    totals = packed.groupBy("lang", "gid").agg(F.sum("own").alias("total"))
    sources = sources.join(totals, ["lang", "gid"], "left").withColumn("total", F.coalesce("total", F.lit(0)).cast("bigint"))

    groups = 1 + F.floor(F.col("many") / s.sources)
    many = sources.groupBy("lang").agg(F.max("gid").alias("many"))
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil(F.col("terms") / s.terms) - 1)))
    rows = sources.join(many, "lang").select("lang", "gid", "terms", "total", "many", blocks.alias("block")).join(packed.select("lang", "gid", "block", "tids", "counts"), ["lang", "gid", "block"], "left")
    own = F.floor(F.col("gid") / s.sources)
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), groups - 1))).select("lang", "block", F.least(own, "with").alias("a"), F.greatest(own, "with").alias("b"), "gid", "terms", "total", "tids", "counts")
    tiles = rows.groupBy("lang", "block", "a", "b").applyInArrow(_pairs(s), "lang string, a bigint, b bigint, left array<bigint>, right array<bigint>, sums binary")
    sums = tiles.repartition("lang", "a", "b").sortWithinPartitions("lang", "a", "b").mapInArrow(_summed, "lang string, gid bigint, other bigint, value bigint")

    of_terms = packed.join(sources.select("lang", "gid", "terms", "total", "lang_total"), ["lang", "gid"]).mapInArrow(_heaps(s), "lang string, gid bigint, tid bigint, value bigint")
    ranked = lambda rows, item: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "gid").orderBy(F.desc("value"), item)))
    # Of a block at most `top` come, so a source's candidates are few; numbers of sources and terms follow their order.
    best = ranked(of_terms, "tid").where(F.col("rank") <= s.top).join(terms.select("lang", "tid", F.col("term").alias("item")), ["lang", "tid"]).withColumn("part", F.lit("term"))
    pairs = ranked(sums, "other").join(sources.select("lang", F.col("gid").alias("other"), F.col("source").alias("item")), ["lang", "other"]).withColumn("part", F.lit("pair"))
    columns = ["lang", "gid", "part", "item", "value", "rank"]
    both = pairs.select(*columns).unionByName(best.select(*columns)).join(sources.select("lang", "gid", "source"), ["lang", "gid"])
    return both.select("lang", "source", "part", "item", "value", "rank")
