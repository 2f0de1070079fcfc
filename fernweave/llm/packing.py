"""Lexical retrieval packing: BM25 indexes over shards of like texts find unused neighbours that fill each seed's window."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.llm.common import give_back, mix, stash, thrifty
from fernweave.llm.tokens import codec_of, forget_codec, runs, with_end

_DF_SLICE = 4096


@dataclass(frozen=True)
class Settings:
    window: int = 2048
    end_id: int = 1
    #: Tokens of an index shard, about: a shard is one task's memory.
    shard_tokens: int = 2_000_000
    k1: float = 1.2
    b: float = 0.75


class Distinct:
    """The distinct ids of texts, by one table of the vocabulary instead of a sort for each text."""

    def __init__(self, size: int):
        self.last, self.places = np.zeros(size, np.int64), np.arange(4096)

    def _last(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each id is last, and the places that are last ones."""
        if len(ids) > len(self.places):
            self.places = np.arange(2 * len(ids))
        at, ids = self.places[: len(ids)], ids.astype(np.int64)
        self.last[ids] = at
        last = self.last[ids]
        return last, np.flatnonzero(last == at)

    def once(self, ids: np.ndarray) -> np.ndarray:
        """Each id once."""
        return ids[self._last(ids)[1]]

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each id once, and how often it is there."""
        last, own = self._last(ids)
        return ids[own], np.bincount(last, minlength=len(ids))[own]


def _encode(held, s: Settings):
    """Rows (uid, doc_id, n, ids), and at a partition's end its document frequencies (slice, df, documents, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, kind, seen, tokens = codec_of(held.value), None, 0, 0
        df = np.zeros(-(-codec.size // _DF_SLICE) * _DF_SLICE, np.int64)
        distinct = Distinct(len(df))
        wide = "<u2" if codec.size <= 1 << 16 else "<u4"
        first = TaskContext.get().partitionId() << 33
        names = ["uid", "doc_id", "n", "ids", "slice", "df", "documents"]
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b, ids, sizes in codec.encode_slices(batch.column(1)):
                n = b - a
                ends = np.cumsum(sizes)
                for x, y in zip(ends - sizes, ends, strict=True):
                    df[distinct.once(ids[x:y])] += 1
                ids, sizes = with_end(ids, sizes, s.end_id)
                blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * np.dtype(wide).itemsize), pa.py_buffer(ids.astype(wide))])
                tokens += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + seen, first + seen + n)), batch.column(0).slice(a, n), pa.array(sizes), blobs, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names)
                seen += n
        if kind is not None:
            rows = df.reshape(-1, _DF_SLICE)
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, kind), pa.array([tokens] + [0] * (n - 1)), pa.nulls(n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([seen] + [0] * (n - 1))], names)

    return run


def _sum_df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice, one sum at a time."""
    at, total, count, size = None, None, 0, 0
    names = ["slice", "df", "documents", "n"]

    def row():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([count]), pa.array([size])], names)

    for batch in batches:
        for which, df, documents, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if which != at and at is not None:
                yield row()
                total, count, size = None, 0, 0
            df = np.frombuffer(df, np.int64)
            at, total, count, size = which, df if total is None else total + df, count + documents, size + n
    if at is not None:
        yield row()


def _piece_schema(kind: str, with_ids: bool) -> str:
    return f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + (", ids array<int>" if with_ids else "")


def _pieces(kind: pa.DataType, rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    """rows: (doc_id, start, ids as uint32, doc_tokens, sequence_id, offset)."""
    columns = [
        pa.array([r[0] for r in rows], kind),
        pa.array([r[1] for r in rows], pa.int64()),
        pa.array([len(r[2]) for r in rows], pa.int64()),
        pa.array([zlib.crc32(r[2].tobytes()) for r in rows], pa.int64()),
        *(pa.array([r[i] for r in rows], pa.int64()) for i in (3, 4, 5)),
    ]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if with_ids:
        columns.append(pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def _full_windows(s: Settings, with_ids: bool):
    """The windows that a long document fills alone. Columns: doc_id, n, ids, wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 34
        for batch in batches:
            rows, kind = [], batch.schema.field(0).type
            for doc, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype("<u4")
                for at in range(0, n - n % s.window, s.window):
                    rows.append((doc, at, ids[at : at + s.window], n, sequence, 0))
                    sequence += 2
                if len(rows) >= 500:
                    yield _pieces(kind, rows, with_ids)
                    rows = []
            yield _pieces(kind, rows, with_ids)

    return run


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(x.astype(np.uint64) * np.uint64(2) + np.uint64(1) + np.uint64(salt << 40))


class LexicalKeys:
    """Two of the words that a text shares with others, drawn by weighted min-hash; -1 where there is none.

    Weights are those of BM25, so the chance that two texts draw the same word is their weighted similarity.
    """

    def __init__(self, idf: np.ndarray, df: np.ndarray, s: Settings):
        self.s, self.distinct = s, Distinct(len(df))
        self.weight = np.where(df > 1, idf * (s.k1 + 1), 0.0)
        draws = [-np.log((_mixed(np.arange(len(df)), salt) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) for salt in (1, 2)]
        #: By weight, but for the part of it that a text's count makes; infinite for words that no other text has.
        self.draws = [np.divide(d, self.weight, out=np.full(len(df), np.inf), where=self.weight > 0) for d in draws]

    def of(self, ids: np.ndarray) -> tuple[int, int]:
        terms, tf = self.distinct.of(ids if ids.max(initial=0) < len(self.weight) else ids[ids < len(self.weight)])
        if not len(terms):
            return -1, -1
        by_count = 1 + self.s.k1 / tf
        drawn = [draw[terms] * by_count for draw in self.draws]
        least = [int(d.argmin()) for d in drawn]
        return tuple(int(terms[i]) if d[i] < np.inf else -1 for d, i in zip(drawn, least, strict=True))


def _keyed(stats, s: Settings):
    """Columns key and other from the rows' tails, before all columns. Columns: uid, doc_id, n, tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_codec()
        idf, df, _ = stats.value
        draw = LexicalKeys(idf, df, s)
        for batch in batches:
            keys = [draw.of(np.frombuffer(blob, "<u2" if len(blob) == 2 * (n % s.window) else "<u4")) for n, blob in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            keys = np.array(keys, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), *batch.columns], ["key", "other", *batch.schema.names])

    return run


class Dealing:
    """Shards of keys, of about shard_tokens at most.

    A key larger than a shard is parted by the other word, and what is still larger by row. tokens: for each key;
    parted: for each key and part, where sizes are known.
    """

    def __init__(self, tokens: dict[int, int], limit: int):
        self.limit = limit
        size = max(tokens, default=-1) + 2
        #: Parts of a key; the key of texts without one is the first.
        self.parts = np.ones(size, np.int64)
        for key, n in tokens.items():
            if n > limit:
                self.parts[key + 1] = 8 * -(-n // limit)
        self.first_part = np.cumsum(self.parts) - self.parts

    @property
    def large(self) -> list[int]:
        return [int(k) - 1 for k in np.flatnonzero(self.parts > 1)]

    def settle(self, tokens: dict[int, int], parted: dict[tuple[int, int], int]) -> None:
        sizes = np.zeros(int(self.parts.sum()), np.int64)
        for key, n in tokens.items():
            if self.parts[key + 1] == 1:
                sizes[self.first_part[key + 1]] = n
        for (key, part), n in parted.items():
            sizes[self.first_part[key + 1] + part] = n
        self.shard, self.shares = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // self.limit))
        shard, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > self.limit:
                shard, held = shard + 1, 0
            self.shard[i] = shard
            if self.shares[i] > 1:
                shard, held = shard + int(self.shares[i]), 0
            else:
                held += n

    def part(self, key: np.ndarray, other: np.ndarray) -> np.ndarray:
        return (_mixed(other + 1, 3) % self.parts[key + 1].astype(np.uint64)).astype(np.int64)

    def of(self, key: np.ndarray, other: np.ndarray, uid: np.ndarray) -> np.ndarray:
        slot = self.first_part[key + 1] + self.part(key, other)
        return self.shard[slot] + (_mixed(uid, 4) % self.shares[slot].astype(np.uint64)).astype(np.int64)


def _dealt(dealing):
    """Column shard before uid, doc_id, n and tail. Columns: key, other, uid, doc_id, n, tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = dealing.value.of(*(batch.column(i).to_numpy() for i in range(3)))
            yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns[2:]], ["shard", *batch.schema.names[2:]])

    return run


def _parts(dealing):
    """(key, part, n): tokens of each part in a partition. Columns: key, other, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, other, n = (c.to_numpy() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(dealing.value.part(key, other)), pa.array(n)], ["key", "part", "n"])

    return run


def deal(tails: DataFrame, s: Settings) -> Dealing:
    """How rows (key, other, uid, doc_id, n, tail) go to shards; what the driver holds is bounded by the vocabulary and the number of shards."""
    size = F.pmod(F.col("n"), F.lit(s.window))
    tokens = {r["key"]: r["n"] for r in tails.groupBy("key").agg(F.sum(size).alias("n")).collect()}
    dealing, parted = Dealing(tokens, s.shard_tokens), {}
    if dealing.large:
        held = tails.sparkSession.sparkContext.broadcast(dealing)
        large = tails.where(F.col("key").isin(dealing.large)).select("key", "other", size.alias("n")).mapInArrow(_parts(held), "key bigint, part bigint, n bigint")
        parted = {(r["key"], r["part"]): r["n"] for r in large.groupBy("key", "part").agg(F.sum("n").alias("n")).collect()}
    dealing.settle(tokens, parted)
    return dealing


#: Words of more than this part of a shard's pieces may be whole rows.
_DENSE = 16


class ShardIndex:
    """BM25 over the pieces of one shard, as one sorted array of postings."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean: float, s: Settings):
        distinct = Distinct(max([len(idf), *(int(p.max()) + 1 for p in pieces if len(p))]))
        own = [distinct.of(p) for p in pieces]
        self.terms = [t for t, _ in own]
        sizes = np.array([len(t) for t in self.terms])
        token = np.concatenate(self.terms)
        tf = np.concatenate([c for _, c in own]).astype(float)
        where = np.repeat(np.arange(len(pieces)), sizes)
        length = np.array([len(p) for p in pieces], float)[where]
        weight = idf[token] * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * length / mean))
        # The most frequent words are whole rows, as much as their postings take or a few times that: to add rows up is far
        # cheaper than to gather postings.
        spread = np.bincount(token, minlength=len(idf))
        frequent = np.argsort(-spread, kind="stable")[: 2 * len(token) // len(pieces)]
        frequent = frequent[_DENSE * spread[frequent] > len(pieces)]
        self.row = np.full(len(idf), -1, np.int64)
        self.row[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), len(pieces)))
        dense = self.row[token] >= 0
        self.rows[self.row[token[dense]], where[dense]] = weight[dense]
        token, where, weight = token[~dense], where[~dense], weight[~dense]
        order = np.argsort(token, kind="stable")
        self.where, self.weight = where[order], weight[order]
        self.bounds = np.searchsorted(token[order], np.arange(len(idf) + 1))
        #: Places of pieces among those that are still held.
        self.held = np.arange(len(pieces))

    def keep(self, left: np.ndarray) -> None:
        """Holds those of the held pieces that are left; left: of all pieces."""
        stay = left[self.held]
        place = np.cumsum(stay) - 1
        postings = stay[self.where]
        self.bounds = np.concatenate([[0], np.cumsum(postings)])[self.bounds]
        self.where, self.weight = place[self.where[postings]], self.weight[postings]
        self.rows, self.held = self.rows[:, stay], self.held[stay]

    def scores(self, piece: int) -> np.ndarray:
        """The BM25 score of every held piece for the words of one."""
        terms = self.terms[piece]
        row = self.row[terms]
        few = terms[row < 0]
        a, b = self.bounds[few], self.bounds[few + 1]
        at = runs(a, b - a)
        found = np.bincount(self.where[at], weights=self.weight[at], minlength=len(self.held))
        asked = np.zeros(len(self.rows))
        asked[row[row >= 0]] = 1.0
        return found + asked @ self.rows


def pack_shard(pieces: list[np.ndarray], idf: np.ndarray, mean: float, s: Settings) -> list[list[tuple[int, int, int]]]:
    """Windows of (piece, from, to): each takes the longest unused piece as its seed, then the best unused neighbours.

    A neighbour that does not fit is cut; its rest stays unused. So every window but the last is full.
    """
    index = ShardIndex(pieces, idf, mean, s)
    at, size = np.zeros(len(pieces), np.int64), np.array([len(p) for p in pieces], np.int64)
    windows = []
    for seed in np.argsort(-size, kind="stable").tolist():
        if at[seed] == size[seed]:
            continue
        window, room = [(seed, int(at[seed]), int(size[seed]))], s.window - int(size[seed] - at[seed])
        at[seed] = size[seed]
        if room:
            left = at < size
            if 8 * np.count_nonzero(left[index.held]) < 7 * len(index.held):
                index.keep(left)
            held = index.held
            scores = np.where(left[held], index.scores(seed), -1.0)
            few = min(48, len(scores))
            best = np.argpartition(-scores, few - 1)[:few] if few else held[:0]
            best = best[np.lexsort((best, -scores[best]))]
            if (size - at)[held[best[scores[best] >= 0]]].sum() < room:
                best = np.lexsort((np.arange(len(scores)), -scores))
            for place in best.tolist():
                if not room or scores[place] < 0:
                    break
                piece = int(held[place])
                take = min(room, int(size[piece] - at[piece]))
                window.append((piece, int(at[piece]), int(at[piece]) + take))
                at[piece] += take
                room -= take
        windows.append(window)
    return windows


def pack_documents(documents: DataFrame, tokenizer_path: str, settings: Settings = Settings(), with_ids: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids.

    A document's ids end with end_id. Full windows of a long document are sequences of their own; its rest is packed
    with lexical neighbours of its shard. Document frequencies are counted over all documents. All sequences are full
    but one for each shard at most.

    A null or empty text is its end id alone. Repeated rows are documents of their own, null ids are kept. Other
    columns are not read; an empty table gives an empty result. Texts that draw the same word by weighted min-hash share
    a shard, so near copies and texts of a topic mostly meet; a word of too many texts is parted by a second draw, then
    by row. So a shard's size is bounded, and so is what a task holds. One shard holds all of a small table.
    """
    s, spark = settings, documents.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    coded = stash(rows.mapInArrow(thrifty(_encode(held, s)), f"uid bigint, doc_id {kind}, n bigint, ids binary, slice int, df binary, documents bigint"), "coded")
    sums = coded.where(F.col("slice").isNotNull()).select("slice", "df", "documents", "n").repartition("slice").sortWithinPartitions("slice")
    got = sorted(sums.mapInArrow(_sum_df, "slice int, df binary, documents bigint, n bigint").collect())
    docs, tokens = sum(r["documents"] for r in got), sum(r["n"] for r in got)
    df = np.concatenate([np.frombuffer(r["df"], np.int64) for r in got]) if got else np.zeros(1, np.int64)
    idf, mean = np.log1p((docs - df + 0.5) / (df + 0.5)), max(1.0, min(tokens / max(1, docs), s.window))
    stats = spark.sparkContext.broadcast((idf, df, mean))

    texts = coded.where(F.col("slice").isNull())
    full = texts.where(F.col("n") >= s.window).select("doc_id", "n", "ids").mapInArrow(thrifty(_full_windows(s, with_ids)), _piece_schema(kind, with_ids))
    rest = F.pmod(F.col("n"), F.lit(s.window))
    wide = F.octet_length("ids") / F.col("n")
    tails = texts.where(rest > 0).select("uid", "doc_id", "n", F.substr("ids", ((F.col("n") - rest) * wide + 1).cast("int"), (rest * wide).cast("int")).alias("tail"))
    if tokens > s.shard_tokens:
        keyed = stash(tails.mapInArrow(thrifty(_keyed(stats, s)), f"key bigint, other bigint, uid bigint, doc_id {kind}, n bigint, tail binary"), "tails")
        dealing = spark.sparkContext.broadcast(deal(keyed, s))
        tails = keyed.mapInArrow(_dealt(dealing), f"shard bigint, uid bigint, doc_id {kind}, n bigint, tail binary")
    else:
        tails = tails.select(F.lit(0).cast("bigint").alias("shard"), "*")

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        forget_codec()
        group = group.sort_by("uid").combine_chunks()
        shard, field = key[0].as_py(), group.schema.field("doc_id").type
        ids, n, blobs = (group.column(c).to_pylist() for c in ("doc_id", "n", "tail"))
        pieces = [np.frombuffer(b, "<u2" if len(b) == 2 * (m % s.window) else "<u4").astype("<u4") for b, m in zip(blobs, n, strict=True)]
        idf, _, mean = stats.value
        out, sequence = [], (shard << 34) + 1
        for window in pack_shard(pieces, np.append(idf, np.zeros(max(0, s.end_id + 1 - len(idf)))), mean, s):
            offset = 0
            for piece, a, b in window:
                out.append((ids[piece], n[piece] - n[piece] % s.window + a, pieces[piece][a:b], n[piece], sequence, offset))
                offset += b - a
            sequence += 2
        made = pa.Table.from_batches([_pieces(field, out, with_ids)])
        del group, blobs, pieces, out
        give_back()
        return made

    packed = tails.groupBy("shard").applyInArrow(pack, _piece_schema(kind, with_ids))
    return full.unionByName(packed)
