"""BPE encoding and decoding by dynamic programming over the prefixes of each pretoken."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.llm.common import Memo, thrifty

#: Texts that are encoded side by side.
SLICE = 1_000
#: The pattern that splits text before byte-level merges.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(shown))
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letter[b] for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """token: the bytes of each id; rank: of each id that a merge makes; pair: (left, right) -> id; parts: id -> (left, right)."""

    token: dict[int, bytes]
    rank: dict[int, int]
    pair: dict[tuple[int, int], int]
    parts: dict[int, tuple[int, int]]
    special: dict[str, int] = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> Vocabulary:
        """A byte-level BPE file of the tokenizers library."""
        data = json.loads(text)
        model, of = data["model"], {c: b for b, c in enumerate(byte_letters())}
        ids = model["vocab"]
        rank, pair, parts = {}, {}, {}
        for at, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            made, a, b = ids[left + right], ids[left], ids[right]
            if made not in rank:
                rank[made], parts[made] = at, (a, b)
            pair[a, b] = made
        special = {x["content"]: x["id"] for x in data["added_tokens"]}
        return cls({i: bytes(of[c] for c in s) for s, i in ids.items()}, rank, pair, parts, special)


class IntTable:
    """A hash table of non-negative int64 keys and values for whole arrays at once: open addressing, linear probes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, int(len(keys) * 4).bit_length())
        self.shift, self.mask, self.n = np.uint64(64 - bits), (1 << bits) - 1, len(keys)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        self.add(keys, values)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys, none of them present."""
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            put = self.keys[slot] == keys
            self.values[slot[put]] = values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """-1 for keys that are absent."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            found = self.keys[slot[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out


class SuffixAutomaton:
    """After each byte of a text: the vocabulary tokens that are suffixes of what was read.

    Of the suffix automaton of the vocabulary only those states are kept that can end a token later: the prefixes of
    tokens, each with the suffix link to the longest of its suffixes that is one too. Reading a text, the state is its
    longest suffix that is a prefix of a token, so the tokens on its chain of links are all tokens that are suffixes of
    what was read, which is what the encoder asks for; substrings that start no token would only cost memory. longest[s] is the longest token that is a suffix of state s (-1: none),
    shorter[s] the state to ask for the next shorter one. Transitions are one table of (state, byte) keys, so that
    many texts step at once.
    """

    def __init__(self, tokens: dict[bytes, int]):
        states: dict[bytes, int] = {b"": 0}
        for text in tokens:
            for end in range(1, len(text) + 1):
                states.setdefault(text[:end], len(states))
        n = len(states)
        self.fail, self.longest, self.shorter = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
        keys = np.zeros(n - 1, np.int64)
        for text in sorted(states, key=len):
            s = states[text]
            if not s:
                continue
            keys[s - 1] = states[text[:-1]] * 256 + text[-1]
            if len(text) > 1:
                back = int(self.fail[states[text[:-1]]])
                suffix = text[1:]
                while suffix not in states:
                    suffix = suffix[1:]
                self.fail[s] = states[suffix]
            back = int(self.fail[s])
            self.shorter[s] = back if self.longest[back] < 0 or text in tokens else self.shorter[back]
            own = tokens.get(text, -1)
            self.longest[s] = own if own >= 0 else self.longest[back]
        self.moves = IntTable(keys, np.arange(1, n))

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        out = self.moves.get(states * 256 + symbols)
        rows = np.flatnonzero(out < 0)
        back = states[rows]
        while len(rows):
            rows, back = rows[back > 0], self.fail[back[back > 0]]
            out[rows] = self.moves.get(back * 256 + symbols[rows])
            still = out[rows] < 0
            rows, back = rows[still], back[still]
        return np.maximum(out, 0)


class PrefixEncoder:
    """Exact merge-order BPE without merging.

    Merge-order BPE gives each prefix of a pretoken exactly one encoding, so of the tokens that are suffixes of the
    prefix exactly one can be its last: the one whose merges survive next to the last token of the prefix before it.
    That token is stored for every prefix, and back-pointers from the end give the ids. Many pretokens run side by
    side, one byte a step.
    """

    #: Pairs of tokens whose compatibility is remembered, at most.
    PAIRS = 2_000_000
    #: A longer pretoken is read in segments of so many bytes, side by side.
    SEGMENT = 1_024

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        usable = {t: i for i, t in vocabulary.token.items() if i in vocabulary.parts or len(t) == 1}
        self.automaton = SuffixAutomaton(usable)
        self.length = np.zeros(max(vocabulary.token) + 2, np.int64)
        for t, i in usable.items():
            self.length[i] = len(t)
        self.reach = int(self.length.max(initial=1))
        self.pairs = IntTable(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        fit = self.pairs.get(keys)
        new = np.unique(keys[fit < 0])
        if len(new):
            if self.pairs.n > self.PAIRS:
                self.pairs, new = IntTable(new[:0], new[:0]), np.unique(keys)
            made = np.array([self._compatible(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], np.int64)
            if (self.pairs.n + len(new)) * 2 > len(self.pairs.keys):
                held = self.pairs.keys >= 0
                self.pairs = IntTable(np.concatenate([self.pairs.keys[held], new]), np.concatenate([self.pairs.values[held], made]))
            else:
                self.pairs.add(new, made)
                self.pairs.n += len(new)
            fit = self.pairs.get(keys)
        return fit > 0

    def _compatible(self, left: int, right: int) -> bool:
        """Do left and right stay as they are when their texts stand side by side?

        Undo the two tokens' merges from the latest back. Whenever the parts that touch at the seam make a token,
        its merge must come too late: after the merge that hid one of the touching parts.
        """
        rank, parts, pair = self.v.rank, self.v.parts, self.v.pair
        hides_left = hides_right = len(rank) + 1
        while True:
            made = pair.get((left, right))
            # Equal merges run from left to right, so one at the seam goes before the same one right of it.
            if made is not None and rank[made] < hides_left and rank[made] <= hides_right:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a >= b:
                hides_left, left = a, parts[left][1]
            else:
                hides_right, right = b, parts[right][0]

    def encode_many(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Ids of each pretoken, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        at = 0
        while at < len(order) and len(pieces[order[at]]) > 2 * self.SEGMENT:
            out[order[at]] = self._long(pieces[order[at]])
            at += 1
        while at < len(order):
            longest = max(1, len(pieces[order[at]]))
            rows = order[at : at + max(1, 500_000 // longest)]
            for row, ids in zip(rows, self._block([pieces[i] for i in rows], longest), strict=True):
                out[row] = ids
            at += len(rows)
        return out

    def _long(self, piece: bytes) -> bytes:
        """A long pretoken in segments, each read together with what is before it.

        A prefix's last token follows from the bytes and the last tokens within the longest token's length before it. So
        a segment that gives the same last tokens as the one before it over that length, where both read, goes on just as
        the whole would. Where it does not, it is read again behind the true ones.
        """
        ahead = self.SEGMENT // 4 * max(1, -(-self.reach * 8 // self.SEGMENT))
        starts = list(range(0, len(piece), self.SEGMENT))
        parts = [piece[max(0, s - ahead) : s + self.SEGMENT] for s in starts]
        order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
        guess = self._last([parts[i] for i in order], max(map(len, parts)))
        column = {i: guess[:, j] for j, i in enumerate(order)}
        last = np.full(len(piece) + 1, -1, np.int64)
        for i, start in enumerate(starts):
            end, skip = min(len(piece), start + self.SEGMENT), min(start, ahead)
            near = min(skip, self.reach)
            own = column[i]
            if start and not np.array_equal(own[skip - near : skip + 1], last[start - near : start + 1]):
                context = max(0, start - 2 * self.reach)
                own = self._last([piece[context:end]], end - context, last[context : start + 1])[:, 0]
                skip = start - context
            last[start + 1 : end + 1] = own[skip + 1 : skip + 1 + end - start]
        ids, at = [], len(piece)
        while at:
            if last[at] < 0:
                raise ValueError("the vocabulary has no token for some byte")
            ids.append(last[at])
            at -= int(self.length[last[at]])
        return np.array(ids[::-1], "<u4").tobytes()

    def _last(self, pieces: list[bytes], longest: int, known: np.ndarray | None = None) -> np.ndarray:
        """The last token of each prefix (rows) of each piece, by falling length (columns). known: of the first prefixes of the only piece."""
        n, sizes = len(pieces), np.array([len(p) for p in pieces])
        text = np.frombuffer(b"".join(p.ljust(longest, b"\0") for p in pieces), np.uint8).reshape(n, longest)
        last = np.full((longest + 1, n), -1, np.int64)
        if known is not None:
            last[: len(known), 0] = known
        state = np.zeros(n, np.int64)
        for end in range(1, longest + 1):
            live = int(np.searchsorted(-sizes, -end, side="right"))
            state[:live] = self.automaton.step(state[:live], text[:live, end - 1].astype(np.int64))
            rows, here = np.arange(live), state[:live].copy()
            while len(rows) and (known is None or end >= len(known)):
                token = self.automaton.longest[here]
                rows, here, token = rows[token >= 0], here[token >= 0], token[token >= 0]
                start = end - self.length[token]
                before = last[start, rows]
                fine = start == 0
                ask = np.flatnonzero(~fine & (before >= 0))
                fine[ask] = self.fits(before[ask], token[ask])
                last[end, rows[fine]] = token[fine]
                rows, here = rows[~fine], self.automaton.shorter[here[~fine]]
        return last

    def _block(self, pieces: list[bytes], longest: int) -> list[bytes]:
        """pieces by falling length."""
        n, sizes = len(pieces), np.array([len(p) for p in pieces])
        last = self._last(pieces, longest)
        rows, at, steps = np.flatnonzero(sizes), sizes[sizes > 0].copy(), []
        count = np.zeros(n, np.int64)
        while len(rows):
            token = last[at, rows]
            if (token < 0).any():
                raise ValueError("the vocabulary has no token for some byte")
            steps.append((rows, token))
            count[rows] += 1
            at = at - self.length[token]
            rows, at = rows[at > 0], at[at > 0]
        ends = np.cumsum(count)
        flat = np.zeros(int(ends[-1]) if n else 0, "<u4")
        for back, (rows, token) in enumerate(steps):
            flat[ends[rows] - 1 - back] = token
        raw, ends = flat.tobytes(), (ends * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Codec:
    """Texts to ids and back, with a bounded cache of words."""

    def __init__(self, vocabulary: Vocabulary, cache: int = 400_000):
        self.v, self.core = vocabulary, PrefixEncoder(vocabulary)
        self.pretokens = regex.compile(PRETOKEN).findall
        self.odd_space = re.compile(r"[^\S \n]").search
        self.memo = Memo(self._words, cache)
        self.ends = regex.compile("|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True))) if vocabulary.special else None
        size = max([*vocabulary.token, *vocabulary.special.values()]) + 1
        self.bytes = [b""] * size
        for i, t in vocabulary.token.items():
            self.bytes[i] = t
        for s, i in vocabulary.special.items():
            self.bytes[i] = s.encode()

    def _words(self, words: list[str]) -> list[bytes]:
        """Each is a text whose ends are ends of pretokens, or a special token, as a tuple of its string."""
        cut: list[tuple] = []
        for w in words:
            if w[0] == " " and w[1:].isalpha():
                cut.append((w,))
            elif w[0] == " " and w[-1] in ",." and w[1:-1].isalpha():
                cut.append((w[:-1], w[-1]))
            elif isinstance(w, tuple):
                cut.append(w)
            else:
                cut.append(tuple(self.pretokens(w)))
        pieces = list({p for w, c in zip(words, cut, strict=True) if w is not c for p in c})
        of = dict(zip(pieces, self.core.encode_many([p.encode("utf-8", "surrogatepass") for p in pieces]), strict=True))
        return [of[c[0]] if len(c) == 1 and w is not c else np.uint32(self.v.special[w[0]]).tobytes() if w is c else b"".join(map(of.__getitem__, c)) for w, c in zip(words, cut, strict=True)]

    def _cut(self, text: str) -> list[str]:
        """A space between two other characters, neither white space, always starts a pretoken; cut there."""
        if not text:
            return []
        if text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or self.odd_space(text):
            return self.pretokens(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]]

    def encode_many(self, texts: Sequence[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; the strings of special tokens become their ids."""
        cut: list[list] = []
        for text in texts:
            parts: list = []
            if self.ends is not None and self.ends.search(text):
                at = 0
                for m in self.ends.finditer(text):
                    parts += [*self._cut(text[at : m.start()]), (m[0],)]
                    at = m.end()
                text = text[at:]
            cut.append(parts + self._cut(text))
        table = self.memo.fill({w for words in cut for w in words})
        return [b"".join(map(table.__getitem__, words)) for words in cut]

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def codec_of(vocabulary_json: str) -> Codec:
    """A worker's codec, kept from task to task with its cache."""
    return Codec(Vocabulary.from_json(vocabulary_json))


def encode_documents(documents: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, ids (binary: little-endian unsigned 32-bit), decoded (text) for each row.

    A null or empty text has no ids and decodes to "". Very long texts cost linear time; rows repeat as they come;
    other columns are not read; an empty table gives an empty result. Map-only. The vocabulary file is read on the
    driver and broadcast (its size does not depend on the data).
    """
    return _run(documents, vocabulary_path, id_column, text_column, "ids binary, decoded string", lambda codec, ids: (ids, codec.decode(np.frombuffer(ids, "<u4").tolist())))


def digest_documents(documents: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encode_documents() with its outputs digested where they are made."""

    def digests(codec, ids):
        decoded = codec.decode(np.frombuffer(ids, "<u4").tolist())
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _run(documents, vocabulary_path, id_column, text_column, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digests)


def _run(documents: DataFrame, path: str, id_column: str, text_column: str, columns: str, result) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        held = documents.sparkSession.sparkContext.broadcast(f.read())
    rows = documents.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    schema = f"id {rows.schema[0].dataType.simpleString()}, {columns}"
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [{"binary": pa.binary(), "string": pa.string(), "bigint": pa.int64()}[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = [result(codec, ids) for ids in codec.encode_many([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([m[i] for m in made], k) for i, k in enumerate(kinds))], ["id", *names])

    return rows.mapInArrow(thrifty(run), schema).withColumnRenamed("id", id_column)
