"""Whole texts to ids with the tokenizers library: one library call for each new word piece, the rest on Arrow columns."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from fernweave.llm.bpe import IntTable, byte_letters

#: Words of these characters only are lower-cased and cut here as the library would; all others go through it whole.
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
#: Of those, words that are one run of letters, or one and a mark: two pieces at most, known without a cut.
_MARKS = ".,;:!?)"
_SIMPLE = f"^[A-Za-zÀ-ÖØ-öø-ÿ]+[{_MARKS}]?$"
_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+|\n")
#: Texts are encoded in slices of about so many bytes; the encoder's arrays are many times a slice.
_SLICE_BYTES = 2 << 20


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run in turn."""
    shifts, n = starts - (np.cumsum(sizes) - sizes), int(sizes.sum())
    small = np.int32 if n + int(np.abs(shifts).max(initial=0)) < 1 << 31 else np.int64
    at = np.repeat(shifts.astype(small), sizes)
    at += np.arange(n, dtype=small)
    return at


def _joined(words: pa.Array, by: str) -> pa.Scalar:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), by)[0]


class Merges:
    """Merge-order BPE of many short pieces side by side: in each round, each piece makes its first pair of the lowest rank one."""

    #: Longer pieces (bytes) would need many rounds.
    LONGEST = 64
    #: Pieces that are side by side, at most.
    BLOCK = 8_192

    def __init__(self, model: dict):
        ids, end, letters = model["vocab"], model.get("end_of_word_suffix") or "", byte_letters()
        self.inner, self.last = (np.array([ids.get(c + e, -1) for c in letters], np.int64) for e in ("", end))
        #: Without a token for each byte the library has to say what becomes of a piece.
        self.complete = min(self.inner.min(), self.last.min()) >= 0
        lefts, rights = zip(*(m if isinstance(m, list) else m.split(" ") for m in model["merges"]))
        left, right, made = (np.fromiter(map(ids.__getitem__, names), np.int64, len(lefts)) for names in (lefts, rights, map("".join, zip(lefts, rights, strict=True))))
        # Of equal pairs the last counts, as in the library.
        pairs, rank = np.unique((left << 32 | right)[::-1], return_index=True)
        self.none = len(lefts)
        self.made = np.append(made, 0)
        self.ranks = IntTable(pairs, self.none - 1 - rank)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank = self.ranks.get(left << 32 | right)
        return np.where(rank < 0, self.none, rank)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in turn, and how many each has. Pieces are not empty and hold no line end."""
        made = [self._block(pieces[i : i + self.BLOCK]) for i in range(0, len(pieces), self.BLOCK)]
        return tuple(np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _block(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer("".join([p + "\n" for p in pieces]).encode(), np.uint8)
        ends = np.flatnonzero(raw == 10)
        ids = self.inner[raw]
        ids[ends - 1] = self.last[raw[ends - 1]]
        ids, size = ids[raw != 10], np.diff(ends, prepend=-1) - 1
        start, own = np.cumsum(size) - size, np.arange(len(pieces))
        rank = np.append(self._rank(ids[:-1], ids[1:]), self.none)
        rank[start + size - 1] = self.none
        flat, order, sizes = [], [], []
        while len(own):
            least = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), start)
            at, live = least & 0xFFFFFFFF, least >> 32 < self.none
            done = ~live
            flat.append(ids[runs(start[done], size[done])])
            order.append(own[done])
            sizes.append(size[done])
            stay = np.repeat(live, size)
            at, before = at[live], (at - start)[live]
            ids[at] = self.made[rank[at]]
            stay[at + 1] = False
            own, size, ids, rank = own[live], size[live] - 1, ids[stay], rank[stay]
            start = np.cumsum(size) - size
            at = start + before
            rank[at] = self.none
            pair = at[before < size - 1]
            rank[pair] = self._rank(ids[pair], ids[pair + 1])
            pair = at[before > 0]
            rank[pair - 1] = self._rank(ids[pair - 1], ids[pair])
        flat, order, sizes = np.concatenate(flat), np.concatenate(order), np.concatenate(sizes)
        back = np.argsort(order)
        return flat[runs((np.cumsum(sizes) - sizes)[back], sizes[back])].astype(np.uint32), sizes[back]


class WordCodec:
    """Ids of texts under a lower-casing word BPE file (white space dropped), as the library's encode() gives them.

    White space separates words for good in such a vocabulary, and a word's pieces (a run of letters, a digit, a run of
    marks) don't merge, so a text's ids are those of its pieces in turn. Distinct words of a slice are cut once. Pieces
    are cached, at most about `cache` of them and `cache_chars` characters; a full cache is emptied.
    """

    def __init__(self, tokenizer_json: str, cache: int = 400_000, cache_chars: int = 8_000_000):
        self.whole = Tokenizer.from_str(tokenizer_json)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.tokenize = self.whole.model.tokenize
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.size = self.whole.get_vocab_size()
        self.merges = Merges(json.loads(tokenizer_json)["model"])
        self.cache, self.cache_chars = cache, cache_chars
        codec = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> int:
                self[piece] = at = codec._learn(piece)
                return at

        self.kind = Pieces
        self._clear()

    def _clear(self) -> None:
        self.pieces = self.kind({"\n": -1})
        self.ids, self.sizes = array("I"), array("q")
        self.chars = 0

    def _learn(self, piece: str) -> int:
        self.chars += len(piece)
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        before = len(self.ids)
        self.ids.extend([t.id for t in self.tokenize(piece)])
        self.sizes.append(len(self.ids) - before)
        return len(self.sizes) - 1

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of distinct pieces; those that are new are learned together."""
        at = np.fromiter(map(self.pieces.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = [pieces[i] for i in np.flatnonzero(at < 0).tolist()]
        short = [p for p in new if 2 * len(p) <= self.merges.LONGEST] if self.merges.complete else []
        n = len(self.sizes)
        ids, sizes = self.merges.encode(short)
        self.ids.frombytes(ids.tobytes())
        self.sizes.frombytes(sizes.tobytes())
        self.chars += sum(map(len, short))
        self.pieces.update(zip(short, range(n, n + len(short))))
        at[at < 0] = np.fromiter(map(self.pieces.__getitem__, new), np.int64, len(new))
        return at

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: all in turn, and for each word where its own start and how many there are."""
        if len(self.sizes) > self.cache or self.chars > self.cache_chars:
            self._clear()
        simple = pc.match_substring_regex(words, _SIMPLE)
        ids, base = [], 0
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for look_up, which in ((self._simple_words, simple), (self._other_words, pc.invert(simple))):
            found, first, size = look_up(words.filter(which))
            at = which.to_numpy(zero_copy_only=False)
            starts[at], sizes[at] = first + base, size
            ids.append(found)
            base += len(found)
        return np.concatenate(ids), starts, sizes

    def _stored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all pieces: the ids in turn, and for each piece, -1 being none, where they start and how many there are."""
        sizes = np.append(np.array(self.sizes, np.int64), 0)
        return np.array(self.ids, np.uint32), np.cumsum(sizes) - sizes, sizes

    def _simple_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """_words() for words of _SIMPLE."""
        words = pc.utf8_lower(words)
        runs_of = pc.ascii_rtrim(words, _MARKS).dictionary_encode()
        letters = _joined(runs_of.dictionary, "\n").as_py().split("\n") if len(words) else []
        piece = self._numbers(letters)[runs_of.indices.to_numpy()]
        # A word's last byte is its mark's number in ASCII, if it has one.
        ends = np.cumsum(pc.binary_length(words).to_numpy())
        last = np.frombuffer(_joined(words, "").as_buffer(), np.uint8)[ends - 1] if len(words) else np.zeros(0, np.uint8)
        mark = np.full(256, -1, np.int64)
        for m in _MARKS:
            mark[ord(m)] = self.pieces[m]
        tail = mark[last]
        ids, first, size = self._stored()
        starts, sizes = first[piece], size[piece] + size[tail]
        marked = np.flatnonzero(tail >= 0)
        both = np.column_stack([piece[marked], tail[marked]]).ravel()
        starts[marked] = len(ids) + np.cumsum(sizes[marked]) - sizes[marked]
        return np.concatenate([ids, ids[runs(first[both], size[both])]]), starts, sizes

    def _other_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """_words() for any words."""
        sizes, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        plain = pc.and_(pc.match_substring_regex(words, _PLAIN), pc.invert(pc.match_substring(words, "<|"))).to_numpy(zero_copy_only=False)
        kept = words.filter(pa.array(plain))
        cut = _joined(kept, "\n").as_py().lower()
        at = np.fromiter(map(self.pieces.__getitem__, _CUT.findall(cut)), np.int64)
        stored, first, size = self._stored()
        first, size = first[at], size[at]
        word = np.cumsum(at < 0)
        flat = stored[runs(first, size)]
        if plain.any():
            sizes[plain] = np.bincount(word, weights=size, minlength=int(plain.sum())).astype(np.int64)
        starts[plain] = np.cumsum(sizes[plain]) - sizes[plain]
        odd, end = [], len(flat)
        for i in np.flatnonzero(~plain).tolist():
            text = words[i].as_py()
            ids = self.whole.encode(text, add_special_tokens=False).ids if text else []
            odd.append(np.array(ids, np.uint32))
            starts[i], sizes[i], end = end, len(ids), end + len(ids)
        return np.concatenate([flat, *odd]), starts, sizes

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn as unsigned 32-bit integers, and how many each has. A null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        ids, starts, sizes = self._words(coded.dictionary)
        word = coded.indices.to_numpy()
        n = sizes[word]
        total = np.concatenate([[0], np.cumsum(n)])
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]) if len(lists) else np.zeros(1, np.int64)
        return ids[runs(starts[word], n)], np.diff(total[bounds])

    def encode_slices(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, ids, sizes) of slices of bounded size; a slice holds one text at least."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        at, total = 0, np.concatenate([[0], np.cumsum(size)])
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(total, total[at] + _SLICE_BYTES, "right")) - 1)
            yield at, to, *self.encode_array(texts.slice(at, to - at))
            at = to

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, sizes = self.encode_array(pa.array(texts, pa.string()))
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(texts) else []


@lru_cache(maxsize=1)
def codec_of(tokenizer_json: str) -> WordCodec:
    """A worker's codec, kept from task to task with its cache."""
    return WordCodec(tokenizer_json)


def forget_codec() -> None:
    """For the tasks that come after the encoding ones, in the same workers: a codec with a full cache takes 100 MB and more."""
    codec_of.cache_clear()


def id_lists(ids: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Ids of several texts in turn as an Arrow list column."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    return np.insert(ids, np.cumsum(sizes), end_id).astype(np.uint32), sizes + 1
