"""URL filters: all glob rules simulated at once by a multiword Shift-And automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbols past the bytes: the boundary of host and path, and the end of the input.
BOUNDARY, END = 256, 257
SYMBOLS = 258
_CELLS = 2_000_000


@dataclass(frozen=True)
class Rule:
    """verdict is "block" or "allow"; the rule fits host and its subdomains, for paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def label(self) -> str:
        return self.host + self.path

    def glob(self) -> list[int | None]:
        """Symbols of the glob `*.host<boundary>path*`; None is the wildcard `*`."""
        return [None, *b".", *self.host.encode(), BOUNDARY, *self.path.encode(), None, END]


class ShiftAnd:
    """Globs packed one after another into 64-bit words; one step moves every state of every glob.

    A glob is a list of symbols with None for `*`. State i of a glob means its first i symbols (wildcards
    aside) are read; a wildcard after symbol i lets state i stay on any input.
    """

    def __init__(self, globs: Sequence[Sequence[int | None]]):
        bits = sum(1 + sum(s is not None for s in g) for g in globs)
        self.words = max(1, -(-bits // 64))
        self.reads = np.zeros((SYMBOLS, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.stay = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        at = 0
        for glob in globs:
            first = at
            self._set(self.start, first)
            for symbol in glob:
                if symbol is None:
                    self._set(self.stay, at)
                else:
                    at += 1
                    self._set(self.reads[symbol], at)
            self.final.append((at // 64, np.uint64(1) << np.uint64(at % 64)))
            at += 1

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def run(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """symbols: (n, longest), rows sorted by falling length. Returns (n, globs): does each glob fit?"""
        states = np.tile(self.start, (len(symbols), 1))
        one, top = np.uint64(1), np.uint64(63)
        for column in range(symbols.shape[1]):
            live = int(np.searchsorted(-lengths, -column, side="left"))
            before = states[:live]
            moved = before << one
            moved[:, 1:] |= before[:, :-1] >> top
            states[:live] = (moved & self.reads[symbols[:live, column]]) | (before & self.stay)
        return np.stack([states[:, word] & bit != 0 for word, bit in self.final], axis=1) if self.final else np.zeros((len(symbols), 0), bool)


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _judge(rules: Sequence[Rule], default: str):
    ranked = sorted(rules, key=lambda r: (-len(r.label), r.label, r.verdict != "block"))
    labels = np.array([*(r.label for r in ranked), None], object)
    verdicts = np.array([*(r.verdict for r in ranked), default], object)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ShiftAnd([r.glob() for r in ranked])
        for batch in batches:
            coded = [np.array([*b".", *h.encode("utf-8", "replace"), BOUNDARY, *p.encode("utf-8", "replace"), END], np.int16) for h, p in zip(batch["host"], batch["path"], strict=True)]
            lengths = np.array([len(x) for x in coded], np.int64)
            best = np.full(len(coded), len(ranked))
            order, at = np.argsort(-lengths, kind="stable"), 0
            while at < len(order):
                longest = int(lengths[order[at]])
                rows = order[at : at + max(1, _CELLS // longest)]
                block = np.full((len(rows), longest), END, np.int16)
                for i, row in enumerate(rows):
                    block[i, : lengths[row]] = coded[row]
                fits = automaton.run(block, lengths[rows])
                best[rows] = np.where(fits.any(axis=1), fits.argmax(axis=1) if ranked else 0, len(ranked))
                at += len(rows)
            yield batch.assign(rule=labels[best], verdict=verdicts[best])

    return judge


def filter_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """id, host, path, rule, verdict for each row of pages, by the longest rule that fits.

    A null url, or one without "://", has empty host and path and takes the default verdict, as any url that
    no rule fits. Rules of one length that fit one url: the smaller label wins, then block. Repeated rows stay;
    other columns are not read; an empty table gives an empty result. Map-only: no shuffle.
    """
    coded = pages.select(F.col(f"`{id_column}`").alias("id"), url_host(F.col(f"`{url_column}`")).alias("host"), url_path(F.col(f"`{url_column}`")).alias("path"))
    schema = f"id {coded.schema[0].dataType.simpleString()}, host string, path string, rule string, verdict string"
    return coded.mapInPandas(_judge(tuple(rules), default), schema).toDF(id_column, "host", "path", "rule", "verdict")
