"""Quality rules: rule statistics of whole texts, judged by an isolation forest calibrated on labelled rows."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.llm.common import WORD, beside, discard, map_beside, mix, stash, thrifty

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")
_SPACE = " \t\n\v\f\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest sees: logarithms of counts for each thousand characters or words, damped so that a single one in a
#: short text is no anomaly, and length alone never.
FEATURES = ("symbols", "marks", "upper", "one_char_words", "adjacent_same")
_DAMP_CHARS, _DAMP_WORDS = 200, 40
#: The columns of measured() that hold them.
_COLUMNS = [f"__{name}" for name in FEATURES]
WINDOW = 5


def statistics(text: str) -> tuple[list[int], np.ndarray]:
    """The BASE counts and the FEATURES of one whole text."""
    words = WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(_SYMBOLS.findall(text))
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    dup_lines = len(lines) - len(set(lines))
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.uint64)
    repeated = 0
    if n > WINDOW:
        with np.errstate(over="ignore"):
            h = np.zeros(n - WINDOW + 1, np.uint64)
            for i in range(WINDOW):
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + ids[i : n - WINDOW + 1 + i]
                h *= np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h) + 1, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(twice)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
        repeated = int((np.cumsum(edge)[:n] > 0).sum())
    chars_, words_ = chars + _DAMP_CHARS, n + _DAMP_WORDS
    features = np.log1p(
        np.array(
            [
                1e3 * symbols / chars_,
                1e3 * (text.count("!") + text.count("?")) / chars_,
                1e3 * len(_UPPER.findall(text)) / chars_,
                1e3 * sum(len(x) == 1 for x in words) / words_,
                1e3 * float((ids[1:] == ids[:-1]).sum()) / words_ if n else 0.0,
            ]
        )
    )
    return [n, chars, symbols, dup_lines, repeated], features


@dataclass(frozen=True)
class Settings:
    trees: int = 100
    #: A tree's splits are drawn from about so many rows; then all rows weigh its ends, as much as so many together.
    rows_per_tree: int = 512
    #: What all bad rows weigh in the trees at most, for each good one: anomalies must be rare for few splits to isolate them.
    bad_share: float = 0.05
    #: Share of good labelled rows that the threshold may cost at most.
    lose_share: float = 0.001
    min_words: int = 10
    max_repeat_percent: int = 20
    seed: int = 11


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among rows that weigh n."""
    n = np.asarray(n, float)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + np.euler_gamma + 1 / (2 * m) - 1 / (12 * m * m)) - 2 * m / np.maximum(n, 1), np.clip(n - 1, 0, 1))


class IsolationForest:
    """Random axis splits; rows that few splits isolate are anomalies. All trees are flat arrays.

    Splits are drawn from a tree's own sample. How many rows end where is counted over all rows, not over the sample.
    """

    def __init__(self, rows: np.ndarray, trees: int, rows_per_tree: int, seed: int):
        rng = np.random.default_rng(seed)
        size = min(rows_per_tree, len(rows))
        self._split([rows[rng.choice(len(rows), size, replace=False)] for _ in range(trees)] if len(rows) else [], size, rng)
        if self.trees:
            self.weigh(self.ends([(rows, np.zeros(len(rows), np.int64), np.ones(len(rows)))], 1) @ np.ones(1) * (size / len(rows)))

    @classmethod
    def of_samples(cls, samples: list[np.ndarray], size: float, seed: int) -> IsolationForest:
        """A tree for each sample. All rows, which are still to be weighed, weigh size together."""
        forest = cls.__new__(cls)
        forest._split(samples, size, np.random.default_rng(seed))
        return forest

    def _split(self, samples: list[np.ndarray], size: float, rng: np.random.Generator) -> None:
        self.size = size
        self.limit = max(1, int(np.ceil(np.log2(max(2, self.size)))))
        self.trees = [self._grow(sample, rng) for sample in samples]

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, split, left, right, length = [], [], [], [], []

        def node(part: np.ndarray, depth: int) -> int:
            at = len(feature)
            for x, v in ((feature, -1), (split, 0.0), (left, at), (right, at), (length, depth + float(_average_path(len(part))))):
                x.append(v)
            low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(0), np.zeros(0))
            open_ = np.flatnonzero(high > low)
            if depth < self.limit and len(part) > 1 and len(open_):
                f = int(rng.choice(open_))
                value = float(rng.uniform(low[f], high[f]))
                feature[at], split[at] = f, value
                left[at] = node(part[part[:, f] < value], depth + 1)
                right[at] = node(part[part[:, f] >= value], depth + 1)
            return at

        node(rows, 0)
        return np.array(feature), np.array(split), np.array(left), np.array(right), np.array(length)

    def _end(self, tree: tuple[np.ndarray, ...], rows: np.ndarray) -> np.ndarray:
        """The node at which each row ends."""
        feature, split, left, right, _ = tree
        at, every = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for _ in range(self.limit):
            f = feature[at]
            at = np.where(f < 0, at, np.where(rows[every, np.maximum(f, 0)] < split[at], left[at], right[at]))
        return at

    def ends(self, parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], kinds: int) -> np.ndarray:
        """How many rows of each kind end at each node of each tree. parts: rows, the kind of each, and how often it is there."""
        found = np.zeros((len(self.trees), max(len(t[0]) for t in self.trees), kinds))
        for rows, kind, times in parts:
            for own, tree in zip(found, self.trees, strict=True):
                own += np.bincount(self._end(tree, rows) * kinds + kind, times, own.size).reshape(own.shape)
        return found

    def weigh(self, mass: np.ndarray) -> None:
        """Set the lengths of paths: the depth of a node, and what the rows that end there, of this mass, would add."""
        for tree, own in zip(self.trees, mass, strict=True):
            feature, _, left, right, length = tree
            depth = np.zeros(len(feature))
            for at in np.flatnonzero(feature >= 0):  # parents come first
                depth[left[at]] = depth[right[at]] = depth[at] + 1
            length[:] = depth + _average_path(own[: len(feature)])

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; the higher, the fewer splits isolate the row."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        for tree in self.trees:
            total += tree[-1][self._end(tree, rows)]
        return 2.0 ** (-total / len(self.trees) / max(float(_average_path(self.size)), 1e-9))


@dataclass(frozen=True)
class Model:
    """Rows whose score is over the threshold are anomalies; without labelled rows of both kinds none is."""

    forest: IsolationForest
    threshold: float
    settings: Settings


def _measured(at_text: int, made):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                both = [statistics(t or "") for t in part.column(at_text).to_pylist()]
                base = np.array([b for b, _ in both], np.int64).reshape(-1, len(BASE))
                yield made(part, base, np.array([f for _, f in both], float).reshape(-1, len(FEATURES)))

    return run


def measured(documents: DataFrame, text_column: str = "text") -> DataFrame:
    """documents with the BASE counts and the FEATURES (`__symbols` and so on) of whole texts, for fit_measured and
    judge_measured: whoever needs both writes this table and reads the texts once. Columns of these names are replaced.
    """
    rows = documents.drop(*BASE, *_COLUMNS)

    def made(part, base, features):
        return beside(part, *(pa.array(x) for x in base.T), *(pa.array(x) for x in features.T))

    return map_beside(rows, _measured(rows.columns.index(text_column), made), {**dict.fromkeys(BASE, "bigint"), **dict.fromkeys(_COLUMNS, "double")})


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from every labelled document, as fit_measured does."""
    rows = stash(measured(documents.select("doc_id", "text")).drop("text"), "quality-measured")
    try:
        return fit_measured(rows, labels, settings)
    finally:
        discard(rows)


def grows(doc_id: Column, settings: Settings = Settings()) -> Column:
    """The random half of the ids that the trees grow on; the threshold is calibrated on the other one."""
    return F.xxhash64(F.lit(settings.seed), doc_id) % 2 == 0


def fit_measured(rows: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id") -> Model:
    """Learn from every labelled row of measured(); quality: 1 good, 0 bad, and an id labelled both ways is bad.

    The forest grows on a random half. A tree's splits are drawn from a sample of that half, as isolation forests do, and
    all rows of the half are counted at its ends, where the bad ones together weigh bad_share of the good ones at most. The other
    half, which no tree has seen, calibrates the threshold: the lowest that costs at most lose_share of its good rows and
    catches the most of its bad ones, so over all good scores but that share, half way to the next bad one above.
    What reaches the driver is bounded by Settings: samples, counts of nodes, histograms.
    """
    s = settings
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    found = rows.select(F.col(id_column).alias("doc_id"), *_COLUMNS).join(marked, "doc_id")
    # Equal rows of one id are one, with their number.
    found = found.groupBy("doc_id", "quality", *_COLUMNS).agg(F.count("*").alias("n"))
    key = F.xxhash64(F.lit(s.seed), "doc_id", *_COLUMNS).alias("key")
    labelled = stash(found.select("quality", "n", key, *_COLUMNS, grows(F.col("doc_id"), s).alias("grows")), "quality-labelled")
    scored = None
    try:
        n = {(r["grows"], r["quality"]): r["n"] for r in labelled.groupBy("grows", "quality").agg(F.sum("n").alias("n")).collect()}
        if not all(n.get(x) for x in ((True, 1), (False, 1), (False, 0))):
            return Model(IsolationForest(np.zeros((0, len(FEATURES))), 0, 1, s.seed), 1.0, s)
        forest = _forest(labelled.where("grows").drop("grows"), n[True, 1], n.get((True, 0), 0), s)
        scored = stash(_scored(labelled.where("not grows").drop("grows"), forest), "quality-scored")
        good = scored.where("quality = 1")
        floor = _in_place(good, "score", "n", math.ceil((n[False, 1] - 1) * (1 - s.lose_share)))
        above = scored.where((F.col("quality") == 0) & (F.col("score") > floor)).agg(F.min("score")).first()[0]
        return Model(forest, 1.0 if above is None else (floor + above) / 2, s)
    finally:
        discard(*(t for t in (labelled, scored) if t is not None))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 5_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The features, quality, number and key of labelled rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            quality, n, key, *features = (c.to_numpy(zero_copy_only=False) for c in batch.slice(at, rows).columns)
            yield np.column_stack(features), quality.astype(np.int64), n, key


def _forest(labelled: DataFrame, good: int, bad: int, s: Settings) -> IsolationForest:
    """From all labelled rows of the half that grows."""
    weight = np.array([min(1.0, max(1.0, good * s.bad_share) / max(bad, 1)), 1.0])
    whole = good + bad * weight[0]
    size = min(float(s.rows_per_tree), whole)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = mix(np.arange(1, s.trees + 1, dtype=np.uint64))[:, None]
        for rows, quality, n, key in _parts(batches):
            chance = n * weight[quality] * (size / whole)
            tree, at = np.nonzero((mix(key.view(np.uint64) ^ trees) >> np.uint64(11)) * 2.0**-53 < chance)
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(key[at]), *(pa.array(x) for x in rows[at].T)], ["tree", "key", *_COLUMNS])

    drawn = labelled.mapInArrow(thrifty(draw), "tree bigint, key bigint, " + ", ".join(f"{c} double" for c in _COLUMNS)).toArrow()
    drawn = drawn.sort_by([(c, "ascending") for c in drawn.column_names])
    rows = np.column_stack([drawn[c].to_numpy() for c in _COLUMNS])
    forest = IsolationForest.of_samples(np.split(rows, np.searchsorted(drawn["tree"].to_numpy(), np.arange(1, s.trees))), size, s.seed)
    held = labelled.sparkSession.sparkContext.broadcast(forest)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = held.value.ends((p[:3] for p in _parts(batches)), len(weight)).astype(np.int64)
        places = np.nonzero(ends)
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in places), pa.array(ends[places])], ["tree", "node", "quality", "n"])

    counts = labelled.mapInArrow(thrifty(count), "tree bigint, node bigint, quality bigint, n bigint").groupBy("tree", "node", "quality").agg(F.sum("n").alias("n")).toArrow()
    ends = np.zeros((s.trees, max(len(t[0]) for t in forest.trees), len(weight)))
    ends[tuple(counts[c].to_numpy() for c in ("tree", "node", "quality"))] = counts["n"].to_numpy()
    forest.weigh(ends @ weight * (size / whole))
    return forest


def _scored(labelled: DataFrame, forest: IsolationForest) -> DataFrame:
    """quality, n and score of labelled rows."""
    held = labelled.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, quality, n, _ in _parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(quality), pa.array(n), pa.array(held.value.score(rows))], ["quality", "n", "score"])

    return labelled.mapInArrow(thrifty(run), "quality bigint, n bigint, score double")


def _in_place(rows: DataFrame, value: str, times: str, place: int, bins: int = 4_096) -> float:
    """The value at a place, from 0, of the ascending values, each there so many times: by histograms of ever less of them."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        part = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).alias("part")
        counts = rows.where(F.col(value).between(low, high)).groupBy(part).agg(F.sum(times).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).orderBy("part").collect()
        for r in counts:
            if place < r["n"]:
                low, high = r["low"], r["high"]
                break
            place -= r["n"]
    return low


def _verdicts(model: Model, base: np.ndarray, features: np.ndarray) -> list[pa.Array]:
    failed = (base[:, 0] < model.settings.min_words) | (100 * base[:, 4] > model.settings.max_repeat_percent * base[:, 0])
    score = model.forest.score(features)
    return [pa.array(failed), pa.array(score), pa.array(~failed & ~(score > model.threshold))]


_VERDICTS = {"base_failed": "boolean", "anomaly": "double", "kept": "boolean"}


def judge(documents: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, anomaly and kept.

    base_failed: fewer than min_words words, or more than max_repeat_percent of them in repeated 5-word windows.
    anomaly: the forest's score. kept: neither base_failed nor an anomaly over the threshold. A null or empty text has
    no words and fails. Columns of these names are replaced; rows repeat as they come; whole texts count; an empty
    table gives an empty result. Map-only; the model's size is fixed by Settings.
    """
    rows = documents.drop(*BASE, *_VERDICTS)
    held = documents.sparkSession.sparkContext.broadcast(model)

    def made(part, base, features):
        return beside(part, *(pa.array(x) for x in base.T), *_verdicts(held.value, base, features))

    return map_beside(rows, _measured(rows.columns.index(text_column), made), {**dict.fromkeys(BASE, "bigint"), **_VERDICTS})


def judge_measured(rows: DataFrame, model: Model) -> DataFrame:
    """The same of rows of measured(), without a look at their texts. The FEATURES go."""
    rows = rows.drop(*_VERDICTS)
    held = rows.sparkSession.sparkContext.broadcast(model)
    places = [[rows.columns.index(c) for c in names] for names in (BASE, _COLUMNS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, features = (np.column_stack([batch.column(i).to_numpy() for i in own]) for own in places)
            yield beside(batch, *_verdicts(held.value, base, features))

    return map_beside(rows, run, _VERDICTS).drop(*_COLUMNS)
