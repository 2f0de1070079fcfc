"""Language identification: averaged hashed subword embeddings under a linear softmax, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.llm.common import beside, map_beside

UNDETERMINED = "und"
SLICE = 500


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that no model learns from; a null id is not held out (and not learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Settings:
    #: The bound of the labelled sample: documents, dealt evenly to the languages.
    rows: int = 1_200
    buckets: int = 1 << 16
    dim: int = 16
    longest: int = 4
    epochs: int = 2
    rate: float = 0.5
    #: Whole texts are learned from in consecutive pieces of 1 to piece_words words.
    piece_words: int = 60
    #: Of the right answers on calibration texts, the share that rejection may cost at most.
    reject_share: float = 0.001
    #: Pieces of fewer words don't count for the rejection threshold.
    reject_words: int = 10
    seed: int = 7
    #: Words, and their characters, whose logits a worker keeps.
    cache: int = 200_000
    cache_chars: int = 16_000_000


def letters_only(words: Sequence[str]) -> list[str]:
    """Lower-cased letter runs of each word, as `<run><run>`; "" if there is none."""
    out = []
    for w in words:
        w = w.lower()
        if w.isalpha():
            out.append(f"<{w}>")
        elif w[:-1].isalpha():
            out.append(f"<{w[:-1]}>")
        else:
            runs = "".join(c if c.isalpha() else " " for c in w).split()
            out.append("".join(f"<{r}>" for r in runs))
    return out


def subwords(words: Sequence[str], buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets of all n-grams of 1 to `longest` characters, and the word of each. Words as letters_only() gives."""
    text = "".join(words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    ids, owners = [], []
    rolled = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, longest + 1):
            if len(codes) < n:
                break
            rolled = rolled[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
            inside = owner[: len(rolled)] == owner[n - 1 :]
            h = rolled[inside] * np.uint64(0x9E3779B97F4A7C15)
            ids.append((h >> np.uint64(40)).astype(np.int64) % buckets)
            owners.append(owner[: len(rolled)][inside])
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ids), np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    """table: the logits of each bucket (its embedding through the softmax layer), bias, temperature and reject_below.

    foreign_rejected: the share of calibration texts below the threshold when their own language is left out of the
    answer, as an estimate for texts of languages that were not learned (None for fewer than three languages).
    """

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float
    settings: Settings
    foreign_rejected: float | None = None

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return _softmax(logits / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


class Bags:
    """Whole texts as word numbers, and the n-gram buckets of each distinct word once."""

    def __init__(self, texts: Sequence[str], s: Settings):
        known: dict[str, int] = {}
        self.tokens = [np.array([known.setdefault(w, len(known)) for w in t.split()], np.int64) for t in texts]
        ids, owner = subwords(letters_only(list(known)), s.buckets, s.longest)
        order = np.argsort(owner, kind="stable")
        self.ids = ids[order].astype(np.int32)
        self.sizes = np.bincount(owner, minlength=len(known))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def grams(self, pieces: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All buckets of several pieces in turn, and their number in each."""
        words = np.concatenate(pieces)
        n = self.sizes[words]
        at = np.repeat(self.starts[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        edges = np.cumsum([0, *(len(p) for p in pieces)])
        total = np.concatenate([[0], np.cumsum(n)])
        return self.ids[at], np.diff(total[edges])


def _pieces(words: np.ndarray, longest: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Consecutive pieces of 1 to longest words; none is left out."""
    ends = np.cumsum(rng.integers(1, longest + 1, len(words) + 1))
    return [p for p in np.split(words, ends[ends < len(words)]) if len(p)]


def train(texts: Sequence[str], labels: Sequence[str], settings: Settings = Settings()) -> Model:
    """Stochastic gradient descent on pieces of the texts, which take in every word; a fifth of the texts is kept for calibration."""
    s, rng = settings, np.random.default_rng(settings.seed)
    languages = sorted(set(labels))
    k = len(languages)
    if not k:
        return Model([], np.zeros((s.buckets, 0), np.float32), np.zeros(0), 1.0, 0.0, s)
    bags, of = Bags(texts, s), [languages.index(x) for x in labels]
    cut = [(p, of[i], i % 5 == 0) for i, words in enumerate(bags.tokens) for p in _pieces(words, s.piece_words, rng)]
    cut = [c for c in cut if bags.sizes[c[0]].any()]
    learn, check = [c for c in cut if not c[2]], [c for c in cut if c[2]]
    y = np.array([c[1] for c in learn], np.int64)
    weight = 1.0 / np.maximum(1, np.bincount(y, minlength=k))
    weight /= weight.mean()
    emb = rng.normal(0, 0.1, (s.buckets, s.dim)).astype(np.float32)
    out = rng.normal(0, 0.1, (s.dim, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    step, steps = 0, max(1, s.epochs * -(-len(learn) // 32))
    for _ in range(s.epochs):
        rows = rng.permutation(len(learn))
        for at in range(0, len(rows), 32):
            batch = rows[at : at + 32]
            ids, n = bags.grams([learn[i][0] for i in batch])
            mean = np.add.reduceat(emb[ids], np.cumsum(n) - n, axis=0) / n[:, None]
            p = _softmax(mean @ out + bias)
            p[np.arange(len(batch)), y[batch]] -= 1
            p *= weight[y[batch], None] / len(batch)
            rate = s.rate * (1 - step / steps)
            back = (p @ out.T) / n[:, None]
            used, where = np.unique(ids, return_inverse=True)
            counts = np.bincount(where * len(batch) + np.repeat(np.arange(len(batch)), n), minlength=len(used) * len(batch)).reshape(len(used), len(batch)).astype(np.float32)
            emb[used] -= (rate * 32) * (counts @ back).astype(np.float32)
            out -= rate * (mean.T @ p).astype(np.float32)
            bias -= rate * p.sum(axis=0).astype(np.float32)
            step += 1
    table = emb @ out
    model = Model(languages, table.astype(np.float32), bias.astype(np.float64), 1.0, 0.0, s)
    return calibrated(model, bags, check + [(w, of[i], True) for i, w in enumerate(bags.tokens) if i % 5 == 0 and bags.sizes[w].any()])


def calibrated(model: Model, bags: Bags, texts: Sequence[tuple[np.ndarray, int, bool]]) -> Model:
    """The temperature of the least loss on texts (words, language), and the score that reject_share of right answers miss."""
    s, k = model.settings, len(model.languages)
    if not texts:
        return model
    y = np.array([t[1] for t in texts])
    z = []
    for words, _, _ in texts:
        ids, n = bags.grams([words])
        z.append(model.table[ids].sum(axis=0) / n[0] + model.bias)
    z = np.array(z)
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-300)).mean()
    model = replace(model, temperature=float(min(np.geomspace(0.05, 20, 60), key=loss)))
    long = np.array([len(t[0]) >= s.reject_words for t in texts])
    z, y = z[long], y[long]
    p = model.probabilities(z) if len(z) else np.zeros((0, k))
    right = p.max(axis=1)[p.argmax(axis=1) == y] if len(z) else np.zeros(0)
    if not len(right):
        return model
    below = float(np.quantile(right, s.reject_share, method="lower"))
    foreign = None
    if k > 2:
        z[np.arange(len(y)), y] = -np.inf
        foreign = float((model.probabilities(z).max(axis=1) < below).mean())
    return replace(model, reject_below=below, foreign_rejected=foreign)


def labelled_sample(documents: DataFrame, settings: Settings = Settings()) -> pd.DataFrame:
    """text, lang: at most rows documents, as many of each language, chosen by the hash of their id; never held-out ones."""
    s = settings
    rows = documents.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return pd.DataFrame({"text": [], "lang": []})
    each = max(1, s.rows // len(counts))
    share = F.element_at(F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(each / r["count"]))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # A little more than asked for, so that the draw rarely falls short; the surplus goes.
    got = rows.where(draw < share * 1.2 + 1e-6).select("text", "lang", draw.alias("draw")).toPandas()
    got = got.sort_values(["lang", "draw", "text"])
    return got[got.groupby("lang").cumcount() < each][["text", "lang"]].reset_index(drop=True)


def fit(documents: DataFrame, settings: Settings = Settings()) -> Model:
    sample = labelled_sample(documents, settings)
    return train(sample["text"].tolist(), sample["lang"].tolist(), settings)


class Scorer:
    """Whole texts to languages; the summed logits of words are cached."""

    def __init__(self, model: Model):
        self.m, self.cache = model, model.settings.cache
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.chars = 0
        self.sums = np.zeros((1024, len(self.m.languages) + 1))

    def _learn(self, words: set[str]) -> None:
        if len(self.row) > self.cache or self.chars > self.m.settings.cache_chars:
            self._clear()
        new = list(words - self.row.keys())
        if not new:
            return
        ids, owner = subwords(letters_only(new), self.m.settings.buckets, self.m.settings.longest)
        at = len(self.row)
        self.chars += sum(map(len, new))
        while at + len(new) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        made = self.sums[at : at + len(new)]
        for k in range(len(self.m.languages)):
            made[:, k] = np.bincount(owner, weights=self.m.table[ids, k], minlength=len(new))
        made[:, -1] = np.bincount(owner, minlength=len(new))
        self.row.update(zip(new, range(at, at + len(new)), strict=True))

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        cut = [(t or "").split() for t in texts]
        self._learn(set().union(*cut))
        k, find = len(self.m.languages), self.row.__getitem__
        total = np.zeros((len(texts), k + 1))
        for i, words in enumerate(cut):
            if words:
                total[i] = self.sums[np.fromiter(map(find, words), np.int64, len(words))].sum(axis=0)
        if not k:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        n = total[:, -1]
        p = self.m.probabilities(total[:, :-1] / np.maximum(n, 1)[:, None] + self.m.bias)
        best = p.argmax(axis=1)
        return [self.m.languages[b] if c else UNDETERMINED for b, c in zip(best, n, strict=True)], np.where(n > 0, p.max(axis=1), 0.0)


def predict(documents: DataFrame, model: Model, text_column: str = "text", lang: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """documents with lang_pred, score and rejected; columns of these names are replaced.

    A null text, or one without a letter, is "und" with score 0 and rejected. rejected also holds where the calibrated
    score is below the model's threshold. Whole texts count, however long. Rows repeat as they come; an empty table
    gives an empty result; a model without languages answers "und". Map-only; the model's size is fixed by Settings.
    """
    rows = documents.drop(lang, score, rejected)
    held, at_text = documents.sparkSession.sparkContext.broadcast(model), rows.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                best, p = scorer.predict(part.column(at_text).to_pylist())
                no = [b == UNDETERMINED or x < scorer.m.reject_below for b, x in zip(best, p, strict=True)]
                yield beside(part, pa.array(best, pa.string()), pa.array(p, pa.float64()), pa.array(no, pa.bool_()))

    return map_beside(rows, run, {lang: "string", score: "double", rejected: "boolean"})
