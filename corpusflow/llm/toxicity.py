"""Toxicity by class-conditional Kneser-Ney models over the bytes of words.

Each class has its own counts of byte n-grams inside words; below the highest order both classes share one Kneser-Ney
backoff from the continuation counts of all n-grams. So a rare expression scores alike in both classes except where its
counts differ. A word's evidence is the log-likelihood under the toxic model less that under the ordinary one; a document
has the same difference per byte over the whole text, the evidence of its most telling words, and what its words exceed
ordinary evidence by, for its length. A logistic function of these, fitted on labelled rows that the counts do not hold,
gives the score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.segments import bounded

ORDER = 5
DISCOUNT = 0.9
#: Evidence of a word that ordinary words seldom reach.
USUAL = 2.0
#: Shorter texts count as long as this where length itself is judged.
FEWEST_WORDS = 20
FEATURES = ("per_byte", "first", "second", "first_4", "first_8", "excess_for_length", "log_words", "excess")
#: Labelled rows of each class, chosen by a hash of their ids, that a model is fitted on; a quarter of them calibrates.
ROWS_PER_CLASS = 8_000
CUTOFF = 0.7
CACHED_WORDS = 300_000
#: Letters of texts that are split at once, about, and words whose n-grams are held at once: a batch of rows has far more.
LETTERS_AT_ONCE, WORDS_AT_ONCE = 1 << 18, 1 << 15

# other ASCII than letters and digits stands between words; one digit stands for all
_BETWEEN = bytes(i if i >= 128 or chr(i).isalpha() else 48 if chr(i).isdigit() else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_BETWEEN).split()


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams as integers, word after word, and where each word's begin; spaces stand before and after a word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    text = np.frombuffer((b" " * (ORDER - 1)).join([b"", *[w + b" " for w in words]]), np.uint8).astype(np.int64)
    keys = np.zeros(len(text), np.int64)
    for back in range(ORDER):
        keys[back:] |= text[:len(text) - back] << (8 * back)
    starts = np.append(0, np.cumsum(lengths + 1))
    # the first places of each word only hold the spaces before it
    place = np.arange(starts[-1]) + np.repeat(np.arange(1, len(words) + 1) * (ORDER - 1), lengths + 1)
    return keys[place], starts[:-1]


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all words of the texts in ascending order, and how often each occurs."""
    grams, n = np.zeros((2, 0), np.int64)
    for some in bounded(texts, LETTERS_AT_ONCE):
        words = [w for t in some for w in words_of(t)]
        for at in range(0, len(words), WORDS_AT_ONCE):
            more, m = np.unique(_grams(words[at:at + WORDS_AT_ONCE])[0], return_counts=True)
            grams, place = np.unique(np.concatenate([grams, more]), return_inverse=True)
            m, n = np.concatenate([n, m]), np.zeros(len(grams), np.int64)
            np.add.at(n, place, m)
    return grams, n


class Model:
    """Evidence of each n-gram and, for n-grams never seen, of its context; weights of the logistic function."""

    def __init__(self, counts: pd.DataFrame):
        """counts: gram, toxic (0 or 1), n."""
        by = [dict(zip(c["gram"].tolist(), c["n"].tolist())) for c in (counts[counts["toxic"] == y] for y in (0, 1))]
        grams = set(by[0]) | set(by[1])
        shared, left = [], grams
        for order in range(ORDER - 1, 0, -1):
            mask = (1 << 8 * order) - 1
            continued = Counter(g & mask for g in left)
            shared.append((continued, *_totals(continued)))
            left = set(continued)

        def backoff(gram: int, depth: int = 0) -> float:
            if depth == len(shared):
                return 1 / 256
            gram &= (1 << 8 * (ORDER - 1 - depth)) - 1
            n, total, kinds = shared[depth]
            context = gram >> 8
            return (max(n[gram] - DISCOUNT, 0) + DISCOUNT * kinds[context] * backoff(gram, depth + 1)) / total[context]

        totals = [_totals(c) for c in by]

        def probability(y: int, gram: int, lower: float) -> float:
            total, kinds = totals[y]
            context = gram >> 8
            if context not in total:
                return lower
            return (max(by[y].get(gram, 0) - DISCOUNT, 0) + DISCOUNT * kinds[context] * lower) / total[context]

        self.grams = np.array(sorted(grams), np.int64)
        lower = [backoff(g) for g in self.grams.tolist()]
        self.evidence = np.array([np.log(probability(1, g, p) / probability(0, g, p)) for g, p in zip(self.grams.tolist(), lower)])
        self.contexts = np.array(sorted({g >> 8 for g in grams}), np.int64)
        weight = [[DISCOUNT * t[1][h] / t[0][h] if h in t[0] else 1.0 for h in self.contexts.tolist()] for t in totals]
        self.context_evidence = np.log(np.array(weight[1]) / np.array(weight[0]))
        self.weights: np.ndarray | None = None
        self._known: dict[bytes, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def word_evidence(self, words: list[bytes]) -> np.ndarray:
        parts = [self._evidence(words[at:at + WORDS_AT_ONCE]) for at in range(0, len(words), WORDS_AT_ONCE)]
        return np.concatenate([np.zeros(0), *parts])

    def _evidence(self, words: list[bytes]) -> np.ndarray:
        keys, starts = _grams(words)
        out = _find(self.contexts, self.context_evidence, keys >> 8, 0.0)
        out = _find(self.grams, self.evidence, keys, out)
        return np.add.reduceat(out, starts)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """``FEATURES`` of each text: greatest evidences (0 beyond the words there are) and means of the first of them."""
        parts = [self._features(some) for some in bounded(texts, LETTERS_AT_ONCE)]
        return np.concatenate([np.zeros((0, len(FEATURES))), *parts])

    def _features(self, texts: list[str | None]) -> np.ndarray:
        known = self._known
        if len(known) > CACHED_WORDS:
            known.clear()
        out = np.zeros((len(texts), len(FEATURES)))
        split = [words_of(t) for t in texts]
        new = list(set().union(*split).difference(known))
        known.update(zip(new, self.word_evidence(new).tolist()))
        for row, words in zip(out, split):
            n = len(words)
            if not n:
                continue
            values = np.zeros(max(8, n))
            values[:n] = np.fromiter(map(known.__getitem__, words), np.float64, n)
            top = np.sort(np.partition(values, -8)[-8:])[::-1]
            excess = np.maximum(values - USUAL, 0).sum()
            row[:] = (values.sum() / (sum(map(len, words)) + n + 1), top[0], top[1], top[:4].mean(), top.mean(),
                      excess / np.sqrt(n + 1), np.log1p(max(n, FEWEST_WORDS)), excess)
        return out

    def calibrate(self, features: np.ndarray, labels: np.ndarray, ridge: float = 0.3) -> None:
        """Ridge logistic regression by damped Newton steps on standardised features."""
        self.mean, self.scale = features.mean(axis=0), features.std(axis=0) + 1e-9
        x = np.column_stack([(features - self.mean) / self.scale, np.ones(len(features))])

        def loss(w: np.ndarray) -> float:
            return np.logaddexp(0, np.where(labels > 0, -1, 1) * (x @ w)).sum() + ridge / 2 * w @ w

        w = np.zeros(x.shape[1])
        for _ in range(100):
            p = _logistic(x @ w)
            slope = x.T @ (p - labels) + ridge * w
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
            before = loss(w)
            while loss(w - step) > before and np.abs(step).max() > 1e-9:
                step = step / 2
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """From 0 to 1; 0 for a text without words."""
        x = self.features(texts)
        worded = x[:, FEATURES.index("log_words")] > 0
        return np.where(worded, _logistic((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]), 0.0)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


def _totals(counts: dict[int, int]) -> tuple[Counter, Counter]:
    """Of each context: the sum of its counts and how many n-grams go on from it."""
    total, kinds = Counter(), Counter()
    for gram, n in counts.items():
        total[gram >> 8] += n
        kinds[gram >> 8] += 1
    return total, kinds


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model | None:
    """A model of the labelled rows (doc_id, toxic); None if either class has no rows to count or to calibrate with.

    Rows without an id or a label are not used; of several labels of an id the greatest counts. At most ``rows_per_class`` ids
    of each class are learned from, so the counts that reach the driver are bounded; their choice does not depend on order.
    """
    tag = F.xxhash64("doc_id", F.lit(11))
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    present = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = [present.where(F.col("toxic") == y).orderBy(tag, "doc_id").limit(rows_per_class) for y in (0, 1)]
    chosen = chosen[0].union(chosen[1]).withColumn("holds", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(4)) == 0)
    # at most 2 * rows_per_class ids
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y in (0, 1):
                grams, n = gram_counts([t for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if c == y])
                if len(grams):
                    yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.full(len(grams), y, np.int32)), pa.array(n)],
                                                     ["gram", "toxic", "n"])

    counts = sample.where("NOT holds").select("text", "toxic").mapInArrow(count, "gram long, toxic int, n long") \
        .groupBy("gram", "toxic").agg(F.sum("n").alias("n")).toPandas()
    if counts["toxic"].nunique() < 2:
        return None
    model = Model(counts)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, x.T.copy())], ["toxic", *FEATURES])

    schema = ", ".join(["toxic int", *[f"{f} double" for f in FEATURES]])
    held = sample.where("holds").select("text", "toxic").mapInArrow(measure, schema).toPandas()
    if held["toxic"].nunique() < 2:
        return None
    model.calibrate(held[list(FEATURES)].to_numpy(), held["toxic"].to_numpy(np.float64))
    return model


def score(text: Column | str, model: Model | None) -> Column:
    """Toxicity of each whole text from 0 to 1; 0 for null texts, texts without words, and without a model."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        parts = [model.scores(texts.iloc[at:at + 256].tolist()) for at in range(0, len(texts), 256)]
        return pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return of(text)


def held_out(doc_id: Column | str) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 3, is 1 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learned from labelled rows that are not held out.

    Repeated rows each get a row; an empty table gives no rows; other columns are left out.
    """
    model = fit(docs, labels.where(~held_out("doc_id")), rows_per_class)
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), score("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))


def keep_ordinary(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """The rows, with all their columns, whose text is not predicted as toxic."""
    model = fit(docs, labels.where(~held_out("doc_id")), rows_per_class)
    return docs.where(score("text", model) < CUTOFF)
