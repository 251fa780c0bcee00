"""Character n-gram features, naive Bayes training and scoring, decisions (TF, LG, BN)."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.defaults import CYRILLIC_LANGUAGES
from corpusflow.functions import text as tx
from corpusflow.session import cut_lineage, shared_folder, stored

# Smoothing and decision thresholds.
LANGUAGE_SMOOTHING = 0.45
BINARY_SMOOTHING = 0.5
MIN_LETTERS = 2
MIN_CONFIDENCE = 0.36
MIN_COVERAGE = 0.28
MIN_MARGIN = 0.04
MIN_WORD_COVERAGE = 0.12
HIGH_CONFIDENCE_WITHOUT_WORDS = 0.92
MIN_SHARED_WORD_COVERAGE = 0.40
MAX_SHARED_LETTERS = 96
GREETING_SINGLE = 0.97
GREETING_FIRST = 0.78

#: Largest model that workers hold, or n-grams of one without its word features; a worker needs some four to eight times as much.
BROADCAST_BYTES = 32 * 1024 * 1024
#: Characters of the texts that meet the words of a larger model together.
BLOCK_CHARS = 8 * 1024 * 1024


# ---------------------------------------------------------------- features

def gram_rows(words: DataFrame, *columns: str) -> DataFrame:
    """(columns, ngram): the features of the composed form of ``word``."""
    composed = words.select(*columns, tx.nfc(F.col("word")).alias("_composed"))
    return composed.select(*columns, F.explode(tx.word_ngrams(F.col("_composed"))).alias("ngram"))


def char_ngrams(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """TF1: (keys, ngram, n). Words are counted first, so n-grams are built once per distinct word."""
    grams = gram_rows(tx.word_counts(df, keys, text), *keys, "n")
    return grams.groupBy(*keys, "ngram").agg(F.sum("n").alias("n"))


def script_profile(df: DataFrame, text: str = "text") -> DataFrame:
    """TF3/TF4: letters per script, restricted label set and the unsupported flag."""
    counts = tx.script_counts(F.col(text))
    df = df.select("*", tx.letter_count(F.col(text)).alias("letters"),
                   *[c.alias(name) for name, c in counts.items()])
    top = F.greatest(*counts)
    strong = (F.col("letters") >= 4) & (top >= F.col("letters") * 0.7)
    return df.withColumn(
        "restrict_script",
        F.when(strong & (F.col("greek") == top), "greek")
        .when(strong & (F.col("georgian") == top), "georgian")
        .when(strong & (F.col("armenian") == top), "armenian")
        .when(strong & (F.col("cyrillic") == top), "cyrillic")) \
        .withColumn("unsupported", (F.col("letters") >= 4) & (F.col("other") >= 4)
                    & (F.col("other") >= F.col("letters") * 0.4))


def allowed_labels(script: Column) -> Column:
    """TF4: the label set a dominant script allows; null = no restriction."""
    return F.when(script == "greek", F.array(F.lit("el"))) \
        .when(script == "georgian", F.array(F.lit("ka"))) \
        .when(script == "armenian", F.array(F.lit("hy"))) \
        .when(script == "cyrillic", F.array(*[F.lit(c) for c in CYRILLIC_LANGUAGES]))


def greeting_key(text: Column) -> Column:
    """TF6: letters and blanks only, lower case, blanks collapsed."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L} ]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def match_greetings(df: DataFrame, greetings: DataFrame, text: str = "text") -> DataFrame:
    """TF6: add ``greeting_codes`` (ordered, null without a match); greetings(phrase, codes)."""
    keyed = df.withColumn("_phrase", greeting_key(F.col(text)))
    table = greetings.select(F.col("phrase").alias("_phrase"), F.col("codes").alias("greeting_codes"))
    return keyed.join(table, "_phrase", "left").drop("_phrase")


def greeting_scores(codes: Column) -> Column:
    """TF6: first code .97 alone, else .78 with the rest shared; the best three."""
    first = F.when(F.size(codes) == 1, F.lit(GREETING_SINGLE)).otherwise(F.lit(GREETING_FIRST))
    rest = (F.lit(1.0) - F.lit(GREETING_FIRST)) / (F.size(codes) - 1)
    return F.slice(F.transform(codes, lambda c, i: F.struct(
        c.alias("code"), F.when(i == 0, first).otherwise(rest).alias("p"))), 1, 3)


def example_weight(text: Column, is_greeting: Column | None = None) -> Column:
    """TF5: weight of a training text by length and completeness."""
    complete = F.substring(text, -1, 1).isin(".", "?", "!", "։", "…")
    greeting = is_greeting if is_greeting is not None else F.lit(False)
    return F.when(greeting, 1.0).when(~tx.has_letters(text, 12), 0.2).when(complete & tx.has_letters(text, 25), 1.0) \
        .when(complete, 0.7).otherwise(0.35)


def quoted(text: str) -> str:
    """A pattern that matches the text itself."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def cue_match(text: Column, cues: dict[str, list[str]]) -> Column:
    """TF7: a folded word contains a stem or known name, equals a token, or starts with a prefix."""
    folded = tx.fold(text)
    tests = []
    inside = [*cues.get("contains", []), *(quoted(name) for name in cues.get("names", []))]
    if inside:
        tests.append("(?:" + "|".join(inside) + ")")
    if cues.get("exact"):
        tests.append(r"(?:^|[^\p{L}])(?:" + "|".join(cues["exact"]) + r")(?:$|[^\p{L}])")
    if cues.get("prefix"):
        tests.append(r"(?:^|[^\p{L}])(?:" + "|".join(cues["prefix"]) + ")")
    return F.coalesce(folded.rlike("|".join(tests)), F.lit(False)) if tests else F.lit(False)


# ---------------------------------------------------------------- naive Bayes

@dataclass
class NBModel:
    """``counts``: one row per n-gram with one nullable count column per label (c0, c1, ...)."""

    labels: list[str]
    counts: DataFrame
    priors: list[float]
    totals: list[float]
    vocabulary: int
    smoothing: float
    _held: Broadcast | None = None
    _held_short: Broadcast | None = None

    def denominator(self, i: int) -> float:
        return self.totals[i] + self.smoothing * self.vocabulary

    def unseen(self, i: int) -> float:
        return math.log(self.smoothing / self.denominator(i))

    def log_likelihood(self, i: int) -> Column:
        seen = F.log((F.col(f"c{i}") + self.smoothing) / self.denominator(i))
        return F.when(F.col(f"c{i}").isNotNull(), seen.cast("float").cast("double"))

    def likelihoods(self) -> DataFrame:
        """ngram and a nullable log-likelihood per label (p0, p1, ...)."""
        return self.counts.select("ngram", *[self.log_likelihood(i).alias(f"p{i}") for i in range(len(self.labels))])

    def is_small(self) -> bool:
        """The whole table, as counted in training, is below the bound for what a worker may hold."""
        return self.vocabulary * (48 + 9 * len(self.labels)) <= BROADCAST_BYTES

    def local(self) -> Broadcast:
        """The likelihoods for the workers, fetched once as an Arrow table (the driver has no object for each n-gram); only for a small model."""
        if self._held is None:
            self._held = self.counts.sparkSession.sparkContext.broadcast(self.likelihoods().toArrow())
        return self._held

    def local_short(self) -> Broadcast | None:
        """``local`` without the word features, of which a large corpus has ever more; None if that is still too large."""
        if self._held_short is None:
            short = self.likelihoods().filter(~F.startswith("ngram", F.lit("w:")))
            if short.count() * (48 + 9 * len(self.labels)) > BROADCAST_BYTES:
                return None
            self._held_short = self.counts.sparkSession.sparkContext.broadcast(short.toArrow())
        return self._held_short

    def likelihood_table(self) -> DataFrame:
        """LG1 as rows: (label, ngram, log_likelihood)."""
        rows = F.array(*[F.struct(F.lit(label).alias("label"), self.log_likelihood(i).alias("log_likelihood"))
                         for i, label in enumerate(self.labels)])
        return self.counts.select("ngram", F.inline(rows)) \
            .filter(F.col("log_likelihood").isNotNull()).select("label", "ngram", "log_likelihood")

    def prior_table(self) -> DataFrame:
        spark = self.counts.sparkSession
        return spark.createDataFrame(
            [(label, self.priors[i], self.unseen(i), self.totals[i]) for i, label in enumerate(self.labels)],
            "label string, log_prior double, unseen double, tokens double")


def train_nb(labeled: DataFrame, smoothing: float = LANGUAGE_SMOOTHING, label: str = "label",
             text: str = "text", weight: str | None = "weight") -> NBModel:
    """LG1: weighted multinomial naive Bayes.

    The corpus is reduced to (label, word) sums before any n-gram exists; the n-gram table is
    stored once (reliable checkpoint) and read by every later use. Only per-label totals reach
    the driver.
    """
    if weight is not None and weight in labeled.columns:
        w = F.when(F.col(weight) <= 0, 1.0).otherwise(F.coalesce(F.col(weight).cast("double"), F.lit(1.0)))
    else:
        w = F.lit(1.0)
    data = labeled.select(F.col(label).alias("label"), F.col(text).alias("text"), w.alias("_weight"))
    docs = {r["label"]: r["w"] for r in
            data.groupBy("label").agg(F.sum("_weight").alias("w")).collect()}
    if not docs:
        raise ValueError("training data is empty")
    labels = sorted(docs)
    by_word = tx.word_counts(data, ["label"], "text", F.col("_weight"))
    grams = by_word.select("label", "word", F.col("n").cast("double").alias("n")).mapInArrow(_gram_sums(labels), "label string, ngram string, n double")
    wide = grams.groupBy("ngram").agg(*[
        F.sum(F.when(F.col("label") == name, F.col("n"))).alias(f"c{i}") for i, name in enumerate(labels)])
    wide = cut_lineage(wide)
    sums = wide.agg(F.count(F.lit(1)).alias("v"),
                    *[F.coalesce(F.sum(f"c{i}"), F.lit(0.0)).alias(f"t{i}") for i in range(len(labels))]).first()
    total = sum(docs.values())
    priors = [math.log((docs[name] + smoothing) / (total + smoothing * len(labels))) for name in labels]
    return NBModel(labels, wide, priors, [sums[f"t{i}"] for i in range(len(labels))],
                   max(sums["v"], 1), smoothing)


def _short_codes(words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(for each size (word, n-gram as a whole number) of the n-grams of composed words, words with letters over two bytes, left out)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    letters = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(letters))
    wide = np.zeros(len(words), bool)
    wide[word[letters > 0xFFFF]] = True
    code, found = np.zeros(len(letters), np.uint64), []
    for n in range(1, tx.MAX_N + 1):
        code = code[:len(letters) - n + 1] << np.uint64(16) | letters[n - 1:]
        if n >= tx.MIN_N:
            at = np.flatnonzero((left[:len(code)] >= n) & ~wide[word[:len(code)]])
            found.append((word[at], code[at]))
    return found, np.flatnonzero(wide)


def _gram_of(code: int) -> str:
    out = ""
    while code:
        out, code = chr((code & 0xFFFF) - 1) + out, code >> 16
    return out


def _gram_sums(labels: list[str]) -> Callable:
    """(label, word, n) -> (label, ngram, n): word features one by one, n-grams summed up over what a task reads."""
    schema = pa.schema([("label", pa.string()), ("ngram", pa.string()), ("n", pa.float64())])

    def rows(names: list[str], grams: list[str], n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.float64())], schema=schema)

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        sums = np.concatenate([s for _, s in held])
        return codes, np.stack([np.bincount(at, sums[:, i], len(codes)) for i in range(len(labels))], axis=1)

    def given(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        codes, sums = summed(held)
        for i, name in enumerate(labels):
            some = np.flatnonzero(sums[:, i])
            for at in range(0, len(some), 65_536):
                part = some[at:at + 65_536]
                yield rows([name] * len(part), [_gram_of(c) for c in codes[part].tolist()], sums[part, i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = kept = 0
        number = {name: i for i, name in enumerate(labels)}
        for batch in batches:
            if not batch.num_rows:
                continue
            words = [unicodedata.normalize("NFC", w) for w in batch.column("word").to_pylist()]
            names, n = batch.column("label").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False)
            whole = [i for i, w in enumerate(words) if len(w) <= tx.MAX_WORD_FEATURE]
            yield rows([names[i] for i in whole], ["w:" + words[i] for i in whole], n[whole])
            coded, wide = _short_codes(words)
            for i in wide.tolist():
                grams = tx.word_features(words[i])[int(len(words[i]) <= tx.MAX_WORD_FEATURE):]
                yield rows([names[i]] * len(grams), grams, np.full(len(grams), n[i]))
            of, codes = (np.concatenate(c) for c in zip(*coded))
            codes, at = np.unique(codes, return_inverse=True)
            label = np.array([number[x] for x in names])
            sums = np.bincount(at * len(labels) + label[of], n[of], len(codes) * len(labels)).reshape(-1, len(labels))
            held.append((codes, sums))
            waiting += len(codes)
            if waiting > max(500_000, kept):
                held = [summed(held)]
                waiting, kept = 0, len(held[0][0])
                if kept > 2_000_000:  # other scripts have more n-grams than a task should hold
                    yield from given(held)
                    held, kept = [], 0
        if held:
            yield from given(held)

    return run


class _Grams:
    """Numbers of the n-grams of a model. Short ones of two-byte letters are looked up by a whole number, for many words at once."""

    def __init__(self, grams: list[str]):
        self.index = {g: i for i, g in enumerate(grams)}
        short = [(self._code(g), i) for i, g in enumerate(grams) if len(g) <= tx.MAX_N and max(g, default="\0") < "\uffff"]
        self.codes = pd.Index(np.array([c for c, _ in short], np.uint64))
        self.numbers = np.array([i for _, i in short], np.int64)

    @staticmethod
    def _code(gram: str) -> int:
        code = 0
        for letter in gram:
            code = code << 16 | ord(letter) + 1
        return code

    def of(self, words: list[str], whole_words: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(features of each word, whether it has a word feature, number of that or -1; word and number of the known n-grams)."""
        words = [unicodedata.normalize("NFC", w) for w in words]
        short = [len(w) <= tx.MAX_WORD_FEATURE for w in words]
        get = whole_words.get
        number = np.fromiter((get("w:" + w, -1) if ok else -1 for w, ok in zip(words, short)), np.int64, len(words))
        whole, lengths = np.array(short, bool), np.fromiter(map(len, words), np.int64, len(words)) + 2
        counts = whole + sum(np.maximum(0, lengths - n + 1) for n in range(tx.MIN_N, tx.MAX_N + 1))
        found_of, found = [], []
        coded, wide = _short_codes(words)
        for of, codes in coded:
            places = self.codes.get_indexer(codes)
            known = places >= 0
            found_of.append(of[known])
            found.append(self.numbers[places[known]])
        for i in wide:
            numbers = [g for g in map(self.index.get, tx.word_features(words[i])[int(whole[i]):]) if g is not None]
            found_of.append(np.full(len(numbers), i))
            found.append(np.array(numbers, np.int64))
        return counts, whole, number, np.concatenate(found_of), np.concatenate(found)


def _parts(likelihoods: pa.Table) -> tuple[list[str], np.ndarray]:
    """(n-grams, their log-likelihoods, NaN = none)."""
    matrix = [likelihoods.column(name).to_numpy().astype(np.float64) for name in likelihoods.column_names if name != "ngram"]
    return likelihoods.column("ngram").to_pylist(), np.column_stack(matrix)


class _WordScorer:
    """Per word: features, word features and, per label, gain, seen features and the known word feature; kept while met again.

    Texts of so many words are taken together, and their new words are looked up at once.
    """

    CACHED, TOGETHER = 300_000, 65_536

    def __init__(self, grams: list[str] | _Grams, likelihoods: np.ndarray, unseen: list[float], words: list[str] | None = None):
        """``words``: word features whose likelihoods follow those of the grams, which then hold none."""
        self.grams = grams if isinstance(grams, _Grams) else _Grams(grams)
        self.words = self.grams.index if words is None else {w: i for i, w in enumerate(words, len(self.grams.index))}
        self.known = ~np.isnan(likelihoods)
        self.gain = np.where(self.known, likelihoods - np.array(unseen), 0.0)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, 2 + 3 * len(unseen)))

    def _add(self, words: list[str]) -> None:
        counts, has_word, number, of, grams = self.grams.of(words, self.words)
        first, k = len(self.rows), self.gain.shape[1]
        while first + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        new = self.table[first:first + len(words)]
        whole = np.flatnonzero(number >= 0)
        of, grams = np.concatenate([whole, of]), np.concatenate([number[whole], grams])
        new[:, 0], new[:, 1] = counts, has_word
        for i in range(k):
            new[:, 2 + i] = np.bincount(of, self.gain[grams, i], len(words))
            new[:, 2 + k + i] = np.bincount(of, self.known[grams, i], len(words))
            new[:, 2 + 2 * k + i] = 0
            new[whole, 2 + 2 * k + i] = self.known[number[whole], i]
        self.rows.update(zip(words, range(first, first + len(words))))

    def total(self, text: str) -> np.ndarray:
        return next(self.totals([text]))

    def totals(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The sums of each text."""
        waiting: list[str] = []
        ends: list[int] = []
        for text in texts:
            waiting += text.split()
            ends.append(len(waiting))
            if len(waiting) >= self.TOGETHER:
                yield from self._summed(waiting, ends)
                waiting, ends = [], []
        yield from self._summed(waiting, ends)

    def _summed(self, words: list[str], ends: list[int]) -> Iterator[np.ndarray]:
        new = set(words).difference(self.rows)
        if len(self.rows) + len(new) > self.CACHED and self.rows:
            self.rows.clear()
            new = set(words)
        names = list(new)
        for at in range(0, len(names), self.TOGETHER):
            self._add(names[at:at + self.TOGETHER])
        table = self.table[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]
        first = 0
        for end in ends:
            yield table[first:end].sum(axis=0)
            first = end


class _Sums:
    """The score columns of texts by a scorer of words; holds no more of the model than its totals."""

    def __init__(self, model: NBModel):
        self.unseen, self.priors = [model.unseen(i) for i in range(len(model.labels))], np.array(model.priors)

    def of(self, scorer: _WordScorer, texts: pd.Series) -> pd.DataFrame:
        rows, k = [], len(self.unseen)
        for sums in scorer.totals(words or "" for words in texts):
            whole = sums[[0, 1, *range(2 + k, 2 + 3 * k)]].astype(np.int64)
            rows.append((whole[0], whole[1], self.priors + np.array(self.unseen) * sums[0] + sums[2:2 + k], whole[2:2 + k], whole[2 + k:]))
        return pd.DataFrame(rows, columns=["tokens", "word_tokens", "scores", "seen", "word_seen"])


def score_column(text: Column, model: NBModel) -> Column:
    """LG2/LG3 of a text as struct<tokens, word_tokens, scores, seen, word_seen> (no tokens without features), in the text's own row.

    The measured model goes to the workers once; texts meet it where they are, nothing is shuffled.
    """
    held, sums = model.local(), _Sums(model)

    @F.pandas_udf("tokens long, word_tokens long, scores array<double>, seen array<long>, word_seen array<long>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _WordScorer(*_parts(held.value), sums.unseen)
        for part in parts:
            yield sums.of(scorer, part)

    # a condition on the scores must not be pushed below them, where it would score every text once more
    return score.asNondeterministic()(F.regexp_replace(F.lower(text), tx.WORD_BREAK, " "))


def score_nb(df: DataFrame, model: NBModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """LG2/LG3, one row per text that has features: (key, tokens, word_tokens, scores, seen, word_seen); arrays follow
    ``model.labels``."""
    return with_scores(df.select(key, text), model, text).filter("tokens IS NOT NULL").select(key, *_SCORE)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the blocks of a task, each of about BLOCK_CHARS characters of text, however long the texts are."""
    seen = 0
    for batch in batches:
        ends = seen + batch["text"].str.len().fillna(0).add(64).cumsum().to_numpy()
        yield batch.assign(block=(ends // BLOCK_CHARS).astype(np.int64))
        seen = ends[-1] if len(ends) else seen


def _block_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct word features of each block."""
    return _block_grams(batches, lambda words: {f"w:{c}" for w in words if w and len(c := unicodedata.normalize("NFC", w)) <= tx.MAX_WORD_FEATURE})


def _block_grams(batches: Iterator[pd.DataFrame], of: Callable | None = None) -> Iterator[pd.DataFrame]:
    """The distinct features of each block; the rows of a block follow each other."""
    at, words = None, set()

    def features() -> pd.DataFrame:
        grams = list(of(words) if of else {g for w in words if w for g in tx.word_features(w)})
        return pd.DataFrame({"task": at[0], "block": at[1], "ngram": pd.Series(grams, dtype=object)})

    for batch in batches:
        for key, part in batch.groupby(["task", "block"], sort=False):
            if key != at:
                if at is not None:
                    yield features()
                at, words = key, set()
            for text in part["text"]:
                words.update((text or "").split(" "))
    if at is not None:
        yield features()


_SHORT: dict[int, tuple[_Grams, np.ndarray, pa.Table]] = {}


def _short_grams(short: Broadcast) -> tuple[_Grams, np.ndarray]:
    """The n-grams of a broadcast, made ready once in a worker; the last ones stay."""
    held = short.value
    if id(held) not in _SHORT:
        grams, likelihoods = _parts(held)
        _SHORT.clear()
        _SHORT[id(held)] = _Grams(grams), likelihoods, held
    return _SHORT[id(held)][:2]


def score_nb_shuffled(df: DataFrame, model: NBModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The sums of a model that workers cannot hold, by a ``key`` that is unique.

    A block of texts gets the part of the model that its words need: it asks for each of its distinct features once, however
    often and in however many texts they stand. Most of a large model are word features; if workers can hold the n-grams
    without them, only word features are asked for. The texts move once, to their block; nothing has a row per text and word.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, "blocks")
    kind, k = dict(df.dtypes)[key], len(model.labels)
    plain = F.regexp_replace(F.lower(F.col(text)), tx.WORD_BREAK, " ")
    schema = f"row {kind}, text string, task int, block long"
    df.select(F.col(key).alias("row"), plain.alias("text")).withColumn("task", F.spark_partition_id()) \
        .mapInPandas(_blocks, schema).write.parquet(folder)
    texts = spark.read.schema(schema).parquet(folder)
    short = model.local_short()
    asked = texts.select("task", "block", "text").mapInPandas(_block_words if short else _block_grams, "task int, block long, ngram string")
    # the likelihoods are 32-bit numbers, which move as such
    given = asked.join(model.likelihoods().select("ngram", *[F.col(f"p{i}").cast("float") for i in range(k)]), "ngram")
    sums = _Sums(model)

    def score(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        grams, likelihoods = known["ngram"].tolist(), known[[f"p{i}" for i in range(k)]].to_numpy(np.float64)
        if short:
            of, held = _short_grams(short)
            scorer = _WordScorer(of, np.concatenate([held, likelihoods]), sums.unseen, grams)
        else:
            scorer = _WordScorer(grams, likelihoods, sums.unseen)
        found = sums.of(scorer, rows["text"])
        return found.assign(row=rows["row"].to_numpy())[["row", *_SCORE]][found["tokens"] > 0]

    # small in bytes, long in time: adaptive execution must not put many blocks into one task
    parts = max(spark.sparkContext.defaultParallelism, texts.select("task", "block").distinct().count())
    dealt = [side.repartition(parts, "task", "block").groupBy("task", "block") for side in (texts, given)]
    summed = dealt[0].cogroup(dealt[1]).applyInPandas(
        score, f"row {kind}, tokens long, word_tokens long, scores array<double>, seen array<long>, word_seen array<long>")
    return summed.withColumnRenamed("row", key)


_SCORE = ["tokens", "word_tokens", "scores", "seen", "word_seen"]


def with_scores(df: DataFrame, model: NBModel, text: str) -> DataFrame:
    """All rows with the score columns, null for texts without features.

    Each row is a text of its own whatever its key: for a model that workers cannot hold rows are numbered and stored first.
    """
    if model.is_small():
        has = F.col("_s.tokens") > 0
        return df.withColumn("_s", score_column(F.col(text), model)).select("*", *[F.when(has, F.col(f"_s.{c}")).alias(c) for c in _SCORE]).drop("_s")
    numbered = stored(df.withColumn("_row_number", F.monotonically_increasing_id()), "numbered")
    return numbered.join(score_nb_shuffled(numbered, model, "_row_number", text), "_row_number", "left").drop("_row_number")


def _softmax(scores: Column) -> Column:
    """Null scores (excluded labels) get probability 0."""
    top = F.array_max(scores)
    exps = F.transform(scores, lambda s: F.coalesce(F.exp(s - top), F.lit(0.0)))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(exps, lambda e: e / total)


def rank_labels(scored: DataFrame, labels: list[str], allowed: Column | None = None) -> DataFrame:
    """LG2: add ``ranked`` array<struct<neg_p, idx, code, p, seen, word_seen>>, best first, ties by label."""
    names = F.array(*[F.lit(c) for c in labels])
    scores = F.col("scores")
    if allowed is not None:
        scores = F.zip_with(scores, names, lambda s, c: F.when(
            allowed.isNull() | F.array_contains(allowed, c), s))
    df = scored.withColumn("_scores", scores)
    df = df.withColumn("probabilities", _softmax(F.col("_scores")))
    ranked = F.transform(names, lambda c, i: F.struct(
        (-F.element_at("probabilities", i + 1)).alias("neg_p"), i.alias("idx"), c.alias("code"),
        F.element_at("probabilities", i + 1).alias("p"), F.element_at("seen", i + 1).alias("seen"),
        F.element_at("word_seen", i + 1).alias("word_seen")))
    return df.withColumn("ranked", F.sort_array(ranked)).drop("_scores")


def label_probabilities(df: DataFrame, model: NBModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """LG2 as rows: (key, label, score, p, seen, word_seen, tokens, word_tokens)."""
    scored = rank_labels(score_nb(df, model, key, text), model.labels)
    names = F.array(*[F.lit(c) for c in model.labels])
    return scored.select(key, "tokens", "word_tokens", F.inline(F.arrays_zip(
        names.alias("label"), F.col("scores").alias("score"), F.col("probabilities").alias("p"),
        F.col("seen"), F.col("word_seen"))))


def decide_language(df: DataFrame, model: NBModel, key: str = "doc_id", text: str = "text",
                    greetings: DataFrame | None = None, strict_quirks: bool = True) -> DataFrame:
    """LG4: the ordered decision over greeting, letters, script, coverage, shared words and margin.

    -> (key, code, p, coverage, is_unknown, is_ambiguous, is_unrecognized_script, reason, top)
    with ``top`` array<struct<code, p>>, at most 8.
    """
    base = df.select(key, text)
    if greetings is not None:
        base = match_greetings(base, greetings, text)
    else:
        base = base.withColumn("greeting_codes", F.lit(None).cast("array<string>"))
    scored = with_scores(script_profile(base, text), model, text).select(
        key, "greeting_codes", "letters", "restrict_script", "unsupported", *_SCORE)
    allowed = allowed_labels(F.col("restrict_script"))
    scored = rank_labels(scored, model.labels, allowed)
    any_label = F.coalesce(F.arrays_overlap(allowed, F.array(*[F.lit(c) for c in model.labels])), F.lit(True))
    first_in = F.coalesce(F.array_contains(allowed, F.lit(model.labels[0])), F.lit(True))
    word_tokens = F.when(first_in, F.col("word_tokens")).otherwise(F.lit(0)) if strict_quirks else F.col("word_tokens")
    scored = scored.withColumn("_wt", F.coalesce(word_tokens, F.lit(0))) \
        .withColumn("_top", F.element_at("ranked", 1)) \
        .withColumn("coverage", F.col("_top.seen") / F.col("tokens")) \
        .withColumn("_wcov", F.when(F.col("_wt") > 0, F.col("_top.word_seen") / F.col("_wt")).otherwise(0.0)) \
        .withColumn("_margin", F.col("_top.p") - (F.element_at("ranked", 2)["p"] if len(model.labels) > 1 else F.lit(0.0)))
    hits = F.slice(F.transform("ranked", lambda r: F.struct(r["code"].alias("code"), r["p"].alias("p"))), 1, 8)
    shared = F.slice(F.filter("ranked", lambda r: (F.col("_wt") > 0) & (
        r["word_seen"] / F.col("_wt") >= MIN_SHARED_WORD_COVERAGE)), 1, 8)
    scored = scored.withColumn("_shared", shared).withColumn(
        "_sum", F.aggregate("_shared", F.lit(0.0), lambda acc, r: acc + r["word_seen"] / F.col("_wt")))
    flattened = F.transform(F.sort_array(F.transform("_shared", lambda r, i: F.struct(
        (-(r["word_seen"] / F.col("_wt"))).alias("neg"), i.alias("i"), r["code"].alias("code"),
        F.when(F.col("_sum") > 0, r["word_seen"] / F.col("_wt") / F.col("_sum")).otherwise(0.0).alias("p")))),
        lambda r: F.struct(r["code"].alias("code"), r["p"].alias("p")))
    scored = scored.withColumn("_flat", flattened)
    reason = (
        F.when(F.size("greeting_codes") > 0, "greeting")
        .when(F.col("letters") < MIN_LETTERS, "too_short")
        .when(F.col("unsupported"), "unsupported_script")
        .when(F.col("tokens").isNull(), "no_letters")
        .when(~any_label, "no_trained_language")
        .when(F.col("coverage") < MIN_COVERAGE, "low_coverage")
        .when((F.col("_wt") > 0) & (F.col("_wcov") < MIN_WORD_COVERAGE)
              & (F.col("_top.p") < HIGH_CONFIDENCE_WITHOUT_WORDS), "low_word_coverage")
        .when((F.col("_wt") > 0) & (F.col("letters") <= MAX_SHARED_LETTERS) & (F.size("_shared") >= 2), "shared_words")
        .when(F.col("_margin") < MIN_MARGIN, "small_margin")
        .when(F.col("_top.p") < MIN_CONFIDENCE, "low_confidence")
        .otherwise("detected"))
    out = scored.withColumn("reason", reason)
    is_reason = F.col("reason").isin
    empty = F.array().cast("array<struct<code:string,p:double>>")
    top = F.when(F.col("reason") == "greeting", greeting_scores(F.col("greeting_codes"))) \
        .when(F.col("reason") == "shared_words", F.col("_flat")) \
        .when(is_reason("too_short", "unsupported_script", "no_letters", "no_trained_language"), empty) \
        .otherwise(hits)
    out = out.withColumn("top", top).withColumn(
        "is_unknown", is_reason("too_short", "unsupported_script", "no_letters", "no_trained_language",
                                "low_coverage", "low_word_coverage", "low_confidence"))
    return out.select(
        key,
        F.when(~F.col("is_unknown"), F.get("top", F.lit(0))["code"]).alias("code"),
        F.coalesce(F.get("top", F.lit(0))["p"], F.lit(0.0)).alias("p"),
        F.when(F.col("reason") == "greeting", 1.0).when(F.col("is_unknown"), 0.0)
        .otherwise(F.col("coverage")).alias("coverage"),
        "is_unknown", is_reason("shared_words", "small_margin").alias("is_ambiguous"),
        (F.col("reason") == "unsupported_script").alias("is_unrecognized_script"), "reason", "top")


def detect_language(decided: DataFrame, known: list[str], fallback: str = "de") -> DataFrame:
    """LG5: the decided code, or the fallback when unknown, ambiguous or not in the catalog."""
    good = ~F.col("is_unknown") & ~F.col("is_ambiguous") & F.col("code").isin(*known)
    return decided.withColumn("language", F.when(good, F.col("code")).otherwise(F.lit(fallback)))


def evaluate(predicted: DataFrame, truth: str = "truth", pred: str = "pred") -> tuple[DataFrame, DataFrame]:
    """LG6: (confusion counts, accuracy per true label)."""
    confusion = predicted.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))
    accuracy = confusion.groupBy(truth).agg(
        F.sum("n").alias("total"),
        (F.sum(F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return confusion, accuracy


# ---------------------------------------------------------------- binary model and gates

def train_binary_nb(labeled: DataFrame, positive: str, negative: str, label: str = "label",
                    text: str = "text", smoothing: float = BINARY_SMOOTHING) -> NBModel:
    """BN1: unweighted two-label model, label names compared without case; both must occur."""
    name = F.when(F.lower(label) == positive.lower(), positive).when(F.lower(label) == negative.lower(), negative)
    data = labeled.select(name.alias("label"), F.col(text).alias("text")).filter(F.col("label").isNotNull())
    model = train_nb(data, smoothing, weight=None)
    if set(model.labels) != {positive, negative}:
        raise ValueError(f"training needs both labels {positive} and {negative}")
    return model


def score_binary_nb(df: DataFrame, model: NBModel, positive: str, negative: str, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """BN1: (key, label, p); a tie is positive, a text without features is negative with p = 1."""
    scored = with_scores(df.select(key, text), model, text)
    at = {name: i + 1 for i, name in enumerate(model.labels)}
    pos, neg = F.element_at("scores", at[positive]), F.element_at("scores", at[negative])
    top = F.greatest(pos, neg)
    p = F.exp(pos - top) / (F.exp(pos - top) + F.exp(neg - top))
    joined = scored.select(key, tx.has_letters(F.col(text), MIN_LETTERS).alias("_letters"), p.alias("_p"))
    usable = F.col("_letters") & F.col("_p").isNotNull()
    is_positive = usable & (F.col("_p") >= 0.5)
    return joined.select(key, F.when(is_positive, positive).otherwise(negative).alias("label"),
                         F.when(is_positive, F.col("_p")).when(usable, 1 - F.col("_p")).otherwise(1.0).alias("p"))


def is_positive(scored: DataFrame, positive: str, threshold: float = 0.45) -> DataFrame:
    """BN2: rows of the positive label at or above the threshold."""
    return scored.filter((F.col("label") == positive) & (F.col("p") >= threshold))


def abuse_gate(df: DataFrame, model: NBModel, hard: list[str], soft: list[str], key: str = "doc_id",
               text: str = "text", reject: str = "reject", ok: str = "ok", threshold: float = 0.55) -> DataFrame:
    """BN3 (fail-open): (key, passes, gate). Only rows with a soft marker reach the model."""
    lower = F.lower(text)
    step = F.when(tx.is_blank(F.col(text)), "blank").when(tx.any_substring(lower, hard), "hard_marker") \
        .when(~tx.any_substring(lower, soft), "no_marker").otherwise("model")
    staged = df.select(key, text, step.alias("gate"))
    direct = staged.filter(F.col("gate") != "model").select(
        key, (F.col("gate") != "hard_marker").alias("passes"), "gate")
    judged = score_binary_nb(staged.filter(F.col("gate") == "model").select(key, text), model, reject, ok, key, text)
    return direct.unionByName(judged.select(
        key, (~((F.col("label") == reject) & (F.col("p") >= threshold))).alias("passes"), F.lit("model").alias("gate")))


def scope_gate(df: DataFrame, model: NBModel, cues: dict[str, list[str]], key: str = "doc_id",
               text: str = "text", positive: str = "in_scope", negative: str = "out_of_scope",
               threshold: float = 0.42) -> DataFrame:
    """BN4: (key, in_scope, gate); a domain cue decides, the rest goes through the model."""
    staged = df.select(key, text, cue_match(F.col(text), cues).alias("_cue"))
    cued = staged.filter("_cue").select(key, F.lit(True).alias("in_scope"), F.lit("cue").alias("gate"))
    judged = score_binary_nb(staged.filter("NOT _cue").select(key, text), model, positive, negative, key, text)
    return cued.unionByName(judged.select(
        key, ((F.col("label") == positive) & (F.col("p") >= threshold)).alias("in_scope"), F.lit("model").alias("gate")))
