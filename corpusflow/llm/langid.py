"""Language identification by a bidirectional gated recurrent network over bytes, written and trained in numpy.

A text is read as UTF-8 in windows of ``WINDOW`` bytes that together hold each byte once (the last window of a longer text
begins earlier and only its new bytes count). The network labels every byte with a distribution over the languages; the mean
over all bytes is the document's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 64
HIDDEN = 8
#: Documents of each language that a network is trained on (chosen by a hash of their ids), and windows of each.
ROWS_PER_LANGUAGE = 400
WINDOWS_PER_ROW = 6
EPOCHS = 6
#: Windows that pass through the network together.
BATCH = 2_048
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")
_DIRECTIONS = ("forth", "back")


def _soften(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: squashes to -1..1 like tanh at a fraction of its cost; its slope is (1 - |value|)^2."""
    size = np.abs(x)
    size += 1
    x /= size
    return x


def _gate(x: np.ndarray) -> np.ndarray:
    """The same from 0 to 1, in place."""
    _soften(x)
    x *= 0.5
    x += 0.5
    return x


def _gate_slope(gate: np.ndarray) -> np.ndarray:
    return 0.5 * (1 - np.abs(2 * gate - 1)) ** 2


class BiGRU:
    """Weights: for each direction a row per byte (in), recurrent (rec) and bias of the three gates; a linear output."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.w = {}
        for d in _DIRECTIONS:
            self.w[f"{d}_in"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.w[f"{d}_rec"] = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
            self.w[f"{d}_bias"] = np.zeros(3 * hidden, np.float32)
        self.w["out"] = rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32)
        self.w["out_bias"] = np.zeros(len(languages), np.float32)

    def _run(self, d: str, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step: steps (time, windows) -> (time, windows, hidden); keep takes what backpropagation needs."""
        n = self.hidden
        enter = self.w[f"{d}_in"] + self.w[f"{d}_bias"]
        (update_in, update_rec), (reset_in, reset_rec), (new_in, new_rec) = (
            (np.ascontiguousarray(enter[:, k:k + n]), np.ascontiguousarray(self.w[f"{d}_rec"][:, k:k + n])) for k in (0, n, 2 * n))
        h = np.zeros((steps.shape[1], n), enter.dtype)
        out = np.empty((*steps.shape, n), enter.dtype)
        for t, byte in enumerate(steps):
            update, reset, past = h @ update_rec, h @ reset_rec, h @ new_rec
            update += update_in.take(byte, axis=0)
            reset += reset_in.take(byte, axis=0)
            _gate(update), _gate(reset)
            new = reset * past
            new += new_in.take(byte, axis=0)
            _soften(new)
            if keep is not None:
                keep.append((h, update, reset, past, new))
            # update * h + (1 - update) * new
            h = np.subtract(h, new, out=out[t])
            h *= update
            h += new
        return out

    def label(self, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probabilities (languages, time, windows) for uint8 windows (windows, time)."""
        steps = np.ascontiguousarray(windows.T)
        traces = {d: None if keep is None else [] for d in _DIRECTIONS}
        forth = self._run("forth", steps, traces["forth"])
        back = self._run("back", steps[::-1], traces["back"])[::-1]
        n, flat = self.hidden, (-1, self.hidden)
        p = np.ascontiguousarray((forth.reshape(flat) @ self.w["out"][:n]).T)
        p += (back.reshape(flat) @ self.w["out"][n:] + self.w["out_bias"]).T
        np.exp(np.clip(p, -60, 60, out=p), out=p)
        p /= p.sum(axis=0)
        if keep is not None:
            keep.update(traces, states={"forth": forth, "back": back}, steps=steps)
        return p.reshape(-1, *steps.shape)

    def gradients(self, windows: np.ndarray, languages: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all bytes and its gradient, by backpropagation through time."""
        keep: dict = {}
        p = np.moveaxis(self.label(windows, keep), 0, 2).copy()
        time, count, _ = p.shape
        rows = np.arange(count)
        loss = float(-np.log(p[:, rows, languages] + 1e-12).mean())
        d_logits = p
        d_logits[:, rows, languages] -= 1
        d_logits /= time * count
        n = self.hidden
        states = np.concatenate([keep["states"]["forth"], keep["states"]["back"]], axis=2)
        grads = {"out": np.einsum("tbh,tbl->hl", states, d_logits, optimize=True), "out_bias": d_logits.sum(axis=(0, 1))}
        d_states = d_logits @ self.w["out"].T
        for d, part in (("forth", d_states[:, :, :n]), ("back", d_states[::-1, :, n:])):
            steps = keep["steps"] if d == "forth" else keep["steps"][::-1]
            rec = self.w[f"{d}_rec"]
            d_in, d_rec, d_bias = np.zeros_like(self.w[f"{d}_in"]), np.zeros_like(rec), np.zeros_like(self.w[f"{d}_bias"])
            carried = np.zeros((count, n), np.float32)
            for t in range(time - 1, -1, -1):
                h, update, reset, past, new = keep[d][t]
                dh = part[t] + carried
                d_new = dh * (1 - update) * (1 - np.abs(new)) ** 2
                d_update = dh * (h - new) * _gate_slope(update)
                d_reset = d_new * past * _gate_slope(reset)
                d_past = d_new * reset
                d_rec[:, :n] += h.T @ d_update
                d_rec[:, n:2 * n] += h.T @ d_reset
                d_rec[:, 2 * n:] += h.T @ d_past
                d_x = np.concatenate([d_update, d_reset, d_new], axis=1)
                one_hot = np.zeros((256, count), np.float32)
                one_hot[steps[t], rows] = 1
                d_in += one_hot @ d_x
                d_bias += d_x.sum(axis=0)
                carried = dh * update + d_update @ rec[:, :n].T + d_reset @ rec[:, n:2 * n].T + d_past @ rec[:, 2 * n:].T
            grads |= {f"{d}_in": d_in, f"{d}_rec": d_rec, f"{d}_bias": d_bias}
        return loss, grads

    def train(self, windows: np.ndarray, languages: np.ndarray, epochs: int = EPOCHS, batch: int = 256, rate: float = 0.02,
              seed: int = 8) -> list[float]:
        """Adam over shuffled batches, languages weighted by drawing them equally often; the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(languages == k) for k in range(len(self.languages))]
        most = max(map(len, by))
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses, step = [], 0
        for epoch in range(epochs):
            order = rng.permutation(np.concatenate([rng.permutation(np.resize(b, most)) for b in by]))
            total, slower = [], rate * (1 - epoch / epochs) ** 0.5
            for at in range(0, len(order), batch):
                some = order[at:at + batch]
                loss, grads = self.gradients(windows[some], languages[some])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                step += 1
                for k, g in grads.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] -= (slower * first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
                total.append(loss)
            losses.append(float(np.mean(total)))
        return losses

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """Mean distribution over all bytes of each non-empty text."""
        out = np.zeros((len(texts), len(self.languages)))
        windows, owner, fresh = [], [], []

        def flush() -> None:
            p = self.label(np.stack(windows))
            # of each window the last bytes count, as many as are new
            p *= np.arange(WINDOW)[:, None] >= WINDOW - np.array(fresh)
            np.add.at(out, owner, p.sum(axis=1).T)
            windows.clear(), owner.clear(), fresh.clear()

        for i, raw in enumerate(texts):
            data = np.frombuffer(raw, np.uint8)
            if len(data) < WINDOW:
                data = np.concatenate([np.full(WINDOW - len(data), 32, np.uint8), data])
                starts, last = [], len(raw)
            else:
                starts, last = range(0, len(data) - WINDOW, WINDOW), (len(data) - 1) % WINDOW + 1
            for start in starts:
                windows.append(data[start:start + WINDOW])
                owner.append(i)
                fresh.append(WINDOW)
                if len(windows) == BATCH:
                    flush()
            windows.append(data[-WINDOW:])
            owner.append(i)
            fresh.append(last)
            if len(windows) >= BATCH:
                flush()
        if windows:
            flush()
        return out / np.array([max(1, len(t)) for t in texts])[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its probability; ``UNDETERMINED`` with 0 for a null text or one without a letter."""
        worth = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        p = self.pool([texts[i].encode() for i in worth])
        for i, k, q in zip(worth, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
            names[i], scores[i] = self.languages[k], min(1.0, q)
        return names, scores


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, windows_per_row: int = WINDOWS_PER_ROW,
        epochs: int = EPOCHS) -> BiGRU | None:
    """A network of the rows (doc_id, text, lang) with a language and a letter; None if there are none.

    At most ``rows_per_language`` rows of each language are learned from, and of each ``windows_per_row`` windows spread over
    the whole text: that bounds what reaches the driver.
    """
    tag = F.xxhash64("doc_id", "text", F.lit(21))
    ranked = docs.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")).select("doc_id", "text", "lang", tag.alias("tag"))
    order = Window.partitionBy("lang").orderBy("tag")
    # the rank is limited before the shuffle, so a hot language sends few rows; ids only, texts follow by a semi join
    few = ranked.select("lang", "tag").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows_per_language)
    sample = ranked.join(F.broadcast(few.select("lang", "tag")), ["lang", "tag"], "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, windows = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                raw = raw.rjust(WINDOW)
                for start in np.unique(np.linspace(0, len(raw) - WINDOW, windows_per_row).astype(int)).tolist():
                    langs.append(lang)
                    windows.append(raw[start:start + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], ["lang", "bytes"])

    rows = sample.select("lang", "text").mapInArrow(cut, "lang string, bytes binary").toPandas()
    if rows.empty:
        return None
    rows = rows.assign(bytes=rows["bytes"].map(bytes)).sort_values(["lang", "bytes"])
    languages = sorted(rows["lang"].unique())
    windows = np.stack([np.frombuffer(b, np.uint8) for b in rows["bytes"]])
    model = BiGRU(languages)
    model.train(windows, rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(), epochs)
    return model


def language(text: Column | str, model: BiGRU | None) -> Column:
    """struct<lang_pred, score> of each whole text."""

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        if model is None:
            return pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": [0.0] * len(texts)})
        names, scores = [], []
        for at in range(0, len(texts), 1024):
            found = model.predict(texts.iloc[at:at + 1024].tolist())
            names += found[0]
            scores += found[1]
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return of(text)


def held_out(doc_id: Column | str) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 5, is 0 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from rows with a language that are not held out.

    A null text, or one without a letter, is ``und`` with score 0; so is all when there is nothing to learn from. Repeated
    rows each get a row; an empty table gives no rows; other columns are left out.
    """
    model = fit(docs.where(~held_out("doc_id")), rows_per_language)
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), language("text", model).alias("l")) \
        .select("doc_id", "held_out", "l.*")
