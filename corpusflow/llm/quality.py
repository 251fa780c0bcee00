"""Quality rules: word and line statistics, and bands of zstandard ratios over whole documents and fixed chunks."""

from __future__ import annotations

from functools import cache
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bands of the ratio bytes / compressed bytes at zstandard level 3: (bytes from, least ratio, most ratio). The least ratio
#: is 1 to 3 percent below the least of all prose measured at that length (README, "Quality bands"); below are encoded data
#: and, the longer the text, random words and ids; above are lines or passages that repeat. The shorter a text, the less it
#: compresses, and below 128 bytes the frame outweighs it.
BANDS = [
    (0, 0.0, 9.0), (128, 0.95, 2.4), (192, 1.1, 2.4), (256, 1.18, 2.6), (384, 1.26, 2.6), (512, 1.36, 2.7), (768, 1.44, 2.7),
    (1_024, 1.5, 2.9), (1_536, 1.65, 2.9), (2_048, 1.74, 3.1), (3_072, 1.86, 3.1), (4_096, 1.9, 3.4), (6_144, 1.97, 3.4),
    (8_192, 2.08, 3.8), (12_288, 2.15, 3.8), (16_384, 2.21, 4.2), (32_768, 2.26, 4.2), (65_536, 2.37, 4.6),
]
LEVEL = 3
#: Bytes of a chunk, and the share of outlying chunks (by the band of their own length) that rejects a text.
CHUNK_BYTES = 4_096
CHUNK_SHARE = 0.5
#: Fixed rules: fewest words, and most words of repeated windows in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"

STATISTICS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, "
              "n_chunks long, n_repetitive_chunks long, n_random_chunks long, base_failed boolean, kept boolean")


@cache
def _compressor(level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level)


def _band(n: int) -> tuple[float, float]:
    low, high = BANDS[0][1:]
    for start, a, b in BANDS:
        if n >= start:
            low, high = a, b
    return low, high


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a window of three found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n:
        return 0
    first, again = set(), set()
    for w in windows:
        (again if w in first else first).add(w)
    hit = np.fromiter(map(again.__contains__, windows), dtype=bool, count=n)
    covered = np.zeros(n + 2, dtype=bool)
    for shift in range(3):
        covered[shift:shift + n] |= hit
    return int(covered.sum())


def _measure(text: str | None) -> tuple:
    raw = (text or "").encode()
    words = raw.split()  # of bytes: the six ASCII spaces only
    n_words = len(words)
    word_chars = len(text or "") - (len(raw) - len(raw.translate(None, _SPACE)))
    n_symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = raw.split(b"\n")
    worded = list(compress(lines, map(bytes.strip, lines)))
    n_dup = len(worded) - len(set(worded))
    n_repeat = _repeated(words)
    squeeze = _compressor(LEVEL).compress
    ratio = len(raw) / len(squeeze(raw)) if raw else 0.0
    low, high = _band(len(raw))
    outlying = bool(raw) and not low <= ratio <= high
    chunks = [raw[i:i + CHUNK_BYTES] for i in range(0, len(raw), CHUNK_BYTES)] if len(raw) > CHUNK_BYTES else []
    repetitive = random = 0
    for chunk in chunks:
        a, b = _band(len(chunk))
        r = len(chunk) / len(squeeze(chunk))
        repetitive += r > b
        random += r < a
    base_failed = n_words < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED * n_words
    kept = not base_failed and not outlying and not (chunks and repetitive + random > CHUNK_SHARE * len(chunks))
    return (n_words, word_chars, n_symbols, n_dup, n_repeat, ratio, len(chunks), repetitive, random, base_failed, kept)


def statistics(text: Column | str) -> Column:
    """Struct of ``STATISTICS`` for each whole text; a null or empty text has no words and is rejected."""

    @F.pandas_udf(STATISTICS)
    def measured(texts: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in STATISTICS.split(", ")]
        return pd.DataFrame([_measure(t) for t in texts], columns=names)

    return measured(text)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and ``STATISTICS``; a row per input row, repeated rows and null ids included, other columns left out."""
    return docs.select("doc_id", statistics("text").alias("s")).select("doc_id", "s.*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, whose text passes the rules; an empty table stays empty."""
    return docs.where(statistics("text")["kept"])
