"""Text expressions: words, n-grams, letters, scripts, folding, cleaning, truncation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_BREAK = r"[^\p{L}\p{M}]+"

# N-gram sizes, longest word feature, script code-point ranges.
MIN_N = 1
MAX_N = 4
MAX_WORD_FEATURE = 14
SCRIPT_RANGES = {
    "cyrillic": r"\x{0400}-\x{052F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}",
    "greek": r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}",
    "georgian": r"\x{10A0}-\x{10FF}\x{2D00}-\x{2D2F}",
    "armenian": r"\x{0530}-\x{058F}",
    "latin": r"\x{0000}-\x{024F}\x{1E00}-\x{1EFF}",
}


def letters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}]+", "")


def letter_count(text: Column) -> Column:
    """TF2: number of letters."""
    return F.length(letters(text))


def has_letters(text: Column, least: int) -> Column:
    """Whether the text has so many letters, without a look at what follows them."""
    return text.rlike(r"^" + r"[^\p{L}]*+\p{L}" * least)


def script_counts(text: Column) -> dict[str, Column]:
    """TF3: letters per script; ``other`` is what no range covers."""
    only = letters(text)
    counts = {name: F.length(F.regexp_replace(only, f"[^{span}]+", "")) for name, span in SCRIPT_RANGES.items()}
    known = counts["latin"]
    for name in ("cyrillic", "greek", "georgian", "armenian"):
        known = known + counts[name]
    counts["other"] = F.length(only) - known
    return counts


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def nfc(text: Column) -> Column:
    """Composed form. Only texts with marks or singleton code points travel to Python."""
    needs = text.rlike(r"[\p{M}\x{1100}-\x{11FF}\x{2126}\x{212A}\x{212B}\x{F900}-\x{FAFF}]")
    return F.coalesce(_nfc(F.when(needs, text)), text)


def word_counts(df: DataFrame, keys: list[str], text: str, weight: Column | None = None) -> DataFrame:
    """(keys, word, n): the shuffle carries words, not n-grams; partial sums run map-side."""
    exploded = df.select(*keys, (weight if weight is not None else F.lit(1)).alias("_w"),
                         F.explode(F.split(F.lower(F.col(text)), WORD_BREAK)).alias("word")).filter("word <> ''")
    return exploded.groupBy(*keys, "word").agg(F.sum("_w").alias("n"))


def word_ngrams(word: Column) -> Column:
    """Features of one word: ``w:word`` if short enough and all 1-4-grams of the padded word."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))

    def of_size(n: int) -> Column:
        last = F.length(padded) - n + 1
        grams = F.transform(F.sequence(F.lit(1), last), lambda i: padded.substr(i, F.lit(n)))
        return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))

    whole = F.when(F.length(word) <= MAX_WORD_FEATURE, F.array(F.concat(F.lit("w:"), word))) \
        .otherwise(F.array().cast("array<string>"))
    return F.concat(whole, *[of_size(n) for n in range(MIN_N, MAX_N + 1)])


def word_features(word: str) -> list[str]:
    """The same features of one word in Python; the word feature stands first."""
    word = unicodedata.normalize("NFC", word)
    padded = f" {word} "
    whole = [f"w:{word}"] if len(word) <= MAX_WORD_FEATURE else []
    return whole + [padded[i:i + n] for n in range(MIN_N, MAX_N + 1) for i in range(len(padded) - n + 1)]


def _fold_pairs() -> tuple[str, str]:
    """Accented lower-case letter -> base letter, derived from the Unicode decompositions."""
    source, target = [], []
    for code in list(range(0xC0, 0x250)) + list(range(0x1E00, 0x1F00)) + list(range(0x386, 0x3CF)) \
            + list(range(0x400, 0x460)):
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if char == char.lower() and len(base) == 1 and base != char:
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _fold_pairs()


def fold(text: Column) -> Column:
    """Lower case, diacritics removed, sharp s written as ss."""
    plain = F.regexp_replace(F.translate(F.lower(text), FOLD_FROM, FOLD_TO), r"\p{Mn}", "")
    return F.replace(plain, F.lit("ß"), F.lit("ss"))


def clean(text: Column) -> Column:
    """EX6 after entity decoding: at most two line ends in a row, blanks collapsed, trimmed."""
    lines = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(lines, r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}&&[^\n]]+", " "))


def strip(text: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.regexp_replace(text, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def _last_period(text: Column) -> Column:
    """0-based index of the last period, -1 without one."""
    back = F.locate(".", F.reverse(text))
    return F.when(back == 0, F.lit(-1)).otherwise(F.length(text) - back)


def truncate_sentence(text: Column, limit: int = 15000, keep: int = 12000) -> Column:
    """EX8: cut at ``limit``, then back to the last period if its index is above ``keep``."""
    cut = F.substring(text, 1, limit)
    last = _last_period(cut)
    return F.when(F.length(text) <= limit, text) \
        .when(last > keep, cut.substr(F.lit(1), last + 1)).otherwise(cut)


def truncate_for_embedding(text: Column, limit: int = 20000) -> Column:
    """EX8, embedding form: back to a period above 80 %, else mark the cut with dots."""
    cut = F.substring(text, 1, limit)
    last = _last_period(cut)
    return F.when(F.length(text) <= limit, text) \
        .when(last > limit * 0.8, cut.substr(F.lit(1), last + 1)).otherwise(F.concat(cut, F.lit("...")))


def any_substring(text: Column, markers: list[str]) -> Column:
    """True if the text contains one of the markers (plain substrings)."""
    if not markers:
        return F.lit(False)
    return F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(text, m))
