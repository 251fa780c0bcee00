"""Token ids of whole texts, assembled from segments cut at safe boundaries.

A text may be cut before a space that a non-space follows, and on both sides of a line feed between non-spaces: no pre-token
of the vocabularies used here spans such a place, and what stands on one side never changes the split of the other. So the
ids of a text are the ids of its segments, and a worker needs to encode a segment that it has seen only once. The segments
are whole; long texts need no other treatment.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
import string
from collections.abc import Callable, Iterable, Iterator
from functools import cache, lru_cache
from itertools import islice
from operator import add

import numpy as np

#: Bytes that the segments of a generation take in a worker, about; two generations are kept. Those that begin a line, far
#: fewer, get half of it.
CACHED_BYTES = 64 << 20
#: What a remembered segment takes besides its letters and ids, and the most letters that one may have.
ENTRY_BYTES, REMEMBERED_CHARS = 180, 64
#: Letters of texts whose segments are looked up at once, about; few enough that they stay near the processor.
LETTERS_AT_ONCE = 1 << 15

# Python's white space holds that of the vocabularies, so each cut is safe for them.
_CUT = re.compile(r" (?=\S)")
# Longer segments are also cut between punctuation and a letter of a script that every Unicode version knows as letters: these
# stand in different pre-tokens, and no such letter composes with a mark before it.
_INNER = re.compile(r"(?<=[,.;:!?)\]}…、。，！？；：])(?=[A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-Ωα-ωА-яぁ-ゖァ-ヺ一-龥가-힣])")
_PUNCTUATION = string.punctuation
# Fixed rule: byte-level vocabularies spell bytes that do not print as letters from U+0100 on, in order.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_UNPRINTED = [b for b in range(256) if b not in _PRINTED]
_BYTE_LETTERS = "".join(chr(b if b in _PRINTED else 256 + _UNPRINTED.index(b)) for b in range(256))


def byte_of_letter(letter: str) -> int:
    """The byte that a letter of a byte-level vocabulary stands for."""
    return _BYTE_LETTERS.index(letter)


def four_bytes(n: int) -> list[bytes]:
    """Each id below n as a little-endian unsigned 32-bit integer."""
    return [i.to_bytes(4, "little") for i in range(n)]


def _spelled(text: str) -> str:
    """The text as a byte-level vocabulary spells its bytes."""
    return codecs.charmap_decode(text.encode(), "strict", _BYTE_LETTERS)[0]


#: Ids of a segment behind ``before``; the third may be asked for those of another segment behind it (None: not remembered).
Encode = Callable[[str, str, Callable[[str], bytes | None]], bytes]


class _Generation(dict):
    """Ids by segment; ``find`` gives those of a segment that is not there, and may put it in."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find = find

    def __missing__(self, segment: str) -> bytes:
        return self.find(segment)


class Remembered:
    """Ids of segments with ``before`` in front; what was not asked for during a whole generation is forgotten.

    A generation ends when its entries take ``cached`` bytes. Long segments, such as texts without spaces, are put together
    from parts (``inner`` remembers those behind the first) and forgotten at once.
    """

    def __init__(self, encode: Encode, before: str, cached: int, inner: Remembered | None = None,
                 cut: re.Pattern[str] | None = _INNER):
        self.encode, self.before, self.cached, self.inner, self.cut = encode, before, cached, inner or self, cut
        self.now: dict[str, bytes] = _Generation(self._find)
        self.past: dict[str, bytes] = {}
        self.passing: dict[str, bytes] = {}
        self.held = 0

    def of(self, rows: list[list[str]], first: int, last: int | None) -> list[bytes]:
        """Ids of the segments first to last of each row, one after the other."""
        if self.held > self.cached:
            self.now, self.past, self.held = _Generation(self._find), dict(self.now), 0
        ids = self.now.__getitem__
        out = [b"".join(map(ids, islice(row, first, last))) for row in rows]
        self.passing.clear()
        return out

    def _find(self, segment: str) -> bytes:
        if len(segment) > REMEMBERED_CHARS:
            if segment not in self.passing:
                self.passing[segment] = self._long(segment)
            return self.passing[segment]
        ids = self.past.get(segment)
        if ids is None:
            ids = self.encode(self.before, segment, self._known)
        self.held += 2 * len(segment) + len(ids) + ENTRY_BYTES
        self.now[segment] = ids
        return ids

    def _long(self, segment: str) -> bytes:
        start, *rest = self.cut.split(segment) if self.cut else [segment]
        return self.encode(self.before, start, self._known) + b"".join(map(self.inner.part, rest))

    def part(self, part: str) -> bytes:
        return self.now[part] if len(part) <= REMEMBERED_CHARS else self.encode(self.before, part, self._known)

    def _known(self, segment: str) -> bytes | None:
        return self.now.get(segment) or self.past.get(segment)


class SegmentEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers; ``encode`` does the work for new segments."""

    def __init__(self, encode: Encode, cached: int = CACHED_BYTES):
        self.line = encode("", "\n", lambda segment: None)
        self.heads = Remembered(encode, "", cached // 2)
        self.rest = Remembered(encode, " ", cached, self.heads)

    def __call__(self, texts: Iterable[str | None]) -> list[bytes]:
        return [ids for some in bounded(texts, LETTERS_AT_ONCE) for ids in self._ids(some)]

    def _ids(self, texts: list[str | None]) -> list[bytes]:
        lines = [list(_lines(t)) if t else [] for t in texts]
        # where single spaces are all the white space there is, the plain split makes the same cuts
        split = [x.split(" ") if x.isprintable() and "  " not in x else _CUT.split(x) for some in lines for x in some]
        done = map(add, self.heads.of(split, 0, 1), self.rest.of(split, 1, None))
        return [self.line.join(islice(done, len(some))) for some in lines]


def bounded(texts: Iterable[str | None], letters: int) -> Iterator[list[str | None]]:
    """The texts in order, in lists that end with the text that brings them to so many letters."""
    some, held = [], 0
    for text in texts:
        some.append(text)
        held += len(text or "")
        if held >= letters:
            yield some
            some, held = [], 0
    if some:
        yield some


def _lines(text: str) -> Iterator[str]:
    """The text between the line feeds that have a non-space on both sides."""
    held = None
    for line in text.split("\n"):
        if held is not None and (not line or line[0].isspace() or not held or held[-1].isspace()):
            held += "\n" + line
            continue
        if held is not None:
            yield held
        held = line
    yield held


def byte_encoder(path: str) -> SegmentEncoder:
    """Byte-level vocabulary of the tokenizers library, a space before a word being part of it."""
    return SegmentEncoder(_library(path, str, True))


def word_encoder(path: str) -> SegmentEncoder:
    """Vocabulary with word ends, lower case, white space dropped."""
    return SegmentEncoder(_library(path, str.lower, False))


def _library(path: str, fold: Callable[[str], str], keeps_space: bool) -> Encode:
    """Most new segments are letters with or without punctuation behind: two pre-tokens at once. The letters, if they are not
    remembered without it, go straight to the library's model, spelled in byte letters; all other segments go through the whole
    tokenizer."""
    # Spark runs a worker for each core; threads of the library would take the others' time
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True  # strings of special tokens in a text are ordinary text
    tokenize = whole.model.tokenize
    packed = four_bytes(max(whole.get_vocab(with_added_tokens=True).values()) + 1)
    front = {before: _spelled(before) if keeps_space else "" for before in ("", " ")}

    def plain(text: str) -> bytes:
        return np.array(whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    tail_ids = lru_cache(1 << 12)(plain)

    def encode(before: str, segment: str, known: Callable[[str], bytes | None]) -> bytes:
        stem = segment if segment.isalpha() else segment.rstrip(_PUNCTUATION)
        letters = fold(stem)
        if not letters.isalpha():
            return plain(before + segment)
        if not (ascii := letters.isascii()) and max(letters) >= "\u0250":
            # Latin letters only: alike in every Unicode version, and composed already
            return plain(before + segment)
        tail = segment[len(stem):]
        ids = known(stem) if tail else None
        if not ids:
            ids = b"".join([packed[t.id] for t in tokenize(front[before] + (letters if ascii else _spelled(letters)))])
        return ids + tail_ids(tail) if tail else ids

    return encode


def rank_encoder(path: str, pattern: str) -> SegmentEncoder:
    """Vocabulary in a local rank file, by the tiktoken library."""
    encoding = rank_encoding(path, pattern)
    return SegmentEncoder(lambda before, segment, known: np.array(encoding.encode_ordinary(before + segment), dtype="<u4").tobytes())


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def rank_encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


# One encoder per worker and vocabulary.
@cache
def byte_encoder_of(path: str) -> SegmentEncoder:
    return byte_encoder(path)


@cache
def word_encoder_of(path: str) -> SegmentEncoder:
    return word_encoder(path)


@cache
def rank_encoder_of(path: str, pattern: str) -> SegmentEncoder:
    return rank_encoder(path, pattern)
