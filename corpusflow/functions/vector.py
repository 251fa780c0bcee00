"""Vector expressions and the blocked top-k kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores that are held at once, and hits that a task hands on together.
CELLS, HITS = 1 << 20, 100_000
SCORE_DIGITS = 9  # scores are rounded so that equal vectors tie whatever block they sit in


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns in double precision (null for a zero vector)."""
    size = norm(a) * norm(b)
    return F.when(size != 0, dot(a, b) / size)


def unit_matrix(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(row-normalised matrix, mask of usable rows); null and zero vectors are unusable."""
    if not len(column):
        return np.zeros((0, 0)), np.zeros(0, dtype=bool)
    present = column.notna().to_numpy()
    widths = column[present].map(len).unique()
    if len(widths) > 1:
        raise ValueError(f"vectors of different sizes: {sorted(widths.tolist())}")
    width = int(widths[0]) if len(widths) else 0
    matrix = np.zeros((len(column), width))
    if present.any():
        matrix[present] = np.stack(column[present].to_numpy()).astype(np.float64)
    length = np.sqrt((matrix * matrix).sum(axis=1))
    usable = present & (length > 0)
    matrix[usable] /= length[usable, None]
    return matrix, usable


def unit_arrow(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``unit_matrix`` of an Arrow column of lists, without an object for each row."""
    present = column.is_valid().to_numpy()
    if not present.any():
        return np.zeros((len(column), 0)), present
    lists = column.drop_null().combine_chunks()
    widths = pc.unique(pc.list_value_length(lists)).to_pylist()
    if len(widths) > 1:
        raise ValueError(f"vectors of different sizes: {sorted(widths)}")
    matrix = np.zeros((len(column), widths[0]))
    matrix[present] = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, widths[0])
    length = np.sqrt((matrix * matrix).sum(axis=1))
    usable = present & (length > 0)
    matrix[usable] /= length[usable, None]
    return matrix, usable


def plain_ids(column: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers as such, other ids and columns with nulls as objects."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    out = np.empty(len(column), dtype=object)
    out[:] = column.to_pylist()
    return out


def margin(width: int) -> float:
    """More than a 32-bit product of unit vectors and a rounded score can lie apart."""
    return (width + 8) * 1.2e-7 + 2 * 10.0 ** -SCORE_DIGITS


def _reached(scores: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the scores at or above the bound of their row."""
    keep = scores >= bound[:, None]
    flat = keep.reshape(-1)
    if flat.size % 8 == 0:  # few are: eight are looked at together
        words = np.flatnonzero(flat.view(np.uint64))
        inner, at = np.nonzero(flat.reshape(-1, 8)[words])
        flat = words[inner] * 8 + at
    else:
        flat = np.flatnonzero(flat)
    return np.divmod(flat, scores.shape[1])


def _exact(a: np.ndarray, rows: np.ndarray, b: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Rounded products of pairs of rows in double precision, some at a time."""
    out = np.empty(len(rows))
    step = max(1, CELLS // max(1, a.shape[1]))
    for at in range(0, len(rows), step):
        out[at:at + step] = np.einsum("ij,ij->i", a[rows[at:at + step]], b[cols[at:at + step]])
    return np.round(out, SCORE_DIGITS)


def _sortable(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of the ids, null first."""
    return pd.factorize(ids, sort=True)[0] if ids.dtype == object else ids


def _first(k: int, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the k best of each (row, keys), place of each); ties go to the smaller id."""
    order = np.lexsort((_sortable(ids), -scores, *reversed(keys), rows))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([np.diff(c[order]) != 0 for c in (rows, *keys)], axis=0)
    starts = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < k], place[place < k]


def _best(k: int, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the k best of each of n rows, k-th best score of each row or -inf); ties go to the smaller id. Sorts ties only."""
    order = np.argsort(rows.astype(np.int16) if n < 1 << 15 else rows, kind="stable")
    counts = np.bincount(rows, minlength=n)
    most = int(counts.max(initial=0))
    if most < k:
        return order, np.full(n, -np.inf)
    of, ranked = rows[order], scores[order]
    table = np.full((n, most), -np.inf)
    table[of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)] = ranked
    kth = np.partition(table, most - k, axis=1)[:, most - k]
    keep = ranked >= kth[of]
    tied = np.bincount(of[keep], minlength=n) > k
    if tied.any():
        some = np.flatnonzero(keep & tied[of])
        keep[some] = False
        keep[some[_first(k, of[some], ranked[some], ids[order[some]])[0]]] = True
    return order[keep], kth


def _once(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions of the best score of each (row, id)."""
    codes = pd.factorize(ids)[0] if ids.dtype == object else ids
    order = np.lexsort((-scores, codes, rows))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(rows[order]) != 0) | (np.diff(codes[order]) != 0)
    return order[new]


def topk_search(k: int, floor: float, mode: str, groups_of=None, distinct: bool = False):
    """``prepare`` for ``sliced_product``.

    big has (chunk_id, grp, embedding), small has (query_id, grp, embedding).
    mode "own": a query meets chunks of its own group; "each": best k of every group;
    "all": best k over all groups. ``groups_of`` may tell, for the small side, the rows that ask for each group; the best k
    chunks of a row then count over all its groups, and with ``distinct`` a chunk that a group holds twice counts once. If it has
    ``table_of``, the groups of one such table hold no chunk twice, and what a row has found in them bounds what it looks for.

    Pairs are scored in 32 bits first; those that can be among the best, by what the task has found before, are scored in double precision.
    """

    def prepare(small: pd.DataFrame):
        vectors, usable = unit_matrix(small["embedding"])
        places = np.flatnonzero(usable)
        if groups_of:
            asked_of = groups_of(small)
        elif mode == "own":
            asked_of = {g: places[i] for g, i in small.iloc[places].groupby("grp").indices.items()}
        else:
            asked_of = {None: places}
        query_ids, short = small["query_id"].to_numpy(), vectors.astype(np.float32)
        slack = margin(vectors.shape[1])
        least = max(floor, -2.0) - slack
        # the k-th best score of a row so far less the slack; a row of "each" has another one in every group
        bounds = np.full(len(vectors), least, np.float32)
        table_of, best_of = getattr(asked_of, "table_of", None), {}

        def raised(best: np.ndarray, at: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
            """Take scores, at most k of a row and in order of the rows, into the k best of the rows of a table."""
            counts = np.bincount(rows, minlength=len(at))
            new = np.full((len(at), k), -np.inf, np.float32)
            new[rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)] = scores
            some = np.flatnonzero(counts)
            both = np.partition(np.concatenate([best[at[some]], new[some]], axis=1), k, axis=1)[:, k:]
            best[at[some]] = both
            bounds[at[some]] = np.maximum(bounds[at[some]], both.min(axis=1) - np.float32(slack))

        def search(big: pd.DataFrame) -> Iterator[pd.DataFrame]:
            chunks, chunk_ok = unit_matrix(big["embedding"])
            big, chunks = big[chunk_ok], chunks[chunk_ok]
            ids, groups = big["chunk_id"].to_numpy(), big["grp"].to_numpy()
            members_of = {None: np.arange(len(big))} if mode == "all" else big.groupby("grp").indices
            out: list[tuple] = []
            waiting = 0

            def column(at: int, like: pd.Series) -> pd.Series:
                return pd.Series(np.concatenate([part[at] for part in out]) if out else [], dtype=like.dtype)

            def hits() -> pd.DataFrame:
                return pd.DataFrame({"query_id": column(0, small["query_id"]), "chunk_id": column(1, big["chunk_id"]), "grp": column(2, big["grp"]),
                                     "score": np.concatenate([part[3] for part in out]) if out else np.zeros(0)})

            for group, members in members_of.items():
                asked = asked_of.get(group if mode == "own" else None)
                if asked is None or not len(members):
                    continue
                part, names = chunks[members], ids[members]
                part_short = part.astype(np.float32)
                bound = np.full(len(vectors), least, np.float32) if mode == "each" else bounds
                # a chunk that comes twice may not stand for two of the best k distinct ones
                raises = not groups_of or len(pd.unique(names)) == len(names)
                step = max(1, min(1024, CELLS // len(members)))
                for start in range(0, len(asked), step):
                    block = asked[start:start + step]
                    if vectors.shape[1] != part.shape[1]:
                        raise ValueError(f"vectors of different sizes: {vectors.shape[1]} and {part.shape[1]}")
                    scores = short[block] @ part_short.T
                    if part.shape[0] > 4 * k and not groups_of:
                        kth = np.partition(scores, part.shape[0] - k, axis=1)[:, part.shape[0] - k]
                        bound[block] = np.maximum(bound[block], kth - np.float32(2 * slack))
                    rows, cols = _reached(scores, bound[block])
                    exact = _exact(vectors, block[rows], part, cols)
                    keep = exact >= max(floor, -2.0)
                    rows, cols, exact = rows[keep], cols[keep], exact[keep]
                    if distinct and not raises:
                        once = _once(rows, exact, names[cols])
                        rows, cols, exact = rows[once], cols[once], exact[once]
                    if table_of is not None and len(rows):
                        kept, _ = _best(k, rows, exact, names[cols], len(block))
                        rows, cols, exact = rows[kept], cols[kept], exact[kept]
                        raised(best_of.setdefault(table_of(group), np.full((len(vectors), k), -np.inf, np.float32)), block, rows, exact)
                    elif len(rows) > k:
                        kept, kth = _best(k, rows, exact, names[cols], len(block))
                        rows, cols, exact = rows[kept], cols[kept], exact[kept]
                        if raises or distinct:
                            bound[block] = np.maximum(bound[block], (kth - slack).astype(np.float32))
                    out.append((query_ids[block[rows]], names[cols], groups[members][cols], exact))
                    waiting += len(rows)
                    if waiting >= HITS:
                        yield hits()
                        out.clear()
                        waiting = 0
            if out:
                yield hits()

        return search

    return prepare


class StreamedBest:
    """The best chunks of a block of queries, while all chunks pass by: ``add`` takes some, ``finish`` gives what is left.

    With ``each`` the chunks come in order of their groups and the best k of every group count; a group is given out when
    the next one begins. ``distinct`` counts chunks of one id once. With ``lists`` (bitmaps of the queries) a chunk counts for the queries
    that have the bit of its group. Memory: the block, its k best chunks of one group, and a tile of scores.
    """

    TILE = 512

    def __init__(self, vectors: np.ndarray, usable: np.ndarray, k: int, floor: float, each: bool = False, distinct: bool = False, lists: np.ndarray | None = None):
        self.places = np.flatnonzero(usable)
        self.exact, self.k, self.floor, self.each, self.distinct = vectors[self.places], k, max(floor, -2.0), each, distinct
        self.short = self.exact.astype(np.float32)
        self.lists = None if lists is None else lists[self.places]
        self.slack = margin(vectors.shape[1])
        self.tiles = [slice(at, at + self.TILE) for at in range(0, len(self.places), self.TILE)]
        self.bound = np.full(len(self.places), self.floor - self.slack, np.float32)
        self.found: list[list[tuple]] = [[] for _ in self.tiles]
        self.waiting, self.kept = [0] * len(self.tiles), [0] * len(self.tiles)
        self.group, self.number = None, 0
        self.seen = 0

    def add(self, ids: np.ndarray, groups: np.ndarray, chunks: np.ndarray, bits: np.ndarray | None = None) -> Iterator[tuple]:
        """Take chunks; yields (places of queries, ids, groups, scores) of groups that have ended."""
        if not len(ids) or not len(self.places):
            return
        if chunks.shape[1] != self.exact.shape[1]:
            raise ValueError(f"vectors of different sizes: {self.exact.shape[1]} and {chunks.shape[1]}")
        if not self.each:
            yield from self._columns(ids, groups, np.zeros(len(ids), np.int64), chunks, bits, True)
            return
        new = np.append(True, groups[1:] != groups[:-1])
        new[0] = self.group is None or groups[0] != self.group
        numbers = self.number + np.cumsum(new)
        starts = np.unique(np.append(0, np.flatnonzero(new)))
        ends = np.append(starts[1:], len(ids))
        at = 0
        while at < len(starts):
            to = at + 1
            goes_on = numbers[starts[at]] == self.number
            # small groups pass together, without a bound of their own; the first and the last may have chunks elsewhere
            while not goes_on and to < len(starts) - 1 and ends[to] - starts[at] <= 256:
                to += 1
            cut = slice(starts[at], ends[to - 1])
            if not goes_on:
                yield from self._end()
            alone = to == at + 1
            yield from self._columns(ids[cut], groups[cut], numbers[cut], chunks[cut], None, alone)
            self.group, self.number = groups[cut.stop - 1], int(numbers[cut.stop - 1])
            if not alone:
                yield from self._end()
            at = to

    def _columns(self, ids, groups, numbers, chunks, bits, bounded: bool) -> Iterator[tuple]:
        short = chunks.astype(np.float32)
        at = 0
        while at < len(ids):
            # the first chunks have no bound to meet but the least score
            cols = slice(at, at + max(128, min(CELLS // self.TILE, self.seen)))
            width = len(ids[cols])
            for t, tile in enumerate(self.tiles):
                rows, col = _reached(self.short[tile] @ short[cols].T, self.bound[tile])
                if not len(rows):
                    continue
                rows, col = rows + tile.start, col + at
                if self.lists is not None:
                    asked = (self.lists[rows, bits[col] >> 3] & (128 >> (bits[col] & 7))) > 0
                    rows, col = rows[asked], col[asked]
                exact = _exact(self.exact, rows, chunks, col)
                good = exact >= self.floor
                rows, col, exact = rows[good], col[good], exact[good]
                self.found[t].append((rows, ids[col], groups[col], numbers[col], exact))
                self.waiting[t] += len(rows)
                if self.waiting[t] > max(4096, self.kept[t]):
                    self._reduce(t, bounded)
            self.seen += width
            at += width
        return
        yield

    def _reduce(self, t: int, bounded: bool) -> None:
        rows, ids, groups, numbers, scores = (np.concatenate(c) for c in zip(*self.found[t]))
        if self.distinct:
            once = _once(rows, scores, ids)
            rows, ids, groups, numbers, scores = (c[once] for c in (rows, ids, groups, numbers, scores))
        if len(numbers) and numbers.min() != numbers.max():
            kept, _ = _first(self.k, rows, scores, ids, numbers)
        else:
            tile = self.tiles[t]
            kept, kth = _best(self.k, rows - tile.start, scores, ids, len(self.bound[tile]))
            if bounded:
                self.bound[tile] = np.maximum(self.bound[tile], (kth - self.slack).astype(np.float32))
        self.found[t], self.waiting[t], self.kept[t] = [tuple(c[kept] for c in (rows, ids, groups, numbers, scores))], 0, len(kept)

    def _end(self) -> Iterator[tuple]:
        for t in range(len(self.tiles)):
            if self.found[t]:
                self._reduce(t, False)
                rows, ids, groups, _, scores = self.found[t][0]
                self.found[t], self.kept[t] = [], 0
                yield self.places[rows], ids, groups, scores
        self.bound[:] = self.floor - self.slack
        self.seen = 0

    def finish(self) -> Iterator[tuple]:
        yield from self._end()


def topk_stream(k: int, floor: float, each: bool = False, per_group: int | None = None, distinct: bool = False, bit_of=None):
    """``prepare`` for ``streamed_product``; columns and modes as in ``topk_search``.

    ``each``: big comes ordered by grp. ``per_group``: of the k best of a query only so many of each group are given out, with their
    place. ``bit_of`` gives the bits of groups in the bitmaps ``lists`` of the small side.
    """

    class Stream:
        def __init__(self, tables: list[pa.Table]):
            asked = pa.concat_tables(tables)
            vectors, usable = unit_arrow(asked["embedding"])
            self.ids = asked["query_id"].combine_chunks()
            bits = None
            if bit_of is not None:
                bits = np.frombuffer(b"".join(asked["lists"].to_pylist()), np.uint8).reshape(len(asked), -1)
            self.best = StreamedBest(vectors, usable, k, floor, each, distinct, bits)
            self.codes: dict = {}
            self.groups: list = []

        def add(self, big: pa.Table) -> Iterator[pa.RecordBatch]:
            chunks, usable = unit_arrow(big["embedding"])
            if each:
                usable = usable & big["grp"].is_valid().to_numpy()
            kept = np.flatnonzero(usable)
            if not len(kept):
                return
            self.kinds = big["chunk_id"].type, big["grp"].type
            ids, named = plain_ids(big["chunk_id"])[kept], pc.dictionary_encode(big["grp"].combine_chunks(), null_encoding="encode")
            values = named.dictionary.to_pylist()
            for value in values:
                if value not in self.codes:
                    self.codes[value] = len(self.groups)
                    self.groups.append(value)
            groups = np.array([self.codes[v] for v in values], np.int64)[named.indices.to_numpy(zero_copy_only=False)[kept]]
            bits = None
            if bit_of is not None:
                bits = np.array([bit_of(v) for v in values], np.int64)[named.indices.to_numpy(zero_copy_only=False)[kept]]
            for found in self.best.add(ids, groups, chunks[kept], bits):
                yield from self._out(*found)

        def finish(self) -> Iterator[pa.RecordBatch]:
            for found in self.best.finish():
                yield from self._out(*found)

        def _out(self, rows, ids, groups, scores) -> Iterator[pa.RecordBatch]:
            if per_group is not None:
                kept, place = _first(per_group, rows, scores, ids, groups)
            else:
                kept, place = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for at in range(0, len(kept), HITS):
                part = kept[at:at + HITS]
                names, at_group = np.unique(groups[part], return_inverse=True)
                of_group = pa.array([self.groups[g] for g in names.tolist()], self.kinds[1]).take(pa.array(at_group))
                yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(rows[part])), pa.array(ids[part], self.kinds[0]), of_group,
                                                  pa.array(scores[part]), pa.array((place[at:at + HITS] + 1).astype(np.int32))],
                                                 ["query_id", "chunk_id", "grp", "score", "rn"])

    return Stream


def best_hits(k: int, keys: list[str]):
    """``merge`` for ``sliced_product``: the k best hits of each query, or query and group; ties go to the smaller id."""

    def merge(hits: pd.DataFrame) -> pd.DataFrame:
        return hits.sort_values(["score", "chunk_id"], ascending=[False, True], kind="stable").groupby(keys, sort=False, dropna=False).head(k)

    return merge
