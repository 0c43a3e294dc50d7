"""Exact cosine search of a block of stated queries in one streaming pass over vectors.

Scores are left folds in double precision, rounded to 6 places. A product of
matrices in single precision only says which pairs can be among the best: its
error has a bound, and every pair within that bound of a query's k-th best is
scored again by the fold, so the result does not depend on the product's bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and queries of one product, pairs that are scored again at once, rows of one batch that is sent back.
ROWS, QUERIES, PAIRS, SENT = 1024, 512, 1 << 15, 1 << 16
#: Kinds of an id in the order of their ranking: null, a value, no row at all.
NULL, VALUE, EMPTY = 0, 1, 2
SLACK = 1e-12


def fold(values: np.ndarray) -> np.ndarray:
    """Sums of rows from left to right, as ``numeric.fold_sum`` makes them."""
    return np.cumsum(values, axis=1)[:, -1] + 0.0


def micro(score: np.ndarray) -> np.ndarray:
    """Scores in whole millionths as Spark's round gives them: halves of the shortest decimal go away from zero."""
    y = np.abs(score) * 1e6
    whole = np.floor(y)
    up = y - whole >= 0.5
    for k in np.flatnonzero(np.abs(y - whole - 0.5) < 1e-6).tolist():
        up[k] = Decimal(repr(float(abs(score[k])))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP) > whole[k]
    return np.copysign(whole + up, score)


def by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) for each number of dimensions; vectors that ``numeric.unit_vector`` has no value for are left out."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths[lengths > 0]).tolist():
        places = np.flatnonzero(lengths == size)
        rows = values.reshape(-1, size) if len(places) == len(lengths) else values[starts[places, None] + np.arange(size)]
        with np.errstate(all="ignore"):
            norm = np.sqrt(fold(rows * rows))
            fine = (norm > 0) & (norm < np.inf)
            yield places[fine], rows[fine] / norm[fine, None]


def codes(ids: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Numbers in the order of the ids."""
    if ids.dtype != object:
        return ids
    out, known = np.zeros(len(ids), np.int64), kind == VALUE
    out[known] = np.unique(ids[known], return_inverse=True)[1]
    return out


def places_in(groups: np.ndarray) -> np.ndarray:
    """For sorted group numbers, each row's place within its group."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))


def first_copies(v: np.ndarray, ids: np.ndarray, kind: np.ndarray, top_k: int) -> np.ndarray:
    """Which rows can be among a query's first ``top_k``: of equal vectors, which tie for every query, those with the least ids."""
    bits = np.ascontiguousarray(v).view(np.int64)
    with np.errstate(over="ignore"):
        key = (bits * (np.random.default_rng(bits.shape[1]).integers(1 << 62, size=bits.shape[1]) * 2 + 1)).sum(axis=1)
    order = np.lexsort((codes(ids, kind), kind, key))
    place = places_in(key[order])
    if len(place) == 0 or place.max() < top_k:
        return np.arange(len(v))
    group = np.cumsum(place == 0) - 1
    leader = order[place == 0][group]
    unlike = np.unique(group[(bits[order] != bits[leader]).any(axis=1)])  # vectors that only share the key
    return np.sort(order[(place < top_k) | np.isin(group, unlike)])


def largest(v: np.ndarray) -> float:
    """The largest norm, 1 at least: unit vectors of tiny numbers can be off."""
    return float(np.sqrt(max(1.0, (v * v).sum(axis=1).max(initial=0.0))))


class Best:
    """The best rows of each query so far by (-rounded score, id), nulls first among ids and last among scores."""

    def __init__(self, n: int, top_k: int, dtype: np.dtype):
        self.top_k = top_k
        self.level, self.score = np.full((n, top_k), -np.inf), np.full((n, top_k), np.nan)
        self.kind, self.ids = np.full((n, top_k), EMPTY, np.int8), np.zeros((n, top_k), dtype)

    def add(self, q: np.ndarray, score: np.ndarray, level: np.ndarray, kind: np.ndarray, ids: np.ndarray) -> None:
        q, score, level, kind, ids = (x[level >= self.level[q, -1]] for x in (q, score, level, kind, ids))
        some = np.unique(q)
        if not len(some):
            return
        q, score, level, kind, ids = (
            np.concatenate(x)
            for x in ((np.repeat(some, self.top_k), q), (self.score[some].ravel(), score), (self.level[some].ravel(), level), (self.kind[some].ravel(), kind), (self.ids[some].ravel(), ids))
        )
        keys = (codes(ids, kind), -level, q) if (kind == VALUE).all() else (codes(ids, kind), kind, -level, q)
        order = np.lexsort(keys)
        first = order[places_in(q[order]) < self.top_k].reshape(len(some), self.top_k)
        self.score[some], self.level[some], self.kind[some], self.ids[some] = score[first], level[first], kind[first], ids[first]


class Tile:
    """Room for one product of queries and rows; taken once, because fresh pages cost more than the product."""

    def __init__(self):
        self.about, self.mask = np.empty(ROWS * QUERIES, np.float32), np.empty(ROWS * QUERIES + 8, bool)

    def product(self, q32: np.ndarray, v32: np.ndarray) -> np.ndarray:
        return np.matmul(q32, v32.T, out=self.about[: len(q32) * len(v32)].reshape(len(q32), len(v32)))

    def reach(self, about: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the values that reach their row's bar. Hits are few: only rows whose largest value does are looked at, eight marks as one word first."""
        some, n = np.flatnonzero(about.max(axis=1) >= bar), about.shape[1]
        if not len(some):
            return some, some
        size = len(some) * n
        np.greater_equal(about if len(some) == len(about) else about[some], bar[some, None], out=self.mask[:size].reshape(-1, n))
        self.mask[size : size + 8] = False
        places = (np.flatnonzero(self.mask[: -(-size // 8) * 8].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
        i, j = np.divmod(places[self.mask[places]], n)
        return some[i], j


class Asked:
    """Some of the queries of one size, and the scores that are not ranked yet.

    Ranking costs more than scoring, and a low bar only lets more pairs through:
    scores wait until half as many rows again have been seen, or there are PAIRS.
    """

    def __init__(self, best: Best, q: np.ndarray, qv: np.ndarray):
        self.best, self.q, self.qv, self.q32, self.most = best, q, qv, qv.astype(np.float32), largest(qv)
        self.waiting, self.n, self.seen, self.due = [], 0, 0, 0
        self.rank()

    def rank(self) -> None:
        if self.waiting:
            i, score, kind, ids = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
            self.best.add(self.q[i], score, micro(score), kind, ids)
        self.waiting, self.n, self.due = [], 0, self.seen + self.seen // 2
        self.bar = (self.best.level[self.q, -1] - 0.5) * 1e-6

    def look(self, tile: Tile, v: np.ndarray, v32: np.ndarray, most: float, kind: np.ndarray, ids: np.ndarray) -> None:
        """Score the rows that can be among the best of a query."""
        (n, size), k = v.shape, self.best.top_k
        about = tile.product(self.q32, v32)
        # the product's largest error: two roundings of the factors and one for each term and sum, over the product of the norms
        off = (size + 4) * 2.0**-24 * 1.01 * self.most * most + SLACK
        bar = self.bar - off
        open_ = np.flatnonzero(np.isneginf(bar))
        if len(open_) and n > k:
            bar[open_] = np.partition(about[open_], n - k, axis=1)[:, n - k] - 2 * off - 1e-6
        rows, columns = tile.reach(about, np.nextafter(bar.astype(np.float32), np.float32(-np.inf)))
        self.seen += n
        for at in range(0, len(rows), PAIRS):
            i, j = rows[at : at + PAIRS], columns[at : at + PAIRS]
            self.waiting.append((i, fold(self.qv[i] * v[j]), kind[j], ids[j]))
            self.n += len(i)
            if self.n >= PAIRS:
                self.rank()
        if self.seen >= self.due:
            self.rank()


class Block:
    """Queries that are held against every vector at once."""

    def __init__(self, items: pa.Array, vectors: pa.Array):
        self.items, self.groups = items, list(by_size(vectors))

    def search(self, batches: Iterator[pa.RecordBatch], top_k: int) -> Iterator[pa.RecordBatch]:
        best = kind_of_id = None
        tile, asked = Tile(), []
        for batch in batches:
            column, kind_of_id = batch.column(0), batch.schema.types[0]
            whole = pa.types.is_integer(kind_of_id)
            all_kinds = np.where(column.is_null().to_numpy(zero_copy_only=False), NULL, VALUE).astype(np.int8)
            all_ids = pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False) if whole else np.array([*column.to_pylist(), None], object)[:-1]
            if best is None:
                best = Best(len(self.items), top_k, np.dtype(np.int64 if whole else object))
                asked = [Asked(best, q[x : x + QUERIES], qv[x : x + QUERIES]) for q, qv in self.groups for x in range(0, len(q), QUERIES)]
            for places, v in by_size(batch.column(1)):
                keep = first_copies(v, all_ids[places], all_kinds[places], top_k)
                kind, ids, v = all_kinds[places[keep]], all_ids[places[keep]], v[keep]
                v32, most = v.astype(np.float32), largest(v)
                alike = [x for x in asked if x.qv.shape[1] == v.shape[1]]
                few = np.lexsort((codes(ids, kind), kind))[:top_k] if len(alike) < len(asked) else []
                for x in asked:
                    if x.qv.shape[1] != v.shape[1]:  # no score, which ranks after every score
                        none = np.full(len(x.q) * len(few), np.nan)
                        best.add(np.repeat(x.q, len(few)), none, np.full(len(none), -np.inf), np.tile(kind[few], len(x.q)), np.tile(ids[few], len(x.q)))
                for r in (slice(k, k + ROWS) for k in range(0, len(v), ROWS)):
                    for x in alike:
                        x.look(tile, v[r], v32[r], most, kind[r], ids[r])
        for x in asked:
            x.rank()
        if best is None:
            return
        q, place = np.nonzero(best.kind != EMPTY)
        for at in range(0, len(q), SENT):
            a, b = q[at : at + SENT], place[at : at + SENT]
            ids = pa.array(best.ids[a, b], pa.int64() if pa.types.is_integer(kind_of_id) else kind_of_id, mask=best.kind[a, b] == NULL).cast(kind_of_id)
            score = pa.array(best.score[a, b], pa.float64(), mask=np.isneginf(best.level[a, b]))
            yield pa.RecordBatch.from_arrays([self.items.take(pa.array(a)), ids, score], names=["item_id", "vec_id", "score"])


def searcher(sent, top_k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow over (vec_id, embedding); ``sent`` is the broadcast Block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sent.value.search(batches, top_k)

    return search
