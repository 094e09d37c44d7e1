"""Exact nearest neighbours of queries, which may be a stated set or every row, in blocks: both sides are cut by a hash of
their keys, each pair of blocks meets in one task as arrays, and only what can still be among a query's best k leaves it.
Work grows with queries times vectors as it must, but a pair costs a few array operations, and a task holds one pair of
blocks. Blocks grow with the number of queries up to a bound, so that rows are copied to fewer of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workers import reachable

VECTORS, QUERIES, ROWS = 4096, 4096, 256
#: At most so many times larger are blocks of vectors and of queries if there are many queries.
WIDER, HIGHER = 16, 4
#: Cosines are ranked by six decimals: what is this close to the k-th may still tie with it.
SLACK = 2.1e-6
#: Squares of lengths between which a cosine is first told as a product of unit vectors of single precision; ERROR times their
#: components and eight is twice what two of these can be off by.
SMALL, LARGE, ERROR = 1e-140, 1e140, 2.4e-7


def _sides(table: pa.Table):
    """(keys, rank of each key, {length: (rows, matrix)}) where vectors without null only are in a matrix."""
    table = table.combine_chunks()
    ids, vectors = table["id"].combine_chunks(), table["vec"].combine_chunks()
    rank = pc.rank(ids, tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    ends = np.cumsum(np.maximum(lengths, 0))
    if flat.null_count:
        holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        lengths = np.where(holes[ends] > holes[ends - np.maximum(lengths, 0)], -1, lengths)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    sets = {}
    for n in set(lengths.tolist()) - {-1}:
        rows = np.flatnonzero(lengths == n)
        sets[n] = rows, values[(ends[rows] - n)[:, None] + np.arange(n)]
    return ids, rank, sets


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last as SQL does."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _squares(q: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(matrix)))
    for k in range(matrix.shape[1]):
        out += np.square(matrix[None, :, k] - q[:, None, k])
    return out


def _alike(matrix: np.ndarray) -> np.ndarray:
    """A number for each row; rows with the same one are equal."""
    words = np.ascontiguousarray(matrix).view(np.uint64)
    odd = np.random.default_rng(1).integers(0, 1 << 62, matrix.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    _, first, group = np.unique((words ^ (words >> np.uint64(32))) @ odd, return_index=True, return_inverse=True)
    other = np.flatnonzero((words != words[first[group]]).any(axis=1))  # another vector with the same hash stands alone
    group[other] = len(first) + np.arange(len(other))
    return group


def _few(group: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among a query's best k, in order: of those alike, the k + 1 least keys, for one may be its own."""
    turn = np.lexsort((rank, group))
    new = np.ones(len(turn), dtype=bool)
    new[1:] = group[turn][1:] != group[turn][:-1]
    step = new.copy()
    step[1:] |= rank[turn][1:] != rank[turn][:-1]
    level = np.cumsum(step)
    return np.sort(turn[level - np.maximum.accumulate(np.where(new, level, 0)) <= k])


def _place(*sorted_by: np.ndarray) -> np.ndarray:
    """The place from 0 of each row among those before it that are equal in all of these."""
    new = np.zeros(len(sorted_by[0]), dtype=bool)
    new[:1] = True
    for z in sorted_by:
        new[1:] |= z[1:] != z[:-1]
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _least(best: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The k least of best and of the least scores of groups of columns: their k-th is no less than the k-th score."""
    wide = score.shape[1] // max(128, 4 * k)
    if wide > 1:
        cut = score.shape[1] // wide * wide
        score = np.hstack([score[:, :cut].reshape(len(score), wide, -1).min(axis=1), score[:, cut:]])
    return np.partition(np.hstack([best, score]), k - 1, axis=1)[:, :k]


class _Pairs:
    """Vectors of one length, held against queries of that length; what is smaller is nearer."""

    def __init__(self, k: int, cosine: bool, cols: np.ndarray, matrix: np.ndarray, wanted: np.ndarray, rank: np.ndarray, keys: np.ndarray, tile: int):
        self.k, self.cosine, self.tile = k, cosine, tile
        keep = _few(_alike(matrix) if matrix.shape[1] else np.zeros(len(matrix)), rank[cols], k)
        if by_x := not cosine and matrix.shape[1] > 0:
            keep = keep[np.argsort(matrix[keep, 0], kind="stable")]
        self.window = tile // 4 if by_x and len(keep) > tile // 2 else 0
        self.cols, self.matrix, self.wanted = cols[keep], matrix[keep], wanted
        self.rank, self.keys = rank[self.cols], keys[self.cols]
        self.by = np.argsort(self.keys, kind="stable")
        self.square, self.length = _dot(self.matrix, self.matrix), _dot(wanted, wanted)
        self.tame = cosine and all(((x > SMALL) & (x < LARGE)).all() for x in (self.square, self.length))
        self.slack = SLACK if cosine else 0.0
        if self.tame:
            self.unit = (self.matrix / np.sqrt(self.square)[:, None]).astype(np.float32)
            self.turned = (-wanted / np.sqrt(self.length)[:, None]).astype(np.float32)
            self.slack += ERROR * (wanted.shape[1] + 8)

    def scores(self, rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
        if self.tame:
            return self.turned[rows] @ self.unit[lo:hi].T
        q, matrix = self.wanted[rows], self.matrix[lo:hi]
        with np.errstate(all="ignore"):
            near = -(q @ matrix.T) / np.sqrt(self.length[rows][:, None] * self.square[None, lo:hi]) if self.cosine else _squares(q, matrix)
        near[np.isnan(near)] = -np.inf if self.cosine else np.inf
        return near

    def others(self, rows: np.ndarray, own: np.ndarray):
        """A function that gives the scores of a range of columns; a query's own key has the worst."""
        low, high = (np.searchsorted(self.keys[self.by], own, side) for side in ("left", "right"))
        i = np.repeat(np.arange(len(own)), high - low)
        j = self.by[np.arange(len(i)) - np.repeat(np.cumsum(high - low) - high, high - low)]

        def of(lo: int, hi: int) -> np.ndarray:
            score, here = self.scores(rows, lo, hi), (j >= lo) & (j < hi)
            score[i[here], j[here] - lo] = np.inf
            return score

        return of

    def around(self, x: np.ndarray, of) -> tuple[np.ndarray, int, int]:
        """A bound of each query's k-th distance from what is about as far to the right, and the columns that aren't beyond
        the bounds by that alone."""
        low, high = np.searchsorted(self.matrix[:, 0], [x[0], x[-1]])
        middle = (low + high) // 2
        bound = _least(np.full((len(x), self.k), np.inf), of(max(0, middle - self.window // 2), min(len(self.cols), middle + self.window // 2)), self.k)[:, -1]
        with np.errstate(all="ignore"):
            reach = np.sqrt(bound) * (1 + 1e-12) + np.abs(x) * 1e-12 + 1e-150
            left, right = np.min(x - reach), np.max(x + reach)
        if not (np.isfinite(left) and np.isfinite(right)):
            return bound, 0, len(self.cols)
        return bound, int(np.searchsorted(self.matrix[:, 0], left, "left")), int(np.searchsorted(self.matrix[:, 0], right, "right"))

    def settled(self, i: np.ndarray, j: np.ndarray, rows: np.ndarray):
        """Which of the pairs can be among the best, and their a, b and c. Cosines that are surely rounded to the same six
        decimals tie, and of these the k least keys are left; one within a thousandth of an edge stands for itself."""
        x, y = self.matrix[j], self.wanted[rows[i]]
        with np.errstate(all="ignore"):
            a, b, c = (_dot(y, x), self.square[j], self.length[rows[i]]) if self.cosine else (_dot(y - x, y - x), *np.full((2, len(i)), np.nan))
            sort = -1e6 * (a / np.sqrt(b * c)) if self.cosine else a
            if self.cosine:
                sort = np.where(np.abs(sort - np.rint(sort)) < 0.499, np.rint(sort), sort)
        void = np.isnan(sort)
        sort = np.where(void, -np.inf if self.cosine else np.inf, sort)
        turn = np.lexsort((self.rank[j], void, sort, i))
        turn = turn[_place(i[turn], sort[turn], void[turn]) < self.k]
        place = _place(i[turn])
        ends = np.full(len(rows), np.inf)
        ends[i[turn][place == self.k - 1]] = sort[turn][place == self.k - 1]
        turn = turn[sort[turn] <= ends[i[turn]] + 1.01] if self.cosine else turn[place < self.k]
        return turn, a[turn], b[turn], c[turn]

    def nearest(self, rows: np.ndarray, own: np.ndarray):
        """(i, j, a, b, c) of the pairs of these queries that can be among the best, and a bound of each one's k-th score."""
        of = self.others(rows, own)
        bound, lo, hi = self.around(self.wanted[rows, 0], of) if self.window else (np.full(len(rows), np.inf), 0, len(self.cols))
        least = np.full((len(rows), self.k), np.inf)
        i, j, left = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for at in range(lo, hi, self.tile):
            score = of(at, min(hi, at + self.tile))
            least = _least(least, score, self.k)
            bound = np.minimum(bound, least[:, -1])
            cut = bound + self.slack
            more, to = np.divmod(np.flatnonzero(score <= cut.astype(score.dtype)[:, None]), score.shape[1])
            i, j, left = np.append(i, more), np.append(j, to + at), np.append(left, score[more, to])
            near = (left <= cut[i]) & (self.keys[j] != own[i])
            i, j, left = i[near], j[near], left[near]
            if len(i) > 8 * self.k * len(rows):  # many ties, of which few can be among the best
                turn = self.settled(i, j, rows)[0]
                i, j, left = i[turn], j[turn], left[turn]
        turn, a, b, c = self.settled(i, j, rows)
        return (i[turn], j[turn], a, b, c), bound


def _block(k: int, cosine: bool):
    """Scores of a pair of blocks; nulls of a cosine are last and of a distance first."""
    tile, height = VECTORS, ROWS if cosine else max(1, ROWS // 4)

    def one(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        vids, rank, vsets = _sides(vectors)
        qids, _, qsets = _sides(queries)
        keys, own = (pc.fill_null(pc.index_in(x, value_set=pc.unique(qids)), -1).to_numpy(zero_copy_only=False) for x in (vids, qids))
        out = {"q": [], "v": [], "a": [], "b": [], "c": []}
        known = np.concatenate([np.zeros(0, np.int64), *(rows for rows, _ in qsets.values())])
        unknown = np.setdiff1d(np.arange(len(qids)), known), np.zeros((len(qids) - len(known), 0))
        for n, (asked, wanted) in [(-1, unknown), *qsets.items()]:
            cols, matrix = vsets.get(n, (np.zeros(0, np.int64), np.zeros((0, wanted.shape[1]))))
            rest = np.setdiff1d(np.arange(len(vids)), cols)  # of which no score is known
            rest = rest[_few(np.zeros(len(rest)), rank[rest], k)]
            pairs = _Pairs(k, cosine, cols, matrix, wanted, rank, keys, tile)
            order = np.argsort(wanted[:, 0], kind="stable") if pairs.window else np.arange(len(asked))
            for at in range(0, len(asked), height):
                rows = order[at : at + height]
                mine = asked[rows]
                (i, j, *numbers), bound = pairs.nearest(rows, own[mine])
                short = np.flatnonzero(bound == np.inf) if cosine else np.arange(len(rows))
                p, r = np.repeat(short, len(rest)), np.tile(rest, len(short))
                apart = keys[r] != own[mine[p]]
                out["q"].append(mine[np.append(i, p[apart])])
                out["v"].append(np.append(pairs.cols[j], r[apart]))
                for name, x in zip("abc", numbers, strict=True):
                    out[name] += [pa.array(x), pa.nulls(int(apart.sum()), pa.float64())]
        index = lambda name: pa.array(np.concatenate([np.zeros(0, np.int64), *out[name]]).astype(np.int64))
        numbers = [pa.chunked_array(out[n], type=pa.float64()).combine_chunks() for n in "abc"]
        return pa.table([qids.take(index("q")), vids.take(index("v")), *numbers], names=["query_id", "neighbour_id", "a", "b", "c"])

    return one


def _counts(vectors: int, queries: int) -> tuple[int, int]:
    """How many blocks either side is cut into: of VECTORS and QUERIES rows, and wider ones where there are many queries."""
    nq = max(1, -(-queries // QUERIES))
    nv = -(-vectors // (VECTORS * min(WIDER, max(1, nq // 4))))
    return max(1, nv), max(min(nq, 8 * HIGHER), -(-queries // (QUERIES * HIGHER)))


def candidates(vectors: DataFrame, queries: DataFrame, key: str, vector: Column, k: int, cosine: bool) -> DataFrame:
    """(query_id, neighbour_id, a, b, c): at least each query's k nearest. Of cosines a is the product and b and c the
    squares, of distances a is the square; null where a vector is null, holds a null or has another length."""
    reachable(vectors.sparkSession)
    nv, nq = _counts(vectors.count(), queries.count())
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    side = lambda d: d.select(F.col(key).alias("id"), vector.alias("vec"))
    left = side(vectors).select("id", "vec", block(nv).alias("vb"), every(nq).alias("qb"))
    right = side(queries).select("id", "vec", every(nv).alias("vb"), block(nq).alias("qb"))
    kind = vectors.schema[key].dataType.simpleString()
    found = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb"))
    return found.applyInArrow(_block(k, cosine), f"query_id {kind}, neighbour_id {kind}, a double, b double, c double")
