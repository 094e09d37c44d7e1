"""Vector code compression: product codes by exact integer k-means over anchors-hierarchy metric trees.

Each component x of a vector becomes the integer floor(4096 * x); a vector is cut into PARTS equal consecutive parts,
and each part position has a codebook of ENTRIES entries, which start as that part of the vectors with the smallest
keys. A round assigns every part to its nearest entry (squared distance, ties to the lower index) and replaces each
entry by the floor of its parts' mean; an entry without parts stays. A vector's code is its parts' entries at the end.

Vectors are dealt into blocks where they are read. For each part of a block a metric tree is built middle-out: about
the square root of its points become anchors, each new one at the farthest point of the widest anchor and taking
nearer points from those close enough to have any; anchors are joined pairwise into the smallest balls up to one root,
and taken apart in the same way below until a ball has LEAF points. Balls hold the sum and number of their points.
The trees are written once. A round walks them with the entries that may be nearest: a child inherits its parent's
list, an entry goes when the ball lies wholly on the far side of the plane between it and the entry nearest to the
centre, and a ball with one entry left adds its cached sum and count without a look at its points. The points of a
leaf are compared exactly, as integers. A round brings PARTS * ENTRIES * (length of a part + 1) numbers to the driver.

Vectors that are null, hold null or non-finite components, or aren't of the length of the one with the smallest key
(a positive multiple of PARTS) are dropped. Rows that repeat a key are rows of their own; among them order is by
vector, and a null key comes last. With fewer vectors than ENTRIES there are as many entries as vectors. Components
whose integers reach 2^29 / sqrt(length of a part / 8) raise an error, since a squared distance must be a long.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dealt_join, ready, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LEAF = 32
#: Rows and bytes of integers of one block at most.
BLOCK_ROWS, BLOCK_BYTES = 4096, 16 << 20


def anchors(points: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """The points (numbers into points) owned by each of about sqrt(n) anchors, none of them empty."""
    start = points[own[0]]
    far = np.sqrt(((points[own] - start) ** 2).sum(axis=1))
    by = np.argsort(-far, kind="stable")
    pivots, owned, dist = [start], [own[by]], [far[by]]
    while len(pivots) ** 2 < len(own):
        widest = max(range(len(pivots)), key=lambda a: dist[a][0])
        if dist[widest][0] == 0:
            break
        pivot = points[owned[widest][0]]
        between = np.sqrt(((np.array(pivots) - pivot) ** 2).sum(axis=1))
        taken, how_far = [], []
        for a, apart in enumerate(between):
            # a point nearer to its anchor than half the way between the two stays; distances fall
            upto = int(np.searchsorted(-dist[a], -apart / 2, side="right"))
            if upto == 0:
                continue
            ask = owned[a][:upto]
            now = np.sqrt(((points[ask] - pivot) ** 2).sum(axis=1))
            nearer = now < dist[a][:upto]
            if nearer.any():
                taken.append(ask[nearer])
                how_far.append(now[nearer])
                stays = np.ones(len(owned[a]), bool)
                stays[:upto] = ~nearer
                owned[a], dist[a] = owned[a][stays], dist[a][stays]
        new, far = np.concatenate(taken), np.concatenate(how_far)
        by = np.argsort(-far, kind="stable")
        pivots.append(pivot)
        owned.append(new[by])
        dist.append(far[by])
    return owned


class Tree:
    """Balls over points. A ball holds points low to high of the tree's order; kids is -1 twice for a leaf."""

    def __init__(self, whole: np.ndarray):
        self.points = whole.astype(float)
        self.balls: list[tuple] = []
        root = self._build(np.arange(len(whole)))
        self._flatten(whole, root)

    def _ball(self, own: np.ndarray, kids: tuple[int, int] | None) -> int:
        centre = self.points[own].mean(axis=0)
        radius = float(np.sqrt(((self.points[own] - centre) ** 2).sum(axis=1).max()))
        self.balls.append((own, centre, radius, kids))
        return len(self.balls) - 1

    def _build(self, own: np.ndarray) -> int:
        groups = anchors(self.points, own) if len(own) > LEAF else [own]
        if len(groups) == 1:
            return self._ball(own, None)
        nodes = [self._build(g) for g in groups]
        centre = np.array([self.balls[n][1] for n in nodes])
        radius = np.array([self.balls[n][2] for n in nodes])
        # the diameter of the ball around two balls
        wide = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2)) + radius[:, None] + radius[None]
        np.fill_diagonal(wide, np.inf)
        for _ in range(len(nodes) - 1):
            i, j = divmod(int(np.argmin(wide)), len(nodes))
            nodes[i] = self._ball(np.concatenate([self.balls[nodes[i]][0], self.balls[nodes[j]][0]]), (nodes[i], nodes[j]))
            centre[i], radius[i] = self.balls[nodes[i]][1:3]
            gone = np.isinf(wide[i])
            row = np.sqrt(((centre - centre[i]) ** 2).sum(axis=1)) + radius + radius[i]
            row[gone & (np.arange(len(nodes)) != j)] = np.inf
            row[[i, j]] = np.inf
            wide[i], wide[:, i] = row, row
            wide[j], wide[:, j] = np.inf, np.inf
        return nodes[int(i)]

    def _flatten(self, whole: np.ndarray, root: int) -> None:
        order, low, count = [], np.zeros(len(self.balls), int), 0
        stack = [root]
        while stack:
            n = stack.pop()
            low[n] = count
            if self.balls[n][3] is None:
                order.append(self.balls[n][0])
                count += len(self.balls[n][0])
            else:
                stack += self.balls[n][3][::-1]
        self.root, self.order, self.low = root, np.concatenate(order), low
        self.points = whole[self.order]
        self.count = np.array([len(b[0]) for b in self.balls])
        self.centre = np.array([b[1] for b in self.balls])
        self.radius = np.array([b[2] for b in self.balls])
        self.sums = np.array([whole[b[0]].sum(axis=0) for b in self.balls])
        self.kids = np.array([b[3] or (-1, -1) for b in self.balls])
        del self.balls

    def walk(self, entries: np.ndarray) -> Iterator[tuple[int, int | np.ndarray, np.ndarray]]:
        """(ball, its only entry or the entry of each of its points, those points' numbers in the tree's order)."""
        real = entries.astype(float)
        apart = np.sqrt(((real[:, None] - real[None]) ** 2).sum(axis=2))
        # of equal entries the first takes all
        first = np.sort(np.unique(entries, axis=0, return_index=True)[1])
        stack = [(self.root, first)]
        while stack:
            n, may = stack.pop()
            if len(may) > 1:
                off = ((real[may] - self.centre[n]) ** 2).sum(axis=1)
                best = int(np.argmin(off))
                room = self.radius[n] * (1 + 1e-9) + 1e-9 * float(np.abs(self.centre[n]).max()) + 1e-6
                may = may[off - off[best] <= 2 * apart[may[best], may] * room]
            low, high = self.low[n], self.low[n] + self.count[n]
            if len(may) == 1:
                yield n, int(may[0]), slice(low, high)
            elif self.kids[n][0] >= 0:
                stack += [(int(k), may) for k in self.kids[n]]
            else:
                off = ((self.points[low:high, None] - entries[may][None]) ** 2).sum(axis=2)
                yield n, may[np.argmin(off, axis=1)], slice(low, high)

    def summed(self, entries: np.ndarray) -> np.ndarray:
        """For each entry the sum of its points and, last, their number."""
        out = np.zeros((len(entries), entries.shape[1] + 1), np.int64)
        for n, entry, at in self.walk(entries):
            if isinstance(entry, int):
                out[entry, :-1] += self.sums[n]
                out[entry, -1] += self.count[n]
            else:
                np.add.at(out, (entry, slice(None, -1)), self.points[at])
                np.add.at(out, (entry, -1), 1)
        return out

    def assigned(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's entry and squared distance, in the order of the points given."""
        codes = np.empty(len(self.points), np.int64)
        for _, entry, at in self.walk(entries):
            codes[at] = entry
        error = ((self.points - entries[codes]) ** 2).sum(axis=1)
        back = np.argsort(self.order)
        return codes[back], error[back]


def integers(vectors: list | np.ndarray) -> np.ndarray:
    """(row, part, position) as integers."""
    real = np.floor(np.asarray(vectors, dtype=float) * SCALE)
    real = real.reshape(len(real), PARTS, -1)
    if real.size and float(np.abs(real).max()) * 2 * np.sqrt(real.shape[2]) >= 2**31.5:
        raise ValueError("components this large have squared distances that are no longs")
    return real.astype(np.int64)


def kept(vectors: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, list]:
    """(key, vec, label) of the vectors to be coded, and the vectors of the ENTRIES smallest keys."""
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vec"), F.col(label).alias("label"))
    rows = rows.filter("vec is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    by = (F.col("key").asc_nulls_last(), "vec")
    least = rows.filter(F.size("vec") % PARTS == 0).orderBy(*by).first()
    if least is None:
        return rows.filter("false"), []
    rows = rows.filter(F.size("vec") == len(least.vec))
    return rows, [r.vec for r in rows.orderBy(*by).limit(ENTRIES).collect()]


def forest(rows: DataFrame, length: int) -> DataFrame:
    """(keys, labels, trees): a row for each block, as a written table."""
    most = max(64, min(BLOCK_ROWS, BLOCK_BYTES // (8 * length)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            flat = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            parts = integers(flat.reshape(table.num_rows, -1))
            trees = pickle.dumps([Tree(parts[:, p]) for p in range(PARTS)], protocol=5)
            lists = [pa.ListArray.from_arrays([0, table.num_rows], table[c].combine_chunks()) for c in ("key", "label")]
            return pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.binary())], names=["keys", "labels", "trees"])

        n = 0
        for b in batches:
            while n + b.num_rows >= most:
                held.append(b.slice(0, most - n))
                b = b.slice(most - n)
                yield block()
                held, n = [], 0
            if b.num_rows:
                held.append(b)
                n += b.num_rows
        if held:
            yield block()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return stored(rows.mapInArrow(run, f"keys array<{kinds['key']}>, labels array<{kinds['label']}>, trees binary"))


def moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, position) after a round."""
    shape = (*books.shape[:2], books.shape[2] + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape, np.int64)
        for b in batches:
            for trees in b["trees"]:
                out += np.array([t.summed(e) for t, e in zip(pickle.loads(trees.as_py()), books, strict=True)])
        flat = out.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "value"])

    sums = blocks.select("trees").mapInArrow(run, "at long, value long").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(np.prod(shape), np.int64)
    for r in sums.collect():
        out[r.at] = r.value
    out = out.reshape(shape)
    count = out[..., -1:]
    return np.where(count > 0, out[..., :-1] // np.maximum(count, 1), books)


def coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(key, label, code, error): a row for each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                trees = pickle.loads(b["trees"][i].as_py())
                codes, errors = zip(*(t.assigned(e) for t, e in zip(trees, books, strict=True)), strict=True)
                text = [bytes(row).hex() for row in np.array(codes).T.astype(np.uint8).tolist()]
                yield pa.RecordBatch.from_arrays([b["keys"][i].values, b["labels"][i].values, pa.array(text), pa.array(sum(errors))], names=["key", "label", "code", "error"])

    kinds = {f.name: f.dataType.elementType.simpleString() for f in blocks.schema if f.name != "trees"}
    return blocks.mapInArrow(run, f"key {kinds['keys']}, label {kinds['labels']}, code string, error long")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(key, code, error, label_error) with a row for each vector that is kept, and the codebooks (part, entry,
    position). label_error: errors summed over equal labels; null labels are equal."""
    ready(vectors.sparkSession)
    rows, first = kept(vectors, key, vector, label)
    if not first:
        out = rows.select(F.col("key").alias(key), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return out, np.zeros((PARTS, 0, 0), np.int64)
    blocks = forest(rows, len(first[0]))
    books = integers(first).transpose(1, 0, 2)
    for _ in range(rounds):
        books = moved(blocks, books)
    name = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("name")
    found = stored(coded(blocks, books).select("key", "code", "error", name))
    sums = stored(found.groupBy("name").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    out = dealt_join(found, sums, "name", "n")
    return out.select(F.col("key").alias(key), "code", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _sql() -> str:
    """The same in DuckDB: a plain search of the nearest entry, a common table for each round."""
    near = """a{r} AS MATERIALIZED (SELECT id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT p.id, p.part, c.entry,
        CAST(list_sum(list_transform(list_zip(p.x, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN c{r} c ON p.part = c.part) GROUP BY id, part)"""
    move = """c{n} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.y, c.y) AS y FROM c{r} c LEFT JOIN (SELECT part, entry, list(v ORDER BY k) AS y FROM (
        SELECT part, entry, k, CAST(floor(sum(x[k]) / count(*)) AS BIGINT) AS v FROM a{r} JOIN p USING (id, part), range(1, (SELECT max(len(x)) + 1 FROM p)) r(k) GROUP BY part, entry, k) GROUP BY part, entry) m
        ON m.part = c.part AND m.entry = c.entry)"""
    steps = [near.format(r=r) + ",\n" + move.format(r=r, n=r + 1) for r in range(ROUNDS)] + [near.format(r=ROUNDS)]
    return f"""
    WITH v AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS i FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (SELECT id, part, i[part * (len(i) // {PARTS}) + 1 : (part + 1) * (len(i) // {PARTS})] AS x FROM v, range({PARTS}) r(part)),
    c0 AS (SELECT part, id - 1 AS entry, x AS y FROM p WHERE id <= {ENTRIES}),
    {(',' + chr(10)).join(steps)},
    e AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY id)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           (SELECT sha256(string_agg(CAST(y[k] AS VARCHAR), ',' ORDER BY part, entry, k)) FROM c{ROUNDS}, range(1, (SELECT max(len(x)) + 1 FROM p)) r(k)) AS codebooks_sha256
    FROM e JOIN v USING (id)
    """


SQL = _sql()
