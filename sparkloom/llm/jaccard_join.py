"""N-gram Jaccard join by chosen paths: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Equal texts are one row from the start (their digest is aggregated, partly before the shuffle). Each of RUNS runs puts
every set at the root of a tree and splits a node's sets again and again on sampled shared tokens: the node's path
draws one or two of the COORDINATES of a min-hash sketch, 1 / SIMILARITY on average, and sets with the same token there
go on together. A node of one set ends. A bounded draw of a larger node's sets tells how alike they are. A dense node,
whose sets agree in DENSE of their sketches on average, ends too: most of its pairs have to be compared anyway. Another
one of at most SMALL sets is compared by brute force, and a larger one is split again.

A pair at the threshold is still together after d splits of one run with a probability of at least SIMILARITY ** d, so
all RUNS part it within DEPTH splits with at most (1 - SIMILARITY ** DEPTH) ** RUNS: the runs are as many as
TARGET_RECALL asks for.

Brute force in small nodes gives pairs whose sketches aren't far below the threshold; they are verified on the whole
sets. Dense nodes are cut into blocks of bounded sets and bytes, and every two blocks are a tile, a group of its own: a
tile compares all its pairs on whole sets, counts the links and emits each set's count and its class in the tile, never
the pairs. A pair that is in several dense nodes counts in the one with the least number only, which sets learn from
each other's lists of nodes; sets without such a pair are not sent to a tile. Nothing depends on a node's size but how
many tiles it has.

n_links counts the verified links to other texts. class_id is the largest key among the rows that links connect. Texts
with fewer than five words have their whole word sequence as the only shingle; texts without words link to no other
text. A null text counts as empty. Rows with equal texts share a class, null keys being least. Repeated rows each get a
row, and rows that repeat a key with another text are told apart by their texts; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import slices
from .shared import dealt_join, marked, ready, stored, text_digest, whole_row

WORDS, SIMILARITY, TARGET_RECALL = 5, 0.8, 0.998
COORDINATES, DEPTH = 64, 4
RUNS = math.ceil(math.log(1 - TARGET_RECALL) / math.log(1 - SIMILARITY**DEPTH))
#: Sets of a node that are compared without asking how alike they are, sets compared by brute force on sketches.
FEW, SMALL = 12, 64
#: Sets drawn to tell how alike a node's sets are, and the mean agreement of their sketches in a dense node.
DRAWN, DENSE = 32, 0.5
#: Sets and shingles on each side of a tile, about.
TILE, TILE_SHINGLES = 2048, 700_000
#: Pairs whose sketches agree less than this are four standard deviations below the threshold.
SURELY_BELOW = SIMILARITY - 4 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / COORDINATES)
_FACTORS = np.random.default_rng(5).integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STRIP, _COLUMNS = 256, 2048


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, how many words each text has)."""
    flat = pc.fill_null(texts, "")
    for c in "\t\n\x0b\x0c\r":
        flat = pc.replace_substring(flat, c, " ")
    lists = pc.split_pattern(flat, " ")
    words, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    coded = words.filter(pa.array(real)).dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    return known[coded.indices.to_numpy(zero_copy_only=False)], np.bincount(of[real], minlength=len(texts)).astype(np.int64)


def shingles(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, how many each text has); a text of fewer words has one."""
    ends = np.cumsum(counts)
    starts = ends - counts
    own = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    first = np.cumsum(own) - own
    at = np.arange(int(own.sum())) - np.repeat(first - starts, own)
    end = np.minimum(np.repeat(ends, own), at + WORDS)
    value = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            inside = at + k < end
            word = np.where(inside, words[np.minimum(at + k, max(0, len(words) - 1))], np.uint64(0)) if len(words) else value
            value = _mixed((value + word) * _MIX + np.uint64(k))
    return value, own


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, rows=256, size=2 << 20):
        value, own = shingles(*words_of(b["text"]))
        full = np.flatnonzero(own)
        sketch = np.zeros((b.num_rows, COORDINATES), np.uint32)
        if len(full):
            at = (np.cumsum(own) - own)[full]
            with np.errstate(over="ignore"):
                for j in range(COORDINATES):
                    sketch[full, j] = np.minimum.reduceat((value * _FACTORS[j]) >> np.uint64(16), at) & np.uint64(0xFFFFFFFF)
        yield pa.RecordBatch.from_arrays(
            [b["key"], b["digest"], pa.array(own), pa.array([r.tobytes() for r in sketch], pa.binary())],
            names=["key", "digest", "length", "sketch"],
        )


def _below(sketch: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, nodes): where the sets go from their nodes, one level down."""
    with np.errstate(over="ignore"):
        drawn = _mixed(node * _MIX + np.uint64(17))
        one = (drawn % np.uint64(COORDINATES)).astype(np.int64)
        two = (one + 1 + ((drawn >> np.uint64(8)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
        both = (drawn >> np.uint64(32)).astype(np.float64) / 2**32 < 1 / SIMILARITY - 1
        rows = np.concatenate([np.arange(len(node)), np.flatnonzero(both)])
        at = np.concatenate([one, two[both]])
        return rows, _mixed(node[rows] * _MIX ^ _mixed((sketch[rows, at].astype(np.uint64) << np.uint64(7) | at.astype(np.uint64)) * _MIX))


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _gone(reps: pa.Array, rows: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([reps.take(pa.array(rows)), pa.array(node.view(np.int64))], names=["rep", "node"])


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the roots of all runs to the first level."""
    for batch in batches:
        for start in range(0, batch.num_rows, 8192):
            b = batch.slice(start, 8192)
            sketch = _sketches(b["sketch"])
            for run in range(RUNS):
                yield _gone(b["rep"], *_below(sketch, np.full(b.num_rows, xxhash.xxh64_intdigest(f"run {run}"), np.uint64)))


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 8192):
            b = batch.slice(start, 8192)
            yield _gone(b["rep"], *_below(_sketches(b["sketch"]), b["node"].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))


def _agreement(sketch: np.ndarray) -> np.ndarray:
    """Share of coordinates that every two sets agree on."""
    return (sketch[:, None] == sketch[None]).mean(axis=-1)


def _density(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dense = []
        for held in b["held"].to_pylist():
            n = len(held)
            agrees = _agreement(np.frombuffer(b"".join(held), np.uint32).reshape(-1, COORDINATES))
            dense.append(n > 1 and (float(agrees.sum()) - n) / (n * (n - 1)) >= DENSE)
        yield pa.RecordBatch.from_arrays([b["node"], b["size"], pa.array(dense, pa.bool_())], names=["node", "size", "dense"])


def _brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        left, right = [], []
        for members in b["members"].to_pylist():
            reps = np.array([m["rep"] for m in members])
            i, j = np.nonzero(np.triu(_agreement(np.frombuffer(b"".join(m["sketch"] for m in members), np.uint32).reshape(-1, COORDINATES)) >= SURELY_BELOW, 1))
            left.append(np.minimum(reps[i], reps[j]))
            right.append(np.maximum(reps[i], reps[j]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (left, right)], names=["a", "b"])


def shingle_set(text: str | None) -> set[tuple[str, ...]]:
    """The shingles that similarity is measured on."""
    words = [w for w in (text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    return {tuple(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))} if words else set()


def jaccard(one: set, two: set) -> float:
    shared = len(one & two)
    return shared / (len(one) + len(two) - shared) if one or two else 0.0


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts to their sorted different shingle hashes."""
    for b in slices(batches, rows=256, size=2 << 20):
        value, own = shingles(*words_of(b["text"]))
        held = [np.unique(x).tobytes() for x in np.split(value, np.cumsum(own)[:-1])]
        yield pa.RecordBatch.from_arrays([b["rep"], pa.array(held, pa.binary())], names=["rep", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hit = []
        for x, y in zip(b["one"], b["two"], strict=True):
            one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(one, two), len(one) - 1)
            shared = int((one[at] == two).sum())
            hit.append(shared / (len(one) + len(two) - shared) >= SIMILARITY)
        yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))


class _Common:
    """How many values of ragged lists every two rows share: blocks of a 0-1 matrix multiplied, strip by strip."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        row = np.repeat(np.arange(len(lengths)), lengths)
        _, code, times = np.unique(values, return_inverse=True, return_counts=True)
        column = np.cumsum(times > 1) - 1
        held = (times > 1)[code]
        row, column = row[held], column[code[held]]
        by = np.argsort(column // _COLUMNS, kind="stable")
        self._row, self._column = row[by], column[by]
        self._cuts = np.searchsorted(self._column // _COLUMNS, np.arange(int(self._column.max(initial=-1)) // _COLUMNS + 2))
        self._n = len(lengths)

    def counts(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = np.zeros((len(one), len(two)), np.float32)
        for k, (start, end) in enumerate(zip(self._cuts, self._cuts[1:], strict=False)):
            matrix = np.zeros((self._n, _COLUMNS), np.float32)
            matrix[self._row[start:end], self._column[start:end] - k * _COLUMNS] = 1
            right = matrix[two].T
            for at in range(0, len(one), _STRIP):
                out[at : at + _STRIP] += matrix[one[at : at + _STRIP]] @ right
        return out


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    held = lists.combine_chunks()
    return held.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)


def _new_pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of one block, rows of the other, whether their pair meets in this node first)."""
    node, i, j = (t[c][0].as_py() for c in ("node", "i", "j"))
    block = t["block"].to_numpy()
    one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
    values, lengths = _flat(t["nodes"])
    before = values < node
    lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[before], minlength=len(lengths))
    new = _Common(values[before], lengths).counts(one, two) == 0
    if i == j:
        np.fill_diagonal(new, False)
    return one, two, new


def _unmet(t: pa.Table) -> pa.Table:
    """The sets of a tile that have a pair which meets here first."""
    one, two, new = _new_pairs(t)
    wanted = np.unique(np.concatenate([one[new.any(axis=1)], two[new.any(axis=0)]]))
    return t.select(["node", "i", "j", "block", "rep"]).take(pa.array(wanted))


def _tile(t: pa.Table) -> pa.Table:
    """Links of a tile: each linked set's number of links, and the largest set (root) of its class within the tile."""
    t = t.sort_by([("rep", "descending")])
    one, two, hit = _new_pairs(t)
    data = t["shingles"].to_pylist()
    lengths = np.array([len(x) // 8 for x in data], np.int64)
    shared = _Common(np.frombuffer(b"".join(data), np.uint64), lengths).counts(one, two)
    for k in range(0, len(one), _STRIP):
        s = shared[k : k + _STRIP].astype(np.float64)
        hit[k : k + _STRIP] &= s / (lengths[one[k : k + _STRIP], None] + lengths[two][None] - s) >= SIMILARITY
    links = np.zeros(t.num_rows, np.int64)
    links[one] = hit.sum(axis=1)
    if t["i"][0] != t["j"][0]:
        links[two] = hit.sum(axis=0)
    root = np.arange(t.num_rows)
    while True:
        least = root.copy()
        for k in range(0, len(one), _STRIP):
            h, rows = hit[k : k + _STRIP], one[k : k + _STRIP]
            least[rows] = np.minimum(least[rows], np.where(h, root[two][None], t.num_rows).min(axis=1, initial=t.num_rows))
            np.minimum.at(least, two, np.where(h, root[rows][:, None], t.num_rows).min(axis=0, initial=t.num_rows))
        least = least[least]
        if (least == root).all():
            break
        root = least
    linked = np.flatnonzero(links)
    rep = t["rep"].to_numpy()
    return pa.table({"rep": pa.array(rep[linked]), "root": pa.array(rep[root[linked]]), "n": pa.array(links[linked])})


def _ends(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs that met in a small node and aren't surely below; (rep, node, size): the sets of dense nodes."""
    sketches = sets.filter("length > 0").select("rep", "sketch")
    below = stored(sketches.mapInArrow(_first, "rep long, node long"))
    found: list[DataFrame] = []
    dense: list[DataFrame] = []
    while True:
        sizes = stored(below.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
        shared = stored(dealt_join(below, sizes, "node", "size"))
        more = shared.filter(F.col("size") > FEW)
        drawn = more.filter(F.pmod(F.xxhash64("rep", "node"), "size") < DRAWN).join(sketches, "rep")
        kinds = stored(drawn.groupBy("node").agg(F.any_value("size").alias("size"), F.collect_list("sketch").alias("held")).mapInArrow(_density, "node long, size long, dense boolean"))
        told = stored(dealt_join(more.drop("size"), kinds, "node", "size"))
        dense.append(told.filter("dense").select("rep", "node", "size"))
        rest = told.filter("not dense").select("rep", "node", "size")
        few = shared.filter(F.col("size") <= FEW).select("rep", "node").unionByName(rest.filter(F.col("size") <= SMALL).select("rep", "node"))
        found.append(stored(_small(few, sketches)))
        below = stored(rest.filter(F.col("size") > SMALL).join(sketches, "rep").mapInArrow(_children, "rep long, node long"))
        if below.isEmpty():
            return stored(_united(found).distinct()), stored(_united(dense))


def _small(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """Brute force in small nodes; the same members in another run are compared once."""
    keyed = rows.groupBy("node").agg(F.sort_array(F.collect_list("rep")).alias("reps")).select("reps").distinct()
    each = keyed.withColumn("set", F.xxhash64("reps")).select("set", F.explode("reps").alias("rep")).join(sketches, "rep")
    groups = each.groupBy("set").agg(F.collect_list(F.struct("rep", "sketch")).alias("members"))
    return groups.select("members").mapInArrow(_brute, "a long, b long")


def _united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _tiles(dense: DataFrame, nodes_of: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, i, j, block, rep): the sets of each tile that have a pair which meets there first."""
    measured = dense.join(sets.select("rep", "length"), "rep").groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum("length").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")
    nodes = stored(measured.select("node", "size", blocks.alias("blocks")))
    placed = dealt_join(dense.select("rep", "node"), nodes, "node", "size").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = other.select("node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep")
    return stored(sides.join(nodes_of, "rep").groupBy("node", "i", "j").applyInArrow(_unmet, "node long, i int, j int, block int, rep long"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): the largest node it is connected with. Large-star and small-star
    steps in turn, each a written table, until nothing changes; a popular node's links stay where they are."""

    def largest(edges: DataFrame, out: bool) -> DataFrame:
        """Each node's smaller (out) neighbours, or its larger ones, go to the largest of it and its neighbours."""
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if out else edges
        top = stored(sides.groupBy("a").agg(F.greatest(F.max("b"), F.col("a")).alias("top"), F.count(F.lit(1)).alias("size")))
        moved = dealt_join(sides, top, "a", "size")
        if out:
            moved = moved.filter("b < a").select(F.col("b").alias("a"), F.col("top").alias("b"))
        else:
            moved = moved.select(F.col("b").alias("a"), F.col("top").alias("b")).unionByName(top.select("a", F.col("top").alias("b")))
        ordered = moved.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return stored(ordered.distinct())

    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct())
    before = None
    while True:
        edges = largest(largest(edges, True), False)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, key, class_key, class_digest, n_links, n_copies): a row for each different text, as a written table.
    key: the largest of its rows; class_key, class_digest: those of the row that stands for its class."""
    ready(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), text_digest(text).alias("digest"))
    sketched = source.mapInArrow(_sketch, "key long, digest binary, length long, sketch binary")
    one = sketched.groupBy("digest").agg(F.max("key").alias("key"), F.count(F.lit(1)).alias("n_copies"), F.any_value("length").alias("length"), F.any_value("sketch").alias("sketch"))
    # the number is given as the table is written, so it stays
    sets = stored(one.withColumn("rep", F.monotonically_increasing_id()))
    pairs, dense = _ends(sets)
    nodes_of = stored(dense.groupBy("rep").agg(F.collect_list("node").alias("nodes")))
    tiles = _tiles(dense, nodes_of, sets)
    # pairs that share a dense node meet there
    listed = lambda side: nodes_of.select(F.col("rep").alias(side), F.col("nodes").alias(f"nodes_{side}"))
    apart = pairs.join(listed("a"), "a", "left").join(listed("b"), "b", "left").filter(~F.coalesce(F.arrays_overlap("nodes_a", "nodes_b"), F.lit(False)))
    apart = stored(apart.select("a", "b"))
    held = _whole(source, sets, tiles.select("rep").unionByName(apart.select(F.explode(F.array("a", "b")).alias("rep"))).distinct())
    sides = [held.select(F.col("rep").alias(s), F.col("shingles").alias(c)) for s, c in (("a", "one"), ("b", "two"))]
    single = stored(apart.join(sides[1].hint("merge"), "b").join(sides[0].hint("merge"), "a").mapInArrow(_verify, "a long, b long"))
    met = tiles.join(held.hint("merge"), "rep").join(nodes_of.hint("merge"), "rep")
    tiled = stored(met.groupBy("node", "i", "j").applyInArrow(_tile, "rep long, root long, n long"))
    degree = tiled.select("rep", "n").unionByName(single.select(F.explode(F.array("a", "b")).alias("rep"), F.lit(1).cast("long").alias("n")))
    edges = single.unionByName(tiled.filter("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = sets.select("digest", "rep", "key", "n_copies").join(degree.groupBy("rep").agg(F.sum("n").alias("n_links")), "rep", "left")
    known = stored(known.join(components(edges).withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")))
    best = F.max(F.struct(F.col("key").isNotNull().alias("has"), F.col("key").alias("key"), F.col("digest").alias("digest"))).alias("best")
    heads = stored(known.groupBy("root").agg(best, F.count(F.lit(1)).alias("size")))
    named = dealt_join(known, heads, "root", "size")
    return stored(named.select("digest", "key", F.col("best.key").alias("class_key"), F.col("best.digest").alias("class_digest"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"))


def _whole(source: DataFrame, sets: DataFrame, needed: DataFrame) -> DataFrame:
    """(rep, shingles) of the sets that are needed: only their texts are shuffled, one of each."""
    wanted = stored(sets.select("rep", "digest").join(needed, "rep"))
    near = marked(source.select("digest", "text"), F.col("digest"), wanted, F.col("digest")).filter("_marked").select("digest", "text")
    texts = near.join(wanted.hint("merge"), "digest").dropDuplicates(["rep"]).select("rep", "text")
    return stored(texts.mapInArrow(_sets, "rep long, shingles binary"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, n_links, n_copies): a row for each row of docs. n_copies: rows with the same text."""
    found = classes(docs, key, text).select("digest", F.col("class_key").alias("class_id"), "n_links", "n_copies")
    rows = docs.select(F.col(key).cast("long").alias(key), text_digest(text).alias("digest"))
    return dealt_join(rows, found, "digest", "n_copies").select(key, "class_id", "n_links", "n_copies")


def kept_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class, the one with the largest key, all columns (null keys are least; of repeated
    rows one stays). Rows that are surely the only ones of their class stay where they are; the others are shuffled."""
    return one_of_each(docs, classes(docs, key, text), key, text)


def one_of_each(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """docs without the rows that don't stand for their class in found (a table that `classes` gives)."""
    settled = found.filter((F.col("n_copies") == 1) & (F.col("digest") == F.col("class_digest"))).select("digest")
    doubtful = stored(found.join(settled, "digest", "left_anti").select("digest", "key", (F.col("digest") == F.col("class_digest")).alias("stands")))
    held = docs.select(whole_row(docs), F.col(key).cast("long").alias("key"), text_digest(text).alias("digest"))
    rows = marked(held, F.col("digest"), doubtful, F.col("digest"))
    told = doubtful.select("digest", F.col("key").alias("best"), "stands")
    # losers go before the winners of a text meet: a text's rows with its largest key are all that is left to number
    met = rows.filter("_marked").join(told.hint("merge"), "digest", "left").filter(F.col("stands").isNull() | (F.col("stands") & F.col("key").eqNullSafe(F.col("best"))))
    first = F.row_number().over(Window.partitionBy("digest", "key").orderBy(F.lit(1)))
    one = met.filter("stands").withColumn("first", first).filter("first = 1").select("row.*")
    return rows.filter("not _marked").select("row.*").unionByName(met.filter("stands is null").select("row.*")).unionByName(one)
