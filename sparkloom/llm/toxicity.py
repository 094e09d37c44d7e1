"""Toxicity by class-conditional Kneser-Ney models.

Spark counts, over all labelled training rows, in how many different left contexts (words before it, or the start of a
text) each word stands in toxic text, in ordinary text and in both together. These continuation counts are the models:
a class's probability of a word is its discounted share of the class's contexts, and the discounted mass backs off to
the probability from the shared counts, discounted in turn, whose rest goes to words not seen. So a rare expression has
the same backoff in both classes and little evidence. Discounts come from the counts, n1 / (n1 + 2 n2). A text that
repeats another one adds no context, so copies count once without being removed.

A text's evidence is the difference of the toxic and the ordinary log-likelihood, normalised by length: of the whole
text, of its most toxic word and of its three most toxic words. A logistic curve over these and the text's length turns
them into a score. It is fitted on at most about CURVE_ROWS training rows of each class, each seen with counts from
which its own one of FOLDS folds is left out. All constants were chosen within training rows.

The model a task holds is one log ratio for each of SLOTS hashed words, whatever the input; every counted word is in it,
and words that share a slot share their counts.

Words are lower-case runs without white space, trimmed of punctuation. A null or empty text has the score of no
evidence for its length. Without rows of both classes the score is the toxic share (0 with no labels). Rows that repeat
a key in the labels count as toxic if any does. Repeated rows each get a row; other columns, labels and keys are no
inputs of a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import slices
from .shared import marked, ready, stored

#: Training rows of each class that fit the curve, about, and folds for their evidence.
CURVE_ROWS, FOLDS = 4_000, 3
THRESHOLD = 0.3
#: Hashed words of the model.
SLOTS = 1 << 22
_EDGES = ".,;:!?\"'()[]{}*#%&$|<>…«»"
#: Stands for the start of a text.
START = -1


def lower_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all words in order, the codes' hashes, how many words each text has)."""
    flat = pc.utf8_lower(pc.fill_null(texts, ""))
    for c in "\t\n\x0b\x0c\r":
        flat = pc.replace_substring(flat, c, " ")
    lists = pc.split_pattern(flat, " ")
    of = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    words = [w.strip(_EDGES) for w in coded.dictionary.to_pylist()]
    index = coded.indices.to_numpy(zero_copy_only=False)
    real = np.array([bool(w) for w in words], dtype=bool)[index] if len(words) else np.zeros(0, bool)
    known = np.array([xxhash.xxh64_intdigest(w) >> 1 for w in words], dtype=np.int64)
    return index[real], known, np.bincount(of[real], minlength=len(texts)).astype(np.int64)


#: Bits of a hashed left context beside the slot of its word.
_CONTEXT_BITS = 40


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pair, kinds): the slot of a word with the word before it, and a bit for each class and fold of the texts
    that have them, once for a batch."""
    for b in slices(batches, rows=2048, size=8 << 20):
        index, known, counts = lower_words(b["text"])
        kind = np.repeat(np.left_shift(1, b["kind"].to_numpy(zero_copy_only=False)).astype(np.int16), counts)
        starts = np.zeros(len(index), bool)
        starts[(np.cumsum(counts) - counts)[counts > 0]] = True
        index = index.astype(np.int64)
        before = np.where(starts, len(known), np.concatenate([index[:1], index[:-1]]))
        code, at = np.unique(before * (len(known) + 1) + index, return_inverse=True)
        kinds = np.zeros(len(code), np.int16)
        np.bitwise_or.at(kinds, at, kind)
        word, context = known[code % (len(known) + 1)], np.append(known, START)[code // (len(known) + 1)]
        yield pa.RecordBatch.from_arrays([pa.array(word % SLOTS << _CONTEXT_BITS | context >> 8 & (1 << _CONTEXT_BITS) - 1), pa.array(kinds)], names=["pair", "kinds"])


#: Counts over all training rows, then those without each fold.
_VIEWS = [-1, *range(FOLDS)]


def _counts(rows: DataFrame) -> DataFrame:
    """(slot, n_<class>_<view>): a word's different contexts in ordinary (0), toxic (1) and any (2) text of each view."""
    pairs = rows.mapInArrow(_contexts, "pair long, kinds short").groupBy("pair").agg(F.bit_or("kinds").alias("kinds"))
    columns = []
    for v, c in product(range(len(_VIEWS)), (0, 1, 2)):
        mask = sum(1 << k * FOLDS + f for k in (0, 1) for f in range(FOLDS) if c in (k, 2) and f != _VIEWS[v])
        columns.append(F.count_if(F.col("kinds").bitwiseAND(F.lit(mask).cast("short")) != 0).cast("int").alias(f"n_{c}_{v}"))
    return stored(pairs.groupBy(F.shiftright("pair", _CONTEXT_BITS).cast("int").alias("slot")).agg(*columns))


def _ratios(counts: DataFrame) -> np.ndarray:
    """Log ratios, views x slots; a slot without a counted word has that of words not seen."""
    names = [n for n in counts.columns if n != "slot"]
    tells = {"sum": F.sum, "types": lambda c: F.count_if(c > 0), "one": lambda c: F.count_if(c == 1), "two": lambda c: F.count_if(c == 2)}
    sums = counts.agg(*(f(F.col(n)).alias(f"{n}_{k}") for n in names for k, f in tells.items())).first()

    def p(v: int, c: int, n: Callable, above: Callable, lower):
        """The probability of a word whose counts n gives; above(x, 0) is the larger one."""
        total, types, one, two = (sums[f"n_{c}_{v}_{k}"] for k in tells)
        discount = min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5
        total = max(1, total)
        return above(n(f"n_{c}_{v}") - discount, 0.0) / total + lower * ((1 - (total - discount * types) / total) if types else 1.0)

    def ratio(v: int, n: Callable, above: Callable, log: Callable):
        shared = p(v, 2, n, above, 1 / (sums[f"n_2_{v}_types"] + 1))
        return log(p(v, 1, n, above, shared) / p(v, 0, n, above, shared))

    each = [ratio(v, F.col, lambda x, low: F.greatest(x, F.lit(low)), F.log).cast("float").alias(f"r{v}") for v in range(len(_VIEWS))]
    held = counts.select("slot", *each).toArrow()
    out = np.empty((len(_VIEWS), SLOTS), np.float32)
    for v in range(len(_VIEWS)):
        out[v] = ratio(v, lambda _: 0.0, max, np.log)
        out[v, held["slot"].to_numpy()] = held[f"r{v}"].to_numpy()
    return out


def features(texts: pa.Array, ratios: np.ndarray, view: np.ndarray | None = None) -> np.ndarray:
    """Of each text: 1, its difference of log-likelihoods per word, that of the most toxic word and of three, length."""
    index, known, counts = lower_words(texts)
    out = np.zeros((len(counts), 5))
    out[:, 0], out[:, 4] = 1, np.log1p(counts) / 5
    if not len(index):
        return out
    text = np.repeat(np.arange(len(counts)), counts)
    ratio = ratios[0 if view is None else view[text], (known % SLOTS)[index]].astype(float)
    n = np.maximum(counts, 1)
    out[:, 1] = np.bincount(text, ratio, minlength=len(counts)) / n
    by = np.lexsort((-ratio, text))
    place = np.arange(len(by)) - np.repeat(np.cumsum(counts) - counts, counts)
    for column, most in ((2, 1), (3, 3)):
        out[:, column] = np.bincount(text[place < most], ratio[by[place < most]], minlength=len(counts)) / np.minimum(n, most)
    return out


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a light ridge, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.05 * np.eye(len(w)), x.T @ (y - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, training: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """The log ratios and the curve. Counts are over all labelled training rows."""
    spark = docs.sparkSession
    ready(spark)
    fold = F.pmod(F.xxhash64(F.col(key), F.lit("fold")), F.lit(FOLDS)).cast("int")
    marks = labels.filter(training & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_toxic"))
    marks = stored(marks.select(F.col(key).alias("_key"), "_toxic", (F.col("_toxic") * FOLDS + fold).alias("kind")))
    shares = {r["_toxic"]: r["count"] for r in marks.groupBy("_toxic").count().collect()}
    # only labelled texts are shuffled
    near = marked(docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text")), F.col("_key"), marks, F.col("_key"))
    rows = stored(near.filter("_marked").select("_key", "text").join(marks, "_key"))
    if {0, 1} - {r["_toxic"] for r in rows.select("_toxic").distinct().collect()}:
        total = sum(shares.values())
        return {"share": shares.get(1, 0) / total if total else 0.0}
    counts = _counts(rows.select("text", "kind"))
    if counts.isEmpty():
        return {"share": shares[1] / sum(shares.values())}
    ratios = _ratios(counts)
    rate = {c: min(1.0, CURVE_ROWS / shares[c]) for c in (0, 1)}
    draw = F.pmod(F.xxhash64(F.col("_key"), F.lit("draw")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = rows.filter(draw < F.when(F.col("_toxic") == 1, rate[1]).otherwise(rate[0])).select("text", "kind")
    held = spark.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows=512, size=4 << 20):
            kind = b["kind"].to_numpy(zero_copy_only=False)
            x = features(b["text"], held.value, kind % FOLDS + 1)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), pa.array((kind // FOLDS).astype(float))], names=[*"abcde", "y"])

    fit = sample.mapInArrow(run, ", ".join(f"{c} double" for c in [*"abcde", "y"])).toPandas().to_numpy()
    x, y = fit[:, :5], fit[:, 5]
    w = _curve(x, y) if 0 < y.sum() < len(y) else np.array([-2.0, 1.0, 1.0, 0.0, 0.0])
    w[0] += np.log(rate[0] / rate[1])
    return {"ratios": ratios[:1], "weights": w}


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, llr, predicted): a row for each row of docs. llr: the whole text's difference per word."""
    ready(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = held.value
        for b in slices(batches, rows=512, size=4 << 20):
            if "share" in given:
                llr, p = np.zeros(b.num_rows), np.full(b.num_rows, given["share"])
            else:
                x = features(b["text"], given["ratios"])
                llr, p = x[:, 1], 1 / (1 + np.exp(-np.clip(x @ given["weights"], -30, 30)))
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(p), pa.array(llr)], names=["key", "score", "llr"])

    out = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, score double, llr double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).withColumnRenamed("key", key)
