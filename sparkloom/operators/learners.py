"""Models that Spark's own library fits over whole tables: uplift learners, clusters, projections, calibration, batches to label.

Features are double columns without nulls (see reports.featurize); rows with a null treatment or outcome teach nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, HashingTF, IDF, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered, running

c = F.col
Score = Callable[[DataFrame], DataFrame]


def _gather(df: DataFrame, features: Sequence[str], out: str = "_x") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df)


def _regress(rows: DataFrame, features: Sequence[str], outcome: str, seed: int):
    model = GBTRegressor(featuresCol="_x", labelCol=outcome, predictionCol="_guess", maxDepth=3, maxIter=10, seed=seed).fit(_gather(rows, features))
    return lambda df, out: model.transform(_gather(df, features)).drop("_x").withColumnRenamed("_guess", out)


def fit_learner(kind: str, units: DataFrame, features: Sequence[str], treated: str, outcome: str, key: str, seed: int = 7) -> Score:
    """A function that adds a score to units. random: a hash of the key; response: the outcome, treated or not; s: one model
    with the treatment among its features; t: one for each arm; x: effects imputed by the other arm's model, fitted again
    and blended by the treated share, which an experiment knows."""
    rows = units.select(key, *features, c(treated).cast("double").alias("_t"), c(outcome).cast("double").alias("_y")).filter("_t is not null and _y is not null")
    arm = lambda v: rows.filter(c("_t") == v)
    if kind == "random":
        return lambda df: df.withColumn("score", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    if kind == "response":
        return lambda df, g=_regress(rows, features, "_y", seed): g(df, "score")
    if kind == "s":
        g = _regress(rows, [*features, "_t"], "_y", seed)
        at = lambda df, v, out: g(df.withColumn("_t", F.lit(v)), out).drop("_t")
        return lambda df: at(at(df, 1.0, "_one"), 0.0, "_zero").withColumn("score", c("_one") - c("_zero")).drop("_one", "_zero")
    one, zero = _regress(arm(1), features, "_y", seed), _regress(arm(0), features, "_y", seed)
    if kind == "t":
        return lambda df: zero(one(df, "_one"), "_zero").withColumn("score", c("_one") - c("_zero")).drop("_one", "_zero")
    if kind != "x":
        raise ValueError(f"unknown learner {kind}")
    low = _regress(one(arm(0), "_other").withColumn("_d", c("_other") - c("_y")).drop("_other"), features, "_d", seed)
    high = _regress(zero(arm(1), "_other").withColumn("_d", c("_y") - c("_other")).drop("_other"), features, "_d", seed)
    share = rows.agg(F.avg("_t")).first()[0]
    return lambda df: high(low(df, "_low"), "_high").withColumn("score", share * c("_low") + (1 - share) * c("_high")).drop("_low", "_high")


def score_units(score: Score, units: DataFrame, fitted_on: str, version: str) -> DataFrame:
    """units with their score; refused if the model was fitted on another version of the data."""
    if fitted_on != version:
        raise ValueError(f"the model knows data {fitted_on}, not {version}")
    return score(units)


def evaluate_learners(scores: DataFrame, learner: str, score: str, tie: str, treated: Column, outcome: Column) -> DataFrame:
    """(learner, n, qini, place): the mean height of each learner's curve of extra successes over its units by falling score,
    ties by tie, less that of a straight line to the curve's end. One order over all learners serves all curves."""
    rows = scores.select(learner, score, tie, treated.cast("long").alias("_t"), outcome.cast("long").alias("_y")).filter("_t is not null and _y is not null")
    order = [F.desc(score), c(tie)]
    packed = rows.withColumns({"_n1": c("_t"), "_n0": 1 - c("_t"), "_k1": c("_t") * c("_y"), "_k0": (1 - c("_t")) * c("_y")})
    for name in ("_n1", "_n0", "_k1", "_k0"):
        packed = running(packed, "sum", c(name), name, *order, by=[learner])
    height = c("_k1") - c("_k0") * F.coalesce(F.try_divide(c("_n1"), c("_n0")), F.lit(0))
    told = packed.select(learner, height.alias("_h"), (c("_n1") + c("_n0")).alias("_place"))
    sums = told.groupBy(learner).agg(F.count(F.lit(1)).alias("n"), F.avg("_h").alias("_mean"), F.max_by("_h", "_place").alias("_end"))
    made = sums.select(learner, "n", ((c("_mean") - c("_end") * (c("n") + 1) / (2 * c("n"))) / c("n")).alias("qini"))
    return made.withColumn("place", F.row_number().over(Window.orderBy(F.desc("qini"), learner)))  # a row for each learner


def group_profile(units: DataFrame, score: str, tie: str, levels: Sequence[str]) -> DataFrame:
    """(part, column, value, n, share): what the tenth of units with the highest scores, and those with a score below zero,
    are made of."""
    ranked = numbered(units, "_place", F.desc(score), c(tie))
    n = F.broadcast(units.agg(F.count(F.lit(1)).alias("_n")))  # one row
    parts = F.array_compact(F.array(F.when(c("_place") * 10 <= c("_n"), "top"), F.when(c(score) < 0, "harmed")))
    dealt = ranked.crossJoin(n).select(F.explode(parts).alias("part"), F.array(*(F.struct(F.lit(x).alias("column_name"), c(x).cast("string").alias("value")) for x in levels)).alias("_v"))
    counts = dealt.select("part", F.explode("_v").alias("_v")).groupBy("part", "_v").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("part", "_v.column_name", "_v.value", "n", (c("n") / F.sum("n").over(Window.partitionBy("part", "_v.column_name"))).alias("share"))


def kmeans(vectors: DataFrame, key: str, vector: str, k: int, seed: int = 7) -> DataFrame:
    """(key, cluster) by the direction of the vectors."""
    unit = Normalizer(inputCol="_v", outputCol="_u").transform(vectors.select(key, array_to_vector(c(vector).cast("array<double>")).alias("_v")))
    return KMeans(k=k, seed=seed, featuresCol="_u", predictionCol="cluster").fit(unit).transform(unit).select(key, "cluster")


def pca2(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, list[float]]:
    """(key, x, y) on the two first principal axes, and the shares of variance that they explain."""
    wide = vectors.select(key, array_to_vector(c(vector).cast("array<double>")).alias("_v"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(wide)
    flat = model.transform(wide).select(key, vector_to_array("_p").alias("_p"))
    return flat.select(key, c("_p")[0].alias("x"), c("_p")[1].alias("y")), [float(v) for v in model.explainedVariance]


def calibrate(scores: DataFrame, depth: str, p: str, truth: str) -> DataFrame:
    """(depth, slope, shift) of a logistic regression of the truth on the logit of p, for each depth; 1 and 0 where fewer
    than ten rows or only one answer is known."""
    held = F.least(F.greatest(c(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = scores.select(c(depth).cast("int").alias("depth"), F.ln(held / (1 - held)).alias("_logit"), c(truth).cast("double").alias("_y"))
    told = []
    for r in sorted(rows.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("k")).collect()):  # a row for each level of a tree
        slope, shift = 1.0, 0.0
        if r.n >= 10 and 0 < r.k < r.n:
            model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1e-6).fit(_gather(rows.filter(c("depth") == r.depth), ["_logit"]))
            slope, shift = float(model.coefficients[0]), float(model.intercept)
        told.append((r.depth, slope, shift))
    return scores.sparkSession.createDataFrame(told, "depth int, slope double, shift double")


def best_threshold(scores: DataFrame, p: str, truth: Column, steps: int = 100) -> DataFrame:
    """One row (threshold, f1): the step of a grid with the highest F1 over all rows, the lowest of equal ones. Rows are
    counted by the highest step that they reach, so no row is held against every step."""
    at = F.floor(c(p) * steps).cast("int")
    counts = scores.filter(c(p).isNotNull()).groupBy(at.alias("_at")).agg(F.count_if(truth).alias("_yes"), F.count(F.lit(1)).alias("_n"))
    down = Window.orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)  # a row for each step
    f1 = 2 * F.sum("_yes").over(down) / (F.sum("_n").over(down) + F.sum("_yes").over(Window.partitionBy()))
    return counts.select((c("_at") / steps).alias("threshold"), f1.alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)


def select_batch(scores: DataFrame, vectors: DataFrame, key: str, score: str, vector: str, k: int, seed: int = 7, shortlist: int = 6) -> DataFrame:
    """(key, place, why) of k items to label: in odd places the most uncertain one of each cluster that the k * shortlist / 2
    most uncertain items fall into, in even ones others by hash; k is the feature."""
    half = (k + 1) // 2
    near = scores.orderBy(F.desc(score), key).limit(half * shortlist)
    groups = kmeans(vectors.join(F.broadcast(near.select(key)), key), key, vector, half, seed)
    heads = groups.join(near, key).withColumn("_i", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(score), key))).filter("_i = 1")
    first = heads.select(key, (F.row_number().over(Window.orderBy(F.desc(score), key)) * 2 - 1).alias("place"), F.lit("uncertain").alias("why"))
    rest = scores.join(F.broadcast(first.select(key)), key, "left_anti").withColumn("_h", F.xxhash64(key, F.lit(seed))).orderBy("_h", key).limit(k - half)
    other = rest.select(key, (F.row_number().over(Window.orderBy("_h", key)) * 2).alias("place"), F.lit("random").alias("why"))
    return first.unionByName(other)


def tfidf_baseline(texts: DataFrame, key: str, text: str, label: str, train: Column, width: int = 1 << 14) -> DataFrame:
    """(key, label, train, p) of a flat model of hashed words: weights by rarity, one logistic regression on the train rows."""
    words = RegexTokenizer(inputCol="_text", outputCol="_w", pattern=r"[^\p{L}]+").transform(texts.select(key, F.coalesce(text, F.lit("")).alias("_text"), c(label).cast("double").alias(label), train.alias("train")))
    counted = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=width).transform(words).drop("_w", "_text")
    rare = IDF(inputCol="_tf", outputCol="_x").fit(counted.filter("train")).transform(counted)
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.01, maxIter=20).fit(rare.filter(c("train") & c(label).isNotNull()))
    return model.transform(rare).select(key, label, "train", vector_to_array("probability")[1].alias("p"))
