"""Labels of a tree: closing, changing and scoring them; classifiers of its nodes; invariants; tiles; resampled intervals.

A node is a path of names joined by '/', its parent the path without the last name. Nulls and empty paths are no label.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .claims import prefixes

c = F.col
_PARENT = r"(^|/)[^/]*$"


def parent_of(path: Column) -> Column:
    """A path's parent, null for a root."""
    return F.nullif(F.regexp_replace(path, _PARENT, ""), F.lit(""))


def close_labels(labels: DataFrame, key: str, path: str) -> DataFrame:
    """The labels with all their ancestors, each once."""
    return labels.filter(F.length(path) > 0).select(key, F.explode(prefixes(c(path))).alias(path)).distinct()


def open_labels(labels: DataFrame, removed: DataFrame, key: str, path: str) -> DataFrame:
    """Closed labels without the removed ones and all below them: a removed label's row goes to each label of its key, and
    keys have few."""
    gone = removed.select(key, c(path).alias("_gone")).distinct()
    hit = labels.join(gone, key).filter((c(path) == c("_gone")) | c(path).startswith(F.concat("_gone", F.lit("/"))))
    return labels.join(hit.select(key, path).distinct(), [key, path], "left_anti")


def inconsistent(labels: DataFrame, key: str, path: str) -> DataFrame:
    """(key, path) of labels whose parent is not labelled."""
    children = labels.select(key, path, parent_of(c(path)).alias("_up")).filter("_up is not null")
    held = labels.select(key, c(path).alias("_up"))
    return children.join(held, [key, "_up"], "left_anti").select(key, path)


def merge_nodes(labels: DataFrame, key: str, path: str, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Labels after leaf source became target, closed again, and (key, reason) of the items to look at once more: those
    that keep source's parent without any label below it. The old ancestors stay, for they were true before."""
    if target == source or target.startswith(f"{source}/"):
        raise ValueError("a node can't become itself or one below it")
    ups = [target[:i] for i in range(len(target)) if target[i] == "/"] + [target]
    moved = labels.filter(c(path) == source).select(key, F.explode(F.array(*map(F.lit, ups))).alias(path))
    after = labels.filter(c(path) != source).select(key, path).unionByName(moved).distinct()
    up = source.rpartition("/")[0]
    touched = labels.filter(c(path) == source).select(key).distinct()
    kept = after.join(touched, key, "left_semi").groupBy(key).agg(F.bool_or(c(path) == up).alias("_up"), F.bool_or(c(path).startswith(f"{up}/")).alias("_below"))
    flagged = kept.filter(c("_up") & ~c("_below")).select(key, F.lit(f"merged:{source}->{target}").alias("reason"))
    return after, flagged


def split_node(labels: DataFrame, key: str, path: str, node: str) -> DataFrame:
    """(key, reason) of the items to look at once more when node gets finer children: those with no label below it, for
    which the answer could change. Labels stay."""
    own = labels.groupBy(key).agg(F.bool_or(c(path) == node).alias("_on"), F.bool_or(c(path).startswith(f"{node}/")).alias("_below"))
    return own.filter(c("_on") & ~c("_below")).select(key, F.lit(f"split:{node}").alias("reason"))


def move_node(labels: DataFrame, key: str, path: str, node: str, parent: str) -> DataFrame:
    """Labels after node and all below it went under parent, closed again; the old ancestors stay."""
    if parent == node or parent.startswith(f"{node}/"):
        raise ValueError("a node can't go under itself")
    at = f"{parent}/{node.rpartition('/')[2]}"
    inside = (c(path) == node) | c(path).startswith(f"{node}/")
    renamed = F.when(inside, F.concat(F.lit(at), F.substring(c(path), F.lit(len(node) + 1), F.length(path)))).otherwise(c(path))
    return close_labels(labels.select(key, renamed.alias(path)), key, path)


def retire_node(labels: DataFrame, key: str, path: str, node: str) -> DataFrame:
    """Labels without node and all below it."""
    return labels.filter((c(path) != node) & ~c(path).startswith(f"{node}/")).select(key, path)


def tree_depths(edges: DataFrame, node: str, parent: str, most: int = 32) -> DataFrame:
    """(node, depth, leaf) of a tree given by parent pointers, roots at depth 1: one join for each level, until a level is
    empty. Nodes on a cycle or below a missing parent have no depth and no row; deeper than most is an error."""
    level = edges.filter(c(parent).isNull()).select(node, F.lit(1).alias("depth"))
    found, reached = level, 1
    while not level.isEmpty():
        reached += 1
        if reached > most + 1:
            raise ValueError(f"deeper than {most} levels")
        level = edges.join(level.select(c(node).alias(parent)), parent).select(node, F.lit(reached).alias("depth"))
        found = found.unionByName(level)
    parents = edges.select(c(parent).alias(node), F.lit(False).alias("_leaf")).filter(c(node).isNotNull()).distinct()
    return found.join(parents, node, "left").select(node, "depth", F.coalesce("_leaf", F.lit(True)).alias("leaf"))


def marginals(conditional: DataFrame, key: str, path: str, p: str, slope: Mapping[int, float], shift: Mapping[int, float]) -> DataFrame:
    """(key, path, marginal) of P(node | parent): the product down from the root, then its logit times slope plus shift of
    its depth, and no more than any ancestor's. A node whose ancestors are not all given has none."""
    depth = F.size(F.split(path, "/"))
    nodes = conditional.filter(F.length(path) > 0).select(key, path, c(p).alias("_p"))
    ups = nodes.select(key, path, F.explode(prefixes(c(path))).alias("_up"))
    met = ups.join(nodes.select(key, c(path).alias("_up"), "_p"), [key, "_up"])
    product = met.groupBy(key, path).agg(F.count(F.lit(1)).alias("_n"), F.exp(F.sum(F.ln(F.greatest("_p", F.lit(1e-12))))).alias("_m")).filter(c("_n") == depth)
    at = lambda table, other: F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[depth], F.lit(other)) if table else F.lit(other)
    m = F.least(F.greatest("_m", F.lit(1e-12)), F.lit(1 - 1e-12))
    logit = F.ln(m / (1 - m)) * at(slope, 1.0) + at(shift, 0.0)
    fitted = product.select(key, path, (1 / (1 + F.exp(-logit))).alias("_m"))
    above = fitted.select(key, path, F.explode(prefixes(c(path))).alias("_up")).join(fitted.select(key, c(path).alias("_up"), "_m"), [key, "_up"])
    return above.groupBy(key, path).agg(F.min("_m").alias("marginal"))


def decode(marginal: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, path, marginal) at or above the threshold; marginals never rise downwards, so the set is closed."""
    return marginal.filter(c("marginal") >= threshold)


def confidence(marginal: DataFrame, key: str) -> DataFrame:
    """(key, confidence): how far each item's least certain node is from even, 0.5 to 1."""
    return marginal.groupBy(key).agg(F.min(F.greatest("marginal", 1 - c("marginal"))).alias("confidence"))


def top_candidates(probabilities: DataFrame, key: str, node: str, p: str, floor: float, k: int) -> DataFrame:
    """Each item's k likeliest nodes of at least floor, ties by node."""
    order = Window.partitionBy(key).orderBy(F.desc(p), node)
    return probabilities.filter(c(p) >= floor).withColumn("place", F.row_number().over(order)).filter(c("place") <= k)


def labels_to_reach(curves: DataFrame, name: str, n: str, score: str, targets: DataFrame, target: str) -> DataFrame:
    """(name, target, needed): where each curve first reaches each target, between its points in a straight line; null if
    it never does."""
    w = Window.partitionBy(name).orderBy(n)
    steps = curves.withColumn("_n", F.lag(n).over(w)).withColumn("_s", F.lag(score).over(w))
    met = steps.crossJoin(F.broadcast(targets))  # the few targets asked for
    at = F.when(c("_n").isNull(), c(n).cast("double")).otherwise(c("_n") + (c(n) - c("_n")) * (c(target) - c("_s")) / (c(score) - c("_s")))
    return met.groupBy(name, target).agg(F.min_by(F.when(c(score) >= c(target), at), F.when(c(score) >= c(target), c(n))).alias("needed"))


def promotion_gate(candidates: DataFrame, active: DataFrame, drop: float) -> DataFrame:
    """candidates (model, version, score) with baseline, passed and reason against the one active row, if any: first model,
    version changed, ok, or fell."""
    one = active.select(c("model").alias("baseline"), c("version").alias("_v"), c("score").alias("_s")).limit(1)
    met = candidates.join(F.broadcast(one), F.lit(True), "left")
    reason = F.when(c("baseline").isNull(), "first model").when(c("version") != c("_v"), "version changed").when(c("score") >= c("_s") - drop, "ok").otherwise("fell")
    return met.withColumn("reason", reason).withColumn("passed", c("reason") != "fell").drop("_v", "_s")


def weakest_nodes(metrics: DataFrame, support: str, score: str, least: int, n: int, tie: str) -> DataFrame:
    """The n supported nodes with the lowest score; a report."""
    return metrics.filter(c(support) >= least).orderBy(score, tie).limit(n)


def labelled_set(annotations: DataFrame, items: DataFrame, vectors: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(key, labels, vector) of items with an annotation and a vector: labels become a sorted set before they meet the wide
    vectors."""
    sets = annotations.filter(c(label).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("labels"))
    return sets.join(items.select(key), key, "left_semi").join(vectors.select(key, vector), key)


# Classifiers of nodes


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 30) -> np.ndarray:
    """Newton steps of a logistic regression with an unpenalised constant in front."""
    wide = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(wide.shape[1]), np.diag([1e-9] + [penalty] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(wide @ w, -30, 30)))
        step = np.linalg.solve(wide.T @ (wide * (p * (1 - p))[:, None]) + ridge, wide.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_node_classifiers(vectors: DataFrame, labels: DataFrame, nodes: DataFrame, key: str, vector: str, path: str, most: int = 20_000, penalty: float = 1 / 30) -> DataFrame:
    """(path, weights, n, positives): for each node a logistic regression of P(node | parent) on the items with its parent
    (all items for a root), the constant first; where there is no contrast only a constant, the smoothed share. A node
    learns from at most `most` items by hash of the key, the documented bound of its sample; counts n and positives are of
    the whole. labels must be closed; a node whose parent nobody has gets no model."""
    tree = nodes.select(path, parent_of(c(path)).alias("_up"))
    everyone = vectors.select(key, F.lit("").alias("_up"))
    held = labels.select(key, c(path).alias("_up")).unionByName(everyone)
    asked = held.join(F.broadcast(tree.select(path, F.coalesce("_up", F.lit("")).alias("_up"))), "_up").select(key, path)
    marked = asked.join(labels.select(key, path, F.lit(1).alias("_y")), [key, path], "left").fillna(0, ["_y"])
    counts = marked.groupBy(path).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("positives"))
    # the threshold of a hash is known before anything is gathered: about `most` rows of a node pass it, whatever its size
    part = F.pmod(F.xxhash64(key), F.lit(1_000_000)) < F.ceil(F.lit(1_000_000.0) * most / c("n"))
    drawn = marked.join(F.broadcast(counts), path).filter(part).join(vectors.select(key, c(vector).cast("array<double>").alias("_x")), key)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_order")
        y, n, positives = frame["_y"].to_numpy(float), int(frame["n"].iloc[0]), int(frame["positives"].iloc[0])
        share = (positives + 0.5) / (n + 1)
        flat = np.concatenate([[np.log(share / (1 - share))], np.zeros(len(frame["_x"].iloc[0]))])
        w = _logistic(np.vstack(frame["_x"].to_list()), y, penalty) if 0 < y.sum() < len(y) else flat
        return pd.DataFrame({path: [frame[path].iloc[0]], "weights": [w.tolist()], "n": [n], "positives": [positives]})

    return drawn.withColumn("_order", F.xxhash64(key)).groupBy(path).applyInPandas(fit, f"{path} string, weights array<double>, n long, positives long")


def node_probabilities(vectors: DataFrame, models: DataFrame, key: str, vector: str, path: str) -> DataFrame:
    """(key, path, p): P(node | parent) of every item and node; models are as many as the tree has nodes."""
    wide = F.concat(F.array(F.lit(1.0)), c(vector).cast("array<double>"))
    dot = F.aggregate(F.zip_with("_x", "weights", lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return vectors.select(key, wide.alias("_x")).crossJoin(F.broadcast(models.select(path, "weights"))).select(key, path, (1 / (1 + F.exp(-dot))).alias("p"))


# Invariants


def discover_invariants(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(property, verdict): templates of every table and pair of tables, held or violated; one that nothing could break is
    left out. One aggregation for each table gives not_null, unique, non_negative and a <= b of its columns; columns of the
    same name in two tables give subset (an anti-join of distinct values) and equal row counts."""
    spark = next(iter(tables.values())).sparkSession
    found = []

    def told(name: str, broken, known) -> None:
        if known:
            found.append((name, "violated" if broken else "held"))

    rows, kinds = {}, {}
    for t, df in tables.items():
        kinds[t] = {f.name: "num" if f.dataType.typeName() in ("integer", "long", "double", "float") else f.dataType.typeName() for f in df.schema.fields if f.dataType.typeName() not in ("array", "struct", "map")}
        numbers = sorted(x for x, k in kinds[t].items() if k == "num")
        aggs = [F.count(F.lit(1)).alias("_n")]
        for x in kinds[t]:
            aggs += [F.count(x).alias(f"known {x}"), F.countDistinct(x).alias(f"distinct {x}")]
        aggs += [F.count_if(c(x) < 0).alias(f"negative {x}") for x in numbers]
        aggs += [F.count_if(c(a) > c(b)).alias(f"over {a} {b}") for a in numbers for b in numbers if a != b]
        aggs += [F.count_if(c(a) <= c(b)).alias(f"under {a} {b}") for a in numbers for b in numbers if a != b]
        one = df.agg(*aggs).first().asDict()  # one row of counts
        rows[t] = one["_n"]
        for x in kinds[t]:
            told(f"not_null({t}.{x})", one[f"known {x}"] < rows[t], rows[t])
            told(f"unique({t}.{x})", one[f"distinct {x}"] < one[f"known {x}"], one[f"known {x}"])
        for x in numbers:
            told(f"non_negative({t}.{x})", one[f"negative {x}"], one[f"known {x}"])
        for a in numbers:
            for b in numbers:
                if a != b:
                    told(f"le({t}.{a},{t}.{b})", one[f"over {a} {b}"], one[f"over {a} {b}"] + one[f"under {a} {b}"])
    for t in tables:
        for u in tables:
            if t == u:
                continue
            if t < u:
                told(f"row_count_eq({t},{u})", rows[t] != rows[u], rows[t] + rows[u])
            for x in sorted(set(kinds[t]) & set(kinds[u])):
                if kinds[t][x] == kinds[u][x]:
                    mine = tables[t].select(x).filter(c(x).isNotNull()).distinct()
                    told(f"subset({t}.{x},{u}.{x})", not mine.join(tables[u].select(x), x, "left_anti").isEmpty(), not mine.isEmpty())
    return spark.createDataFrame(found, "property string, verdict string")


def property_tally(outcomes: DataFrame, name: str, verdict: str, known_bugs: Sequence[str]) -> DataFrame:
    """(name, held, violated, vacuous, confidence, gate): confidence is the rule of three for a property never violated in
    n runs, 1 - 3 / n and at least 0; gate tells violations nobody knows of (unexpected) and known bugs that hold (stale)."""
    n = lambda v: F.count_if(c(verdict) == v)
    told = outcomes.groupBy(name).agg(n("held").alias("held"), n("violated").alias("violated"), n("vacuous").alias("vacuous"))
    known = c(name).isin(list(known_bugs)) if known_bugs else F.lit(False)
    sure = F.when((c("violated") == 0) & (c("held") > 0), F.greatest(F.lit(0.0), 1 - 3 / c("held")))
    return told.withColumn("confidence", sure).withColumn("gate", F.when((c("violated") > 0) & ~known, "unexpected").when((c("violated") == 0) & (c("held") > 0) & known, "stale").otherwise("ok"))


# Tiles


def tile_pyramid(points: DataFrame, key: str, x: Column, y: Column, priority: Column, capacity: int, most: int) -> DataFrame:
    """(key, z, tx, ty) of points with x and y in [0, 1), others left out: each tile keeps its first capacity points by
    priority, ties by key, and hands the rest down a level; the last level keeps all. A tile's last kept point is found
    from the firsts of every task, so no task holds the whole of a crowded tile; these cuts, a row for each full tile, are
    written, and a level is one filter over the points."""
    spark, ahead = points.sparkSession, F.struct("_order", key)
    left = points.select(key, x.alias("_x"), y.alias("_y"), priority.alias("_order")).filter("_x >= 0 and _x < 1 and _y >= 0 and _y < 1")
    out = None
    for z in range(most + 1):
        side = 1 << z
        tile = left.withColumn("tx", F.floor(c("_x") * side).cast("long")).withColumn("ty", F.floor(c("_y") * side).cast("long"))
        if z < most:
            first = tile.withColumn("_place", F.row_number().over(Window.partitionBy("tx", "ty").orderBy("_order", key))).filter(c("_place") <= capacity)
            path = scratch(spark)
            first.groupBy("tx", "ty").agg(F.max(ahead).alias("_cut"), F.count(F.lit(1)).alias("_n")).filter(c("_n") == capacity).drop("_n").write.parquet(path)
            tile = tile.join(spark.read.parquet(path), ["tx", "ty"], "left")
            kept, left = tile.filter(c("_cut").isNull() | (ahead <= c("_cut"))), tile.filter(ahead > c("_cut")).select(key, "_x", "_y", "_order")
        else:
            kept = tile
        level = kept.select(key, F.lit(z).alias("z"), "tx", "ty")
        out = level if out is None else out.unionByName(level)
    return out


# Resampling


def bootstrap_mean_difference(df: DataFrame, key: str, treated: Column, outcome: Column, rounds: int, share: float = 0.95) -> DataFrame:
    """(estimate, low, high): the difference of means and the range of its resampled values. Each row's weight in a round is
    a Poisson(1) draw from a hash of (key, round), so rows need no round of sampling together; only sums by round are
    shuffled. Poisson weights stand for a multinomial draw."""
    steps = np.cumsum([np.exp(-1.0) / m for m in np.cumprod([1.0, *range(1, 12)])])  # P(at most 0, 1, ... )
    rows = df.select(key, treated.cast("boolean").alias("_t"), outcome.cast("double").alias("_y")).filter("_t is not null and _y is not null")
    drawn = rows.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    u = F.pmod(F.xxhash64(key, "_round"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    weight = F.when(c("_round") == 0, F.lit(1)).otherwise(sum((u >= float(s)).cast("int") for s in steps))
    mean = lambda t: F.try_divide(F.sum(F.when(c("_t") == t, c("_w") * c("_y"))), F.sum(F.when(c("_t") == t, c("_w"))))
    means = drawn.withColumn("_w", weight).groupBy("_round").agg((mean(True) - mean(False)).alias("_d"))
    tail = (1 - share) / 2
    again = F.when(c("_round") > 0, c("_d"))
    return means.agg(F.max(F.when(c("_round") == 0, c("_d"))).alias("estimate"), F.percentile(again, F.lit(tail)).alias("low"), F.percentile(again, F.lit(1 - tail)).alias("high"))
