"""Claims about standings, experiments and labels. Nulls in a measured column make no claim; ties are told in each docstring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered, running

c = F.col
#: Rungs of a claim in per mille.
LADDER = (1, 5, 10, 20, 30, 50, 100, 150, 200, 250)


def cutpoints(df: DataFrame, value: str, cuts: Sequence[float], k: int) -> DataFrame:
    """(cut, n, at_or_above): how many rows lie from each cut to the next, and at or above it, where at least k do.
    Rows below the first cut belong to none."""
    ladder = F.array(*(F.lit(float(x)) for x in sorted(cuts)))
    at = F.array_max(F.filter(ladder, lambda x: x <= c(value)))
    counts = df.select(at.alias("cut")).filter("cut is not null").groupBy("cut").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.createDataFrame([(float(x),) for x in sorted(cuts)], "cut double").join(counts, "cut", "left").fillna(0, ["n"])
    return running(every, "sum", c("n"), "at_or_above", F.desc("cut")).filter(c("at_or_above") >= k)


def claim_permille(at_or_above: Column, population: Column) -> Column:
    """The smallest rung r with at_or_above <= r per mille of the population, in whole numbers; null if none holds."""
    return F.array_min(F.filter(F.array(*(F.lit(r) for r in LADDER)), lambda r: at_or_above * 1000 <= population * r))


def audit_claims(claims: DataFrame, exact: DataFrame, key: str, k: int) -> DataFrame:
    """(key, violation) of claims (key, permille) against exact (key, at_or_above, population): false, not the smallest
    rung that holds, of fewer than k, or about nobody known."""
    met = claims.join(exact, key, "left").withColumn("_best", claim_permille(c("at_or_above"), c("population")))
    kinds = [
        ("unknown", c("population").isNull()),
        ("false", c("at_or_above") * 1000 > c("population") * c("permille")),
        ("too_small", c("at_or_above") < k),
        ("not_reproducible", c("_best").isNull() | (c("_best") != c("permille"))),
    ]
    return met.select(key, F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(n)) for n, bad in kinds)))).alias("violation"))


def select_story(candidates: DataFrame, owner: str, family: str, score: str, tie: str, caps: dict[str, int], n: int) -> DataFrame:
    """Each owner's n best candidates, at most caps[family] (else one) of a family; place 1 is shown first, the best last."""
    best = Window.partitionBy(owner, family).orderBy(F.desc(score), tie)
    cap = F.coalesce(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv))[c(family)], F.lit(1)) if caps else F.lit(1)
    held = candidates.withColumn("_in", F.row_number().over(best)).filter(c("_in") <= cap)
    ranked = held.withColumn("_rank", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(score), tie))).filter(c("_rank") <= n)
    return ranked.withColumn("place", F.count(F.lit(1)).over(Window.partitionBy(owner)) - c("_rank") + 1).drop("_in", "_rank")


def uplift_deciles(units: DataFrame, score: Column, tie: str, treated: Column, outcome: Column, bins: int = 10) -> DataFrame:
    """Bins of equal size by the rank of a score, 1 the highest (ties by tie): units and successes of both arms, their
    difference and its 95 % interval."""
    ranked = numbered(units.withColumn("_score", score), "_place", F.desc("_score"), c(tie))
    at = (F.floor((c("_place") - 1) * bins / F.lit(max(1, units.count()))) + 1).cast("long").alias("bin")
    sums = ranked.groupBy(at).agg(F.count_if(treated).alias("n_treated"), F.count_if(~treated).alias("n_control"), F.count_if(treated & outcome).alias("k_treated"), F.count_if(~treated & outcome).alias("k_control"))
    p, q = F.try_divide("k_treated", "n_treated"), F.try_divide("k_control", "n_control")
    error = F.sqrt(F.try_divide(p * (1 - p), c("n_treated")) + F.try_divide(q * (1 - q), c("n_control")))
    return sums.withColumn("uplift", F.round(p - q, 6)).withColumn("low", F.round(p - q - 1.96 * error, 6)).withColumn("high", F.round(p - q + 1.96 * error, 6))


def qini_points(units: DataFrame, score: Column, tie: str, treated: Column, outcome: Column) -> DataFrame:
    """The Qini curve, a point for each unit from the highest score down: (place, qini)."""
    rows = units.select(score.alias("_score"), c(tie).alias("_tie"), *(F.when(x, 1).otherwise(0).cast("long").alias(n) for n, x in (("_t", treated), ("_kt", treated & outcome), ("_c", ~treated), ("_kc", ~treated & outcome))))
    order = (F.desc("_score"), c("_tie"))
    for n in ("_t", "_kt", "_c", "_kc"):
        rows = running(rows, "sum", c(n), f"s{n}", *order)
    gain = c("s_kt") - c("s_kc") * F.coalesce(F.try_divide("s_t", "s_c"), F.lit(0.0))
    return rows.select((c("s_t") + c("s_c")).alias("place"), gain.alias("qini"))


def area_over_random(curve: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the area between a curve from (0, 0) on and the line to its end, both axes scaled to the last point's
    place; trapezoids between neighbours, which meet through a shifted join on the place, not in one window."""
    n, end = curve.agg(F.max(x), F.max_by(y, x)).first()
    before = curve.select((c(x) + 1).alias(x), c(y).alias("_y"))
    steps = curve.join(before, x, "left").select(((c(y) + F.coalesce("_y", F.lit(0.0))) / 2).alias("_area"))
    return steps.agg(F.round(F.sum("_area") / F.lit(n) - F.lit(end) / 2, 6).alias("area"))


def curve_points(curve: DataFrame, x: str, n: int) -> DataFrame:
    """At most n points of a curve with places 1, 2, ..: the first, the last and evenly spaced ones between."""
    last = curve.agg(F.max(x)).first()[0] or 0
    wanted = curve.sparkSession.range(n).select((1 + F.round(c("id") * (last - 1) / F.lit(max(1, n - 1)))).cast("long").alias(x)).distinct()
    return curve.join(F.broadcast(wanted), x)  # n rows


def diff_in_means(df: DataFrame, treated: Column, outcome: str, *by: str) -> DataFrame:
    """Difference of the arms' means with a 95 % interval, for each group."""
    side = lambda f, t: f(F.when(t, c(outcome)))
    sums = df.groupBy(*by).agg(*(side(f, t).alias(f"_{n}{k}") for k, t in (("t", treated), ("c", ~treated)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    diff, error = c("_mt") - c("_mc"), F.sqrt(c("_vt") / c("_nt") + c("_vc") / c("_nc"))
    return sums.select(*by, F.round(diff, 6).alias("diff"), F.round(diff - 1.96 * error, 6).alias("low"), F.round(diff + 1.96 * error, 6).alias("high"))


def policy_size(scores: DataFrame, uplift: str, budget: float, cost: float, value: float) -> DataFrame:
    """One row: how many units are worth treating, affordable and available, and the least of these."""
    sums = scores.agg(F.count_if(c(uplift) > F.lit(cost / value)).alias("worthwhile"), F.count(F.lit(1)).alias("available"))
    return sums.withColumn("affordable", F.lit(int(budget // cost)).cast("long")).withColumn("size", F.least("worthwhile", "available", "affordable"))


def traits(df: DataFrame, member: Column, levels: Sequence[str], n: int = 8) -> DataFrame:
    """The n levels that a group has more or less often than all rows: (feature, level, share_group, share_all)."""
    each = df.select(F.when(member, 1).otherwise(0).alias("_in"), F.explode(F.array(*(F.struct(F.lit(x).alias("feature"), F.coalesce(c(x).cast("string"), F.lit("unknown")).alias("level")) for x in levels))).alias("x")).select("_in", "x.*")
    counts = each.groupBy("feature", "level").agg(F.sum("_in").alias("_k"), F.count(F.lit(1)).alias("_n"))
    group, every = df.agg(F.count_if(member), F.count(F.lit(1))).first()
    shares = counts.select("feature", "level", F.round(F.try_divide(c("_k"), F.lit(group)), 6).alias("share_group"), F.round(c("_n") / F.lit(every), 6).alias("share_all"))
    return shares.orderBy(F.desc(F.round(F.abs(c("share_group") - c("share_all")), 6)), "feature", "level").limit(n)


def balance(df: DataFrame, treated: Column, columns: Sequence[str], share: float) -> DataFrame:
    """A row for each covariate: standardised mean difference, and the arms' chi-square against the planned share."""
    sides = [("t", treated), ("c", ~treated)]
    sums = df.agg(F.count_if(treated).alias("n_t"), F.count_if(~treated).alias("n_c"), *(f(F.when(t, c(x))).alias(f"{x}_{n}_{k}") for x in columns for k, t in sides for n, f in (("m", F.avg), ("v", F.var_samp))))
    total = c("n_t") + c("n_c")
    chi = F.pow(c("n_t") - total * share, 2) / (total * share) + F.pow(c("n_c") - total * (1 - share), 2) / (total * (1 - share))
    rows = [F.struct(F.lit(x).alias("covariate"), F.round((c(f"{x}_m_t") - c(f"{x}_m_c")) / F.sqrt((c(f"{x}_v_t") + c(f"{x}_v_c")) / 2), 6).alias("smd"), F.round(chi, 6).alias("chi_square")) for x in columns]
    return sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def prefixes(path: Column) -> Column:
    """The paths of a slash-separated path's nodes, from the root down."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def build_taxonomy(labels: DataFrame, path: str, least: int) -> DataFrame:
    """(node, depth, support): nodes whose subtree has at least so many rows. Support falls from a parent to its child,
    so a kept node's parents are kept."""
    counts = labels.filter(c(path).isNotNull()).groupBy(path).agg(F.count(F.lit(1)).alias("_n"))
    nodes = counts.select(F.explode(prefixes(c(path))).alias("node"), "_n").groupBy("node").agg(F.sum("_n").alias("support"))
    return nodes.filter(c("support") >= least).select("node", F.size(F.split("node", "/")).alias("depth"), "support")


def effective_label(labels: DataFrame, key: str, path: str, nodes: DataFrame) -> DataFrame:
    """(key, node): the longest prefix of a row's path that is a known node; none where no prefix is."""
    each = labels.select(key, F.posexplode(prefixes(c(path))).alias("_depth", "node"))
    return each.join(nodes.select("node").distinct(), "node").groupBy(key).agg(F.max_by("node", "_depth").alias("node"))


def hierarchical_f1(truth: DataFrame, found: DataFrame, key: str, path: str) -> DataFrame:
    """(depth, tp, fp, fn, f1): labels with all their ancestors, true and predicted, compared at each depth."""
    long = lambda df, n: df.select(key, F.explode(prefixes(c(path))).alias("node")).distinct().withColumn(n, F.lit(True))
    both = long(truth, "_t").join(long(found, "_p"), [key, "node"], "full").withColumn("depth", F.size(F.split("node", "/")))
    sums = both.groupBy("depth").agg(F.count_if(c("_t") & c("_p")).alias("tp"), F.count_if(c("_t").isNull()).alias("fp"), F.count_if(c("_p").isNull()).alias("fn"))
    return sums.withColumn("f1", F.round(2 * c("tp") / (2 * c("tp") + c("fp") + c("fn")), 6))


def uncertainty(probabilities: DataFrame, key: str, p: str) -> DataFrame:
    """(key, uncertainty, entropy) of an item's node probabilities: the most undecided node, and the sum in bits."""
    h = lambda x: F.when((x > 0) & (x < 1), -(x * F.log2(x) + (1 - x) * F.log2(1 - x))).otherwise(0.0)
    return probabilities.groupBy(key).agg(F.round(F.max(1 - F.abs(2 * c(p) - 1)), 6).alias("uncertainty"), F.round(F.sum(h(c(p))), 6).alias("entropy"))


def story_cards(stories: DataFrame, key: str, cards: str) -> DataFrame:
    """(key, position, card): a row for each card of each story, in order from 0; a story without cards has none."""
    return stories.select(key, F.posexplode(cards).alias("position", "card"))


#: Probabilities are held this far from 0 and 1 before their logarithm.
EPS = 1e-6


def tree_uncertainty(conditional: DataFrame, key: str, path: str, p: str) -> DataFrame:
    """(key, uncertainty, entropy) of an item's decisions in a tree. conditional: (key, path, p), the probability of a node
    given its parent, paths with /. A node counts by its reach, the probability of its parent: the least certain reachable
    decision (a maximum, so a node with many children isn't more uncertain for it), and the entropy of the whole tree in
    nats. A node whose ancestors aren't all given is reached by those that are; null probabilities count for nothing."""
    held = conditional.filter(c(p).isNotNull()).select(c(key).alias("key"), c(path).alias("path"), c(p).cast("double").alias("p"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asked = held.filter(F.size(parts) > 1).select("key", "path", F.explode(above).alias("above"))
    known = held.select("key", c("path").alias("above"), c("p").alias("q"))
    reach = asked.join(known, ["key", "above"]).groupBy("key", "path").agg(F.when(F.min("q") <= 0, 0.0).otherwise(F.exp(F.sum(F.ln(F.greatest("q", F.lit(1e-300)))))).alias("reach"))
    told = held.join(reach, ["key", "path"], "left").withColumn("reach", F.coalesce("reach", F.lit(1.0))).withColumn("near", F.least(F.lit(1 - EPS), F.greatest(F.lit(EPS), "p")))
    h = -(c("near") * F.ln("near") + (1 - c("near")) * F.ln(1 - c("near")))
    return told.groupBy("key").agg(F.max(c("reach") * (1 - F.abs(2 * c("p") - 1))).alias("uncertainty"), F.sum(c("reach") * h).alias("entropy")).withColumnRenamed("key", key)
