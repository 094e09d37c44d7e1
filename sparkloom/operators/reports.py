"""Views, marts, gates and summaries. Each docstring tells what nulls, ties and empty tables give; every row of an input
takes part, and only what is called a limit limits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nearest import candidates
from .ranks import numbered

c = F.col


def clean_static(df: DataFrame, texts: Sequence[str], sums: Mapping[str, tuple[str, str, float, float]]) -> DataFrame:
    """df with blank texts null, others trimmed, and each sum (a, b, low, high) = a + b where it lies in its bounds, else null."""
    out = df.withColumns({t: F.nullif(F.trim(t), F.lit("")) for t in texts})
    return out.withColumns({n: F.when((c(a) + c(b)).between(low, high), c(a) + c(b)) for n, (a, b, low, high) in sums.items()})


def consistency_rows(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(key, rule) of every rule that a row breaks; one that is null is broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items())))
    return df.select(key, F.explode(broken).alias("rule"))


def live_view(latest: DataFrame, lat: str, lon: str, ts: str, box: tuple[float, float, float, float], seconds: int, limit: int, tie: str) -> DataFrame:
    """The newest rows, at most limit, inside box (south, west, north, east) and no older than seconds before the newest
    moment in the data, not the clock's. Rows without place or time are never in view."""
    south, west, north, east = box
    newest = F.broadcast(latest.agg(F.max(ts).alias("_newest")))  # one row
    fresh = latest.crossJoin(newest).withColumn("age_seconds", F.unix_micros(c("_newest").cast("timestamp")) / 1e6 - F.unix_micros(c(ts).cast("timestamp")) / 1e6)
    seen = fresh.filter(c(lat).between(south, north) & c(lon).between(west, east) & (c("age_seconds") <= seconds)).drop("_newest")
    return seen.orderBy("age_seconds", tie).limit(limit)


def trails(view: DataFrame, reports: DataFrame, key: str, ts: str, minutes: int) -> DataFrame:
    """The reports of each thing in view from minutes before its own newest one on. The view is capped by its limit, so it
    goes to the reports."""
    ends = view.select(key, c(ts).alias("_end")).dropDuplicates([key])
    return reports.join(F.broadcast(ends), key).filter((c(ts) <= c("_end")) & (c(ts) >= c("_end") - F.expr(f"INTERVAL {minutes} MINUTES"))).drop("_end")


def filter_categories(df: DataFrame, wanted: Mapping[str, Sequence[str]], known: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows whose every column holds one of its wanted labels; a label that isn't known for its column is an error."""
    for column, labels in wanted.items():
        if strange := sorted(set(labels) - set(known[column])):
            raise ValueError(f"unknown {column}: {', '.join(strange)}")
    return reduce(lambda d, kv: d.filter(c(kv[0]).isin(list(kv[1]))), wanted.items(), df)


def medians(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: each column's median over train, nulls left out."""
    return train.agg(*(F.percentile(x, F.lit(0.5)).alias(x) for x in columns))


def featurize(df: DataFrame, middles: DataFrame, numbers: Sequence[str], levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """df with nulls of the numbers filled by the training medians and a 0/1 column for each known level; a level not known
    is 0 everywhere."""
    met = df.crossJoin(F.broadcast(middles.select(*(c(x).alias(f"_mid_{x}") for x in numbers))))
    full = met.withColumns({x: F.coalesce(c(x), c(f"_mid_{x}")) for x in numbers}).drop(*(f"_mid_{x}" for x in numbers))
    flags = {f"{x}={v}": F.coalesce((c(x) == v).cast("int"), F.lit(0)) for x, vs in levels.items() for v in vs}
    return full.withColumns(flags)


def attach_detail(df: DataFrame, columns: Sequence[str], out: str = "detail") -> DataFrame:
    """df with the columns as one JSON text, nulls left out."""
    return df.withColumn(out, F.to_json(F.struct(*columns)))


def assemble_mart(key: str, *parts: DataFrame) -> DataFrame:
    """The parts side by side for every key that all of them have."""
    return reduce(lambda a, b: a.join(b, key, "inner"), parts)


def entity_card(things: DataFrame, facts: DataFrame, key: str, ts: str, tie: str, *state: str) -> DataFrame:
    """Each thing beside its newest fact's state and its number of facts (0 and nulls without any); facts are aggregated
    before they meet the things."""
    newest = F.max_by(F.struct(*state), F.struct(ts, tie)).alias("_state")
    told = facts.groupBy(key).agg(newest, F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("n_facts"))
    return things.join(told.select(key, "_state.*", "last_seen", "n_facts"), key, "left").fillna(0, ["n_facts"])


def knn_2d(points: DataFrame, queries: DataFrame, key: str, x: str, y: str, k: int) -> DataFrame:
    """Exact nearest neighbours in the plane, self excluded, ties by key. queries may be all points; they meet in blocks and
    each pair of blocks keeps its best k before anything is shuffled."""
    place = F.array(c(x).cast("double"), c(y).cast("double"))
    near = candidates(points, queries, key, place, k, cosine=False).select("query_id", "neighbour_id", c("a").alias("squared"))
    w = Window.partitionBy("query_id").orderBy("squared", "neighbour_id")
    return near.withColumn("place", F.row_number().over(w)).filter(c("place") <= k)


def neighbour_recall(one: DataFrame, two: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(query_id, recall, purity): the share of one's neighbours that two has too, and of two's neighbours with the query's
    label; a query without neighbours in either has no row."""
    sets = lambda d, n: d.groupBy("query_id").agg(F.collect_set("neighbour_id").alias(n))
    met = sets(one, "_a").join(sets(two, "_b"), "query_id")
    mine = labels.select(c(key).alias("query_id"), c(label).alias("_mine"))
    theirs = two.join(labels.select(c(key).alias("neighbour_id"), c(label).alias("_theirs")), "neighbour_id").join(mine, "query_id")
    pure = theirs.groupBy("query_id").agg(F.avg((c("_theirs") == c("_mine")).cast("int")).alias("purity"))
    return met.select("query_id", (F.size(F.array_intersect("_a", "_b")) / F.size("_a")).alias("recall")).join(pure, "query_id")


def sale_stats(messages: DataFrame, ts: str, kind: str, counts: Mapping[str, Sequence[str]]) -> DataFrame:
    """(second, metric, n): each message counts once for every metric of its kind; other kinds count for none."""
    metrics = F.create_map(*(x for k, v in counts.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[c(kind)]
    return messages.select(F.date_trunc("second", c(ts)).alias("second"), F.explode(metrics).alias("metric")).groupBy("second", "metric").agg(F.count(F.lit(1)).alias("n"))


def feed_profile(lines: DataFrame, source: str, text: str) -> DataFrame:
    """(source, name, lines, with_name, missing, invalid): for each top-level name of a source's JSON lines how many have it,
    and how many lines can't be read; name null is a source of which none can be."""
    keys = F.json_object_keys(c(text))
    rows = lines.select(c(source).alias("source"), keys.alias("_keys"))
    whole = rows.groupBy("source").agg(F.count(F.lit(1)).alias("lines"), F.count_if(c("_keys").isNull()).alias("invalid"))
    named = rows.select("source", F.explode(F.array_distinct("_keys")).alias("name")).groupBy("source", "name").agg(F.count(F.lit(1)).alias("with_name"))
    met = whole.join(named, "source", "left").fillna(0, ["with_name"])
    return met.withColumn("missing", c("lines") - c("invalid") - c("with_name"))


def market_profile(history: DataFrame, item: str, ts: str, tie: str, price: str, spike: float) -> DataFrame:
    """(item, n, spread, mean_over_median, volatility, spikes) of prices above zero in order: range over median, the sample
    deviation of log changes (null below two of them), changes larger than spike."""
    w = Window.partitionBy(item).orderBy(ts, tie)
    told = history.filter(c(price) > 0).withColumn("_change", F.ln(price) - F.ln(F.lag(price).over(w)))
    middle = F.percentile(price, F.lit(0.5))
    return told.groupBy(item).agg(F.count(F.lit(1)).alias("n"), ((F.max(price) - F.min(price)) / middle).alias("spread"), (F.avg(price) / middle).alias("mean_over_median"), F.stddev_samp("_change").alias("volatility"), F.count_if(F.abs("_change") > spike).alias("spikes"))


def story_distribution(stories: DataFrame, cards: str) -> DataFrame:
    """(card, users, share, stories, common_share): the share of stories with each card, how many different stories there
    are (order of cards aside) and the share of the most frequent one."""
    sets = stories.select(F.array_sort(F.array_distinct(cards)).alias("_story"))
    kinds = sets.groupBy("_story").agg(F.count(F.lit(1)).alias("_n"))
    whole = kinds.agg(F.count(F.lit(1)).alias("stories"), F.sum("_n").alias("_all"), F.max("_n").alias("_most"))  # one row
    users = kinds.select(F.explode("_story").alias("card"), "_n").groupBy("card").agg(F.sum("_n").alias("users"))
    return users.crossJoin(F.broadcast(whole)).select("card", "users", (c("users") / c("_all")).alias("share"), "stories", (c("_most") / c("_all")).alias("common_share"))


def quality_counts(rows: DataFrame, source: str, reason: str, late: str) -> DataFrame:
    """(source, valid, quarantined, late, reasons): rows of each source with and without a reason, late ones, and counts by
    reason as a map text 'reason=n' in order, empty if there is none."""
    each = rows.groupBy(source, reason).agg(F.count(F.lit(1)).alias("_n"), F.count_if(c(late)).alias("_late"))
    text = F.array_join(F.array_sort(F.collect_list(F.when(c(reason).isNotNull(), F.concat(c(reason), F.lit("="), c("_n"))))), ",")
    bad = F.coalesce(F.sum(F.when(c(reason).isNotNull(), c("_n"))), F.lit(0))
    return each.groupBy(source).agg((F.sum("_n") - bad).alias("valid"), bad.alias("quarantined"), F.sum("_late").alias("late"), text.alias("reasons"))


def purchasing_power(prices: DataFrame, wages: DataFrame, period: str, item: str, basket: Mapping[int, float]) -> DataFrame:
    """(period, wage, basket_cost, hours, real_wage) of prices (period, item, price) and wages (period, wage): the cost is null
    unless every item of the basket has a price; hours = cost / wage; the real wage is in baskets of the first whole period."""
    held = F.create_map(*(F.lit(x) for kv in basket.items() for x in kv))[c(item)]
    parts = prices.select(period, item, (held * c("price")).alias("_part")).filter("_part is not null").groupBy(period).agg(F.sum("_part").alias("_sum"), F.countDistinct(item).alias("_n"))
    told = wages.join(parts, period, "left").withColumn("basket_cost", F.when(c("_n") == len(basket), c("_sum")))
    first = F.broadcast(told.agg(F.min_by(F.when(c("basket_cost").isNotNull(), c("basket_cost")), F.when(c("basket_cost").isNotNull(), c(period))).alias("_first")))
    return told.crossJoin(first).select(period, "wage", "basket_cost", (c("basket_cost") / c("wage")).alias("hours"), (c("wage") * c("_first") / c("basket_cost")).alias("real_wage"))


def lock_waits(samples: DataFrame, run: str, blocked: str, wait: str, tick: float) -> DataFrame:
    """(run, samples, most_blocked, longest, p95, blocked_seconds): a run's waits; each sample with something blocked counts
    as one tick. Nulls in blocked or wait are none."""
    return samples.groupBy(run).agg(F.count(F.lit(1)).alias("samples"), F.max(blocked).alias("most_blocked"), F.max(wait).alias("longest"), F.percentile(wait, F.lit(0.95)).alias("p95"), (F.count_if(c(blocked) > 0) * tick).alias("blocked_seconds"))


def duration_by_size(runs: DataFrame, kind: str, size: str, seconds: str) -> DataFrame:
    """(kind, magnitude, runs, median, p95, rate): runs by the decimal magnitude of their size; rate is rows a second over
    all of them. Sizes not above zero have no magnitude and are left out."""
    known = runs.filter(c(size) > 0).withColumn("magnitude", F.length(F.floor(size).cast("string")) - 1)
    return known.groupBy(kind, "magnitude").agg(F.count(F.lit(1)).alias("runs"), F.percentile(seconds, F.lit(0.5)).alias("median"), F.percentile(seconds, F.lit(0.95)).alias("p95"), F.try_divide(F.sum(size), F.sum(seconds)).alias("rate"))


def regression_gate(current: DataFrame, baseline: DataFrame, name: str, score: str, cost: str, reference: str, tolerance: float, allowed: float) -> DataFrame:
    """(name, failure) of each baseline row: missing now; score below the baseline's by more than tolerance; cost, as a ratio
    to the reference row's, above the baseline's ratio by more than the share allowed; no reference row: one failure. No
    row means that the gate passes."""

    def told(d: DataFrame, tag: str) -> DataFrame:
        one = F.broadcast(d.filter(c(name) == reference).agg(F.first(cost).alias("_ref")))  # one row
        return d.crossJoin(one).select(name, c(score).alias(f"_score{tag}"), (c(cost) / c("_ref")).alias(f"_ratio{tag}"), F.lit(True).alias(f"_in{tag}"))

    met = told(baseline, "_b").join(told(current, "_c"), name, "left")
    kinds = [
        ("missing", c("_in_c").isNull()),
        ("score", c("_score_c") < c("_score_b") - tolerance),
        ("cost", (c(name) != reference) & (c("_ratio_c") > c("_ratio_b") * (1 + allowed))),
        ("no_reference", (c(name) == reference) & c("_in_c").isNull()),
    ]
    return met.select(name, F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(k)) for k, bad in kinds)))).alias("failure"))


def accuracy_vs_truth(df: DataFrame, group: str, published: str, truth: str) -> DataFrame:
    """(group, n, mean_error, p95_error, max_error, beyond_2x, beyond_4x, correlation) of log errors and of the logs of one
    more than each; rows where either isn't above zero are left out."""
    known = df.filter((c(published) > 0) & (c(truth) > 0)).withColumn("_e", F.abs(F.ln(c(published) / c(truth))))
    return known.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_e").alias("mean_error"), F.percentile("_e", F.lit(0.95)).alias("p95_error"), F.max("_e").alias("max_error"),
        F.avg((c("_e") > F.ln(F.lit(2.0))).cast("int")).alias("beyond_2x"), F.avg((c("_e") > F.ln(F.lit(4.0))).cast("int")).alias("beyond_4x"), F.corr(F.log1p(published), F.log1p(truth)).alias("correlation"),
    )


def recall_by_kind(truth: DataFrame, events: DataFrame, keys: Sequence[str], kind: str, caught_by: Mapping[str, Sequence[str]]) -> DataFrame:
    """(kind, injected, caught, recall): true cases that an event of one of their kinds names by key."""
    pairs = F.create_map(*(x for k, v in caught_by.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    seen = events.select(*keys, c(kind).alias("_seen")).distinct()
    asked = truth.withColumn("_id", F.struct(*keys)).select(*keys, kind, F.explode_outer(pairs[c(kind)]).alias("_seen"))
    hit = asked.join(seen.withColumn("_hit", F.lit(1)), [*keys, "_seen"], "left").groupBy(*keys, kind).agg(F.max("_hit").alias("_hit"))
    return hit.groupBy(kind).agg(F.count(F.lit(1)).alias("injected"), F.count("_hit").alias("caught"), (F.count("_hit") / F.count(F.lit(1))).alias("recall"))


def same_result(a: DataFrame, b: DataFrame, order: Sequence[str], columns: Sequence[str], within: float = 1e-9) -> DataFrame:
    """(place, columns) where two results differ when read in order, which must be total: a row on one side only, or values
    that are unequal, numbers relative to the larger by more than within. No rows: the same."""
    numbers = {f.name for f in a.schema.fields if f.dataType.typeName() in ("double", "float")}
    left, right = (numbered(d.select(*dict.fromkeys([*order, *columns])), "place", *map(c, order)).select("place", F.lit(True).alias(f"_in{t}"), *(c(x).alias(f"{x}{t}") for x in columns)) for d, t in ((a, "_a"), (b, "_b")))
    met = left.join(right, "place", "full")

    def off(x: str) -> Column:
        p, q = c(f"{x}_a"), c(f"{x}_b")
        close = F.coalesce(F.abs(p - q) <= within * F.greatest(F.abs(p), F.abs(q)), F.lit(False)) if x in numbers else F.lit(False)
        return ~(p.eqNullSafe(q) | close)

    one_side = c("_in_a").isNull() | c("_in_b").isNull()
    names = F.when(one_side, F.array(F.lit("row"))).otherwise(F.array_compact(F.array(*(F.when(off(x), F.lit(x)) for x in columns))))
    return met.select("place", F.array_join(names, ",").alias("columns")).filter("columns <> ''")


def text_shapes(df: DataFrame, text: str, ladder: Sequence[tuple[str, str]]) -> DataFrame:
    """(shape, n, share, example, shortest, longest): rows by the first pattern of the ladder that they match, else other,
    or null; the example is the least text."""
    shape = reduce(lambda w, kp: w.when(c(text).rlike(kp[1]), kp[0]), ladder[1:], F.when(c(text).isNull(), "null").when(c(text).rlike(ladder[0][1]), ladder[0][0])).otherwise("other")
    shapes = df.groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min(text).alias("example"), F.min(F.length(text)).alias("shortest"), F.max(F.length(text)).alias("longest"))
    return shapes.crossJoin(F.broadcast(shapes.agg(F.sum("n").alias("_all")))).withColumn("share", c("n") / c("_all")).drop("_all")


def total_order_write(df: DataFrame, path: str, *keys: str) -> None:
    """df as Parquet files in the order of the keys, then of every other column: files are ranges of it, in their order."""
    order = [*keys, *(x for x in df.columns if x not in keys)]
    df.repartitionByRange(*keys).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def changed_days(old: DataFrame, new: DataFrame, day: str, ahead: int) -> DataFrame:
    """(day, changed): days whose fingerprints differ or stand on one side only, and the days ahead of them, which are made
    from them; changed is false for a day that only follows one."""
    rest = [x for x in new.columns if x != day]
    met = old.select(day, F.struct(*rest).alias("_old")).join(new.select(day, F.struct(*rest).alias("_new")), day, "full").filter(~c("_old").eqNullSafe(c("_new")))
    dealt = met.select(F.explode(F.sequence(c(day), F.date_add(day, ahead))).alias("_to"), c(day).alias("_from"))
    return dealt.groupBy(c("_to").alias(day)).agg(F.bool_or(c("_to") == c("_from")).alias("changed"))


def file_manifest(lines: DataFrame, files: DataFrame, file: str, reason: str) -> DataFrame:
    """(file, read, accepted, quarantined, status) of every file: empty without lines, partial with some refused, refused
    with all of them, else ok."""
    counts = lines.groupBy(file).agg(F.count(F.lit(1)).alias("read"), F.count(reason).alias("quarantined"))
    told = files.select(file).distinct().join(counts, file, "left").fillna(0, ["read", "quarantined"]).withColumn("accepted", c("read") - c("quarantined"))
    return told.withColumn("status", F.when(c("read") == 0, "empty").when(c("accepted") == 0, "refused").when(c("quarantined") > 0, "partial").otherwise("ok"))


def route(records: DataFrame, topic: str, body: str) -> DataFrame:
    """records with route: reject for a body that is no JSON object, static or position by topic, dead for other topics."""
    kind = F.when(F.json_object_keys(c(body)).isNull(), "reject").when(c(topic).startswith("static"), "static").when(c(topic).startswith("position"), "position").otherwise("dead")
    return records.withColumn("route", kind)


def replay_quarantine(quarantined: DataFrame, replayed: DataFrame, key: str, reason: str, which: str) -> DataFrame:
    """The quarantined rows of one reason that were not replayed before: what goes through the pipeline once more."""
    return quarantined.filter(c(reason) == which).join(replayed.select(key).distinct(), key, "left_anti")
