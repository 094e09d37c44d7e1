"""Rule sets at a table's boundary. Each returns Rules for `validation.first_failure` or rows with a reason.

A row's reason is the first rule that fails; a null condition doesn't fail. Nulls are told by the rules for missing
fields; repeated rows are told by number within their key, the order given; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .validation import Rules, first_failure

c = F.col
#: Seconds that a clock may run ahead, degrees around (0, 0) that mean no position.
FUTURE_S, NULL_ISLAND = 120, 0.001


def missing(*columns: str) -> Rules:
    """A rule for each column: null, or blank text."""
    return [(f"missing_{n}", c(n).isNull() | (F.trim(c(n).cast("string")) == "")) for n in columns]


def positions(now: Column, id_: str = "id", lat: str = "lat", lon: str = "lon", ts: str = "ts") -> Rules:
    return [
        *missing(id_, lat, lon, ts),
        ("bad_id", ~c(id_).between(200_000_000, 799_999_999)),
        ("no_position", (c(lat) == 91) | (c(lon) == 181)),
        ("out_of_range", (F.abs(lat) > 90) | (F.abs(lon) > 180)),
        ("null_island", (F.abs(lat) < NULL_ISLAND) & (F.abs(lon) < NULL_ISLAND)),
        ("in_the_future", c(ts) > now + F.expr(f"INTERVAL {FUTURE_S} SECONDS")),
    ]


def check_digit(number: Column, length: int) -> Column:
    """Whether the last of `length` digits is the weighted sum of the others (weights length, length - 1, .., 2) mod 10."""
    digit = lambda k: F.floor(number / F.lit(10 ** (length - 1 - k))).cast("long") % 10
    total = sum((digit(k) * (length - k) for k in range(length - 1)), F.lit(0))
    return (number >= 0) & (number < 10**length) & (total % 10 == digit(length - 1))


def events(known: Sequence[str], low: Column, high: Column) -> Rules:
    return [*missing("event_id", "user_id", "event_type", "ts"), ("unknown_type", ~c("event_type").isin(list(known))), ("time_out_of_range", ~c("ts").between(low, high))]


def listings(df: DataFrame, items: DataFrame, item: str, price: str, volume: str, total: str, snapshot: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with a reason: missing fields, unknown item, price, volume, or a repeat of an order within a snapshot."""
    place = F.row_number().over(Window.partitionBy(*sorted(snapshot, key=lambda x: x != item)).orderBy(*order))
    # dealt by item and sorted once, for places and join alike: a task holds its rows in one sort instead of two
    placed = (df.repartition(item) if item in snapshot else df).withColumn("_seen", place)
    known = placed.join(items.select(c(item)).distinct().withColumn("_known", F.lit(True)), item, "left")
    rules: Rules = [
        *missing(item, price, volume),
        ("unknown_item", c("_known").isNull()),
        ("bad_price", ~(c(price) > 0)),
        ("bad_volume", ~(c(volume) > 0) | (c(volume) > c(total))),
        ("duplicate_in_snapshot", c("_seen") > 1),
    ]
    return known.withColumn("reason", first_failure(rules)).drop("_known", "_seen")


def history(day: str, low: str, average: str, high: str, fetched: str) -> Rules:
    return [*missing(day, low, average, high), ("bad_price", ~(c(low) > 0)), ("inconsistent_range", ~((c(low) <= c(average)) & (c(average) <= c(high)))), ("day_after_fetch", c(day) > c(fetched))]


def flows(kind: str, known: Sequence[str], amount: str) -> Rules:
    value = c(amount)
    return [*missing(kind, amount), ("unknown_kind", ~c(kind).isin(list(known))), ("not_finite", F.isnan(value) | F.abs(value).isin([float("inf")])), ("negative", value < 0)]


def feedback(now: Column, text: str = "text", lang: str = "lang", source: str = "source", ts: str = "created_at", most: int = 4000) -> Rules:
    return [
        *missing(text, source, ts),
        ("too_long", F.length(text) > most),
        ("bad_source", ~c(source).rlike("^[a-z][a-z0-9_.-]{0,40}$")),
        ("bad_language", ~c(lang).rlike("^[a-z]{2}(-[A-Z]{2})?$")),
        ("in_the_future", c(ts) > now + F.expr("INTERVAL 1 DAY")),
    ]


def attempts(user: str, kind: str, quantity: str, known: Sequence[str], most: int) -> Rules:
    number = c(quantity).try_cast("long")
    return [*missing(user, kind, quantity), ("unknown_kind", ~c(kind).isin(list(known))), ("quantity_not_a_number", number.isNull()), ("quantity_out_of_range", ~number.between(1, most))]


def truth(text: Column) -> Column:
    """Tolerant booleans: null where the text is none of the spellings."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("1", "true", "t", "yes", "y"), True).when(t.isin("0", "false", "f", "no", "n"), False)


def money(text: Column) -> Column:
    """Amounts with currency signs, spaces and thousands separators; null where no number is left."""
    return F.regexp_replace(text, r"[$€£,\s]", "").try_cast("double")


def orders(statuses: dict[str, str], known_currencies: Sequence[str], now: Column) -> tuple[Column, Column, Rules]:
    """(status, placed at, rules) of order lines (order_ref, email, country, status, amount, currency, placed_at)."""
    status = F.create_map(*(F.lit(x) for kv in statuses.items() for x in kv))[F.lower(F.trim("status"))]
    at = any_time(c("placed_at"))
    amount = money(c("amount"))
    rules: Rules = [
        *missing("order_ref", "email", "country", "status", "amount", "placed_at"),
        ("bad_email", ~c("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")),
        ("bad_country", ~c("country").rlike("^[A-Z]{2}$")),
        ("unknown_status", status.isNull()),
        ("bad_amount", amount.isNull()),
        ("negative_amount", amount < 0),
        ("unknown_currency", ~F.coalesce(c("currency"), F.lit("EUR")).isin(list(known_currencies))),
        ("bad_time", at.isNull()),
        ("in_the_future", at > now),
    ]
    return status, at, rules


def any_time(text: Column) -> Column:
    """Dates in ISO, slash and plain spellings, with or without a time, and seconds or milliseconds since 1970."""
    whole = text.try_cast("long")
    spelled = [F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "yyyy-MM-dd")]
    epoch = F.when(whole >= 100_000_000_000, F.timestamp_millis(whole)).when(whole.isNotNull(), F.timestamp_seconds(whole))
    return F.coalesce(*spelled, epoch)


def delivery_conflicts(df: DataFrame, key: str, body: str, order: str) -> DataFrame:
    """Each row's verdict within its key, in order: created, duplicate (same body as the first) or conflict."""
    w = Window.partitionBy(key).orderBy(order)
    digest = F.sha2(F.coalesce(c(body).cast("string"), F.lit("")), 256)
    first = F.first(digest).over(w)
    verdict = F.when(F.row_number().over(w) == 1, "created").when(digest == first, "duplicate").otherwise("conflict")
    return df.withColumn("verdict", F.when(c(key).isNull(), "quarantined").otherwise(verdict))


def copies_and_leakage(df: DataFrame, key: str, text: str, split: str) -> DataFrame:
    """Pool rows whose text stands in the test split (leaked_from) or in an earlier pool row (copy_of); digests meet,
    aggregated before the shuffle."""
    digest = F.sha2(F.coalesce(c(text), F.lit("")), 256)
    rows = df.select(c(key), c(split), digest.alias("_digest"))
    firsts = rows.groupBy("_digest").agg(F.min(F.when(c(split) == "pool", c(key))).alias("_pool"), F.min(F.when(c(split) == "test", c(key))).alias("leaked_from"))
    met = rows.filter(c(split) == "pool").join(firsts, "_digest").withColumn("copy_of", F.when(c("_pool") != c(key), c("_pool")))
    return met.filter("leaked_from is not null or copy_of is not null").select(key, "leaked_from", "copy_of")


def vectors(vector: str, dim: int) -> Rules:
    v = c(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin([float("inf")]))
    return [*missing("token"), ("field_count", F.size(v) != dim), ("not_a_number", bad), ("all_zero", F.forall(v, lambda x: x == 0)), ("repeated_token", c("_seen") > 1)]


def account_rows(landed: DataFrame, clean: DataFrame, quarantined: DataFrame) -> DataFrame:
    """One row: landed, clean, quarantined, lost and invented (what clean and quarantined lack or have too many)."""
    side = lambda df, k: df.agg(*(F.count(F.lit(1)).alias(n) if n == k else F.lit(0).cast("long").alias(n) for n in ("landed", "clean", "quarantined")))
    all_ = side(landed, "landed").unionByName(side(clean, "clean")).unionByName(side(quarantined, "quarantined"))
    sums = all_.agg(*(F.sum(n).alias(n) for n in ("landed", "clean", "quarantined")))
    gap = c("landed") - c("clean") - c("quarantined")
    return sums.withColumn("lost", F.greatest(gap, F.lit(0))).withColumn("invented", F.greatest(-gap, F.lit(0)))


def reconcile_layers(pairs: Sequence[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(name, expected, actual) of the equalities that are broken; each side is a table of one number."""
    one = lambda n, k, df: df.select(F.lit(n).alias("name"), F.lit(k).alias("side"), c(df.columns[0]).cast("double").alias("value"))
    sides = [one(n, k, df) for n, a, b in pairs for k, df in (("expected", a), ("actual", b))]
    out = sides[0]
    for s in sides[1:]:
        out = out.unionByName(s)
    both = out.groupBy("name").agg(*(F.max(F.when(c("side") == k, c("value"))).alias(k) for k in ("expected", "actual")))
    return both.filter(~c("expected").eqNullSafe(c("actual")))


def check_constraints(df: DataFrame, key: str, required: Sequence[str], types: dict[str, str], accepted: dict[str, Sequence], parents: dict[str, DataFrame]) -> DataFrame:
    """(key, broken): a row for each broken constraint of each row; parents hold a column of the same name."""
    marked = df.withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy(key)))
    for n, parent in parents.items():
        marked = marked.join(parent.select(n).distinct().withColumn(f"_{n}", F.lit(True)), n, "left")
    checks = [
        *((f"missing_{n}", c(n).isNull()) for n in required),
        *((f"type_{n}", c(n).isNotNull() & c(n).cast("string").try_cast(t).isNull()) for n, t in types.items()),
        *((f"not_accepted_{n}", c(n).isNotNull() & ~c(n).isin(list(v))) for n, v in accepted.items()),
        (f"duplicate_{key}", c(key).isNotNull() & (c("_times") > 1)),
        *((f"dangling_{n}", c(n).isNotNull() & c(f"_{n}").isNull()) for n in parents),
    ]
    broken = F.array_compact(F.array(*(F.when(failed, F.lit(n)) for n, failed in checks)))
    return marked.select(key, F.explode(broken).alias("broken"))
