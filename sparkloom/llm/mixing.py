"""Mixing sources to target weights by capped water-filling.

A document's size is its number of words (runs without a space or U+0009 to U+000D; a null text has none). Sources take
their weights in turn, by code point, the null source last. They share SHARE times all words by weight; a source that
would get over EPOCHS times its own words is clamped there, and the excess goes to the others by weight, until none is
above. The level of the fill is found in rounds over a table with a row for each source: each round adds up what the
clamped ones hold and the weights of the rest, two numbers.

A source's target is a number of whole repetitions of all its documents and a rest. The rest goes to documents in the
order of a seeded draw; the one in which it ends is taken in part (a fractional repetition), so a source's taken words
are its target to within half a word, and no document is taken over EPOCHS times. The draw is a hash of the seed, the
key and the text, so reruns agree. The place where the rest ends is found without ordering a source: draws are cut into
as many blocks as the square root of its number of rows, blocks are summed, and only the rows of one block are ordered.

Rows with a null key, or which repeat one, are rows of their own. An empty table gives an empty result, sizes of zero
are taken zero times. Other columns are ignored (`amounts`) or kept as they are (`mixed`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from .shared import dealt_join, ready, stored

WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix"
WORD = r"[^\x20\x09-\x0D]+"
#: Draws are numbers below this.
DRAWS = 1 << 60


def sized(docs: DataFrame, key: str, text: str, source: str, seed: str, *kept: Column) -> DataFrame:
    """(key, part, source, size, draw) and what is kept, for each row. part: the source as a key that is never null."""
    held, name = F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(source).cast("string")
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), held))
    return docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("part"),
        name.alias("source"),
        F.regexp_count(held, F.lit(WORD)).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("draw"),
        *kept,
    )


def fill(sources: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """sources (part, source, source_size), one row each, with target."""
    rest = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") - 1).cast("int") % len(weights) + 1)
    held = stored(numbered(sources, "place", F.col("source").asc_nulls_last()).withColumn("weight", rest).withColumn("cap", F.lit(float(epochs)) * F.col("source_size")))
    total, level, before = (held.agg(F.sum("source_size")).first()[0] or 0) * share, 0.0, None
    while True:
        above = F.lit(level) * F.col("weight") > F.col("cap")
        clamped, free = held.agg(F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if free == before or not free:
            break
        before, level = free, (total - clamped) / free
    return held.withColumn("target", F.when(F.lit(level) * F.col("weight") > F.col("cap"), F.col("cap")).otherwise(F.lit(level) * F.col("weight")))


def _block() -> Column:
    return F.least((F.col("draw") / DRAWS * F.col("blocks")).cast("long"), F.col("blocks") - 1)


def plan(rows: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """A row for each source: source_size, target, whole repetitions, and at which block of draws (at) and after how
    many of its words (left) the rest of the target ends."""
    sources = stored(rows.groupBy("part", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    goal = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(0)
    facts = fill(sources, weights, share, epochs).withColumn("goal", goal).withColumn("whole", whole)
    facts = stored(facts.select("part", "n", "source_size", "target", "whole", (F.col("goal") - F.col("whole") * F.col("source_size")).alias("rest"), F.ceil(F.sqrt("n")).alias("blocks")))
    sums = dealt_join(rows, facts.filter("rest > 0").select("part", "n", "blocks"), "part", "n").groupBy("part", _block().alias("block")).agg(F.sum("size").alias("words"))
    upto = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("part").orderBy("block"))).join(facts.select("part", "rest"), "part")
    ends = upto.filter("upto >= rest and upto - words < rest").select("part", F.col("block").alias("at"), (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))
    return stored(facts.join(ends, "part", "left").withColumns({"at": F.coalesce("at", F.lit(-1)), "left": F.coalesce("left", F.lit(0))}))


def taken(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """rows with source_size, target and taken."""
    told = dealt_join(rows, planned, "part", "n").withColumn("block", _block())
    columns = [*(c for c in rows.columns), "source_size", "target"]
    apart = told.filter("block != at").withColumn("taken", (F.col("whole") + (F.col("block") < F.col("at")).cast("long")) * F.col("size"))
    before = F.sum("size").over(Window.partitionBy("part").orderBy("draw", F.col("key").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    last = told.filter("block = at").withColumn("before", before)
    last = last.withColumn("taken", F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before"))))
    return apart.select(*columns, "taken").unionByName(last.select(*columns, "taken"))


def amounts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """(key, size, source_size, target, taken): a row for each row of docs; taken: the words that the mix takes of it."""
    ready(docs.sparkSession)
    rows = stored(sized(docs, key, text, source, seed))
    out = taken(rows, plan(rows, weights, share, epochs))
    return out.select(F.col("key").alias(key), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: docs' columns, a row for each repetition; of a repetition in part, the first words, joined by
    one space. Texts aren't shuffled but for those of a block in which a source's rest ends and of rare sources."""
    ready(docs.sparkSession)
    held = stored(sized(docs, key, text, source, seed))
    rows = sized(docs, key, text, source, seed, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = taken(rows, plan(held, weights, share, epochs)).filter("taken > 0")
    words = F.explode(F.expr("transform(sequence(0, (taken - 1) div size), k -> least(size, taken - k * size))"))
    out = out.select("row", "size", words.alias("words"))
    whole = F.col("row").getField(text)
    part = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    cut = F.when(F.col("words") < F.col("size"), part).otherwise(whole)
    return out.select(*((cut if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns))


#: The same rows in DuckDB: the fill in closed form (sources in order of cap over weight), one order of each source.
SQL = f"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
                      CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS draw FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, {EPOCHS}.0::DOUBLE * source_size AS cap FROM s),
    f AS (SELECT *, {SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total,
                 coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
                 sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
    l AS (SELECT (total - clamped) / free AS level FROM f WHERE (total - clamped) / free * weight <= cap ORDER BY cap / weight, source LIMIT 1),
    t AS (SELECT source, source_size, CASE WHEN level * weight > cap THEN cap ELSE level * weight END AS target FROM f, l),
    g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS whole FROM t),
    r AS (SELECT d.*, source_size, target, whole, goal - whole * source_size AS rest,
                 sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size AS before
          FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
    SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM r
"""
