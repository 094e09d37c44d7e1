"""The verdict of the compression bands against a plain zstandard version, and against labels."""

import math
import random
import string

import zstandard
from pyspark.sql import functions as F

from sparkloom.llm import quality_rules

DATA = "/root/testdata/sf0.01"


def limits(size, table):
    if size < table[0][0]:
        return None
    for (a, *low), (b, *high) in zip(table, table[1:]):
        if size <= b:
            share = (math.log(size) - math.log(a)) / (math.log(b) - math.log(a))
            return [x + share * (y - x) for x, y in zip(low, high)]
    return table[-1][1:]


def plain(text):
    data = (text or "").encode()
    own = limits(len(data), quality_rules.WHOLE_BANDS)
    if own is None:
        return None, None
    ratio = len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(data)) / len(data)
    chunks = [data[i : i + 4096] for i in range(0, len(data), 4096)]
    if len(chunks) > 1 and len(chunks[-1]) < 1000:
        last = chunks.pop()
        chunks[-1] += last
    low = high = 0
    for c in chunks:
        if (lim := limits(len(c), quality_rules.CHUNK_BANDS)) is not None:
            r = len(zstandard.ZstdCompressor(level=1, write_content_size=False).compress(c)) / len(c)
            low, high = low + (r < lim[0]), high + (r > lim[1])
    why = "repetitive" if ratio < own[0] else "incompressible" if ratio > own[1] else None
    if why is None and (low + high) / len(chunks) >= quality_rules.BAD_CHUNKS:
        why = "repetitive chunks" if low >= high else "incompressible chunks"
    return ratio, why


def test_verdicts_equal_a_plain_version(spark):
    r = random.Random(9)
    docs = [x.text for x in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    prose = max((t for t in docs if t), key=len)
    noise = "".join(r.choice(string.printable) for _ in range(30_000))
    odd = [None, "", "x" * 199, "x" * 200, noise[:250], noise[:5000], noise, prose + " " + noise, prose[:9000] + "same words again " * 600, "ab " * 50_000, prose[:4096], prose[:5095], prose[:5097]]
    table = spark.createDataFrame(list(enumerate(docs + odd)), "doc_id long, text string")
    got = {x.doc_id: x for x in quality_rules.measure(table).collect()}
    for i, t in enumerate(docs + odd):
        ratio, why = plain(t)
        assert (got[i].whole_ratio, got[i].verdict) == (ratio, why) and got[i].kept == (not got[i].base_failed and why is None)
    assert {"repetitive", "incompressible", "repetitive chunks"} <= {x.verdict for x in got.values()}


def test_bands_reject_poor_texts_and_keep_good_ones(spark):
    rows = quality_rules.measure(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"))
    known = rows.filter("not base_failed").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("quality", "kept", (F.col("word_chars") + F.col("n_words")).alias("size"))
    n = {(x.quality, x.long, x.kept): x["count"] for x in known.groupBy("quality", F.when(F.col("size") >= 4000, 2).when(F.col("size") >= 1000, 1).otherwise(0).alias("long"), "kept").count().collect()}
    share = lambda quality, long: n.get((quality, long, False), 0) / (n.get((quality, long, False), 0) + n.get((quality, long, True), 0))
    assert share(0, 2) >= 0.95 and share(0, 1) >= 0.5 and max(share(1, k) for k in (0, 1, 2)) <= 0.01
