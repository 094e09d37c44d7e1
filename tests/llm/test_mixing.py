"""Source mixing against its SQL, a plain fill, and odd rows."""

import random
from collections import Counter

import pytest
from compare import differences

from sparkloom.llm import mixing, queries

DATA = "/root/testdata/sf0.001"


def plain_fill(sizes: dict, weights, share, epochs):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, clamped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in clamped]
        rest = total - sum(epochs * sizes[s] for s in clamped)
        got = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if got[s] > epochs * sizes[s]}
        if not above:
            return got | {s: float(epochs * sizes[s]) for s in clamped}
        clamped |= above


def test_query_gives_the_rows_of_its_sql(spark):
    assert differences(queries.op13_mixing(spark, DATA), queries.ORACLE["op13_mixing"], DATA) == ""


def test_taken_words_are_the_plain_fill_on_odd_sources(spark):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40])), r.choice(["b", "b", "b", "a", "", "é", "z", None])) for i in range(600)]
    rows += [(7, "same row twice", "a"), (7, "same row twice", "a"), (None, "no key", "b"), (None, None, None), (900, None, "only empty"), (901, "x y \x0b z\n", "ä"), (902, "long " * 50_000, "huge"), (903, "one", "huge")]
    docs = spark.createDataFrame([(*x, "clash", 1, 2, 3) for x in rows], "doc_id long, text string, source string, part string, block long, target int, size int").repartition(5)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")])
    wanted = plain_fill(sizes, mixing.WEIGHTS, mixing.SHARE, mixing.EPOCHS)
    got = mixing.amounts(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.amounts(docs.repartition(2)).collect()), key=str)
    assert all(0 <= x.taken <= 2 * x.size for x in got)
    assert sum(x.taken for x in got) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))
    for s, target in wanted.items():
        mine = [x for x in got if x.source_size == sizes[s] and x.target == pytest.approx(target)]
        assert mine and (target == 0 or abs(sum(x.taken for x in mine) - target) <= 0.5 + 1e-6)


def test_the_mix_holds_whole_and_part_repetitions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumnRenamed("n_chars", "words")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = Counter()
    for x in out.collect():
        words[x.doc_id] += len(__import__("re").findall(r"[^\x20\x09-\x0D]+", x.text))
    assert words == Counter({x.doc_id: x.taken for x in mixing.amounts(docs).collect() if x.taken})


def test_an_empty_table_gives_no_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("false")
    assert mixing.amounts(docs).count() == 0 and mixing.mixed(docs).count() == 0
