"""Spelling variants against their SQL and a brute-force version on odd rows, also with blocks so small that all are cut."""

import random
import re
import zlib
from collections import Counter

import pytest
from compare import differences

from sparkloom.llm import queries, spelling

DATA = "/root/testdata/sf0.001"


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    count = Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 7 and k >= 2}
    near = {w: [x for x in n if x != w and one_apart(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=str)


def test_query_gives_the_rows_of_its_sql(spark):
    assert differences(queries.op12_spelling(spark, DATA), queries.ORACLE["op12_spelling"], DATA) == ""


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(11)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randint(7, 10))) for _ in range(60)]

    def changed(w):
        i, c = r.randrange(len(w)), r.choice("abcdeéÉÿ×")
        return r.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[::-1]])

    texts = [" ".join([r.choice(base) if r.random() < 0.8 else changed(r.choice(base)) for _ in range(60)]).title() for _ in range(150)]
    # chains of forms, anagrams, runs beyond 255 letters, one text often, marks between letters
    texts += ["chainedly " * 400 + "chainedl " * 30 + "chaneddl chainedd " * 2 + "chaineddl chaineddl", "abcdefg bacdefg gfedcba " * 3, "a" * 400 + " " + "a" * 400 + " " + "a" * 401 + "\n" + "a" * 401]
    texts += ["hot word wordings"] * 40 + ["", None, "ÀÖØöøÿ× ÀÖØöøÿ÷ x_underscore_words1234567", "  "]
    rows = [(i if i % 17 else i // 17, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "keyless keyless", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(4)


@pytest.mark.parametrize("rows", [20_000, 30])
def test_variants_equal_brute_force_on_odd_rows(spark, docs, monkeypatch, rows):
    monkeypatch.setattr(spelling, "BLOCK_ROWS", rows)
    wanted = plain([(x.doc_id, x.text) for x in docs.collect()])
    assert sum(w[1] is not None for w in wanted) > 20 and any(w[1] not in (None, w[2]) for w in wanted)
    assert sorted(map(tuple, spelling.variants(docs).collect()), key=str) == wanted


def test_anagrams_are_compared_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_ROWS", 10)
    r = random.Random(3)
    words = {"".join(r.sample("àæìòøàæ", 7)) for _ in range(60)} | {"".join(r.sample("àæìòøab", 7)) for _ in range(20)}
    rows = [(i, f"{w} {w} {w}") for i, w in enumerate(sorted(words))]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_an_empty_table_gives_no_rows(docs):
    assert spelling.variants(docs.filter("false")).count() == 0
