"""Product codes against their SQL, a plain integer k-means and odd rows."""

import hashlib
import math
import random

import numpy as np
from compare import differences

from sparkloom.llm import queries, vector_codes

DATA = "/root/testdata/sf0.001"


def plain(rows):
    """(key, code, error, label) of each kept row, and the codebooks' digest."""
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[[math.floor(4096 * v) for v in r[1][p * len(r[1]) // 8 : (p + 1) * len(r[1]) // 8]] for p in range(8)] for r in rows]
    books = [[x[i][p] for i in range(min(16, len(x)))] for p in range(8)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(6):
        for p in range(8):
            mine = {}
            for v in x:
                mine.setdefault(nearest(p, v[p])[1], []).append(v[p])
            books[p] = [[sum(c) // len(mine[k]) for c in zip(*mine[k])] if k in mine else e for k, e in enumerate(books[p])]
    out = []
    for r, v in zip(rows, x):
        near = [nearest(p, v[p]) for p in range(8)]
        out.append((r[0], "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near), r[2]))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def test_query_gives_the_rows_of_its_sql(spark):
    assert differences(queries.op11_vector_codes(spark, DATA), queries.ORACLE["op11_vector_codes"], DATA) == ""


def check(spark, rows, parts):
    df = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], "vec_id long, embedding array<float>, label string, key string, error int, code string").repartition(parts)
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    wanted, digest = plain(rows)
    sums = {}
    for _, _, e, label in wanted:
        sums[label] = sums.get(label, 0) + e
    found, books = vector_codes.compress(df)
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted(((k, c, e, sums[label]) for k, c, e, label in wanted), key=str) and vector_codes.digest(books) == digest


def test_codes_equal_a_plain_version_on_odd_rows(spark):
    r = random.Random(2)
    heavy = [r.uniform(-1, 1) for _ in range(24)]
    rows = [(i, [r.uniform(-1, 1) * (i % 3) for _ in range(24)], r.choice(["a", "b", None, "hot", "hot"])) for i in range(20, 900)]
    rows += [(i, heavy, "same") for i in range(300, 700)] + [(5, heavy, "same"), (5, heavy, "same"), (5, heavy[::-1], None), (None, [0.0] * 24, "a")]
    rows += [(1, None, "a"), (2, [0.5] * 23 + [None], "a"), (3, [0.5] * 23 + [math.nan], "a"), (4, [math.inf] * 24, "a"), (6, [], None)]
    # grid points: many ties between entries
    rows += [(10_000 + i, [r.choice([-0.5, 0.0, 0.5]) for _ in range(24)], "grid") for i in range(400)]
    check(spark, rows, 3)


def test_few_rows_and_rows_all_alike(spark):
    check(spark, [(i, [i / 8] * 16, None) for i in range(5)], 2)
    check(spark, [(i, [0.25] * 16, "l") for i in range(200)], 2)


def test_lengths_that_differ_are_dropped_and_an_empty_table_gives_no_rows(spark):
    df = spark.createDataFrame([(1, [0.1] * 7, 1), (2, [0.1] * 8, 1), (3, [0.2] * 16, 1)], "vec_id long, embedding array<double>, label int")
    assert [x.vec_id for x in vector_codes.compress(df)[0].collect()] == [2]
    assert vector_codes.compress(df.filter("false"))[0].count() == 0


def test_most_points_are_settled_by_whole_balls():
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (16, 8))
    points = centres[rng.integers(0, 16, 4096)] + rng.integers(-60, 60, (4096, 8))
    whole = sum(at.stop - at.start for _, entry, at in vector_codes.Tree(points).walk(centres) if isinstance(entry, int))
    assert whole > 0.95 * 4096
