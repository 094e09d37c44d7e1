"""The training-data operators against the libraries, brute force and held-out labels, on odd rows and given tables."""

import hashlib
import itertools
import random
import re
import struct
import zlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import exact_dedup, html_extract, jaccard_join, langid, packing, quality_classifier, quality_rules, queries, token_counts, toxicity

DATA = "/root/testdata/sf0.001"
ODD = ["", None, " ", "word", "word", "a b c d e f g h i j k l m", "a b c d e f g h i j k l m", "\n\nx\n\n y  z\t", "<|endoftext|> end", "ünï çödé ▁ x​", "long " * 3000, "one two\nthree " * 40]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, "clash") for i, t in enumerate(ODD)] + [(None, "no key here at all", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, digest string").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


def test_bpe_equals_the_library(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op1_bpe(spark, DATA).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_counts_equal_the_library(spark, odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    for docs in (spark.read.parquet(f"{DATA}/documents.parquet"), odd):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        for r in token_counts.count(docs, path, limit=50).collect():
            assert r.n_tokens == len(p.encode(texts[r.doc_id])) and r.n_bytes == len(texts[r.doc_id].encode())
            assert r.over_limit == (r.n_tokens > 50)
    assert token_counts.count(empty, path).count() == 0


def test_prefix_counts_equal_the_library(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(3)
    parts = ["a", "e", "n", "t", " ", "  ", "\n", "x", "▁", "é", "漢", "🙂", "'", "1", "\t", "\u200b", "the", "ing", ".", " \n", "\n  "]
    texts = ["x\n\n  xa", "don't\n\n  xa", "", None, "a" * 300, *("".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(800))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = {i: [len(p.encode((t or "")[:k])) for k in range(len(t or "") + 1)] for i, t in enumerate(texts)}
    assert {x.doc_id: x.tokens for x in token_counts.prefix_counts(docs, path).collect()} == wanted
    for x in token_counts.count(docs, path, limit=5).collect():
        assert x.fits_chars == max(k for k, n in enumerate(wanted[x.doc_id]) if n <= 5)


def test_exact_dedup(odd, empty):
    got = {r.doc_id: r for r in exact_dedup.dedup(odd).collect()}
    assert len(got) == len(ODD) + 1 and got[0].keep_id == 1 and got[0].group_size == 2 and not got[3].kept and got[4].kept
    assert exact_dedup.dedup(empty).count() == 0 and exact_dedup.kept_rows(odd).count() == len({t or "" for t in ODD}) + 1


def brute_classes(texts: dict[int, str]) -> tuple[dict[int, int], dict[int, int]]:
    sets = {i: jaccard_join.shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    degree = dict.fromkeys(texts, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    last = {t: i for i, t in sorted(texts.items())}
    for a, b in itertools.combinations(sorted(texts), 2):
        same = texts[a] == texts[b]
        if same or jaccard_join.jaccard(sets[a], sets[b]) >= jaccard_join.SIMILARITY:
            root[min(find(a), find(b))] = max(find(a), find(b))
            if not same and last[texts[a]] == a and last[texts[b]] == b:
                degree[a], degree[b] = degree[a] + 1, degree[b] + 1
    return {i: find(i) for i in texts}, {i: degree[last[t]] for i, t in texts.items()}


def test_jaccard_join_equals_brute_force(spark, odd, empty):
    for docs in (spark.read.parquet(f"{DATA}/documents.parquet"), odd.filter("doc_id is not null")):
        classes, degree = brute_classes({r.doc_id: r.text or "" for r in docs.collect()})
        for r in jaccard_join.join(docs).collect():
            assert (r.class_id, r.n_links) == (classes[r.doc_id], degree[r.doc_id])
    assert jaccard_join.join(empty).count() == 0 and jaccard_join.join(odd).count() == len(ODD) + 1


def test_a_dense_group_is_one_class(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[:j], f"x{i}", *base[j + 1 :]])) for i in range(150) for j in [i * 7 % 120]]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {149} and all(r.n_links > 0 for r in got)


@pytest.mark.parametrize("n", [200, 2000])
def test_every_link_of_a_dense_group_is_counted(spark, n):
    r = random.Random(1)
    texts = {}
    for k in range(n):
        words = [f"w{i}" for i in range(200)]
        for p in r.sample(range(200), r.randint(1, 4)):
            words[p] = f"x{k}.{p}"
        texts[k] = " ".join(words)
    got = jaccard_join.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    classes, degree = brute_classes(texts)
    found, real = sum(x.n_links for x in got), sum(degree.values())
    print(f"{n} near copies: {found} of {real} link ends")
    assert {x.doc_id: x.class_id for x in got} == classes and 0.99 * real <= found <= real


def test_rows_that_repeat_a_key_are_told_apart(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (1, two), (2, one + " more"), (1, two), (None, two), (None, "quite another text than those above")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.class_id or 0, x.n_links, x.n_copies) for x in jaccard_join.join(docs).collect())
    assert got == [(0, 0, 0, 1), (0, 1, 0, 3), (1, 1, 0, 3), (1, 1, 0, 3), (1, 2, 1, 1), (2, 2, 1, 1)]
    kept = sorted((x.doc_id or 0, x.text) for x in jaccard_join.kept_rows(docs).collect())
    assert kept == [(0, rows[5][1]), (1, two), (2, one + " more")]


def test_dense_groups_that_drift_equal_brute_force(spark):
    base = [f"w{i}" for i in range(300)]

    def changed(words, places, tag):
        return [f"{tag}.{i}" if i in places else w for i, w in enumerate(words)]

    twins = [changed(base, set(random.Random(k).sample(range(300), 5)), f"t{k}") for k in range(120)]
    rows = [*twins, *(changed(t, {(k * 11 + 5) % 300}, "u") for k, t in enumerate(twins))]
    chain = [f"c{i}" for i in range(100)]
    for k in range(80):
        chain = changed(chain, {k * 13 % 100}, f"r{k}")
        rows.append(chain)
    texts = {i: " ".join(r) for i, r in enumerate(rows)}
    got = jaccard_join.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    classes, _ = brute_classes(texts)
    assert len(set(classes.values())) > 90 and {r.doc_id: r.class_id for r in got} == classes


def plain_counts(text: str) -> tuple:
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows: dict = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n")]
    dup = sum(bool(re.search("[^\x20\x09-\x0d]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_quality_counts_equal_plain_ones(spark, odd, empty):
    for docs in (spark.read.parquet(f"{DATA}/documents.parquet").filter("n_chars < 8000"), odd):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        for r in quality_rules.measure(docs).collect():
            want = plain_counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.kept and r.base_failed)
    kept = {r.doc_id for r in quality_rules.measure(odd).filter("kept").collect()}
    assert {r.doc_id for r in quality_rules.kept_rows(odd).collect()} == kept and quality_rules.kept_rows(empty).count() == 0


def test_language_is_found(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.op3_langid(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred != 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)
    contents = langid.learn(docs, F.lit(True))
    assert {r.doc_id: r.lang_pred for r in langid.classify(odd, contents).collect()}[0] == "und" and langid.classify(empty, contents).count() == 0
    assert {r.lang_pred for r in langid.classify(odd, {}).collect()} == {"und"}


def test_packing_is_whole_and_gapless(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    got = packing.pack_documents(odd, path).collect()
    for i, text in texts.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in mine) == len(ids) and all(r.length == 1024 for r in mine[1:])
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length]))
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        assert all(o == sum(n for _, n in sorted(held)[:k]) for k, (o, _) in enumerate(sorted(held))) and sum(n for _, n in held) <= 1024
    assert packing.pack_documents(empty, path).count() == 0


def test_toxicity_on_held_out_rows(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op2_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").select("predicted", "toxic").toPandas()
    assert (got.predicted == got.toxic).mean() >= 0.95 and ((got.predicted == 1) & (got.toxic == 0)).mean() < 0.02
    none = toxicity.learn(odd, labels.filter("false"), F.lit(True))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0} and toxicity.score(empty, none).count() == 0


def test_quality_classifier_on_held_out_rows(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_quality_classifier(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got.selected == (got.quality == 1)).mean() >= 0.85
    none = quality_classifier.learn(odd, spark.createDataFrame([], "doc_id long, grade int"), F.lit(True))
    assert {r.expected_grade for r in quality_classifier.grade(odd, none).collect()} == {0.0} and quality_classifier.grade(empty, none).count() == 0


def test_html_extraction(spark):
    menu = "<div>Home page of all our news and letters today</div>"
    pages = [(i, "http://h/x", f"<html><body>{menu}<div>Unique words number{i} stand here alone{i} on page{i}</div></body></html>") for i in range(6)]
    pages += [(9, None, None), (10, "", ""), (11, "http://h/y", "<nav>no</nav><article><h1>A &amp; B</h1><p>one\n  two<script>x<y</script><p>three<br>four<div class='comments'>bad</div></article><footer>f</footer>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got[3] == "Unique words number3 stand here alone3 on page3" and got[9] == got[10] == ""
    assert got[11] == "A & B\none two\nthree four"
    assert html_extract.extract(df.filter("false")).count() == 0


def test_html_boilerplate_is_counted_over_the_whole_host(spark):
    n = 10 * html_extract.GROUP
    rare = "<div>this notice stands on four pages of the host only</div>"
    pages = [(i, "http://h/x", f"<body><div>About us</div>{rare if i % (n // 4) == 0 else ''}<div>own text number{i} of page{i} goes{i} here{i}</div></body>") for i in range(n)]
    got = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"own text number{i} of page{i} goes{i} here{i}" for i in range(n)}


def test_pipeline_keeps_what_its_stages_keep(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA).select("doc_id").distinct().collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    quality = {r.doc_id for r in quality_rules.measure(docs).filter("kept").collect()}
    assert out and {r.doc_id for r in out} <= quality
    assert len({r.text for r in docs.filter(F.col("doc_id").isin([r.doc_id for r in out])).collect()}) == len(out)


def test_toxicity_equals_a_small_plain_model(spark):
    import math

    import pyarrow as pa

    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = {i: " ".join(r.choice(words) if r.random() > 0.1 else ("bad" if i % 3 == 0 else "good") for _ in range(r.randint(1, 30))) for i in range(90)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in texts], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.lit(True))
    pairs = [{(u, w) for i, t in texts.items() if int(i % 3 == 0) == c for u, w in zip(["<s>", *t.split()], t.split(), strict=False)} for c in (0, 1)]

    def plain(held, word, lower):
        counts = [sum(w == x for _, x in held) for w in {x for _, x in held}]
        one, two = counts.count(1), counts.count(2)
        d = min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5
        return max(sum(word == x for _, x in held) - d, 0) / len(held) + d * len(counts) / len(held) * lower

    def ratio(word):
        both = pairs[0] | pairs[1]
        shared = plain(both, word, 1 / (len({w for _, w in both}) + 1))
        return math.log(plain(pairs[1], word, shared) / plain(pairs[0], word, shared))

    text = "w1 bad w2 good never"
    got = toxicity.features(pa.array([text]), model["ratios"])[0]
    want = sorted((ratio(w) for w in text.split()), reverse=True)
    assert abs(got[1] - sum(want) / 5) < 1e-4 and abs(got[2] - want[0]) < 1e-4 and abs(got[3] - sum(want[:3]) / 3) < 1e-4


def test_html_runs_equal_brute_force_on_a_host_of_1000_pages():
    r = random.Random(2)
    words = [f"v{i}" for i in range(30)]
    pages = [[" ".join(r.choice(words) for _ in range(r.randint(1, 9))) for _ in range(2)] for _ in range(1000)]
    on: dict = {}
    for i, page in enumerate(pages):
        for block in page:
            tokens = block.split(" ")
            for k in range(max(1, len(tokens) - html_extract.RUN + 1)):
                on.setdefault(" ".join(tokens[k : k + html_extract.RUN]), set()).add(i)
    assert html_extract.runs(pages) == {html_extract._hash(x): len(ids) for x, ids in on.items()}


def test_html_of_doubtful_names_and_odd_markup(spark):
    share = "<div class='share'>Send this page to all of your friends now</div>"
    page = "<body><header><h1>Site</h1></header><article><header><h1>Title</h1><i>by line</i></header><p title=\"a>one</p><p class=it's>two {i}</p><div class='search-results'>found {i} things</div>{share}</article><aside>side</aside></body>"
    rows = [(i, "http://h/x", page.replace("{i}", f"n{i}").replace("{share}", share), "clash") for i in range(5)]
    rows += [(1, "http://h/x", rows[1][2], "again"), (None, None, "<p>no container, no host</p>", None), (7, "http://g/", "<article>" + "<p>long text</p>" * 5000 + "</article>", None)]
    got = sorted(((r.page_id if r.page_id is not None else -1, r.text) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()))
    text = {i: f"Title\none\ntwo n{i}\nfound n{i} things" for i in range(5)}
    assert got == sorted([*text.items(), (1, text[1]), (-1, "no container, no host"), (7, "\n".join(["long text"] * 5000))])


def test_bpe_of_odd_rows_equals_the_library(odd, empty):
    from sparkloom.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    got = bpe.decode(bpe.encode(odd, path), path).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) == t.encode(texts[r.doc_id], add_special_tokens=False).ids and r.text == texts[r.doc_id]
    assert bpe.encode(empty, path).count() == 0


def test_pipeline_stages_on_odd_rows_equal_plain_versions(spark, odd):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = odd.unionByName(spark.createDataFrame([(50 + k, " ".join(f"w{i}" for i in range(80)) + f" {k % 3}", "en", "clash") for k in range(6)], odd.schema))
    plain = [(r.doc_id, r.text or "") for r in docs.collect()]
    exact = stages["exact_dedup"](spark, docs, DATA)
    assert exact.columns == docs.columns
    winners = {t: max((i for i, x in plain if x == t), key=lambda i: (i is not None, i or 0)) for _, t in plain}
    kept = [(r.text or "", r.doc_id) for r in exact.collect()]
    assert len(kept) == len(winners) and set(kept) == set(winners.items())
    near = stages["jaccard_join"](spark, exact, DATA)
    known = {i: t for t, i in winners.items() if i is not None}
    classes, _ = brute_classes(known)
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == set(classes.values()) | ({None} if None in winners.values() else set())
    for stage in ("quality_rules", "langid"):
        kept = stages[stage](spark, docs, DATA)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {i for i, _ in plain} and stages[stage](spark, docs.filter("false"), DATA).count() == 0
