"""Spelling variants: words that differ by one code point, found in a frequency-vector trie.

Words are the runs of letters in all texts, lower-cased in A to Z; a run whose hash says so loses one code point (the
contract's typing errors). Words of MIN_LENGTH code points that occur MIN_COUNT times are arranged in a trie by how
often they hold each group of letters, one group after another. Two words one code point apart differ in these counts
by one surplus and one deficit at most, so a word's search walks the trie depth first and may once take a child with
one letter fewer (the deficit) and after that once a child with one more (the surplus). Deficits come first: of two
near words just one finds the other. The words of the leaves that a search reaches are verified letter by letter.

The trie is cut into blocks, subtrees by their first groups' counts: a word is a member of one block and searches in
the few blocks within its budget. A block with over BLOCK_ROWS members and searches is cut again by its next groups, so
that none is large; a block that no group cuts any more (anagrams) is compared in tiles. A task holds one block, builds
its subtree over sorted count vectors and walks it with all searches at once. What leaves it is pairs of near words.

A word's form is its near word of largest n (ties: the least in code points) if that n is FACTOR times its own, and the
root follows forms by pointer doubling: n grows tenfold at each step, so chains are short. Null texts have no words; a
null key is written as an empty text in the hash. Repeated rows count each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dealt_join, partitions, ready, stored

MIN_LENGTH, MIN_COUNT, FACTOR, ERRORS = 7, 2, 10, 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of the trie's levels, common ones first; letters beyond A to Z share MORE further levels.
ORDER, MORE = "etaoinsrhldcumfpgwybvkxjqz", 6
GROUPS = [*ORDER, *("".join(chr(c) for c in range(0xC0, 0x100) if c % MORE == k) for k in range(MORE))]
LEVELS = len(GROUPS)
#: Levels that cut the trie at a time, and rows of one block.
CUT, BLOCK_ROWS = 4, 1 << 17
#: Members below which a node of a block's trie isn't cut further; candidate pairs, and their letters, verified at a time.
LEAF, PAIRS, BYTES = 16, 1 << 17, 1 << 22

_LEVEL = np.full(256, -1)
for _k, _g in enumerate(GROUPS):
    _LEVEL[[ord(x) for x in _g]] = _k


def occurring(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(word, n)."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}"), F.lit(0))).alias("run"))
    lower = F.translate("run", UPPER, LOWER)
    hashed = runs.select(lower.alias("run"), F.crc32(F.concat("key", F.lit(":"), lower)).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % ERRORS == 0, short).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_COUNT)


def _count(level: int) -> Column:
    return F.least(F.lit(255), F.length("word") - F.length(F.translate("word", GROUPS[level], "")))


def _deeper(rows: DataFrame, level: int) -> DataFrame:
    """Rows one level down the trie: members (state -1) by their count, searches by each count that their budget allows.
    States of a search: nothing spent, the deficit spent, both spent."""
    have = F.col(f"have_{level}")
    way = lambda state, count: F.struct(state.alias("state"), count.alias("count"))
    state = F.col("state")
    ways = F.array_compact(F.array(way(state, have), F.when((state == 0) & (have > 0), way(F.lit(1), have - 1)), F.when(state == 1, way(F.lit(2), have + 1))))
    out = rows.withColumn("way", F.explode(ways))
    kept = [c for c in rows.columns if c not in ("state", "block", f"have_{level}")]
    return out.select(*kept, F.col("way.state").alias("state"), F.concat_ws(".", "block", F.col("way.count").cast("string")).alias("block"))


def blocks(words: DataFrame) -> DataFrame:
    """(block, level, word, n, state): the trie's subtrees with their members and searches, none over BLOCK_ROWS."""
    rows, done = None, []
    for level in range(0, LEVELS, CUT):
        counts = {f"have_{k}": _count(k) for k in range(level, level + CUT)}
        if rows is None:
            # a small table becomes a large one here: its rows are dealt to all tasks first
            rows = words.select("word", "n").repartition(4 * partitions(words.sparkSession), "word").withColumns(counts).withColumn("block", F.lit("")).withColumn("state", F.explode(F.array(F.lit(-1), F.lit(0))))
        else:
            rows = rows.select("word", "n", "state", "block").withColumns(counts)
        for k in range(level, level + CUT):
            rows = _deeper(rows, k)
        rows = stored(rows)
        sizes = stored(rows.groupBy("block").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("state") < 0).alias("members")))
        # searches that met no member end here
        held = dealt_join(rows, sizes, "block", "size").filter("members > 0")
        done.append(held.filter(F.col("size") <= BLOCK_ROWS).select("block", F.lit(level + CUT).alias("level"), "word", "n", "state"))
        rows = held.filter(F.col("size") > BLOCK_ROWS)
        if sizes.filter((F.col("size") > BLOCK_ROWS) & (F.col("members") > 0)).isEmpty():
            break
    else:
        # words that no group tells apart: members and searches are dealt into parts, each part meets each
        parts = lambda n: F.ceil(n * 2 / BLOCK_ROWS).cast("int")
        mine = lambda n: F.pmod(F.xxhash64("word"), parts(n)).cast("int")
        every = lambda n: F.sequence(F.lit(0), parts(n) - 1)
        m, s = F.col("members"), F.col("size") - F.col("members")
        one = F.col("state") < 0
        tiled = rows.withColumn("i", F.explode(F.when(one, F.array(mine(m))).otherwise(every(m)))).withColumn("j", F.explode(F.when(one, every(s)).otherwise(F.array(mine(s)))))
        done.append(tiled.select(F.concat_ws("/", "block", F.col("i").cast("string"), F.col("j").cast("string")).alias("block"), F.lit(LEVELS).alias("level"), "word", "n", "state"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def vectors(words: list[bytes]) -> np.ndarray:
    """How often each word (Latin-1) holds each group of letters, 255 at most."""
    size = np.array([len(w) for w in words])
    level = _LEVEL[np.frombuffer(b"".join(words), np.uint8)]
    out = np.bincount(np.repeat(np.arange(len(words)), size) * LEVELS + level, minlength=len(words) * LEVELS)
    return np.minimum(out, 255).reshape(len(words), LEVELS).astype(np.int16)


def reached(members: np.ndarray, searches: np.ndarray, states: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Depth-first walk of the trie of members (count vectors in lexicographic order) from a level on, with all searches
    at once: (searches, members) within the budget, as numbers of their rows."""
    stack = [(0, len(members), level, np.arange(len(searches)), states)]
    while stack:
        low, high, level, at, state = stack.pop()
        if high - low > LEAF and level < LEVELS:
            cuts = np.flatnonzero(np.diff(members[low:high, level])) + 1
            have = searches[at, level]
            for a, b in zip([low, *(low + cuts)], [*(low + cuts), high], strict=True):
                over = have - members[a, level]
                go = np.where(over == 0, state, np.where((over == 1) & (state == 0), 1, np.where((over == -1) & (state == 1), 2, -1)))
                on = go >= 0
                if on.any():
                    stack.append((int(a), int(b), level + 1, at[on], go[on]))
            continue
        step = max(1, PAIRS // LEAF)
        for first in range(0, len(at), step):
            some, spent = at[first : first + step], state[first : first + step]
            for a in range(low, high, LEAF):
                over = searches[some, None, level:] - members[None, a : min(high, a + LEAF), level:]
                more, less = np.maximum(over, 0).sum(axis=2), np.maximum(-over, 0).sum(axis=2)
                # of what differs still, the deficit comes first
                first_more = (over > 0).argmax(axis=2) if over.shape[2] else more
                first_less = (over < 0).argmax(axis=2) if over.shape[2] else less
                spent_ = spent[:, None]
                fits = (less == 0) & (more == 0)
                fits |= (spent_ == 0) & (more == 1) & ((less == 0) | ((less == 1) & (first_more < first_less)))
                fits |= (spent_ == 1) & (more == 0) & (less == 1)
                q, m = np.nonzero(fits)
                if len(q):
                    yield some[q], m + a


def near(words: list[bytes], pairs: np.ndarray) -> np.ndarray:
    """Of pairs of words, given by number, which are exactly one code point apart."""
    size = np.array([len(w) for w in words])
    letters, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
    sizes = size[pairs]
    both = sizes[:, 0] << 32 | sizes[:, 1]
    out = np.zeros(len(pairs), bool)
    for code in np.unique(both):
        n, m = int(code >> 32), int(code & 0xFFFFFFFF)
        if abs(n - m) > 1:
            continue
        whole = np.flatnonzero(both == code)
        for at in np.array_split(whole, len(whole) * n // BYTES + 1):
            a, b = (letters[start[pairs[at, side], None] + np.arange(k)] for side, k in ((0, n), (1, m)))
            if n == m:
                out[at] = (a != b).sum(axis=1) == 1
                continue
            a, b = (a, b) if n > m else (b, a)
            # some place of the longer word left out gives the shorter one
            front = np.cumprod(np.c_[np.ones(len(at), np.int8), a[:, :-1] == b], axis=1)
            back = np.cumprod(np.c_[np.ones(len(at), np.int8), (a[:, 1:] == b)[:, ::-1]], axis=1)[:, ::-1]
            out[at] = (front * back).any(axis=1)
    return out


def _pairs(table: pa.Table) -> pa.Table:
    words = [w.encode("latin-1") for w in table["word"].to_pylist()]
    n, state, level = table["n"].to_numpy(), table["state"].to_numpy(), table["level"][0].as_py()
    own, ask = np.flatnonzero(state < 0), np.flatnonzero(state >= 0)
    counts = vectors(words)
    own = own[np.argsort(np.ascontiguousarray(counts[own].astype(np.uint8)).view(f"S{LEVELS}").ravel(), kind="stable")]
    found: list[np.ndarray] = []
    held: list[np.ndarray] = []

    def verify() -> None:
        asked = np.concatenate(held)
        held.clear()
        # words of equal counts reach each other: one way is enough
        alike = np.flatnonzero((counts[asked[:, 0]] == counts[asked[:, 1]]).all(axis=1))
        back = [k for k, (i, j) in zip(alike, asked[alike].tolist()) if words[i] <= words[j]]
        asked = np.delete(asked, back, axis=0)
        found.append(asked[near(words, asked)])

    size = 0
    for q, m in reached(counts[own], counts[ask], state[ask], level):
        held.append(np.stack([ask[q], own[m]], axis=1))
        size += len(q)
        if size >= PAIRS:
            verify()
            size = 0
    if held:
        verify()
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    take = lambda side, c: table[c].combine_chunks().take(pa.array(pairs[:, side]))
    return pa.table({"a": take(0, "word"), "a_n": take(0, "n"), "b": take(1, "word"), "b_n": take(1, "n")})


def pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each two near words of words (word, n) once, as a written table."""
    dealt = blocks(words).repartition(4 * partitions(words.sparkSession), "block")
    return stored(dealt.groupBy("block").applyInArrow(_pairs, "a string, a_n long, b string, b_n long"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form), the last form of each word's chain."""
    out = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        told = stored(out.join(further, "root", "left"))
        if told.filter("next is not null").isEmpty():
            return out
        out = told.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row for each word."""
    ready(docs.sparkSession)
    words = stored(occurring(docs, key, text))
    found = pairs(words)
    both = found.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.unionByName(found.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    told = stored(words.join(best, "word", "left").withColumn("has", F.coalesce(-F.col("best.less") >= FACTOR * F.col("n"), F.lit(False))))
    told = told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best.near")).alias("form"), F.when(F.col("has"), -F.col("best.less")).alias("form_n"))
    ends = roots(told.filter("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _sql() -> str:
    """The same in DuckDB: crc32 by its table, near words as those that share a word with one place blanked or left out."""
    table = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    size = f"""CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END"""
    return f"""
    WITH k AS MATERIALIZED (SELECT {table}::BIGINT[] AS t),
    r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}')), '{UPPER}', '{LOWER}') AS run FROM documents WHERE text IS NOT NULL),
    u AS (SELECT doc_id, run, count(*) AS times FROM r GROUP BY ALL),
    b AS (SELECT run, times, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: {size})) AS bytes FROM u),
    h AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes::BIGINT[]), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM b, k),
    d AS (SELECT CASE WHEN h % {ERRORS} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM h),
    w AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM d WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(times) >= {MIN_COUNT}),
    s AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS blank, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
    x AS (SELECT a.word AS a, b.word AS b FROM s a JOIN s b ON a.blank = b.blank AND a.word <> b.word
          UNION SELECT s.word, w.word FROM s JOIN w ON s.short = w.word UNION SELECT w.word, s.word FROM s JOIN w ON s.short = w.word),
    m AS (SELECT x.a AS word, count(*) AS n_near, max(w.n) AS best_n, arg_min(x.b, (-w.n, x.b)) AS best FROM x JOIN w ON w.word = x.b GROUP BY x.a),
    f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {FACTOR} * w.n THEN best END AS form, CASE WHEN best_n >= {FACTOR} * w.n THEN best_n END AS form_n FROM w LEFT JOIN m USING (word)),
    g AS (WITH RECURSIVE g AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
          SELECT g.word, g.root FROM g JOIN f ON f.word = g.root WHERE f.form IS NULL)
    SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN g USING (word)
    """


SQL = _sql()
