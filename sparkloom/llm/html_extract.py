"""HTML extraction: a host's repeated passages by suffix arrays, and the main text of every page.

Markup is cut into blocks of text with a tokenizer of tags: character references are decoded, white space in a block
becomes one space, and what stands in a navigation, page header, footer, sidebar, advert, form, comment section, script
or style is left out, by the name of its element or a word of its class, id or role that means nothing else. A header
inside an article gives its headings. Other blocks of the page's main container (article or main) are its text.

What place and name don't settle is settled by what a host repeats: blocks of pages without such a container, and blocks
whose class has a word that may mean boilerplate or not (search, share, related, ...). The doubtful blocks of all pages
of a host, and those outside the containers, are laid out in groups of bounded size (dealt by a hash of host, salt and
page, so a hot host fills many groups), each group's blocks become one stream of numbered tokens with a separator of its
own after each block, and a suffix array of the stream (prefix doubling) with its common prefixes gives each run of RUN
tokens once, with the pages of the group that it stands on (a block of fewer tokens is one run). Spark adds these counts
up over the whole host, and the runs that stand on PAGES pages of the host go back to every group that has them; no
group decides alone. A longer repeated substring is covered by its runs of RUN tokens, each repeated on as many pages
at least, and each such run is a repeated substring itself, so the covered tokens are those of all substrings of RUN
tokens or more that PAGES pages share. A block whose tokens are covered in COVERED of its length is boilerplate and
goes; the others are unique and stay.

Article text that many pages quote stays: in a container only doubtful blocks can go.

A null or empty html has an empty text. A null or unreadable url counts as the host "". Repeated rows each get a row;
other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import slices
from .shared import dealt_join, ready, stored

#: Tokens of the shortest run that counts as repeated, distinct pages it stands on, share of a block to cover.
RUN, PAGES, COVERED = 5, 3, 0.8
#: Pages that one suffix array holds.
GROUP = 200

# Element names of the HTML standard.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "head", "title"}
ASIDE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BREAKS = {"address", "article", "aside", "blockquote", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
# Words of a class, id or role that name boilerplate, and those that may.
NAMED = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|footer|sidebar|cookie|cookies|consent|ad|ads|advert|adverts|advertisement|sponsored|comments|respond|breadcrumb|breadcrumbs|newsletter|complementary|contentinfo)(?:$|[\s_-])")
DOUBTED = re.compile(r"(?:^|[\s_-])(?:header|side|notice|banner|promo|comment|related|share|social|popup|modal|widget|search)(?:$|[\s_-])")

_DOUBLE, _SINGLE = (f"{q}(?:[^{q}<]|<(?![a-zA-Z/!]))*+{q}|{q}[^{q}]*+{q}(?=[\\s>])" for q in ('"', "'"))
# a quote that doesn't close before the next tag, or isn't followed by a space, is part of a name
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]|[^\s/>=]+(?:\s*=\s*(?:{_DOUBLE}|{_SINGLE}|[^\s>\"'][^\s>]*)?)?|=)*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")


class _Place:
    """Where the reader of a page stands: open elements and how many of them hide, contain or cast doubt."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool, bool, bool]] = []
        self.hidden = self.main = self.doubted = 0

    def enter(self, name: str, attributes: str) -> None:
        named = " ".join(next(filter(None, x), "") for x in _NAMES.findall(attributes)).lower() if attributes else ""
        plain = name in ("html", "body", "article", "main")
        hides = name in SILENT or name in ASIDE or (name == "header" and not self.main) or bool(named and not plain and NAMED.search(named))
        doubts = bool(named and not plain and DOUBTED.search(named))
        self._add(name, hides, name in ("article", "main"), doubts, 1)
        self.open.append((name, hides, name in ("article", "main"), doubts))

    def leave(self, place: int) -> None:
        for x in self.open[place:]:
            self._add(*x, -1)
        del self.open[place:]

    def _add(self, name: str, hides: bool, main: bool, doubts: bool, n: int) -> None:
        self.hidden += n * hides
        self.main += n * main
        self.doubted += n * doubts

    def last(self, name: str) -> int | None:
        return next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == name), None)

    def shows(self) -> bool:
        """An article's own header shows its headings only."""
        if self.hidden:
            return False
        names = [x[0] for x in self.open]
        return "header" not in names or bool(HEADINGS.intersection(names[names.index("header") :]))


#: What a block's place tells: main text; in a main container, but of a doubtful name; outside of one.
MAIN, DOUBTFUL, OUTSIDE = 0, 1, 2


def blocks(page: str) -> list[tuple[str, int]]:
    """The blocks of a page that neither element nor name marks as boilerplate, and what their place tells."""
    found: list[tuple[str, int]] = []
    run: list[str] = []
    place = _Place()
    at = 0

    def end() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(run))).strip() if run else ""
        run.clear()
        if text:
            found.append((text, OUTSIDE if not place.main else DOUBTFUL if place.doubted else MAIN))

    while True:
        m = _TOKEN.search(page, at)
        upto = m.start() if m else len(page)
        if upto > at and place.shows():
            run.append(page[at:upto])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BREAKS:
            end()
        if m[1]:
            if (opened := place.last(name)) is not None:
                place.leave(opened)
        elif name in ("script", "style"):
            close = re.compile(f"</{name}", re.I).search(page, at)
            at = page.find(">", close.end()) + 1 or len(page) if close else len(page)
        elif name == "br":
            run.append(" ")
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            if name == "p" and any(x[0] == "p" for x in place.open[-3:]):  # a paragraph ends where the next begins
                place.leave(place.last("p"))
            place.enter(name, m[3])
    end()
    return found


def suffix_array(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, length of each one's common prefix with the one before, RUN at most), by prefix doubling up
    to RUN tokens."""
    n = len(stream)
    rank, k = np.unique(stream, return_inverse=True)[1].astype(np.int64), 1
    while k < RUN:
        later = np.full(n, -1, np.int64)
        later[: n - min(k, n)] = rank[min(k, n) :]
        key = rank * (n + 2) + later + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        k *= 2
    order = np.argsort(rank, kind="stable")
    common = np.zeros(n, np.int64)
    one, two = order[1:], order[:-1]
    going = np.ones(max(0, n - 1), bool)
    for j in range(RUN):
        a, b = one + j, two + j
        going &= (a < n) & (b < n)
        going[going] = stream[a[going]] == stream[b[going]]
        common[1:] += going
    return order, common


def _hash(run: str) -> int:
    return xxhash.xxh64_intdigest(run.encode("utf-8", "surrogatepass")) >> 1


def runs(pages: list[list[str]]) -> dict[int, int]:
    """On how many of the pages each run of RUN tokens in a block, or shorter block, stands."""
    numbers: dict[str, int] = {}
    stream, page, words, inside, separators = [], [], [], [], 0
    short: dict[str, set[int]] = {}
    for i, held in enumerate(pages):
        for block in held:
            tokens = block.split(" ")
            if len(tokens) < RUN:
                short.setdefault(block, set()).add(i)
                continue
            separators += 1
            stream += [*(numbers.setdefault(w, len(numbers)) for w in tokens), -separators]
            words += [*tokens, ""]
            page += [i] * (len(tokens) + 1)
            inside += [k + RUN <= len(tokens) for k in range(len(tokens) + 1)]
    found = {_hash(b): len(on) for b, on in short.items()}
    if stream:
        order, common = suffix_array(np.array(stream, np.int64))
        group = np.cumsum(common < RUN)
        whole = np.array(inside)[order]
        order, group = order[whole], group[whole]
        on = np.unique(np.stack([group, np.array(page)[order]], axis=1), axis=0)[:, 0]
        for at, n in zip(order[np.unique(group, return_index=True)[1]], np.unique(on, return_counts=True)[1], strict=True):
            found[_hash(" ".join(words[at : at + RUN]))] = int(n)
    return found


def unique_blocks(held: list[str], repeated: set[int]) -> list[str]:
    """The blocks of a page that repeated runs don't cover."""
    out = []
    for block in held:
        tokens = block.split(" ")
        covered = np.zeros(len(tokens), bool)
        for k in range(max(1, len(tokens) - RUN + 1)):
            if _hash(" ".join(tokens[k : k + RUN])) in repeated:
                covered[k : k + RUN] = True
        if covered.sum() < COVERED * len(tokens):
            out.append(block)
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "html", rows=256, size=4 << 20):
        held = [blocks(h) if h else [] for h in b["html"].to_pylist()]
        columns = [pa.array([[t for t, _ in x] for x in held], pa.list_(pa.string())), pa.array([[k for _, k in x] for x in held], pa.list_(pa.int8()))]
        yield pa.RecordBatch.from_arrays([b["key"], b["url"], *columns], names=["key", "url", "blocks", "places"])


def _runs(table: pa.Table) -> pa.Table:
    doubtful = [[b for b, k in zip(x, y, strict=True) if k != MAIN] for x, y in zip(table["blocks"].to_pylist(), table["places"].to_pylist(), strict=True)]
    found = runs(doubtful)
    n = len(found)
    schema = pa.schema([("host", pa.string()), ("salt", pa.int64()), ("run", pa.int64()), ("pages", pa.int64())])
    return pa.table({"host": table["host"].slice(0, 1).to_pylist() * n, "salt": table["salt"].slice(0, 1).to_pylist() * n, "run": list(found.keys()), "pages": list(found.values())}, schema=schema)


def _unrepeat(table: pa.Table, hits: pa.Table) -> pa.Table:
    repeated = set(hits["run"].to_pylist())
    kept = []
    for held, places in zip(table["blocks"].to_pylist(), table["places"].to_pylist(), strict=True):
        own = min(places) != OUTSIDE  # outside of a container nothing is text if there is one
        kept.append([b for b, k in zip(held, places, strict=True) if k == MAIN or (k == (DOUBTFUL if own else OUTSIDE) and unique_blocks([b], repeated))])
    return pa.table({"key": table["key"], "url": table["url"], "text": pa.array(["\n".join(x) for x in kept], pa.string())})


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars): a row for each row of pages."""
    ready(pages.sparkSession)
    source = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    parsed = stored(source.mapInArrow(_parse, "key long, url string, blocks array<string>, places array<tinyint>"))
    settled = ~F.exists("places", lambda k: k != MAIN)
    certain = parsed.filter(settled).select("key", "url", F.array_join("blocks", "\n").alias("text"))
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    open_ = parsed.filter(~settled).withColumn("host", host)
    sizes = stored(open_.groupBy("host").agg(F.count(F.lit(1)).alias("n")))
    # a hot host's pages are salted where they are
    salted = dealt_join(open_, sizes, "host", "n").withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.ceil(F.col("n") / GROUP)))
    dealt = salted.select("host", "salt", "key", "url", "blocks", "places")
    found = stored(dealt.groupBy("host", "salt").applyInArrow(_runs, "host string, salt long, run long, pages long"))
    repeated = stored(found.groupBy("host", "run").agg(F.sum("pages").alias("n")).filter(F.col("n") >= PAGES).select("host", "run"))
    hits = found.select("host", "salt", "run").join(repeated.hint("merge"), ["host", "run"], "left_semi")
    rest = dealt.groupBy("host", "salt").cogroup(hits.groupBy("host", "salt")).applyInArrow(_unrepeat, "key long, url string, text string")
    both = certain.unionByName(rest)
    return both.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
