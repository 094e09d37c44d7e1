"""Language ID by compression: the language whose zstandard raw-content dictionary makes the text smallest.

Learning takes, for each language that has labelled rows, a bounded sample of them (SAMPLE_ROWS, chosen by a hash of the
key) and fills a dictionary of at most DICTIONARY_BYTES with different pieces of their texts by turns: one piece of each
text from a hashed place of it, then the next ones. Predicting compresses every whole text, in
chunks so that the text's own past doesn't outweigh the dictionary, once with each. Letters are compared in lower
case; digits, symbols and runs of white space count as one space, so junk and layout tell nothing.

score: 0 to 1, the winner's lead over the next, from its share of bytes saved. accepted: false when that lead is
narrow for the text's length. A null text, or one without a letter, is `und` with score 0 and isn't accepted. With no
labelled row at all every text is `und`. A tie goes to the first language in order of name. Repeated rows each get a
row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ready

#: Bounds of what is learned from: rows of each language, and bytes of a dictionary.
SAMPLE_ROWS, DICTIONARY_BYTES = 400, 48_000
CHUNK, PIECE = 1_000, 400
#: A lead of less than NARROW of the smaller size, or of less than NARROW_BYTES, is too narrow to tell.
NARROW, NARROW_BYTES = 0.002, 1
_SEARCH = zstandard.ZstdCompressionParameters(min_match=3, search_log=5, target_length=48, strategy=zstandard.STRATEGY_LAZY2, window_log=18, hash_log=17, chain_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)


def normal(texts: pa.Array) -> list[bytes]:
    """Lower-case words with one space between; empty for a null and for a text without a letter."""
    words = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}']+", " ")
    words = pc.if_else(pc.match_substring_regex(words, r"\p{L}"), pc.utf8_trim(words, " "), "")
    return pc.cast(words, pa.binary()).to_pylist()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each text from a hashed place on, around to it again, no more than a dictionary holds."""
    for b in batches:
        out: list[tuple] = []
        for lang, draw, data in zip(b["lang"].to_pylist(), b["draw"].to_pylist(), normal(b["text"]), strict=True):
            n = -(-len(data) // PIECE)
            for turn in range(min(n, DICTIONARY_BYTES // PIECE)):
                at = (draw + turn) % n * PIECE
                out.append((lang, turn, draw, data[at : at + PIECE]))
        columns = zip(*out, strict=True) if out else ((), (), (), ())
        types = (pa.string(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "turn", "draw", "piece"])


def learn(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language, from the rows for which training holds and which have a language and a text.

    Two passes: counts by language, then only the texts whose key's hash falls into the sample; they are cut where they
    are read, so that no task and no row holds more than pieces for one dictionary.
    """
    ready(docs.sparkSession)
    rows = docs.filter(training & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(lang).count().collect()
    if not counts:
        return {}
    scale = 1_000_000_007
    draw = F.pmod(F.xxhash64(F.col(key)), F.lit(scale))
    share = F.create_map(*(F.lit(x) for r in counts for x in (r[lang], min(1.0, SAMPLE_ROWS / r["count"] + 1e-9))))
    sample = rows.select(F.col(lang).cast("string").alias("lang"), draw.alias("draw"), F.col(text).cast("string").alias("text")).filter(F.col("draw") <= scale * F.element_at(share, F.col("lang")))
    cut = sample.mapInArrow(_pieces, "lang string, turn int, draw long, piece binary").groupBy("lang", "piece").agg(F.min(F.struct("turn", "draw")).alias("place"))
    upto = F.sum(F.length("piece") + 1).over(Window.partitionBy("lang").orderBy("place", "piece"))
    held = cut.withColumn("upto", upto).filter(F.col("upto") <= DICTIONARY_BYTES).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("pieces"))
    return {r["lang"]: b" ".join(bytes(x["piece"]) for x in r["pieces"]) for r in held.orderBy("lang").collect()}


class Classifier:
    def __init__(self, contents: dict[str, bytes]):
        self.names = sorted(contents)
        self._by = []
        for n in self.names:
            d = zstandard.ZstdCompressionDict(contents[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=_SEARCH)
            self._by.append(zstandard.ZstdCompressor(dict_data=d, compression_params=_SEARCH))

    def sizes(self, data: bytes) -> list[int]:
        chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        return [sum(len(z.compress(c)) for c in chunks) for z in self._by]

    def predict(self, data: bytes) -> tuple[str, float, bool]:
        """(language, score, accepted) of a normal text."""
        if not data or not self.names:
            return "und", 0.0, False
        found = sorted(zip(self.sizes(data), self.names, strict=True))
        if len(found) == 1:
            return found[0][1], 1.0, True
        (least, name), (second, _) = found[:2]
        lead = second - least
        return name, min(1.0, 0.5 + lead / max(8.0, 0.2 * second)), lead >= max(NARROW_BYTES, NARROW * least)


def classify(docs: DataFrame, contents: dict[str, bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, accepted): a row for each row of docs."""
    ready(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(contents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(held.value)
        for b in batches:
            found = [model.predict(t) for t in normal(b["text"])]
            name, score, accepted = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b["key"], pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                names=["key", "lang_pred", "score", "accepted"],
            )

    out = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return out.mapInArrow(run, "key long, lang_pred string, score double, accepted boolean").withColumnRenamed("key", key)


def kept_rows(docs: DataFrame, contents: dict[str, bytes], text: str = "text") -> DataFrame:
    """docs without the rows whose language can't be told, all columns, judged where they are read (no shuffle)."""
    ready(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(contents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(held.value)
        for b in batches:
            yield b.filter(pa.array([model.predict(t)[2] for t in normal(b[text])], pa.bool_()))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)
