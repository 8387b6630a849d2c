"""Language identification by compression.

Each language has a raw-content dictionary of excerpts of labelled texts. A text belongs to the
language whose dictionary compresses it best; narrow margins are reported as unreliable.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriescope.llm.common import shared_checkpoint, small_batches

#: Labelled documents a language gives to its dictionary, and characters of each: an excerpt from a
#: place that the document's hash picks. Together they bound what is learned from.
DOCUMENTS, EXCERPT = 192, 768
#: Languages that can be learned: each has a compressor of its own in every task.
LANGUAGES = 128
#: Bytes that are compressed at a time, so that a long text's own past doesn't outweigh the
#: dictionary, with zeros behind them, as a block that gains nothing would be stored without a look
#: at the dictionary.
CHUNK, LEVEL, PADDING = 4096, 9, bytes(64)
#: Share of the runner-up's size by which the best must be smaller to be reliable.
MARGIN = 0.02

UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def letters_of(text: str | None) -> str:
    """The words of a text in lower case, joined by spaces, whatever stands between them; empty if
    it has no letter."""
    words = _WORD.findall((text or "").lower())
    return " ".join(words) if any(c.isalpha() for w in words for c in w) else ""


def held_out(id_col: Column) -> Column:
    """Is the crc32 of the id as text 1 modulo 3? Null ids aren't held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", documents: int = DOCUMENTS, excerpt: int = EXCERPT, languages: int = LANGUAGES) -> dict[str, bytes]:
    """Dictionaries by language from labelled rows that aren't held out, the most frequent language first.

    For each language, each of ``documents`` slots takes the id with the smallest hash of those that
    fall into it, so the sample is bounded and doesn't depend on the order of rows; more than
    ``languages`` labels are an error, as a document of one left out would get a wrong language. Rows without an id or label are ignored; null texts
    and texts without a letter give nothing. Texts are read once, for the chosen ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.where("doc_id is not null and lang is not null").where(~held_out(F.col("doc_id")))
    h = F.xxhash64("doc_id")
    slots = rows.groupBy("lang", F.pmod(F.shiftright(h, 20), F.lit(documents)).alias("slot")).agg(F.min_by("doc_id", h).alias("doc_id"), F.count("*").alias("n"))
    slots = shared_checkpoint(slots)
    names = [r["lang"] for r in slots.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(languages + 1).collect()]
    if len(names) > languages:
        raise ValueError(f"there are more than {languages} languages")
    chosen = slots.where(F.col("lang").isin(names)).select("lang", "doc_id")
    room = F.greatest(F.length("text") - excerpt, F.lit(0)) + 1
    cut = F.substring(F.col("text"), (F.pmod(h, room) + 1).cast("int"), F.lit(excerpt))
    picked = rows.join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min(cut).alias("piece")).where("piece is not null")
    pieces: dict[str, list[bytes]] = {}
    for r in picked.orderBy("lang", F.xxhash64("doc_id"), "doc_id").collect():
        if piece := letters_of(r["piece"]):
            pieces.setdefault(r["lang"], []).append(piece.encode("utf-8", "surrogatepass"))
    return {k: b" ".join(pieces[k]) for k in names if k in pieces}


class Classifier:
    """Sizes of texts under each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        import zstandard as zstd

        self.names = list(dictionaries)
        self.compressors = []
        for content in dictionaries.values():
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, data: bytes) -> list[int]:
        """Bytes that the chunks of ``data`` take under each dictionary."""
        pieces = [data[i : i + CHUNK] + PADDING for i in range(0, len(data), CHUNK)]
        return [sum(len(c.compress(x)) for x in pieces) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, is the margin wide enough?)."""
        data = letters_of(text).encode("utf-8", "surrogatepass")
        if not data or not self.names:
            return UNDETERMINED, 0.0, False
        sizes = self.sizes(data)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        score = 1 / sum(2.0 ** max(-60, sizes[best] - s) for s in sizes)
        others = [s for i, s in enumerate(sizes) if i != best]
        return self.names[best], score, not others or min(others) - sizes[best] >= MARGIN * min(others)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row (doc_id, held_out, lang_pred, score, reliable) for every row of ``docs``.

    Only the text decides. A null text or one without a letter is ``und`` with score 0, and so is
    every text if no language was learned. Equal sizes go to the more frequent language.
    Repeated rows and null ids stay; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    names = ["doc_id", "held_out", "lang_pred", "score", "reliable"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for b in batches:
            made = [classifier.predict(t) for t in b.column(2).to_pylist()]
            lang, score, reliable = zip(*made, strict=True) if made else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(reliable, pa.bool_())], names=names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, reliable boolean")
