"""Benchmark decontamination by winnowing.

The smallest k-gram hash of each run of w k-grams is a fingerprint. A shared span of k + w - 1
words holds a whole run, whose smallest hash is chosen at the same place on both sides, so every
shared window of that length is found from a matching fingerprint. Matches are then extended to
all windows around them, and those are joined on their words: no hash decides a hit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriescope.llm.common import keyed, match_rows, rows_in, shared_checkpoint, small_batches

#: Words of a window.
SPAN = 13
#: Words of a k-gram; a run has SPAN - K + 1 of them.
K = 7
#: Benchmark fingerprints that one pass over the documents looks up (8 bytes each in every
#: worker). A larger benchmark is dealt into blocks of at most so many, each with its own pass.
BLOCK = 4_000_000

# Upper case to lower, all ASCII characters but digits and letters to a space.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CACHE = 200_000


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z in lower case, cut at all ASCII characters but digits and letters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 13)
        return h


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:m].copy()
        for j in range(1, n):
            out *= _BASE
            out += hashes[j : j + m]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def _winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Places of the fingerprints: the last smallest hash of each run of w hashes."""
    m = len(grams) - w + 1
    if m <= 0:
        return np.empty(0, np.int64)
    best, at = grams[:m].copy(), np.arange(m)
    for j in range(1, w):
        less = grams[j : j + m] <= best
        best = np.where(less, grams[j : j + m], best)
        at = np.where(less, np.arange(j, j + m), at)
    return np.unique(at)


def _hashes(words: list[bytes], cache: _WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def _windows(words: list[bytes], starts: list[int], n: int) -> list[dict]:
    return [{"at": p, "n": n, "window": b" ".join(words[p : p + n]).decode("utf-8", "surrogatepass")} for p in starts]


def _item_scan(span: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(item_id, text) -> a row for each window, with the fingerprints of its item on the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHash()
        for b in batches:
            ids, sizes, prints, windows = [], [], [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if not words:
                    continue
                h, n = _hashes(words, cache), min(span, len(words))
                if n < span:
                    fps = _grams(h, n)
                else:
                    g = _grams(h, k)
                    fps = np.unique(g[_winnow(g, span - k + 1)])
                for x in _windows(words, range(len(words) - n + 1), n):
                    ids.append(item)
                    sizes.append(n)
                    windows.append(x["window"])
                    prints.append([] if x["at"] else fps.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(sizes, pa.int32()), pa.array(windows, pa.string()), pa.array(prints, pa.list_(pa.int64()))], names=["item_id", "n", "window", "fps"])

    return run


_FOUND = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("window", pa.string())]))


def _doc_scan(prints: dict[int, np.ndarray], span: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, th, text) -> (doc_id, th, n_words, found): the windows around matching fingerprints.

    ``prints``: sorted fingerprints by the size of their windows.
    """
    w = span - k + 1

    def known(x: np.ndarray, among: np.ndarray) -> np.ndarray:
        return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x

    def starts(h: np.ndarray, n: int, among: np.ndarray) -> list[int]:
        if n < span:
            g = _grams(h, n)
            return np.flatnonzero(known(g, among)).tolist() if len(g) else []
        g = _grams(h, k)
        at = _winnow(g, w)
        at = at[known(g[at], among)] if len(at) else at
        if not len(at):
            return []
        near = np.unique((at[:, None] - np.arange(w)[None, :]).ravel())
        return near[(near >= 0) & (near <= len(h) - span)].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHash()
        for b in batches:
            counts, found = [], []
            for text in b.column(2).to_pylist():
                words = words_of(text)
                h = _hashes(words, cache)
                counts.append(len(words))
                found.append([x for n, among in prints.items() for x in _windows(words, starts(h, n, among), n)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(found, _FOUND)], names=["doc_id", "th", "n_words", "found"])

    return run


def _blocks(fps: DataFrame, block: int) -> Iterator[dict[int, np.ndarray]]:
    """Sorted fingerprints by window size, at most about ``block`` at a time."""
    n = -(-fps.count() // block)
    for i in range(n):
        part = fps.where(F.pmod(F.xxhash64("fp"), F.lit(n)) == i).toPandas()
        yield {int(size): np.sort(g["fp"].to_numpy(np.int64).view(np.uint64)) for size, g in part.groupby("n")}


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text",
    span: int = SPAN, k: int = K, share: int = 20, block: int = BLOCK,
) -> DataFrame:
    """One row for every row of ``docs``: (doc_id, th, n_words, n_hit, n_items, items, contaminated).

    A window is ``span`` consecutive words of an item, or all words of a shorter one; items without
    words have none. n_hit counts the document's words inside occurrences of windows, items are the
    sorted ids, as strings, of the items they are from (a null id counts as ""). contaminated: a
    hit, and share * n_hit >= n_words. A null text has no words. Repeated rows, repeated items and
    null ids are kept as they are; other columns aren't read; an empty table of documents gives an
    empty result, an empty benchmark no hits.
    """
    small_batches(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    parts = shared_checkpoint(items.mapInArrow(_item_scan(span, k), "item_id string, n int, window string, fps array<long>"))
    fps = parts.select("n", F.explode("fps").alias("fp")).distinct()
    # Both are written first, so that the joins with a hot window or a hot item below can be split.
    # Sets of items are numbered, so that a document's windows carry a number instead of a list.
    by_window = shared_checkpoint(parts.groupBy("window", "n").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    sets = shared_checkpoint(by_window.select("items").distinct().withColumn("set_id", F.monotonically_increasing_id()))
    of_window = shared_checkpoint(by_window.join(sets, "items").select("window", "n", "set_id"))

    source = keyed(docs, text, id_col)
    schema = "doc_id long, th long, n_words long, found array<struct<at:int,n:int,window:string>>"
    passes = [shared_checkpoint(source.mapInArrow(_doc_scan(p, span, k), schema)) for p in _blocks(fps, block) or []]
    if not passes:
        passes = [shared_checkpoint(source.mapInArrow(_doc_scan({}, span, k), schema))]
    base = passes[0].select("doc_id", "th", "n_words")
    found = passes[0].select("doc_id", "th", F.inline("found"))
    for more in passes[1:]:
        found = found.unionAll(more.select("doc_id", "th", F.inline("found")))
    hits = found.join(of_window, ["window", "n"])
    per_doc = hits.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans"), F.collect_set("set_id").alias("set_ids"))
    # Words under the spans, which are in order of their starts.
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda s, x: F.struct(F.greatest(s["end"], x["at"] + x["n"]).alias("end"), (s["total"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(s["end"], x["at"]))).alias("total")),
        lambda s: s["total"],
    )
    counted = per_doc.select("doc_id", "th", covered.cast("long").alias("n_hit"), "set_ids")
    named = counted.select("doc_id", "th", "n_hit", F.explode("set_ids").alias("set_id")).join(sets, "set_id")
    named = named.groupBy("doc_id", "th", "n_hit").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = match_rows(base, named, "left", "doc_id", "th").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select(
        "doc_id", "th", "n_words", n_hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", **options: object) -> DataFrame:
    """``docs`` without the contaminated ones; all columns pass unchanged."""
    bad = contamination(docs, benchmark, text, id_col, **options).where("contaminated").select("doc_id", "th").distinct()
    return rows_in(docs, bad, "left_anti", text, id_col)
