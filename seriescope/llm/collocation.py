"""Phrase collocations: exact counts of the phrases that a sketch can't rule out.

Count sketches bound the number of a phrase from above, so no frequent phrase is missed. What passes
goes into Aho-Corasick automata, which count all occurrences, overlaps included, between delimiters;
thresholds and scores come from these counts alone.

1. All pairs of words are counted in the cells of a sketch; cells are summed in the cluster.
2. Longer runs of words, all of whose pairs may be frequent, are counted in a second sketch.
3. A third scan lists the phrases that both sketches leave.
4. The automata scan the texts, and their counts are summed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriescope.llm.common import shared_checkpoint, small_batches

#: Words of a phrase, at most; least occurrences; phrases of a language in the result.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Cells of a row of a sketch: about one for eight pairs of words, within these powers of two. A row's
#: bits (cells that reached ``least``) are broadcast: 32 MB at most.
CELL_BITS = (16, 28)
#: Rows of a sketch, and cells that one reducer sums at a time.
DEPTH, BLOCK_BITS = 2, 20
#: Bytes of text that are hashed at a time, and phrases that a task gathers before it passes them on.
WINDOW, FLUSH = 1 << 21, 1 << 22
#: Counts of phrases that are summed together.
COUNTS = 4096
#: Characters of the phrases of an automaton. More phrases get automata, and scans, of their own.
AUTOMATON = 4 << 20

# What splits pieces, and white space between words.
_DELIMITERS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_DELIMITERS + b"\t", b"\n" * len(_DELIMITERS) + b" ")
_SPACE, _BREAK, _GAP = 32, 10, re.compile(rb"[ \n]")
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_ROUNDS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def plain(text: str | None) -> bytes:
    """The text with A-Z lowered, delimiters as line feeds and tabs as spaces."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_PLAIN)


def _windows(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(own, window): the data in windows cut between words, each with up to LONGEST - 1 words of
    context before its own part, which begins at ``own``."""
    at = 0
    while at < len(data):
        end = at + WINDOW
        if end >= len(data):
            end = len(data)
        else:
            cut = _GAP.search(data, end)
            end = cut.start() if cut else len(data)
        before = data[:at].rsplit(None, LONGEST - 1)
        start = len(before[0]) if len(before) == LONGEST else 0
        yield at - start, data[start:end]
        at = end


class Hasher:
    """Hashes of words and phrases of a window, by prefix sums of powers of an odd number."""

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            size = max(n, WINDOW)
            for name, base in (("powers", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece, hash) of each word."""
        a = np.frombuffer(data, np.uint8)
        self._grow(len(a) + 1)
        inside = np.zeros(len(a) + 2, np.int8)
        inside[1:-1] = (a != _SPACE) & (a != _BREAK)
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.searchsorted(np.flatnonzero(a == _BREAK), start)
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * self.powers[: len(a)], out=sums[1:])
        return start, end, piece, mixed((sums[end] - sums[start]) * self.inverse[start])


def mixed(h: np.ndarray) -> np.ndarray:
    for shift, times in zip((30, 27), _ROUNDS, strict=True):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return h ^ (h >> np.uint64(31))


def cell(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each phrase in a row of the sketch."""
    return (mixed(h + np.uint64(row)) >> np.uint64(64 - bits)).astype(np.int64)


def phrases(h: np.ndarray, piece: np.ndarray, own: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, first word, hash) of the phrases of 2, 3, ... words that end in the window's own part."""
    g = h
    for n in range(2, longest + 1):
        g = g[:-1] * np.uint64(_STEP) + h[n - 1 :]
        at = np.flatnonzero((piece[: len(g)] == piece[n - 1 :]) & own[n - 1 :])
        yield n, at, g[at] + np.uint64(n)


def heavy(h: np.ndarray, sketch: list[np.ndarray], bits: int) -> np.ndarray:
    """May the phrases have reached the threshold? True for all that have."""
    ok = np.ones(len(h), bool)
    for row, marks in enumerate(sketch):
        c = cell(h, row, bits)
        ok &= (marks[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
    return ok


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, data): texts of a language of a batch, one behind the other with breaks between."""
    for b in batches:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text:
                by.setdefault(lang, []).append(plain(text))
        for lang, texts in by.items():
            yield lang, b"\n".join(texts)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(language, window, start, end, piece, hash, own) of the words of each window."""
    import xxhash

    hasher = Hasher()
    for lang, data in _batches(batches):
        seed = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))
        for own, window in _windows(data):
            start, end, piece, h = hasher.words(window)
            yield lang, window, start, end, piece, mixed(h ^ seed), start >= own


class _Cells:
    """Counts of cells that are passed on in blocks."""

    def __init__(self, bits: int, least: int, depth: int) -> None:
        self.bits, self.depth, self.waiting, self.n = bits, depth, [], 0
        self.least, self.kind = least, "<u2" if least < 1 << 16 else "<u4"

    def add(self, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.waiting.append(h)
        self.n += len(h)
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint64)
        self.waiting, self.n = [], 0
        block_bits = min(BLOCK_BITS, self.bits)
        for row in range(self.depth if len(h) else 0):
            c, n = np.unique(cell(h, row, self.bits), return_counts=True)
            n = np.minimum(n, self.least).astype(self.kind)
            low = (c & ((1 << block_bits) - 1)).astype("<u4")
            blocks, first = np.unique(c >> block_bits, return_index=True)
            cuts = [*first.tolist(), len(c)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(blocks), row, np.int32)), pa.array(blocks.astype(np.int32)), pa.array([low[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                 pa.array([n[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["row", "block", "cells", "counts"],
            )


def _reached(bits: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a few blocks -> the bits of their cells that reached ``least``."""
    block_bits, kind = min(BLOCK_BITS, bits), "<u2" if least < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(0, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["row", "block", "marks"])

        for b in batches:  # sorted, so a block's rows follow each other
            for row, block, cells, counts in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if (row, block) != key:
                    if key is not None:
                        yield done()
                    key, total = (row, block), np.zeros(1 << block_bits, np.int64)
                total[np.frombuffer(cells, "<u4")] += np.frombuffer(counts, kind)
        if key is not None:
            yield done()

    return run


def _sketch(cells: DataFrame, bits: int, least: int, depth: int) -> list[np.ndarray]:
    """The bits of each row, whose size depends on ``bits`` only."""
    block_bits = min(BLOCK_BITS, bits)
    size = (1 << block_bits) >> 3
    out = [np.zeros((1 << bits) >> 3, np.uint8) for _ in range(depth)]
    parts = min(depth << (bits - block_bits), int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    summed = cells.repartition(parts, "row", "block").sortWithinPartitions("row", "block").mapInArrow(_reached(bits, least), "row int, block int, marks binary")
    for r in summed.collect():
        out[r["row"]][r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(bytes(r["marks"]), np.uint8)
    return out


_CELLS = "row int, block int, cells binary, counts binary"

#: Automata of a worker process, by the broadcast that they are of.
_BUILT: dict[tuple[str, str], object] = {}


def _automaton(key: str, lang: str, words: list[str]) -> object:
    """The automaton of a language's phrases, built once a worker process."""
    import ahocorasick

    if (key, lang) not in _BUILT:
        for old in [k for k in _BUILT if k[0] != key]:
            del _BUILT[old]
        a = ahocorasick.Automaton()
        for i, w in enumerate(words):
            a.add_word(f" {w} ", i)
        a.make_automaton()
        _BUILT[key, lang] = a
    return _BUILT[key, lang]


def guarded(data: bytes) -> str:
    """Words between single spaces, breaks as words of their own."""
    data = b" " + data.replace(b"\n", b" \n ") + b" "
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data.decode("utf-8", "surrogatepass")


def _source(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))


def candidates(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, bits: int | None = None, depth: int = DEPTH) -> DataFrame:
    """(lang, phrase) of 2 to ``longest`` words: all that occur ``least`` times, and the few that
    share all of their cells with such. ``bits``: cells of a row as a power of two; too few let
    more phrases pass, and none be missed."""
    spark = docs.sparkSession
    small_batches(spark)
    source = _source(docs, text, lang).where("text is not null")
    if bits is None:
        size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(max((size // 48).bit_length(), CELL_BITS[0]), CELL_BITS[1])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Cells(bits, least, depth)
        for *_, piece, h, own in _hashed(batches):
            for _, _, g in phrases(h, piece, own, 2):
                yield from out.add(g)
        yield from out.flush()

    context = spark.sparkContext
    two = context.broadcast(_sketch(source.mapInArrow(pairs, _CELLS), bits, least, depth))

    def longer(h: np.ndarray, piece: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Phrases all of whose pairs may be frequent."""
        first = np.zeros(len(h) + 1, bool)
        for _, at, g in phrases(h, piece, np.ones(len(h), bool), 2):
            first[at] = heavy(g, two.value, bits)
        good = np.concatenate([[0], np.cumsum(~first)])
        for n, at, g in phrases(h, piece, own, longest):
            ok = good[at + n - 1] == good[at]
            yield n, at[ok], g[ok]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Cells(bits, least, depth)
        for *_, piece, h, own in _hashed(batches):
            for n, _, g in longer(h, piece, own):
                if n > 2:
                    yield from out.add(g)
        yield from out.flush()

    more = context.broadcast(_sketch(source.mapInArrow(runs, _CELLS), bits, least, depth))

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[int] = set()
        found: dict[tuple[str, int], list[str]] = {}

        def packed() -> pa.RecordBatch:
            keys = list(found)
            out = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([found[k] for k in keys], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(out, names=["lang", "bucket", "phrases"])

        for name, window, start, end, piece, h, own in _hashed(batches):
            for n, at, g in longer(h, piece, own):
                if n > 2:
                    ok = heavy(g, more.value, bits)
                    at, g = at[ok], g[ok]
                g, where = np.unique(g, return_index=True)
                for x, i in zip(g.tolist(), at[where].tolist(), strict=True):
                    if x not in seen:
                        seen.add(x)
                        phrase = b" ".join(window[start[i] : end[i + n - 1]].split())
                        found.setdefault((name, xxhash.xxh64_intdigest(phrase) % buckets), []).append(phrase.decode("utf-8", "surrogatepass"))
            if len(seen) > FLUSH:
                yield packed()
                seen.clear()
                found.clear()
        yield packed()

    # A task passes on lists of its distinct phrases, dealt by their hash, so rows don't grow with the tasks.
    lists = source.mapInArrow(listed, "lang string, bucket int, phrases array<string>")
    return lists.repartition(buckets, "lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(_distinct, "lang string, phrase string")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list]]:
    """(language, number, values of the third column) of sorted rows."""
    key, values = None, []
    for b in batches:
        for lang, number, value in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if (lang, number) != key:
                if key is not None:
                    yield *key, values
                key, values = (lang, number), []
            values.append(value)
    if key is not None:
        yield *key, values


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, _, lists in _grouped(batches):
        found = sorted(set().union(*lists))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.string())], names=["lang", "phrase"])


def counted(docs: DataFrame, wanted: DataFrame, text: str = "text", lang: str = "lang", automaton: int = AUTOMATON) -> DataFrame:
    """(lang, phrase, f): all contiguous occurrences of the distinct rows (lang, phrase) of ``wanted``.

    The phrases are dealt into automata by a hash until none has more than ``automaton`` characters,
    or holds one phrase; each is broadcast for a scan of its own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sized = wanted.select("lang", "phrase", F.xxhash64("lang", "phrase").alias("__h"), F.length("phrase").alias("__size"))
    groups = 1
    while True:
        sizes = sized.groupBy(F.pmod("__h", F.lit(groups)).alias("g")).agg(F.sum("__size").alias("chars"), F.count("*").alias("n")).where(f"chars > {automaton} and n > 1")
        if sizes.isEmpty():
            break
        groups *= 2
    source = _source(docs, text, lang).where("text is not null")
    out = None
    for k in range(groups):
        by: dict[str, list[str]] = {}
        for r in sized.where(F.pmod("__h", F.lit(groups)) == k).select("lang", "phrase").collect():
            by.setdefault(r["lang"], []).append(r["phrase"])
        shared, key = spark.sparkContext.broadcast(by), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            totals = {name: np.zeros(len(words), np.int64) for name, words in shared.value.items()}
            for name, data in _batches(batches):
                if name in totals:
                    a = _automaton(key, name, shared.value[name])
                    for part in _parts(data):
                        hits = np.fromiter(map(itemgetter(1), a.iter(guarded(part))), np.int64)
                        totals[name] += np.bincount(hits, minlength=len(totals[name]))
            # Counts pass on in blocks, so rows don't grow with the phrases of a task.
            blocks = [(name, i // COUNTS, total[i : i + COUNTS].astype("<i8").tobytes()) for name, total in totals.items() for i in range(0, len(total), COUNTS)]
            cols = list(zip(*blocks, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["lang", "block", "counts"])

        def summed(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for name, block, parts in _grouped(batches):
                total = sum(np.frombuffer(x, "<i8") for x in parts)
                at = np.flatnonzero(total)
                words = shared.value[name]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array([words[block * COUNTS + i] for i in at.tolist()], pa.string()), pa.array(total[at], pa.int64())], names=["lang", "phrase", "f"])

        blocks = source.mapInArrow(scan, "lang string, block int, counts binary")
        found = blocks.repartition("lang", "block").sortWithinPartitions("lang", "block").mapInArrow(summed, "lang string, phrase string, f long")
        found = shared_checkpoint(found)
        out = found if out is None else out.unionAll(found)
    return out


def _parts(data: bytes) -> Iterator[bytes]:
    """Data in parts of about a window, cut at breaks, so that no phrase is cut."""
    at = 0
    while at < len(data):
        cut = data.find(b"\n", at + WINDOW)
        end = len(data) if cut < 0 else cut
        yield data[at:end]
        at = end


def words_of(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, n): the occurrences of words of each language."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, int] = {}
        for name, data in _batches(batches):
            n[name] = n.get(name, 0) + len(data.split())
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["lang", "n"])

    return _source(docs, text, lang).where("text is not null").mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def _words(list_: Column, start: Column, length: Column) -> Column:
    """Words of a list as a phrase."""
    return F.array_join(F.slice(list_, start, length), " ")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, bits: int | None = None, automaton: int = AUTOMATON, salts: int = 16,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    a = f(phrase) is at least ``least``; a cut after k words gives l and r, the counts of both parts,
    and the score floor(1000 a n / (l r)), n being the language's words. The cut with the lowest score
    counts, of equal ones the first. A phrase goes if a longer one that holds it is as frequent; one
    more word is enough to look at, as what lies between is as frequent, too. Order: score and a
    falling, then the phrase by its bytes.

    A null language is ``und``. Null and empty texts hold no word; repeated rows count each; other
    columns aren't read; an empty table gives an empty result.
    """
    found = shared_checkpoint(candidates(docs, text, lang, longest, least, bits))
    # A frequent phrase's parts of two words and more are as frequent, so they are candidates; words are added.
    word = F.explode(F.array_distinct(F.split("phrase", " ")))
    wanted = found.unionAll(found.select("lang", word.alias("phrase")).distinct())
    f = shared_checkpoint(counted(docs, wanted, text, lang, automaton).where(F.col("f") >= least))
    n = words_of(docs, text, lang)

    w, m, k, one = F.col("w"), F.size("w"), F.col("k"), F.lit(1)
    several = f.withColumn("w", F.split("phrase", " ")).where(m > 1).withColumnRenamed("f", "a")
    cuts = several.withColumn("k", F.explode(F.sequence(one, m - 1))).withColumns({"head": _words(w, one, k), "rest": _words(w, k + 1, m)}).drop("w")
    parts = cuts.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    scored = parts.join(n, "lang").withColumns({f"__{c}": x for c, x in wide.items()}).withColumn("score", F.expr("cast((1000 * (__a * __n)) div (__l * __r) as long)"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    best = scored.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")

    shorter = F.array_distinct(F.array(_words(w, one, m - 1), _words(w, F.lit(2), m - 1)))
    held = several.where(m > 2).select("lang", F.explode(shorter).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(held, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    some = kept.withColumn("__salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
