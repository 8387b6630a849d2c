"""Quality rules: an isolation forest on rule statistics.

Fixed rules reject documents that are too short or repeat themselves. For the rest, random splits of
the statistics isolate unusual documents early: all statistics are drawn alike, on scales that the
ranks of good documents give. Labelled rows only say from which path length on a document is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriescope.llm.common import keyed, small_batches

#: Labelled rows that fit the forest and its threshold: those with the smallest hash of their id.
LABELLED = 20_000
#: Trees, and rows of which each is grown.
TREES, SAMPLE = 100, 256
#: Statistics that a node may look at before it splits by one; how far outside a node's rows, as a part
#: of their width, a value may lie; the least width, in ranks.
LOOKS, MARGIN, WIDTH = 4, 0.25, 0.1
#: Points of a statistic's scale; where in the gap between good and bad scores the threshold lies.
POINTS, GAP = 1024, 0.25

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"

#: Names of ``statistics``.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_lower", "n_digits", "n_capital_words", "n_single_lines", "n_letterless", "longest", "top_tenth")

# Bytes below 128 that aren't letters or white space.
_MARKS = bytes(c for c in range(128) if not chr(c).isalpha() and c not in _SPACE)


def _repeat_words(ids: np.ndarray, kinds: int) -> int:
    """Words inside 3-word windows that occur more than once; ids are below ``kinds``."""
    if len(ids) < 3:
        return 0
    pairs = ids[:-1] * kinds + ids[1:]
    if kinds > 2_000_000:
        pairs, kinds = np.unique(pairs, return_inverse=True)[1], max(kinds, len(pairs))
    _, which, times = np.unique(pairs[:-1] * kinds + ids[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    hit = np.zeros(len(ids), bool)
    for j in range(3):
        hit[j : len(ids) - 2 + j] |= again
    return int(hit.sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts of BASE and EXTRA over a whole text; a null text has none."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))

    def count(chars: bytes) -> int:
        return len(data) - len(data.translate(None, chars))

    lines = [x for x in data.split(b"\n") if x.strip(_SPACE)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    top = max(1, len(words) // 10)
    longest = np.partition(sizes, len(sizes) - top)[-top:] if len(sizes) else np.zeros(1, np.int64)
    return (
        len(words), len(text) - count(_SPACE), count(_SYMBOLS), len(lines) - len(set(lines)), _repeat_words(ids, max(len(seen), 1)),
        len(lines), count(_UPPER), count(_LOWER), count(_DIGITS), sum(map(bytes.isupper, words)), sum(len(x.split(None, 1)) == 1 for x in lines),
        len(words) - len(data.translate(None, _MARKS).split()), int(longest.max()), int(longest.sum() * 1000 // top),
    )


def base_failed(s: np.ndarray) -> np.ndarray:
    """Fewer than 50 words, or over half of them repeated."""
    return (s[:, 0] < 50) | (100 * s[:, 4] > 50 * s[:, 0])


#: Names of ``features``: what the trees split. Each kind of oddity shows in several.
FEATURES = (
    "characters a word", "symbols a word", "repeated lines", "repeated words", "capitals", "digits", "lines a word", "words", "no letters", "symbols", "words without letters", "longest word",
    "words in capitals", "lines of one word", "long words", "small letters",
)


def features(s: np.ndarray) -> np.ndarray:
    """The statistics as ratios, so that a long document is like a short one; its length itself is
    one of them. None is clipped or weighed here: the splits find what is unusual."""
    s = s.astype(float)
    words, chars, lines = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1), np.maximum(s[:, 5], 1)
    return np.column_stack([
        s[:, 1] / words, np.log1p(s[:, 2] / words), s[:, 3] / lines, s[:, 4] / words, s[:, 6] / np.maximum(s[:, 6] + s[:, 7], 1), s[:, 8] / chars, np.log1p(s[:, 5] / words), np.log(words),
        1 - (s[:, 6] + s[:, 7]) / chars, s[:, 2] / chars, s[:, 11] / words, np.log1p(s[:, 12]), s[:, 9] / words, s[:, 10] / words, s[:, 13] / 1000, s[:, 7] / chars,
    ])


@dataclass(frozen=True)
class Scale:
    """Values of each feature and their ranks among good rows; beyond the last value, ranks go on by
    the distance over the width of the values."""

    values: list[np.ndarray]
    ranks: list[np.ndarray]
    width: np.ndarray

    @classmethod
    def of(cls, good: np.ndarray, all_rows: np.ndarray) -> Scale:
        values, ranks = [], []
        for column in good.T:
            at = np.sort(column)
            u = np.unique(at)
            u = u[np.unique(np.linspace(0, len(u) - 1, min(len(u), POINTS)).round().astype(int))]
            values.append(u)
            ranks.append((np.searchsorted(at, u, "left") + np.searchsorted(at, u, "right")) / 2 / len(at))
        return cls(values, ranks, np.maximum(np.ptp(good, axis=0), np.maximum(all_rows.std(axis=0), 1e-9)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x, dtype=float)
        for i, (u, r, w) in enumerate(zip(self.values, self.ranks, self.width, strict=True)):
            out[:, i] = np.interp(x[:, i], u, r) + (np.minimum(x[:, i] - u[0], 0) + np.maximum(x[:, i] - u[-1], 0)) / w
        return out


@dataclass(frozen=True)
class Forest:
    """Trees as arrays of nodes (leaves lead to themselves), and the least score that is rejected.

    A node looks at LOOKS features, whose values must lie in its rows' ranges or near; a row outside
    is isolated there. ``length`` is the path length of a row that ends in a node."""

    scale: Scale
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    looks: np.ndarray
    low: np.ndarray
    high: np.ndarray
    depth: int
    norm: float
    threshold: float = np.inf

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2^(-mean path length / its expectation): from 0, usual, to 1, isolated at once."""
        x = self.scale(rows)
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            node, left = np.zeros(len(x), np.int64), np.arange(len(x))
            for level in range(self.depth):
                at = node[left]
                v = x[left[:, None], self.looks[t][at]]
                out = ((v < self.low[t][at]) | (v > self.high[t][at])).any(axis=1)
                total[left[out]] += level + 1
                left, at = left[~out], at[~out]
                go = x[left, self.feature[t][at]] < self.cut[t][at]
                node[left] = np.where(go, self.left[t][at], self.right[t][at])
            total[left] += self.length[t][node[left]]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def _expected(n: int) -> float:
    """Mean path length of a failed search among n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(good: np.ndarray, bad: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> Forest:
    """An isolation forest of good rows; bad ones only widen the scales. Each tree has ``sample`` rows.

    Each node draws features evenly, up to LOOKS, until one has different values among its rows; it
    splits by that one at an even place between the least and the largest. A row whose value of one of
    them lies outside what the node's rows have, by more than MARGIN of their width, is isolated there:
    a tree of usual rows would else treat an extreme like the largest row that it has seen."""
    rng = np.random.default_rng(seed)
    scale = Scale.of(good, np.concatenate([good, bad]))
    ranked = scale(good)
    sample, k = max(2, min(sample, len(good))), good.shape[1]
    depth = int(np.ceil(np.log2(sample))) + 1
    grown = []
    for _ in range(trees):
        nodes: list[tuple] = []

        def split(rows: np.ndarray, level: int, nodes: list[tuple] = nodes) -> int:
            me = len(nodes)
            nodes.append((0, np.inf, me, me, level + _expected(len(rows)), [0] * LOOKS, [-np.inf] * LOOKS, [np.inf] * LOOKS))
            low, high = rows.min(axis=0), rows.max(axis=0)
            if level < depth - 1 and (high > low).any():
                looks: list[int] = []
                while len(looks) < LOOKS and not (looks and high[looks[-1]] > low[looks[-1]]):
                    looks.append(int(rng.integers(k)))
                f = looks[-1] if high[looks[-1]] > low[looks[-1]] else int(rng.choice(np.flatnonzero(high > low)))
                cut = float(rng.uniform(low[f], high[f]))
                if cut <= low[f]:
                    cut = float(high[f])
                looks += [looks[-1]] * (LOOKS - len(looks))
                far = MARGIN * np.maximum(high - low, WIDTH)
                go = rows[:, f] < cut
                left, right = split(rows[go], level + 1), split(rows[~go], level + 1)
                nodes[me] = (f, cut, left, right, level, looks, (low - far)[looks].tolist(), (high + far)[looks].tolist())
            return me

        split(ranked[rng.choice(len(good), sample, replace=len(good) < sample)], 0)
        grown.append(nodes)
    size = max(map(len, grown))
    idle = (0, np.inf, 0, 0, 0.0, [0] * LOOKS, [-np.inf] * LOOKS, [np.inf] * LOOKS)
    parts = list(zip(*[zip(*(nodes + [idle] * (size - len(nodes))), strict=True) for nodes in grown], strict=True))
    kinds = (np.int64, float, np.int64, np.int64, float, np.int64, float, float)
    return Forest(scale, *(np.array(p, kind) for p, kind in zip(parts, kinds, strict=True)), depth, _expected(sample))


def calibrate(good: np.ndarray, bad: np.ndarray) -> float:
    """The score from which to reject: the best sum of good rows kept and bad rows rejected, at GAP of
    the way from the good scores to the bad ones; without rows of both kinds nothing is rejected."""
    if not len(good) or not len(bad):
        return np.inf
    cuts = np.unique(np.concatenate([good, bad]))
    kept = np.searchsorted(np.sort(good), cuts, side="left") / len(good)
    caught = 1 - np.searchsorted(np.sort(bad), cuts, side="left") / len(bad)
    best = int(np.argmax(kept + caught))
    below = good[good < cuts[best]]
    return float(below.max() + GAP * (cuts[best] - below.max())) if len(below) else float(cuts[best])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", labelled: int = LABELLED, trees: int = TREES, sample: int = SAMPLE) -> Forest:
    """A forest of labelled good rows, and the threshold that tells labelled rows apart best.

    At most ``labelled`` labelled rows are used, those whose id hashes lowest, so that the sample is
    bounded and the same whatever the order of rows; of several labels of an id the lowest counts, of
    several documents of an id the one with the lowest counts. Rows without a label, text or id and rows that fail the fixed rules don't count. Without good
    rows nothing is rejected by the forest.
    """
    small_batches(docs.sparkSession)
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    rows = keyed(docs, text, id_col).where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    names = ["quality", *BASE, *EXTRA]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(i, q, *statistics(t)) for i, q, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*made, strict=True) if made else [[]] * (len(names) + 1))], names=["doc_id", *names])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names)
    one = rows.mapInArrow(run, schema).groupBy("doc_id").agg(F.min(F.struct(*names)).alias("row")).select("row.*")
    got = one.toPandas().to_numpy(np.int64).reshape(-1, len(names))
    got = got[np.lexsort(got.T)]
    got = got[~base_failed(got[:, 1:])]
    good, bad = features(got[got[:, 0] == 1][:, 1:]), features(got[got[:, 0] != 1][:, 1:])
    if not len(good):
        return grow(np.zeros((2, len(FEATURES))), bad[:0], 1, 2)
    forest = grow(good, bad, trees, sample)
    return replace(forest, threshold=calibrate(forest.scores(good), forest.scores(bad)))


def _verdicts(texts: list[str | None], forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(statistics, base_failed, score, kept) of a batch."""
    s = np.array([statistics(t) for t in texts], np.int64).reshape(-1, len(BASE) + len(EXTRA))
    failed, score = base_failed(s), forest.scores(features(s))
    return s, failed, score, ~failed & (score < forest.threshold)


def judge(docs: DataFrame, forest: Forest, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row (doc_id, the counts of BASE, base_failed, kept, score) for every row of ``docs``.

    A null or empty text has no words and fails. Repeated rows and null ids are kept as they are;
    other columns aren't read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    names = ["doc_id", *BASE, "base_failed", "kept", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, failed, score, kept = _verdicts(b.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[:, i]) for i in range(len(BASE))), pa.array(failed), pa.array(kept), pa.array(score)], names=names)

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in BASE) + ", base_failed boolean, kept boolean, score double"
    return keyed(docs, text, id_col).select("doc_id", "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """``docs`` that pass the rules and the forest; all columns pass unchanged."""
    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(forest), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_verdicts(b.column(at).to_pylist(), shared.value)[3]))

    return docs.mapInArrow(run, docs.schema)

