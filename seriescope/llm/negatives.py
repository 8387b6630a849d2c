"""Hard negatives by exact inner products, most of which a rotated prefix rules out.

Vectors of integers are turned by the eigenvectors of their second moments, so that the leading
components hold most of each product. The product of the leading components and the norms of what
remains bound a score from both sides; only pairs whose bounds reach what is asked for are verified,
by products of the integers themselves.

The anchors are a stated query set. They are held against all rows in chunks of a bounded size, each
in a scan of its own, in which every task keeps the best few rows of each anchor.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriescope.llm.common import shared_checkpoint, shared_folder, small_batches

#: Anchors of a chunk, which is broadcast, and of a block of products.
CHUNK, BLOCK = 8192, 1024
#: Rows that wait to be merged with the best so far, at least.
MERGE = 4096
#: Share of the second moments that the leading components hold at least.
LEADING = 0.7
#: Components beyond this could overflow a sum of 64 bits; rows with one are verified by Python's integers.
SAFE = 1 << 28
#: What stands for a null id inside: it sorts last.
NO_ID = (1 << 63) - 1

_ROW = "vec_id long, label int, v array<double>"


def usable(rows: DataFrame, vector: str = "embedding", label: str = "label", id_col: str = "vec_id", scale: int = 256) -> DataFrame:
    """(vec_id, label, v) of the rows that take part: v is floor(scale * x) of each component."""
    v = F.col(vector).cast("array<double>")
    fit = F.col(label).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    # Doubles from 2^52 on are whole already.
    scaled = F.transform(v, lambda x: F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return rows.where(F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"), scaled.alias("v"))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of lists as a matrix; shorter ones end with zeros."""
    offsets, flat = column.offsets.to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    width = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def rotation(rows: DataFrame, leading: float = LEADING) -> tuple[np.ndarray, int]:
    """(orthogonal matrix, leading components): eigenvectors of the summed outer products of all rows."""
    small_batches(rows.sparkSession)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            x = _matrix(b.column(0), width)
            total += np.nan_to_num(x.T @ x, nan=0.0, posinf=1e200, neginf=-1e200)  # any rotation is right
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    moments = np.zeros((width, width))
    # Summed by position in the cluster, so the driver gets one matrix.
    cells = rows.select("v").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    for r in cells.collect():
        moments[r["i"], r["j"]] = r["x"]
    values, vectors = np.linalg.eigh((moments + moments.T) / 2)
    order = np.argsort(-values)
    held = np.cumsum(np.maximum(values[order], 0))
    m = int(np.searchsorted(held, leading * held[-1])) + 1 if width and held[-1] > 0 else width
    return vectors[:, order], min(m, width)


class Turned:
    """Rows of integers with their rotated leading components, norms of the remainder and rounding slack."""

    def __init__(self, x: np.ndarray, turn: np.ndarray, leading: int) -> None:
        self.x = x
        y = x @ turn
        self.lead = np.ascontiguousarray(y[:, :leading])
        self.rest = np.sqrt((y[:, leading:] ** 2).sum(axis=1))
        self.norm = np.sqrt((x**2).sum(axis=1))
        self.whole = x.astype(np.int64) if not x.size or np.abs(x).max() < SAFE else None

    def exact(self, at: np.ndarray, other: Turned, where: np.ndarray) -> np.ndarray:
        """Integer products of rows ``at`` with rows ``where`` of ``other``, kept within 64 bits."""
        if self.whole is not None and other.whole is not None:
            return np.einsum("ij,ij->i", self.whole[at], other.whole[where])
        low, high = -(1 << 63), (1 << 63) - 1
        return np.array([min(max(sum(int(p) * int(q) for p, q in zip(self.x[i], other.x[j], strict=True)), low), high) for i, j in zip(at, where, strict=True)], np.int64)


#: Rounding errors of a sum of up to 2^20 products, as a part of the product of norms: far more than occur.
SLACK = 2.0**-30


def bounds(a: Turned, rows: np.ndarray, b: Turned) -> tuple[np.ndarray, np.ndarray]:
    """(product of the leading components, how far the score may be from it) of rows of a with all of b."""
    part = a.lead[rows] @ b.lead.T
    off = np.multiply.outer(a.rest[rows], b.rest) + SLACK * np.multiply.outer(a.norm[rows], b.norm) + 1
    if not (a.norm[rows].max(initial=0) < 1e100 and b.norm.max(initial=0) < 1e100):
        wild = ~np.isfinite(part) | ~np.isfinite(off)
        part[wild], off[wild] = 0, np.inf
    return part, off


class Best:
    """The ``k`` highest (score, smallest id) of each slot."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(slots, -np.inf)
        self.waiting, self.n = [], 0

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        """Rows wait until there are as many as were kept; ``least`` follows with the next merge."""
        self.waiting.append((slot, score, id_))
        self.n += len(slot)
        if self.n >= max(MERGE, len(self.slot)):
            self.merge()

    def merge(self) -> None:
        if not self.n:
            return
        slot, score, id_ = (np.concatenate(x) for x in zip((self.slot, self.score, self.id), *self.waiting, strict=True))
        self.waiting, self.n = [], 0
        order = np.lexsort((id_, ~score, slot))  # ~ falls as the score rises, without overflow
        slot, score, id_ = slot[order], score[order], id_[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff([*first, len(slot)]))
        keep = rank < self.k
        full = rank == self.k - 1
        self.least[slot[full]] = score[full]
        self.slot, self.score, self.id = slot[keep], score[keep], id_[keep]


def _chunks(spark: SparkSession, anchors: DataFrame) -> Iterator[DataFrame]:
    """The rows of ``anchors``, written to the shared folder in files of CHUNK rows at most."""
    folder = f"{shared_folder(spark)}/anchors-{uuid.uuid4().hex}"
    n = anchors.count()
    anchors.repartition(max(1, -(-n // CHUNK))).write.option("maxRecordsPerFile", CHUNK).parquet(folder)
    for file in sorted(spark.read.parquet(folder).inputFiles()) if n else []:
        yield spark.read.schema(anchors.schema).parquet(file)


def _scan(rows: DataFrame, make: Callable[[], object], schema: str) -> DataFrame:
    """Hand the batches of a partition to what ``make`` builds, and give what it kept at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = make()
        for b in batches:
            state.see(b)
        yield state.kept()

    return rows.select("vec_id", "label", "v").mapInArrow(run, schema)


def _ids(b: pa.RecordBatch) -> np.ndarray:
    return b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)


class _Positives:
    """The best rows of the anchors' own labels."""

    def __init__(self, anchors: dict, turn: np.ndarray, leading: int, k: int) -> None:
        self.id, self.label, self.key = anchors["id"], anchors["label"], anchors["key"]
        self.turned, self.turn, self.leading = Turned(anchors["v"], turn, leading), turn, leading
        self.best = Best(len(self.id), k)

    def see(self, b: pa.RecordBatch) -> None:
        ids, labels, x = _ids(b), b.column(1).to_numpy(zero_copy_only=False), _matrix(b.column(2), len(self.turn))
        for label in np.unique(labels):
            mine, theirs = np.flatnonzero(self.label == label), np.flatnonzero(labels == label)
            if not len(mine):
                continue
            seen = Turned(x[theirs], self.turn, self.leading)
            for at in range(0, len(mine), BLOCK):
                block = mine[at : at + BLOCK]
                part, off = bounds(self.turned, block, seen)
                i, j = np.nonzero(part + off >= self.best.least[block][:, None])
                self.best.add(block[i], self.turned.exact(block[i], seen, j), ids[theirs][j])

    def kept(self) -> pa.RecordBatch:
        b = self.best
        b.merge()
        own = np.arange(len(self.id))
        own = self.turned.exact(own, self.turned, own)
        return pa.RecordBatch.from_arrays([pa.array(self.key[b.slot]), pa.array(b.id), pa.array(b.score), pa.array((b.id == self.id[b.slot]) & (b.score == own[b.slot]))], names=["key", "other_id", "score", "own"])


class _Negatives:
    """The best rows of other labels whose scores lie in an interval of each positive."""

    def __init__(self, anchors: dict, turn: np.ndarray, leading: int, k: int, low: int, high: int) -> None:
        self.label, self.key, self.positives = anchors["label"], anchors["key"], anchors["positives"]
        self.turned, self.turn, self.leading = Turned(anchors["v"], turn, leading), turn, leading
        n, self.places = len(self.label), max((len(p) for p in self.positives), default=0)
        # An interval that holds nothing for places without a positive.
        self.low, self.high = np.full((n, self.places), 1, np.int64), np.full((n, self.places), 0, np.int64)
        for i, p in enumerate(self.positives):
            for j, score in enumerate(p):
                self.low[i, j], self.high[i, j] = -(-low * score // 100), high * score // 100
        self.empty = self.low > self.high
        self.best = Best(n * self.places, k)

    def see(self, b: pa.RecordBatch) -> None:
        ids, labels, x = _ids(b), b.column(1).to_numpy(zero_copy_only=False), _matrix(b.column(2), len(self.turn))
        if not self.places:
            return
        seen = Turned(x, self.turn, self.leading)
        for at in range(0, len(self.label), BLOCK):
            block = np.arange(at, min(at + BLOCK, len(self.label)))
            least = self.best.least.reshape(-1, self.places)[block]
            floor = np.where(self.empty[block], np.inf, np.maximum(self.low[block], least))
            ceiling = np.where(self.empty[block], -np.inf, self.high[block].astype(float))
            part, off = bounds(self.turned, block, seen)
            i, j = np.nonzero((part + off >= floor.min(axis=1)[:, None]) & (part - off <= ceiling.max(axis=1)[:, None]) & (self.label[block][:, None] != labels[None, :]))
            score = self.turned.exact(block[i], seen, j)
            for place in range(self.places):
                ok = (score >= floor[i, place]) & (score >= self.low[block[i], place]) & (score <= self.high[block[i], place])
                self.best.add(block[i[ok]] * self.places + place, score[ok], ids[j[ok]])

    def kept(self) -> pa.RecordBatch:
        b = self.best
        b.merge()
        n = max(self.places, 1)
        return pa.RecordBatch.from_arrays([pa.array(self.key[b.slot // n]), pa.array((b.slot % n).astype(np.int32)), pa.array(b.id), pa.array(b.score)], names=["key", "place", "other_id", "score"])


def _collected(chunk: DataFrame, width: int) -> dict:
    """A chunk of anchors as arrays; CHUNK rows at most."""
    got = chunk.toArrow().combine_chunks()
    column = lambda name: got.column(name).combine_chunks()
    out = {"key": column("key").to_numpy(zero_copy_only=False), "label": column("label").to_numpy(zero_copy_only=False), "v": _matrix(column("v"), width)}
    out["id"] = column("vec_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
    if "positives" in got.column_names:
        out["positives"] = column("positives").to_pylist()
    return out


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, leading: float = LEADING,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` and ``anchors`` (vec_id, label, v) hold integers; anchors are rows of ``rows``, too, and no
    positive of their own. An anchor's positives are its ``positives`` best other rows of its label; for
    each, the ``negatives`` best rows of other labels whose score is from ``low`` to ``high`` percent
    of the positive's. Higher scores come first, ties by the smaller id, null ids last.

    Vectors of other lengths count as padded with zeros, scores stop at the ends of 64 bits, repeated
    rows count each (a repeated anchor isn't a positive of itself, its copies are), and empty tables
    give an empty result.
    """
    spark = rows.sparkSession
    small_batches(spark)
    rows = shared_checkpoint(rows)
    turn, m = rotation(rows, leading)
    context = spark.sparkContext
    shared_turn = context.broadcast(turn)
    # Numbered once, so that equal anchors stay apart.
    keyed = shared_checkpoint(anchors.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", "v"))

    def gathered(parts: list[DataFrame], schema: str) -> DataFrame:
        if not parts:
            return spark.createDataFrame([], schema)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out

    found, of = [], "key long, other_id long, score long, own boolean"
    for chunk in _chunks(spark, keyed):
        shared = context.broadcast(_collected(chunk, len(turn)))
        # One more than asked for, as the anchor itself may be among them.
        found.append(shared_checkpoint(_top(_scan(rows, lambda s=shared: _Positives(s.value, shared_turn.value, m, positives + 1), of), ["key"], positives + 1)))
    near = gathered(found, of + ", rank int")
    # The anchor goes once: a row of its id and score can be no other, or is like it.
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("own"), "rank"))
    others = near.withColumn("first", first).where("not (own and first = 1)")
    others = others.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("rank"))).where(F.col("rank") <= positives)
    listed = shared_checkpoint(others.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "other_id", "score"))).alias("found")))

    asked = keyed.join(listed.select("key", F.col("found.score").alias("positives")), "key")
    parts, of = [], "key long, place int, other_id long, score long"
    for chunk in _chunks(spark, asked):
        shared = context.broadcast(_collected(chunk, len(turn)))
        parts.append(shared_checkpoint(_top(_scan(rows, lambda s=shared: _Negatives(s.value, shared_turn.value, m, negatives, low, high), of), ["key", "place"], negatives)))
    top = gathered(parts, of + ", rank int")

    def real(c: str) -> Column:
        return F.when(F.col(c) != NO_ID, F.col(c))

    pairs = listed.select("key", F.posexplode("found").alias("place", "p")).select("key", "place", F.col("p.other_id").alias("positive"), F.col("p.score").alias("positive_score"))
    named = top.join(pairs, ["key", "place"]).join(keyed.select("key", F.col("vec_id").alias("anchor_id")), "key")
    return named.select("anchor_id", real("positive").alias("positive_id"), "rank", real("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _top(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
