"""SimHash near-duplicates by covering locality-sensitive hashing.

Every pair of fingerprints within the radius agrees on the kept bits of at least one of
2^(radius+1) - 1 structured masks, so candidates are found without a chance of a miss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriescope.llm.common import keyed, per_text, rows_in, shared_checkpoint
from seriescope.llm.components import connected_components

BITS = 64
#: Buckets of up to so many fingerprints are compared within a task; larger ones are split by
#: midpoints, which is exact as well and needs no pairs.
BUCKET = 256
#: Hashes that are unpacked to bits at a time.
BLOCK = 65_536


def fingerprinter(shingle: int = 4) -> Callable[[], Callable[[str], tuple[int]]]:
    """Text -> (fingerprint as a signed long,): the majority of each bit over the XXH64 of its shingles."""

    def make() -> Callable[[str], tuple[int]]:
        import xxhash

        digest = xxhash.xxh64_intdigest

        def fingerprint(text: str) -> tuple[int]:
            words = text.encode("utf-8", "surrogatepass").lower().split()
            if not words:
                return (0,)
            joined = b" ".join(words)
            if len(words) <= shingle:
                hashes = [digest(joined, 42)]
            else:
                length = np.fromiter(map(len, words), np.int64, len(words))
                end = np.cumsum(length + 1) - 1
                hashes = [digest(joined[a:b], 42) for a, b in zip((end - length).tolist(), end[shingle - 1 :].tolist(), strict=False)]
            counts = np.zeros(BITS, np.int64)
            for at in range(0, len(hashes), BLOCK):
                block = np.array(hashes[at : at + BLOCK], dtype="<u8")
                counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
            return (int(bits.view("<i8")[0]),)

        return fingerprint

    return make


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 4) -> DataFrame:
    """(doc_id, th, fp) of every row. Null and empty texts have fingerprint zero."""
    return per_text(keyed(docs, text, id_col), "doc_id long, th long, fp long", fingerprinter(shingle), 2)


def covering_masks(radius: int) -> list[int]:
    """Kept bits of each table: bit i has the label 1 + i mod (2^(radius+1) - 1); mask v keeps the
    bits whose label has an odd inner product with v. For radius differing bits some v in
    radius + 1 dimensions is orthogonal to all their labels, so that mask keeps none of them."""
    size = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(BITS) if ((1 + i % size) & v).bit_count() & 1) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucket_links(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lists of fingerprints -> a spanning set of the links within each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for fps in batch.column(0):
                x = np.array(fps.values.to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64)  # bitwise_count takes absolute values
                near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
                left = np.ones(len(x), bool)
                while left.any():
                    first = int(np.flatnonzero(left)[0])
                    reached, edge = np.zeros(len(x), bool), np.zeros(len(x), bool)
                    edge[first] = True
                    while edge.any():
                        reached |= edge
                        edge = near[edge].any(axis=0) & ~reached
                    others = x[reached & (np.arange(len(x)) != first)]
                    a += others.view(np.int64).tolist()
                    b += [int(x.view(np.int64)[first])] * len(others)
                    left &= ~reached
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _midpoints(masks: list[int], radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(fp, v) -> (fp, v, z): all points within radius/2 in the bits that mask v leaves out.

    Two members of a bucket are within the radius exactly if they share such a point.
    """
    from itertools import combinations

    flips = []
    for m in masks:
        free = [i for i in range(BITS) if not m >> i & 1]
        flips.append(np.array([_signed(sum(1 << i for i in c)) for n in range(radius // 2 + 1) for c in combinations(free, n)], dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for at in range(len(fp)):
                z = fp[at] ^ flips[v[at]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(z), fp[at])), pa.array(np.full(len(z), v[at], np.int32)), pa.array(z)], names=["fp", "v", "z"])

    return run


def fingerprint_links(fps: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links that connect the distinct longs ``fp`` exactly as all pairs within the radius do."""
    if radius < 2 or radius % 2:
        raise ValueError("the radius must be even and at least 2")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(masks)])
    # Each row grows to as many as there are masks, so small inputs must not be coalesced before.
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = fps.repartition(parts, F.xxhash64("fp")).select("fp", F.inline(tables))
    # Written first, so that the join below has plain shuffles on both sides and can split hot buckets.
    sizes = shared_checkpoint(rows.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1"))
    # The same join at all sizes of input: a broadcast would depend on how many buckets there are.
    members = shared_checkpoint(rows.join(sizes.hint("merge"), ["v", "key"]))
    lists = members.where(F.col("n") <= bucket).groupBy("v", "key").agg(F.collect_list("fp").alias("fps"))
    links = lists.select("fps").mapInArrow(_bucket_links(radius), "a long, b long")
    large = members.where(F.col("n") > bucket)
    if not large.isEmpty():
        points = large.select("fp", "v").mapInArrow(_midpoints(masks, radius), "fp long, v int, z long")
        least = points.groupBy("v", "z").agg(F.min("fp").alias("m"), F.count("*").alias("c")).where("c > 1").select("v", "z", "m")
        shared = points.join(least, ["v", "z"]).where("fp > m").select(F.col("fp").alias("a"), F.col("m").alias("b"))
        links = links.unionAll(shared.distinct())
    return links


def _grouped(docs: DataFrame, text: str, id_col: str, shingle: int, radius: int, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, th, fp, root, component_id); root tells groups apart."""
    rows = shared_checkpoint(fingerprints(docs, text, id_col, shingle))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(fingerprint_links(nodes.select("fp"), radius, bucket))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Written first, so that the join with a large component's fingerprints can be split.
    groups = shared_checkpoint(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    ids = placed.join(groups, "root").select("fp", "root", "component_id")
    return rows.join(ids, "fp").select("doc_id", "th", "fp", "root", "component_id")


def near_duplicate_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 4, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """One row (doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id that links within the radius reach, the row's own included.
    Null and empty texts share fingerprint zero and are linked like any other. Null ids are ignored
    in the minimum; a group of null ids only has a null component_id. Repeated rows are all kept;
    other columns of ``docs`` aren't read; an empty table gives an empty result.
    """
    return _grouped(docs, text, id_col, shingle, radius, bucket).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id, null ids last, then
    the smallest hash; of rows equal in both, one stays. All columns pass unchanged."""
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    first = _grouped(docs, text, id_col, shingle, radius).groupBy("root").agg(F.min(rank).alias("rank")).select("rank.doc_id", "rank.th")
    return rows_in(docs, first, "left_semi", text, id_col, once=True)
