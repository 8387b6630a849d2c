"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target of words, and so each of its documents an expected number of copies. The
whole part is taken; the fractions are rounded together: two documents pass mass in words to each
other, in a direction drawn so that both fractions keep their expectation, until one of them is whole.
The other one goes on to the next document. The words of a source thus stay what they were, but for
the last document's.

Documents of a source are dealt into buckets; what each bucket leaves meets in buckets of a level
above, until one document a source is left: a reduction tree whose nodes run in parallel.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriescope.llm.common import per_text, shared_checkpoint, shared_folder, small_batches

#: Documents of a bucket, and buckets that meet in one of the next level.
BUCKET, FAN = 4096, 64
#: Weights of the sources in their order, repeated; words of the mix and of a source, at most, as parts of their sizes.
WEIGHTS, SHARE, MOST = (3, 1, 2), (3, 2), 2
SEED = 11

_DOC = "doc_id long, th long, source string, size long"


def sized(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, th, source, size) of every row: th is a hash of id and text, size counts words between
    white space; a null text has none."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text)).alias("th"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"),
    )
    return per_text(rows, _DOC, lambda: lambda t: (len(t.encode("utf-8", "surrogatepass").split()),), 3)


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` (source, ...) and ``number``: the place of each in the order of code points, null last.
    Ranges of sources are numbered apart, from the counts of the ranges before them."""
    ordered = [F.col("source").isNull(), F.col("source")]
    ranged = shared_checkpoint(sources.repartitionByRange(*ordered).withColumn("__range", F.spark_partition_id()))
    counts = {r["__range"]: r["n"] for r in ranged.groupBy("__range").agg(F.count("*").alias("n")).collect()}
    before, at = [], 0
    for k in sorted(counts):
        before.append((k, at))
        at += counts[k]
    ahead = sources.sparkSession.createDataFrame(before, "__range int, __before long")
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*ordered))
    return ranged.join(F.broadcast(ahead), "__range").withColumn("number", F.col("__before") + within - 1).drop("__range", "__before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) of each source of ``sizes`` (source, size).

    Together the targets are ``share`` of all words, dealt by weight. A target stops at ``most`` times
    its source; what is over goes to the others by weight, until none is above. Sums are of whole
    numbers, so targets don't depend on the order of rows. A source without words has target 0.
    """
    total = shared_checkpoint(numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))))
    w = F.get(F.array(*map(F.lit, weights)), (F.col("number") % len(weights)).cast("int")).cast("long")
    up, down = share
    state = total.withColumn("weight", w)
    room = state.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    # Words are counted in parts of 1 / down, which makes all sums whole.
    capped, least = 0, None
    while True:
        over = F.lit(False) if least is None else F.col("source_size") * F.lit(most * down) * F.lit(least[1]).cast("decimal(19,0)") < F.col("weight") * F.lit(str(least[0])).cast("decimal(19,0)")
        got = state.withColumn("over", over).agg(
            F.sum(F.when(F.col("over"), F.col("source_size"))).alias("capped"), F.sum(F.when(~F.col("over"), F.col("weight"))).alias("free"), F.count(F.when(F.col("over"), 1)).alias("n"),
        ).first()
        left, free = up * room - most * down * (got["capped"] or 0), got["free"] or 0
        if least is not None and got["n"] == capped or not free:
            break
        capped, least = got["n"], (left, free)
    if not free:
        target = (F.col("source_size") * most).cast("double")
    else:
        target = F.when(over, F.col("source_size") * most).otherwise(F.col("weight") * F.lit(left) / F.lit(free * down))
    return state.withColumn("target", target.cast("double")).select("source", "source_size", "n_docs", "target")


def draw(th: int, level: int, seed: int = SEED) -> float:
    """A number from 0 to 1 that depends on the document, the level and the seed only."""
    import xxhash

    return xxhash.xxh64_intdigest(th.to_bytes(8, "little", signed=True) + level.to_bytes(4, "little"), seed) / 2.0**64


def pass_mass(p: float, s: int, q: float, t: int, u: float) -> tuple[float, float]:
    """Fractions p of a document of s words and q of one of t words, after one pass: p s + q t stays,
    each keeps its expectation over u in [0, 1), and one of them is whole."""
    up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
    if u * (up + down) < down:
        return (1.0 if (1 - p) * s <= q * t else min(p + up / s, 1.0)), (0.0 if q * t <= (1 - p) * s else max(q - up / t, 0.0))
    return (0.0 if p * s <= (1 - q) * t else max(p - down / s, 0.0)), (1.0 if (1 - q) * t <= p * s else min(q + down / t, 1.0))


_STATE = _DOC + ", bucket long, whole int, fraction double"


def _reduced(level: int, seed: int):  # noqa: ANN202
    """Rows sorted by source and bucket -> each with a whole number of copies, but one a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the one row of the bucket whose fraction isn't whole

        def batch(rows: list[list]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "th", "source", "size", "bucket", "whole", "fraction"])

        def whole(row: list) -> list:
            row[5], row[6] = row[5] + int(row[6]), 0.0
            return row

        for b in batches:
            out = []
            for row in map(list, zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if held is not None and (held[2], held[4]) != (row[2], row[4]):
                    out.append(held)
                    held = None
                if row[6] in (0.0, 1.0):
                    out.append(whole(row))
                elif held is None:
                    held = row
                else:
                    held[6], row[6] = pass_mass(held[6], held[3], row[6], row[3], draw(row[1], level, seed))
                    a, held = held, None
                    for x in (a, row):
                        if x[6] in (0.0, 1.0):
                            out.append(whole(x))
                        else:
                            held = x
            yield batch(out)
        if held is not None:
            yield batch([held])

    return run


def copies(sizes: DataFrame, goal: DataFrame, bucket: int = BUCKET, fan: int = FAN, seed: int = SEED) -> DataFrame:
    """(doc_id, th, source, size, copies) of every row of ``sizes``, by the targets ``goal``."""
    spark = sizes.sparkSession
    small_batches(spark)
    folder = f"{shared_folder(spark)}/mix-{uuid.uuid4().hex}"
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = goal.select(F.col("source").alias("__source"), ratio.alias("ratio"), F.ceil(F.col("n_docs") / bucket).alias("buckets"))
    dealt = sizes.join(per, F.col("source").eqNullSafe(F.col("__source"))).select(
        "doc_id", "th", "source", "size", F.pmod(F.xxhash64("th", F.lit(seed)), "buckets").alias("bucket"), F.floor("ratio").cast("int").alias("whole"),
        F.when(F.col("size") > 0, F.col("ratio") - F.floor("ratio")).otherwise(0.0).alias("fraction"),
    )
    level = 0
    most = per.agg(F.max("buckets")).first()[0] or 0
    while most:
        # Longest first, so that what is left in the end is short.
        ordered = dealt.repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.desc("size"), "th", "doc_id")
        ordered.mapInArrow(_reduced(level, seed), _STATE).write.parquet(f"{folder}/level={level}")
        left = spark.read.parquet(f"{folder}/level={level}").where("fraction > 0")
        if most == 1:
            break
        most, level = -(-most // fan), level + 1
        dealt = left.withColumn("bucket", F.floor(F.col("bucket") / fan))
    if not most:
        return sizes.withColumn("copies", F.lit(0)).limit(0)
    # A row that went up a level is counted there; the last one of a source is drawn.
    done = spark.read.parquet(folder).where(f"fraction = 0 or level = {level}")
    chance = F.shiftrightunsigned(F.xxhash64("th", F.lit(seed + 1)), 11) / F.lit(2.0**53)
    more = F.when(chance < F.col("fraction"), 1).otherwise(0)
    return done.select("doc_id", "th", "source", "size", (F.col("whole") + more).alias("copies"))


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST,
    bucket: int = BUCKET, fan: int = FAN, seed: int = SEED,
) -> DataFrame:
    """(doc_id, th, size, source_size, target, copies, taken) of every row of ``docs``.

    ``taken`` = copies x size. A row has the whole part of target / source_size copies or one more. The same rows
    give the same copies however they are dealt: buckets and draws come from a hash of id and text.
    Of rows equal in both the first sorted ones differ from the last, no matter which. A null source is
    one of its own, the last; null ids stay; a null or empty text has size 0 and nothing is taken; an
    empty table gives an empty result; other columns aren't read.
    """
    sizes = shared_checkpoint(sized(docs, text, source, id_col))
    goal = shared_checkpoint(targets(sizes, weights, share, most))
    found = copies(sizes, goal, bucket, fan, seed)
    named = found.join(goal.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    return named.select("doc_id", "th", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
