"""Sharding by extendible hashing.

A row's hash prefix points, through a directory, to a bucket. A bucket over the byte limit splits on
its next bit, others stay, until every bucket fits; each row then belongs to the shortest prefix
whose rows fit together. Prefix sizes are summed in the cluster, no row list is ever held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriescope.llm.common import keyed, shared_checkpoint

#: Bits of the hash: the first 60 of the MD5 of the id as text.
BITS = 60
#: Bits that a round looks at below the depth at which equal shares would fit.
STEP = 6


def hash_bits(id_col: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text; a null id hashes like an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _directory(rows: DataFrame, done: int, bits: int, limit: int) -> DataFrame:
    """(cell, depth): for each prefix of ``bits`` bits in a bucket that fits ``limit``, the bucket's
    depth, the least from ``done`` on.

    Sizes only fall with depth, so a bucket that fits is the one sought exactly if its parent doesn't.
    """
    cells = rows.groupBy(F.shiftright("h", BITS - bits).alias("cell")).agg(F.sum("size").alias("size"))
    bucket = F.expr(f"shiftright(cell, {bits} - depth)")
    at = shared_checkpoint(cells).select("cell", "size", F.explode(F.sequence(F.lit(done), F.lit(bits))).alias("depth")).withColumn("bucket", bucket)
    fits = shared_checkpoint(at.groupBy("depth", "bucket").agg(F.sum("size").alias("total")).where(F.col("total") <= limit).select("depth", "bucket"))
    children = fits.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.shiftleft("bucket", 1), F.shiftleft("bucket", 1) + 1)).alias("bucket"))
    leaves = shared_checkpoint(fits.join(children, ["depth", "bucket"], "left_anti"))
    # Only cells that hold rows: a shallow bucket may have far more cells than there are rows.
    return at.join(leaves, ["depth", "bucket"]).select("depth", "cell")


def assign_shards(docs: DataFrame, limit: int, text: str = "text", id_col: str = "doc_id", step: int = STEP) -> DataFrame:
    """One row (doc_id, n_bytes, depth, shard) for every row of ``docs``.

    n_bytes is the size of the text in UTF-8 (null: 0), shard the bits of its bucket, as text, and
    depth how many they are. Where ids are equal in all 60 bits and together exceed the limit, no
    bit can part them: such rows go to pages of the bucket, named ``bits.part.page``, each within
    the limit. A single text over the limit has a page of its own. Other columns aren't read; an
    empty table gives an empty result.
    """
    if limit < 1:
        raise ValueError("the limit must be positive")
    rows = keyed(docs, text, id_col).select("doc_id", "th", hash_bits(F.col("doc_id")).alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    rows = shared_checkpoint(rows)
    total = rows.agg(F.sum("size").alias("s")).first()["s"] or 0
    bits = min(BITS, max(0, (total // limit).bit_length()) + step)
    done, placed = 0, None
    while True:
        found = _directory(rows, done, bits, limit)
        marked = rows.withColumn("cell", F.shiftright("h", BITS - bits)).join(found, "cell", "left").drop("cell")
        here = marked.where("depth is not null").withColumn("page", F.lit(""))
        placed = here if placed is None else placed.unionByName(here)
        left = marked.where("depth is null").drop("depth")
        if left.isEmpty():
            break
        left = shared_checkpoint(left)
        if bits == BITS:
            placed = placed.unionByName(_pages(left, limit))
            break
        rows, done, bits = left, bits + 1, min(BITS, bits + 2 * step)
    prefix = F.substring(F.lpad(F.bin("h"), BITS, "0"), F.lit(1), F.col("depth"))
    return placed.select("doc_id", F.col("size").alias("n_bytes"), F.col("depth").cast("int").alias("depth"), F.concat(prefix, "page").alias("shard"))


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Pages of rows that no bit parts: each partition fills its own, so no task gets more rows than it read."""
    parted = rows.withColumn("part", F.spark_partition_id())
    order = Window.partitionBy("part", "h").orderBy("th").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Pages of half the limit, by where a row begins: rows of up to half the limit never exceed it,
    # larger ones get pages of their own.
    half = max(1, limit // 2)
    begins = F.sum("size").over(order) - F.col("size")
    small = F.floor(begins / half)
    page = F.when(F.col("size") > half, F.concat(F.lit("x"), F.row_number().over(Window.partitionBy("part", "h").orderBy("th")))).otherwise(small.cast("string"))
    named = parted.withColumn("page", F.concat_ws(".", F.lit(""), F.col("part").cast("string"), page)).withColumn("depth", F.lit(BITS))
    return named.drop("part")


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` as Parquet, a folder a shard. Needs ids that are unique and not null."""
    docs.join(shards.select(F.col("doc_id").alias(id_col), "shard"), id_col).repartition("shard").write.partitionBy("shard").parquet(path)
