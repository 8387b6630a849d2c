"""What the text operators share: row identity, shared checkpoints and batch helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Documents may be long, so batches hold few of them.
BATCH_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it names none, a local session, as in
    tests, gets one of its own; on a cluster that is an error, as no folder of one machine would do."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so that lost executors cost no more than one step."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that long texts don't pile up in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements whose running sums are listed at a time: a list grows by its copy.
_RUN = 256


def running_starts(sizes: Column) -> Column:
    """The sums of the elements before each one of an array of ints."""

    def state(at: Column, out: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), out.alias("out"))

    none = F.array().cast("array<int>")

    def inner(s: Column, run: Column) -> Column:
        return F.aggregate(run, state(s["at"], none), lambda x, n: state(x["at"] + n, F.concat(x["out"], F.array(x["at"]))))

    def over(a: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(a), F.lit(_RUN)), lambda k: F.slice(a, k, _RUN))
        lists = F.aggregate(runs, state(F.lit(0), F.array().cast("array<array<int>>")), lambda s, run: let(inner(s, run), lambda x: state(x["at"], F.concat(s["out"], F.array(x["out"])))), lambda s: s["out"])
        return F.when(F.size(a) > 0, F.flatten(lists)).otherwise(none)

    return let(sizes, over)


def row_hash(text: str = "text", id_col: str = "doc_id") -> Column:
    """Hash of id and text. (id, hash) tells apart rows whose id is null or repeated; rows equal in
    both get equal results. Copies under different ids have different hashes, so no key is hot."""
    return F.xxhash64(F.col(id_col), F.col(text))


def keyed(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, th, text) with th = ``row_hash``; no other column of ``docs`` is read."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(text, id_col).alias("th"), F.col(text).cast("string").alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def match_rows(left: DataFrame, rows: DataFrame, how: str, id_col: str, th: str) -> DataFrame:
    """Join ``left`` with ``rows`` (doc_id, th, ...) on id and hash, null ids being equal. Only the
    hash deals out rows. The keys of ``rows`` get fresh names and are dropped."""
    other_id, other_th = fresh(left, "other_id"), fresh(left, "other_th")
    right = rows.withColumnsRenamed({"doc_id": other_id, "th": other_th})
    x, y = F.col(id_col), F.col(other_id)
    return left.join(right, (F.col(th) == F.col(other_th)) & F.coalesce(x == y, x.isNull() & y.isNull()), how).drop(other_id, other_th)


def rows_in(docs: DataFrame, rows: DataFrame, how: str = "left_semi", text: str = "text", id_col: str = "doc_id", once: bool = False) -> DataFrame:
    """``docs`` whose (id, hash) is (``left_semi``) or isn't (``left_anti``) in ``rows``; ``once``: of
    rows equal in both, one stays. All columns pass unchanged."""
    th = fresh(docs, "row_hash")
    kept = match_rows(docs.withColumn(th, row_hash(text, id_col)), rows, how, id_col, th)
    return (kept.dropDuplicates([id_col, th]) if once else kept).drop(th)


def per_text(df: DataFrame, schema: str, make: Callable[[], Callable[[str], tuple]], keep: int) -> DataFrame:
    """Append columns computed from the last column, a text, dropping that text.

    ``make`` builds, once a task, the function from a text (null: empty) to a tuple of values;
    the first ``keep`` columns pass unchanged. ``schema`` lists all columns of the result.
    """
    small_batches(df.sparkSession)
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            rows = [fn(t or "") for t in b.column(keep).to_pylist()]
            made = list(zip(*rows, strict=True)) if rows else [[]] * (len(arrow) - keep)
            cols = [b.column(i) for i in range(keep)] + [pa.array(v, type=arrow.field(keep + i).type) for i, v in enumerate(made)]
            yield pa.RecordBatch.from_arrays(cols, names=arrow.names)

    return df.mapInArrow(run, target)
