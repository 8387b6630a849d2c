"""Reading signals, annotations, rosters and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriescope.operators.clean import clip_label, interpolate, time_index, to_number
from seriescope.operators.common import keys_in

# Names of columns in order of preference.
TIME_NAMES = ("timestamp", "time", "date", "datetime")
VALUE_NAMES = ("value", "data", "kpi", "metric", "y")
LABEL_NAMES = ("label", "labels", "anomaly", "is_anomaly", "is_anomalous")


def resolve_columns(schema: T.StructType) -> tuple[str | None, str, str | None]:
    """(time, value, label) columns by name, whatever the case; else the first numeric column is the value."""
    by_name: dict[str, str] = {}
    for f in schema.fields:
        by_name.setdefault(f.name.strip().lower(), f.name)

    def first(names: Sequence[str]) -> str | None:
        return next((by_name[n] for n in names if n in by_name), None)

    ts, value, label = first(TIME_NAMES), first(VALUE_NAMES), first(LABEL_NAMES)
    if value is None:
        value = next((f.name for f in schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in (ts, label)), None)
    if value is None:
        raise ValueError("no value column")
    return ts, value, label


def normalise(df: DataFrame, order: str | None = None) -> DataFrame:
    """(keys, idx, ts, value, label) of raw rows: columns by ``resolve_columns``, rows by time, or by
    ``order`` where there is no time; values are numbers with their gaps filled, labels 0 or 1."""
    keys = keys_in(df)
    plain = T.StructType([f for f in df.schema.fields if f.name not in (*keys, order)])
    ts, value, label = resolve_columns(plain)
    if ts is None and order is None:
        raise ValueError("without a time column an order is needed")
    place = F.col(f"`{ts}`") if ts else F.col(order)
    rows = df.select(*keys, place.alias("ts"), to_number(F.col(f"`{value}`")).alias("value"), (clip_label(F.col(f"`{label}`")) if label else F.lit(None).cast("int")).alias("label"), *([F.col(order).alias("__o")] if order else []))
    kind = rows.schema["ts"].dataType
    if isinstance(kind, T.StringType):
        # Text is ordered by what it says: numbers, then times, then other text.
        rows = rows.withColumn("__t", F.struct(F.col("ts").try_cast("double").isNull().alias("a"), F.col("ts").try_cast("double").alias("b"), F.col("ts").try_cast("timestamp").isNull().alias("c"), F.col("ts").try_cast("timestamp").alias("d"), F.col("ts").alias("e")))
    indexed = time_index(rows, "__t" if isinstance(kind, T.StringType) else "ts", *(["__o"] if order else []))
    placed = interpolate(indexed).drop("__o", "__t")
    return placed if ts else placed.withColumn("ts", F.col("idx"))


#: Columns of a CSV line that are looked at.
WIDTH = 64


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(file, name, row_order, header, cells): the lines below the header of each CSV file in ``path``,
    as lists of text, with the file's own header.

    Each line meets the header of its file only, so files may have other columns or another order;
    empty lines are left out. A file of any size is read in parts, its header being the line at its start.
    """

    def listed(row: Column) -> Column:  # parsed once, not once a column
        return F.get(F.transform(F.array(row), lambda r: F.array(*[r[f"c{i}"] for i in range(WIDTH)])), F.lit(0))

    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    schema = ", ".join(f"c{i} string" for i in range(WIDTH))
    text = spark.read.text(path, pathGlobFilter=glob)
    # Lines of a file come in order within a part, parts in that of their offsets.
    line = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("row_order"), F.regexp_replace("value", "^\ufeff", "").alias("value"),
    ).where("trim(value) <> ''")
    heads = line.where("__at = 0").groupBy("file").agg(F.min("row_order").alias("__first"), F.min_by("value", "row_order").alias("__header"))
    heads = heads.select("file", "__first", F.transform(listed(F.from_csv("__header", schema, options)), lambda h: F.lower(F.trim(h))).alias("header"))
    below = line.join(heads, "file").where("row_order > __first")

    # Paths are percent-encoded: a plus sign stands for itself.
    name = F.url_decode(F.replace(F.regexp_extract("file", r"([^/]+)$", 1), F.lit("+"), F.lit("%2B")))
    return below.select("file", name.alias("name"), "row_order", "header", listed(F.from_csv("value", schema, options)).alias("cells"))


def _named(names: Sequence[str]) -> Column:
    """The place in ``header`` of the first of ``names`` that it has, from 1; 0 if none."""
    places = [F.nullif(F.array_position("header", n), F.lit(0).cast("long")) for n in names]
    return F.coalesce(*places, F.lit(0)).cast("int")


def _cell(at: Column) -> Column:
    return F.when(at > 0, F.get("cells", at - 1))


def read_signal_files(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """(dataset, signal_id, row_order, timestamp, value, label) of CSV files, one signal a file named after it.

    Columns are found file by file as ``resolve_columns`` does: by name, whatever the case and order;
    a file without a value column of a known name takes its first other column that holds numbers only.
    A file that has none is an error. All values are text; times missing in a file are null.
    """
    lines = _lines(spark, path, "*.csv").withColumns({"__t": _named(TIME_NAMES), "__v": _named(VALUE_NAMES), "__l": _named(LABEL_NAMES)})
    cell = F.col("c").isNotNull() & (F.trim("c") != "")
    other = lines.where("__v = 0").select("file", "__t", "__l", "header", F.posexplode("cells").alias("p", "c")).where("get(header, p) is not null and p + 1 <> __t and p + 1 <> __l")
    numeric = other.groupBy("file", "p").agg(F.bool_and(F.when(cell, F.col("c").try_cast("double").isNotNull())).alias("numeric")).where("numeric").groupBy("file").agg((F.min("p") + 1).alias("__n"))
    placed = lines.join(numeric, "file", "left").withColumn("__v", F.when(F.col("__v") > 0, F.col("__v")).otherwise(F.coalesce("__n", F.lit(0))))
    value = F.when(F.col("__v") > 0, _cell(F.col("__v"))).otherwise(F.raise_error(F.concat(F.lit("no value column in "), F.col("name"))).cast("string"))
    signal = F.regexp_replace("name", r"\.csv$", "")
    return placed.select(F.lit(dataset).alias("dataset"), signal.alias("signal_id"), "row_order", _cell(F.col("__t")).alias("timestamp"), value.alias("value"), _cell(F.col("__l")).alias("label"))


def select_files(files: DataFrame, cases: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """(name, position) of files (column ``name``) that a case names: by stem, by a beginning
    ``case_`` or anywhere; in order of cases, then names, each file once; at most ``most``."""
    stem = F.regexp_replace("name", r"\.csv$", "")
    rows = files.where(F.col("name").endswith(".csv"))
    if cases:
        listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(cases)])
        fits = F.filter(listed, lambda x: (stem == x["c"]) | F.startswith(F.col("name"), F.concat(x["c"], F.lit("_"))) | F.contains(F.col("name"), x["c"]))
        rows = rows.withColumn("__i", F.array_min(F.transform(fits, lambda x: x["i"]))).where("__i is not null")
    else:
        rows = rows.withColumn("__i", F.lit(0))
    ordered = rows.groupBy("name").agg(F.min("__i").alias("__i")).orderBy("__i", "name")
    if most is not None:
        ordered = ordered.limit(most)
    from pyspark.sql import Window

    return ordered.withColumn("position", F.row_number().over(Window.orderBy("__i", "name"))).drop("__i")  # a list of file names


def parse_annotations(rows: DataFrame, signal: str = "signal", text: str = "anomalies", order: str = "row_order") -> DataFrame:
    """(signal_id, start_value, end_value) from a list of pairs in text, as JSON or as a literal of
    Python: pairs in parentheses or brackets, a comma allowed behind the last. The last row of a
    signal counts, and text that is no such list holds none."""
    last = rows.groupBy(F.col(signal).alias("signal_id")).agg(F.max_by(text, order).alias("t"))
    listed = F.regexp_replace(F.translate("t", "()", "[]"), r",\s*\]", "]")
    pairs = F.from_json(listed, "array<array<double>>")
    whole = F.filter(F.coalesce(pairs, F.array().cast("array<array<double>>")), lambda p: F.size(p) >= 2)
    return last.select("signal_id", F.explode(whole).alias("p")).select("signal_id", F.col("p")[0].alias("start_value"), F.col("p")[1].alias("end_value"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of a CSV with columns signal and anomalies, named or not."""
    raw = spark.read.csv(path, header=False, quote='"', escape='"')
    rows = raw.select(F.col("_c0").alias("signal"), F.col("_c1").alias("anomalies"), F.monotonically_increasing_id().alias("row_order"))
    return parse_annotations(rows.where(F.lower("signal") != "signal"))


def read_roster(spark: SparkSession, path: str, count: int | None = None) -> DataFrame:
    """(dataset, signal_id) of a roster; its pairs must be distinct, be safe parts of a path, and be
    as many as it says (and as ``count`` says)."""
    raw = spark.read.json(path, multiLine=True).select(F.col("count").alias("n"), F.explode("signals").alias("s")).select("n", "s.dataset", "s.signal_id")
    unsafe = F.col("dataset").rlike(r"[/\\]|^\.{1,2}$|^$") | F.col("signal_id").rlike(r"[/\\]|^\.{1,2}$|^$")
    got = raw.agg(F.count("*").alias("rows"), F.count_distinct("dataset", "signal_id").alias("pairs"), F.max("n").alias("n"), F.count_if(unsafe | unsafe.isNull()).alias("unsafe")).first()
    if got["rows"] != got["pairs"] or got["rows"] != got["n"] or got["unsafe"] or (count is not None and got["rows"] != count):
        raise ValueError(f"not a roster: {got}")
    return raw.select("dataset", "signal_id")


def result_name_parts(name: Column) -> Column:
    """(dataset, model, alpha) from ``results_{dataset}_{model}_alpha_{alpha}.csv``."""
    pattern = r"results_([^_]+)_(.+)_alpha_([0-9.eE+-]+?)\.csv$"
    return F.struct(F.regexp_extract(name, pattern, 1).alias("dataset"), F.regexp_extract(name, pattern, 2).alias("model"), F.regexp_extract(name, pattern, 3).try_cast("double").alias("alpha"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, model, alpha, signal, f1) of result files, whatever the order of each one's columns;
    rows with a status other than success are left out."""
    lines = _lines(spark, path, "results_*_alpha_*.csv").withColumn("__p", result_name_parts(F.col("name")))
    status = _cell(_named(["status"]))
    kept = lines.where(status.isNull() | (status == "success"))
    return kept.select("__p.dataset", "__p.model", "__p.alpha", _cell(_named(["signal"])).alias("signal"), _cell(_named(["f1"])).try_cast("double").alias("f1"))


def intervals_of_json(rows: DataFrame, text: str = "text") -> DataFrame:
    """(keys, start_idx, end_idx) of a list of pairs in JSON text; other text holds none."""
    pairs = F.from_json(text, "array<array<long>>")
    return rows.select(*keys_in(rows), F.explode(pairs).alias("p")).where("size(p) >= 2").select(*keys_in(rows), F.col("p")[0].alias("start_idx"), F.col("p")[1].alias("end_idx"))


def intervals_of_csv(rows: DataFrame, text: str = "text") -> DataFrame:
    """(keys, start_idx, end_idx) of CSV text with the columns start and end first."""
    line = rows.select(*keys_in(rows), F.explode(F.slice(F.split(text, "\\r?\\n"), 2, 1 << 30)).alias("l"))
    parts = line.select(*keys_in(rows), F.split("l", ",").alias("c")).where("size(c) >= 2")
    return parts.select(*keys_in(rows), F.col("c")[0].try_cast("double").cast("long").alias("start_idx"), F.col("c")[1].try_cast("double").cast("long").alias("end_idx"))
