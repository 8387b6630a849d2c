"""Evidence about an interval of a signal: values, statistics, scores, references, plot data.

Each operator takes requests, rows (keys, start_idx, end_idx), and answers all of them at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriescope.functions.numeric import finite_or, is_finite
from seriescope.operators.common import keys_in, materialise, per_signal, with_next
from seriescope.operators.decision import MAD_SCALE, beside, medians
from seriescope.operators.intervals import points_in
from seriescope.operators.quantiles import order_statistics
from seriescope.operators.ranges import Tree, deviation_of, mean_of, range_aggregates
from seriescope.operators.windows import centred_range

#: Points that a raw look may return.
RAW_LIMIT = 512
#: Points of context beside a focused plot.
CONTEXT = 128


def clamp(requests: DataFrame, lengths: DataFrame) -> DataFrame:
    """Requests with their ends in order and inside the signal (``lengths``: keys, n)."""
    keys = keys_in(requests)
    r = requests.join(lengths.select(*keys, "n"), keys)
    low, high = F.least("start_idx", "end_idx"), F.greatest("start_idx", "end_idx")

    def inside(x: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(x, F.col("n") - 1)).cast("long")

    return r.withColumns({"__s": inside(low), "__e": inside(high)}).drop("start_idx", "end_idx").withColumnsRenamed({"__s": "start_idx", "__e": "end_idx"})


def raw_segment(points: DataFrame, requests: DataFrame, limit: int = RAW_LIMIT) -> DataFrame:
    """(request columns, status, n_points, idx, value): the points of each request; one of more than
    ``limit`` points gets a row with status ``error`` instead."""
    n = F.col("end_idx") - F.col("start_idx") + 1
    sized = requests.withColumns({"status": F.when(n <= limit, "ok").otherwise("error"), "n_points": n})
    keys = keys_in(requests)
    good = points_in(points.select(*keys, "idx", "value"), sized.where("status = 'ok'"), keys)
    bad = sized.where("status = 'error'").withColumns({"idx": F.lit(None).cast("long"), "value": F.lit(None).cast("double")})
    return good.select(*sized.columns, "idx", "value").unionByName(bad)


def focused_segment(points: DataFrame, requests: DataFrame, lengths: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(request columns, idx, value, inside): the points of each request and some beside it."""
    keys = keys_in(requests)
    r = requests.withColumnsRenamed({"start_idx": "focus_start", "end_idx": "focus_end"})
    wide = clamp(r.withColumns({"start_idx": F.col("focus_start") - context, "end_idx": F.col("focus_end") + context}), lengths).drop("n")
    found = points_in(points.select(*keys, "idx", "value"), wide, keys).drop("start_idx", "end_idx")
    return found.withColumn("inside", F.col("idx").between(F.col("focus_start"), F.col("focus_end")))


def segment_statistics(points: DataFrame, requests: DataFrame) -> DataFrame:
    """(request columns, n_points, mean, std, lo, hi, q05, q25, q50, q75, q95, global_median).

    Counts, moments and extremes come from a tree of blocks; quantiles are narrowed request by request,
    so no task holds a long one, but the points of each request are read for them."""
    keys = keys_in(requests)
    points = materialise(points.select(*keys, "idx", "value"))
    whole = order_statistics(points, F.col("value"), [0.5], keys, "global_median").withColumn("global_median", F.col("global_median")[0])
    v = F.col("value")
    found = range_aggregates(points, requests, {"n_points": ("count", v), "m": ("moments", v), "lo": ("min", v), "hi": ("max", v)}, keys)
    s = found.select(*requests.columns, "n_points", mean_of(F.col("m")).alias("mean"), deviation_of(F.col("m")).alias("std"), "lo", "hi")
    shares = (0.05, 0.25, 0.5, 0.75, 0.95)
    met = materialise(points_in(points, requests.distinct(), keys).select(F.struct(*requests.columns).alias("__row"), "value"))
    cuts = order_statistics(met, v, shares, ["__row"], "__q")
    s = s.withColumn("__row", F.struct(*requests.columns)).join(cuts, "__row", "left")
    s = s.withColumns({f"q{int(q * 100):02d}": F.col("__q")[i] for i, q in enumerate(shares)}).drop("__q", "__row")
    return s.join(whole, keys)


def _scaled(points: DataFrame, value: str) -> DataFrame:
    """Add ``z``: the distance from the signal's median in robust deviations; where these vanish, in
    standard deviations, or 1."""
    keys = keys_in(points)
    s = beside(points, beside(points.groupBy(*keys).agg(F.stddev_pop(value).alias("__std")), medians(points, F.col(value), keys), keys), keys)
    spread = F.when(F.col("__mad") > 1e-12, MAD_SCALE * F.col("__mad")).when(F.col("__std") > 1e-12, F.col("__std")).otherwise(F.lit(1.0))
    return s.withColumn("z", (F.col(value) - F.col("__med")) / spread).drop("__med", "__std", "__mad")


def value_zscores(points: DataFrame, requests: DataFrame) -> DataFrame:
    """(request columns, n_points, max_abs_z): values against the whole signal."""
    keys = keys_in(requests)
    found = points_in(_scaled(materialise(points.select(*keys, "idx", "value")), "value").select(*keys, "idx", "z"), requests, keys)
    return found.groupBy(*requests.columns).agg(F.count("*").alias("n_points"), F.max(F.abs("z")).alias("max_abs_z"))


def difference_zscores(points: DataFrame, requests: DataFrame) -> DataFrame:
    """(request columns, n_points, max_abs_z): steps to the next point against all steps of the
    signal; from the step into the request to the one out of it."""
    keys = keys_in(requests)
    points = materialise(points.select(*keys, "idx", "value"))
    ahead = with_next(points, "value", "__next", keys)
    steps = ahead.select(*keys, "idx", (F.col("__next") - F.col("value")).alias("step")).where("step is not null")
    wide = requests.withColumnsRenamed({"start_idx": "__s", "end_idx": "__e"}).withColumns({"start_idx": F.greatest(F.lit(0), F.col("__s") - 1), "end_idx": F.col("__e")})
    found = points_in(_scaled(steps, "step").select(*keys, "idx", "z"), wide, keys).drop("start_idx", "end_idx").withColumnsRenamed({"__s": "start_idx", "__e": "end_idx"})
    return found.groupBy(*requests.columns).agg(F.count("*").alias("n_points"), F.max(F.abs("z")).alias("max_abs_z"))


def group_screening(scores: DataFrame, requests: DataFrame) -> DataFrame:
    """(request columns, scale, local_mean, local_peak, global_mean, scales_above): scores of each
    scale inside a request and in the whole signal, and how many scales have a peak above zero."""
    keys = keys_in(requests)
    whole = scores.groupBy(*keys, "scale").agg(F.avg("score").alias("global_mean"))
    asked = requests.join(whole.select(*keys, "scale"), keys)
    found = range_aggregates(scores, asked, {"m": ("moments", F.col("score")), "local_peak": ("max", F.col("score"))}, [*keys, "scale"])
    local = found.withColumn("local_mean", mean_of(F.col("m"))).join(whole, [*keys, "scale"])
    above = F.count_if(F.col("local_peak") > 0).over(Window.partitionBy(*requests.columns))
    return local.withColumn("scales_above", above).select(*requests.columns, "scale", "local_mean", "local_peak", "global_mean", "scales_above")


def reference_screening(scores: DataFrame, refs: DataFrame, requests: DataFrame) -> DataFrame:
    """(request columns, scale, similarity, mean, peak, status) of requests with ``reference_id``: how
    alike reference and query are, null if it isn't among the query's nearest (``refs``: scale,
    query_id, ref_id, sim), and the scores of its scale in the whole signal. An id of another form, or
    of a scale without scores, has status ``error``."""
    keys = keys_in(requests)
    p = parse_reference_id(F.col("reference_id"))
    asked = requests.withColumns({"scale": p["scale"], "__q": p["query_id"], "__r": p["ref_id"]})
    whole = scores.groupBy(*keys, "scale").agg(F.avg("score").alias("mean"), F.max("score").alias("peak"))
    near = refs.select(*keys, "scale", F.col("query_id").alias("__q"), F.col("ref_id").alias("__r"), F.col("sim").alias("similarity"))
    joined = asked.join(near, [*keys, "scale", "__q", "__r"], "left").join(whole.withColumn("__has", F.lit(True)), [*keys, "scale"], "left")
    return joined.select(*requests.columns, "scale", "similarity", "mean", "peak", F.when(F.col("__has"), "ok").otherwise("error").alias("status"))


def reference_id(scale: Column, query: Column, ref: Column) -> Column:
    """s{scale}:q{query}:r{reference}, the last two with six digits."""
    return F.format_string("s%d:q%06d:r%06d", scale, query, ref)


def parse_reference_id(text: Column) -> Column:
    """(scale, query_id, ref_id) of such an id; nulls where it isn't one."""
    pattern = r"^s(\d+):q(\d{6}):r(\d{6})$"

    def part(i: int, kind: str) -> Column:
        return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, i)).cast(kind)

    return F.struct(part(1, "int").alias("scale"), part(2, "long").alias("query_id"), part(3, "long").alias("ref_id"))


def envelope(points: DataFrame, columns: int, value: str = "value") -> DataFrame:
    """(keys, idx, value, extreme): of each of ``columns`` buckets of a signal, the first smallest and
    the first largest finite value; all points, unmarked, where there are no more than buckets."""
    keys = keys_in(points)
    sized = per_signal(points, F.count("*").alias("__n")).withColumn("__v", finite_or(F.col(value), None))
    few = sized.where(F.col("__n") <= columns).select(*keys, "idx", F.col(value).alias("value"), F.lit(0).alias("extreme"))
    # Bucket b holds the indices from floor(b n / columns) on.
    b = F.floor((F.col("idx") * columns + columns - 1) / F.col("__n"))
    b = F.when(F.floor(b * F.col("__n") / columns) > F.col("idx"), b - 1).otherwise(b)
    many = sized.where((F.col("__n") > columns) & F.col("__v").isNotNull()).withColumn("__b", F.least(b, F.lit(columns - 1)))
    ends = many.groupBy(*keys, "__b").agg(F.min(F.struct(F.col("__v").alias("v"), F.col("idx").alias("i"))).alias("lo"), F.max(F.struct(F.col("__v").alias("v"), (-F.col("idx")).alias("i"))).alias("hi"))
    both = F.array_distinct(F.array(F.struct(F.col("lo.i").alias("idx"), F.col("lo.v").alias("value")), F.struct((-F.col("hi.i")).alias("idx"), F.col("hi.v").alias("value"))))
    return few.unionByName(ends.select(*keys, F.inline(both)).withColumn("extreme", F.lit(1)))


def extremes_tree(points: DataFrame, value: str = "value", **sizes: int) -> Tree:
    """The tree that ``envelopes`` asks: finite extremes with their first places. It is written once and
    serves plots of any span and width."""
    v = finite_or(F.col(value), None)
    low, high = F.when(v.isNotNull(), F.struct(v.alias("v"), F.col("idx").alias("i"))), F.when(v.isNotNull(), F.struct(v.alias("v"), (-F.col("idx")).alias("i")))
    return Tree(points, {"lo": ("min", low), "hi": ("max", high)}, keys_in(points), **sizes)


def envelopes(tree: Tree, requests: DataFrame, columns: int) -> DataFrame:
    """(request columns, idx, value, extreme): the ``envelope`` of each requested span (start_idx,
    end_idx inside the signal), of at most ``columns`` pairs of extremes. A span of no more points than
    columns gives its finite points, unmarked. A column reads nodes and two blocks, however long it is.
    """
    n = F.col("end_idx") - F.col("start_idx") + 1
    wide = requests.where(n >= 1).select(F.struct(*requests.columns).alias("__span"), *tree.by, n.alias("__width"), F.col("start_idx").alias("__from"))
    parts = wide.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(columns).cast("long"), F.col("__width")) - 1)).alias("__b"))
    few = F.col("__width") <= columns
    first = F.when(few, F.col("__b")).otherwise(F.floor(F.col("__b") * F.col("__width") / columns))
    last = F.when(few, F.col("__b")).otherwise(F.floor((F.col("__b") + 1) * F.col("__width") / columns) - 1)
    asked = parts.select("__span", *tree.by, "__width", (F.col("__from") + first).cast("long").alias("start_idx"), (F.col("__from") + last).cast("long").alias("end_idx"))
    found = tree.ask(asked).where("lo is not null")
    both = F.array_distinct(F.array(F.struct(F.col("lo.i").alias("idx"), F.col("lo.v").alias("value")), F.struct((-F.col("hi.i")).alias("idx"), F.col("hi.v").alias("value"))))
    return found.select("__span", "__width", F.inline(both)).select("__span.*", "idx", "value", F.when(F.col("__width") <= columns, 0).otherwise(1).alias("extreme"))


def shared_limits(points: DataFrame, value: str = "value") -> DataFrame:
    """(keys, lo, hi): finite extremes widened by 5 % of their distance, 1e-6 at least."""
    keys = keys_in(points)
    s = points.where(is_finite(F.col(value))).groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    pad = F.greatest((F.col("__hi") - F.col("__lo")) * 0.05, F.lit(1e-6))
    return s.select(*keys, (F.col("__lo") - pad).alias("lo"), (F.col("__hi") + pad).alias("hi"))


def comparison_panels(requests: DataFrame, refs: DataFrame, starts: DataFrame, lengths: DataFrame, size: int, context: int = CONTEXT) -> DataFrame:
    """(keys, query_id, panel, lo, hi): ranges of one span for a query's focus and its references."""
    keys = keys_in(requests)
    r = requests.join(lengths.select(*keys, "n"), keys).withColumn("span", F.least(F.col("n"), F.greatest(F.col("end_idx") - F.col("start_idx") + 1 + 2 * context, F.lit(size))))
    own = r.select(*keys, "query_id", F.lit("query").alias("panel"), "span", "n", ((F.col("start_idx") + F.col("end_idx")) / 2.0).alias("centre"))
    at = starts.select(*keys, F.col("window_id").alias("ref_id"), (F.col("start_idx") + (size - 1) / 2.0).alias("centre"))
    theirs = r.join(refs.select(*keys, "query_id", "ref_id"), [*keys, "query_id"]).join(at, [*keys, "ref_id"])
    both = own.unionByName(theirs.select(*keys, "query_id", F.concat(F.lit("r"), F.col("ref_id").cast("string")).alias("panel"), "span", "n", "centre"))
    return both.withColumn("range", centred_range(F.col("centre"), F.col("span"), F.col("n"))).select(*keys, "query_id", "panel", "range.lo", "range.hi")


def label_lanes(labels: list[tuple[float, float]], gap: float = 0.0) -> list[int]:
    """The first lane in which each label (left, right), in order of left ends, hits none before it."""
    ends: list[float] = []
    out = [0] * len(labels)
    for i in sorted(range(len(labels)), key=lambda i: labels[i]):
        left, right = labels[i]
        lane = next((k for k, e in enumerate(ends) if e + gap <= left), len(ends))
        if lane == len(ends):
            ends.append(right)
        else:
            ends[lane] = right
        out[i] = lane
    return out
