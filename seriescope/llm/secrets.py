"""Secret scans with column functions only.

Fixed patterns find assignments, access keys and long hexadecimal runs. Besides, every long run of
key characters is a candidate: a window slides over it, its Shannon entropy follows from character
counts that change by one in and one out, and the run is reported if its entropy passes the bound
of its character class and no allow-list pattern fits.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriescope.llm.common import let, running_starts

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "entropy")

# Fixed patterns of the contract. Shorter matches of the last two can't hide longer ones, so their
# least lengths are in the pattern; an assignment's value is measured after it is matched.
_ASSIGN_KEY = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?"""
_ASSIGN_VALUE = r"[A-Za-z0-9+/_.=-]+"
_ACCESS = r"AKIA[A-Z0-9]{16,}"
_HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6

#: Characters of a window, and of a candidate at least.
WINDOW = 20
_CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
# The 64 + 3 characters of a candidate.
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character classes, the first that fits counts: name, pattern of the whole run, least entropy in bits.
#: Ten digits reach log2 10 = 3.32 bits at most, and 20 random ones hardly ever, so long runs of digits are found more often than short ones.
CLASSES = (
    ("digits", r"^[0-9=_/+-]+$", 3.1),
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 2.8),
    ("one case", r"^(?:[a-z]+|[A-Z]+)$", 3.8),
    ("letters", r"^[A-Za-z=_/+-]+$", 4.0),
    ("alphanumeric", r"^[A-Za-z0-9]+$", 3.4),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.6),
)
#: Runs that fit one of these aren't secrets: UUIDs, placeholders, counted alphabets, dated names.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example|sample|placeholder|changeme|dummy|xxxxx|00000000",
    r"(?i)abcdefgh|12345678|qwerty",
    r"^[a-z]+(?:[-_/][a-z]+)*[-_/][0-9]{1,8}$",
)

_SPANS = "array<struct<start:int,kind:int,end:int>>"

#: Code points of a segment, at least, and of a piece of a run of which the entropy is taken.
SEGMENT, PIECE = 2048, 4096
# Where a text may be cut: no pattern and no candidate goes on behind a character that none of them
# takes, nor over spaces that don't stand beside a colon or an equals sign.
_CUT = r"""(?<=[^A-Za-z0-9+/_.=\-"' :])|(?<=[^ :="'])(?= +[^ :=])"""


def _segments(text: Column) -> Column:
    """The text in segments that hold each span whole, so that work on a span never grows with the text."""
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{SEGMENT}}}.*?(?:{_CUT}|\z)"), F.lit(0))
    return F.when(F.length(text) <= SEGMENT, F.array(text)).otherwise(cut)


def _found(text: Column, kind: int, prefix: str, value: str, least: int = 1) -> Column:
    """Spans of the leftmost non-overlapping matches of ``prefix`` and ``value`` with a value of ``least``.

    Each match of the pattern begins where the last one ended and takes the shortest gap, so lengths
    of gaps and matches add up to the places.
    """
    pattern = F.lit(rf"(?s)\G(.*?)({prefix})({value})")
    part = [F.transform(F.regexp_extract_all(text, pattern, F.lit(i)), F.length) for i in (1, 2, 3)]
    sizes = F.zip_with(F.zip_with(part[0], part[1], lambda g, p: F.struct(g.alias("gap"), p.alias("prefix"))), part[2], lambda s, v: F.struct(s["gap"].alias("gap"), (s["prefix"] + v).alias("match"), v.alias("value")))
    none = F.array().cast(_SPANS)

    def placed(s: Column) -> Column:
        """Linear in the matches: places come from running sums, no list grows match by match."""
        starts = running_starts(F.transform(s, lambda x: x["gap"] + x["match"]))
        fits = F.zip_with(s, starts, lambda x, at: F.when(x["value"] >= least, F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["match"]).alias("end"))))
        return F.filter(fits, lambda x: x.isNotNull())

    return F.when(text.rlike(prefix + value), let(sizes, placed)).otherwise(none)


def _least_sum(run: Column, window: int) -> Column:
    """The least sum(c log2 c) over the counts c of any ``window`` successive characters of ``run``.

    Counts are a string with one character for each of the alphabet, "a" for none. A character that
    enters the window changes one of them, one that leaves it another, and the sum follows.
    """
    weight = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(window + 2)])
    places = F.transform(F.split(run, ""), lambda ch: F.instr(F.lit(_ALPHABET), ch))
    # What leaves as each character enters: nothing until the window is full, then the one before it.
    waiting = F.concat(F.array_repeat(F.lit(None).cast("int"), window - 1), F.array(F.lit(0)))

    def moves(p: Column) -> Column:
        leaves = F.concat(waiting, F.slice(p, 1, F.greatest(F.size(p) - window, F.lit(0))))
        return F.filter(F.flatten(F.zip_with(p, leaves, lambda a, b: F.array(a, -b))), lambda e: e.isNotNull())

    def step(s: Column, e: Column) -> Column:
        at = F.abs(e)
        before = F.ascii(F.substring(s["counts"], at, F.lit(1))) - 97
        after = before + F.signum(e).cast("int")
        counts = F.when(e == 0, s["counts"]).otherwise(F.overlay(s["counts"], F.char(after + 97), at, F.lit(1)))
        total = s["sum"] + F.get(weight, after) - F.get(weight, before)
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(e <= 0, F.least(s["best"], total)).otherwise(s["best"]).alias("best"))

    zero = F.struct(F.lit("a" * len(_ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(window * log2(window)).alias("best"))
    return F.aggregate(let(places, moves), zero, step, lambda s: s["best"])


def window_entropy(run: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of any ``window`` successive characters of ``run``.

    For counts c of a window of n characters it is log2 n - sum(c log2 c) / n. Long runs are taken in
    pieces that share all but one character of a window, so memory is bounded by a piece.
    """
    pieces = F.regexp_extract_all(run, F.lit(rf"(?=(.{{1,{PIECE + window - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    least = F.aggregate(pieces, F.lit(window * log2(window)), lambda s, p: F.least(s, _least_sum(p, window)))
    return F.lit(log2(window)) - least / window


def _suspicious(run: Column, window: int) -> Column:
    """Does the entropy of a candidate pass the bound of its class, and no allow-list pattern fit?"""
    bound = F.lit(None).cast("double")
    for _, pattern, least in reversed(CLASSES):
        bound = F.when(run.rlike(pattern), F.lit(least)).otherwise(bound)
    allowed = run.rlike(ALLOWED[0])
    for pattern in ALLOWED[1:]:
        allowed = allowed | run.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(run, window) >= bound)


def _spans_of(segment: Column, window: int) -> Column:
    """Spans of the fixed patterns and of suspicious candidates outside them, sorted."""
    fixed = F.concat(_found(segment, 0, _ASSIGN_KEY, _ASSIGN_VALUE, LEAST_VALUE), _found(segment, 1, "", _ACCESS), _found(segment, 2, "", _HEX))

    def added(base: Column) -> Column:
        outside = F.filter(_found(segment, 3, "", _CANDIDATE % window), lambda x: ~F.exists(base, lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"])))
        return F.concat(base, F.filter(outside, lambda x: let(F.substring(segment, x["start"] + 1, x["end"] - x["start"]), lambda run: _suspicious(run, window))))

    return F.array_sort(let(fixed, added))


def with_spans(docs: DataFrame, name: str = "spans", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` and the column ``name``: spans (start, kind, end), sorted, of the secrets of each text.

    Places count code points, ends are exclusive, kind is the place in KINDS. Spans of the fixed
    patterns all stay; one found by its entropy is left out where a fixed pattern's span holds it.
    A null or empty text has none. Rows pass unchanged, whatever other columns they have.
    """

    def placed(parts: Column) -> Column:
        def moved(part: Column, at: Column) -> Column:
            return F.transform(_spans_of(part, window), lambda x: F.struct((x["start"] + at).alias("start"), x["kind"].alias("kind"), (x["end"] + at).alias("end")))

        return F.flatten(F.zip_with(parts, running_starts(F.transform(parts, F.length)), moved))

    return docs.withColumn(name, let(_segments(F.coalesce(F.col(text).cast("string"), F.lit(""))), placed))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row (doc_id, n_assign, n_access, n_hex, base, spans) for every row of ``docs``: how many
    spans each fixed pattern has, these listed, and all listed."""
    found = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")))
    fixed = F.filter("spans", lambda x: x["kind"] < 3)

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(3)]
    return found.select("doc_id", *counts, listed(fixed).alias("base"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "<secret>", window: int = WINDOW) -> DataFrame:
    """``docs`` with each secret of ``text`` replaced by ``mark``, spans that overlap by one; all
    columns stay as they are, and so do null texts."""

    def clean(part: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            gap = F.substring(part, s["at"] + 1, x["start"] - s["at"])
            apart = x["start"] >= s["at"]
            return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(apart, F.concat(s["out"], gap, F.lit(mark))).otherwise(s["out"]).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.aggregate(_spans_of(part, window), zero, step, lambda s: F.concat(s["out"], F.substring(part, s["at"] + 1, F.length(part))))

    return docs.withColumn(text, F.array_join(F.transform(_segments(F.col(text)), clean), ""))
