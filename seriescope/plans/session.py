"""Review sessions over all signals at once: assessment by windows, turns of tools, verification,
arbitration by evidence, additions.

The reviewer is an interface on DataFrames. A turn calls one tool for all windows, each of which has
its own budget. Given a folder, a session commits each step's result as a table under the hash of
its request; a step that was committed is read again, not repeated.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
from collections.abc import Callable, Iterator, Mapping
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriescope.operators import protocol, windows
from seriescope.operators.common import keys_in, materialise
from seriescope.operators.evidence import RAW_LIMIT
from seriescope.plans.tools import TOOL_BUDGET, TURN_BUDGET, Registry, Tables, check_step

#: Corrections that a reviewer gets after records that break a rule.
CORRECTIONS = 2


#: Makes or reads the table of a step: its name, what asks for it besides the session, and its maker.
Step = Callable[[str, object, Callable[[], DataFrame]], DataFrame]


class Reviewer(Protocol):
    """Makes decision records; ``problems`` are records of its last answer with their violation.

    ``ask`` names the next tool with its requests (keys, window, record_key, start_idx, end_idx) and
    arguments, or nothing to finalize; ``seen`` are the rows of the tools that were called. ``verify``
    decides on every target; its statistics are the rows of value_zscore. ``add`` may report new
    events of windows with targets: records with ``seq``, their order.
    """

    def assess(self, candidates: DataFrame, problems: DataFrame | None) -> DataFrame: ...

    def ask(self, targets: DataFrame, seen: Mapping[str, DataFrame], turn: int) -> tuple[str, DataFrame, dict] | None: ...

    def verify(self, targets: DataFrame, statistics: DataFrame, problems: DataFrame | None) -> DataFrame: ...

    def add(self, targets: DataFrame, seen: Mapping[str, DataFrame], problems: DataFrame | None) -> DataFrame | None: ...


class RuleReviewer:
    """A deterministic reviewer: strong candidates are kept, weak short ones removed, the rest is kept
    with doubt and judged by how far its values lie from the signal's. It looks at the values, too, or
    at a plot where they are too many, and reports no new events."""

    def __init__(self, strong: float = 6.0, weak: float = 3.0) -> None:
        self.strong, self.weak = strong, weak

    def assess(self, candidates: DataFrame, problems: DataFrame | None) -> DataFrame:
        keys = keys_in(candidates)
        sure = F.col("severity") >= self.strong
        return candidates.select(
            *keys, "candidate_id", F.col("start_idx").alias("reviewed_start"), F.col("end_idx").alias("reviewed_end"), F.lit("keep").alias("action"),
            F.col("start_idx").alias("final_start"), F.col("end_idx").alias("final_end"), F.when(sure, 3).otherwise(2).alias("confidence_level"),
            F.when(sure, 0.97).otherwise(0.8).alias("confidence"), F.lit("severity of the screening").alias("rationale"), F.lit(False).alias("evidence_sufficient"),
        )

    def ask(self, targets: DataFrame, seen: Mapping[str, DataFrame], turn: int) -> tuple[str, DataFrame, dict] | None:
        asked = targets.select(*keys_in(targets), "window", "record_key", F.col("reviewed_start").alias("start_idx"), F.col("reviewed_end").alias("end_idx"))
        short = F.col("end_idx") - F.col("start_idx") < RAW_LIMIT
        calls = (("value_zscore", asked), ("inspect_raw_segment", asked.where(short)), ("plot_focused_segment", asked.where(~short)))
        return (*calls[turn], {}) if turn < len(calls) else None

    def verify(self, targets: DataFrame, statistics: DataFrame, problems: DataFrame | None) -> DataFrame:
        keys = keys_in(targets)
        far = statistics.select(*keys, "record_key", "max_abs_z")
        gone = F.coalesce(F.col("max_abs_z") < self.weak, F.lit(False))
        joined = targets.join(far, [*keys, "record_key"], "left")
        null = F.lit(None).cast("long")
        return joined.withColumns({
            "action": F.when(gone, "remove").otherwise(F.col("action")), "final_start": F.when(gone, null).otherwise(F.col("final_start")),
            "final_end": F.when(gone, null).otherwise(F.col("final_end")), "evidence_sufficient": F.lit(True),
        }).select(*targets.columns)

    def add(self, targets: DataFrame, seen: Mapping[str, DataFrame], problems: DataFrame | None) -> DataFrame | None:
        return None


def corrected(ask, lengths: DataFrame, corrections: int = CORRECTIONS) -> DataFrame:  # noqa: ANN001
    """Records from ``ask(problems)`` that break no rule; after so many corrections a remaining problem is an error."""
    problems = None
    for _ in range(corrections + 1):
        records = materialise(ask(problems))
        checked = protocol.violations(records, lengths)
        problems = checked.where("violation is not null")
        if problems.isEmpty():
            return records
    raise ValueError(f"records break the protocol: {[r['violation'] for r in problems.limit(5).collect()]}")


def gather(reviewer: Reviewer, tables: Tables, targets: DataFrame, known: Registry, step: Step) -> tuple[dict[str, DataFrame], DataFrame]:
    """(rows by tool, evidence) of the reviewer's turns. Evidence has a row (keys, window, record_key,
    turn, tool, family, status, focus_start, focus_end) for each request; one without rows failed."""
    keys = keys_in(targets)
    per = [*keys, "window", "record_key"]
    seen: dict[str, DataFrame] = {}
    found: list[DataFrame] = []
    for turn in range(TURN_BUDGET + 1):
        call = reviewer.ask(targets, seen, turn)
        if call is None:
            break
        name, requests, arguments = call
        # The last turn is the final answer's.
        check_step({"type": "call_tool", "tool": name, "arguments": arguments, "focus_interval": (0, 0)}, known, 1, len(found), turn + 1, set())
        asked = materialise(requests.select(*per, "start_idx", "end_idx"))
        outside = asked.join(tables.lengths.select(*keys, "n"), keys, "left").where("n is null or not (0 <= start_idx and start_idx <= end_idx and end_idx < n)")
        if not outside.isEmpty():
            raise ValueError("the focus lies outside the signal")
        result = known.dispatch(name, tables, asked, **arguments)
        focus = asked.withColumnsRenamed({"start_idx": "focus_start", "end_idx": "focus_end"}).withColumns({"turn": F.lit(turn), "tool": F.lit(name), "family": F.lit(result.family)})
        if result.rows is None:
            found.append(focus.withColumn("status", F.lit("error")))
            continue
        seen[name] = step(f"tool_{turn:02d}", [name, arguments], lambda rows=result.rows: rows)
        answered = seen[name].groupBy(*per).agg((F.min("status") if "status" in seen[name].columns else F.lit("ok")).alias("status"))
        # "error" sorts before "ok".
        found.append(focus.join(answered, per, "left").withColumn("status", F.coalesce("status", F.lit("error"))))
    nothing = targets.sparkSession.createDataFrame([], "turn int, tool string, family string, status string, focus_start long, focus_end long")
    evidence = targets.select(*per).limit(0).crossJoin(nothing)
    for e in found:
        evidence = evidence.unionByName(e)
    return seen, materialise(evidence)


def _additions(reviewer: Reviewer, targets: DataFrame, seen: Mapping[str, DataFrame], plan: DataFrame, occupied: DataFrame, lengths: DataFrame, corrections: int) -> DataFrame | None:
    """New events that break no rule, overlap neither occupied intervals nor each other, and whose
    home windows have targets; None if there are none."""
    keys = keys_in(targets)
    problems = None
    for _ in range(corrections + 1):
        made = reviewer.add(targets, seen, problems)
        if made is None:
            return None
        checked = materialise(protocol.violations(made, lengths).withColumn("violation", F.coalesce("violation", F.when(F.col("candidate_id").isNotNull() | (F.col("action") != "add"), F.lit("not_add")))))
        homed = homes(checked, plan)
        away = homed.join(targets.select(*keys, "window").distinct(), [*keys, "window"], "left_anti").select(*checked.columns).withColumn("violation", F.coalesce("violation", F.lit("other_window")))
        taken = protocol.conflicting_additions(checked, occupied).withColumn("violation", F.coalesce("violation", F.lit("overlap")))
        problems = materialise(checked.where("violation is not null").unionByName(away).unionByName(taken))
        if problems.isEmpty():
            return homed.drop("violation").withColumn("record_key", protocol.record_key())
    raise ValueError(f"additions break the protocol: {[r['violation'] for r in problems.limit(5).collect()]}")


def homes(records: DataFrame, plan: DataFrame) -> DataFrame:
    """``records`` with the ``window`` of the plan whose core holds the midpoint of what was reviewed."""
    placed = records.withColumns({"start_idx": F.col("reviewed_start"), "end_idx": F.col("reviewed_end")})
    return windows.home_windows(placed, plan).drop("start_idx", "end_idx")


def run_session(points: DataFrame, candidates: DataFrame, reviewer: Reviewer, corrections: int = CORRECTIONS, scores: DataFrame | None = None, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records with a verdict, final intervals) of the candidates (candidate_id, start_idx, end_idx,
    severity) of all signals.

    Removals, refinements and additions need evidence of two families, one of them numeric, from
    tools called in the record's home window. ``root``: a folder to commit steps to and go on from.
    """
    keys = keys_in(candidates)
    # Every step looks at them, so they are written first and not made again by each.
    points, candidates = materialise(points), materialise(candidates)
    lengths = materialise(points.groupBy(*keys).agg(F.count("*").alias("n")))
    request = [type(reviewer).__name__, sorted(map(repr, vars(reviewer).items())), corrections, *[_content(t) for t in (points, candidates, scores)]] if root else None

    answered: list[str] = []

    def step(name: str, more: object, make) -> DataFrame:  # noqa: ANN001
        if not root:
            return materialise(make())
        # A step asks for what all steps before it asked for, too.
        asked = [request, more, answered[-1] if answered else None]
        rows = committed(points.sparkSession, root, name, asked, make)
        answered.append(fingerprint([name, asked]))
        return rows

    plan = step("windows", None, lambda: windows.assessment_windows(lengths, candidates))
    first = step("assessment", None, lambda: corrected(lambda p: reviewer.assess(candidates, p), lengths, corrections))
    missed = protocol.coverage(candidates, first)
    if not missed.isEmpty():
        raise ValueError("not every candidate was assessed once and unchanged")
    ordered = first.where("candidate_id is null").withColumn("seq", F.monotonically_increasing_id())
    if not ordered.isEmpty() and not protocol.conflicting_additions(ordered, candidates).isEmpty():
        raise ValueError("an added event overlaps a candidate or another addition")
    first = materialise(homes(first, plan).withColumn("record_key", protocol.record_key()))
    targets = protocol.verification_targets(first)
    tables = Tables(points, lengths, scores)
    seen, evidence = gather(reviewer, tables, targets, Registry(), step)
    statistics = seen.get("value_zscore", targets.select(*keys, "record_key", F.lit(None).cast("long").alias("n_points"), F.lit(None).cast("double").alias("max_abs_z")).limit(0))
    second = step("verification", None, lambda: corrected(lambda p: reviewer.verify(targets, statistics, p), lengths, corrections))
    decided = second.groupBy(*keys, "record_key").agg(F.count("*").alias("answers"), F.bool_or(F.col("action") == "add").alias("adds"))
    known = targets.select(*keys, "record_key", F.lit(True).alias("asked"))
    if not known.join(decided, [*keys, "record_key"], "full").where("asked is null or answers is null or answers <> 1 or adds").isEmpty():
        raise ValueError("every target must be decided once, and none by ADD")
    supported = protocol.evidence_support(second, evidence, ("window",))
    guarded = supported.withColumn("evidence_sufficient", F.col("evidence_sufficient") & F.col("supported")).drop("supported")
    judged = protocol.arbitrate(targets, guarded.select(*targets.columns))
    settled = first.join(targets.select(*keys, "record_key"), [*keys, "record_key"], "left_anti").withColumn("verdict", F.lit("assessment_final"))
    records = settled.unionByName(judged)
    places = [candidates.select(*keys, "start_idx", "end_idx"), *[r.where("final_start is not null").select(*keys, F.col("final_start").alias("start_idx"), F.col("final_end").alias("end_idx")) for r in (first, second)]]
    added = _additions(reviewer, targets, seen, plan, places[0].unionByName(places[1]).unionByName(places[2]), lengths, corrections)
    if added is not None:
        judged_new = protocol.accepted_additions(protocol.evidence_support(added, evidence, ("window",)))
        records = records.unionByName(judged_new.where("accepted").withColumn("verdict", F.lit("new_add_accepted")).select(*records.columns))
    final = step("records", None, lambda: records)
    return final, protocol.final_intervals(final)


def _content(table: DataFrame | None) -> list[str] | None:
    """What tells a table's content from another's, whatever the order of its rows."""
    if table is None:
        return None
    row = table.agg(F.count("*"), F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)")), F.sum(F.crc32(F.to_json(F.struct("*")).cast("binary")))).first()
    return [*table.columns, *map(str, row)]


def fingerprint(value: object) -> str:
    """SHA-256 of the canonical JSON of a value."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def committed(spark: SparkSession, root: str, step: str, request: object, make) -> DataFrame:  # noqa: ANN001
    """The table of a step: read where it was committed for the same request, else made and written;
    a commit for another request is an error. Each attempt to make it is logged beside it (request,
    event, error)."""
    mine = fingerprint(request)
    table = f"{root}/{step}"
    try:
        seen = spark.read.text(f"{table}/request").first()["value"]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        seen = None
    if seen is not None and seen != mine:
        raise ValueError(f"step {step} was committed for another request")

    def log(event: str, error: str | None = None) -> None:
        spark.createDataFrame([(mine, event, error)], "request string, event string, error string").coalesce(1).write.mode("append").json(f"{table}/attempts")

    if seen is None:
        log("started")
        try:
            make().write.mode("overwrite").parquet(f"{table}/rows")
        except Exception as e:
            log("failed", f"{type(e).__name__}: {e}"[:500])
            raise
        log("completed")
        spark.createDataFrame([(mine,)], "value string").coalesce(1).write.mode("overwrite").text(f"{table}/request")
    return spark.read.parquet(f"{table}/rows")


def check_identity(old: Mapping[str, object] | None, new: Mapping[str, object]) -> None:
    """An experiment goes on only with the same model, budgets, roster and hashes."""
    if old is not None:
        changed = sorted(k for k in {*old, *new} if old.get(k) != new.get(k))
        if changed:
            raise ValueError(f"another experiment's output: {', '.join(changed)} differ")


@contextlib.contextmanager
def output_lock(path: str) -> Iterator[None]:
    """Hold a lock file with this process's number on the driver; one whose process is gone is taken over."""
    while True:
        try:
            f = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            break
        except FileExistsError:
            with open(path, encoding="ascii") as held:
                pid = held.read().strip()
            if pid.isdigit() and os.path.exists(f"/proc/{pid}"):
                raise RuntimeError(f"process {pid} holds {path}") from None
            with contextlib.suppress(FileNotFoundError):
                os.remove(path)
    try:
        os.write(f, str(os.getpid()).encode("ascii"))
        os.close(f)
        yield
    finally:
        os.remove(path)
