"""Evidence tools by name: a catalogue, and a dispatcher that answers requests of all signals at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriescope.operators import evidence, retrieval
from seriescope.operators.common import keys_in

#: Tool calls and turns of a review.
TOOL_BUDGET, TURN_BUDGET = 5, 8
#: Points of context beside compared windows.
CONTEXTS = {"short": 64, "medium": 128, "long": 256}


@dataclass(frozen=True)
class Tables:
    """What tools look into: points, lengths, scores by scale, windows with retained references, and
    the nearest references of all scales (scale, query_id, ref_id, sim)."""

    points: DataFrame
    lengths: DataFrame
    scores: DataFrame | None = None
    windows: DataFrame | None = None
    retained: DataFrame | None = None
    size: int = 224
    nearest: DataFrame | None = None


@dataclass(frozen=True)
class Tool:
    """A tool: its name, evidence family, purpose, and what it makes of tables and requests."""

    name: str
    family: str
    purpose: str
    run: Callable[..., DataFrame]
    arguments: tuple[str, ...] = ()


@dataclass
class Result:
    """Status ok with rows, or status error with a message."""

    tool: str
    status: str
    family: str
    rows: DataFrame | None = None
    error: str | None = None
    warnings: list[str] = field(default_factory=list)


def get_references(t: Tables, requests: DataFrame, offset: int = 0, limit: int = 4) -> DataFrame:
    """(request columns, query_id, rank, ref_id, sim, retained_rank, reference_id): the retained
    references of the window nearest to each request."""
    keys = keys_in(requests)
    near = retrieval.nearest_window(t.windows, requests, t.size).withColumnRenamed("window_id", "query_id")
    page = retrieval.reference_page(t.retained, offset, limit)
    found = near.join(page, [*keys, "query_id"])
    return found.withColumn("reference_id", evidence.reference_id(F.lit(t.size), F.col("query_id"), F.col("ref_id")))


def compare_references(t: Tables, requests: DataFrame, context: str = "medium") -> DataFrame:
    """Panels (keys, query_id, panel, lo, hi) for requests with ``reference_id``: of the ids that are
    retained references, one span for the query's window and each reference."""
    keys = keys_in(requests)
    parsed = requests.select(*keys, evidence.parse_reference_id(F.col("reference_id")).alias("p")).where(F.col("p.scale") == t.size)
    kept = parsed.select(*keys, "p.query_id", "p.ref_id").distinct().join(t.retained.select(*keys, "query_id", "ref_id"), [*keys, "query_id", "ref_id"], "left_semi")
    own = t.windows.select(*keys, F.col("window_id").alias("query_id"), "start_idx", (F.col("start_idx") + t.size - 1).alias("end_idx"))
    asked = own.join(kept.select(*keys, "query_id"), [*keys, "query_id"], "left_semi")
    return evidence.comparison_panels(asked, kept, t.windows, t.lengths, t.size, CONTEXTS.get(context, CONTEXTS["medium"]))


def get_screening_evidence(t: Tables, requests: DataFrame, target_type: str = "group") -> DataFrame:
    """Scores of each scale inside and outside of requests, or, for the type ``reference``, of requests
    with ``reference_id``, the similarity beside the scores of its scale."""
    if target_type == "reference":
        return evidence.reference_screening(t.scores, t.nearest, requests)
    return evidence.group_screening(t.scores, evidence.clamp(requests, t.lengths).drop("n"))


TOOLS = (
    Tool("get_references", "reference", "retained references of the nearest window", get_references, ("offset", "limit")),
    Tool("compare_references_visually", "reference_visual", "ranges that show a query beside its references", compare_references, ("context",)),
    Tool("inspect_raw_segment", "raw_numeric", "exact values of up to 512 points", lambda t, r: evidence.raw_segment(t.points, evidence.clamp(r, t.lengths).drop("n"))),
    Tool("plot_focused_segment", "visual", "a segment with its surroundings", lambda t, r: evidence.focused_segment(t.points, evidence.clamp(r, t.lengths).drop("n"), t.lengths)),
    Tool("segment_statistics", "statistical", "moments and quantiles of a segment", lambda t, r: evidence.segment_statistics(t.points, evidence.clamp(r, t.lengths).drop("n"))),
    Tool("value_zscore", "statistical", "values against the whole signal", lambda t, r: evidence.value_zscores(t.points, evidence.clamp(r, t.lengths).drop("n"))),
    Tool("diff_zscore", "statistical", "steps against all steps", lambda t, r: evidence.difference_zscores(t.points, evidence.clamp(r, t.lengths).drop("n"))),
    Tool("get_screening_evidence", "screening", "scores of each scale inside and outside, or of a reference", get_screening_evidence, ("target_type",)),
)


class Registry:
    """Tools by name; any error becomes a result with status ``error``."""

    def __init__(self, tools: tuple[Tool, ...] = TOOLS) -> None:
        self.tools: dict[str, Tool] = {}
        for t in tools:
            self.register(t)

    def register(self, tool: Tool) -> None:
        if tool.name in self.tools:
            raise ValueError(f"duplicate tool: {tool.name}")
        self.tools[tool.name] = tool

    def catalogue(self) -> str:
        return "\n".join(f"- {t.name} ({t.family}): {t.purpose}; arguments: {', '.join(t.arguments) or 'none'}" for t in self.tools.values())

    def dispatch(self, name: str, tables: Tables, requests: DataFrame, **arguments: object) -> Result:
        if name not in self.tools:
            raise KeyError(f"unknown tool: {name}")
        tool = self.tools[name]
        try:
            rows = tool.run(tables, requests, **arguments)
            return Result(name, "ok", tool.family, rows, None, ["Similar references need not be normal."] if tool.family.startswith("reference") else [])
        except Exception as e:
            return Result(name, "error", tool.family, None, f"{type(e).__name__}: {e}")


def check_step(step: dict, known: Registry, length: int, calls: int, turns: int, targets: set[str]) -> None:
    """A reviewer's step is a tool call within the budgets, or a final answer on every target once."""
    if step.get("type") == "call_tool":
        if calls >= TOOL_BUDGET or turns >= TURN_BUDGET:
            raise ValueError("the budget is used up: finalize")
        tool = known.tools.get(step.get("tool", ""))
        if tool is None or set(step.get("arguments") or {}) - set(tool.arguments):
            raise ValueError("invalid tool request")
        a, b = step.get("focus_interval") or (1, 0)
        if not 0 <= a <= b < length:
            raise ValueError("the focus lies outside the signal")
        if step.get("decisions") or step.get("additions"):
            raise ValueError("a tool request cannot finalize records")
    elif step.get("type") == "finalize":
        if any(step.get(k) is not None for k in ("tool", "arguments", "focus_interval")):
            raise ValueError("a final answer calls no tool")
        named = [d["record_key"] for d in step.get("decisions") or []]
        if len(named) != len(set(named)) or set(named) != targets:
            raise ValueError("every target must be decided once")
    else:
        raise ValueError("unknown step")
