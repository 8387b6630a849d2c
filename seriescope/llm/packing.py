"""Best-fit packing by a linear grouping scheme.

Only the number of pieces of each length matters to the plan, and there are at most ``capacity``
lengths, so the plan is made from that histogram whatever the corpus holds:

1. large lengths, in falling order, are cut into groups of equal cardinality and rounded up to the
   largest of their group;
2. a linear program over configurations of these few sizes, by column generation, says how many
   sequences get which configuration. The small lengths take part as one more demand: their sum has
   to find room beside the large ones;
3. the solution is rounded to whole sequences, and actual lengths take the places of the groups;
4. small lengths, and large ones that the rounding left over, go longest first where the least room
   is left that holds them.

A plan is a list of runs of equal sequences. Spark numbers the pieces of each length and looks up
the run that their number falls into.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriescope.llm.common import keyed, shared_checkpoint, small_batches
from seriescope.llm.tokens import Vocabulary

#: Groups of the large lengths. Rounding up wastes less the more there are.
GROUPS = 128
#: Lengths up to this part of the capacity are small: a plan is made for each, and the best one counts.
SMALLS = (1 / 3, 1 / 4, 1 / 2)
#: Room of a configuration, as a part of the capacity, that small pieces are taken to leave empty.
SLACK = 1 / 64


def _best_column(sizes: list[int], duals: np.ndarray, room_value: np.ndarray, capacity: int) -> tuple[float, np.ndarray, int]:
    """(value, how many of each size, room) of the configuration with the largest sum of ``duals`` and
    of the value of the room that it leaves."""
    level, best, fill = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -np.inf), 0
    level[0] = best[0] = 0.0
    taken: list[np.ndarray] = []
    of_level = np.zeros(capacity + 1, np.int64)
    while np.isfinite(level).any() and fill + min(sizes) <= capacity:
        following, took = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
        for i, (s, d) in enumerate(zip(sizes, duals, strict=True)):
            value = level[: capacity + 1 - s] + d
            better = value > following[s:]
            following[s:][better] = value[better]
            took[s:][better] = i
        taken.append(took)
        better = following > best
        best[better], of_level[better] = following[better], len(taken)
        level, fill = following, fill + min(sizes)
    total = best + room_value[::-1]
    used = int(total.argmax())
    column, at = np.zeros(len(sizes)), used
    for n in range(of_level[used], 0, -1):
        i = taken[n - 1][at]
        column[i] += 1
        at -= sizes[i]
    return float(total[used]), column, capacity - used


def configurations(sizes: list[int], demand: list[int], capacity: int, small: int = 0, slack: float = SLACK) -> list[tuple[tuple[int, ...], int]]:
    """(how many of each size, how many sequences) of each configuration.

    The linear program asks for the fewest sequences that hold all of ``demand`` and, in the room
    that they leave, ``small`` tokens more; of each room the share ``slack`` of the capacity stays empty.
    The solution is rounded down, then those configurations get one more that lost most by it, with
    the pieces that are left, until the program's number of sequences is reached. ``sizes`` fall.
    """
    k = len(sizes)
    if not k:
        return []
    usable = np.maximum(np.arange(capacity + 1) - int(slack * capacity), 0)
    need = np.array([*demand, small], float)
    basis = np.diag([*(float(capacity // s) for s in sizes), float(max(usable[-1], 1))])
    used = need / np.diag(basis)
    for _ in range(40 * k):
        duals = np.linalg.solve(basis.T, np.ones(k + 1))
        value, column, room = _best_column(sizes, duals[:k], duals[k] * usable, capacity)
        if value <= 1 + 1e-7:
            break
        column = np.array([*column, usable[room]], float)
        change = np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        used = np.maximum(used - ratio[out] * change, 0)
        used[out] = ratio[out]
        basis[:, out] = column
    plan: Counter = Counter()
    left = np.array(demand)
    columns = np.rint(basis[:k]).astype(int).T
    for j in np.argsort(-used):
        if columns[j].any():
            n = min(int(used[j] + 1e-6), *(int(left[i] // columns[j][i]) for i in range(k) if columns[j][i]))
            if n > 0:
                plan[tuple(columns[j].tolist())] += n
                left -= n * columns[j]
    sequences = -int(-used[columns.any(axis=1)].sum() // 1)
    for j in np.argsort(-(used - np.floor(used + 1e-6))):
        column = np.minimum(columns[j], left)
        if column.any() and plan.total() < sequences:
            plan[tuple(column.tolist())] += 1
            left -= column
    return sorted(plan.items(), reverse=True)


def _grouped(large: list[tuple[int, int]], groups: int) -> dict[int, int]:
    """(length, pieces) in falling order -> the largest length of each group of about as many pieces,
    and its pieces. Groups end where lengths do; no more lengths than groups are taken as they are."""
    if len(large) <= groups:
        return dict(large)
    each = -(-sum(n for _, n in large) // groups)
    sizes: dict[int, int] = {}
    top = 0
    for length, n in large:
        top = top or length
        sizes[top] = sizes.get(top, 0) + n
        if sizes[top] >= each:
            top = 0
    return sizes


def _substituted(plan: list[tuple[tuple[int, ...], int]], sizes: list[int], counts: dict[int, int], capacity: int, slack: float) -> list[tuple[list[int], int]]:
    """Configurations of groups -> runs of actual lengths, which are taken off ``counts``.

    A place takes the longest length left that its group's size allows. Configurations that leave no
    room for small pieces come first, and the last place of each takes the longest that fits at all:
    it may be of a larger group, whose place then goes to a shorter length. Each group has no more
    places than pieces, and taking the longest keeps it so for all lengths up to any bound, so no
    place stays empty.
    """
    lengths = sorted(counts)
    room = {column: capacity - sum(c * s for c, s in zip(column, sizes, strict=True)) for column, _ in plan}
    runs = []
    for column, times in sorted(plan, key=lambda x: (room[x[0]] >= slack * capacity, x[0])):
        limits = [s for s, c in zip(sizes, column, strict=True) for _ in range(c)]
        while times:
            taken: list[int] = []
            for i, limit in enumerate(limits):
                if i + 1 == len(limits) and room[column] < slack * capacity:
                    limit = capacity - sum(taken)
                at = bisect_right(lengths, limit) - 1
                taken.append(lengths[at])
                counts[lengths[at]] -= 1
                if not counts[lengths[at]]:
                    lengths.pop(at)
            more = min(times - 1, *(counts[x] // taken.count(x) for x in taken))
            for x in taken:
                counts[x] -= more
            lengths = [x for x in lengths if counts[x]] if more else lengths
            runs.append((taken, more + 1))
            times -= more + 1
    return runs


def plan_sequences(counts: dict[int, int], capacity: int, groups: int = GROUPS, smalls: tuple[float, ...] = SMALLS, slack: float = SLACK) -> list[tuple[list[int], int]]:
    """Pieces by length -> runs (lengths in a sequence, number of such sequences): of the plans of
    each bound of ``smalls`` the one with the fewest sequences, of equal ones the first."""
    if any(not 0 < length <= capacity for length, n in counts.items() if n):
        raise ValueError("lengths must be from 1 to the capacity")
    return min((_plan(counts, capacity, groups, small, slack) for small in smalls), key=lambda runs: sum(n for _, n in runs))


def _plan(counts: dict[int, int], capacity: int, groups: int, small: float, slack: float) -> list[tuple[list[int], int]]:
    full = counts.get(capacity, 0)
    falling = sorted(((length, n) for length, n in counts.items() if n and length < capacity), reverse=True)
    large = [x for x in falling if x[0] > capacity * small]
    smalls = [x for x in falling if x[0] <= capacity * small]
    grouped = _grouped(large, groups)
    plan = configurations(list(grouped), list(grouped.values()), capacity, sum(length * n for length, n in smalls), slack)
    left = dict(large)
    runs = _substituted(plan, list(grouped), left, capacity, slack)
    rest = [(length, n) for length, n in left.items() if n]
    return ([([capacity], full)] if full else []) + _best_fit(runs, rest + smalls, capacity)


def _best_fit(runs: list[tuple[list[int], int]], pieces: list[tuple[int, int]], capacity: int) -> list[tuple[list[int], int]]:
    """``runs`` with ``pieces`` (length, number) added, each where the least room is left that holds it;
    new sequences where none does."""
    by_room: dict[int, list[tuple[list[int], int]]] = {}
    for lengths, n in runs:
        by_room.setdefault(capacity - sum(lengths), []).append((lengths, n))
    rooms = sorted(by_room)

    def put(lengths: list[int], n: int) -> None:
        r = capacity - sum(lengths)
        if r not in by_room:
            by_room[r] = []
            insort(rooms, r)
        by_room[r].append((lengths, n))

    for length, n in pieces:
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fit = capacity // length
                whole, rest = divmod(n, fit)
                if whole:
                    put([length] * fit, whole)
                if rest:
                    put([length] * rest, 1)
                break
            r = rooms[at]
            lengths, times = by_room[r].pop()
            if not by_room[r]:
                del by_room[r]
                rooms.pop(at)
            fit = min(r // length, n)
            m = min(times, n // fit)
            if m < times:
                put(lengths, times - m)
            put([*lengths, *[length] * fit], m)
            n -= fit * m
    return [(lengths, n) for r in sorted(by_room) for lengths, n in by_room[r]]


def places(runs: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, last number + 1, sequence of the first, offset) of each place of each run."""
    seen: Counter = Counter()
    out, sequence = [], 0
    for lengths, n in runs:
        offset = 0
        for length in lengths:
            out.append((length, seen[length], seen[length] + n, sequence, offset))
            seen[length] += n
            offset += length
        sequence += n
    return out


def _cut(vocabulary: Vocabulary, capacity: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary.encoder()
        names = ["doc_id", "th", "piece", "start", "length", "ids_crc32"]
        for b in batches:
            rows: list[tuple] = []
            for doc, th, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                start, piece = 0, 0
                while start < len(ids):
                    length = (len(ids) - start) % capacity or capacity
                    rows.append((doc, th, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                    start, piece = start + length, piece + 1
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return run


def pack(
    docs: DataFrame, vocabulary: Vocabulary, text: str = "text", id_col: str = "doc_id", capacity: int = 2048, end_id: int = 0,
    groups: int = GROUPS, smalls: tuple[float, ...] = SMALLS,
) -> DataFrame:
    """One row a piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its ids and then ``end_id``; one longer than ``capacity`` is cut from its end, so
    that only its first piece is shorter. A null text is empty: one piece with the end id. Repeated
    rows are packed each; null ids stay null; other columns aren't read; an empty table gives an
    empty result. Plan and look-up table are bounded by the capacity, not by the corpus.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = keyed(docs, text, id_col)
    pieces = shared_checkpoint(source.mapInArrow(_cut(vocabulary, capacity, end_id), "doc_id long, th long, piece int, start long, length long, ids_crc32 long"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.createDataFrame(places(plan_sequences(counts, capacity, groups, smalls)), "slot_length long, first long, past long, sequence long, offset long")

    # The number of a piece among those of its length: pieces of its part before it, and parts before.
    # Parts are as many as the pieces of a part, so neither grows faster than the root of the corpus.
    parts = spark.createDataFrame([(length, isqrt(n) + 1) for length, n in counts.items()], "slot_length long, parts long")
    dealt = pieces.join(F.broadcast(parts), F.col("length") == F.col("slot_length")).drop("slot_length")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("th", "piece"), "parts"))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "th", "piece")
    numbers = dealt.withColumn("rank", F.row_number().over(order)).join(before.select("length", "part", "before"), ["length", "part"])
    numbers = numbers.withColumn("number", F.col("before") + F.col("rank") - 1)
    placed = numbers.join(F.broadcast(table), (F.col("length") == F.col("slot_length")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("past")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("number") - F.col("first")).alias("sequence_id"), "offset")
