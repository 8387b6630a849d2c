"""Token counts that follow edits.

A document's text is cut into leaves of whole pre-tokens, and a segment tree over the leaves holds
their lengths and token counts. An edit is found by the lengths, re-encodes the leaves it touches and
their neighbours where it comes near a cut, and updates the sums above them; the rest of the text is
neither encoded nor copied again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriescope.llm.common import small_batches
from seriescope.llm.tokens import Vocabulary

#: Characters of a leaf, at least where the text can be cut. Leaves may grow to GROWN times as many
#: before the tree gets new ones.
LEAF, GROWN = 256, 8
#: Characters beside an edit that may decide where pre-tokens end, or make up a special string with it.
CONTEXT = 16

# Places where a pre-token begins whatever stands further away: before white space, and between letters,
# digits and other characters, but for a quote and the letters of a contraction.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = regex.compile(
    rf"(?<=[^{_BLANK}])(?=[{_BLANK}])|(?<=\p{{L}})(?=[^{_BLANK}\p{{L}}])|(?<=\p{{N}})(?=[^{_BLANK}\p{{N}}])"
    rf"|(?<=[^{_BLANK}\p{{L}}\p{{N}}'])(?=[\p{{L}}\p{{N}}])"
)
_LOOK = 256
_LETTERS = regex.compile(r"\p{L}\p{L}")

#: Strings that are one token each, where the encoder names none.
SPECIAL = ("<|endoftext|>",)

EDITS = "array<struct<start:int,end:int,text:string>>"


def _special_at(text: str, at: int, special: tuple[str, ...]) -> int:
    """The end of a special string around a place, 0 if there is none."""
    for s in special:
        found = text.find(s, max(0, at - len(s) + 1), at + len(s) - 1)
        if 0 <= found < at:
            return found + len(s)
    return 0


def _apart(text: str, at: int, within: np.ndarray | None) -> bool:
    """Is the place amid letters that no token reaches over?"""
    if within is None or "'" in text[max(0, at - 3) : at] or not _LETTERS.fullmatch(text, at - 1, at + 1):
        return False
    return not within[text[at - 1].encode("utf-8", "surrogatepass")[-1], text[at].encode("utf-8", "surrogatepass")[0]]


def cut(text: str, size: int = LEAF, encode: Callable[[str], list[int]] | None = None) -> list[str]:
    """The leaves of a text; none for an empty one. Each is ``size`` long at least and ends at the
    next place where pre-tokens part, or where no token of ``encode`` reaches over."""
    within, special = getattr(encode, "within", None), getattr(encode, "special", SPECIAL)
    out, at = [], 0
    while at < len(text):
        end = _place(text, max(at + size, 1), within)
        while end < len(text) and (inside := _special_at(text, end, special)):
            end = _place(text, inside, within)
        out.append(text[at:end])
        at = end
    return out


def _place(text: str, at: int, within: np.ndarray | None) -> int:
    """The first place from ``at`` on where a leaf may end."""
    while at < len(text):
        stop = min(at + _LOOK, len(text))
        m = _CUT.search(text, at, min(stop + 1, len(text)))
        end = m.start() if m else stop
        for i in range(at, end):
            if _apart(text, i, within):
                return i
        if m:
            return end
        at = stop
    return len(text)


def grow(leaves: list[int]) -> list[int]:
    """A segment tree: sums at 1, the children of i at 2i and 2i + 1, leaves at the end."""
    n = 1
    while n < len(leaves):
        n *= 2
    tree = [0] * n + list(leaves) + [0] * (n - len(leaves))
    for i in range(n - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


class Counted:
    """A text in leaves, with trees of their lengths and token counts."""

    def __init__(self, leaves: list[str], lengths: list[int], counts: list[int]) -> None:
        self.lengths, self.counts = lengths, counts
        self.leaves = leaves + [""] * (len(lengths) // 2 - len(leaves))

    @classmethod
    def of(cls, text: str, encode: Callable[[str], list[int]], size: int = LEAF) -> Counted:
        leaves = cut(text, size, encode)
        return cls(leaves, grow([len(x) for x in leaves]), grow([len(encode(x)) for x in leaves]))

    @classmethod
    def again(cls, text: str, lengths: list[int], counts: list[int]) -> Counted:
        """From a text and its trees; nothing is encoded."""
        leaves, at = [], 0
        for n in lengths[len(lengths) // 2 :]:
            leaves.append(text[at : at + n])
            at += n
        return cls(leaves, lengths, counts)

    def text(self) -> str:
        return "".join(self.leaves)

    def place(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, the last one for the text's end, and the characters before it."""
        i, before = 1, 0
        while i < len(self.leaves):
            i *= 2
            if self.lengths[i + 1] and at - before >= self.lengths[i]:
                before += self.lengths[i]
                i += 1
        return i - len(self.leaves), before

    def edit(self, start: int, end: int, new: str, encode: Callable[[str], list[int]], size: int = LEAF) -> int:
        """Replace the characters from start to end, places outside the text being moved to its ends;
        returns how many characters were encoded."""
        total = self.lengths[1]
        start = min(max(start, 0), total)
        end = min(max(end, start), total)
        a, before = self.place(max(start - CONTEXT, 0))
        b, _ = self.place(min(end + CONTEXT, total))
        old = "".join(self.leaves[a : b + 1])
        region = old[: start - before] + new + old[end - before :]
        slots, wanted = b - a + 1, size
        fresh = cut(region, wanted, encode)
        while len(fresh) > slots and wanted < GROWN * size:
            wanted *= 2
            fresh = cut(region, wanted, encode)
        if len(fresh) > slots:  # new leaves: sums move, but no other leaf is encoded
            fresh = cut(region, size, encode)
            n = len(self.leaves)
            last = max((i for i in range(n) if self.lengths[n + i]), default=0)
            lengths, counts = self.lengths[n:], self.counts[n:]
            lengths[a : b + 1], counts[a : b + 1] = [len(x) for x in fresh], [len(encode(x)) for x in fresh]
            upto = max(last + 1, b + 1) + len(fresh) - slots
            self.leaves[a : b + 1] = fresh
            self.lengths, self.counts = grow(lengths[:upto]), grow(counts[:upto])
            self.leaves = self.leaves[:upto] + [""] * (len(self.lengths) // 2 - upto)
            return len(region)
        fresh += [""] * (slots - len(fresh))
        n = len(self.leaves)
        self.leaves[a : b + 1] = fresh
        self.lengths[n + a : n + b + 1] = [len(x) for x in fresh]
        self.counts[n + a : n + b + 1] = [len(encode(x)) if x else 0 for x in fresh]
        left, right = (n + a) // 2, (n + b) // 2
        while left:
            for tree in (self.lengths, self.counts):
                for i in range(left, right + 1):
                    tree[i] = tree[2 * i] + tree[2 * i + 1]
            left, right = left // 2, right // 2
        return len(region)


_STATE = "doc_id long, text string, lengths array<long>, tree array<long>"


def build(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = (), size: int = LEAF) -> DataFrame:
    """(doc_id, text, lengths, tree, *keep) of every row: the segment trees of its leaves' lengths and
    token counts, whose element 1 is the document's. A null text is empty: one leaf without a token."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary.encoder()
        for b in batches:
            made = [Counted.of(t, encode, size) for t in b.column(1).to_pylist()]
            trees = [pa.array([getattr(x, k) for x in made], pa.list_(pa.int64())) for k in ("lengths", "counts")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *trees, *b.columns[2:]], names=["doc_id", "text", "lengths", "tree", *keep])

    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[2:])
    return source.mapInArrow(run, _STATE + more)


def update(state: DataFrame, vocabulary: Vocabulary, edits: str = "edits", size: int = LEAF) -> DataFrame:
    """(doc_id, text, lengths, tree, n_before, n_after, encoded_chars) of every row of a state with a
    column of EDITS.

    Edits are applied one after the other, each to the text that the last one left. Null edits and
    null replacements delete; no edits leave a row as it is. encoded_chars is how many characters
    were encoded again. Repeated rows and null ids stay; an empty table gives an empty result.
    """
    small_batches(state.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary.encoder()
        for b in batches:
            made, before, chars = [], [], []
            for t, lengths, counts, todo in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                x = Counted.again(t, lengths, counts)
                before.append(counts[1])
                total = 0
                for e in todo or []:
                    if e is not None and e["start"] is not None:
                        total += x.edit(e["start"], e["end"] if e["end"] is not None else e["start"], e["text"] or "", encode, size)
                made.append(x)
                chars.append(total)
            trees = [pa.array([getattr(x, k) for x in made], pa.list_(pa.int64())) for k in ("lengths", "counts")]
            numbers = [pa.array(x, pa.int64()) for x in (before, [x.counts[1] for x in made], chars)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.text() for x in made], pa.string()), *trees, *numbers], names=["doc_id", "text", "lengths", "tree", "n_before", "n_after", "encoded_chars"])

    return state.select("doc_id", "text", "lengths", "tree", edits).mapInArrow(run, _STATE + ", n_before long, n_after long, encoded_chars long")


def with_edits(state: DataFrame, edits: DataFrame) -> DataFrame:
    """``state`` and a column ``edits``: those of (doc_id, seq, start, end, text) rows of its
    document, by seq. Documents without edits have an empty list."""
    e = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "text"))).alias("sorted"))
    listed = e.select("doc_id", F.transform("sorted", lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["text"].alias("text"))).alias("edits"))
    return state.join(listed, "doc_id", "left").withColumn("edits", F.coalesce("edits", F.array().cast(EDITS)))
