"""Fill-in-middle examples: a text's lines are dealt to prefix, middle and suffix and put in a new order.

Cuts and form of a document follow from a hash of its id, so they depend on neither
partitioning nor order, and runs agree. Per Arrow batch, `pyarrow.compute` splits the
texts into list arrays, flattens them with the index of their parent, computes each
unit's ordinal within its parent, filters the units by role, rebuilds list arrays and
joins the pieces with `binary_join`. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgauge.llm.common import columns_or_raise

#: Bytes of text that are held as arrays of lines at a time; a longer text is one slice of its own.
SLICE_BYTES = 4 << 20
DRAWS = [f"__draw{k}" for k in range(1, 5)]
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


@dataclass(frozen=True)
class Infill:
    """How texts are turned: sentinels, share of texts turned and of these with the suffix first, both in percent."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 100
    suffix_first: int = 50
    seed: int = 7

    def __post_init__(self) -> None:
        marks = self.marks
        if not all(marks):
            raise ValueError("a sentinel is empty")
        # A first character that occurs nowhere else keeps sentinels from arising where a piece meets one.
        if any(m.count(marks[0][0]) != 1 or m[0] != marks[0][0] for m in marks):
            raise ValueError("sentinels have to begin with one same character that does not occur in them again")
        if any(a != b and b.startswith(a) for a in marks for b in marks) or len(set(marks)) < 3:
            raise ValueError("no sentinel may begin with another one")

    @property
    def marks(self) -> list[str]:
        return [self.prefix, self.suffix, self.middle]


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four 32-bit numbers of the hash of seed and id; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(name) for k, name in enumerate(DRAWS)]


def fill_in_middle(docs: DataFrame, how: Infill = Infill()) -> DataFrame:
    """Every row of `docs` with the number of its lines, its form and the reordered text.

    Added are ``n`` (lines, with their line break), ``form`` (plain, psm, spm),
    ``prefix_chars`` and ``middle_chars`` (code points, null if plain) and ``output``;
    columns of these names that the input has are replaced, all others stay.

    A null text counts as empty; an empty text, and one that holds a sentinel, stays
    plain. A text without a line break has one line. Equal rows get equal results, as
    do equal texts with one id; a null id is hashed as the empty one. Very long texts
    are handled whole, one slice at a time. An empty table gives an empty table.
    """
    columns_or_raise(docs, "doc_id", "text")
    kept = [c for c in docs.columns if c not in ADDED and c not in DRAWS]
    fed = docs.select(*[F.col(f"`{c}`") for c in kept], *_draws(F.col("doc_id"), how.seed))
    schema = T.StructType([docs.schema[c] for c in kept] + [
        T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    place = kept.index("text")

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in _slices(batch.column(place)):
                part = batch.slice(first, last - first)
                made = turned(part.column(place), [part.column(len(kept) + k) for k in range(4)], how)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(kept))] + made, names=kept + ADDED)

    return fed.mapInArrow(turn, schema)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Index ranges of at most `SLICE_BYTES` of text, or of one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield first, last
        first = last


def turned(texts: pa.Array, draws: list[pa.Array], how: Infill) -> list[pa.Array]:
    """Number of lines, form, code points of prefix and middle, and output of each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    h1, h2, h3, h4 = (d.to_numpy(zero_copy_only=False) for d in draws)
    pieces = pc.split_pattern(texts, "\n")
    parent = pc.list_parent_indices(pieces).to_numpy(zero_copy_only=False)
    parts = pc.list_flatten(pieces)
    held = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(held) - held
    ordinal = np.arange(len(parent)) - starts[parent]
    # What follows a text's last line break is a line only if it holds something.
    closing = ordinal == held[parent] - 1
    breaks = pa.array(np.where(closing, "", "\n"), pa.large_string())
    units = pc.binary_join_element_wise(parts, breaks, pa.scalar("", pa.large_string()))
    real = pc.greater(pc.binary_length(units), 0).to_numpy(zero_copy_only=False)
    n = np.bincount(parent[real], minlength=len(texts)).astype(np.int64)

    one, two = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    marked = np.zeros(len(texts), dtype=bool)
    for mark in how.marks:
        marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h3 % 100 >= how.rate)
    spm = ~plain & (h4 % 100 < how.suffix_first)

    role = (ordinal >= low[parent]).astype(np.int8) + (ordinal >= high[parent])
    prefix, middle, suffix = (_joined(units, parent, real & (role == k), len(texts)) for k in range(3))
    mark = lambda m: pa.scalar(m, pa.large_string())
    glue = pa.scalar("", pa.large_string())
    psm_text = pc.binary_join_element_wise(mark(how.prefix), prefix, mark(how.suffix), suffix, mark(how.middle), middle, glue)
    spm_text = pc.binary_join_element_wise(mark(how.suffix), suffix, mark(how.prefix), prefix, mark(how.middle), middle, glue)
    is_plain, is_spm = pa.array(plain), pa.array(spm)
    output = pc.if_else(is_plain, texts, pc.if_else(is_spm, spm_text, psm_text))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    nothing = pa.scalar(None, pa.int64())
    lengths = [pc.if_else(is_plain, nothing, pc.utf8_length(piece).cast(pa.int64())) for piece in (prefix, middle)]
    return [pa.array(n), pa.array(form, pa.string()), *lengths, output.cast(pa.string())]


def _joined(units: pa.Array, parent: np.ndarray, chosen: np.ndarray, texts: int) -> pa.Array:
    """The chosen units of each text in one piece; a text without any has an empty one."""
    counts = np.bincount(parent[chosen], minlength=texts)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64())
    lists = pa.LargeListArray.from_arrays(offsets, units.filter(pa.array(chosen)))
    return pc.binary_join(lists, pa.scalar("", pa.large_string()))


def restored(form: Column, output: Column, how: Infill = Infill()) -> Column:
    """The exact text again, from output and form alone."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in how.marks), -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))
