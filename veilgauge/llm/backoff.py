"""Stupid-backoff scores of documents from n-gram counts of the whole corpus.

Documents are dealt into blocks of a few megabytes. A block sends each of its distinct
n-grams of every order once, with its own count, to the partition of the count table
that the n-gram's hash names; the partition adds the counts of all blocks and answers
each block with the totals in the order asked. The answers are joined with the blocks
again, and scores are summed per document. Messages are packed: sorted hashes as
differences, counts compressed. A frequent n-gram costs one entry per block, whatever
its count, so no partition runs hot; blocks and partitions grow in number, not in size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgauge.llm.common import SPACE_RUN, WordHashes, columns_or_raise, mixed

ORDER = 3
#: The factor for every step back, as published.
ALPHA = 0.4
BLOCK_BYTES = 8_000_000
#: n-grams are compared by 64-bit hashes: among 10^13 different ones, a given one shares its hash with a chance of 5e-7.
HASH_BITS = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """The n-grams of a block of texts.

    `hashes` are the distinct ones, sorted, and `counts` their occurrences. With
    `places`, `at[n]` says for each word which of them ends there with n + 1 words, -1
    where the text has fewer before, and `own[n]` how often the word's text holds it.
    """

    def __init__(self, texts: list[bytes | None], order: int, places: bool = False) -> None:
        """texts: in UTF-8."""
        words = [t.split() if t else [] for t in texts]
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        flat = WordHashes(1 << 62).of([w for ws in words for w in ws])
        del words
        self.text = np.repeat(np.arange(len(texts)), self.lengths)
        self.place = np.arange(len(flat)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        hashes, before = [], flat
        for n in range(1, order + 1):
            if n == 1:
                now = mixed(flat + _STEP)
            else:
                now = np.zeros_like(flat)
                now[1:] = mixed(before[:-1] * _STEP + flat[1:] + np.uint64(n))
            hashes.append(now)
            before = now
        ends = [np.flatnonzero(self.place >= n) for n in range(order)]
        every = np.concatenate([h[e] for h, e in zip(hashes, ends, strict=True)])
        if not places:
            self.hashes, self.counts = np.unique(every, return_counts=True)
            return
        # One stable sort gives the distinct n-grams, their places, and their runs within a text.
        order_ = np.argsort(every, kind="stable")
        every, text = every[order_], np.concatenate([self.text[e] for e in ends])[order_]
        fresh = np.r_[True, every[1:] != every[:-1]][:len(every)]
        self.hashes, self.counts = every[fresh], np.diff(np.r_[np.flatnonzero(fresh), len(every)])
        run = np.flatnonzero(fresh | np.r_[True, text[1:] != text[:-1]][:len(every)])
        sizes = np.diff(np.r_[run, len(every)])
        at, own = np.empty(len(every), dtype=np.int64), np.empty(len(every), dtype=np.int64)
        at[order_], own[order_] = np.cumsum(fresh) - 1, np.repeat(sizes, sizes)
        self.at, self.own = np.full((order, len(flat)), -1, dtype=np.int64), np.zeros((order, len(flat)), dtype=np.int64)
        first = 0
        for n, e in enumerate(ends):
            self.at[n, e], self.own[n, e] = at[first:first + len(e)], own[first:first + len(e)]
            first += len(e)

    def partitions(self, parts: int) -> np.ndarray:
        return ((self.hashes >> np.uint64(HASH_BITS - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)

    def log_scores(self, totals: np.ndarray, words: int, alpha: float, leave_out: bool) -> np.ndarray:
        """Sum of the natural logarithms of the scores per text."""
        order = len(self.at)
        seen = np.append(totals, 0)[self.at]
        if leave_out:
            seen -= self.own
        rest = words - (self.lengths[self.text] if leave_out else 0)
        score = np.maximum(seen[0], 1) / np.maximum(rest, 1)
        for k in range(1, order):
            inside = np.flatnonzero(self.place >= k)
            hit = seen[k, inside] > 0
            stepped = alpha * score[inside]
            stepped[hit] = seen[k, inside[hit]] / seen[k - 1, inside[hit] - 1]
            score[inside] = stepped
        return np.bincount(self.text, weights=np.log(score), minlength=len(self.lengths))


def packed(hashes: np.ndarray) -> bytes:
    """Ascending hashes as differences: four low bytes each, and the rest, which is small, compressed."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    return steps.astype("<u4").tobytes() + zlib.compress((steps >> np.uint64(32)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes, n: int) -> np.ndarray:
    """The `n` hashes of a message."""
    low = np.frombuffer(data, dtype="<u4", count=n).astype(np.uint64)
    high = np.ascontiguousarray(np.frombuffer(zlib.decompress(data[4 * n:]), dtype=np.uint8).reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(low | high.astype(np.uint64) << np.uint64(32), dtype=np.uint64)


def _counts(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _values(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with their last column, texts, compressed one by one; null stays null."""
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = [None if t is None else press(t) for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], batch.schema.names)


def expanded(texts: pa.ChunkedArray) -> list[bytes | None]:
    back = zstandard.ZstdDecompressor().decompress
    return [None if t is None else back(t) for t in texts.to_pylist()]


def score_documents(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, leave_out: bool = True,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) per row of `docs`.

    A word scores count(n-gram) / count(context) at the longest order up to `order`
    that was seen, times `alpha` for each step back; at the last step its count over
    the number of all words, where a word seen nowhere counts as once. Counts are
    those of all rows of `docs`, with `leave_out` without the occurrences in the row's
    own text, as these would vouch for themselves. Words are split at white space.
    Texts without words, null ones included, score 0, with a null mean. Repeated rows
    count and score each. A very long text is one document of its block. No rows give
    no rows; further columns, whatever their names, are ignored.
    """
    columns_or_raise(docs, "doc_id", "text")
    corpus = docs.agg(F.sum(F.octet_length("text")).alias("bytes"),
                      F.sum(F.regexp_count("text", F.lit(f"[^{SPACE_RUN[1:]}"))).alias("words")).first()
    parts, words = max(1, -(-(corpus["bytes"] or 0) // block_bytes)), corpus["words"] or 0
    keyed = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("block"), "doc_id", "text")
    keyed = keyed.mapInArrow(compressed, T.StructType([*keyed.schema.fields[:2], T.StructField("text", T.BinaryType())]))
    message = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("part", T.IntegerType()),
                            T.StructField("hashes", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    answer = T.StructType([f for f in message if f.name != "hashes"])

    def ask(group: pa.Table) -> pa.Table:
        block, grams = group["block"][0].as_py(), Grams(expanded(group["text"]), order)
        rows = []
        part = grams.partitions(parts)
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(starts[1:], len(part))[:len(starts)]
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            rows.append((block, int(part[a]), packed(grams.hashes[a:b]), _counts(grams.counts[a:b])))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=message.names)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        counts = [_values(x) for x in group["counts"]]
        hashes = [unpacked(x, len(c)) for x, c in zip(group["hashes"], counts, strict=True)]
        distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.concatenate(counts)
        totals = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)[inverse]
        ends = np.cumsum([len(x) for x in hashes])[:-1]
        return pd.DataFrame({"block": group["block"], "part": group["part"], "counts": [_counts(x) for x in np.split(totals, ends)]})

    kind = T.StructType([docs.select("doc_id").schema[0], T.StructField("n_words", T.LongType()),
                         T.StructField("log_score", T.DoubleType())])

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        grams = Grams(expanded(texts["text"]), order, places=True)
        found = [_values(x.as_py()) for x in answers.sort_by("part")["counts"]]
        totals = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        return pa.table([texts["doc_id"], pa.array(grams.lengths, pa.int64()),
                         pa.array(grams.log_scores(totals, words, alpha, leave_out), pa.float64())], names=kind.names)

    blocks = keyed.groupBy("block")
    asked = blocks.applyInArrow(ask, message)
    answers = asked.groupBy("part").applyInPandas(add, answer)
    scored = blocks.cogroup(answers.groupBy("block")).applyInArrow(score, kind)
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
