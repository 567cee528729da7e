"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are taken in Arrow batches inside the tasks. The trees are
fitted on a bounded sample of labelled rows and flattened into arrays; a batch of
documents walks all trees at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgauge.llm.common import columns_or_raise
from veilgauge.session import materialise

#: Labelled rows that take part in fitting; those with the smallest hash of doc_id are taken.
SAMPLE = 40_000
THRESHOLD = 0.3
FEATURES = (
    "words", "characters", "word_length", "word_length_spread", "longest_word", "distinct_words", "distinct_pairs",
    "top_word", "lines", "line_words", "repeated_lines", "upper", "digits", "symbols", "punctuation", "other_bytes",
    "white", "byte_entropy", "short_words", "sentence_ends")

_CLASS = np.zeros(256, dtype=np.int64)  # other ASCII letters and controls
for _code, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>{}[]()=+_~^@\\/", b".,;:!?'\"-",
                                bytes(range(128, 256)), b" \t\n\r\x0b\x0c"), 1):
    _CLASS[list(_chars)] = _code


def statistics_of(text: str | None) -> list[float]:
    """The features of one text, in the order of FEATURES; zeros for a null or empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=7) / len(raw)
    share = counts[counts > 0] / len(raw)
    words = text.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n) if n else np.zeros(1)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    top = Counter(words).most_common(1)[0][1] / n if n else 0.0
    distinct = len(set(words)) / n if n else 0.0
    pairs = len(set(zip(words, words[1:], strict=False))) / (n - 1) if n > 1 else 1.0
    ends = counts[46] + counts[33] + counts[63]
    return [float(n), float(len(text)), float(lengths.mean()), float(lengths.std()), float(lengths.max()), distinct, pairs, top,
            float(len(lines)), n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), *kinds[[1, 2, 3, 4, 5, 6]].tolist(),
            float(-(share * np.log2(share)).sum()), float((lengths <= 3).mean()), ends / max(1, n)]


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics_of(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass(frozen=True)
class Forest:
    """Complete binary trees in heap order: split of each inner node, value of each leaf."""

    feature: np.ndarray  # (trees, 2^depth - 1)
    cut: np.ndarray  # go right above it
    leaf: np.ndarray  # (trees, 2^depth)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 per row."""
        if not len(self.leaf):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        trees, inner = np.arange(len(self.leaf)), self.feature.shape[1]
        out = np.empty(len(x))
        for i in range(0, len(x), 2048):
            rows = x[i:i + 2048]
            node = np.zeros((len(rows), len(trees)), dtype=np.int64)
            at = np.arange(len(rows))[:, None]
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (rows[at, self.feature[trees, node]] > self.cut[trees, node])
            out[i:i + 2048] = self.leaf[trees, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-(out + self.base)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 160, depth: int = 4, rate: float = 0.1, bins: int = 64,
        least: float = 5.0, ridge: float = 1.0) -> Forest:
    """Boosted trees for the logistic loss, grown level by level from histograms of gradients.

    Without rows the chance is one half everywhere; with a single class it is that
    class's smoothed share.
    """
    inner = 2**depth - 1
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    none = Forest(np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    if not len(y) or y.min() == y.max():
        return none
    rows, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1)
    shift = np.arange(width) * bins
    margin = np.full(rows, base)
    feature, cut, leaf = (np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(rows, dtype=np.int64)  # within its level
        for level in range(depth):
            n = 2**level
            at = (node[:, None] * (width * bins) + shift + binned).ravel()
            histogram = [np.bincount(at, weights=np.repeat(w, width), minlength=n * width * bins)
                         .reshape(n, width, bins).cumsum(axis=2) for w in (grad, hess)]
            g, h = histogram
            total_g, total_h = g[:, :, -1:], h[:, :, -1:]
            value = lambda a, b: a * a / (b + ridge)
            gain = value(g, h) + value(total_g - g, total_h - h) - value(total_g, total_h)
            gain[(h < least) | (total_h - h < least)] = 0
            for j in range(width):
                gain[:, j, len(edges[j]):] = 0
            best = gain.reshape(n, -1).argmax(axis=1)
            chosen, place = best // bins, best % bins
            split = gain.reshape(n, -1)[np.arange(n), best] > 1e-9
            first = n - 1
            feature[t, first:first + n] = np.where(split, chosen, 0)
            cut[t, first:first + n] = [edges[j][b] if s else np.inf for j, b, s in zip(chosen, place, split, strict=True)]
            right = split[node] & (binned[np.arange(rows), chosen[node]] > place[node])
            node = 2 * node + right
        sums = [np.bincount(node, weights=w, minlength=inner + 1) for w in (grad, hess)]
        leaf[t] = -rate * sums[0] / (sums[1] + ridge)
        margin += leaf[t][node]
    return Forest(feature, cut, leaf, base)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and one array of statistics per row of `docs`."""
    columns_or_raise(docs, "doc_id", "text")
    kind = T.StructType([docs.select("doc_id").schema[0], T.StructField("features", T.ArrayType(T.DoubleType()))])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            x = _matrix(batch.column(1).to_pylist())
            features = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32), x.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), features], ["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(batches, kind)


def held_out(doc_id: Column) -> Column:
    """Every fifth document or so, by its id; these labels are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Forest:
    """Fit on statistics joined with `labels` (doc_id, quality), held-out rows apart.

    At most `sample` rows reach the driver. Labels other than 0 and 1 and labels
    without a document are ignored; further columns of `labels` are not read.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = measured.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "features").limit(sample).toArrow()
    x = np.asarray(rows["features"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    return fit(x, np.asarray(rows["quality"], dtype=np.float64), **options)


def score(measured: DataFrame, forest: Forest) -> DataFrame:
    """doc_id and score per row of statistics."""
    kind = T.StructType([measured.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(x))], ["doc_id", "score"])

    return measured.select("doc_id", "features").mapInArrow(batches, kind)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`; empty texts too."""
    measured, _ = materialise(statistics(docs))
    scored = score(measured, train(measured, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_predicted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` predicted good, with all their columns; texts are scored where they lie."""
    measured, _ = materialise(statistics(docs))
    forest = train(measured, labels, sample)
    place = docs.columns.index("text")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            good = forest.score(_matrix(batch.column(place).to_pylist())) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(batches, docs.schema)
