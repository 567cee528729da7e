"""Near copies among vectors by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. Vectors that
share enough of them meet in the inverted lists of their common pivots, where pairs are
verified by cosine; a link counts in the list of its rarest common pivot. Pivots lie
well apart: a dense group has one pivot in its midst instead of many that are equally
far from its members, so its members meet in that pivot's list. Equal vectors are one
class. Lists are cut into blocks, and every pair of blocks is a task of its own, so a
list of any length is searched whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgauge.llm.common import columns_or_raise, components
from veilgauge.session import materialise

COSINE = 0.95
#: Nearest pivots that describe a vector, and how many of them a candidate shares.
NEAREST, SHARED = 10, 1
#: Vectors per pivot aimed at; the pivots are drawn from a sample of between these numbers of vectors.
PER_PIVOT, FEWEST, MOST = 64, 64, 16_384
#: A sampled vector with this cosine or more to an earlier pivot is none itself.
APART = 0.75
#: Vectors of a list that one side of a task holds.
BLOCK = 512


def _classes(vectors: DataFrame, key: str, value: str) -> DataFrame:
    """(key, digest, unit) per row; digest and unit are null where a vector links with nothing."""
    kind = T.StructType([T.StructField("key", vectors.schema[key].dataType), T.StructField("digest", T.BinaryType()),
                         T.StructField("unit", T.BinaryType())])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            digests, units = [], []
            for values in batch.column(1).to_pylist():
                x = np.array([np.nan if v is None else v for v in values], dtype=np.float64) if values else np.zeros(1)
                scale = np.abs(x).max()
                if not np.isfinite(x).all() or not scale:
                    digests.append(None)
                    units.append(None)
                    continue
                y = x / scale  # against overflow and underflow of squares
                digests.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest())
                units.append((y / np.linalg.norm(y)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(units, pa.binary())], kind.names)

    return vectors.select(F.col(key).alias("key"), value).mapInArrow(batches, kind)


def _described(classes: DataFrame, pivots: dict[int, np.ndarray], nearest: int) -> DataFrame:
    """Classes with `nearest`: the places of the nearest pivots of the same dimension, closest first.

    Pivots of all dimensions are numbered through. A vector whose dimension has no
    pivot lies in a list of its dimension, which no other dimension shares.
    """
    kind = T.StructType([*classes.schema.fields, T.StructField("nearest", T.ArrayType(T.IntegerType()))])
    first, count = {}, 0
    for dimension, matrix in sorted(pivots.items()):
        first[dimension] = count
        count += len(matrix)

    place = classes.columns.index("unit")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            units = [np.frombuffer(u) for u in batch.column(place).to_pylist()]
            found: list[list[int] | None] = [None] * len(units)
            sizes = np.array([len(u) for u in units])
            for dimension in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dimension)
                if dimension not in pivots:
                    for i in at:
                        found[i] = [-dimension]
                    continue
                matrix = pivots[dimension]
                k = min(nearest, len(matrix))
                for part in np.array_split(at, -(-len(at) // 1024)):
                    closeness = np.stack([units[i] for i in part]) @ matrix.T
                    top = np.argpartition(-closeness, k - 1, axis=1)[:, :k]
                    order = np.argsort(-np.take_along_axis(closeness, top, axis=1), axis=1, kind="stable")
                    for i, near in zip(part.tolist(), np.take_along_axis(top, order, axis=1) + first[dimension], strict=True):
                        found[i] = near.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], kind.names)

    return classes.mapInArrow(batches, kind)


def _apart(units: np.ndarray, cosine: float) -> np.ndarray:
    """The units, without those that have `cosine` or more to an earlier one that stays."""
    kept = np.zeros((0, units.shape[1]))
    for part in np.array_split(units, -(-len(units) // 512)):
        part = part[(part @ kept.T < cosine).all(axis=1)]
        near = part @ part.T >= cosine
        stays = np.ones(len(part), dtype=bool)
        for i in range(len(part)):
            if stays[i]:
                stays[i + 1:] &= ~near[i, i + 1:]
        kept = np.concatenate([kept, part[stays]])
    return kept


def _pairs_of(group: pd.DataFrame, order: np.ndarray, cosine: float, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) in the group of the links that belong to this list and pair of blocks."""
    pivot, low, high = (int(group[c].iat[0]) for c in ("pivot", "low", "high"))
    side = group["block"].to_numpy()
    rows, columns = np.flatnonzero(side == low), np.flatnonzero(side == high)
    units = np.stack([np.frombuffer(u) for u in group["unit"]])
    closeness = units[rows] @ units[columns].T
    met = closeness >= cosine - 1e-9
    if pivot >= 0:
        nearest = group["nearest"].tolist()
        lengths = np.array([len(x) for x in nearest])
        names, codes = np.unique(np.concatenate(nearest), return_inverse=True)
        marks = np.zeros((len(group), len(names)), dtype=np.float32)
        marks[np.repeat(np.arange(len(group)), lengths), codes] = 1
        if shared > 1:
            met &= marks[rows] @ marks[columns].T >= np.minimum(shared, np.minimum.outer(lengths[rows], lengths[columns]))
        earlier = order[names] < order[pivot]  # a pair belongs to the list of its rarest common pivot
        met &= marks[rows][:, earlier] @ marks[columns][:, earlier].T == 0
    if low == high:
        met = np.triu(met, 1)
    i, j = np.nonzero(met)
    good = np.ones(len(i), dtype=bool)
    edge = np.flatnonzero(closeness[i, j] < cosine + 1e-9)  # again in one order of sums, the same for every list
    i, j = rows[i], columns[j]
    for part in np.array_split(edge, -(-len(edge) // 65536) or 1):
        good[part] = np.einsum("ij,ij->i", units[i[part]], units[j[part]]) >= cosine
    return i[good], j[good]


def near_vectors(vectors: DataFrame, key: str = "vec_id", value: str = "embedding", cosine: float = COSINE,
                 nearest: int = NEAREST, shared: int = SHARED, per_pivot: int = PER_PIVOT) -> DataFrame:
    """(key, n_links, component_id, kept) per row: other rows with a cosine of `cosine` or more, and their groups.

    Cosines are taken in double precision. A vector that is null, empty, zero or holds
    null or non-finite components links with nothing. Vectors of different lengths do
    not link. Equal vectors link, repeated rows too. Pivots are drawn from a sample of
    distinct vectors, one for `per_pivot` of them within FEWEST and MOST, less those
    near an earlier one (APART); that is the only thing sampled: every vector is
    indexed. A link is missed only if its ends share fewer than `shared` of their
    `nearest` pivots; tests hold the recall against brute force, in dense groups too.
    """
    columns_or_raise(vectors, key, value)
    rows, _ = materialise(_classes(vectors, key, value))
    classes, held = materialise(rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")))
    many = max(FEWEST, min(MOST, held // per_pivot))
    sample = classes.orderBy(F.xxhash64("digest"), "digest").limit(many).select("unit").toArrow()["unit"].to_pylist()
    pivots: dict[int, list] = {}
    for unit in (np.frombuffer(u) for u in sample):
        pivots.setdefault(len(unit), []).append(unit)
    matrices = {d: _apart(np.stack(m), APART) for d, m in pivots.items()}
    described, _ = materialise(_described(classes, matrices, nearest))

    # How often each pivot occurs: at most as many rows as pivots.
    frequency = np.zeros(max(1, sum(map(len, matrices.values()))), dtype=np.int64)
    for row in described.select(F.explode("nearest").alias("p")).where("p >= 0").groupBy("p").count().collect():
        frequency[row["p"]] = row["count"]
    order = np.empty(len(frequency), dtype=np.int64)
    order[np.argsort(frequency, kind="stable")] = np.arange(len(frequency))
    kind = T.StructType([*described.schema.fields, T.StructField("pivot", T.IntegerType())])

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pivot = [], []
            for i, near in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                chosen = sorted(near, key=lambda p: order[p] if p >= 0 else -1)[:max(1, len(near) - shared + 1)]
                row += [i] * len(chosen)
                pivot += chosen
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row, pa.int64())).columns, pa.array(pivot, pa.int32())], kind.names)

    postings = described.mapInArrow(posted, kind)
    sizes, _ = materialise(postings.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
                           .where("blocks > 0"))
    dealt = postings.join(sizes, "pivot").withColumn("block", F.pmod(F.xxhash64("digest"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "pivot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block",
        "digest", "copies", "unit", "nearest")
    out = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("links", T.LongType())])

    def search(group: pd.DataFrame) -> pd.DataFrame:
        i, j = _pairs_of(group, order, cosine, shared)
        digests, copies = group["digest"].to_numpy(), group["copies"].to_numpy()
        links = np.bincount(i, weights=copies[j], minlength=len(group)) + np.bincount(j, weights=copies[i], minlength=len(group))
        label = np.arange(len(group))
        while True:  # smallest place reachable inside the group: one link per vector stands for all of them
            new = label.copy()
            np.minimum.at(new, i, label[j])
            np.minimum.at(new, j, label[i])
            new = new[new]
            if (new == label).all():
                break
            label = new
        linked = np.flatnonzero(links)
        return pd.DataFrame({"a": digests[label[linked]], "b": digests[linked], "links": links[linked].astype(np.int64)})

    found, _ = materialise(dealt.groupBy("pivot", "low", "high").applyInPandas(search, out))
    of = components(found)
    links = found.groupBy(F.col("b").alias("digest")).agg(F.sum("links").alias("links"))
    per_class = (classes.select("digest", "copies").join(links, "digest", "left")
                 .join(of.withColumnRenamed("node", "digest"), "digest", "left")
                 .select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                         F.coalesce("component", "digest").alias("component")))
    placed, _ = materialise(rows.select("key", "digest").join(per_class, "digest", "left"))
    smallest = placed.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("key").alias("smallest"))
    joined = placed.join(smallest, "component", "left")
    component = F.when(F.col("component").isNull(), F.col("key")).otherwise(F.col("smallest"))
    return joined.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))
