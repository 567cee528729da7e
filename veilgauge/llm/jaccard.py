"""Jaccard join of word n-gram sets by T-occurrence search.

Equal sets are one class. Two sets of the required overlap share a few elements of
their prefixes under one global order; elements that many texts of a task share come
last in it, so that common passages seldom lie in a prefix. Prefix postings decide
which sets meet; the meeting itself is a search over the inverted lists of a block of
whole sets: the short lists of a query are merged by counting, the long ones are only
probed by binary search for the candidates that the short ones leave (DivideSkip).

Only connectivity is asked for. Sets are first searched against the first set of their
posting lists, the smallest one; after that, pairs that are connected already need no
test, and all other pairs with enough lists in common are searched in a second round.
There, sets that meet in a long list are searched in blocks of whole lists, so no row
stands for a pair, and a search returns only links that connect what it has not connected
yet. Postings carry the size of the set and the place of the element in it: two sets hold
nothing in common before the places where they first meet, which rules out most pairs
that only share a passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgauge.llm.common import columns_or_raise, components, mixed, text_slices
from veilgauge.session import materialise

#: The library's own defaults; a query may ask for others.
WORDS = 5
SIMILARITY = (80, 100)
#: A shingle that so many texts of one task share is counted; with so many counts in all it is put last in the order.
COMMON_IN_TASK, COMMON = 2, 8
#: Shingles that a task counts together.
COUNTED = 4_000_000
#: At most so many common shingles, the most frequent ones, are sent to the tasks (8 bytes each).
#: The order of elements is free, so this bound changes no result.
MOST_COMMON = 1_000_000
#: Sets in the index of a block, and queries that one task searches in it.
INDEXED, QUERIES = 64, 192
#: A list of more sets than this that aren't all connected is searched as a whole, in blocks of about so many sets.
CROWD, LIST_BLOCK = 64, 512
#: Documents to fetch are broadcast up to this size, taking so many bytes for each; beyond, texts are shuffled.
BROADCAST_BYTES, OWNER_BYTES = 64 << 20, 128
#: Prefixes hold one common element more for so many required ones, up to the bound; both only weigh prefixes against candidates.
PER_SHARED, MOST_SHARED = 100, 4
#: Share of the required overlap that long lists may hold, from the published rule T / (mu log M + 1).
MU = 1.0

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words of up to so many bytes are hashed together, in slices of about so many characters.
SHORT_WORD, HASHED_CHARACTERS = 32, 1 << 18
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
_OF_BYTE[65:91] = _OF_BYTE[97:123]
_OF_PLACE = mixed(np.arange(1001, 1001 + SHORT_WORD, dtype=np.uint64) * _STEP) | np.uint64(1)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, lower-cased in A-Z, and the number of words of every text."""
    hashes, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for a, b in text_slices(texts, HASHED_CHARACTERS):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts[a:b]]
        joined = b" ".join(raw)
        data = np.frombuffer(joined, dtype=np.uint8)
        inside = ~_BLANK[data]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        lengths = ends - starts
        firsts = np.cumsum(lengths) - lengths
        place = np.minimum(np.arange(int(lengths.sum())) - np.repeat(firsts, lengths), SHORT_WORD - 1)
        found = np.zeros(0, dtype=np.uint64)
        if len(starts):
            found = mixed(np.add.reduceat(_OF_BYTE[data[inside]] * _OF_PLACE[place], firsts))
        for k in np.flatnonzero(lengths > SHORT_WORD).tolist():
            word = joined[starts[k]:ends[k]].lower()
            found[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        hashes.append(found)
        begins = np.cumsum([0, *[len(r) + 1 for r in raw]])
        counts.append(np.diff(np.searchsorted(starts, begins)))
    return np.concatenate(hashes), np.concatenate(counts)


class Shingler:
    """Sorted 64-bit hashes of the distinct n-grams of texts, words lower-cased in A-Z."""

    def __init__(self, words: int) -> None:
        self.words = words

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        h, lengths = word_hashes(texts)
        sums = h.copy()
        for k in range(1, self.words):
            sums[:-k or None] = sums[:-k or None] * _STEP + h[k:]
        sums = mixed(sums)
        out, first = [], 0
        for n in lengths.tolist():
            if n >= self.words:
                values = np.sort(sums[first:first + n - self.words + 1])
                out.append(values[np.append(True, values[1:] != values[:-1])])
            elif n:  # the whole sequence as one
                value = np.array([n], dtype=np.uint64)
                for k in range(first, first + n):
                    value = mixed(value * _STEP + h[k])
                out.append(value)
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            first += n
        return out


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _required(n: int, similarity: tuple[int, int]) -> int:
    """Least overlap of a set of n elements with a similar one."""
    return -(-similarity[0] * n // similarity[1])


def _shared(n: int, similarity: tuple[int, int]) -> int:
    """Prefix elements that a set of n elements shares with every similar one, within its lengthened prefix.

    A prefix of n - required + m elements holds the m smallest common ones; more of
    them make candidates rarer and prefixes longer.
    """
    return min(MOST_SHARED, 1 + _required(n, similarity) // PER_SHARED)


def _fields(*names: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in names])


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _described(docs: DataFrame, words: int) -> DataFrame:
    """Row by row: doc_id, text_key, n, digest; and, per task, the shingles that several of its texts share."""
    source = docs.select("doc_id", _text_key().alias("text_key"), "text")
    kind = T.StructType([source.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("n", T.LongType()),
                         T.StructField("digest", T.BinaryType()), T.StructField("shingle", T.LongType()),
                         T.StructField("texts", T.LongType())])

    def shared(sets: list[np.ndarray], key_type: pa.DataType) -> pa.RecordBatch:
        values, times = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64),) * 2
        values, times = values[times >= COMMON_IN_TASK], times[times >= COMMON_IN_TASK]
        none = [pa.nulls(len(values), t) for t in (key_type, pa.int64(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([*none, pa.array(values.view(np.int64)), pa.array(times.astype(np.int64))], kind.names)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, held, count, key_type = Shingler(words), set(), [], 0, None
        for batch in rows:
            texts, key_type = batch.column(2).to_pylist(), batch.column(0).type
            for a, b in text_slices(texts):
                n, digests = [], []
                for values in shingler.sets(texts[a:b]):
                    digest = _digest(values)
                    n.append(len(values))
                    digests.append(digest)
                    if _short(digest) not in seen:  # exact copies make nothing common
                        seen.add(_short(digest))
                        held.append(values)
                        count += len(values)
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int64()),
                                                  pa.array(digests, pa.binary()), none, none], kind.names)
                if count >= COUNTED:
                    yield shared(held, key_type)
                    held, count = [], 0
        if held:
            yield shared(held, key_type)

    return source.mapInArrow(batches, kind)


def _postings(docs: DataFrame, words: int, similarity: tuple[int, int], common: np.ndarray) -> DataFrame:
    """(shingle, node, n, place) for the prefix of every distinct set of a task; n: its size, place: that of the shingle in the order."""
    kind = _fields(("shingle", T.LongType()), ("node", T.LongType()), ("n", T.IntegerType()), ("place", T.IntegerType()))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(words), set()
        for batch in rows:
            texts = batch.column(0).to_pylist()
            for a, b in text_slices(texts):
                prefixes, nodes, sizes = [], [], []
                for values in shingler.sets(texts[a:b]):
                    node = _short(_digest(values))
                    if not len(values) or node in seen:
                        continue
                    seen.add(node)
                    at = np.searchsorted(common, values)
                    late = common[np.minimum(at, len(common) - 1)] == values if len(common) else np.zeros(len(values), dtype=bool)
                    ordered = np.concatenate([values[~late], values[late]])
                    prefixes.append(ordered[:len(values) - _required(len(values), similarity) + _shared(len(values), similarity)])
                    nodes.append(node)
                    sizes.append(len(values))
                lengths = [len(p) for p in prefixes]
                if lengths:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(prefixes).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), lengths)),
                         pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                         pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in lengths]))], kind.names)

    return docs.select("text").mapInArrow(batches, kind)


def _sets_of(texts: DataFrame, words: int) -> DataFrame:
    """(node, digest, values) of the texts whose set is the wanted one."""
    kind = _fields(("node", T.LongType()), ("digest", T.BinaryType()), ("values", T.BinaryType()))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in rows:
            texts, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in text_slices(texts):
                found = [(d, v.tobytes()) for v, w in zip(shingler.sets(texts[a:b]), wanted[a:b], strict=True) if (d := _digest(v)) == w]
                yield pa.RecordBatch.from_arrays([pa.array([_short(d) for d, _ in found], pa.int64()), pa.array([d for d, _ in found], pa.binary()),
                                                  pa.array([v for _, v in found], pa.binary())], kind.names)

    return texts.select("text", "digest").mapInArrow(batches, kind)


class Index:
    """Inverted lists of a block of sets, searched with DivideSkip."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        values = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.owner = owner[order]  # ascending within each list
        self.values, self.starts = np.unique(values[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(values))
        self.keys = np.repeat(np.arange(len(self.values)), self.ends - self.starts) * len(sets) + self.owner

    def search(self, query: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
        """Indexed sets with 'similarity' or more to the query."""
        if not len(query) or not len(self.values):
            return np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.values, query), len(self.values) - 1)
        at = at[self.values[at] == query]
        required = _required(len(query), similarity)
        if len(at) < required:
            return np.zeros(0, dtype=np.int64)
        lengths = self.ends[at] - self.starts[at]
        order = np.argsort(lengths, kind="stable")
        longest = int(lengths[order[-1]])
        aside = min(required - 1, int(required / (MU * np.log2(longest + 1) + 1)))
        short, long = at[order[:len(at) - aside]], at[order[len(at) - aside:]]
        # Merge the short lists by counting; a candidate lies in at least required - aside of them.
        sizes = self.ends[short] - self.starts[short]
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        counts = np.bincount(self.owner[np.repeat(self.starts[short], sizes) + inside], minlength=len(self.sizes))
        found = np.flatnonzero(counts >= required - aside)
        shared = counts[found]
        # Probe every long list for every candidate by binary search.
        probes = long[:, None] * len(self.sizes) + found
        place = np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)
        shared = shared + (self.keys[place] == probes).sum(axis=0)
        union = len(query) + self.sizes[found] - shared
        return found[similarity[1] * shared >= similarity[0] * union]


def _may_link(similarity: tuple[int, int], shared: Column | int = 0) -> Column:
    """Whether two sets with `n_a`, `n_b` elements can be similar.

    At most `shared` elements that both hold come before the places `place_a` and `place_b`, and all others after them.
    """
    low, high = similarity
    rest = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + shared
    both = F.least(rest, F.col("n_a"), F.col("n_b")).cast("long")
    return both * (low + high) >= (F.col("n_a") + F.col("n_b")) * F.lit(low).cast("long")


def _least(similarity: tuple[int, int]) -> Column:
    """`_shared` of the smaller of two sets."""
    low, high = similarity
    required = F.ceil(F.least("n_a", "n_b") * F.lit(low).cast("long") / F.lit(high))
    return F.least(F.lit(MOST_SHARED), 1 + F.floor(required / PER_SHARED))


def _unconnected(listed: DataFrame, near: DataFrame | None, similarity: tuple[int, int]) -> DataFrame:
    """(shingle, node, n, place, component, main, held): the lists whose sets aren't all connected yet.

    `main`: whether the set is in the list's largest component; `held`: sets of the list.
    Places behind those at which a set still meets any of the list's are left out: of the
    first `_shared` elements that two similar sets share, each lies early enough in both.
    """
    low, high = similarity
    shared = F.least(F.lit(MOST_SHARED), 1 + F.floor(F.ceil(F.col("n") * F.lit(low).cast("long") / F.lit(high)) / PER_SHARED)) - 1
    both = F.least(F.col("n") - F.col("place") + shared, F.col("n")).cast("long")
    early = listed.where(both * (low + high) >= (F.col("n") + F.col("lead.n")) * F.lit(low).cast("long"))
    alone = F.hex("node").cast("binary")
    held = ["shingle", "node", "n", "place"]
    if near is None:
        placed = early.select(*held, alone.alias("component"))
    else:
        of = near.select(_node(F.col("node")).alias("node"), "component")
        placed = early.join(of, "node", "left").select(*held, F.coalesce("component", alone).alias("component"))
    placed, _ = materialise(placed.distinct())
    crowds = placed.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("held"))
    mixed_ = crowds.groupBy("shingle").agg(F.max_by("component", F.struct("held", "component")).alias("main"),
                                           F.count(F.lit(1)).alias("of"), F.sum("held").alias("held")).where("of > 1").drop("of")
    return materialise(placed.join(mixed_, "shingle").withColumn("main", F.col("component") == F.col("main")))[0]


def _open_pairs(placed: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs of nodes (a, b) that share enough of these lists, early enough, and aren't connected yet.

    The sets outside a list's largest component meet all sets of the list. Two sets have
    the same order, so what they share lies behind the first place in both where they meet.
    """
    side = lambda x: placed.select("shingle", F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("place").alias(f"place_{x}"),
                                   F.col("component").alias(f"of_{x}"), F.col("main").alias(f"main_{x}"))
    # Only the first places where two sets meet are needed, as many as they have to share.
    before = F.least("place_a", "place_b", _least(similarity) - 1)
    met = side("a").where("NOT main_a").join(side("b"), "shingle").where(
        F.expr("of_a <> of_b AND (main_b OR a < b)") & _may_link(similarity, before))
    # Either set may lie in the largest component of one list and outside that of another.
    one_way = lambda x, y: [F.when(F.col("a") < F.col("b"), F.col(f"{c}{x}")).otherwise(F.col(f"{c}{y}")).alias(f"{c}{x}")
                            for c in ("", "n_", "place_")]
    return _enough(met.select(*one_way("a", "b"), *one_way("b", "a")), similarity)


def _enough(met: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of nodes that meet in enough lists, the first one early enough."""
    return (met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("lists"), *[F.min(c).alias(c) for c in ("n_a", "n_b", "place_a", "place_b")])
            .where((F.col("lists") >= _least(similarity)) & _may_link(similarity)).select("a", "b"))


class Forest:
    """Which of so many things are connected."""

    def __init__(self, size: int) -> None:
        self.above = list(range(size))

    def top(self, x: int) -> int:
        while self.above[x] != x:
            self.above[x] = x = self.above[self.above[x]]
        return x

    def connects(self, a: int, b: int) -> bool:
        """Connect two things; whether they weren't."""
        a, b = self.top(a), self.top(b)
        self.above[a] = b
        return a != b


def _sets(wanted: DataFrame, rows: DataFrame, docs: DataFrame, words: int) -> tuple[DataFrame, int]:
    """(node, digest, values) of the wanted nodes, and their number."""
    owners, many = materialise(rows.where("n > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("owner"))
                               .withColumn("node", _node(F.col("digest"))).join(wanted, "node", "left_semi")
                               .select(F.col("owner.doc_id").alias("owner"), F.col("owner.text_key").alias("owner_key"), "digest"))
    if many * OWNER_BYTES <= BROADCAST_BYTES:
        owners = F.broadcast(owners)  # counted; else both sides are shuffled
    # By text too: ids may be shared or null.
    texts = docs.select("doc_id", _text_key().alias("text_key"), "text").join(
        owners, F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("text_key") == F.col("owner_key")))
    sets, held = materialise(_sets_of(texts, words))
    if held > many:  # repeated rows
        sets = sets.dropDuplicates(["digest"])
    return sets, many


_LINKS = _fields(("a", T.BinaryType()), ("b", T.BinaryType()))


def _links(found: list[tuple[bytes, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["a", "b"], dtype=object)


def _searched(pairs: DataFrame, rows: DataFrame, docs: DataFrame, words: int, similarity: tuple[int, int]) -> tuple[DataFrame, int]:
    """Links (a, b) between digests, for node pairs (a, b): b is searched in the block of sets that holds a.

    Of the links that a search finds, those are returned that connect sets it has not connected yet.
    """
    sets, many = _sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), rows, docs, words)
    block = F.pmod(F.hash("a"), F.lit(max(1, many // INDEXED)))
    asked = pairs.select(block.alias("block"), "b").distinct()
    load, _ = materialise(asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("salts")))
    queries = asked.join(load, "block").select(
        "block", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.col("b").alias("node"), F.lit(True).alias("query"))
    indexed = pairs.select(block.alias("block"), F.col("a").alias("node")).distinct().join(load, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "node", F.lit(False).alias("query"))
    meeting = queries.unionByName(indexed).join(sets, "node").select("block", "salt", "query", "digest", "values")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        values = [np.frombuffer(v, dtype=np.uint64) for v in group["values"]]
        query = group["query"].to_numpy()
        digests = group["digest"].tolist()
        held = np.flatnonzero(~query)
        index = Index([values[i] for i in held])
        known, forest = pd.factorize(group["digest"])[0].tolist(), Forest(len(group))
        return _links([(digests[held[j]], digests[i]) for i in np.flatnonzero(query) for j in index.search(values[i], similarity)
                       if forest.connects(known[held[j]], known[i])])

    return materialise(meeting.groupBy("block", "salt").applyInPandas(search, _LINKS))


def _searched_lists(placed: DataFrame, rows: DataFrame, docs: DataFrame, words: int, similarity: tuple[int, int]) -> tuple[DataFrame, int]:
    """Links (a, b) between digests of unlike components that meet in one of these lists, enough to connect them.

    A list is cut into blocks; every two of its blocks meet in a task, in which the sets
    outside the list's largest component are searched against all.
    """
    sets, _ = _sets(placed.select("node").distinct(), rows, docs, words)
    blocks = F.ceil(F.col("held") / LIST_BLOCK).cast("int")
    at = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = placed.select("shingle", "node", "component", "main", at.alias("at"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    meeting = dealt.select("shingle", F.least("at", "other").alias("first"), F.greatest("at", "other").alias("second"),
                           "node", "component", "main", "at").join(sets, "node").drop("node")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        values = [np.frombuffer(v, dtype=np.uint64) for v in group["values"]]
        main, at, digests = group["main"].to_numpy(), group["at"].to_numpy(), group["digest"].tolist()
        first, second = at == group["first"].iloc[0], at == group["second"].iloc[0]
        of, forest, found = pd.factorize(group["component"])[0].tolist(), Forest(len(group)), []
        turns = [(first, second & ~main)] + ([(first & ~main, second & main)] if (first != second).any() else [])
        for holds, asks in turns:
            held, queries = np.flatnonzero(holds), np.flatnonzero(asks)
            if len(held) and len(queries):
                index = Index([values[i] for i in held])
                found += [(digests[held[j]], digests[i]) for i in queries for j in index.search(values[i], similarity)
                          if forest.connects(of[held[j]], of[i])]
        return _links(found)

    return materialise(meeting.groupBy("shingle", "first", "second").applyInPandas(search, _LINKS))


def _labelled(docs: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """(doc_id, text_key, n, digest, component) per row of `docs`; component: the digest that stands for its group."""
    columns_or_raise(docs, "doc_id", "text")
    described, _ = materialise(_described(docs, words))
    rows = described.where(F.col("n").isNotNull()).select("doc_id", "text_key", "n", "digest")
    common = (described.where(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("texts").alias("texts"))
              .where(F.col("texts") >= COMMON).orderBy(F.desc("texts"), "shingle").limit(MOST_COMMON).select("shingle").toArrow())
    common = np.sort(np.asarray(common["shingle"].combine_chunks()).view(np.uint64))
    each = Window.partitionBy("shingle")
    # Sets that hold the same passage are most alike the smallest of them.
    postings = _postings(docs, words, similarity, common).withColumns(
        {"first": F.min("node").over(each), "last": F.max("node").over(each), "lead": F.min(F.struct("n", "node", "place")).over(each)})
    listed, _ = materialise(postings.where("first < last").drop("first", "last"))
    stars, many = materialise(_enough(listed.where("node <> lead.node").select(
        F.col("lead.node").alias("a"), F.col("node").alias("b"), F.col("lead.n").alias("n_a"), F.col("n").alias("n_b"),
        F.col("lead.place").alias("place_a"), F.col("place").alias("place_b")), similarity))
    linked = near = None
    if many:
        linked, _ = _searched(stars, rows, docs, words, similarity)
        near = components(linked)
    placed = _unconnected(listed, near, similarity)
    further = []
    crowded, many = materialise(placed.where(F.col("held") > CROWD))
    if many:
        further.append(_searched_lists(crowded, rows, docs, words, similarity))
    pairs, many = materialise(_open_pairs(placed.where(F.col("held") <= CROWD), similarity))
    if many:
        further.append(_searched(pairs, rows, docs, words, similarity))
    for links, found in further:
        if found:
            linked = links if linked is None else linked.unionByName(links)
    if near is None or any(found for _, found in further):
        near = components(linked) if linked is not None else None
    if near is None:
        near = rows.limit(0).select(F.col("digest").alias("node"), F.col("digest").alias("component"))

    labelled = rows.join(near.withColumnRenamed("node", "digest"), "digest", "left").withColumn(
        "component", F.coalesce("component", "digest"))
    return materialise(labelled)[0]


def similar_groups(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) per row of `docs`.

    `component_id` is the smallest doc_id reachable by links of `similarity`
    (intersection over union, as a fraction). A text with fewer words than `words` is
    one shingle; a null or blank text has none and links with nothing. Repeated rows
    link with each other. A null doc_id is never the smallest unless all are null.
    Shingles are compared by 64-bit, sets by 128-bit hashes.
    """
    labelled = _labelled(docs, words, similarity)
    first = labelled.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("first"))
    joined = labelled.where("n > 0").join(first, "component").unionByName(
        labelled.where("n = 0").withColumn("first", F.col("doc_id")))
    return joined.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("first").alias("component_id"))


def _node(digest: Column) -> Column:
    """The first eight bytes of a digest as a signed little-endian number, as `_short` has it."""
    pair = lambda k: F.hex(F.substring(digest, k, 1))
    part = lambda places: F.conv(F.concat(*[pair(k) for k in places]), 16, 10).cast("long")
    return F.shiftleft(part((8, 7, 6, 5)), 32).bitwiseOR(part((4, 3, 2, 1)))


def keep_one(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows of `docs` without near copies: of each group the one with the smallest doc_id, then text_key, stays.

    Groups are of texts, whatever their ids: a doc_id that unlike texts share, or null,
    loses none of them. A null doc_id stays only if its group has no other. Repeated
    rows are one document. Texts without words are no copies of each other; one per
    doc_id and text_key stays.
    """
    labelled = _labelled(docs, words, similarity)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    kept = (labelled.where("n > 0").groupBy("component").agg(F.min(place).alias("first")).select("first.doc_id", "first.text_key")
            .unionByName(labelled.where("n = 0").select("doc_id", "text_key").distinct()))
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id",
                        _text_key().alias("text_key"))
    found = whole.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key")), "left_semi")
    return found.dropDuplicates(["doc_id", "text_key"]).select("row.*")
