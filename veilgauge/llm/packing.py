"""Packing of token pieces into sequences by linear grouping and best fit.

Lengths are whole numbers up to the capacity, so a histogram of at most `capacity`
counts describes any number of pieces. The plan is made on that histogram alone:
large lengths are rounded up within groups of equal cardinality; configurations of
the few rounded sizes are chosen one by one, each the fullest that holds the largest
size left, and used as often as the counts allow; the actual lengths take the places
of the rounded ones; small lengths then go where they fit best. Every piece finds its
place from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgauge.llm.common import Remembered, columns_or_raise, text_slices
from veilgauge.llm.merges import PairMerges
from veilgauge.session import materialise

CAPACITY = 4096
END = 1
#: Lengths above capacity / SMALL are large; the others fill the gaps.
SMALL = 8
#: Group counts tried; the plan with the fewest sequences is taken.
GROUPS = (16, 64, 256)
#: Chunks of text other than plain words that a Python worker remembers.
REMEMBERED = 100_000
#: Letters of the longest word that is handled as a number; the longer ones go to the tokenizer.
WORD = 16
STOPS = ".,"
#: Characters handled at once: distinct words are merged once per slice.
SLICE = 3 << 20
_BLANK, _LETTER, _STOP, _OTHER = range(4)
#: Masks that keep the first 0 to 8 bytes of eight.
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


class Chunks:
    """Ids of white-space separated chunks of text, gathered from those of its distinct words.

    The tokenizer drops white space and never joins anything across it, so the ids of
    a text are those of its chunks in order. A word of up to 16 Latin-1 letters and the
    stops behind it are separate tokens, and case doesn't matter: such chunks are found
    and compared as numbers, whole slices of text at once, and merged with the
    tokenizer's own merge table. All others go to the tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores out
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.seen = Remembered(REMEMBERED)
        self._read_merges(path)
        self._read_classes()
        if self._ids(["a b", "a", "b"])[0] != b"".join(self._ids(["a", "b"])):
            raise ValueError("only tokenizers that drop white space are supported")

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: set[str]) -> dict[str, bytes]:
        fresh = list(fresh)
        return dict(zip(fresh, self._ids(fresh), strict=True))

    def _read_merges(self, path: str) -> None:
        """The tokenizer's own merge table, for plain words: many new ones a round instead of a call each."""
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.merges = PairMerges({(vocabulary[a], vocabulary[b]): (r, vocabulary[a + b]) for r, (a, b) in enumerate(pairs)}, len(vocabulary))
        # Bytes stand for themselves where printable and else, in order, for the characters from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        names = [chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)]
        self.inside = np.array([vocabulary[n] for n in names])
        self.last = np.array([vocabulary[n + suffix] for n in names])

    def _read_classes(self) -> None:
        """What a character is, and its lower case, by its number; numbers beyond the last white space are `_OTHER`."""
        blank = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
        self.classes = np.full(0x3002, _OTHER, dtype=np.uint8)
        self.classes[:256] = [_LETTER if chr(i).isalpha() else _OTHER for i in range(256)]
        self.classes[[ord(c) for c in STOPS]] = _STOP
        self.classes[blank] = _BLANK
        self.lower = np.array([ord(chr(i).lower()) for i in range(256)], dtype=np.uint8)

    def _words(self, keys: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of lower-case Latin-1 letters, one word behind the other, and how many each has.

        keys: (words, 16) letters, zero behind the end.
        """
        letters = keys[np.arange(WORD)[None, :] < lengths[:, None]].astype(np.int64)
        wide = letters >= 128  # two bytes in UTF-8
        at = np.cumsum(1 + wide) - 1
        coded = np.empty(int(at[-1]) + 1 if len(at) else 0, dtype=np.int64)
        coded[at] = np.where(wide, 0x80 | letters & 0x3F, letters)
        coded[at[wide] - 1] = 0xC0 | letters[wide] >> 6
        unit = np.empty(len(coded), dtype=np.int64)
        unit[at] = np.repeat(np.arange(len(lengths)), lengths)
        unit[at[wide] - 1] = unit[at[wide]]
        sym = self.inside[coded]
        ends = at[np.cumsum(lengths) - 1]
        sym[ends] = self.last[coded[ends]]
        sym, unit = self.merges.merge(sym, unit)
        return sym, np.bincount(unit, minlength=len(lengths))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; none for a null or blank text."""
        sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), dtype=np.int64, count=len(texts))
        whole = " ".join(t or "" for t in texts) + " " * (2 * WORD)
        points = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
        kind = self.classes[np.minimum(points, len(self.classes) - 1)]
        low = self.lower[np.minimum(points, 255).astype(np.uint8)]
        del points
        full = kind != _BLANK
        start = np.flatnonzero(full & ~np.r_[False, full[:-1]])
        if not len(start):
            return [b""] * len(texts)
        end = np.flatnonzero(full[:-1] & ~full[1:]) + 1
        letter, stop = kind == _LETTER, kind == _STOP
        n_letters, n_stops = (np.add.reduceat(x, start, dtype=np.int64) for x in (letter, stop))
        mixed_up = np.flatnonzero(letter[1:] & stop[:-1]) + 1  # a letter behind a stop
        plain = (n_letters > 0) & (n_letters <= WORD) & (n_stops <= 8) & (n_letters + n_stops == end - start)
        plain[np.searchsorted(start, mixed_up, side="right") - 1] = False
        plain &= letter[start]

        # The distinct words and runs of stops as numbers: 16 letters are two of them, a run of stops one.
        eight = np.ndarray(shape=(len(low) - 7,), dtype="<u8", buffer=low, strides=(1,))
        at, size = start[plain], n_letters[plain]
        first, second = eight[at] & _KEPT[np.minimum(size, 8)], eight[at + 8] & _KEPT[np.maximum(size - 8, 0)]
        behind = eight[at + size] & _KEPT[n_stops[plain]]
        word, distinct = _numbered(first, second)
        tail, tails = _numbered(behind, np.zeros_like(behind))
        letters = np.stack([first[distinct], second[distinct]], axis=1).astype("<u8").view(np.uint8).reshape(-1, WORD)
        ids, held = self._words(letters, size[distinct])
        rest = np.flatnonzero(~plain)
        odd = [whole[a:b] for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)]
        odd += [int(x).to_bytes(8, "little").rstrip(b"\0").decode() for x in behind[tails]]
        found = self.seen.of([c for c in odd if c], self._learn)
        if "" in odd:
            found.insert(odd.index(""), b"")  # the run of no stops; chunks aren't empty

        # One entry per distinct word, odd chunk and run of stops; a chunk is a word with a run, or odd with nothing behind.
        ids = np.concatenate([ids.astype("<u4"), np.frombuffer(b"".join(found), dtype="<u4")])
        held = np.r_[held, np.fromiter((len(x) // 4 for x in found), dtype=np.int64, count=len(found)), 0]
        place = np.cumsum(held) - held
        entry = np.full((len(start), 2), len(held) - 1, dtype=np.int64)
        entry[plain, 0], entry[plain, 1] = word, len(distinct) + len(rest) + tail
        entry[rest, 0] = len(distinct) + np.arange(len(rest))
        entry = entry.ravel()
        held = held[entry]
        upto = np.cumsum(held)
        ids = ids[np.arange(upto[-1]) + np.repeat(place[entry] - (upto - held), held)].tobytes()
        of_text = np.r_[0, upto][2 * np.searchsorted(start, np.r_[0, np.cumsum(sizes)])] * 4
        return [ids[a:b] for a, b in zip(of_text[:-1].tolist(), of_text[1:].tolist(), strict=True)]


def _numbered(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct pair, from 0 on, and the place of a pair with each number."""
    if second.any():
        key = np.stack([first, second], axis=1).view([("first", "<u8"), ("second", "<u8")]).ravel()
        short = second == 0
        number = np.empty(len(key), dtype=np.int64)
        number[short], seen = pd.factorize(first[short])
        _, number[~short] = np.unique(key[~short], return_inverse=True)
        number[~short] += len(seen)
    else:
        number, _ = pd.factorize(first)
    places = np.empty(int(number.max(initial=-1)) + 1, dtype=np.int64)
    places[number] = np.arange(len(number))
    return number, places


@lru_cache(maxsize=2)
def chunks(path: str) -> Chunks:
    return Chunks(path)


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", end: int = END) -> DataFrame:
    """(key, piece, start, length, ids): token ids of every whole text and the end id, cut at the capacity only.

    Ids are little-endian unsigned 32-bit integers. A null text counts as empty and
    becomes one piece that holds the end id. Repeated rows stay.
    """
    columns_or_raise(docs, key, "text")
    kind = T.StructType([docs.select(key).schema[0], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                         T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    last, step = np.array([end], dtype="<u4").tobytes(), capacity * 4

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunks(path)
        for batch in source:
            texts = batch.column(1).to_pylist()
            for a, b in text_slices(texts, SLICE):
                row, piece, start, ids = [], [], [], []
                for i, whole in enumerate(known.encode(texts[a:b]), a):
                    whole += last
                    for n, at in enumerate(range(0, len(whole), step)):
                        row.append(i)
                        piece.append(n)
                        start.append(at // 4)
                        ids.append(whole[at:at + step])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], kind.names)

    return docs.select(key, "text").mapInArrow(batches, kind)


class Plan:
    """Runs of places: pieces of one length and consecutive ranks in consecutive sequences."""

    def __init__(self, counts: np.ndarray, capacity: int, groups: int, small: int = SMALL) -> None:
        """counts[l]: pieces of length l, for l up to the capacity."""
        self.capacity, self.sequences = capacity, 0
        self.used = np.zeros(capacity + 1, dtype=np.int64)  # pieces of each length that have a place
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, pieces in a sequence, first sequence, offset
        open_: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs (first sequence, sequences)
        self._large(counts, groups, capacity // small, open_)
        self._small(counts, capacity // small, open_)
        self.runs.sort()
        self.arrays = [np.array(x, dtype=np.int64) for x in zip(*self.runs, strict=True)] if self.runs else []

    def _put(self, length: int, pieces: int, each: int, sequence: int, offset: int) -> None:
        self.runs.append((length, int(self.used[length]), each, sequence, offset))
        self.used[length] += pieces

    def _large(self, counts: np.ndarray, groups: int, limit: int, open_: dict) -> None:
        lengths = np.flatnonzero(counts)[::-1]
        lengths = lengths[lengths > limit]
        total = int(counts[lengths].sum())
        if not total:
            return
        size = -(-total // groups)
        # Actual lengths from the longest, cut into groups of equal cardinality; a group's size is its longest.
        queues: list[list[list[int]]] = []
        room = 0
        for length in lengths.tolist():
            left = int(counts[length])
            while left:
                if not room:
                    queues.append([])
                    room = size
                taken = min(left, room)
                queues[-1].append([length, taken])
                left, room = left - taken, room - taken
        merged: dict[int, list[list[int]]] = {}
        for queue in queues:
            merged.setdefault(queue[0][0], []).extend(queue)
        sizes = sorted(merged, reverse=True)
        stock = np.array([sum(n for _, n in merged[s]) for s in sizes], dtype=np.int64)
        while stock.any():
            config = self._fullest(sizes, stock)
            times = min(int(stock[i]) // n for i, n in config)
            for i, n in config:
                stock[i] -= n * times
            self._substitute([merged[sizes[i]] for i, n in config for _ in range(n)], times, open_)

    def _fullest(self, sizes: list[int], stock: np.ndarray) -> list[tuple[int, int]]:
        """The largest size left with what fills its sequence best, as (place of size, times); larger sizes first."""
        first = int(np.flatnonzero(stock)[0])
        room = self.capacity - sizes[first]
        reach = np.zeros(room + 1, dtype=bool)
        reach[0] = True
        by = np.full(room + 1, -1, dtype=np.int64)
        for i in range(first, len(sizes)):
            if reach[room]:
                break
            most = int(stock[i]) - (i == first)
            for _ in range(min(most, room // sizes[i])):
                fresh = np.zeros_like(reach)
                fresh[sizes[i]:] = reach[:-sizes[i]]
                fresh &= ~reach
                if not fresh.any():
                    break
                by[fresh] = i
                reach |= fresh
        filled = int(np.flatnonzero(reach)[-1])
        times: dict[int, int] = {first: 1}
        while filled:
            i = int(by[filled])
            times[i] = times.get(i, 0) + 1
            filled -= sizes[i]
        return sorted(times.items())

    def _substitute(self, slots: list[list[list[int]]], times: int, open_: dict) -> None:
        """Fill `times` sequences: each slot takes that many actual lengths from its group, longest first."""
        taken: list[list[list[int]]] = []
        for queue in slots:
            part, left = [], times
            while left:
                length, n = queue[0]
                now = min(n, left)
                part.append([length, now])
                left -= now
                if now == n:
                    queue.pop(0)
                else:
                    queue[0][1] -= now
            taken.append(part)
        while taken[0]:
            run = min(part[0][1] for part in taken)
            offset = 0
            for part in taken:
                self._put(part[0][0], run, 1, self.sequences, offset)
                offset += part[0][0]
                part[0][1] -= run
                if not part[0][1]:
                    part.pop(0)
            open_.setdefault(self.capacity - offset, []).append((self.sequences, run))
            self.sequences += run

    def _small(self, counts: np.ndarray, limit: int, open_: dict) -> None:
        for length in range(min(limit, self.capacity), 0, -1):
            left = int(counts[length])
            while left:
                free = min((r for r in open_ if r >= length), default=None)
                if free is None:  # as many new sequences as the rest needs
                    each = self.capacity // length
                    free = self.capacity
                    open_.setdefault(free, []).append((self.sequences, -(-left // each)))
                    self.sequences += -(-left // each)
                first, n = open_[free].pop()
                each = free // length
                full = min(n, left // each)
                offset = self.capacity - free
                if full:
                    self._put(length, full * each, each, first, offset)
                    open_.setdefault(free - each * length, []).append((first, full))
                    left -= full * each
                if full < n:
                    rest = left if left < each else 0
                    if rest:
                        self._put(length, rest, rest, first + full, offset)
                        open_.setdefault(free - rest * length, []).append((first + full, 1))
                        full += 1
                        left = 0
                    if full < n:
                        open_.setdefault(free, []).append((first + full, n - full))
                if not open_.get(free):
                    open_.pop(free, None)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and rank."""
        lengths, starts, each, base, offset = self.arrays
        first = np.searchsorted(lengths, length)
        # Runs of a length stand in the order of their ranks: look for the last that starts at or before the rank.
        scale = int(starts.max()) + int(rank.max(initial=0)) + 1
        dense = np.searchsorted(np.unique(lengths), lengths)
        at = np.searchsorted(dense * scale + starts, dense[first] * scale + rank, side="right") - 1
        within = rank - starts[at]
        return base[at] + within // each[at], offset[at] + within % each[at] * length


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, small: int = SMALL) -> DataFrame:
    """`pieces` with `sequence_id` and `offset`: gapless places in sequences of at most `capacity`.

    `pieces` has a `length` from 1 to `capacity`. Every row gets a place. Ranks are
    counted inside the tasks that write the rows, and completed by a join with the
    counts of (task, length); only the histogram of lengths reaches the driver. Columns
    that are named like an added one are replaced.
    """
    columns_or_raise(pieces, "length")
    pieces = pieces.drop("sequence_id", "offset", "_task", "_in_task", "_base", "_rank")
    counted = T.StructType([*pieces.schema.fields, T.StructField("_task", T.IntegerType()), T.StructField("_in_task", T.LongType())])
    place = pieces.columns.index("length")

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = np.zeros(capacity + 1, dtype=np.int64)
        task = TaskContext.get().partitionId()
        for batch in source:
            length = np.asarray(batch.column(place)).astype(np.int64)
            if len(length) and not (1 <= length.min() and length.max() <= capacity):
                raise ValueError(f"lengths lie from 1 to {capacity}")
            rank = pd.Series(length).groupby(length).cumcount().to_numpy() + so_far[length]
            so_far += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), task, dtype=np.int32)),
                                              pa.array(rank, pa.int64())], counted.names)

    rows, _ = materialise(pieces.mapInArrow(count, counted))
    held, _ = materialise(rows.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_held")))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("_task", "length", F.coalesce(F.sum("_held").over(before), F.lit(0)).cast("long").alias("_base"))
    histogram = held.groupBy("length").agg(F.sum("_held").alias("n")).collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in histogram:
        counts[row["length"]] = row["n"]
    plan = min((Plan(counts, capacity, g, small) for g in groups), key=lambda x: x.sequences)
    ranked = rows.join(bases, ["_task", "length"]).select(*pieces.columns, (F.col("_base") + F.col("_in_task")).alias("_rank"))
    kind = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def placed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                where = plan.place(np.asarray(batch.column(place)).astype(np.int64), np.asarray(batch.column(batch.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, pa.int64()) for x in where)], kind.names)

    return ranked.mapInArrow(placed, kind)
