"""SentencePiece byte-pair encoding and decoding in vectorised merge rounds.

The distinct units of a batch lie side by side in flat symbol arrays. In each round
every unit merges its pair of minimum rank, all units at once; units without a pair
left are taken out and the arrays compacted. A unit is a run of blanks with the
characters behind it: no piece of the vocabulary reaches across such a border, so
units are independent, and the ids of units already seen are looked up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilgauge.llm.common import Remembered, columns_or_raise, text_slices
from veilgauge.llm.merges import PairMerges, split_ids

BLANK = "▁"
#: Units remembered by a Python worker.
REMEMBERED = 300_000
CODEPOINTS = 0x110000


class Vocabulary:
    """Tables of one model file, and the ids of units seen so far."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        usual = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.size, self.begin, self.end = size, model.bos_id(), model.eos_id()
        self.bytes_of = {int(pieces[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        if any(model.is_unused(i) for i in usual) or len(self.bytes_of) not in (0, 256):
            raise ValueError("models with unused pieces or a partial byte fallback are not supported")
        probe = "ﬁ ½  x é "
        if model.decode(model.encode(probe)) != probe:
            raise ValueError("only models that leave their text as it is are supported")
        known = {pieces[i]: i for i in usual}
        self.symbol = np.arange(CODEPOINTS, dtype=np.int64) + size  # characters outside the vocabulary
        for piece, i in known.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        of = lambda part: known.get(part, size + ord(part) if len(part) == 1 else None)
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in usual}, reverse=True))}
        pairs, joined = {}, set()
        for piece, i in known.items():
            joined.update(piece if len(piece) > 1 else "")
            if re.search(f"[^{BLANK}]{BLANK}", piece):
                raise ValueError("a piece reaches across a blank")
            for k in range(1, len(piece)):
                left, right = of(piece[:k]), of(piece[k:])
                if left is not None and right is not None:
                    pairs[left, right] = (order[model.get_score(i)], i)
        self.pairs = PairMerges(pairs, size + CODEPOINTS)
        alone = "".join(c for c in "\n\t\r" if c not in joined)  # characters that never merge end a unit as well
        stops = re.escape(alone)
        self.units = re.compile((f"[{stops}]|" if alone else "") + f"{BLANK}*[^{BLANK}{stops}]+|{BLANK}+")
        self.text_of = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i)
                        else b" \xe2\x81\x87 " if model.is_unknown(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.seen = Remembered(REMEMBERED)

    def merge(self, units: list[str]) -> list[bytes]:
        """Ids of each unit, as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sym, unit = self.pairs.merge(self.symbol[flat], np.repeat(np.arange(len(units)), lengths))
        unit, sym = self._fall_back(unit, sym)
        return split_ids(sym, unit, len(units))

    def _fall_back(self, unit: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the pieces of their bytes, or else the unknown piece."""
        odd = np.flatnonzero(sym >= self.size)
        if not len(odd):
            return unit, sym
        spelt = [[self.bytes_of[b] for b in chr(s - self.size).encode("utf-8", "surrogatepass")] if self.bytes_of else [self.unknown]
                 for s in sym[odd].tolist()]
        times = np.ones(len(sym), dtype=np.int64)
        times[odd] = [len(x) for x in spelt]
        out = np.repeat(sym, times)
        out[np.repeat(sym >= self.size, times)] = [b for x in spelt for b in x]
        return np.repeat(unit, times), out

    def encode(self, texts: list[str | None], ends: bool = True) -> list[bytes]:
        """Ids of each text with begin and end ids; a null text counts as empty."""
        before, after = (np.array([x], dtype="<u4").tobytes() if ends else b"" for x in (self.begin, self.end))
        units = [self.units.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        ids = self.seen.of([u for x in units for u in x], self._learn)
        out, first = [], 0
        for x in units:
            out.append(before + b"".join(ids[first:first + len(x)]) + after)
            first += len(x)
        return out

    def _learn(self, fresh: set[str]) -> dict[str, bytes]:
        units = list(fresh)
        return dict(zip(units, self.merge(units), strict=True))

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", ends: bool = True) -> DataFrame:
    """(key, n_tokens, ids): ids of every whole text as little-endian unsigned 32-bit integers.

    `path` is the model file, present on every machine. Each row is encoded, repeated
    ones too; null texts count as empty; other columns are left out.
    """
    columns_or_raise(docs, key, "text")
    kind = T.StructType([docs.select(key).schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in source:
            texts = batch.column(1).to_pylist()
            for a, b in text_slices(texts):
                ids = words.encode(texts[a:b], ends)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    [key, "n_tokens", "ids"])

    return docs.select(key, "text").mapInArrow(batches, kind)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of `encoded` with `decoded`, the text of `ids`; null ids give a null text."""
    columns_or_raise(encoded, "ids")
    encoded = encoded.drop("decoded")
    kind = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    place = encoded.columns.index("ids")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in source:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = [None if x is None else words.decode(x) for x in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], kind.names)

    return encoded.mapInArrow(batches, kind)
