"""What several training-data operators share."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.session import materialise

#: White space between words: blank and U+0009 to U+000D; every other character belongs to a word.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def columns_or_raise(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")


def words_of(text: Column) -> Column:
    """The words of a text in order; none for a null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from every node that occurs in a link: (node, component).

    Each round hooks every node to its smallest neighbour, halves the chains that
    arise until they are stars, and contracts the links. At least half of the
    remaining nodes disappear in a round. Everything stays in tables of the shared
    scratch folder; only row counts reach the driver. Null ends are ignored.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    pairs, left = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while left:
        ends = pairs.select(F.col("b").alias("node"), F.col("a").alias("other")).unionByName(
            pairs.select(F.col("a").alias("node"), F.col("a").alias("other")))
        parents, _ = materialise(ends.groupBy("node").agg(F.min("other").alias("parent")))
        while True:
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            halved, _ = materialise(parents.join(above, "parent").select(
                "node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")))
            parents = halved.select("node", "parent")
            if halved.where("moved").isEmpty():
                break
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("component"))
        else:
            step = parents.select(F.col("node").alias("component"), F.col("parent").alias("root"))
            labels, _ = materialise(labels.join(step, "component", "left").select(
                "node", F.coalesce("root", "component").alias("component")))
        for end in ("a", "b"):
            pairs = pairs.join(parents.select(F.col("node").alias(end), F.col("parent").alias("root")), end).drop(end)
            pairs = pairs.withColumnRenamed("root", end)
        pairs, left = materialise(pairs.where("a <> b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if labels is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def text_slices(texts: list[str | None], characters: int = 1 << 21):
    """Consecutive (first, last) index ranges of about so many characters, so that work arrays stay small."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text) if text else 0
        if held >= characters:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit words over all bits."""
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes:
    """64-bit hashes of words; so many words are remembered between texts."""

    def __init__(self, remembered: int = 200_000) -> None:
        self.remembered = remembered
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.remembered:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


class Remembered:
    """A bounded store of values by word: two halves, of which the older is given up when the newer is full.

    Words in use move to the newer half, so frequent ones stay.
    """

    def __init__(self, most: int) -> None:
        self.half = most // 2
        self.new: dict = {}
        self.old: dict = {}

    def of(self, words: list, learn) -> list:
        """The value of each word; `learn` gets the set of unknown words and returns a dict with them."""
        found = list(map(self.new.get, words))
        gaps = [i for i, v in enumerate(found) if v is None]
        if gaps:
            missing = {words[i] for i in gaps}
            if len(self.new) > self.half:
                self.old, self.new = self.new, {}
            old = self.old.get
            kept = {w: v for w in missing if (v := old(w)) is not None}
            self.new.update(kept)
            if len(kept) < len(missing):
                self.new.update(learn(missing.difference(kept)))
            value = self.new.__getitem__
            for i in gaps:
                found[i] = value(words[i])
        return found
