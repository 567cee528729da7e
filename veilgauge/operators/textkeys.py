"""Keys under which similar texts meet, and how similar two texts can be at most.

Texts are taken as bags of character pairs, with a mark before the first and after the
last character; the n-th occurrence of a pair is a pair of its own. If two texts reach a
similarity, what they have in common is a subsequence of some length; every character
outside it breaks two pairs at most and every insertion one, so at least so many pairs
are shared (count filter). Texts list their pairs rarest first. Of two texts that share
``c`` pairs, the first ``all - c + 1`` of both lists have one in common (prefix filter),
so only these are keys. Lengths bound ``c`` from below, and common characters bound the
similarity from above.

Where texts are short and almost all of their characters have to agree, a pair of
characters says too little (codes that differ in a digit share most pairs with most
others). What two similar texts have in common is then a subsequence of a length that both
lengths give, so texts list all their subsequences of such lengths as keys (deletion
neighbourhood): whoever meets is nearly always similar.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.session import materialise

#: Lowest similarity at which two texts surely share a character pair, by measure.
LOWEST = {"ratcliff": 2 / 3, "levenshtein": 0.5}
#: Similarities are compared after rounding to thousandths.
HALF_STEP = 0.0005
SLACK = 1e-9
#: Characters are counted in so many groups; groups only raise the bound.
GROUPS = 32
#: Texts longer than this are found by their character pairs.
SHORT = 64
#: Subsequences made at once.
AT_ONCE = 1 << 19
#: Odd, so that places in a text do not fade from the sum.
BASE = np.uint64(0x9E3779B97F4A7C15)


def usable(method: str, least: float) -> bool:
    """Whether texts of this similarity meet under a key that not all texts have."""
    return least - HALF_STEP - SLACK > LOWEST[method] + 0.01


def shared_at_least(method: str, length: str, least: str) -> str:
    """Fewest character pairs that a text of this length shares with any text at least so similar."""
    least = f"({least} - {HALF_STEP + SLACK!r}D)"
    if method == "levenshtein":
        # With m characters in the longer text: m + 1 pairs, two lost per edit, at most (1 - least) m edits.
        found = f"{length} * (2 * {least} - 1) + 1"
    else:
        # 3 M - la - lb + 1 with M = least (la + lb) / 2, smallest for the shortest text that can reach it.
        found = f"({length} + {length} * {least} / (2 - {least})) * (1.5D * {least} - 1) + 1"
    return f"greatest(1, int(ceil({found} - {SLACK!r}D)))"


def prefix(tokens: str, length: str, least: str, method: str) -> str:
    """The pairs of a text, rarest first, that have to hold one it shares with a similar text."""
    return f"slice({tokens}, 1, greatest(1, size({tokens}) - {shared_at_least(method, length, least)} + 1))"


def at_most(method: str, a: str, b: str, letters_a: str, letters_b: str) -> str:
    """Similarity that the common characters of two texts allow, rounded as similarities are; 0 for a missing text."""
    common = f"aggregate(zip_with({letters_a}, {letters_b}, (x, y) -> least(x, y)), 0, (s, x) -> s + x)"
    if method == "levenshtein":
        bound = f"if(greatest(length({a}), length({b})) = 0, 1D, {common} / greatest(length({a}), length({b}), 1))"
    else:
        bound = f"if(length({a}) + length({b}) = 0, 1D, 2 * {common} / greatest(length({a}) + length({b}), 1))"
    return f"coalesce(round({bound} + {SLACK!r}D, 3), 0D)"


def common_at_least(method: str, a: int, b: int, least: float) -> int:
    """Length of a subsequence that texts of these lengths surely have in common if they are at least so similar."""
    reached = least - HALF_STEP - SLACK
    # Every edit takes a character of the longer text at most; the ratio counts characters in common on both sides.
    return max(0, ceil((reached * max(a, b) if method == "levenshtein" else reached * (a + b) / 2) - SLACK))


def kept_lengths(method: str, length: int, others: list[int], least: float) -> list[int]:
    """Lengths of the subsequences by which a text meets similar ones of the other side's lengths."""
    found = [(common_at_least(method, length, other, least), other) for other in others]
    return sorted({n for n, other in found if n <= min(length, other)})


def lengths_of(a: DataFrame, b: DataFrame, i: int) -> tuple[dict[int, int], dict[int, int]]:
    """How many texts of column `i` have which length, per side; what is longer than SHORT counts as one more."""
    made = lambda df, side: df.where(f"{side}v{i} is not null").selectExpr(
        f"{str(not side).lower()} AS mine", f"least(length({side}v{i}), {SHORT + 1}) AS n")
    rows = made(a, "").unionByName(made(b, "b_")).groupBy("mine", "n").agg(F.count(F.lit(1)).alias("texts")).collect()
    return tuple({r["n"]: r["texts"] for r in rows if r["mine"] == side} for side in (True, False))


def subsequence_count(method: str, mine: dict[int, int], others: dict[int, int], least: float) -> float:
    """How many subsequences texts of these lengths list at most; infinite if one is too long."""
    if not mine or not others:
        return 0.0
    if max(mine) > SHORT or max(others) > SHORT:
        return float("inf")
    return float(sum(n * comb(length, k) for length, n in mine.items() for k in kept_lengths(method, length, list(others), least)))


def _hashes(texts: list[str], kept: list[int]) -> np.ndarray:
    """A number per subsequence of each of these equally long texts, a row per text.

    Equal subsequences have equal numbers; unequal ones that do only meet for nothing.
    """
    length = len(texts[0])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(texts), length).astype(np.uint64)
    codes = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    codes ^= codes >> np.uint64(29)
    codes *= np.uint64(0x94D049BB133111EB)
    codes ^= codes >> np.uint64(32)
    found = []
    for k in kept:
        places = np.array(list(combinations(range(length), k)), dtype=np.int64).reshape(comb(length, k), k)
        sums = np.full((len(texts), len(places)), k, dtype=np.uint64)
        for at in range(k):
            sums *= BASE
            sums += codes[:, places[:, at]]
        found.append(sums)
    return np.concatenate(found, axis=1).view(np.int64)


def subsequences(text: Column, lengths: list[int], others: list[int], method: str, least: float) -> Column:
    """The distinct subsequences, as numbers, by which a text meets similar texts of the other side's lengths."""
    kept = {n: kept_lengths(method, n, others, least) for n in lengths}

    @F.arrow_udf("array<bigint>")
    def made(values: pa.Array) -> pa.Array:
        by_length: dict[int, list[tuple[int, str]]] = {}
        for at, value in enumerate(values.to_pylist()):
            if value is not None and kept.get(len(value)):
                by_length.setdefault(len(value), []).append((at, value))
        sizes, rows = np.zeros(len(values), dtype=np.int64), []
        for length, members in by_length.items():
            step = max(1, AT_ONCE // sum(comb(length, k) for k in kept[length]))
            for start in range(0, len(members), step):
                places, texts = zip(*members[start:start + step])
                sums = np.sort(_hashes(list(texts), kept[length]), axis=1)
                new = np.ones(sums.shape, dtype=bool)
                new[:, 1:] = sums[:, 1:] != sums[:, :-1]
                sizes[list(places)] = new.sum(axis=1)
                rows.append((np.repeat(places, new.sum(axis=1)), sums[new]))
        owners = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, dtype=np.int64)
        numbers = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers[np.argsort(owners, kind="stable")], pa.int64()))

    return made(text)


def _facts(texts: DataFrame) -> DataFrame:
    """Distinct texts with their character pairs, rarest over all texts first, and their characters by group."""
    marked = "concat(char(2), text, char(3))"
    pairs = F.expr(f"transform(sequence(1, length(text) + 1), k -> substring({marked}, k, 2))")
    # The n-th occurrence of a pair within its text.
    counted = texts.select("text", F.explode(pairs).alias("pair")).groupBy("text", "pair").agg(F.count(F.lit(1)).alias("times"))
    tokens = counted.selectExpr("text", "explode(transform(sequence(1, int(times)), k -> concat(pair, string(k)))) AS token")
    held = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("texts"))
    ordered = tokens.join(held, "token").groupBy("text").agg(F.sort_array(F.collect_list(F.struct("texts", "token"))).alias("t"))
    return ordered.select("text", F.col("t.token").alias("tokens"))


def _letters(text: str) -> str:
    """Number of characters of each group."""
    chars = f"filter(split({text}, ''), c -> c <> '')"
    groups = f"transform({chars}, c -> pmod(ascii(c), {GROUPS}))"
    return f"transform(sequence(0, {GROUPS - 1}), g -> size(filter({groups}, c -> c = g)))"


def with_tokens(a: DataFrame, b: DataFrame, i: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with tokens and letters of text column `i`; rarity is counted over the texts of both."""
    texts = a.selectExpr(f"v{i} AS text").unionByName(b.selectExpr(f"b_v{i} AS text")).where("text is not null").distinct()
    facts, _ = materialise(_facts(texts).withColumn("letters", F.expr(_letters("text"))))
    named = [facts.selectExpr(f"text AS {s}v{i}", f"tokens AS {s}tokens{i}", f"letters AS {s}letters{i}") for s in ("", "b_")]
    return tuple(materialise(df.join(f, f"{s}v{i}", "left"))[0] for df, f, s in zip((a, b), named, ("", "b_")))
