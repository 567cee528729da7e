"""Best partners of every target tuple when many columns, text or several graded columns are compared.

The pairs wanted are the ``top`` best of each target tuple. They are looked for in
rounds that allow a growing *loss* (weight times missing similarity): a round finds all
pairs within its loss, and a tuple whose last wanted partner lies within it is finished,
because every pair not found yet scores lower. Most tuples finish while the loss is
small and keys are selective; only the others are looked at more widely.

Within a round, columns compared exactly are decided one after the other, the most
selective first: a pair agrees, or it disagrees and loses the column's weight. A branch
ends when the loss is used up (no pair can follow), or when what is agreed on is
selective enough to be joined on. These *leaves* are disjoint, so each pair is met under
one of them, and they are listed lazily: no set of columns is built that no branch needs.
How far branches go is chosen by cost, from how often values of a column agree.

The loss a leaf leaves over bounds every graded column as well, which adds keys to the
join: numbers and dates share a cell of a grid as wide as the bound, texts share a
subsequence that lacks few of their characters or, where those are too many, one of their
rarest character pairs (:mod:`veilgauge.operators.textkeys`). The exact text ratio is
computed once per distinct pair of texts, and only if the pair could still score enough
with as much similarity as their common characters allow.

Where all columns are compared exactly, they weigh the same and a round's loss is a number
of columns that may differ. They are then dealt into that many blocks and some more: of so
many blocks a pair within the loss agrees on all of at least that surplus. Tuples meet by
every choice of so many blocks, which are few sets of many columns, and travel as short
exact codes of their values, so pairs are told and ranked without the values.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import partial, reduce
from itertools import combinations, count as counting
from math import comb, log

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from veilgauge import settings
from veilgauge.operators import textkeys
from veilgauge.operators.topk import packed
from veilgauge.session import materialise

#: Share of the largest loss that each round allows.
SHARES = [1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0]
#: A round is left out unless it is this much cheaper than the next one.
WORTH = 4.0
#: Rows and pairs below which a round of its own costs more than it saves.
ROUND_COST = 1_000_000
#: Where all columns are compared exactly, cost grows evenly with the loss and finer rounds save the wide ones.
EXACT_SHARES = [*SHARES[:5], 3 / 8, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1.0]
#: With texts, rounds differ in how many exact ratios they need, which the join's cost does not tell.
TEXT_SHARES = [1 / 64, 1 / 32, 1 / 20, 1 / 16, 1 / 4, 1.0]
#: Subsequences per tuple of both sides up to which texts meet by them.
SUBSEQUENCES = 128
#: Keys of a few remaining targets up to which they are broadcast (three integers each).
BROADCAST_KEYS = 1_000_000
SLACK = 1e-9
#: Similarities are rounded to thousandths.
HALF_STEP = 0.0005
#: Pairs that one salt of a leaf is meant to hold.
PAIRS_PER_SALT = 4_000_000
#: Rows of a side under all its leaves beyond which it may not be broadcast. The planner can't tell:
#: it knows the size of a side before its tuples are listed under every leaf.
BROADCAST_ROWS = 100_000
#: Rows under leaves that one task is meant to make: a few small files of tuples would be listed by as many tasks.
LISTED_ROWS = 200_000
#: Pairs that cost as much to look at as a row costs to list, sort and write.
ROW_COST = 32
#: Bits that a packed number holds, so that sums of them stay positive.
BITS = 62
#: Distinct values of a column up to which a shorter code than that is looked for.
CODED = 1024
#: Tuples of each side whose pairs tell how often sets of columns agree; only cost depends on it.
LOOKED_AT = 512
#: Pairs under one key of packed tuples beyond which it is dealt to several tasks.
HOT_PAIRS = 64_000_000
#: Bits of a pair's number that name the auxiliary tuple, and those of them that count its keys.
NAMED, KEYED = 57, 8
#: Leaves beyond which a way of branching is not followed any further; a coarser one always exists.
MOST_LEAVES = 20_000
#: Share of pairs assumed to share a key of their texts; only the choice among equal results depends on it.
TEXT_SHARE = 0.02
QUANTILES = 201


@dataclass(frozen=True)
class Code:
    """Where a column's values lie in the packed numbers, and which part of their hash tells all of them apart.

    Zero and all bits set are left to missing values of the two sides, which equal nothing.
    """

    word: int
    at: int
    bits: int
    shift: int
    seed: int

    @property
    def mask(self) -> int:
        return ((1 << self.bits) - 1) << self.at

    def of(self, value: str, missing: bool) -> str:
        made = f"1 + pmod(shiftright(xxhash64({self.seed}, {value}), {self.shift}), {(1 << self.bits) - 2}L)"
        return f"shiftleft(if({value} is null, {(1 << self.bits) - 1 if missing else 0}L, {made}), {self.at})"


@dataclass
class Statistics:
    """Sizes of both sides, how often two values of an exact column agree, and quantiles of ordered columns.

    Of columns that are packed also their codes, and sets of columns (as bits) that some
    pairs agree on with the share of each.
    """

    target: int
    auxiliary: int
    agree: dict[int, float]
    quantiles: dict[int, tuple[np.ndarray, np.ndarray]]
    codes: dict[int, Code] | None = None
    alike: tuple[np.ndarray, np.ndarray] | None = None

    def within(self, i: int, radius: float) -> float:
        """About which share of pairs differs by at most so much in an ordered column."""
        mine, theirs = self.quantiles[i]
        if not len(mine) or not len(theirs):
            return 0.0
        inside = np.searchsorted(theirs, mine + radius, "right") - np.searchsorted(theirs, mine - radius, "left")
        return max(float(inside.mean()) / len(theirs), 1.0 / max(self.auxiliary, 1))


def _ordered(plan) -> list[int]:
    return [i for i in plan.graded if plan.kinds[i] in ("numeric", "date")]


def _texts(plan) -> list[int]:
    return [i for i in plan.graded if plan.kinds[i] == "text"]


def _line(plan, i: int, value: str) -> str:
    """An ordered column in units of its span, so that similarity is one minus distance."""
    if plan.kinds[i] == "date":
        return f"(datediff({value}, DATE'1970-01-01') / {float(settings.DATE_HORIZON_DAYS)!r}D)"
    return f"({value} / {plan.spans[i]!r}D)"


def measured(a: DataFrame, b: DataFrame, plan, target: int, auxiliary: int):
    """The plan with the numeric spans of the target side, and statistics of both sides.

    One pass over the values of exact columns and one over the ordered ones.
    """
    agree, quantiles, codes = {i: 1.0 for i in plan.exact}, {}, None
    if plan.exact:
        def listed(df: DataFrame, side: str) -> DataFrame:
            pairs = ", ".join(f"'{i}', {side}v{i}" for i in plan.exact)
            return df.selectExpr(f"stack({len(plan.exact)}, {pairs}) AS (i, v)", f"{str(not side).lower()} AS mine").where("v is not null")
        counted = listed(a, "").unionByName(listed(b, "b_")).groupBy("i", "v").agg(
            F.expr("count_if(mine) AS x"), F.expr("count_if(not mine) AS y"))
        if _packable(plan):
            counted, _ = materialise(counted)
            codes = _codes(counted, plan)
        found = {int(r["i"]): r["pairs"] for r in counted.groupBy("i").agg(F.expr("sum(double(x) * y) AS pairs")).collect()}
        agree = {i: found.get(i, 0.0) / max(target, 1) / max(auxiliary, 1) for i in plan.exact}
    if ordered := _ordered(plan):
        def numbers(df: DataFrame, side: str) -> DataFrame:
            made = [f"double({side}v{i})" if plan.kinds[i] == "numeric" else f"double(datediff({side}v{i}, DATE'1970-01-01'))" for i in ordered]
            return df.selectExpr(f"{str(not side).lower()} AS mine", *[f"{m} AS n{i}" for m, i in zip(made, ordered)])
        points = f"array({', '.join(f'{k / (QUANTILES - 1)}D' for k in range(QUANTILES))})"
        both = numbers(a, "").unionByName(numbers(b, "b_"))
        rows = {r["mine"]: r for r in both.groupBy("mine").agg(
            *[F.expr(f"percentile_approx(n{i}, {points}, 10000) AS q{i}") for i in ordered],
            *[F.expr(f"max(n{i}) - min(n{i}) AS s{i}") for i in ordered]).collect()}
        spans = list(plan.spans)
        for i in ordered:
            if plan.kinds[i] == "numeric":
                spans[i] = float((rows[True][f"s{i}"] if True in rows else None) or 1.0)
            unit = spans[i] if plan.kinds[i] == "numeric" else float(settings.DATE_HORIZON_DAYS)
            quantiles[i] = tuple(np.array((rows[side][f"q{i}"] if side in rows else None) or []) / unit for side in (True, False))
        plan = replace(plan, spans=spans)
    return plan, Statistics(target, auxiliary, agree, quantiles, codes)


@dataclass(frozen=True)
class Leaf:
    """A character per column: agreed 1, disagreed 0, key of a graded column k, not looked at -."""

    marks: str
    pairs: float
    salts: int = 1


def leaves_within(plan, stats: Statistics, loss: float, target: int, enough: float) -> list[Leaf] | None:
    """Leaves of one round whose expected pairs are at most `enough` where columns allow it; None if they are too many."""
    order = sorted(plan.exact, key=lambda i: (stats.agree[i], -plan.weights[i]))
    everything = float(target) * stats.auxiliary
    found: list[Leaf] = []

    def keyed(marks: list[str], lost: float, pairs: float) -> Leaf:
        """Add graded columns as keys, the most selective first, until the leaf is small enough."""
        options = []
        for i in plan.graded:
            share = (loss - lost) / plan.weights[i] if plan.weights[i] else 1.0
            if plan.kinds[i] == "text":
                if textkeys.usable(plan.text_method, 1 - share):
                    options.append((TEXT_SHARE, i))
            elif share < 1:
                options.append((stats.within(i, share + HALF_STEP), i))
        for p, i in sorted(options):
            if pairs <= enough:
                break
            if p < 0.5:
                marks[i] = "k"
                pairs *= p
        return Leaf("".join(marks), pairs, 1 + int(pairs // PAIRS_PER_SALT))

    # Depth first without recursion; each entry is decided up to `place`.
    open_ = [(0, 0.0, everything, ["-"] * len(plan.kinds))]
    while open_:
        place, lost, pairs, marks = open_.pop()
        if place == len(order) or pairs <= enough:
            found.append(keyed(marks, lost, pairs))
            if len(found) > MOST_LEAVES:
                return None
            continue
        i = order[place]
        agreed, differ = list(marks), list(marks)
        agreed[i], differ[i] = "1", "0"
        if lost + plan.weights[i] <= loss + SLACK:
            open_.append((place + 1, lost + plan.weights[i], pairs, differ))
        if stats.agree[i] > 0:
            open_.append((place + 1, lost, pairs * stats.agree[i], agreed))
    return found


def _copies(leaves: list[Leaf]) -> float:
    """About how many rows the leaves make of a tuple."""
    return sum(2.0 ** sum(m == "k" for m in x.marks) * x.salts for x in leaves)


def cheapest(plan, stats: Statistics, loss: float, target: int) -> tuple[list[Leaf] | Blocks, float]:
    """The way of branching, or of dealing columns to blocks, with the least rows to join and pairs to look at."""
    if _packable(plan):
        return _cheapest_blocks(plan, stats, loss, target)
    best, least = None, float("inf")
    rows = target + stats.auxiliary
    enough = float(target) * stats.auxiliary
    while True:
        leaves = leaves_within(plan, stats, loss, target, enough)
        if leaves is None:
            break
        copies = _copies(leaves)
        cost = copies * rows + sum(x.pairs for x in leaves)
        if cost < least:
            best, least = leaves, cost
        if enough < 1 or copies * rows > 4 * least:
            break
        enough /= 8
    return best, least


def _marked(leaves: list[Leaf], mark: str) -> list[int]:
    """Columns that some leaf marks so."""
    return [i for i in range(len(leaves[0].marks)) if any(x.marks[i] == mark for x in leaves)]


def _mark(i: int) -> str:
    return f"substring(leaf, {i + 1}, 1)"


def _key(parts: list[str]) -> list[str]:
    """128 bits of a list of values, nulls included, as two integers."""
    marked = ", ".join(f"isnull({p}), {p}" for p in parts)
    return [f"xxhash64('a', {marked}) AS x1", f"xxhash64('b', {marked}) AS x2"]


def _spread(df: DataFrame, plan, leaves: list[Leaf], loss: float, side: str, carry: list[str], listed_texts: bool = False) -> DataFrame:
    """Every tuple under its key of each leaf: ``leaf``, key ``x1, x2`` and `carry`.

    A tuple without a value in a column the leaf keys on can't be met there. `side` begins
    the names of its columns: nothing for the target, ``b_`` for the auxiliary side.
    With `listed_texts` the keys of texts are listed in ``listed{i}``.
    """
    target = not side
    agreed, differing, keyed = (_marked(leaves, m) for m in "10k")
    listed = ", ".join(f"'{x.marks}:{x.salts}'" for x in leaves)
    needed = [f"({_mark(i)} not in ('1', 'k') or {side}v{i} is not null)" for i in [*agreed, *keyed]]
    df = df.withColumn("leaf", F.expr(f"explode(array({listed}))")).where(" and ".join(needed) or "true")
    lost = " + ".join(["0D", *[f"if({_mark(i)} = '0', {plan.weights[i]!r}D, 0D)" for i in differing]])
    parts = ["leaf", *[f"if({_mark(i)} = '1', {side}v{i}, null)" for i in agreed]]
    for i in keyed:
        share = f"greatest(({loss!r}D - ({lost})) / {plan.weights[i]!r}D, 0D)"
        if plan.kinds[i] == "text" and listed_texts:
            made, none = f"listed{i}", "0L"
        elif plan.kinds[i] == "text":
            made, none = textkeys.prefix(f"{side}tokens{i}", f"length({side}v{i})", f"(1D - {share})", plan.text_method), "''"
        else:
            # Cells twice as wide as the bound: a target's reach touches two of them at most.
            radius, at = f"({share} + {HALF_STEP + SLACK!r}D)", _line(plan, i, f"{side}v{i}")
            cell = lambda x: f"bigint(floor({x} / (2 * {radius})))"  # noqa: B023, E731
            made, none = (f"array_distinct(array({cell(f'({at} - {radius})')}, {cell(f'({at} + {radius})')}))" if target
                          else f"array({cell(at)})"), "0L"
        df = df.withColumn(f"key{i}", F.expr(f"explode(if({_mark(i)} = 'k', {made}, array({none})))"))
        parts.append(f"key{i}")
    if any(x.salts > 1 for x in leaves):
        salts = "bigint(substring_index(leaf, ':', -1))"
        df = df.withColumn("salt", F.expr(f"pmod(t1, {salts})" if target else f"explode(sequence(0L, {salts} - 1))"))
        parts.append("salt")
    return df.selectExpr("leaf", *_key(parts), *carry)


def _listed(df: DataFrame, rows: float) -> DataFrame:
    """A side, dealt to as many tasks as its rows under all leaves need."""
    return df.repartition(int(rows / LISTED_ROWS) + 1) if rows > BROADCAST_ROWS else df


def _met(a: DataFrame, b: DataFrame, plan, leaves: list[Leaf], loss: float, sizes: tuple[int, int]) -> DataFrame:
    """Pairs under the leaf each belongs to, with the values of both."""
    values = [f"v{i}" for i in range(len(plan.kinds))] + [f"letters{i}" for i in _texts(plan)]
    copies = _copies(leaves)
    a, b = (_listed(df, n * copies) for df, n in zip((a, b), sizes))
    left = _spread(a, plan, leaves, loss, "", ["t1", "t2", "copies", *values])
    right = _spread(b, plan, leaves, loss, "b_", ["u1", "u2", "keys", *[f"b_{c}" for c in values]]).drop("leaf")
    if min(sizes) * copies > BROADCAST_ROWS:
        right = right.hint("merge")
    meets = [f"case {_mark(i)} when '1' then v{i} = b_v{i} when '0' then not coalesce(v{i} = b_v{i}, false) else true end"
             for i in sorted({*_marked(leaves, "1"), *_marked(leaves, "0")})]
    return left.join(right, ["x1", "x2"]).where(" and ".join(meets) or "true")


def _subsequence_keys(plan, leaves: list[Leaf], loss: float, lengths: dict, sizes: tuple[int, int], target: int) -> tuple[float, float] | None:
    """Keys that both sides list if all texts meet by subsequences; None if those are no keys or too many.

    `lengths` are those of all `target` tuples, of which `sizes` tells how many remain.
    """
    texts = _texts(plan)
    if not texts or any(x.marks[i] != "k" for i in texts for x in leaves):
        return None
    least = {i: 1 - loss / plan.weights[i] for i in texts}
    if not all(textkeys.usable(plan.text_method, s) for s in least.values()):
        return None
    copies = sum(2.0 ** sum(m == "k" and i not in texts for i, m in enumerate(x.marks)) for x in leaves)
    rows = []
    for side, counted in enumerate((target, sizes[1])):
        listed = [textkeys.subsequence_count(plan.text_method, lengths[i][side], lengths[i][1 - side], least[i]) for i in texts]
        rows.append(sizes[side] * copies * float(np.prod([n / max(counted, 1) for n in listed])))
    return tuple(rows) if sum(rows) <= SUBSEQUENCES * sum(sizes) else None


def _met_listed(a: DataFrame, b: DataFrame, plan, leaves: list[Leaf], loss: float, sizes: tuple[int, int], lengths: dict,
                rows: tuple[float, float]) -> DataFrame:
    """Pairs whose texts have a long enough subsequence in common, each once, with the values of both.

    Only keys and tuple numbers travel; the scores are taken from the values.
    """
    # Such keys are selective by themselves.
    leaves = [replace(x, salts=1) for x in leaves]

    def spread(df: DataFrame, side: str, ids: list[str]) -> DataFrame:
        at = int(bool(side))
        df = _listed(df.select(*ids, *[f"{side}v{i}" for i in range(len(plan.kinds))]), rows[at])
        for i in _texts(plan):
            df = df.withColumn(f"listed{i}", textkeys.subsequences(
                F.col(f"{side}v{i}"), list(lengths[i][at]), list(lengths[i][1 - at]), plan.text_method, 1 - loss / plan.weights[i]))
        return _spread(df, plan, leaves, loss, side, ids, listed_texts=True).select("x1", *ids)

    left, right = spread(a, "", ["t1", "t2"]), spread(b, "b_", ["u1", "u2"])
    if rows[0] <= BROADCAST_KEYS:
        left = F.broadcast(left)
    elif min(rows) > BROADCAST_ROWS:
        right = right.hint("merge")
    pairs = left.join(right, "x1").select("t1", "t2", "u1", "u2").distinct()
    return pairs.join(a, ["t1", "t2"]).join(b, ["u1", "u2"])


def _total(plan) -> str:
    return " + ".join(["0D", *[f"{w!r}D * scores[{i}]" for i, w in enumerate(plan.weights)]])


def _combined(plan) -> str:
    return f"round(({_total(plan)}) / {plan.total_weight!r}D, 9)"


def _packable(plan) -> bool:
    """Whether all columns are compared exactly and weigh the same, and a number can name those that agree."""
    return not plan.graded and len(plan.exact) < 63 and len(set(plan.weights)) == 1 and plan.weights[0] > 0


def _codes(counted: DataFrame, plan) -> dict[int, Code]:
    """Short codes of all values (one row per column ``i`` and value ``v``), none shared by two values of a column."""
    for seed in counting():
        whole = f"pmod(xxhash64({seed}, v), {(1 << BITS) - 2}L)"
        rows = counted.groupBy("i").agg(F.count("v").alias("values"), F.expr(f"count(DISTINCT {whole}) AS told")).collect()
        if all(r["values"] == r["told"] for r in rows):
            break
    values = {int(r["i"]): r["values"] for r in rows}
    few = [str(i) for i in values if values[i] <= CODED]
    hashes: dict[int, list[int]] = {}
    for r in counted.where(F.col("i").isin(few)).selectExpr("i", f"xxhash64({seed}, v) AS h").collect() if few else []:
        hashes.setdefault(int(r["i"]), []).append(r["h"])
    found = {}
    for i in plan.exact:
        number, of = values.get(i, 0), np.array(hashes.get(i, []), dtype=np.int64)
        short = ((bits, shift) for bits in range(max(2, (number + 1).bit_length()), BITS) for shift in range(32)
                 if len(np.unique((of >> shift) % ((1 << bits) - 2))) == number)
        found[i] = next(short, (BITS, 0)) if number <= CODED else (BITS, 0)
    placed, room = {}, []
    for i in sorted(plan.exact, key=lambda i: -found[i][0]):
        bits, shift = found[i]
        word = next((k for k, used in enumerate(room) if used + bits <= BITS), len(room))
        if word == len(room):
            room.append(0)
        placed[i] = Code(word, room[word], bits, shift, seed)
        room[word] += bits
    return placed


def _words(codes: dict[int, Code]) -> range:
    return range(1 + max(c.word for c in codes.values()))


def _in_words(df: DataFrame, codes: dict[int, Code], side: str, carry: list[str]) -> DataFrame:
    """Tuples as packed numbers, the columns they miss as bits, and `carry`. `side` begins the names as in `_spread`.

    The numbers keep these names: for each number renamed the planner would double what it infers from their hash.
    """
    missing = " | ".join(f"if({side}v{i} is null, {1 << i}L, 0L)" for i in codes)
    return df.selectExpr(*carry, f"{missing} AS missing", *[
        f"{' | '.join(c.of(f'{side}v{i}', bool(side)) for i, c in codes.items() if c.word == k)} AS {side}w{k}" for k in _words(codes)])


@dataclass(frozen=True)
class Blocks:
    """Columns dealt to blocks, as bits, of which tuples meet by every choice of so many."""

    columns: tuple[int, ...]
    surplus: int

    @property
    def choices(self) -> list[tuple[int, int]]:
        """Blocks and columns of every choice, as bits."""
        return [(sum(1 << k for k in some), sum(self.columns[k] for k in some)) for some in combinations(range(len(self.columns)), self.surplus)]


def _allowed(plan, loss: float) -> int:
    """Columns that may differ within a loss."""
    return min(int((loss + 2 * SLACK) / plan.weights[0]), len(plan.exact))


def _dealt(plan, stats: Statistics, number: int) -> list[int]:
    """Columns in so many blocks, as bits, that agree about equally seldom."""
    blocks, loads = [0] * number, [0.0] * number
    for i in sorted(plan.exact, key=lambda i: stats.agree[i]):
        least = min(range(number), key=lambda k: (loads[k], blocks[k].bit_count()))
        blocks[least] |= 1 << i
        loads[least] -= log(max(stats.agree[i], 1e-9))
    return blocks


def _share(stats: Statistics, blocks: list[int], surplus: int) -> float:
    """About how often a pair meets, as a share of all pairs: once for every choice of blocks it agrees on."""
    ways = [1.0] + [0.0] * surplus
    for block in blocks:
        p = float(np.prod([q for i, q in stats.agree.items() if block >> i & 1]))
        ways = [w + p * (ways[k - 1] if k else 0.0) for k, w in enumerate(ways)]
    if stats.alike is None:
        return ways[surplus]
    sets, shares = stats.alike
    agreeing = sum(((sets & block) == block).astype(np.int64) for block in blocks)
    seen = float((shares * np.array([comb(n, surplus) for n in range(len(blocks) + 1)], dtype=float)[agreeing]).sum())
    return max(seen, ways[surplus])


def _cheapest_blocks(plan, stats: Statistics, loss: float, target: int) -> tuple[Blocks, float]:
    """Blocks by which all pairs within the loss meet, with the least rows to join and pairs to look at, and that cost.

    Pairs found are rows to sort as well, whatever the blocks.
    """
    differ, rows, everything = _allowed(plan, loss), target + stats.auxiliary, float(target) * stats.auxiliary
    # Where all columns may differ, no block has to agree.
    best, least = Blocks((), 0), ROW_COST * rows + everything if differ == len(plan.exact) else float("inf")
    for surplus in range(1, len(plan.exact) - differ + 1):
        choices = comb(differ + surplus, surplus)
        if choices > MOST_LEAVES or ROW_COST * choices * rows >= least:
            break
        blocks = _dealt(plan, stats, differ + surplus)
        cost = ROW_COST * choices * rows + everything * _share(stats, blocks, surplus)
        if cost < least:
            best, least = Blocks(tuple(blocks), surplus), cost
    if stats.alike is None:
        return best, least
    sets, shares = stats.alike
    return best, least + ROW_COST * everything * float(shares[np.bitwise_count(sets) >= len(plan.exact) - differ].sum())


def _looked_at(df: DataFrame, codes: dict[int, Code], side: str, rows: int) -> np.ndarray:
    """Packed numbers of some tuples, picked by their hash."""
    names = [f"{side}w{k}" for k in _words(codes)]
    some = df.where(f"pmod(xxhash64({', '.join(names)}), {max(1, rows // LOOKED_AT)}L) = 0").select(*names).limit(2 * LOOKED_AT)
    return np.array([tuple(r) for r in some.collect()], dtype=np.int64).reshape(-1, len(names))


def _alike(mine: np.ndarray, theirs: np.ndarray, codes: dict[int, Code]) -> tuple[np.ndarray, np.ndarray] | None:
    """Sets of columns that pairs of these tuples agree on, as bits, and the share of each."""
    if not len(mine) or not len(theirs):
        return None
    agreed = np.zeros((len(mine), len(theirs)), dtype=np.int64)
    for i, c in codes.items():
        agreed |= ((mine[:, c.word, None] ^ theirs[None, :, c.word]) & c.mask == 0).astype(np.int64) << i
    sets, times = np.unique(agreed, return_counts=True)
    return sets, times / agreed.size


def _masked(codes: dict[int, Code], columns: int) -> list[int]:
    """Bits of the packed numbers that some columns take."""
    return [sum(c.mask for i, c in codes.items() if c.word == k and columns >> i & 1) for k in _words(codes)]


def _hot(spark, mine: np.ndarray, theirs: np.ndarray, blocks: Blocks, codes: dict[int, Code], sizes: tuple[int, int]) -> tuple[list[int], int]:
    """Keys that make about more than `HOT_PAIRS` pairs, going by some tuples of both sides, and to how many tasks to deal them."""
    found, most = [], 0.0
    for chosen, columns in blocks.choices if len(mine) and len(theirs) else []:
        keys, times = zip(*(np.unique(some & np.array(_masked(codes, columns)), axis=0, return_counts=True) for some in (mine, theirs)))
        held = dict(zip(map(tuple, keys[1].tolist()), (times[1] * (sizes[1] / len(theirs))).tolist()))
        for key, n in zip(map(tuple, keys[0].tolist()), (times[0] * (sizes[0] / len(mine))).tolist()):
            if (pairs := n * held.get(key, 0.0)) > HOT_PAIRS:
                found.append((chosen, *key))
                most = max(most, pairs)
    if not found:
        return [], 1
    names = ["k", *[f"w{k}" for k in _words(codes)]]
    made = spark.createDataFrame(found, ", ".join(f"{n} long" for n in names)).selectExpr(f"xxhash64({', '.join(names)}) AS x")
    return [r["x"] for r in made.collect()], 1 + int(most // HOT_PAIRS)


def _met_packed(a: DataFrame, b: DataFrame, blocks: Blocks, codes: dict[int, Code], differ: int, sizes: tuple[int, int],
                hot: tuple[list[int], int]) -> DataFrame:
    """Pairs that differ in few enough columns, each once: ``t``, and ``p`` that grows with what differs and then with ``u``."""
    words, choices, (keys, parts) = _words(codes), blocks.choices, hot
    sets = ", ".join(f"named_struct('k', {chosen}L, 'c', {columns}L, " + ", ".join(
        f"'m{k}', {m}L" for k, m in enumerate(_masked(codes, columns))) + ")" for chosen, columns in choices)

    def spread(df: DataFrame, side: str, ids: list[str], rows: int) -> DataFrame:
        df = _listed(df, rows * len(choices)).withColumn("set", F.expr(f"explode(array({sets}))")).where("set.c & missing = 0")
        df = df.selectExpr(f"xxhash64(set.k, {', '.join(f'{side}w{k} & set.m{k}' for k in words)}) AS x", *ids, *[f"{side}w{k}" for k in words])
        if keys:
            df = df.withColumn("parts", F.when(F.col("x").isin(keys), F.lit(parts)).otherwise(1))
            df = df.withColumn("part", F.expr("explode(sequence(0, parts - 1))" if side else "int(pmod(t, parts))")).drop("parts")
        return df

    left, right = spread(a, "", ["t", "set.k AS chosen"], sizes[0]), spread(b, "b_", ["u"], sizes[1])
    if sizes[0] * len(choices) <= BROADCAST_ROWS:
        left = F.broadcast(left)
    elif sizes[1] * len(choices) * parts <= BROADCAST_ROWS:
        right = F.broadcast(right)
    else:
        right = right.hint("merge")
    high = [sum(1 << c.at + c.bits - 1 for c in codes.values() if c.word == k) for k in words]
    low = [sum((1 << c.bits - 1) - 1 << c.at for c in codes.values() if c.word == k) for k in words]
    differing = " + ".join(f"bit_count(((((w{k} ^ b_w{k}) & {low[k]}L) + {low[k]}L) | (w{k} ^ b_w{k})) & {high[k]}L)" for k in words)
    pairs = left.join(right, ["x", "part"] if keys else ["x"]).where(f"({differing}) <= {differ}")
    if len(choices) > 1:
        # A pair that agrees on more blocks than are chosen is kept under the last of them.
        same = [" and ".join(f"((w{k} ^ b_w{k}) & {m}L) = 0" for k, m in enumerate(_masked(codes, columns)) if m) for columns in blocks.columns]
        agreed = " | ".join(f"if({s}, {1 << k}L, 0L)" for k, s in enumerate(same))
        pairs = pairs.where(f"(({agreed}) ^ chosen) < (chosen & -chosen)")
    return pairs.selectExpr("t", f"shiftleft(bigint({differing}), {NAMED}) | u AS p")


def _scored(found: DataFrame, targets: DataFrame, partners: DataFrame, plan, codes: dict[int, Code], sizes: tuple[int, int]) -> DataFrame:
    """Partners of every target tuple with keys and scores: (t1, t2, copies, partners)."""
    kept = lambda df, n: df.hint("merge") if n > BROADCAST_ROWS else df
    pairs = found.selectExpr("t", "explode(found) AS p").selectExpr("t", f"p & {(1 << NAMED) - 1}L AS u")
    pairs = pairs.join(kept(partners.drop("missing"), sizes[1]), "u")
    pairs = pairs.join(kept(targets.drop("missing"), sizes[0]), "t")
    scores = ", ".join(f"if(((w{c.word} ^ b_w{c.word}) & {c.mask}L) = 0, 1D, 0D)" for _, c in sorted(codes.items()))
    pairs = pairs.selectExpr("t", "t1", "t2", "copies", "keys", f"array({scores}) AS scores")
    pairs = pairs.withColumn("combined", F.expr(_combined(plan))).where(f"combined >= {plan.threshold!r}D")
    item = F.expr("transform(keys, k -> struct(-combined AS minus, k AS kb, scores))")
    best = pairs.groupBy("t", "t1", "t2", "copies").agg(F.collect_list(item).alias("partners"))
    return best.selectExpr("t1", "t2", "copies", f"slice(sort_array(flatten(partners)), 1, {plan.top}) AS partners")


def _best_packed(a: DataFrame, b: DataFrame, plan, stats: Statistics) -> tuple[DataFrame, int, dict]:
    """The result of `best_partners` where tuples travel as packed numbers."""
    codes, told, finished = stats.codes, {"rounds": [], "pairs": 0}, []
    targets, _ = materialise(_in_words(a, codes, "", ["t1", "t2", "copies", "monotonically_increasing_id() AS t"]))
    # Ranges of the smallest key are numbered in order, so ties go to it. A number ends with how many keys there are.
    ordered = _in_words(b.where("size(keys) > 0"), codes, "b_", ["keys"]).orderBy(F.expr("get(keys, 0)"), *[f"b_w{k}" for k in _words(codes)])
    largest = Observation()
    number = F.expr(f"shiftleft(monotonically_increasing_id(), {KEYED}) | least(size(keys), {(1 << KEYED) - 1})")
    partners, auxiliary = materialise(ordered.withColumn("u", number).observe(largest, F.max("u").alias("u")))
    if (largest.get["u"] or 0) >> NAMED:
        raise ValueError(f"tuples in more than {1 << NAMED - KEYED - 33} partitions can't be numbered")
    remaining, count = targets.drop("t1", "t2", "copies"), stats.target
    mine, theirs = _looked_at(targets, codes, "", count), _looked_at(partners, codes, "b_", auxiliary)
    stats = replace(stats, auxiliary=auxiliary, alike=_alike(mine, theirs, codes))
    losses = schedule(plan, stats)
    for loss in losses:
        last, sizes = loss == losses[-1], (count, auxiliary)
        blocks, _ = cheapest(plan, stats, loss, count)
        seen, ended = Observation(), Observation()
        pairs = _met_packed(remaining, partners, blocks, codes, _allowed(plan, loss), sizes, _hot(a.sparkSession, mine, theirs, blocks, codes, sizes))
        pairs = pairs.observe(seen, F.count(F.lit(1)).alias("pairs"))
        enough = f"aggregate(found, 0L, (n, p) -> n + (p & {(1 << KEYED) - 1}L)) >= {plan.top}"
        best = packed(pairs, ["t"], [F.asc("p")], plan.top, F.col("p"), "found").select("t", "found").withColumn(
            "done", F.expr(f"{str(last).lower()} or {enough}"))
        best, _ = materialise(best.observe(ended, F.expr("count_if(done) AS done")))
        told["rounds"].append({"loss": loss, "leaves": len(blocks.choices), "tuples": count, "pairs": seen.get["pairs"]})
        told["pairs"] += seen.get["pairs"]
        finished.append(best.where("done").select("t", "found"))
        if last or ended.get["done"] == count:
            break
        remaining, count = materialise(remaining.join(finished[-1].select("t"), "t", "left_anti"))
    scored, tuples = materialise(_scored(reduce(DataFrame.unionByName, finished), targets, partners, plan, codes, (stats.target, auxiliary)))
    return scored, tuples, told


def _round(a: DataFrame, b: DataFrame, plan, leaves: list[Leaf], loss: float, last: bool, sizes: tuple[int, int],
           trace: dict, met) -> tuple[DataFrame, dict]:
    """``top`` best partners within the loss of every tuple that has any: (t1, t2, copies, partners, done), and counts of them.

    `sizes`: tuples of both sides. `met` gives the pairs to score.
    """
    width = range(len(plan.kinds))
    texts = _texts(plan)
    sims = {i: F.expr(f"if(v{i} = b_v{i}, 1D, 0D)") for i in plan.exact}
    sims |= {i: plan.graded_similarity(i, F.col(f"v{i}"), F.col(f"b_v{i}")) for i in _ordered(plan)}
    if met is _met:
        sims |= {i: F.expr(textkeys.at_most(plan.text_method, f"v{i}", f"b_v{i}", f"letters{i}", f"b_letters{i}")) for i in texts}
    else:
        sims |= {i: F.expr(f"if(v{i} is null or b_v{i} is null, 0D, 1D)") for i in texts}
    # One array: with a column per similarity, filters on their sum multiply in the optimizer.
    total = _total(plan)
    enough = f"{total} >= {plan.total_weight - loss - SLACK!r}D"
    pairs = met(a, b, plan, leaves, loss, sizes).select(
        "t1", "t2", "copies", "u1", "u2", "keys", F.array(*[sims[i] for i in width]).alias("scores"), *[c for i in texts for c in (f"v{i}", f"b_v{i}")])
    pairs = pairs.where(enough)
    # A pair can be met under several character pairs of its texts.
    if met is _met and any(x.marks[i] == "k" for i in texts for x in leaves):
        pairs = pairs.dropDuplicates(["t1", "t2", "u1", "u2"])
    seen, ended = Observation(), Observation()
    pairs = pairs.observe(seen, F.count(F.lit(1)).alias("pairs"))
    if texts:
        pairs, _ = materialise(pairs)
        for i in texts:
            both = [f"v{i}", f"b_v{i}"]
            exact = pairs.select(*both).where(f"v{i} is not null and b_v{i} is not null").distinct().withColumn(
                "ratio", plan.graded_similarity(i, F.col(f"v{i}"), F.col(f"b_v{i}")))
            exact, trace[f"ratios {plan.columns[i]}"] = materialise(exact)
            known = ", ".join("coalesce(ratio, 0D)" if j == i else f"scores[{j}]" for j in width)
            pairs = pairs.join(exact, both, "left").withColumn("scores", F.expr(f"array({known})")).drop("ratio", *both)
        pairs = pairs.where(enough)
    pairs = pairs.selectExpr("t1", "t2", "copies", "keys", "scores", f"{_combined(plan)} AS combined").where(f"combined >= {plan.threshold!r}D")
    item = F.expr("transform(keys, k -> struct(-combined AS minus, k AS kb, scores))")
    best = packed(pairs, ["t1", "t2"], [F.desc("combined"), F.expr("keys[0]")], plan.top, item, "partners")
    within = (plan.total_weight - loss) / plan.total_weight + 2 * SLACK
    best = best.selectExpr("t1", "t2", "copies", f"slice(sort_array(flatten(partners)), 1, {plan.top}) AS partners").withColumn(
        "done", F.expr(f"{str(last).lower()} or size(partners) = {plan.top} and -element_at(partners, -1).minus >= {within!r}D"))
    best, _ = materialise(best.observe(ended, F.expr("count_if(done) AS done"), F.count(F.lit(1)).alias("all")))
    trace["pairs"] = seen.get["pairs"]
    return best, ended.get


def schedule(plan, stats: Statistics) -> list[float]:
    """Losses of the rounds: the last one is what the threshold allows."""
    largest = max(0.0, (1 - plan.threshold) * plan.total_weight) + SLACK
    if _texts(plan) and ROUND_COST < float(stats.target) * stats.auxiliary:
        return [share * largest for share in TEXT_SHARES]
    if _packable(plan):
        steps = [differ * plan.weights[0] + SLACK for differ in range(_allowed(plan, largest) + 1)]
    else:
        steps = [share * largest for share in (SHARES if plan.graded else EXACT_SHARES)]
    costs = [(loss, cheapest(plan, stats, loss, stats.target)[1]) for loss in steps]
    kept, last = [costs[-1][0]], costs[-1][1]
    for loss, cost in reversed(costs[:-1]):
        if last >= ROUND_COST and cost * WORTH <= last:
            kept.insert(0, loss)
            last = cost
    return kept


def expected(plan, stats: Statistics) -> float:
    """Rows and pairs that the first round is expected to touch."""
    return cheapest(plan, stats, schedule(plan, stats)[0], stats.target)[1]


def _ranked(best: DataFrame) -> DataFrame:
    ranked = "transform(partners, (p, k) -> struct(k + 1 AS rank, p.kb AS kb, -p.minus AS combined, p.scores AS scores)) AS found"
    return best.selectExpr("t1", "t2", "copies", ranked)


def best_partners(a: DataFrame, b: DataFrame, plan, stats: Statistics) -> tuple[DataFrame | None, int, dict]:
    """``top`` best partners of every target tuple that has any: (t1, t2, copies, found), their number, and what was done.

    ``found`` holds rank, kb, combined and scores. Told are all pairs scored, and per
    round the loss allowed, leaves, tuples, pairs and exact text ratios.
    """
    if _packable(plan):
        partners, tuples, told = _best_packed(a, b, plan, stats)
        return _ranked(partners), tuples, told
    lengths = {i: textkeys.lengths_of(a, b, i) for i in _texts(plan)}
    finished, remaining, count, tuples = [], a, stats.target, 0
    with_tokens = not lengths
    told = {"rounds": [], "pairs": 0}
    losses = schedule(plan, stats)
    for loss in losses:
        last = loss == losses[-1]
        leaves, _ = cheapest(plan, stats, loss, count)
        step = {"loss": loss, "leaves": len(leaves), "tuples": count, "pairs": 0}
        told["rounds"].append(step)
        if not leaves:
            continue
        sizes, met = (count, stats.auxiliary), _met
        if listed := _subsequence_keys(plan, leaves, loss, lengths, sizes, stats.target):
            met = partial(_met_listed, lengths=lengths, rows=listed)
        elif not with_tokens:
            for i in lengths:
                remaining, b = textkeys.with_tokens(remaining, b, i)
            with_tokens = True
        best, ended = _round(remaining, b, plan, leaves, loss, last, sizes, step, met)
        finished.append(best.where("done"))
        tuples += ended["done"]
        told["pairs"] += step["pairs"]
        if last or ended["done"] == count:
            break
        remaining, count = materialise(remaining.join(best.where("done").select("t1", "t2"), ["t1", "t2"], "left_anti"))
    if not finished:
        return None, 0, told
    return _ranked(reduce(DataFrame.unionByName, finished)), tuples, told
