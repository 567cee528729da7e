"""Attaching a group-level value to every row without a hot-key task.

A window over the grouping columns, or a plain join on them, sends the largest
group to one task. Here the largest groups - at most ``HEAVY_GROUPS`` rows, a
fixed bound - are broadcast, so their rows never shuffle; only rows of groups
that each hold less than ``1 / HEAVY_GROUPS`` of the table are shuffled. If the
caller knows that all groups together are few, they are broadcast whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.functions.columns import ref

HEAVY_GROUPS = 1024
BROADCAST_ROWS = 100_000


def null_safe(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right)])


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str,
           values: list[str], how: str = "left", group_count: int | None = None) -> DataFrame:
    """Rows of ``rows`` plus ``values`` of their group in ``groups``.

    ``groups`` has one row per combination of ``keys`` (nulls equal each other)
    and ``weight`` tells how many rows a group has. ``how`` is left or inner;
    ``group_count`` is the counted number of groups, if the caller has it.
    """
    marked = groups.select(
        *[ref(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        ref(weight).alias("__w"),
        F.struct(*[ref(v) for v in values]).alias("__v"),
    )
    group_keys = [F.col(f"__k{i}") for i in range(len(keys))]
    on = null_safe([ref(k) for k in keys], group_keys)
    kept = [ref(c) for c in rows.columns]
    if group_count is not None and group_count <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(marked), on, how)
    else:
        heavy = marked.orderBy(F.desc("__w"), *group_keys).limit(HEAVY_GROUPS)
        probed = rows.join(F.broadcast(heavy), on, "left")
        hot = probed.where(F.col("__v").isNotNull()).select(*kept, "__v")
        cold = probed.where(F.col("__v").isNull()).select(*kept).join(marked, on, how).select(*kept, "__v")
        joined = hot.unionByName(cold)
    return joined.select(*kept, *[F.col("__v")[v].alias(v) for v in values])
