"""Best partners where one ordered column decides among very many equal ones.

With a single number or date beside exact columns, and many tuples alike in the others,
pairs under any key are as many as values times values. This plan never lists them:

1. A pair at the threshold agrees exactly on a heavy enough set of columns, its
   *signature*. Per signature both sides shrink to (signature values, ordered value),
   the auxiliary side with its ``top`` smallest keys. A pair is later used only under the
   signature that equals its exact agreement; a partner missing from a block's best
   has ``top`` others that score at least as well, so nothing is lost.
2. Within a block, similarity depends on the distance alone and is rounded to thousandths
   of the span. Cells are as wide as such a step; counts per cell tell how many cells away
   a value has to look until ``top`` partners are held.
3. In a cell with few values each is compared. In a crowded one, every value is at one of
   two similarities, cut at a place that depends on the target's value. The cell is
   halved again and again; a part keeps its ``top`` smallest keys. A target takes the
   parts that lie wholly on one side of its cut, one or two per halving, and compares
   one by one only what lies within a billionth of a step from the cut.

So a target looks at cells times halvings, however many values a cell holds.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgauge import settings
from veilgauge.functions import similarity
from veilgauge.operators.skew import attach
from veilgauge.operators.topk import packed
from veilgauge.session import materialise

SLACK = 1e-9
#: Similarities are rounded to so many steps.
STEPS = 1000
NO_CELL = -(1 << 60)
#: Cells begin at this share of a step, so that values and cuts on round numbers don't fall on their edges.
ORIGIN = 0.3819660112501051
HALVINGS = 30
#: Values of a cell from which on it is halved.
CROWD = 8
#: Kinds of lookups beside the halvings 0 to HALVINGS: every value of a cell, every value of a smallest part.
WHOLE, SMALLEST = -1, HALVINGS + 1
MOST_EXACT = 10


def applies(plan) -> bool:
    """One ordered column, and few enough exact columns to list their heavy sets."""
    return len(plan.graded) == 1 and plan.kinds[plan.graded[0]] in ("numeric", "date") and len(plan.exact) <= MOST_EXACT


def signatures(plan) -> dict[int, float]:
    """Bit masks over the exact columns heavy enough to reach the threshold, with their weight."""
    needed = plan.threshold * plan.total_weight - sum(plan.weights[i] for i in plan.graded)
    bits = range(len(plan.exact))
    weight = lambda chosen: sum(plan.weights[plan.exact[j]] for j in chosen)
    sets = [chosen for size in range(len(plan.exact) + 1) for chosen in combinations(bits, size)]
    return {sum(1 << j for j in s): weight(s) for s in sets if weight(s) >= needed - SLACK}


def _by_signature(tuples: DataFrame, plan, masks: list[int], fingerprint, carry: list[str]) -> DataFrame:
    """Each tuple once per signature: ``sid``, its block key ``x1, x2``, and `carry`.

    A tuple with a null inside the signature cannot agree there and is left out.
    """
    sid = F.col("sid")
    spread = tuples.withColumn("sid", F.explode(F.array(*[F.lit(s) for s in masks])))
    inside = [sid.bitwiseAND(F.lit(1 << j)) != 0 for j in range(len(plan.exact))]
    usable = reduce(lambda a, b: a & b, [~m | F.col(f"v{i}").isNotNull() for m, i in zip(inside, plan.exact)], F.lit(True))
    masked = [F.when(m, F.col(f"v{i}")) for m, i in zip(inside, plan.exact)]
    return spread.where(usable).select("sid", *fingerprint("x", [sid, *masked]), *carry)


def _steps(plan, value: Column, low: float) -> Column:
    """Place of an ordered value in steps of one thousandth of similarity above `low`."""
    i = plan.graded[0]
    if plan.kinds[i] == "date":
        scaled = F.datediff(value, F.lit("1970-01-01").cast("date")) / F.lit(float(settings.DATE_HORIZON_DAYS))
    else:
        scaled = value / F.lit(plan.spans[i])
    return scaled * F.lit(float(STEPS)) - F.lit(low) + F.lit(ORIGIN)


def _part(place: Column) -> Column:
    """Number of the smallest part of its cell that a place falls into."""
    return F.floor((place - F.floor(place)) * F.lit(float(1 << HALVINGS))).cast("bigint")


def _lookups() -> Column:
    """What a target's value has to look up in a cell: (halving, part) pairs; see the module's third point."""
    return F.expr(f"""
      case when not crowded then array(struct({WHOLE} AS level, 0L AS node))
           when apart > {STEPS} then array(struct(0 AS level, 0L AS node))
           when cut = 0 or cut = {(1 << HALVINGS) - 1} then array(struct({WHOLE} AS level, 0L AS node))
           else concat(
             transform(filter(sequence(1, {HALVINGS}), j -> shiftright(cut - 1, {HALVINGS} - j) % 2 = 1),
                       j -> struct(j AS level, shiftright(cut - 1, {HALVINGS} - j) - 1 AS node)),
             transform(filter(sequence(1, {HALVINGS}), j -> shiftright(cut + 1, {HALVINGS} - j) % 2 = 0),
                       j -> struct(j AS level, shiftright(cut + 1, {HALVINGS} - j) + 1 AS node)),
             transform(array(cut - 1, cut, cut + 1), p -> struct({SMALLEST} AS level, p AS node))) end""")


def _near_pairs(a_groups: DataFrame, b_side: DataFrame, block: list[str], plan) -> DataFrame:
    """Pairs of a target's value and an auxiliary value that hold every best partner.

    Values ``o`` cells apart differ by more than ``o - 1`` and less than ``o + 1`` steps.
    Once the cells up to ``o`` hold ``top`` partners, anything beyond ``o + 2`` scores
    strictly lower, so leaving it out is exact (``o + 3`` leaves room for
    floating-point error at a cell's edge). Nulls, and everything a full span away, have
    similarity 0 and are paired if a cell has to look that far.
    """
    value = f"v{plan.graded[0]}"
    far = STEPS + 1
    low = a_groups.agg(F.min(_steps(plan, F.col(value), 0.0))).first()[0]
    low = 0.0 if low is None else low - ORIGIN
    place_a, place_b = _steps(plan, F.col(value), low), _steps(plan, F.col(f"b_{value}"), low)
    ends = a_groups.agg(F.max(F.floor(place_a))).first()[0] or 0
    edges = (-far - 1, ends + far + 1)
    a_cells = a_groups.withColumn("cell_a", F.coalesce(F.floor(place_a).cast("bigint"), F.lit(NO_CELL))).withColumn(
        "cut", _part(place_a + F.lit(0.5)))
    b_cells, _ = materialise(b_side.withColumn("cell_b", F.coalesce(
        F.greatest(F.lit(edges[0]), F.least(F.lit(edges[1]), F.floor(place_b).cast("bigint"))), F.lit(NO_CELL))).withColumn(
        "part", F.coalesce(_part(place_b), F.lit(0).cast("bigint"))))
    # Beyond the edges everything has similarity 0, so only the smallest keys count.
    outside = F.col("cell_b").isin(NO_CELL, *edges)
    entry = F.struct(F.col(f"b_{value}").alias("b"), "keys")
    key = [*block, "cell_b"]

    held = b_cells.groupBy(*key).agg(F.sum(F.size("keys")).alias("held"), F.count(F.lit(1)).alias("n")).withColumn(
        "crowded", (F.col("n") > CROWD) & ~outside)
    apart = F.when((F.col("cell_a") == NO_CELL) | (F.col("cell_b") == NO_CELL), F.lit(far)).otherwise(
        F.least(F.abs(F.col("cell_a") - F.col("cell_b")), F.lit(far)))
    # Cells, not values: a block has a few thousand at most on either side.
    cells = a_cells.select(*block, "cell_a").distinct().join(held, block).withColumn("apart", apart)
    nearest = Window.partitionBy(*block, "cell_a")
    within = F.sum("held").over(nearest.orderBy("apart").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    reach = F.min(F.when(F.col("within") >= plan.top, F.col("apart"))).over(nearest)
    useful = (cells.withColumn("within", within).withColumn("reach", reach)
              .where(F.col("reach").isNull() | (F.col("reach") >= STEPS - 2) | (F.col("apart") <= F.col("reach") + 3))
              .select(*block, "cell_a", "cell_b", "apart", "crowded"))

    crowded = b_cells.join(held.where("crowded").select(*key), key)
    halved = crowded.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(HALVINGS)))).withColumn(
        "node", F.expr(f"shiftright(part, {HALVINGS} - level)"))
    parts = packed(halved, [*key, "level", "node"], [F.col("keys")[0]["kb"]], plan.top, entry, "entries")
    few = packed(b_cells.where(outside), key, [F.col("keys")[0]["kb"]], plan.top, entry, "entries")
    every = lambda df, level, node: df.select(
        *key, F.lit(level).alias("level"), node.cast("bigint").alias("node"), F.array(entry).alias("entries"))
    table = (parts.select(*key, "level", "node", "entries")
             .unionByName(few.select(*key, F.lit(WHOLE).alias("level"), F.lit(0).cast("bigint").alias("node"), "entries"))
             .unionByName(every(b_cells.where(~outside), WHOLE, F.lit(0)))
             .unionByName(every(crowded, SMALLEST, F.col("part"))))
    looking = a_cells.join(useful, [*block, "cell_a"]).withColumn("at", F.explode(_lookups())).select(
        *[c for c in a_groups.columns], "cell_b", "at.level", "at.node")
    found = looking.join(table, [*key, "level", "node"]).withColumn("entry", F.explode("entries"))
    return found.select(*a_groups.columns, F.col("entry.b").alias(f"b_{value}"), F.col("entry.keys").alias("keys"))


def best_partners(a_tuples: DataFrame, b_tuples: DataFrame, plan, fingerprint) -> tuple[DataFrame, int, dict]:
    """``top`` best partners of every target tuple that has any: (t1, t2, copies, found), their number, and what was done."""
    masks = signatures(plan)
    values = [f"v{i}" for i in range(len(plan.kinds))]
    (i,) = plan.graded
    value, block = f"v{i}", ["sid", "x1", "x2"]
    b_rows = b_tuples.select(F.explode("keys").alias("kb"), *[F.col(f"b_{v}").alias(v) for v in values])
    a_groups, groups = materialise(_by_signature(a_tuples, plan, list(masks), fingerprint, [value]).groupBy(*block, value).agg(
        F.count(F.lit(1)).alias("tuples")))
    b_side = packed(_by_signature(b_rows, plan, list(masks), fingerprint, [*values, "kb"]), [*block, value], [F.col("kb")], plan.top,
                    F.struct("kb", *[f"v{j}" for j in plan.exact]), "keys").select(*block, F.col(value).alias(f"b_{value}"), "keys")
    pairs, compared = materialise(_near_pairs(a_groups, b_side, block, plan))
    weight = F.create_map(*[F.lit(x) for pair in masks.items() for x in pair])[F.col("sid")]
    scored = pairs.withColumn("s", plan.graded_similarity(i, F.col(value), F.col(f"b_{value}"))).withColumn(
        "graded_score", F.round(F.lit(plan.weights[i]) * F.col("s"), 9))
    scored = scored.where(weight + F.col("graded_score") >= F.lit(plan.threshold * plan.total_weight - SLACK))
    # The best keys are among the best (value, smallest key) partners.
    partner = F.transform("keys", lambda k: F.struct(
        (-F.col("graded_score")).alias("minus"), k["kb"].alias("kb"), *[k[f"v{j}"].alias(f"b_v{j}") for j in plan.exact], F.col("s").alias("s")))
    near = packed(scored, [*block, value], [F.desc("graded_score"), F.col("keys")[0]["kb"]], plan.top, partner, "partners")
    per_group, groups = materialise(near.select(*block, value, "tuples", F.slice(
        F.sort_array(F.flatten("partners")), 1, plan.top).alias("partners")))
    spread = _by_signature(a_tuples, plan, list(masks), fingerprint, ["t1", "t2", *values, "copies"])
    offered = attach(spread, per_group, [*block, value], "tuples", ["partners"], "inner", groups)
    chosen = offered.select("sid", "t1", "t2", *values, "copies", F.explode("partners").alias("p"))
    agreement = sum((F.when(F.col(f"v{j}") == F.col("p")[f"b_v{j}"], 1 << k).otherwise(0) for k, j in enumerate(plan.exact)), F.lit(0))
    scores = [F.col("p.s") if j == i else similarity.exact_similarity(F.col(f"v{j}"), F.col("p")[f"b_v{j}"]) for j in range(len(values))]
    combined = sum((F.lit(w) * s for w, s in zip(plan.weights, scores)), F.lit(0.0)) / F.lit(plan.total_weight)
    kept = (chosen.where(agreement == F.col("sid")).withColumn("combined", F.round(combined, 9))
            .where(F.col("combined") >= F.lit(plan.threshold))
            .select("t1", "t2", "copies", F.col("p.kb").alias("kb"), "combined", F.array(*scores).alias("scores")))
    per_tuple, tuples = materialise(packed(kept, ["t1", "t2"], [F.desc("combined"), F.asc("kb")], plan.top,
                                           F.struct(F.col("__rank").alias("rank"), "kb", "combined", "scores"), "found").select(
        "t1", "t2", "copies", "found"))
    return per_tuple, tuples, {"pairs": compared, "groups": groups}
