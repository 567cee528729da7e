"""Record linkage of a table against an auxiliary table, over all rows.

A pair's score is the weighted mean of its attribute similarities. Both tables first
shrink to distinct attribute tuples, the auxiliary side with its ``top`` smallest keys
each, as they tie on score. The best partners of a tuple are then found without a cross
join and without a cap:

* usually in rounds of growing loss (:mod:`veilgauge.operators.rounds`), which join on
  the columns that have to agree, on cells of numbers and dates and on character pairs of
  texts, and look further only for tuples whose best partners are not certain yet;
* or, where one number or date has to decide among very many tuples alike in all else,
  by counting in cells and halving crowded ones (:mod:`veilgauge.operators.nearest`).

Both give the result of comparing all pairs; expected cost chooses between them. What a
tuple found is handed to all its rows (see :mod:`veilgauge.operators.skew`).

Scores are compared at nine decimals, which absorbs floating-point noise in
the weighted sum; ties go to the smaller auxiliary key.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgauge import settings
from veilgauge.functions import dates, similarity
from veilgauge.functions.columns import (as_text, is_code_like, is_numeric, is_temporal, is_text, nan_to_null,
                                         ref, shared_columns)
from veilgauge.functions.ladders import linkage_level
from veilgauge.functions.text import fold
from veilgauge.operators import nearest, rounds
from veilgauge.operators.quantiles import as_number
from veilgauge.operators.skew import attach
from veilgauge.operators.topk import packed
from veilgauge.session import materialise

log = logging.getLogger("veilgauge.linkage")

#: Pairs to look at per row from which on a single ordered column is searched by halving cells.
CROWDED = 100


def linkage_kinds(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """How each shared column is compared; decided on the target table alone.

    Only text columns need a look at the data: share of dates, distinct values.
    """
    fields = df.schema
    texts = [c for c in columns if is_text(fields[c].dataType) and not is_code_like(c)]
    facts = {}
    if texts:
        narrow = df.select(*[ref(c).alias(str(i)) for i, c in enumerate(texts)])
        values = (narrow.unpivot([], [ref(c) for c in narrow.columns], "i", "v")
                  .groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")))
        parsed = dates.parse_mixed(F.col("v")).isNotNull()
        facts = {texts[int(r["i"])]: r for r in values.groupBy("i").agg(
            F.sum("n").alias("row_count"),
            F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("missing_count"),
            F.sum(F.when(parsed, F.col("n")).otherwise(0)).alias("parsed_rows"),
            F.count("v").alias("unique_count")).collect()}
    return {c: _kind(c, is_numeric(fields[c].dataType), is_temporal(fields[c].dataType), facts.get(c))
            for c in columns}


def kinds_from(stats: DataFrame, columns: list[str]) -> dict[str, str]:
    """The same decision from column statistics that are already there (one row per column)."""
    rows = {r["column"]: r for r in stats.collect()}
    return {c: _kind(c, rows[c]["numeric"], rows[c]["temporal"], rows[c] if rows[c]["textual"] else None)
            for c in columns if c in rows}


def _kind(name: str, numeric: bool, temporal: bool, text_facts) -> str:
    if is_code_like(name):
        return "categorical"
    if numeric or temporal:
        return "numeric" if numeric else "date"
    if text_facts is None:
        return "categorical"
    present = text_facts["row_count"] - text_facts["missing_count"]
    if present and text_facts["parsed_rows"] > 0.7 * present:
        return "date"
    few = text_facts["unique_count"] <= max(20, 0.2 * text_facts["row_count"])
    return "categorical" if few else "text"


@dataclass(frozen=True)
class Comparison:
    """What is compared and how: columns in target order, kinds, weights and numeric spans."""

    columns: list[str]
    kinds: list[str]
    weights: list[float]
    spans: list[float]
    threshold: float
    top: int
    text_method: str

    @property
    def total_weight(self) -> float:
        return sum(self.weights)

    @property
    def exact(self) -> list[int]:
        return [i for i, k in enumerate(self.kinds) if k == "categorical"]

    @property
    def graded(self) -> list[int]:
        return [i for i, k in enumerate(self.kinds) if k != "categorical"]

    def typed(self, df: DataFrame, i: int) -> Column:
        """Column ``i`` of either table in the form its kind compares."""
        name, kind = self.columns[i], self.kinds[i]
        dtype = df.schema[name].dataType
        if kind == "categorical":
            return as_text(name, dtype)
        if kind == "numeric":
            return as_number(df, name)
        if kind == "date":
            return F.to_date(ref(name)) if is_temporal(dtype) else F.to_date(dates.parse_mixed(as_text(name, dtype)))
        return fold(as_text(name, dtype))

    def graded_similarity(self, i: int, a: Column, b: Column) -> Column:
        kind = self.kinds[i]
        if kind == "numeric":
            raw = similarity.numeric_similarity(a, b, self.spans[i])
        elif kind == "date":
            raw = similarity.date_similarity(a, b)
        else:
            raw = similarity.TEXT_METHODS[self.text_method](a, b)
        return F.round(raw, 3)


def _weights_by_kind(weights: dict[str, float]) -> dict[str, float]:
    """Weights by kind or by the published weight name; other names are refused."""
    kind_of = {name: kind for kind, name in settings.WEIGHT_KEYS.items()} | {kind: kind for kind in settings.WEIGHT_KEYS}
    if unknown := set(weights) - set(kind_of):
        raise ValueError(f"unknown weights: {', '.join(sorted(unknown))}")
    return {kind_of[name]: weight for name, weight in weights.items()}


def compare_plan(df_a: DataFrame, df_b: DataFrame, *, exclude: list[str], weights=None, threshold=None,
                 top: int = settings.LINKAGE_TOP, text_method: str = "ratcliff",
                 columns: list[str] | None = None, kinds: dict[str, str] | None = None) -> Comparison:
    shared = [c for c in (columns or shared_columns(df_a, df_b)) if c not in exclude]
    kinds = kinds or {}
    kinds = {**linkage_kinds(df_a, [c for c in shared if c not in kinds]), **kinds}
    per_kind = {**settings.LINKAGE_WEIGHTS, **_weights_by_kind(weights or {})}
    return Comparison(shared, [kinds[c] for c in shared], [float(per_kind[kinds[c]]) for c in shared],
                      [1.0] * len(shared),
                      settings.LINKAGE_THRESHOLD if threshold is None else float(threshold), top, text_method)


def _fingerprint(name: str, parts: list[Column]) -> list[Column]:
    """128-bit key of a value list as two integers: cheap to sort and shuffle.

    Nulls count (a hash alone would skip them). A match is confirmed on the
    values themselves, so equal keys of unequal values could not produce one.
    """
    marked = [x for p in parts for x in (p.isNull(), p)]
    return [F.xxhash64(F.lit("a"), *marked).alias(f"{name}1"), F.xxhash64(F.lit("b"), *marked).alias(f"{name}2")]


class Linkage:
    """Result of an attack: lazy match frames plus the facts known when it was planned."""

    def __init__(self, plan: Comparison, matches: DataFrame, coverage: DataFrame, per_tuple: DataFrame | None = None,
                 scored_pairs: int = 0):
        self.plan = plan
        self.matches = matches
        self.coverage = coverage
        #: Distinct target tuples with their number of rows and matches; None if nothing was compared.
        self.per_tuple = per_tuple
        #: Pairs of distinct tuples that were compared.
        self.scored_pairs = scored_pairs

    def top_matches(self, limit: int = settings.MATCH_LIST_LIMIT) -> DataFrame:
        """The strongest matches; the count in :meth:`summary` is taken before this cut."""
        return self.matches.orderBy(F.desc("match_probability"), "key_a", "key_b").limit(limit)

    def summary(self) -> DataFrame:
        """One row: pairs considered, matches, highest confidence and row coverage.

        Taken from the distinct tuples: rows that share one have the same matches.
        """
        if self.per_tuple is None:
            found = self.matches.agg(F.count(F.lit(1)).alias("matches_found"), F.lit(0.0).alias("highest_confidence"))
        else:
            found = self.per_tuple.agg(
                F.coalesce(F.sum(F.col("copies") * F.size("found")), F.lit(0)).cast("bigint").alias("matches_found"),
                F.coalesce(F.max(F.round(F.col("found")[0]["combined"], 3)), F.lit(0.0)).alias("highest_confidence"))
        return found.join(F.broadcast(self.coverage)).select(
            F.lit(",".join(self.plan.columns)).alias("shared_columns"),
            (F.col("target_rows_tested") * F.col("auxiliary_rows_tested")
             if self.plan.columns else F.lit(0).cast("bigint")).alias("candidates_tested"),
            "matches_found", "highest_confidence", "target_rows_total", "target_rows_tested",
            "auxiliary_rows_total", "auxiliary_rows_tested", "was_truncated")


def coverage(df_a: DataFrame, df_b: DataFrame, compared: bool = True) -> DataFrame:
    """How many rows exist and how many take part, per side: all of them, or none without a shared column."""
    total_a = df_a.agg(F.count(F.lit(1)).alias("target_rows_total"))
    total_b = df_b.agg(F.count(F.lit(1)).alias("auxiliary_rows_total"))
    tested = lambda c: F.col(c) if compared else F.lit(0).cast("bigint")
    return total_a.join(F.broadcast(total_b)).select(
        "target_rows_total", tested("target_rows_total").alias("target_rows_tested"),
        "auxiliary_rows_total", tested("auxiliary_rows_total").alias("auxiliary_rows_tested"),
        F.lit(False).alias("was_truncated"))


def _no_matches(df_a: DataFrame, df_b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    schema = T.StructType([
        T.StructField("key_a", df_a.schema[key_a].dataType),
        T.StructField("key_b", df_b.schema[key_b].dataType),
        T.StructField("match_rank", T.IntegerType()),
        T.StructField("match_probability", T.DoubleType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("matching_attributes", T.MapType(T.StringType(), T.StructType([
            T.StructField("score", T.DoubleType()), T.StructField("kind", T.StringType()),
            T.StructField("weight_key", T.StringType())]))),
    ])
    return df_a.sparkSession.createDataFrame([], schema)


def linkage(df_a: DataFrame, df_b: DataFrame, key_a: str, key_b: str, *, weights: dict | None = None,
            threshold: float | None = None, top: int = settings.LINKAGE_TOP,
            text_method: str = "ratcliff", columns: list[str] | None = None,
            kinds: dict[str, str] | None = None) -> Linkage:
    """Link ``df_a`` to ``df_b`` on every shared column but the keys; every row takes part."""
    df_a, df_b = nan_to_null(df_a), nan_to_null(df_b)
    plan = compare_plan(df_a, df_b, exclude=[key_a, key_b], weights=weights, threshold=threshold, top=top,
                        text_method=text_method, columns=columns, kinds=kinds)
    covered = coverage(df_a, df_b, bool(plan.columns))
    if not plan.columns:
        return Linkage(plan, _no_matches(df_a, df_b, key_a, key_b), covered)

    width = range(len(plan.columns))
    values = [f"v{i}" for i in width]
    typed_a, typed_b = [plan.typed(df_a, i) for i in width], [plan.typed(df_b, i) for i in width]
    a_rows = df_a.select(ref(key_a).alias("ka"), *[c.alias(v) for c, v in zip(typed_a, values)],
                         *_fingerprint("t", typed_a))
    b_rows = df_b.select(ref(key_b).alias("kb"), *[c.alias(v) for c, v in zip(typed_b, values)])
    # Each step is written once: the next one reads it several times.
    a_tuples, target = materialise(a_rows.groupBy("t1", "t2", *values).agg(F.count(F.lit(1)).alias("copies")))
    b_keyed = b_rows.select("kb", *values, *_fingerprint("u", [F.col(v) for v in values]))
    b_tuples, auxiliary = materialise(packed(b_keyed, ["u1", "u2"], [F.col("kb")], plan.top, F.col("kb"), "keys").select(
        "u1", "u2", "keys", *[F.col(v).alias(f"b_{v}") for v in values]))
    plan, stats = rounds.measured(a_tuples, b_tuples, plan, target, auxiliary)
    if nearest.applies(plan) and rounds.expected(plan, stats) > CROWDED * (target + auxiliary):
        per_tuple, tuples, trace = nearest.best_partners(a_tuples, b_tuples, plan, _fingerprint)
    else:
        per_tuple, tuples, trace = rounds.best_partners(a_tuples, b_tuples, plan, stats)
    log.info("linkage of %d with %d distinct tuples: %s", target, auxiliary, trace)
    if per_tuple is None:
        return Linkage(plan, _no_matches(df_a, df_b, key_a, key_b), covered)
    rows = attach(a_rows.select("ka", "t1", "t2"), per_tuple, ["t1", "t2"], "copies", ["found"], "inner", tuples)
    flat = rows.select("ka", F.explode("found").alias("m"))
    attributes = F.create_map(*[x for i in width for x in (
        F.lit(plan.columns[i]),
        F.struct(F.col("m.scores")[i].alias("score"), F.lit(plan.kinds[i]).alias("kind"),
                 F.lit(settings.WEIGHT_KEYS[plan.kinds[i]]).alias("weight_key")))])
    matches = flat.select(
        F.col("ka").alias("key_a"), F.col("m.kb").alias("key_b"), F.col("m.rank").alias("match_rank"),
        F.round("m.combined", 3).alias("match_probability"),
        linkage_level(F.col("m.combined")).alias("risk_level"),
        attributes.alias("matching_attributes"))
    return Linkage(plan, matches, covered, per_tuple, trace["pairs"])


def explain_matches(matches: DataFrame) -> DataFrame:
    """One row per match and attribute: how strongly the attribute contributed."""
    flat = matches.select("key_a", "key_b", "risk_level", "match_probability",
                          F.explode("matching_attributes").alias("attribute", "info"))
    score = F.col("info.score")
    strength = F.when(score >= 0.85, "strong").when(score >= 0.5, "partial").otherwise("weak")
    return flat.select(
        "key_a", "key_b", "risk_level", "match_probability", "attribute",
        F.col("info.kind").alias("kind"), score.alias("score"), strength.alias("strength"),
        F.format_string("%s: %s match (%s, score %s)", F.col("attribute"), strength,
                        F.col("info.kind"), score.cast("string")).alias("factor"))


def match_attribute_matrix(result: Linkage, limit: int = settings.HEATMAP_MATCHES) -> DataFrame:
    """Scores of the strongest matches, one row per match and one column per attribute."""
    first = result.top_matches(limit)
    info = F.col("matching_attributes")
    return first.select("key_a", "key_b", "match_probability",
                        *[info[c]["score"].alias(c) for c in result.plan.columns])
