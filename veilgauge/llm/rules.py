"""Quality rules with thresholds that adapt to each language and source.

Document statistics are plain column expressions. A mergeable quantile sketch per
(language, source) describes the documents that pass the base rules; sketches are
merged upwards to the language and to the whole corpus, so that a small group
borrows the thresholds of the level above. Documents are then joined with the
thresholds of their group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.llm.common import SPACE, any_of, columns_or_raise, words_of
from veilgauge.session import materialise

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A group with fewer documents uses the thresholds of its language, or else of the corpus.
MIN_GROUP = 100
#: Sketch size: exact up to so many documents in a group, within about 0.1 % in rank beyond.
SKETCH = 4096
#: A measure may lie so many quartile distances outside the quartiles.
REACH = 4.0
#: Smallest quartile distance that counts, so that a group of very even documents keeps some slack. Times `REACH` it
#: stays well below what the base rules let pass, so that every measure can reject in a group that is even in it.
MEASURES = {"word_length": 0.5, "symbol_share": 0.01, "duplicate_line_share": 0.07, "repeat_share": 0.03}


def _repeated_words(words: Column, n: Column) -> Column:
    """Words covered by windows that occur twice or more.

    Windows are compared by 64-bit hashes within one document: with 20,000 windows
    two different ones collide with a chance of 1e-11.
    """
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(
        *[F.get(words, i + k) for k in range(WINDOW)])))

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def repeated(ordered: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(ordered, j)["h"] == x["h"], F.lit(False))
        marked = F.transform(ordered, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
        return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

    def count(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bound(bound(ordered, repeated), covered)

    return F.coalesce(bound(hashes, lambda found: F.when(
        F.size(F.array_distinct(found)) < F.size(found), count(found))), F.lit(0)).cast("long")


def bound(value: Column, body) -> Column:
    """`body` over a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def statistics(docs: DataFrame) -> DataFrame:
    """Statistics of every whole text, in columns behind `doc_id`, `lang` and `source`.

    A null or blank text has no words and zero everywhere. Repeated rows stay
    repeated; further columns are ignored.
    """
    columns_or_raise(docs, "doc_id", "text", "lang", "source")
    raw = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    raw = raw.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    bare = F.translate("text", SPACE, "")
    counted = raw.select(
        "doc_id", "lang", "source", F.size("words").alias("n"), "words", F.xxhash64("text").alias("text_key"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))
              ).alias("line"))
    return counted.select(
        "doc_id", "lang", "source", "text_key", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.col("line.n_lines").cast("long").alias("n_lines"), F.col("line.dup").cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words"), F.col("n")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def measures() -> dict[str, Column]:
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(F.lit(0.0))
    return {"word_length": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
            "duplicate_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words")}


def thresholds(measured: DataFrame, min_group: int = MIN_GROUP, k: int = SKETCH, reach: float = REACH) -> DataFrame:
    """Lower and upper bound of every measure per (lang, source), from the rows that pass the base rules.

    One row per group of `measured`, with `n_<level>` of the level that decided. Null
    languages and sources form groups of their own. Without passing rows anywhere
    the bounds are null and cut nothing.
    """
    own = measured.groupBy("lang", "source").agg(
        F.count_if(~F.col("base_failed")).alias("n"),
        *[F.kll_sketch_agg_double(F.when(~F.col("base_failed"), F.col(m)), F.lit(k)).alias(m) for m in MEASURES])
    own, _ = materialise(own)
    merge = lambda: [F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, F.lit(k)).alias(m) for m in MEASURES]]

    def quartiles(df: DataFrame, level: str) -> DataFrame:
        keys = [c for c in df.columns if c in ("lang", "source")]
        at = lambda m, q: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(F.col(m), F.lit(q)))
        return df.select(*keys, F.struct(F.lit(level).alias("level"), F.col("n"), *[
            F.array(at(m, 0.25), at(m, 0.75)).alias(m) for m in MEASURES]).alias(level))

    per_language = quartiles(own.groupBy("lang").agg(*merge()), "language").withColumnRenamed("lang", "of_lang")
    corpus = quartiles(own.agg(*merge()), "corpus")
    chosen = (quartiles(own, "group").join(per_language, F.col("lang").eqNullSafe(F.col("of_lang")), "left")
              .crossJoin(corpus)  # one row
              .select("lang", "source", F.when(F.col("group.n") >= min_group, F.col("group"))
                      .when(F.col("language.n") >= min_group, F.col("language")).otherwise(F.col("corpus")).alias("t")))
    spread = lambda m: F.greatest(F.col(f"t.{m}")[1] - F.col(f"t.{m}")[0], F.lit(MEASURES[m]))
    return chosen.select(
        F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), F.col("t.level").alias("level"),
        *[(F.col(f"t.{m}")[0] - reach * spread(m)).alias(f"{m}_low") for m in MEASURES],
        *[(F.col(f"t.{m}")[1] + reach * spread(m)).alias(f"{m}_high") for m in MEASURES])


def judged(docs: DataFrame, min_group: int = MIN_GROUP, k: int = SKETCH, reach: float = REACH) -> DataFrame:
    """Every document's statistics with `base_failed`, `kept` and the level its thresholds came from."""
    measured = statistics(docs).withColumn("base_failed", base_failed()).withColumns(measures())
    measured, _ = materialise(measured)
    limits = thresholds(measured, min_group, k, reach)
    outside = any_of([(F.col(m) < F.col(f"{m}_low")) | (F.col(m) > F.col(f"{m}_high")) for m in MEASURES])
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    return joined.select(
        "doc_id", "lang", "source", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))).alias("kept"), "level")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows that the rules keep, with their own columns; equal rows share a verdict."""
    key = ["doc_id", "lang", "source", "text_key"]
    good = judged(docs, **options).where("kept").select(*[F.col(c).alias(f"good_{c}") for c in key]).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "lang", "source",
                        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    same = [F.col(c).eqNullSafe(F.col(f"good_{c}")) for c in key[:3]]
    return whole.join(good, (F.col("text_key") == F.col("good_text_key")) & same[0] & same[1] & same[2], "left_semi").select("row.*")
