"""Quality rules with adaptive thresholds from mergeable quantile sketches (native).

Every document gets base counts inside one scan (array functions on its own
words, nothing shuffled); the thin counts are written once. The sketch of a metric is a
histogram whose bins grow with the value (7 significant bits), so that counts
add up whatever the order of merging and results repeat exactly. Sketches are kept per (lang, source),
merged by language and over all; a source with a third of all rows costs no task more
than its bins. The fences from the sketches are joined back to the thin table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import SPACE, WORD, joinable, materialise, table, words_of

WINDOW = 8
#: Characters counted as symbols. Fixed value.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class RuleParams:
    """A metric's fence in a group is its upper quartile + spread * the interquartile range. Where that range is
    zero, the split into two classes that differ most (Otsu's; `few` documents at least above it) is the fence, if it
    explains the share `clear` of the variance; else ranks decide, and the fence is the quantile that leaves `tail` thousandths above it. A fence is
    drawn to that of the language, and that to the one of all documents, as if `shrink` documents more had it. Only
    documents that pass the base rules are counted. bits: significant bits of a bin's value (7: within 1.6 %)."""

    spread: int = 8
    clear: float = 0.85
    few: int = 10
    tail: int = 5
    shrink: int = 100
    bits: int = 7


#: Shares are whole multiples of 2 ** -SCALE, rounded down: exact everywhere.
SCALE = 20
#: metric: (count, of how many). Shares of words, lines or characters.
METRICS = {
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
}


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts; the text isn't kept. Null text: no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    squeezed = F.translate(text, " \t\n\x0b\f\r", "")
    # Repeated 8-word windows, by 64-bit hashes: a hash set tells whether any window repeats at all; only
    # then are hashes sorted with their places, and the union of the repeated windows is measured by the
    # gaps between their starts.
    # A window's hash is made by doubling: of two words, of two such pairs, of two such fours.
    twice = lambda c, k: F.transform(F.slice(c, 1, F.size(c) - k), lambda h, i: F.xxhash64(h, F.get(F.col(c), i + k)))
    d = docs.select(
        F.col("doc_id").alias("doc_id"),
        F.col("lang").alias("lang"),
        F.col("source").alias("source"),
        words_of(F.col("text")).alias("_w"),
        F.length(squeezed).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(squeezed) - F.length(F.regexp_replace(squeezed, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        lines.alias("_l"),
    )
    d = d.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", "n_upper",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") > WINDOW, F.transform("_w", lambda w: F.xxhash64(w))).alias("_win"),
    )
    for k in (1, 2, 4):
        d = d.withColumn("_win", twice("_win", k))
    d = d.withColumn("_some", F.size(F.array_distinct("_win")) < F.size("_win"))
    sorted_pairs = F.when(F.col("_some"), F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("_s", sorted_pairs).drop("_win", "_some")
    at = lambda i: F.get(F.col("_s"), i)["h"]
    starts = F.sort_array(F.transform(F.filter("_s", lambda p, i: (at(i - 1) == p["h"]) | (at(i + 1) == p["h"])), lambda p: p["i"]))
    d = d.withColumn("_p", starts).drop("_s")
    gaps = F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), i + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_p")


def sketches(counts: DataFrame, params: RuleParams) -> DataFrame:
    """(lang, source, metric, top, n): how many documents have a share in the bin whose largest value is top."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])
    each = counts.where("not base_failed").select("lang", "source", F.explode(pairs).alias("p")).select("lang", "source", "p.*")
    drop = F.greatest(F.lit(0), F.length(F.bin("v")) - params.bits)  # bits of the value that its bin forgets
    top = F.expr("shiftleft(shiftright(v, _d) + 1, _d) - 1")
    return each.withColumn("_d", drop).withColumn("top", top).groupBy("lang", "source", "metric", "top").agg(F.count("*").alias("n"))


def fences(counts: DataFrame, params: RuleParams) -> DataFrame:
    """(lang, source, fence_<metric>) for each group of documents that pass the base rules."""
    bins = materialise(sketches(counts, params), "rule-sketches")

    def level(keys: list[str], name: str) -> DataFrame:
        """keys, metric, count of documents and fence of each merged sketch. A window holds the bins of one sketch."""
        by = [*keys, "metric"]
        merged = bins.groupBy(*by, "top").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*by)
        upto = w.orderBy("top").rowsBetween(Window.unboundedPreceding, 0)
        placed = merged.select(
            *by, "top", F.sum("n").over(upto).alias("upto"), F.sum("n").over(w).alias("total"), F.sum(F.col("n") * F.col("top")).over(upto).alias("s0"),
            F.sum(F.col("n") * F.col("top")).over(w).alias("s"), F.sum(F.expr("cast(n as decimal(18, 0)) * cast(top * top as decimal(18, 0))")).over(w).cast("double").alias("q"),
        )
        gap = F.expr("s0 / cast(upto as double) - (s - s0) / cast(total - upto as double)")
        between = F.when(F.col("upto") <= F.col("total") - params.few, gap * gap * (F.expr("cast(upto as double) / total") * F.expr("cast(total - upto as double)")))
        at = lambda q: F.min(F.when(1000 * F.col("upto") >= q * F.col("total"), F.col("top")))
        q = placed.withColumn("between", between).groupBy(*by).agg(
            F.max("total").alias(f"{name}_n"), at(250).alias("q1"), at(750).alias("q3"), at(1000 - params.tail).alias("far"),
            F.max(F.struct("between", (-F.col("top")).alias("top"))).alias("cut"), F.max(F.expr("q - cast(s as double) * s / total")).alias("all"),
        )
        split = F.when(F.col("cut.between") >= params.clear * F.col("all"), -F.col("cut.top")).otherwise(F.col("far"))
        fence = F.when(F.col("q3") > F.col("q1"), F.col("q3") + params.spread * (F.col("q3") - F.col("q1"))).otherwise(split)
        return q.select(*[F.col(k).alias(f"{name}_{k}") for k in by], f"{name}_n", fence.alias(f"{name}_fence"))

    own, lang, whole = level(["lang", "source"], "own"), level(["lang"], "lang"), level([], "all")
    drawn = lambda n, fence, to: F.expr(f"({n} * {fence} + {params.shrink} * {to}) div ({n} + {params.shrink})")
    wide = lang.join(F.broadcast(whole), F.col("lang_metric") == F.col("all_metric"))  # whole: one row per metric
    wide = joinable(wide.select("lang_lang", "lang_metric", drawn("lang_n", "lang_fence", "all_fence").alias("lang_fence")), "rule-languages")
    found = own.join(wide, F.col("own_lang").eqNullSafe(F.col("lang_lang")) & (F.col("own_metric") == F.col("lang_metric")))
    fence = drawn("own_n", "own_fence", "lang_fence")
    return found.groupBy(F.col("own_lang").alias("f_lang"), F.col("own_source").alias("f_source")).agg(
        *[F.max(F.when(F.col("own_metric") == m, fence)).alias(f"fence_{m}") for m in METRICS]
    )


def judge(docs: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """Base counts, metrics, fences, base_failed and kept for each row of docs.

    A null text has no words and fails the base rules, as an empty one. Repeated rows and rows of null doc_id are
    judged each; null lang or source are groups of their own. A share at its fence is kept. Texts of any length are
    counted whole. Only doc_id, text, lang and source are read, so other columns are no matter. An empty table gives none.
    """
    share = lambda count, of: F.expr(f"shiftleft({count}, {SCALE}) div greatest({of}, 1)")
    bad = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counts = materialise(base_counts(docs).select("*", bad.alias("base_failed"), *[share(*of).alias(m) for m, of in METRICS.items()]), "rule-counts")
    f = joinable(fences(counts, params), "rule-fences")
    joined = counts.join(f, counts.lang.eqNullSafe(f.f_lang) & counts.source.eqNullSafe(f.f_source), "left").drop("f_lang", "f_source")
    over = F.lit(False)
    for m in METRICS:
        over = over | (F.col(m) > F.col(f"fence_{m}"))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(over, F.lit(False)))


def filter_documents(docs: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """The rows of docs whose verdict is kept."""
    kept = judge(docs, params).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.doc_id), "left_semi")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
