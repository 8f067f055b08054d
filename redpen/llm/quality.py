"""Quality rules whose thresholds adapt to each language and source.

Per document a few counts are taken inside its row.  Each (lang, source) gets one
mergeable KLL quantile sketch per measure; the fewer documents a group has, the more its
quantiles are drawn to those of its language, and those of a language to those of all.
The fences taken from the sketches are joined back and filter the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.llm.common import WHITE, words, written

SYMBOLS = "#*$%&|<>"

#: measure: (count, what it is counted over, which sides are fenced, rank of the upper fence).
#: Repeats are rare in every group and have a long honest tail, so their fence is far out; up to a fifth of a
#: group may be symbol junk, so that fence starts at the quartile.
MEASURES = {
    "word_length": ("word_chars", "n_words", "both", 0.75),
    "symbol_share": ("n_symbols", "n_words", "upper", 0.75),
    "dup_line_share": ("n_dup_lines", "n_lines", "upper", 0.98),
    "repeat_share": ("n_repeat_words", "n_words", "upper", 0.98),
}
#: Their quantiles are taken of each group: the measures, and how much each document has to count over.
SKETCHED = {m: f"{count} / greatest({over}, 1)" for m, (count, over, *_) in MEASURES.items()} | {"n_words": "n_words", "n_lines": "n_lines"}


@dataclass(frozen=True)
class Rules:
    """``reach``: how many quartile distances beyond its rank a fence lies.
    ``errors``: standard errors of a count that a document may lie beyond the fence.
    ``borrowed``: documents of the next wider sketch that count with a group's own.
    ``sketch_k``: KLL accuracy (200: rank error about 1.3 %)."""

    least_words: int = 50
    repeat_percent: int = 50
    reach: float = 4.0
    errors: float = 3.0
    borrowed: int = 20
    sketch_k: int = 200


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A null text counts as empty.  ``n_lines`` are the lines with a word.  Words in repeated
    three-word windows are found by sorting the hashes of the windows inside the row: linear
    space, n log n time, whatever the text repeats.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    solid = F.translate(text, WHITE, "")
    base = docs.select(
        "doc_id",
        "lang",
        "source",
        words(F.col("text")).alias("w"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0).alias("lines"),
    )
    hashed = base.select(
        "*",
        F.sort_array(
            F.slice(
                F.transform(
                    "w",
                    lambda x, i: F.struct(F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")),
                ),
                1,
                F.greatest(F.size("w") - 2, F.lit(0)),
            )
        ).alias("s"),
    )

    def repeated(x: Column, j: Column) -> Column:
        return (x["h"] == F.get("s", j - 1)["h"]) | (x["h"] == F.get("s", j + 1)["h"])

    placed = hashed.withColumn("p", F.sort_array(F.transform(F.filter("s", repeated), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("p", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("p", j + 1) - x, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return placed.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def with_base(stats: DataFrame, rules: Rules) -> DataFrame:
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    return stats.withColumn("base_failed", failed)


def sketches(stats: DataFrame, rules: Rules) -> DataFrame:
    """One row per (lang, source): a KLL sketch of each measure and length over all documents that pass the base rules."""
    passed = stats.where("not base_failed").select("lang", "source", *(F.expr(e).cast("double").alias(m) for m, e in SKETCHED.items()))
    return passed.groupBy("lang", "source").agg(*(F.kll_sketch_agg_double(m, F.lit(rules.sketch_k)).alias(m) for m in SKETCHED))


def thresholds(group_sketches: DataFrame, rules: Rules) -> DataFrame:
    """lang, source with ``<measure>_low`` and ``<measure>_high`` (null: that side is open) and the median n_words and n_lines."""
    by_lang = group_sketches.groupBy("lang").agg(*(F.kll_merge_agg_double(m).alias(f"{m}_l") for m in SKETCHED))
    overall = {m: group_sketches.agg(F.kll_merge_agg_double(m)).scalar() for m in SKETCHED}
    wide = group_sketches.withColumnRenamed("lang", "g_lang").join(by_lang, F.col("g_lang").eqNullSafe(F.col("lang")))

    def quantile(m: str, rank: float) -> Column:
        """The group's quantile, drawn to that of its language, and this to that of all, as if by ``borrowed`` documents."""
        own, lang = (F.kll_sketch_get_n_double(x) for x in (m, f"{m}_l"))
        value = F.kll_sketch_get_quantile_double(overall[m], F.lit(rank))
        for n, x in ((lang, m + "_l"), (own, m)):
            value = (n * F.kll_sketch_get_quantile_double(x, F.lit(rank)) + rules.borrowed * value) / (n + rules.borrowed)
        return value

    cols = [F.col("g_lang").alias("t_lang"), F.col("source").alias("t_source")]
    cols += [quantile(over, 0.5).alias(f"{over}_usual") for over in ("n_words", "n_lines")]
    for m, (_, _, sides, rank) in MEASURES.items():
        q1, q3 = quantile(m, 0.25), quantile(m, 0.75)
        reach = rules.reach * (q3 - q1)
        cols += [
            (F.greatest(q1 - reach, F.lit(0.0)) if sides == "both" else F.lit(None).cast("double")).alias(f"{m}_low"),
            (quantile(m, rank) + reach).alias(f"{m}_high"),
        ]
    return wide.select(*cols)


def inside(measure: str, rules: Rules) -> Column:
    """Whether a document lies within the fences, but for the sampling error of its count.

    A count over n words or lines is taken to vary by the square root of what the fence lets expect,
    plus what can come up where it lets expect none.  Documents longer than usual in their group get
    the error of a usual one: a fence is not known more closely than the documents it is taken from.
    """
    count, over, *_ = MEASURES[measure]
    n = F.greatest(F.least(F.col(over).cast("double"), F.col(f"{over}_usual")), F.lit(1.0))
    low, high, value = F.col(f"{measure}_low"), F.col(f"{measure}_high"), F.col(count) / F.greatest(F.col(over), F.lit(1))
    under = value < low - rules.errors * F.sqrt(low / n)
    beyond = value > high + rules.errors * F.sqrt(high / n) + rules.errors**2 / n
    return ~F.coalesce(under, F.lit(False)) & ~F.coalesce(beyond, F.lit(False))


def judged(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per document its counts, ``base_failed`` and ``kept``.

    Null or blank texts have no words and fail the base rules.  Null lang or source form
    groups of their own.  Repeated doc_ids are judged row by row.  An empty table gives no
    rows.  Other columns of ``docs`` are ignored, whatever their names.
    """
    stats = written(with_base(counts(docs), rules), "quality")
    fences = thresholds(sketches(stats, rules), rules)
    joined = stats.join(fences, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    kept = ~F.col("base_failed")
    for m in MEASURES:
        kept = kept & inside(m, rules)
    return joined.select(*stats.columns, kept.alias("kept"))


def op10_query(spark, sf_dir: str) -> DataFrame:
    from redpen.llm.common import table

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged(table(spark, sf_dir, "documents")).select(*columns)
