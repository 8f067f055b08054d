"""Which paragraph each diagnostic belongs to, and the comments to put there.

``paragraphs``: doc_id, para_no, text (top-level paragraphs, blank ones included).
``diagnostics``: doc_id, seq, severity, code, message, loc_section, loc_text, loc_finding, source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from redpen.functions import fixed, text as t
from redpen.operators.lineage import settle
from redpen.operators.matching import phrase_hits
from redpen.operators.ordered import numbered, position_bucket


def hint_key(c: Column) -> Column:
    """A section hint without filler words, lower-cased, outer punctuation removed."""
    bare = F.regexp_replace(F.lower(t.strip(c)), r"(?U)\bsections?\b", "")
    bare = F.regexp_replace(bare, r"(?U)\bthroughout the document\b", "")
    return F.btrim(t.strip(t.collapse(bare)), F.lit(" .,:;"))


def section_hints(c: Column) -> Column:
    """The parts of a hint such as ``Scope and Methods / Tools``, each once, in order."""
    parts = F.array(t.strip(c))
    for splitter in (r"(?iU)\s+and\s+", r"(?U)\s*/\s*", r"(?U)\s*,\s*"):
        parts = F.flatten(F.transform(parts, lambda p: F.split(p, splitter)))
    return F.array_distinct(F.filter(F.transform(parts, hint_key), lambda p: p != ""))


def hint_tokens(hint: Column) -> Column:
    return F.regexp_extract_all(hint, F.lit("([a-z0-9]{4,})"), F.lit(1))


def hint_tokens_needed(tokens: Column) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(3), F.size(tokens)))


def message_quotes(message: Column) -> Column:
    """Double-quoted spans of a message, longest first."""
    spans = F.filter(
        F.transform(F.regexp_extract_all(message, F.lit('"([^"]+)"'), F.lit(1)), t.strip), lambda s: s != ""
    )
    keyed = F.transform(spans, lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"), s.alias("span")))
    return F.transform(F.sort_array(keyed), lambda k: k["span"])


def _candidates(diagnostics: DataFrame) -> DataFrame:
    """Texts to look for, best first: (rung, nth); ``whole`` ones prefer an equal paragraph."""

    def rung(number: int, whole: bool, needles: Column) -> Column:
        return F.transform(
            needles,
            lambda s, i: F.struct(
                F.lit(number).alias("rung"), i.alias("nth"), F.lit(whole).alias("whole"), t.strip(s).alias("needle")
            ),
        )

    def single(c: Column) -> Column:
        return F.array_compact(F.array(c))

    section = F.when(F.col("loc_section") != "Document", F.col("loc_section"))
    ladder = F.concat(
        rung(1, True, single(F.col("loc_finding"))),
        rung(2, False, single(F.col("loc_text"))),
        rung(3, True, single(section)),
        rung(4, True, F.coalesce(section_hints(section), F.array().cast("array<string>"))),
        rung(6, False, F.coalesce(message_quotes(F.col("message")), F.array().cast("array<string>"))),
    )
    return diagnostics.select("doc_id", "seq", F.inline(F.filter(ladder, lambda c: c["needle"] != "")))


def _needle_paragraphs(needles: DataFrame, hits: DataFrame) -> DataFrame:
    """Per report and needle the first paragraph equal to it and the first holding it."""
    found = hits.join(needles, ["doc_id", "phrase"])

    def first(test: Column) -> Column:
        return F.min(F.when(test, F.col("para_no")))

    equal = first(F.col("text") == F.col("needle"))
    same_letters = first(F.lower("text") == F.col("phrase"))
    holding = F.coalesce(first(F.contains("text", "needle")), F.min("para_no"))
    return found.groupBy("doc_id", "needle").agg(
        F.coalesce(equal, same_letters, holding).alias("as_whole"), holding.alias("as_part")
    )


def _hint_probes(hints: DataFrame) -> DataFrame:
    """Words to search for so that no paragraph with enough of a hint's words is missed.

    Of n words, k must be there, so at least one of the n - k + 1 longest is.
    """
    worded = (
        hints.select("doc_id", "hint")
        .distinct()
        .withColumn("tokens", hint_tokens(F.col("hint")))
        .withColumn("needed", hint_tokens_needed(F.col("tokens")))
        .filter(F.size("tokens") >= F.col("needed"))
    )
    longest = F.sort_array(F.transform("tokens", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    probes = F.array_distinct(
        F.transform(F.slice(longest, F.lit(1), F.size("tokens") - F.col("needed") + 1), lambda x: x["w"])
    )
    return worded.select("doc_id", "hint", "tokens", "needed", F.explode(probes).alias("phrase"))


def _hint_overlaps(probes: DataFrame, hits: DataFrame) -> DataFrame:
    """Per report and hint the first paragraph that holds enough of its words."""
    return (
        hits.join(probes, ["doc_id", "phrase"])
        .filter(F.size(F.filter("tokens", lambda w: F.contains(F.lower("text"), w))) >= F.col("needed"))
        .groupBy("doc_id", "hint")
        .agg(F.min("para_no").alias("para_no"))
    )


def resolve_anchors(diagnostics: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """doc_id, seq, para_no and the rung of the ladder that found it.

    Rungs: 1 finding title, 2 location text, 3 section, 4 parts of the section hint,
    5 words of the hint, 6 quotes in the message, 7 the first paragraph with text.
    """
    paragraphs = paragraphs.select("doc_id", "para_no", t.strip(F.col("text")).alias("text"))
    candidates = settle(_candidates(diagnostics))
    hints = candidates.filter("rung = 4").select("doc_id", "seq", "nth", F.col("needle").alias("hint"))
    needles = candidates.select("doc_id", "needle").distinct().withColumn("phrase", F.lower("needle"))
    probes = _hint_probes(hints)

    wanted = needles.select("doc_id", "phrase").unionByName(probes.select("doc_id", "phrase"))
    lowered = paragraphs.select("doc_id", "para_no", F.lower("text").alias("text"))
    matches = settle(phrase_hits(lowered, wanted, ["doc_id", "para_no"], ["doc_id"]).drop("n"))
    hits = matches.join(paragraphs, ["doc_id", "para_no"])

    by_needle = candidates.join(_needle_paragraphs(needles, hits), ["doc_id", "needle"]).select(
        "doc_id", "seq", "rung", "nth", F.when(F.col("whole"), F.col("as_whole")).otherwise(F.col("as_part")).alias("para_no")
    )
    by_words = hints.join(_hint_overlaps(probes, hits), ["doc_id", "hint"]).select(
        "doc_id", "seq", F.lit(5).alias("rung"), "nth", "para_no"
    )
    best = (
        by_needle.unionByName(by_words)
        .groupBy("doc_id", "seq")
        .agg(F.min(F.struct("rung", "nth", "para_no")).alias("best"))
    )
    fallback = paragraphs.groupBy("doc_id").agg(
        F.coalesce(F.min(F.when(F.col("text") != "", F.col("para_no"))), F.min("para_no")).alias("first_no")
    )
    return (
        diagnostics.select("doc_id", "seq")
        .join(best, ["doc_id", "seq"], "left")
        .join(fallback, "doc_id", "left")
        .select(
            "doc_id", "seq",
            F.coalesce("best.para_no", "first_no").alias("para_no"),
            F.coalesce("best.rung", F.lit(7)).alias("rung"),
        )
        .filter("para_no is not null")
    )


def source_label(source: Column, code: Column) -> Column:
    by_model = F.lower(t.strip(F.coalesce(source, F.lit("")))).isin(fixed.AI_SOURCES)
    return F.when(by_model | F.startswith(F.upper(F.coalesce(code, F.lit(""))), F.lit("LLM-")), "AI-REVIEW").otherwise("RULE-PATTERN")


def comment_rows(diagnostics: DataFrame, anchors: DataFrame, comments: DataFrame, author: str) -> DataFrame:
    """Comments to write: earlier ones by ``author`` make way, ids go on after the others'."""
    placed = diagnostics.join(anchors.select("doc_id", "seq", "para_no"), ["doc_id", "seq"])
    counted = numbered(placed, ["doc_id"], ["seq"], position_bucket("seq"), "nth")
    taken = comments.filter(F.coalesce("author", F.lit("")) != author).groupBy("doc_id").agg(F.max("comment_id").alias("max_id"))
    label = source_label(F.col("source"), F.col("code"))
    return counted.join(taken, "doc_id", "left").select(
        "doc_id", "para_no",
        (F.greatest(F.coalesce("max_id", F.lit(0)), F.lit(0)) + F.col("nth")).alias("comment_id"),
        F.lit(author).alias("author"),
        F.format_string("[%s][%s][%s] %s", label, F.col("code"), F.col("severity"), F.col("message")).alias("text"),
    )
