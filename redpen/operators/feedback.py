"""Reviewers' decisions, read out of comment threads and merged into rule tables.

``comments``: doc_id, seq, comment_id, parent_id, author, text (seq is document order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from redpen.functions import fixed, text as t
from redpen.operators.ordered import numbered, position_bucket


def decision(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for verdict, pattern in reversed(fixed.DECISIONS):
        out = F.when(text.rlike(pattern), verdict).otherwise(out)
    return out


def rewrite_pair(text: Column) -> Column:
    """The ``"old" -> "new"`` of a comment as a struct, else null."""
    straight = t.straight_quotes(text)
    for arrow in "→⟶⟹":
        straight = F.replace(straight, F.lit(arrow), F.lit("->"))

    def read(pattern: str) -> Column:
        parts = F.struct(
            F.regexp_extract(straight, pattern, 1).alias("from_text"), F.regexp_extract(straight, pattern, 2).alias("to_text")
        )
        return F.when(straight.rlike(pattern), parts)

    pair = F.coalesce(read(fixed.REWRITE_NAMED), read(fixed.REWRITE_BARE))
    clean = F.struct(t.strip(pair["from_text"]).alias("from_text"), t.strip(pair["to_text"]).alias("to_text"))
    return F.when((clean["from_text"] != "") & (clean["to_text"] != ""), clean)


def diagnostic_rule(text: Column, most_chars: int | None = fixed.RULE_MESSAGE_CHARS) -> Column:
    """Code and message of a ``[label][code][severity] message`` comment, else null; ``most_chars`` of the message (None: whole).

    Accept and reject markers typed into the comment are not part of it.
    """
    plain = t.strip(F.regexp_replace(text, fixed.MARKER, ""))
    code = t.strip(F.regexp_extract(plain, fixed.DIAGNOSTIC_COMMENT, 1))
    message = F.trim(t.collapse(F.regexp_extract(plain, fixed.DIAGNOSTIC_COMMENT, 2)))
    kept = message if most_chars is None else F.rtrim(F.substring(message, 1, most_chars))
    rule = F.struct(code.alias("code"), kept.alias("message_contains"))
    return F.when((code != "") | (message != ""), rule)


def resolve_decisions(comments: DataFrame, author: str, ahead: int = 6, id_gap: int = 8, most_chars: int | None = fixed.RULE_MESSAGE_CHARS) -> DataFrame:
    """Comments by ``author`` that state a rule, with the verdict on them.

    The verdict is in the comment itself, else in its first deciding reply, else in the
    first deciding top-level comment by someone else among the next ``ahead``.
    """
    placed = numbered(comments, ["doc_id"], ["seq"], position_bucket("seq"), "nth").withColumn(
        "verdict", decision(F.col("text"))
    )
    rewrite, rule = rewrite_pair(F.col("text")), diagnostic_rule(F.col("text"), most_chars)
    base = placed.filter(t.strip(F.coalesce("author", F.lit(""))) == author).select(
        "doc_id", "seq", "nth", "comment_id", "text", "verdict", rewrite.alias("rewrite"), rule.alias("rule")
    ).filter("rewrite is not null or rule is not null")

    deciding = placed.filter("verdict is not null")
    replies = (
        deciding.filter("parent_id is not null")
        .groupBy("doc_id", F.col("parent_id").alias("comment_id"))
        .agg(F.min_by("verdict", "seq").alias("reply_verdict"))
    )
    others = deciding.filter("parent_id is null").filter(t.strip(F.coalesce("author", F.lit(""))) != author).select(
        "doc_id", "nth", F.col("comment_id").alias("other_id"), F.col("verdict").alias("other_verdict")
    )
    # Positions are dense, so "the next few" is an equi-join on position.
    nearby = (
        base.select("doc_id", "seq", "comment_id", F.explode(F.sequence(F.col("nth") + 1, F.col("nth") + ahead)).alias("nth"))
        .join(others, ["doc_id", "nth"])
        .filter(F.coalesce(F.col("other_id") - F.col("comment_id") <= id_gap, F.lit(True)))
        .groupBy("doc_id", "seq")
        .agg(F.min_by("other_verdict", "nth").alias("near_verdict"))
    )
    return (
        base.join(replies, ["doc_id", "comment_id"], "left")
        .join(nearby, ["doc_id", "seq"], "left")
        .select(
            "doc_id", "seq", "comment_id", "rewrite", "rule",
            F.coalesce("verdict", "reply_verdict", "near_verdict").alias("decision"),
        )
        .filter("decision is not null")
    )


def reviewed_rewrites(resolved: DataFrame) -> DataFrame:
    return resolved.filter("rewrite is not null").select("doc_id", "seq", "decision", "rewrite.*")


def reviewed_diagnostics(resolved: DataFrame) -> DataFrame:
    return resolved.filter("rule is not null").select("doc_id", "seq", "decision", "rule.*")


REWRITE_COLUMNS = ["from_text", "to_text"]
DIAGNOSTIC_COLUMNS = ["code", "message_contains"]


def _rewrite_keys() -> dict[str, Column]:
    return {"_from": t.squash(F.col("from_text")), "_to": t.squash(F.col("to_text"))}


def _diagnostic_keys() -> dict[str, Column]:
    return {"_code": F.upper(t.strip(t.collapse(F.col("code")))), "_message": t.squash(F.col("message_contains"))}


def _new_rules(existing: DataFrame, reviewed: DataFrame, keys: dict[str, Column], columns: list[str]) -> DataFrame:
    names = ["decision", *keys]
    first = F.min_by(F.struct(*columns, "doc_id", "seq"), F.struct("doc_id", "seq"))
    fresh = reviewed.withColumns(keys).groupBy(*names).agg(first.alias("rule"))
    return fresh.join(existing.withColumns(keys).select(*names), names, "left_anti").select("decision", "rule.*")


def new_rewrites(existing: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Rewrite decisions that ``existing`` does not have, worded as first reviewed: decision, from_text, to_text, doc_id, seq."""
    return _new_rules(existing, reviewed, _rewrite_keys(), REWRITE_COLUMNS)


def new_diagnostics(existing: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Diagnostic decisions that ``existing`` does not have: decision, code, message_contains, doc_id, seq.  Codes are equal whatever their case."""
    return _new_rules(existing, reviewed, _diagnostic_keys(), DIAGNOSTIC_COLUMNS)


def _merged(existing: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    added = new.select("decision", *columns, F.lit(True).alias("added"))
    return existing.select("decision", *columns, F.lit(False).alias("added")).unionByName(added)


def merge_rewrites(existing: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Existing rewrite decisions plus new ones, with ``added`` telling which is which."""
    return _merged(existing, new_rewrites(existing, reviewed), REWRITE_COLUMNS)


def merge_diagnostics(existing: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Existing diagnostic decisions plus new ones."""
    return _merged(existing, new_diagnostics(existing, reviewed), DIAGNOSTIC_COLUMNS)


def feedback_counts(merged_rewrites: DataFrame, merged_diagnostics: DataFrame) -> DataFrame:
    """How many rules of each kind and decision were added."""
    both = merged_rewrites.select(F.lit("rewrite").alias("kind"), "decision", "added").unionByName(
        merged_diagnostics.select(F.lit("diagnostic").alias("kind"), "decision", "added")
    )
    return both.groupBy("kind", "decision").agg(
        F.count_if("added").alias("added"), F.count_if(~F.col("added")).alias("kept")
    )
