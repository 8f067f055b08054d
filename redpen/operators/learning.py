"""Learning from successive versions of reports: what wording, casing and layout went or stayed.

Tables used here:

* ``pairs``: pair_id, family, old_doc, new_doc
* ``docs``: doc_id, text (paragraphs joined by newline; one row per report)
* ``paragraphs``: doc_id, para_no, text
* ``tracked``: doc_id, para_no, seq, kind (ins, del), text

Counts come out either summed over all pairs or, with ``per_pair``, as one partial
count per pair for the refresh job.  Both are plain sums, so they merge in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from redpen.functions import fixed, text as t
from redpen.operators.lineage import settle
from redpen.operators.matching import among
from redpen.operators.ordered import at_ranks, numbered

# --- versions and pairs ---------------------------------------------------------------


def report_versions(reports: DataFrame, suffix: str = ".docx") -> DataFrame:
    """Reports whose file name states a version, with family, major and minor.

    With a column ``path``, families lie within one folder, and file_name comes with its folder.
    """
    stem = t.file_stem(F.col("file_name"))
    folder = F.regexp_replace("path", r"[^/]*$", "") if "path" in reports.columns else F.lit("")
    return (
        reports.filter(F.endswith(F.lower("file_name"), F.lit(suffix)) & ~F.startswith("file_name", F.lit(".")))
        .select(
            "doc_id",
            F.concat(folder, "file_name").alias("file_name"),
            F.concat(folder, t.report_family(stem)).alias("family"),
            t.version_part(stem, 1).alias("major"),
            t.version_part(stem, 2).alias("minor"),
        )
        .filter("family is not null")
    )


def version_pairs(reports: DataFrame, mode: str = "consecutive") -> DataFrame:
    """Each version with the next one, or with mode ``latest`` the first with the last."""
    versions = report_versions(reports).withColumn("lower_name", F.lower("file_name"))
    order = ["major", "minor", "lower_name", "doc_id"]
    if mode == "latest":
        ends = versions.groupBy("family").agg(
            F.count("*").alias("n"),
            F.min(F.struct(*order, "file_name")).alias("old"),
            F.max(F.struct(*order, "file_name")).alias("new"),
        ).filter("n >= 2")
        joined = ends.select(
            "family", F.col("old.doc_id").alias("old_doc"), F.col("old.file_name").alias("old_name"),
            F.col("new.doc_id").alias("new_doc"), F.col("new.file_name").alias("new_name"),
        )
    else:
        bucket = F.struct("major", F.floor(F.col("minor") / 1024).alias("minor"))
        placed = numbered(versions, ["family"], order, bucket, "nth")
        old = placed.select("family", "nth", F.col("doc_id").alias("old_doc"), F.col("file_name").alias("old_name"))
        new = placed.select(
            "family", (F.col("nth") - 1).alias("nth"), F.col("doc_id").alias("new_doc"), F.col("file_name").alias("new_name")
        )
        joined = old.join(new, ["family", "nth"])
    return joined.select(F.concat_ws("::", "old_name", "new_name").alias("pair_id"), "family", "old_doc", "new_doc")


def pair_sides(pairs: DataFrame) -> DataFrame:
    """pair_id, doc_id and whether the report is the old or the new one."""
    return pairs.select(
        "pair_id",
        F.inline(
            F.array(
                F.struct(F.col("old_doc").alias("doc_id"), F.lit(1).alias("is_old"), F.lit(0).alias("is_new")),
                F.struct(F.col("new_doc").alias("doc_id"), F.lit(0).alias("is_old"), F.lit(1).alias("is_new")),
            )
        ),
    )


def _sides(pairs: DataFrame, per_pair: bool) -> tuple[DataFrame, list[str]]:
    """How often each report counts as old and as new: per pair, or over all pairs.

    Over all pairs a report is read once, however many pairs it belongs to.
    """
    sides = pair_sides(pairs)
    if per_pair:
        return sides, ["pair_id"]
    return sides.groupBy("doc_id").agg(F.sum("is_old").alias("is_old"), F.sum("is_new").alias("is_new")), []


# --- wording that went away ----------------------------------------------------------------


#: Characters of text whose phrases are counted in one task.
TASK_CHARS = 4 << 20


def tasks_for(docs: DataFrame) -> int:
    """As many tasks as count the phrases of ``docs`` in memory."""
    chars = docs.agg(F.sum(F.length("text").cast("bigint")).alias("n")).first()["n"] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS))


def _said(docs: DataFrame, sides: DataFrame, keys: list[str], tracked: DataFrame | None, weight: int) -> DataFrame:
    """Texts with how often they count as old and as new; tracked changes count ``weight``."""
    sides = settle(sides)
    paired = sides.select("doc_id")  # texts of reports without a pair need not travel
    said = among(docs, "doc_id", paired).join(sides, "doc_id").select(*keys, "text", F.col("is_old").alias("old"), F.col("is_new").alias("new"))
    if tracked is None:
        return said
    both = (F.col("is_old") + F.col("is_new")) * F.lit(weight)
    revised = clean_tracked(among(tracked, "doc_id", paired)).join(sides, "doc_id").select(
        *keys, "text",
        F.when(F.col("kind") == "del", both).otherwise(0).alias("old"),
        F.when(F.col("kind") == "ins", both).otherwise(0).alias("new"),
    )
    return said.unionByName(revised)


def sentence_counts(
    docs: DataFrame, pairs: DataFrame, tracked: DataFrame | None = None, weight: int = 2, per_pair: bool = False
) -> DataFrame:
    """Old and new counts of each sentence; tracked changes in either version count ``weight``."""
    sides, keys = _sides(pairs, per_pair)
    said = _said(docs, sides, keys, tracked, max(1, weight))
    if per_pair:
        said = said.repartition(tasks_for(docs), "pair_id")
    wording = F.transform(t.sentences(F.col("text")), t.squash)
    return merge_counts(said.select(*keys, F.explode(wording).alias("phrase"), "old", "new"), *keys)


def ngram_counts(
    docs: DataFrame, pairs: DataFrame, tracked: DataFrame | None = None,
    shortest: int = 3, longest: int = 5, per_pair: bool = False,
) -> DataFrame:
    """Old and new counts of each run of words; tracked changes count once."""
    sides, keys = _sides(pairs, per_pair)
    said = _said(docs, sides, keys, tracked, 1)
    if per_pair:
        # a pair's texts travel, not their word runs
        said = said.repartition(tasks_for(docs), "pair_id")
        return merge_counts(said.select(*keys, F.explode(t.all_ngrams(F.col("text"), shortest, longest)).alias("phrase"), "old", "new"), *keys)
    return merge_counts(dealt_ngrams(said, tasks_for(docs), shortest, longest), "key").drop("key")


def dealt_ngrams(texts: DataFrame, tasks: int, shortest: int = 3, longest: int = 5) -> DataFrame:
    """key, phrase and the other columns of ``texts``, a row for each word run: equal ones have one key, and lie in one task.

    Stretches of words travel, not the runs in them, which are some five times as long.
    """
    others = [c for c in texts.columns if c != "text"]
    packed = texts.select(*others, F.inline(t.word_runs(F.col("text"), shortest, longest))).repartition(tasks, "key")
    return packed.select("key", *others, F.explode(t.stretch_ngrams(F.col("stretch"), F.col("heads"), shortest, longest)).alias("phrase"))


def merge_counts(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy(*keys, "phrase").agg(F.sum("old").alias("old"), F.sum("new").alias("new"))


def drops(counts: DataFrame, min_drop: int = 4, min_len: int = 0) -> DataFrame:
    return counts.filter((F.col("old") - F.col("new") >= min_drop) & (F.length("phrase") >= min_len))


# --- casing ----------------------------------------------------------------------------------


def _one_sided(paragraphs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Paragraph wordings that only one version of a pair has; settled, as both sides are read."""
    return settle(
        paragraphs.join(pair_sides(pairs), "doc_id")
        .groupBy("pair_id", "text")
        .agg(
            F.sum("is_old").alias("in_old"),
            F.sum("is_new").alias("in_new"),
            F.min(F.when(F.col("is_new") == 1, F.col("para_no"))).alias("first_no"),
            F.max(F.when(F.col("is_new") == 1, F.col("para_no"))).alias("last_no"),
        )
        .filter("in_old = 0 or in_new = 0")
        .withColumn("lower", F.lower("text"))
    )


def case_votes(paragraphs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Votes for a casing, per pair: each old occurrence with each new one."""
    sides = _one_sided(paragraphs, pairs)
    # Occurrences are counted before the join, so a repeated paragraph stays one row.
    old = sides.filter("in_new = 0").groupBy("pair_id", "lower").agg(F.sum("in_old").alias("in_old"))
    new = sides.filter("in_old = 0").select("pair_id", "lower", F.col("text").alias("preferred"), "in_new", "first_no")
    return new.join(old, ["pair_id", "lower"]).select(
        "pair_id", "lower", "preferred", (F.col("in_old") * F.col("in_new")).alias("votes"), "first_no"
    )


def case_rules(votes: DataFrame) -> DataFrame:
    """The casing with most votes; ties go to the one seen first."""
    totals = votes.groupBy("lower", "preferred").agg(
        F.sum("votes").alias("votes"), F.min(F.struct("pair_id", "first_no")).alias("first")
    )
    best = F.min_by("preferred", F.struct((-F.col("votes")).alias("v"), "first", "preferred"))
    return totals.groupBy("lower").agg(best.alias("preferred"), F.max("votes").alias("votes"))


# --- changed sentences (``alignment.sentence_changes``) ---------------------------------------------


def change_samples(changes: DataFrame, most: int | None = None) -> DataFrame:
    """The changes of each kind in each pair, numbered, for a model to look at; with ``most`` the first of them."""
    nth = F.row_number().over(Window.partitionBy("pair_id", "kind").orderBy("seq"))
    numbered_ = changes.withColumn("nth", nth)
    return numbered_ if most is None else numbered_.filter(F.col("nth") <= most)


def rewrite_votes(changes: DataFrame) -> DataFrame:
    """One row per usable replaced sentence, with its wording keys."""
    old, new = F.col("old_sentence"), F.col("new_sentence")
    return (
        changes.filter("kind = 'replaced'")
        .withColumns({"from_key": t.squash(old), "to_key": t.squash(new)})
        .filter((F.col("from_key") != F.col("to_key")) & t.high_signal(old, new))
        .select(
            "pair_id", "from_key", "to_key", old.alias("from_text"), new.alias("to_text"),
            F.lit(1).alias("votes"), F.struct("pair_id", F.lit(0).alias("stage"), F.lit(0).alias("para_no"), "seq").alias("first"),
        )
    )


# --- tracked changes --------------------------------------------------------------------------------


def clean_tracked(tracked: DataFrame) -> DataFrame:
    return tracked.withColumn("text", F.trim(t.collapse(F.col("text")))).filter("text <> ''")


def tracked_replacements(tracked: DataFrame) -> DataFrame:
    """Insertions with the oldest deletion of their paragraph not yet replaced.

    With deletions counting up and insertions down, an insertion finds a deletion
    waiting exactly when the balance before it is above its lowest value so far (or
    above zero).  The k-th insertion that does takes the k-th deletion.
    """
    paragraph = ["doc_id", "para_no"]
    upto = Window.partitionBy(*paragraph).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("kind") == "del", 1).otherwise(-1)
    counted = (
        clean_tracked(tracked)
        .withColumn("balance", F.sum(step).over(upto))
        .withColumn("lowest", F.least(F.min("balance").over(before), F.lit(0)))
        .withColumn("waiting", F.coalesce(F.sum(step).over(before), F.lit(0)) - F.coalesce("lowest", F.lit(0)))
        .withColumn("takes", ((F.col("kind") == "ins") & (F.col("waiting") > 0)).cast("int"))
        .withColumn("nth", F.sum(F.when(F.col("kind") == "del", 1).otherwise(F.col("takes"))).over(
            Window.partitionBy(*paragraph, "kind").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    )
    old = counted.filter("kind = 'del'").select(*paragraph, "nth", F.col("text").alias("from_text"))
    new = counted.filter("takes = 1").select(*paragraph, "nth", "seq", F.col("text").alias("to_text"))
    return old.join(new, [*paragraph, "nth"]).select(*paragraph, "seq", "from_text", "to_text")


def tracked_votes(tracked: DataFrame, pairs: DataFrame, weight: int = 2) -> DataFrame:
    """Tracked replacements of both versions as weighted rewrite votes."""
    return (
        tracked_replacements(tracked)
        .filter("from_text <> to_text")
        .join(pair_sides(pairs), "doc_id")
        .select(
            "pair_id", t.squash(F.col("from_text")).alias("from_key"), t.squash(F.col("to_text")).alias("to_key"),
            "from_text", "to_text", F.lit(max(1, weight)).alias("votes"),
            F.struct("pair_id", (F.col("is_new") + 1).alias("stage"), "para_no", "seq").alias("first"),
        )
    )


def tracked_totals(tracked: DataFrame, pairs: DataFrame) -> DataFrame:
    """Insertions, deletions and replacements over all pairs."""
    sides, _ = _sides(pairs, per_pair=False)
    weight = F.col("is_old") + F.col("is_new")
    events = clean_tracked(tracked).select("doc_id", F.when(F.col("kind") == "del", "deleted").otherwise("inserted").alias("kind"))
    swaps = tracked_replacements(tracked).select("doc_id", F.lit("replacements").alias("kind"))
    return events.unionByName(swaps).join(sides, "doc_id").groupBy("kind").agg(F.sum(weight).alias("n"))


# --- rewrite rules -------------------------------------------------------------------------------------


def rewrite_rules(votes: DataFrame, min_votes: int = 2) -> DataFrame:
    """Rules with enough votes, worded as first seen."""
    example = F.min_by(F.struct("from_text", "to_text"), "first")
    return (
        votes.groupBy("from_key", "to_key")
        .agg(F.sum("votes").alias("votes"), example.alias("example"))
        .filter(F.col("votes") >= min_votes)
        .select("example.from_text", "example.to_text", "votes")
    )


def merge_rewrite_rules(learned: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted rules first, then learned ones by votes; the first of each wording stays.

    Accepted rules keep the order of ``pos`` if they have it; learned ones keep ``source`` and ``reason`` if they have them.
    """
    from_text, to_text = F.col("from_text"), F.col("to_text")
    more = [c for c in ("source", "reason") if c in learned.columns]
    given = {"source": F.lit("accepted_feedback"), "reason": F.lit("")}
    kind = dict(accepted.dtypes).get("pos", "bigint")
    pos = F.col("pos") if "pos" in accepted.columns else F.lit(None).cast(kind)
    ranked_ = accepted.select(
        "from_text", "to_text", F.lit(fixed.ACCEPTED_REWRITE_COUNT).cast("bigint").alias("votes"), F.lit(0).alias("priority"), pos.alias("pos"), *[given[c].alias(c) for c in more]
    ).unionByName(
        learned.select("from_text", "to_text", F.col("votes").cast("bigint").alias("votes"), F.lit(1).alias("priority"), F.lit(None).cast(kind).alias("pos"), *more)
    )
    order = F.struct("priority", "pos", (-F.col("votes")).alias("v"), "from_text", "to_text", *more)
    first = F.min_by(F.struct("from_text", "to_text", "votes", "priority", *more), order)
    return (
        ranked_.withColumns({"from_key": t.squash(from_text), "to_key": t.squash(to_text)})
        .filter("from_key <> '' and to_key <> ''")
        .groupBy("from_key", "to_key")
        .agg(first.alias("rule"))
        .select("rule.*")
    )


# --- layout -----------------------------------------------------------------------------------------------


def usual_values(facts: DataFrame, column: str, min_share: float, min_count: int = 2) -> DataFrame:
    """Values used often enough over all reports, with count and share."""
    counts = facts.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total")).select("total").scalar()
    share = F.col("n") / total
    return counts.filter((F.col("n") >= min_count) & (share >= min_share)).select(
        column, "n", F.round(share, 4).alias("share")
    )


def usual_range(facts: DataFrame, column: str, min_samples: int = 3) -> DataFrame:
    """Low, median and high of positive values: those at ranks n/10, n/2 and 9n/10, rounded down.  No row if there are too few values."""
    spark, kind = facts.sparkSession, dict(facts.dtypes)[column]
    positive = facts.filter(F.col(column) > 0).select(column)
    n = positive.count()
    values = at_ranks(positive, column, [int(n * 0.1), n // 2, int(n * 0.9)]) if n >= min_samples else []
    return spark.createDataFrame([(*values, n)] if values else [], f"low {kind}, median {kind}, high {kind}, samples bigint")


def pair_layout(layout: DataFrame, pairs: DataFrame) -> DataFrame:
    """Layout facts of the new report of each pair."""
    return layout.join(pairs.select(F.col("new_doc").alias("doc_id")), "doc_id")


# --- the two-version profile ------------------------------------------------------------------------------


def change_profile(
    docs: DataFrame, paragraphs: DataFrame, pairs: DataFrame, min_drop: int = 5, min_len: int = 15
) -> DataFrame:
    """Per pair: dropped sentences, dropped word runs, and casing changes (the last one wins)."""
    sentences = drops(sentence_counts(docs, pairs, per_pair=True), min_drop, min_len)
    ngrams = drops(ngram_counts(docs, pairs, per_pair=True), min_drop)
    sides = _one_sided(paragraphs, pairs)
    old = sides.filter("in_new = 0").select("pair_id", "lower").distinct()
    new = sides.filter("in_old = 0").groupBy("pair_id", "lower").agg(F.max_by("text", "last_no").alias("preferred"))

    def shaped(df: DataFrame, kind: str, phrase: str, old_n: Column, new_n: Column, preferred: Column) -> DataFrame:
        return df.select(
            "pair_id", F.lit(kind).alias("kind"), F.col(phrase).alias("phrase"),
            old_n.cast("bigint").alias("old_n"), new_n.cast("bigint").alias("new_n"), preferred.cast("string").alias("preferred"),
        )

    none = F.lit(None)
    return (
        shaped(sentences, "sentence", "phrase", F.col("old"), F.col("new"), none)
        .unionByName(shaped(ngrams, "ngram", "phrase", F.col("old"), F.col("new"), none))
        .unionByName(shaped(new.join(old, ["pair_id", "lower"]), "case", "lower", none, none, F.col("preferred")))
    )
