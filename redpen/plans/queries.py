"""Registered queries: each operator over the derived report tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from redpen.functions import fixed, text as t
from redpen.operators import alignment, anchors, checks, feedback, learning, review, structure
from redpen.operators.lineage import settle, shared_folder
from redpen.operators.matching import phrase_hits
from redpen.plans import profile, refresh, scan
from redpen.plans.views import Views
from redpen.sources import configs, packages, rule_store, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: _wide_integers(build(Views(spark, sf_dir)))
    return build


def _wide_integers(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, the type SQL gives counts and positions."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if kind == "int" else F.col(c) for c, kind in df.dtypes])


def flat(diagnostics: DataFrame, *more: str) -> DataFrame:
    return diagnostics.select("doc_id", "severity", "code", "message", *more)


# --- sources and sinks ----------------------------------------------------------------


@query
def ingest_blocks(v: Views) -> DataFrame:
    blocks = packages.blocks(packages.read_packages(v.packages(), "block"))
    return blocks.select("doc_id", "block_no", "type", "text", "style_name", "heading_level")


@query
def ingest_layout(v: Views) -> DataFrame:
    parts = settle(packages.read_packages(v.packages(), "layout_paragraph", "layout_table", "layout_image"))
    return packages.layout_snapshot(packages.layout_paragraphs(parts), packages.layout_tables(parts), packages.layout_images(parts))


@query
def ingest_breaks(v: Views) -> DataFrame:
    return packages.breaks(packages.read_packages(v.packages(), "paragraph"))


@query
def ingest_comments(v: Views) -> DataFrame:
    return packages.comments(packages.read_packages(v.packages(), "comment"))


@query
def ingest_tracked(v: Views) -> DataFrame:
    return packages.tracked(packages.read_packages(v.packages(), "tracked"))


@query
def layout_snapshot(v: Views) -> DataFrame:
    layout = v.layout()
    return packages.layout_snapshot(layout, layout, packages.image_shapes(layout))


@query
def tracked_pairs(v: Views) -> DataFrame:
    return learning.tracked_replacements(v.tracked())


@query
def config_rules(v: Views) -> DataFrame:
    files = v.configs()
    return (
        configs.ignore_rules(files).select("doc_id", "kind", "pos", F.col("value").alias("a"), F.lit("").alias("b"))
        .unionByName(configs.feedback_rewrites(files).select("doc_id", F.concat(F.lit("rewrite_"), "decision").alias("kind"), "pos", F.col("from_text").alias("a"), F.col("to_text").alias("b")))
        .unionByName(configs.feedback_diagnostics(files).select("doc_id", F.concat(F.lit("diagnostic_"), "decision").alias("kind"), "pos", F.col("code").alias("a"), F.col("message_contains").alias("b")))
    )


@query
def scan_report(v: Views) -> DataFrame:
    found = scan.scan(
        scan.Reports(blocks=v.blocks(), breaks=v.breaks(), texts=v.secrets(), findings=v.findings(), finding_lines=v.finding_stretches()),
        rules=v.diagnostic_rules(), min_len=10,
    )
    return sinks.in_order(found).select("doc_id", "seq", "severity", "code", "message")


# --- structure --------------------------------------------------------------------------


@query
def heading_levels(v: Views) -> DataFrame:
    return v.blocks().select("doc_id", "block_no", t.heading_level(F.col("style_name")).alias("heading_level"))


@query
def sections(v: Views) -> DataFrame:
    return structure.sections(v.blocks()).select("doc_id", "section_no", "parent_no", "level", "title")


@query
def section_depth(v: Views) -> DataFrame:
    return structure.sections(v.blocks()).select("doc_id", "section_no", "depth")


@query
def deep_sections(v: Views) -> DataFrame:
    """Sections of 40 levels with all sections above them."""
    return structure.sections(v.deep_blocks()).select("doc_id", "section_no", "level", F.array_join("ancestors", ">").alias("path"))


@query
def section_text(v: Views) -> DataFrame:
    return structure.section_text(v.blocks(), "on")


@query
def findings(v: Views) -> DataFrame:
    return structure.finding_outline(v.finding_block_stretches()).select("doc_id", "finding_no", "title", "threat_text", "cvss_text", "n_lines")


@query
def table_values(v: Views) -> DataFrame:
    tables = v.finding_blocks().filter("type = 'tbl'")
    return tables.select(
        "doc_id", "block_no",
        t.table_value(F.col("rows"), "threat level").alias("threat_text"),
        t.table_value(F.col("rows"), "CVSS").alias("cvss_text"),
        t.table_value(F.col("rows"), "Owner").alias("owner"),
    )


@query
def finding_fields(v: Views) -> DataFrame:
    return structure.finding_fields(v.finding_stretches()).select("finding_no", "field", "line_no", "line")


@query
def implicit_evidence(v: Views) -> DataFrame:
    return v.finding_lines().groupBy("finding_no").agg(F.bool_or(t.shows_evidence(F.col("line"))).alias("has_evidence"))


@query
def threat_level(v: Views) -> DataFrame:
    stated = F.concat(
        F.when(F.col("finding_no") % 3 == 0, "low risk, threat  level = ").when(F.col("finding_no") % 3 == 1, "rated ").otherwise("threat-"),
        F.lower("threat_text"), F.lit(" as of now"),
    )
    return v.findings().select("finding_no", t.threat_level(stated).alias("threat"), t.threat_level(F.col("title")).alias("none"))


@query
def severity(v: Views) -> DataFrame:
    return v.findings().select("finding_no", t.severity(F.concat_ws(" ", "title", "threat_text")).alias("severity"))


@query
def cvss_score(v: Views) -> DataFrame:
    return v.findings().select("finding_no", t.cvss_score(F.col("cvss_text")).alias("score"))


@query
def cvss_band(v: Views) -> DataFrame:
    return v.findings().select("finding_no", t.cvss_band(t.cvss_score(F.col("cvss_text"))).alias("band"))


# --- text functions -------------------------------------------------------------------------


@query
def sentences(v: Views) -> DataFrame:
    return v.secrets().select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("sentence_no", "sentence"))


@query
def normalized_sentences(v: Views) -> DataFrame:
    return sentences(v).select("doc_id", "sentence_no", t.bare_sentence(F.col("sentence")).alias("bare"), t.squash(F.col("sentence")).alias("squashed"))


@query
def url_or_ip(v: Views) -> DataFrame:
    return sentences(v).select("doc_id", "sentence_no", t.has_url_or_ip(F.col("sentence")).alias("found"))


@query
def rewrite_tokens(v: Views) -> DataFrame:
    return v.paras().select("doc_id", "para_no", F.array_join(t.rewrite_tokens(F.col("text")), " ").alias("tokens"))


@query
def high_signal(v: Views) -> DataFrame:
    return v.rewrite_rules().select("from_text", "to_text", t.high_signal(F.col("from_text"), F.col("to_text")).alias("high"))


@query
def ngram_counts(v: Views) -> DataFrame:
    texts = v.texts().select("text")
    return learning.dealt_ngrams(texts, learning.tasks_for(texts)).groupBy("key", "phrase").agg(F.count("*").alias("n")).drop("key")


@query
def quoted_phrases(v: Views) -> DataFrame:
    quotes = t.quoted_phrases(F.concat_ws(" ", "text", F.lit("'one thing' “One  Thing” ‘two’")))
    return v.comments().select("doc_id", "seq", F.posexplode(quotes).alias("nth", "phrase"))


@query
def phrase_counts(v: Views) -> DataFrame:
    lowered = v.texts().select("doc_id", F.lower("text").alias("text"))
    return phrase_hits(lowered, v.phrases(), ["doc_id"]).select("doc_id", "phrase", "n")


@query
def overlap_tokens(v: Views) -> DataFrame:
    return v.paras().select("doc_id", "para_no", F.array_join(F.sort_array(t.overlap_tokens(F.col("text"))), " ").alias("tokens"))


@query
def supporting_sentence(v: Views) -> DataFrame:
    message = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('About "'), F.replace(F.substring("text", 40, 8), F.lit('"'), F.lit(" ")), F.lit('" here'))).otherwise(
        F.concat(F.lit("about "), F.substring("text", 60, 60))
    )
    return v.texts().select("doc_id", t.supporting_sentence(F.col("text"), message, F.lit("Narrative")).alias("sentence"))


@query
def phrase_matches(v: Views) -> DataFrame:
    return checks.matching_phrases(v.paras().select(F.col("text").alias("phrase")), v.phrases())


@query
def llm_payload(v: Views) -> DataFrame:
    return review.parsed(v.responses(), "doc_id").select(
        "doc_id", F.col("payload").isNotNull().alias("has_payload"), F.size("issues").alias("n_issues")
    )


@query
def rubric_rating(v: Views) -> DataFrame:
    score = F.when(F.col("doc_id") % 9 == 0, "x").otherwise((F.col("doc_id") % 27).cast("string"))
    return v.raw("documents").select("doc_id", t.rubric_rating(score).alias("rating"))


# --- checks ------------------------------------------------------------------------------------


@query
def check_blank_pages(v: Views) -> DataFrame:
    return flat(checks.blank_pages(v.breaks()))


@query
def check_index_headings(v: Views) -> DataFrame:
    return flat(checks.index_headings(v.blocks()), "loc_text")


@query
def check_repetition(v: Views) -> DataFrame:
    return flat(checks.repetition(v.blocks(), min_len=10))


@query
def check_sensitive(v: Views) -> DataFrame:
    return flat(checks.sensitive(v.secrets()), "evidence")


@query
def check_hygiene(v: Views) -> DataFrame:
    blocks = v.secrets().select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text"), F.lit("p").alias("type"))
    return flat(checks.hygiene(blocks), "loc_text")


@query
def check_deprecated_ngrams(v: Views) -> DataFrame:
    ignored = v.phrases().filter("phrase = 'les'")
    return flat(checks.deprecated_phrases(v.texts(), v.phrases(), ignored))


@query
def check_deprecated_ai(v: Views) -> DataFrame:
    return flat(checks.deprecated_phrases(v.texts(), v.phrases().select(F.initcap("phrase").alias("phrase")), from_ai=True))


@query
def check_case(v: Views) -> DataFrame:
    return flat(checks.preferred_case(v.texts(), v.phrases().select(F.col("phrase").alias("lower"), F.initcap("phrase").alias("preferred"))))


@query
def check_rewrites(v: Views) -> DataFrame:
    return flat(checks.preferred_rewrites(v.texts(), v.rewrite_rules(), ignored=v.phrases().filter("phrase = 'und'")), "loc_text")


@query
def check_paragraph_styles(v: Views) -> DataFrame:
    layout = v.layout()
    return flat(checks.paragraph_styles(layout, learning.usual_values(layout, "style_id", 0.03)))


@query
def check_table_columns(v: Views) -> DataFrame:
    layout = v.layout()
    return flat(checks.table_columns(layout, learning.usual_values(layout, "columns", 0.2)))


@query
def check_image_widths(v: Views) -> DataFrame:
    images = packages.image_shapes(v.layout())
    return flat(checks.image_widths(images, learning.usual_range(images, "width_emu")))


def _facts(v: Views) -> DataFrame:
    return structure.finding_facts(v.findings(), v.finding_stretches())


@query
def check_finding_structure(v: Views) -> DataFrame:
    return flat(checks.finding_structure(_facts(v)), "loc_finding")


@query
def check_finding_quality(v: Views) -> DataFrame:
    return flat(checks.finding_quality(_facts(v)), "loc_finding")


@query
def check_finding_repetition(v: Views) -> DataFrame:
    fields = structure.field_stretches(v.finding_stretches())
    return flat(checks.finding_repetition(v.findings(), fields, min_len=8, min_count=2), "loc_finding")


@query
def check_cvss_consistency(v: Views) -> DataFrame:
    return flat(checks.cvss_consistency(_facts(v)), "loc_finding")


@query
def suppress_diagnostics(v: Views) -> DataFrame:
    return checks.suppress(v.diagnostics(), v.diagnostic_rules()).select("doc_id", "seq", "code", "message")


# --- learning ------------------------------------------------------------------------------------


def _pairs(v: Views) -> DataFrame:
    return learning.version_pairs(v.versions())


@query
def report_versions(v: Views) -> DataFrame:
    return learning.report_versions(v.versions().select("doc_id", "file_name"))


@query
def pairs_consecutive(v: Views) -> DataFrame:
    return _pairs(v)


@query
def pairs_latest(v: Views) -> DataFrame:
    return learning.version_pairs(v.versions(), "latest")


@query
def deprecated_sentences(v: Views) -> DataFrame:
    return learning.drops(learning.sentence_counts(v.texts(), _pairs(v)), min_drop=1, min_len=20)


@query
def deprecated_ngrams(v: Views) -> DataFrame:
    return learning.drops(learning.ngram_counts(v.texts(), _pairs(v)), min_drop=4)


@query
def case_normalization(v: Views) -> DataFrame:
    return learning.case_rules(learning.case_votes(v.versions_case(), _pairs(v))).select("lower", "preferred", "votes")


@query
def aligned_rewrites(v: Views) -> DataFrame:
    return learning.rewrite_rules(learning.rewrite_votes(alignment.sentence_changes(v.texts(), _pairs(v))), min_votes=1)


@query
def change_samples(v: Views) -> DataFrame:
    return learning.change_samples(alignment.sentence_changes(v.texts(), _pairs(v)))


@query
def tracked_signals(v: Views) -> DataFrame:
    tracked, pairs = v.tracked(), _pairs(v)
    sentences = learning.sentence_counts(v.texts(), pairs, tracked).select(F.lit("sentence").alias("kind"), F.col("phrase").alias("a"), F.lit("").alias("b"), "old", "new")
    ngrams = learning.ngram_counts(v.texts(), pairs, tracked).select(F.lit("ngram").alias("kind"), F.col("phrase").alias("a"), F.lit("").alias("b"), "old", "new")
    rewrites = learning.tracked_votes(tracked, pairs).groupBy("from_key", "to_key").agg(F.sum("votes").alias("votes"))
    return sentences.unionByName(ngrams).unionByName(
        rewrites.select(F.lit("rewrite").alias("kind"), F.col("from_key").alias("a"), F.col("to_key").alias("b"), F.lit(0).alias("old"), F.col("votes").alias("new"))
    )


@query
def ai_votes(v: Views) -> DataFrame:
    responses = v.pair_responses()
    phrases = review.with_enough_votes(review.ai_phrase_votes(responses)).select(F.lit("phrase").alias("kind"), F.col("phrase").alias("a"), F.lit("").alias("b"), "votes")
    rules = review.with_enough_votes(review.ai_style_votes(responses)).select(F.lit("rule").alias("kind"), F.col("rule").alias("a"), F.lit("").alias("b"), "votes")
    rewrites = review.with_enough_votes(review.ai_rewrite_votes(responses)).select(F.lit("rewrite").alias("kind"), F.col("from_text").alias("a"), F.col("to_text").alias("b"), "votes")
    return phrases.unionByName(rules).unionByName(rewrites)


def _learned_rewrites(v: Views) -> DataFrame:
    """Tracked replacements as learned rules."""
    return learning.rewrite_rules(learning.tracked_votes(v.tracked(), _pairs(v)), min_votes=2)


@query
def preferred_rewrites(v: Views) -> DataFrame:
    return learning.merge_rewrite_rules(_learned_rewrites(v), v.rewrite_rules())


@query
def format_rules_styles(v: Views) -> DataFrame:
    layout = v.layout()
    kinds = [("style", "style_id", 0.03), ("alignment", "alignment", 0.03), ("columns", "columns", 0.2)]
    parts = [
        learning.usual_values(layout, column, share).select(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("value"), "n", "share")
        for kind, column, share in kinds
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def format_rules_images(v: Views) -> DataFrame:
    images = packages.image_shapes(v.layout())
    widths = learning.usual_range(images, "width_emu")
    aspects = learning.usual_range(images, "aspect")

    def typed(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), *[F.col(c).cast("double").alias(c) for c in ("low", "median", "high")], "samples")

    return typed(widths, "width_emu").unionByName(typed(aspects, "aspect"))


@query
def change_profile(v: Views) -> DataFrame:
    return learning.change_profile(v.texts(), v.versions_case(), _pairs(v), min_drop=1)


@query
def incremental_refresh(v: Views) -> DataFrame:
    pairs, state = refresh.example_state(v, _pairs(v))
    found = refresh.examined(pairs, state, refresh.fingerprint(), refresh.hashed_rows(refresh.example_files(v)))
    return found.select("pair_id", "status")


@query
def refreshed_totals(v: Views) -> DataFrame:
    """Sentence totals after two refreshes: between them reports changed, and pairs came and went."""
    folder, pairs, files = shared_folder(v.spark, "refresh"), _pairs(v), refresh.example_files(v)
    changed = F.col("doc_id") % 3 == 0
    drafts = v.texts().withColumn("text", F.when(changed, F.concat(F.lit("First draft. "), F.substring("text", 1, 500))).otherwise(F.col("text")))
    earlier = files.withColumns({"size": F.when(changed, 1).otherwise(F.col("size")), "content": F.when(changed, F.lit(b"draft")).otherwise(F.col("content"))})
    missing = pairs.filter("old_doc % 4 <> 1").unionByName(pairs.filter("old_doc % 4 = 2").withColumn("pair_id", F.concat("pair_id", F.lit(" gone"))))
    for now, listed, texts in ((missing, earlier, drafts), (pairs, files, v.texts())):
        count = {"sentences": lambda todo, texts=texts: learning.sentence_counts(texts, todo, per_pair=True)}
        refresh.refresh(v.spark, folder, refresh.pair_stats(now, listed), refresh.hashed_rows(listed), count)
    return refresh.totals(v.spark, folder, "sentences")


def _evidence(v: Views) -> profile.Evidence:
    layout = v.layout()
    return profile.Evidence(
        docs=v.texts(), paragraphs=v.versions_case(), pairs=settle(_pairs(v)), tracked=v.tracked(), layout_paragraphs=layout, layout_tables=layout,
        layout_images=packages.image_shapes(layout), responses=v.pair_responses(),
    )


@query
def learned_profile(v: Views) -> DataFrame:
    """Every kind of rule, written and read again."""
    path = shared_folder(v.spark, "profile")
    sinks.write_profile(profile.rules(profile.learn(_evidence(v))), path)
    return sinks.read_profile(v.spark, path)


@query
def profile_scan(v: Views) -> DataFrame:
    """All 18 checks of a scan with the learned profile; results written per report and read again."""
    rules = profile.for_scan(learned_profile(v), v.rewrite_rules(), ignored_phrases=v.phrases().filter("phrase = 'und'"))
    layout = v.layout()
    reports = scan.Reports(
        blocks=v.blocks(), breaks=v.breaks(), texts=v.secrets(), findings=v.findings(), finding_lines=v.finding_stretches(), layout_paragraphs=layout,
        layout_tables=layout, layout_images=packages.image_shapes(layout), responses=v.responses(),
    )
    found = sinks.in_order(scan.scan(reports, rules, v.diagnostic_rules(), min_len=10))
    path = shared_folder(v.spark, "results")
    ids = [df.select("doc_id") for df in (v.raw("documents"), layout, v.findings())]
    named = ids[0].unionByName(ids[1]).unionByName(ids[2]).distinct().withColumn("file_name", F.format_string("Report %d", "doc_id"))
    sinks.write_scan_results(sinks.scan_results(found, v.findings(), named, rows_per_part=1000), path, "parquet")
    results = v.spark.read.parquet(path)
    return results.select("doc_id", F.inline("diagnostics")).select("doc_id", "severity", "code", "message")


# --- feedback and annotation ------------------------------------------------------------------------


@query
def comment_decisions(v: Views) -> DataFrame:
    return v.comments().select("doc_id", "seq", feedback.decision(F.col("text")).alias("decision"))


@query
def comment_rewrites(v: Views) -> DataFrame:
    return v.comments().select("doc_id", "seq", feedback.rewrite_pair(F.col("text")).alias("pair")).filter("pair is not null").select("doc_id", "seq", "pair.*")


@query
def comment_diag_rules(v: Views) -> DataFrame:
    return v.comments().select("doc_id", "seq", feedback.diagnostic_rule(F.col("text")).alias("rule")).filter("rule is not null").select("doc_id", "seq", "rule.*")


@query
def resolve_feedback(v: Views) -> DataFrame:
    return feedback.resolve_decisions(v.comments(), "qa-bot").select("doc_id", "seq", "decision", F.col("rule.code").alias("code"))


@query
def merge_feedback(v: Views) -> DataFrame:
    resolved = settle(feedback.resolve_decisions(v.comments(), "qa-bot"))
    # What half of the reviewed reports said is already known, in other spacing.
    reviewed = feedback.reviewed_rewrites(resolved)
    known = reviewed.select("decision", F.replace("from_text", F.lit(" "), F.lit("  ")).alias("from_text"), F.concat(F.lit(" "), "to_text").alias("to_text"), (F.col("doc_id") % 2 == 0).alias("known"))
    existing = known.filter("known").drop("known").distinct()
    merged = feedback.merge_rewrites(existing, reviewed)
    rules = feedback.merge_diagnostics(
        v.diagnostic_rules().filter("decision <> 'ignore'"), feedback.reviewed_diagnostics(resolved)
    )
    return feedback.feedback_counts(merged, rules)


@query
def stored_feedback(v: Views) -> DataFrame:
    """Rules stored by two upserts, the second over comments of which the first had half."""
    folder = shared_folder(v.spark, "rules")
    resolved = settle(feedback.resolve_decisions(v.comments(), "qa-bot"))
    for part in (resolved.filter("doc_id % 2 = 0"), resolved):
        rule_store.upsert(v.spark, folder, part)
    return rule_store.stored(v.spark, folder).select("kind", "decision", F.when(F.col("kind") == "rewrite", t.squash(F.col("a"))).otherwise(F.col("a")).alias("a"), t.squash(F.col("b")).alias("b"))


@query
def resolve_anchors(v: Views) -> DataFrame:
    return anchors.resolve_anchors(v.diagnostics(), v.paras())


@query
def section_hints(v: Views) -> DataFrame:
    return v.diagnostics().select("doc_id", "seq", F.posexplode(anchors.section_hints(F.col("loc_section"))).alias("nth", "hint"))


@query
def comment_rows(v: Views) -> DataFrame:
    diagnostics = v.diagnostics()
    found = anchors.resolve_anchors(diagnostics, v.paras())
    return anchors.comment_rows(diagnostics, found, v.comments(), "qa-bot")


# --- review --------------------------------------------------------------------------------------------


def _narratives(v: Views) -> DataFrame:
    return review.narratives(v.blocks(), structure.field_stretches(v.finding_stretches()), v.texts())


@query
def narratives(v: Views) -> DataFrame:
    return _narratives(v)


@query
def review_prompts(v: Views) -> DataFrame:
    pairs = _pairs(v)
    ngrams = learning.drops(learning.ngram_counts(v.texts(), pairs), 4)
    accepted = v.rewrite_rules()
    learned = _learned_rewrites(v)
    responses = v.pair_responses()
    guide = review.guidance(
        ngrams, review.with_enough_votes(review.ai_phrase_votes(responses)), learning.merge_rewrite_rules(learned, accepted),
        review.with_enough_votes(review.ai_style_votes(responses)), ignored_phrases=v.phrases().filter("phrase = 'und'"),
    )
    return review.review_prompts(_narratives(v), guide).select("doc_id", "content")


@query
def packed_narratives(v: Views) -> DataFrame:
    """Narratives cut into parts of 700 characters at most, and put together again."""
    parts = review.packed(_narratives(v), "narrative", 700)
    ordered = F.sort_array(F.collect_list(F.struct("part_no", "part")))
    complete = (F.count("*") == F.max("n_parts")) & (F.max(F.length("part")) <= 700)
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["part"]), "").alias("narrative"), complete.alias("complete"))


@query
def llm_issues(v: Views) -> DataFrame:
    return flat(review.review_diagnostics(v.responses(), _narratives(v)), "loc_section", "source")


@query
def llm_parse_failures(v: Views) -> DataFrame:
    return flat(review.unparsed_responses(v.responses()), "loc_section")


def _messages(v: Views) -> DataFrame:
    """Two model messages per document, about wording it has or lacks."""
    word = F.when(F.col("lang") == "en", "the").when(F.col("lang") == "fr", "les").when(F.col("lang") == "de", "und").otherwise("que")
    messages = F.array(
        F.concat(F.lit("Avoid using '"), word, F.lit("' and \"zzqq\" phrasing")),
        F.concat(F.lit("Use “x” instead of ‘"), F.when(F.col("doc_id") % 2 == 0, word).otherwise("zzqq"), F.lit("’ here")),
    )
    return v.raw("documents").select("doc_id", "text", F.posexplode(messages).alias("nth", "message"))


@query
def llm_grounding(v: Views) -> DataFrame:
    return _messages(v).select("doc_id", "nth", review.grounded(F.col("message"), F.col("text")).alias("grounded"))


@query
def llm_counts(v: Views) -> DataFrame:
    return _messages(v).select("doc_id", "nth", review.counted_message(F.col("message"), F.col("text")).alias("c")).select("doc_id", "nth", "c.*")


@query
def llm_severity(v: Views) -> DataFrame:
    counted = review.counted_message(F.col("message"), F.col("text"))["max_count"]
    stated: Column = F.when(F.col("nth") == 0, "Suggestion").when(F.col("doc_id") % 2 == 0, "warning").otherwise("error")
    return _messages(v).select("doc_id", "nth", review.elevated(stated, counted).alias("severity"))


@query
def llm_examples(v: Views) -> DataFrame:
    message = F.concat(F.lit("Stating the obvious: "), F.substring("text", 30, 40))
    return v.texts().select("doc_id", review.with_example(message, F.col("text"), F.lit("Narrative")).alias("message"))


@query
def rubric_scores(v: Views) -> DataFrame:
    return review.rubric_scores(v.responses())
