"""What goes to a reviewing model and what is made of its answer.

Calling the model is left to the user: prompts come out as a table and responses come
in as one (doc_id or pair_id, response).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from redpen.functions import fixed, text as t
from redpen.operators import structure
from redpen.operators.checks import _diagnostics, matching_phrases, usable_rewrites
from redpen.operators.lineage import settle
from redpen.operators.ordered import Total, running

# --- JSON in responses ------------------------------------------------------------------


def _json_in(text: str | None, objects_only: bool) -> str | None:
    """The JSON in a response: all of it, else a fenced part, else the first array."""
    whole = (text or "").strip()
    kinds = dict if objects_only else (list, dict)
    fenced = [m.group(1).strip() for m in re.finditer(fixed.FENCE, whole, re.IGNORECASE | re.DOTALL)]
    for candidate in [whole, *fenced]:
        try:
            value = json.loads(candidate)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, kinds):
            return json.dumps(value)
    if objects_only:
        return None
    reader = json.JSONDecoder()
    start = whole.find("[")
    while start != -1:
        try:
            return json.dumps(reader.raw_decode(whole, start)[0])
        except (ValueError, RecursionError):
            start = whole.find("[", start + 1)
    return None


@F.pandas_udf(T.StringType())
def _payload(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda s: None if s is None else _json_in(s, objects_only=False))


@F.pandas_udf(T.StringType())
def _object_payload(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda s: None if s is None else _json_in(s, objects_only=True))


def response_payload(response: Column, objects_only: bool = False) -> Column:
    """The JSON of a response as a variant, null if it has none.

    A response that is JSON as it stands is parsed natively; only the others go through Python.
    """
    whole = F.try_parse_json(t.strip(response))
    fits = _is("OBJECT", whole) if objects_only else _is("OBJECT", whole) | _is("ARRAY", whole)
    clean = F.coalesce(fits, F.lit(False))
    found = (_object_payload if objects_only else _payload)(F.when(~clean, response))
    return F.when(clean, whole).otherwise(F.try_parse_json(found))


def _is(kind: str, v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit(kind))


def _strings(payload: Column, path: str) -> Column:
    """Non-blank string items of an array in the payload, stripped."""
    items = F.filter(F.try_variant_get(payload, path, "array<variant>"), lambda v: _is("STRING", v))
    texts = F.transform(items, lambda v: t.strip(F.try_variant_get(v, "$", "string")))
    return F.filter(texts, lambda s: s != "")


# --- answers about one report ---------------------------------------------------------------


def grounded(message: Column, text: Column) -> Column:
    """False when a message proposes to replace wording the text does not have."""
    straight = t.straight_quotes(message)
    named = F.concat(*[F.regexp_extract_all(straight, F.lit(p), F.lit(1)) for p in fixed.GROUNDING])

    def judge(phrases: Column) -> Column:
        return (F.size(phrases) == 0) | F.exists(phrases, lambda p: F.contains(F.lower(text), F.lower(p)))

    stripped = F.filter(F.transform(named, t.strip), lambda p: p != "")
    nothing_to_test = (F.coalesce(message, F.lit("")) == "") | (F.coalesce(text, F.lit("")) == "")
    return nothing_to_test | F.coalesce(t.bind(stripped, judge), F.lit(True))


def counted_message(message: Column, text: Column, most: int | None = 4) -> Column:
    """Struct (message, max_count): wording complaints with counts of what they quote, ``most`` of them (None: all) in the message."""
    low = F.lower(message)
    about_wording = F.contains(low, F.lit("overused phrase")) | F.contains(low, F.lit("avoid")) | F.contains(low, F.lit("phrasing"))
    counts = F.filter(
        F.transform(t.quoted_phrases(message), lambda p: F.struct(p.alias("phrase"), t.phrase_count(text, p).alias("n"))),
        lambda c: c["n"] > 0,
    )

    def said(found: Column) -> Column:
        listed = F.array_join(
            F.transform(found if most is None else F.slice(found, 1, most), lambda c: F.format_string('"%s"=%dx', c["phrase"], c["n"])), ", "
        )
        relevant = about_wording & (F.size(found) > 0)
        extended = F.format_string("%s Counts in narrative: %s.", message, listed)
        return F.struct(
            F.when(relevant & ~F.contains(low, F.lit("counts:")), extended).otherwise(message).alias("message"),
            F.when(relevant, F.array_max(F.transform(found, lambda c: c["n"]))).otherwise(0).alias("max_count"),
        )

    return t.bind(counts, said)


def elevated(severity: Column, max_count: Column) -> Column:
    s = F.lower(F.coalesce(t.blank_to_null(severity), F.lit("suggestion")))
    return (
        F.when((s == "error") | (max_count >= 6), "error")
        .when((max_count >= 3) & (s == "suggestion"), "warning")
        .otherwise(s)
    )


def complains_of_repetition(message: Column) -> Column:
    low = F.lower(message)

    def has(*parts: str) -> Column:
        out = F.lit(True)
        for p in parts:
            out = out & F.contains(low, F.lit(p))
        return out

    kinds = has("overused phrase") | has("overused", "phras") | has("avoid using", "phrasing") | has("repetition", "phrase")
    return kinds & (F.size(t.quoted_phrases(message)) > 0)


def with_example(message: Column, text: Column, hint: Column, most_chars: int | None = fixed.EXAMPLE_CHARS) -> Column:
    """Vague complaints get the sentence they are most likely about, up to ``most_chars`` of it (None: whole)."""
    low = F.lower(message)
    vague = F.contains(low, F.lit("obvious")) | F.contains(low, F.lit("redundant"))
    shown = F.contains(low, F.lit("sentence:")) | F.contains(low, F.lit("excerpt:"))

    def add(sentence: Column) -> Column:
        flat = F.replace(t.strip(sentence), F.lit("\n"), F.lit(" "))
        cut = flat if most_chars is None else F.when(F.length(flat) > most_chars, F.concat(F.substring(flat, 1, most_chars - 3), F.lit("..."))).otherwise(flat)
        return F.when(sentence != "", F.concat(message, F.lit(' Example sentence: "'), cut, F.lit('"'))).otherwise(message)

    return F.when(
        vague & ~shown & (F.coalesce(text, F.lit("")) != ""), t.bind(t.supporting_sentence(text, message, hint), add)
    ).otherwise(message)


def parsed(responses: DataFrame, key: str) -> DataFrame:
    """key, payload (variant), issues (array of variant, null when there is no list)."""
    payload = responses.select(key, response_payload(F.col("response")).alias("payload"))
    issues = F.coalesce(
        F.try_variant_get("payload", "$", "array<variant>"), F.try_variant_get("payload", "$.issues", "array<variant>")
    )
    return payload.withColumn("issues", issues)


def issues(responses: DataFrame) -> DataFrame:
    """Issues as stated: doc_id, issue_no, severity, message, location_hint."""

    def field(name: str) -> Column:
        return F.coalesce(F.try_variant_get("issue", f"$.{name}", "string"), F.lit(fixed.REVIEW_DEFAULTS[name])).alias(name)

    stated = parsed(responses, "doc_id").select("doc_id", F.posexplode("issues").alias("issue_no", "issue"))
    return stated.filter(_is("OBJECT", F.col("issue"))).select(
        "doc_id", "issue_no", field("severity"), field("message"), field("location_hint")
    )


def review_diagnostics(responses: DataFrame, narratives: DataFrame) -> DataFrame:
    """Issues that hold up against the narrative, with counts, examples and severity."""
    stated = issues(responses)
    # a report's issues come to its narrative in one row; the narrative stays where it was put together
    asked = stated.groupBy("doc_id").agg(F.collect_list(F.struct("issue_no", "severity", "message", "location_hint")).alias("issues"))
    joined = narratives.select("doc_id", "narrative").join(asked, "doc_id").select("doc_id", "narrative", F.inline_outer("issues"))
    text, message = F.col("narrative"), F.col("message")
    kept = (
        joined.filter(grounded(message, text))
        .withColumn("counted", counted_message(message, text))
        .filter(~complains_of_repetition(message) | (F.col("counted.max_count") > 3))
    )
    return _diagnostics(
        kept, 17, elevated(F.col("severity"), F.col("counted.max_count")), fixed.REVIEW_CODE,
        with_example(F.col("counted.message"), text, F.col("location_hint")),
        pos=F.col("issue_no"), section=F.col("location_hint"), source="ai_review",
    )


def unparsed_responses(responses: DataFrame) -> DataFrame:
    severity, code, message = fixed.REVIEW_UNPARSED
    missing = parsed(responses, "doc_id").filter("issues is null")
    return _diagnostics(missing, 18, severity, code, F.lit(message), section="Narrative")


def rubric_scores(responses: DataFrame) -> DataFrame:
    """doc_id, axis, score 0 to 25, rating; only where the response gives scores."""
    scored = (
        parsed(responses, "doc_id")
        .select("doc_id", F.try_variant_get("payload", "$.rubric_scores", "variant").alias("scores"))
        .filter(_is("OBJECT", F.col("scores")))
    )
    axes = F.array(
        *[
            F.struct(
                F.lit(axis).alias("axis"),
                F.try_variant_get("scores", f"$.{axis}.score", "string").alias("stated"),
                F.try_variant_get("scores", f"$.{axis}.rating", "string").alias("rating"),
            )
            for axis in fixed.RUBRIC_AXES
        ]
    )
    whole = F.coalesce(
        F.when(F.col("stated").rlike(r"\A\s*[+-]?[0-9]+(?:\.[0-9]+)?\s*\z"), F.col("stated")).try_cast("double").cast("bigint"),
        F.lit(0),
    )
    score = F.greatest(F.lit(0), F.least(F.lit(25), whole)).cast("int")
    return scored.select("doc_id", F.inline(axes)).select(
        "doc_id", "axis", score.alias("score"),
        F.coalesce(t.blank_to_null(t.strip(F.col("rating"))), t.rubric_rating(score)).alias("rating"),
    )


# --- answers about one version pair ---------------------------------------------------------------


def _pair_payloads(responses: DataFrame) -> DataFrame:
    return responses.select("pair_id", response_payload(F.col("response"), objects_only=True).alias("payload")).filter("payload is not null")


def ai_phrase_votes(responses: DataFrame) -> DataFrame:
    said = _pair_payloads(responses).select(F.explode(_strings(F.col("payload"), "$.deprecated_phrases")).alias("phrase"))
    return said.groupBy(F.lower("phrase").alias("phrase")).agg(F.count("*").alias("votes"))


def ai_style_votes(responses: DataFrame) -> DataFrame:
    said = _pair_payloads(responses).select(F.explode(_strings(F.col("payload"), "$.style_rules")).alias("rule"))
    return said.groupBy("rule").agg(F.count("*").alias("votes"))


def ai_rewrite_votes(responses: DataFrame) -> DataFrame:
    """Usable rewrites with votes, wording and reason as first given."""
    items = _pair_payloads(responses).select(
        "pair_id", F.posexplode(F.try_variant_get("payload", "$.preferred_rewrites", "array<variant>")).alias("seq", "item")
    ).filter(_is("OBJECT", F.col("item")))

    def part(name: str) -> Column:
        return t.strip(F.coalesce(F.try_variant_get("item", f"$.{name}", "string"), F.lit("")))

    given = items.select(
        "pair_id", "seq", part("from").alias("from_text"), part("to").alias("to_text"), part("reason").alias("reason")
    )
    usable = given.filter(
        (F.col("from_text") != "") & (F.col("to_text") != "") & (F.col("from_text") != F.col("to_text"))
        & t.high_signal(F.col("from_text"), F.col("to_text"))
    )
    example = F.min_by(F.struct("from_text", "to_text", "reason"), F.struct("pair_id", "seq"))
    return (
        usable.groupBy(t.squash(F.col("from_text")).alias("from_key"), t.squash(F.col("to_text")).alias("to_key"))
        .agg(F.count("*").alias("votes"), example.alias("example"))
        .select("example.*", "votes")
    )


def with_enough_votes(votes: DataFrame, min_votes: int = 2) -> DataFrame:
    return votes.filter(F.col("votes") >= min_votes)


# --- prompts -----------------------------------------------------------------------------------------


def _head(lines: DataFrame, order: list[str], bucket: Column, separator: str, most_chars: int | None) -> DataFrame:
    """Each report's lines joined, by ``separator`` within one value of ``order[0]``; with ``most_chars`` only so many characters of them.

    With a limit, lines that start beyond it are dropped before anything is put together.
    """
    kept = lines
    if most_chars is not None:
        placed = running(lines, ["doc_id"], order, bucket, [Total("start", F.length("line") + 1, before=True)])
        kept = placed.filter(F.col("start") < most_chars)

    def joined(rows: Column) -> Column:
        def led(p: Column, i: Column) -> Column:
            goes_on = F.get(rows, i - 1)[order[0]] == p[order[0]]
            return F.concat(F.when(goes_on, separator).otherwise("\n"), p["line"])

        return F.array_join(F.transform(rows, led), "")

    together = kept.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*order, "line"))).alias("rows"))
    text = t.bind(F.col("rows"), joined)
    return together.select("doc_id", (F.substring(text, 2, most_chars) if most_chars is not None else F.substr(text, F.lit(2))).alias("head"))


def narratives(blocks: DataFrame, finding_fields: DataFrame, texts: DataFrame, most_chars: int | None = None) -> DataFrame:
    """The text to review: narrative sections, else findings' narratives, else the whole report.

    The text is whole; ``most_chars`` is for callers whose model takes no more (fixed.NARRATIVE_CHARS in the tool this follows).
    Fields may come as ``structure.field_stretches``: the lines of a narrative are then joined in their row before they travel.
    """
    sections = structure.section_text(blocks, "narrative")
    by_section = _head(
        sections, ["match_no", "block_no"], F.struct("match_no", F.floor(F.col("block_no") / 65536).alias("b")), "\n", most_chars
    )
    if "fields" in finding_fields.columns:
        def whole(own: Column) -> Column:
            line = F.array_join(F.transform(own, lambda f: f["line"]), " ")
            return F.when(F.size(own) > 0, F.array(F.struct(F.get(own, F.lit(0))["line_no"].alias("line_no"), line.alias("line"))))

        own = F.filter("fields", lambda f: f["field"] == "narrative")
        # findings of no report in ``texts`` need not travel
        held = finding_fields.select("doc_id", "finding_no", own.alias("own")).join(texts.select("doc_id"), "doc_id", "left_semi")
        fields = held.select("doc_id", "finding_no", F.inline_outer(t.bind(F.col("own"), whole))).filter("line is not null")
    else:
        fields = finding_fields.filter("field = 'narrative'")
    by_finding = _head(
        fields, ["finding_no", "line_no"], F.struct("finding_no", F.floor(F.col("line_no") / 65536).alias("b")), " ", most_chars
    )
    whole = F.col("text") if most_chars is None else F.substring("text", 1, most_chars)
    return (
        texts.select("doc_id", whole.alias("whole"))
        .join(by_section.withColumnRenamed("head", "a"), "doc_id", "left")
        .join(by_finding.withColumnRenamed("head", "b"), "doc_id", "left")
        .select("doc_id", F.coalesce(t.blank_to_null(F.col("a")), t.blank_to_null(F.col("b")), F.col("whole")).alias("narrative"))
        .filter("narrative <> ''")
    )


@dataclass(frozen=True)
class GuideSizes:
    """How many of each kind a guide names, best first; None: all.  Rewrites and phrases are ``considered`` before ignored ones are left out."""

    considered: int | None = 12
    rewrites: int | None = 8
    style_rules: int | None = 10


def _first(df: DataFrame, most: int | None, *order: str) -> DataFrame:
    return df if most is None else df.orderBy(*order).limit(most)


def _top_list(rules: DataFrame, value: Column, order: list[Column], most: int | None) -> DataFrame:
    """One row with the first ``most`` values in order, as an array: a guide goes into a prompt, so it is put together."""
    top = rules.select(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"), value.alias("value"))
    ordered = F.sort_array(F.collect_list(F.struct("o", "value")))
    return _first(top, most, "o", "value").agg(F.transform(ordered, lambda r: r["value"]).alias("top"))


def guidance(
    ngrams: DataFrame, ai_phrases: DataFrame, rewrites: DataFrame, style_rules: DataFrame,
    ignored_phrases: DataFrame | None = None, ignored_rewrites: DataFrame | None = None, rejected: DataFrame | None = None,
    sizes: GuideSizes = GuideSizes(),
) -> DataFrame:
    """One row: what past revisions teach, in the form prompts give it.

    ``ngrams``: phrase, old, new; ``ai_phrases``: phrase, votes; ``rewrites``: from_text,
    to_text, votes, priority (as merged); ``style_rules``: rule, votes.
    """

    def shown(top: DataFrame, template: str, separator: str, most: int | None = None) -> Column:
        values = F.slice("top", 1, most) if most else F.col("top")
        line = top.select(
            F.when(F.size("top") > 0, F.format_string(template, F.array_join(values, separator))).alias("line")
        )
        return line.scalar()

    def phrases(df: DataFrame, order: list[Column]) -> DataFrame:
        placed = df.select("phrase", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"))
        first = _first(placed, sizes.considered, "o", "phrase")
        if ignored_phrases is not None:
            first = settle(first)  # else what is counted for it is counted twice
            first = first.join(matching_phrases(first.select("phrase"), ignored_phrases), "phrase", "left_anti")
        return _top_list(first, F.col("phrase"), [F.col("o")], sizes.considered)

    usable = usable_rewrites(rewrites, ignored_rewrites, rejected)
    pairs = _top_list(
        usable, F.format_string('"%s" -> "%s"', "from_text", "to_text"), [F.col("priority"), -F.col("votes"), F.col("from_text")], sizes.considered
    )
    lines = [
        shown(phrases(ngrams, [F.col("new") - F.col("old"), -F.col("old")]), fixed.GUIDE_DEPRECATED, ", "),
        shown(phrases(ai_phrases, [-F.col("votes")]), fixed.GUIDE_AI_DEPRECATED, ", "),
        shown(pairs, fixed.GUIDE_REWRITES, "\n- ", sizes.rewrites),
        shown(_top_list(style_rules, F.col("rule"), [-F.col("votes")], sizes.style_rules), fixed.GUIDE_STYLE_RULES, "\n- "),
    ]
    one_row = ngrams.sparkSession.range(1)
    return one_row.select(F.concat_ws("\n", *lines).alias("guidance"))


def packed(texts: DataFrame, text: str, most_chars: int) -> DataFrame:
    """The whole ``text`` of each doc_id in numbered parts of at most ``most_chars`` characters: doc_id, part_no, n_parts, part.

    Parts end where lines end; only a longer line is cut.  Joined in order the parts are the text.
    """
    @F.arrow_udf("array<int>")
    def starts(lengths: pa.Array) -> pa.Array:
        out = []
        for row in lengths:
            used, own = 0, []
            for at, n in enumerate(row.as_py()):
                if not own or used + n > most_chars:
                    used = 0
                    own.append(at)
                used += n
            out.append(own)
        return pa.array(out, pa.list_(pa.int32()))

    # a line keeps its line feed; a long one is cut into pieces of the size
    lines = F.split(F.col(text), r"(?<=\n)", -1)
    pieces = F.flatten(F.transform(lines, lambda x: F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.length(x), F.lit(1)) - 1) / most_chars).cast("int")), lambda k: F.substring(x, k * most_chars + 1, F.lit(most_chars)))))
    split = texts.filter(F.col(text).isNotNull()).select("doc_id", F.filter(pieces, lambda x: x != "").alias("pieces"))
    # a text's parts are put together in its own row
    placed = split.withColumn("starts", starts(F.transform("pieces", F.length)))
    def part(start: Column, no: Column) -> Column:
        end = F.coalesce(F.get("starts", no + 1), F.size("pieces"))
        return F.array_join(F.slice("pieces", start + 1, end - start), "")

    # outer, as the filter that Spark derives from a plain one would hold the function
    parts = placed.select("doc_id", F.size("starts").alias("n_parts"), F.posexplode_outer(F.transform("starts", part)).alias("part_no", "part"))
    return parts.filter("part_no is not null").select("doc_id", "part_no", "n_parts", "part")


DEFAULT_RUBRIC = "Judge layout, wording, tone, information and structure."
DEFAULT_INSTRUCTIONS = (
    "Review this report narrative. Answer in JSON with issues (severity, message, location_hint) "
    "and rubric_scores (look, words, tone, information, structure; score 0 to 25 and rating each)."
)


def review_prompts(
    narratives: DataFrame, guidance: DataFrame, instructions: str = DEFAULT_INSTRUCTIONS, rubric: str = DEFAULT_RUBRIC, most_chars: int | None = None
) -> DataFrame:
    """One prompt per report; with ``most_chars`` as many as its narrative takes, each with so much of it: doc_id, part_no, n_parts, instructions, content."""
    learned = guidance.select("guidance").scalar()
    whole = narratives.select("doc_id", F.lit(0).alias("part_no"), F.lit(1).alias("n_parts"), F.col("narrative").alias("part"))
    parts = whole if most_chars is None else packed(narratives, "narrative", most_chars)
    content = F.format_string("Learned guidance:\n%s\n\nRubric guidance:\n%s\n\nText to review:\n%s", learned, F.lit(rubric), F.col("part"))
    return parts.select("doc_id", "part_no", "n_parts", F.lit(instructions).alias("instructions"), content.alias("content"))


def pair_prompts(samples: DataFrame, instructions: str) -> DataFrame:
    """One prompt per version pair over its first replaced, removed and added sentences."""

    def listed(kind: str, item: Column) -> Column:
        picked = F.collect_list(F.when(F.col("kind") == kind, F.struct("seq", item.alias("item"))))
        return F.transform(F.sort_array(picked), lambda p: p["item"])

    swap = F.struct(F.col("old_sentence").alias("from"), F.col("new_sentence").alias("to"))
    sample = F.to_json(
        F.struct(
            F.col("replaced").alias("replaced_pairs"), F.col("removed").alias("removed_sentences"), F.col("added").alias("added_sentences")
        )
    )
    return (
        samples.groupBy("pair_id")
        .agg(
            listed("replaced", swap).alias("replaced"),
            listed("removed", F.col("old_sentence")).alias("removed"),
            listed("added", F.col("new_sentence")).alias("added"),
        )
        .select("pair_id", F.concat_ws("\n", F.lit(instructions), sample).alias("content"))
    )
