"""Sections, findings and finding fields of every report, from its ordered blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from redpen.functions import fixed, text as t
from redpen.operators.lineage import settle
from redpen.operators.matching import among
from redpen.operators.ordered import Latest, Total, enclosing, numbered, position_bucket, running


def section_blocks(blocks: DataFrame) -> DataFrame:
    """Paragraph blocks with the number of the section they are in; 0 precedes the first heading."""
    paragraphs = blocks.filter("type = 'p'").select("doc_id", "block_no", "text", "heading_level")
    marked = paragraphs.withColumn("level", F.nullif("heading_level", F.lit(0)))
    starts = F.col("level").isNotNull().cast("bigint")
    return running(marked, ["doc_id"], ["block_no"], position_bucket("block_no"), [Total("section_no", starts)])


def sections(blocks: DataFrame) -> DataFrame:
    """One row per section, with the section numbers above it, outermost first.

    Section numbers follow reading order, which is also the depth-first order of the tree.  Headings
    may have any level; one is inside the nearest earlier section of a smaller level.
    """
    # only headings take their text along
    placed = section_blocks(blocks.withColumn("text", F.when(F.nullif("heading_level", F.lit(0)).isNotNull(), F.col("text"))))
    headings = placed.filter("level is not null").select(
        "doc_id", "section_no", F.col("level").cast("int").alias("level"), F.col("text").alias("title")
    )
    preamble = (
        placed.filter("section_no = 0")
        .select("doc_id", "section_no")
        .distinct()
        .select("doc_id", "section_no", F.lit(0).alias("level"), F.lit("Preamble").alias("title"))
    )
    seen = enclosing(headings.unionByName(preamble), ["doc_id"], "section_no", "level", "ancestors")
    return seen.select(
        "doc_id",
        "section_no",
        F.get(F.reverse("ancestors"), F.lit(0)).alias("parent_no"),
        "level",
        "title",
        F.size("ancestors").alias("depth"),
        "ancestors",
    )


def section_text(blocks: DataFrame, keyword: str) -> DataFrame:
    """Lines of each section whose title holds ``keyword``, down to its grandchildren.

    A line is repeated for every matching section it belongs to.  Joined by newline in
    (match_no, block_no) order the lines are the section's text.
    """
    named = F.coalesce(F.contains(F.lower("title"), F.lit(keyword.lower())), F.lit(False))
    tree = settle(sections(blocks).select("doc_id", "section_no", "ancestors", named.alias("named")))
    reach = tree.select(
        "doc_id",
        "section_no",
        F.explode(F.array_append(F.slice("ancestors", F.greatest(F.size("ancestors") - 1, F.lit(1)), F.lit(2)),
                                 F.col("section_no"))).alias("match_no"),
    )
    named = tree.filter("named").select("doc_id", F.col("section_no").alias("match_no"))
    # paragraphs are numbered where a title matches only
    asked = among(blocks, "doc_id", named.select("doc_id"))
    lines = section_blocks(asked).select("doc_id", "section_no", "block_no", "text", "level")
    return (
        reach.join(named, ["doc_id", "match_no"])
        .join(lines, ["doc_id", "section_no"])
        .filter("level is null or section_no <> match_no")
        .select("doc_id", "match_no", "section_no", "block_no", F.col("text").alias("line"))
    )


def finding_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with the number of the finding they are in and the paragraph before them."""
    text = t.blank_to_null(t.strip(F.col("text")))
    marked = blocks.select(
        "doc_id", "block_no", "type", "text", "rows",
        ((F.col("type") == "tbl") & t.opens_finding(F.col("rows"))).alias("opens"),
    )
    return running(
        marked,
        ["doc_id"],
        ["block_no"],
        position_bucket("block_no"),
        [
            Total("finding_no", F.col("opens").cast("bigint")),
            Latest("paragraph_before", F.when(F.col("type") == "p", text), before=True),
        ],
    )


def findings(blocks: DataFrame) -> DataFrame:
    return finding_blocks(blocks).filter("opens").select(
        "doc_id",
        "finding_no",
        F.coalesce("paragraph_before", F.lit("Untitled Finding")).alias("title"),
        t.table_value(F.col("rows"), "Threat Level").alias("threat_text"),
        t.table_value(F.col("rows"), "CVSS").alias("cvss_text"),
    )


def finding_outline(blocks: DataFrame) -> DataFrame:
    """``findings`` with ``n_lines``, the number of paragraphs of each.

    Blocks may come as stretches: doc_id, blocks (array of block_no, type, text, rows, in order).  A stretch is cut at the
    tables in it that open findings, in its row; of each piece its last wording and its number of paragraphs travel, not its lines.
    """
    if "blocks" not in blocks.columns:
        blocks = blocks.select("doc_id", F.array(F.struct("block_no", "type", "text", "rows")).alias("blocks"))

    def piece(b: Column, at: Column, end: Column) -> Column:
        def told(paragraphs: Column) -> Column:
            def worded(some: Column) -> Column:
                return F.try_element_at(F.filter(F.transform(some, lambda p: t.strip(p["text"])), lambda w: w != ""), F.lit(-1))

            rows = F.get(b, at)["rows"]  # none before the first table
            return F.struct(
                F.get(b, F.greatest(at, F.lit(0)))["block_no"].alias("block_no"), (at >= 0).alias("opens"),
                t.table_value(rows, "Threat Level").alias("threat_text"), t.table_value(rows, "CVSS").alias("cvss_text"),
                F.size(paragraphs).alias("lines"),
                # nearly always the last one says something
                F.coalesce(worded(F.slice(paragraphs, F.greatest(F.size(paragraphs), F.lit(1)), F.lit(1))), worded(paragraphs)).alias("last"),
            )

        return t.bind(F.filter(F.slice(b, at + 2, end - at - 1), lambda x: x["type"] == "p"), told)

    def pieces(b: Column) -> Column:
        opening = F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda i: (F.get(b, i)["type"] == "tbl") & t.opens_finding(F.get(b, i)["rows"]))
        cut = F.concat(F.array(F.lit(-1)), opening)
        return t.bind(cut, lambda at: F.transform(at, lambda a, nth: piece(b, a, F.coalesce(F.get(at, nth + 1), F.size(b)))))

    # outer, as the filter that Spark derives from a plain one would cut the stretches once more; settled, as the running values read it twice
    cut = blocks.filter("size(blocks) > 0").select("doc_id", F.inline_outer(pieces(F.col("blocks"))))
    marked = settle(cut.filter("opens or lines > 0"))
    placed = running(
        marked,
        ["doc_id"],
        ["block_no"],
        position_bucket("block_no"),
        [Total("finding_no", F.col("opens").cast("bigint")), Latest("paragraph_before", F.col("last"), before=True)],
    )
    opened = F.when(F.col("opens"), F.struct(F.coalesce("paragraph_before", F.lit("Untitled Finding")).alias("title"), "threat_text", "cvss_text"))
    whole = placed.filter("finding_no > 0").groupBy("doc_id", "finding_no").agg(F.min(opened).alias("f"), F.sum("lines").alias("n_lines"))
    return whole.select("doc_id", "finding_no", "f.*", "n_lines")


def finding_lines(blocks: DataFrame) -> DataFrame:
    """Paragraphs from a finding's table to the next one, the next one's title included."""
    return (
        finding_blocks(blocks)
        .filter("finding_no > 0 and type = 'p'")
        .select("doc_id", "finding_no", F.col("block_no").alias("line_no"), F.col("text").alias("line"))
    )


#: Positions whose lines make one stretch.
STRETCH_LINES = 1024
#: Up to this many findings are sent to the lines; more of them meet by shuffle.
FEW_FINDINGS = 200_000


def stretches(lines: DataFrame) -> DataFrame:
    """Lines as stretches: doc_id, finding_no, stretch, alone, lines (array of line_no, line, in order).

    A stretch holds the lines of STRETCH_LINES positions; ``alone`` says that its finding has no other, false that it may.
    Lines that come as stretches stay as they are: what is asked of one finding is then answered in the row, and no text is moved.
    """
    if "lines" in lines.columns:
        return lines
    entries = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    stretch = position_bucket("line_no", STRETCH_LINES).alias("stretch")
    return lines.groupBy("doc_id", "finding_no", stretch).agg(entries.alias("lines")).withColumn("alone", F.lit(False))


def long_lines(lines: DataFrame) -> DataFrame:
    """Stretches as one row per line."""
    return lines.select("doc_id", "finding_no", F.inline("lines")) if "lines" in lines.columns else lines


def field_stretches(lines: DataFrame) -> DataFrame:
    """``stretches`` with fields: the non-blank lines under a known ``Label:`` (array of field, line_no, line, in order); an unknown label ends the field."""
    keys = ["doc_id", "finding_no"]

    def marks(lines: Column) -> Column:
        def switch(line: Column, at: Column) -> Column:
            # only lines that end in a colon can be labels
            return F.struct(at.alias("at"), F.when(F.contains(line["line"], F.lit(":")), t.label_of(line["line"])).alias("label"))

        labels = F.filter(F.transform(lines, switch), lambda m: m["label"].isNotNull())
        return F.transform(labels, lambda m: F.struct(m["at"].alias("at"), F.coalesce(t.field_of(m["label"]), F.lit("")).alias("field")))

    def under(marks: Column) -> Column:
        def piece(m: Column, nth: Column) -> Column:
            end = F.coalesce(F.get(marks, nth + 1)["at"], F.size("lines"))
            said = F.slice("lines", m["at"] + 2, end - m["at"] - 1)
            stripped = F.transform(said, lambda x: F.struct(m["field"].alias("field"), x["line_no"].alias("line_no"), t.strip(x["line"]).alias("line")))
            return F.when(m["field"] != "", F.filter(stripped, lambda x: x["line"] != ""))

        return F.flatten(F.array_compact(F.transform(marks, piece)))

    marked = stretches(lines).withColumn("marks", marks(F.col("lines")))
    last = F.try_element_at("marks", F.lit(-1))["field"]
    others = marked.filter("not alone")
    earlier = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = others.select(*keys, "stretch", last.alias("last")).select(*keys, "stretch", F.last("last", ignorenulls=True).over(earlier).alias("open"))
    held = marked.filter("alone").withColumn("open", F.lit(None).cast("string")).unionByName(others.join(carried, [*keys, "stretch"]))
    opened = F.array(F.struct(F.lit(-1).alias("at"), F.coalesce("open", F.lit("")).alias("field")))
    return held.select(*keys, "stretch", "alone", "lines", t.bind(F.concat(opened, "marks"), under).alias("fields"))


def finding_fields(lines: DataFrame) -> DataFrame:
    """``field_stretches`` as one row per line; rows of these may also come themselves."""
    rows = lines if "fields" in lines.columns else field_stretches(lines)
    # outer, as the filter that Spark derives from a plain one would find the fields once more
    return rows.select("doc_id", "finding_no", F.inline_outer("fields")).filter("field is not null")


def narrative_sentences(fields: DataFrame) -> DataFrame:
    """Sentences of each finding's narrative; one may run over several lines."""
    pieces = (
        fields.filter("field = 'narrative'")
        .select("doc_id", "finding_no", "line_no", F.posexplode(t.sentences(F.col("line"))).alias("piece_no", "piece"))
    )
    ends = F.col("piece").rlike(r"[.!?]\z").cast("bigint")
    placed = running(
        pieces,
        ["doc_id", "finding_no"],
        ["line_no", "piece_no"],
        position_bucket("line_no"),
        [Total("sentence_no", ends, before=True)],
    )
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "piece_no", "piece")))
    return placed.groupBy("doc_id", "finding_no", "sentence_no").agg(
        F.concat_ws(" ", F.transform(ordered, lambda p: p["piece"])).alias("sentence")
    )


def whole_sentences(fields: str | Column) -> Column:
    """``narrative_sentences`` of fields that lie in one row: an array, in order."""
    narrative = F.filter(fields, lambda f: f["field"] == "narrative")
    pieces = F.flatten(F.transform(narrative, lambda f: t.sentences(f["line"])))

    def joined(pieces: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.get(pieces, i).rlike(r"[.!?]\z") | (i == F.size(pieces) - 1))

        def of(ends: Column) -> Column:
            def sentence(end: Column, nth: Column) -> Column:
                start = F.coalesce(F.get(ends, nth - 1) + 1, F.lit(0))
                return F.array_join(F.slice(pieces, start + 1, end - start + 1), " ")

            return F.transform(ends, sentence)

        return F.when(F.size(pieces) > 0, t.bind(ends, of)).otherwise(F.array().cast("array<string>"))

    return t.bind(pieces, joined)


def line_windows(lines: DataFrame, width: int) -> DataFrame:
    """Each line with the ``width - 1`` lines after it, joined by newline."""
    placed = numbered(lines, ["doc_id", "finding_no"], ["line_no"], position_bucket("line_no"), "nth")
    spread = placed.select(
        "doc_id", "finding_no", "nth", "line",
        F.explode(F.sequence(F.greatest(F.lit(1), F.col("nth") - (width - 1)), F.col("nth"))).alias("start"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("nth", "line")))
    return spread.groupBy("doc_id", "finding_no", "start").agg(
        F.concat_ws("\n", F.transform(ordered, lambda p: p["line"])).alias("text")
    )


def finding_facts(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per finding with everything the finding checks ask about."""
    keys = ["doc_id", "finding_no"]

    def chars(rows: str | Column) -> Column:
        return F.aggregate(rows, F.lit(0).cast("bigint"), lambda n, line: n + F.coalesce(F.length(line["line"]), F.lit(0)) + 1)

    shown = F.exists("lines", lambda line: t.shows_evidence(line["line"]))
    narrative = F.filter("fields", lambda f: f["field"] == "narrative")
    names = F.array_distinct(F.transform("fields", lambda f: f["field"]))
    named = [F.array_contains("names", name).alias(f"has_{name}") for name in fixed.FIELD_LABELS]
    # all that is asked of a stretch is read in its row, once
    read = field_stretches(lines).withColumn("names", names).select(*keys, chars("lines").alias("chars"), shown.alias("shown"), F.nullif(chars(narrative), F.lit(0)).alias("narrative_chars"), *named)
    told = read.groupBy(*keys).agg(
        (F.sum("chars") - 1).alias("text_chars"), F.bool_or("shown").alias("implicit_evidence"), (F.sum("narrative_chars") - 1).alias("narrative_chars"),
        *[F.bool_or(f"has_{name}").alias(f"has_{name}") for name in fixed.FIELD_LABELS],
    )
    fields = F.array_compact(F.array(*[F.when(F.col(f"has_{name}"), name) for name in fixed.FIELD_LABELS]))
    base = findings.join(told, keys, "left").select(
        *findings.columns,
        F.coalesce("text_chars", F.lit(0)).alias("text_chars"),
        fields.alias("fields"),
        F.coalesce("implicit_evidence", F.lit(False)).alias("implicit_evidence"),
        "narrative_chars",
    )
    return base.withColumn(
        "fields",
        F.when(F.col("implicit_evidence"), F.array_union("fields", F.array(F.lit("evidence")))).otherwise(F.col("fields")),
    ).join(_readings(findings, lines), keys)


def _readings(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Threat level, severity and score of each finding.

    The table's values are used where they say something.  Otherwise the text is read
    through windows of four lines, the most lines one of the patterns can run over, so
    no finding's text is put together.
    """
    keys = ["doc_id", "finding_no"]
    threat_cell, cvss_cell = t.blank_to_null(F.col("threat_text")), t.blank_to_null(F.col("cvss_text"))
    stated = findings.select(
        *keys, "title", threat_cell.isNotNull().alias("has_threat"), cvss_cell.isNotNull().alias("has_cvss"),
        t.threat_level(threat_cell).alias("stated_threat"), t.cvss_score(cvss_cell).alias("stated_score"),
    )
    unsure = settle(stated.filter("stated_threat is null or not has_cvss").select(*keys, "title"))
    asked = unsure.select(*keys)
    asked = F.broadcast(asked) if unsure.count() <= FEW_FINDINGS else asked
    text = (
        long_lines(lines.join(asked, keys, "left_semi")).filter(t.strip(F.col("line")) != "").select(*keys, "line_no", "line", F.lit(False).alias("is_title"))
    ).unionByName(
        unsure.select(*keys, F.lit(-1).alias("line_no"), F.col("title").alias("line"), F.lit(True).alias("is_title"))
    )
    body = line_windows(text.filter("not is_title").drop("is_title"), 4)
    headed = line_windows(text.drop("is_title"), 4)

    def first_of(value: Column) -> Column:
        return F.min_by(value, F.when(value.isNotNull(), F.col("start")))

    labelled = F.initcap(t.blank_to_null(F.regexp_extract("text", fixed.THREAT_LABEL, 1)))
    named = F.initcap(t.blank_to_null(F.regexp_extract("text", fixed.THREAT_WORD, 1)))
    threats = headed.groupBy(*keys).agg(
        F.coalesce(first_of(labelled), first_of(named)).alias("read_threat"),
        first_of(t.severity(F.col("text"))).alias("read_severity"),
    )
    parts = t.cvss_parts(F.col("text"))
    scores = body.withColumn("parts", parts).groupBy(*keys).agg(
        F.coalesce(*[first_of(F.col("parts")[p]) for p in ("before", "after", "loose")]).alias("read_score")
    )
    threat = F.when(F.col("has_threat"), F.col("stated_threat")).otherwise(F.col("read_threat"))
    return (
        stated.join(threats, keys, "left")
        .join(scores, keys, "left")
        .select(
            *keys,
            threat.alias("threat"),
            F.coalesce(threat, F.col("read_severity")).alias("severity_word"),
            F.when(F.col("has_cvss"), F.col("stated_score")).otherwise(F.col("read_score")).alias("score"),
        )
    )
