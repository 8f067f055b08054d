"""Operators against brute force and hand-written expectations, and the ways they must agree."""

import io
import random
import zipfile

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from redpen.operators import alignment, anchors, checks, feedback, learning, matching, ordered, structure
from redpen.plans import profile, scan
from redpen.sources import configs, packages, rule_store, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_running_values_do_not_depend_on_the_bucket_size(spark):
    random.seed(7)
    data = [(k, i, random.choice([None, 1, 2])) for k in (1, 2) for i in range(60)]
    df = spark.createDataFrame(data, "k int, i int, v int")

    def run(size):
        return rows(ordered.running(df, ["k"], ["i"], ordered.position_bucket("i", size), [
            ordered.Total("total", F.coalesce("v", F.lit(0))), ordered.Latest("seen", F.col("v"), before=True)]))

    small, whole = run(4), run(1000)
    assert small == whole
    seen, total = None, 0
    for k, i, v, t_, s_ in [r for r in sorted(whole, key=lambda r: (r[0], r[1])) if r[0] == 1]:
        assert s_ == seen
        total += v or 0
        seen = v if v is not None else seen
        assert t_ == total


@pytest.mark.parametrize("choices, n", [([None, 1, 2, 3, 5], 80), ([None, *range(1, 41)], 700), ([10, 9, 11, None], 60)])
def test_sections_equal_a_stack(spark, choices, n):
    random.seed(3)
    levels = [random.choice(choices) for _ in range(n)]
    blocks = spark.createDataFrame(
        [(1, i, "p", f"t{i}", level) for i, level in enumerate(levels)], "doc_id long, block_no int, type string, text string, heading_level int"
    )
    expected, stack, number = [], [], 0
    if levels[0] is None:
        stack, expected = [(0, 0)], [(0, None)]
    for level in levels:
        if level:
            number += 1
            while stack and stack[-1][0] >= level:
                stack.pop()
            expected.append((number, stack[-1][1] if stack else None))
            stack.append((level, number))
    got = [(r["section_no"], r["parent_no"]) for r in structure.sections(blocks).orderBy("section_no").collect()]
    assert got == expected


def test_enclosing_across_stretches_of_every_size(spark):
    random.seed(4)
    data = [(key, i, random.choice((1, 2, 3, 7, 40))) for key in (1, 2) for i in range(150)]
    df = spark.createDataFrame(data + [(3, i, i + 1) for i in range(30)], "k long, at long, level int")
    for r in ordered.enclosing(df, ["k"], "at", "level", "above", width=4).collect():
        own = {i: level for key, i, level in data if key == r.k} or {i: i + 1 for i in range(30)}
        want = [i for i in range(r.at) if own[i] < r.level and all(own[j] > own[i] for j in range(i + 1, r.at))]
        assert r.above == want


def test_findings_and_their_lines(spark):
    table = [["Threat Level", "High", "CVSS", "7.1"]]
    data = [(0, "p", "Intro", None), (1, "p", "First", None), (2, "tbl", None, table), (3, "p", "a", None), (4, "tbl", None, [["x"]]),
            (5, "p", "Second", None), (6, "tbl", None, [["threat level"]]), (7, "tbl", None, table), (8, "p", "b", None)]
    blocks = spark.createDataFrame([(1, *d) for d in data], "doc_id long, block_no int, type string, text string, rows array<array<string>>")
    assert rows(structure.findings(blocks)) == [(1, 1, "First", "High", "7.1"), (1, 2, "Second", "High", "7.1")]
    assert rows(structure.finding_lines(blocks).select("finding_no", "line")) == [(1, "Second"), (1, "a"), (2, "b")]
    outline = [(1, 1, "First", "High", "7.1", 2), (1, 2, "Second", "High", "7.1", 1)]
    assert rows(structure.finding_outline(blocks)) == outline
    for width in (2, 3, 5, 9):  # stretches of blocks, cut anywhere
        cut = [(1, [d for d in data[a:a + width]]) for a in range(0, 9, width)] + [(1, [])]
        kind = "doc_id long, blocks array<struct<block_no:int,type:string,text:string,rows:array<array<string>>>>"
        assert rows(structure.finding_outline(spark.createDataFrame(cut, kind))) == outline


def test_finding_checks_without_table_values_read_the_text(spark):
    findings = spark.createDataFrame([(1, 1, "T", None, None), (1, 2, "Medium thing", "TBD", "")], "doc_id long, finding_no int, title string, threat_text string, cvss_text string")
    lines = spark.createDataFrame(
        [(1, 1, 0, "low at first"), (1, 1, 1, "Threat"), (1, 1, 2, "level"), (1, 1, 3, ":"), (1, 1, 4, "High"), (1, 1, 5, "CVSS:"), (1, 1, 6, "9.8"),
         (1, 2, 0, "Evidence:"), (1, 2, 1, "x"), (1, 2, 2, "CVSS = 2.0")], "doc_id long, finding_no int, line_no int, line string")
    facts = structure.finding_facts(findings, lines)
    got = {r["finding_no"]: (r["threat"], r["severity_word"], r["score"]) for r in facts.collect()}
    assert got == {1: ("High", "High", 9.8), 2: (None, "Medium", 2.0)}
    messages = rows(checks.cvss_consistency(facts).select("message"))
    assert messages == [('Severity "High" does not match CVSS 9.8 (expected Critical).',), ('Severity "Medium" does not match CVSS 2.0 (expected Low).',)]


def test_narrative_sentences_run_over_lines(spark):
    fields = spark.createDataFrame([(1, 1, "narrative", 0, "One two"), (1, 1, "narrative", 1, "three. Four."), (1, 1, "narrative", 2, "Five")],
                                   "doc_id long, finding_no int, field string, line_no int, line string")
    assert rows(structure.narrative_sentences(fields).select("sentence")) == [("Five",), ("Four.",), ("One two three.",)]


def _texts_and_phrases(spark):
    random.seed(11)
    words = ["scan", "scanner", "the", "then", "de", "-", "é1", "zz", "port"]
    texts = [(i, " ".join(random.choices(words, k=12)) + random.choice(["", "  ", ". the end"])) for i in range(40)]
    phrases = {t[a:a + n] for _, t in texts[:25] for a, n in [(0, 3), (2, 9), (5, 16), (1, 1), (7, 25)]} | {"absent here", " ", "--", "he"}
    return spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string"), texts, phrases


def test_matching_equals_plain_counting(spark):
    texts, phrases, plain, wanted = _texts_and_phrases(spark)
    expected = sorted((i, p, t.count(p)) for i, t in plain for p in wanted if p in t)
    assert rows(matching.phrase_hits(texts, phrases, ["id"])) == expected
    assert rows(matching.phrase_hits(texts, phrases.limit(0), ["id"])) == []
    assert rows(matching.phrase_hits(texts.withColumn("text", F.lit(None).cast("string")), phrases, ["id"])) == []


def test_matching_of_random_texts(spark, monkeypatch):
    """Short alphabets, many overlaps, signs of several bytes, pieces across chunks of text."""
    monkeypatch.setattr(matching, "CHUNK_BYTES", 7)
    random.seed(12)
    for signs in ("ab", "aé日", "abcdefgh "):
        plain = [(i, "".join(random.choices(signs, k=random.choice((0, 1, 7, 40, 90))))) for i in range(40)]
        wanted = sorted({"".join(random.choices(signs, k=random.choice((1, 2, 3, 5, 9, 14)))) for _ in range(60)} | {t[3:17] for _, t in plain if len(t) > 20})
        texts, phrases = spark.createDataFrame(plain, "id int, text string"), spark.createDataFrame([(p,) for p in wanted], "phrase string")
        assert rows(matching.phrase_hits(texts, phrases, ["id"])) == sorted((i, p, t.count(p)) for i, t in plain for p in wanted if p in t)


def test_pieces_of_phrases_are_read_all_at_once(monkeypatch):
    random.seed(13)
    phrases = ["", "a", "é", None, *("".join(random.choices("abé日 ", k=random.randrange(1, 40))) for _ in range(300))]
    expected = set()
    for phrase in filter(None, phrases):
        data = phrase.encode()
        width = max(w for w in matching.WIDTHS if w <= len(data))
        for at in {(len(data) - width) * k // (matching.PIECES - 1) for k in range(matching.PIECES)}:
            piece = matching._pieces_at(np.frombuffer(data, np.uint8), at, 1, width).view(np.int64)[0]
            expected.add((phrase, width, at, int(piece)))
    monkeypatch.setattr(matching, "_pieces_at", None)  # one call for each piece is what took the time
    batch = pa.RecordBatch.from_arrays([pa.array(phrases)], ["phrase"])
    got = [tuple(r.values()) for b in matching._phrase_pieces([batch]) for r in b.to_pylist()]
    assert set(got) == expected


def test_matching_within_a_report(spark):
    texts, phrases, plain, wanted = _texts_and_phrases(spark)
    keyed = texts.withColumn("doc_id", F.col("id") % 3)
    asked = phrases.crossJoin(spark.range(2).select(F.col("id").cast("int").alias("doc_id")))
    expected = sorted((i % 3, i, p) for i, t in plain for p in wanted if p in t and i % 3 < 2)
    assert rows(matching.phrase_hits(keyed, asked, ["doc_id", "id"], ["doc_id"]).drop("n")) == expected


def test_secrets_with_their_surroundings(spark):
    text = "x" * 30 + " password: hunter22 " + "y" * 30 + "\nkey AKIA" + "A" * 16
    found = checks.sensitive(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert rows(found.select("message", "evidence")) == [
        ("Possible sensitive data detected: AWS Access Key", "y" * 15 + "\nkey AKIA" + "A" * 16),
        ("Possible sensitive data detected: Password Assignment", "x" * 19 + " password: hunter22 " + "y" * 19),
    ]


def test_hygiene_capital_rule_is_optional(spark):
    blocks = spark.createDataFrame([(1, 0, "p", "High risk. It is High here here")], "doc_id long, block_no int, type string, text string")
    assert rows(checks.hygiene(blocks).select("message")) == [("Repeated word",)]
    assert rows(checks.hygiene(blocks, capitals=True).select("message")) == [('Mid-sentence capitalization: "High"',), ("Repeated word",)]


def test_tracked_replacements_equal_a_queue(spark):
    random.seed(5)
    events, expected = [], []
    for para in range(30):
        queue = []
        for seq in range(12):
            kind, text = random.choice(["del", "ins"]), f"{para}.{seq}" if random.random() > 0.1 else " "
            events.append((1, para, seq, kind, text))
            if text == " ":
                continue
            if kind == "del":
                queue.append(text)
            elif queue:
                expected.append((1, para, seq, queue.pop(0), text))
    df = spark.createDataFrame(events, "doc_id long, para_no int, seq int, kind string, text string")
    assert rows(learning.tracked_replacements(df)) == sorted(expected)


def test_version_pairs(spark):
    names = ["a_v0.1.docx", "A v0.2.docx", "a-0.10.docx", "b_v1.0.docx", "plain.docx", "a_v0.3.txt"]
    reports = spark.createDataFrame(list(enumerate(names)), "doc_id long, file_name string")
    assert rows(learning.version_pairs(reports).select("old_doc", "new_doc")) == [(0, 1), (1, 2)]
    assert rows(learning.version_pairs(reports, "latest").select("old_doc", "new_doc")) == [(0, 2)]


def _small_corpus(spark):
    docs = spark.createDataFrame([(1, "The tested device unit. Keep this."), (2, "The tested unit. Keep this. New one."), (3, "The tested unit. Keep this.")], "doc_id long, text string")
    pairs = spark.createDataFrame([("p1", "f", 1, 2), ("p2", "f", 2, 3)], "pair_id string, family string, old_doc long, new_doc long")
    return docs, pairs


def test_partial_counts_per_pair_merge_to_the_whole(spark):
    docs, pairs = _small_corpus(spark)
    tracked = spark.createDataFrame([(2, 0, 0, "del", "Gone now."), (2, 0, 1, "ins", "Here now.")], "doc_id long, para_no int, seq int, kind string, text string")
    for count in (learning.sentence_counts, learning.ngram_counts):
        assert rows(count(docs, pairs, tracked)) == rows(learning.merge_counts(count(docs, pairs, tracked, per_pair=True)))
    assert ("gone now.", 4, 0) in rows(learning.sentence_counts(docs, pairs, tracked))


def test_aligned_rewrites_and_samples(spark):
    docs, pairs = _small_corpus(spark)
    changes = alignment.sentence_changes(docs, pairs)
    assert rows(changes.select("pair_id", "kind", "old_sentence", "new_sentence").na.fill("")) == [
        ("p1", "added", "", "New one."), ("p1", "replaced", "The tested device unit.", "The tested unit."), ("p2", "removed", "New one.", ""),
    ]
    assert rows(learning.rewrite_rules(learning.rewrite_votes(changes), 1)) == [("The tested device unit.", "The tested unit.", 1)]


def test_usual_range_takes_ranks_not_interpolation(spark):
    facts = spark.createDataFrame([(i * i + 1,) for i in range(25)], "w long")
    values = sorted(i * i + 1 for i in range(25))
    got = learning.usual_range(facts, "w").first()
    assert (got["low"], got["median"], got["high"], got["samples"]) == (values[2], values[12], values[22], 25)
    assert learning.usual_range(facts.limit(2), "w").count() == 0


def test_values_at_ranks_equal_sorted_ranks(spark):
    random.seed(6)
    for kind, values in (("long", [random.randrange(-(1 << 62), 1 << 62) for _ in range(300)] + [5] * 200), ("double", [random.expovariate(1) ** 9 for _ in range(400)] + [0.1, 0.1 + 1e-16, 1e300, -1e300]), ("long", [7])):
        df = spark.createDataFrame([(x,) for x in values], f"v {kind}").repartition(3)
        ranks = sorted({0, len(values) // 10, len(values) // 2, len(values) - 1})
        assert ordered.at_ranks(df, "v", ranks) == [sorted(values)[r] for r in ranks]


def test_ranks_across_ranges(spark):
    random.seed(8)
    data = [(random.choice("aab"), random.randrange(40), i) for i in range(500)]
    got = ordered.ranked(spark.createDataFrame(data, "k string, v long, i long").repartition(7), ["k"], ["v", "i"], "rank").collect()
    for key in "ab":
        assert [r.i for r in sorted((r for r in got if r.k == key), key=lambda r: r.rank)] == [i for _, i in sorted((v, i) for k, v, i in data if k == key)]
        assert sorted(r.rank for r in got if r.k == key) == list(range(1, sum(k == key for k, _, _ in data) + 1))


def test_merged_rewrites_keep_file_order_and_reason(spark):
    learned = spark.createDataFrame([("a  b", "c d", 5, "versions", ""), ("a b", "c d", 3, "ai_compare", "shorter"), ("x y", "z y", 2, "ai_compare", "plain")],
                                    "from_text string, to_text string, votes long, source string, reason string")
    accepted = spark.createDataFrame([("Q R", "S", 1), ("q r", "s", 0)], "from_text string, to_text string, pos int")
    assert rows(learning.merge_rewrite_rules(learned, accepted).select("from_text", "votes", "source", "reason")) == [
        ("a  b", 5, "versions", ""), ("q r", 9999, "accepted_feedback", ""), ("x y", 2, "ai_compare", "plain")]


def test_profile_from_versions_to_scan(spark, tmp_path):
    """Rules learned from a pair, stored, read again, and found in another report."""
    docs, pairs = _small_corpus(spark)
    paragraphs = docs.select("doc_id", F.lit(0).alias("para_no"), "text")
    answer = '{"deprecated_phrases":["Stay Here"],"preferred_rewrites":[{"from":"stay here now","to":"stay here","reason":"shorter"}],"style_rules":["Be brief."]}'
    responses = spark.createDataFrame([("p1", answer), ("p2", answer), ("p2", "none")], "pair_id string, response string")
    learned = profile.learn(profile.Evidence(docs, paragraphs, pairs, responses=responses), profile.Limits(min_rewrites=1, min_drop=1, min_len=1))
    sinks.write_profile(profile.rules(learned), str(tmp_path / "profile"))
    stored = sinks.read_profile(spark, str(tmp_path / "profile"))
    assert rows(stored.filter("kind = 'rewrite'").select("rank", "phrase", "detail", "source", "reason", "n")) == [
        (1, "stay here now", "stay here", "ai_compare", "shorter", 2), (2, "The tested device unit.", "The tested unit.", "versions", "", 1)]
    wanted = profile.for_scan(stored)
    assert wanted.styles is None and wanted.image_widths is None and rows(wanted.ai_phrases) == [("stay here",)]
    text = spark.createDataFrame([(9, "The tested device unit. " + "Stay here. " * 5)], "doc_id long, text string")
    blocks = spark.createDataFrame([(9, 0, "p", "x", None, None, None, None)], "doc_id long, block_no int, type string, text string, style_id string, style_name string, heading_level int, rows array<array<string>>")
    breaks = spark.createDataFrame([], "doc_id long, para_no int, text string, has_break boolean")
    found = sinks.in_order(scan.scan(scan.Reports(blocks=blocks, breaks=breaks, texts=text), wanted))
    assert {"DOC-STYLE-REWRITE-001", "DOC-STYLE-DEPRECATED-AI-001"} <= {r.code for r in found.collect()}
    reports = spark.createDataFrame([(9, "nine.docx"), (8, "eight.docx")], "doc_id long, file_name string")
    path = str(tmp_path / "results")
    sinks.write_scan_results(sinks.scan_results(found, spark.createDataFrame([], "doc_id long"), reports), path)
    assert sorted((r.document, len(r.diagnostics)) for r in spark.read.json(path).collect()) == [("eight.docx", 0), ("nine.docx", found.count())]


def test_suppression_order_and_no_extra_rows(spark):
    diagnostics = spark.createDataFrame([(1, "A", "Check  this"), (2, "A", "other"), (3, "B", "check this"), (4, "C", "x")], "doc_id long, code string, message string")
    rules = spark.createDataFrame(
        [("accept", "A", "check this"), ("reject", "A", ""), ("reject", "A", "check"), ("ignore", "", "CHECK THIS"), ("reject", "c", "")], "decision string, code string, message_contains string")
    assert rows(checks.suppress(diagnostics, rules).select("doc_id")) == [(1,), (4,)]


@pytest.mark.parametrize("share", [2, 1000])
def test_suppression_of_common_and_rare_messages(spark, monkeypatch, share):
    """One message is on a third of all rows; it may be kept, dropped or accepted."""
    monkeypatch.setattr(checks, "COMMON_SHARE", share)
    random.seed(2)
    data = [(i, random.choice("ABC") if i % 3 else "A", "Common  one" if i % 3 == 0 else f"note {random.randrange(60)}") for i in range(600)]
    diagnostics = spark.createDataFrame(data, "doc_id long, code string, message string")
    for common in ("accept", "reject", "ignore", None):
        decisions = [("reject", "B", ""), ("reject", "", "note 1"), ("accept", "C", "note 12")] + ([(common, "A", "COMMON one")] if common else [])
        def stays(code, message):
            hit = {d for d, c, part in decisions if c in ("", code) and part.lower() in " ".join(message.lower().split())}
            return "accept" in hit or not hit & {"reject", "ignore"}
        rules = spark.createDataFrame(decisions, "decision string, code string, message_contains string")
        assert rows(checks.suppress(diagnostics, rules)) == sorted(r for r in data if stays(*r[1:]))


def test_decisions_come_from_text_reply_or_neighbour(spark):
    base = '[R][C-1][warning] "one two" -> "one three"'
    data = [(1, 0, 1, None, "bot", base), (1, 1, 2, 1, "me", "accepted"), (1, 2, 3, None, "bot", base), (1, 3, 4, None, "bot", "accept: mine"),
            (1, 4, 5, None, "me", "rejected"), (1, 5, 20, None, "bot", base), (1, 6, 29, None, "me", "accept"), (2, 0, 1, None, "bot", "[reject] " + base)]
    comments = spark.createDataFrame(data, "doc_id long, seq long, comment_id long, parent_id long, author string, text string")
    resolved = feedback.resolve_decisions(comments, "bot")
    assert rows(resolved.select("doc_id", "seq", "decision")) == [(1, 0, "accept"), (1, 2, "reject"), (2, 0, "reject")]
    reviewed = feedback.reviewed_rewrites(resolved)
    once = feedback.merge_rewrites(spark.createDataFrame([], "decision string, from_text string, to_text string"), reviewed)
    assert rows(once) == [("accept", "one two", "one three", True), ("reject", "one two", "one three", True)]
    assert not [r for r in feedback.merge_rewrites(once.drop("added"), reviewed).collect() if r["added"]]


def _resolved(spark, *said):
    data = [(doc_id, 0, decision, (f"{a}", f"{b}") if kind == "rewrite" else None, (a, b) if kind == "diagnostic" else None) for doc_id, kind, decision, a, b in said]
    return spark.createDataFrame(data, "doc_id long, seq long, decision string, rewrite struct<from_text:string,to_text:string>, rule struct<code:string,message_contains:string>")


def _rules(spark, folder):
    return sorted((r.kind, r.decision, r.a, r.b, r.commit) for r in rule_store.stored(spark, folder).collect())


def test_stored_rules_grow_by_upserts(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    assert _rules(spark, folder) == []
    first = _resolved(spark, (1, "rewrite", "accept", "One  two", "one"), (2, "rewrite", "accept", "one two", "ONE"), (1, "diagnostic", "reject", "c-1", "Some  text"))
    assert rows(rule_store.upsert(spark, folder, first)) == [("diagnostic", "reject", 1), ("rewrite", "accept", 1)]
    again = _resolved(spark, (3, "rewrite", "accept", "ONE TWO", "one"), (3, "rewrite", "reject", "one two", "one"), (3, "diagnostic", "reject", "C-1", "some text"))
    assert rows(rule_store.upsert(spark, folder, again)) == [("rewrite", "reject", 1)]
    want = [("diagnostic", "reject", "c-1", "Some  text", 1), ("rewrite", "accept", "One  two", "one", 1), ("rewrite", "reject", "one two", "one", 2)]
    assert _rules(spark, folder) == want
    # folders are gathered, and what came first stays first
    monkeypatch.setattr(rule_store, "FOLDERS", 2)
    rule_store.upsert(spark, folder, _resolved(spark, (0, "rewrite", "accept", "a b", "a")))
    assert _rules(spark, folder) == sorted([*want, ("rewrite", "accept", "a b", "a", 3)]) and len(rule_store.last_commit(spark, folder)[1]) == 1
    kept = learning.merge_rewrite_rules(spark.createDataFrame([], "from_text string, to_text string, votes long"), rule_store.rewrites(rule_store.stored(spark, folder)).filter("decision = 'accept'"))
    assert rows(kept.select("from_text")) == [("One  two",), ("a b",)]


def test_an_upsert_that_dies_halfway_adds_nothing(spark, tmp_path, monkeypatch):
    folder, said = str(tmp_path), _resolved(spark, (1, "rewrite", "accept", "a b", "a"))
    monkeypatch.setattr(rule_store, "_commit", lambda *args: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        rule_store.upsert(spark, folder, said)
    monkeypatch.undo()
    assert _rules(spark, folder) == []
    rule_store.upsert(spark, folder, said)
    assert _rules(spark, folder) == [("rewrite", "accept", "a b", "a", 1)]


def test_two_writers_of_one_commit(spark, tmp_path, monkeypatch):
    """The other writer is first; what it added is not added again."""
    folder, commit = str(tmp_path), rule_store._commit
    mine = _resolved(spark, (1, "rewrite", "accept", "a b", "a"), (2, "rewrite", "accept", "c d", "c"))

    def late(*args):
        monkeypatch.setattr(rule_store, "_commit", commit)
        rule_store.upsert(spark, folder, _resolved(spark, (9, "rewrite", "accept", "A B", "a")))
        commit(*args)

    monkeypatch.setattr(rule_store, "_commit", late)
    rule_store.upsert(spark, folder, mine)
    assert _rules(spark, folder) == [("rewrite", "accept", "A B", "a", 1), ("rewrite", "accept", "c d", "c", 2)]


def test_packed_texts(spark):
    from redpen.operators import review

    random.seed(3)
    texts = [(i, "".join(random.choice(("ab", "\n", "x" * 7, "é ", "long" * 9)) for _ in range(random.randrange(60)))) for i in range(40)] + [(90, ""), (91, None), (92, "\n"), (93, "y" * 30)]
    got = {}
    for r in review.packed(spark.createDataFrame(texts, "doc_id long, text string"), "text", 10).collect():
        assert 0 < len(r.part) <= 10
        got.setdefault(r.doc_id, {})[r.part_no] = (r.part, r.n_parts)
    assert {k: "".join(x[n][0] for n in range(x[0][1])) for k, x in got.items()} == {i: x for i, x in texts if x}
    # parts are full: the first line of a part would not have fitted into the one before
    for parts in got.values():
        for n in range(1, len(parts)):
            assert len(parts[n - 1][0]) + len(parts[n][0].split("\n")[0]) + ("\n" in parts[n][0]) > 10


def test_anchor_ladder(spark):
    paragraphs = spark.createDataFrame([(1, 0, ""), (1, 1, "Intro text"), (1, 2, "Weak TLS"), (1, 3, "We used weak tls ciphers"), (1, 4, "Gathering of Information for Devices")],
                                       "doc_id long, para_no int, text string")
    data = [(1, 1, "m", None, None, "weak TLS"), (1, 2, "m", None, "TLS ciphers", None), (1, 3, 'm "x" and "weak tls ci"', "Document", None, None),
            (1, 4, "m", "Device Information Gathering", None, None), (1, 5, "m", "Nothing", None, None)]
    diagnostics = spark.createDataFrame(data, "doc_id long, seq int, message string, loc_section string, loc_text string, loc_finding string")
    assert rows(anchors.resolve_anchors(diagnostics, paragraphs)) == [(1, 1, 2, 1), (1, 2, 3, 2), (1, 3, 3, 6), (1, 4, 4, 5), (1, 5, 1, 7)]


def _package(body, styles=True, comments=""):
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        package.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
        if styles:
            package.writestr("word/styles.xml", f'<w:styles {space}><w:style w:styleId="H1"><w:name w:val="Heading 1"/></w:style></w:styles>')
        if comments:
            package.writestr("word/comments.xml", f"<w:comments {space}>{comments}</w:comments>")
    return out.getvalue()


def test_packages_to_tables(spark):
    def run(text):
        return f"<w:r><w:t>{text}</w:t></w:r>"

    cell = "<w:tc><w:p>{}</w:p></w:tc>".format
    body = (
        f'<w:p><w:pPr><w:pStyle w:val="H1"/><w:jc w:val="Center"/></w:pPr>{run(" Title ")}</w:p><w:p/>'
        f'<w:p><w:del><w:r><w:delText>old</w:delText></w:r></w:del><w:ins>{run("new")}</w:ins><w:r><w:br w:type="page"/></w:r></w:p>'
        f"<w:tbl><w:tblGrid><w:gridCol/><w:gridCol/></w:tblGrid><w:tr>{cell(run('a'))}{cell(run('b'))}</w:tr><w:tr>{cell('')}</w:tr></w:tbl>"
        '<w:p><wp:extent cx="200" cy="100"/><wp:extent cx="x" cy="1"/><wp:extent cx="0" cy="1"/></w:p>'
    )
    comments = '<w:comment w:id="3" w:author=" bot "><w:p><w:r><w:t>hi</w:t></w:r></w:p></w:comment>'
    files = spark.createDataFrame([(1, _package(body, comments=comments)), (2, b"not a zip"), (3, _package("<w:p/>", styles=False))], "doc_id long, content binary")
    parts = packages.read_packages(files).cache()
    blocks = [tuple(r) for r in packages.blocks(parts).select("doc_id", "block_no", "type", "text", "heading_level", "rows").orderBy("block_no").collect()]
    assert blocks == [(1, 0, "p", "Title", 1, None), (1, 1, "p", "new", None, None), (1, 2, "tbl", None, None, [["a", "b"]])]
    assert rows(packages.breaks(parts).filter("doc_id = 1").select("para_no", "has_break")) == [(0, False), (1, False), (2, True), (3, False)]
    assert rows(packages.tracked(parts).select("para_no", "seq", "kind", "text")) == [(2, 0, "del", "old"), (2, 1, "ins", "new")]
    assert rows(packages.layout_images(parts).select("width_emu", "height_emu", "aspect")) == [(200, 100, 2.0)]
    assert rows(packages.layout_tables(parts)) == [(1, 2)]
    assert ("H1", "center") in rows(packages.layout_paragraphs(parts).select("style_id", "alignment"))
    assert [tuple(r) for r in packages.comments(parts).select("comment_id", "author", "text").collect()] == [(3, "bot", "hi")]
    assert [r["doc_id"] for r in packages.errors(parts).collect()] == [2]
    assert packages.texts(parts).filter("doc_id = 1").first()["text"] == "Title\nnew\na\nb"


def test_configs_missing_and_odd_files(spark, tmp_path):
    assert configs.ignore_rules(configs.read_json(spark, str(tmp_path / "none.json"))).count() == 0
    (tmp_path / "f.json").write_text('{"ignore_diagnostic_codes": ["A", " ", 3], "accepted_rewrites": [{"from": "a", "to": " b "}, {"from": "a"}, 5], "rejected_diagnostics": "no"}')
    files = configs.read_json(spark, str(tmp_path / "f.json"))
    assert rows(configs.ignore_rules(files).select("kind", "value")) == [("code", "3"), ("code", "A")]
    assert rows(configs.feedback_rewrites(files).select("decision", "from_text", "to_text")) == [("accept", "a", "b")]
    assert configs.feedback_diagnostics(files).count() == 0


def test_results_nest_in_parts(spark):
    found = spark.createDataFrame([(1, 1, i, "warning", "C", f"m{i}", None, None, None, None, None) for i in range(5)],
                                  "doc_id long, check_no int, pos long, severity string, code string, message string, loc_section string, loc_text string, loc_finding string, evidence string, source string")
    reports = spark.createDataFrame([(1, "a.docx"), (2, "b.docx")], "doc_id long, file_name string")
    findings = spark.createDataFrame([(1, 1)], "doc_id long, finding_no int")
    whole = sinks.scan_results(sinks.in_order(found), findings, reports)
    assert rows(whole.select("doc_id", "part", F.size("diagnostics"), "findings_count")) == [(1, 0, 5, 1), (2, 0, 0, 0)]
    nested = sinks.scan_results(sinks.in_order(found), findings, reports, rows_per_part=2)
    assert rows(nested.select("doc_id", "part", F.size("diagnostics"), "findings_count")) == [(1, 0, 2, 1), (1, 1, 2, 1), (1, 2, 1, 1), (2, 0, 0, 0)]


def test_families_stay_in_their_folder(spark):
    names = ["/a/Report_v1.0.docx", "/a/Report_v1.1.docx", "/b/Report_v1.0.docx", "/b/Report_v1.2.docx", "/c/Report_v1.0.docx"]
    reports = spark.createDataFrame([(i, n, n.rsplit("/", 1)[1]) for i, n in enumerate(names)], "doc_id long, path string, file_name string")
    assert rows(learning.version_pairs(reports).select("pair_id", "old_doc", "new_doc")) == [
        ("/a/Report_v1.0.docx::/a/Report_v1.1.docx", 0, 1), ("/b/Report_v1.0.docx::/b/Report_v1.2.docx", 2, 3),
    ]


def test_damaged_packages_give_error_rows(spark):
    def package(method=zipfile.ZIP_DEFLATED):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", method) as z:
            z.writestr("word/document.xml", "<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:body>" + "<w:p/>" * 500 + "</w:body></w:document>")
        return bytearray(out.getvalue())

    broken, locked, odd = package(), package(), package()
    broken[60:90] = b"\xff" * 30  # the packed stream
    central = locked.rindex(b"PK\x01\x02")
    locked[6] |= 1  # marked as encrypted, in both headers
    locked[central + 8] |= 1
    odd[8:10] = b"\x63\x00"  # a method nobody knows
    odd[central + 10 : central + 12] = b"\x63\x00"
    files = [(1, bytes(broken)), (2, bytes(locked)), (3, bytes(odd)), (4, b"no zip"), (5, None), (6, bytes(package()))]
    parts = packages.read_packages(spark.createDataFrame(files, "doc_id long, content binary"))
    assert [r[0] for r in rows(packages.errors(parts).select("doc_id"))] == [1, 2, 3, 4, 5]
    assert packages.breaks(parts).filter("doc_id = 6").count() == 500


def test_only_asked_kinds_are_read(spark):
    """Members that nothing asked for may be damaged; a report is read paragraph by paragraph."""
    body = "<w:p><w:pPr><w:pStyle w:val='H1'/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>" + "<w:p><w:r><w:t>x</w:t></w:r></w:p>" * 3
    whole = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(_package(body, comments="<w:comment w:id='1'/>"))) as good, zipfile.ZipFile(whole, "w") as bad:
        bad.writestr("word/document.xml", good.read("word/document.xml"))
        bad.writestr("word/styles.xml", "<w:styles")
        bad.writestr("word/comments.xml", "no xml")
    files = spark.createDataFrame([(1, whole.getvalue())], "doc_id long, content binary")
    assert packages.breaks(packages.read_packages(files, "paragraph")).count() == 4
    assert rows(packages.read_packages(files, "tracked", "layout_paragraph").groupBy("part").count()) == [("layout_paragraph", 4)]
    for kind in ("block", "comment"):
        assert rows(packages.read_packages(files, kind).select("part")) == [("error",)]
    with pytest.raises(ValueError):
        packages.read_packages(files, "blocks")


def test_a_long_report_is_not_held_whole():
    import tracemalloc

    def most(n):
        content = packages.pa.scalar(_package("<w:p><w:r><w:t>some words here</w:t></w:r></w:p>" * n), packages.pa.binary())
        out = packages._Rows({"paragraph", "error"})
        tracemalloc.start()
        for _ in packages._package(out, 1, content):
            if out.n >= 1000:
                for _ in out.taken():
                    pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak

    assert most(60_000) < most(6_000) + 4_000_000


def test_lines_lose_their_outer_blanks_only(spark, tmp_path):
    from redpen.plans.views import Views

    rows = [(1, "0 zero 0\n1 one 1\n  two  \n\n   \n55"), (2, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' as lang", "'s' as source").write.parquet(f"{tmp_path}/documents.parquet")
    texts = Views(spark, str(tmp_path)).texts().filter("doc_id = 1").first()["text"]
    assert texts == "0 zero 0\n1 one 1\ntwo\n55"


def test_places_of_other_reports_phrases_do_not_travel(spark):
    from redpen.operators import matching

    texts = spark.createDataFrame([(d, f"alpha{d} beta{d} gamma{d} " * 3 + "alpha1 beta1") for d in range(40)], "doc_id bigint, text string")
    wanted = spark.createDataFrame([(d, f"alpha{d} beta{d}") for d in range(40)], "doc_id bigint, phrase string")
    hits = matching.phrase_hits(texts, wanted, ["doc_id"], ["doc_id"]).collect()
    assert {(r["doc_id"], r["n"]) for r in hits} == {(d, 4 if d == 1 else 3) for d in range(40)}

    home = F.xxhash64("doc_id")
    rules = matching._known_by(wanted.select("phrase")).join(wanted, "phrase")
    bits = matching._bitmap(rules.select(F.col("piece").bitwiseXOR(home).alias("piece")))
    assert len(bits) * 8 == matching.LEAST_BITS
    widths = [r["width"] for r in rules.select("width").distinct().collect()]
    spots = matching._spots(spark.sparkContext.broadcast(bits), widths)("text", home)
    assert texts.filter("doc_id <> 1").select(F.sum(F.size(spots))).first()[0] <= 39 * 3


def test_fields_run_on_from_one_stretch_of_lines_to_the_next(spark):
    step = structure.STRETCH_LINES
    said = [(0, "before"), (1, "Narrative:"), (2, "a"), (step + 5, "b"), (3 * step, "c"), (3 * step + 1, "Notes:"), (3 * step + 2, "d"), (4 * step, "Evidence:"), (4 * step + 1, " e ")]
    lines = spark.createDataFrame([(1, n, at, line) for n in (1, 2) for at, line in said if n == 1 or at], "doc_id long, finding_no int, line_no int, line string")
    want = [(1, n, "evidence", 4 * step + 1, "e") for n in (1, 2)] + [(1, n, "narrative", at, x) for n in (1, 2) for at, x in ((2, "a"), (step + 5, "b"), (3 * step, "c"))]
    assert rows(structure.finding_fields(lines)) == sorted(want)
    assert rows(structure.finding_fields(structure.stretches(lines))) == sorted(want)


def test_fields_of_findings_in_one_row_move_no_lines(spark):
    stretch = "array(struct(0 as line_no, 'Narrative:' as line), struct(1 as line_no, 'a' as line))"
    lines = spark.range(4).selectExpr("id as doc_id", "1 as finding_no", "0L as stretch", "true as alone", f"{stretch} as lines").filter("alone")
    fields = structure.finding_fields(lines)
    assert rows(fields) == [(i, 1, "narrative", 1, "a") for i in range(4)]
    assert "Exchange" not in fields._jdf.queryExecution().executedPlan().toString()


def test_narratives_of_findings_part_at_findings(spark):
    from redpen.operators import review

    fields = spark.createDataFrame([(1, 2, "narrative", 4, "c"), (1, 1, "narrative", 7, "b"), (1, 1, "narrative", 2, "a"), (1, 2, "evidence", 1, "x")], "doc_id long, finding_no int, field string, line_no int, line string")
    blocks = spark.createDataFrame([(1, 0, "p", "T", 1)], "doc_id long, block_no int, type string, text string, heading_level int")
    texts = spark.createDataFrame([(1, "T"), (2, "whole")], "doc_id long, text string")
    assert rows(review.narratives(blocks, fields, texts)) == [(1, "a b\nc"), (2, "whole")]


def test_packing_moves_nothing(spark):
    from redpen.operators import review

    plan = review.packed(spark.range(3).selectExpr("id as doc_id", "repeat('ab\n', 9) as text"), "text", 10)
    assert [r.n_parts for r in plan.filter("doc_id = 0").collect()] == [3, 3, 3]
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_packages_are_made_and_read_in_small_batches():
    import pyarrow as pa

    from redpen.plans import views
    from redpen.sources import packages

    texts = ["\n".join(["word " * 200] * 300)] * 12
    batch = pa.RecordBatch.from_arrays([pa.array(range(12), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    packed = list(views._pack(iter([batch])))
    assert [i for p in packed for i in p.column(0).to_pylist()] == list(range(12)) and max(p.num_rows for p in packed) <= 4
    out, most = packages._Rows({"paragraph", "error"}), 0
    for p in packed:
        for doc_id, content in zip(*p.columns):
            for _ in packages._package(out, doc_id.as_py(), content):
                if out.full():
                    most = max(most, sum(b.get_total_buffer_size() for b in out.taken()))
    assert 0 < most < 4 * packages.BATCH_CHARS


def test_long_phrases_are_known_by_long_pieces(spark):
    """Texts made of the same words hold each short piece of a phrase, but few hold a long one."""
    random.seed(14)
    words = ["".join(random.choices("abcdefgh", k=7)) for _ in range(30)]
    texts = spark.createDataFrame([(i, " ".join(random.choices(words, k=60))) for i in range(50)], "id int, text string")
    said = [" ".join(random.choices(words, k=7)) for _ in range(200)]
    known = matching._known_by(spark.createDataFrame([(p,) for p in said], "phrase string").distinct())
    assert known.filter("width < 32").count() == 0 and known.count() == len(set(said))
    spots = matching._spots(spark.sparkContext.broadcast(matching._bitmap(known.select("piece"))), [32])("text", F.lit(0).cast("bigint"))
    assert texts.select(F.sum(F.size(spots))).first()[0] < 50


def test_places_of_a_piece_travel_in_one_row(spark):
    known = matching._known_by(spark.createDataFrame([("the",)], "phrase string"))
    spots = matching._spots(spark.sparkContext.broadcast(matching._bitmap(known.select("piece"))), [2])("text", F.lit(0).cast("bigint"))
    texts = spark.createDataFrame([("",), ("the " * 500,), ("no",), ("the the",)], "text string")
    assert [[len(s["at"]) for s in row[0]] for row in texts.select(spots).collect()] == [[], [500], [], [2]]


def test_phrases_do_not_travel_with_their_places(spark, monkeypatch):
    """Phrases are told apart by digest, and one longer than all known ones is not looked for in these."""
    asked = []

    def seen(texts, phrases, keep, within=None):
        asked.append((keep, sorted(r["phrase"] for r in phrases.select("phrase").collect())))
        return matching.phrase_hits(texts, phrases, keep, within)

    monkeypatch.setattr(checks, "phrase_hits", seen)
    phrases = spark.createDataFrame([("of  THE report",), ("OF",), ("none",), ("a longer text of all",), ("of the report",), (None,), (" ",)], "phrase string")
    known = spark.createDataFrame([("of the",), ("of The ",)], "phrase string")
    assert rows(checks.matching_phrases(phrases, known)) == [("OF",), ("of  THE report",), ("of the report",)]
    assert asked == [(["id"], ["of the"]), (["known"], ["none", "of"])]


def test_repeats_of_a_finding_in_one_row_are_counted_there(spark):
    """Findings in one row and others, over random lines, against the long form."""
    random.seed(15)
    said = ["Narrative:", "Notes:", "Same  words.", "same words.", "One. Two!", "runs on", "see www.x.org.", "", " Other words here? ", "Other, words here?"]
    long = [(1, n, at, random.choice(said) if at else "Narrative:") for n in range(40) for at in range(random.randrange(1, 30))]
    lines = spark.createDataFrame(long, "doc_id long, finding_no int, line_no int, line string")
    findings = spark.range(40).selectExpr("1L as doc_id", "cast(id as int) as finding_no", "'T' as title")
    rows_of = structure.stretches(lines).withColumn("alone", F.col("finding_no") % 3 > 0)
    columns = ["doc_id", "pos", "message"]
    for least in (2, 3):
        want = rows(checks.finding_repetition(findings, structure.finding_fields(lines), 4, least).select(columns))
        assert rows(checks.finding_repetition(findings, structure.field_stretches(rows_of), 4, least).select(columns)) == want != []
    own = checks._repeats_in_row(structure.field_stretches(rows_of.filter("alone")).filter("alone"), 4, 2)
    assert "hashpartitioning" not in own._jdf.queryExecution().optimizedPlan().toString()


def test_narratives_from_stretches(spark):
    from redpen.operators import review

    data = [(1, 2, 0, "Narrative:"), (1, 2, 4, "c"), (1, 2, 5, ""), (1, 2, 6, "d"), (1, 1, 1, "Narrative:"), (1, 1, 7, " b"), (1, 1, 9, "Notes:"), (1, 1, 10, "x"), (2, 3, 0, "y")]
    lines = spark.createDataFrame(data, "doc_id long, finding_no int, line_no int, line string")
    blocks = spark.createDataFrame([(1, 0, "p", "T", 1)], "doc_id long, block_no int, type string, text string, heading_level int")
    texts = spark.createDataFrame([(1, "T"), (2, "whole")], "doc_id long, text string")
    told = review.narratives(blocks, structure.field_stretches(lines), texts)
    assert rows(told) == rows(review.narratives(blocks, structure.finding_fields(lines), texts)) == [(1, "b\nc d"), (2, "whole")]
    by_finding = "collect_list(struct(finding_no"
    assert told._jdf.queryExecution().optimizedPlan().toString().count(by_finding) == 1


def test_signs_of_addresses_do_not_hide_any(spark):
    from redpen.functions import fixed, text as t

    said = ["HTTPS://a", "http:/x", "see WwW.b.c", "10.0.0.1", "1.2.3", "a.b.c.d", "fe80:0:1", "a:b", "ab:cd:ef", "x. y. z. 1.1.1.1", "", "http ://", "www", None]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    plain = F.col("s").rlike(fixed.URL) | F.col("s").rlike(fixed.IPV4) | F.col("s").rlike(fixed.IPV6)
    assert df.filter(~plain.eqNullSafe(t.has_url_or_ip(F.col("s")))).count() == 0


def test_text_outside_headings_does_not_travel_for_sections(spark, monkeypatch):
    """Of a report without a matching title no paragraph is numbered; titles alone make the tree."""
    data = [(d, i, "p", f"Narrative {d}" if d == 1 and i == 2 else f"long wording {i}", 1 + i % 3 if i % 2 == 0 else None) for d in (1, 2) for i in range(8)]
    blocks = spark.createDataFrame(data, "doc_id long, block_no long, type string, text string, heading_level int")
    numbered, asked = structure.section_blocks, []
    monkeypatch.setattr(structure, "section_blocks", lambda b: asked.append(b) or numbered(b))
    # block 2 is of level 3 and the only section that matches; block 4 (level 2) closes it
    assert rows(structure.section_text(blocks, "NARRATIVE")) == [(1, 2, 2, 3, "long wording 3")]
    tree, lines = asked
    assert tree.filter("text is not null and heading_level is null").count() == 0 and tree.filter("text is not null").count() == 8
    assert {r.doc_id for r in lines.collect()} == {1}


def test_narratives_leave_out_findings_of_other_reports(spark):
    from redpen.operators import review

    lines = spark.createDataFrame([(d, 1, at, line) for d in (1, 7) for at, line in enumerate(("Narrative:", f"n{d}"))], "doc_id long, finding_no int, line_no int, line string")
    blocks = spark.createDataFrame([(1, 0, "p", "T", 1)], "doc_id long, block_no int, type string, text string, heading_level int")
    told = review.narratives(blocks, structure.field_stretches(lines), spark.createDataFrame([(1, "T")], "doc_id long, text string"))
    assert rows(told) == [(1, "n1")]
    assert "LeftSemi" in told._jdf.queryExecution().optimizedPlan().toString()


def test_issues_are_judged_where_the_narrative_is(spark):
    from redpen.operators import review

    said = '[{"message":"Avoid using \'red\' phrasing"},{"message":"Stating the obvious about red"},{"message":"Use \'a\' instead of \'zz\'"}]'
    responses = spark.createDataFrame([(1, said), (2, "[]"), (3, said)], "doc_id long, response string")
    told = spark.createDataFrame([(1, "Red is red. A red one, red as red."), (2, "x")], "doc_id long, narrative string")
    found = review.review_diagnostics(responses, told)
    assert rows(found.select("doc_id", "pos")) == [(1, 0), (1, 1)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2


def test_stretches_of_blocks_are_cut_once(spark):
    kind = "doc_id long, blocks array<struct<block_no:int,type:string,text:string,rows:array<array<string>>>>"
    data = [(0, "p", "First", None), (1, "tbl", None, [["Threat Level", "High"]]), (2, "p", "said", None), (3, "p", " \t", None), (4, "tbl", None, [["Threat Level"]]), (5, "p", " ", None)]
    cut = spark.createDataFrame([(1, data)], kind)
    found = structure.finding_outline(cut)
    assert rows(found) == [(1, 1, "First", "High", None, 2), (1, 2, "said", None, None, 1)]
    # the running values read the cut pieces, twice, and the blocks no more
    assert "blocks" not in found._jdf.queryExecution().analyzed().toString()


def test_rows_among_keys(spark):
    """None is lost, whatever the type of the keys, and nearly all others are left out."""
    keys = spark.range(-500, 40_000, 7).select(F.col("id").cast("int").alias("k"))
    rows_ = spark.range(-1_000, 60_000).selectExpr("id as doc_id", "'x' as text")
    kept = matching.among(rows_, "doc_id", keys)
    assert kept.columns == ["doc_id", "text"]
    got, wanted = [r[0] for r in kept.select("doc_id").collect()], {r[0] for r in keys.collect()}
    assert wanted <= set(got) and len(set(got)) == len(got) < len(wanted) + 100
    assert matching.among(rows_, "doc_id", keys.limit(0)).count() == 0


def test_texts_without_a_pair_do_not_travel(spark, monkeypatch):
    from redpen.operators import alignment

    asked, plain = [], matching.among
    for module in (learning, alignment):
        monkeypatch.setattr(module, "among", lambda df, column, keys: asked.append(plain(df, column, keys)) or asked[-1])
    docs = spark.createDataFrame([(i, f"One {i}. Two {i // 2}. Three.") for i in range(20)], "doc_id long, text string")
    pairs = spark.createDataFrame([("p", "f", 4, 5)], "pair_id string, family string, old_doc long, new_doc long")
    counts = learning.merge_counts(learning.sentence_counts(docs, pairs))
    assert rows(counts) == [("one 4.", 1, 0), ("one 5.", 0, 1), ("three.", 1, 1), ("two 2.", 1, 1)]
    assert rows(alignment.sentence_changes(docs, pairs)) == [("p", "replaced", 0, "One 4.", "One 5.")]
    assert [sorted(r["doc_id"] for r in df.collect()) for df in asked] == [[4, 5], [4], [5]]


def test_guides_count_wording_once(spark):
    from redpen.operators import review

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    ngrams = spark.createDataFrame([("of the", 9, 1), ("as is", 8, 0), ("to be", 7, 1)], "phrase string, old long, new long")
    none = spark.createDataFrame([], "phrase string, votes long")
    rewrites = spark.createDataFrame([], "from_text string, to_text string, votes long, priority int")
    ignored = spark.createDataFrame([("AS IS",)], "phrase string")
    guide = review.guidance(ngrams.mapInArrow(counted, ngrams.schema), none, rewrites, none.withColumnRenamed("phrase", "rule"), ignored_phrases=ignored)
    said = guide.first()["guidance"]
    assert "of the, to be" in said and "as is" not in said
    assert read.value == 3
