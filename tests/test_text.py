"""Text functions on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from redpen.functions import fixed, text as t
from redpen.operators import anchors, feedback, review


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, score",
    [
        ("7.1 CVSS:4.0/AV:N", 7.1), ("CVSS: 7.5", 7.5), ("CVSS v3.1: 7.5", 7.5), ("CVSS 3.1: 7.5", 3.1),
        ("CVSS:3.1/AV:N", 3.1), ("10.0 CVSS:", 0.0), ("4.0", None), ("score 4.0 then 6", 6.0), ("none", None),
    ],
)
def test_cvss_score_keeps_the_established_reading(spark, text, score):
    assert value(spark, t.cvss_score(F.lit(text))) == score


@pytest.mark.parametrize("text, score", [("10.0 CVSS:", 10.0), ("CVSS 3.1: 7.5", 7.5), ("9.8 CVSS:3.1/AV:N", 9.8)])
def test_cvss_score_strict(spark, text, score):
    assert value(spark, t.cvss_score(F.lit(text), mode="strict")) == score


@pytest.mark.parametrize("score, band", [(9.0, "Critical"), (8.9, "High"), (7.0, "High"), (4.0, "Medium"), (3.9, "Low"), (0.0, "None")])
def test_cvss_band(spark, score, band):
    assert value(spark, t.cvss_band(F.lit(score))) == band


@pytest.mark.parametrize("name, level", [("heading 2", 2), ("Heading10", 10), ("heading 0", None), ("Title", None), ("my heading 1", None)])
def test_heading_level(spark, name, level):
    assert value(spark, t.heading_level(F.lit(name))) == level


def test_sentences_split_after_end_marks_only(spark):
    assert value(spark, t.sentences(F.lit(" One. Two!\n Three\nfour? "))) == ["One.", "Two!", "Three\nfour?"]
    assert value(spark, t.sentences(F.lit("  "))) == []


def test_strip_and_squash_know_unicode_space(spark):
    assert value(spark, t.strip(F.lit("  a b \n"))) == "a b"
    assert value(spark, t.squash(F.lit(" A  B\t\nc "))) == "a b c"


def test_bare_sentence_drops_everything_but_plain_letters(spark):
    assert value(spark, t.bare_sentence(F.lit("Héllo, the 2nd  TIME!"))) == "hllo the 2nd time"


@pytest.mark.parametrize(
    "old, new, good",
    [
        ("the tested device", "the tested unit", True), ("alpha", "alpha beta", False), ("alpha beta", "gamma delta", False),
        ("a1 b1 c1 d1 e1 f1", "a1 x2 x3 x4 x5 x6", False), ("a1 b1 c1 d1 e1 f1", "a1 b1 x3 x4 x5 x6", True), ("alpha\nbeta", "alpha beta", False),
    ],
)
def test_high_signal(spark, old, new, good):
    assert value(spark, t.high_signal(F.lit(old), F.lit(new))) is good


def test_ngrams_of_short_texts_are_empty(spark):
    assert value(spark, t.all_ngrams(F.lit("it's two"))) == []
    assert value(spark, t.all_ngrams(F.lit("a b c d"))) == ["a b c", "b c d", "a b c d"]


def test_quoted_phrases_double_first_and_once(spark):
    text = "'late one' then “Early  One” and \"early one\" and 'no'"
    assert value(spark, t.quoted_phrases(F.lit(text))) == ["Early  One", "late one"]


def test_phrase_count_does_not_overlap(spark):
    assert value(spark, t.phrase_count(F.lit("aAaa b"), F.lit("aa"))) == 2
    assert value(spark, t.phrase_count(F.lit("abc"), F.lit(""))) == 0


def test_table_value_takes_first_cell_with_a_neighbour(spark):
    rows = F.array(F.array(F.lit("x"), F.lit("CVSS")), F.array(F.lit(" cvss "), F.lit(" 7.1 "), F.lit("y")))
    assert value(spark, t.table_value(rows, "CVSS")) == "7.1"


@pytest.mark.parametrize(
    "text, found",
    [
        ("[ACCEPT] fine", "accept"), ("[ rejected ] no", "reject"), ("Reject: no", "reject"), ("accepted", "accept"),
        ("unaccepted", None), ("[accept] [reject]", "reject"), ("accept: x [rejected]", "reject"), ("I accept it", None),
    ],
)
def test_decision(spark, text, found):
    assert value(spark, feedback.decision(F.lit(text))) == found


def test_rewrite_pair_and_rule_of_a_comment(spark):
    text = "[accept] [RULE][CODE-1][warning] Preferred rewrite:  “old words” → “new words”"
    assert value(spark, feedback.rewrite_pair(F.lit(text))).asDict() == {"from_text": "old words", "to_text": "new words"}
    rule = value(spark, feedback.diagnostic_rule(F.lit(text)))
    assert rule["code"] == "CODE-1" and rule["message_contains"].startswith("Preferred rewrite: “old words”")
    assert value(spark, feedback.rewrite_pair(F.lit("no pair"))) is None


def test_section_hints(spark):
    assert value(spark, anchors.section_hints(F.lit("Scope section and Methods / Tools, scope"))) == ["scope", "methods", "tools"]


@pytest.mark.parametrize(
    "text, whole, objects",
    [
        ('[{"a": 1}]', '[{"a": 1}]', None), ('x ```json {"a": 2}``` y', '{"a": 2}', '{"a": 2}'),
        ('see [not json] then ["]", 1] end', '["]", 1]', None), ('say {"issues": [1, 2]} now', "[1, 2]", None), ("", None, None), ("none", None, None),
    ],
)
def test_json_in_responses(text, whole, objects):
    assert review._json_in(text, objects_only=False) == whole
    assert review._json_in(text, objects_only=True) == objects


def test_review_message_rules(spark):
    text = F.lit("Very good. Very good. It is very good and VERY GOOD.")
    counted = value(spark, review.counted_message(F.lit("Avoid 'very good'"), text))
    assert (counted["message"], counted["max_count"]) == ("Avoid 'very good' Counts in narrative: \"very good\"=4x.", 4)
    assert value(spark, review.grounded(F.lit("use 'a' instead of 'zzz'"), text)) is False
    assert value(spark, review.grounded(F.lit("use 'a' instead of 'good'"), text)) is True
    assert [value(spark, review.elevated(F.lit(s), F.lit(n))) for s, n in [("suggestion", 2), ("Suggestion", 3), ("warning", 5), ("warning", 6)]] == [
        "suggestion", "warning", "warning", "error",
    ]


@pytest.mark.parametrize("shortest, longest", [(3, 5), (1, 2), (2, 2), (4, 6)])
def test_stretches_hold_each_word_run_once(spark, shortest, longest):
    texts = ["", "it's two", "a b c", "the the the the the the the of the", " ".join(f"w{chr(97 + i * i % 23)} of" for i in range(60))]
    docs = spark.createDataFrame([(x,) for x in texts], "text string")
    direct = docs.select(F.explode(t.all_ngrams(F.col("text"), shortest, longest)).alias("g"))
    packed = docs.select(F.inline(t.word_runs(F.col("text"), shortest, longest)))
    runs = packed.select("key", F.explode(t.stretch_ngrams(F.col("stretch"), F.col("heads"), shortest, longest)).alias("g"))
    assert sorted(r["g"] for r in runs.collect()) == sorted(r["g"] for r in direct.collect())
    assert runs.distinct().count() == direct.distinct().count()  # one key for equal runs


def test_only_white_space_that_changes_is_replaced(spark):
    points = [chr(c) for c in range(1, 0x3100)] + ["😀", "\ufeff"]
    texts = [f"{a}{p}b {p} c{p}{p} D.{p}" for p in points for a in ("", "a")] + ["", " ", "  a  b "]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    once = [F.regexp_replace(c, f"[{fixed.WHITESPACE}]+", " ") for c in (F.col("x"), F.regexp_replace(F.lower("x"), r"(?U)[^a-z0-9\s]", ""))]
    assert df.filter((t.collapse(F.col("x")) != once[0]) | (t.bare_sentence(F.col("x")) != F.trim(once[1]))).count() == 0
    # single spaces make no match
    pattern = r"(?U) [\s\x1c-\x1f]+|[\t-\x1f\x85-\u3000&&[\s\x1c-\x1f]][\s\x1c-\x1f]*"
    assert pattern in df.select(t.collapse(F.col("x")))._jdf.queryExecution().analyzed().toString()
    assert value(spark, F.regexp_count(F.lit("a b  c d\te"), F.lit(pattern))) == 2
