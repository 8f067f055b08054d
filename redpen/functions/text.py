"""Column expressions over report text.  All run inside Spark; none calls Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from redpen.functions import fixed


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def words_literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(fixed.WHITESPACE))


def collapse(c: Column) -> Column:
    """Each run of white space as one space; single spaces, the most by far, are not touched."""
    white = r"[\s\x1c-\x1f]"
    return F.regexp_replace(c, rf"(?U) {white}+|[\t-\x1f\x85-\u3000&&{white}]{white}*", " ")


def squash(c: Column) -> Column:
    """Lower case, single spaces, no outer space: the key for comparing wording."""
    return F.trim(F.lower(collapse(c)))


def paragraph_texts(text: Column) -> Column:
    """The non-blank lines of a text, stripped."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda p: p != "")


def sentences(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"(?U)(?<=[.!?])\s+"), lambda s: s != "")


def bare_sentence(c: Column) -> Column:
    """Lower-case letters, digits and single spaces only: the key for repetition."""
    return F.trim(collapse(F.regexp_replace(F.lower(c), r"(?U)[^a-z0-9\s]+", "")))


def has_url_or_ip(c: Column) -> Column:
    """The patterns are tried only where their signs are: ``://`` or ``www.``, three points, two colons."""
    url = F.contains(c, F.lit("://")) | F.contains(F.lower(c), F.lit("www."))
    points, colons = F.substring_index(c, ".", 3) != c, F.substring_index(c, ":", 2) != c
    return (url & c.rlike(fixed.URL)) | (points & c.rlike(fixed.IPV4)) | (colons & c.rlike(fixed.IPV6))


def rewrite_tokens(c: Column) -> Column:
    stop = words_literal(fixed.REWRITE_STOP_WORDS)
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9']+)"), F.lit(1))
    return F.filter(found, lambda w: ~F.array_contains(stop, w))


def high_signal(old: Column, new: Column) -> Column:
    """True when a rewrite is one line and both sides share enough wording."""
    tokens = F.struct(rewrite_tokens(old).alias("a"), rewrite_tokens(new).alias("b"))

    def judge(t: Column) -> Column:
        shared = F.size(F.array_intersect(t["a"], t["b"]))
        shorter = F.least(F.size(t["a"]), F.size(t["b"]))
        return (shorter >= 2) & (shared >= F.when(shorter >= 6, 2).otherwise(1))

    one_line = ~F.contains(old, F.lit("\n")) & ~F.contains(new, F.lit("\n"))
    return one_line & bind(tokens, judge)


def plain_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z']+)"), F.lit(1))


def ngrams(words: Column, n: int) -> Column:
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1)))
    empty = F.array().cast("array<string>")
    return F.coalesce(F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")), empty)


def all_ngrams(c: Column, shortest: int = 3, longest: int = 5) -> Column:
    return bind(plain_words(c), lambda w: F.concat(*[ngrams(w, n) for n in range(shortest, longest + 1)]))


#: Values of a run's key.
RUN_KEYS = 1 << 16


def word_runs(c: Column, shortest: int = 3, longest: int = 5) -> Column:
    """The word runs of ``all_ngrams`` packed into stretches: (key, heads, stretch).

    A run is known by the least hash among the pairs of words (single words, if runs of one word count) in its
    first ``shortest`` words; so equal runs have one key.  Neighbours that share it lie in one stretch, at its first ``heads`` words.
    """
    pair = min(shortest, 2)
    window = shortest - pair + 1

    def packed(w: Column) -> Column:
        scores = F.transform(F.sequence(F.lit(1), F.size(w) - (pair - 1)), lambda i: F.hash(*[F.get(w, i - 1 + k) for k in range(pair)]))
        return bind(scores, lambda s: bind(least_of(s), lambda least: bind(starts_of(least), lambda starts: stretches_of(w, least, starts))))

    def least_of(s: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(s) - window)
        return F.transform(at, lambda i: F.least(*[F.get(s, i + k) for k in range(window)]) if window > 1 else F.get(s, i))

    def starts_of(least: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(least) - 1)
        return F.filter(at, lambda i: (i == 0) | (F.get(least, i) != F.get(least, i - 1)))

    def stretches_of(w: Column, least: Column, starts: Column) -> Column:
        def stretch(at: Column, nth: Column) -> Column:
            heads = F.coalesce(F.get(starts, nth + 1), F.size(least)) - at
            words = F.slice(w, at + 1, heads + (longest - 1))
            return F.struct(F.pmod(F.get(least, at), F.lit(RUN_KEYS)).alias("key"), heads.alias("heads"), F.array_join(words, " ").alias("stretch"))

        return F.transform(starts, stretch)

    return bind(plain_words(c), lambda w: F.when(F.size(w) >= shortest, packed(w)))


def stretch_ngrams(stretch: Column, heads: Column, shortest: int = 3, longest: int = 5) -> Column:
    """The word runs that begin at the first ``heads`` words of a stretch."""
    def runs(w: Column) -> Column:
        def of_head(at: Column) -> Column:
            lengths = F.sequence(F.lit(shortest), F.least(F.lit(longest), F.size(w) - at + 1))
            return F.transform(lengths, lambda n: F.array_join(F.slice(w, at, n), " "))

        return F.flatten(F.transform(F.sequence(F.lit(1), heads), of_head))

    return bind(F.split(stretch, " "), runs)


def straight_quotes(c: Column) -> Column:
    return F.translate(c, "“”‘’", "\"\"''")


def quoted_phrases(c: Column) -> Column:
    """Quoted spans of 3 to 120 characters, double quotes first, one per wording."""
    straight = straight_quotes(c)
    spans = F.concat(
        F.regexp_extract_all(straight, F.lit('"([^"]{3,120})"'), F.lit(1)),
        F.regexp_extract_all(straight, F.lit("'([^']{3,120})'"), F.lit(1)),
    )
    keyed = F.transform(spans, lambda s: F.struct(strip(s).alias("phrase"), squash(s).alias("key")))

    def first_of_each(pairs: Column) -> Column:
        kept = F.filter(
            pairs,
            lambda p, i: (p["key"] != "") & (F.array_position(pairs["key"], p["key"]) == i + 1),
        )
        return kept["phrase"]

    return F.coalesce(bind(keyed, first_of_each), F.array().cast("array<string>"))


def phrase_count(text: Column, phrase: Column) -> Column:
    """Non-overlapping occurrences of ``phrase``, ignoring case."""
    return exact_count(F.lower(text), F.lower(phrase))


def exact_count(text: Column, phrase: Column) -> Column:
    removed = F.length(text) - F.length(F.replace(text, phrase, F.lit("")))
    return F.when(F.length(phrase) > 0, (removed / F.length(phrase)).cast("int")).otherwise(0)


def overlap_tokens(c: Column) -> Column:
    stop = words_literal(fixed.OVERLAP_STOP_WORDS)
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]{3,})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: ~F.array_contains(stop, w)))


def supporting_sentence(text: Column, message: Column, hint: Column) -> Column:
    """The sentence a message is about: a quoted one, else the closest in wording."""
    facts = F.struct(
        sentences(F.coalesce(text, F.lit(""))).alias("sentences"),
        quoted_phrases(F.coalesce(message, F.lit(""))).alias("quoted"),
        F.array_union(
            overlap_tokens(F.coalesce(hint, F.lit(""))), overlap_tokens(F.coalesce(message, F.lit("")))
        ).alias("wanted"),
    )

    def choose(f: Column) -> Column:
        quoted_hits = F.transform(
            f["quoted"],
            lambda q: F.get(F.filter(f["sentences"], lambda s: F.contains(F.lower(s), F.lower(q))), F.lit(0)),
        )
        by_quote = F.get(F.filter(quoted_hits, lambda s: s.isNotNull()), F.lit(0))
        scored = F.transform(
            f["sentences"],
            lambda s, i: bind(
                overlap_tokens(s),
                lambda own: F.when(
                    F.size(own) > 0,
                    F.struct(
                        F.size(F.array_intersect(f["wanted"], own)).alias("score"),
                        (-i).alias("earlier"),
                        s.alias("sentence"),
                    ),
                ),
            ),
        )
        by_wording = F.array_max(scored)["sentence"]
        return F.coalesce(by_quote, by_wording, F.get(f["sentences"], F.lit(0)), F.lit(""))

    return bind(facts, choose)


def rubric_rating(score: Column) -> Column:
    v = score.try_cast("int")
    return F.when(v >= 19, "Strong").when(v >= 10, "Fair").otherwise("Weak")


# --- report structure ---------------------------------------------------------


def heading_level(style_name: Column) -> Column:
    digits = F.regexp_extract(F.replace(F.lower(style_name), F.lit(" "), F.lit("")), r"\Aheading([0-9]+)", 1)
    return F.nullif(digits.try_cast("int"), F.lit(0))


def table_value(rows: Column, label: str) -> Column:
    """The cell to the right of the first cell that reads ``label``."""
    wanted = label.lower()
    hits = F.flatten(
        F.transform(
            rows,
            lambda r: F.transform(
                F.filter(
                    F.arrays_zip(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))).alias("cell"),
                                 F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))).alias("value")),
                    lambda z: F.lower(strip(z["cell"])) == wanted,
                ),
                lambda z: strip(z["value"]),
            ),
        )
    )
    return F.get(hits, F.lit(0))


def opens_finding(rows: Column) -> Column:
    """A table opens a finding when its first four rows mention a threat level."""
    named = F.exists(F.slice(rows, 1, 4), lambda r: F.exists(r, lambda c: F.contains(c, F.lit("Threat Level"))))
    return F.coalesce(named, F.lit(False))


def label_of(line: Column) -> Column:
    """Lower-cased label of a line that is nothing but ``Label:``, else null."""
    bare = strip(line)
    label = F.regexp_extract(bare, r"(?U)\A([A-Za-z\s]+):\z", 1)
    return F.when(F.endswith(bare, F.lit(":")) & (label != ""), F.lower(strip(label)))


def field_of(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for field, names in fixed.FIELD_LABELS.items():
        out = F.when(label.isin(names), field).otherwise(out)
    return out


def shows_evidence(line: Column) -> Column:
    """The line has an evidence marker; plain substring tests come before the patterns."""
    def judge(low: Column) -> Column:
        possible = F.lit(False)
        for word in fixed.EVIDENCE_WORDS:
            possible = possible | F.contains(low, F.lit(word))
        return possible & low.rlike("(?U)" + "|".join(fixed.EVIDENCE_MARKERS))

    return bind(F.lower(strip(line)), judge)


def threat_level(text: Column) -> Column:
    label = F.regexp_extract(text, fixed.THREAT_LABEL, 1)
    word = F.regexp_extract(text, fixed.THREAT_WORD, 1)
    return F.initcap(F.coalesce(blank_to_null(label), blank_to_null(word)))


def severity(text: Column) -> Column:
    return F.initcap(blank_to_null(F.regexp_extract(text, fixed.SEVERITY_WORD, 1)))


def cvss_parts(text: Column) -> Column:
    """The three readings of a score, best first; each may be null."""
    low = F.lower(text)
    loose = F.filter(
        F.transform(F.regexp_extract_all(low, F.lit(fixed.CVSS_ANY), F.lit(1)), lambda d: d.try_cast("double")),
        lambda v: v != 4.0,
    )
    return F.struct(
        F.regexp_extract(low, fixed.CVSS_BEFORE, 1).try_cast("double").alias("before"),
        F.regexp_extract(low, fixed.CVSS_AFTER, 1).try_cast("double").alias("after"),
        F.get(loose, F.lit(0)).alias("loose"),
    )


def cvss_score(text: Column, mode: str = "reference") -> Column:
    """Score in a CVSS text.

    ``reference`` keeps the established reading, in which ``10.0 CVSS:`` is 0.0 and
    a version such as ``CVSS:3.1/...`` counts as a score.  ``strict`` drops version
    tokens and vectors first and reads scores from 0 to 10.
    """
    if mode == "reference":
        return bind(cvss_parts(text), lambda p: F.coalesce(p["before"], p["after"], p["loose"]))
    plain = F.regexp_replace(F.lower(text), r"(?U)cvss\s*:?\s*v?[0-9]\.[0-9](?=\s*[:=/])(?:/[a-z0-9:/.]*)?", "cvss")
    found = F.regexp_extract(plain, r"(?<![0-9.])(10(?:\.0)?|[0-9](?:\.[0-9])?)(?![0-9.]|\s*/)", 1)
    return found.try_cast("double")


def cvss_band(score: Column) -> Column:
    return (
        F.when(score >= 9.0, "Critical")
        .when(score >= 7.0, "High")
        .when(score >= 4.0, "Medium")
        .when(score > 0, "Low")
        .when(score.isNotNull(), "None")
    )


# --- report names ---------------------------------------------------------------


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def version_part(stem: Column, part: int) -> Column:
    """Major (1) or minor (2) number of the last version token, else null."""
    return F.get(F.reverse(F.regexp_extract_all(stem, F.lit(fixed.VERSION_TOKEN), F.lit(part))), F.lit(0)).try_cast("int")


def report_family(stem: Column) -> Column:
    bare = F.lower(F.regexp_replace(F.regexp_replace(stem, fixed.VERSION_TOKEN, " "), r"(?U)[\W_]+", ""))
    return F.when(version_part(stem, 1).isNotNull(), blank_to_null(bare))
