"""Secret scans through a trigram inverted index.

Each rule's regular expression gives a Boolean query over trigrams: every text it can match
holds all trigrams of at least one alternative.  Postings (trigram, row) are written once for
the trigrams that the rules name; intersecting them leaves candidate rows, which the
expressions then verify.  A rule whose expression has an alternative without any trigram
is run over every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser as parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redpen.llm.common import shared_folder


@dataclass(frozen=True)
class Rule:
    """``least`` code points are needed in ``group`` of a match; shorter matches are dropped, but use up their text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    # A run too short stays too short from any later start inside it, so the least lengths stand in the expressions.
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("github", r"ghp_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: An expression with more alternatives than this counts as one without trigrams.
MOST_ALTERNATIVES = 64


def _alternatives(items) -> list[str]:
    """The literal skeletons of a parsed expression, in lower case; a zero character stands for anything else."""
    found = [""]
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            ways = [chr(arg).lower()]
        elif name == "SUBPATTERN":
            ways = _alternatives(arg[-1])
        elif name == "BRANCH":
            ways = [way for branch in arg[1] for way in _alternatives(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            ways = [way + "\0" for way in _alternatives(arg[2])]
        elif name == "AT":
            ways = [""]
        else:
            ways = ["\0"]
        if len(found) * len(ways) > MOST_ALTERNATIVES:
            ways = ["\0"]
        found = [a + b for a in found for b in ways]
    return found


def trigram_query(pattern: str) -> list[list[str]] | None:
    """Alternatives, each a list of trigrams that must all occur in the lower-cased text; None: any text may match."""
    clauses = []
    for way in _alternatives(parser.parse(pattern)):
        grams = sorted({run[i : i + 3] for run in way.split("\0") for i in range(len(run) - 2)})
        if not grams:
            return None
        clauses.append(grams)
    return clauses


def index(docs: DataFrame, rules=RULES) -> DataFrame:
    """The postings (key, trigram) of the trigrams that ``rules`` name, written in order of the trigrams.

    ``docs`` has ``key`` and ``text``.  Texts are folded to lower case first.
    """
    grams = sorted({g for r in rules for clause in trigram_query(r.pattern) or [] for g in clause})
    held = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("folded"), g))
    postings = docs.select("key", F.lower("text").alias("folded")).select("key", F.explode(held).alias("trigram"))
    path = shared_folder(docs.sparkSession, "trigrams")
    postings.distinct().sortWithinPartitions("trigram", "key").write.parquet(path)
    return docs.sparkSession.read.schema(postings.schema).parquet(path)


def candidates(postings: DataFrame, rules=RULES) -> DataFrame:
    """(key, kinds): the rows that hold all trigrams of some alternative of each kind."""
    spark = postings.sparkSession
    clauses = [(r.kind, n, g, len(c)) for r in rules for n, c in enumerate(trigram_query(r.pattern) or []) for g in c]
    # the size of this table is fixed by the rules alone
    wanted = F.broadcast(spark.createDataFrame(clauses, "kind string, clause int, trigram string, needed int"))
    met = postings.join(wanted, "trigram").groupBy("key", "kind", "clause", "needed").agg(F.count(F.lit(1)).alias("n"))
    return met.where("n = needed").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _matches(rule: Rule, text: Column) -> Column:
    """array<struct<kind, i, gap, len, inner>>: the matches in order, each with the code points since the one before."""
    split = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    both = F.zip_with(hits, inner, lambda h, g: F.struct(F.length(h).alias("len"), F.length(g).alias("inner")))
    # there is one more gap than there are matches; it has no partner
    zipped = F.zip_with(both, split, lambda m, gap: F.struct(m["len"].alias("len"), m["inner"].alias("inner"), F.length(gap).alias("gap")))
    real = F.filter(zipped, lambda m: m["len"].isNotNull())
    placed = F.transform(real, lambda m, i: F.struct(F.lit(rule.kind).alias("kind"), i.alias("i"), m["gap"].alias("gap"), m["len"].alias("len"), m["inner"].alias("inner")))
    return placed


def _found(rows: DataFrame, rules, listed: bool) -> DataFrame:
    """One row per match of ``rules`` in ``rows``; with ``listed`` only of the kinds in the column ``kinds``."""
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,len:int,inner:int>>")
    arrays = []
    for r in rules:
        there = F.col("text").rlike(r.pattern)
        if listed:
            there = F.array_contains("kinds", r.kind) & there
        arrays.append(F.when(there, _matches(r, F.col("text"))).otherwise(none))
    return rows.select("doc_id", "key", F.inline(F.concat(*arrays)))


def spans(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, key, kind, start, stop) of every match, in code points, ``stop`` exclusive, once per distinct row.

    ``docs`` has doc_id, text and key, a hash of both; rows equal in both have the same spans.
    """
    listed = [r for r in rules if trigram_query(r.pattern) is not None]
    rest = [r for r in rules if trigram_query(r.pattern) is None]
    found = candidates(index(docs, listed), listed).withColumnRenamed("key", "c_key")
    rows = _found(docs.join(found, F.col("key") == F.col("c_key")), listed, True)
    if rest:
        rows = rows.unionByName(_found(docs, rest, False))
    run = Window.partitionBy("doc_id", "key", "kind").orderBy("i")
    placed = rows.distinct().withColumn("stop", F.sum(F.col("gap") + F.col("len")).over(run))
    enough = F.lit(False)
    for r in rules:
        enough = enough | ((F.col("kind") == r.kind) & (F.col("inner") >= r.least))
    return placed.where(enough).select("doc_id", "key", "kind", (F.col("stop") - F.col("len")).alias("start"), "stop")


def scanned(docs: DataFrame, rules=RULES) -> DataFrame:
    """Per row of ``docs``: doc_id, a count ``n_<kind>`` for each base kind, ``base_sha256`` and ``spans``.

    Null and empty texts have no spans (the hash is that of the empty string).  Rows that repeat
    a doc_id with another text are scanned each for itself; null ids are kept.  An empty table
    gives no rows.  Columns other than doc_id and text are ignored.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    order = F.array_position(F.array(*(F.lit(r.kind) for r in rules)), F.col("kind"))
    item = F.struct("start", order.alias("rank"), F.concat_ws(":", "kind", "start", "stop").alias("label"))
    is_base = F.col("kind").isin([r.kind for r in rules if r.base])
    per_row = spans(keyed, rules).groupBy("doc_id", "key").agg(
        *(F.count(F.when(F.col("kind") == r.kind, 1)).alias(f"n_{r.kind}") for r in rules if r.base),
        F.sort_array(F.collect_list(F.when(is_base, item))).alias("base"),
        F.sort_array(F.collect_list(item)).alias("all"),
    )
    per_row = per_row.withColumnsRenamed({"doc_id": "s_doc_id", "key": "s_key"})
    joined = keyed.select("doc_id", "key").join(per_row, (F.col("key") == F.col("s_key")) & F.col("doc_id").eqNullSafe(F.col("s_doc_id")), "left")

    def text_of(name: str) -> Column:
        return F.coalesce(F.array_join(F.col(f"{name}.label"), ","), F.lit(""))

    return joined.select(
        "doc_id",
        *(F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules if r.base),
        F.sha2(text_of("base"), 256).alias("base_sha256"),
        text_of("all").alias("spans"),
    )


def op5_query(spark, sf_dir: str) -> DataFrame:
    from redpen.llm.common import table

    return scanned(table(spark, sf_dir, "documents"))
