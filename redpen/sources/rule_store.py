"""Reviewers' decisions kept in a folder: rules are only ever added, in numbered commits.

An upsert writes the rules that are new to a folder of their own and then the next commit, a small file
that names the folders in force.  Creating that file fails if another writer took the number; the upsert
then looks at what that one added and tries again.  Whatever no commit names does not count.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from redpen.operators import feedback
from redpen.operators.lineage import settle
from redpen.sources.configs import _exists

RULES = "kind string, decision string, a string, b string, commit bigint, doc_id bigint, seq bigint"
#: Folders in force before an upsert gathers them into one.
FOLDERS = 32


class CommitTaken(RuntimeError):
    """Another writer made the commit of this number."""


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def last_commit(spark: SparkSession, folder: str) -> tuple[int, list[str]]:
    """The number of the last commit and the folders it names; 0 and none before the first."""
    if not _exists(spark, f"{folder}/commits"):
        return 0, []
    path, files = _path(spark, f"{folder}/commits")
    last = max((int(entry.getPath().getName()) for entry in files.listStatus(path) if entry.getPath().getName().isdigit()), default=0)
    if not last:
        return 0, []
    text = spark.read.text(f"{folder}/commits/{last:012d}", wholetext=True).first()["value"]
    return last, json.loads(text)


def _commit(spark: SparkSession, folder: str, number: int, folders: list[str]) -> None:
    path, files = _path(spark, f"{folder}/commits/{number:012d}")
    try:
        out = files.create(path, False)
    except Exception as error:
        if files.exists(path):
            raise CommitTaken(number) from error
        raise
    out.write(json.dumps(folders).encode())
    out.close()


def stored(spark: SparkSession, folder: str, folders: list[str] | None = None) -> DataFrame:
    """All rules in force: kind (rewrite, diagnostic), decision, a, b and where they were first reviewed."""
    folders = last_commit(spark, folder)[1] if folders is None else folders
    if not folders:
        return spark.createDataFrame([], RULES)
    return spark.read.schema(RULES).parquet(*[f"{folder}/rules/{name}" for name in folders])


def rewrites(rules: DataFrame) -> DataFrame:
    """decision, from_text, to_text, pos of stored rewrite decisions; ``pos`` is the order in which they came."""
    pos = F.struct("commit", "doc_id", "seq")
    return rules.filter("kind = 'rewrite'").select("decision", F.col("a").alias("from_text"), F.col("b").alias("to_text"), pos.alias("pos"))


def diagnostics(rules: DataFrame) -> DataFrame:
    return rules.filter("kind = 'diagnostic'").select("decision", F.col("a").alias("code"), F.col("b").alias("message_contains"))


def upsert(spark: SparkSession, folder: str, resolved: DataFrame, tries: int = 10) -> DataFrame:
    """Add what reviewers decided (``feedback.resolve_decisions``) to the stored rules; returns how many of each kind were new.

    A decision already stored is left as it is, in its first wording.
    """
    resolved = settle(resolved)
    for _ in range(tries):
        number, folders = last_commit(spark, folder)
        known = stored(spark, folder, folders)
        fresh = {
            "rewrite": (feedback.new_rewrites(rewrites(known), feedback.reviewed_rewrites(resolved)), feedback.REWRITE_COLUMNS),
            "diagnostic": (feedback.new_diagnostics(diagnostics(known), feedback.reviewed_diagnostics(resolved)), feedback.DIAGNOSTIC_COLUMNS),
        }
        new = [
            rows.select(
                F.lit(kind).alias("kind"), "decision", F.col(a).alias("a"), F.col(b).alias("b"),
                F.lit(number + 1).cast("bigint").alias("commit"), F.col("doc_id").cast("bigint"), F.col("seq").cast("bigint"),
            )
            for kind, (rows, (a, b)) in fresh.items()
        ]
        gather = len(folders) >= FOLDERS
        rows = new[0].unionByName(new[1])
        name = uuid.uuid4().hex
        (rows.unionByName(known) if gather else rows).write.parquet(f"{folder}/rules/{name}")
        try:
            _commit(spark, folder, number + 1, [name] if gather else [*folders, name])
        except CommitTaken:
            continue
        added = stored(spark, folder, [name]).filter(F.col("commit") == number + 1)
        return added.groupBy("kind", "decision").agg(F.count("*").alias("added"))
    raise CommitTaken(f"{tries} times")
