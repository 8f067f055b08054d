"""Incremental learning: only pairs whose reports or settings changed are read again.

State lives under one folder.  Every refresh writes a new generation of the pairs' state, of the
contributions of recomputed pairs and of the totals, and appends to ``commits`` last.
Readers follow the last commit, so a refresh that dies halfway leaves the earlier one in force.

Totals move by signed deltas: what recomputed pairs contribute now is added, what they and
pairs no longer there contributed before is taken off.  Reused pairs are not read at all.
Generations whose contributions are spread thin are gathered into one, and those that neither the last
commit nor the one before refers to are removed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import batched

from pyspark.sql import DataFrame, SparkSession, functions as F

from redpen.operators.lineage import settle
from redpen.plans.views import Views
from redpen.sources.configs import _exists

SETTINGS = {"ngram_min": 3, "ngram_max": 5, "track_changes": True, "track_weight": 2}
SIGNATURE = ["old_size", "old_modified", "new_size", "new_modified"]
HASHES = ["old_sha256", "new_sha256"]
STATE = (
    "pair_id string, fingerprint string, old_size bigint, old_modified timestamp, new_size bigint, "
    "new_modified timestamp, old_sha256 string, new_sha256 string, gen bigint"
)
TOTALS = "phrase string, old bigint, new bigint"
#: Paths handed to one read of changed files.
PATHS = 10_000


def fingerprint(settings: dict | None = None) -> str:
    """Hash of the settings that shape a pair's contribution; thresholds do not."""
    return hashlib.sha256(json.dumps(settings or SETTINGS, sort_keys=True).encode()).hexdigest()


# --- which pairs changed -------------------------------------------------------------------


def _sided(facts: DataFrame, name: str) -> DataFrame:
    return facts.select(*[F.col(c).alias(f"{name}_{'doc' if c == 'doc_id' else c}") for c in facts.columns])


def pair_stats(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs with size and time of both reports (``files``: doc_id, size, modified and more)."""
    facts = files.select("doc_id", "size", "modified")
    return pairs.join(_sided(facts, "old"), "old_doc").join(_sided(facts, "new"), "new_doc")


def hashed(files: DataFrame) -> DataFrame:
    return files.select("doc_id", F.sha2("content", 256).alias("sha256"))


def hashed_rows(files: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A hash function for contents that lie in a table with doc_id and content."""
    return lambda chosen: hashed(files.join(chosen, "doc_id", "left_semi"))


def hashed_paths(files: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A hash function for listed files (doc_id, path) that opens only the chosen ones, some thousand paths at a time."""
    def hashes(chosen: DataFrame) -> DataFrame:
        spark = files.sparkSession
        listed = files.select("doc_id", "path")
        parts = [spark.createDataFrame([], "path string, sha256 string")]
        paths: Iterator[str] = (row["path"] for row in listed.join(chosen, "doc_id", "left_semi").select("path").toLocalIterator())
        for some in batched(paths, PATHS):
            content = spark.read.format("binaryFile").load(list(some))
            parts.append(settle(content.select("path", F.sha2("content", 256).alias("sha256"))))
        read = parts[0]
        for part in parts[1:]:
            read = read.unionByName(part)
        return listed.join(read, "path").select("doc_id", "sha256")

    return hashes


def pair_signatures(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs with size, time and content hash of both reports (``files``: doc_id, size, modified, content); reads all contents."""
    facts = files.select("doc_id", "size", "modified", F.sha2("content", 256).alias("sha256"))
    return pairs.join(_sided(facts, "old"), "old_doc").join(_sided(facts, "new"), "new_doc")


def pair_status(pairs: DataFrame, state: DataFrame, current: str, full: bool = False) -> DataFrame:
    """Each pair with status reused_stat, reused_hash or recomputed; stored pairs no longer there are stale.

    Without hash columns in ``pairs`` a pair that size and time do not settle is ``unsure``.
    """
    known = state.select("pair_id", *[F.col(c).alias(f"_{c}") for c in state.columns if c != "pair_id"])

    def same(columns: list[str]):
        out = F.col("_fingerprint") == current
        for c in columns:
            out = out & (F.col(c) == F.col(f"_{c}"))
        return F.coalesce(out, F.lit(False))

    status = F.when(F.lit(full), "recomputed").when(same(SIGNATURE), "reused_stat")
    if set(HASHES) <= set(pairs.columns):
        status = status.when(same(HASHES), "reused_hash").otherwise("recomputed")
    else:
        status = status.otherwise("unsure")
    present = pairs.withColumn("_present", F.lit(True)).join(known, "pair_id", "full")
    return present.withColumn("status", F.when(F.col("_present").isNull(), "stale").otherwise(status)).drop("_present")


def examined(pairs: DataFrame, state: DataFrame, current: str, hashes: Callable[[DataFrame], DataFrame], full: bool = False) -> DataFrame:
    """The pairs of ``pair_stats`` with status and hashes.  Contents are read only of reports that size and time leave open."""
    first = settle(pair_status(pairs, state, current, full))
    open_ = first.filter("status in ('unsure', 'recomputed')")
    chosen = open_.select(F.explode(F.array("old_doc", "new_doc")).alias("doc_id")).distinct()
    found = settle(hashes(chosen))
    second = first.join(_sided(found, "old"), "old_doc", "left").join(_sided(found, "new"), "new_doc", "left")
    equal = (F.col("_fingerprint") == current) & (F.col("old_sha256") == F.col("_old_sha256")) & (F.col("new_sha256") == F.col("_new_sha256"))
    status = F.when(F.col("status") == "unsure", F.when(F.coalesce(equal, F.lit(False)), "reused_hash").otherwise("recomputed")).otherwise(F.col("status"))
    return second.withColumns({"status": status} | {c: F.coalesce(c, f"_{c}") for c in HASHES})


# --- the stored state ----------------------------------------------------------------------------


def _commits(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the last two commits, newest first."""
    if not _exists(spark, f"{folder}/commits"):
        return []
    done = spark.read.schema("gen bigint").parquet(f"{folder}/commits").orderBy(F.desc("gen")).limit(2)
    return [row["gen"] for row in done.collect()]


def read_state(spark: SparkSession, folder: str) -> DataFrame:
    commits = _commits(spark, folder)
    if not commits:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{folder}/state/written={commits[0]}")


def _generations(spark: SparkSession, folder: str, commit: int) -> list[int]:
    """The generations that a commit refers to; there are at most as many as are kept, plus one."""
    state = spark.read.schema(STATE).parquet(f"{folder}/state/written={commit}")
    return sorted(row["gen"] for row in state.select("gen").distinct().collect())


def _stored(spark: SparkSession, folder: str, name: str, owners: DataFrame, generations: list[int]) -> DataFrame | None:
    """Contributions of the pairs in ``owners`` (pair_id, gen); None when nothing was ever stored."""
    paths = [f"{folder}/contributions/{name}/gen={g}" for g in generations]
    if not paths:
        return None
    stored = spark.read.option("basePath", f"{folder}/contributions/{name}").parquet(*paths)
    return stored.withColumn("gen", F.col("gen").cast("bigint")).join(owners.select("pair_id", "gen"), ["pair_id", "gen"], "left_semi").drop("gen")


def contributions(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Partial results of all current pairs, whichever refresh wrote them."""
    return _stored(spark, folder, name, read_state(spark, folder), _generations(spark, folder, _commits(spark, folder)[0]))


def totals(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """phrase, old, new over all current pairs, as the last refresh left them."""
    return spark.read.schema(TOTALS).parquet(f"{folder}/totals/{name}/written={_commits(spark, folder)[0]}")


def refresh(
    spark: SparkSession,
    folder: str,
    pairs: DataFrame,
    hashes: Callable[[DataFrame], DataFrame],
    contribute: dict[str, Callable[[DataFrame], DataFrame]],
    settings: dict | None = None,
    full: bool = False,
    keep: int = 8,
) -> DataFrame:
    """Bring the state up to date with ``pairs`` (as from ``pair_stats``); returns counts by status.

    ``hashes`` gives (doc_id, sha256) of the reports it is asked for.  ``contribute`` maps a name to a function from pairs to
    their partial counts (pair_id, phrase, old, new).  ``keep``: generations that
    may hold contributions in use before they are gathered.
    """
    current, before = fingerprint(settings), _commits(spark, folder)
    gen = before[0] + 1 if before else 1
    status_path = f"{folder}/status/written={gen}"
    examined(pairs, read_state(spark, folder), current, hashes, full).write.mode("overwrite").parquet(status_path)
    status = spark.read.parquet(status_path)
    active, todo = status.filter("status <> 'stale'"), status.filter("status = 'recomputed'").select(*pairs.columns)
    known = _generations(spark, folder, before[0]) if before else []
    gathering = len(known) >= keep
    gone = status.filter("status in ('recomputed', 'stale') and _gen is not null").select("pair_id", F.col("_gen").alias("gen"))
    kept = active.filter("status <> 'recomputed'").select("pair_id", F.col("_gen").alias("gen"))
    for name, build in contribute.items():
        fresh = build(todo)
        held = _stored(spark, folder, name, kept, known) if gathering else None
        path = f"{folder}/contributions/{name}/gen={gen}"
        (fresh if held is None else fresh.unionByName(held)).write.mode("overwrite").parquet(path)
        added = spark.read.schema(fresh.schema).parquet(path).join(todo.select("pair_id"), "pair_id", "left_semi")
        parts = [added.select("phrase", "old", "new")]
        if (taken := _stored(spark, folder, name, gone, known)) is not None:
            parts += [totals(spark, folder, name), taken.select("phrase", (-F.col("old")).alias("old"), (-F.col("new")).alias("new"))]
        moved = parts[0]
        for part in parts[1:]:
            moved = moved.unionByName(part)
        sums = moved.groupBy("phrase").agg(F.sum("old").alias("old"), F.sum("new").alias("new")).filter("old <> 0 or new <> 0")
        sums.select("phrase", F.col("old").cast("bigint"), F.col("new").cast("bigint")).write.mode("overwrite").parquet(f"{folder}/totals/{name}/written={gen}")
    owner = F.lit(gen) if gathering else F.when(F.col("status") == "recomputed", F.lit(gen)).otherwise(F.col("_gen"))
    active.select("pair_id", F.lit(current).alias("fingerprint"), *SIGNATURE, *HASHES, owner.cast("bigint").alias("gen")).write.mode("overwrite").parquet(
        f"{folder}/state/written={gen}"
    )
    spark.range(1).select(F.lit(gen).cast("bigint").alias("gen")).coalesce(1).write.mode("append").parquet(f"{folder}/commits")
    _remove_unused(spark, folder, list(contribute))
    return status.groupBy("status").agg(F.count("*").alias("n"))


def _remove_unused(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Remove what neither of the last two commits refers to."""
    commits = _commits(spark, folder)
    used = {g for c in commits for g in _generations(spark, folder, c)}
    keep = {f"{folder}/contributions/{name}": {f"gen={g}" for g in {*used, *commits}} for name in names}
    keep |= {f"{folder}/{part}": {f"written={c}" for c in commits} for part in ("status", "state", *(f"totals/{name}" for name in names))}
    for parent, inside in keep.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(parent)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for entry in files.listStatus(path):
            if entry.getPath().getName() not in inside:
                files.delete(entry.getPath(), True)


# --- for the registered queries -----------------------------------------------------------------


def example_files(v: Views) -> DataFrame:
    return v.raw("documents").select(
        "doc_id", F.length("text").cast("bigint").alias("size"), F.timestamp_seconds(F.col("doc_id")).alias("modified"),
        F.col("text").cast("binary").alias("content"),
    )


def example_state(v: Views, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes and times of all pairs and an earlier state in which some differ."""
    signed = pair_signatures(pairs, example_files(v))
    kind = F.col("new_doc") % 5
    state = signed.select(
        F.when(kind == 4, F.concat("pair_id", F.lit(" gone"))).otherwise(F.col("pair_id")).alias("pair_id"),
        F.when(kind == 3, "other").otherwise(fingerprint()).alias("fingerprint"),
        "old_size", "old_modified", "new_size",
        F.when(kind.isin(1, 2), F.timestamp_seconds(F.col("new_doc") + 1)).otherwise(F.col("new_modified")).alias("new_modified"),
        "old_sha256",
        F.when(kind == 2, "changed").otherwise(F.col("new_sha256")).alias("new_sha256"),
    )
    return signed.drop(*HASHES), state
