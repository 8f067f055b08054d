"""Line dedup against levelled sorted runs of line hashes.

Documents come in batches, here in ascending doc_id order.  The keys seen so far lie in runs:
tables bucketed and sorted by hash, at several levels.  A batch's keys meet the runs by merge
joins on the buckets; keys in no run form a new run at level 0, and when a level has
``fanout`` runs they are merged into one run of the next level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redpen.llm.common import WHITE, shared_folder, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null doc_id, which comes after all others.
LAST = (1 << 63) - 1


class Runs:
    """The levelled runs of one collection.  Tables are named ``<name>_<number>``."""

    def __init__(self, spark: SparkSession, name: str | None = None, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.name = name or f"line_runs_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, keys: DataFrame) -> str:
        name, self.made = f"{self.name}_{self.made}", self.made + 1
        keys.select("h1", "h2").repartition(self.buckets, "h1", "h2").write.option("compression", "zstd").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        return name

    def known(self, keys: DataFrame) -> DataFrame:
        """``keys`` (h1, h2, ...) with ``known``: whether some run holds the key."""
        out = keys.withColumn("known", F.lit(False))
        for name in (n for level in self.levels for n in level):
            run = self.spark.table(name).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.lit(True).alias("hit"))
            out = out.join(run.hint("merge"), (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")), "left")
            out = out.withColumn("known", F.col("known") | F.coalesce("hit", F.lit(False))).drop("r1", "r2", "hit")
        return out

    def add(self, keys: DataFrame) -> None:
        """Make ``keys``, none of which is known, a run of level 0, and merge full levels."""
        fresh, level = self._write(keys), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(fresh)
            if len(self.levels[level]) < self.fanout:
                return
            merged, old = None, self.levels[level]
            for name in old:
                merged = self.spark.table(name) if merged is None else merged.unionByName(self.spark.table(name))
            fresh = self._write(merged)
            self.levels[level] = []
            for name in old:
                self.spark.sql(f"drop table {name}")
            level += 1

    def drop(self) -> None:
        for name in (n for level in self.levels for n in level):
            self.spark.sql(f"drop table if exists {name}")
        self.levels = []


def key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def line_keys(docs: DataFrame, least: int) -> DataFrame:
    """(d, row_key, n, h1, h2): a row for each line whose key has ``least`` code points; two 64-bit hashes stand for the key."""
    rows = docs.select("d", "row_key", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).withColumn("key", key(F.col("line")))
    rows = rows.where(F.length("key") >= least)
    return rows.select("d", "row_key", "n", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key", F.length("key")).alias("h2"))


def deduplicated(docs: DataFrame, least: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept (the text without its dropped lines).

    A key held by several documents stays only in the smallest doc_id holding it, there on all
    its lines.  Null and empty texts are one empty line.  Rows with equal doc_id are one
    document; null ids are one document after all others.  An empty table gives no rows; other
    columns are ignored.  A batch is a range of doc_id, so the first holder is the smallest.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("row_key", F.xxhash64("text"))
    shares = [n / batches for n in range(1, batches)]
    cuts = base.agg(F.percentile_approx("d", shares, 10000).alias("cuts")).first()["cuts"] or []
    batch = sum(((F.col("d") > cut).cast("int") for cut in sorted(set(cuts))), F.lit(0))
    path = shared_folder(spark, "line-keys")
    keyed = line_keys(base, least).withColumn("batch", batch)
    keyed.write.option("compression", "zstd").partitionBy("batch").parquet(path)
    lines = spark.read.schema(keyed.schema).parquet(path)

    runs, states = Runs(spark, fanout=fanout), None
    for n in range(len(set(cuts)) + 1):
        firsts = lines.where(F.col("batch") == n).groupBy("h1", "h2").agg(F.min("d").alias("first"), F.max("d").alias("last"))
        state = written(runs.known(firsts).withColumn("state_batch", F.lit(n)), "line-state")
        runs.add(state.where("not known"))
        # only keys with a line to drop meet the lines again
        shared = state.where("known or first < last").withColumnsRenamed({"h1": "s1", "h2": "s2"})
        states = shared if states is None else states.unionByName(shared)
    runs.drop()

    same = (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")) & (F.col("batch") == F.col("state_batch"))
    gone = lines.join(states, same).where("known or d > first")
    gone = gone.groupBy(F.col("d").alias("g_d"), F.col("row_key").alias("g_key")).agg(F.collect_set("n").alias("gone"))
    joined = base.join(gone, (F.col("d") == F.col("g_d")) & (F.col("row_key") == F.col("g_key")), "left")
    joined = joined.withColumn("gone", F.coalesce("gone", F.array().cast("array<int>"))).withColumn("lines", F.split("text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), kept.alias("kept"))


def op9_query(spark, sf_dir: str) -> DataFrame:
    from redpen.llm.common import table

    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
