"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words.  A target of r times the source's size gives each
document floor(r) certain copies; the rest is sampled: each document has an inclusion
probability p, a random u fixed by its key, and the rank ((u / (1 - u)) / (p / (1 - p))).
Documents are taken in order of rank until the words still missing are reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redpen.llm.common import words, written

#: Cells of the first and of the second cut of the rank axis.
CELLS = 1024


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """source, source_size, mean_pull, target from one row per source (source, source_size, mean_pull).

    Sources in code point order, null last, take ``weights`` in turn.  All share ``share``
    times the words of all sources; a target stops at ``most`` times its source's size and
    the excess goes to the others by weight.  With sources ordered by size per weight, those
    that stop are the first ones, so running sums give the level at which the rest fills up.
    """
    rows = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    turn = F.array(*(F.lit(float(w)) for w in weights))
    rows = rows.withColumn("weight", F.get(turn, (F.col("place") % len(weights)).cast("int")))
    rows = rows.withColumn("most", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy()
    upto = Window.orderBy(F.col("most") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("total", share * F.sum("source_size").over(everything))
    rows = rows.withColumn("stopped", F.coalesce(F.sum("most").over(upto), F.lit(0.0)))
    rows = rows.withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    rows = rows.withColumn("level", (F.col("total") - F.col("stopped")) / F.col("open_weight"))
    # the first source, in this order, that the level of its place does not fill sets the level of all
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "place", "level"))).over(everything)
    rows = rows.withColumn("final", level["level"])
    target = F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least("most", F.col("final") * F.col("weight")))
    return rows.select("source", "source_size", "mean_pull", target.alias("target"))


def mixed(
    docs: DataFrame,
    weights: list[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    pull: Column | None = None,
) -> DataFrame:
    """``doc_id``, ``row_key``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``pull`` is a document's relative chance inside its source (default: the logarithm of its
    size, so longer documents are somewhat likelier); chances scale to the mean that
    the source needs.  ``row_key`` hashes doc_id and text and sets u, so reruns agree; rows equal
    in both have equal ranks and are told apart only by how many of them are taken.
    Null sources form one source; null and blank texts have size 0 and are taken as often as
    their rank says, for 0 words.  An empty table gives no rows; a source of size 0 has target 0.
    """
    pull = F.log(F.col("size") + 2.0) if pull is None else pull
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("row_key"))
    sized = written(sized.withColumn("pull", pull), "mixing-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("pull").alias("mean_pull"))
    goals = targets(per_source, list(weights), share, most)
    goals = goals.withColumn("ratio", F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)))
    goals = goals.withColumn("whole", F.floor("ratio")).withColumn("missing", (F.col("ratio") - F.col("whole")) * F.col("source_size"))
    goals = written(goals.withColumnRenamed("source", "g_source"), "mixing-goals")

    same = F.col("source").eqNullSafe(F.col("g_source"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "row_key"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), (F.col("ratio") - F.col("whole")) * F.col("pull") / F.col("mean_pull")))
    rank = (u / (1 - u)) / (p / (1 - p))
    # rank / (1 + rank) has the same order and lies in [0, 1)
    placed = sized.join(goals, same).withColumn("spot", rank / (1 + rank))
    placed = placed.withColumn("cell", F.least(F.floor(F.col("spot") * CELLS), F.lit(CELLS - 1)))
    inner = F.least(F.floor((F.col("spot") * CELLS - F.col("cell")) * CELLS), F.lit(CELLS - 1))
    placed = placed.withColumn("inner", inner)

    # Where the missing words run out: first the cell, then the cell inside it, then the row.
    edge = _edge(placed.groupBy("g_source", "cell").agg(F.sum("size").alias("words"), F.first("missing").alias("missing")), "cell")
    edge = written(edge.withColumnRenamed("g_source", "e_source"), "mixing-edge")
    at_edge = placed.join(edge, F.col("g_source").eqNullSafe(F.col("e_source")) & (F.col("cell") == F.col("edge_cell")))
    inside = at_edge.groupBy("g_source", "edge_cell", "inner").agg(F.sum("size").alias("words"), F.first("left_cell").alias("missing"))
    inner_edge = _edge(inside, "inner").select(F.col("g_source").alias("i_source"), "edge_inner", "left_inner")
    inner_edge = written(inner_edge, "mixing-inner")

    both = placed.join(edge, F.col("g_source").eqNullSafe(F.col("e_source")), "left")
    both = both.join(inner_edge, F.col("g_source").eqNullSafe(F.col("i_source")), "left")
    before = (F.col("cell") < F.col("edge_cell")) | ((F.col("cell") == F.col("edge_cell")) & (F.col("inner") < F.col("edge_inner")))
    on_edge = (F.col("cell") == F.col("edge_cell")) & (F.col("inner") == F.col("edge_inner"))
    before, on_edge = F.coalesce(before, F.lit(False)), F.coalesce(on_edge, F.lit(False))
    both = both.withColumn("on_edge", on_edge).withColumn("before", before)
    clear = both.where("not on_edge").withColumn("extra", F.col("before").cast("long"))
    run = Window.partitionBy("g_source").orderBy("spot", "doc_id", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    edge_rows = both.where("on_edge").withColumn("so_far", F.coalesce(F.sum("size").over(run), F.lit(0)))
    # the row that crosses the target is taken if that ends nearer to it
    edge_rows = edge_rows.withColumn("extra", (F.col("left_inner") - F.col("so_far") > F.col("size") / 2.0).cast("long"))
    out = ["doc_id", "row_key", "source", "size", "source_size", "target", "whole", "extra"]
    chosen = clear.select(*out).unionByName(edge_rows.select(*out))
    chosen = chosen.withColumn("copies", F.col("whole") + F.col("extra"))
    return chosen.select("doc_id", "row_key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def resampled(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, each row as often as the mix takes it.

    Rows equal in doc_id and text count as one row that is taken as often as they are together.
    """
    copies = mixed(docs, **options).groupBy(F.col("doc_id").alias("mix_id"), F.col("row_key").alias("mix_key")).agg(F.sum("copies").cast("int").alias("mix_copies"))
    keyed = docs.withColumn("mix_own", F.xxhash64("doc_id", "text")).dropDuplicates(["doc_id", "mix_own"])
    joined = keyed.join(copies.where("mix_copies > 0"), (F.col("mix_own") == F.col("mix_key")) & F.col("doc_id").eqNullSafe(F.col("mix_id")))
    return joined.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), "mix_copies"))).select(*docs.columns)


def _edge(cells: DataFrame, name: str) -> DataFrame:
    """Per source the first ``name`` at which its words reach ``missing``, and what is missing before it."""
    run = Window.partitionBy("g_source").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    rows = cells.withColumn("so_far", F.coalesce(F.sum("words").over(run), F.lit(0)))
    rows = rows.where(F.col("so_far") < F.col("missing"))
    last = F.max_by(F.struct(name, (F.col("missing") - F.col("so_far")).alias("left")), name)
    rows = rows.groupBy("g_source").agg(last.alias("last"))
    return rows.select("g_source", F.col(f"last.{name}").alias(f"edge_{name}"), F.col("last.left").alias(f"left_{name}"))


def op3_query(spark, sf_dir: str) -> DataFrame:
    from redpen.llm.common import table

    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
