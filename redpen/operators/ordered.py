"""Running values over an ordered key that stay distributed when one key is huge.

A plain window sends a whole key to one task.  Here the rows of a key are cut into
buckets that follow the order.  Each bucket is summarised with a map-side combined
aggregate, the summaries (one row per bucket) are accumulated, and every bucket
then continues from the value carried into it.  No task sees more than one bucket
of rows or the bucket summaries of one key.

``bucket`` must never decrease along ``order``, and equal positions must share a
bucket.  Keys must not be null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from redpen.operators.lineage import settle

BUCKET_ROWS = 65_536
_BUCKET = "_bucket"


@dataclass(frozen=True)
class Total:
    """Sum of ``value`` over the rows up to this one (``before``: without it)."""

    name: str
    value: Column
    before: bool = False

    def within(self) -> Column:
        return F.sum(self.value)

    def summary(self, order: list[str]) -> Column:
        return F.sum(self.value)

    def carried(self, summary: Column) -> Column:
        return F.sum(summary)

    def joined(self, local: Column, carry: Column) -> Column:
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))


@dataclass(frozen=True)
class Latest:
    """Last non-null ``value`` up to this row (``before``: strictly earlier)."""

    name: str
    value: Column
    before: bool = False

    def within(self) -> Column:
        return F.last(self.value, ignorenulls=True)

    def summary(self, order: list[str]) -> Column:
        position = F.when(self.value.isNotNull(), F.struct(*order))
        return F.max_by(self.value, position)

    def carried(self, summary: Column) -> Column:
        return F.last(summary, ignorenulls=True)

    def joined(self, local: Column, carry: Column) -> Column:
        return F.coalesce(local, carry)


def position_bucket(position: str | Column, rows: int = BUCKET_ROWS) -> Column:
    """Bucket for an integer position that is unique within its key."""
    c = F.col(position) if isinstance(position, str) else position
    return F.floor(c / F.lit(rows))


def running(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: list[Total | Latest]
) -> DataFrame:
    rows = df.withColumn(_BUCKET, bucket)
    group = [*keys, _BUCKET]

    summaries = rows.groupBy(*group).agg(*[v.summary(order).alias(f"_s_{v.name}") for v in values])
    earlier = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carries = summaries.select(
        *group, *[v.carried(F.col(f"_s_{v.name}")).over(earlier).alias(f"_c_{v.name}") for v in values]
    )

    inside = Window.partitionBy(*group).orderBy(*order)
    local = rows.withColumns(
        {
            f"_l_{v.name}": v.within().over(inside.rowsBetween(Window.unboundedPreceding, -1 if v.before else 0))
            for v in values
        }
    )
    joined = local.join(carries, group)
    return joined.select(
        *df.columns, *[v.joined(F.col(f"_l_{v.name}"), F.col(f"_c_{v.name}")).alias(v.name) for v in values]
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    """Row numbers from 1 within each key."""
    return running(df, keys, order, bucket, [Total(name, F.lit(1).cast("bigint"))])


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Ranks from 1 within each key by ``order``, however large a key is.

    All rows are cut into ranges of (keys, order).  A row's place is its place in its range and
    the number of rows in the ranges before; a key's rows follow each other, so its ranks count from its first place.
    """
    by = [*keys, *order]
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = settle(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_range": F.spark_partition_id(), "_at": index}))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = placed.groupBy("_range").agg(F.count("*").alias("_rows")).select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    whole = placed.join(offsets, "_range").withColumn("_at", F.col("_before") + F.col("_at"))
    starts = whole.groupBy(*keys).agg(F.min("_at").alias("_start"))
    return whole.join(starts, keys).select(*df.columns, (F.col("_at") - F.col("_start") + 1).alias(name))


#: Cells that a span of values is cut into at a time.
CELLS = 1024


def at_ranks(df: DataFrame, column: str, ranks: list[int]) -> list:
    """The values at ``ranks`` (from 0) of the ascending numbers in ``column``, exactly and without sorting them.

    Values are counted by cells of a span; a rank falls into one cell, which is the span of the next turn,
    until a cell holds one value.  Each turn brings at most CELLS rows for each rank to the driver.
    """
    counts = settle(df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")))
    ends = counts.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    found: list = [None] * len(ranks)
    open_ = {i: (ends["low"], ends["high"], rank) for i, rank in enumerate(ranks)}
    while open_:
        spans = [
            F.struct(F.lit(i).alias("i"), F.lit(low).alias("low"), F.lit(high).alias("high")) for i, (low, high, _) in open_.items()
        ]
        part = (F.col("v") - F.col("s.low")).cast("double") / F.greatest((F.col("s.high") - F.col("s.low")).cast("double"), F.lit(1e-300))
        cell = F.least(F.floor(part * CELLS), F.lit(CELLS - 1))
        cells = (
            counts.select("v", "n", F.explode(F.array(*spans)).alias("s")).filter("v between s.low and s.high")
            .groupBy("s.i", cell.alias("cell")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        )
        for i, (_, _, rank) in list(open_.items()):
            for row in sorted((r for r in cells if r["i"] == i), key=lambda r: r["cell"]):
                if rank < row["n"]:
                    open_[i] = (row["low"], row["high"], rank)
                    if row["low"] == row["high"]:
                        found[i] = row["low"]
                        del open_[i]
                    break
                rank -= row["n"]
    return found


def _outlined(earlier: Column, later: Column) -> Column:
    """Two chains one after the other: what the later one's first entry leaves open of the earlier, then the later."""
    outermost = F.get(later, F.lit(0))
    return F.concat(F.filter(earlier, lambda x: outermost.isNull() | (x["level"] < outermost["level"])), later)


def _folded(chains: Column, kind: str) -> Column:
    return F.aggregate(chains, F.array().cast(kind), _outlined)


def enclosing(df: DataFrame, keys: list[str], position: str, level: str, name: str, width: int = 64) -> DataFrame:
    """``name``: the positions of the entries open at each row, outermost first.

    An entry is open until one of its level or a smaller one comes; ``position`` counts up from 0 within the
    keys without large gaps.  A stretch of rows is summarised by its chain, the entries still open at its end, whose levels rise;
    two chains join to that of both stretches.  Rows are cut into stretches of ``width``, these into
    stretches of as many, and a row's chain is put together from those before it at each size.
    """
    entry = F.struct(F.col(level).alias("level"), F.col(position).cast("bigint").alias("at"))
    kind = f"array<struct<level:{dict(df.dtypes)[level]},at:bigint>>"
    small, large = F.floor(F.col(position) / width), F.floor(F.col(position) / (width * width))

    def before(rows: DataFrame, group: list[str], order: str, chain: Column, out: str) -> DataFrame:
        earlier = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(out, _folded(F.collect_list(chain).over(earlier), kind))

    def chains(rows: DataFrame, group: list[str], order: str, chain: Column) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), chain.alias("c"))))
        return rows.groupBy(*group).agg(_folded(F.transform(ordered, lambda x: x["c"]), kind).alias("_chain"))

    rows = df.withColumns({"_small": small, "_large": large})
    bottom = chains(rows, [*keys, "_large", "_small"], position, F.array(entry))
    middle = before(bottom, [*keys, "_large"], "_small", F.col("_chain"), "_middle").drop("_chain")
    top = before(chains(bottom, [*keys, "_large"], "_small", F.col("_chain")), keys, "_large", F.col("_chain"), "_top").drop("_chain")
    placed = before(rows, [*keys, "_large", "_small"], position, F.array(entry), "_own").join(middle, [*keys, "_large", "_small"]).join(top, [*keys, "_large"])
    whole = _outlined(_outlined(F.col("_top"), F.col("_middle")), F.col("_own"))
    return placed.select(*df.columns, F.transform(F.filter(whole, lambda x: x["level"] < F.col(level)), lambda x: x["at"]).alias(name))
