"""Numbering in a total order without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` range-partitioned and sorted, with its partition and its place there, written once."""
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """``df`` with the position of each row in ``order``; the order must be total for a stable result.

    Rows are range-partitioned and sorted, written once, numbered inside each partition and shifted by the rows of
    the partitions before. Only one count a partition is joined back.
    """
    placed = _placed(df, order)
    # the id's lower bits count the rows of a partition from 0
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return placed.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + at + start).cast("bigint")).drop("_part", "_at", "_before")


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row among those of equal ``keys`` (nulls are equal), from 1.

    Rows are range-partitioned by keys and order, so a key that holds a third of all rows lies in many partitions:
    they are numbered inside each and shifted by what the partitions before hold of the key. A partition goes on with
    at most one key of those before it, so the table of shifts has no more rows than there are partitions.
    """
    placed = _placed(df, [*(F.col(k) for k in keys), *order])
    counts = placed.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.withColumn("_before", before).where("_before > 0").select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_before")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    place = F.row_number().over(Window.partitionBy("_part", *keys).orderBy("_at"))
    out = placed.withColumn("_place", place).join(F.broadcast(shifts), same, "left").withColumn(name, (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("bigint"))
    return out.select(*df.columns, name)


#: A key is hot if it holds more than one row in so many; there can't be more such keys than this.
HOT_SHARE = 1_000


def join_counted(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """``rows`` joined with the one row that ``facts`` has for each key; ``facts`` counts a key's rows in column ``n``.

    Hot keys, of which there are at most ``HOT_SHARE``, are handed to every task; only the rest is shuffled. Both
    frames are read twice and should be written or cheap.
    """
    hot = facts.where(F.col(n) * HOT_SHARE > total)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts.where(F.col(n) * HOT_SHARE <= total), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)
