"""Global row numbers of a sorted table, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helmwatch.llm.common import shuffle_parts, written

#: monotonically_increasing_id() keeps the partition above this bit and the place within it below.
_PLACE_BITS = 33


def numbered(rows: DataFrame, *order, name: str = "numbered") -> tuple[DataFrame, int]:
    """rows with a column row_number, counted from 0 in the given order, and the number of rows.

    Rows are dealt to ranges of the order and sorted there; a range's first number is the size of the ranges before it,
    so the numbers depend on the rows alone, not on how files are split. Rows that tie in order are dealt apart by
    their place in the input, so no key is too large for a range; if they differ elsewhere, their numbers among each
    other are open: give an order that only equal rows tie in. Nulls come first where a column ascends. The sorted rows
    are written once, so a lost executor costs no second sort and can not change a number.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn("_apart", F.monotonically_increasing_id())
    ordered = dealt.repartitionByRange(shuffle_parts(spark), *order, "_apart").sortWithinPartitions(*order, "_apart")
    placed = written(ordered.drop("_apart").withColumn("_place", F.monotonically_increasing_id()), name)
    # One row per partition, so the window and the broadcast are bounded by spark.sql.shuffle.partitions.
    sizes = placed.groupBy(F.shiftright("_place", _PLACE_BITS).alias("_part")).agg(F.count("*").alias("_rows"))
    first = sizes.select("_part", "_rows", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_first"))
    first = written(first, f"{name}-first")
    total = first.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    within = F.col("_place").bitwiseAND((1 << _PLACE_BITS) - 1)
    joined = placed.withColumn("_part", F.shiftright("_place", _PLACE_BITS)).join(F.broadcast(first), "_part")
    return joined.withColumn("row_number", F.col("_first") + within).drop("_part", "_rows", "_first", "_place"), total
