"""Dense numbers in a given order without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """The rows with their places from 0 in the order given, as ``name``.

    Rows are dealt by ranges and sorted in their partitions, which are then fixed; a partition's first number is the number
    of rows before it, of which the driver gets one count a partition. Ties get their numbers in any order."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    sizes = dict(rows.groupBy(F.spark_partition_id().alias("p")).count().collect())
    first, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        first.append(total)
        total += sizes.get(p, 0)
    start = F.array(*[F.lit(n).cast("long") for n in first])[F.spark_partition_id()]
    return rows.withColumn(name, start + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
