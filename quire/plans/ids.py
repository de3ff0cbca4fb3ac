"""Dense, order-preserving ids for the values of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import checkpoint


def dense_ids(values: DataFrame, column: str, id_name: str = "id") -> DataFrame:
    """values with one more column, a number from 0 without gaps that ascends with `column`.

    values must hold each value of column once. A range-partitioned sort is checkpointed; then each row's number is its place in its partition plus
    the sizes of the partitions before, of which the driver receives one number per partition.
    """
    names = values.columns
    sorted_ = values.repartitionByRange(F.col(column)).sortWithinPartitions(column)
    fixed = checkpoint(sorted_)
    place = fixed.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = {r["__p"]: r["count"] for r in place.groupBy("__p").count().collect()}
    starts, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    start = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts or [0]]), F.col("__p") + 1)
    return place.withColumn(id_name, F.col("__i") + start).select(*names, id_name)
