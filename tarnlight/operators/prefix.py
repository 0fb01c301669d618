"""Running sums over an order of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.scratch import materialize


def sums_before(df: DataFrame, by: tuple[str, ...], order: Column, values: tuple[str, ...], prefix: str = "before_") -> DataFrame:
    """``df`` with the sums of ``values`` over the rows that come before each row in its group, as ``before_<value>``.

    Rows are dealt by ranges of the order and summed in each range; the few sums by range give each range its start. No task
    holds a whole group. Rows equal in the order stand in one range in any order among them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *by, order).withColumn("_p", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    own = Window.partitionBy(*by, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*by, "_p").agg(*[F.sum(v).alias(v) for v in values])
    starts = parts.select(*by, "_p", *[F.coalesce(F.sum(v).over(ranges), F.lit(0)).alias(f"_s_{v}") for v in values])
    out = dealt.withColumns({f"{prefix}{v}": F.coalesce(F.sum(v).over(own), F.lit(0)) for v in values}).join(starts, [*by, "_p"])
    out = out.withColumns({f"{prefix}{v}": F.col(f"{prefix}{v}") + F.col(f"_s_{v}") for v in values})
    return out.drop("_p", *[f"_s_{v}" for v in values])
