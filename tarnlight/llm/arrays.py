"""Column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 512


def running_sum(values: Column) -> Column:
    """For an array of longs, the sum of the elements before each element.

    Summed in chunks, so that the cost of growing an array stays in proportion to its length.
    """

    def scan(a: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("p"))
        return F.aggregate(a, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["p"], F.array(acc["s"])).alias("p")))

    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")))
    chunks = F.transform(numbers, lambda c: scan(F.slice(values, c * _CHUNK + 1, _CHUNK)))
    heads = scan(F.transform(chunks, lambda c: c["s"]))["p"]
    return F.flatten(F.zip_with(chunks, heads, lambda c, h: F.transform(c["p"], lambda v: v + h)))
