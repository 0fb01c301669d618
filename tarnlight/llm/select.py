"""Exact prefixes of ordered groups by weight, without sorting a group; rows with listed ids, without shuffling the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlight.scratch import materialize, temporary

#: Groups up to which their table is broadcast; beyond it is joined like any table.
BROADCAST_GROUPS = 100_000
_BITS = 12
LEVELS = 2


def small(groups: DataFrame) -> DataFrame:
    """``groups``, marked for broadcast if it has at most BROADCAST_GROUPS rows."""
    return F.broadcast(groups) if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else groups


def cutoffs(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Where each group's prefix ends: ``(grp, last_key, last_tie)``, nulls if no row fits.

    rows: (grp, key, tie, weight). Rows of a group are ordered by key, an evenly spread long from 0 to 2^60, then by tie. budgets:
    (grp, budget), a row for each group. The prefix holds the rows whose running weight is at most the budget; weights are
    longs of 0 or more. Rows equal in key and tie stand or fall together.

    ``rows`` and ``budgets`` are read several times and should be tables. A group is cut down by the sums of 4096 ranges of keys, twice; only the rows of the one range in 16 million that the
    prefix ends in are put in order.
    """
    with temporary(rows.sparkSession):
        here = budgets.select("grp", F.col("budget").cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("range"))
        for level in range(1, LEVELS + 1):
            shift = 60 - _BITS * level
            here = materialize(here, "ranges")
            inside = rows.join(small(here), "grp").where(F.shiftright("key", shift + _BITS) == F.col("range"))
            sums = inside.groupBy("grp", "left", F.shiftright("key", shift).alias("range")).agg(F.sum("weight").alias("w"))
            sums = sums.withColumn("upto", F.sum("w").over(Window.partitionBy("grp").orderBy("range")))
            at = F.struct("range", (F.col("left") - F.col("upto") + F.col("w")).alias("left"))
            # the range that the budget ends in; if all fits, the last that has rows
            found = sums.groupBy("grp").agg(F.min(F.when(F.col("upto") > F.col("left"), at)).alias("x"), F.max(at).alias("y"))
            end = F.coalesce("x", "y")
            here = here.join(found, "grp", "left").select(
                "grp", F.coalesce(end["left"], "left").alias("left"), F.coalesce(end["range"], "range").alias("range"), F.col("x").isNull().alias("whole")
            )
            if level < LEVELS:
                here = here.drop("whole")
        here = materialize(here, "ranges")
        shift = 60 - _BITS * LEVELS
        ends = rows.join(small(here.where("not whole")), "grp").where(F.shiftright("key", shift) == F.col("range"))
        order = Window.partitionBy("grp", "range").orderBy("key", "tie")
        inside = ends.withColumn("upto", F.sum("weight").over(order)).where("upto <= left")
        last = inside.groupBy("grp").agg(F.max(F.struct("key", "tie")).alias("last"))
        # no row of the last range fits: the prefix holds all rows of the ranges before it
        before = F.shiftleft("range", shift) - 1
        found = here.join(last, "grp", "left").select(
            "grp", F.when(F.col("whole"), F.lit((1 << 60) - 1)).otherwise(F.coalesce("last.key", before)).alias("last_key"),
            F.when(~F.col("whole"), F.col("last.tie")).alias("last_tie"),
        )
        return materialize(found, "cutoffs", keep=True)


def within(key, tie, last_key, last_tie):
    """Whether a row belongs to the prefix that ``cutoffs`` found. A null last_tie takes every tie."""
    return F.coalesce((key < last_key) | ((key == last_key) & (last_tie.isNull() | (tie <= last_tie))), F.lit(False))


#: Bits of a listed set: so many for each id, up to a bound that makes 16 MB.
_BITS_PER_ID, _LEAST_BITS, MAX_BITS = 16, 1 << 18, 1 << 27
_PIECE = 1 << 15


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    while name in df.columns:
        name += "_"
    return name


def _split(df: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose value is surely not in ``ids``, and the rest. A Bloom filter of one hash, of at most 16 MB."""
    bits = _LEAST_BITS
    n = ids.count()
    while bits < min(MAX_BITS, _BITS_PER_ID * n):
        bits *= 2
    piece, held = unused(df, "_piece"), unused(df, "_bits")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    pieces = ids.select(slot(F.col(ids.columns[0])).alias("s")).groupBy(F.floor(F.col("s") / _PIECE).alias(piece))
    pieces = pieces.agg(F.bitmap_construct_agg(F.col("s") % _PIECE).alias(held))
    at = slot(F.col(column))
    tested = df.withColumn(piece, F.floor(at / _PIECE)).join(F.broadcast(pieces), piece, "left")
    byte = F.conv(F.hex(F.substring(held, (F.floor((at % _PIECE) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    power = F.pow(F.lit(2), at % 8).cast("int")
    hit = F.coalesce(byte.bitwiseAND(power) != 0, F.lit(False))
    return tested.where(~hit).drop(piece, held), tested.where(hit).drop(piece, held)


def among(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose value stands in the one column of ``ids``, null among them. ``ids`` is read three times.

    Only rows that a filter of bounded size lets through cross the network, for an exact join.
    """
    listed = ids.toDF(unused(df, "_listed"))
    return _split(df, column, ids)[1].join(listed.hint("merge"), F.col(column).eqNullSafe(F.col(listed.columns[0])), "left_semi")


def without(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose value doesn't stand in the one column of ``ids``; the counterpart of ``among``."""
    listed = ids.toDF(unused(df, "_listed"))
    clear, maybe = _split(df, column, ids)
    return clear.unionByName(maybe.join(listed.hint("merge"), F.col(column).eqNullSafe(F.col(listed.columns[0])), "left_anti"))
