"""The enrichment of reports by look-ups that answer later, as a running job (H1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions import rules as R

#: A report that isn't answered within this time of its creation is an error.
WAIT = "1 hour"
#: How much later than the newest row of its stream a row may come.
LATE = "1 hour"
_ANSWER = ("available", "live_ndci", "latest_ndci", "exceeds", "spatial_confidence", "corroboration", "mode")
_WRITTEN = ("satellite_ndci", "satellite_exceeds_clean_baseline", "satellite_spatial_confidence", "satellite_corroboration", "satellite_mode", "satellite_checked_at", "satellite_status")


def processing(reports: DataFrame) -> DataFrame:
    """H1: what a report is as soon as it comes, before any answer."""
    return reports.drop(*_WRITTEN).withColumn("satellite_status", F.lit("processing"))


def _once(rows: DataFrame, late: str) -> DataFrame:
    """Of the rows (id, at, row) of one id one: in a stream the first that comes, in a table the earliest. ``at`` gets its watermark."""
    if rows.isStreaming:
        return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])
    order = Window.partitionBy("id").orderBy("at", F.to_json("row"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def settle(reports: DataFrame, results: DataFrame, wait: str = WAIT, late: str = LATE) -> DataFrame:
    """H1: one row for each report (report_id, created_at, ...), with the columns that the look-up writes, once it is settled.

    results: report_id, checked_at, failed, available, live_ndci, latest_ndci, exceeds, spatial_confidence, corroboration, mode.
    A result between a report's creation and ``wait`` after it makes it done or unavailable, or error where the look-up failed.
    Reports without such a result are errors. Both tables may be streams: then an answered report comes out with its answer,
    an unanswered one when the watermarks of both say that no answer can come any more, and state is kept no longer than that.

    Repeated report ids count once, and so do repeated results. Reports without id or time can't be answered: they come out
    at once, as errors. Results without id or time, or for no report, are left out. Columns that the look-up writes are
    replaced where reports have them; other clashing names do no harm, since both sides travel as one struct.
    """
    known = F.col("report_id").isNotNull() & F.col("created_at").isNotNull()
    asked = lambda df: df.select(F.col("report_id").alias("id"), F.col("created_at").cast("timestamp").alias("at"), F.struct("*").alias("row"))
    plain = reports.drop(*_WRITTEN)
    answer = F.struct(*[F.col(c) for c in (*_ANSWER, "checked_at")], F.coalesce("failed", F.lit(False)).alias("failed"))
    answered = results.where("report_id is not null and checked_at is not null")
    answered = answered.select(F.col("report_id").alias("id"), F.col("checked_at").cast("timestamp").alias("at"), answer.alias("row"))
    left = _once(asked(plain.where(known)), late)
    right = _once(answered, late).select(F.col("id").alias("of"), F.col("at").alias("then"), F.col("row").alias("answer"))
    within = (F.col("id") == F.col("of")) & (F.col("then") >= F.col("at")) & (F.col("then") <= F.col("at") + F.expr(f"interval {wait}"))
    met = left.join(right, within, "left_outer").select("row", "answer")
    lost = asked(plain.where(~known)).select("row", F.lit(None).cast(met.schema["answer"].dataType).alias("answer"))
    cols = R.satellite_columns(F.col("answer.live_ndci"), F.col("answer.latest_ndci"), F.col("answer.available"))
    failed = F.col("answer").isNull() | F.col("answer.failed")
    keep = lambda c: F.when(~failed, c)
    return met.unionByName(lost).select(
        *[F.col("row")[c].alias(c) for c in plain.columns], keep(cols["satellite_ndci"]).alias("satellite_ndci"), keep(F.col("answer.exceeds")).alias("satellite_exceeds_clean_baseline"),
        keep(F.col("answer.spatial_confidence")).alias("satellite_spatial_confidence"), keep(F.col("answer.corroboration")).alias("satellite_corroboration"), keep(F.col("answer.mode")).alias("satellite_mode"),
        keep(F.col("answer.checked_at")).alias("satellite_checked_at"), F.when(failed, "error").otherwise(cols["satellite_status"]).alias("satellite_status"),
    )


def lifecycle(taken: DataFrame, settled: DataFrame) -> DataFrame:
    """H1: (report_id, satellite_status) now, a row for each report id taken in: what it was settled as, else processing."""
    done = settled.where("report_id is not null").groupBy("report_id").agg(F.min("satellite_status").alias("now"))
    ids = taken.where("report_id is not null").select("report_id").distinct()
    return ids.join(done, "report_id", "left").select("report_id", F.coalesce("now", F.lit("processing")).alias("satellite_status"))
