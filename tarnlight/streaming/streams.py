"""Structured Streaming: ingest, rolling counts, weekly snapshots, alert state (H3-H6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnlight.functions import rules as R
from tarnlight.operators.reports import scored, validate
from tarnlight.operators.spatial import resolve_bodies
from tarnlight.scratch import drop, materialize
from tarnlight.sources.tables import exists
from tarnlight.streaming.state import current_state, merge_batch

LATE = "1 day"


def _marked(reports: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark, which needs times of a zone; a table as it is."""
    if not reports.isStreaming:
        return reports
    return reports.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)


def rolling_counts(reports: DataFrame, late: str = LATE) -> DataFrame:
    """H5: reports of each body in every 7-day window that starts on a day. As a stream, later rows are dropped."""
    marked = _marked(reports, late)
    n = marked.groupBy(F.window("created_at", "7 days", "1 day").alias("w"), "water_body_id").agg(F.count("*").alias("n"))
    return n.select("water_body_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def weekly_snapshots(reports: DataFrame, late: str = LATE) -> DataFrame:
    """H6: averages, maximum score and count of each body in tumbling weeks."""
    marked = _marked(reports, late)
    out = marked.groupBy(F.window("created_at", "7 days").alias("w"), "water_body_id").agg(
        F.count("*").alias("report_count"), F.avg("composite_score").alias("a"), F.avg("algae_percentage").alias("b"),
        F.avg("foam_coverage_pct").alias("c"), F.avg("turbidity_score").alias("d"),
    )
    names = {"risk_score": "a", "avg_algae_pct": "b", "avg_foam_coverage": "c", "avg_turbidity": "d"}
    return out.select("water_body_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "report_count", *[R.rounded(F.col(c), 4).alias(n) for n, c in names.items()])


MADE = "founder long, latitude double, longitude double, body_name string, type string, city string, state string, created_at timestamp, updated_at timestamp, batch int"
_SEEN = "report_id long, day date, batch int"


def _unseen(batch: DataFrame, out: str, batch_id: int) -> DataFrame:
    """The batch without reports that an earlier one took in, and one row (the earliest) of those that it repeats itself.

    A replayed report has its time again, so of what was taken in only the ids of the batch's days are read.
    """
    spark = batch.sparkSession
    first = batch.withColumn("_day", F.to_date("created_at"))
    order = Window.partitionBy("report_id").orderBy("created_at", "latitude", "longitude")
    first = first.withColumn("_n", F.row_number().over(order)).where((F.col("_n") == 1) | F.col("report_id").isNull()).drop("_n")
    if not exists(spark, f"{out}/seen"):
        return first.drop("_day")
    days = first.agg(F.min("_day"), F.max("_day")).first()
    seen = spark.read.schema(_SEEN).parquet(f"{out}/seen").where(F.col("day").between(F.lit(days[0]), F.lit(days[1])) & (F.col("batch") < batch_id))
    return first.join(seen.select("report_id", F.col("day").alias("_day")), ["report_id", "_day"], "left_anti").select(*batch.columns)


def ingest_batch(bodies: DataFrame, out: str) -> Callable[[DataFrame, int], None]:
    """H4: what happens to a micro-batch: validated, scored, matched to bodies, written under its batch id, added to the bodies' state.

    Reports that an earlier batch took in, or that the batch repeats, are left out. Bodies that a batch makes on a miss are
    written too, with their place, unknown type, city and state and their times, and later batches match against them, so
    several batches in the order of time make the bodies that one would. The folders of a batch are overwritten when it is
    replayed, and a batch reads those of earlier batches only, so each report and each body is written once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        good, bad = validate(_unseen(batch, out, batch_id))
        made = None
        if batch_id and exists(spark, f"{out}/bodies"):
            made = spark.read.schema(MADE).parquet(f"{out}/bodies").where(F.col("batch") < batch_id).drop("batch")
        found = resolve_bodies(scored(good).drop("base"), bodies, made).withColumnRenamed("body_id", "matched_body_id")
        found = materialize(found, "resolved", keep=True)
        found.drop("founder_latitude", "founder_longitude").write.mode("overwrite").parquet(f"{out}/reports/batch={batch_id}")
        founded = found.where(F.col("matched_body_id") == F.concat(F.lit("new-"), F.col("report_id").cast("string")))
        founded = founded.where((F.col("latitude") == F.col("founder_latitude")) & (F.col("longitude") == F.col("founder_longitude")))
        unknown, at = F.lit("Unknown"), F.col("created_at").cast("timestamp")
        founded.select(
            F.col("report_id").cast("long").alias("founder"), "latitude", "longitude", "body_name", F.lit("unknown").alias("type"), unknown.alias("city"), unknown.alias("state"), at.alias("created_at"), at.alias("updated_at")
        ).write.mode("overwrite").parquet(f"{out}/bodies/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{out}/rejected/batch={batch_id}")
        merge_batch(found.drop("water_body_id").withColumnRenamed("matched_body_id", "water_body_id"), f"{out}/state", batch_id)
        days = found.select(F.col("report_id").cast("long").alias("report_id"), F.to_date("created_at").alias("day")).where("report_id is not null")
        days.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{out}/seen/batch={batch_id}")
        drop(found)

    return write


def ingest(reports: DataFrame, bodies: DataFrame, out: str, checkpoint: str, late: str = "30 days") -> StreamingQuery:
    """H4: the running stream; it stops when all that is there has been taken in.

    A report id that comes again within the watermark is dropped before it is matched; ``ingest_batch`` finds the others.
    Reports that come later than ``late`` after the newest aren't taken in.
    """
    first = _marked(reports, late).dropDuplicatesWithinWatermark(["report_id"])
    writer = first.writeStream.foreachBatch(ingest_batch(bodies, out)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def ingested_state(spark, out: str) -> DataFrame:
    """H4: the bodies' state (W7) after all batches taken in; a body is the one that a report was matched to."""
    return current_state(spark, f"{out}/state")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there into an in-memory table, for tests."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
