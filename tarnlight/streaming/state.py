"""The current state of water bodies, kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.scratch import delete
from tarnlight.sources.tables import exists

#: Bodies are dealt over so many folders by a hash of their id; a batch opens those that its bodies lie in.
BUCKETS = 64
#: After so many batches the whole state is written anew, so that a reading never follows more batches than that.
COMPACT = 20
_STATE = "water_body_id string, total_reports bigint, latest struct<created_at:timestamp,report_id:bigint,composite_score:double,risk_level:string>, batch int, bucket int"


def _bucket() -> F.Column:
    return F.pmod(F.xxhash64("water_body_id"), F.lit(BUCKETS)).cast("int").alias("bucket")


def partial(reports: DataFrame) -> DataFrame:
    """(water_body_id, total_reports, latest): what reports say of their bodies; two such tables add up by sum and maximum."""
    latest = F.struct(F.col("created_at").cast("timestamp").alias("created_at"), F.col("report_id").cast("bigint").alias("report_id"), F.col("composite_score").cast("double").alias("composite_score"), "risk_level")
    return reports.where("water_body_id is not null").groupBy(F.col("water_body_id").cast("string").alias("water_body_id")).agg(F.count("*").alias("total_reports"), F.max(latest).alias("latest"))


def _versions(spark: SparkSession, path: str, upto: int) -> DataFrame:
    """Rows of the last whole state before batch ``upto``, and of the batches after it. A body's newest row is its state."""
    empty = spark.createDataFrame([], _STATE)
    out, base = empty, -1
    if exists(spark, f"{path}/whole"):
        whole = spark.read.schema(_STATE).parquet(f"{path}/whole").where(F.col("batch") < upto)
        base = whole.agg(F.max("batch")).first()[0]  # from the folders' names
        base = -1 if base is None else base
        out = whole.where(F.col("batch") == base) if base >= 0 else empty
    if exists(spark, f"{path}/changes"):
        out = out.unionByName(spark.read.schema(_STATE).parquet(f"{path}/changes").where((F.col("batch") > base) & (F.col("batch") < upto)))
    return out


def _newest(versions: DataFrame) -> DataFrame:
    newest = versions.groupBy("water_body_id").agg(F.max_by(F.struct("total_reports", "latest"), "batch").alias("s"))
    return newest.select("water_body_id", "s.total_reports", "s.latest")


def merge_batch(reports: DataFrame, path: str, batch_id: int, compact: int = COMPACT) -> None:
    """Bring the state at ``path`` up to date with one batch of matched, scored reports (water_body_id, ...).

    The batch is summed by body, joined to the newest earlier state of those bodies and written as the rows of batch
    ``batch_id``. Of the state only the folders of the touched bodies are opened, and only versions of earlier batches count,
    so a replayed batch overwrites its rows with the same. Every ``compact`` batches the whole state is written, for others to
    start from, and versions older than the whole state before it go.
    """
    spark = reports.sparkSession
    # one row a body of the batch; read for its buckets, and for the merge
    new = partial(reports).withColumn("bucket", _bucket()).cache()
    try:
        buckets = [r.bucket for r in new.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        before = _versions(spark, path, batch_id).where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
        before = _newest(before.join(new.select("water_body_id"), "water_body_id", "left_semi"))
        both = before.unionByName(new.select(*before.columns)).groupBy("water_body_id").agg(F.sum("total_reports").alias("total_reports"), F.max("latest").alias("latest"))
        both.withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/changes/batch={batch_id}")
    finally:
        new.unpersist()
    if (batch_id + 1) % compact == 0:
        whole = _newest(_versions(spark, path, batch_id + 1)).withColumn("bucket", _bucket())
        whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/whole/batch={batch_id}")
        # what the whole state before this one has taken over; batches since then can still be replayed
        for k in range(batch_id - 2 * compact + 1, batch_id - compact + 1):
            delete(spark, f"{path}/changes/batch={k}")
        delete(spark, f"{path}/whole/batch={batch_id - 2 * compact}")


def current_state(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """W7 from the kept state: total_reports, last_report_at, current_risk_score and current_risk_level for each body.

    ``upto``: as it stood before that batch, back to the last but one whole state. Bodies that no report was matched to have no row; nothing taken in yet: no rows.
    """
    newest = _newest(_versions(spark, path, (1 << 31) - 1 if upto is None else upto))
    return newest.select(
        "water_body_id", "total_reports", F.col("latest.created_at").alias("last_report_at"),
        F.col("latest.composite_score").alias("current_risk_score"), F.col("latest.risk_level").alias("current_risk_level"),
    )
