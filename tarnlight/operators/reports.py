"""Reports and water bodies: validation, scoring, body state, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions import fixed as K
from tarnlight.functions import rules as R
from tarnlight.operators.prefix import sums_before


def as_of_column(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def rejected(lat: Column, lon: Column, kind: Column, mime: Column | None = None, size: Column | None = None) -> Column:
    """The first failure as a struct of code and reason, null if there is none."""
    say = lambda code, reason: F.struct(F.lit(code).alias("code"), F.lit(reason).alias("reason"))
    out = F.when(~F.coalesce(lat.between(-90, 90), F.lit(False)), say(422, "latitude out of range"))
    out = out.when(~F.coalesce(lon.between(-180, 180), F.lit(False)), say(422, "longitude out of range"))
    out = out.when(~F.coalesce(kind.isin(*K.CONTAMINATION_TYPES), F.lit(False)), say(422, "unknown contamination type"))
    if mime is not None:
        out = out.when(~F.coalesce(mime.isin(*K.MIME_TYPES), F.lit(False)), say(400, "unsupported image type"))
    if size is not None:
        out = out.when(size > K.MAX_BYTES, say(400, "image too large")).when(F.coalesce(size, F.lit(0)) == 0, say(400, "empty image"))
    return out


def validate(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The accepted reports, and the rejected ones with reject_code and reject_reason.

    The image is judged by the columns mime_type and size_bytes where the table has them.
    """
    mime, size = (F.col(c) if c in reports.columns else None for c in ("mime_type", "size_bytes"))
    marked = reports.withColumn("_r", rejected(F.col("latitude"), F.col("longitude"), F.col("contamination_type"), mime, size))
    bad = marked.where("_r is not null").withColumns({"reject_code": F.col("_r.code"), "reject_reason": F.col("_r.reason")}).drop("_r")
    return marked.where("_r is null").drop("_r"), bad


def scored(reports: DataFrame) -> DataFrame:
    """Composite score, fused with the model outputs, with the safety net, and its level."""
    c = F.col
    base = reports.withColumn(
        "base",
        R.composite(c("algae_percentage"), c("foam_coverage_pct"), c("turbidity_score"), R.fu_quality(c("forel_ule_index")), c("oil_coverage_pct"), c("color_abnormality_score"), c("debris_density")),
    )
    p_bad = F.when(c("eff_prediction") == "bad", c("eff_confidence")).otherwise(1 - c("eff_confidence"))
    fused = base.withColumn("fused_score", R.let(c("base.composite_score"), lambda x: R.fuse(x, c("eff_prediction"), c("eff_confidence"), p_bad, c("yolo_prediction"), c("yolo_confidence"))))
    fused = fused.withColumn("composite_score", R.let(c("fused_score"), lambda x: R.safety_net(x, c("foam_coverage_pct"), c("debris_density"), c("algae_percentage"))))
    return fused.withColumn("risk_level", R.let(c("composite_score"), R.risk_level))


def body_state(reports: DataFrame) -> DataFrame:
    """total_reports, last_report_at and the latest report's score and level for each body."""
    latest = F.struct("created_at", "report_id")
    return reports.groupBy("water_body_id").agg(
        F.count("*").alias("total_reports"), F.max("created_at").alias("last_report_at"),
        F.max_by("composite_score", latest).alias("current_risk_score"), F.max_by("risk_level", latest).alias("current_risk_level"),
    )


def recent_counts(bodies: DataFrame, reports: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """A2: reports of each body in the last days, 0 where there are none. One join, not a query for each body."""
    since = as_of_column(as_of) - F.make_dt_interval(F.lit(days))
    n = reports.where(F.col("created_at") >= since).groupBy("water_body_id").agg(F.count("*").alias("recent_reports"))
    return bodies.join(n, F.col("id") == F.col("water_body_id"), "left").drop("water_body_id").withColumn("recent_reports", F.coalesce("recent_reports", F.lit(0)))


def breakdown(reports: DataFrame) -> DataFrame:
    """A3: reports of each body by type, all nine types, zero-filled, as columns and as a map of those that occur."""
    counts = reports.groupBy("water_body_id").agg(*[F.count_if(F.col("contamination_type") == t).alias(t) for t in K.CONTAMINATION_TYPES])
    entries = F.array(*[F.struct(F.lit(t).alias("key"), F.col(t).alias("value")) for t in sorted(K.CONTAMINATION_TYPES)])
    return counts.withColumn("breakdown", F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0)))


def level_distribution(df: DataFrame, level: str = "risk_level") -> DataFrame:
    """A4: count and per cent (1 dp) of each level."""
    n = df.groupBy(level).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1))


def extent(df: DataFrame) -> DataFrame:
    """A5"""
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in ("latitude", "longitude") for n, f in (("min", F.min), ("max", F.max))])


def label_stats(df: DataFrame, label: str) -> DataFrame:
    """Rows, base rate of labels above 0, and the share of the most frequent label."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(
        F.sum("n").alias("n"), F.round(F.sum(F.when(F.col(label) > 0, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("base_rate"),
        F.round(F.max("n") / F.sum("n"), 4).alias("majority_share"),
    )


def score_distribution(df: DataFrame, score: str = "composite_score") -> DataFrame:
    """Extremes, mean, median, population deviation and percentiles."""
    q = F.expr(f"percentile({score}, array(0.1D, 0.25D, 0.5D, 0.75D, 0.9D))")
    out = df.agg(F.min(score).alias("min"), F.max(score).alias("max"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), q.alias("q"))
    return out.select("min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), *[F.col("q")[k].alias(n) for k, n in enumerate(("p10", "p25", "median", "p75", "p90"))])


def threshold_advice(distribution: DataFrame, low_pct: Column) -> DataFrame:
    """suggested limits P20 and P50+15, and a warning if over 20% are low. distribution: p15, p20, p50."""
    return distribution.select(
        F.col("p20").alias("suggested_low"), (F.col("p50") + 15).alias("suggested_moderate"), (low_pct > 20).alias("too_many_low"),
        F.when(low_pct > 20, F.col("p15")).alias("lower_limit_to"),
    )


FEATURES = ("algae_percentage", "foam_coverage_pct", "turbidity_score", "oil_coverage_pct", "color_abnormality_score", "debris_density")


def feature_stats(df: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Mean, median, population deviation and maximum of each feature, with its rank by mean.

    The exact median comes from running counts over distinct values, which no task holds as a whole.
    """
    long = df.unpivot([], list(features), "feature", "value")
    stats = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("value").alias("max"), F.count("value").alias("_n"))
    counted = sums_before(long.where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n")), ("feature",), F.col("value"), ("n",))
    counted = counted.join(stats.select("feature", "_n"), "feature")
    at = lambda rank: F.max(F.when((F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n")), F.col("value")))
    middle = counted.groupBy("feature").agg(((at(F.floor((F.col("_n") - 1) / 2)) + at(F.ceil((F.col("_n") - 1) / 2))) / 2).alias("median"))
    stats = stats.join(middle, "feature", "left").select("feature", "mean", "median", "std", "max")
    return stats.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "feature")))  # a row for each feature


def detector_matrix(df: DataFrame, category: str = "contamination_type") -> DataFrame:
    """The mean of each detector by category, 1 dp; clarity is turned into turbidity."""
    values = {
        "algae": F.col("algae_percentage"), "foam": F.col("foam_coverage_pct"), "turbidity": 100 - F.col("turbidity_score"),
        "oil": F.col("oil_coverage_pct"), "color_abnormality": F.col("color_abnormality_score"), "debris": F.col("debris_density"),
    }
    return df.groupBy(F.col(category).alias("category")).agg(*[F.round(F.avg(v), 1).alias(k) for k, v in values.items()], F.round(F.avg("forel_ule_index"), 1).alias("fu_index"))


def detector_hits(matrix: DataFrame, expected: DataFrame) -> DataFrame:
    """The two strongest detectors of each category, and whether one of those expected is among them."""
    long = matrix.unpivot(["category"], list(K.DETECTORS), "detector", "value")
    order = Window.partitionBy("category").orderBy(F.desc("value"), "detector")
    top = long.withColumn("r", F.row_number().over(order)).where("r <= 2").groupBy("category")
    top = top.agg(F.array_sort(F.collect_list(F.struct("r", "detector"))).alias("t")).select("category", F.col("t.detector").alias("top2"))
    return top.join(F.broadcast(expected), "category").withColumn("match", F.arrays_overlap("top2", "expected"))


def expected_detectors(spark) -> DataFrame:
    """The fixed table of J16: eight rows."""
    return spark.createDataFrame([(k, list(v)) for k, v in K.EXPECTED_DETECTORS.items()], "category string, expected array<string>")


def latest_report(reports: DataFrame) -> DataFrame:
    """Each body's latest report as a struct."""
    latest = F.struct("report_id", "contamination_type", "composite_score", "risk_level", "created_at")
    return reports.groupBy("water_body_id").agg(F.max_by(latest, F.struct("created_at", "report_id")).alias("latest_analysis"))


def page_after(df: DataFrame, order: str, after: tuple | None = None, limit: int = 20, most: int = 100, tie: str = "report_id") -> tuple[DataFrame, tuple | None]:
    """W2 by a cursor: the rows that come after ``after``, newest first, and the cursor of the next page (None after the last).

    ``after`` is (order, id) of the last row that was seen, None for the first page. It filters before anything is ordered, so
    a late page costs what the first one does, and rows added meanwhile shift no page. Rows without an order or id are on none.
    ``total`` is the number of all rows of the list, with those of other pages.
    """
    keyed = df.where(F.col(order).isNotNull() & F.col(tie).isNotNull())
    n = max(1, min(limit, most))
    rest = keyed
    if after is not None:
        at, last = (F.lit(v).cast(keyed.schema[c].dataType) for v, c in zip(after, (order, tie), strict=True))
        rest = keyed.where((F.col(order) < at) | ((F.col(order) == at) & (F.col(tie) < last)))
    rows = rest.orderBy(F.col(order).desc(), F.col(tie).desc()).limit(n)
    total = keyed.agg(F.count("*").alias("total"))
    ends = rows.agg(F.count("*"), F.min(F.struct(order, tie))).first()
    return rows.crossJoin(F.broadcast(total)), tuple(ends[1]) if ends[0] == n else None  # one row


def page(df: DataFrame, order: str, limit: int = 20, offset: int = 0, most: int = 100, tie: str = "report_id") -> DataFrame:
    """Newest first; the limit is held to [1, most] and a negative offset is 0. Ties go by id."""
    return df.orderBy(F.desc(order), F.desc(tie)).offset(max(0, offset)).limit(min(most, max(1, limit)))


def top_risk(bodies: DataFrame, k: int = 20, level: str | None = None) -> DataFrame:
    """Bodies by current risk; an unknown level filters nothing."""
    kept = bodies.where(F.col("current_risk_level") == level) if level in K.LEVELS else bodies
    return kept.orderBy(F.desc("current_risk_score"), "id").limit(k)


def history(scores: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Scores of the last days (1 to 365), newest first, with a date label."""
    since = as_of_column(as_of) - F.make_dt_interval(F.lit(min(365, max(1, days))))
    return scores.where(F.col("created_at") >= since).withColumn("date", F.date_format("created_at", "yyyy-MM-dd")).orderBy(F.desc("created_at"), F.desc("report_id"))


def last_k(reports: DataFrame, k: int = 5) -> DataFrame:
    """W5"""
    order = Window.partitionBy("water_body_id").orderBy(F.desc("created_at"), F.desc("report_id"))
    return reports.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def snapshots(reports: DataFrame) -> DataFrame:
    """For each report the body's running count, and the report's own values under the names of averages."""
    counted = sums_before(reports.withColumn("_one", F.lit(1)), ("water_body_id",), F.struct("created_at", "report_id"), ("_one",))
    return counted.select(
        "report_id", "water_body_id", F.col("composite_score").alias("risk_score"), "risk_level", F.col("algae_percentage").alias("avg_algae_pct"),
        F.col("foam_coverage_pct").alias("avg_foam_coverage"), F.col("turbidity_score").alias("avg_turbidity"),
        (F.col("before__one") + 1).alias("report_count"), F.col("created_at").alias("window_start"), F.col("created_at").alias("window_end"),
    )


def get_by_id(df: DataFrame, key: str, value) -> DataFrame:
    """One row or none."""
    return df.where(F.col(key) == F.lit(value))


def with_status(df: DataFrame, status: str | None = None) -> DataFrame:
    """Any string is a status; none filters nothing."""
    return df if status is None else df.where(F.col("status") == status)


def iso(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")


def report_payload(reports: DataFrame) -> DataFrame:
    """P5: the outer form of a report with its nested satellite verdict."""
    names = ("ndci", "exceeds_clean_baseline", "spatial_confidence", "corroboration", "mode")
    verdict = F.struct(F.col("satellite_status").alias("status"), *[F.col(f"satellite_{n}").alias(n) for n in names], iso(F.col("satellite_checked_at")).alias("checked_at"))
    return reports.select("report_id", "water_body_id", "contamination_type", "composite_score", "risk_level", iso(F.col("created_at")).alias("created_at"), verdict.alias("satellite_verdict"))


def body_payload(bodies: DataFrame) -> DataFrame:
    """P6"""
    return bodies.select(
        "id", F.coalesce("name", R.unnamed(F.col("latitude"), F.col("longitude"))).alias("name"), "latitude", "longitude", "city", "state",
        "current_risk_score", "current_risk_level", "total_reports", "recent_reports", iso(F.col("last_report_at")).alias("last_report_at"),
    )


def bodies_with_state(bodies: DataFrame, reports: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Bodies with what their reports say; those without reports are low at 0."""
    state = body_state(reports).withColumnRenamed("water_body_id", "_b")
    joined = recent_counts(bodies, reports, as_of, days).join(state, F.col("id") == F.col("_b"), "left").drop("_b")
    return joined.fillna({"total_reports": 0, "current_risk_score": 0.0, "current_risk_level": "low"})


def enrich(reports: DataFrame, verdicts: DataFrame) -> DataFrame:
    """H1: reports with their body's satellite verdict; no verdict yet: pending; an error in it: error.

    verdicts: water_body_id, available, live_ndci, latest_ndci, exceeds, corroboration, failed.
    """
    cols = R.satellite_columns(F.col("live_ndci"), F.col("latest_ndci"), F.col("available"))
    joined = reports.join(verdicts.withColumn("_v", F.lit(True)), "water_body_id", "left")
    status = F.when(F.col("_v").isNull(), "pending").when(F.coalesce("failed", F.lit(False)), "error").otherwise(cols["satellite_status"])
    return joined.withColumns({"satellite_ndci": cols["satellite_ndci"], "satellite_status": status}).drop("_v")
