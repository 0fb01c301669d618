"""Reading and writing tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlight.functions import rules as R
from tarnlight.operators.curation import absent, extension

#: Schemas of the entity tables as DDL, with the values that missing columns and nulls take.
SCHEMAS = {
    "water_bodies": "id string, name string, latitude double, longitude double, type string, city string, state string, current_risk_score double, current_risk_level string, total_reports int, last_report_at timestamp, created_at timestamp, updated_at timestamp",
    "reports": "id string, water_body_id string, latitude double, longitude double, contamination_type string, reporter_name string, notes string, forel_ule_index int, forel_ule_color string, algae_percentage double, foam_detected boolean, foam_coverage_pct double, turbidity_score double, composite_score double, risk_level string, satellite_status string, satellite_ndci double, satellite_exceeds_clean_baseline boolean, satellite_spatial_confidence string, satellite_corroboration string, satellite_mode string, satellite_checked_at timestamp, created_at timestamp",
    "risk_scores": "id string, water_body_id string, risk_score double, risk_level string, avg_algae_pct double, avg_foam_coverage double, avg_turbidity double, report_count int, window_start timestamp, window_end timestamp, created_at timestamp",
    "authorities": "id string, name string, email string, website string, verified boolean, jurisdiction string, is_default boolean, created_at timestamp",
    "alerts": "id string, report_id string, water_body_id string, authority_id string, risk_level string, composite_score double, satellite_corroboration string, status string, channel string, recipient string, subject string, body string, send_note string, created_at timestamp, sent_at timestamp",
    "votes": "image_id string, water_body_name string, location_city string, annotator_1 int, annotator_2 int, annotator_3 int, consensus_label int",
    "collection_meta": "image_id string, filename string, source_category string, annotation_low_moderate_high string, annotator_1 string, annotator_2 string, annotator_3 string, notes string",
    "licensed_meta": "image_id string, filename string, source_category string, annotation_low_moderate_high string, annotator_1 string, annotator_2 string, annotator_3 string, notes string, source_page string, source_url string, license string, license_code string, author string, attribution string, collected_on string",
    "ndci_monthly": "lake string, category string, date string, ndci_mean string, water_px string, n_scenes string",
}
DEFAULTS = {
    "water_bodies": {"type": "lake", "city": "Bengaluru", "state": "Karnataka", "current_risk_score": 0.0, "current_risk_level": "low", "total_reports": 0},
    "reports": {"foam_detected": False, "satellite_status": "pending"},
    "authorities": {"email": "", "verified": False, "is_default": False},
    "alerts": {"status": "pending_review", "channel": "email"},
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def ensure_columns(df: DataFrame, wanted: T.StructType, defaults: dict | None = None) -> DataFrame:
    """The wanted columns, missing ones null or their default, the table's others after them."""
    defaults = defaults or {}
    there = set(df.columns)

    def column(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`").cast(f.dataType) if f.name in there else F.lit(None).cast(f.dataType)
        return (F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else c).alias(f.name)

    return df.select(*[column(f) for f in wanted], *[F.col(f"`{c}`") for c in df.columns if c not in wanted.names])


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """An entity table from Parquet files that may differ in their columns."""
    return ensure_columns(spark.read.option("mergeSchema", True).parquet(path), schema(name), DEFAULTS.get(name))


def read_csv(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame:
    """A headed CSV; blanks are null; without a schema all columns are strings. Columns are matched by name."""
    df = spark.read.csv(path, header=True, nullValue="", quote='"', escape='"', multiLine=True)
    return df if ddl is None else ensure_columns(df, T.StructType([T.StructField(f.name, T.StringType()) for f in T.StructType.fromDDL(ddl)])).select(
        *[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in T.StructType.fromDDL(ddl)]
    )


def resolve_columns(df: DataFrame) -> DataFrame:
    """S3: ``image_id`` from filename where it isn't there; ``label`` from consensus_label, else final_label, else the votes."""
    names = set(df.columns)
    key = next((c for c in ("filename", "image_id") if c in names), None)
    if key is None:
        raise ValueError("neither filename nor image_id")
    number = lambda c: R.vote(F.col(c).cast("string")) if c in names else F.lit(None).cast("int")
    label = R.final_label(number("consensus_label"), number("final_label"), F.array(*[number(f"annotator_{k}") for k in (1, 2, 3)]))
    return df.withColumn("image_id", F.col(key)).withColumn("label", label)


def lenient_double(c: Column | str) -> Column:
    return F.col(c).try_cast("double") if isinstance(c, str) else c.try_cast("double")


def read_ndci_monthly(spark: SparkSession, path: str) -> DataFrame:
    """The monthly series; rows whose value is blank, 'None' or no number are left out; no category is 'unknown'."""
    df = read_csv(spark, path, SCHEMAS["ndci_monthly"])
    out = df.withColumn("ndci_mean", lenient_double("ndci_mean")).where("ndci_mean is not null")
    return out.withColumn("category", F.coalesce("category", F.lit("unknown"))).withColumns({c: F.col(c).try_cast("bigint") for c in ("water_px", "n_scenes")})


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(name, category, rings) of GeoJSON collections: polygons and multipolygons with all rings of all parts, holes too.

    A file is one task, since a collection is one JSON value. Features of other kinds, or whose coordinates can't be read, have
    null rings.
    """
    geo = "type string, features array<struct<type:string,properties:struct<name:string,category:string,city:string,state:string>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(geo).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.properties.name", "f.properties.category", "f.geometry.*")
    one = F.from_json("coordinates", "array<array<array<double>>>")
    many = F.flatten(F.from_json("coordinates", "array<array<array<array<double>>>>"))
    return f.select("name", F.coalesce("category", F.lit("unknown")).alias("category"), F.when(F.col("type") == "Polygon", one).when(F.col("type") == "MultiPolygon", many).alias("rings"))


def read_labelled_files(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    """Files under a root with an allowed extension; the folder's name is the label."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return df.where(extension(F.col("path")).isin(*extensions)).select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("label"), "length", "content")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_or_compute(spark: SparkSession, path: str, make: Callable[[], DataFrame], recompute: bool = False) -> DataFrame:
    """The table at ``path`` if a finished one is there, else made, written and read back."""
    if recompute or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_split(df: DataFrame, path: str, by: str, *order: str) -> None:
    """A folder for each value of ``by``, sorted within files."""
    df.sortWithinPartitions(by, *order).write.mode("overwrite").partitionBy(by).parquet(path)


def write_sorted_csv(df: DataFrame, path: str, *order: str) -> None:
    """A headed CSV, its parts in order."""
    df.orderBy(*order).write.mode("overwrite").csv(path, header=True)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row nested report as JSON."""
    report.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The report with ``status`` 'ok', or one row of nulls with 'NOT RUN' if it isn't there."""
    if exists(spark, path):
        return spark.read.schema(ddl).json(path).withColumn("status", F.lit("ok"))
    return spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(ddl)], F.lit("NOT RUN").alias("status"))


_BATCH = "appended_in"


def _finished(spark: SparkSession, path: str) -> list[str]:
    """Folders of the batches whose write came to its end: a list of names, one for each append."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{_BATCH}=*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(f.getPath().getParent().toString() for f in found or [])


def append_new(df: DataFrame, path: str, key: str, batch: str | None = None) -> None:
    """Append the rows whose key isn't in the table yet, of repeated new keys one, as a folder of their own.

    A write that failed leaves a folder that no reader counts. A batch that comes again under its name overwrites its folder
    and looks at the other batches only, so the table stays as it was. Without a name a batch takes the time and a random
    number, so that writers never overwrite each other's; keys that two of them bring at one time are told apart by
    ``appended``. Rows without a key are never taken for known: each batch adds one.
    """
    if _BATCH in df.columns:
        raise ValueError(f"the table has a column {_BATCH}, which names its batches")
    spark, name = df.sparkSession, batch or f"{time.time_ns()}-{uuid.uuid4().hex}"
    others = [f for f in _finished(spark, path) if not f.endswith(f"/{_BATCH}={name}")]
    new = absent(df, spark.read.parquet(*others), key) if others else df.dropDuplicates([key])
    new.write.mode("overwrite").parquet(f"{path}/{_BATCH}={name}")


def appended(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """The rows of all batches of ``append_new`` that were finished. With ``key``, of equal keys the first batch's row;
    rows without a key all stay. A table that no batch finished is an error."""
    folders = _finished(spark, path)
    if not folders:
        raise ValueError(f"no finished batch at {path}")
    rows = spark.read.option("basePath", path).parquet(*folders)
    if key is not None:
        first = Window.partitionBy(key).orderBy(_BATCH)
        rows = rows.withColumn("_n", F.row_number().over(first)).where((F.col("_n") == 1) | F.col(key).isNull()).drop("_n")
    return rows.drop(_BATCH)
