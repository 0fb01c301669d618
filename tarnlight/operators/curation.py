"""Choosing items for a data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions import fixed as K
from tarnlight.functions import rules as R
from tarnlight.scratch import materialize


def free_license(name: Column) -> Column:
    """P10: by prefix, trimmed, in any case."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    out = F.lit(False)
    for p in K.FREE_LICENSES:
        out = out | low.startswith(p)
    return out


def is_relevant(*fields: Column, terms: tuple[str, ...] = K.EXCLUDED_TERMS) -> Column:
    """None of the terms stands in the joined slugs, inside words too."""
    joined = F.concat_ws("_", *[R.slug(f) for f in fields])
    return ~joined.rlike("|".join(terms))


def extension(path: Column) -> Column:
    """The lower-cased suffix, without a query string."""
    return F.lower(F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))


def has_extension(path: Column, extensions: tuple[str, ...] = K.PHOTO_EXTENSIONS) -> Column:
    return extension(path).isin(*extensions)


def valid_labels(df: DataFrame, label: str) -> DataFrame:
    """Rows whose label is 0, 1 or 2 as a number; ``label`` becomes an integer."""
    return df.withColumn(label, F.expr(f"try_cast(try_cast(`{label}` AS double) AS int)")).where(F.col(label).isin(0, 1, 2))


def dedup_exact(df: DataFrame, code: str, *order: str) -> DataFrame:
    """Of equal contents the first by order; a minimum over each content, with partial aggregation."""
    names = [F.col(c) for c in df.columns]
    first = df.groupBy(code).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_x"))
    return first.select("_x.*")


def quota(df: DataFrame, by: str, n: int, *order: str) -> DataFrame:
    """The first n of each label."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("_r", place).where(F.col("_r") <= n).drop("_r")


def require_rows(df: DataFrame, least: int) -> DataFrame:
    """The table itself, or an error if it has fewer rows."""
    n = df.limit(least).count()
    if n < least:
        raise ValueError(f"only {n} rows; {least} are needed")
    return df


def balanced_sample(df: DataFrame, target: int, by: str, *order: str) -> DataFrame:
    """An equal quota of each category, then what is missing from the rest in the order of all. The order has no ties."""
    kinds = df.select(by).distinct().count()
    each = target // max(1, kinds)
    first = quota(df, by, each, *order)
    missing = target - first.count()
    # the first of all in number twice the target hold as many as can be missing, whatever the quotas took of them
    rest = df.orderBy(*order).limit(2 * target).join(first.select(*order), list(order), "left_anti").orderBy(*order).limit(max(0, missing))
    return first.unionByName(rest)


def number_rows(df: DataFrame, prefix: str, width: int, *order: str) -> DataFrame:
    """``prefix001`` and so on, in order. The rows are range-partitioned and counted, never gathered."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).withColumn("_p", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    numbered = ranged.withColumn("_r", place).join(F.broadcast(offsets), "_p")
    return numbered.withColumn("item_id", F.concat(F.lit(prefix), F.lpad((F.col("_r") + F.col("_o")).cast("string"), width, "0"))).drop("_p", "_r", "_o")


def skip_counts(df: DataFrame, supported: Column, relevant: Column, valid: Column, duplicate: Column) -> DataFrame:
    """The first reason to skip each row, 'kept' if there is none."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    reason = F.when(no(supported), "unsupported").when(no(relevant), "irrelevant").when(no(valid), "invalid").when(F.coalesce(duplicate, F.lit(False)), "duplicate").otherwise("kept")
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all tables by column name; a missing column is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def absent(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't there yet, of repeated new keys one."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
