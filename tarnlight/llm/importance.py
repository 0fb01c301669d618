"""Choosing documents by importance resampling (Xie et al. 2023): hashed n-gram models and Gumbel top-k.

Two bags of hashed one- and two-word features are counted: of the target text, documents labelled as good, and of the raw
text, all documents. A document's log weight is the sum of the log ratios of its features. With Gumbel noise added, the k
largest are a draw without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm.select import cutoffs, within
from tarnlight.llm.text import columns, hash64, lower_words, mixed, utf8
from tarnlight.scratch import materialize

BUCKETS = 1 << 14
#: The target model is fitted on at most so many labelled documents, those first by a hash of doc_id.
TARGET_DOCS = 20_000
SEED = 11


def features(text: bytes) -> np.ndarray:
    """Buckets of all words and of all two words in a row, repeats included."""
    words = hash64(lower_words(text))
    pairs = mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + mixed(words[1:]))
    return (np.concatenate([words, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def target_ids(labels: DataFrame) -> DataFrame:
    """At most TARGET_DOCS doc_ids labelled good; of repeated labels the lowest counts."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_DOCS).select("doc_id")


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p(target) - log p(raw) by bucket, with one added to each count. A table of fixed size."""
    good = F.broadcast(target_ids(labels).withColumn("good", F.lit(1)))
    rows = docs.select("doc_id", "text").join(good, "doc_id", "left").select("text", F.coalesce("good", F.lit(0)).alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for texts, flags in columns(batches, "text", "good"):
            for t, flag in zip(utf8(texts), flags.to_pylist(), strict=True):
                n = np.bincount(features(t), minlength=BUCKETS)
                raw += n
                if flag:
                    target += n
        full = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(raw[full]), pa.array(target[full])], ["bucket", "raw", "target"])

    sums = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    counts = np.ones((2, BUCKETS))
    for bucket, raw, target in sums.collect():
        counts[:, bucket] += target, raw
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def log_weight(text: Column | str, ratios: np.ndarray) -> Column:
    """The sum of the log ratios of all features of the whole text; 0 for null and empty texts."""
    held = SparkSession.active().sparkContext.broadcast(ratios)

    @F.arrow_udf("double")
    def weights(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([float(held.value[features(t)].sum()) for t in utf8(texts)], pa.float64())

    return weights.asNondeterministic()(text)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise that depends on doc_id and seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11)
    return -F.log(-F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))))


def _descending_key(x: Column) -> Column:
    """Longs from 0 to 2^60, evenly enough spread, that fall as a double rises: its place on a squashed axis."""
    share = F.lit(0.5) - F.atan(x / F.lit(50.0)) / F.lit(np.pi)
    return F.least(F.greatest(F.floor(share * F.lit(float(1 << 60))), F.lit(0).cast("bigint")), F.lit((1 << 60) - 1))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED) -> DataFrame:
    """``(doc_id, log_weight, gumbel_weight)`` of the documents drawn: the top k by log weight plus Gumbel noise.

    k is ``share`` of all rows, rounded; by default the share of good documents among the labelled. Equal weights go by
    doc_id; rows without doc_id are never drawn, rows that repeat one are drawn together while k allows. No labels: the
    weights are all the same and the draw is uniform, of all rows. Nothing is sorted as a whole: the k-th weight is found
    from counts of ranges.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    if share is None:
        share = labels.agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0))).first()[0]
        share = 1.0 if share is None else share
    weighed = docs.select("doc_id", log_weight("text", log_ratios(docs, labels)).alias("log_weight"))
    weighed = weighed.withColumn("gumbel_weight", F.col("log_weight") + gumbel(F.col("doc_id"), seed))
    # the one group is a column of the table: as a literal it would be folded away, and joins on it with it
    weighed = weighed.withColumns({"key": _descending_key(F.col("gumbel_weight")), "grp": F.lit("all"), "weight": F.lit(1).cast("bigint")})
    weighed = materialize(weighed, "weights", keep=True)
    k = round(share * weighed.count())
    rows = weighed.select("grp", "key", F.col("doc_id").alias("tie"), "weight")
    row = cutoffs(rows, docs.sparkSession.createDataFrame([("all", k)], "grp string, budget bigint")).first()
    drawn = within(F.col("key"), F.col("doc_id"), F.lit(row.last_key).cast("bigint"), F.lit(row.last_tie).cast("bigint"))
    return weighed.where(drawn).drop("key", "grp", "weight")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
