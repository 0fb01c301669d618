"""Hard negatives: for each anchor and positive, the best rows of other labels that score well under the positive.

Scores are inner products of whole numbers, computed exactly in blocks of anchors against all rows. Several candidates'
components stand, biased, in separate fields of one 64-bit integer (Kronecker packing); one multiplication for each anchor
component then serves all candidates of the integer, and their sums are unpacked at the end. Fields are as wide as the
greatest product of norms needs, so none spills into the next: by the inequality of Cauchy and Schwarz no score is greater.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.llm.text import columns
from tarnlight.scratch import materialize, temporary

SCALE = 256
#: A pass holds anchors of at most so many components (8 bytes each) in a broadcast, and at most so many anchors.
BLOCK_COMPONENTS, BLOCK_ANCHORS = 2_000_000, 32_768
#: Rows are met so many at a time by so many anchors.
_ROWS, _ANCHORS = 2048, 512
#: Rows whose components' squares sum to this or more take no part: their scores would not fit a long.
LARGEST = 2.0**61
_NONE = np.iinfo(np.int64).min


class Rule(NamedTuple):
    """How many positives and negatives, and which hundredths of the positive's score a negative may have."""

    positives: int = 5
    negatives: int = 3
    least: int = 50
    most: int = 95


class Vectors(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray  # a row each, whole numbers


def whole(ids: pa.Array, vectors: pa.Array, labels: pa.Array) -> Vectors:
    """Scaled whole vectors in order of id. Rows with a null among id, label, vector or components, or a component that isn't finite, are left out.

    Shorter vectors are filled up with zeros to the longest here.
    """
    flat = vectors.flatten()
    sizes = np.diff(vectors.offsets.to_numpy()).astype(np.int64)
    valid = ~(np.asarray(ids.is_null()) | np.asarray(labels.is_null()) | np.asarray(vectors.is_null()))
    sizes[np.asarray(vectors.is_null())] = 0
    value = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become nan
    of = np.repeat(np.arange(len(ids)), sizes)
    place = np.arange(len(value)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    odd = ~np.isfinite(value)
    valid[of[odd]] = False
    scaled = np.floor(SCALE * np.where(odd, 0.0, value))
    with np.errstate(over="ignore"):
        valid &= np.bincount(of, scaled * scaled, len(ids)) < LARGEST
    use = valid[of]
    x = np.zeros((len(ids), int(sizes.max(initial=0))), np.int64)
    x[of[use], place[use]] = scaled[use].astype(np.int64)
    ids, labels = (np.asarray(a.fill_null(0)).astype(np.int64) for a in (ids, labels))
    keep = np.flatnonzero(valid)
    keep = keep[np.argsort(ids[keep], kind="stable")]
    return Vectors(ids[keep], labels[keep], x[keep])


def _norm(x: np.ndarray) -> float:
    return float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)))


class Packed:
    """Candidates packed for anchors of a given greatest norm."""

    def __init__(self, x: np.ndarray, norm: float) -> None:
        self.n, dims = x.shape
        bound = int(norm * _norm(x) * 1.001) + 1  # no score is greater, whatever the rounding of norms
        self.bias, self.bits = bound, (2 * bound).bit_length()
        self.fields = max(1, 64 // self.bits)
        low = int(-x.min(initial=0))
        filled = np.zeros((-(-self.n // self.fields) * self.fields, dims), np.uint64)
        filled[: self.n] = (x + low).astype(np.uint64)
        parts = filled.reshape(-1, self.fields, dims)
        words = np.zeros((len(parts), dims), np.uint64)
        for k in range(self.fields):
            words += parts[:, k] << np.uint64(self.bits * k)
        # dims first: an anchor's component multiplies a row of words
        self.words, self.low = np.ascontiguousarray(words.T), low

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products, a row for each anchor. All is modulo 2^64; adding the bias makes every field whole and positive."""
        a = anchors.astype(np.uint64)  # negative ones wrap around, as the products do
        total = np.zeros((len(a), self.words.shape[1]), np.uint64)
        for d in range(self.words.shape[0]):
            total += a[:, d : d + 1] * self.words[d]
        every = sum(1 << (self.bits * k) for k in range(self.fields)) % (1 << 64)
        # what the candidates' bias has added to each field is taken off, and the fields' own bias is added
        own = np.uint64(self.bias) - np.uint64(self.low) * a.sum(axis=1, dtype=np.uint64)
        total += (own * np.uint64(every))[:, None]
        mask = np.uint64((1 << self.bits) - 1) if self.bits < 64 else np.uint64(2**64 - 1)
        out = np.empty((len(a), total.shape[1], self.fields), np.int64)
        for k in range(self.fields):
            out[:, :, k] = ((total >> np.uint64(self.bits * k)) & mask).astype(np.int64) - self.bias
        return out.reshape(len(a), -1)[:, : self.n]


def _padded(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] == dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k first of each row by score, then by place: ``(row, id, score)``. ``scores`` is used up; _NONE is no candidate."""
    for _ in range(min(k, scores.shape[1])):
        at = scores.argmax(axis=1)
        rows = np.arange(len(scores))
        got = scores[rows, at]
        rows = rows[got != _NONE]
        if not len(rows):
            return
        yield rows, ids[at[rows]], got[rows]
        scores[rows, at[rows]] = _NONE


def _tiles(batches: Iterator[pa.RecordBatch], held: Vectors) -> Iterator[tuple[Vectors, np.ndarray, np.ndarray]]:
    """Some rows, the places of some anchors, and their scores."""
    for ids, vectors, labels in columns(batches, "id", "vector", "label"):
        rows = whole(ids, vectors, labels)
        dims = max(rows.x.shape[1], held.x.shape[1])
        anchors, norm = _padded(held.x, dims), _norm(held.x)
        for start in range(0, len(rows.ids), _ROWS):
            some = Vectors(*[c[start : start + _ROWS] for c in rows])
            packed = Packed(_padded(some.x, dims), norm)
            for first in range(0, len(anchors), _ANCHORS):
                at = np.arange(first, min(first + _ANCHORS, len(anchors)))
                yield some, at, packed.scores(anchors[at])


def _first(rows: DataFrame, by: tuple[str, ...], k: int) -> DataFrame:
    """The k first rows of each group by score, then id, as ``place`` from 1. Few leave each task already."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _positives(rows: DataFrame, held, k: int) -> DataFrame:
    """The k first rows of each anchor's label: ``(anchor, id, score, place)``, anchors by their place in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Vectors(*held.value)
        for some, at, scores in _tiles(batches, block):
            scores[(block.labels[at][:, None] != some.labels) | (block.ids[at][:, None] == some.ids)] = _NONE
            for row, ids, score in _best(scores, some.ids, k):
                yield pa.RecordBatch.from_arrays([pa.array(at[row]), pa.array(ids), pa.array(score)], ["anchor", "id", "score"])

    return _first(rows.mapInArrow(run, "anchor long, id long, score long"), ("anchor",), k)


def _negatives(rows: DataFrame, held, ranges, k: int) -> DataFrame:
    """The k first rows of other labels within each positive's range: ``(anchor, positive, id, score)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, (low, high) = Vectors(*held.value), ranges.value
        # the worst of the best so far, by positive and anchor: what is worse needn't leave the task
        worst = np.full(low.shape, _NONE)
        kept = np.full((*low.shape, k), _NONE)
        for some, at, scores in _tiles(batches, block):
            scores[block.labels[at][:, None] == some.labels] = _NONE
            for p in range(len(low)):
                least = np.maximum(low[p, at], worst[p, at])[:, None]
                fits = (scores >= least) & (scores <= high[p, at][:, None])
                some_fit = np.flatnonzero(fits.any(axis=1))
                if not len(some_fit):
                    continue
                inside = np.where(fits[some_fit], scores[some_fit], _NONE)
                for row, ids, score in _best(inside, some.ids, k):
                    here = at[some_fit[row]]
                    kept[p, here] = np.sort(np.c_[kept[p, here], score], axis=1)[:, 1:]
                    worst[p, here] = kept[p, here, 0]
                    yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(np.full(len(here), p + 1)), pa.array(ids), pa.array(score)], ["anchor", "positive", "id", "score"])

    found = rows.mapInArrow(run, "anchor long, positive long, id long, score long")
    return _first(found, ("anchor", "positive"), k)


def _blocks(anchors: DataFrame) -> Iterator[Vectors]:
    """Anchors some at a time, of a bounded number of components. The driver holds one block and one row group's worth of rows."""
    held, n = [], 0

    def block() -> Vectors:
        dims = max(len(r.vector) for r in held)
        kind = pa.list_(pa.float64())
        ids, vectors, labels = pa.array([r.id for r in held]), pa.array([r.vector for r in held], kind), pa.array([r.label for r in held])
        got = whole(ids, vectors, labels)
        return Vectors(got.ids, got.labels, _padded(got.x, dims))

    for r in anchors.toLocalIterator():
        size = max(n, len(r.vector))
        if held and ((len(held) + 1) * size > BLOCK_COMPONENTS or len(held) == BLOCK_ANCHORS):
            yield block()
            held, size = [], len(r.vector)
        held.append(r)
        n = size
    if held:
        yield block()


def mine(rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rule: Rule = Rule()) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    An anchor's positives are the other rows of its label with the highest scores, as many as ``rule`` says; for each, the rows
    of other labels with the highest scores within the rule's hundredths of the positive's are returned, ranked from 1. Ties go
    to the smaller id; rows equal in id and score in any order. Fewer rows give fewer; an anchor without rows of its label or
    within the range gives none. Rows with a null id, label, vector or component take no part, nor do those with a component
    that isn't finite or with components too large for a long (LARGEST). Of vectors of unequal length the shorter is filled
    up with zeros. A row that repeats an anchor's id isn't its positive; a repeated anchor stands for itself each time. An
    empty table gives no rows.

    Anchors go out in blocks of bounded size. Every block takes two passes over all rows, without a shuffle of them: of what
    a pass finds, each task sends a few rows for an anchor.
    """
    spark = rows.sparkSession
    table = rows.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), F.col(f"`{label}`").cast("bigint").alias("label"), is_anchor.alias("anchor"))
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, v: s + F.floor(v * SCALE).cast("double") * F.floor(v * SCALE).cast("double"))
    chosen = table.where("anchor and id is not null and label is not null and vector is not null").where(~odd & (squares < LARGEST))
    done = []
    with temporary(spark):
        chosen = materialize(chosen.select("id", "vector", "label"), "anchors")
        for block in _blocks(chosen):
            held = spark.sparkContext.broadcast(tuple(block))  # plain values: workers need no copy of this class
            positives = materialize(_positives(table.select("id", "vector", "label"), held, rule.positives), "positives")
            low, high = np.full((rule.positives, len(block.ids)), 1), np.full((rule.positives, len(block.ids)), 0)  # nothing is within
            for anchor, place, score in positives.select("anchor", "place", "score").toLocalIterator():
                low[place - 1, anchor], high[place - 1, anchor] = -(-rule.least * score // 100), rule.most * score // 100
            ranges = spark.sparkContext.broadcast((low, high))
            negatives = _negatives(table.select("id", "vector", "label"), held, ranges, rule.negatives)
            # the anchors' ids by place, again a bounded table
            ids = spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(len(block.ids))), "anchor_id": pa.array(block.ids)}))
            named = positives.select("anchor", F.col("place").cast("bigint").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
            out = negatives.join(F.broadcast(named), ["anchor", "positive"]).join(F.broadcast(ids), "anchor")
            done.append(materialize(out.select(
                "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
            ), "negatives", keep=True))
            held.destroy()
            ranges.destroy()
    if not done:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.schema(done[0].schema).parquet(*[f for d in done for f in {x.rsplit("/", 1)[0] for x in d.inputFiles()}])


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, list_inner_product(a.x, b.x)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE label <> anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
