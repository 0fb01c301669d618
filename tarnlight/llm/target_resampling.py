"""Importance resampling towards a target text (Xie et al. 2023) with whole-number gains, on Arrow kernels.

Features are all runs of one to three words, hashed by CRC-32 into buckets. A bucket's gain compares its share in the target
with its share in the documents; a document's weight is the sum of its features' gains, and Gumbel noise added to it draws a
sample without replacement. Texts are tokenised by Arrow: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and
``dictionary_encode``. Dictionary numbers shifted by one and two places form the runs, of which only distinct ones are hashed;
``take`` brings their buckets back to each place, and reducing by segments gives each document its sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.select import unused
from tarnlight.llm.text import columns
from tarnlight.operators.prefix import sums_before
from tarnlight.scratch import materialize

BUCKETS = 10_000
#: Characters between words: all of ASCII but letters (of lower-cased texts) and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Documents with fewer words are never drawn; of the others this share is.
MIN_WORDS, PERCENT, SEED = 20, 5, 42
#: Texts are handled so many bytes at a time, one text at least.
_SLICE = 4 << 20


def _crc_table() -> np.ndarray:
    """CRC-32 (polynomial 0xEDB88320) of each byte value."""
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, (row >> 1) ^ np.uint32(0xEDB88320), row >> 1)
    return row


def crc32(values: pa.Array, prefix: bytes = b"") -> np.ndarray:
    """CRC-32 of ``prefix`` and each of ``values``, all at once: a byte of every value at each step, longest first."""
    table = _crc_table()
    offsets = np.frombuffer(values.buffers()[1], np.int64 if pa.types.is_large_string(values.type) else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, falling = offsets[:-1][order], -lengths[order]
    state = np.full(len(values), 0xFFFFFFFF, np.uint32)
    for b in prefix:
        state = (state >> 8) ^ table[(state ^ np.uint32(b)) & 0xFF]
    for k in range(int(-falling[0]) if len(values) else 0):
        n = int(np.searchsorted(falling, -k))  # so many are longer than k bytes
        part = state[:n]
        state[:n] = (part >> 8) ^ table[(part ^ data[starts[:n] + k]) & 0xFF]
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


class _Shift:
    """The CRC-32 of a text followed by others, from both parts' values: zero bytes shift the first, linearly in its bits."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.kinds, self.of = np.unique(lengths, return_inverse=True)
        at, table, powers = np.arange(256, dtype=np.uint32), _crc_table(), []
        # table k moves byte k of a value over 2^p zero bytes, for each power that the greatest length needs
        step = np.stack([(x >> 8) ^ table[x & 0xFF] for x in (at << np.uint32(8 * k) for k in range(4))])
        for _ in range(int(self.kinds.max(initial=1)).bit_length()):
            powers.append(step)
            step = np.stack([self._apply(step, step[k]) for k in range(4)])
        tables = []
        for n in self.kinds.tolist():
            own = np.stack([at << np.uint32(8 * k) for k in range(4)])
            for p, power in enumerate(powers):
                if n >> p & 1:
                    own = np.stack([self._apply(power, own[k]) for k in range(4)])
            tables.append(own)
        self.tables = np.concatenate(tables, None) if tables else np.zeros(0, np.uint32)

    @staticmethod
    def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
        return tables[0][x & 0xFF] ^ tables[1][x >> 8 & 0xFF] ^ tables[2][x >> 16 & 0xFF] ^ tables[3][x >> 24]

    def __call__(self, first: np.ndarray, word: np.ndarray) -> np.ndarray:
        at = self.of[word] * 1024
        return np.bitwise_xor.reduce([self.tables.take(at + (256 * k + (first >> np.uint32(8 * k) & np.uint32(0xFF)))) for k in range(4)])


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    upto, start = np.cumsum(sizes), 0
    while start < len(texts):
        before = int(upto[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + _SLICE, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words, document, bucket)``: words by text, and for each feature its text's place and its bucket, by word place and length of run."""
    lowered = pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))
    parts = pc.split_pattern_regex(lowered, BETWEEN)
    flat, parent = pc.list_flatten(parts), pc.list_parent_indices(parts)
    full = pc.not_equal(flat, "")  # before a leading and behind a trailing separator
    coded = flat.filter(full).dictionary_encode()
    doc = parent.filter(full).to_numpy(zero_copy_only=False).astype(np.int64)
    n_words = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    word, vocabulary = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    lengths = pc.binary_length(vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    single, behind, shift = crc32(vocabulary), crc32(vocabulary, b" "), _Shift(lengths + 1)
    size = np.int64(max(len(vocabulary), 1))
    bucket = lambda hashes: (hashes % np.uint32(BUCKETS)).astype(np.int64)
    two, three = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    codes = pa.array(word[:-1] * size + word[1:]).dictionary_encode()
    distinct = codes.dictionary.to_numpy(zero_copy_only=False)
    pairs = shift(single[distinct // size], distinct % size) ^ behind[distinct % size]
    pair = pa.array(pairs).take(codes.indices).to_numpy(zero_copy_only=False)
    # the third word goes behind the pair that begins two places before it
    triple = shift(pair[:-1], word[2:]) ^ behind[word[2:]]
    return n_words, np.concatenate([doc, doc[:-1][two], doc[:-2][three]]), np.concatenate([bucket(single[word]), bucket(pair[two]), bucket(triple[three])])


def bucket_counts(items: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all whole texts fall into each bucket. A table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for (texts,) in columns(batches, "t"):
            for some in _slices(texts):
                sums += np.bincount(features(some)[2], minlength=BUCKETS)
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums[full])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    rows = items.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(count, "bucket long, n long")
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of a bucket's shares in the target and in the documents, one added to each count."""
    all_raw, all_target = int(raw.sum()), int(target.sum())
    return np.array([
        floor(1000 * log((float(t) + 1) * (all_raw + len(raw)) / ((float(s) + 1) * (all_target + len(raw))))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)
    ], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` without its text but with ``n_words``, ``n_features`` and ``weight``, the sum of its features' gains. No row is dropped.

    Columns of the caller's with one of these names keep them; the new ones then get underscores.
    """
    held = docs.sparkSession.sparkContext.broadcast(gain)
    others = [c for c in docs.columns if c != text]
    new = [unused(docs, c) for c in ("n_words", "n_features", "weight")]
    # a struct has one field at least
    kept = [F.col(f"`{c}`") for c in others] or [F.lit(0).alias("none")]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(f"`{text}`").cast("string").alias("t"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, texts in columns(batches, "row", "t"):
            start = 0
            for some in _slices(texts):
                n_words, doc, bucket = features(some)
                sums = np.zeros((2, len(some)), np.int64)
                # by length of run, each document's features are one segment
                for lo, hi in _segments(doc):
                    edges = np.flatnonzero(np.r_[True, doc[lo + 1 : hi] != doc[lo : hi - 1]])
                    at = doc[lo:hi][edges]
                    sums[0, at] += np.add.reduceat(held.value[bucket[lo:hi]], edges)
                    sums[1, at] += np.diff(np.r_[edges, hi - lo])
                yield pa.RecordBatch.from_arrays([kept.slice(start, len(some)), pa.array(n_words), pa.array(sums[1]), pa.array(sums[0])], ["row", *"abc"])
                start += len(some)

    schema = rows.select("row").schema.add("a", "long").add("b", "long").add("c", "long")
    out = rows.mapInArrow(weigh, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in others], *[F.col(a).alias(n) for a, n in zip("abc", new, strict=True)])


def _segments(doc: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of non-falling document places: one for each length of run."""
    cuts = [0, *(np.flatnonzero(np.diff(doc) < 0) + 1).tolist(), len(doc)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 times standard Gumbel noise) from SHA-256 of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` for every row of ``docs``.

    Of the rows with at least ``min_words`` words, the floor of ``percent`` hundredths with the highest scores are drawn and
    ranked from 1, ties by the smaller doc_id; ``rank`` is null for all others. Null texts count as empty and weigh 0. Rows
    without doc_id have no score and are neither counted nor drawn; rows that repeat a doc_id are rows of their own. With no
    target texts all gains follow the documents alone; no documents: no rows.

    Both passes over the texts are without a shuffle. What is put in order are narrow rows, dealt over tasks by ranges.
    """
    docs = docs.select("doc_id", "text")
    gain = gains(bucket_counts(docs), bucket_counts(target))
    found = materialize(weighed(docs, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "weights", keep=True)
    able = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    drawn = percent * found.where(able).count() // 100
    order = F.struct((-F.col("score")).alias("s"), "doc_id")
    ranked = sums_before(found.where(able).withColumn("one", F.lit(1)), (), order, ("one",)).withColumn("rank", F.col("before_one") + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = found.where(~F.coalesce(able, F.lit(False))).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.select(*found.columns, "rank").unionByName(rest)


def query(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
