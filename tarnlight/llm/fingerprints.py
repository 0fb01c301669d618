"""I-Match fingerprints with several randomised lexicons (Chowdhury et al. 2002; Kolcz et al. 2004).

Terms whose inverse document frequency lies in a band form the lexicon. A text keeps its distinct terms that are in the
lexicon, sorted; of these, each of FAMILIES random families of nested subsets keeps a half, a quarter, ... 2^-LEVELS; each
subset's kept terms are hashed. Texts of any length so have subsets that keep about one of their terms, which survive an
edit elsewhere. Two fingerprints are compared through the number of subsets that differ and that are not empty: both counts
grow with the logarithm of the number of terms behind them, and give the share of common terms. With 24 levels that holds
up to some millions of distinct terms.

The document frequencies of all terms are counted in Spark by hash bucket, 2^LEXICON_BITS in number. The lexicon then is a
bit for each bucket, 2 MB whatever the corpus, and terms that share a bucket share the sum of their frequencies. That blurs the
band little even where many share one: its lower end is a share of all texts (one in 160,000), and so far above what rare terms
add up to. With 10^9 texts and 10^9 terms, a bucket's 60 terms reach the 6,100 texts only if one of them does nearly alone; with
10^6 such terms, 6% of the rare ones stand beside one and are taken in with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.decontaminate import words
from tarnlight.llm.text import columns, hash64, mixed, utf8

LEXICON_BITS = 24
#: The band, in nats: terms of more than 22% of all texts are out, and terms of fewer than one in 160,000.
IDF_BAND = (1.5, 12.0)
FAMILIES, LEVELS = 6, 24
#: Characters of text for each range of doc_ids that is put in order as a whole.
RANGE_CHARS = 256_000_000
#: A text of whose terms a smaller share lies in the band keeps all its terms.
MIN_SHARE = 0.5
_GROUP = 13
_SEEDS = mixed(np.arange(1, FAMILIES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LEVELS = np.arange(1, LEVELS + 1)


def _terms(text: bytes) -> np.ndarray:
    """Hashes of the distinct terms, sorted."""
    return np.sort(hash64(list(set(words(text)))))


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(bucket, df)``: in how many texts a bucket's terms stand, summed over its terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << LEXICON_BITS, np.int32)
        for (texts,) in columns(batches, "text"):
            for t in utf8(texts):
                np.add.at(seen, _terms(t) >> np.uint64(64 - LEXICON_BITS), 1)
        full = np.flatnonzero(seen)
        for at in range(0, len(full), 1 << 16):
            part = full[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(seen[part], pa.int64())], ["bucket", "df"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket int, df bigint").groupBy("bucket").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = IDF_BAND) -> np.ndarray:
    """A bit for each bucket in the band. 2^LEXICON_BITS bits come to the driver, packed."""
    n = max(1, docs.count())
    idf = F.log(F.lit(float(n)) / F.col("df"))
    kept = document_frequencies(docs, text).where(idf.between(*band))

    @F.arrow_udf("binary")
    def packed(lists: pa.Array) -> pa.Array:
        out = []
        for x in lists:
            bits = np.zeros(1 << _GROUP, np.uint8)
            bits[np.array(x.as_py(), np.int64)] = 1
            out.append(np.packbits(bits).tobytes())
        return pa.array(out, pa.binary())

    rows = kept.groupBy(F.shiftright("bucket", _GROUP).alias("g")).agg(F.collect_list(F.col("bucket").bitwiseAND((1 << _GROUP) - 1)).alias("low"))
    bits = np.zeros(1 << (LEXICON_BITS - 3), np.uint8)
    size = 1 << (_GROUP - 3)
    for g, part in rows.select("g", packed("low").alias("bits")).collect():
        bits[g * size : (g + 1) * size] = np.frombuffer(bytes(part), np.uint8)
    return bits


def fingerprint(text: bytes, bits: np.ndarray) -> np.ndarray:
    """FAMILIES * LEVELS hashes of 16 bits; 0 for an empty subset."""
    terms = _terms(text)
    bucket = (terms >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)
    kept = terms[(bits[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 == 1]
    if len(kept) < MIN_SHARE * len(terms):
        kept = terms
    out = np.zeros((FAMILIES, LEVELS), np.uint16)
    for f in range(FAMILIES):
        drawn = mixed(kept ^ _SEEDS[f])
        sparse, rank = kept, drawn
        for level in range(1, LEVELS + 1):
            inside = rank < np.uint64(1 << (64 - level))
            sparse, rank = sparse[inside], rank[inside]
            if not len(sparse):
                break
            out[f, level - 1] = xxhash.xxh64_intdigest(sparse.tobytes(), f * LEVELS + level) % 65535 + 1
    return out.ravel()


def _behind(counts: np.ndarray) -> np.ndarray:
    """The number of terms of which as many subsets as ``counts`` keep one at least, on average.

    That all do tells only that there are many; it counts as half a subset less, which the last level can resolve.
    """
    counts = np.minimum(counts, FAMILIES * LEVELS - 0.5)
    sizes = np.concatenate([[0.0], np.exp2(np.arange(-6, LEVELS + 8, 0.125))])
    expected = FAMILIES * (1 - np.exp(-sizes[:, None] * 2.0**-_LEVELS)).sum(axis=1)
    return np.interp(counts, expected, sizes)


_TABLE = _behind(np.arange(FAMILIES * LEVELS + 1))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of common terms, 0 to 1; 1 for equal fingerprints."""
    apart, full = int((a != b).sum()), int(((a != 0) | (b != 0)).sum())
    return max(0.0, float(1 - _TABLE[apart] / _TABLE[full])) if apart else 1.0


def spelled(prints: np.ndarray) -> str:
    return prints.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", bits: np.ndarray | None = None) -> DataFrame:
    """``docs`` with the fingerprint of each whole text. Null is the empty text; texts without terms have all zeros.

    The lexicon is counted over ``docs`` unless it is given.
    """
    held = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text) if bits is None else bits)

    @F.arrow_udf("string")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([spelled(fingerprint(t, held.value)) for t in utf8(texts)], pa.string())

    return docs.withColumn(out, prints.asNondeterministic()(F.col(text)))


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by the first as many characters of the next one."""
    q = len(text) // 4
    return text[: len(text) - q] + after[:q]


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text) dealt into ranges of doc_id, sorted in each, each range followed by the next one's first row.

    Columns: range, after (true for the row that only follows), doc_id, text. After the last range comes the first row of
    all. Rows without doc_id come last, equal doc_ids go by text. A range is a part of the table, never all of it.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    ranges = ranges or max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // RANGE_CHARS))
    shares = [k / ranges for k in range(1, ranges)]
    row = docs.agg(F.min("doc_id"), F.percentile_approx("doc_id", shares or [0.5], 10 * ranges)).first()
    firsts = np.array(sorted({row[0], *(row[1] or [])} - {None}) or [0], np.int64)

    @F.arrow_udf("array<int>")
    def dealt(ids: pa.Array) -> pa.Array:
        out = []
        for i in ids.to_pylist():
            k = len(firsts) - 1 if i is None else max(0, int(np.searchsorted(firsts, i, "right")) - 1)
            out.append([k, -1 - (k - 1) % len(firsts)] if i is not None and firsts[k] == i else [k])
        return pa.array(out, pa.list_(pa.int32()))

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.explode(dealt("doc_id")).alias("k"))
    rows = rows.select(F.when(F.col("k") < 0, -1 - F.col("k")).otherwise(F.col("k")).alias("range"), (F.col("k") < 0).alias("after"), "doc_id", "text")
    return rows.repartition(ranges, "range").sortWithinPartitions("range", "after", F.col("doc_id").asc_nulls_last(), "text")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """RESULT for each row of ``docs``: its fingerprint, that of its edited text, and their likenesses.

    The edited text ends in the beginning of the next document by doc_id, after the last of the first. A single document
    follows itself. The texts cross the network once.
    """
    docs = docs.select("doc_id", "text")
    held = docs.sparkSession.sparkContext.broadcast(lexicon(docs))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, kind = held.value, pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

        def told(one: tuple, after: tuple) -> dict:
            changed = edited(one[3], after[3]).encode()
            prints = fingerprint(changed, bits)
            return {
                "doc_id": one[2], "n_chars": len(one[3]), "edited_sha256": hashlib.sha256(changed).hexdigest(), "fingerprint": spelled(one[4]),
                "edited_fingerprint": spelled(prints), "near_edited": likeness(one[4], prints), "near_next": likeness(one[4], after[4]),
            }

        last, head = None, None
        for ranges, afters, ids, texts in columns(batches, "range", "after", "doc_id", "text"):
            out = []
            for k, after, i, t in zip(ranges.to_pylist(), afters.to_pylist(), ids.to_pylist(), texts.to_pylist(), strict=True):
                row = (k, after, i, t, fingerprint(t.encode(), bits))
                if last and last[0] == k and not last[1]:
                    out.append(told(last, row))
                elif last and not last[1]:  # no row had a doc_id: the only range, which its own first row follows
                    out.append(told(last, head))
                if not last or last[0] != k:
                    head = row
                last = row
            yield pa.RecordBatch.from_pylist(out, kind)
        if last and not last[1]:
            yield pa.RecordBatch.from_pylist([told(last, head)], kind)

    return with_next(docs).mapInArrow(pairs, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
