"""Near-duplicates by the Jaccard similarity of sets of word shingles: MinHash bands (Broder 1997) and exact verification.

Each text has BANDS keys of ROWS minima over its set of shingle hashes. Sets of similarity 0.8 share none of the keys with
probability (1 - 0.8^4)^32 = 4.8e-8, more similar ones less. Sets that share a key are candidates; those whose sizes allow it
are verified on the sets themselves, which are made anew for the texts that have a candidate. Equal sets are one class and
meet once. What crosses the network is a number and a key for each band; of the texts only those with a candidate do
(``select.among``).

Under a key that more than ``crowd`` classes share, each is first verified against two of them, the one with the most company
and one picked by hash, which joins large groups of copies. Keys whose classes then still stand in several components mostly
come of a passage that unlike texts share. Their classes are joined exactly by their rarest shingles (prefix filtering,
Chaudhuri et al. 2006; positions, Xiao et al. 2008): with n shingles in one global order from rare to frequent, sets of
similarity 0.8 share one among the first n - ceil(0.8 n) + 1. Shingles that no other class has come first, so texts with enough of their own
have no candidates. Pairs within one component can't change it and are left out, and so are those known already: the
components are those of all pairs, and neither a large group of copies nor a frequent passage is squared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.llm.select import among
from tarnlight.llm.text import columns, freed, hash64, lower_words, mixed, pieces
from tarnlight.operators.graph import connected_components
from tarnlight.scratch import materialize

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
#: Classes under a key beyond which it is crowded.
CROWD = 16
_STEP = 1 << 18
_PART = 512
_FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_BAND_NUMBERS = mixed(np.arange(BANDS, dtype=np.uint64) + np.uint64(1 << 32))
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of ``width`` words, repeats counted. A text of fewer words is one shingle; no words, none."""
    words = lower_words(text)
    if not words:
        return
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    joined = b" ".join(words)
    for at in range(0, n, _STEP):
        yield hash64([joined[a:b] for a, b in zip(starts[at : at + _STEP], stops[at : at + _STEP], strict=True)])


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct hashes, sorted."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *hashes(text, width)]))


def _named(found: np.ndarray) -> int:
    """A hash of the set, 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).view(np.int64)) if len(found) else 0


def _bands(found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), _PART):
        least = np.minimum(least, (found[None, at : at + _PART] * _FACTORS[:, None]).min(axis=1))
    least = least.reshape(BANDS, ROWS)
    keys = least[:, 0] ^ _BAND_NUMBERS
    for k in range(1, ROWS):
        keys = mixed(keys * _FOLD + least[:, k])
    return keys.view(np.int64)


def sketches(docs: DataFrame, width: int, code: Callable[[bytes], int]) -> DataFrame:
    """``(doc_id, fp, n, bands, code)`` for each row of ``docs`` (doc_id, text): the hash of its set, the set's size, its keys, its ``code``.

    All come of one function, since each iterator of batches that a task runs is a Python worker with a copy of the texts.
    """

    def made(texts: pa.Array) -> pa.Array:
        fp, n, bands, codes = [], [], [], []
        for part in pieces(texts):
            for t in part:  # one set at a time
                found = shingle_set(t, width)
                fp.append(_named(found))
                n.append(len(found))
                bands.append(_bands(found))
                codes.append(code(t))
        parts = [pa.array(fp, pa.int64()), pa.array(n, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(codes, pa.int64())]
        return pa.StructArray.from_arrays(parts, ["fp", "n", "bands", "code"])

    @F.arrow_udf("struct<fp:bigint,n:int,bands:array<bigint>,code:bigint>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return freed(map(made, batches))

    found = docs.select("doc_id", sketch.asNondeterministic()(F.col("text")).alias("s"))
    return found.select("doc_id", "s.fp", "s.n", "s.bands", "s.code")


def _sets(docs: DataFrame, classes: DataFrame, some: DataFrame, width: int) -> DataFrame:
    """``(fp, shingles)`` once for each ``fp`` of ``some``."""
    ends = materialize(classes.select("fp", "doc_id").join(some, "fp", "left_semi"), "ends")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in columns(batches, "text"):
            for part in pieces(texts):
                sets = [shingle_set(t, width) for t in part]
                yield pa.RecordBatch.from_arrays([pa.array([_named(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["fp", "shingles"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return freed(each(batches))

    found = among(docs, "doc_id", ends.select("doc_id")).select("text").mapInArrow(made, "fp long, shingles binary")
    return materialize(found.join(ends, "fp", "left_semi").dropDuplicates(["fp"]), "sets")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar."""

    def compared(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / (len(x) + len(y) - both) >= similarity)
        return pa.array(out, pa.bool_())

    @F.arrow_udf("boolean")
    def alike(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return freed(compared(x, y) for x, y in batches)

    ends = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    sets = _sets(docs, classes, ends, width)
    one, other = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("fp").alias("b"), F.col("shingles").alias("sb"))
    return materialize(pairs.join(one, "a").join(other, "b").where(alike("sa", "sb")).select("a", "b"), "alike")


def _met(left: DataFrame, right: DataFrame, key: str, similarity: float, *more: Column) -> DataFrame:
    """Distinct pairs a < b of rows (key, fp, n) that share a key and whose sizes allow the similarity."""
    x, y = left.alias("x"), right.alias("y")
    on = (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.fp") != F.col("y.fp"))
    on &= F.least("x.n", "y.n") >= F.lit(similarity) * F.greatest("x.n", "y.n") - F.lit(1e-6)
    for c in more:
        on &= c
    return x.join(y, on).select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()


def _across(rows: DataFrame, key: str, similarity: float, *more: Column) -> DataFrame:
    """Pairs of rows (key, fp, n, component) under one key in different components: each from the side that isn't in the largest."""
    parts = rows.groupBy(key, "component").agg(F.count("*").alias("size"))
    main = parts.groupBy(key).agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    rows = rows.join(main, key)
    # Both in small components: each pair once by the order of fp. One in the main one: always from the small side.
    once = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.fp") < F.col("y.fp")))
    return _met(rows.where("component <> main"), rows, key, similarity, once, *more)


def _shingle_rows(sets: DataFrame) -> DataFrame:
    """``(fp, shingle)`` for each shingle of each set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps, found in columns(batches, "fp", "shingles"):
            for fp, x in zip(fps.to_numpy(), found.to_pylist(), strict=True):
                values = np.frombuffer(x, np.int64)
                for at in range(0, len(values), _STEP):
                    part = values[at : at + _STEP]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), fp)), pa.array(part)], ["fp", "shingle"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return freed(each(batches))

    return sets.mapInArrow(made, "fp long, shingle long")


def _rarest_first(docs: DataFrame, classes: DataFrame, members: DataFrame, width: int, similarity: float) -> DataFrame:
    """Pairs of ``members`` (fp, n, component) in different components that share one of their rarest shingles."""
    rows = _shingle_rows(_sets(docs, classes, members.select("fp"), width))
    known = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    shared = materialize(rows.join(known, "shingle"), "shared")
    own = Window.partitionBy("fp")
    # The shingles of no other class come before these.
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "shingle")) - 1
    prefix = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - F.lit(1e-6)) + 1
    shared = shared.join(members, "fp").withColumn("place", place).where(F.col("place") < prefix)
    shared = materialize(shared.select("shingle", "fp", "n", "component", "place"), "prefixes")
    rest = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))  # from the shared shingle on
    enough = rest >= F.lit(similarity / (1 + similarity)) * (F.col("x.n") + F.col("y.n")) - F.lit(1e-6)
    return _across(shared, "shingle", similarity, enough)


def links(docs: DataFrame, prints: DataFrame, width: int, similarity: float, crowd: int) -> DataFrame:
    """Edges ``(a, b)`` between the sets ``fp`` of ``prints`` whose components are those of ``similarity`` or more.

    ``prints`` are the materialized ``sketches`` of ``docs``, without their codes.
    """
    classes = materialize(prints.where("n > 0").dropDuplicates(["fp"]), "classes")
    rows = classes.select("fp", "n", F.explode("bands").alias("block"))
    met = rows.groupBy("block").agg(F.count("*").alias("size")).where("size > 1")
    rows = materialize(rows.join(met, "block"), "bands")
    few, many = rows.where(F.col("size") <= crowd), rows.where(F.col("size") > crowd)
    company = many.groupBy("fp").agg(F.sum("size").alias("company"))
    who = F.struct("fp", "n")
    picked = many.join(company, "fp").groupBy("block").agg(F.max_by(who, F.struct("company", "fp")).alias("p"), F.min_by(who, F.xxhash64("fp")).alias("q"))
    picked = picked.select("block", F.explode(F.array_distinct(F.array("p", "q"))).alias("p")).select("block", "p.fp", "p.n")
    pairs = _met(few, few, "block", similarity, F.col("x.fp") < F.col("y.fp")).unionByName(_met(many, picked, "block", similarity)).distinct()
    pairs = materialize(pairs, "candidates")
    edges = _verified(docs, classes, pairs, width, similarity)
    if many.limit(1).count() == 0:
        return edges
    comps = connected_components(edges, "a", "b")
    many = many.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    many = materialize(many.select("block", "fp", "n", "component"), "crowded")
    open_ = many.groupBy("block").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one <> other")
    members = materialize(many.join(open_, "block", "left_semi").select("fp", "n", "component").distinct(), "open")
    rest = _rarest_first(docs, classes, members, width, similarity).join(pairs, ["a", "b"], "left_anti")
    return edges.unionByName(_verified(docs, classes, materialize(rest, "rest"), width, similarity))
