"""Codes of 64 bits: pairs, clusters, splits without leaks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions import rules as R
from tarnlight.operators.graph import connected_components
from tarnlight.scratch import materialize, temporary


def _simhash(text: str) -> int:
    words = sorted({w for w in text.split(" ") if w})
    if not words:
        return 0
    digests = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest()[:8] for w in words), np.uint8)
    bits = np.unpackbits(digests.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(words)).view(">i8")[0])


def simhash_words(text: Column) -> Column:
    """A 64-bit SimHash (Charikar 2002) of the distinct space-separated words of the lower-cased text.

    A word's bits are the first 16 hexadecimal digits of its MD5. A bit is 1 if set in more than half of the words; no words
    give 0. Counting 64 bits over arrays of words costs Spark's own array functions fifty times as much, so this is numpy
    on Arrow batches.
    """

    @F.arrow_udf("long")
    def codes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([_simhash(t or "") for t in texts.to_pylist()], pa.int64())

    return codes.asNondeterministic()(F.lower(text))


def _edges(bands: int) -> list[tuple[int, int]]:
    """First bit and width of each band."""
    cuts = [64 * k // bands for k in range(bands + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]


def _bands(code: Column, bands: int) -> Column:
    return F.array(*[
        F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << width) - 1)).cast("bigint").alias("v")) for k, (at, width) in enumerate(_edges(bands))
    ])


def band_number(n: int, t: int) -> int:
    """Four bands or three: what makes fewer probes and chance meetings together over ``n`` codes."""
    def work(bands: int) -> float:
        return sum(sum(math.comb(w, r) for r in range(t // bands + 1)) * (1 + n / 2**w) for _, w in _edges(bands))

    return min((4, 3), key=work)


def near_codes(left: DataFrame, right: DataFrame, t: int = 10, bands: int | None = None) -> DataFrame:
    """(a, b, d) for distinct codes of both tables (column ``code``) at most t bits apart.

    Of the bands of a code one differs in at most t // bands bits, so probing that band within that radius misses nothing. The
    probes go out from the left side. Four bands of 16 bits are probed 548 times for t = 10 and meet 0.8% of all random
    codes; from some 700,000 codes on three bands are wider: 4,700 probes meet 0.2%. The pairs are the same.
    """
    bands = bands or band_number(right.count(), t)
    masks = F.create_map(*[x for k, (_, width) in enumerate(_edges(bands)) for x in (F.lit(k), F.lit(_masks(width, t // bands)).cast("array<bigint>"))])
    probed = left.select(F.col("code").alias("a"), F.explode(_bands(F.col("code"), bands)).alias("x"))
    probed = probed.select("a", F.col("x.k").alias("k"), F.explode(F.element_at(masks, F.col("x.k"))).alias("m"), F.col("x.v").alias("v"))
    probed = probed.select("a", "k", F.col("v").bitwiseXOR(F.col("m")).alias("v"))
    banded = right.select(F.col("code").alias("b"), F.explode(_bands(F.col("code"), bands)).alias("x")).select("b", "x.k", "x.v")
    # sizes are estimated from before the explode, so neither side may be taken for a small one
    met = probed.join(banded.hint("merge"), ["k", "v"]).withColumn("d", R.hamming(F.col("a"), F.col("b"))).where(F.col("d") <= t)
    return met.select("a", "b", "d").distinct()


#: Where all codes meet, they do so in blocks of so many (0.5 MB), two blocks at a time.
FAR_BLOCK = 1 << 16
#: Blocks of a table at least, so that tasks share the work of a small one.
LEAST_BLOCKS = 8
#: Up to so many pairs of codes, blocks are no slower than looking up (a pair costs a nanosecond, a row looked up some hundreds by estimate)
#: and send far less; the result is the same.
DIRECT = 1 << 52
#: A tile of two blocks: what is compared at once fits a core's cache.
_TALL, _WIDE = 64, 4096


def _block_number(n: int) -> int:
    return max(LEAST_BLOCKS, -(-n // FAR_BLOCK))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int").alias("block")


def _numbers(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _dealt(sent: DataFrame, pairs: int) -> DataFrame:
    """Pairs of blocks (i, j) over tasks: a task's time comes from pairs of codes, which their bytes don't show."""
    return sent.repartition(min(pairs, 1024), "i", "j")


def pairs_in_blocks(codes: DataFrame, n: int, t: int = 10) -> DataFrame:
    """(a, b, d), a < b, for ``n`` distinct codes (column ``code``) at most t bits apart: each block meets itself and every later one.

    Time grows with the square of n, by a nanosecond a pair; a task holds two blocks and passes pairs on as it finds them.
    """
    blocks = _block_number(n)
    packed = codes.where("code is not null").groupBy(_block(blocks)).agg(F.collect_list("code").alias("codes"))
    sent = packed.withColumn("other", _numbers(blocks)).select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "codes")
    tall, wide = _TALL, _WIDE

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i == j, c.values.to_numpy().view(np.uint64)) for x in batches for i, j, c in zip(x["i"].to_pylist(), x["j"].to_pylist(), x["codes"], strict=True)]
        own, a, b = rows[0][0], rows[0][1], rows[-1][1]
        if not own and len(rows) < 2:  # the other block is empty
            return
        held, n_held = [], 0
        for x in range(0, len(a), tall):
            for y in range(x if own else 0, len(b), wide):
                d = np.bitwise_count(a[x : x + tall, None] ^ b[y : y + wide])
                at = np.flatnonzero(d <= t)
                p, q = np.divmod(at, d.shape[1])
                if own:  # each pair of a block with itself once
                    later = y + q > x + p
                    at, p, q = at[later], p[later], q[later]
                if len(at):
                    u, v = a[x + p].view(np.int64), b[y + q].view(np.int64)
                    held.append((np.minimum(u, v), np.maximum(u, v), d.ravel()[at].astype(np.int32)))
                    n_held += len(at)
                if n_held > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*held, strict=True)], ["a", "b", "d"])
                    held, n_held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*held, strict=True)], ["a", "b", "d"])

    return _dealt(sent, blocks * (blocks + 1) // 2).groupBy("i", "j").applyInArrow(meet, "a long, b long, d int")


def _nearest_in_blocks(open_: DataFrame, n_open: int, firsts: DataFrame, n_firsts: int) -> DataFrame:
    """(code, d, k): for each code of ``open_`` the nearest of each block of ``firsts`` (code, k), of equals the smallest k."""
    kind = dict(firsts.dtypes)["k"]
    rows, cols = _block_number(n_open), _block_number(n_firsts)
    left = open_.groupBy(_block(rows)).agg(F.collect_list("code").alias("codes")).select(F.col("block").alias("i"), _numbers(cols).alias("j"), "codes", F.lit(None).cast(f"array<{kind}>").alias("keys"))
    right = firsts.groupBy(_block(cols)).agg(F.array_sort(F.collect_list(F.struct("k", "code"))).alias("x"))
    right = right.select(_numbers(rows).alias("i"), F.col("block").alias("j"), F.col("x.code").alias("codes"), F.col("x.k").alias("keys"))
    tall, wide = _TALL, _WIDE

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = known = keys = None
        for batch in batches:
            for c, k in zip(batch["codes"], batch["keys"], strict=True):
                if k.is_valid:
                    known, keys = c.values.to_numpy().view(np.uint64), k.values
                else:
                    mine = c.values.to_numpy().view(np.uint64)
        if mine is None or known is None:  # an empty block
            return
        near, at = np.full(len(mine), 255, np.uint8), np.zeros(len(mine), np.int64)
        for x in range(0, len(mine), tall):
            best, where = near[x : x + tall], at[x : x + tall]
            for y in range(0, len(known), wide):
                d = np.bitwise_count(mine[x : x + tall, None] ^ known[y : y + wide])
                new = np.flatnonzero(d.min(axis=1) < best)  # of equals the first stays, which has the smallest key
                where[new] = y + d[new].argmin(axis=1)
                best[new] = d[new, where[new] - y]
        yield pa.RecordBatch.from_arrays([pa.array(mine.view(np.int64)), pa.array(near.astype(np.int32)), keys.take(pa.array(at))], ["code", "d", "k"])

    return _dealt(left.unionByName(right), rows * cols).groupBy("i", "j").applyInArrow(meet, f"code long, d int, k {kind}")


def hamming_pairs(df: DataFrame, key: str, code: str, t: int = 10) -> DataFrame:
    """Pairs of distinct codes at most t bits apart, a < b. Equal codes are one class; ``members`` has its rows."""
    codes = df.select(F.col(code).alias("code")).distinct()
    n = codes.count()
    return pairs_in_blocks(codes, n, t) if n * n <= DIRECT else near_codes(codes, codes, t).where("a < b")


def clusters(df: DataFrame, key: str, code: str, t: int = 10) -> DataFrame:
    """(key, code, cluster_id): components of "at most t bits", named by their smallest key."""
    comps = connected_components(hamming_pairs(df, key, code, t), "a", "b").select(F.col("node").alias("code"), "component")
    named = df.select(key, F.col(code).alias("code")).join(comps, "code", "left").withColumn("component", F.coalesce("component", "code"))
    least = named.groupBy("component").agg(F.min(key).alias("cluster_id"))
    return named.join(least, "component").select(key, "code", "cluster_id")


def group_split(clustered: DataFrame, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Whole clusters go to val, in seeded order, while val has less than int(n * ratio) rows.

    Clusters are summed by the first three digits of their draw; only the one sum in which val fills up is put in order.
    """
    sizes = clustered.groupBy("cluster_id").agg(F.count("*").alias("n")).withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.col("cluster_id").cast("string"))))
    sizes = sizes.withColumn("b", F.substring("draw", 1, 3))
    sums = sizes.groupBy("b").agg(F.sum("n").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 4096 rows at most
    sums = sums.select("b", before.alias("before"))
    target = sizes.agg(F.floor(F.coalesce(F.sum("n"), F.lit(0)) * F.lit(ratio)).alias("target"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("draw", "cluster_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    split = sizes.withColumn("inside", inside).join(sums, "b").crossJoin(F.broadcast(target))  # one row
    split = split.select("cluster_id", F.when(F.col("before") + F.col("inside") < F.col("target"), "val").otherwise("train").alias("split"))
    return clustered.join(split, "cluster_id")


def cluster_stats(clustered: DataFrame) -> DataFrame:
    """A15, F34"""
    sizes = clustered.groupBy("cluster_id").agg(F.count("*").alias("n"))
    out = sizes.agg(
        F.count("*").alias("clusters"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"), F.avg("n").alias("mean"),
        F.expr("percentile(n, 0.5D)").cast("int").alias("median"), F.stddev_pop("n").alias("std"),
    )
    pct = F.try_divide(F.col("singletons") * 100.0, F.col("clusters"))
    return out.select("clusters", "singletons", F.round(pct, 4).alias("singleton_pct"), "largest", F.round("mean", 6).alias("mean"), "median", F.round("std", 6).alias("std"), R.cluster_risk(pct).alias("risk"))


def split_overlap(split: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Clusters that occur in both splits, and the rows of these."""
    val, train = (split.where(F.col("split") == s).select(cluster) for s in ("val", "train"))
    both = val.intersect(train)
    rows = split.join(both, cluster, "left_semi")
    return rows.agg(F.count_distinct(cluster).alias("clusters"), F.count("*").alias("rows"))


def nearest_code(val: DataFrame, train: DataFrame, key: str = "doc_id", flips: int = 3) -> DataFrame:
    """(key, distance, nearest) for each val row: the nearest of all train rows, of equals the smallest key.

    Up to ``DIRECT`` pairs all codes meet in blocks of bounded size. Beyond, codes are cut into four: what differs in at most
    4s + 3 bits has a quarter that differs in at most s, so round s looks the quarters up with s bits flipped, and a code leaves
    once its nearest so far is that near (a growing radius; Norouzi et al. 2014). Codes that are farther than 4 flips + 3 bits
    from everything then meet all train codes in blocks. Null codes, and all rows if train has none, have no distance.
    """
    spark = val.sparkSession
    with temporary(spark):
        firsts = materialize(train.where("code is not null").groupBy("code").agg(F.min(key).alias("k")), "codes")
        open_ = materialize(val.where("code is not null").select("code").distinct().withColumn("m", F.lit(None).cast(f"struct<d:int,k:{dict(firsts.dtypes)['k']}>")), "open")
        done = []

        def better(met: DataFrame) -> DataFrame:
            """Open codes with the nearer of what they had and what they have met (code, d, k)."""
            got = met.groupBy("code").agg(F.min(F.struct("d", "k")).alias("new"))
            both = open_.join(got.hint("merge"), "code", "left")
            return materialize(both.select("code", F.least("m", "new").alias("m")), "nearer")

        known_codes = firsts.count()
        for s in range(flips + 1):
            if open_.count() * known_codes <= DIRECT:
                break
            index = firsts.select(F.explode(_bands(F.col("code"), 4)).alias("at"), F.col("code").alias("other"), "k")
            masks = F.lit([sum(1 << b for b in bits) for bits in combinations(range(16), s)]).cast("array<bigint>")
            keys = F.flatten(F.transform(_bands(F.col("code"), 4), lambda at: F.transform(masks, lambda x: F.struct(at["k"].alias("k"), at["v"].bitwiseXOR(x).alias("v")))))
            met = open_.select("code", F.explode(keys).alias("at")).join(index.hint("merge"), "at")  # as in near_codes
            known = better(met.select("code", R.hamming(F.col("code"), F.col("other")).cast("int").alias("d"), "k"))
            sure = F.coalesce(F.col("m.d") <= 4 * s + 3, F.lit(False))
            done.append(known.where(sure))
            open_ = known.where(~sure)
        out = better(_nearest_in_blocks(open_.select("code"), open_.count(), firsts, known_codes))
        for more in done:
            out = out.unionByName(more)
        found = materialize(out, "nearest", keep=True)
    return val.select(key, "code").join(found, "code", "left").select(key, F.col("m.d").alias("distance"), F.col("m.k").alias("nearest"))


def distance_profile(distances: DataFrame) -> DataFrame:
    """How many distances are 0 to 19, all bins filled, with the shares below 5 and 10 and of F34's suspicious ones."""
    bins = distances.sparkSession.range(20).select(F.col("id").cast("int").alias("bin"))
    counts = distances.groupBy(F.col("distance").alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def distance_summary(distances: DataFrame) -> DataFrame:
    """A16, F34"""
    pct = lambda cond: F.avg(cond.cast("double")) * 100
    d = F.col("distance")
    out = distances.agg(F.min("distance").alias("min"), F.max("distance").alias("max"), F.avg("distance").alias("mean"), F.expr("percentile(distance, 0.5D)").alias("median"), pct(d < 5).alias("below_5"), pct(d < 10).alias("below_10"), pct(d <= 6).alias("suspicious"))
    return out.select("min", "max", F.round("mean", 4).alias("mean"), "median", F.round("below_5", 4).alias("below_5"), F.round("below_10", 4).alias("below_10"), R.leakage_level(F.coalesce("suspicious", F.lit(0.0))).alias("level"))
