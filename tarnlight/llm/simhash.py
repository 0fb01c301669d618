"""SimHash near-duplicates (Charikar 2002) found through pigeonhole blocks (Manku et al. 2007).

A fingerprint's 64 bits are cut into five blocks. Two fingerprints that differ in at most two bits agree on at least three
blocks, so they meet under at least one of the ten keys "these three blocks"; each key fixes 38 bits or more, which keeps
chance meetings rare however large the corpus. Equal fingerprints are one class and meet once. Candidates under a key are
verified by the number of differing bits.

A key under which more than ``crowd`` different fingerprints meet is not joined with itself. There each fingerprint is
linked to itself and to the codes one bit away among the key's free bits: fingerprints at most two bits apart share such a
code, and whatever shares one is at most two bits apart, so the components are the same and no pairs are made.

That radius is the contract of the query. Elsewhere these links stand too, and beside them texts are linked whose sets of
five-word shingles have a Jaccard similarity of 0.8 or more: such texts lie up to 14 bits apart, too far for blocks (see
``shingles.py``), while texts within two bits can be less similar than that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.llm import shingles
from tarnlight.llm.select import unused, without
from tarnlight.llm.shingles import hashes
from tarnlight.llm.text import freed, pieces
from tarnlight.operators.graph import connected_components
from tarnlight.scratch import materialize, temporary

WIDTH = 3
MAX_BITS = 2
BLOCKS = (13, 13, 13, 13, 12)
CROWD = 64


def _fingerprint(text: bytes, width: int) -> int:
    n, ones = 0, np.zeros(64, np.int64)
    for found in hashes(text, width):
        n += len(found)
        bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def simhash(text: Column | str, width: int = WIDTH) -> Column:
    """The 64-bit fingerprint of whole texts as a long.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. Shingles are ``width`` words, repeats
    counted; a text of fewer words is one shingle; no words, the empty text and null give 0. A bit is 1 if it is 1 in the
    XXH64 (seed 42) of more than half the shingles.
    """

    @F.arrow_udf("long")
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return freed(pa.array([_fingerprint(t, width) for part in pieces(texts) for t in part], pa.int64()) for texts in batches)

    return fingerprint.asNondeterministic()(text)


def _keys() -> list[tuple[int, int, list[int]]]:
    """(number, mask, free bits) of each choice of all blocks but ``MAX_BITS``."""
    edges = np.cumsum((0, *BLOCKS)).tolist()
    bits = [range(a, b) for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for number, kept in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - MAX_BITS)):
        mask = sum(1 << b for k in kept for b in bits[k])
        out.append((number, mask, [b for k in range(len(BLOCKS)) if k not in kept for b in bits[k]]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of "at most two differing bits" over distinct fingerprints ``fp``.

    Under crowded keys an end can be a code that no document has; it joins the same components.
    """
    keys = _keys()
    cases = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("block")) for k, m, _ in keys])
    rows = prints.select("fp", F.explode(cases).alias("x")).select("fp", "x.k", "x.block")
    met = rows.groupBy("k", "block").agg(F.count("*").alias("n")).where("n > 1")
    rows = materialize(rows.join(met, ["k", "block"]), "blocks")
    few, many = rows.where(F.col("n") <= crowd), rows.where(F.col("n") > crowd)
    left, right = few.select("k", "block", F.col("fp").alias("a")), few.select("k", "block", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    pairs = left.join(right, ["k", "block"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    flips = F.create_map(*[x for k, _, free in keys for x in (F.lit(k), F.array(*[F.lit(_signed(1 << b)) for b in free]))])
    around = many.select("fp", F.explode(F.element_at(flips, F.col("k"))).alias("bit"))
    around = around.select(F.col("fp").alias("a"), F.col("fp").bitwiseXOR(F.col("bit")).alias("b")).distinct()
    return pairs.distinct().unionByName(around)


def _joined_by_code(prints: DataFrame, crowd: int) -> DataFrame:
    """Edges ``(a, b)`` that join sets ``fp`` of ``prints`` (fp, code) whose texts' SimHash ``code`` is linked.

    A code is a node named by a hash of its own, tied to the sets that it comes from if it is linked or has several.
    """
    codes = materialize(prints.select("fp", "code").distinct(), "codes")
    node = lambda c: F.xxhash64(F.lit("simhash"), F.col(c))
    met = links(codes.select(F.col("code").alias("fp")).distinct(), crowd)
    met = materialize(met.select(node("a").alias("a"), node("b").alias("b")), "met")
    owned = codes.select("fp", node("code").alias("node"))
    several = owned.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    ties = several.unionByName(met.select(F.col("a").alias("node"))).unionByName(met.select(F.col("b").alias("node"))).distinct()
    return met.unionByName(owned.join(ties, "node", "left_semi").select(F.col("fp").alias("a"), F.col("node").alias("b")))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int | None = None, width: int = shingles.WIDTH,
    similarity: float = shingles.SIMILARITY, max_bits: int | None = None,
) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs``: the smallest doc_id reachable over links.

    Linked are texts whose SimHash over WIDTH words differs in at most MAX_BITS bits, and texts whose sets of shingles of
    ``width`` words have a Jaccard similarity of ``similarity`` or more; ``fp`` is a hash of the set. With ``max_bits``
    (MAX_BITS, the only radius that the blocks reach) SimHash alone links, over ``width`` words, and is ``fp``. Either is 0
    for texts without words.

    Other columns of ``docs`` are not read. Repeated rows each give a row. A row without doc_id takes part and gets the
    smallest doc_id of its component, null if there is none. An empty table gives no rows.
    """
    if max_bits not in (None, MAX_BITS):
        raise ValueError(f"max_bits: {MAX_BITS} or none")
    with temporary(docs.sparkSession):
        if max_bits is None:
            docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
            prints = materialize(shingles.sketches(docs, width, lambda t: _fingerprint(t, WIDTH)), "shingles")
            edges = shingles.links(docs, prints.drop("code"), width, similarity, shingles.CROWD if crowd is None else crowd)
            edges = edges.unionByName(_joined_by_code(prints, CROWD if crowd is None else crowd))
            prints = prints.select("doc_id", "fp")
        else:
            prints = materialize(docs.select(F.col(doc_id).alias("doc_id"), simhash(F.col(text), width).alias("fp")), "simhash")
            edges = links(prints.select("fp").distinct(), CROWD if crowd is None else crowd)
        classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
        comps = connected_components(edges, "a", "b")
        named = classes.join(comps.withColumnRenamed("node", "fp"), "fp", "left")
        named = named.select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
        least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
        named = named.join(least, "component").select("fp", "component_id")
        return materialize(prints.join(named, "fp").select("doc_id", "fp", "component_id"), "groups", keep=True)


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near-duplicates, by SimHash or shingles, the document with the smallest doc_id.

    Of repeated doc_ids one row stays. Rows without doc_id stay only where their whole group has none, one of each text.
    """
    found = near_duplicates(docs, doc_id, text)
    n, named, ids = found.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == named == ids:
        return without(docs, doc_id, found.where("doc_id <> component_id").select("doc_id"))
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(unused(docs, "_kept")))
    kept = docs.join(stays.hint("merge"), F.col(doc_id).eqNullSafe(F.col(stays.columns[0])), "left_semi")
    some = kept.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id])
    return some.unionByName(kept.where(F.col(doc_id).isNull()).dropDuplicates([text]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs, width=WIDTH, max_bits=MAX_BITS)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
