"""Benchmark passages in training texts: broadcast sets of the test windows, scan every window of every text, remove.

Both sides are normalised alike: A-Z lower-cased, words are runs of digits, letters and all non-ASCII characters. A window
is ``WINDOW`` words in a row; an item of fewer words is one window. The windows are broadcast as hashes in blocks of items
of at most ``BLOCK_WORDS`` words, so what is sent has a fixed bound however large the benchmark; every text is scanned
against every block. A text's window is looked up by the numbers of its words in the block's vocabulary, which are equal
only if the words are: a hit of the hash set is verified by comparing them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.select import unused
from tarnlight.llm.text import freed, pieces
from tarnlight.scratch import drop, materialize

WINDOW = 10
#: Words of one broadcast block: about 40 MB as Python objects.
BLOCK_WORDS = 200_000
#: Blocks that a task holds at once. A larger benchmark takes more passes, each written before the next.
PASS_BLOCKS = 4
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_MULTIPLIER = 0x9E3779B97F4A7C15
RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<first:int,last:int>>>"


def words(text: bytes) -> list[bytes]:
    """Runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z."""
    return text.translate(_WORD_BYTES).split()


def _rolling(numbers: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` numbers in a row."""
    out = np.zeros(len(numbers) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(_MULTIPLIER) + numbers[k : k + len(out)]
    return out


class Windows:
    """The windows of some items: vocabulary, hashes by width, and for each hash the windows with their items."""

    def __init__(self, vocabulary: dict[bytes, int], by_width: dict[int, dict[int, dict[tuple[int, ...], set[str]]]]):
        self.vocabulary, self.by_width = vocabulary, by_width
        self.hashes = {w: np.array(sorted(x), np.uint64) for w, x in by_width.items()}

    @classmethod
    def of(cls, items: list[tuple[str, list[bytes]]], window: int) -> Windows:
        vocabulary: dict[bytes, int] = {}
        by_width: dict[int, dict[int, dict[tuple[int, ...], set[str]]]] = {}
        for item, found in items:
            numbers = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in found]
            width = min(window, len(numbers))
            if not width:
                continue
            at = by_width.setdefault(width, {})
            for i, h in enumerate(_rolling(np.array(numbers, np.uint64), width).tolist()):
                at.setdefault(h, {}).setdefault(tuple(numbers[i : i + width]), set()).add(item)
        return cls(vocabulary, by_width)

    def parts(self) -> tuple[dict, dict]:
        """Plain values that make the block again, so that they can be sent where this package isn't installed."""
        return self.vocabulary, self.by_width

    def hits(self, found: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, width, items) of every occurrence of a window."""
        get = self.vocabulary.get
        numbers = np.fromiter((get(w, 0) for w in found), np.uint64, len(found))
        known = np.concatenate([[0], np.cumsum(numbers > 0)])
        for width, hashes in self.hashes.items():
            if len(found) < width:
                continue
            full = np.flatnonzero(known[width:] - known[:-width] == width)
            if not len(full):
                continue
            rolled = _rolling(numbers, width)[full]
            at = np.searchsorted(hashes, rolled)
            for i in full[hashes[np.minimum(at, len(hashes) - 1)] == rolled].tolist():
                key = numbers[i : i + width]
                items = self.by_width[width].get(int(_rolling(key, width)[0]), {}).get(tuple(key.tolist()))
                if items:
                    yield i, width, items


def _scan(text: bytes, windows: Windows) -> tuple[int, np.ndarray, set[str]]:
    found = words(text)
    change = np.zeros(len(found) + 1, np.int64)
    items: set[str] = set()
    for i, width, of in windows.hits(found):
        change[i] += 1
        change[i + width] -= 1
        items |= of
    return len(found), np.cumsum(change[:-1]) > 0, items


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> Iterator[Windows]:
    """The benchmark's windows in blocks of bounded size, in the order of item ids. Items come in one block at a time."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    part: list[tuple[str, list[bytes]]] = []
    size = 0
    for item, t in rows.where("item is not null").toLocalIterator():
        found = words(t.encode())
        for at in range(0, max(1, len(found)), BLOCK_WORDS):  # the windows of a very long item are dealt over blocks
            piece = found[at : at + BLOCK_WORDS + window - 1]
            if at and len(piece) < window:
                continue
            if part and size + len(piece) > BLOCK_WORDS:
                yield Windows.of(part, window)
                part, size = [], 0
            part.append((item, piece))
            size += len(piece)
    yield Windows.of(part, window)


def matches(text: Column, windows: list, before: Column | None = None) -> Column:
    """RESULT for each text against some broadcast blocks, together with what ``before`` found against others."""
    span = pa.struct([("first", pa.int32()), ("last", pa.int32())])
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(span))])

    def found(t: bytes, had: dict | None, blocks: list[Windows]) -> dict:
        n, hit, items = 0, None, set(had["items"] if had else ())
        for block in blocks:
            n, more, of = _scan(t, block)
            hit = more if hit is None else hit | more
            items |= of
        for s in had["spans"] if had else ():
            hit[s["first"] : s["last"] + 1] = True
        return {"n_words": n, "n_hit": int(hit.sum()), "items": sorted(items), "spans": [{"first": a, "last": b} for a, b in _runs(hit)] if items else []}

    def each(batches: Iterator[tuple[pa.Array, list]]) -> Iterator[pa.Array]:
        blocks = [Windows(*b.value) for b in windows]
        for texts, had in batches:
            every = (t for part in pieces(texts) for t in part)
            yield pa.array([found(t, h, blocks) for t, h in zip(every, had, strict=True)], kind)

    @F.arrow_udf(RESULT)
    def first(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return freed(each((texts, [None] * len(texts)) for texts in batches))

    @F.arrow_udf(RESULT)
    def further(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return freed(each((texts, had.to_pylist()) for texts, had in batches))

    return first.asNondeterministic()(text) if before is None else further.asNondeterministic()(text, before)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, out: str = "match") -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_hit, items (ids as sorted strings), spans (runs of hit words).

    A column of that name is replaced; the caller chooses it.

    A word is hit if it lies inside any occurrence of a window. Null and empty texts have no words; an empty benchmark hits
    nothing. Items without words or without id have no windows; items that repeat an id count once. Rows stay as they are,
    and no text is shuffled. PASS_BLOCKS blocks are broadcast for a pass; a pass beyond the first reads what the one before it
    wrote, which is deleted then.
    """
    context = docs.sparkSession.sparkContext
    found, held = None, []
    for block in blocks(benchmark, window=window):
        if len(held) == PASS_BLOCKS:
            done = docs.withColumn(out, matches(F.col(text), held)) if found is None else found.withColumn(out, matches(F.col(text), held, F.col(out)))
            before, found = found, materialize(done, "pass", keep=True)
            if before is not None:
                drop(before)
            for sent in held:
                sent.destroy()
            held = []
        held.append(context.broadcast(block.parts()))
    if found is None:
        return docs.withColumn(out, matches(F.col(text), held))
    return found.withColumn(out, matches(F.col(text), held, F.col(out)))


_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def without_spans(text: Column, spans: Column) -> Column:
    """The text with the hit words, and what stands between two of one span, removed. ``spans`` are in order and apart.

    What stays is cut out between the spans, so the cost is in proportion to the text, however many spans it has.
    """
    text = F.coalesce(text, F.lit(""))
    gaps = F.regexp_extract_all(text, F.lit(_SEPARATOR), F.lit(0))

    def cut(x: Column) -> Column:
        parts, spans = x["parts"], x["spans"]
        head = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)  # a text that begins with a separator has no word before it
        starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["last"] + 1 + head))
        ends = F.concat(F.transform(spans, lambda s: s["first"] + head), F.array(F.size(parts)))
        kept = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda z: F.slice(x["pieces"], z["a"] + 1, z["b"] - z["a"]))
        return F.array_join(F.flatten(kept), "")

    # bound by a lambda each, so that no span computes the words anew
    split = F.transform(F.array(F.struct(F.split(text, _SEPARATOR, -1).alias("parts"), gaps.alias("gaps"), spans.alias("spans"))), lambda x: F.struct(
        x["parts"].alias("parts"), x["spans"].alias("spans"), F.transform(x["parts"], lambda p, i: F.concat(p, F.coalesce(F.get(x["gaps"], i), F.lit("")))).alias("pieces"),
    ))
    return F.get(F.transform(split, cut), F.lit(0))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents (``remove="documents"``) or without their hit words (``"spans"``)."""
    match = unused(docs, "_match")
    found = contamination(docs, benchmark, text, window, match)
    n_hit = F.col(match)["n_hit"]
    if remove == "documents":
        return found.where(n_hit == 0).drop(match)
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    clean = F.when(n_hit > 0, without_spans(F.col(text), F.col(match)["spans"])).otherwise(F.col(text))
    return found.withColumn(text, clean).drop(match)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "match.n_words", "match.n_hit", F.size("match.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("match.items", ","), 256).alias("items_sha256"), (F.col("match.n_hit") > 0).alias("contaminated"),
    )


#: Windows as joined words, met by equality. Lower-casing is spelled out, because lower() changes more than A-Z.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0) x),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k) x),
hits AS (SELECT doc_id, dw.k, i, item FROM dw JOIN bw ON bw.g = dw.g AND bw.k = dw.k),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hits) y GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) z GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items s USING (doc_id)
"""
