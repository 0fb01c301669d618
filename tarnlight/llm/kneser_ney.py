"""An interpolated modified Kneser-Ney bigram model (Chen and Goodman 1998), counted in Spark, read by memory map.

Tokens are 64-bit hashes. Counting goes in two rounds, each a pre-aggregation in the task, a shuffle by hash range and a
merge of one range at a time:

1. bigrams: each task sends its distinct pairs with their counts, packed, to the pair's range. A range's merged counts are
   written as a file of sorted hash arrays, and give for each context how many followers it had once, twice and more often,
   and for each token how many different tokens preceded it.
2. tokens: these and the plain counts go to the token's range and are written as sorted hash arrays too.

With more than 2^10 ranges rows are not sent to each of them: a task deals them to 2^10 coarse ranges by the first ten bits
of the key, a task of a coarse range merges what it gathers and deals it by the next ten, and so on. So a send makes 2^10
rows at most, and rows grow with the corpus times the number of rounds, not with its square.

The files lie in the shared folder. Scoring tasks map them into memory and look up the distinct pairs and tokens of some MB
of text at a time, in sorted order, so a task holds no model, and the model may be larger than memory. The number of ranges
grows with the corpus, so that a range's size doesn't.

The order is two: context of more than one word is not used (README has the figures behind that).
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm.text import columns, hash64, lower_words, mixed, utf8
from tarnlight.scratch import delete, new_path

#: Documents whose crc32(doc_id as text) leaves this remainder are held out and not learned from.
FOLDS, HELD_OUT = 7, 2
#: Characters of text for each range, tokens gathered by a task before it sends them on, and bytes scored at a time.
RANGE_CHARS, TASK_TOKENS, SCORE_BYTES = 24_000_000, 4_000_000, 12_000_000
#: Hashes of the end of a text and of what stands before its first token. Words have no white space, so none is hashed alike.
END, START = (int(x) for x in hash64([b"\n", b" "]))
_U48 = np.uint64(16)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a key that one round of sending tells apart.
ROUND_BITS = 10


def _pairs(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A hash of two tokens in a row. Tokens count here by their first 48 bits."""
    return mixed((before >> _U48) * _PAIR + mixed(after >> _U48))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte planes together, compressed."""
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(data: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=n * sum(np.dtype(k).itemsize for k in kinds) or 1), np.uint8)
    out, at = [], 0
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).ravel())
        at += n * size
    return out


def _counted(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, an index of the first row of each, and the sum of each array over a key's rows."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], order[first], *[np.add.reduceat(s[order], first) if len(first) else s[:0] for s in sums]


def _rounds(bits: int) -> list[int]:
    """How many bits of the key the ranges have after each round of sending; the last has all."""
    return [*range(ROUND_BITS, bits, ROUND_BITS), bits]


def _by_range(bits: int, kind: str, keys: np.ndarray, *arrays: np.ndarray) -> Iterator[dict]:
    """Packed rows, one for each range of sorted ``keys`` that has any."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(first, np.append(first[1:], len(keys)), strict=True):
        yield {"part": int(part[a]), "kind": kind, "n": int(b - a), "data": _pack(*[x[a:b] for x in arrays])}


def _types(kind: str) -> tuple[type, ...]:
    """What a packed row of a kind holds. Counts that a round has added up are wide; their kind ends in a plus."""
    wide = kind.endswith("+")
    n = np.int64 if wide else np.uint32
    return {"pairs": (np.uint64, np.uint64, n), "tokens": (np.uint64, np.int64), "contexts": (np.uint64, n, n, n), "preceded": (np.uint64, n)}[kind.rstrip("+")]


def _unpacked(kind: str, n: int, data: bytes) -> tuple[str, list[np.ndarray]]:
    """The kind without its width, and its arrays: of pairs both tokens, else one key, then counts."""
    types, kind = _types(kind), kind.rstrip("+")
    arrays, keys = _unpack(data, n, *types), 2 if kind == "pairs" else 1
    if kind == "pairs":
        arrays[0] = np.cumsum(arrays[0], dtype=np.uint64)
    return kind, [*arrays[:keys], *[x.astype(np.int64) for x in arrays[keys:]]]


def _pairs_by_range(bits: int, kind: str, before: np.ndarray, after: np.ndarray, count: np.ndarray) -> Iterator[dict]:
    """Packed rows of distinct pairs of tokens (their 48 bits) with the sums of their counts."""
    keys, at, n = _counted(_pairs(before << _U48, after << _U48), count)
    before, after = before[at], after[at]
    part = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    order = np.argsort((part << np.uint64(48)) | before if bits <= 16 else keys)  # equal contexts pack well
    before, part = before[order], part[order]
    same = np.concatenate([[False], part[1:] == part[:-1]])
    steps = before - np.where(same, np.roll(before, 1), np.uint64(0))
    yield from _by_range(bits, kind, keys[order], steps, after[order], n[order].astype(_types(kind)[2]))


_ROWS = "part long, kind string, n long, data binary"
_SCHEMA = pa.schema([("part", pa.int64()), ("kind", pa.string()), ("n", pa.int64()), ("data", pa.binary())])


def _send(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _SCHEMA)


def _write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """A file appears whole or not at all; a task that runs again writes the same bytes."""
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as out:
        for key, array in arrays.items():
            head = io.BytesIO()
            np.lib.format.write_array_header_1_0(head, np.lib.format.header_data_from_array_1_0(array))
            data = head.getvalue() + array.tobytes()
            out.write(f"{key} {len(data)}\n".encode().ljust(64) + data)
    files.move(temporary, f"{path}/{name}")


def _mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory.

    From a store without files, the executor's first task that needs a file copies it to the folder that Spark gives the
    executor for the application, and deletes with it; the others map that copy.
    """
    files, path = fs.FileSystem.from_uri(folder)
    path = f"{path}/{name}"
    local = path
    if not isinstance(files, fs.LocalFileSystem):
        local = os.path.join(SparkFiles.getRootDirectory(), f"{folder.rstrip('/').rsplit('/', 1)[-1]}-{name}")
        if not os.path.exists(local):
            part = f"{local}-{uuid.uuid4().hex}"
            with open(part, "wb") as out, files.open_input_stream(path) as source:
                while piece := source.read(1 << 24):
                    out.write(piece)
            os.replace(part, local)
    whole = np.memmap(local, np.uint8, "r") if os.path.getsize(local) else np.empty(0, np.uint8)
    found, at = {}, 0
    while at < len(whole):
        key, size = bytes(whole[at : at + 64]).split()
        body = whole[at + 64 : at + 64 + int(size)]
        head = io.BytesIO(bytes(body[:256]))
        np.lib.format.read_magic(head)
        shape, _, kind = np.lib.format.read_array_header_1_0(head)
        start = head.tell()
        found[key.decode()] = np.frombuffer(body[start : start + int(np.prod(shape)) * kind.itemsize], kind)
        at += 64 + int(size)
    return found


def _small(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in a byte each, and the few of 255 and more apart with their places."""
    large = np.flatnonzero(counts >= 255)
    return {"count": np.minimum(counts, 255).astype(np.uint8), "at": large.astype(np.int64), "full": counts[large].astype(np.int64)}


def _token_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the hashes of its tokens; the last is the end."""
    for t in texts:
        found = hash64(lower_words(t))
        yield np.append(found, np.uint64(END))


@dataclass
class Model:
    folder: str
    bits: int
    tokens: int  # N
    types: int  # V
    pair_types: int
    pair_discounts: tuple[float, float, float]
    type_discounts: tuple[float, float, float]
    unseen: float  # mass that the lower order leaves to the uniform distribution over V + 1 tokens
    texts: int


def forget(spark: SparkSession, model: Model) -> None:
    """Delete a model's files, when no scores by it are still to be made."""
    delete(spark, model.folder)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many have counts 1 to 4; 0.75 of absolute discounting where these don't give proper ones."""
    n1, n2, n3, n4 = n
    if not (n1 and n2):
        return (0.75, 0.75, 0.75)
    y = n1 / (n1 + 2 * n2)
    out = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.75]
    return tuple(d if 0 < d < k else 0.75 for k, d in enumerate(out, 1))


def _of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5].tolist()


def _dealt(rows: DataFrame, bits: int, tasks: int) -> DataFrame:
    """A further round: rows of a coarse range, some at a time, added up and dealt by ``bits`` bits of their keys.

    Any task may take any of a coarse range's rows, so ranges are spread over as many tasks as there are.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(held: dict[str, list]) -> Iterator[dict]:
            for kind, arrays in held.items():
                columns = [np.concatenate(x) for x in zip(*arrays, strict=True)]
                if kind == "pairs":
                    yield from _pairs_by_range(bits, "pairs+", *columns)
                    continue
                keys, _, *sums = _counted(*columns)
                yield from _by_range(bits, f"{kind}+", keys if kind == "tokens" else keys << _U48, keys, *sums)

        held, size, part, sizes = {}, 0, None, None
        for batch in batches:
            for number, kind, n, data in zip(*[batch.column(c).to_pylist() for c in ("part", "kind", "n", "data")], strict=True):
                if kind == "sizes":
                    sizes = np.frombuffer(data, np.int64) + (0 if sizes is None else sizes)
                    continue
                if held and (number != part or size >= TASK_TOKENS):
                    yield _send(list(sent(held)))
                    held, size = {}, 0
                kind, arrays = _unpacked(kind, n, data)
                held.setdefault(kind, []).append(arrays)
                part, size = number, size + n
        if held:
            yield _send(list(sent(held)))
        if sizes is not None:
            yield _send([{"part": -1, "kind": "sizes", "n": len(sizes), "data": sizes.tobytes()}])

    spread = F.pmod(F.xxhash64("data"), F.lit(max(1, tasks >> ROUND_BITS)))
    return rows.repartition(tasks, "part", spread).sortWithinPartitions("part").mapInArrow(deal, _ROWS)


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count the model over all of ``docs``. Null is the empty text. No rows: a model that knows no token."""
    spark = docs.sparkSession
    folder = new_path(spark, "kneser-ney")
    texts = docs.select(F.col(text).alias("text"))
    rows, chars = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    bits = max(0, int(np.ceil(np.log2(max(1, chars / RANGE_CHARS)))))
    first, *further = _rounds(bits)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(held: list[np.ndarray]) -> Iterator[dict]:
            after = np.concatenate(held)
            before = np.concatenate([[np.uint64(START)], after[:-1]])
            before[np.cumsum([len(x) for x in held])[:-1]] = START
            yield from _pairs_by_range(first, "pairs", before >> _U48, after >> _U48, np.ones(len(after), np.int64))
            yield from _by_range(first, "tokens", *(lambda k, _, c: (k, k, c))(*_counted(np.concatenate(held), np.ones(sum(map(len, held)), np.int64))))

        held, size = [], 0
        for (column,) in columns(batches, "text"):
            for found in _token_hashes(utf8(column)):
                held.append(found)
                size += len(found)
                if size >= TASK_TOKENS:
                    yield _send(list(sent(held)))
                    held, size = [], 0
        if held:
            yield _send(list(sent(held)))

    def merge_pairs(key: tuple, table: pa.Table) -> pa.Table:
        out, pairs, number = [], [], key[0].as_py()
        for kind, n, data in zip(*[table.column(c).to_pylist() for c in ("kind", "n", "data")], strict=True):
            if kind.startswith("tokens"):
                out.append({"part": number >> (bits - first), "kind": kind, "n": n, "data": data})
                continue
            pairs.append(_unpacked(kind, n, data)[1])
        if not pairs:
            return pa.Table.from_pylist(out, _SCHEMA)
        before, after, count = (np.concatenate(x) for x in zip(*pairs, strict=True))
        del pairs
        keys, at, n = _counted(_pairs(before << _U48, after << _U48), count)
        before, after = before[at], after[at]
        _write(folder, f"pairs-{number}", {"hash": keys, **_small(n)})
        out.append({"part": -1, "kind": "sizes", "n": 5, "data": np.array([len(keys), *_of_counts(n)], np.int64).tobytes()})
        contexts, _, one, two, more = _counted(before, *[x.astype(np.int64) for x in (n == 1, n == 2, n > 2)])
        out += _by_range(first, "contexts", contexts << _U48, contexts, *[x.astype(np.uint32) for x in (one, two, more)])
        types, _, preceded = _counted(after, np.ones(len(after), np.int64))
        out += _by_range(first, "preceded", types << _U48, types, preceded.astype(np.uint32))
        return pa.Table.from_pylist(out, _SCHEMA)

    def sizes(first: int, values: np.ndarray) -> pa.Table:
        return pa.table({"k": pa.array(np.arange(first, first + len(values)), pa.int32()), "value": pa.array(values, pa.int64())})

    def merge_tokens(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        if number < 0:
            return sizes(0, np.sum([np.frombuffer(x, np.int64) for x in table.column("data").to_pylist()], axis=0))
        got: dict[str, list] = {"tokens": [], "contexts": [], "preceded": []}
        for kind, n, data in zip(*[table.column(c).to_pylist() for c in ("kind", "n", "data")], strict=True):
            kind, arrays = _unpacked(kind, n, data)
            got[kind].append(arrays)
        sums = {}
        for kind, width in (("tokens", 1), ("contexts", 3), ("preceded", 1)):
            arrays = [np.concatenate(x) for x in zip(*got[kind], strict=True)] or [np.empty(0, np.uint64), *[np.empty(0, np.int64)] * width]
            sums[kind] = _counted(*arrays)
        hashes, _, count = sums["tokens"]

        def at(kind: str, number: int) -> np.ndarray:
            keys, values = sums[kind][0], sums[kind][2 + number]
            if not len(keys):
                return np.zeros(len(hashes), np.uint32)
            k = np.minimum(np.searchsorted(keys, hashes >> _U48), len(keys) - 1)
            return np.where(keys[k] == hashes >> _U48, values[k], 0).astype(np.uint32)

        preceded = at("preceded", 0)
        arrays = {"hash": hashes, "count": count, "preceded": preceded, **{f"n{k + 1}": at("contexts", k) for k in range(3)}}
        starts = sums["contexts"]  # the context before a first token is no token; its followers stand apart
        k = np.flatnonzero(starts[0] == np.uint64(START) >> _U48)
        if len(k):
            arrays["start"] = np.array([x[k[0]] for x in starts[2:]], np.int64)
        _write(folder, f"tokens-{number}", arrays)
        return sizes(5, np.array([len(hashes), count.sum(), preceded.sum(dtype=np.int64), *_of_counts(preceded)], np.int64))

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 << bits)  # as many ranges in each, however large the corpus
    sent = texts.mapInArrow(gather, _ROWS)
    for b in further:
        sent = _dealt(sent, b, tasks)
    pairs = sent.repartition(tasks, "part").groupBy("part").applyInArrow(merge_pairs, _ROWS)
    for b in further:
        pairs = _dealt(pairs, b, tasks)
    merged = pairs.repartition(tasks, "part").groupBy("part").applyInArrow(merge_tokens, "k int, value long")
    total = dict(merged.groupBy("k").agg(F.sum("value")).collect())
    pair_types, *pairs, v, n, preceded, of1, of2, of3, of4 = (total.get(k, 0) for k in range(12))
    of = [of1, of2, of3, of4]
    lower = _discounts(of)
    left = sum(d * x for d, x in zip(lower, (of[0], of[1], v - of[0] - of[1]), strict=True)) / max(1, preceded)
    return Model(folder, bits, n, v, pair_types, _discounts(pairs), lower, left if preceded else 1.0, rows)


class Lookup:
    """The model's files, mapped once in a task."""

    def __init__(self, model: Model):
        self.model = model
        self.files: dict[str, dict[str, np.ndarray]] = {}
        self.start = np.zeros(3, np.int64)
        part = START >> (64 - model.bits) if model.bits else 0
        self.start = self._file(f"tokens-{part}").get("start", self.start)

    def _file(self, name: str) -> dict[str, np.ndarray]:
        if name not in self.files:
            try:
                self.files[name] = _mapped(self.model.folder, name)
            except FileNotFoundError:  # no token of the corpus fell into this range
                self.files[name] = {"hash": np.empty(0, np.uint64)}
        return self.files[name]

    def _places(self, kind: str, keys: np.ndarray) -> Iterator[tuple[slice, dict, np.ndarray, np.ndarray]]:
        """For sorted keys, range by range: which of them, the file, their places in it, and whether they are there."""
        bits = self.model.bits
        part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(first, np.append(first[1:], len(keys)), strict=True):
            file = self._file(f"{kind}-{part[a]}")
            hashes = file["hash"]
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, keys[a:b]), len(hashes) - 1)
                yield slice(a, b), file, at, hashes[at] == keys[a:b]

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for part, file, at, there in self._places("pairs", keys):
            count = file["count"][at].astype(np.int64)
            large = np.flatnonzero(there & (count == 255))
            count[large] = file["full"][np.searchsorted(file["at"], at[large])]
            out[part] = np.where(there, count, 0)
        return out

    def tokens(self, keys: np.ndarray) -> dict[str, np.ndarray]:
        out = {k: np.zeros(len(keys), np.int64) for k in ("count", "preceded", "n1", "n2", "n3")}
        for part, file, at, there in self._places("tokens", keys):
            for k, x in out.items():
                x[part] = np.where(there, file[k][at], 0)
        return out


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(0.0, counts - np.array([0.0, *d])[np.minimum(counts, 3)])


def score(look: Lookup, texts: list[bytes]) -> list[tuple[int, int, float, float]]:
    """(n_tokens, n_known, base_score, score) of each text; scores are log10 probabilities."""
    m = look.model
    held = list(_token_hashes(texts))
    ends = np.cumsum([len(x) for x in held])
    after = np.concatenate(held)
    del held
    types, at = np.unique(after, return_inverse=True)
    known = look.tokens(types)
    lower = (_discounted(known["preceded"], m.type_discounts) / max(1, m.pair_types)) + m.unseen / (m.types + 1)
    base = np.log10(known["count"] + 1) - np.log10(m.tokens + m.types + 1)
    d = m.pair_discounts
    left = (d[0] * known["n1"] + d[1] * known["n2"] + d[2] * known["n3"]) / np.maximum(1, known["count"])
    left = np.where(known["count"] > 0, left, 1.0)
    before = np.concatenate([[len(types)], at[:-1]])  # numbers of types; one past them is the start
    before[ends[:-1]] = len(types)
    times = np.append(known["count"], m.texts)
    left = np.append(left, np.dot(d, look.start) / m.texts if m.texts else 1.0)
    keys = np.append(types, np.uint64(START))
    pairs, back = np.unique(_pairs(keys[before], after), return_inverse=True)
    seen = look.pairs(pairs)
    p = _discounted(seen, d)[back] / np.maximum(1, times[before]) + left[before] * lower[at]
    logs = np.log10(p)
    starts = np.concatenate([[0], ends[:-1]])
    return list(zip(
        (ends - starts).tolist(), np.add.reduceat((known["count"] > 0)[at].astype(np.int64), starts).tolist(),
        np.add.reduceat(base[at], starts).tolist(), np.add.reduceat(logs, starts).tolist(), strict=True,
    ))


RESULT = "struct<n_tokens:bigint,n_known:bigint,base_score:double,score:double>"


def scored(text: Column | str, model: Model) -> Column:
    """RESULT for whole texts: the tokens, those that the training texts know, and both log10 probabilities.

    Tokens are runs of other characters than ASCII white space, A-Z lower-cased, and one end. Null is the empty text, of
    one token. ``base_score`` is that of add-one smoothed single tokens. The perplexity is 10 ** (-score / n_tokens).
    """
    held = SparkSession.active().sparkContext.broadcast(astuple(model))
    kind = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    @F.arrow_udf(RESULT)
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        look = Lookup(Model(*held.value))
        for column in batches:
            every, out, at = utf8(column), [], 0
            while at < len(every):
                stop, size = at, 0
                while stop < len(every) and (stop == at or size + len(every[stop]) < SCORE_BYTES):
                    size += len(every[stop])
                    stop += 1
                out += score(look, every[at:stop])
                at = stop
            yield pa.array([dict(zip(("n_tokens", "n_known", "base_score", "score"), x, strict=True)) for x in out], kind)

    return scores.asNondeterministic()(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored("text", model).alias("s"))
    return out.select("doc_id", "held_out", "s.n_tokens", "s.n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "s.base_score", "s.score")
