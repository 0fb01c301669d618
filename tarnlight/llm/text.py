"""What several operators need of texts: whole texts as UTF-8 bytes, words, hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Characters between words, as a character class: space and \t \n \v \f \r. ``bytes.split()`` splits on the same six.
SPACE = r"\x20\x09-\x0D"
#: Bytes of text that a worker holds at once beside the batch that it was sent.
PIECE = 4_000_000


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts as bytes; null is the empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [t or b"" for t in texts.cast(kind).to_pylist()]


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[list[bytes]]:
    """``utf8`` of all texts in order, in lists of less than ``size`` bytes together; a text of more is one of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size)))
        yield utf8(texts.slice(at, stop - at))
        at = stop


def lower_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased and nothing else changed."""
    return text.lower().split()


def hash64(parts: list[bytes], seed: int = 42) -> np.ndarray:
    """XXH64 of each part, unsigned."""
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of SplitMix64, Steele et al. 2014)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def columns(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[pa.Array, ...]]:
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(batch.schema.get_field_index(n)) for n in names)


def release() -> None:
    """Give freed memory back to the system. Python workers outlive a task, and what one stage needed would count in the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent where the C library isn't GNU's
    if trim is not None:
        trim(0)


def freed(results: Iterator) -> Iterator:
    """``results``; after the last, when no local of the generator that made them is alive any more, ``release``."""
    yield from results
    release()
