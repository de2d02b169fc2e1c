"""Helpers for functions that run on Arrow batches: whole texts as bytes, word hashes, window hashes.

``bytes.split()`` without arguments splits at 0x20 and 0x09-0x0D only, which is
the word rule of these operators; ``bytes.lower()`` touches A-Z only.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import types as T

SLICE_BYTES, SLICE_ROWS = 4 << 20, 4096


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand over at most 8 MB of rows at a time, so that long texts don't fill the workers' memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def slices(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches so that a slice holds some 4 MB of text (one longer text makes a slice of its own)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        column = column.cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else []
        low = 0
        while low < len(column):
            high = int(np.searchsorted(ends, ends[low] + SLICE_BYTES, side="right")) - 1
            high = max(low + 1, min(high, low + SLICE_ROWS, len(column)))
            yield batch.slice(low, high - low), [t or b"" for t in column.slice(low, high - low).to_pylist()]
            low = high


def hash64(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)


def hash128(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each word, as the columns of an array."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


def weights(k: int, seed: int) -> np.ndarray:
    """Fixed odd multipliers, one for each place of a window."""
    return np.random.default_rng(seed).integers(0, 2**64, k, np.uint64, endpoint=False) | np.uint64(1)


def window_hash(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of every run of k words, from the words' hashes."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(weights(k, seed)):
        out += c * h[j : j + n]
    return out


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask of the n places that a run of k places from one of the starts covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + k, n), -1)
    return np.cumsum(edge[:-1]) > 0


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def free_name(taken: Iterable[str], wish: str) -> str:
    """A column name that none of the given ones equals, whatever the case."""
    low = {t.lower() for t in taken}
    while wish.lower() in low:
        wish += "_"
    return wish
