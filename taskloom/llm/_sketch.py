"""Count-min sketches of 64-bit keys, built per partition, merged by Spark, and sent back as "seen twice" bits.

A sketch has three rows of ``width`` cells. A task sends, for each chunk of cells,
the cells its keys fall into and whether it met them twice; chunks are merged
where they meet, by counting to two. A key is estimated as repeated if its cells
in all rows count two: repeated keys always are, since cells only overestimate.
The width follows the input up to ``MAX_BITS``; the merged bits, three rows of
``width / 8`` bytes, are thus bounded (96 MB) and are sent to all tasks. Beyond
the bound more keys are estimated as repeated and go to the exact pass: results
stay the same, but the filter helps less. The bits travel as compressed chunks,
which take less on disk and in the driver as long as the sketch is sparse.
"""

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_BITS, MAX_BITS = 20, 28
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
ROWS = len(_MIX)
#: Keys that a task gathers before it sends their cells.
HELD_KEYS = 1_000_000
_CHUNK = 20
TOUCHES = "chunk long, cells binary"


def width_bits(keys: float) -> int:
    """Eight cells a key in each row."""
    return min(MAX_BITS, max(MIN_BITS, int(np.ceil(np.log2(max(1.0, 8 * keys))))))


def cells(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each key in each row."""
    return [(keys.astype(np.uint64) * np.uint64(m)) >> np.uint64(64 - bits) for m in _MIX]


def _squeezed(ascending: np.ndarray) -> bytes:
    """Differences of ascending numbers, byte by byte, as most are small."""
    steps = np.diff(ascending, prepend=np.uint32(0)).astype("<u4")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unsqueezed(part: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(part), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def touches(keys: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """A task's own sketch: one row for each chunk of cells that it touched."""
    every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    for row, own in enumerate(cells(every, bits)):
        at, n = np.unique(own, return_counts=True)
        packed = ((at & np.uint64((1 << _CHUNK) - 1)) << np.uint64(1) | (n > 1).astype(np.uint64)).astype(np.uint32)
        chunk = (at >> np.uint64(_CHUNK)).astype(np.int64) + (row << (bits - _CHUNK))
        ends = np.flatnonzero(np.diff(chunk, append=-1)) + 1 if len(chunk) else []
        low, ids, parts = 0, [], []
        for high in ends:
            ids.append(int(chunk[low]))
            parts.append(_squeezed(packed[low:high]))
            low = high
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.binary())], ["chunk", "cells"])


def merged(found: DataFrame, bits: int) -> Broadcast:
    """Merge the tasks' sketches into the bits of cells that count two or more."""
    chunks = ROWS << (bits - _CHUNK)

    def merge(batches):
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, own in zip(b.column(0).to_pylist(), b.column(1)):
                cell = _unsqueezed(own.as_py())
                have = counts.setdefault(chunk, np.zeros(1 << _CHUNK, np.uint8))
                have[cell >> 1] = np.minimum(2, have[cell >> 1] + 1 + (cell & 1))  # cells are distinct in a row
        for chunk, have in counts.items():
            packed = zlib.compress(np.packbits(have > 1, bitorder="little").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([packed])], ["chunk", "bits"])

    n = min(chunks, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = found.repartition(n, "chunk").mapInArrow(merge, "chunk long, bits binary").collect()  # 96 MB at most, before compression
    return found.sparkSession.sparkContext.broadcast({r["chunk"]: bytes(r["bits"]) for r in rows})


def lookup(sent: Broadcast, bits: int) -> Callable[[np.ndarray], np.ndarray]:
    """Keys -> whether they are estimated as repeated."""
    cells_of_chunk = np.zeros((ROWS << (bits - _CHUNK), (1 << _CHUNK) // 8), np.uint8)
    for chunk, packed in sent.value.items():
        cells_of_chunk[chunk] = np.frombuffer(zlib.decompress(packed), np.uint8)
    both = cells_of_chunk.reshape(ROWS, -1)

    def repeated(keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for row, own in enumerate(cells(keys, bits)):
            out &= (both[row][own >> np.uint64(3)] >> (own & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out

    return repeated


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
