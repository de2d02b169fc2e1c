"""Substring dedup (5): words covered by a window of words that occurs earlier are removed.

1. Count-min prefilter. A window is counted by its minimiser, the run of
   ``gram`` words in it with the least hash: equal windows have equal minimisers
   at different places, so the count of a window is never more than that of its
   minimiser, and only one place in five is counted. Tasks' sketches are merged.
2. A second pass looks every window up. Documents without a window estimated as
   repeated are done. In the others the estimated windows are hashed whole (96
   bits from the hashes of their words) and grouped exactly: first inside a block
   of some 4 MB of text, where all but the first occurrence are removed already,
   then one occurrence a block is sent on, so a window that is everywhere makes
   no large group. Their number follows the bytes of text, as does that of the tasks.
3. What the groups remove goes back to the blocks' texts.

"Earlier" is by document id, then by row, then by place. Defined cases: a null
text has no words; fewer words than a window: nothing is removed; null ids come
before all others; rows with equal ids are documents of their own, in the order
they are read; an empty table gives an empty result; texts are read whole; extra
columns are not read. Ids are bigint.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm import _sketch
from taskloom.llm._text import covered, hash128, slices, small_batches, weights, window_hash
from taskloom.session import scratch_path, shuffle_width

GRAM = 12
#: Bytes of text for each group of windows that one task settles at a time: a group stays as large when the input grows.
GROUP_BYTES = 32 << 20
_NULL_ID = np.iinfo(np.int64).min


class Block:
    """Word hashes of a slice of documents, and the windows inside single documents."""

    def __init__(self, texts: list[bytes], width: int, gram: int):
        self.words = [t.split() for t in texts]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(self.counts)
        self.h = hash128([w for doc in self.words for w in doc]) if self.counts.sum() else np.zeros((0, 2), np.uint64)
        n = len(self.h)
        self.starts = np.zeros(0, np.int64)
        if n < width:
            return
        row = np.repeat(np.arange(len(texts)), self.counts)
        at = np.arange(n - width + 1)
        # A window is inside a document if its first and last word are.
        self.starts = at[row[: n - width + 1] == row[width - 1 :]]
        self.row = row[self.starts]
        grams = window_hash(self.h[:, 0], gram, 51)
        span = width - gram + 1
        best = self.starts.copy()
        least = grams[best]
        for j in range(1, span):
            here = grams[self.starts + j]
            less = here < least
            least = np.where(less, here, least)
            best[less] = self.starts[less] + j
        self.minimiser, self.minimiser_at = least, best

    def counted(self) -> np.ndarray:
        """Minimisers, each place once."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        _, first = np.unique(self.minimiser_at, return_index=True)
        return self.minimiser[first]


def groups_for(size: int, width: int) -> int:
    """Groups of windows for ``size`` bytes of text on ``width`` shuffle partitions."""
    return max(4 * width, -(-size // GROUP_BYTES))


def _packed(rows: np.ndarray, starts: np.ndarray) -> bytes:
    return np.stack([rows, starts], axis=1).astype(np.int32).tobytes()


def _unpacked(parts) -> np.ndarray:
    return np.frombuffer(b"".join(p for p in parts if p), np.int32).reshape(-1, 2)


_HASH = np.dtype([("h1", "<u8"), ("h2", "<u4")])


def _pack_windows(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> bytes:
    """Hashes as they are; ids, rows and starts (in the order of the text) as compressed differences."""
    hashes = np.zeros(len(h1), _HASH)
    hashes["h1"], hashes["h2"] = h1, h2
    steps = [np.diff(x.astype(k), prepend=x.dtype.type(0)).astype(k).tobytes() for x, k in ((ids, np.int64), (rows, np.int32), (starts, np.int32))]
    return hashes.tobytes() + zlib.compress(b"".join(steps), 1)


def _unpack_windows(part: bytes, n: int) -> tuple[np.ndarray, ...]:
    hashes = np.frombuffer(part, _HASH, n)
    steps = zlib.decompress(part[n * _HASH.itemsize :])
    ids = np.cumsum(np.frombuffer(steps, np.int64, n), dtype=np.int64)
    rows = np.cumsum(np.frombuffer(steps, np.int32, n, 8 * n), dtype=np.int32)
    return hashes["h1"], hashes["h2"], ids, rows, np.cumsum(np.frombuffer(steps, np.int32, n, 12 * n), dtype=np.int32)


def _result(words: list[bytes], starts: np.ndarray, width: int) -> tuple[int, int, bytes]:
    if not len(starts):
        return len(words), 0, b" ".join(words)
    gone = covered(starts, width, len(words))
    kept = [w for w, g in zip(words, gone.tolist()) if not g]
    return len(words), len(words) - len(kept), b" ".join(kept)


def remove_repeats(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM) -> DataFrame:
    """One row a document: id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and
    ``kept``, those words, null where nothing was removed (the text stays as it is).
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    # About one word in seven bytes, two minimisers in (windows' grams + 1) words.
    size = _sketch.text_bytes(docs, text_col)
    bits = _sketch.width_bits(size / 7 * 2 / (width - gram + 2))

    def count(batches):
        keys, held = [], 0
        for _, texts in slices(batches, "body"):
            keys.append(Block(texts, width, gram).counted())
            held += len(keys[-1])
            if held > _sketch.HELD_KEYS:
                yield from _sketch.touches(keys, bits)
                keys, held = [], 0
        yield from _sketch.touches(keys, bits)

    sent = _sketch.merged(rows.mapInArrow(count, _sketch.TOUCHES), bits)
    chunks = groups_for(size, shuffle_width(spark))
    c1, c2 = weights(width, 52), weights(width, 53)
    out = "kind int, block long, id long, row int, chunk long, n_words long, n_removed long, sha string, body binary, part binary"
    names = [f.split()[0] for f in out.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]

    def table(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    def second(batches):
        repeated = _sketch.lookup(sent, bits)
        number = TaskContext.get().partitionId() << 32
        for part, texts in slices(batches, "body"):
            block, number = Block(texts, width, gram), number + 1
            ids = part.column(0).to_pylist()
            hit = repeated(block.minimiser) if len(block.starts) else np.zeros(0, bool)
            starts, in_row = block.starts[hit], block.row[hit] if len(block.starts) else np.zeros(0, np.int64)
            waits, found = set(in_row.tolist()), []
            for i, words in enumerate(block.words):
                if i not in waits:
                    n, gone, kept = _result(words, np.zeros(0, np.int64), width)
                    found.append((0, number, ids[i], i, None, n, gone, hashlib.sha256(kept).hexdigest(), None, None))
            if len(starts):
                h1, h2 = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
                for j in range(width):
                    h1 += c1[j] * block.h[starts + j, 0]
                    h2 += c2[j] * block.h[starts + j, 1]
                h2 >>= np.uint64(32)
                local = starts - (block.ends - block.counts)[in_row]
                order_id = np.array([_NULL_ID if v is None else v for v in ids], np.int64)[in_row]
                order = np.lexsort((local, in_row, order_id, h2, h1))
                h1, h2, local, in_row, order_id = (x[order] for x in (h1, h2, local, in_row, order_id))
                first = np.ones(len(h1), bool)
                first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                later: dict[int, list] = {}
                again = np.flatnonzero(~first)
                again = again[np.argsort(in_row[again], kind="stable")]
                for r, own in zip(*_runs(in_row[again], local[again])):
                    later[r] = own
                for i in sorted(waits):
                    gone = later.get(i, np.zeros(0, np.int64))
                    found.append((1, number, ids[i], i, None, None, None, None, zlib.compress(b" ".join(block.words[i]), 1), _packed(np.full(len(gone), i), gone)))
                # One occurrence a block of each window, dealt by its hash.
                h1, h2, local, in_row, order_id = (x[first] for x in (h1, h2, local, in_row, order_id))
                chunk = (h1 % np.uint64(chunks)).astype(np.int64)
                by = np.lexsort((local, in_row, chunk))
                for c, at in zip(*_runs(chunk[by], by)):
                    found.append((2, number, None, None, c, len(at), None, None, None, _pack_windows(h1[at], h2[at], order_id[at], in_row[at], local[at])))
            for low in range(0, len(found), 1000):
                yield table(found[low : low + 1000])

    path = scratch_path(spark, "substring")
    rows.mapInArrow(second, out).write.partitionBy("kind").parquet(path)
    schema = rows.mapInArrow(second, out).schema
    all_kinds = spark.read.schema(schema).parquet(path)

    def group(table_: pa.Table) -> pa.Table:
        """All occurrences of a chunk's windows but the first, by block."""
        n = table_.column("n_words").to_numpy()
        parts = [_unpack_windows(p.as_py(), k) for p, k in zip(table_.column("part"), n.tolist())]
        h1, h2, id_, row, at = (np.concatenate(x) for x in zip(*parts))
        block = np.repeat(table_.column("block").to_numpy(), n)
        order = np.lexsort((at, row, block, id_, h2, h1))
        h1, h2 = h1[order], h2[order]
        again = np.zeros(len(order), bool)
        again[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        block, row, at = (x[order[again]] for x in (block, row, at))
        by = np.argsort(block, kind="stable")
        ids, parts = [], []
        for b, which in zip(*_runs(block[by], by)):
            ids.append(b)
            parts.append(_packed(row[which], at[which]))
        return pa.table({"block": pa.array(ids, pa.int64()), "part": pa.array(parts, pa.binary())})

    # A task takes some four groups, however many there are.
    tasks = chunks // 4
    removals = all_kinds.where("kind = 2").select("chunk", "block", "n_words", "part").repartition(tasks, "chunk").groupBy("chunk").applyInArrow(group, "block long, part binary")

    def finish(texts: pa.Table, gone: pa.Table) -> pa.Table:
        outside = _unpacked(gone.column("part").to_pylist())
        found = {c: [] for c in ("id", "n_words", "n_removed", "kept_sha256", "kept")}
        by_row = dict(zip(*_runs(*_sorted(outside[:, 0], outside[:, 1]))))
        for id_, row, body, part in zip(*(texts.column(c).to_pylist() for c in ("id", "row", "body", "part"))):
            starts = np.concatenate([_unpacked([part])[:, 1], by_row.get(row, np.zeros(0, np.int32))]).astype(np.int64)
            n, removed, kept = _result(zlib.decompress(body).split(), starts, width)
            for c, v in zip(found, (id_, n, removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if removed else None)):
                found[c].append(v)
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(found.items(), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))})

    waiting = all_kinds.where("kind = 1").select("block", "id", "row", "body", "part")
    finished = waiting.groupBy("block").cogroup(removals.groupBy("block")).applyInArrow(
        finish, "id long, n_words long, n_removed long, kept_sha256 string, kept string")
    done = all_kinds.where("kind = 0").select("id", "n_words", "n_removed", F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
    return done.unionByName(finished).withColumnRenamed("id", id_col)


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Values by key; equal keys must stand together."""
    if not len(keys):
        return [], []
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return keys[np.concatenate([[0], cuts])].tolist(), np.split(values, cuts)
