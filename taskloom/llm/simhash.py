"""SimHash near-dedup (4) by the generalised pigeonhole principle.

Fingerprints that differ in at most ``radius`` bits are linked. The 64 bits are
dealt into parts, correlated bits together. A fingerprint searches part i within
its own threshold t_i, where the t_i + 1 sum to radius + 1: whatever it should
find differs by at most t_i bits in some part i. The thresholds are allocated by
dynamic programming so that the number of candidates, estimated from the value
counts of the parts, is least; a part that holds too common a value gets no probe
at all. Probes and stored parts meet in an equi-join and are verified there.

Texts with equal fingerprints are one class from the start. In a bucket, every
fingerprint near the bucket's leader (the one with most documents) is linked to
the leader; pairs of two such fingerprints are connected by that and are not
emitted, so a dense group of copies gives no square number of links.

Defined cases: a null or empty text has fingerprint zero and is linked like any
other; fewer words than a shingle form one shingle; repeated rows get a row each;
null ids are members of their class but never its name (a class of null ids only
is named null); an empty table gives an empty result; texts are read whole.
"""

from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskloom.llm._graph import components
from taskloom.llm._text import slices, small_batches
from taskloom.session import written

#: Cost of verifying a candidate, in probe rows.
CANDIDATE_COST = 0.05
_WIDE = 16  # bits of a part that the value counts tell apart


def fingerprint(raw: bytes, width: int = 4, seed: int = 42) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = np.frombuffer(b"".join(map(partial(xxhash.xxh64_digest, seed=seed), shingles)), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for low in range(0, len(h), 4096):
        ones += np.unpackbits(h[low : low + 4096], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): fp is the 64-bit fingerprint as a signed bigint."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        for part, texts in slices(batches, "body"):
            fps = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], ["id", "fp"])

    return rows.mapInArrow(run, out)


def bit_groups(distinct: DataFrame, parts: int) -> list[list[int]]:
    """Deal the 64 bits into parts; each takes the bits most correlated with those it has."""

    def run(batches):
        total = np.zeros((65, 65))
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for low in range(0, len(fps), 8192):
                bits = (fps[low : low + 8192, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.float64)
                bits = np.concatenate([bits, np.ones((len(bits), 1))], axis=1)
                total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(65 * 65)), pa.array(total.ravel().astype(np.int64))], ["cell", "n"])

    sums = distinct.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    both = np.zeros(65 * 65)
    for r in sums.collect():  # 65 x 65 cells
        both[r["cell"]] = r["n"]
    both = both.reshape(65, 65)
    n = max(both[64, 64], 1)
    p = both[64, :64] / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs((both[:64, :64] / n - np.outer(p, p)) / np.outer(spread, spread))
    left, groups = set(range(64)), []
    for i in range(parts):
        size = (64 + i) // parts
        rest = sorted(left)
        group = [max(rest, key=lambda b: related[b, rest].sum())]
        left.discard(group[0])
        while len(group) < size:
            group.append(max(sorted(left), key=lambda b: related[b, group].sum()))
            left.discard(group[-1])
        groups.append(sorted(group))
    return groups


def part_values(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a group, gathered into a number."""
    out = np.zeros(len(fps), np.uint64)
    for k, bit in enumerate(group):
        out |= (fps >> np.uint64(bit) & np.uint64(1)) << np.uint64(k)
    return out


def ball_counts(distinct: DataFrame, groups: list[list[int]], radius: int) -> list[np.ndarray]:
    """For each part, threshold and value: how many stored fingerprints lie within the threshold (an estimate for wide parts)."""

    def run(batches):
        counts = [np.zeros(1 << min(len(g), _WIDE), np.int64) for g in groups]
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for c, g in zip(counts, groups):
                c += np.bincount(part_values(fps, g[:_WIDE]).astype(np.int64), minlength=len(c))
        for i, c in enumerate(counts):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(at), pa.array(c[at])], ["part", "value", "n"])

    # At most parts x 2**16 rows, whatever the input.
    found = distinct.select("fp").mapInArrow(run, "part long, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toArrow()
    part, value, n = (found.column(c).to_numpy() for c in ("part", "value", "n"))
    out = []
    for i, g in enumerate(groups):
        width, more = min(len(g), _WIDE), max(0, len(g) - _WIDE)
        layers = np.zeros((radius + 1, 1 << width), np.float32)
        layers[0, value[part == i]] = n[part == i]
        for bit in range(width):
            layers[1:] += layers[:-1].reshape(radius, -1, 2, 1 << bit)[:, :, ::-1, :].reshape(radius, -1)
        # In the bits that are not counted, values are taken as even.
        share = [sum(comb(more, d) for d in range(t + 1)) / 2**more for t in range(radius + 1)]
        out.append(np.stack([sum(layers[d] * share[t - d] for d in range(t + 1)) for t in range(radius + 1)]))
    return out


def allocate(fps: np.ndarray, groups: list[list[int]], balls: list[np.ndarray], radius: int) -> np.ndarray:
    """Units (threshold + 1) per fingerprint and part, summing to radius + 1 at least cost."""
    units, n = radius + 1, len(fps)
    best = np.full((units + 1, n), np.inf)
    best[0] = 0
    picks = []
    for g, ball in zip(groups, balls):
        value = part_values(fps, g[:_WIDE]).astype(np.int64)
        probes = np.cumsum([comb(len(g), d) for d in range(units)])
        cost = [np.zeros(n)] + [probes[u - 1] + CANDIDATE_COST * ball[u - 1][value] for u in range(1, units + 1)]
        ways = np.full((units + 1, units + 1, n), np.inf)
        for have in range(units + 1):
            for use in range(units + 1 - have):
                ways[have + use, use] = best[have] + cost[use]
        picks.append(ways.argmin(axis=1))
        best = ways.min(axis=1)
    out, at, each = np.zeros((n, len(groups)), np.int64), np.full(n, units), np.arange(n)
    for i in range(len(groups) - 1, -1, -1):
        out[:, i] = picks[i][at, each]
        at = at - out[:, i]
    return out


def _masks(bits: int, threshold: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for d in range(threshold + 1) for c in combinations(range(bits), d)], np.uint64)


def probe_counts(units: np.ndarray, groups: list[list[int]], radius: int) -> np.ndarray:
    """Number of probes of each fingerprint."""
    out = np.zeros(len(units), np.int64)
    for i, g in enumerate(groups):
        out += np.cumsum([0, *(comb(len(g), d) for d in range(radius + 1))])[units[:, i]]
    return out


def part_count(n: int, radius: int) -> int:
    """Number of parts with least expected cost for n even fingerprints."""

    def cost(parts: int) -> float:
        units, per = radius + 1, 64 // parts
        shares = [units // parts + (i < units % parts) for i in range(parts)]
        probes = sum(sum(comb(per, d) for d in range(u)) for u in shares)
        return probes * (1 + CANDIDATE_COST * n / 2.0**per)

    return min(range(2, radius + 2), key=cost)


def links(distinct: DataFrame, radius: int = 4, parts: int | None = None) -> DataFrame:
    """(a, b): verified links that connect all fingerprints within ``radius`` of each other.

    ``distinct`` has each fingerprint once: (fp, n), n its number of documents. It should be a written table.
    """
    parts = parts or part_count(distinct.count(), radius)
    groups = bit_groups(distinct, parts)
    balls = ball_counts(distinct, groups, radius)

    def key_of(values: np.ndarray, part: int) -> np.ndarray:
        return (values | np.uint64(part) << np.uint64(40)).view(np.int64)

    def stored(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, g in enumerate(groups):
                keys = key_of(part_values(fps.view(np.uint64), g), i)
                yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(0), b.column(1)], ["key", "fp", "n"])

    def probes(batches):
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for low in range(0, len(every), 2048):
                fps = every[low : low + 2048]
                units = allocate(fps.view(np.uint64), groups, balls, radius)
                for i, g in enumerate(groups):
                    values = part_values(fps.view(np.uint64), g)
                    for u in range(1, radius + 2):
                        at, masks = np.flatnonzero(units[:, i] == u), _masks(len(g), u - 1)
                        step = max(1, (1 << 18) // len(masks))
                        for first in range(0, len(at), step):
                            some = at[first : first + step]
                            keys = key_of((values[some, None] ^ masks[None, :]).ravel(), i)
                            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(fps[some], len(masks)))], ["key", "q"])

    rows = written(distinct.select("fp", "n").mapInArrow(stored, "key long, fp long, n long"), "simhash-parts")
    leads = rows.groupBy("key").agg(F.max(F.struct("n", "fp"))["fp"].alias("lead"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    index = rows.drop("n").join(leads, "key", "left").withColumn("by", near(F.col("fp"), F.col("lead")))
    index = written(index, "simhash-index")
    stars = index.where("by and fp <> lead").select(F.col("fp").alias("a"), F.col("lead").alias("b"))
    q, fp, lead = F.col("q"), F.col("fp"), F.col("lead")
    wanted = (fp.eqNullSafe(lead) & (q != fp)) | ((q < fp) & ~F.coalesce(F.col("by") & near(q, lead), F.lit(False)))
    found = distinct.select("fp").mapInArrow(probes, "key long, q long").alias("p")
    pairs = found.join(index.alias("x"), (F.col("p.key") == F.col("x.key")) & near(q, fp) & wanted)
    return stars.unionByName(pairs.select(q.alias("a"), fp.alias("b"))).distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): one row a document; component_id is the least id that links reach."""
    prints = written(fingerprints(docs, id_col, text_col, width), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")), "simhash-distinct")
    roots = components(written(links(distinct, radius), "simhash-links"), "a", "b")
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = written(member.select("fp", "root", "first"), "simhash-member")
    names = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(member.join(names, "root").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with one of each group: the one with the least id.

    Of rows with equal ids one stays, as they name one document. Rows without an id all stay.
    """
    found = near_duplicates(docs, radius, width, id_col, text_col)
    kept = found.select(F.col("component_id").alias("kept_id")).where("kept_id is not null").distinct()
    named = docs.join(kept, docs[id_col] == kept["kept_id"], "left_semi").dropDuplicates([id_col])
    return named.unionByName(docs.where(F.col(id_col).isNull()))
