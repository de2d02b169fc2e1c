"""Near-dedup of whole texts through SimHash (4), for the pipeline: five-word shingles, Jaccard of 0.8 or more.

One 64-bit fingerprint does not tell Jaccard 0.8 from less: such texts differ in some
ten of its bits, give or take three. So a text has ``WORDS`` independent fingerprints of
its distinct shingles, and two texts are candidates where any of them differ in at most
``RADIUS`` bits. Each fingerprint is searched by the generalised pigeonhole principle of
``simhash``: parts of correlated bits, thresholds allocated per fingerprint, probes.
Candidates are verified by exact Jaccard on whole shingle sets, so nothing is linked
wrongly; at 0.8 a pair escapes all four searches in some 8 % of cases, at 0.85 in 1 %.

Texts with equal sets are one class from the start. Before the probes each class is
compared with one or two leaders of the buckets it is in, and what that links makes
first groups. Probes then only pass pairs of two groups; in a crowded bucket the rows of
its leader's group stand apart, and probes of the same group never meet them. A
thousand copies thus cost some thousand comparisons, not a million.

The number of probes of a class rises with the number of classes, so they are not made
all at once: a search takes one fingerprint and a slice of the classes, and its shuffle
is gone before the next.

Defined cases: words as in SimHash; fewer words than a shingle form one shingle; null
and empty texts share the one shingle zero; shingles and sets are named by 64-bit
hashes; of a group the row with the least id stays, null ids last, and of rows with
equal ids the text with the least hash; of rows equal in id and text one stays; an empty
table stays empty; other columns are carried along; texts are read whole.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskloom.llm._graph import components
from taskloom.llm._text import free_name, hash64, slices, small_batches, window_hash
from taskloom.llm.simhash import _masks, allocate, ball_counts, bit_groups, part_count, part_values, probe_counts
from taskloom.session import shuffle_width, written

WORDS, RADIUS = 4, 9
#: Buckets of more rows set their leader's group apart. That only saves comparisons of one group with itself.
CROWDED = 64
#: Of a larger index the buckets have to be larger, so that the list of them (16 bytes each) stays within this length.
LISTED = 1 << 17
#: Probes of one search, for each class, some 20 bytes each in a shuffle; smaller searches than the latter are made at once.
ROUND_PROBES, SMALL_ROUND = 80, 1 << 22


def shingles(raw: bytes, width: int = 5) -> np.ndarray:
    """The distinct shingles of a text, ascending."""
    words = raw.lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    return np.unique(window_hash(hash64(words), min(width, len(words)), 5))


def _name(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def fingerprints(own: np.ndarray, words: int = WORDS) -> list[int]:
    """Independent SimHash fingerprints of a set of shingles, as signed numbers."""
    out = []
    for w in range(words):
        h = own + np.uint64((0x9E3779B97F4A7C15 * (w + 1)) % 2**64)  # a mixed counter for each fingerprint
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        ones = np.zeros(64, np.int64)
        for low in range(0, len(h), 8192):
            ones += np.unpackbits(h[low : low + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        out.append(int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True))
    return out


def _near(x: Column, y: Column, radius: int) -> Column:
    return F.bit_count(x.bitwiseXOR(y)) <= radius


def _same(x: str, y: str) -> Column:
    return F.col(f"{x}.id").eqNullSafe(F.col(f"{y}.id")) & (F.col(f"{x}.h") == F.col(f"{y}.h"))


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets agree in 0.8 of their union. Sets of ``b`` travel to ``a``, which may be in many pairs."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(classes, "sig").select("first.id", "first.h", "sig")
    asked = written(asked, "similar-asked", free=True)

    def run(batches):
        for part, texts in slices(batches, "body"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t, width).tobytes() for t in texts], pa.binary())], ["sig", "own"])

    picked = rows.alias("r").join(asked.alias("k"), _same("r", "k")).select("k.sig", "r.body")
    sets = picked.mapInArrow(run, "sig long, own binary").groupBy("sig").agg(F.first("own").alias("own"))

    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                n, m = len(x) // 8, len(y) // 8
                both = 0
                if 5 * min(n, m) >= 4 * max(n, m):
                    both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep.append(5 * both >= 4 * (n + m - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("sig").alias(k), F.col("own").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    met = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
    return written(met.mapInArrow(compare, "a long, b long"), "similar-pairs", free=True)


def _keys(values: np.ndarray, word: int, part: int) -> np.ndarray:
    return (values | np.uint64(word) << np.uint64(56) | np.uint64(part) << np.uint64(48)).view(np.int64)


def _split(keys: np.ndarray, roots: np.ndarray, listed: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the rows whose bucket is listed: rows of the group that stands apart there, and rows of other groups."""
    held, owns = listed
    if not len(held):
        return np.zeros((2, len(keys)), bool)
    at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    hit, same = held[at] == keys, owns[at] == roots
    return hit & same, hit & ~same


def rounds(counts: list[int], most: int) -> list[tuple[list[int], int, int]]:
    """(fingerprints, slice, number of slices): searches of some ``most`` probes that make up all."""
    if sum(counts) <= most:
        return [(list(range(len(counts))), 0, 1)]
    slots = [(w, max(1, -(-n // most))) for w, n in enumerate(counts)]
    return [([w], part, of) for w, of in slots for part in range(of)]


def links(classes: DataFrame, rows: DataFrame, radius: int = RADIUS, words: int = WORDS, width: int = 5) -> DataFrame:
    """(a, b): verified pairs that connect the classes (sig, n, first, f0, f1, …) as all found pairs do. ``classes`` is a written table."""
    prints = [f"f{w}" for w in range(words)]
    n = classes.count()
    parts = part_count(n, radius)
    plans = []
    for f in prints:
        one = classes.select(F.col(f).alias("fp"))
        groups = bit_groups(one, parts)
        plans.append((groups, ball_counts(one, groups, radius)))
    deals = [groups for groups, _ in plans]

    def stored(ws, listed=((), ())):  # batches: sig, another column, fingerprints
        def run(batches):
            for b in batches:
                other = b.column(1).to_numpy(zero_copy_only=False)
                for c, w in enumerate(ws):
                    fps = b.column(2 + c).to_numpy(zero_copy_only=False).astype(np.int64)
                    for i, g in enumerate(deals[w]):
                        keys = _keys(part_values(fps.view(np.uint64), g), w, i)
                        keys = np.where(_split(keys, other, listed)[0], ~keys, keys)
                        yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(0), b.column(1), pa.array(fps)], ["key", "sig", "other", "fp"])

        return run

    def allocated(batches):  # batches: sig, root, fingerprints
        for b in batches:
            for low in range(0, b.num_rows, 2048):
                part = b.slice(low, 2048)
                units, counts = [], []
                for w, (groups, balls) in enumerate(plans):
                    fps = part.column(2 + w).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                    found = allocate(fps, groups, balls, radius)
                    units.append(pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * parts, pa.array(found.ravel().astype(np.int8))))
                    counts.append(pa.array(probe_counts(found, groups, radius)))
                yield pa.RecordBatch.from_arrays([*part.columns, *units, *counts], ["sig", "root", *prints, *shares, *amounts])

    def probes(ws, listed):  # batches: sig, root, fingerprints, units
        def run(batches):
            for b in batches:
                sig, root = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                for c, w in enumerate(ws):
                    fps = b.column(2 + c).to_numpy(zero_copy_only=False).astype(np.int64)
                    units = b.column(2 + len(ws) + c).flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
                    for i, g in enumerate(deals[w]):
                        values = part_values(fps.view(np.uint64), g)
                        for u in range(1, radius + 2):
                            at, masks = np.flatnonzero(units[:, i] == u), _masks(len(g), u - 1)
                            step = max(1, (1 << 17) // len(masks))
                            for first in range(0, len(at), step):
                                some = at[first : first + step]
                                keys = _keys((values[some, None] ^ masks[None, :]).ravel(), w, i)
                                columns = [keys, *(np.repeat(x[some], len(masks)) for x in (sig, root, fps))]
                                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "q", "rq", "fq"])
                                also = _split(keys, columns[2], listed)[1]
                                if also.any():
                                    columns = [~keys[also], *(x[also] for x in columns[1:])]
                                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "q", "rq", "fq"])

        return run

    # Leaders: the class of most documents, and one by hash, of each bucket.
    index = classes.select("sig", "n", *prints).mapInArrow(stored(range(words)), "key long, sig long, other long, fp long")
    index = written(index, "similar-index")
    lead = lambda rank: F.max(F.struct(rank.alias("rank"), "sig", "fp"))
    leads = index.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.array(lead(F.col("other")), lead(F.xxhash64("sig"))).alias("leads"))
    leads = written(leads.where("k > 1"), "similar-leads", free=True)
    met = index.join(leads.drop("k"), "key").select("sig", "fp", F.posexplode("leads").alias("way", "lead"))
    met = met.where((F.col("sig") != F.col("lead.sig")) & _near(F.col("fp"), F.col("lead.fp"), radius))
    stars = met.groupBy("sig", "way").agg(F.max(F.struct("lead.rank", "lead.sig"))["sig"].alias("a"))
    stars = stars.select("a", F.col("sig").alias("b")).distinct()
    stars = _verified(written(stars, "similar-stars", free=True), classes, rows, width)

    # First groups, and the searches of each class.
    roots = written(components(stars, "a", "b"), "similar-roots", free=True)
    shares, amounts = [f"u{w}" for w in range(words)], [f"p{w}" for w in range(words)]
    named = classes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("sig", F.coalesce("root", "sig").alias("root"), *prints)
    named = named.repartition(shuffle_width(classes.sparkSession), "sig")
    kinds = [*(f"{c} long" for c in ("sig", "root", *prints)), *(f"{c} array<byte>" for c in shares), *(f"{c} long" for c in amounts)]
    named = named.mapInArrow(allocated, ", ".join(kinds))
    named = written(named, "similar-named", free=True)
    counts = [c or 0 for c in named.agg(*(F.sum(c) for c in amounts)).first()]

    # Leaders that have a group set it apart in their bucket, in LISTED buckets at most.
    least = max(CROWDED, -(-n * words * parts // LISTED))
    crowded = leads.where(F.col("k") > least).select("key", F.col("leads")[0]["sig"].alias("node")).join(roots, "node")
    crowded = crowded.select("key", F.col("root").alias("own")).toArrow().sort_by("key")
    held, owns = (crowded.column(c).to_numpy() for c in ("key", "own"))

    # Pairs of two groups. A search shuffles its own probes only, and they are gone before the next.
    found = []
    for ws, part, of in rounds(counts, max(ROUND_PROBES * n, SMALL_ROUND)):
        mine = np.isin(held >> 56, ws)
        listed = held[mine], owns[mine]
        some_prints, some_shares = ([names[w] for w in ws] for names in (prints, shares))
        index = named.select("sig", "root", *some_prints).mapInArrow(stored(ws, listed), "key long, sig long, root long, fp long")
        asking = named.where(F.pmod(F.xxhash64("sig"), F.lit(of)) == part).select("sig", "root", *some_prints, *some_shares)
        asked = asking.mapInArrow(probes(ws, listed), "key long, q long, rq long, fq long")
        pairs = asked.join(index, "key").where((F.col("rq") != F.col("root")) & (F.col("q") < F.col("sig")) & _near(F.col("fq"), F.col("fp"), radius))
        found.append(written(pairs.select(F.col("q").alias("a"), F.col("sig").alias("b")).distinct(), "similar-found", free=True))
    pairs = written(reduce(DataFrame.unionByName, found).distinct(), "similar-candidates", free=True)
    return stars.unionByName(_verified(pairs, classes, rows, width))


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with one row of each group of similar texts."""
    small_batches(docs.sparkSession)
    body = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("h"), body.alias("body"))
    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("h", "sig", *(f"f{w}" for w in range(words))))])

    def run(batches):
        for part, texts in slices(batches, "body"):
            own = [shingles(t, width) for t in texts]
            numbers = zip(*((_name(s), *fingerprints(s, words)) for s in own))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in numbers)], out.names)

    prints = written(rows.mapInArrow(run, out), "similar-prints")
    first = F.min(F.struct(F.col("id").isNull().alias("late"), "id", "h")).alias("first")
    classes = prints.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), first, *(F.min(f"f{w}").alias(f"f{w}") for w in range(words)))
    # Small numbers in place of hashes: they travel in every probe, and shuffles compress them.
    classes = written(classes.withColumn("sig", F.monotonically_increasing_id()), "similar-classes", free=True)
    roots = components(links(classes, rows, radius, words, width), "a", "b")
    member = classes.select("sig", "first").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    kept = written(member.groupBy("root").agg(F.min("first").alias("first")).select("first.id", "first.h"), "similar-kept", free=True)
    # Rows that are equal in id and text are few as a rule; only they are shuffled whole.
    kept = kept.alias("k").join(prints.groupBy("id", "h").agg(F.count(F.lit(1)).alias("rows")).alias("p"), _same("k", "p")).select("k.id", "k.h", "p.rows")
    kept = written(kept, "similar-kept-rows", free=True)
    h = free_name(docs.columns, "h")
    named = docs.withColumn(h, F.xxhash64(body))

    def those(which: DataFrame) -> DataFrame:
        return named.alias("d").join(which.alias("k"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("k.id")) & (F.col(f"d.{h}") == F.col("k.h")), "left_semi")

    return those(kept.where("rows = 1")).drop(h).unionByName(those(kept.where("rows > 1")).dropDuplicates([id_col, h]).drop(h))
