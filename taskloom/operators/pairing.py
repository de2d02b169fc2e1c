"""Typed pairing: k seeded draws per problem from the texts of its type."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions.hashing import bucket_digits, md5_bucket, md5_int, md5_key
from taskloom.functions.text import strip
from taskloom.operators.numbering import dense_ordinal, number_rows, spread_join, top_per_key
from taskloom.session import shuffle_width

DEFAULT_TYPE = 3
ANY_TYPE = 0
SMALL_POOL = 10_000  # ids; the six pools stay below 2 MB


def resolve_type(col: Column) -> Column:
    """``type_level1`` as 1..5; everything else is the default type."""
    number = strip(col).try_cast("int")
    return F.when(number.between(1, 5), number).otherwise(DEFAULT_TYPE)


def pool_sizes(listing: DataFrame) -> dict[int, int]:
    """Entries per type: five numbers at most reach the driver."""
    return {r["type_id"]: r["n"] for r in listing.groupBy("type_id").agg(F.count(F.lit(1)).alias("n")).collect()}


def route_problems(problems: DataFrame, sizes: dict[int, int], strict: bool = False) -> DataFrame:
    """Add ``type_id`` and ``route``: typed, fallback (own pool is empty) or skipped."""
    present = [k for k, n in sizes.items() if n > 0]
    other = "fallback" if present and not strict else "skipped"
    typed = problems.withColumn("type_id", resolve_type(F.col("type_level1")))
    hit = F.col("type_id").isin(*present) if present else F.lit(False)
    return typed.withColumn("route", F.when(hit, "typed").otherwise(other))


def pair_stats(problems: DataFrame, sizes: dict[int, int], strict: bool = False) -> DataFrame:
    """Problems per route and, for typed ones, per type."""
    routed = route_problems(problems, sizes, strict)
    label = F.when(F.col("route") == "typed", F.col("type_id").cast("string")).otherwise(F.col("route"))
    return routed.groupBy(label.alias("route")).agg(F.count(F.lit(1)).alias("n"))


def _rings(listing: DataFrame, with_any: bool, seed: int) -> DataFrame:
    """Entries with a dense position per pool, in hash order."""
    entry = listing.withColumn("_h", md5_key(F.lit(seed), F.col("type_id"), F.col("corpus_id"), F.col("slot")))
    if with_any:
        entry = entry.withColumn("pool", F.explode(F.array(F.col("type_id"), F.lit(ANY_TYPE))))
    else:
        entry = entry.withColumn("pool", F.col("type_id"))
    entry = entry.select("pool", "corpus_id", "slot", "_h")
    bucket = md5_bucket(F.col("_h"), bucket_digits(shuffle_width(listing.sparkSession)))
    ring = number_rows(entry, ["pool"], ["_h", "corpus_id", "slot"], bucket, "pool_pos")
    return ring.select("pool", "pool_pos", "corpus_id")


def _pool() -> Column:
    return F.when(F.col("route") == "typed", F.col("type_id")).otherwise(ANY_TYPE)


def typed_picks(
    problems: DataFrame,
    listing: DataFrame,
    k: int = 1,
    seed: int = 42,
    strict: bool = False,
    sizes: dict[int, int] | None = None,
    small_pool: int = SMALL_POOL,
) -> DataFrame:
    """``k`` corpus ids per problem, without repeats until the whole pool was used once.

    Each pool is a ring in hash order; a problem starts at its own hashed place
    and takes consecutive entries, with a new start for each pass over the pool.
    Only ids are numbered and joined. The join key (pool, position) is near
    uniform for large pools; the rings of pools up to ``small_pool`` entries,
    whose keys would be hot, are broadcast (at most 6 x ``small_pool`` ids).
    """
    sizes = pool_sizes(listing) if sizes is None else sizes
    routed = route_problems(problems, sizes, strict).where("route <> 'skipped'")
    uses_any = not strict and any(sizes.get(i, 0) == 0 for i in range(1, 6))
    pool_n = {**sizes, ANY_TYPE: sum(sizes.values())}
    size_of = F.create_map(*[F.lit(v) for pair in pool_n.items() for v in pair])
    draws = (
        routed.withColumn("pool", _pool())
        .withColumn("_n", F.try_element_at(size_of, F.col("pool")).cast("bigint"))
        .withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .withColumn("_pass", F.floor(F.col("sample_idx") / F.col("_n")))
        .withColumn("_start", md5_int(md5_key(F.lit(seed), F.col("id"), F.col("_pass"))))
        .withColumn("pool_pos", F.pmod(F.pmod("_start", "_n") + F.pmod("sample_idx", "_n"), F.col("_n")))
        .drop("_pass", "_start", "_n")
    )
    rings = _rings(listing, uses_any, seed)
    live = [p for p, n in pool_n.items() if n > 0 and (p != ANY_TYPE or uses_any)]
    small = [p for p in live if pool_n[p] <= small_pool]
    large = [p for p in live if pool_n[p] > small_pool]
    parts = []
    if large:
        chosen = F.col("pool").isin(*large)
        parts.append(draws.where(chosen).join(rings.where(chosen), ["pool", "pool_pos"]))
    if small:
        chosen = F.col("pool").isin(*small)
        parts.append(draws.where(chosen).join(F.broadcast(rings.where(chosen)), ["pool", "pool_pos"]))
    if not parts:  # no corpus at all: every problem is skipped
        return draws.where(F.lit(False)).join(rings, ["pool", "pool_pos"]).drop("pool", "pool_pos")
    return reduce(DataFrame.unionByName, parts).drop("pool", "pool_pos")


def typed_pairs(
    problems: DataFrame, listing: DataFrame, texts: DataFrame, k: int = 1, hot_rows: int = 1_000_000, **options
) -> DataFrame:
    """Problems with the texts of their picks; ``texts`` has one row per corpus_id.

    Draws are near uniform within a pool, so texts are hot keys exactly where a
    pool has more than ``hot_rows`` draws per entry. Such pools are small (at
    most draws / ``hot_rows`` entries), which bounds the broadcast list of their ids.
    """
    sizes = options.pop("sizes", None) or pool_sizes(listing)
    picks = typed_picks(problems, listing, k, sizes=sizes, **options)
    routed = route_problems(problems, sizes, options.get("strict", False)).where("route <> 'skipped'")
    asked = routed.groupBy(_pool().alias("pool")).agg(F.count(F.lit(1)).alias("n")).collect()  # six rows at most
    pool_n = {**sizes, ANY_TYPE: sum(sizes.values())}
    hot_pools = [r["pool"] for r in asked if r["n"] * k > hot_rows * pool_n[r["pool"]]]
    if not hot_pools:
        return picks.join(texts, "corpus_id")
    entries = listing if ANY_TYPE in hot_pools else listing.where(F.col("type_id").isin(*hot_pools))
    hot = F.broadcast(entries.select("corpus_id", F.lit(True).alias("_hot")).distinct())
    return spread_join(
        picks.join(hot, "corpus_id", "left"), texts.join(hot, "corpus_id", "left"), ["corpus_id"], ["id", "sample_idx"]
    )


def segment_sample(df: DataFrame, seq: str, key: str, seed: int = 42, size: int = 500) -> DataFrame:
    """About ``size`` rows, spread over n // size + 1 equal contiguous segments.

    Each segment gives at least one row, and the rows left over by the division
    belong to the last segment, which is why ranking is split by ordinal blocks.
    """
    rows = dense_ordinal(df, seq, total="_total")
    segments = F.floor(F.col("_total") / size) + 1
    width = F.greatest(F.floor(F.col("_total") / segments), F.lit(1))
    segment = F.least(F.floor(F.col("ord") / width), segments - 1)
    quota = F.greatest(F.lit(1), F.floor(F.lit(size) / segments))
    drawn = (
        rows.withColumn("segment", segment).withColumn("_quota", quota)
        .withColumn("_draw", md5_key(F.lit(seed), F.col(key)))
    )
    best = top_per_key(drawn, ["segment"], ["_draw", seq], F.col("_quota"), F.floor(F.col("ord") / size))
    return best.drop("_total", "_quota", "_draw")
