"""Dense ordinals, top-k and lookups that hold up when one key has most rows.

A window over a hot key, or over no key at all, puts that key on one task. The
ordinals here are built in two levels instead: rows are numbered inside
(key, bucket), where the bucket follows the wanted order, and the small table
of (key, bucket) counts supplies the offset of each bucket.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.session import shuffle_width

#: Quantiles that are fetched at most; finer buckets divide the space between two of them evenly.
_QUANTILES = 512


def range_bucket(df: DataFrame, seq: str, n_buckets: int | None = None) -> Column:
    """Bucket expression that is monotone in the bigint column ``seq``.

    One aggregate over ``seq`` alone fetches the limits of the buckets as
    quantiles, so buckets are even however the values cluster. The quantiles only
    balance the work: any monotone bucketing gives the same ordinals, so they
    need not be exact.
    """
    n_buckets = n_buckets or 4 * shuffle_width(df.sparkSession)
    parts = min(n_buckets, _QUANTILES)
    per = -(-n_buckets // parts)
    found = df.agg(F.percentile_approx(seq, [i / parts for i in range(parts + 1)], 10 * _QUANTILES * 2)).first()[0]
    cuts = sorted(set(found or []))
    if len(cuts) < 2:
        return F.lit(0)
    value = F.col(seq).cast("double")

    def inside(i: int) -> Column:
        if per == 1:
            return F.lit(i)
        width = cuts[i + 1] - cuts[i]
        return F.lit(i * per) + F.least(F.greatest(F.floor((value - float(cuts[i])) * (per / width)), F.lit(0)), F.lit(per - 1))

    # Binary search as nested conditions: log2(quantiles) comparisons a row.
    def search(low: int, high: int) -> Column:
        if low == high:
            return inside(low)
        middle = (low + high) // 2
        return F.when(F.col(seq) <= cuts[middle + 1], search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(cuts) - 2).cast("int")


def number_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    out: str = "ord",
    attach: DataFrame | None = None,
    total: str | None = None,
) -> DataFrame:
    """Add ``out`` = 0, 1, 2, … within ``by`` in the order of ``order``.

    ``bucket`` must be monotone in ``order``. ``attach`` is an optional table
    with one row per ``by``; its columns are added and rows without a partner
    dropped, at the cost of a join against the count table only. ``total`` adds
    the number of rows per ``by``. The wide rows are shuffled once, on
    (by, bucket).
    """
    keys = list(by)
    cells = df.withColumn("_cell", bucket)
    counts = cells.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    # At most one row per bucket and key in this window.
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    before = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(whole))
    offsets = offsets.drop("_n")
    if attach is not None:
        offsets = offsets.join(attach, keys)
    if not keys:
        offsets = F.broadcast(offsets)  # one row per bucket
    local = Window.partitionBy(*keys, "_cell").orderBy(*order)
    return (
        cells.withColumn("_local", F.row_number().over(local) - 1)
        .join(offsets, [*keys, "_cell"])
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_cell", "_before", "_local")
    )


def dense_ordinal(df: DataFrame, seq: str, out: str = "ord", total: str | None = None) -> DataFrame:
    """0..n-1 over the whole table in the order of a unique bigint ``seq``."""
    return number_rows(df, [], [seq], range_bucket(df, seq), out, total=total)


def top_per_key(
    df: DataFrame, by: Sequence[str], order: Sequence[str], k, spread: Column, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key (exact); ``rank`` counts from 0.

    ``spread`` splits a key over tasks: each part keeps its own first ``k``, and
    only those meet in the final ranking. ``k`` is a number or a column.
    """
    limit = k if isinstance(k, Column) else F.lit(k)
    part = Window.partitionBy(*by, "_part").orderBy(*order)
    final = Window.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("_part", spread)
        .withColumn("_r", F.row_number().over(part))
        .where(F.col("_r") <= limit)
        .withColumn(rank, F.row_number().over(final) - 1)
        .where(F.col(rank) < limit)
        .drop("_part", "_r")
    )


def spread_join(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], row_id: Sequence[str],
    how: str = "inner", parts: int | None = None,
) -> DataFrame:
    """Many-to-one join where both sides carry a flag ``_hot`` for their key.

    Rows of hot keys are spread over ``parts`` join keys by ``row_id``, which
    must tell rows apart; only the table rows of hot keys are repeated.
    """
    parts = parts or shuffle_width(rows.sparkSession)
    hot = F.coalesce(F.col("_hot"), F.lit(False))
    spread = F.pmod(F.xxhash64(*row_id), F.lit(parts)).cast("int")
    every = F.when(hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    left = rows.withColumn("_part", F.when(hot, spread).otherwise(F.lit(0))).drop("_hot")
    right = table.withColumn("_part", F.explode(every)).drop("_hot")
    return left.join(right, [*keys, "_part"], how).drop("_part")


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    row_id: Sequence[str],
    how: str = "inner",
    hot_rows: int = 1_000_000,
    hot_from: DataFrame | None = None,
) -> DataFrame:
    """Join many rows to a table that has one row per key, safe for hot keys.

    Keys with more than ``hot_rows`` rows are marked by their 8-byte hash. There
    are at most (rows / hot_rows) of them, so the broadcast list of hashes stays
    below 8 MB per 10**12 rows. A hash collision merely spreads one more key.
    ``hot_from`` is a cheaper table with the same keys to count on.
    """
    keys = list(keys)
    hashed = F.xxhash64(*keys)
    counted = (rows if hot_from is None else hot_from).select(hashed.alias("_h")).groupBy("_h")
    hot = counted.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select("_h", F.lit(True).alias("_hot"))

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("_h", hashed).join(F.broadcast(hot), "_h", "left").drop("_h")

    return spread_join(marked(rows), marked(table), keys, row_id, how)
