"""Mixing sources to target weights (13), in DataFrame functions only.

Each document gets a hash-random key. Documents are range-sorted by source and key;
sums of sizes inside each range, and the small table of range totals carried forward,
give each document the number of words before it in its source. The mix takes whole
epochs of a source as long as its budget lasts and then the words up to exactly the
budget, so a document at the cut is taken in part.

Sources by code point, null last, weigh ``weights`` in turn. They share a total by
weight; a target stops at ``epochs`` times its source's size, and what it leaves is
shared anew until none is above. In the order of cap by weight the capped sources are
a first stretch, so prefix sums over that order find them at once. The number of
sources is not bounded by anything here but the input: all orders over them are
range-sorted too.

A source with most of the rows is cut into ranges like any other. Ranges hold rows of
one key only where ids repeat with equal sizes.

Defined cases: a null text or size counts as 0; a source of size 0 has target 0; nulls
are a source of their own; a null id has the key of the empty string; of rows with equal
id and size the cut may meet any, with equal sums; a total of 0 takes nothing; an empty
table gives an empty result; extra columns are carried along, and helper columns give
way to their names. Budgets are targets rounded down to whole words.
"""

from collections.abc import Sequence
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.llm._text import free_name
from taskloom.session import written

WEIGHTS = (5, 2, 1)
_SPACES = "\t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Number of words between the six ASCII white-space characters; null counts 0."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), _SPACES, " " * len(_SPACES))
    return F.size(F.array_remove(F.split(plain, " "), "")).cast("long")


def ranges(rows: DataFrame, order: Sequence[Column], part: str, name: str) -> DataFrame:
    """The rows as a written table, range-sorted, with the number of each row's range."""
    return written(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), name)


def before(rows: DataFrame, order: Sequence[Column], values: dict[str, Column], name: str) -> DataFrame:
    """Add to each row the sums of ``values`` over all rows before it, exact, as decimals.

    Rows are sorted inside their range only; the totals of ranges, at most one row a shuffle partition, are carried over.
    """
    part = free_name(rows.columns, "part")
    cut = ranges(rows, order, part, name)
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside, over = ahead(Window.partitionBy(part).orderBy(*order)), ahead(Window.orderBy(part))
    exact = {k: v.cast("decimal(38,0)") for k, v in values.items()}
    totals = cut.groupBy(part).agg(*(F.sum(v).alias(k) for k, v in exact.items()))
    totals = totals.select(part, *(F.coalesce(F.sum(k).over(over), F.lit(0)).alias(f"{k}_ahead") for k in exact))
    out = cut.join(totals, part).select(*rows.columns, part, *(f"{k}_ahead" for k in exact), *(
        F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(k) for k, v in exact.items()))
    return out.select(*rows.columns, *((F.col(k) + F.col(f"{k}_ahead")).cast("decimal(38,0)").alias(k) for k in exact))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = 3) -> DataFrame:
    """(source, source_size, target, budget) for a table (source, source_size) with one row a source."""
    ranked = before(sources, [F.col("source").asc_nulls_last()], {"place": F.lit(1)}, "mix-sources")
    turn = (F.col("place") % len(weights)).cast("int")
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("decimal(38,0)")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * epochs).cast("decimal(38,0)"))
    every = lcm(*weights)
    per = (F.col("cap") * (F.lit(every).cast("decimal(38,0)") / F.col("weight")).cast("decimal(38,0)")).cast("decimal(38,0)")
    ranked = written(ranked.withColumn("per", per), "mix-weights")
    total, all_weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    order = [F.col("per"), F.col("source").asc_nulls_last()]
    filled = before(ranked, order, {"caps": F.col("cap"), "heavy": F.col("weight")}, "mix-levels")
    # Capped: what is left for this source and all after it gives it more than its cap.
    left = F.lit(int(total)).cast("decimal(38,0)") - F.col("caps")
    capped = left * F.col("weight") > F.col("cap") * (F.lit(int(all_weights)).cast("decimal(38,0)") - F.col("heavy"))
    filled = written(filled.withColumn("capped", capped), "mix-capped")
    spent, light = filled.agg(F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)), F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight")))).first()
    rest, light = int(total) - int(spent or 0), max(int(light or 0), 1)
    share = (F.lit(rest).cast("decimal(38,0)") * F.col("weight")).cast("decimal(38,0)")
    whole = F.expr(f"cast(({rest}BD * weight) div {light}BD as bigint)")
    return filled.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share.cast("double") / F.lit(float(light))).alias("target"),
                         F.when(F.col("capped"), F.col("cap").cast("bigint")).otherwise(whole).alias("budget"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = 3, seed: int = 13, id_col: str = "doc_id",
        source_col: str = "source", size_col: str = "size") -> DataFrame:
    """All columns of the documents, and ``source_size``, ``target`` (the source's) and ``taken`` (words of this document,
    at most ``epochs`` times its size). ``docs`` needs a size in words; a written, narrow table is best.
    """
    part, key, ahead, own = (free_name([*docs.columns, "source_size", "target", "taken", "budget"], c) for c in ("part", "key", "ahead", "own"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    rows = docs.withColumn(key, F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    source = F.col(source_col).asc_nulls_last()
    cut = ranges(rows, [source, F.col(key), F.col(id_col), size], part, "mix-ranges")
    totals = written(cut.groupBy(part, F.col(source_col).alias("source")).agg(F.sum(size).alias(own)), "mix-totals")
    sources = totals.groupBy("source").agg(F.sum(own).cast("long").alias("source_size"))
    # A source's rows here are its ranges, at most one a shuffle partition.
    over = Window.partitionBy("source").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn(ahead, F.coalesce(F.sum(own).over(over), F.lit(0))).drop(own).alias("c")
    wanted = targets(sources, weights, epochs).alias("w")
    own_source = F.col("c.source").eqNullSafe(F.col("w.source"))
    carried = written(carried.join(wanted, own_source).select(f"c.{part}", "c.source", ahead, "source_size", "target", "budget"), "mix-carried").alias("c")
    inside = Window.partitionBy(part, source_col).orderBy(key, id_col, size).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn(key, F.coalesce(F.sum(size).over(inside), F.lit(0))).alias("d")
    met = placed.join(carried, (F.col(f"d.{part}") == F.col(f"c.{part}")) & F.col(f"d.{source_col}").eqNullSafe(F.col("c.source")))
    size = F.coalesce(F.col(f"d.{size_col}"), F.lit(0)).cast("long")
    budget, whole = F.col("c.budget"), F.greatest(F.col("c.source_size"), F.lit(1))
    rest = budget % whole
    start = F.col(f"d.{key}") + F.col(f"c.{ahead}")
    taken = F.round((budget - rest) / whole).cast("long") * size + F.least(F.greatest(rest - start, F.lit(0)), size)
    return met.select(*(F.col(f"d.`{c}`").alias(c) for c in docs.columns), "c.source_size", "c.target", taken.cast("long").alias("taken"))


def copies(mixed: DataFrame, text_col: str = "text", size_col: str = "size") -> DataFrame:
    """The mix itself: a row for each epoch of a document, all columns, its text whole, or cut where the budget ends.

    White space between the words of a cut text becomes single spaces.
    """
    size = F.col(size_col)
    plain = F.translate(F.col(text_col), _SPACES, " " * len(_SPACES))
    epoch, n = (free_name(mixed.columns, c) for c in ("epoch", "n_words"))
    last = F.ceil(F.col("taken") / size).cast("int")
    rows = mixed.where((size > 0) & (F.col("taken") > 0)).withColumn(epoch, F.explode(F.sequence(F.lit(1), last)))
    rows = rows.withColumn(n, F.least(size, F.col("taken") - (F.col(epoch) - 1) * size))
    first = F.array_join(F.slice(F.array_remove(F.split(plain, " "), ""), 1, F.col(n).cast("int")), " ")
    return rows.withColumn(text_col, F.when(F.col(n) < size, first).otherwise(F.col(text_col)))


#: The query's rows in DuckDB SQL, with windows over whole sources.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS BIGINT) AS size,
    ('0x' || substr(md5('13:' || doc_id), 1, 15))::BIGINT AS key FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s
), f AS (SELECT *, coalesce(sum(3 * source_size) OVER o, 0) AS caps, coalesce(sum(weight) OVER o, 0) AS heavy, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM w WINDOW o AS (ORDER BY 3 * source_size * (10 // weight), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (SELECT *, (total - caps) * weight > 3 * source_size * (weights - heavy) AS capped FROM f
), r AS (SELECT *, total - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER () AS rest, greatest(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER (), 1) AS light FROM c
), t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(rest * weight AS DOUBLE) / CAST(light AS DOUBLE) END AS target,
    CASE WHEN capped THEN 3 * source_size ELSE (rest * weight) // light END AS budget FROM r
), p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.budget, CASE WHEN t.source_size > 0 THEN t.budget // t.source_size ELSE 0 END AS rounds,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(rounds * size + least(greatest(budget - rounds * source_size - start, 0), size) AS BIGINT) AS taken FROM p"""
