"""Centroid clustering (11): Lloyd rounds on whole numbers, nearest centroids by Orchard's search.

For each centroid the others are listed by distance from it. A vector starts at centroid
0 and walks its list; whenever a centroid is closer (or as close with a smaller number)
the search jumps to that one's list. Centroids it has met are marked and not measured
again. It stops where the next one in the list is strictly beyond twice the current
distance: by the triangle inequality nothing from there on can be as close. All vectors
of a block take their steps together in numpy.

Vectors become whole numbers once and are written; a round reads them, sums components
per cluster inside each task, and merges (cluster, component) sums in Spark, so that only
k times (dims + 1) numbers come back. Sums and distances are exact.

Defined cases: vectors that are null, of another length or with a null, NaN or infinite
component are left out; a null id is drawn as the empty string; repeated rows are vectors
of their own, and of equal ids the smaller vector counts as first; with fewer vectors than
k there are fewer clusters; an empty centroid stays; an empty table gives empty results;
other columns are not read. A component beyond the range in which distances fit 64 bits
(some 2**26 after scaling, for 64 dimensions) is refused with a ValueError, never rounded.
"""

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskloom.session import written

BLOCK = 8192


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the numbers of the others by squared distance from it, and these distances."""
    apart = np.stack([((centroids - c) ** 2).sum(axis=1) for c in centroids])
    order = np.argsort(apart, axis=1, kind="stable")
    order = order[order != np.arange(len(order))[:, None]].reshape(len(order), -1)
    return order, np.take_along_axis(apart, order, axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each vector, ties to the smaller number, and how many distances were measured."""
    n, others = len(x), order.shape[1]
    at, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    best = ((x - centroids[0]) ** 2).sum(axis=1)
    met = np.zeros((n, others + 1), bool)
    met[:, 0] = True
    active, measured = np.arange(n), n
    while True:
        active = active[place[active] < others]
        active = active[apart[at[active], place[active]] <= 4 * best[active]]
        if not len(active):
            return at, best, measured
        other = order[at[active], place[active]]
        place[active] += 1
        fresh = ~met[active, other]
        rows, other = active[fresh], other[fresh]
        met[rows, other] = True
        d = ((x[rows] - centroids[other]) ** 2).sum(axis=1)
        measured += len(rows)
        closer = (d < best[rows]) | ((d == best[rows]) & (other < at[rows]))
        rows = rows[closer]
        at[rows], best[rows], place[rows] = other[closer], d[closer], 0


def _blocks(batches, dims: int):
    """Vectors of each batch as rows of whole numbers, some thousands at a time."""
    limit = isqrt((1 << 60) // dims) // 2
    for b in batches:
        values = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        for low in range(0, len(values), BLOCK):
            x = values[low : low + BLOCK]
            if x.max() > limit or x.min() < -limit:
                raise ValueError(f"a component is beyond {limit}: distances would not fit 64 bits")
            yield b.slice(low, len(x)), x


def whole_vectors(vectors: DataFrame, scale: int, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors of ``dims`` finite components, each floor(scale * component)."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    whole = F.transform(v, lambda e: F.floor(e.cast("double") * scale))
    return vectors.where((F.size(v) == dims) & ~bad).select(F.col(id_col).alias("id"), whole.alias("v"))


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, dims: int = 64,
            id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Members (id, cluster, distance), a written table, and clusters (cluster, centroid, size, inertia), k rows at most."""
    spark = vectors.sparkSession
    table = written(whole_vectors(vectors, scale, dims, id_col, vector_col), "orchard-vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = table.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, dims)
    kinds = T.StructType([T.StructField(id_col, table.schema["id"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    shape = "cluster int, centroid array<bigint>, size bigint, inertia bigint"
    if not len(centroids):
        return spark.createDataFrame([], kinds), spark.createDataFrame([], shape)

    def sums(centroids: np.ndarray):
        lists = neighbour_lists(centroids)

        def run(batches):
            total = np.zeros((len(centroids), dims + 1), np.int64)
            for _, x in _blocks(batches, dims):
                at = nearest(x, centroids, *lists)[0]
                for c in np.unique(at):
                    own = x[at == c]
                    total[c, :dims] += own.sum(axis=0)
                    total[c, dims] += len(own)
            cell = np.flatnonzero(total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], ["cell", "n"])

        return run

    def members(centroids: np.ndarray):
        lists = neighbour_lists(centroids)

        def run(batches):
            for part, x in _blocks(batches, dims):
                at, best, _ = nearest(x, centroids, *lists)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at.astype(np.int32)), pa.array(best)], kinds.names)

        return run

    for _ in range(rounds):
        merged = table.mapInArrow(sums(centroids), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        total = np.zeros(len(centroids) * (dims + 1), np.int64)
        for r in merged.collect():  # k times (dims + 1) cells at most
            total[r["cell"]] = r["n"]
        total = total.reshape(len(centroids), dims + 1)
        some = total[:, dims] > 0
        moved = centroids.copy()
        moved[some] = total[some, :dims] // total[some, dims:]
        if (moved == centroids).all():
            break  # further rounds would repeat this one
        centroids = moved
    found = written(table.mapInArrow(members(centroids), kinds), "orchard-members")
    counted = {r["cluster"]: r for r in found.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("distance").alias("inertia")).collect()}
    rows = [(c, [int(v) for v in own], counted[c]["size"] if c in counted else 0, counted[c]["inertia"] if c in counted else 0) for c, own in enumerate(centroids)]
    return found, spark.createDataFrame(rows, shape)


def oracle(k: int = 8, rounds: int = 10) -> str:
    """The query's rows in DuckDB SQL: all distances in every round."""
    parts = [f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v AS m FROM e ORDER BY sha256('3:' || vec_id) LIMIT {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS best FROM (
    SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM e, c{r}) GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""s{r} AS MATERIALIZED (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY c, i
), c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(any_value(q.m), any_value(c{r}.m)) AS m FROM c{r} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{r} GROUP BY c) q ON c{r}.c = q.c GROUP BY c{r}.c)""")
    return ", ".join(parts) + f""" SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON best.c = c{rounds}.c"""
