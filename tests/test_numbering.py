import random

import pytest
from pyspark.sql import functions as F

from taskloom.functions.hashing import md5_bucket, md5_key
from taskloom.operators.numbering import dense_ordinal, lookup_join, number_rows, range_bucket, top_per_key
from taskloom.operators.pairing import segment_sample
from taskloom.operators.sharding import shard_ceil, shard_contiguous


@pytest.mark.parametrize("parts", [1, 7, 64])
@pytest.mark.parametrize("seqs", ["dense", "sparse", "clustered"])
def test_dense_ordinal(spark, parts, seqs):
    rng = random.Random(3)
    values = {
        "dense": list(range(1000)),
        "sparse": rng.sample(range(-(10**15), 10**15), 1000),
        "clustered": [p * 2**33 + i for p in range(4) for i in range(250)],
    }[seqs]
    df = spark.createDataFrame([(v,) for v in rng.sample(values, 1000)], "seq bigint").repartition(parts)
    got = dense_ordinal(df, "seq", total="n").collect()
    assert sorted((r.seq, r.ord, r.n) for r in got) == [(v, i, 1000) for i, v in enumerate(sorted(values))]


def test_one_row_and_no_rows(spark):
    one = spark.createDataFrame([(5,)], "seq bigint")
    assert [r.ord for r in dense_ordinal(one, "seq").collect()] == [0]
    assert dense_ordinal(one.where("seq > 9"), "seq").collect() == []


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_number_within_hot_key(spark, parts):
    """Two thirds of the rows share one key."""
    df = spark.range(3000).selectExpr("id AS seq", "CASE WHEN id % 3 < 2 THEN 'hot' ELSE concat('k', id % 100) END AS k")
    got = number_rows(df.repartition(parts), ["k"], ["seq"], range_bucket(df, "seq", 256)).collect()
    by_key = {}
    for r in sorted(got, key=lambda r: r.seq):
        assert r.ord == by_key.get(r.k, 0)
        by_key[r.k] = r.ord + 1
    assert by_key["hot"] == 2000 and sum(by_key.values()) == 3000


def test_hot_key_spans_many_buckets(spark):
    """The hot key must not sit in one window partition."""
    df = spark.range(2000).selectExpr("id AS seq", "'hot' AS k")
    largest = df.groupBy(range_bucket(df, "seq", 256).alias("b")).count().agg(F.max("count")).first()[0]
    assert largest <= 40


@pytest.mark.parametrize("rule", ["id", "id * 1000003 % 999983", "CASE WHEN id < 1900 THEN id ELSE id + 1000000000000 END", "(id % 4) * 8589934592 + id"])
def test_buckets_are_even(spark, rule):
    df = spark.range(2000).selectExpr(f"{rule} AS seq")
    sizes = [r["count"] for r in df.groupBy(range_bucket(df, "seq", 100).alias("b")).count().collect()]
    assert max(sizes) <= 4 * 20


def test_attach_drops_keys_without_partner(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, seq bigint")
    extra = spark.createDataFrame([("a", 9)], "k string, m int")
    got = number_rows(df, ["k"], ["seq"], range_bucket(df, "seq"), attach=extra).collect()
    assert sorted((r.k, r.ord, r.m) for r in got) == [("a", 0, 9), ("a", 1, 9)]


def test_top_per_key(spark):
    df = spark.range(5000).selectExpr("id", "id % 2 AS k").withColumn("h", md5_key(F.col("id")))
    got = top_per_key(df, ["k"], ["h"], 5, md5_bucket(F.col("h"), 1)).collect()
    for k in (0, 1):
        best = sorted((r.h for r in df.where(F.col("k") == k).collect()))[:5]
        assert [r.h for r in sorted(got, key=lambda r: r["rank"]) if r.k == k] == best


@pytest.mark.parametrize("hot_rows", [5, 10**6])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_spreads_hot_keys(spark, hot_rows, how):
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id < 400 THEN 0 WHEN id < 990 THEN id % 50 ELSE 777 END AS k")
    table = spark.range(60).selectExpr("id AS k", "id * 10 AS v")
    got = lookup_join(rows, table, ["k"], ["id"], how, hot_rows).collect()
    want = rows.join(table, "k", how).collect()
    assert sorted((r.id, r.k, r.v or -1) for r in got) == sorted((r.id, r.k, r.v or -1) for r in want)


def test_shards(spark):
    for n, shards in ((10, 3), (3, 5), (1, 1), (12, 4)):
        df = spark.range(n).withColumnRenamed("id", "seq")
        sizes = [n // shards + (i < n % shards) for i in range(shards)]
        want = [i for i, s in enumerate(sizes) for _ in range(s)]
        assert [r.shard for r in shard_contiguous(df, "seq", shards).orderBy("seq").collect()] == want
        per = -(-n // shards)
        assert [r.shard for r in shard_ceil(df, "seq", shards).orderBy("seq").collect()] == [i // per for i in range(n)]


@pytest.mark.parametrize("n", [1, 499, 500, 1750, 250_000])
def test_segment_sample(spark, n):
    rows = segment_sample(spark.range(n).withColumnRenamed("id", "seq"), "seq", "seq").collect()
    segments = n // 500 + 1
    width, quota = max(n // segments, 1), max(1, 500 // segments)
    counts = {}
    for r in rows:
        assert r.segment == min(r.seq // width, segments - 1)
        counts[r.segment] = counts.get(r.segment, 0) + 1
    assert len(counts) == min(segments, n)
    assert all(c == min(quota, width) or s == segments - 1 for s, c in counts.items())
