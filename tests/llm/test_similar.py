"""The pipeline's near-dedup: SimHash candidates with exact verification, held against all pairs."""

import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from taskloom import session
from taskloom.llm import simhash, similar


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similar_pairs(texts):
    """Pairs of places of distinct texts with Jaccard of 0.8 or more, through the shingles they share."""
    own, holders = [sets(t) for t in texts], {}
    for i, s in enumerate(own):
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = {}
    for held in holders.values():
        for k, a in enumerate(held):
            for b in held[k + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    return [(a, b) for (a, b), n in shared.items() if 5 * n >= 4 * (len(own[a]) + len(own[b]) - n)]


def kept(rows):
    """Least id of each group, by all pairs."""
    texts = [t for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in similar_pairs(texts):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return sorted({rows[find(i)][0] for i in range(len(rows))})


def near_copies(edits=40):
    r = random.Random(8)
    passage, rows = [f"p{i}" for i in range(60)], []
    for g in range(40):
        base = [f"g{g}w{r.randrange(300)}" for _ in range(r.choice([8, 60, 200]))] + passage * (g % 4 == 0)
        for k in range(r.randrange(1, 9)):
            own = list(base)
            for _ in range(r.randrange(1 + len(own) // edits)):
                own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
            rows.append((100 * g + k, " ".join(own)))
    return rows + [(9000, ""), (9001, None), (9002, "one two"), (9003, "ONE two"), (9004, "one two three")]


@pytest.mark.parametrize("crowded", [0, 64])
def test_groups_equal_all_pairs(spark, monkeypatch, crowded):
    monkeypatch.setattr(similar, "CROWDED", crowded)
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string").repartition(3)
    want = kept(near_copies())
    assert 40 < len(want) < len(near_copies()) - 40
    found = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert set(want) <= set(found) and len(found) <= len(want) + 3  # nothing is linked wrongly, hardly anything missed


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_documents(spark, folder):
    """Of the pairs of different texts with Jaccard 0.8 or more, nine in ten and more end in one group."""
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text")
    texts = [r["text"] for r in docs.select("text").distinct().where("text is not null").collect()]
    pairs = similar_pairs(texts)
    distinct = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    stayed = {r["doc_id"] for r in similar.keep_one(distinct).collect()}
    lost = [p for p in pairs if p[0] in stayed and p[1] in stayed]
    assert len(pairs) > 3 and len(lost) <= 0.1 * len(pairs)


def test_crowd_of_copies_and_thin_passage(spark, monkeypatch):
    """A thousand near copies cost candidates in proportion, and a passage that all texts share costs none."""
    r = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    crowd = []
    for i in range(1000):
        own = list(base)
        own[r.randrange(150)] = f"e{i}"
        crowd.append((i, " ".join(own)))
    passage = " ".join(f"p{i}" for i in range(25))
    thin = [(5000 + i, " ".join(f"t{i}w{k}" for k in range(60)) + " " + passage) for i in range(1000)]
    asked, check = [], similar._verified
    monkeypatch.setattr(similar, "_verified", lambda pairs, *more: asked.append(pairs.count()) or check(pairs, *more))
    docs = spark.createDataFrame(crowd + thin, "doc_id long, text string").repartition(40)
    found = {x["doc_id"] for x in similar.keep_one(docs).collect()}
    assert {i for i, _ in thin} < found and len(found) <= 1010
    assert sum(asked) < 4 * 1000


def test_similar_edges(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "A b c d e f"), (3, "another text that is not the same at all"),
            (None, "null id alone"), (None, "null id alone"), (None, "null ids and another text")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, sig int, h int")
    found = similar.keep_one(docs)
    assert found.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in found.collect()) == [
        (-1, "null id alone"), (-1, "null ids and another text"), (3, "a b c d e f"), (3, "another text that is not the same at all")]
    assert similar.keep_one(docs.limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(300_000))
    few = spark.createDataFrame([(1, long), (2, long + " end"), (3, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in similar.keep_one(few).collect()) == [1, 3]
    assert similar.keep_one(few.withColumn("doc_id", F.col("doc_id").cast("string"))).count() == 2


def shuffle_bytes(spark):
    """Size of the shuffle files that this session holds."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.stat().st_size for d in folders for f in Path(d.toString()).rglob("shuffle_*.data"))


def settled(spark, most):
    """The same, once files that are being removed are gone, or after some seconds."""
    for _ in range(50):
        if shuffle_bytes(spark) <= most:
            break
        time.sleep(0.1)
    return shuffle_bytes(spark)


def random_texts(n):
    r = random.Random(5)
    return [(i, " ".join(f"w{r.randrange(4000)}" for _ in range(30))) for i in range(n)]


def test_probes_of_a_search_are_gone_before_the_next(spark, monkeypatch):
    """All probes together make some megabytes; once a table is written, none of them is on disk."""
    docs = spark.createDataFrame(random_texts(6000), "doc_id long, text string").repartition(4)
    steps, write = {}, similar.written
    spark._jvm.System.gc()
    began = settled(spark, 0)

    def noted(df, name, *a, **b):
        out = write(df, name, *a, **b)
        steps[name] = settled(spark, began + 3_000_000) - began
        return out

    monkeypatch.setattr(similar, "written", noted)
    assert similar.keep_one(docs).count() == 6000
    assert "similar-candidates" in steps and max(steps.values()) < 4_000_000, steps


def test_many_searches_find_what_one_finds(spark, monkeypatch):
    docs = spark.createDataFrame(near_copies() + [(10_000 + i, t) for i, t in random_texts(300)], "doc_id long, text string").repartition(3)
    names = []
    write = similar.written
    monkeypatch.setattr(similar, "written", lambda df, name, *a, **b: names.append(name) or write(df, name, *a, **b))
    kept_ids = lambda: sorted(r["doc_id"] for r in similar.keep_one(docs).collect())
    one = kept_ids()
    assert names.count("similar-found") == 1
    names.clear()
    monkeypatch.setattr(similar, "SMALL_ROUND", 0)
    monkeypatch.setattr(similar, "ROUND_PROBES", 2)
    monkeypatch.setattr(similar, "CROWDED", 0)
    assert kept_ids() == one and names.count("similar-found") > 8
    names.clear()
    monkeypatch.setattr(similar, "ROUND_PROBES", 30)
    monkeypatch.setattr(similar, "LISTED", 1)
    assert kept_ids() == one and names.count("similar-found") == 4


def test_rounds_make_up_all_probes():
    assert similar.rounds([3, 4, 0], 7) == [([0, 1, 2], 0, 1)]
    assert similar.rounds([3, 4, 0], 6) == [([0], 0, 1), ([1], 0, 1), ([2], 0, 1)]
    assert similar.rounds([9, 5], 4) == [([0], 0, 3), ([0], 1, 3), ([0], 2, 3), ([1], 0, 2), ([1], 1, 2)]
    r = np.random.default_rng(1)
    groups = [list(range(16 * i, 16 * i + 16)) for i in range(4)]
    units = r.integers(0, 5, (50, 4))
    want = [sum(len(simhash._masks(16, u - 1)) for u in row if u) for row in units]
    assert simhash.probe_counts(units, groups, 9).tolist() == want


def test_written_frees_its_shuffle(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark._jvm.System.gc()
    before, began = spark.conf.get(name), shuffle_bytes(spark)
    rows = spark.range(200_000).select(F.xxhash64("id").alias("x"))
    found = session.written(rows.repartition(4, "x"), "freed", free=True)
    assert settled(spark, began) <= began and found.count() == 200_000
    assert spark.conf.get(name) == before
    session.written(rows.repartition(4, "x"), "left")
    assert shuffle_bytes(spark) > began
