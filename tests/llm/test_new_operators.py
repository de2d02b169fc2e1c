"""Orchard clustering, fill-in-middle and source mixing against brute force, and their defined cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import SPACE
from taskloom.llm import fim, mixing, orchard

TEXTS = [None, "", "a", " ", "é", "日本語 and ascii 😀😀 end", "x" * 5000, "a<P>b", "<S>", "plain <M> text", "ends with <", "> begins", "<S", "one two\nthree\tfour é",
         "é combining", "word " * 4000 + "ü" * 3000, "\x00\x1f", "Ａ wide", "ÿ\x7f\x80"]


def lloyd(vectors, k, rounds, seed=3):
    """id -> (cluster, distance) with Python integers, all distances measured."""
    first = sorted(vectors, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in first]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids)) for _, v in vectors]

    for _ in range(rounds):
        at = assigned()
        for c in range(len(centroids)):
            own = [v for (_, v), (_, i) in zip(vectors, at) if i == c]
            if own:
                centroids[c] = [sum(col) // len(own) for col in zip(*own)]
    return [(i, d) for d, i in assigned()], centroids


@pytest.mark.parametrize("k", [1, 2, 8, 40])
def test_orchard_equals_all_distances(k):
    r = np.random.default_rng(k)
    centroids = r.integers(-20, 20, (k, 5))
    centroids[k // 2] = centroids[0]  # equal centroids tie
    x = r.integers(-25, 25, (3000, 5))
    at, best, measured = orchard.nearest(x, centroids, *orchard.neighbour_lists(centroids))
    every = ((x[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert k < 40 or measured < 0.9 * every.size  # the triangle inequality spares some


def test_orchard_spares_distances_on_clusters():
    r = np.random.default_rng(1)
    centroids = r.integers(-10**6, 10**6, (200, 16))
    x = np.repeat(centroids, 20, axis=0) + r.integers(-100, 100, (4000, 16))
    at, _, measured = orchard.nearest(x, centroids, *orchard.neighbour_lists(centroids))
    assert (at == np.repeat(np.arange(200), 20)).all() and measured < 0.3 * 200 * 4000


def test_clusters_equal_brute_force(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([-0.5, 0.25, r.random()]) for _ in range(4)]) for i in range(120)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (500, None), (501, [1.0, 2.0]), (502, [1.0, None, 0.0, 0.0]), (503, [float("nan"), 0.0, 0.0, 0.0]),
             (504, [float("inf"), 0.0, 0.0, 0.0]), (505, [0.0, 0.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, cluster int, distance int").repartition(5)
    members, clusters = orchard.cluster(table, k=6, rounds=4, dims=4)
    kept = [(i, [int(np.floor(1024 * c)) for c in v]) for i, v in rows if v and len(v) == 4 and all(c is not None and np.isfinite(c) for c in v)]
    want, centroids = lloyd(kept, 6, 4)
    assert sorted(map(tuple, members.collect())) == sorted((i, c, d) for (i, _), (c, d) in zip(kept, want))
    found = {x["cluster"]: x for x in clusters.collect()}
    for c, own in enumerate(centroids):
        dist = [d for at, d in want if at == c]
        assert (found[c]["centroid"], found[c]["size"], found[c]["inertia"]) == (own, len(dist), sum(dist))


def test_cluster_edges(spark):
    kind = "vec_id long, embedding array<float>"
    members, clusters = orchard.cluster(spark.createDataFrame([], kind), dims=2)
    assert members.count() == clusters.count() == 0
    few = spark.createDataFrame([(1, [0.5, 0.5]), (None, [0.5, 0.5]), (3, [0.5, 0.5])], kind)
    members, clusters = orchard.cluster(few, dims=2)  # equal vectors: all go to the smallest number, the others stay empty
    assert [tuple(x) for x in members.select("cluster", "distance").distinct().collect()] == [(0, 0)]
    assert sorted((x["cluster"], x["size"]) for x in clusters.collect()) == [(0, 3), (1, 0), (2, 0)]
    with pytest.raises(Exception, match="beyond"):
        orchard.cluster(spark.createDataFrame([(1, [1e30, 0.0])], kind), dims=2)[0].collect()


def fill_in_middle(key, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_equals_brute_force_and_comes_back(spark):
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice("ab Zé日😀\n<>PSM,") for _ in range(r.randrange(60))) for _ in range(400)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[5], "x", 1), (None, "null id é", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, body string, output int")
    found = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((i, *fill_in_middle("" if i is None else i, t), t or "") for i, t, *_ in rows), key=repr)
    assert sorted((tuple(x) for x in found), key=repr) == want
    assert {x["form"] for x in found} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0


def test_fim_by_characters(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for x in fim.transform(docs, unit="char", fim_percent=100).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect():
        text = TEXTS[x["doc_id"]] or ""
        assert x["back"] == text and x["n"] == len(text)
        if x["form"] != "plain":
            a, b = sorted(h % (len(text) + 1) for h in fim.draws(1, str(x["doc_id"]))[:2])
            assert (x["prefix_chars"], x["middle_chars"]) == (a, b - a)


def test_index_converts_both_ways():
    for text in filter(None, TEXTS):
        raw = text.encode()
        index = fim.Exceptions(np.frombuffer(raw, np.uint8))
        assert len(index.at_byte) == sum(ord(c) > 127 for c in text)
        for at in range(len(text) + 1):
            byte = len(text[:at].encode())
            assert index.to_bytes(at) == byte and index.to_points(byte) == at


def test_text_that_is_not_utf8(spark):
    docs = spark.sql("select 4L doc_id, cast(X'61FF62C3' as string) text")
    assert fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).first()["back"] == "a�b�"


def mixture(rows, weights=(5, 2, 1), epochs=3):
    """(id, size, source_size, target, taken) by plain rounds of sharing anew."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest, light = total - sum(epochs * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped) or 1
        over = {s for s in order if s not in capped and rest * weight[s] > epochs * sizes[s] * light}
        if not over:
            break
        capped |= over
    out = []
    for s in order:
        target, budget = (epochs * sizes[s], epochs * sizes[s]) if s in capped else (rest * weight[s] / light, rest * weight[s] // light)
        own = sorted((int(hashlib.md5(f"13:{i}".encode()).hexdigest()[:15], 16), i, n) for i, t, n in rows if t == s)
        rounds, left = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        for _, i, n in own:
            take = min(max(left, 0), n)
            left -= n
            out.append((i, n, sizes[s], float(target), rounds * n + take))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_mixture_equals_brute_force(spark, seed):
    r = random.Random(seed)
    names = [None, "", "a", "b", "B", "é", "😀", *(f"s{i}" for i in range(30))][: [4, 37, 9][seed]]
    rows = [(i, "a" if r.random() < 0.4 else r.choice(names), r.choice([0, 1, 5, 200])) for i in range(700)] + [(9000, "zero", 0)]
    docs = spark.createDataFrame([(*x, 1, "p") for x in rows], "doc_id long, source string, size long, budget int, part string")
    want = mixture(rows)
    found = [mixing.mix(docs.repartition(n)) for n in (1, 13)]
    for f in found:
        assert f.columns == ["doc_id", "source", "size", "budget", "part", "source_size", "target", "taken"]
        assert sorted(tuple(x) for x in f.select("doc_id", "size", "source_size", "target", "taken").collect()) == want
    assert all(t <= 3 * n for _, n, _, _, t in want)


def test_mixture_edges(spark):
    kind = "doc_id long, source string, size long"
    assert mixing.mix(spark.createDataFrame([], kind)).count() == 0
    assert [x["taken"] for x in mixing.mix(spark.createDataFrame([(1, "a", 0), (2, None, None)], kind)).collect()] == [0, 0]
    same = mixing.mix(spark.createDataFrame([(1, "a", 7)] * 50 + [(None, "b", 7)] * 5, kind)).collect()
    for source, budget in (("a", 385 - 15 * 7), ("b", 15 * 7)):  # b is capped at three epochs
        assert sum(x["taken"] for x in same if x["source"] == source) == budget


def test_copies_hold_the_taken_words(spark):
    r = random.Random(4)
    rows = [(i, r.choice("abc"), " \n".join("w%d" % r.randrange(99) for _ in range(r.randrange(9)))) for i in range(90)] + [(99, "d", "x  y\tz"), (100, "d", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", mixing.word_count(F.col("text")))
    assert {x["doc_id"]: x["size"] for x in docs.collect()} == {i: len(SPACE.findall(t or "")) for i, _, t in rows}
    mixed = mixing.mix(docs)
    taken = {x["doc_id"]: x["taken"] for x in mixed.collect()}
    made: dict = {}
    for x in mixing.copies(mixed).collect():
        made[x["doc_id"]] = made.get(x["doc_id"], 0) + len(SPACE.findall(x["text"]))
    assert made == {i: n for i, n in taken.items() if n}
