import pytest

from taskloom.operators.pairing import pair_stats, pool_sizes, route_problems, typed_pairs, typed_picks


@pytest.fixture(scope="module")
def data(spark):
    sizes = {1: 20, 2: 300, 3: 7}  # types 4 and 5 are empty
    listing = [(t * 1000 + i, t, 0) for t, n in sizes.items() for i in range(n)]
    problems = [(f"p{i}", level) for i, level in enumerate(["1", "2", "3", "4", "5", "", None, "x", " 2 ", "9"] * 3)]
    listing = spark.createDataFrame(listing, "corpus_id bigint, type_id int, slot int").cache()
    problems = spark.createDataFrame(problems, "id string, type_level1 string").cache()
    texts = listing.selectExpr("corpus_id", "concat('text ', corpus_id) AS corpus_text")
    return sizes, listing, problems, texts


@pytest.mark.parametrize("small_pool", [0, 50, 10_000])
@pytest.mark.parametrize("k", [1, 3, 45])
def test_draws(spark, data, k, small_pool):
    sizes, listing, problems, _ = data
    rows = typed_picks(problems, listing, k, small_pool=small_pool).collect()
    by_problem = {}
    for r in rows:
        by_problem.setdefault(r.id, []).append(r)
    assert len(by_problem) == 30
    for picks in by_problem.values():
        picks.sort(key=lambda r: r.sample_idx)
        assert [r.sample_idx for r in picks] == list(range(k))
        kind = picks[0].type_id
        n = sizes.get(kind, sum(sizes.values()))
        ids = [r.corpus_id for r in picks]
        for start in range(0, k, n):  # each pass over the pool is free of repeats
            part = ids[start : start + n]
            assert len(set(part)) == len(part)
        if kind in sizes:
            assert {i // 1000 for i in ids} == {kind}
            assert picks[0].route == "typed"
        else:
            assert picks[0].route == "fallback"


def test_same_draws_for_any_partitioning(spark, data):
    _, listing, problems, _ = data
    results = set()
    for parts in (1, 7, 64):
        rows = typed_picks(problems.repartition(parts), listing.repartition(parts), 4).collect()
        results.add(tuple(sorted((r.id, r.sample_idx, r.corpus_id) for r in rows)))
    assert len(results) == 1


def test_strict_skips_and_empty_corpus(spark, data):
    sizes, listing, problems, texts = data
    kinds = {r.type_id for r in typed_picks(problems, listing, 2, strict=True).collect()}
    assert kinds == {1, 2, 3}
    none = listing.where("type_id > 5")
    assert typed_picks(problems, none, 2).count() == 0
    assert {r.route for r in route_problems(problems, pool_sizes(none)).collect()} == {"skipped"}
    stats = {r.route: r.n for r in pair_stats(problems, sizes).collect()}
    assert stats == {"1": 3, "2": 6, "3": 15, "fallback": 6}


def test_pairs_carry_texts_through_hot_picks(spark, data):
    """Seven texts serve many problems, so every text is a hot key here."""
    _, listing, problems, texts = data
    rows = typed_pairs(problems, listing, texts, 5, hot_rows=2).collect()
    assert len(rows) == 150
    assert all(r.corpus_text == f"text {r.corpus_id}" for r in rows)
