"""SimHash, substring and line dedup, and decontamination, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from brute import components, contamination, fingerprint, substring
from taskloom.llm import decontam, linededup, simhash
from taskloom.llm import substring as sub

SCHEMA = "doc_id long, text string, key string, body string, id long, row int, lines string, kind int"


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "k", "b", 7, 1, "l", 0) for i, t in rows], SCHEMA)


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def near_copies():
    rows, r = [], random.Random(3)
    for g in range(12):
        base = prose(g, 150).split()
        for k in range(r.randrange(1, 9)):
            own = list(base)
            for _ in range(k):
                own[r.randrange(len(own))] = f"x{r.randrange(99)}"
            rows.append((100 * g + k, " ".join(own)))
    return rows + [(5000, None), (5001, ""), (5002, "one two"), (5003, "ONE two"), (5004, "É é")]


def test_simhash_equals_brute_force(spark):
    rows = near_copies()
    found = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(table(spark, rows)).collect()}
    assert found == components(rows)
    assert len({c for _, c in found.values()}) < len(rows)


@pytest.mark.parametrize("parts", [2, 3, 4, 5])
def test_every_number_of_parts_finds_all_links(spark, parts):
    r = random.Random(parts)
    seeds = [r.getrandbits(64) for _ in range(40)]
    prints = {s ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))) for s in seeds for _ in range(6)}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    distinct = spark.createDataFrame([(p, 1) for p in signed], "fp long, n long").repartition(3)
    links = {tuple(sorted((x["a"], x["b"]))) for x in simhash.links(distinct, 4, parts).collect()}
    close = lambda a, b: ((a ^ b) % 2**64).bit_count() <= 4
    assert all(close(a, b) for a, b in links)

    def classes(pairs):
        root = {p: p for p in signed}

        def find(p):
            while root[p] != p:
                p = root[p]
            return p

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for p in signed:
            groups.setdefault(find(p), set()).add(p)
        return sorted(map(sorted, groups.values()))

    assert classes(links) == classes([(a, b) for a in signed for b in signed if a < b and close(a, b)])


def test_thresholds_sum_to_the_bound():
    import numpy as np

    r = np.random.default_rng(1)
    fps = r.integers(0, 2**64, 50, np.uint64)
    groups = [list(range(16 * i, 16 * i + 16)) for i in range(4)]
    balls = [np.ones((5, 1 << 16), np.float32) * (i + 1) for i in range(4)]
    balls[0] *= 1e6  # a part that holds too common values gets no probe
    units = simhash.allocate(fps, groups, balls, 4)
    assert (units.sum(axis=1) == 5).all() and (units[:, 0] == 0).all()


def test_simhash_null_ids_repeats_and_empty(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "quite other words here now")]
    found = simhash.near_duplicates(table(spark, rows))
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in found.collect()) == [(-1, -1), (-1, 3), (3, 3), (3, 3)]
    kept = simhash.keep_one(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 3]
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_fingerprint_of_long_text():
    text = prose(1, 9000)
    assert simhash.fingerprint(text.encode()) == fingerprint(text)


def repeats():
    r = random.Random(5)
    shared = [prose(50 + i, 30) for i in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(200 + i, r.randrange(0, 60)), r.choice(shared), prose(400 + i, r.randrange(5)), r.choice(shared)[:80]]
        rows.append((i, "  \n".join(parts)))
    rows += [(70, rows[3][1]), (71, "a " * 90), (72, "a a"), (73, None), (74, ""), (75, prose(9, 3000) + " " + shared[0]), (76, "nb\u00a0sp\x1cx " * 30)]
    return rows


def test_substring_equals_brute_force(spark):
    rows = repeats()
    found = sub.remove_repeats(table(spark, rows).repartition(5))
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect())
    assert got == substring(rows)
    assert any(r["n_removed"] for r in found.collect())


def test_substring_full_sketch_loses_nothing(spark, monkeypatch):
    from taskloom.llm import _sketch

    monkeypatch.setattr(_sketch, "lookup", lambda sent, bits: lambda keys: keys == keys)
    rows = repeats()
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sub.remove_repeats(table(spark, rows)).collect())
    assert got == substring(rows)


def test_substring_groups_follow_the_text(spark, monkeypatch):
    assert [sub.groups_for(n << 30, 8) for n in (0, 1, 2, 4, 1 << 10)] == [32, 32, 64, 128, 1 << 15]
    monkeypatch.setattr(sub, "GROUP_BYTES", 500)
    rows = repeats()
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sub.remove_repeats(table(spark, rows).repartition(5)).collect())
    assert got == substring(rows)


def test_substring_repeated_rows_null_ids_and_empty(spark):
    text = prose(1, 25)
    rows = [(4, text), (4, text), (None, text)]
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in sub.remove_repeats(table(spark, rows).coalesce(1)).collect())
    assert got == [(-1, 0), (4, 25), (4, 25)]
    assert sub.remove_repeats(table(spark, [])).count() == 0


def items():
    return [(1, prose(50, 20)), (2, prose(51, 13)), (10, "Short ITEM of five-5"), (11, None), (12, ""), (13, prose(50, 15)), (None, prose(52, 14)), (14, "lone")]


def test_decontamination_equals_brute_force(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    rows = [(i, f"{prose(i, 40)} {items()[i % 3][1].upper()}! {prose(9 + i, 30 * i)}") for i in range(12)]
    rows += [(20, prose(50, 14)), (21, None), (22, ""), (23, "a lone word"), (24, prose(52, 14) + "É"), (25, prose(52, 14)), (26, "alone LONE")]
    found = decontam.judge(table(spark, rows), bench)
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in found.collect())
    assert got == sorted(contamination(rows, [x for x in items()]), key=lambda x: x[0]) or got == sorted(
        [(d, n, h, [i for i in own if i != "None"], c) for d, n, h, own, c in contamination(rows, items())])
    kept = decontam.drop_contaminated(table(spark, rows), bench)
    assert kept.columns == table(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [d for d, *_, c in got if not c]


def test_decontamination_repeats_nulls_and_empty(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    rows = [(1, prose(50, 20)), (1, prose(50, 20)), (1, "clean text"), (None, prose(50, 20))]
    got = sorted((r["doc_id"] or -1, r["n_hit"]) for r in decontam.judge(table(spark, rows), bench).collect())
    assert got == [(-1, 20), (1, 0), (1, 20), (1, 20)]
    assert [r["text"] for r in decontam.drop_contaminated(table(spark, rows), bench).collect()] == ["clean text"]
    assert decontam.judge(table(spark, []), bench).count() == 0
    none = decontam.judge(table(spark, rows), bench.limit(0))
    assert [r["n_hit"] for r in none.collect()] == [0] * 4


def test_decontamination_beyond_the_broadcast_bound(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    rows = [(i, f"{prose(i, 40)} {items()[i % 3][1]}") for i in range(6)]
    both = [sorted((r["doc_id"], r["n_hit"]) for r in decontam.judge(table(spark, rows), bench, broadcast_rows=b).collect()) for b in (0, 10**6)]
    assert both[0] == both[1]


def test_spans_are_removed(spark):
    df = spark.range(1).select(F.split(F.lit("a b c d"), " ").alias("w"), F.expr("array(named_struct('at', 1, 'n', 2))").alias("h"))
    assert df.select(decontam.without_spans(F.col("w"), F.col("h"))).first()[0] == "a d"


def test_line_templates(spark):
    rows = [
        (5, "Report 17 was sent to Anna today\nonly here one"), (6, "x y z own\nReport 18 was sent to Anna today"),
        (7, "Report 99 was sent to Anna today\nReport 98 was sent to Anna today\nlast"), (8, "Report 12 was sent to Berta today\n\nend of it all"),
        (9, "short line\nshort line"), (10, "short line"), (11, "short line"), (12, None), (13, ""), (14, "in two docs only"), (15, "in two docs only"),
    ]
    found = linededup.drop_recurring(table(spark, rows).repartition(4))
    assert found.columns == [*table(spark, rows).columns, "lines_"]
    got = {r["doc_id"]: (r["text"], r["lines_"]["n_lines"], r["lines_"]["n_dropped"]) for r in found.collect()}
    assert got[5] == ("Report 17 was sent to Anna today\nonly here one", 2, 0)  # the first document keeps its line
    assert got[6] == ("x y z own", 2, 1)
    assert got[7] == ("last", 3, 2)
    assert got[8] == ("\nend of it all", 3, 1)  # one place differs from the template
    for i in (9, 10, 11, 14, 15):
        assert got[i][2] == 0
    assert got[12] == (None, 1, 0) and got[13] == ("", 1, 0)


def test_line_templates_repeats_and_empty(spark):
    line = "the same words in every one"
    rows = [(1, line), (1, line), (None, line), (2, "other words stand in this")]
    got = sorted((r["doc_id"] or -1, r["text"]) for r in linededup.drop_recurring(table(spark, rows)).collect())
    assert got == [(-1, line), (1, ""), (1, ""), (2, "other words stand in this")]
    assert linededup.drop_recurring(table(spark, [])).count() == 0
