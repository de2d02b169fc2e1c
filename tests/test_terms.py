"""The automaton's counts against one scan a term."""

import pytest
from pyspark.sql import functions as F

from taskloom.functions.lexicon import SPATIAL_WORDS, TEMPORAL_WORDS
from taskloom.functions.terms import term_counts
from taskloom.operators.corpus import corpus_features, rule_filter, rule_hints

GROUPS = {"temporal": TEMPORAL_WORDS, "spatial": SPATIAL_WORDS, "odd": ("aa", "aba", "é", "😀b", "aa")}


def _counted(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = rows.select("id", term_counts(F.col("text"), GROUPS).alias("n")).orderBy("id").collect()
    return [tuple(r["n"]) for r in found]


def test_counts(spark):
    texts = [
        None, "", "a", "aaaaa", "ababa abababa", "evolvevolve", "first, then next", "strengthen rows", " row row",
        "éé😀b😀b then\x00until", "at each step, per step", "x" * 200_000 + "matrix" * 1000, "aaaaa",
    ]
    assert _counted(spark, texts) == [tuple(sum((x or "").count(w) for w in g) for g in GROUPS.values()) for x in texts]
    assert _counted(spark, []) == []


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = docs.select("text", term_counts(F.lower("text"), GROUPS).alias("n")).collect()
    assert all(tuple(r["n"]) == tuple(sum((r["text"] or "").lower().count(w) for w in g) for g in GROUPS.values()) for r in found)


@pytest.mark.parametrize("terms", [(), ("a", "")])
def test_terms_must_not_be_empty(terms):
    with pytest.raises(ValueError):
        term_counts(F.lit("a"), {"g": terms})


def test_texts_pass_the_automaton_once(spark):
    docs = spark.createDataFrame([("then " * 100, "x")], "text string, quality_domain_txt string")
    kept = rule_filter(rule_hints(corpus_features(docs)))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and kept.count() == 1
