"""Corpus rules: features, type hints, buckets and classified rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions import text as t
from taskloom.functions.lexicon import NUMERIC_DOMAINS, SPATIAL_WORDS, TEMPORAL_WORDS
from taskloom.functions.strict_json import parse_last_block
from taskloom.functions.terms import bounded_batches, term_counts

# (?d): only the line feed ends a line; (?m): ^ at each line.
_TABLE = r"(?d)\|.{2,}\|"
_GAP = rf"[[{t.WS}]&&[^\n]]"
_LIST_LINE = rf"(?mdU)^{_GAP}*+(?:\d+[.):]|[-*•]){_GAP}++[^{t.WS}]"
_WORDS = {"temporal_score": TEMPORAL_WORDS, "spatial_score": SPATIAL_WORDS}


def corpus_features(corpus: DataFrame) -> DataFrame:
    """Measure each text in one narrow pass; the word lists are counted together by an automaton.

    Adds text_len, token_count, digit_tokens, numeric_ratio, has_table,
    list_lines, line_count, list_density, temporal_score, spatial_score, is_prose.
    """
    bounded_batches(corpus.sparkSession)
    stripped = corpus.withColumn("text", t.computed_once(t.strip(t.text_or_empty(F.col("text")))))
    lowered = stripped.withColumn("_lower", t.computed_once(F.lower("text")))
    scored = lowered.withColumn("_scores", t.computed_once(term_counts(F.col("_lower"), _WORDS)))
    measured = scored.select(
        "*",
        t.computed_once(F.length("text")).alias("text_len"),
        t.token_count(F.col("_lower")).alias("token_count"),
        t.digit_token_count(F.col("_lower")).alias("digit_tokens"),
        F.col("text").rlike(_TABLE).alias("has_table"),
        F.regexp_count("text", F.lit(_LIST_LINE)).alias("list_lines"),
        (t.occurrences(F.col("text"), "\n") + 1).alias("line_count"),
        F.col("_scores.temporal_score"),
        F.col("_scores.spatial_score"),
    ).drop("_lower", "_scores")
    ratios = measured.withColumns({
        "numeric_ratio": F.col("digit_tokens") / F.greatest("token_count", F.lit(1)),
        "list_density": F.col("list_lines") / F.col("line_count"),
    })
    return ratios.withColumn(
        "is_prose",
        (F.col("text_len") >= 400) & ~F.col("has_table")
        & (F.col("list_density") < 0.15) & (F.col("numeric_ratio") < 0.25),
    )


def rule_hints(features: DataFrame, domain: str = "quality_domain_txt") -> DataFrame:
    """Add ``rule_hints``: sorted types 1..5 that the rules suggest."""
    tests = {
        1: F.col("spatial_score") >= 4,
        2: F.col("is_prose"),
        3: (F.col("numeric_ratio") >= 0.07) | F.coalesce(F.col(domain).isin(*NUMERIC_DOMAINS), F.lit(False)),
        4: F.col("has_table") | (F.col("list_density") >= 0.20),
        5: F.col("temporal_score") >= 4,
    }
    hints = F.array_compact(F.array(*[F.when(test, F.lit(k)) for k, test in tests.items()]))
    none = F.array().cast("array<int>")
    return features.withColumn("rule_hints", F.when(F.col("text_len") < 200, none).otherwise(hints))


def rule_status(hinted: DataFrame) -> DataFrame:
    """Add ``status``: empty, no_hint or kept."""
    status = F.when(F.col("text") == "", "empty").when(F.size("rule_hints") == 0, "no_hint")
    return hinted.withColumn("status", status.otherwise("kept"))


def rule_filter(hinted: DataFrame) -> DataFrame:
    return rule_status(hinted).where("status = 'kept'").drop("status")


def suitable_types(listed: Column) -> Column:
    """Distinct sorted types 1..5 out of listed values in text form."""
    digits = F.filter(listed, lambda x: x.rlike("^0*[1-5]$"))
    return F.array_sort(F.array_distinct(F.transform(digits, lambda x: F.right(x, F.lit(1)).cast("int"))))


def classified_corpus(
    requests: DataFrame, responses: DataFrame, key: str = "request_id", balanced: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Every answered request with its parsed types, parse failures included.

    ``key`` is unique on both sides; ``keep`` names further request columns.
    """
    answered = requests.join(responses.select(key, F.col("raw").alias("raw_output")), key)
    parsed = answered.withColumn("_p", parse_last_block(F.col("raw_output"), balanced))
    return parsed.select(
        key, *keep, "text", "rule_hints",
        suitable_types(F.col("_p.types")).alias("suitable_types"),
        F.col("_p.reasons").alias("reasons"),
        "raw_output",
        F.col("_p.ok").alias("parse_ok"),
        F.col("_p.origin").alias("parse_origin"),
        F.col("_p.matched_inner").alias("matched_inner"),
    )


def corpus_texts(classified: DataFrame, corpus_id: str, max_len: int = 4096) -> DataFrame:
    """corpus_id → text for pairing; empty texts are dropped."""
    kept = classified.where(~t.is_blank(F.col("text")))
    return kept.select(
        F.col(corpus_id).alias("corpus_id"), t.truncate(t.strip(F.col("text")), max_len).alias("corpus_text")
    )


def type_listing(classified: DataFrame, corpus_id: str) -> DataFrame:
    """One narrow row per (text, listed type); ``slot`` is the place in the list, so repeats stay.

    Reads no text: use it on tables whose empty texts are already dropped.
    """
    rows = classified.select(F.col(corpus_id).alias("corpus_id"), F.posexplode("suitable_types").alias("slot", "_type"))
    typed = rows.withColumn("type_id", F.col("_type").try_cast("int")).drop("_type")
    return typed.where(F.col("type_id").between(1, 5))


def type_buckets(classified: DataFrame, corpus_id: str, max_len: int = 4096) -> DataFrame:
    """The buckets with their texts: one row per (text, listed type)."""
    kept = classified.where(~t.is_blank(F.col("text")))
    text = t.truncate(t.strip(F.col("text")), max_len).alias("corpus_text")
    rows = kept.select(
        F.col(corpus_id).alias("corpus_id"), text, F.posexplode("suitable_types").alias("slot", "_type")
    )
    typed = rows.withColumn("type_id", F.col("_type").try_cast("int")).drop("_type")
    return typed.where(F.col("type_id").between(1, 5))


def bucket_counts(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("type_id").agg(F.count(F.lit(1)).alias("entries"))


def hint_vs_model(classified: DataFrame) -> DataFrame:
    """Per type how often rule and model agree, the model adds it, or drops it."""
    rule, model = F.col("rule_hints"), F.col("suitable_types")
    tagged = classified.select(F.explode(F.concat(
        F.transform(F.array_intersect(rule, model), lambda x: F.struct(x.alias("type_id"), F.lit("agreed").alias("outcome"))),
        F.transform(F.array_except(rule, model), lambda x: F.struct(x.alias("type_id"), F.lit("dropped").alias("outcome"))),
        F.transform(F.array_except(model, rule), lambda x: F.struct(x.alias("type_id"), F.lit("added").alias("outcome"))),
    )).alias("_t"))
    return tagged.groupBy("_t.type_id", "_t.outcome").agg(F.count(F.lit(1)).alias("n"))
