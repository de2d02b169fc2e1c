"""Countable quality rules for responses and instrumented code."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions.lexicon import TAXONOMY
from taskloom.functions.text import computed_once, lines, occurrences, strip, text_or_empty, token_count, tokens
from taskloom.operators.runs import MARK

_EDGE_MARKS = r"^[^\p{L}\p{N}\-+]+|[^\p{L}\p{N}]+$"


def taxonomy_valid(rows: DataFrame) -> DataFrame:
    """Add ``taxonomy_status``: new, bad_level1, bad_level2, mismatch or valid."""
    one, two = F.col("type_level1"), F.col("type_level2")
    status = (
        F.when(F.col("is_new"), "new")
        .when(~one.rlike("^[1-5]$"), "bad_level1")
        .when(~two.isin(*TAXONOMY), "bad_level2")
        .when(F.substring_index(two, ".", 1) != one, "mismatch")
        .otherwise("valid")
    )
    return rows.withColumn("taxonomy_status", status)


def length_window(rows: DataFrame, col: str, low: int, high: int | None = None) -> DataFrame:
    """Add ``words`` and ``in_window``."""
    words = token_count(text_or_empty(F.col(col)))
    ok = F.col("words") >= low
    return rows.withColumn("words", words).withColumn("in_window", ok & (F.col("words") <= high) if high else ok)


def input_preserved(draft_input: Column, refined_input: Column) -> Column:
    return draft_input.eqNullSafe(refined_input)


def value_coverage(rows: DataFrame, values: str, text: str) -> DataFrame:
    """Distinct values of ``values`` and how many stand in ``text`` as whole tokens.

    Marks around a token are ignored. Set intersection, so cost stays linear.
    """
    bare = F.transform(tokens(text_or_empty(F.col(text))), lambda x: F.regexp_replace(x, _EDGE_MARKS, ""))
    wanted = F.array_distinct(tokens(text_or_empty(F.col(values))))
    return (
        rows.withColumn("_wanted", wanted)
        .withColumn("value_count", F.size("_wanted"))
        .withColumn("values_found", F.size(F.array_intersect("_wanted", F.concat(bare, tokens(text_or_empty(F.col(text)))))))
        .withColumn("coverage", F.col("values_found") / F.greatest("value_count", F.lit(1)))
        .drop("_wanted")
    )


def banned_terms(rows: DataFrame, col: str, terms: tuple[str, ...]) -> DataFrame:
    """One row per banned term found as a whole word, without regard to case."""
    text = F.lower(text_or_empty(F.col(col)))

    def found(term: str) -> Column:
        # The literal comes first, so only its hits look around; absent terms never reach the pattern.
        whole_word = rf"\Q{term}\E(?<![\p{{L}}\p{{N}}_]\Q{term}\E)(?![\p{{L}}\p{{N}}_])"
        return F.when(F.contains("_low", F.lit(term)) & F.col("_low").rlike(whole_word), F.lit(term))

    hits = F.array_compact(F.array(*[found(term) for term in terms]))
    lowered = rows.withColumn("_low", computed_once(text))
    return lowered.withColumn("_hits", computed_once(hits)).withColumn("term", F.explode("_hits")).drop("_low", "_hits")


def step_check(rows: DataFrame) -> DataFrame:
    """Add ``step_status``: no_steps, gap, wrong_count or ok."""
    found = F.regexp_extract_all("reasoning", F.lit(r"(?md)^Step (\d{1,9}):"), F.lit(1)).cast("array<int>")
    n = F.size("_steps")
    status = (
        F.when(n == 0, "no_steps")
        .when(F.col("_steps") != F.sequence(F.lit(1), F.greatest(n, F.lit(1))), "gap")
        .when(~F.coalesce(F.col("num_steps") == n, F.lit(False)), "wrong_count")
        .otherwise("ok")
    )
    return rows.withColumn("_steps", found).withColumn("steps_found", n).withColumn("step_status", status).drop("_steps")


def test_suite_mix(inputs: DataFrame, key: list[str], max_len: int = 1000) -> DataFrame:
    """Per suite: inputs per level, repeats and over-long inputs. Repeats are counted
    through a pre-grouping on the input, never by collecting a suite."""
    level = lambda x: F.sum(F.when(F.col("level") == x, F.col("n")).otherwise(0))
    by_input = inputs.groupBy(*key, F.sha2("input", 256).alias("_i"), "level", (F.length("input") > max_len).alias("_long")).agg(
        F.count(F.lit(1)).alias("n")
    )
    by_text = by_input.groupBy(*key, "_i").agg(
        level("A").alias("a"), level("B").alias("b"), level("C").alias("c"),
        F.sum("n").alias("n"), F.max("_long").alias("_long"),
    )
    mix = by_text.groupBy(*key).agg(
        F.sum("a").alias("level_a"), F.sum("b").alias("level_b"), F.sum("c").alias("level_c"),
        F.sum(F.col("n") - 1).alias("repeats"),
        F.sum(F.when(F.col("_long"), F.col("n")).otherwise(0)).alias("over_long"),
    )
    return mix.withColumn("mix_ok", (F.col("level_a") == 5) & (F.col("level_b") == 5) & (F.col("level_c") == 20))


def instrument_readonly(rows: DataFrame, key: list[str], original: str = "original", code: str = "code") -> DataFrame:
    """Bag check per program: lost original lines and added lines without the marker.

    Blank lines do not count. One scan gives the lines of both sides, and one
    grouping on the line compares them.
    """
    def signed(col: str, sign: int) -> Column:
        return F.transform(
            lines(text_or_empty(F.col(col))), lambda x: F.struct(strip(x).alias("line"), F.lit(sign).alias("sign"))
        )

    both = rows.select(*key, F.inline(F.concat(signed(original, 1), signed(code, -1)))).where("line <> ''")
    net = both.groupBy(*key, "line").agg(F.sum("sign").alias("net"))
    marked = F.contains("line", F.lit(MARK))
    per = net.groupBy(*key).agg(
        F.sum(F.greatest("net", F.lit(0))).alias("lost_lines"),
        F.sum(F.when(~marked, F.greatest(-F.col("net"), F.lit(0))).otherwise(0)).alias("unmarked_lines"),
    )
    return per.withColumn("read_only", (F.col("lost_lines") == 0) & (F.col("unmarked_lines") == 0))


def trace_plan_parity(rows: DataFrame, code: str = "code") -> DataFrame:
    """Add ``trace_statements`` and ``plan_matches``; needs ``plan_entries``."""
    return rows.withColumn("trace_statements", occurrences(text_or_empty(F.col(code)), MARK)).withColumn(
        "plan_matches", F.coalesce(F.col("plan_entries") == F.col("trace_statements"), F.lit(False))
    )
