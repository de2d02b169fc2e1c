"""Record shaping: problem texts, solutions, names and ratings."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.functions.hashing import md5_bucket, md5_key
from taskloom.functions.language import language_detect
from taskloom.functions.text import is_blank, strip, text_or_empty
from taskloom.operators.numbering import number_rows, range_bucket, top_per_key


def _filled(col: Column) -> Column:
    return F.coalesce(col != "", F.lit(False))


def _part(label: str, col: Column) -> Column:
    """``label`` and the value, or null (which concat_ws leaves out)."""
    return F.when(_filled(col), F.concat(F.lit(label), col))


def problem_text_classify() -> Column:
    """Text for the problem classifier: title, description, formats, first example."""
    first = F.try_element_at("examples", F.lit(1))
    example = F.when(
        F.size("examples") > 0,
        F.concat(
            F.lit("\n\nExamples:\nExample 1:"),
            text_or_empty(_part("\nInput: ", first["input"])),
            text_or_empty(_part("\nOutput: ", first["output"])),
        ),
    )
    return F.concat_ws(
        "\n",
        _part("### ", F.col("title")),
        _part("\n", F.col("description")),
        _part("\n\nInput format:\n", F.col("input_format")),
        _part("\n\nOutput format:\n", F.col("output_format")),
        example,
    )


def problem_text(with_note: bool = False) -> Column:
    """Full problem: kernel or question, formats and every example, numbered from 1."""
    def shown(e: Column, i: Column) -> Column:
        return F.concat(
            F.lit("  Example "), (i + 1).cast("string"),
            F.lit(":\n    Input:  "), strip(text_or_empty(e["input"])),
            F.lit("\n    Output: "), strip(text_or_empty(e["output"])),
        )

    examples = F.when(
        F.size("examples") > 0,
        F.concat(F.lit("\nExamples:\n"), F.array_join(F.transform("examples", shown), "\n")),
    )
    question = F.when(_filled(F.col("refined_question")), F.col("refined_question")).otherwise(
        text_or_empty(F.col("question"))
    )
    parts = [
        question,
        _part("\nInput format:\n", F.col("input_format")),
        _part("\nOutput format:\n", F.col("output_format")),
        examples,
    ]
    if with_note:
        parts.append(_part("\nNote:\n", F.col("note")))
    return F.concat_ws("\n", *parts)


def tags_text() -> Column:
    return F.when(F.size("tags") > 0, F.array_join("tags", ", ")).otherwise("None")


def editorial_text() -> Column:
    """Language and source of the first solution."""
    first = F.try_element_at("accepted_solutions", F.lit(1))
    return F.when(
        F.size("accepted_solutions") > 0,
        F.concat(
            F.lit("Reference code ("), F.coalesce(first["programmingLanguage"], F.lit("Unknown")),
            F.lit("):\n"), F.coalesce(first["source"], F.lit("N/A")),
        ),
    ).otherwise("None")


def solution_rows(qa: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
    """One row per (problem, solution); a problem without any keeps one row with null ``pos``."""
    return qa.select(
        *keep, F.posexplode_outer("accepted_solutions").alias("pos", "_s")
    ).select(*keep, F.col("pos").cast("bigint"), "_s.source", "_s.og_source", "_s.programmingLanguage", "_s.submission_id")


def solution_status(
    solutions: DataFrame, max_code_len: int | None = 8000, allowed: list[str] | None = None
) -> DataFrame:
    """Add ``code``, ``language`` and ``status``, tested in the order empty, language, length."""
    code = F.when(_filled(F.col("source")), F.col("source")).otherwise(text_or_empty(F.col("og_source")))
    language = language_detect(F.col("programmingLanguage"))
    status = F.when(is_blank(F.col("code")), "empty")
    if allowed:
        status = status.when(~F.col("language").isin(*allowed), "language")
    if max_code_len:
        status = status.when(F.length("code") > max_code_len, "too_long")
    return (
        solutions.withColumn("code", code)
        .withColumn("language", language)
        .withColumn("status", status.otherwise("kept"))
    )


def expand_solutions(
    solutions: DataFrame,
    max_solutions: int | None = None,
    max_code_len: int | None = 8000,
    allowed: list[str] | None = None,
    seed: int = 42,
    key: str = "id",
) -> DataFrame:
    """Usable solutions per problem, renumbered from 0 after filtering and sampling.

    ``solutions`` has one row per (``key``, pos); where problem ids repeat, the key names the record. With ``max_solutions`` a seeded
    sample is kept and numbered in sample order; otherwise the order is ``pos``.
    """
    kept = solution_status(solutions, max_code_len, allowed).where("status = 'kept'").drop("status")
    if max_solutions is None:
        bucket = range_bucket(solutions, "pos")
        return number_rows(kept, [key], ["pos"], bucket, "solution_idx")
    # At most M per problem: in position order where all fit, in sample order where not.
    drawn = kept.withColumn("_draw", md5_key(F.lit(seed), F.col("id"), F.col("pos")))
    few = top_per_key(drawn, [key], ["_draw"], max_solutions + 1, md5_bucket(F.col("_draw"), 2), "_rank")
    group = Window.partitionBy(key)  # holds max_solutions + 1 rows at most
    sized = few.withColumn("_all", F.count(F.lit(1)).over(group)).where(F.col("_rank") < max_solutions)
    by_pos = F.when(F.col("_all") <= max_solutions, F.col("pos"))
    order = group.orderBy(by_pos.asc_nulls_last(), "_draw")
    return sized.withColumn("solution_idx", (F.row_number().over(order) - 1).cast("bigint")).drop("_draw", "_rank", "_all")


def expand_funnel(
    solutions: DataFrame, max_code_len: int | None = 8000, allowed: list[str] | None = None
) -> DataFrame:
    """Rows per status; a problem without solutions counts once as empty."""
    return solution_status(solutions, max_code_len, allowed).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def first_code(solutions: DataFrame) -> DataFrame:
    """Per problem the first non-empty ``source`` by (seq, pos). White space counts as code."""
    return (
        solutions.where(_filled(F.col("source")))
        .groupBy("id")
        .agg(F.min_by(F.struct("source", "programmingLanguage"), F.struct("seq", "pos")).alias("_c"))
        .select("id", F.col("_c.source").alias("code"),
                text_or_empty(F.col("_c.programmingLanguage")).alias("programmingLanguage"))
    )


def rating_lookup(qa: DataFrame) -> DataFrame:
    """id → rating; the last record wins and null counts as 0."""
    return qa.groupBy("id").agg(F.max_by(F.coalesce("rating", F.lit(0)), "seq").alias("rating"))

