"""Fields out of model responses."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.functions.strict_json import json_fields, json_list_size, printed_list
from taskloom.functions.text import is_blank, strip, text_or_empty


def draft_and_input(rows: DataFrame, col: str = "synthesis_result") -> DataFrame:
    """Draft problem and input; an unparsable response is the draft itself."""
    p = F.col("_p")
    return (
        rows.withColumn("_p", json_fields(F.col(col), "problem", "input"))
        .withColumn("draft_problem", F.when(p["ok"], text_or_empty(p["problem"])).otherwise(text_or_empty(F.col(col))))
        .withColumn("draft_input", F.when(p["ok"], text_or_empty(p["input"])).otherwise(""))
        .drop("_p")
    )


def story_fields(rows: DataFrame) -> DataFrame:
    """First of refined and draft that parses with a problem and a non-null input.

    Adds ``story_problem``, ``story_input`` and ``story_origin``; all null if neither does.
    """
    def valid(p):
        return p["ok"] & (text_or_empty(p["problem"]) != "") & p["input"].isNotNull()

    r, s = F.col("_r"), F.col("_s")
    pick = lambda field: F.when(valid(r), r[field]).when(valid(s), s[field])
    return (
        rows.withColumn("_r", json_fields(F.col("refined_result"), "problem", "input"))
        .withColumn("_s", json_fields(F.col("synthesis_result"), "problem", "input"))
        .withColumn("story_problem", pick("problem"))
        .withColumn("story_input", pick("input"))
        .withColumn("story_origin", F.when(valid(r), "refined").when(valid(s), "draft"))
        .drop("_r", "_s")
    )


def story_templates(rows: DataFrame) -> DataFrame:
    return story_fields(rows).where(F.col("story_problem").isNotNull())


def synth_records(rows: DataFrame) -> DataFrame:
    """Stories that can be run: the input must not be blank. Rating is filled later."""
    return (
        story_templates(rows)
        .where(~is_blank(F.col("story_input")))
        .select("id", "title", "type_id", "sample_idx", F.col("story_problem").alias("problem"),
                F.col("story_input").alias("input"), F.lit(0).alias("rating"))
    )


def parse_instrumented(rows: DataFrame, col: str = "instrument_result") -> DataFrame:
    parsed = rows.withColumn("_p", json_fields(F.col(col), "instrumented_code", "analysis", "trace_plan"))
    return parsed.withColumns({
        "code": F.col("_p.instrumented_code"),
        "analysis": text_or_empty(F.col("_p.analysis")),
        "trace_plan": text_or_empty(F.col("_p.trace_plan")),
    }).drop("_p")


def instrumented_code(rows: DataFrame, col: str = "instrument_result") -> DataFrame:
    """Per problem the first response (by ``seq``) that carries code."""
    usable = parse_instrumented(rows, col).where(text_or_empty(F.col("code")) != "")
    fields = ("language", "code", "analysis", "trace_plan")
    first = usable.groupBy("id").agg(F.min_by(F.struct(*fields), "seq").alias("_f"))
    return first.select("id", *[F.col(f"_f.{f}").alias(f) for f in fields])


def plan_size(rows: DataFrame, col: str = "instrument_result", out: str = "plan_entries") -> DataFrame:
    return rows.withColumn(out, json_list_size(F.col(col), "trace_plan"))


def classification_fields(rows: DataFrame, col: str = "raw") -> DataFrame:
    """Task code of a problem; the two levels feed type_level1 and type_level2."""
    p = F.col("_p")
    return (
        rows.withColumn("_p", json_fields(F.col(col), "core_step", "level1", "level2", "new", "reason"))
        .withColumns({
            "parse_ok": p["ok"],
            "core_step": text_or_empty(p["core_step"]),
            "type_level1": strip(text_or_empty(p["level1"])),
            "type_level2": strip(text_or_empty(p["level2"])),
            "is_new": F.lower(strip(text_or_empty(p["new"]))) == "true",
            "reason": text_or_empty(p["reason"]),
        })
        .drop("_p")
    )


def kernel_text(rows: DataFrame, col: str = "raw", question: str = "question") -> DataFrame:
    """``refined_question`` from ``{"text": …}``, else the question."""
    found = text_or_empty(F.col("_p.text"))
    return (
        rows.withColumn("_p", json_fields(F.col(col), "text"))
        .withColumn("refined_question", F.when(found != "", found).otherwise(text_or_empty(F.col(question))))
        .drop("_p")
    )


def generated_inputs(rows: DataFrame, col: str = "printed") -> DataFrame:
    """One row per printed test input; the level follows the place: 5 A, 5 B, then C."""
    level = F.when(F.col("place") < 5, "A").when(F.col("place") < 10, "B").otherwise("C")
    return rows.select(
        *[c for c in rows.columns if c != col], F.posexplode(printed_list(F.col(col))).alias("place", "input")
    ).withColumn("level", level)


def cot_fields(rows: DataFrame, col: str = "cot_result") -> DataFrame:
    p = F.col("_p")
    return (
        rows.withColumn("_p", json_fields(F.col(col), "verified", "num_steps", "reasoning", "mismatch_reason"))
        .withColumns({
            "parse_ok": p["ok"],
            "verified": F.lower(text_or_empty(p["verified"])) == "true",
            "num_steps": p["num_steps"].try_cast("int"),
            "reasoning": text_or_empty(p["reasoning"]),
            "mismatch_reason": text_or_empty(p["mismatch_reason"]),
        })
        .drop("_p")
    )
