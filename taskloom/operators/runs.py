"""Execution outcomes and trace lines."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions.text import computed_once, is_blank, lines, strip, strip_left, text_or_empty

MARK = "[TRACE]"
MAX_TRACE_LINES = 20
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
_INTEGER = r"^[+-]?\d+$"
# Marker, label, then " | key=value" parts.
_WELL_FORMED = r"^\[TRACE\] [^|=]*[^|=\s](?:\s\|\s[^|=]+=.*)*$"


def golden_outputs(runs: DataFrame) -> DataFrame:
    """Successful runs with output, as eval cases."""
    kept = runs.where((F.col("return_code") == 0) & ~is_blank(F.col("stdout")))
    return kept.withColumn("expected_output", strip(F.col("stdout"))).withColumn("source", F.lit("synthesized"))


def _is_trace(line: Column) -> Column:
    return F.startswith(strip_left(line), F.lit(MARK))


def split_trace(runs: DataFrame, col: str = "stdout") -> DataFrame:
    """Add ``traces`` (stripped, in order) and ``actual_output`` (the rest, stripped)."""
    out = lines(text_or_empty(F.col(col)))
    rows = runs.withColumn("_lines", computed_once(out))
    return rows.withColumn("traces", computed_once(F.transform(F.filter("_lines", _is_trace), strip))).withColumn(
        "actual_output", computed_once(strip(F.array_join(F.filter("_lines", lambda x: ~_is_trace(x)), "\n")))
    ).drop("_lines")


def output_match(runs: DataFrame) -> DataFrame:
    """Add ``success`` (code 0 and some stdout) and ``output_matched``."""
    return runs.withColumn(
        "success", F.coalesce((F.col("return_code") == 0) & (F.col("stdout") != ""), F.lit(False))
    ).withColumn("output_matched", strip(F.col("actual_output")) == strip(text_or_empty(F.col("expected_output"))))


def answer_match(actual: Column, expected: Column) -> Column:
    """Equal after stripping; a fractional expected number allows a relative error below 1%."""
    a, e = strip(text_or_empty(actual)), strip(text_or_empty(expected))
    x, y = a.try_cast("double"), e.try_cast("double")
    close = F.abs(x - y) < F.lit(0.01) * F.abs(y)
    fractional = a.rlike(_NUMBER) & e.rlike(_NUMBER) & ~e.rlike(_INTEGER)
    return (a == e) | F.when(fractional, F.coalesce(close | (x == y), F.lit(False))).otherwise(F.lit(False))


def run_status(jobs: DataFrame, done: str = "is_done") -> DataFrame:
    """Add ``run_status``, tested in the order done, no_code, fail, success, mismatch."""
    status = (
        F.when(F.col(done), "done")
        .when(F.col("code").isNull(), "no_code")
        .when(~F.coalesce("success", F.lit(False)), "fail")
        .when(F.col("output_matched"), "success")
        .otherwise("mismatch")
    )
    return jobs.withColumn("run_status", status)


def run_funnel(jobs: DataFrame) -> DataFrame:
    return run_status(jobs).groupBy("run_status").agg(F.count(F.lit(1)).alias("n"))


def trace_events(runs: DataFrame) -> DataFrame:
    """One row per trace line: label, key/value pairs and the same as a map.

    The last of a repeated key wins.
    """
    rows = runs.select("seq", "problem_id", F.posexplode("traces").alias("line_no", "line"))
    body = strip(F.substring(F.col("line"), len(MARK) + 1, 2_147_483_647))  # of any line, stripped or not
    pair = lambda p: F.struct(
        strip(F.substring_index(p, "=", 1)).alias("key"),
        strip(F.substring(p, F.locate("=", p) + 1, F.length(p))).alias("value"),
    )
    with_eq = F.filter(F.slice("_parts", F.lit(2), F.greatest(F.size("_parts") - 1, F.lit(0))), lambda p: F.contains(p, F.lit("=")))

    def last_of_key(p: Column, i: Column) -> Column:
        later = F.slice("_pairs", i + 2, F.size("_pairs"))
        return ~F.exists(later, lambda q: q["key"] == p["key"])

    return (
        rows.withColumn("_parts", computed_once(F.split(body, r"\s\|\s", -1)))
        .withColumn("label", strip(F.element_at("_parts", 1)))
        .withColumn("_pairs", computed_once(F.transform(with_eq, pair)))
        .withColumn("pairs", computed_once(F.filter("_pairs", last_of_key)))
        .withColumn("fields", F.map_from_entries("pairs"))
        .drop("_parts", "_pairs")
    )


def _at(events: DataFrame) -> DataFrame:
    return events.withColumn("_at", F.struct("seq", "line_no"))


def trace_key_stats(events: DataFrame) -> DataFrame:
    """Per problem, label and key: occurrences, first and last value in run order."""
    rows = _at(events).select("problem_id", "label", "_at", F.inline("pairs"))
    return rows.groupBy("problem_id", "label", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("value", "_at").alias("first_value"),
        F.max_by("value", "_at").alias("last_value"),
    )


def trace_label_stats(events: DataFrame) -> DataFrame:
    """Per problem and label: events and distinct keys, pre-grouped by key; the events are made once.

    Rows without a problem count no keys.
    """
    pair = ["problem_id", "label"]
    event = F.array(F.lit(None).cast("string"))  # a null key, which no pair has, stands for the event itself
    keys = F.concat(event, F.transform("pairs", lambda p: p["key"]))
    counted = events.select(*pair, F.explode(keys).alias("key")).groupBy(*pair, "key").agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*pair).agg(
        F.sum(F.when(F.col("key").isNull(), F.col("_n"))).alias("events"),
        F.count(F.when(F.col("problem_id").isNotNull(), F.col("key"))).alias("distinct_keys"),
    )


def trace_budget(runs: DataFrame, limit: int = MAX_TRACE_LINES) -> DataFrame:
    """Add ``trace_lines``, ``malformed_lines`` and ``over_budget``."""
    return runs.withColumns({
        "trace_lines": F.size("traces"),
        "malformed_lines": F.size(F.filter("traces", lambda x: ~x.rlike(_WELL_FORMED))),
        "over_budget": F.size("traces") > limit,
    })
