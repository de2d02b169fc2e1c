"""The two language normalisers. They disagree on purpose: one labels code for
prompts, the other names a runner."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from taskloom.functions.lexicon import LANGUAGE_NAMES
from taskloom.functions.text import strip, text_or_empty


def language_detect(col: Column) -> Column:
    """Exact name first, then the first listed name found inside, else ``cpp``."""
    key = F.lower(strip(text_or_empty(col)))
    exact = F.create_map(*[F.lit(v) for pair in LANGUAGE_NAMES for v in pair])
    inside = [F.when(F.contains(key, F.lit(name)), F.lit(label)) for name, label in LANGUAGE_NAMES]
    return F.coalesce(F.try_element_at(exact, key), *inside, F.lit("cpp"))


def language_runner(col: Column) -> Column:
    """Name of the runner; an unknown name is only lowercased."""
    key = F.lower(text_or_empty(col))

    def has(part: str) -> Column:
        return F.contains(key, F.lit(part))

    return (
        F.when(has("python"), F.lit("python3"))
        .when(has("java"), F.lit("java"))
        .when(has("c++") | has("g++"), F.lit("cpp"))
        .when(key.isin("c", "gnu c"), F.lit("c"))
        .when(has("rust"), F.lit("rust"))
        .when(has("go"), F.lit("go"))
        .when(has("kotlin"), F.lit("kotlin"))
        .otherwise(key)
    )
