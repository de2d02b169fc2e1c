"""Strict JSON out of response columns, natively where possible.

Spark's parser stops at the closing brace, so ``{"a": 1} and more`` would pass.
Here the text becomes the first of two array items; the second holds an end mark
made from the text's hash. Only if the parser arrives at the mark, as the second
item, was the text one object and nothing else. Single quotes, bare names and raw
control characters are off, and of a repeated name the last value counts, so a
text is read as a strict JSON parser reads it. Numbers may be of any length, and
``NaN`` and ``Infinity`` are taken as values. Nesting beyond 1,000 levels is not.

Only two things need Python (Arrow-batched): lists in Python notation, and the
optional search for the last *balanced* object.
"""

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskloom.functions.text import computed_once, strip, text_or_empty

STRICT = {
    "mode": "PERMISSIVE",
    "allowSingleQuotes": "false",
    "allowUnquotedFieldNames": "false",
    "allowUnquotedControlChars": "false",
    "maxStringLen": "2147483647",
    "maxNumLen": "2147483647",
}
_TEXTS = T.ArrayType(T.StringType())
_NAMED = T.MapType(T.StringType(), T.StringType())
_FLAT_BLOCK = r"\{[^{}]*\}"


def one_object(text: Column) -> Column:
    """The text as one object: map of names to strings, nested values as JSON text.

    Null if it is anything else. A string map takes every kind of value, so only
    broken JSON fails, not an unexpected type. Read values by ``value_of``.
    """
    mark = F.concat(F.lit("end-"), F.hex(F.xxhash64(text)), F.hex(F.xxhash64(text, F.lit(1))))
    both = F.concat(F.lit("["), text, F.lit(',{"'), mark, F.lit('":""}]'))
    wrapped = F.from_json(both, "array<map<string,string>>", STRICT)

    def first(p: Column) -> Column:
        end = F.get(p, F.lit(1))
        ended = (F.size(p) == 2) & (F.size(end) == 1) & F.map_contains_key(end, mark)
        return F.when(F.coalesce(ended, F.lit(False)), F.get(p, F.lit(0)))

    return F.when(F.startswith(strip(text), F.lit("{")), F.get(F.transform(F.array(wrapped), first), F.lit(0)))


# Numbers that are no JSON but that parsers take, as Spark prints them.
_NO_NUMBERS = {'"NaN"': "NaN", '"Infinity"': "Infinity", '"-Infinity"': "-Infinity", '"INF"': "Infinity", '"-INF"': "-Infinity"}


def value_of(m: Column, name: str) -> Column:
    """The last value under a name, as a parser that meets it twice keeps it; null where there is none."""
    found = F.filter(F.map_entries(m), lambda e: e["key"] == name)
    last = F.try_element_at(found, F.lit(-1))["value"]
    shown = F.create_map(*[F.lit(v) for pair in _NO_NUMBERS.items() for v in pair])
    return F.when(F.startswith(last, F.lit('"')), F.coalesce(F.try_element_at(shown, last), last)).otherwise(last)


def json_fields(col: Column, *names: str) -> Column:
    """Struct of ``ok`` and one string per name.

    A missing name gives ``''`` and an explicit null gives null, so the two can
    be told apart; values of other types come back as JSON text.
    """

    def fields(m: Column) -> Column:
        def value(n: str) -> Column:
            key = F.lit(n)
            return F.when(m.isNotNull(), F.when(F.map_contains_key(m, key), value_of(m, n)).otherwise(""))

        return F.struct(m.isNotNull().alias("ok"), *[value(n).alias(n) for n in names])

    # The one-element array binds the parsed map, which is read once per name.
    bound = F.transform(F.array(one_object(text_or_empty(col))), fields)
    return computed_once(F.get(bound, F.lit(0)))


def json_list_size(col: Column, name: str) -> Column:
    """Length of the list under ``name``; null where there is none."""
    found = value_of(one_object(text_or_empty(col)), name)
    return computed_once(F.size(F.from_json(found, "array<string>", STRICT)).cast("bigint"))


def typed_value(m: Column, name: str, kind: T.DataType) -> Column:
    """One value of a parsed object as ``kind``; null where it does not fit."""
    text = value_of(m, name)
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(text, kind, STRICT)
    return text.try_cast(kind)


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def parse_last_block(col: Column, balanced: bool = False) -> Column:
    """Classifier response: the whole text, else the last brace-free block that parses.

    Gives ``ok``, ``origin`` (whole / block / none), ``matched_inner`` (the
    block sits inside a wider one, so its object may be the wrong one),
    ``types`` (listed values in text form) and ``reasons``. ``balanced=True``
    takes the last outermost object instead of the last brace-free one.
    """
    raw = strip(text_or_empty(col))

    def result(b: Column) -> Column:
        text, whole = b["text"], b["whole"]
        found = F.coalesce(whole, b["block"]["value"])
        after = F.length(F.call_function("substring_index", text, b["block"]["text"], F.lit(-1)))
        before = F.substring(text, F.lit(1), F.length(text) - after - F.length(b["block"]["text"]))
        inner = whole.isNull() & F.coalesce(_count(before, "{") > _count(before, "}"), F.lit(False))
        return F.struct(
            found.isNotNull().alias("ok"),
            F.when(whole.isNotNull(), "whole").when(found.isNotNull(), "block").otherwise("none").alias("origin"),
            (F.lit(False) if balanced else inner).alias("matched_inner"),
            F.coalesce(typed_value(found, "suitable_types", _TEXTS), F.array().cast(_TEXTS)).alias("types"),
            F.coalesce(typed_value(found, "reasons", _NAMED), F.create_map().cast(_NAMED)).alias("reasons"),
        )

    def last_object(blocks: Column) -> Column:
        parsed = F.transform(blocks, lambda x: F.struct(x.alias("text"), one_object(x).alias("value")))
        return F.try_element_at(F.filter(parsed, lambda x: x["value"].isNotNull()), F.lit(-1))

    def blocks_of(p: Column) -> Column:
        return p["outer"] if balanced else F.regexp_extract_all(p["text"], F.lit(_FLAT_BLOCK), F.lit(0))

    # Each one-element array binds a value that the next step reads several times.
    outer = outermost_objects(raw) if balanced else F.lit(None)
    bound = F.transform(F.array(F.struct(raw.alias("text"), outer.alias("outer"))), lambda p: F.struct(
        p["text"].alias("text"), p["outer"].alias("outer"), one_object(p["text"]).alias("whole")))
    searched = F.transform(bound, lambda p: F.struct(
        p["text"].alias("text"), p["whole"].alias("whole"),
        F.when(p["whole"].isNull(), last_object(blocks_of(p))).alias("block"),
    ))
    return computed_once(F.get(F.transform(searched, result), F.lit(0)))


def _outermost(raw: str) -> list[str]:
    """Texts of the outermost objects, left to right."""
    decoder, at, found = json.JSONDecoder(), raw.find("{"), []
    while at >= 0:
        try:
            _, end = decoder.raw_decode(raw, at)
        except (ValueError, RecursionError):
            end = at + 1
        else:
            found.append(raw[at:end])
        at = raw.find("{", end)
    return found


def outermost_objects(col: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def find(raw: pd.Series) -> pd.Series:
        return pd.Series([_outermost(r or "") for r in raw], dtype=object)

    return find(col)


def _shown(value):
    """Strings as they are, other values as JSON text; a lone surrogate becomes ``?``."""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return text.encode("utf-8", "replace").decode("utf-8")


def printed_list(col: Column) -> Column:
    """Strings of one printed list (JSON or Python notation); null if it is none."""

    def one(raw):
        for read in (json.loads, ast.literal_eval):
            try:
                value = read(raw.strip())
            except (AttributeError, TypeError, ValueError, SyntaxError, MemoryError, RecursionError):
                continue
            if isinstance(value, list):
                return [_shown(v) for v in value]
        return None

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def parse(raw: pd.Series) -> pd.Series:
        return pd.Series([one(r) for r in raw], dtype=object)

    return parse.asNondeterministic()(col)
