import json

from pyspark.sql import functions as F

from taskloom.functions.strict_json import json_fields, parse_last_block, printed_list
from taskloom.operators.corpus import suitable_types

TEXTS = [
    '{"problem": "a", "input": "b"}', '{"problem": "a"}', '{"problem": "a", "input": null}', '{"problem": 5, "input": 0}',
    '{"problem": "a"} tail', "{'problem': 'a'}", '[1]', '"x"', '', 'null', '{"problem": "line\nbreak"}', '{"problem": "a\\nb"}',
    '{"problem": "a",}', '{"problem": "a"}, {"problem": "b"}', '{"problem": "a"} {"problem": "b"}', ' {"problem": "a"}\n',
    '{"problem": "a"}] and more', '{"problem": "a"}]', '{"problem": "a"}] , {"x":1}', '{"problem": "a", "problem": "b"}', '{"problem": "a"},{"end-0":""}',
    '{"problem": ' + "7" * 1500 + '}', '{"problem": "a", "x": ' + "7" * 1500 + '}', '{"problem": NaN}', '{"problem": "a", "x": Infinity}', '{"problem": "a"},', '{"problem": "a"}]]',
    '{"input": "1", "problem": "a", "input": null}', '{"problem": "NaN"}',
    '{"problem": [1, oops]}', '{"problem": {"x": [1, 2]}, "input": true}', '{problem: "a"}', '{"problem": "q\\"x"}', '[{"problem": "a"}]',
    '{"problem": 01}', '{"a": {"b": {"c": 1}}, "problem": "deep"}', '{"problem": "a"', 'prose {"problem": "a"}', '{}', '{"problem": ""}',
]


def _objects():
    for s in TEXTS:
        try:
            value = json.loads(s)
        except ValueError:
            value = None
        yield s, value if isinstance(value, dict) else None


def test_acceptance_follows_a_strict_parser(spark):
    df = spark.createDataFrame([(s,) for s in TEXTS], "s string").withColumn("p", json_fields(F.col("s"), "problem", "input"))
    got = {r.s: r.p for r in df.collect()}
    for s, value in _objects():
        assert got[s].ok == (value is not None), s
        if value is None:
            assert got[s].problem is None
        elif isinstance(value.get("problem", ""), str):
            assert got[s].problem == value.get("problem", ""), s
        if value is not None and "input" in value and value["input"] is None:
            assert got[s].input is None
        elif value is not None and "input" not in value:
            assert got[s].input == ""


def test_numbers_of_any_length_and_no_numbers(spark):
    texts = ['{"a": ' + "7" * 1500 + '}', '{"a": NaN}', '{"a": -Infinity}', '{"a": "NaN"}', '{"a": ' + "[" * 1200 + "]" * 1200 + "}"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    got = [(r.p.ok, r.p.a) for r in df.select("i", json_fields(F.col("s"), "a").alias("p")).orderBy("i").collect()]
    assert got == [(True, "7" * 1500), (True, "NaN"), (True, "-Infinity"), (True, "NaN"), (False, None)]


def test_null_response(spark):
    row = spark.createDataFrame([(None,)], "s string").select(json_fields(F.col("s"), "a").alias("p")).first()
    assert not row.p.ok and row.p.a is None


LAST = {  # response: (ok, origin, matched_inner, types)
    '{"suitable_types": [2, "1", 2, 9]}': (True, "whole", False, [1, 2]),
    'so {"suitable_types": [5]} ok': (True, "block", False, [5]),
    'so {"suitable_types": [5], "reasons": {"5": "x"}}.': (True, "block", True, []),
    '{"suitable_types": [1]} {"suitable_types": [2]}': (True, "block", False, [2]),
    '{"suitable_types": [1]} {"suitable_types": [oops]}': (True, "block", False, [1]),
    "none": (False, "none", False, []),
    "[1]": (False, "none", False, []),
    '{"suitable_types": "135"}': (True, "whole", False, []),
    '{"suitable_types": null, "reasons": "x"}': (True, "whole", False, []),
    '{"suitable_types": [true, 3.0, "03", "x", null, "4 "]}': (True, "whole", False, [3]),
    "": (False, "none", False, []),
}


def test_last_block(spark):
    df = spark.createDataFrame([(s,) for s in LAST], "s string").withColumn("p", parse_last_block(F.col("s")))
    for r in df.withColumn("t", suitable_types(F.col("p.types"))).collect():
        assert (r.p.ok, r.p.origin, r.p.matched_inner, r.t) == LAST[r.s], r.s


def test_balanced_option_finds_the_outer_object(spark):
    s = 'first {"a": 1} then {"suitable_types": [5], "reasons": {"5": "x"}}.'
    p = spark.createDataFrame([(s,)], "s string").select(parse_last_block(F.col("s"), balanced=True).alias("p")).first().p
    assert p.types == ["5"] and p.reasons == {"5": "x"} and not p.matched_inner


def test_printed_lists(spark):
    texts = ["['1\\n2', '3']", '["a", "b"]', "[]", "oops", "{'a': 1}", "[1, 2]", "__import__('os')", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(printed_list(F.col("s"))).collect()]
    assert got == [["1\n2", "3"], ["a", "b"], [], None, None, ["1", "2"], None, None]
