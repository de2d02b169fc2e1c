"""Inputs of the reasoning flow, derived from the given tables.

Each fixture is a set of plain projections over one whole table, written once
in SQL that both Spark and DuckDB run (the few spellings that differ sit in
``Dialect``). No rows are filtered out and no groups are collected: one source
row gives one fixture row per part.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taskloom.sources.jsonl import spread


class Dialect:
    def __init__(self, name: str):
        self.spark = name == "spark"

    @staticmethod
    def div(a: str, b: int) -> str:
        return f"cast(floor(({a}) / {b}) as bigint)"

    @staticmethod
    def s(x: str) -> str:
        return f"cast({x} as string)"

    def cat(self, *parts: str) -> str:
        return f"concat({', '.join(parts)})"

    def arr(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def struct(self, **fields: str) -> str:
        if self.spark:
            return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def take(self, array: str, n: str) -> str:
        return f"slice({array}, 1, cast({n} as int))" if self.spark else f"({array})[1:{n}]"

    def joined(self, n: str, body: str, sep: str) -> str:
        """``body`` for j = 0..n-1 (n at most 64), joined by ``sep``."""
        if self.spark:
            js = f"slice(sequence(0L, 63L), 1, cast({n} as int))"
            return f"array_join(transform({js}, j -> {body}), {sep})"
        return f"coalesce(array_to_string(list_transform(range(0, {n}), lambda j: {body}), {sep}), '')"

    def esc(self, x: str) -> str:
        """Text as the inside of a JSON string."""
        for char, code in ((92, "chr(92)"), (34, "chr(34)"), (10, "'n'"), (13, "'r'"), (9, "'t'")):
            x = f"replace({x}, chr({char}), concat(chr(92), {code}))"
        return x

    def obj(self, **fields: str) -> str:
        """JSON object text; values are SQL expressions giving JSON text."""
        parts = []
        for i, (k, v) in enumerate(fields.items()):
            parts += [f"'{'{' if i == 0 else ', '}\"{k}\": '", v]
        return self.cat(*parts, "'}'")

    def jstr(self, x: str) -> str:
        return self.cat("'\"'", self.esc(x), "'\"'")


NL = "chr(10)"
Parts = list[tuple[str, dict[str, str]]]


def _pick(expr: str, *values: str) -> str:
    """CASE over expr = 0, 1, …; the last value is the default."""
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {expr} {whens} ELSE {values[-1]} END"


DOMAINS = ("technology", "education", "economics", "medical", "natural_science", "news", "sports", "")


def corpus_raw(d: Dialect) -> Parts:
    return [("documents", {
        "seq": "doc_id", "doc_id": "doc_id", "text": "text",
        "quality_domain_txt": _pick("doc_id % 8", *[f"'{x}'" for x in DOMAINS]),
    })]


def corpus_responses(d: Dialect) -> Parts:
    a = d.s("1 + doc_id % 5")
    b = d.s(f"1 + {d.div('doc_id', 9)} % 5")
    pair = d.cat("'{\"suitable_types\": ['", a, "', '", b, "'], \"reasons\": {\"'", a, "'\": \"it fits\"}}'")
    flat = d.cat("'{\"suitable_types\": ['", a, "', '", b, "']}'")
    raw = _pick(
        "doc_id % 9",
        pair,
        "'{\"suitable_types\": [\"1\", \"4\", true, 2.0], \"reasons\": {}}'",
        d.cat("'Let me think. '", flat),
        d.cat("'Answer: '", pair),
        "'{\"suitable_types\": [0, 6, 3, 3], \"reasons\": {\"3\": \"figures\"}}'",
        "'{\"suitable_types\": [1, '",
        "'{\"suitable_types\": [], \"reasons\": {}}'",
        d.cat(flat, "' or {\"suitable_types\": [oops]}'"),
        d.cat(flat, "' done'"),
    )
    return [("documents", {"doc_id": "doc_id", "raw": raw})]


def qa(d: Dialect) -> Parts:
    i = "item_id"
    e1 = d.struct(input=d.cat(d.s(i), NL), output=d.cat("' '", d.s("item_id * 2")))
    e2 = d.struct(input="CASE WHEN item_id % 2 = 0 THEN '' ELSE '7 8' END", output="'15'")
    some = d.cat("'print('", d.s(i), "')'")
    solution = d.struct(
        programmingLanguage="CASE WHEN item_id % 4 <> 2 THEN 'GNU C++17' END",
        source=f"CASE WHEN item_id % 4 <> 3 THEN {some} END",
        og_source="'old'", submission_id=d.cat("'s'", d.s(i)),
    )
    tests = d.arr(
        d.struct(input=d.s(i), output="CASE WHEN item_id % 3 = 1 THEN '' ELSE 'yes' END"),
        d.struct(input="CASE WHEN item_id % 5 = 2 THEN '' ELSE '3' END", output=d.cat(d.s(i), "' '")),
    )
    row = {
        "seq": i, "id": d.cat("'p'", d.s(i)), "contest_id": d.s(d.div(i, 4)),
        "index": _pick("item_id % 4", "'A'", "'B'", "'C'", "'D'"),
        "title": f"CASE WHEN item_id % 6 = 5 THEN '' ELSE {d.cat(chr(39) + 'Task ' + chr(39), d.s(i))} END",
        "description": "text", "question": "text",
        "refined_question": f"CASE WHEN item_id % 3 <> 0 THEN {d.cat(chr(39) + 'Kernel: ' + chr(39), 'text')} ELSE '' END",
        "input_format": "CASE WHEN item_id % 4 = 1 THEN '' ELSE 'One number per line.' END",
        "output_format": "CASE WHEN item_id % 5 = 1 THEN NULL ELSE 'One number.' END",
        "note": f"CASE WHEN {d.div(i, 8)} % 2 = 0 THEN 'See the sample.' ELSE '' END",
        "examples": d.take(d.arr(e1, e2), f"{d.div(i, 3)} % 3"),
        "tags": d.take(d.arr("'math'", "'greedy'"), "item_id % 3"),
        "accepted_solutions": d.take(d.arr(solution), "CASE WHEN item_id % 4 = 0 THEN 0 ELSE 1 END"),
        "official_tests": tests,
        "type_level1": _pick("item_id % 8", "''", "'1'", "'2'", "'3'", "'4'", "' 5 '", "'9'", "'x'"),
        "type_level2": d.cat(d.s("1 + item_id % 5"), "'.1'"),
        "rating": "CASE WHEN item_id % 11 = 0 THEN NULL ELSE cast(800 + 100 * (item_id % 10) as int) END",
    }
    return [("benchmark", row)]


def qa_twice(d: Dialect) -> Parts:
    """Every record twice; the later copy has another rating."""
    first = {"id": d.cat("'p'", d.s("item_id")), "seq": "item_id",
             "rating": "CASE WHEN item_id % 11 = 0 THEN NULL ELSE cast(800 + item_id as int) END"}
    second = {**first, "seq": "item_id + 1000000",
              "rating": "CASE WHEN item_id % 7 = 0 THEN NULL ELSE cast(1500 + item_id as int) END"}
    return [("benchmark", first), ("benchmark", second)]


LANGS = ("GNU C++17", "PyPy 3", "Java 11", "C#", "Scala", "Haskell", "Rust 2021", "JavaScript (V8)", " Python 3 ", "")


def _problem_of(d: Dialect) -> str:
    """45 ids; some of them get no solutions at all."""
    return d.cat("'p'", d.s("conv_id % 45 - CASE WHEN conv_id % 45 % 8 = 5 THEN 1 ELSE 0 END"))


def solutions(d: Dialect) -> Parts:
    return [("conversations", {
        "id": _problem_of(d), "seq": "conv_id", "pos": "conv_id * 1000 + turn",
        "source": "CASE WHEN role = 'assistant' THEN text WHEN turn % 4 = 3 THEN '  ' ELSE '' END",
        "og_source": "CASE WHEN turn % 4 = 2 THEN text ELSE '' END",
        "programmingLanguage": _pick("(conv_id + turn) % 10", *[f"'{x}'" for x in LANGS]),
        "submission_id": d.cat("'s'", d.s("conv_id"), "'-'", d.s("turn")),
    })]


def stories(d: Dialect) -> Parts:
    kind = f"{d.div('doc_id', 30)} % 6"
    inp = d.cat(d.s("doc_id"), "' '", d.s("doc_id % 7"))
    good = d.obj(problem=d.jstr(d.cat("'Draft. '", "text")), input=d.jstr(inp))
    refined = d.obj(problem=d.jstr(d.cat("'Story. '", "text")), input=d.jstr(
        f"CASE WHEN doc_id % 10 = 4 THEN {d.cat(inp, chr(39) + ' 1' + chr(39))} ELSE {inp} END"))
    empty = d.obj(problem="'\"\"'", input=d.jstr(inp))
    null_input = d.obj(problem=d.jstr("text"), input="'null'")
    blank = d.obj(problem=d.jstr("text"), input="'\"  \"'")
    broken = "'{\"problem\": \"cut'"
    return [("documents", {
        "id": d.cat("'p'", d.s("doc_id % 30")), "seq": "doc_id", "title": d.cat("'Story '", d.s("doc_id")),
        "type_id": "cast(1 + doc_id % 5 as int)", "sample_idx": f"cast({d.div('doc_id', 30)} as int)",
        "corpus_text": "text",
        "refined_result": _pick(kind, refined, broken, broken, empty, null_input, blank),
        "synthesis_result": _pick(kind, good, good, broken, empty, null_input, blank),
    })]


def questions(d: Dialect) -> Parts:
    """Documents as question texts; some end in contest wording."""
    tail = _pick("doc_id % 5", "' Given a positive integer n, print the answer.'", "' What was the total of that day?'",
                 "' The Algorithm takes x_1 and i; mind the time complexity.'", "' See the Input format and the output formats.'", "''")
    return [("documents", {"doc_id": "doc_id", "question": d.cat("text", tail)})]


def _case(d: Dialect) -> dict[str, str]:
    source = _pick("event_id % 5", "'level_A'", "'level_B'", "'level_C'", "'official'", "'synthesized'")
    pid = d.cat("'p'", d.s("user_id % 45"))
    return {
        "eval_id": d.cat(pid, "'::'", source, "'::'", d.s("event_id")),
        "seq": "event_id", "problem_id": pid, "title": d.cat("'Case '", d.s("event_id")), "source": source,
        "type_id": "cast(1 + event_id % 5 as int)", "rating": "cast(800 + user_id % 20 * 100 as int)",
        "input": d.cat(d.s("event_id"), "' '", d.s("user_id")), "expected_output": d.s("event_id % 97"),
    }


def eval_cases(d: Dialect) -> Parts:
    return [("events", _case(d))]


def executed_tests(d: Dialect) -> Parts:
    case = _case(d)
    test = d.struct(
        level="CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'A' ELSE 'B' END",
        status="CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'success' END",
        input=case["input"],
        output=f"CASE WHEN event_id % 11 = 0 THEN '' ELSE {case['expected_output']} END",
    )
    return [("events", {"id": case["problem_id"], "test_cases": d.arr(test)})]


def done_keys(d: Dialect) -> Parts:
    """One key per event; a tenth of them belongs to a real case."""
    case = _case(d)
    key = f"CASE WHEN event_id % 10 = 0 THEN {case['eval_id']} ELSE {d.cat(chr(39) + 'other::' + chr(39), d.s('event_id'))} END"
    return [("events", {"eval_id": key})]


def _stdout(d: Dialect) -> str:
    line = d.cat(
        "'[TRACE] '", "CASE WHEN event_id % 23 = 0 THEN '' ELSE event_type END",
        "CASE WHEN event_id % 23 = 0 THEN '' ELSE " + d.cat("' | id='", d.s("event_id"), "' | step='", d.s("j"), "' | id='", d.s("event_id + j")) + " END",
        "' '",
    )
    answer = d.s("event_id % 97 + CASE WHEN user_id % 6 = 0 THEN 1 ELSE 0 END")
    shown = f"CASE WHEN user_id % 4 = 1 THEN {d.cat(chr(39) + '  ' + chr(39), answer, 'chr(13)', NL)} ELSE {answer} END"
    body = d.cat(d.joined("event_id % 27", line, NL), NL, shown)
    return f"CASE WHEN user_id % 17 = 0 THEN {_pick('event_id % 2', chr(39) * 2, d.cat(chr(39) + '  ' + chr(39), NL))} ELSE {body} END"


def runs(d: Dialect) -> Parts:
    return [("events", {**_case(d), "stdout": _stdout(d),
                        "return_code": "CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END"})]


def trace_runs(d: Dialect) -> Parts:
    case = _case(d)
    keep = ("seq", "problem_id", "source", "input", "expected_output")
    first = {k: case[k] for k in keep}
    first["source"] = f"CASE WHEN event_id % 4 = 0 THEN 'unseen' ELSE {case['source']} END"
    first["input"] = f"CASE WHEN event_id % 8 = 1 THEN {d.cat(case['input'], 'chr(13)')} ELSE {case['input']} END"
    first["raw_stdout"] = _stdout(d)
    second = dict(first)
    second["seq"] = "event_id + 1000000000000"
    second["source"] = f"CASE WHEN event_id % 10 = 3 THEN {case['source']} ELSE 'later' END"
    second["raw_stdout"] = d.cat("'late run '", d.s("event_id"))
    return [("events", first), ("events", second)]


def fused(d: Dialect) -> Parts:
    case = _case(d)
    row = {k: case[k] for k in case if k != "input"}
    row["new_input"] = case["input"]
    text = d.cat("'At gate '", d.s("user_id"), "', item ('", d.s("event_id"), "') came by '", "event_type", "'.'")
    row["fused_result"] = (
        f"CASE WHEN event_id % 14 = 3 THEN '{{\"problem\": \"\"}}' WHEN event_id % 15 = 7 THEN '{{\"problem\": ' "
        f"ELSE {d.obj(problem=d.jstr(text))} END"
    )
    return [("events", row)]


def cot(d: Dialect) -> Parts:
    case = _case(d)
    row = {k: case[k] for k in ("eval_id", "seq", "problem_id", "type_id", "rating")}
    row["problem"] = d.cat("'Question '", d.s("event_id"), "' by '", "event_type")
    end = d.cat("'The answer is '", d.s("event_id % 97"), "'.'")
    steps3 = d.cat("'Step 1: Read the gate.'", NL, NL, "'Step 2: Add both.'", NL, NL, "'Step 3: '", end)
    gap = d.cat("'Step 1: Read.'", NL, NL, "'Step 3: '", end)
    banned = d.cat("'Step 1: The code walks the Array, assuming order.'", NL, NL, "'Step 2: '", end)

    def good(n: int, text: str) -> str:
        return d.obj(verified="'true'", num_steps=f"'{n}'", reasoning=d.jstr(text))

    row["cot_result"] = _pick(
        "event_id % 6", good(3, steps3), good(5, steps3), good(2, gap), good(2, banned),
        d.obj(verified="'false'", mismatch_reason=d.jstr("'outputs differ'")), "'{\"verified\": tru'",
    )
    return [("events", row)]


def instrumented(d: Dialect) -> Parts:
    body = f"CASE WHEN conv_id % 7 = 0 THEN substr(text, instr(text, {NL}) + 1) ELSE text END"
    extra = f"CASE WHEN turn % 5 = 1 THEN {d.cat(NL, chr(39) + 'total += 1' + chr(39))} ELSE '' END"
    code = d.cat(body, NL, "'  [TRACE] init | turn='", d.s("turn"), NL, "'[TRACE] end | ok=1'", extra)
    step = "{\"location\": \"here\", \"event\": \"init\"}"
    plan = f"CASE WHEN conv_id % 5 = 0 THEN '[{step}]' ELSE '[{step}, {step}]' END"
    good = d.obj(analysis=d.jstr(d.cat("'Plan '", d.s("conv_id"))), trace_plan=plan, instrumented_code=d.jstr(code))
    none = d.obj(analysis="'\"none\"'", instrumented_code="'\"\"'")
    return [("conversations", {
        "id": _problem_of(d), "seq": "conv_id * 1000 + turn", "language": "CASE WHEN turn % 2 = 0 THEN 'cpp' ELSE 'python' END",
        "original": "text",
        "instrument_result": _pick("(conv_id + turn) % 5", "'no json here'", none, good, good, good),
    })]


def printed_tests(d: Dialect) -> Parts:
    """A printed list per turn, in JSON or Python notation."""
    quote = "CASE WHEN turn % 2 = 0 THEN chr(34) ELSE chr(39) END"
    k = "CASE WHEN turn % 3 = 1 AND j = 7 THEN 6 ELSE j END"
    item = (
        f"CASE WHEN conv_id % 4 = 2 AND j = 12 THEN {d.cat(quote, 'repeat(' + chr(39) + '9' + chr(39) + ', 1200)', quote)} "
        f"ELSE {d.cat(quote, d.s('conv_id'), 'chr(92)', chr(39) + 'n' + chr(39), d.s(k), quote)} END"
    )
    n = "CASE WHEN conv_id % 3 = 0 THEN 29 ELSE 30 END"
    text = d.cat("'['", d.joined(n, item, "', '"), "']'")
    return [("conversations", {
        "suite": "conv_id * 1000 + turn",
        "printed": f"CASE WHEN conv_id % 11 = 10 THEN 'Traceback: failed' ELSE {text} END",
    })]


def classify_responses(d: Dialect) -> Parts:
    one = d.s("1 + item_id % 6")
    two = d.cat(d.s("1 + item_id % 5"), "'.'", d.s("1 + item_id % 4"))
    raw = d.obj(
        core_step=d.jstr("text"),
        level1=f"CASE WHEN item_id % 2 = 0 THEN {d.jstr(one)} ELSE {one} END",
        level2=d.jstr(two),
        new="CASE WHEN item_id % 7 = 3 THEN '\"true\"' WHEN item_id % 7 = 4 THEN 'true' ELSE '\"false\"' END",
        reason="'\"because\"'",
    )
    return [("benchmark", {"id": d.cat("'p'", d.s("item_id")), "raw": f"CASE WHEN item_id % 9 = 8 THEN 'unsure' ELSE {raw} END"})]


def kernel_responses(d: Dialect) -> Parts:
    raw = _pick("item_id % 4", d.obj(text=d.jstr(d.cat("'Given: '", "text"))), "'{\"text\": \"\"}'", "'plain words'", "'[1]'")
    return [("benchmark", {"id": d.cat("'p'", d.s("item_id")), "question": "text", "raw": raw})]


FIXTURES: dict[str, Callable[[Dialect], Parts]] = {f.__name__: f for f in (
    corpus_raw, corpus_responses, qa, qa_twice, solutions, stories, questions, eval_cases, executed_tests, done_keys,
    runs, trace_runs, fused, cot, instrumented, printed_tests, classify_responses, kernel_responses,
)}


# The large tables, whose rendering is costly; for documents a no-op once the input has enough splits. Events are
# narrow and become long outputs, so a task gets a fixed number of them.
_SPREAD_BY = {"documents": (["doc_id"], None), "events": (["event_id", "user_id"], 50_000)}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    out = None
    for table, columns in FIXTURES[name](Dialect("spark")):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        if table in _SPREAD_BY:
            keys, size = _SPREAD_BY[table]
            rows = spread(rows, *keys, rows=size)
        part = rows.selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()])
        out = part if out is None else out.unionByName(part)
    return out


def duckdb_sql(name: str) -> str:
    """The same fixture as a parenthesised DuckDB query."""
    selects = [
        "SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in columns.items()) + f" FROM {table}"
        for table, columns in FIXTURES[name](Dialect("duckdb"))
    ]
    return "(" + " UNION ALL ".join(selects) + ")"
