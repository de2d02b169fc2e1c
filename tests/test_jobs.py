"""Exchange with outside functions, sources, sinks and the stream."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from taskloom.operators import exchange, joins, responses, runs, shape
from taskloom.sources import jsonl, shards
from taskloom.streaming.intake import corpus_stream, intake


def test_chunks_cross_arrow_batches():
    import pandas as pd

    frames = [pd.DataFrame({"x": range(a, b)}) for a, b in ((0, 5), (5, 5), (5, 6), (6, 20))]
    sizes = [(len(c), c.x.tolist()[0]) for c in exchange._chunks(iter(frames), 8)]
    assert sizes == [(8, 0), (8, 8), (4, 16)]


def test_render_is_sequential(spark):
    df = spark.createDataFrame([("see {b}", "B", None)], "a string, b string, c string")
    got = df.select(exchange.render_prompt("{a} {b} {{a}} {c}|", [("a", F.col("a")), ("b", F.col("b")), ("c", F.col("c"))])).first()[0]
    assert got == "see B B {see B} |"


def test_answers_stay_aligned_and_gated(spark):
    reqs = spark.range(500).selectExpr("cast(id AS string) AS request_id", "concat('q ', id) AS prompt", "id % 3 <> 0 AS ok").repartition(5)

    def complete(prompts):
        assert 0 < len(prompts) <= 64
        return [f" {p}! " for p in prompts]

    got = {r.request_id: r.raw for r in exchange.infer_batches(reqs, complete, 64, gate="ok").collect()}
    assert got == {str(i): f"q {i}!" if i % 3 else "" for i in range(500)}


def test_wrong_number_of_answers_fails(spark):
    reqs = spark.range(5).selectExpr("cast(id AS string) AS request_id", "'q' AS prompt")
    with pytest.raises(Exception, match="5 prompts gave 1 completions"):
        exchange.infer_batches(reqs.coalesce(1), lambda p: p[:1], 64).collect()


def test_exchange_asks_only_for_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "answers")
    make = lambda n: spark.range(n).selectExpr("cast(id AS string) AS request_id", "'q' AS prompt")
    first = lambda r: exchange.infer_batches(r, lambda p: ["one"] * len(p), 8)
    second = lambda r: exchange.infer_batches(r, lambda p: ["two"] * len(p), 8)
    exchange.exchange_through(make(20), path, first)
    table = exchange.exchange_through(make(30), path, second)
    assert {r.raw: r["count"] for r in table.groupBy("raw").count().collect()} == {"one": 20, "two": 10}


def test_runner_is_retried_and_gives_up(spark):
    jobs = spark.createDataFrame([("a", "flaky"), ("b", "dead"), ("c", "bad")], "request_id string, code string").selectExpr(
        "*", "'cpp' AS language", "'1' AS stdin").coalesce(1)

    def make():
        seen, lock = {}, threading.Lock()

        def run(job):
            with lock:
                seen[job["code"]] = n = seen.get(job["code"], 0) + 1
            if job["code"] == "dead" or (job["code"] == "flaky" and n < 3):
                raise OSError("no connection")
            return {"return_code": 1 if job["code"] == "bad" else 0, "stdout": f"try {n} in {job['run_timeout']}", "stderr": ""}

        return run

    def lazily(job, state={}):  # locks cannot be pickled, so the runner is made in the task
        return state.setdefault("run", make())(job)

    got = {r.request_id: r for r in exchange.run_batches(jobs, lazily, wait=(0, 0)).collect()}
    assert got["a"].success and got["a"].stdout == "try 3 in 30"
    assert not got["b"].success and got["b"].stderr == "max retries exceeded" and got["b"].return_code == -1
    assert not got["c"].success and got["c"].return_code == 1 and got["c"].stdout == "try 1 in 30"


LINES = ['{"id": "a", "rating": 3}', "", "  ", '{"id": "b"} tail', '{"id": "c", "rating": "x", "extra": [1]}', "[1]", '{"id": "d"', '{"id": "é"}']


def test_bad_line_policies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.jsonl").write_text("\n".join(LINES), encoding="utf-8")
    (tmp_path / "in" / "skip.txt").write_text("not read")
    path = str(tmp_path / "in")
    read = lambda policy: jsonl.read_jsonl(spark, path, "id string, rating int", policy)
    assert sorted((r.id, r.rating or 0) for r in read("drop").collect()) == [("a", 3), ("c", 0), ("é", 0)]
    kept = read("keep").collect()
    assert len(kept) == 6 and {r._bad_line for r in kept if r.id is None} == {'{"id": "b"} tail', "[1]", '{"id": "d"'}
    with pytest.raises(Exception, match="not a JSON object"):
        read("fail").collect()
    with pytest.raises(ValueError):
        read("ignore")


def test_nested_schema_reads_back(spark, tmp_path):
    from taskloom import schemas

    record = {"id": "p1", "examples": [{"input": "1", "output": "2"}], "tags": ["x"], "rating": 900,
              "accepted_solutions": [{"programmingLanguage": "C++", "source": "int\nmain"}], "title": "T"}
    (tmp_path / "a.jsonl").write_text(json.dumps(record) + "\n")
    row = jsonl.read_jsonl(spark, str(tmp_path), schemas.PROBLEMS_RAW).first()
    assert row.examples[0].output == "2" and row.rating == 900 and row.accepted_solutions[0].source == "int\nmain"
    df = jsonl.read_jsonl(spark, str(tmp_path), schemas.PROBLEMS_RAW)
    assert shape.solution_rows(df.selectExpr("id", "transform(accepted_solutions, s -> struct(s.source AS source, '' AS og_source, "
                               "s.programmingLanguage AS programmingLanguage, 's' AS submission_id)) AS accepted_solutions")).count() == 1


def test_shards_range_and_corrupt_files(spark, tmp_path):
    path = str(tmp_path / "t")
    shards.write_shards(spark.range(100).selectExpr("id", "cast(id % 10 AS int) AS shard"), path)
    (tmp_path / "t" / "shard=3" / "part-broken.parquet").write_bytes(b"PAR1 broken")
    assert shards.read_shards(spark, path, 2, 4, skip_unreadable=True).count() == 30
    report = shards.read_report(spark, path).where("not readable").collect()
    assert [r.path.rsplit("/", 1)[1] for r in report] == ["part-broken.parquet"]
    with pytest.raises(Exception):
        shards.read_shards(spark, path, 2, 4).count()


def test_stream_resumes_without_duplicates(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    text = "The first step goes north, then east. " * 20

    def add(start, n):
        rows = spark.range(start, start + n).selectExpr("id AS doc_id", f"concat(id, ' {text}') AS text", "'news' AS quality_domain_txt")
        rows.write.mode("append").json(src)

    def run():
        stream = corpus_stream(spark, src, "doc_id bigint, text string, quality_domain_txt string")
        intake(stream, out, ckpt, "doc_id", complete=lambda ps: ['{"suitable_types": [2]}'] * len(ps)).awaitTermination()
        return [sorted(r.doc_id for r in spark.read.parquet(f"{out}/{kind}").collect()) for kind in ("rule", "model")]

    (tmp_path / "src").mkdir()
    add(0, 20)
    assert run() == [list(range(20))] * 2
    assert run() == [list(range(20))] * 2  # nothing new
    add(20, 5)
    assert run() == [list(range(25))] * 2
    assert {tuple(r.suitable_types) for r in spark.read.parquet(f"{out}/model").select("suitable_types").collect()} == {(2,)}


def test_answer_match(spark):
    cases = [("3", "3", True), (" 3\n", "3", True), ("3.0", "3", False), ("100.99", "100.0", True), ("101.01", "100.0", False),
             ("0", "0.0", True), ("0.001", "0.0", False), ("abc", "abc", True), ("abc", "abd", False), ("nan", "1.0", False),
             ("1e2", "100.5", True), ("-5.0", "5.0", False), ("", "1.0", False), ("99.01", "100.0", True), ("98.99", "100.0", False)]
    df = spark.createDataFrame([(i, a, e) for i, (a, e, _) in enumerate(cases)], "i int, a string, e string")
    got = [r[0] for r in df.orderBy("i").select(runs.answer_match(F.col("a"), F.col("e"))).collect()]
    assert got == [w for *_, w in cases]


def test_trace_lines(spark):
    out = "x\r\n [TRACE] init | a=1 | b=x=y | a=2 \nmid\n[TRACE]\n[TRACE] only\n42\n"
    df = runs.split_trace(spark.createDataFrame([(1, "p", out)], "seq bigint, problem_id string, stdout string"))
    row = runs.trace_budget(df).first()
    assert row.traces == ["[TRACE] init | a=1 | b=x=y | a=2", "[TRACE]", "[TRACE] only"]
    assert row.actual_output == "x\r\nmid\n42" and row.malformed_lines == 1 and not row.over_budget
    events = runs.trace_events(df).orderBy("line_no").collect()
    assert [(e.label, e.fields) for e in events] == [("init", {"b": "x=y", "a": "2"}), ("", {}), ("only", {})]


def test_first_trace_wins_and_carriage_returns_go(spark):
    traces = spark.createDataFrame([
        (2, "p", "s", "1\r\n2\r\n", "late", True), (1, "p", "s", "1\n2", "early", False), (0, "p", "s", "1\n2", " \n", True),
    ], "seq bigint, problem_id string, source string, input string, raw_stdout string, output_matched boolean")
    assert [r.raw_stdout for r in joins.first_traces(traces).collect()] == ["early"]
    assert [r.raw_stdout for r in joins.first_traces(traces, verified_only=True).collect()] == ["late"]


@pytest.mark.parametrize("hot_rows", [3, 10**6])
def test_round_robin_with_a_hot_problem(spark, hot_rows):
    cases = spark.range(200).selectExpr("id AS seq", "CASE WHEN id < 150 THEN 'hot' ELSE concat('p', id % 4) END AS problem_id", "cast(id AS string) AS input")
    templates = spark.createDataFrame([("hot", i, f"h{i}", "") for i in range(3)] + [("p1", 9, "one", "")],
                                      "id string, seq bigint, story_problem string, story_input string")
    rows = joins.round_robin_templates(cases, templates, hot_rows).orderBy("seq").collect()
    hot = [r.story_problem for r in rows if r.problem_id == "hot"]
    assert hot == [f"h{i % 3}" for i in range(150)]
    assert {r.problem_id for r in rows} == {"hot", "p1"}


def test_story_order_of_fields(spark):
    good = '{"problem": "P", "input": "1"}'
    cases = [(good, "x", "draft"), ("x", good, "refined"), (good, '{"problem": "R", "input": ""}', "refined"), (good, '{"problem": "R", "input": null}', "draft"),
             ("x", '{"problem": ""}', None), (None, None, None)]
    df = spark.createDataFrame([(i, s, r) for i, (s, r, _) in enumerate(cases)], "i int, synthesis_result string, refined_result string")
    assert [r.story_origin for r in responses.story_fields(df).orderBy("i").collect()] == [w for *_, w in cases]


def test_sampled_solutions_keep_position_order_when_all_fit(spark):
    rows = [("a", i, f"code {i}", "", "C++", f"s{i}") for i in range(3)] + [("b", i, f"code {i}", "", "C++", f"s{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "id string, pos bigint, source string, og_source string, programmingLanguage string, submission_id string")
    got = shape.expand_solutions(df, 3).orderBy("id", "solution_idx").collect()
    assert [r.pos for r in got if r.id == "a"] == [0, 1, 2]
    assert [r.solution_idx for r in got if r.id == "b"] == [0, 1, 2] and len({r.pos for r in got if r.id == "b"}) == 3


def test_length_gate_boundary(spark):
    df = spark.createDataFrame([("a b c",), ("a b c d",)], "prompt string")
    assert [r.sendable for r in exchange.length_gate(df, 10, 7).orderBy("prompt").collect()] == [True, False]


def _answers(name):
    return lambda reqs: exchange.infer_batches(reqs, lambda ps: [name] * len(ps), 8)


def test_restart_after_a_failed_wave_asks_only_for_the_rest(spark, tmp_path):
    reqs = spark.range(200).selectExpr("cast(id AS string) AS request_id", "'q' AS prompt")
    path, waves = str(tmp_path / "answers"), []

    def failing(r):
        waves.append(1)
        if len(waves) == 3:
            return exchange.infer_batches(r, lambda ps: ps[:0], 8)
        return _answers("one")(r)

    with pytest.raises(Exception, match="gave 0 completions"):
        exchange.exchange_through(reqs, path, failing, waves=4)
    kept = spark.read.schema(exchange.RESPONSES).parquet(path).count()
    assert 0 < kept < 200
    table = exchange.exchange_through(reqs, path, _answers("two"), waves=4)
    assert {r.raw: r["count"] for r in table.groupBy("raw").count().collect()} == {"one": kept, "two": 200 - kept}


def test_restart_after_a_failed_first_wave(spark, tmp_path):
    reqs = spark.range(20).selectExpr("cast(id AS string) AS request_id", "'q' AS prompt")
    path = str(tmp_path / "answers")
    with pytest.raises(Exception, match="completions"):
        exchange.exchange_through(reqs, path, lambda r: exchange.infer_batches(r, lambda ps: ps[:0], 8))
    assert exchange.exchange_through(reqs, path, _answers("two")).count() == 20


def test_calls_are_spread_over_tasks(spark, tmp_path):
    from pyspark import TaskContext

    reqs = spark.range(1000).selectExpr("cast(id AS string) AS request_id", "'q' AS prompt")
    where = lambda r: exchange.infer_batches(r, lambda ps: [str(TaskContext.get().partitionId())] * len(ps), 8)
    table = exchange.exchange_through(reqs, str(tmp_path / "answers"), where, waves=1, parallelism=6)
    assert table.select("raw").distinct().count() == 6


def test_jobs_keep_repeated_rows_and_read_their_input_once(spark, tmp_path):
    from taskloom.plans import jobs

    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = spark.createDataFrame([("a", "same"), ("a", "same"), ("b", "other")], "id string, question string").mapInPandas(count, "id string, question string")
    got = jobs.extract_kernel(rows, lambda ps: ['{"text": "K"}'] * len(ps), str(tmp_path))
    assert got.count() == 3 and seen.value == 3


def test_solutions_of_repeated_ids_stay_apart(spark, tmp_path):
    from taskloom.plans import jobs

    made = spark.range(2).selectExpr(
        "'p' AS id", "'c' AS contest_id", "'A' AS index", "'T' AS title", "concat('question ', id) AS question", "'' AS refined_question", "'' AS input_format",
        "'' AS output_format", "'' AS note", "cast(array() AS array<struct<input:string,output:string>>) AS examples", "'1' AS type_level1",
        "transform(sequence(0, id), i -> struct(concat('code ', id, i) AS source, '' AS og_source, 'C++' AS programmingLanguage, 's' AS submission_id)) AS accepted_solutions")
    got = jobs.generate_tests(made, lambda ps: ["x"] * len(ps), str(tmp_path)).select("problem", "solution_idx", "code").collect()
    assert sorted((r.problem[-10:], r.solution_idx, r.code) for r in got) == sorted((r.problem[-10:], r.solution_idx, r.code) for r in got if r.code[5] in r.problem)
    assert sorted((r.code, r.solution_idx) for r in got) == [("code 00", 0), ("code 10", 0), ("code 11", 1)]


def test_done_runs_stay_valid_when_inputs_are_added_in_front(spark):
    make = lambda seqs: spark.createDataFrame([("p", "s", f"in {i}", i) for i in seqs] + [("p", "s", "twice", 90), ("p", "s", "twice", 91)],
                                              "problem_id string, source string, input string, seq bigint")
    keys = lambda df: {r.run_key for r in joins.with_run_key(df).collect()}
    old, new = keys(make([5, 6, 7])), keys(make([1, 5, 6, 7]))
    assert len(old) == 5 and old < new and len(new) == 6


def test_stream_runs_in_bounded_batches(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    text = "The first step goes north, then east. " * 20
    (tmp_path / "src").mkdir()
    for i in range(5):
        spark.range(i * 4, i * 4 + 4).coalesce(1).selectExpr("id AS doc_id", f"concat(id, ' {text}') AS text", "'news' AS quality_domain_txt").write.mode("append").json(src)
    source = lambda: corpus_stream(spark, src, "doc_id bigint, text string, quality_domain_txt string", files_per_batch=2)
    model = lambda prompts: ['{"suitable_types": [2]}'] * len(prompts)
    intake(source(), out, ckpt, "doc_id", complete=model).awaitTermination()
    rule = spark.read.parquet(f"{out}/rule")
    assert rule.select("batch_id").distinct().count() == 3
    assert sorted(r.doc_id for r in rule.collect()) == list(range(20))
