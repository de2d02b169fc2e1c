"""The response store in buckets, call deadlines, and runs that go on where they broke."""

import os
import time
from functools import partial

import pytest
from pyspark.sql import functions as F

from taskloom.operators import exchange, shape, sharding
from taskloom.plans import jobs


def _reqs(spark, n):
    return spark.range(n).selectExpr("cast(id AS string) AS request_id", "concat('q', id) AS prompt")


def _echo(name):
    return lambda r: exchange.infer_batches(r, lambda ps: [name + p for p in ps], 8)


def test_a_wave_reads_its_own_bucket_only(spark, tmp_path):
    path = str(tmp_path / "answers")
    exchange.exchange_through(_reqs(spark, 100), path, _echo("a"), waves=4)
    store = exchange.ResponseStore(spark, path)
    assert store.buckets == 4  # the layout of the store counts, not the default
    place = str(tmp_path / "reqs")
    exchange.by_bucket(_reqs(spark, 150), 4).write.partitionBy("bucket").parquet(place)
    reqs = spark.read.parquet(place)
    wave = exchange.wave_of(reqs, store, 2, 2)
    plan = wave._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket") == 2 and plan.count("<= 2)") == 2
    read = store.read(2, 2).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("bucket=")[1][0] for r in read} == {"2"}
    assert 0 < wave.count() < 50


def test_few_requests_make_one_wave_and_many_make_more(spark, tmp_path):
    for rows, expected in ((1000, 1), (30, 4)):
        seen = []
        table = exchange.exchange_through(_reqs(spark, 100), str(tmp_path / f"w{rows}"), lambda r: seen.append(1) or _echo("x")(r), wave_rows=rows)
        assert len(seen) == expected and table.count() == 100


def test_requests_dealt_otherwise_than_the_store(spark, tmp_path):
    path = str(tmp_path / "answers")
    exchange.exchange_through(_reqs(spark, 50), path, _echo("a"), waves=3)
    laid = exchange.by_bucket(_reqs(spark, 80), 8)
    assert exchange.exchange_through(laid, path, _echo("b"), dealt=8).count() == 80
    assert exchange.ResponseStore(spark, path).buckets == 3


def test_compaction_keeps_all_answers(spark, tmp_path):
    path = str(tmp_path / "answers")
    for n in (50, 100, 150):
        exchange.exchange_through(_reqs(spark, n), path, _echo(f"{n}:"), bucket_files=1000)
    store = exchange.ResponseStore(spark, path)
    before, files = sorted(map(tuple, store.read().collect())), store.files()
    old = store.read()
    store.compact()
    assert sorted(map(tuple, store.read().collect())) == before and store.files() <= 8 < files
    assert old.count() == 150  # who still reads the old generation can
    os.makedirs(f"{store.root}/gen=2/bucket=0")  # a compaction that broke off
    assert sorted(map(tuple, store.read().collect())) == before
    table = exchange.exchange_through(_reqs(spark, 160), path, _echo("new:"), bucket_files=0)
    assert table.where("raw like 'new:%'").count() == 10 and table.count() == 160
    assert not os.path.exists(f"{store.root}/gen=0")


def test_a_runner_that_hangs_gives_failure_rows(spark):
    def run(job):
        if job["code"] == "hang":
            time.sleep(3600)
        return {"return_code": 0, "stdout": "ok", "stderr": ""}

    todo = spark.createDataFrame([(str(i), "hang" if i % 3 == 0 else "fine", "cpp", "1") for i in range(9)], "request_id string, code string, language string, stdin string")
    start = time.time()
    got = {r.request_id: r for r in exchange.run_batches(todo.coalesce(1), run, max_attempts=2, concurrency=4, wait=(0, 0), request_timeout=0.5).collect()}
    assert time.time() - start < 30
    assert {i for i, r in got.items() if not r.success} == {"0", "3", "6"}
    assert all(got[i].abandoned == 2 and got[i].stderr == "max retries exceeded" and got[i].return_code == -1 for i in "036")
    assert got["1"].abandoned == 0 and got["1"].stdout == "ok"


QUESTIONS = "id string, question string"


def test_a_named_run_goes_on_at_its_stage(spark, tmp_path):
    work, seen = str(tmp_path), spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = spark.createDataFrame([(str(i), f"question {i}") for i in range(40)], QUESTIONS).mapInPandas(count, QUESTIONS)

    def broken(prompts):
        raise RuntimeError("model is away")

    with pytest.raises(Exception, match="model is away"):
        jobs.extract_kernel(rows, broken, jobs.Stages(spark, work, "day 1"))
    assert seen.value == 40 and jobs.Stages(spark, work, "day 1").finished() == ["extract_kernel"]
    again = jobs.extract_kernel(rows, lambda ps: ['{"text": "K"}'] * len(ps), jobs.Stages(spark, work, "day 1"))
    assert again.where("refined_question = 'K'").count() == 40
    assert seen.value == 40  # the stage before the break was not made again
    assert os.listdir(f"{work}/runs") == ["day 1"]
    jobs.Stages(spark, work, "day 1").clear()
    assert not os.path.exists(f"{work}/runs/day 1") and os.path.exists(f"{work}/extract_kernel")


def test_a_half_written_stage_and_other_settings_are_made_anew(spark, tmp_path):
    stages = jobs.Stages(spark, str(tmp_path), "r")
    os.makedirs(f"{stages.folder}/part/")
    open(f"{stages.folder}/part/part-0.parquet", "wb").write(b"cut off")
    assert stages.stored(spark.range(3).toDF("n"), "part", "one").count() == 3
    assert stages.stored(spark.range(5).toDF("n"), "part", "one").count() == 3
    assert stages.stored(spark.range(5).toDF("n"), "part", "two").count() == 5
    assert stages.finished() == ["part"]
    jobs.Stages(spark, str(tmp_path)).stored(spark.range(1).toDF("n"), "s")
    jobs.clear_unnamed(spark, str(tmp_path))
    assert os.listdir(tmp_path / "runs") == ["r"]


def test_kill_between_two_stages_of_tracing(spark, tmp_path, monkeypatch):
    """Jobs are stored, the runner breaks in a later wave: finished waves stay, only the rest is run again."""
    work = str(tmp_path)
    inputs = spark.range(60).selectExpr("concat('p', id % 3) AS problem_id", "'s' AS source", "cast(id AS string) AS input", "'1' AS expected_output", "id AS seq")
    codes = spark.createDataFrame([(f"p{i}", "python", "x", "a", None) for i in range(3)], "id string, language string, code string, analysis string, trace_plan string")
    ran = tmp_path / "ran"
    ran.mkdir()

    def runner(job):
        if not (tmp_path / "back").exists() and len(list(ran.iterdir())) >= 30:
            raise SystemExit("killed")
        open(ran / f"{job['stdin']}-{time.time_ns()}", "w").close()
        return {"return_code": 0, "stdout": "[TRACE] a | b=1\n1\n", "stderr": ""}

    stages = jobs.Stages(spark, work, "r")
    through = partial(exchange.exchange_through, waves=4)
    monkeypatch.setattr(exchange, "exchange_through", through)
    with pytest.raises(Exception, match="killed"):
        jobs.execute_instrumented(inputs, codes, runner, stages)
    kept = {r.stdout for r in exchange.ResponseStore(spark, f"{work}/traces", exchange.RUNS).read().collect()}
    n_kept = exchange.ResponseStore(spark, f"{work}/traces", exchange.RUNS).read().count()
    assert kept and 0 < n_kept < 60 and stages.finished() == ["traces"]
    (tmp_path / "back").touch()
    before = len(list(ran.iterdir()))
    found = jobs.execute_instrumented(inputs, codes, runner, stages)
    assert found.count() == 60 and found.where("output_matched").count() == 60
    assert len(list(ran.iterdir())) - before == 60 - n_kept  # only what was not kept ran again


def test_limits_of_solutions(spark):
    rows = [("a", 0, "x" * 11, "", "C++", "s"), ("a", 1, "x" * 10, "", "C++", "s"), ("a", 2, "y", "", "Go", "s"), ("a", 3, " ", "z", "Python 3", "s"), ("b", 0, "", "", "Java", "s")]
    df = spark.createDataFrame(rows, "id string, pos bigint, source string, og_source string, programmingLanguage string, submission_id string")
    counts = lambda **k: {r.status: r.n for r in shape.expand_funnel(df, **k).collect()}
    assert counts(max_code_len=10, allowed=["cpp", "java"]) == {"kept": 1, "too_long": 1, "language": 1, "empty": 2}
    assert counts() == {"kept": 3, "empty": 2}
    assert [r.pos for r in shape.expand_solutions(df, None, 10, ["cpp"]).orderBy("pos").collect()] == [1]
    long = spark.createDataFrame([("a", i, "x" * (7999 + i), "", "C++", "s") for i in range(3)], df.schema)
    assert shape.expand_solutions(long).agg(F.max(F.length("code"))).first()[0] == 8000


def test_a_resume_shuffles_the_jobs_only(spark, tmp_path):
    path = str(tmp_path / "history")
    done = sharding.DoneKeys(spark, path, "k", buckets=4)
    make = lambda low, high: spark.range(low, high).selectExpr("cast(id AS string) AS k", "id AS n")
    assert done.todo(make(0, 5)).count() == 5
    for low in (0, 100, 50):
        done.add(make(low, low + 100))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        todo = sharding.DoneKeys(spark, path, "k").todo(make(150, 300))
        plan = todo._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        assert sorted(r.n for r in todo.collect()) == list(range(200, 300))
        history, files = done.read(), done.files()
        done.compact()
        assert done.files() == 4 < files and done.read().count() == 200 and history.count() == 300
        os.makedirs(f"{done.root}/gen=2")  # a compaction that broke off
        done.add(make(200, 201))
        assert sorted(r.n for r in done.todo(make(150, 300)).collect()) == list(range(201, 300))
        done.compact()
        assert done.read().count() == 201 and not os.path.exists(f"{done.root}/gen=0")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
