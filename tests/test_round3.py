"""Faults that larger or otherwise laid out tables showed."""

import threading
import time

from pyspark.sql import functions as F

from taskloom.operators import exchange, runs
from taskloom.plans import fixtures, jobs
from taskloom.plans.catalog import QUERIES
from taskloom.session import names_in, shared_dir

DOCS = "doc_id bigint, text string, lang string, source string, n_chars int"
TEXT = "In the year 1999 they went north to the river and at noon came back to the town near the bridge. " * 8


def test_intake_of_a_table_in_several_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{TEXT}{i}" if i % 3 else "short", "en", "web", 1) for i in range(30)], DOCS)
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "one" / "whole"))
    next((tmp_path / "one" / "whole").glob("*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    many, one = (sorted(map(tuple, QUERIES["resume_incremental"](spark, str(tmp_path / d)).collect())) for d in ("many", "one"))
    assert many == one and [r[0] for r in many] == [i for i in range(30) if i % 3]


def test_events_of_one_row_group_are_dealt_to_all_tasks(spark, tmp_path):
    rows = spark.range(120_000).selectExpr("id AS event_id", "id % 1000 AS user_id", "'view' AS event_type")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")  # more splits than cores, all but one of them empty
    try:
        cases = fixtures.load(spark, str(tmp_path), "eval_cases").select("seq", F.spark_partition_id().alias("task"))
        sizes = [r["count"] for r in cases.groupBy("task").count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(sizes) == 120_000 and max(sizes) <= 20_000


def test_tasks_of_events_grow_in_number_and_not_in_size(spark, tmp_path):
    spark.range(1_000_000).selectExpr("id AS event_id", "id % 1000 AS user_id", "'view' AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    cases = fixtures.load(spark, str(tmp_path), "runs").select("seq", F.spark_partition_id().alias("task"))
    assert max(r["count"] for r in cases.groupBy("task").count().collect()) <= 60_000


def test_label_stats_make_the_events_once(spark, capsys):
    out = "[TRACE] a | x=1 | y=2\n[TRACE] a | x=3\n[TRACE] b\n"
    rows = spark.createDataFrame([(1, "p", out), (2, "p", "[TRACE] a | z=1"), (3, None, "[TRACE] a | z=1")], "seq bigint, problem_id string, stdout string")
    stats = runs.trace_label_stats(runs.trace_events(runs.split_trace(rows)))
    stats.explain()
    assert capsys.readouterr().out.count("Scan ExistingRDD") == 1
    assert sorted(map(str, map(tuple, stats.collect()))) == sorted(map(str, [("p", "a", 3, 3), ("p", "b", 1, 0), (None, "a", 1, 0)]))


def test_quick_calls_cost_no_thread_each(spark):
    todo = spark.range(3000).selectExpr("cast(id AS string) AS request_id", "if(id % 50 = 7, 'bad', 'ok') AS code", "'cpp' AS language", "cast(id AS string) AS stdin").coalesce(1)

    def run(job):
        if job["code"] == "bad":
            raise OSError("no connection")
        return {"return_code": 0, "stdout": f"{job['stdin']} {threading.get_ident()}", "stderr": ""}

    got = {r.request_id: r for r in exchange.run_batches(todo, run, concurrency=4, wait=(0, 0)).collect()}
    assert len(got) == 3000 and all(r.success == (int(i) % 50 != 7) and r.abandoned == 0 for i, r in got.items())
    assert all(r.stdout.split()[0] == i for i, r in got.items() if r.success)


def test_calls_at_once_are_bounded_and_a_late_one_is_tried_again(spark):
    todo = spark.range(24).selectExpr("cast(id AS string) AS request_id", "if(id = 5, 'late', 'ok') AS code", "'cpp' AS language", "'' AS stdin").coalesce(1)

    def run(job, seen={}):
        n = seen[job["request_id"]] = seen.get(job["request_id"], 0) + 1
        if job["code"] == "late" and n == 1:
            time.sleep(5)
        now = seen["now"] = seen.get("now", 0) + 1
        time.sleep(0.05)
        seen["now"] -= 1
        return {"return_code": 0, "stdout": f"{now}", "stderr": ""}

    got = {r.request_id: r for r in exchange.run_batches(todo, run, concurrency=3, wait=(0, 0), request_timeout=1).collect()}
    assert all(r.success and int(r.stdout) <= 3 for r in got.values())
    assert got["5"].abandoned == 1 and sum(r.abandoned for r in got.values()) == 1


def _asking(spark, work, n, seen, copies=1):
    """``ask`` over n rows (times copies) in 24 tasks; the model counts what it gets."""
    def complete(prompts):
        seen.add(len(prompts))
        return [str(len(p)) for p in prompts]

    rows = spark.range(n, numPartitions=24).selectExpr("cast(id AS string) AS id", f"explode(sequence(1, {copies})) AS copy", "concat('q', id) AS question").drop("copy")
    return jobs.ask(rows, "extract_kernel", ["id"], {"question": F.col("question")}, complete, jobs.Stages(spark, work, f"run-{n}"), "raw", waves=2)


def test_stages_keep_no_prompts_and_a_first_run_moves_none(spark, tmp_path):
    work, seen = str(tmp_path), spark.sparkContext.accumulator(0)
    got = {r.id: r.raw for r in _asking(spark, work, 400, seen).collect()}
    assert seen.value == 400 and len(got) == 400 and all(int(v) - len(k) == int(got["0"]) - 1 for k, v in got.items())
    assert "prompt" not in spark.read.parquet(f"{work}/runs/run-400/extract_kernel").columns
    more = {r.id: r.raw for r in _asking(spark, work, 500, seen).collect()}  # asks for the new rows only
    assert seen.value == 500 and len(more) == 500 and all(more[k] == v for k, v in got.items())


def test_copies_of_a_request_are_asked_once_in_a_first_run(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    assert _asking(spark, str(tmp_path), 100, seen, copies=3).where("raw IS NOT NULL").count() == 300 and seen.value == 100


def test_unique_requests_are_shuffled_once(spark, tmp_path, capsys):
    reqs = spark.range(50).selectExpr("cast(id AS string) AS request_id", "'p' AS prompt", "0 AS bucket")
    store = exchange.ResponseStore(spark, str(tmp_path), buckets=1)
    store.append(spark.createDataFrame([("3", "a"), ("4", "a")], "request_id string, raw string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wave = exchange.wave_of(reqs, store, 0, 0, 4, True)
        wave.explain()
        assert capsys.readouterr().out.count("Exchange hashpartitioning") == 2  # the requests and the answers
        assert wave.columns == ["request_id", "prompt"] and {r.request_id for r in wave.collect()} == {str(i) for i in range(50)} - {"3", "4"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_intake_files_are_of_bounded_size(spark, tmp_path):
    docs = spark.range(48_000).selectExpr("id AS doc_id", "concat('In 1999 they went north, ', id) AS text", "'en' AS lang", "'web' AS source", "1 AS n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = set(names_in(spark, shared_dir(spark)))
    QUERIES["intake_two_sinks"](spark, str(tmp_path))
    files, = (n for n in set(names_in(spark, shared_dir(spark))) - before if n.startswith("corpus-files-"))
    sizes = spark.read.parquet(f"{shared_dir(spark)}/{files}").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in sizes) == 48_000 and max(r["count"] for r in sizes) <= 5000
