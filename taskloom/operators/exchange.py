"""Prompts out, responses in.

A request is a row with an id, a message list and generation settings. The
model and the code runner are functions that the caller supplies; they run
batch-wise inside tasks. Their results are written to a table keyed by request
id before anything joins them back, so a retried task or a restarted job asks
only for what is missing.
"""

import random
import threading
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.functions.hashing import sha_id
from taskloom.functions.text import text_or_empty, token_count, truncate
from taskloom.operators.sharding import resume_antijoin
from taskloom.prompts import DEFAULT_TYPE, STAGES, TYPE_GUIDES
from taskloom.session import delete, exists, names_in, scratch_path, shuffle_width


def render_prompt(template: str, values: Sequence[tuple[str, Column]]) -> Column:
    """Replace ``{name}`` for each value in turn.

    One after the other on purpose: a placeholder inside an earlier value is
    replaced too, and doubled braces stay as they are.
    """
    text = F.lit(template)
    for name, value in values:
        text = F.replace(text, F.lit("{" + name + "}"), text_or_empty(value.cast("string")))
    return text


def hints_text(hints: Column) -> Column:
    return F.when(F.size(hints) > 0, F.array_join(hints.cast("array<string>"), ", ")).otherwise("none")


def render_corpus_prompt(template: str, text: Column, hints: Column, max_len: int = 2048) -> Column:
    return render_prompt(template, [("text", truncate(text, max_len)), ("rule_hints", hints_text(hints))])


def type_instruction(type_id: Column, lang: str = "en") -> Column:
    """Guide for a type; an unknown type gets the default one. Five literals, so no join."""
    guides = TYPE_GUIDES[lang]
    table = F.create_map(*[F.lit(v) for pair in guides.items() for v in pair])
    return F.coalesce(F.try_element_at(table, type_id), F.lit(guides[DEFAULT_TYPE]))


def chat_messages(user: Column, system: str | None = None) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    head = [message("system", F.lit(system))] if system is not None else []
    return F.array(*head, message("user", user))


def gen_params(stage: str) -> Column:
    """Sampling settings of a stage as a literal struct."""
    s = STAGES[stage]
    return F.struct(
        F.lit(s.batch_size).alias("batch_size"),
        F.lit(s.max_tokens).alias("max_tokens"),
        F.lit(s.max_model_len).alias("max_model_len"),
        F.lit(s.temperature).alias("temperature"),
        F.lit(s.top_p).cast("double").alias("top_p"),
        F.lit(s.top_k).cast("int").alias("top_k"),
        F.lit(s.repetition_penalty).cast("double").alias("repetition_penalty"),
        F.lit(s.seed).alias("seed"),
    )


def settings_text(stage: str) -> str:
    """The settings of a stage that shape its answers, as part of the request id."""
    s = STAGES[stage]
    shown = (s.max_tokens, s.max_model_len, s.temperature, s.top_p, s.top_k, s.repetition_penalty, s.seed)
    return ",".join("" if v is None else str(v) for v in shown)


def requests(rows: DataFrame, stage: str, row_key: Sequence[str], prompt: Column) -> DataFrame:
    """Add ``prompt``, ``messages``, ``params`` and a ``request_id`` that a retry reproduces.

    The id covers the prompt and the settings: after a change of either the model is asked again.
    """
    return (
        rows.withColumn("prompt", prompt)
        .withColumn("messages", chat_messages(F.col("prompt"), STAGES[stage].system))
        .withColumn("params", gen_params(stage))
        .withColumn("request_id", sha_id(F.lit(stage), F.lit(settings_text(stage)), *[F.col(c) for c in row_key], F.col("prompt")))
    )


def length_gate(
    reqs: DataFrame,
    max_model_len: int,
    max_tokens: int,
    token_len: Callable[[Column], Column] = token_count,
) -> DataFrame:
    """Add ``prompt_tokens`` and ``sendable``. Over-long rows stay and later carry an empty result."""
    return reqs.withColumn("prompt_tokens", token_len(F.col("prompt"))).withColumn(
        "sendable", F.col("prompt_tokens") <= max_model_len - max_tokens
    )


def _chunks(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Consecutive chunks of ``size`` rows across Arrow batches; the last may be shorter."""
    held: list[pd.DataFrame] = []
    n = 0
    for frame in frames:
        at = 0
        while at < len(frame):
            take = min(size - n, len(frame) - at)
            held.append(frame.iloc[at : at + take])
            at, n = at + take, n + take
            if n == size:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def infer_batches(
    reqs: DataFrame,
    complete: Callable[[list[str]], list[str]],
    batch_size: int,
    prompt: str = "prompt",
    gate: str | None = None,
) -> DataFrame:
    """Response table (request_id, raw): one stripped completion per request, in row order.

    ``complete`` gets at most ``batch_size`` prompts. Rows where ``gate`` is
    false are not sent and get ``''``.
    """
    columns = ["request_id", prompt] + ([gate] if gate else [])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _chunks(frames, batch_size):
            send = chunk[gate].astype(bool) if gate else pd.Series(True, index=chunk.index)
            prompts = chunk.loc[send, prompt].tolist()
            answers = complete(prompts) if prompts else []
            if len(answers) != len(prompts):
                raise ValueError(f"{len(prompts)} prompts gave {len(answers)} completions")
            raw = pd.Series("", index=chunk.index, dtype=object)
            raw.loc[send] = [a.strip() for a in answers]
            yield pd.DataFrame({"request_id": chunk["request_id"], "raw": raw})

    return reqs.select(*columns).mapInPandas(run, RESPONSES)


# The row of a job that never succeeded.
_FAILED = {"return_code": -1, "stdout": "", "stderr": "max retries exceeded"}
#: Jobs that a task gathers at least before it waits for all of them.
_CALLS = 1024


def _answers(
    todo: list[dict], run: Callable[[dict], dict], max_attempts: int, concurrency: int, wait: tuple[float, float], request_timeout: float
) -> list[tuple[dict, int]]:
    """The answer and the number of abandoned calls of each job.

    Threads take one job after the other, so a quick call costs no hand-over. This one only looks for calls that
    take too long: it abandons them, and another thread goes on in place of theirs, which ends if its call comes back.
    """
    out: list[tuple[dict, int]] = [(_FAILED, 0)] * len(todo)
    numbers, lock, ready = iter(range(len(todo))), threading.Lock(), threading.Event()
    calls: dict[object, tuple[float, int, int, int]] = {}  # by thread: start, job, attempt, calls of it that were abandoned
    errors, settled = [], 0

    def settle(i: int, answer: dict, abandoned: int) -> None:
        nonlocal settled
        out[i] = (answer, abandoned)
        settled += 1
        if settled == len(todo):
            ready.set()

    def serve(i: int | None, attempt: int = 0, abandoned: int = 0) -> None:
        me = object()
        while i is not None:
            if attempt:
                time.sleep(random.uniform(*wait))
            with lock:
                calls[me] = (time.monotonic(), i, attempt, abandoned)
            answer, failed = None, False
            try:
                answer = run(todo[i])
            except Exception:  # the runner is foreign code: any error means "try again"
                failed = True
            except BaseException as e:  # but for one that ends the task
                errors.append(e)
                ready.set()
                return
            attempt += 1
            with lock:
                if calls.pop(me, None) is None:
                    return
                if failed and attempt < max_attempts:
                    continue
                settle(i, _FAILED if failed else answer, abandoned)
            i, attempt, abandoned = next(numbers, None), 0, 0

    def start(*job) -> None:
        threading.Thread(target=serve, args=job, daemon=True).start()

    for _ in range(min(concurrency, len(todo))):
        if (i := next(numbers, None)) is not None:
            start(i)
    while todo and not ready.wait(min(request_timeout / 10, 0.1)):
        with lock:
            now = time.monotonic()
            late = [(me, call) for me, call in calls.items() if now - call[0] >= request_timeout]
            for me, (_, i, attempt, abandoned) in late:
                del calls[me]
                if attempt + 1 == max_attempts:
                    settle(i, _FAILED, abandoned + 1)
        for _, (_, i, attempt, abandoned) in late:
            start(*((i, attempt + 1, abandoned + 1) if attempt + 1 < max_attempts else (next(numbers, None),)))
    if errors:
        raise errors[0]
    return out


def run_batches(
    jobs: DataFrame,
    run: Callable[[dict], dict],
    run_timeout: int = 30,
    max_attempts: int = 3,
    concurrency: int = 100,
    wait: tuple[float, float] = (3.0, 5.0),
    request_timeout: float = 60,
) -> DataFrame:
    """Run table (request_id, success, return_code, stdout, stderr, abandoned) for (code, language, stdin) jobs.

    ``run`` handles one job and may raise; it is tried ``max_attempts`` times
    with a jittered wait, and a job that never succeeds becomes a failure row.
    ``run_timeout`` is handed to ``run``; a call that has not come back after
    ``request_timeout`` seconds counts as a failed attempt and is abandoned, so a
    runner that hangs never holds a task. ``abandoned`` counts such calls.
    ``concurrency`` bounds the calls that a task waits for.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _chunks(frames, max(4 * concurrency, _CALLS)):
            todo = [{**job, "run_timeout": run_timeout} for job in chunk.to_dict("records")]
            done, abandoned = zip(*_answers(todo, run, max_attempts, concurrency, wait, request_timeout))
            codes = [int(d.get("return_code", -1)) for d in done]
            yield pd.DataFrame({
                "request_id": chunk["request_id"],
                "success": [c == 0 for c in codes],
                "return_code": codes,
                "stdout": [d.get("stdout") or "" for d in done],
                "stderr": [d.get("stderr") or "" for d in done],
                "abandoned": abandoned,
            })

    return jobs.select("request_id", "code", "language", "stdin").mapInPandas(work, RUNS)


RESPONSES = "request_id string, raw string"
RUNS = "request_id string, success boolean, return_code int, stdout string, stderr string, abandoned int"

#: Buckets of a response store; requests of one wave, where the number of waves is not given; files that a bucket may gather.
BUCKETS, WAVE_ROWS, BUCKET_FILES = 8, 100_000, 64


def bucket_of(request_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(request_id), F.lit(buckets)).cast("int")


class ResponseStore:
    """Answers by request id, in buckets of the id's hash: a wave reads the buckets it works on and no others.

    ``path/buckets=<n>/gen=<g>/bucket=<b>`` holds appended files; the number of buckets is fixed with the first answer.
    ``compact`` writes the next generation, with few files a bucket. A generation counts once it is complete; the one
    before stays until the next compaction, for those who still read it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = RESPONSES, buckets: int = BUCKETS):
        found = [n for n in names_in(spark, path) if n.startswith("buckets=")]
        self.spark, self.schema = spark, schema
        self.buckets = int(found[0].split("=")[1]) if found else buckets
        self.root = f"{path}/buckets={self.buckets}"

    def _generations(self) -> list[int]:
        found = [int(n.split("=")[1]) for n in names_in(self.spark, self.root) if n.startswith("gen=")]
        return sorted(g for g in found if g == 0 or exists(self.spark, f"{self.root}/gen={g}/_SUCCESS"))

    def folder(self) -> str:
        return f"{self.root}/gen={(self._generations() or [0])[-1]}"

    def read(self, first: int = 0, last: int | None = None) -> DataFrame:
        """Answers of the buckets from first to last, with the column ``bucket``; only these are read."""
        folder, schema = self.folder(), f"{self.schema}, bucket int"
        if not exists(self.spark, folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(folder).where(F.col("bucket").between(first, self.buckets - 1 if last is None else last))

    def append(self, answers: DataFrame) -> None:
        answers.withColumn("bucket", bucket_of(F.col("request_id"), self.buckets)).write.mode("append").partitionBy("bucket").parquet(self.folder())

    def files(self) -> int:
        folder = self.folder()
        return sum(len([f for f in names_in(self.spark, f"{folder}/{b}") if f.endswith(".parquet")]) for b in names_in(self.spark, folder) if b.startswith("bucket="))

    def compact(self) -> None:
        generations = self._generations() or [0]
        rows = self.read().hint("rebalance", "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/gen={generations[-1] + 1}")
        for old in generations[:-1]:
            delete(self.spark, f"{self.root}/gen={old}")


def exchange_through(
    reqs: DataFrame, path: str, answer: Callable[[DataFrame], DataFrame], schema: str = RESPONSES,
    waves: int | None = None, parallelism: int | None = None, wave_rows: int = WAVE_ROWS, bucket_files: int = BUCKET_FILES,
    dealt: int | None = None,
) -> DataFrame:
    """Answer the requests that the store at ``path`` does not hold yet, append them, and return the table.

    Each distinct request id is asked once. The ids are dealt into buckets and the
    buckets into waves, as many as given or as hold some ``wave_rows`` requests
    each. A wave is committed before the next begins, so a run that fails keeps
    the answers of its finished waves, and a restart asks only for the rest.
    Requests and answers lie by bucket, so all waves together read each of them
    once. Inside a wave the calls go to ``parallelism`` tasks (default: the shuffle
    partitions, or as many as read the wave's files, if those are enough for all cores of a first run);
    a given number is not coalesced by size, as a call's cost is not its bytes. Run it with speculation off.

    ``reqs`` is written by bucket first, unless it already lies by a column ``bucket``
    of as many buckets as the store has (``by_bucket``): ``dealt`` says so.
    """
    spark = reqs.sparkSession
    store = ResponseStore(spark, path, schema, dealt or waves or BUCKETS)
    n = parallelism or shuffle_width(spark)
    if dealt != store.buckets:
        place = scratch_path(spark, "requests")
        laid = by_bucket(reqs.drop("bucket"), store.buckets)
        laid.write.partitionBy("bucket").parquet(place)
        reqs = spark.read.schema(laid.schema).parquet(place)
    named = reqs.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    waves, once = min(store.buckets, waves or max(1, -(-(named[0] or 0) // wave_rows))), named[1] == 1
    # A first run over many files sends them as they lie: nothing is answered yet, and each file is a task of its own.
    as_laid = once and parallelism is None and not store.files() and len(reqs.inputFiles()) >= waves * spark.sparkContext.defaultParallelism
    edges = [store.buckets * i // waves for i in range(waves + 1)]
    for first, last in zip(edges, edges[1:]):
        if first < last:
            laid = reqs.where(F.col("bucket").between(first, last - 1)).drop("bucket")
            store.append(answer(laid if as_laid else wave_of(reqs, store, first, last - 1, n, once)))
    if store.files() > bucket_files * store.buckets:
        store.compact()
    return store.read().drop("bucket")


def with_bucket(reqs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return reqs.withColumn("bucket", bucket_of(F.col("request_id"), buckets))


def by_bucket(reqs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Requests dealt to the tasks by bucket, for a table that waves read one part of."""
    return with_bucket(reqs, buckets).hint("rebalance", "bucket")


def wave_of(reqs: DataFrame, store: ResponseStore, first: int, last: int, tasks: int | None = None, once: bool = False) -> DataFrame:
    """The requests of some buckets that have no answer yet, each once, dealt to a number of tasks if one is given.

    ``once`` says that no id occurs twice: the prompts are then moved once, to the tasks that send them. Otherwise
    copies are left out before they move, as a single id may have most of the rows.
    """
    asked, done = reqs.where(F.col("bucket").between(first, last)).drop("bucket"), store.read(first, last)
    if once and tasks:
        # Not an anti-join, which the optimizer moves below the repartition: that would be a second move.
        known = done.select("request_id", F.lit(True).alias("_known"))
        # A join deals fewer parts than the shuffle partitions anew, so it gets a multiple of the tasks.
        parts = tasks * -(-shuffle_width(reqs.sparkSession) // tasks)
        todo = asked.repartition(parts, "request_id").join(known, "request_id", "left").where(F.col("_known").isNull()).drop("_known")
        return todo.coalesce(tasks) if tasks < parts else todo
    todo = resume_antijoin(asked.dropDuplicates(["request_id"]), done, "request_id")
    return todo.repartition(tasks, "request_id") if tasks else todo


def attach_responses(reqs: DataFrame, responses: DataFrame, out: str) -> DataFrame:
    """Row-aligned result column; requests without an answer keep null."""
    return reqs.join(responses.select("request_id", F.col("raw").alias(out)), "request_id", "left")
