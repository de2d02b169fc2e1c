"""Every operator as a query over the given tables."""

import hashlib
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.functions import lexicon
from taskloom.functions import text as t
from taskloom.functions.hashing import sha_id
from taskloom.functions.language import language_detect, language_runner
from taskloom.functions.strict_json import json_fields, parse_last_block
from taskloom.functions.tokens import tokenizer_length
from taskloom.operators import checks, corpus, exchange, export, joins, observed, pairing, responses, runs, shape, sharding
from taskloom.plans import fixtures, jobs
from taskloom.prompts import STAGES
from taskloom.session import scratch_path, written
from taskloom.sources import jsonl, shards
from taskloom.streaming import intake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Inputs:
    """The derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in fixtures.FIXTURES:
            return fixtures.load(self.spark, self.sf_dir, name)
        raise AttributeError(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)

    @cached_property
    def features(self) -> DataFrame:
        return corpus.corpus_features(self.corpus_raw)

    @cached_property
    def hinted(self) -> DataFrame:
        return corpus.rule_hints(self.features)

    @cached_property
    def classified(self) -> DataFrame:
        kept = corpus.rule_filter(self.hinted).withColumn("text", t.truncate(F.col("text"), 2048))
        return corpus.classified_corpus(kept.select("doc_id", "text", "rule_hints"), self.corpus_responses, "doc_id")

    @cached_property
    def buckets(self) -> DataFrame:
        """Buckets from the rule hints, so that they need no model."""
        kept = corpus.rule_filter(self.hinted).withColumn("suitable_types", F.col("rule_hints"))
        return corpus.type_buckets(kept, "doc_id")

    @cached_property
    def ruled(self) -> DataFrame:
        """Hinted texts as a written table, which pairing reads several times."""
        kept = corpus.rule_filter(self.hinted).select("doc_id", "text", F.col("rule_hints").alias("suitable_types"))
        return written(kept, "ruled")

    @cached_property
    def listing(self) -> DataFrame:
        return corpus.type_listing(self.ruled, "doc_id")

    @cached_property
    def texts(self) -> DataFrame:
        return corpus.corpus_texts(self.ruled, "doc_id")

    @cached_property
    def templates(self) -> DataFrame:
        """Parsed templates as a written table: numbering and counting read them again."""
        kept = responses.story_templates(self.stories)
        return written(kept.select("id", "seq", "story_problem", "story_input"), "templates")

    @cached_property
    def codes(self) -> DataFrame:
        return responses.instrumented_code(self.instrumented)

    @cached_property
    def split_runs(self) -> DataFrame:
        return runs.split_trace(self.runs)

    @cached_property
    def cot_rows(self) -> DataFrame:
        return responses.cot_fields(self.cot)


def query(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
    return f


def _ints(col: str):
    return F.array_join(F.col(col).cast("array<string>"), ",")


def _big(col: str):
    return F.col(col).cast("bigint").alias(col)


# --- sources and sinks -------------------------------------------------------

@query
def read_jsonl(x: Inputs) -> DataFrame:
    """Response lines written as text and read as JSON lines; bad lines are kept as empty records."""
    path = x.scratch("jsonl")
    x.corpus_responses.select(F.col("raw").alias("value")).write.text(path)
    found = jsonl.read_jsonl(x.spark, path, "suitable_types array<string>, reasons map<string,string>", "keep", "*.txt")
    return found.groupBy(
        F.col("_bad_line").isNotNull().alias("bad_line"), F.array_join("suitable_types", ",").alias("types")
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def read_jsonl_ordered(x: Inputs) -> DataFrame:
    """A list of two files of response lines, of many blocks each, read in order; bad lines are dropped and leave gaps."""
    size, root = "spark.sql.files.maxPartitionBytes", x.scratch("lines")
    paths = [f"{root}/{i}" for i in range(2)]
    for i, path in enumerate(paths):
        part = x.corpus_responses.where(F.col("doc_id") % 2 == i)
        part.coalesce(1).sortWithinPartitions("doc_id").select(F.col("raw").alias("value")).write.text(path)
    before = x.spark.conf.get(size)
    x.spark.conf.set(size, str(64 << 10))  # blocks of 64 kB
    try:
        found = jsonl.read_jsonl(x.spark, paths, "suitable_types array<string>", "drop", "*.txt", seq="seq")
        return written(found.select("seq", F.array_join("suitable_types", ",").alias("types")), "ordered")
    finally:
        x.spark.conf.set(size, before)


@query
def read_shards(x: Inputs) -> DataFrame:
    path = x.scratch("shards")
    shards.write_shards(sharding.shard_ceil(x.eval_cases, "seq", 16).select("eval_id", "seq", "shard"), path)
    return shards.read_shards(x.spark, path, 3, 9).select("eval_id", "seq", _big("shard"))


@query
def shard_read_report(x: Inputs) -> DataFrame:
    """Rows of every stored shard, and whether its files could be read."""
    path = x.scratch("shards")
    shards.write_shards(sharding.shard_ceil(x.eval_cases, "seq", 16).select("eval_id", "seq", "shard"), path)
    found = shards.read_report(x.spark, path)
    return found.groupBy(F.regexp_extract("path", r"shard=(\d+)", 1).cast("bigint").alias("shard")).agg(
        F.every("readable").alias("readable"), F.sum("rows").alias("n"))


@query
def union_inputs(x: Inputs) -> DataFrame:
    return shards.union_inputs(
        x.eval_cases.select("problem_id", "source", "input"), x.trace_runs.select("problem_id", "input")
    )


@query
def write_shards(x: Inputs) -> DataFrame:
    path = x.scratch("shards")
    shards.write_shards(sharding.shard_contiguous(x.eval_cases, "seq", 7), path)
    return shards.read_shards(x.spark, path).groupBy(_big("shard")).agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


@query
def append_jsonl(x: Inputs) -> DataFrame:
    """Two batches of records with non-ASCII text, one of them appended twice, read back strictly."""
    path = x.scratch("appended")
    docs, items = x.table("documents").select("doc_id", "text"), x.table("benchmark").selectExpr("-1 - item_id AS doc_id", "text")
    for batch, part in (("documents", docs), ("items", items), ("documents", docs)):  # the repeated batch is left alone
        jsonl.append_jsonl(part, path, batch)
    return jsonl.appended(x.spark, path, "doc_id bigint, text string")


@query
def two_way_sink(x: Inputs) -> DataFrame:
    path = x.scratch("two-way")
    numbered = sharding.shard_modulo(x.corpus_raw, "seq", 4)
    hinted = corpus.rule_filter(corpus.rule_hints(corpus.corpus_features(numbered)))
    kept = written(hinted.select("doc_id", "text", "rule_hints", "shard"), "kept")
    answered = corpus.classified_corpus(kept, x.corpus_responses, "doc_id", keep=("shard",))
    shards.two_way_sink(kept, answered, path)
    both = [
        x.spark.read.schema("doc_id bigint, shard int").json(f"{path}/{name}").withColumn("sink", F.lit(name))
        for name in ("rule", "model")
    ]
    return shards.union_inputs(*both).groupBy("sink", _big("shard")).agg(F.count(F.lit(1)).alias("n"))


# --- record shaping ----------------------------------------------------------

@query
def problem_text_classify(x: Inputs) -> DataFrame:
    return x.qa.select("id", shape.problem_text_classify().alias("question"))


@query
def problem_text_full(x: Inputs) -> DataFrame:
    return x.qa.select("id", shape.problem_text().alias("problem"))


@query
def problem_text_note(x: Inputs) -> DataFrame:
    return x.qa.select("id", shape.problem_text(with_note=True).alias("problem"))


@query
def tags_editorial(x: Inputs) -> DataFrame:
    return x.qa.select("id", shape.tags_text().alias("tags"), shape.editorial_text().alias("editorial"))


def _known_solutions(x: Inputs) -> DataFrame:
    """Solutions of known problems, and one empty row for a problem without any."""
    ids = x.qa.select("id")
    known = joins.lookup_join(x.solutions, ids, ["id"], ["pos"])
    return known.unionByName(ids.join(x.solutions.select("id"), "id", "left_anti"), allowMissingColumns=True)


@query
def solution_rows(x: Inputs) -> DataFrame:
    return shape.solution_rows(x.qa).select("id", F.coalesce("pos", F.lit(-1)).alias("pos"), "source", "og_source", "programmingLanguage", "submission_id")


@query
def expand_solutions(x: Inputs) -> DataFrame:
    kept = shape.expand_solutions(_known_solutions(x))
    return kept.select("id", "pos", "code", "language", "submission_id", "solution_idx")


@query
def expand_solutions_sampled(x: Inputs) -> DataFrame:
    kept = shape.expand_solutions(_known_solutions(x), 2, 8000, None)
    return kept.select("id", "pos", "language", "solution_idx")


def _counts(x: Inputs, column: str, counts: dict[str, int]) -> DataFrame:
    return x.spark.createDataFrame(list(counts.items()), f"{column} string, n bigint")


@query
def expand_funnel(x: Inputs) -> DataFrame:
    """The usable solutions are written, and every status is counted on the way."""
    rows = shape.solution_status(_known_solutions(x), 8000)
    kept, counts = observed.kept_and_counts(rows, "status", ["kept", "empty", "language", "too_long"], x.scratch("solutions"))
    return _counts(x, "status", counts)


@query
def language_detect_names(x: Inputs) -> DataFrame:
    return x.solutions.groupBy(
        "programmingLanguage", language_detect(F.col("programmingLanguage")).alias("language")
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def language_runner_names(x: Inputs) -> DataFrame:
    return x.solutions.groupBy(
        "programmingLanguage", language_runner(F.col("programmingLanguage")).alias("runner")
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def first_code(x: Inputs) -> DataFrame:
    return shape.first_code(x.solutions)


@query
def rating_lookup(x: Inputs) -> DataFrame:
    ratings = shape.rating_lookup(x.qa_twice)
    rows = joins.lookup_join(x.stories.select("id", "seq"), ratings, ["id"], ["seq"], "left")
    return rows.select("seq", "id", F.coalesce("rating", F.lit(0)).cast("bigint").alias("rating"))


@query
def text_truncate(x: Inputs) -> DataFrame:
    return x.table("documents").select("doc_id", t.truncate(F.col("text"), 2048).alias("text"))


# --- corpus ------------------------------------------------------------------

@query
def corpus_features(x: Inputs) -> DataFrame:
    whole = ("text_len", "token_count", "digit_tokens", "list_lines", "line_count", "temporal_score", "spatial_score")
    return x.features.select(
        "doc_id", *[_big(c) for c in whole], "has_table", "numeric_ratio", "list_density", "is_prose"
    )


@query
def rule_hints(x: Inputs) -> DataFrame:
    return x.hinted.select("doc_id", _ints("rule_hints").alias("hints"))


@query
def rule_filter(x: Inputs) -> DataFrame:
    """The hinted texts are written, and what is left out is counted on the way."""
    rows = corpus.rule_status(x.hinted).select("doc_id", "text", "rule_hints", "status")
    kept, counts = observed.kept_and_counts(rows, "status", ["kept", "no_hint", "empty"], x.scratch("hinted"))
    return _counts(x, "status", counts)


@query
def suitable_types(x: Inputs) -> DataFrame:
    parsed = x.corpus_responses.withColumn("_p", parse_last_block(F.col("raw")))
    typed = parsed.withColumn("types", corpus.suitable_types(F.col("_p.types")))
    return typed.select("doc_id", _ints("types").alias("types"))


@query
def classified_corpus(x: Inputs) -> DataFrame:
    reasons = F.array_join(F.array_sort(F.transform(
        F.map_entries("reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return x.classified.select(
        "doc_id", "text", _ints("rule_hints").alias("hints"), _ints("suitable_types").alias("types"),
        reasons.alias("reasons"), "raw_output", "parse_ok",
    )


@query
def type_buckets(x: Inputs) -> DataFrame:
    return corpus.type_buckets(x.classified, "doc_id").select("corpus_id", _big("type_id"), "corpus_text")


@query
def bucket_counts(x: Inputs) -> DataFrame:
    return corpus.bucket_counts(x.buckets).select(_big("type_id"), "entries")


@query
def hint_vs_model(x: Inputs) -> DataFrame:
    return corpus.hint_vs_model(x.classified).select(_big("type_id"), "outcome", "n")


# --- typed pairing -----------------------------------------------------------

@query
def resolve_type(x: Inputs) -> DataFrame:
    return x.qa.select("id", pairing.resolve_type(F.col("type_level1")).cast("bigint").alias("type_id"))


def _pairs(x: Inputs, k: int, **options) -> DataFrame:
    problems = x.qa.select("id", "type_level1")
    return pairing.typed_pairs(problems, x.listing, x.texts, k, **options).select(
        "id", _big("type_id"), "route", _big("sample_idx"), "corpus_id", "corpus_text"
    )


@query
def typed_pairs(x: Inputs) -> DataFrame:
    return _pairs(x, 3)


@query
def typed_pairs_cycled(x: Inputs) -> DataFrame:
    """More draws than the small pools hold; ids only."""
    picks = pairing.typed_picks(x.qa.select("id", "type_level1"), x.listing, 45)
    return picks.select("id", _big("type_id"), "route", _big("sample_idx"), "corpus_id")


def _without_types(x: Inputs, *types: int) -> DataFrame:
    return x.listing.where(~F.col("type_id").isin(*types))


@query
def pair_fallback(x: Inputs) -> DataFrame:
    """Types 1 and 3 left empty, so their problems draw from all buckets."""
    pairs = pairing.typed_picks(x.qa.select("id", "type_level1"), _without_types(x, 1, 3), 2)
    return pairs.select("id", _big("type_id"), "route", _big("sample_idx"), "corpus_id")


@query
def pair_stats(x: Inputs) -> DataFrame:
    sizes = pairing.pool_sizes(_without_types(x, 1, 3))
    both = [pairing.pair_stats(x.qa, sizes, strict).withColumn("strict", F.lit(strict)) for strict in (False, True)]
    return shards.union_inputs(*both)


@query
def segment_sample(x: Inputs) -> DataFrame:
    kept = pairing.segment_sample(x.eval_cases.select("seq", "eval_id"), "seq", "eval_id")
    return kept.select("seq", "eval_id", "segment")


# --- shards and resume -------------------------------------------------------

@query
def shard_contiguous(x: Inputs) -> DataFrame:
    return sharding.shard_contiguous(x.eval_cases.select("eval_id", "seq"), "seq", 7).select("eval_id", "ord", _big("shard"))


@query
def shard_ceil(x: Inputs) -> DataFrame:
    return sharding.shard_ceil(x.eval_cases.select("eval_id", "seq"), "seq", 16).select("eval_id", "ord", _big("shard"))


@query
def shard_modulo(x: Inputs) -> DataFrame:
    return sharding.shard_modulo(x.corpus_raw.select("doc_id", "seq"), "seq", 5).select("doc_id", "ord", _big("shard"))


@query
def resume_antijoin(x: Inputs) -> DataFrame:
    return sharding.resume_antijoin(x.eval_cases, x.done_keys, "eval_id").select("eval_id", "seq")


@query
def resume_history(x: Inputs) -> DataFrame:
    """The same against a stored history of three appends, compacted once: only the cases are shuffled."""
    done = sharding.DoneKeys(x.spark, x.scratch("history"), "eval_id", buckets=8)
    for i in range(3):
        done.add(x.done_keys.where(F.pmod(F.xxhash64("eval_id"), F.lit(3)) == i))
        if i == 1:
            done.compact()
    return done.todo(x.eval_cases).select("eval_id", "seq")


@query
def resume_incremental(x: Inputs) -> DataFrame:
    """The streaming intake over the documents, run to the end of what is there."""
    out = x.scratch("intake")
    raw = x.table("documents").schema
    source = intake.corpus_stream(  # the table is one file or a folder of files
        x.spark, f"{x.sf_dir.rstrip('/')}/documents.parquet", raw, "parquet", recursiveFileLookup="true"
    ).selectExpr(*[f"{e} AS `{c}`" for c, e in fixtures.corpus_raw(fixtures.Dialect("spark"))[0][1].items()])
    intake.intake(source, out, x.scratch("intake-checkpoint"), "doc_id").awaitTermination()
    return x.spark.read.parquet(f"{out}/rule").select("doc_id", "text", _ints("rule_hints").alias("hints"))


def _by_length(prompts: list[str]) -> list[str]:
    return [f'{{"suitable_types": [{1 + len(p) % 5}], "reasons": {{}}}}' for p in prompts]


@query
def intake_two_sinks(x: Inputs) -> DataFrame:
    """The streaming intake with both sinks, over four micro-batches that are committed one by one."""
    source, out = x.scratch("corpus-files"), x.scratch("intake")
    # Files of bounded size, so that the tasks of a batch are even and grow in number with the input.
    width = max(8, x.corpus_raw.rdd.getNumPartitions())
    x.corpus_raw.repartition(width, "doc_id").write.option("maxRecordsPerFile", 5000).parquet(source)
    n = len(x.spark.read.parquet(source).inputFiles())
    stream = intake.corpus_stream(x.spark, source, x.corpus_raw.schema, "parquet", files_per_batch=-(-n // 4))
    intake.intake(stream, out, x.scratch("intake-checkpoint"), "doc_id", _by_length).awaitTermination()
    rule = intake.taken_in(x.spark, out, "rule").select(F.lit("rule").alias("sink"), "doc_id", _ints("rule_hints").alias("types"))
    return rule.unionByName(intake.taken_in(x.spark, out, "model").select(F.lit("model").alias("sink"), "doc_id", _ints("suitable_types").alias("types")))


@query
def request_batches(x: Inputs) -> DataFrame:
    return sharding.request_batches(x.eval_cases.select("eval_id", "seq"), "seq", 64).select("eval_id", "batch")


# --- prompts and exchange ----------------------------------------------------

def _synthesis_prompt(x: Inputs) -> DataFrame:
    """Stories as passages; the passage names a later placeholder on purpose."""
    stage = STAGES["synthesize"]
    passage = F.concat("corpus_text", F.lit(" {problem} {{x}}"))
    prompt = exchange.render_prompt(stage.template, [
        ("type_id", F.col("type_id")), ("type_instruction", exchange.type_instruction(F.col("type_id"))),
        ("text", passage), ("problem", F.concat(F.lit("Solve "), "title")),
    ])
    return exchange.requests(x.stories, "synthesize", ["seq"], prompt)


@query
def render_prompt(x: Inputs) -> DataFrame:
    return _synthesis_prompt(x).select("seq", "prompt")


@query
def render_corpus_prompt(x: Inputs) -> DataFrame:
    stage = STAGES["classify_corpus"]
    prompt = exchange.render_corpus_prompt(stage.template, F.col("text"), F.col("rule_hints"))
    return x.hinted.select("doc_id", prompt.alias("prompt"))


@query
def type_instruction(x: Inputs) -> DataFrame:
    shown = x.eval_cases.withColumn("type_id", F.col("type_id") + F.when(F.col("seq") % 7 == 0, 40).otherwise(0))
    return shown.groupBy(_big("type_id"), exchange.type_instruction(F.col("type_id")).alias("guide")).agg(F.count(F.lit(1)).alias("n"))


@query
def chat_messages(x: Inputs) -> DataFrame:
    rows = _synthesis_prompt(x).select("seq", F.posexplode("messages").alias("place", "_m"))
    return rows.select("seq", _big("place"), "_m.role", F.md5("_m.content").alias("content_md5"))


@query
def gen_params(x: Inputs) -> DataFrame:
    return _synthesis_prompt(x).select(
        "request_id", "params.temperature", "params.top_p", "params.repetition_penalty",
        *[F.col(f"params.{c}").cast("bigint").alias(c) for c in ("batch_size", "max_tokens", "max_model_len", "top_k", "seed")],
    )


def _count_words(prompts: list[str]) -> list[str]:
    """Stand-in for a model: a padded answer that depends on the prompt alone."""
    return [f"  words: {len(p.split())}\n" for p in prompts]


@query
def infer_batches(x: Inputs) -> DataFrame:
    """Requests answered through a written response table and joined back."""
    reqs = written(_synthesis_prompt(x).select("seq", "request_id", "prompt"), "requests")
    path = x.scratch("responses")
    table = exchange.exchange_through(reqs, path, lambda r: exchange.infer_batches(r, _count_words, STAGES["synthesize"].batch_size))
    return exchange.attach_responses(reqs.select("seq", "request_id"), table, "synthesis_result").select("seq", "synthesis_result")


def _case_requests(x: Inputs) -> DataFrame:
    """Eval cases as requests, named by their content."""
    return x.eval_cases.select("seq", "input", sha_id(F.lit("case"), F.col("input")).alias("request_id"), F.col("input").alias("prompt"))


def _lengths(prompts: list[str]) -> list[str]:
    return [str(len(p)) for p in prompts]


@query
def exchange_repeated_rows(x: Inputs) -> DataFrame:
    """Equal requests are asked once, and every row gets its answer."""
    copies = F.explode(F.when(F.col("seq") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    reqs = written(_case_requests(x).withColumn("copy", copies), "repeated")
    table = exchange.exchange_through(reqs.select("request_id", "prompt"), x.scratch("answers"), lambda r: exchange.infer_batches(r, _lengths, 64), waves=2)
    return exchange.attach_responses(reqs, table, "answer").select("seq", "input", _big("copy"), "answer")


@query
def exchange_resumed(x: Inputs) -> DataFrame:
    """A first run answers the even cases; a second one over all asks only for the rest."""
    reqs = written(_case_requests(x).withColumn("request_id", F.col("seq").cast("string")), "resumed")
    path = x.scratch("answers")

    def by(name: str):
        return lambda r: exchange.infer_batches(r, lambda prompts: [name] * len(prompts), 64)

    exchange.exchange_through(reqs.where("seq % 2 = 0"), path, by("first"), waves=2)
    table = exchange.exchange_through(reqs, path, by("second"), waves=2)
    return exchange.attach_responses(reqs, table, "answered_by").groupBy("answered_by").agg(F.count(F.lit(1)).alias("n"))


@query
def resume_added_inputs(x: Inputs) -> DataFrame:
    """Inputs that were run before stay done when others are added, also in front of them."""
    inputs = x.eval_cases.select("problem_id", "source", "input", "seq")
    done = joins.with_run_key(inputs.where("seq % 4 <> 0")).select("run_key")
    todo = sharding.resume_antijoin(joins.with_run_key(inputs), written(done, "done"), "run_key")
    return todo.groupBy("problem_id", "source", "input").agg(F.count(F.lit(1)).alias("n"))


@query
def length_gate(x: Inputs) -> DataFrame:
    """Prompts beyond the budget are not sent and carry an empty result."""
    reqs = exchange.length_gate(_synthesis_prompt(x), 400, 100)
    answers = exchange.infer_batches(reqs, _count_words, 100, gate="sendable")
    rows = exchange.attach_responses(reqs.select("seq", "request_id", "prompt_tokens", "sendable"), answers, "result")
    return rows.select("seq", _big("prompt_tokens"), "sendable", "result")


def length_gate_tokens(x: Inputs) -> DataFrame:
    """Documents as prompts, gated by a tokenizer's own count of their tokens."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        count = tokenizer_length(f.read())
    reqs = jsonl.spread(x.table("documents")).select("doc_id", F.col("text").alias("prompt"))
    return exchange.length_gate(reqs, 1024, 512, count).select("doc_id", "prompt_tokens", "sendable")


#: No SQL counts tokens; a test holds this against the whole tokenizer.
UNCHECKED = {"length_gate_tokens"}
QUERIES["length_gate_tokens"] = lambda spark, sf_dir: length_gate_tokens(Inputs(spark, sf_dir))


# --- whole jobs over all rows, with stand-ins for the model and the runner -----

def _digests(prompts: list[str]) -> list[str]:
    """Stand-in for a model whose answer depends on every character of the prompt."""
    return [hashlib.md5(p.encode()).hexdigest() for p in prompts]


def _stages(x: Inputs) -> jobs.Stages:
    return jobs.Stages(x.spark, x.scratch("work"), "whole")


@query
def synthesize_problems(x: Inputs) -> DataFrame:
    found = jobs.synthesize_problems(x.qa, x.ruled, "doc_id", _digests, _stages(x), k=2)
    return found.select("id", _big("type_id"), _big("sample_idx"), "original_problem", "corpus_text", "synthesis_result")


@query
def refine_problems(x: Inputs) -> DataFrame:
    found = jobs.refine_problems(x.stories.drop("refined_result"), _digests, _stages(x))
    return found.select("id", _big("sample_idx"), "title", "refined_result")


@query
def fuse_inputs(x: Inputs) -> DataFrame:
    found = jobs.fuse_inputs(x.eval_cases, x.stories, _digests, _stages(x))
    return found.select("eval_id", _big("template_idx"), "original_input", "new_input", "fused_result")


def _traced_run(job: dict) -> dict:
    """Stand-in for a runner: prints one trace line and an answer; some runs fail, some are silent, some are wrong."""
    n = int(job["stdin"].split()[0])
    out = "" if n % 13 == 4 else f"[TRACE] read | n={n}\n{n % 97 + (n % 11 == 3)}\n"
    return {"return_code": int(n % 50 == 7), "stdout": out, "stderr": ""}


@query
def execute_instrumented(x: Inputs) -> DataFrame:
    inputs = x.eval_cases.select("problem_id", "source", "input", "expected_output", "seq")
    found = jobs.execute_instrumented(inputs, x.codes, _traced_run, _stages(x))
    return found.withColumn("traces", F.array_join("traces", "\n"))


@query
def synthesize_reasoning(x: Inputs) -> DataFrame:
    found = jobs.synthesize_reasoning(x.fused, x.trace_runs, x.codes, _digests, _stages(x))
    return found.select("eval_id", "problem_id", "source", "cot_result")


# --- responses ---------------------------------------------------------------

@query
def parse_json_last_block(x: Inputs) -> DataFrame:
    parsed = x.corpus_responses.withColumn("_p", parse_last_block(F.col("raw")))
    return parsed.select("doc_id", "_p.ok", "_p.origin", "_p.matched_inner", F.array_join("_p.types", ",").alias("types"))


@query
def parse_json_balanced(x: Inputs) -> DataFrame:
    parsed = x.corpus_responses.withColumn("_p", parse_last_block(F.col("raw"), balanced=True))
    return parsed.select("doc_id", "_p.ok", "_p.origin", F.array_join("_p.types", ",").alias("types"))


@query
def draft_and_input(x: Inputs) -> DataFrame:
    return responses.draft_and_input(x.stories).select("seq", "draft_problem", "draft_input")


@query
def story_fields(x: Inputs) -> DataFrame:
    return responses.story_fields(x.stories).select("seq", "story_problem", "story_input", "story_origin")


@query
def synth_records(x: Inputs) -> DataFrame:
    return responses.synth_records(x.stories).select(
        "id", "title", _big("type_id"), _big("sample_idx"), "problem", "input", _big("rating")
    )


@query
def instrumented_code(x: Inputs) -> DataFrame:
    return x.codes.select("id", "language", "code", "analysis")


@query
def classification_fields(x: Inputs) -> DataFrame:
    return responses.classification_fields(x.classify_responses).select(
        "id", "parse_ok", "core_step", "type_level1", "type_level2", "is_new", "reason"
    )


@query
def kernel_text(x: Inputs) -> DataFrame:
    return responses.kernel_text(x.kernel_responses).select("id", "refined_question")


@query
def generated_inputs(x: Inputs) -> DataFrame:
    return responses.generated_inputs(x.printed_tests).select("suite", _big("place"), "input", "level")


@query
def cot_fields(x: Inputs) -> DataFrame:
    return x.cot_rows.select("eval_id", "parse_ok", "verified", F.coalesce("num_steps", F.lit(-1)).cast("bigint").alias("num_steps"), "reasoning", "mismatch_reason")


# --- joins -------------------------------------------------------------------

@query
def round_robin_templates(x: Inputs) -> DataFrame:
    return joins.round_robin_templates(x.eval_cases, x.templates).select(
        "eval_id", "problem_id", "template_idx", "story_problem", "original_input", "new_input", "expected_output"
    )


@query
def fuse_funnel(x: Inputs) -> DataFrame:
    return joins.fuse_funnel(x.eval_cases, x.templates)


@query
def template_stats(x: Inputs) -> DataFrame:
    return joins.template_stats(x.templates)


@query
def code_join(x: Inputs) -> DataFrame:
    codes = shape.first_code(x.solutions)
    rows = joins.code_join(x.eval_cases, codes, "problem_id", ["seq"])
    return rows.select("eval_id", "code", language_runner(F.col("programmingLanguage")).alias("runner"), "code_status")


@query
def test_input_union(x: Inputs) -> DataFrame:
    return joins.test_input_union(x.executed_tests, x.qa, runs.golden_outputs(x.runs.drop("source", "expected_output")))


@query
def trace_join(x: Inputs) -> DataFrame:
    return joins.trace_join(x.fused, x.trace_runs, x.codes).drop("seq", "type_id", "rating")


@query
def trace_join_funnel(x: Inputs) -> DataFrame:
    rows = joins.trace_candidates(x.fused, x.trace_runs, x.codes)
    return rows.groupBy("trace_status").agg(F.count(F.lit(1)).alias("n"))


@query
def eval_keys(x: Inputs) -> DataFrame:
    cases = sharding.dense_ordinal(x.eval_cases.select("problem_id", "source", "seq"), "seq")
    return cases.select(
        "seq", joins.trace_key(F.col("problem_id"), F.col("source"), F.col("ord")).alias("trace_id"),
        joins.synth_key(F.col("problem_id"), F.col("seq")).alias("synth_id"),
    )


# --- runs and traces ---------------------------------------------------------

def _fake_run(job: dict) -> dict:
    """Stand-in for a runner: echoes the input; the code ``fail`` always raises."""
    if job["code"] == "fail":
        raise RuntimeError("no answer")
    return {"return_code": 0, "stdout": f"{job['language']}:{job['stdin']}\n", "stderr": ""}


@query
def run_batches(x: Inputs) -> DataFrame:
    calls = x.eval_cases.select(
        F.col("eval_id").alias("request_id"), F.when(F.col("seq") % 50 == 7, "fail").otherwise("print").alias("code"),
        F.lit("cpp").alias("language"), F.col("input").alias("stdin"),
    )
    done = exchange.run_batches(calls, _fake_run, wait=(0.0, 0.0), concurrency=8)
    return done.select("request_id", "success", _big("return_code"), "stdout", "stderr")


@query
def golden_outputs(x: Inputs) -> DataFrame:
    kept = runs.golden_outputs(x.runs.drop("source", "expected_output"))
    return kept.select("problem_id", "seq", "source", "input", "expected_output")


@query
def split_trace(x: Inputs) -> DataFrame:
    return x.split_runs.select("seq", F.array_join("traces", "\n").alias("traces"), "actual_output")


@query
def output_match(x: Inputs) -> DataFrame:
    return runs.output_match(x.split_runs).select("seq", "success", "output_matched")


@query
def answer_match(x: Inputs) -> DataFrame:
    """Prices and quantities against slightly changed values, and whole numbers."""
    items = x.table("lineitem")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    shifted = (price * F.when(F.col("l_linenumber") % 3 == 0, F.lit("1.02").cast("decimal(4,2)"))
               .otherwise(F.lit("1.00").cast("decimal(4,2)"))).cast("decimal(18,2)")
    pairs = items.select("l_orderkey", "l_linenumber", F.concat(shifted.cast("string"), F.lit(" ")).alias("actual"), price.cast("string").alias("expected"))
    whole = items.select("l_orderkey", F.col("l_linenumber") + 100, (F.col("l_orderkey") * 1000 + F.col("l_linenumber") % 2).cast("string"), (F.col("l_orderkey") * 1000).cast("string"))
    both = pairs.union(whole)
    return both.groupBy("l_linenumber", runs.answer_match(F.col("actual"), F.col("expected")).alias("matched")).agg(F.count(F.lit(1)).alias("n")).withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))


@query
def run_funnel(x: Inputs) -> DataFrame:
    judged = runs.output_match(x.split_runs)
    with_code = joins.code_join(judged, shape.first_code(x.solutions), "problem_id", ["seq"])
    done = x.done_keys.withColumn("is_done", F.lit(True))
    flagged = with_code.join(done, "eval_id", "left").withColumn("is_done", F.coalesce("is_done", F.lit(False)))
    rows = runs.run_status(flagged).select("eval_id", "actual_output", "run_status")
    statuses = ["done", "no_code", "fail", "success", "mismatch"]
    kept, counts = observed.kept_and_counts(rows, "run_status", statuses, x.scratch("runs"), ["success", "mismatch"])
    return _counts(x, "run_status", counts)


@query
def trace_events(x: Inputs) -> DataFrame:
    fields = F.array_join(F.array_sort(F.transform(
        F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return runs.trace_events(x.split_runs).select("seq", _big("line_no"), "label", fields.alias("fields"))


@query
def trace_key_stats(x: Inputs) -> DataFrame:
    return runs.trace_key_stats(runs.trace_events(x.split_runs))


@query
def trace_label_stats(x: Inputs) -> DataFrame:
    return runs.trace_label_stats(runs.trace_events(x.split_runs))


@query
def trace_budget(x: Inputs) -> DataFrame:
    return runs.trace_budget(x.split_runs).select("seq", _big("trace_lines"), _big("malformed_lines"), "over_budget")


# --- checks ------------------------------------------------------------------

@query
def taxonomy_valid(x: Inputs) -> DataFrame:
    rows = checks.taxonomy_valid(responses.classification_fields(x.classify_responses))
    return rows.select("id", "taxonomy_status")


@query
def length_window(x: Inputs) -> DataFrame:
    """Drafts need 200 words; refined stories 150 to 400."""
    rows = responses.story_fields(x.stories).where("story_origin IS NOT NULL")
    draft = checks.length_window(rows.where("story_origin = 'draft'"), "story_problem", 200)
    refined = checks.length_window(rows.where("story_origin = 'refined'"), "story_problem", 150, 400)
    return draft.unionByName(refined).select("seq", "story_origin", _big("words"), "in_window")


@query
def input_preserved(x: Inputs) -> DataFrame:
    rows = x.stories.select("seq", json_fields(F.col("synthesis_result"), "input").alias("d"),
                            json_fields(F.col("refined_result"), "input").alias("r"))
    both = rows.where(F.col("d.ok") & F.col("r.ok"))
    return both.select("seq", checks.input_preserved(F.col("d.input"), F.col("r.input")).alias("preserved"))


@query
def value_coverage(x: Inputs) -> DataFrame:
    rows = x.fused.withColumn("_p", json_fields(F.col("fused_result"), "problem")).withColumn("problem", F.col("_p.problem"))
    return checks.value_coverage(rows.where("_p.ok"), "new_input", "problem").select(
        "seq", _big("value_count"), _big("values_found"), "coverage"
    )


@query
def banned_terms(x: Inputs) -> DataFrame:
    return checks.banned_terms(x.cot_rows, "reasoning", lexicon.REASONING_BANNED).select("eval_id", "term")


@query
def banned_question_terms(x: Inputs) -> DataFrame:
    """Question rules over whole texts, one row per question and term."""
    return checks.banned_terms(x.questions, "question", lexicon.QUESTION_BANNED).select("doc_id", "term")


@query
def step_check(x: Inputs) -> DataFrame:
    return checks.step_check(x.cot_rows.where("verified")).select("eval_id", _big("steps_found"), "step_status")


@query
def test_suite_mix(x: Inputs) -> DataFrame:
    return checks.test_suite_mix(responses.generated_inputs(x.printed_tests), ["suite"])


@query
def instrument_readonly(x: Inputs) -> DataFrame:
    rows = responses.parse_instrumented(x.instrumented).where(F.coalesce(F.col("code"), F.lit("")) != "")
    return checks.instrument_readonly(rows, ["seq"])


@query
def trace_plan_parity(x: Inputs) -> DataFrame:
    rows = responses.plan_size(responses.parse_instrumented(x.instrumented)).where(F.coalesce(F.col("code"), F.lit("")) != "")
    return checks.trace_plan_parity(rows).select("seq", "plan_entries", _big("trace_statements"), "plan_matches")


# --- final records -----------------------------------------------------------

@query
def sft_records(x: Inputs) -> DataFrame:
    path = x.scratch("sft")
    export.sft_records(x.cot_rows).hint("rebalance", "type_id").write.partitionBy("type_id").parquet(path)
    rows = x.spark.read.parquet(path)
    m = F.col("messages")
    return rows.select("eval_id", _big("type_id"), _big("rating"), m[0]["role"].alias("role_1"), m[0]["content"].alias("content_1"),
                       m[1]["role"].alias("role_2"), m[1]["content"].alias("content_2"))


@query
def stage_yield(x: Inputs) -> DataFrame:
    typed = x.qa.select(pairing.resolve_type(F.col("type_level1")).alias("type_id"), "id", "type_level1")
    found = export.stage_yield({
        "problems": typed,
        "pairs": pairing.typed_picks(x.qa.select("id", "type_level1"), x.listing, 3),
        "cases": x.fused,
        "matched": joins.trace_join(x.fused, x.trace_runs, x.codes),
        "verified": x.cot_rows.where("verified"),
    })
    return found.withColumn("type_id", F.col("type_id").cast("bigint"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus features, hints, buckets, seeded pairs and rendered prompts."""
    x = Inputs(spark, sf_dir)
    pairs = pairing.typed_pairs(x.qa.withColumn("problem", shape.problem_text()), x.listing, x.texts, 3)
    prompt = exchange.render_prompt(STAGES["synthesize"].template, [
        ("type_id", F.col("type_id")), ("type_instruction", exchange.type_instruction(F.col("type_id"))),
        ("text", F.col("corpus_text")), ("problem", F.col("problem")),
    ])
    asked = exchange.requests(pairs, "synthesize", ["id", "sample_idx"], prompt)
    return asked.select("id", _big("type_id"), _big("sample_idx"), "corpus_id", "prompt", "request_id")


@query
def synthesis_requests(x: Inputs) -> DataFrame:
    return flagship(x.spark, x.sf_dir)

