"""Ordered and repeated ingest, token lengths, the committed stream, and counts on the way."""

import json
import os

import pytest
from pyspark.sql import functions as F

from taskloom.functions.tokens import token_length, tokenizer_length
from taskloom.operators import exchange, observed
from taskloom.sources import jsonl
from taskloom.streaming.intake import corpus_stream, intake, taken_in


@pytest.mark.parametrize("split", [None, 700, 4096])
def test_line_numbers_do_not_depend_on_splits(spark, tmp_path, split):
    want, at = [], 0
    for name in ("b.jsonl", "a.jsonl", "c.jsonl"):
        lines = []
        for i in range(400):
            lines += ["", json.dumps({"id": f"{name}{i} é", "pad": "x" * (i % 50)})] if i % 7 else ["not json", "   "]
        (tmp_path / name).write_text("\n".join(lines), encoding="utf-8")
    for name in ("a.jsonl", "b.jsonl", "c.jsonl"):
        for i in range(400):
            if i % 7:
                want.append((at, f"{name}{i} é"))
            at += 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        found = jsonl.read_jsonl(spark, [str(tmp_path / n) for n in ("c.jsonl", "a.jsonl", "b.jsonl")], "id string", "drop", seq="seq")
        assert sorted((r.seq, r.id) for r in found.collect()) == want
        kept = jsonl.read_jsonl(spark, str(tmp_path), "id string", "keep", seq="n").select("n").collect()
        assert sorted(r.n for r in kept) == list(range(1200))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_batch_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("ä", 1), ("b", None)], "id string, n int")
    assert jsonl.appended(spark, path, "id string, n int").count() == 0
    assert jsonl.append_jsonl(rows, path, "one")
    assert not jsonl.append_jsonl(rows, path, "one")
    os.makedirs(f"{path}/batch=two")  # a batch whose write broke off before it was entered
    with open(f"{path}/batch=two/part-0.json", "w") as f:
        f.write('{"id": "half')
    read = lambda: sorted(tuple(r) for r in jsonl.appended(spark, path, "id string, n int").select("id", F.coalesce("n", F.lit(-1))).collect())
    assert read() == [("b", -1), ("ä", 1)]
    assert jsonl.append_jsonl(rows.where("id = 'b'"), path, "two")
    assert read() == [("b", -1), ("b", -1), ("ä", 1)]
    with pytest.raises(ValueError):
        jsonl.append_jsonl(rows, path, "../x")


def test_token_lengths_equal_the_whole_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.col("text").alias("prompt"))
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "é 日本 <|endoftext|>"), (-4, "word " * 300_000)], "doc_id long, prompt string")
    with open(path, encoding="utf-8") as f:
        count = tokenizer_length(f.read())
    rows = docs.unionByName(more).repartition(4)
    found = exchange.length_gate(rows, 1024, 512, count).collect()
    want = [len(e.ids) for e in whole.encode_batch([r.prompt or "" for r in found], add_special_tokens=False)]
    assert [r.prompt_tokens for r in found] == want
    assert all(r.sendable == (n <= 512) for r, n in zip(found, want)) and {r.sendable for r in found} == {True, False}


def test_a_counter_is_made_once_a_worker(spark, tmp_path):
    made = tmp_path / "made"
    made.mkdir()

    def load():
        open(made / f"{os.getpid()}-{len(os.listdir(made))}", "w").close()
        return lambda texts: [len(t) for t in texts]

    count = token_length(load, "letters")
    for _ in range(2):
        assert spark.range(100).repartition(16).select(count(F.col("id").cast("string")).alias("n")).agg(F.sum("n")).first()[0] == 190
    pids = [n.split("-")[0] for n in os.listdir(made)]
    assert len(pids) == len(set(pids))


def test_a_kill_between_the_two_sinks_leaves_no_gap_and_no_repeat(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    text = "The first step goes north, then east. " * 20
    (tmp_path / "src").mkdir()
    for i in range(6):
        spark.range(i * 4, i * 4 + 4).coalesce(1).selectExpr("id AS doc_id", f"concat(id, ' {text}') AS text", "'news' AS quality_domain_txt").write.mode("append").json(src)
    flag = tmp_path / "model-is-back"

    def model(prompts):
        if len(list(flag.parent.glob("out/_commits/*"))) >= 1 and not flag.exists():
            raise RuntimeError("killed between rule and model")
        return ['{"suitable_types": [2]}'] * len(prompts)

    def run():
        source = corpus_stream(spark, src, "doc_id bigint, text string, quality_domain_txt string", files_per_batch=2)
        intake(source, out, ckpt, "doc_id", complete=model).awaitTermination()

    with pytest.raises(Exception, match="killed between"):
        run()
    for sink in ("rule", "model"):
        seen = [r.doc_id for r in taken_in(spark, out, sink).collect()]
        assert len(seen) == len(set(seen)) == 8  # the batch that broke off is in neither
    flag.touch()
    run()
    for sink in ("rule", "model"):
        rows = taken_in(spark, out, sink)
        assert sorted(r.doc_id for r in rows.collect()) == list(range(24)) and rows.select("batch_id").distinct().count() == 3


def test_counts_come_with_the_write(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            read.add(len(f))
            yield f

    rows = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'kept' WHEN id % 3 = 1 THEN 'empty' ELSE 'long' END AS status")
    rows = rows.mapInPandas(count, rows.schema)
    kept, counts = observed.kept_and_counts(rows, "status", ["kept", "empty", "long", "never"], str(tmp_path / "kept"))
    assert counts == {"kept": 334, "empty": 333, "long": 333}
    assert kept.count() == 334 and kept.columns == ["id"] and read.value == 1000
