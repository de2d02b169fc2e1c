"""Line dedup (8) with a log-template tree of fixed depth.

A line is parsed into tokens; tokens with a digit, an ``@`` or ``://`` are
variable fields and become ``<*>``. The path in the tree is the number of tokens
and the first ``depth`` tokens; it ends in a leaf. In a leaf the line form that
most documents have becomes a template, and forms that agree with it in at least
``agree`` of the tokens join it (their differing places are variable); so it goes
on with what is left, until no form is. A template
found in ``min_docs`` documents or more is recurring: its lines are dropped,
except in the document with the least id, which shows the template. What other
lines of it have in its variable places (up to a quarter of the words) goes with them.

Lines of leaves that occur once are most of a corpus. A count-min sketch of the
leaves' documents finds the leaves that may recur; only their lines leave the
task, and only documents with such a line are rewritten in a second step.

Defined cases: a null text stays null and counts one empty line, as an empty text does; lines of fewer than ``min_tokens`` tokens
(and empty ones) are never dropped; lines of one or two tokens recur only where they are identical; repeated rows are documents of their own, in the order of
their ids, then as read; null ids come first; an empty table stays empty; all
columns are handed through, whatever their names; texts are read whole.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskloom.llm import _sketch
from taskloom.llm._text import arrow_type, free_name, slices, small_batches
from taskloom.operators.numbering import top_per_key
from taskloom.session import scratch_path, written

_VARIABLE = re.compile(rb"[0-9@]|://")
#: What the query and the pipeline take: two documents make a line recurring, and lines of one or two words count too.
WHOLE = {"min_docs": 2, "min_tokens": 1}
#: Lines of fewer tokens are masked nowhere, and two forms of them never agree: only identical ones recur.
SHORT = 3
#: Tokens of a leaf's distinct forms that one task settles, and templates a round of a larger leaf.
LEAF_CELLS, LEADS = 4_000_000, 32


def parse(line: bytes, depth: int, min_tokens: int) -> tuple[bytes, bytes] | None:
    """(leaf, form) of a line: the tree path and all tokens with variable fields masked."""
    tokens = line.split()
    if len(tokens) < max(1, min_tokens):
        return None
    if len(tokens) >= SHORT and _VARIABLE.search(line):
        tokens = [b"<*>" if _VARIABLE.search(t) else t for t in tokens]
    return b"%d %s" % (len(tokens), b" ".join(tokens[:depth])), b" ".join(tokens)


def _codes(words: list[str]) -> np.ndarray:
    """One row a form: its tokens as numbers. The forms are of one leaf, so all have as many tokens."""
    known: dict[str, int] = {}
    return np.array([[known.setdefault(t, len(known)) for t in w.split(" ")] for w in words], np.int32)


def greedy(words: list[str], agree: float) -> list[int]:
    """For each form the place of its template: the first form left takes those that agree with it, until none is left."""
    if len(words) == 1 or words[0].count(" ") + 1 < SHORT:
        return list(range(len(words)))
    codes, left, out = _codes(words), np.arange(len(words)), np.arange(len(words))
    while len(left) > 1:
        joins = (codes[left] == codes[left[0]]).mean(axis=1) >= agree
        out[left[joins]] = left[0]
        left = left[~joins]
    return out.tolist()


def templates(lines: DataFrame, agree: float) -> DataFrame:
    """(leaf, form, template) of every line form of ``lines`` (leaf, form, words, one row a document).

    Forms and templates are named by 64-bit hashes, unique in a leaf; only distinct forms carry their words. A leaf is
    settled in one task; one of more than ``LEAF_CELLS`` tokens is first cut down, ``LEADS`` templates a round, on all tasks.
    """
    forms = lines.groupBy("leaf", "form").agg(F.count(F.lit(1)).alias("docs"), F.first("words").alias("words"))
    left, small, done = written(forms, "line-forms"), None, None

    def settle(batches):
        leaf, ids, words = None, [], []

        def flush():
            named = [ids[i] for i in greedy(words, agree)] if ids else []
            return [leaf] * len(ids), ids, named

        out: list[tuple] = []
        for b in batches:
            for at, form, text in zip(b.column("leaf").to_pylist(), b.column("form").to_pylist(), b.column("words").to_pylist()):
                if at != leaf:
                    out.append(flush())
                    leaf, ids, words = at, [], []
                ids.append(form)
                words.append(text)
            yield pa.RecordBatch.from_arrays([pa.array([x for o in out for x in o[c]], pa.int64()) for c in range(3)], ["leaf", "form", "template"])
            out = []
        out.append(flush())
        yield pa.RecordBatch.from_arrays([pa.array([x for o in out for x in o[c]], pa.int64()) for c in range(3)], ["leaf", "form", "template"])

    def against(batches):
        leaf, leads = None, []
        for b in batches:
            found = []
            for row in b.select(["leaf", "form", "words", "leads"]).to_pylist():
                if row["leaf"] != leaf:
                    leaf, words = row["leaf"], [x["words"] for x in row["leads"]]
                    leads = [(row["leads"][i]["form"], words[i].split(" ")) for i in dict.fromkeys(greedy(words, agree))]
                own = row["words"].split(" ")
                least = agree if len(own) >= SHORT else 1.0
                found.append(next((f for f, w in leads if sum(map(str.__eq__, own, w)) / len(own) >= least), None))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("leaf", "form", "docs", "words")), pa.array(found, pa.int64())],
                                             ["leaf", "form", "docs", "words", "template"])

    while True:
        tokens = F.count(F.lit(1)) * F.first(F.size(F.split("words", " ")))
        large = written(left.groupBy("leaf").agg(tokens.alias("tokens")).where(F.col("tokens") > LEAF_CELLS).select("leaf"), "line-large")
        rest = left.join(large, "leaf", "left_anti")
        small = rest if small is None else small.unionByName(rest)
        if large.isEmpty():
            break
        wide = left.join(large, "leaf", "left_semi").withColumn("few", -F.col("docs"))
        first = top_per_key(wide, ["leaf"], ["few", F.desc("form")], LEADS, F.pmod("form", F.lit(64)), "rank")
        first = first.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("rank", "form", "words"))).alias("leads"))
        # Written, so that the join deals out both sides and Spark can split a very common leaf. Every lead is settled, so each round ends nearer.
        tried = wide.join(written(first, "line-leads"), "leaf").select("leaf", "form", "docs", "words", "leads")
        tried = written(tried.mapInArrow(against, "leaf long, form long, docs long, words string, template long"), "line-tried")
        joined = tried.where("template is not null").select("leaf", "form", "template")
        done = joined if done is None else done.unionByName(joined)
        left = tried.where("template is null").drop("template")
    order = small.repartition("leaf").sortWithinPartitions("leaf", F.desc("docs"), F.desc("form"))
    settled = order.select("leaf", "form", "words").mapInArrow(settle, "leaf long, form long, template long")
    return settled if done is None else settled.unionByName(done)


def drop_recurring(docs: DataFrame, min_docs: int = 3, depth: int = 3, agree: float = 0.75, min_tokens: int = 3,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with recurring lines taken out of ``text_col``, and a struct column ``lines``
    (set aside as ``lines_`` where that name is taken) with n_lines and n_dropped.
    """
    spark = docs.sparkSession
    small_batches(spark)
    name = free_name(docs.columns, "lines")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"), F.struct(*docs.columns).alias("row"))
    bits = _sketch.width_bits(_sketch.text_bytes(docs, text_col) / 50)

    def leaf_of(parsed) -> int:
        return xxhash.xxh3_64_intdigest(parsed[0])

    def count(batches):
        keys, held = [], 0
        for _, texts in slices(batches, "body"):
            for t in texts:
                found = {parse(x, depth, min_tokens) for x in set(t.split(b"\n"))} - {None}
                keys.append(np.array(list({leaf_of(p) for p in found}), np.uint64))
                held += len(found)
            if held > _sketch.HELD_KEYS:
                yield from _sketch.touches(keys, bits)
                keys, held = [], 0
        yield from _sketch.touches(keys, bits)

    sent = _sketch.merged(rows.select("body").mapInArrow(count, _sketch.TOUCHES), bits)
    form = T.ArrayType(T.StructType([T.StructField("leaf", T.LongType()), T.StructField("form", T.LongType()), T.StructField("words", T.StringType()), T.StructField("at", T.ArrayType(T.IntegerType()))]))
    out = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", T.LongType()), T.StructField("n_lines", T.LongType()),
                        T.StructField("forms", form), T.StructField("row", rows.schema["row"].dataType)])

    def second(batches):
        repeated, key = _sketch.lookup(sent, bits), TaskContext.get().partitionId() << 33
        for part, texts in slices(batches, "body"):
            n_lines, forms = [], []
            for t in texts:
                lines = t.split(b"\n")
                n_lines.append(len(lines))
                found: dict[tuple, list] = {}
                for i, line in enumerate(lines):
                    p = parse(line, depth, min_tokens)
                    if p:
                        found.setdefault(p, []).append(i)
                order = list(found)
                leaves = np.array([leaf_of(p) for p in order], np.uint64)
                hit = repeated(leaves).tolist()
                signed = leaves.view(np.int64).tolist()
                forms.append([
                    {"leaf": s, "form": xxhash.xxh3_64_intdigest(p[1]) - (1 << 63), "words": p[1].decode("utf-8", "replace"), "at": found[p]}
                    for p, s, h in zip(order, signed, hit) if h])
            keys = np.arange(key, key + len(texts))
            key += len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(keys), part.column(0), pa.array(n_lines, pa.int64()), pa.array(forms, arrow_type(form)), part.column(2)], out.names)

    path = scratch_path(spark, "lines")
    rows.mapInArrow(second, out).withColumn("waits", F.size("forms") > 0).write.option("compression", "zstd").partitionBy("waits").parquet(path)
    read = spark.read.schema(T.StructType([*out.fields, T.StructField("waits", T.BooleanType())])).parquet(path)
    waiting, ready = read.where("waits"), read.where("not waits")

    lines = waiting.select("key", "id", F.explode("forms").alias("f")).select("key", "id", "f.leaf", "f.form", "f.words", "f.at")
    named = written(templates(lines.select("leaf", "form", "words"), agree), "line-templates")
    # The written side and the lines are both dealt by the join, so Spark can split a very common line.
    marked = written(lines.drop("words").join(named, ["leaf", "form"]).select("key", "id", "leaf", "template", "at"), "line-marked")
    once = marked.groupBy("leaf", "template", "key").agg(F.first("id").alias("id"))
    counts = once.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("id", "key")).alias("first"))
    recurring = written(counts.where(F.col("docs") >= min_docs).select("leaf", "template", F.col("first.key").alias("keeper")), "line-recurring")
    gone = marked.join(recurring, ["leaf", "template"]).where("key <> keeper")
    gone = gone.groupBy("key").agg(F.flatten(F.collect_list("at")).alias("gone"))
    body = F.col("row")[text_col].cast("string")
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    changed = waiting.select("key", "row", "n_lines", F.split(body, "\n", -1).alias("parts")).join(gone, "key", "left").select(
        "row", F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n").alias("body"),
        F.struct("n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")).alias("lines"))
    same = ready.select("row", body.alias("body"), F.struct("n_lines", F.lit(0).cast("long").alias("n_dropped")).alias("lines"))
    both = changed.unionByName(same)
    kind = docs.schema[text_col].dataType
    columns = [F.col("body").cast(kind).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return both.select(*columns, F.col("lines").alias(name))
