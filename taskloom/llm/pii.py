"""PII (2): base patterns, and information-theoretic sanitisation of the words that give them away.

Base spans are e-mail addresses, ip addresses, card numbers and phone numbers. The
values found are the protected entities. How strongly a term reveals an entity is
estimated from the whole corpus: with n(e) and n(t) the numbers of documents that
hold the entity and the term, and n(t, e) those where the term stands within
``reach`` words of the entity, the term discloses

    log(N n(t, e) / (n(t) n(e))) / log(N / n(e))

of the entity's information: 1 if the term never occurs without it. Terms that
disclose at least ``remove`` are removed and those above ``generalise`` are
generalised, at every place in a document that holds the entity. Pairs seen in fewer
than ``support`` documents show less: for them, one more document is taken to hold the
term without the entity.

Which documents a disclosing pair marks is found at the lesser cost: where all documents
of the term or of the entity have the pair close together and there is one, it is that
document; else the documents of the entity are asked, or those of the term where they are
fewer. So a value that very many documents hold never meets its many terms in each.

Defined cases: a null text counts as empty; documents without base spans get no
other spans; repeated rows are documents of their own; an entity in every
document has no information to disclose; null ids are handed through; an empty
table gives an empty result; extra columns are not read; texts are read whole and
in linear time, whatever they hold.
"""

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskloom.llm._sketch import _CHUNK, ROWS, _squeezed, _unsqueezed, cells
from taskloom.llm._text import slices, small_batches
from taskloom.session import scratch_path, shuffle_width, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """(start, end) by kind: leftmost matches that do not overlap, without those that fail the kind's check."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at, last = text.find("@"), 0
    while at >= 0:  # the run before an @ is the longest local part, so no start is tried twice
        start = at
        while start > last and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        last = found.end() if found else at + 1
        if found:
            out["email"].append((start, last))
        at = text.find("@", last)
    if not _DIGIT.search(text):
        return out
    for run in _DOTTED.finditer(text):
        numbers, start = run.group().split("."), run.start()
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(n.lstrip("0")) < 3 or len(n.lstrip("0")) == 3 and n.lstrip("0") <= "255" for n in four):
                out["ip"].append((start, end))
            start = end + 1
    for run in _CARD.finditer(text):
        digits = run.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out["card"].append(run.span())
    for run in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(run.group())) <= 15:
            out["phone"].append(run.span())
    return out


def entity_of(kind: str, value: str) -> int:
    """A protected value, the same however it is written, as a signed 64-bit number."""
    plain = value.lower() if kind in ("email", "ip") else "".join(_DIGIT.findall(value))
    return xxhash.xxh3_64_intdigest(f"{kind}:{plain}".encode()) - (1 << 63)


def words_of(text: str, spans: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of the words outside the base spans."""
    taken = sorted(s for own in spans.values() for s in own)
    words, i, stop = [], 0, 0
    for m in _TERM.finditer(text):
        # stop: the furthest end of a base span that starts before this word ends.
        while i < len(taken) and taken[i][0] < m.end():
            stop, i = max(stop, taken[i][1]), i + 1
        if stop <= m.start():
            words.append((m.start(), m.end(), term_of(m.group())))
    return words


def term_of(word: str) -> str:
    """Words that differ in case only are one term."""
    return word.lower()


def contexts(text: str, spans: dict[str, list[tuple[int, int]]], reach: int) -> tuple[list[dict], list[int]]:
    """The pairs of entity and term near it, and the entities."""
    words = words_of(text, spans)
    starts = [w[0] for w in words]
    found: dict[tuple[int, str], None] = {}
    entities: dict[int, None] = {}
    for kind, own in spans.items():
        for start, end in own:
            entity = entity_of(kind, text[start:end])
            entities[entity] = None
            low, high = bisect_left(starts, start), bisect_left(starts, end)
            for _, _, term in words[max(0, low - reach) : high + reach]:
                found[entity, term] = None
    return [{"entity": e, "term": t} for e, t in found], list(entities)


def _term_key(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "replace"))


def _term_filter(terms: DataFrame) -> tuple[bytes, int]:
    """A bit set of the terms' hashes, three cells each, 96 MB at most. It lets too many terms pass, never too few."""
    bits = min(28, max(20, (8 * max(1, terms.count()) - 1).bit_length()))
    chunks = ROWS << (bits - _CHUNK)

    def run(batches):
        for b in batches:
            keys = np.array([_term_key(t) for t in b.column(0).to_pylist()], np.uint64)
            for row, at in enumerate(cells(keys, bits)):
                at = np.unique(at)
                chunk = at >> np.uint64(_CHUNK)
                for c in np.unique(chunk).tolist():
                    own = (at[chunk == c] & np.uint64((1 << _CHUNK) - 1)).astype(np.uint32)
                    yield pa.RecordBatch.from_pydict({"chunk": [(row << (bits - _CHUNK)) + c], "cells": [_squeezed(own)]})

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, own in zip(b.column(0).to_pylist(), b.column(1)):
                held.setdefault(chunk, np.zeros(1 << _CHUNK, np.uint8))[_unsqueezed(own.as_py())] = 1
        for chunk, own in held.items():
            yield pa.RecordBatch.from_pydict({"chunk": [chunk], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    found = terms.mapInArrow(run, "chunk long, cells binary").repartition(min(chunks, shuffle_width(terms.sparkSession)), "chunk")
    both = np.zeros((chunks, (1 << _CHUNK) // 8), np.uint8)
    for r in found.mapInArrow(merge, "chunk long, bits binary").collect():  # one row a chunk, 96 MB at most
        both[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return both.tobytes(), bits


def term_documents(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """(term, n): the number of documents of each of the terms, over whole texts."""
    found, bits = _term_filter(terms)
    sent = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        both = np.frombuffer(sent.value, np.uint8).reshape(ROWS, -1)
        counts: dict[str, int] = {}
        for _, texts in slices(batches, "body"):
            per = [set(map(term_of, set(_TERM.findall(t.decode("utf-8", "replace"))))) for t in texts]
            every = list(set().union(*per))
            keys = np.array([_term_key(t) for t in every], np.uint64)
            ok = np.ones(len(every), bool)
            for row, at in enumerate(cells(keys, bits)):
                ok &= (both[row][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            wanted = {t for t, o in zip(every, ok.tolist()) if o}
            for own in per:
                for t in own & wanted:
                    counts[t] = counts.get(t, 0) + 1
            if len(counts) > 200_000:
                yield pa.RecordBatch.from_pydict({"term": list(counts), "n": pa.array(counts.values(), pa.int64())})
                counts = {}
        if counts:
            yield pa.RecordBatch.from_pydict({"term": list(counts), "n": pa.array(counts.values(), pa.int64())})

    rows = docs.select(F.col(text_col).cast("string").alias("body"))
    return rows.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def find(docs: DataFrame, reach: int = 10, support: int = 2, generalise: float = 0.6, remove: float = 0.9,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, ``base`` and ``spans``: arrays of (kind, start, stop), in code points, the end
    exclusive, by kind (email, ip, card, phone, generalise, remove) and start.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    out = T.StructType.fromDDL(
        "key long, base array<struct<kind:string,start:int,stop:int>>, near array<struct<entity:bigint,term:string>>, entities array<bigint>, body string")
    out.add(T.StructField("id", rows.schema["id"].dataType))
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = {f.name: f.type for f in to_arrow_schema(out)}

    def first(batches):
        key = TaskContext.get().partitionId() << 33
        for part, texts in slices(batches, "body"):
            base, near, entities, bodies = [], [], [], []
            for raw in texts:
                text = raw.decode("utf-8", "replace")
                found = base_spans(text)
                base.append([{"kind": k, "start": a, "stop": b} for k in KINDS for a, b in found[k]])
                for column, own in zip((near, entities), contexts(text, found, reach) if base[-1] else ([], [])):
                    column.append(own)
                bodies.append(text if base[-1] else None)
            keys = np.arange(key, key + len(texts))
            key += len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(base, kinds["base"]), pa.array(near, kinds["near"]),
                                              pa.array(entities, kinds["entities"]), pa.array(bodies, kinds["body"]), part.column(0)], out.names)

    path = scratch_path(spark, "pii")
    rows.mapInArrow(first, out).write.option("compression", "zstd").parquet(path)
    read = spark.read.schema(out).parquet(path)
    near = read.where("size(near) > 0").select("key", F.explode("near").alias("x")).select("key", "x.entity", "x.term")
    # near has an entity and term once a document.
    pairs = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.min("key").alias("key"))
    pairs = written(pairs, "pii-pairs")
    holds = read.select("key", F.explode("entities").alias("entity"))
    entities = holds.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    terms = written(term_documents(docs, pairs.select("term").distinct(), text_col), "pii-terms")
    total = F.lit(float(read.count()))
    others = F.col("n_term") + F.when(F.col("n_both") < support, 1).otherwise(0)
    share = F.log(total * F.col("n_both") / (others * F.col("n_entity"))) / F.log(total / F.col("n_entity"))
    told = pairs.join(entities, "entity").where(total > F.col("n_entity")).join(terms, "term").withColumn("share", share)
    least = F.least("n_term", "n_entity")
    way = F.when(least == 1, "one").when((F.col("n_entity") <= F.col("n_term")) | (F.col("n_entity") <= 2 * F.col("n_both")), "entity").otherwise("term")
    told = written(told.where(F.col("share") >= generalise).select("entity", "term", "share", "key", way.alias("way")), "pii-disclosing")
    marked = told.where("way = 'one'").select("key", "term", "share")
    marked = marked.unionByName(holds.join(told.where("way = 'entity'").drop("key"), "entity").select("key", "term", "share"))
    through = told.where("way = 'term'").drop("key", "way")
    marked = marked.unionByName(_through_terms(read, through).join(holds, ["key", "entity"], "left_semi").select("key", "term", "share"))
    marked = marked.groupBy("key", "term").agg(F.max("share").alias("share"))
    marked = marked.groupBy("key").agg(F.collect_list(F.struct("term", (F.col("share") >= remove).alias("gone"))).alias("marked"))
    spans = T.StructType([out["base"], T.StructField("more", out["base"].dataType), T.StructField(id_col, out["id"].dataType)])

    def last(batches):
        for part, texts in slices(batches, "body"):
            more = []
            for base, marks, raw in zip(part.column(0), part.column(2), texts):
                own = {m["term"]: m["gone"] for m in marks.as_py() or ()}
                found = []
                if own:
                    taken: dict[str, list[tuple[int, int]]] = {}
                    for s in base.as_py():
                        taken.setdefault(s["kind"], []).append((s["start"], s["stop"]))
                    for a, b, term in words_of(raw.decode(), taken):
                        if term in own:
                            found.append((own[term], a, b))
                found.sort()
                more.append([{"kind": "remove" if gone else "generalise", "start": a, "stop": b} for gone, a, b in found])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(more, kinds["base"]), part.column(3)], spans.names)

    done = read.select("key", "id", "base", "body").join(marked, "key", "left").select("base", "body", "marked", "id").mapInArrow(last, spans)
    return done.select(id_col, "base", F.concat("base", "more").alias("spans"))


def _through_terms(read: DataFrame, told: DataFrame) -> DataFrame:
    """(key, entity, term, share): the documents of each told term, with the entities that it tells of."""

    def run(batches):
        for part, texts in slices(batches, "body"):
            keys = part.column(0).to_pylist()
            terms = [list(dict.fromkeys(map(term_of, _TERM.findall(t.decode())))) for t in texts]
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "terms": pa.array(terms, pa.list_(pa.string()))})

    if told.isEmpty():
        return read.select("key", F.lit(0).cast("long").alias("entity"), F.lit("").alias("term"), F.lit(0.0).alias("share")).limit(0)
    words = read.where("body is not null").select("key", "body").mapInArrow(run, "key long, terms array<string>")
    return words.select("key", F.explode("terms").alias("term")).join(told, "term")


def sanitised(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with base spans replaced by their kind, generalised terms by their shape, and removed terms left out.

    Where spans overlap, what begins first is replaced and what overlaps it goes with it.
    """
    out, at = [], 0
    for start, stop, kind in sorted((a, b, k) for k, a, b in spans):
        if stop <= at:
            continue
        out.append(text[at : max(at, start)])
        if start >= at:
            word = text[start:stop]
            out.append({"remove": "", "generalise": "[Name]" if word[:1].isupper() else "[word]"}.get(kind, f"[{kind.upper()}]"))
        at = stop
    return "".join(out) + text[at:]
