"""All spans of whole documents against brute force, on every route, and the defined cases."""

import math
import random
import re

import brute
from taskloom.llm import pii

TERM = re.compile(r"[^\W\d_]{3,}")


def by_force(texts, reach=10, support=2, low=0.6, high=0.9):
    """The spans of each text as (kind, start, stop), by counting every term and entity directly."""
    texts = [t or "" for t in texts]
    base = [brute.base_spans(t) for t in texts]
    words, near, entities = [], [], []
    for text, own in zip(texts, base):
        free = [(m.start(), m.end(), m.group().lower()) for m in TERM.finditer(text) if not any(a < m.end() and m.start() < b for _, a, b in own)]
        pairs, held = set(), set()
        for kind, a, b in own:
            entity = (kind, text[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[a:b]))
            held.add(entity)
            before = [w for w in free if w[0] < a]
            after = [w for w in free if w[0] >= b]
            inside = [w for w in free if a <= w[0] < b]
            pairs |= {(entity, w[2]) for w in before[len(before) - min(reach, len(before)) :] + inside + after[:reach]}
        words.append(free)
        near.append(pairs)
        entities.append(held)
    every = [{w.lower() for w in TERM.findall(t)} for t in texts]
    n, share = len(texts), {}
    for entity, term in set().union(*near):
        both = sum((entity, term) in p for p in near)
        n_term, n_entity = sum(term in e for e in every), sum(entity in e for e in entities)
        if n_entity < n:
            share[entity, term] = math.log(n * both / ((n_term + (both < support)) * n_entity)) / math.log(n / n_entity)
    out = []
    for own, free, held in zip(base, words, entities):
        spans = list(own)
        for kind in ("generalise", "remove"):
            for a, b, term in free:
                top = max((share.get((e, term), -9) for e in held), default=-9)
                if (kind == "remove" and top >= high) or (kind == "generalise" and low <= top < high):
                    spans.append((kind, a, b))
        out.append(spans)
    return out


def corpus(n=320):
    r = random.Random(11)
    common = [f"c{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60)]
    texts = []
    for i in range(n):
        words = r.choices(common, k=r.randrange(4, 60))
        if r.random() < 0.4:  # a value that many documents hold, beside words that two or three hold
            at = r.randrange(len(words))
            words[at:at] = [r.choice(["help@desk.org", f"m{i % 40}@x.org", "+1 (555) 010-9999", "10.0.0.1"]), "rare" + chr(97 + i // 3 % 26) + chr(97 + i // 80)]
        if r.random() < 0.3:
            words.append("rare" + chr(97 + r.randrange(26)) + "a")
        if r.random() < 0.1:
            words += ["İstanbul", "m3@x.org", "STRASSE", "ſtreng"]
        texts.append(" ".join(words))
    return texts + texts[:12] + [None, ""]


def test_all_spans_equal_brute_force(spark):
    texts = corpus()
    want = by_force(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(docs).collect()}
    assert [found[i] for i in range(len(texts))] == want
    kinds = {k for own in want for k, *_ in own}
    assert {"remove", "generalise", "email", "ip", "phone"} <= kinds


def test_every_route_is_taken(spark, monkeypatch):
    seen, through = [], pii._through_terms
    monkeypatch.setattr(pii, "_through_terms", lambda read, told: seen.append(told.count()) or through(read, told))
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    pii.find(docs).collect()
    assert seen[0] > 0


def test_pii_edges(spark):
    long = "plain words here " * 60_000 + "secretword jo@long.org " + "tail " * 1000
    rows = [(None, "write to jo@long.org"), (2, long), (2, "same@row.org twice"), (2, "same@row.org twice"), (3, None), (4, ""), (5, "İ İstanbul z@a.bc")]
    docs = spark.createDataFrame([(i, t, "b", 1, "k") for i, t in rows], "doc_id long, text string, base string, key int, body string")
    found = pii.find(docs)
    assert found.columns == ["doc_id", "base", "spans"]
    got = sorted(((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in found.collect()), key=repr)
    want = sorted(((i, own) for (i, _), own in zip(rows, by_force([t for _, t in rows]))), key=repr)
    assert got == want
