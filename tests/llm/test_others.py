"""Quality rules, packing, personal data, licences, urls and revisits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from taskloom.llm import licences, packing, pii, quality, urlfilter, warc
from taskloom.llm.queries import tokenizer_definition

NASTY = [None, "", " \n\t ", "a", "x" * 3000, "a b c d e f g h i j", "one two three four five " * 4, "# $ % a | b\n# $ % a | b\n\n \n", "É\u00a0é\u2003ü \x1c z " * 5]


def table(spark, texts, extra=True):
    rows = [(i, t, "q", "b", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality string, body string, id int")


def test_base_counts_equal_brute_force(spark):
    found = quality.score_documents(table(spark, NASTY + NASTY), None)
    name = found.columns[-1]
    assert found.columns[:-1] == table(spark, []).columns and name == "quality_"
    for r in found.collect():
        q = r[name]
        want = brute.quality(r["text"])
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"]) == want
        assert q["kept"] == (not want[-1])
    assert quality.score_documents(table(spark, []), None).count() == 0


def test_trees_learn_and_are_monotonic():
    r = np.random.default_rng(0)
    x = r.random((3000, len(quality.STATISTICS)))
    signs = list(quality.STATISTICS.values())
    y = ((x[:, 2] + 0.3 * x[:, 0] + 0.05 * r.standard_normal(3000)) < 0.6).astype(int)
    trees = quality.fit_trees(x[:2000], y[:2000], signs)
    assert ((trees.score(x[2000:]) > 0) == y[2000:]).mean() > 0.93  # held out
    for f, sign in enumerate(signs):
        if sign:
            line = np.repeat(x[:200], 20, axis=0)
            line[:, f] = np.tile(np.linspace(0, 1, 20), 200)
            steps = np.diff(trees.score(line).reshape(200, 20), axis=1)
            assert (sign * steps >= -1e-9).all()
    assert trees.feature.shape == trees.value.shape == trees.left.shape


def test_training_edges(spark):
    docs = table(spark, ["some words here"] * 3)
    assert quality.train(docs, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert quality.train(docs, spark.createDataFrame([(0, 1), (0, 1), (None, 0), (1, None), (2, 7)], "doc_id long, quality int")) is None


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_quality(spark, sf):
    folder = f"/root/testdata/{sf}"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    scored = quality.score_documents(docs, quality.train(docs, half)).withColumnRenamed("quality", "found")
    scored = scored.join(labels.where("doc_id % 2 = 1"), "doc_id")
    rows = scored.select("found.kept", "found.base_failed", "quality").collect()
    good = [k for k, b, q in rows if q == 1 and not b]
    bad = [k for k, b, q in rows if q == 0]
    assert sum(good) >= 0.93 * len(good) and sum(bad) <= 0.1 * len(bad)


TRICKY = ["It's the dog's WE'LL don't", "a<|endoftext|>b <|ENDOFTEXT|> x", "été É İstanbul ΑΣ. ΣΑΣ", "日本語 テスト, emoji 😀😃 x", "１２ x²   nb sp   z",
          "ﬁ ß ẞ ªº µ × ÷ a×b e\u0301x", "\x00 \x1c \x85 a\x85b", "<|x|> ' '' ''s", "ǅ ŉ ĳ word... (word) -- a1b2", "Word word. WORD, word!?"]


def test_word_tokenizer_equals_the_whole_one():
    from tokenizers import Tokenizer

    definition = tokenizer_definition()
    whole, words = Tokenizer.from_str(definition), packing.WordTokenizer(definition, memo_words=40)
    for text in TRICKY + [t or "" for t in NASTY] + TRICKY:
        assert list(words.encode([text.encode()])[0]) == whole.encode(text, add_special_tokens=False).ids


def test_word_memo_is_bounded_and_ends_with_the_task(spark):
    import sys

    import pyarrow as pa

    words = ["".join(chr(97 + (i // 26**k) % 26) for k in range(5)) for i in range(600_000)]
    texts = [" ".join(words[i : i + 20_000]) for i in range(0, len(words), 20_000)]
    tokenizer = packing.WordTokenizer(tokenizer_definition())
    found = tokenizer.encode([t.encode() for t in texts])
    assert len(tokenizer.number) < 400_000  # a full memo and the words of one piece
    assert len(found) == len(texts)
    for i in (0, 11, 29):
        assert list(found[i]) == tokenizer.whole.encode(texts[i], add_special_tokens=False).ids

    def held(batches):  # runs in the workers that packed before
        tokenizers = [m.tokenizer for m in [sys.modules.get("_word_tokenizers")] if m]
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([len(t.number) for t in tokenizers], pa.int64())], ["n"])

    packing.pack_documents(table(spark, texts[:4]), tokenizer_definition()).write.format("noop").mode("overwrite").save()
    found = spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()
    assert found and all(r["n"] <= 1 for r in found)


@pytest.mark.parametrize("window", [3000, 1 << 22])
def test_packing_round_trip(spark, window):
    from tokenizers import Tokenizer

    r = random.Random(2)
    texts = [" ".join(r.choice(["the", "river", "ran", "Xylo", "été"]) for _ in range(r.choice([0, 3, 40, 700, 5000]))) for _ in range(60)] + TRICKY + [None]
    pieces = packing.pack_documents(table(spark, texts).repartition(3), tokenizer_definition(), window_tokens=window).collect()
    whole = Tokenizer.from_str(tokenizer_definition())
    by_doc, by_sequence = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"]
        by_doc.setdefault(p["doc_id"], []).append((p["start"], ids, p["doc_tokens"]))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for i, t in enumerate(texts):
        want = whole.encode(t or "", add_special_tokens=False).ids + [1]
        assert [x for _, ids, _ in sorted(by_doc[i]) for x in ids] == want
        assert {n for *_, n in by_doc[i]} == {len(want)}
    for own in by_sequence.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)  # no padding
    assert packing.pack_documents(table(spark, []), tokenizer_definition()).count() == 0


def test_assign_balances_cost():
    r = random.Random(1)
    lengths = [r.randrange(1, 600) for _ in range(500)]
    lengths.append(-sum(lengths) % 2048 or 2048)
    room = [2048] * (sum(lengths) // 2048)
    out = packing.assign(lengths, room, 2048)
    cost = {}
    for _, _, n, s, _ in out:
        cost[s] = cost.get(s, 0) + n + n * n / 2048
    assert max(cost.values()) < 1.2 * min(cost.values())
    assert sum(n for _, _, n, *_ in out) == sum(lengths)


SPANS = ["mail a.b@c.d.e or x@y, me@@z.de a@b@c.dd", "1.2.3.4.5.6.7.8 and 256.1.1.1 0001.2.3.255 1.2..3.4.5.6", "4111 1111 1111 1111 4111-1111-1111-1112 0" + " 0" * 15,
         "+1 (017) 555-7713, +12 +123456789 +1-(((9", "é😀 x@y.zz ٣.٣.٣.٣", "", "@.@", "a" * 2000 + "@b.c", "1" * 4000 + ".1.1.1", "+" * 300 + "1234567890"]


def test_base_spans_equal_plain_patterns():
    r = random.Random(4)
    for text in SPANS + ["".join(r.choice("a1.@+- (9é") for _ in range(60)) for _ in range(3000)]:
        got = [(k, a, b) for k in pii.KINDS for a, b in pii.base_spans(text)[k]]
        assert got == brute.base_spans(text), text


def test_disclosing_terms_equal_brute_force(spark):
    texts = ["call zorblat now at ann@mail.org please", "mail zorblat about it ann@mail.org please", "please wait for the others", None, "please", "",
             "Please ann@mail.org comes again", "one bob@mail.org glimmer", "glimmer here", "two bob@mail.org glimmer"] * 1
    found = {r["doc_id"]: r for r in pii.find(table(spark, texts), reach=3).collect()}
    n, docs = len(texts), [set(pii._TERM.findall((t or "").lower())) for t in texts]
    both = lambda term, mail: sum(term in d and mail in (t or "") for d, t in zip(docs, texts))
    shares = {}
    for term, mail in (("zorblat", "ann@mail.org"), ("please", "ann@mail.org"), ("glimmer", "bob@mail.org")):
        holds = sum(mail in (t or "") for t in texts)
        shares[term] = np.log(n * both(term, mail) / (sum(term in d for d in docs) * holds)) / np.log(n / holds)
    assert shares["zorblat"] >= 0.9 and 0.6 <= shares["glimmer"] < 0.9 and shares["please"] < 0.6
    kinds = lambda i: [(s["kind"], texts[i][s["start"] : s["stop"]]) for s in found[i]["spans"]]
    assert kinds(0) == [("email", "ann@mail.org"), ("remove", "zorblat")]
    assert kinds(7) == [("email", "bob@mail.org"), ("generalise", "glimmer")]
    assert found[8]["spans"] == [] and found[3]["spans"] == []
    spans = [(s["kind"], s["start"], s["stop"]) for s in found[0]["spans"]]
    assert pii.sanitised(texts[0], spans) == "call  now at [EMAIL] please"
    assert pii.find(table(spark, [])).count() == 0


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_licences(spark):
    texts = [MIT, "Words\nReleased under the MIT License.\nWords. All rights reserved.", "Licensed under CC BY-NC 4.0.", None, "", "the mit license is nice",
             "Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License.", MIT[-200:]]
    found = {r["doc_id"]: (r["n_sentences"], r["licences"]) for r in licences.scan(table(spark, texts + [MIT])).collect()}
    assert found == {0: (3, ["MIT"]), 1: (2, ["MIT"]), 2: (1, ["CC-BY-NC-4.0"]), 3: (0, []), 4: (0, []), 5: (0, []),
                     6: (2, ["Apache-2.0"]), 7: (0, []), 8: (3, ["MIT"])}
    twice = spark.createDataFrame([(1, MIT), (1, MIT), (None, MIT)], "doc_id long, text string")
    assert [r["n_sentences"] for r in licences.scan(twice).collect()] == [3, 3, 3]
    assert licences.scan(table(spark, [])).count() == 0


def test_longer_rules_come_first():
    order = [tuple(ids) for _, ids in licences.RULES]
    for i, ids in enumerate(order):
        for later in order[i + 1 :]:
            assert " ".join(ids) not in " ".join(later)


def test_url_rules(spark):
    urls = ["http://a.net/x", "http://net", "http://net/", "http://example.net/en/1", "http://b.example.net/de", "http://EXAMPLE.com/de/x?y#z", "http://example.com/de",
            "http://x.org/fr/", "http://xorg/fr/", "nothing", None, "http://example.net/en/a://b", "a://B?c", "x://h:80/p#f?q"]
    pages = spark.createDataFrame([(i, u, "<p>cheap pills here, words</p>", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    rows = urlfilter.judge(pages, ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"]).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1][2] is None and got[2][2] == "net/"
    assert got[3][2:] == ("example.net/en/", "allow") and got[4][2:] == ("net/", "block") and got[5] == ("example.com", "/de/x", "example.com/de/", "block")
    assert got[6][2] is None and got[7][2:] == ("org/fr/", "allow") and got[8][2] is None
    assert got[9] == got[10] == ("", "", None, "allow") and got[11][:2] == ("example.net", "/en/a://b")
    assert got[12] == ("b", "", None, "allow") and got[13][:2] == ("h:80", "/p")
    assert urlfilter.judge(pages.limit(0), ["net/"], []).count() == 0


def test_url_words_and_bayes(spark):
    good = [f"http://riverbank{i % 3}.example.org/travel/{i}" for i in range(40)]
    bad = [f"http://cheappills.example.org/buy/{i}" for i in range(20)] + ["http://pillsforless.example.org/buy/now"]
    rows = [(u, "<p>The river's bank, travel now.</p>") for u in good] + [(u, "<p class=river>CHEAP pills for less, buy now</p>") for u in bad]
    rows += [(None, None), ("http://neutral.example.org/buy/pills", "<p class=\"travel\">123</p>")]
    pages = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "page_id long, url string, html string")
    got = [r["verdict"] for r in urlfilter.judge(pages, [], []).orderBy("page_id").collect()]
    assert got[:40] == ["allow"] * 40 and got[40:61] == ["block"] * 21 and got[61] == "allow" and got[62] == "block"
    logs = {w: np.log(0.1) for w in ("cheap", "pills", "river", "bank")}
    assert urlfilter.best_cut("cheappills", logs, 100) == ["cheap", "pills"]
    assert urlfilter.best_cut("riverbankx", logs, 100) == ["river", "bank", "x"]
    assert urlfilter.best_cut("", logs, 100) == []


def test_urls_of_hosts_held_out(spark):
    """Hosts without a seed word and pages without a text: what texts elsewhere say of the same host words decides."""
    bad, good = ["luckyspin", "spinclub", "jackpotnight", "luckynight"], ["gardenclub", "riverwalk", "nightwalk", "rivergarden"]
    words = "lucky spin club jackpot night garden river walk"
    rows = [(f"http://{h}{i}.org/p/{i}", f"<h1>{words}</h1><p>place a bet in our casino</p>") for h in bad for i in range(9)]
    rows += [(f"http://{h}{i}.org/p/{i}", f"<h1>{words}</h1><p>betting is not, casinos are not whole words</p>".replace("betting", "better")) for h in good for i in range(9)]
    held = [("http://jackpotspin.net/p/1", None), ("http://luckyjackpot.net/p/1", ""), ("http://gardenwalk.net/p/1", None), ("http://rivergardenwalk.net/q", "<p> 1 </p>")]
    pages = spark.createDataFrame([(i, *x) for i, x in enumerate(rows + held)], "page_id long, url string, html string")
    got = [r["verdict"] for r in urlfilter.judge(pages, [], []).orderBy("page_id").collect()]
    assert got == ["block"] * 36 + ["allow"] * 36 + ["block", "block", "allow", "allow"]
    assert all(r["score"] is None and r["verdict"] == "allow" for r in urlfilter.judge(pages, [], [], seeds=()).collect())


REVISITS = "record_id long, url string, ts long, status int, headers map<string,string>, key string, row int"


def test_revisits(spark):
    rows = [
        (1, "http://www.A.de/p/?b=2&a=1&utm_x=3#f", 10, 200, {"ETag": '"1"', "Content-Type": "t", "Date": "d1"}),
        (2, "https://a.de:443/p?a=1&b=2", 20, 200, {"ETag": '"2"', "Vary": "v"}),
        (3, "a.de/p?a=1&b=2", 15, 304, {"etag": 'W/"1"', "Date": "d3", "Server": "s"}),
        (4, "a.de/p?a=1&b=2", 20, 304, {"etag": '"1"'}), (5, "a.de/p?a=1&b=2", 25, 304, {"etag": '"1"'}), (6, "a.de/p?a=1&b=2", 30, 304, None),
        (7, "a.de/p?a=1&b=2", 10, 304, {}), (8, None, 40, 304, {"etag": '"1"'}), (9, "a.de/p?a=1&b=2", None, 304, None),
        (10, "b.de/", 1, 200, {"Last-Modified": "m"}), (11, "b.de", 2, 304, {"last-modified": "m"}), (11, "b.de", 2, 304, {"last-modified": "m"}),
        (12, "b.de", 3, 404, {}), (None, "b.de", 4, 304, {"etag": '"9"'}), (13, "b.de/", 1, 200, {"Last-Modified": "n"}), (None, "b.de", 2, 200, {}),
    ]
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], REVISITS)
    got = sorted(((r["record_id"] or 0, r["state"], r["source_id"], r["headers"]) for r in warc.resolve(table).collect()), key=lambda x: x[0])
    assert [g[:3] for g in got] == [
        (0, "changed", None), (3, "resolved", 1), (4, "resolved", 1), (5, "changed", None), (6, "unchecked", 2), (7, "orphan", None), (8, "orphan", None),
        (9, "orphan", None), (11, "changed", None), (11, "changed", None)]
    assert got[1][3] == {"etag": 'W/"1"', "content-type": "t", "date": "d3"}
    assert got[4][3] == {"etag": '"2"', "vary": "v"}
    assert warc.resolve(table.limit(0)).count() == 0


def test_a_hot_url_spans_buckets(spark):
    n = 3000
    rows = spark.range(n).select(
        F.col("id").alias("record_id"), F.lit("http://hot.de/").alias("url"), F.col("id").alias("ts"),
        F.when(F.col("id") % 50 == 7, 200).otherwise(304).alias("status"), F.create_map(F.lit("etag"), F.lit("e")).alias("headers"))
    got = {r["record_id"]: r["source_id"] for r in warc.resolve(rows).collect()}
    assert got == {i: (i - 8) // 50 * 50 + 7 if i > 7 else None for i in range(n) if i % 50 != 7}
