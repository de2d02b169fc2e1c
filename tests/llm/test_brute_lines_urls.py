"""Line templates, host segmentation and url scores against plain Python."""

import itertools
import math
import random
import re

import pytest
import xxhash

from taskloom.llm import linededup, urlfilter


def dropped_lines(docs, min_docs, depth=3, agree=0.75, min_tokens=1):
    """id -> text without recurring lines; ids are distinct."""
    forms, where = {}, {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            p = linededup.parse(line.encode(), depth, min_tokens)
            if p:
                where[line] = p
                forms.setdefault(p[0], {}).setdefault(p[1], set()).add(i)
    template = {}
    for leaf, own in forms.items():
        left = sorted(own, key=lambda f: (len(own[f]), xxhash.xxh3_64_intdigest(f) - (1 << 63)), reverse=True)
        while left:
            lead = left[0].split()
            need = agree if len(lead) >= linededup.SHORT else 1.0
            joined = [f for f in left if sum(a == b for a, b in zip(f.split(), lead)) >= need * len(lead)]
            template.update({(leaf, f): (leaf, left[0]) for f in joined})
            left = [f for f in left if f not in joined]
    holders = {}
    for (leaf, form), t in template.items():
        holders.setdefault(t, set()).update(forms[leaf][form])
    out = {}
    for i, text in docs:
        if text is not None:
            keep = lambda x: x not in where or len(holders[template[where[x]]]) < min_docs or min(holders[template[where[x]]]) == i
            text = "\n".join(x for x in text.split("\n") if keep(x))
        out[i] = text
    return out


@pytest.mark.parametrize("min_docs", [2, 3])
def test_dropped_lines_equal_brute_force(spark, min_docs):
    r = random.Random(min_docs)
    docs = [(i, "\n".join(" ".join(r.choice(["a", "b", "c", "d1", "e", "10:0%d" % r.randrange(3)]) for _ in range(r.randrange(9))) for _ in range(r.randrange(7)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "a b c " * 20_000 + "\na b"), (203, "a b c " * 20_000 + "\nonly here at all")]
    want = dropped_lines(docs, min_docs)
    found = linededup.drop_recurring(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), min_docs=min_docs, min_tokens=1)
    assert {x["doc_id"]: x["text"] for x in found.collect()} == want
    assert sum(t != want[i] for i, t in docs) > 50


def test_best_cut_equals_all_cuts():
    r = random.Random(7)
    for _ in range(300):
        label = "".join(r.choice("ab") for _ in range(r.randrange(1, 9)))
        words = {"".join(w) for n in (1, 2, 3) for w in itertools.product("ab", repeat=n) if r.random() < 0.4}
        total = 1000.0
        logs = {w: math.log(r.randrange(1, 400) / total) for w in words}

        def score(cut):
            return sum(logs.get(w, math.log(10 / total) - len(w) * math.log(10)) for w in cut)

        cuts = []
        for marks in itertools.product([0, 1], repeat=len(label) - 1):
            at = [0, *(i + 1 for i, m in enumerate(marks) if m), len(label)]
            cuts.append([label[a:b] for a, b in zip(at, at[1:])])
        found = urlfilter.best_cut(label, logs, total)
        assert "".join(found) == label and math.isclose(score(found), max(map(score, cuts)))


def test_scores_equal_plain_bayes(spark):
    r = random.Random(3)
    names = ["casino-win", "news-win", "cheap-shoes", "the-news", "shoes", "blog", "casino", "news-blog"]
    texts = ["<p>win news shoes the blog org a en x</p>", "<p title='xxx'>news, the CASINO-win; cheap</p>", "<p>casinos and cheapest shoes</p>", None, "<b>12</b>"]
    rows = [(i, f"http://{r.choice(names)}.org/{r.choice(['a', 'win/x', 'en'])}/{r.randrange(2)}", r.choice(texts)) for i in range(80)]
    rows += [rows[0], (900, None, None), (901, "http://" + "longhost" * 60 + ".org/", ""), (902, "no scheme", "casino")]
    pages = spark.createDataFrame([(*x, "h", 0.5) for x in rows], "page_id long, url string, html string, host string, score double")
    found = urlfilter.judge(pages, [], [])

    def tokens(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m.group(1).lower(), m.group(2)) if m else ("", "")
        own = [w for label in re.findall("[a-z]+", host) for w in cut(label)]
        return [f"host:{w}" for w in own] + [f"path:{w}" for w in re.findall("[a-z]+", path.lower())]

    def words_of(html):
        return re.findall("[a-z]+", re.sub("<[^>]*>", " ", html or "").lower())

    counts = {}
    for _, _, html in rows:
        for w in words_of(html):
            counts[w] = counts.get(w, 0) + (len(w) > 1)
    counts = {w: n for w, n in counts.items() if n}
    total = sum(counts.values())
    logs = {w: math.log(n / total) for w, n in counts.items()}
    cut = lambda label: urlfilter.best_cut(label, logs, float(total))
    seen = [tokens(url) for _, url, _ in rows]
    said = [words_of(html) for _, _, html in rows]
    bad = [t for t, s in zip(seen, said) if set(s) & set(urlfilter.SEEDS)]
    good = [t for t, s in zip(seen, said) if s and not set(s) & set(urlfilter.SEEDS)]
    flat = lambda side: [w for t in side for w in t]
    size = len(set(flat(seen)))
    log_of = lambda w, side: math.log((flat(side).count(w) + 1) / (len(flat(side)) + size))
    want = sorted((i, round(math.log(len(bad) / len(good)) + sum(log_of(w, bad) - log_of(w, good) for w in t), 6)) for (i, _, _), t in zip(rows, seen))
    got = found.collect()
    assert sorted((x["page_id"], round(x["score"], 6)) for x in got) == want
    assert all(x["verdict"] == ("block" if x["score"] > 0 else "allow") for x in got)
