"""URL filters (9): rules by host and path; host words by Viterbi; naive Bayes over host and path words.

Words and their counts come from the pages' own texts. Each distinct host label
(the letters between dots, hyphens and digits) is cut into the most probable
words: its substrings are joined with the word counts, so no vocabulary is sent
around or cut off, and the best path is found per label. Multinomial naive Bayes
is trained on all pages with a text: one whose visible text has a seed word is an
example of the unwanted class, whatever its url. The words of hosts and paths then
speak for or against every url that no rule covers, also where there is no text.

Defined cases: a null url, or one without ``://``, has empty host and path and
gets the prior's verdict; pages whose text is null or has no letters are judged but
not learned from; repeated pages are judged row by row and count as often as they
stand; long hosts are segmented whole; an empty table gives an empty result; if
one class has no pages all verdicts are ``allow``; extra columns are not read.
"""

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.session import written

#: Words in a page's visible text that make it an example of the unwanted class.
SEEDS = ("ads", "bet", "bets", "betting", "casino", "cheap", "gambling", "pills", "poker", "porn", "sex", "spam", "viagra", "xxx")
#: Longest word that segmentation looks for; longer runs are cut.
LONGEST = 20


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return _lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def matched_rule(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest rule (``host/path``) that covers the url's host or a parent of it, and starts its path."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):  # a later when is the outer one
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def visible(html: Column) -> Column:
    """Text of a page without tags, A-Z lower-cased."""
    return _lower(F.regexp_replace(F.coalesce(html.cast("string"), F.lit("")), "<[^>]*>", " "))


def unwanted(html: Column, seeds: tuple[str, ...]) -> Column:
    """Whether the visible text has a seed as a whole word; null where it has no letters."""
    seen = visible(html)
    found = seen.rlike(f"(?<![a-z])(?:{'|'.join(map(re.escape, seeds))})(?![a-z])") if seeds else F.lit(False)
    return F.when(seen.rlike("[a-z]"), found)


def word_counts(pages: DataFrame, html_col: str) -> DataFrame:
    """(word, n) over the visible texts of all pages."""
    words = F.split(visible(F.col(html_col)), "[^a-z]+")
    return pages.select(F.explode(words).alias("word")).where("length(word) > 1").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def best_cut(label: str, logs: dict[str, float], total: float) -> list[str]:
    """Most probable cut of a label; an unknown word of k letters has probability 10 / (total * 10**k)."""
    n = len(label)
    best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - LONGEST), end):
            word = label[start:end]
            score = best[start] + logs.get(word, np.log(10 / total) - (end - start) * np.log(10))
            if score > best[end]:
                best[end], back[end] = score, start
    out = []
    while n:
        out.append(label[back[n] : n])
        n = back[n]
    return out[::-1]


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) of distinct labels, by unigram Viterbi."""
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    n = F.length("label")
    starts = F.sequence(F.lit(1), n)
    subs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), n - i + 1)), lambda k: F.substring("label", i, k))))
    pairs = labels.where("label <> ''").select("label", F.explode(F.array_distinct(subs)).alias("word"))
    known = pairs.join(counts, "word", "left").groupBy("label").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n"))).alias("known"))

    def cut(batches):
        for b in batches:
            logs = [{k["word"]: float(np.log(k["n"] / total)) for k in known} for known in b["known"]]
            yield pd.DataFrame({"label": b["label"], "words": [best_cut(s, own, total) for s, own in zip(b["label"], logs)]})

    return known.mapInPandas(cut, "label string, words array<string>")


def judge(pages: DataFrame, block: list[str], allow: list[str], id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html", seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """One row a page: id, host, path, rule, verdict (the rule's, else that of naive Bayes), and ``score``, the
    log odds against the url, null where a class has no pages.
    """
    host, path = parts(F.col(url_col))
    rows = written(pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), unwanted(F.col(html_col), seeds).alias("bad")), "url-rows")
    urls = written(rows.groupBy("host", "path").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")), "url-distinct")
    hosts = urls.select("host").distinct()
    labels = hosts.select("host", F.posexplode(F.split("host", "[^a-z]+")).alias("at", "label")).where("label <> ''")
    labels = written(labels, "url-labels")
    # Written, as both the total and the join take them.
    counts = written(word_counts(pages, html_col), "url-words")
    cuts = written(segment(labels.select("label").distinct(), counts), "url-cuts")
    # Hosts are distinct, so a list holds the words of one host.
    by_host = labels.join(cuts, "label").groupBy("host").agg(F.flatten(F.sort_array(F.collect_list(F.struct("at", "words")))["words"]).alias("words"))
    host_words = F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("host:"), w))
    path_words = F.transform(F.filter(F.split(_lower(F.col("path")), "[^a-z]+"), lambda w: w != ""), lambda w: F.concat(F.lit("path:"), w))
    # Both sides are dealt by the join, so Spark can split a host that has very many urls.
    tokens = urls.join(written(by_host, "url-hosts"), "host", "left").select("host", "path", "bad", "good", F.concat(host_words, path_words).alias("tokens"))
    tokens = written(tokens, "url-tokens")
    bad, good = urls.agg(F.sum("bad"), F.sum("good")).first()
    scores = tokens.select("host", "path", F.lit(None).cast("double").alias("score"))
    if bad and good:
        each = tokens.select("host", "path", "bad", "good", F.explode("tokens").alias("token"))
        seen = written(each.groupBy("token").agg(F.sum("bad").alias("b"), F.sum("good").alias("g")), "url-seen")
        size, b, g = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("g"), F.lit(0))).first()
        odds = seen.select("token", (F.log((F.col("b") + 1) / float(b + size)) - F.log((F.col("g") + 1) / float(g + size))).alias("odds"))
        prior = float(np.log(bad / good))
        # A sum of doubles depends on its order; sorted lists of one url's words make it repeatable.
        summed = each.join(odds, "token").groupBy("host", "path").agg(F.sort_array(F.collect_list("odds")).alias("odds"))
        total = F.aggregate(F.coalesce("odds", F.array().cast("array<double>")), F.lit(prior), lambda s, x: s + x)
        scores = tokens.select("host", "path").join(summed, ["host", "path"], "left").select("host", "path", total.alias("score"))
    scores = written(scores, "url-scores")
    rule = matched_rule(F.col("host"), F.col("path"), [*block, *allow])
    verdict = F.when(F.col("rule").isin(block), "block").when(F.col("rule").isin(allow), "allow").when(F.col("score") > 0, "block").otherwise("allow")
    found = rows.join(scores, ["host", "path"]).withColumn("rule", rule).withColumn("verdict", verdict)
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "score")
