import random
import re

from pyspark.sql import functions as F

from taskloom.functions import lexicon
from taskloom.functions import text as t
from taskloom.functions.language import language_detect, language_runner
from taskloom.operators.corpus import corpus_features, rule_hints

EDGES = ["", " ", " x ", "\x1cx y\x1f", "a b　", "\r\n a \t", "emoji 😀 end", "​kept​", "x\x85"]


def test_strip_and_tokens_follow_python(spark):
    df = spark.createDataFrame([(s,) for s in EDGES], "s string")
    rows = df.select("s", t.strip(F.col("s")), F.size(t.tokens(F.col("s"))), t.token_count(F.col("s")), t.is_blank(F.col("s"))).collect()
    for s, stripped, listed, counted, blank in rows:
        assert stripped == s.strip()
        assert listed == counted == len(s.split())
        assert blank == (not s.strip())


def test_truncate_counts_code_points(spark):
    got = spark.createDataFrame([("😀😀abc",)], "s string").select(t.truncate(F.col("s"), 3)).first()[0]
    assert got == "😀😀a"


def test_null_is_blank(spark):
    assert spark.createDataFrame([(None,)], "s string").select(t.is_blank(F.col("s"))).first()[0]


def _brute_force(text, domain):
    text = text.strip()
    low, toks, lines = text.lower(), text.lower().split(), text.split("\n")
    n = max(len(toks), 1)
    digits = sum(any(c.isdecimal() for c in k) for k in toks)
    listed = sum(bool(re.match(r"^\s*(\d+[.):]|[-*•])\s+\S", ln)) for ln in lines)
    table = any(len(p) >= 2 for ln in lines for p in [ln[ln.find("|") + 1 : ln.rfind("|")]] if ln.count("|") >= 2)
    temporal = sum(low.count(w) for w in lexicon.TEMPORAL_WORDS)
    spatial = sum(low.count(w) for w in lexicon.SPATIAL_WORDS)
    prose = len(text) >= 400 and not table and listed / len(lines) < 0.15 and digits / n < 0.25
    hints = [k for k, ok in (
        (1, spatial >= 4), (2, prose), (3, digits / n >= 0.07 or domain in lexicon.NUMERIC_DOMAINS),
        (4, table or listed / len(lines) >= 0.2), (5, temporal >= 4)) if ok]
    return (len(text), len(toks), digits, listed, len(lines), table, temporal, spatial, hints if len(text) >= 200 else [])


def test_features_match_brute_force(spark):
    rng = random.Random(7)
    pieces = ["strengthen ", "at each round ", "per step ", " row", "map", "- item\n", "12. next\n", "  • a\n", "|ab|", "|a|", "\n",
              "٣ ", "x1 ", "west east ", "Left RIGHT ", "a|b||c\n", "word ", "\r\n", "\t* z ", "😀 ", "floor plan ", "state "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    rows = [(i, s, rng.choice(["news", "medical", "", None])) for i, s in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, text string, quality_domain_txt string")
    got = rule_hints(corpus_features(df)).orderBy("id").select(
        "text_len", "token_count", "digit_tokens", "list_lines", "line_count", "has_table", "temporal_score", "spatial_score", "rule_hints"
    ).collect()
    for row, (_, s, domain) in zip(got, rows):
        assert tuple(row) == _brute_force(s, domain), s


def test_languages(spark):
    names = {  # name: (prompt label, runner)
        "GNU C++17": ("cpp", "cpp"), "JavaScript": ("javascript", "java"), "javascript (v8)": ("c", "java"), "C": ("c", "c"),
        "Haskell": ("cpp", "haskell"), "Kotlin 1.9": ("kotlin", "kotlin"), "Go": ("go", "go"), "PyPy 3-64": ("python", "pypy 3-64"),
        "gnu c": ("c", "c"), "Ruby": ("ruby", "ruby"), "": ("cpp", ""), " Python 3 ": ("python", "python3"), "Django": ("go", "go"),
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for n, a, b in df.select("n", language_detect(F.col("n")), language_runner(F.col("n"))).collect():
        assert (a, b) == names[n], n
