"""Benchmark decontamination (10), in DataFrame functions only.

Benchmark items are cut into windows of ``width`` words (a shorter item is one
window). A window cannot occur in a document unless one of the document's grams
at every ``stride``-th word lies inside it: with grams of k words and a stride of
s, k + s - 1 = width. So documents are first scanned with few, aligned grams
against the broadcast set of the windows' grams; the full windows of the
documents with a hit are then joined with the windows themselves and verified
word for word. Each distinct window length among short items has grams of its own.

Sets made of the benchmark are sent to all tasks only while they have at most
``broadcast_rows`` rows; beyond that Spark joins them by shuffle.

Defined cases: null texts have no words; an item without words is no window;
equal items, and items whose windows occur in each other, are all reported;
every row of a document is judged by its own id and text, repeated rows alike; a
null item id counts as no item, but its windows still hit; an empty benchmark or empty
table gives no hits; extra columns are not read; texts are read whole.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.session import written

_LOW = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_FROM = _LOW + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TO = " " * len(_LOW) + "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Words of small ASCII letters, digits and non-ASCII characters; A-Z are lower-cased first."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), _FROM, _TO)
    return F.array_remove(F.split(plain, " +"), "")


def _grams(words: str, width: int, step: int) -> Column:
    """Hashes of the runs of ``width`` words at every ``step``-th word."""
    last = F.size(words) - width
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i + 1, width)))


def _windows(words: str, width: int) -> Column:
    """(at, window) of every run of ``width`` words, joined by spaces; words have none, so equal strings are equal windows."""
    last = F.size(words) - width
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(words, i + 1, width), " ").alias("window")))


def _small(table: DataFrame, limit: int) -> DataFrame:
    """Marked for broadcast if it is within the bound, else left to Spark."""
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table


def item_windows(benchmark: DataFrame, width: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(n, window, items): each distinct window, its number of words, and the items that it is from."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where("size(words) > 0")
    # An item of fewer words is one window.
    n = F.least(F.size("words"), F.lit(width))
    starts = F.sequence(F.lit(1), F.size("words") - n + 1)
    every = F.transform(starts, lambda i: F.array_join(F.slice("words", i, n), " "))
    rows = rows.select("item", n.alias("n"), F.explode(every).alias("window"))
    return rows.groupBy("n", "window").agg(F.collect_set("item").alias("items"))


def judge(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, id_col: str = "doc_id",
          text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
          broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row a document: its id, n_words, n_hit, ``items`` (ids as sorted strings), ``hits`` (at, n: where
    windows occur, in words) and contaminated: some word is hit, and at least one word in ``share``.
    """
    found = _judged(docs, benchmark, width, share, id_col, text_col, item_col, item_text, broadcast_rows)
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", "hits", "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, id_col: str = "doc_id",
                      text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                      broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents, all columns, without those that ``judge`` finds contaminated."""
    found = _judged(docs, benchmark, width, share, id_col, text_col, item_col, item_text, broadcast_rows)
    bad = written(found.where("contaminated").select("k1", "k2").distinct(), "decontam-bad").toDF("bad1", "bad2")
    body = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    k1, k2 = _keys(docs[id_col], body)
    return docs.join(bad, (k1 == bad["bad1"]) & (k2 == bad["bad2"]), "left_anti")


def _keys(id_: Column, body: Column) -> tuple[Column, Column]:
    """Two hashes of id and text: they name a row in every scan."""
    return F.xxhash64(id_, body), F.xxhash64(body, F.lit("decontam"), id_)


def _judged(docs: DataFrame, benchmark: DataFrame, width: int, share: int, id_col: str, text_col: str, item_col: str,
            item_text: str, broadcast_rows: int) -> DataFrame:
    windows = written(item_windows(benchmark, width, item_col, item_text), "decontam-windows")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most ``width`` numbers
    scans = {n: (n - n // 2, n // 2 + 1) for n in lengths}  # gram width and stride
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k1, k2 = _keys(F.col("id"), F.col("body"))
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body")).select("id", "body", k1.alias("k1"), k2.alias("k2"))
    read = rows.select("id", "k1", "k2", words_of(F.col("body")).alias("words"))
    scanned = read.select("id", "k1", "k2", F.size("words").alias("n_words"), *(_grams("words", *scans[n]).alias(f"g{n}") for n in lengths))
    scanned = written(scanned, "decontam-scan")

    touched = None
    for n in lengths:
        inside = windows.where(F.col("n") == n).select(F.split("window", " ").alias("words"))
        inside = inside.select(F.explode(_grams("words", scans[n][0], 1)).alias("gram")).distinct()
        some = scanned.select("k1", "k2", F.explode(f"g{n}").alias("gram")).join(_small(inside, broadcast_rows), "gram", "left_semi")
        some = some.select("k1", "k2", F.lit(n).alias("n"))
        touched = some if touched is None else touched.unionByName(some)
    empty = F.array().cast("array<struct<at:int,n:int>>")
    if touched is None:
        return scanned.select(
            "id", "k1", "k2", F.col("n_words").cast("long"), F.lit(0).cast("long").alias("n_hit"),
            F.array().cast("array<string>").alias("items"), empty.alias("hits"), F.lit(False).alias("contaminated"))
    touched = written(touched.groupBy("k1", "k2").agg(F.collect_set("n").alias("ns")), "decontam-touched")

    # Only documents with an aligned gram in common have their whole windows compared. Spark sends
    # the keys to all tasks if the written table is below its broadcast limit, and shuffles otherwise.
    texts = rows.select("k1", "k2", "body").join(touched, ["k1", "k2"]).select("k1", "k2", "ns", words_of(F.col("body")).alias("words"))
    found = None
    for n in lengths:
        own = texts.where(F.array_contains("ns", n)).select("k1", "k2", F.explode(_windows("words", n)).alias("w"))
        own = own.select("k1", "k2", "w.at", "w.window")
        own = own.join(_small(windows.where(F.col("n") == n), broadcast_rows), "window").select("k1", "k2", "at", "n", "items")
        found = own if found is None else found.unionByName(own)
    judged = found.groupBy("k1", "k2").agg(
        F.array_sort(F.collect_set(F.struct("at", "n"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def longer(state: Column, hit: Column) -> Column:
        stop = hit["at"] + hit["n"]
        more = F.greatest(stop - F.greatest(hit["at"], state["stop"]), F.lit(0))
        return F.struct(F.greatest(state["stop"], stop).alias("stop"), (state["n"] + more).alias("n"))

    union = F.aggregate("hits", F.struct(F.lit(0).alias("stop"), F.lit(0).alias("n")), longer, lambda s: s["n"])
    judged = judged.withColumn("n_hit", union)
    n_hit, n_words = F.coalesce("n_hit", F.lit(0)).cast("long"), F.col("n_words").cast("long")
    return scanned.select("id", "k1", "k2", "n_words").join(judged, ["k1", "k2"], "left").select(
        "id", "k1", "k2", n_words.alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("hits", empty).alias("hits"),
        ((n_hit > 0) & (share * n_hit >= n_words)).alias("contaminated"))


def without_spans(words: Column, hits: Column) -> Column:
    """The words that no hit covers, joined by spaces: for removing spans in place of documents."""
    free = F.filter(words, lambda w, i: ~F.exists(hits, lambda h: (h["at"] <= i) & (i < h["at"] + h["n"])))
    return F.array_join(free, " ")
