"""The thirteen operators as queries over whole tables, and what SQL can express of them."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.llm import decontam, fim, licences, linededup, mixing, orchard, packing, pii, quality, simhash, substring, urlfilter, warc
from taskloom.session import written


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op5_substring(spark: SparkSession, folder: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    trees = quality.train(docs, _table(spark, folder, "labels"))
    return quality.score_documents(docs, trees).select("doc_id", "quality.*")


def captures(pages: DataFrame) -> DataFrame:
    """Six captures of each page, as a crawler would have made them: four of the page, two of its site's root.

    Visits 0 and 4 and some of 2 are full responses, the rest not-modified; some validators are weak, absent or
    of another version. The root of a common host is a very common URL.
    """
    p, v = F.col("page_id"), F.col("v")
    visits = pages.select("page_id", "url", F.octet_length("html").alias("size"), F.md5("html").alias("digest"),
                          F.explode(F.sequence(F.lit(0), F.lit(5))).alias("v"))
    root = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*", 0)
    full = ((v == 0) & (p % 11 != 0)) | ((v == 2) & (p % 5 == 0)) | ((v == 4) & (p % 3 == 0))
    version = F.when((v >= 2) & (p % 5 == 0), "2").otherwise("1")
    url = F.when(v >= 4, F.concat(root, F.lit("/"))).otherwise(F.col("url"))
    mark = F.when(v >= 4, F.concat(F.lit('"root'), (p % 2).cast("string"), F.lit('"'))).otherwise(
        F.concat(F.lit('"'), F.substring(F.md5(F.concat("url", version)), 1, 12), F.lit('"')))
    tag = F.when(full, F.when(p % 4 != 3, mark)).otherwise(
        F.when((p % 6 == 5) & (v == 3), '"other"').when(p % 4 == 0, mark).when(p % 4 == 1, F.concat(F.lit("W/"), mark)))
    ts = p % 97 * 1000 + v * 700 + p % 7 * 13
    lines = [("Date", F.concat(F.lit("t"), ts.cast("string"))), ("ETag", tag),
             ("Last-Modified", F.when(p % 3 != 2, F.concat(F.lit("d"), version))),
             ("Cache-Control", F.concat(F.lit("max-age="), (p % 100 + v).cast("string"))),
             ("Content-Length", F.when(full, F.col("size")).otherwise(0).cast("string")),
             ("Content-Type", F.when(full, F.lit("text/html"))), ("X-Digest", F.when(full, F.col("digest"))),
             ("Server", F.when(~full, F.lit("edge")))]
    headers = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), c.alias("value")) for k, c in lines)), lambda e: e["value"].isNotNull())
    return visits.select((p * 6 + v).alias("record_id"), url.alias("url"), ts.alias("ts"), F.when(full, 200).otherwise(304).alias("status"),
                         F.map_from_entries(headers).alias("headers"))


def op1_revisits(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.resolve(captures(_table(spark, folder, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.withColumn("headers", F.array_join(lines, "\n")).withColumn("source_id", F.coalesce("source_id", F.lit(-1).cast("long")))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(_table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def tokenizer_definition(path: str | None = None) -> str:
    """JSON text of the tokenizer at ``path`` (default: the public one with word ends)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, folder, "documents"), tokenizer_definition())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.scan(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("sequence", ",").alias("sequence"), F.array_join("licences", ",").alias("licences"))


def op8_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without recurring lines: the text that is left, as a digest, and the counts of lines."""
    found = linededup.drop_recurring(_table(spark, folder, "documents").select("doc_id", "text"), **linededup.WHOLE)
    return found.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op9_urls(spark: SparkSession, folder: str) -> DataFrame:
    found = urlfilter.judge(_table(spark, folder, "pages"), block=["net/", "example.com/de/"], allow=["example.net/en/", "org/fr/"])
    return found.select("page_id", "host", "path", "rule", "verdict")


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.judge(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    members, clusters = orchard.cluster(_table(spark, folder, "embeddings").select("vec_id", "embedding"))
    named = clusters.select("cluster", F.col("inertia").alias("cluster_inertia"), F.sum("inertia").over(Window.partitionBy(F.lit(0))).alias("inertia"),
                            F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))
    return members.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_fim(spark: SparkSession, folder: str) -> DataFrame:
    found = fim.transform(_table(spark, folder, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_mixing(spark: SparkSession, folder: str) -> DataFrame:
    sized = _table(spark, folder, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(written(sized, "mix-sized")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_revisits": op1_revisits,
    "op2_pii": op2_pii,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_substring": op5_substring,
    "op6_quality": op6_quality,
    "op7_licences": op7_licences,
    "op8_line_templates": op8_line_templates,
    "op9_urls": op9_urls,
    "op10_decontamination": op10_decontamination,
    "op11_centroids": op11_centroids,
    "op12_fim": op12_fim,
    "op13_mixing": op13_mixing,
}
ORACLE: dict[str, str] = {
    "op1_revisits": r"""
WITH v AS (SELECT page_id AS p, url, html, unnest([0, 1, 2, 3, 4, 5]) AS v FROM pages
), f AS (SELECT *, (v = 0 AND p % 11 <> 0) OR (v = 2 AND p % 5 = 0) OR (v = 4 AND p % 3 = 0) AS ok,
    CASE WHEN v >= 2 AND p % 5 = 0 THEN '2' ELSE '1' END AS version,
    CASE WHEN v >= 4 THEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0) || '/' ELSE url END AS u,
    p % 97 * 1000 + v * 700 + p % 7 * 13 AS ts FROM v
), m AS (SELECT *, CASE WHEN v >= 4 THEN '"root' || (p % 2) || '"' ELSE '"' || substr(md5(url || version), 1, 12) || '"' END AS mark FROM f
), c AS (SELECT p * 6 + v AS record_id, ok, ts, u, 't' || ts AS date, CASE WHEN p % 3 <> 2 THEN 'd' || version END AS modified,
    CASE WHEN ok THEN CASE WHEN p % 4 <> 3 THEN mark END WHEN p % 6 = 5 AND v = 3 THEN '"other"' WHEN p % 4 = 0 THEN mark WHEN p % 4 = 1 THEN 'W/' || mark END AS tag,
    'max-age=' || (p % 100 + v) AS cache, CASE WHEN ok THEN strlen(html) ELSE 0 END AS size, md5(html) AS digest FROM m
), k AS (SELECT *, regexp_replace(regexp_replace(u, '#[\s\S]*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS t FROM c
), q AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(t, '^[^/?]*', 0)), ':(80|443)$', ''), '^www\.', '')
      || regexp_replace(regexp_extract(t, '^[^/?]*([^?]*)', 1), '/+$', '') AS page,
    list_sort(list_filter(string_split(regexp_extract(t, '^[^?]*\?([\s\S]*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS params FROM k
), n AS (SELECT *, page || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key FROM q
), best AS (SELECT url_key, ts, max(record_id) AS record_id FROM n WHERE ok GROUP BY url_key, ts
), a AS (SELECT r.*, b.record_id AS source FROM (SELECT * FROM n WHERE NOT ok) r ASOF LEFT JOIN best b ON r.url_key = b.url_key AND r.ts > b.ts
), j AS (SELECT a.*, s.tag AS stag, s.modified AS smod, s.size AS ssize, s.digest AS sdigest,
    CASE WHEN a.source IS NULL THEN 'orphan' WHEN a.tag IS NULL AND a.modified IS NULL THEN 'unchecked'
      WHEN CASE WHEN a.tag IS NOT NULL THEN coalesce(regexp_replace(a.tag, '^W/', '') = regexp_replace(s.tag, '^W/', ''), false)
        ELSE coalesce(a.modified = s.modified, false) END THEN 'resolved' ELSE 'changed' END AS state
  FROM a LEFT JOIN n s ON a.source = s.record_id)
SELECT record_id, url_key, ts, state, CASE WHEN state IN ('resolved', 'unchecked') THEN source ELSE -1 END AS source_id,
  CASE WHEN state IN ('resolved', 'unchecked') THEN concat_ws(chr(10), 'cache-control: ' || cache, 'content-length: ' || ssize, 'content-type: text/html',
      'date: ' || date, 'etag: ' || coalesce(tag, stag), 'last-modified: ' || coalesce(modified, smod), 'x-digest: ' || sdigest)
    ELSE concat_ws(chr(10), 'cache-control: ' || cache, 'content-length: ' || size, 'date: ' || date, 'etag: ' || tag, 'last-modified: ' || modified, 'server: edge') END AS headers
FROM j""",
    "op7_licences": licences.oracle(),
    "op11_centroids": orchard.oracle(),
    "op12_fim": fim.ORACLE,
    "op13_mixing": mixing.ORACLE,
    "op5_substring": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM win) WHERE r > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM later
), g AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ks IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ks, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)""",
    "op10_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bn AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0
), bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)
), ns AS (SELECT DISTINCT n FROM bw
), dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns)
), h AS (SELECT doc_id, item_id, n, i FROM dw JOIN bw USING (n, win)
), p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id
), t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
