"""Queries on translation memory, history, jobs and their results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import short_hash
from lectern.operators import jobs as J
from lectern.operators import memory as M
from lectern.plans.base import query, table
from lectern.plans.text import PAGED, SEGMENTS, documents, paged, segmented
from lectern.sources.shared import shared_folder
from lectern.streaming.tables import memory_table

NOW = "2025-01-01 00:00:00"
MEMO = r"""rec AS (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS s, min(doc_id) AS first FROM documents GROUP BY 1),
memo AS (SELECT s, CASE WHEN first % 2 = 0 THEN 'general' ELSE 'legal' END AS domain, 'memory ' || first AS target FROM rec)"""


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each distinct text, under its lowest doc_id."""
    d = documents(spark, sf_dir).groupBy(M.memory_source("text").alias("source")).agg(F.min("doc_id").alias("first"))
    return d.select("source", F.concat(F.lit("memory "), F.col("first").cast("string")).alias("target"), F.when(F.col("first") % 2 == 0, "general").otherwise("legal").alias("domain"), F.lit("").alias("signature"), (F.timestamp_seconds("first")).alias("updated_at"))


@query(rf"WITH {MEMO} SELECT doc_id, target AS remembered, target IS NOT NULL AS memory_hit FROM documents d LEFT JOIN memo ON regexp_replace(d.text, '^\s+|\s+$', '', 'g') = memo.s AND memo.domain = 'general'")
def memory_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts memory has in the general domain."""
    asked = documents(spark, sf_dir).select("doc_id", F.col("text").alias("source"), F.lit("general").alias("domain"), F.lit("").alias("signature"))
    return M.look_up(asked, memory(spark, sf_dir)).select("doc_id", "remembered", "memory_hit")


@query(rf"""WITH {MEMO}, n AS (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS s, 'general' AS domain, 'new ' || doc_id AS target, 1000000 + doc_id AS w FROM documents WHERE doc_id % 3 = 0),
a AS (SELECT s, domain, target, CAST(substr(target, 8) AS BIGINT) AS w FROM memo UNION ALL SELECT * FROM n)
SELECT md5(s) AS source_md5, domain, arg_max(target, w) AS target FROM a GROUP BY s, domain""")
def memory_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory after new results for every third document, the rest of them blank."""
    d = documents(spark, sf_dir)
    new = d.select(F.col("text").alias("source"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("new "), F.col("doc_id").cast("string"))).otherwise(" ").alias("target"), F.lit("general").alias("domain"), F.lit("").alias("signature"), F.timestamp_seconds(F.col("doc_id") + 1000000).alias("updated_at"))
    return M.upsert(memory(spark, sf_dir), new).select(F.md5(F.col("source").cast("binary")).alias("source_md5"), "domain", "target")


@query(rf"""WITH {MEMO}, n AS (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS s, 'general' AS domain, 'new ' || doc_id AS target, 1000000 + doc_id AS w FROM documents WHERE doc_id % 3 = 0),
a AS (SELECT s, domain, target, CAST(substr(target, 8) AS BIGINT) AS w FROM memo UNION ALL SELECT * FROM n)
SELECT md5(s) AS source_md5, domain, arg_max(target, w) AS target FROM a GROUP BY s, domain""")
def kept_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a kept table: the memory as one batch, the new results as two, one of them written twice, with compaction."""
    d = documents(spark, sf_dir)
    new = d.select("doc_id", F.col("text").alias("source"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("new "), F.col("doc_id").cast("string"))).otherwise(" ").alias("target"), F.lit("general").alias("domain"), F.lit("").alias("signature"), F.timestamp_seconds(F.col("doc_id") + 1000000).alias("updated_at"))
    kept = memory_table(spark, f"{shared_folder(spark).rstrip('/')}/kept-memory-{uuid.uuid4().hex}", fan=2)
    halves = [new.where((F.col("doc_id") % 2 == k)).drop("doc_id") for k in (0, 1)]
    for batch, rows in enumerate((memory(spark, sf_dir), *halves, halves[1])):
        kept.write(rows, min(batch, 2), few=batch == 0)
    return kept.read().select(F.md5(F.col("source").cast("binary")).alias("source_md5"), "domain", "target")


@query("""SELECT doc_id, 'b' || chr(0) || lang || chr(1) || 'k' || chr(0) || source AS signature FROM documents""")
def glossary_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature of a small glossary that each document brings."""
    g = F.create_map(F.lit(" k "), F.col("source"), F.lit("b"), F.concat(F.col("lang"), F.lit(" ")), F.lit("x"), F.lit("  "))
    return documents(spark, sf_dir).select("doc_id", M.signature(g).alias("signature"))


@query(f"""WITH RECURSIVE {SEGMENTS}, fnv AS (
  SELECT lang, 0 AS i, CAST(2166136261 AS BIGINT) AS h FROM (SELECT DISTINCT lang FROM documents)
  UNION ALL SELECT lang, i + 1, CAST((CAST(xor(h, ascii(substr(lang, i + 1, 1))) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT) FROM fnv WHERE i < length(lang)
), last AS (SELECT lang, arg_max(h, i) AS h FROM fnv GROUP BY lang),
digits AS (SELECT lang, h, 0 AS k, '' AS s FROM last UNION ALL SELECT lang, h // 36, k + 1, substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(h % 36 AS BIGINT) + 1, 1) || s FROM digits WHERE h > 0)
SELECT doc_id, CAST(sum(length(s.source)) AS BIGINT) AS source_characters, count(DISTINCT page_number) AS unit_count, CASE WHEN count(DISTINCT page_number) = 1 THEN 'page' ELSE 'pages' END AS unit_label,
  any_value(x.s) AS lang_hash FROM segments s JOIN documents d USING (doc_id) JOIN (SELECT lang, arg_max(s, k) AS s FROM digits GROUP BY lang) x ON x.lang = d.lang GROUP BY doc_id""")
def history_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history entry of every document, and the short hash of its language."""
    s = segmented(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    e = M.history_entries(s, ["doc_id", "lang"], F.concat(F.lit("document "), F.col("doc_id").cast("string")))
    return e.select("doc_id", "source_characters", "unit_count", "unit_label", short_hash("lang").alias("lang_hash"))


@query(f"""WITH RECURSIVE {SEGMENTS}, label AS (
  SELECT doc_id, 'document ' || doc_id || '|' || string_agg(segment_id || ':' || length(source), '|' ORDER BY seq) AS s FROM segments GROUP BY doc_id
), fnv AS (SELECT doc_id, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(s, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: CAST((CAST(xor(h, c) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT)) AS h FROM label)
SELECT doc_id, 'document ' || doc_id AS source_label, ltrim(array_to_string(list_transform(range(6, -1, -1), lambda k: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((h // CAST(36 ** k AS BIGINT)) % 36 AS BIGINT) + 1, 1)), ''), '0') AS id FROM fnv""")
def history_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of every document's history entry: a hash of its label and of its segments' ids and lengths."""
    e = M.history_entries(segmented(spark, sf_dir), ["doc_id"], F.concat(F.lit("document "), F.col("doc_id").cast("string")))
    return e.select("doc_id", "source_label", "id")


@query("""WITH h AS (SELECT user_id, event_type || '-' || (event_id % 40) AS id, ts AS saved_at, event_id FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, id ORDER BY saved_at DESC) AS a FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY saved_at DESC, id DESC) AS b FROM o WHERE a = 1),
m AS (SELECT user_id, id, saved_at, CAST(floor((epoch_ms(TIMESTAMP '2025-01-01 00:00:00') - epoch_ms(saved_at)) / 60000) AS BIGINT) AS mi FROM k WHERE b <= 25)
SELECT user_id, id, CASE WHEN mi < 1 THEN 'Just now' WHEN mi < 60 THEN mi || 'm ago' WHEN mi < 1440 THEN (mi // 60) || 'h ago' WHEN mi < 10080 THEN (mi // 1440) || 'd ago' ELSE strftime(saved_at, '%Y-%m-%d') END AS age FROM m""")
def newest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 newest entries of each user, by id, with their age."""
    e = table(spark, sf_dir, "events")
    h = e.select("user_id", F.concat("event_type", F.lit("-"), (F.col("event_id") % 40).cast("string")).alias("id"), F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()).alias("saved_at"))
    return M.newest(h, ["user_id"]).select("user_id", "id", M.age_label("saved_at", F.to_timestamp(F.lit(NOW))).alias("age"))


@query(f"""WITH RECURSIVE {SEGMENTS}, {PAGED}, p AS (SELECT doc, doc_id, CASE WHEN page_number % 4 = 0 THEN ' ' ELSE text END AS text FROM pages_),
t AS (SELECT doc, sum(length(s.source)) AS chars, count(*) AS segments FROM segments s JOIN p USING (doc_id) WHERE trim(p.text) <> '' GROUP BY doc),
c AS (SELECT doc, sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END) AS scans, count(*) AS units FROM p GROUP BY doc),
b AS (SELECT c.doc, CAST(coalesce(chars, 0) AS BIGINT) AS chars, CAST(greatest(coalesce(segments, 0) + 2 * scans, 1) AS BIGINT) AS requests, CAST(scans AS BIGINT) AS scans, units FROM c LEFT JOIN t USING (doc))
SELECT doc, chars, requests, scans, units, CAST(ceil(chars * CAST(1.35 AS DECIMAL(4,2)) + 550 * requests + 2000 * scans) AS BIGINT) AS tokens, chars >= 30000 OR requests >= 25 OR scans >= 5 OR units >= 30 AS is_large FROM b""")
def preflight_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What translating each source would take; every fourth page has no text."""
    p = paged(spark, sf_dir).withColumn("text", F.when(F.col("page_number") % 4 == 0, " ").otherwise(F.col("text"))).withColumn("bytes", F.lit(0).cast("long"))
    s = segmented(spark, sf_dir).join(p.where("trim(text) <> ''").select("doc_id", "doc"), "doc_id")
    return J.preflight(s, p, ["doc"])


DONE = "done AS (SELECT doc_id, segment_id, CASE WHEN (doc_id + seq) % 3 = 0 THEN 'done' ELSE ' ' END AS target FROM segments WHERE (doc_id + seq) % 2 = 0)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segmented(spark, sf_dir)
    n = F.col("doc_id") + F.col("seq")
    return s.where(n % 2 == 0).select("doc_id", "segment_id", F.when(n % 3 == 0, "done").otherwise(" ").alias("target"))


@query(f"WITH RECURSIVE {SEGMENTS}, {DONE} SELECT doc_id, segment_id FROM segments WHERE (doc_id, segment_id) NOT IN (SELECT (doc_id, segment_id) FROM done WHERE trim(target) <> '')")
def pending_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments without a translation."""
    return J.pending(segmented(spark, sf_dir), results(spark, sf_dir), ["doc_id", "segment_id"]).select("doc_id", "segment_id")


@query(f"WITH RECURSIVE {SEGMENTS}, {DONE} SELECT doc_id, segment_id FROM done WHERE trim(target) <> ''")
def completed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with a translation."""
    return J.completed(segmented(spark, sf_dir), results(spark, sf_dir), ["doc_id", "segment_id"]).select("doc_id", "segment_id")


@query("""WITH j AS (SELECT o_custkey AS doc_id, o_orderkey AS job_id, CAST(o_orderkey % 3 AS INTEGER) AS revision, o_orderdate AS created_at FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC, job_id DESC) AS n FROM j)
SELECT o.o_custkey AS doc_id, o.o_orderkey AS job_id FROM orders o JOIN l ON l.n = 1 AND l.doc_id = o.o_custkey AND l.job_id = o.o_orderkey AND l.revision = o.o_orderkey % 2""")
def current_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that belong to the latest job of their document and its revision."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    j = o.select(F.col("o_custkey").alias("doc_id"), key.alias("job_id"), (key % 3).cast("int").alias("revision"), F.col("o_orderdate").alias("created_at"))
    r = o.select(F.col("o_custkey").alias("doc_id"), key.alias("job_id"), (key % 2).cast("int").alias("revision"))
    return J.current_results(r, j).select("doc_id", "job_id")


@query(f"""WITH {PAGED}, x AS (SELECT doc, page_number, CASE WHEN page_number % 7 = 0 THEN '' ELSE text END AS text, CASE WHEN page_number % 2 = 1 THEN 'x' ELSE ' ' END AS target FROM pages_)
SELECT doc, CAST(sum(CASE WHEN trim(target) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS translated, CAST(sum(CASE WHEN trim(target) = '' AND trim(text) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS ready,
  CAST(sum(CASE WHEN trim(target) = '' AND trim(text) = '' THEN 1 ELSE 0 END) AS BIGINT) AS unavailable, min(CASE WHEN trim(target) = '' AND trim(text) <> '' THEN page_number END) AS next_page FROM x GROUP BY doc""")
def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source is translated."""
    p = paged(spark, sf_dir)
    n = F.col("page_number")
    return J.coverage(p.withColumns({"text": F.when(n % 7 == 0, "").otherwise(F.col("text")), "target": F.when(n % 2 == 1, "x").otherwise(" ")}), ["doc"])


ATTEMPTS = """att AS (SELECT user_id * 100 + (event_id // 1000) AS request_id, CAST(row_number() OVER (PARTITION BY user_id, event_id // 1000 ORDER BY event_id) - 1 AS INTEGER) AS attempt,
  CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 429 WHEN event_id % 3 = 1 THEN 503 ELSE 400 END ELSE 200 END AS status,
  CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN ' ' WHEN 'view' THEN '一二三四五六七八九十一二三四五六七八九十x' ELSE 'plain text ' || event_id || ' in English' END AS text FROM events)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    batch, i = F.floor(F.col("event_id") / 1000), F.col("event_id")
    text = F.when(F.col("event_type") == "click", " ").when(F.col("event_type") == "view", "一二三四五六七八九十一二三四五六七八九十x").when(F.col("event_type") != "error", F.concat(F.lit("plain text "), i.cast("string"), F.lit(" in English")))
    status = F.when(F.col("event_type") == "error", F.when(i % 3 == 0, 429).when(i % 3 == 1, 503).otherwise(400)).otherwise(200)
    return e.select((F.col("user_id") * 100 + batch).alias("request_id"), (F.row_number().over(Window.partitionBy("user_id", batch).orderBy("event_id")) - 1).alias("attempt"), status.alias("status"), text.alias("text"))


@query(f"""WITH {ATTEMPTS}, a AS (SELECT *, status < 400 AND trim(coalesce(text, '')) <> '' AND (attempt = 2 OR length(text) < 20 AND length(text) >= 3 OR length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text) >= 0.3) AS ok,
  status >= 400 AND status <> 429 AND status < 500 AND attempt = 0 AS halt FROM att WHERE attempt <= 2),
g AS (SELECT request_id, min(CASE WHEN ok THEN attempt END) AS attempt, bool_or(halt) AS stop FROM a GROUP BY request_id)
SELECT g.request_id, CASE WHEN NOT stop THEN g.attempt END AS attempt, CASE WHEN NOT stop THEN a.text END AS text, CASE WHEN NOT stop THEN CAST(round(0.2 + g.attempt * 0.1, 1) AS DOUBLE) END AS temperature FROM g LEFT JOIN a ON a.request_id = g.request_id AND a.attempt = g.attempt""")
def accepted_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which attempt of each request is taken."""
    return J.accepted_attempts(attempts(spark, sf_dir))


@query("""WITH e AS (SELECT user_id AS doc_id, CASE WHEN event_type = 'signup' THEN NULL ELSE event_id % 7 END AS segment_id, ts, event_id, event_type FROM events),
d AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN (ts, event_id) END) OVER (PARTITION BY doc_id) AS dr, max(CASE WHEN event_type = 'purchase' THEN (ts, event_id) END) OVER (PARTITION BY doc_id, segment_id) AS sr FROM e)
SELECT doc_id, segment_id, sum(CASE WHEN event_type = 'click' AND (dr IS NULL OR (ts, event_id) > dr) AND (sr IS NULL OR (ts, event_id) > sr) THEN 1 ELSE 0 END) % 2 = 1 AS approved FROM d WHERE segment_id IS NOT NULL GROUP BY doc_id, segment_id""")
def approval_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approvals after all toggles, edits and source changes."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "signup", "source_change").when(F.col("event_type") == "purchase", "edit").when(F.col("event_type") == "click", "toggle").otherwise("view")
    return J.approvals(e.select(F.col("user_id").alias("doc_id"), F.when(F.col("event_type") != "signup", F.col("event_id") % 7).alias("segment_id"), "ts", "event_id", action.alias("action")))


@query("""SELECT user_id, list_sort(list_filter(list_distinct(list_concat(a, [1, 2, 3])), lambda x: x NOT IN (2, 9))) AS approved_ids FROM (SELECT user_id, list(DISTINCT CAST(event_id % 12 AS INTEGER)) AS a FROM events GROUP BY user_id)""")
def approved_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored approvals of each user after 1, 2 and 3 were added and 2 and 9 removed."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set((F.col("event_id") % 12).cast("int")).alias("a"))
    return e.select("user_id", J.approved_sets(F.col("a"), F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(2), F.lit(9))).alias("approved_ids"))


@query("""SELECT doc_id, CASE WHEN lang = 'fr' THEN 'Translate legal texts.' ELSE 'Translate texts.' END AS system,
  CASE WHEN doc_id % 2 = 0 THEN 'Context from previous section: before' || chr(10) || chr(10) ELSE '' END || 'Use these exact translations for the following terms:' || chr(10) || '- "订单" → "Order"' || chr(10) || '- "元" → "USD"' || chr(10) || chr(10) || 'Translate this Chinese text into clean English:' || chr(10) || chr(10) || text AS user FROM documents""")
def request_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request made of every document."""
    d = documents(spark, sf_dir).select("doc_id", F.col("text").alias("source"), F.when(F.col("lang") == "fr", "legal").otherwise("general").alias("domain"), F.when(F.col("doc_id") % 2 == 0, " before ").alias("context"))
    domains = spark.createDataFrame([("general", "Translate texts."), ("legal", "Translate legal texts.")], "domain string, system string")
    return J.requests(d, domains, F.create_map(F.lit("订单"), F.lit("Order"), F.lit("元"), F.lit("USD"))).select("doc_id", "system", "user")


@query("""SELECT o_orderkey AS request_id, CASE o_orderkey % 9 WHEN 0 THEN 'Provide exactly one text segment or image task.' WHEN 1 THEN 'Segment id is invalid.' WHEN 2 THEN 'Segment page is invalid.' WHEN 3 THEN 'Segment text is empty.' WHEN 4 THEN 'A glossary entry is invalid.'
  WHEN 5 THEN 'Model is invalid.' WHEN 6 THEN 'Translation domain is invalid.' WHEN 7 THEN 'Temperature is invalid.' END AS error FROM orders""")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule each raw request breaks; requests are made as JSON of all orders."""
    k = F.col("o_orderkey") % 9
    chunk = F.when(k != 0, F.struct(
        F.when(k == 1, " ").otherwise(F.col("o_orderkey").cast("string")).alias("id"), F.when(k == 2, F.lit(0.5)).otherwise(F.lit(3.0)).alias("pageNumber"),
        F.when(k == 3, "\t").otherwise(F.col("o_orderpriority")).alias("originalChinese")))
    body = F.to_json(F.struct(
        chunk.alias("chunk"), F.create_map(F.lit("订单"), F.when(k == 4, " ").otherwise("Order")).alias("glossary"), F.when(k == 5, "bad model!").otherwise("vendor/model-1").alias("model"),
        F.when(k == 6, "cooking").otherwise("legal").alias("domain"), F.when(k == 7, 1.5).otherwise(0.2).alias("temperature")))
    raw = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), body.alias("body"))
    return J.validated(raw, ["general", "historical", "legal", "medical", "literary"]).select("request_id", "error")


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 OR p_brand IN ('Brand#12', 'Brand#23') THEN p_brand ELSE 'fallback' END AS model FROM part")
def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model each request log gets; some logs have no list."""
    p = table(spark, sf_dir, "part")
    asked = F.replace("p_brand", F.lit("#"), F.lit(":"))
    allowed = F.when(F.col("p_size") % 4 != 0, F.array(F.lit("Brand:12"), F.lit("Brand:23")))
    return p.select("p_partkey", F.replace(J.allowed_model(asked, allowed, F.lit("fallback")), F.lit(":"), F.lit("#")).alias("model"))
