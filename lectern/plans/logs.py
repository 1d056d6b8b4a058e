"""Queries on service logs, quotas and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import logs as G
from lectern.plans.base import query, table

EV = "ev AS (SELECT user_id * 100 + event_id // 200 AS request_id, event_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'start' ELSE 'delta' END AS event FROM events)"


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of some events each, their data as JSON."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "start").otherwise("delta")
    text = F.concat(F.lit("t"), F.col("event_id").cast("string"), F.lit(" "))
    data = F.to_json(F.struct(F.when((kind == "delta") | ((kind == "done") & (F.col("event_id") % 2 == 0)), text).alias("text"), F.when(kind == "error", F.lit("failed")).alias("message")))
    return e.select((F.col("user_id") * 100 + F.floor(F.col("event_id") / 200)).alias("request_id"), F.col("event_id").alias("seq"), kind.alias("event"), data.alias("data"), "ts")


@query(f"""WITH {EV}, fin AS (SELECT request_id, min(event_id) AS at, arg_min(event, event_id) AS event FROM ev WHERE event IN ('done', 'error') GROUP BY request_id),
d AS (SELECT ev.request_id, string_agg('t' || event_id || ' ', '' ORDER BY event_id) AS t FROM ev LEFT JOIN fin ON ev.request_id = fin.request_id WHERE ev.event = 'delta' AND (fin.at IS NULL OR ev.event_id < fin.at) GROUP BY ev.request_id)
SELECT r.request_id, coalesce(fin.event, 'open') AS status, CASE WHEN fin.event = 'error' THEN NULL WHEN fin.event = 'done' AND fin.at % 2 = 0 THEN 't' || fin.at || ' ' ELSE coalesce(d.t, '') END AS text, CASE WHEN fin.event = 'error' THEN 'failed' END AS message
FROM (SELECT DISTINCT request_id FROM ev) r LEFT JOIN fin ON r.request_id = fin.request_id LEFT JOIN d ON r.request_id = d.request_id""")
def reassembled_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and end of every request."""
    return G.reassembled(stream_events(spark, sf_dir))


def sse_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of three frames for every event; one has no name, one is no object."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id").cast("string")
    body = F.concat(F.lit("event: "), "event_type", F.lit('\r\ndata: {"a":\r\ndata: '), i, F.lit("}\n\ndata: [1]\n\ndata: {}\n\nevent: broken\ndata: {x"))
    return e.select("event_id", body.alias("body"))


@query("""SELECT event_id, 0 AS seq, event_type AS event, '{"a":' || event_id || '}' AS data FROM events UNION ALL SELECT event_id, 2, 'message', '{}' FROM events""")
def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of every log."""
    return G.frames(sse_logs(spark, sf_dir), ["event_id"])


@query("SELECT event_id, 0 AS seq, 'a' || event_id AS text FROM events UNION ALL SELECT event_id, 2, 'bc' FROM events")
def delta_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text pieces of every provider stream."""
    e = table(spark, sf_dir, "events")
    body = F.concat(F.lit('data: {"choices":[{"delta":{"content":"a'), F.col("event_id").cast("string"), F.lit('"}}]}\n\ndata: {broken\ndata: {"choices":[{"delta":{"content":[{"text":"b"},{"text":"c"}]}}]}\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"late"}}]}'))
    return G.delta_texts(e.select("event_id", body.alias("body")), ["event_id"])


@query("""SELECT class, count(*) AS n FROM (SELECT CASE WHEN event_id % 7 IN (0, 1) OR event_id % 11 = 0 THEN 'key' WHEN event_id % 7 = 2 THEN 'rate' WHEN event_id % 7 = 3 OR event_id % 5 = 0 THEN 'payment' ELSE 'other' END AS class FROM events) GROUP BY class""")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by kind."""
    i = F.col("event_id")
    status = F.when(i % 7 == 0, 401).when(i % 7 == 1, 403).when(i % 7 == 2, 429).when(i % 7 == 3, 402).otherwise(500)
    message = F.when(i % 11 == 0, "Invalid API Key").when(i % 5 == 0, "low Credit").otherwise("down")
    return table(spark, sf_dir, "events").groupBy(G.error_class(status, message).alias("class")).agg(F.count("*").alias("n"))


@query("""SELECT class, count(*) AS n FROM (SELECT CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 'password' WHEN event_id % 7 = 1 OR event_id % 5 IN (0, 1) THEN 'damaged' WHEN event_id % 5 IN (2, 3) THEN 'reader' WHEN event_id % 3 = 0 THEN 'pages' ELSE 'unknown' END AS class FROM events) GROUP BY class""")
def pdf_error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of reading PDFs by kind: name first, then what the message holds."""
    i = F.col("event_id")
    name = F.when(i % 7 == 0, "PasswordException").when(i % 7 == 1, "InvalidPDFException")
    by_five = F.when(i % 5 == 0, "Invalid PDF structure").when(i % 5 == 1, "no PDF header").when(i % 5 == 2, "fake Worker").when(i % 5 == 3, "dynamically imported module")
    message = F.when(i % 11 == 0, "needs a Password").otherwise(F.coalesce(by_five, F.when(i % 3 == 0, "All pages failed")))
    return table(spark, sf_dir, "events").groupBy(G.pdf_error_class(name, message).alias("class")).agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS client_key, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT client_key, event_id, k, CAST(1 AS BIGINT) AS c, us + 864000000000 AS reset_, true AS allowed, us FROM e WHERE k = 1
  UNION ALL SELECT e.client_key, e.event_id, e.k, CASE WHEN f.reset_ <= e.us THEN 1 WHEN f.c < 5 THEN f.c + 1 ELSE f.c END, CASE WHEN f.reset_ <= e.us THEN e.us + 864000000000 ELSE f.reset_ END, f.reset_ <= e.us OR f.c < 5, e.us FROM f JOIN e ON e.client_key = f.client_key AND e.k = f.k + 1)
SELECT client_key, event_id, allowed, CAST(CASE WHEN allowed THEN 0 ELSE greatest(1, ceil((reset_ - us) / 1000000)) END AS BIGINT) AS retry_after FROM f""")
def quota_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events of each user a quota of 5 in 10 days lets through."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("client_key"), "event_id", "ts")
    return G.quota(e, 5, 864_000)


@query("""WITH RECURSIVE e AS (SELECT event_type AS client_key, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT client_key, k, k AS first, us AS begin, us FROM e WHERE k = 1
  UNION ALL SELECT e.client_key, e.k, CASE WHEN f.begin + 60000000000 <= e.us THEN e.k ELSE f.first END, CASE WHEN f.begin + 60000000000 <= e.us THEN e.us ELSE f.begin END, e.us FROM f JOIN e ON e.client_key = f.client_key AND e.k = f.k + 1)
SELECT client_key, event_id, f.k - first < 12 AS allowed, CAST(CASE WHEN f.k - first < 12 THEN 0 ELSE greatest(1, ceil((begin + 60000000000 - f.us) / 1000000)) END AS BIGINT) AS retry_after FROM f JOIN e USING (client_key, k)""")
def quota_by_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events of each kind, all users' together, a quota of 12 in 60 000 seconds lets through: few clients with very many events each."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("client_key"), "event_id", "ts")
    return G.quota_of_any(e, 12, 60_000)


CATALOG = """cat AS (SELECT lower(replace(p_brand, '#', '/')) || '-' || (p_partkey % 300) || CASE WHEN p_size % 3 = 0 THEN ':free' ELSE '' END AS id, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS name, p_size % 3 = 0 AS free, p_size * 1000 AS context_length,
  CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS DOUBLE) * 1000000 END AS prompt_price, p_partkey AS pos FROM part WHERE p_size % 7 <> 0),
mod AS (SELECT id, CASE WHEN arg_max(name, pos) = '' THEN id ELSE arg_max(name, pos) END AS name, any_value(free) AS free, CAST(arg_max(context_length, pos) AS BIGINT) AS context_length, arg_max(struct_pack(p := prompt_price), pos).p AS prompt_price FROM cat GROUP BY id)"""


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    ident = F.concat(F.lit(" "), F.lower(F.replace("p_brand", F.lit("#"), F.lit("/"))), F.lit("-"), (F.col("p_partkey") % 300).cast("string"), F.when(size % 3 == 0, ":free").otherwise(""))
    text = F.when(size % 7 == 0, F.array(F.lit("image"))).otherwise(F.array(F.lit("image"), F.lit("text")))
    entry = F.struct(
        ident.alias("id"), F.when(size % 5 == 0, " ").otherwise(F.col("p_name")).alias("name"), F.struct(text.alias("input_modalities"), F.array(F.lit("text")).alias("output_modalities")).alias("architecture"),
        F.struct(F.when(size % 4 == 0, "n/a").otherwise(size.cast("string")).alias("prompt"), F.lit("-1").alias("completion")).alias("pricing"), (size * 1000).alias("context_length"))
    return p.select(F.col("p_partkey").alias("pos"), F.to_json(entry).alias("payload"))


@query(f"WITH {CATALOG} SELECT id, name, free, context_length, prompt_price, CAST(NULL AS DOUBLE) AS completion_price FROM mod")
def model_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable models of a catalog made of parts."""
    return G.catalog(catalog_rows(spark, sf_dir))


@query(f"WITH {CATALOG} SELECT id, name, CASE WHEN free AND id LIKE 'brand/12%' THEN 1 WHEN free AND id LIKE 'brand/%' THEN 2 WHEN free THEN 3 ELSE 4 END AS rank FROM mod UNION ALL SELECT 'auto/free', 'Automatic', 0")
def listed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as it is shown, the automatic choice first."""
    models = G.catalog(catalog_rows(spark, sf_dir)).withColumn("id", F.regexp_replace("id", "^brand/12", "brand/12/"))
    return G.listed(models, ("auto/free", "Automatic"), ["brand/12", "brand"]).withColumn("id", F.regexp_replace("id", "^brand/12/", "brand/12"))
