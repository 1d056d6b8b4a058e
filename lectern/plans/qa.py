"""Queries over bilingual pairs that are made from every order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import facts
from lectern.operators import qa
from lectern.plans.base import query, table
from lectern.sources.shared import kept, shared_folder
from lectern.streaming import jobs

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
GLOSSARY = [("订单", "Order"), ("金额", "for USD"), ("元", "USD"), ("", "nothing"), ("日", " ")]

#: Orders that a task checks.
TASK_ROWS = 20_000


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_number, segment_id, source and target of every order, with defects by order number."""
    # a small file holds many orders, whose texts are costly to check: the rows are dealt out first, to as many tasks as they need
    o = table(spark, sf_dir, "orders")
    o = o.repartition(max(spark.sparkContext.defaultParallelism, -(-o.count() // TASK_ROWS)), "o_orderkey")
    price = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    y, m, d, key = F.year("o_orderdate").cast("string"), F.month("o_orderdate"), F.day("o_orderdate").cast("string"), F.col("o_orderkey").cast("string")
    source = F.concat(F.lit("订单"), key, F.lit("于"), y, F.lit("年"), m.cast("string"), F.lit("月"), d, F.lit("日金额"), price, F.lit("元"))
    month = F.element_at(F.array(*map(F.lit, MONTHS)), m)
    head = F.concat(F.lit("Order "), key, F.lit(" on "), month, F.lit(" "), d, F.lit(", "), y)
    good = F.concat(head, F.lit(" for USD "), price)
    k = F.col("o_orderkey") % 11
    target = (
        F.when(k == 1, head).when(k == 2, F.concat(F.lit("Order "), key, F.lit(" on 1/1/1900 for USD "), price)).when(k == 3, F.concat(good, F.lit(" 订单金额于年月日元")))
        .when(k == 4, F.lit(" ")).when(k == 5, F.repeat(F.concat(good, F.lit(". ")), 9)).when(k == 6, F.lower(good)).otherwise(good)
    )
    return o.select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("page_number"), F.col("o_orderkey").alias("segment_id"), source.alias("source"), target.alias("target"))


def glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GLOSSARY, "term string, gloss string")


PAIRS = """
o AS (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS price, CAST(year(o_orderdate) AS VARCHAR) AS y, month(o_orderdate) AS m, CAST(day(o_orderdate) AS VARCHAR) AS d, CAST(o_orderkey AS VARCHAR) AS k FROM orders),
h AS (SELECT *, 'Order ' || k || ' on ' || (['January','February','March','April','May','June','July','August','September','October','November','December'])[m] || ' ' || d || ', ' || y AS head FROM o),
g AS (SELECT *, head || ' for USD ' || price AS good FROM h),
pairs AS (SELECT o_custkey AS doc_id, CAST(o_orderkey % 5 + 1 AS INTEGER) AS page_number, o_orderkey AS segment_id,
  '订单' || k || '于' || y || '年' || CAST(m AS VARCHAR) || '月' || d || '日金额' || price || '元' AS source,
  CASE o_orderkey % 11 WHEN 1 THEN head WHEN 2 THEN 'Order ' || k || ' on 1/1/1900 for USD ' || price WHEN 3 THEN good || ' 订单金额于年月日元'
    WHEN 4 THEN ' ' WHEN 5 THEN repeat(good || '. ', 9) WHEN 6 THEN lower(good) ELSE good END AS target FROM g)
"""
# the pairs hold one date, one amount and one order number each, so the SQL builds the facts from the columns
FACTS = """
t AS (SELECT pairs.*, trim(target) AS tt, h.y, h.m, h.d, h.price, h.k FROM pairs JOIN h ON pairs.segment_id = h.o_orderkey),
raw AS (
  SELECT segment_id, 0 AS pos, 'date' AS kind, y || '年' || CAST(m AS VARCHAR) || '月' || d || '日' AS source, 'date:' || y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(d, 2, '0') AS normalized,
    regexp_matches(tt, '(?i)\\b(January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4}\\b') AS matched, tt FROM t
  UNION ALL SELECT segment_id, 1, 'currency', price || '元', 'currency:' || price, list_contains(list_transform(regexp_extract_all(tt, '[-+]?[0-9]+(?:[,.][0-9]+)*'), lambda x: replace(x, ',', '')), price), tt FROM t
  UNION ALL SELECT segment_id, 2, 'number', k, 'number:' || k, list_contains(list_transform(regexp_extract_all(tt, '[-+]?[0-9]+(?:[,.][0-9]+)*'), lambda x: replace(x, ',', '')), k), tt FROM t
    WHERE k NOT IN (y, CAST(m AS VARCHAR), d, price)
)
"""


@query(f"WITH {PAIRS}, {FACTS} SELECT segment_id, kind, source, normalized, matched FROM raw")
def fact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fact of every source, checked against its target."""
    found = facts.with_facts(pairs(spark, sf_dir), "source", "target")
    # explode_outer: explode would add a filter that computes the facts once more
    return found.select("segment_id", F.explode_outer("facts").alias("f")).where("f is not null").select("segment_id", "f.kind", "f.source", "f.normalized", "f.matched")


TERMS = """
gl(term, gloss) AS (VALUES ('订单', 'Order'), ('金额', 'for USD'), ('元', 'USD')),
terms AS (SELECT segment_id, term, gloss, contains(lower(trim(target)), lower(gloss)) AS matched FROM pairs JOIN gl ON contains(source, term))
"""


@query(f"WITH {PAIRS}, {TERMS} SELECT * FROM terms")
def glossary_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every glossary term in every source, by broadcast."""
    return qa.terms(pairs(spark, sf_dir), glossary(spark))


@query(f"WITH {PAIRS}, {TERMS} SELECT * FROM terms")
def glossary_check_by_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an equi-join on substrings, as for glossaries too large to broadcast."""
    return qa.terms_by_grams(pairs(spark, sf_dir), glossary(spark))


WARNED = """
counts AS (
  SELECT doc_id, page_number, segment_id, source, trim(target) AS target, CAST(length(source) AS INTEGER) AS source_chars, CAST(length(trim(target)) AS INTEGER) AS target_chars,
    CAST(length(regexp_replace(trim(target), '[^\\p{Han}]', '', 'g')) AS INTEGER) AS residual_han FROM pairs
), flags AS (
  SELECT c.*, coalesce(f.bad, false) AS bad_fact, coalesce(x.bad, false) AS bad_term FROM counts c
  LEFT JOIN (SELECT segment_id, bool_or(NOT matched) AS bad FROM raw GROUP BY segment_id) f USING (segment_id)
  LEFT JOIN (SELECT segment_id, bool_or(NOT matched) AS bad FROM terms GROUP BY segment_id) x USING (segment_id)
), codes AS (
  SELECT *, list_filter([
    CASE WHEN target = '' THEN 'empty' END, CASE WHEN bad_fact THEN 'numbers' END, CASE WHEN bad_term THEN 'glossary' END,
    CASE WHEN residual_han >= 4 AND residual_han / greatest(target_chars, 1) > 0.06 THEN 'source-leak' END,
    CASE WHEN target <> '' AND source_chars > 40 AND (target_chars / source_chars < 0.25 OR target_chars / source_chars > 6) THEN 'length' END
  ], lambda x: x IS NOT NULL) AS codes FROM flags
)
"""
BEFORE = f"WITH {PAIRS}, {FACTS}, {TERMS}, {WARNED}"
SEVERITY = "CASE WHEN code IN ('empty', 'numbers') THEN 'error' ELSE 'warning' END"


@query(f"{BEFORE} SELECT segment_id, source_chars, target_chars, residual_han, array_to_string(codes, ',') AS codes FROM codes")
def qa_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and warning codes of every segment."""
    r = qa.report(pairs(spark, sf_dir), glossary(spark))
    return r.select("segment_id", "source_chars", "target_chars", "residual_han", F.array_join("warnings.code", ",").alias("codes"))


@query(f"""{BEFORE} SELECT CAST(segment_id AS VARCHAR) || '-' || codes[i] || '-' || CAST(i - 1 AS VARCHAR) AS issue_id, doc_id, segment_id,
  CASE WHEN codes[i] IN ('empty', 'numbers') THEN 'error' ELSE 'warning' END AS severity, codes[i] AS code
  FROM (SELECT *, unnest(range(1, len(codes) + 1)) AS i FROM codes)""")
def qa_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per warning."""
    return qa.issues(qa.report(pairs(spark, sf_dir), glossary(spark))).drop("message")


@query(f"""{BEFORE} SELECT page_number, CAST(sum(len(list_filter(codes, lambda x: x IN ('empty', 'numbers')))) AS BIGINT) AS errors,
  CAST(sum(len(list_filter(codes, lambda x: x NOT IN ('empty', 'numbers')))) AS BIGINT) AS warnings,
  CAST(sum(CASE WHEN segment_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS approved, count(*) AS segments FROM codes GROUP BY page_number""")
def qa_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, warnings, approved and all segments by page number."""
    return qa.summary(qa.report(pairs(spark, sf_dir), glossary(spark)), ["page_number"], F.col("segment_id") % 3 == 0)


@query(f"{BEFORE} SELECT code, {SEVERITY} AS severity, count(*) AS n FROM (SELECT unnest(codes) AS code FROM codes) GROUP BY code")
def qa_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of all pairs by code and severity."""
    return qa.issues(qa.report(pairs(spark, sf_dir), glossary(spark))).groupBy("code", "severity").agg(F.count("*").alias("n"))


# the same SQL over what the edits leave
EDITED = BEFORE.replace("WHEN 1 THEN head", "WHEN 1 THEN good").replace("ELSE good END AS target FROM g)", "ELSE good END AS target FROM g WHERE o_orderkey % 13 <> 0)").replace("('元', 'USD'))", "('元', 'Yuan'), ('日金额', 'USD'))")


@query(f"{EDITED} SELECT segment_id, source_chars, target_chars, residual_han, array_to_string(codes, ',') AS codes FROM codes")
def qa_report_after_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report after three rounds of edits, each made from the stored report before it: targets, glossary, segments that go and come."""
    p, g = pairs(spark, sf_dir), glossary(spark)
    key = F.col("segment_id")
    first = p.where(key % 7 != 0)
    stored = kept(qa.report(first, g))
    # targets that lacked their amount are mended
    good = F.concat("target", F.lit(" for USD "), F.regexp_extract("source", "日金额(.*)元", 1))
    mended = lambda rows: rows.withColumn("target", F.when(key % 11 == 1, good).otherwise(F.col("target")))
    stored = kept(qa.refreshed(stored, mended(first), g, g))
    # a gloss changes and a term comes
    terms = spark.createDataFrame([(t, "Yuan" if t == "元" else x) for t, x in GLOSSARY] + [("日金额", "USD")], "term string, gloss string")
    stored = kept(qa.refreshed(stored, mended(first), g, terms))
    # segments go, and those left out so far come
    last = qa.refreshed(stored, mended(p).where(key % 13 != 0), terms, terms)
    return last.select("segment_id", "source_chars", "target_chars", "residual_han", F.array_join("warnings.code", ",").alias("codes"))


@query(f"{BEFORE} SELECT segment_id, source_chars, target_chars, residual_han, array_to_string(codes, ',') AS codes FROM codes")
def qa_report_of_a_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of pairs that come as a stream, each batch joined with the glossary's kept index."""
    folder = f"{shared_folder(spark).rstrip('/')}/quality-stream-{uuid.uuid4().hex}"
    p, g = pairs(spark, sf_dir), glossary(spark)
    p.repartition(4, "segment_id").write.parquet(f"{folder}/in")
    qa.term_index(g).write.parquet(f"{folder}/index")
    give = lambda report, batch: report.select("segment_id", "source_chars", "target_chars", "residual_han", F.array_join("warnings.code", ",").alias("codes")).write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    write = jobs.quality_writer(g, spark.read.parquet(f"{folder}/index"), give)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")
