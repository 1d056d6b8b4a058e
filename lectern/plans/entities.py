"""Queries on entities and glossaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import entities as E
from lectern.operators import memory as M
from lectern.operators import outcomes
from lectern.operators import search as S
from lectern.plans.base import query, table
from lectern.plans.qa import PAIRS, pairs
from lectern.plans.text import documents
from lectern.sources.shared import shared_folder

NAMES = [("person", "王", 0), ("person", "李", 1), ("organization", "公司", 0), ("organization", "銀行", 1), ("place", "市", 0), ("title", "先生", 0)]
#: Word kinds by part size, for entities made of part names.
TYPES = ("person", "Location", "some organization", "job title", "a term", "what")


def han_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of Chinese for every order, with a name, a body, a place and a title."""
    tail = F.when(F.col("segment_id") % 2 == 0, "\n王小明，李四。北京市、大華銀行\nhttp://x 王五").otherwise("\n李大先生 新北京市\n王生、天地公司分部")
    return pairs(spark, sf_dir).select(F.col("segment_id").alias("doc_id"), F.concat("source", tail).alias("text"))


@query(f"""WITH {PAIRS}, v AS (
  SELECT segment_id AS doc_id, unnest(['王小明', '李四', '北京市', '大華銀行']) AS surface, unnest(['person', 'person', 'place', 'organization']) AS type FROM pairs WHERE segment_id % 2 = 0
  UNION ALL SELECT segment_id, unnest(['李大先生', '新北京市', '天地公司分部']), unnest(['person', 'place', 'organization']) FROM pairs WHERE segment_id % 2 = 1) SELECT * FROM v""")
def chinese_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of every page by small dictionaries."""
    names = spark.createDataFrame(NAMES, "kind string, word string, n int")
    return E.extract(han_pages(spark, sf_dir), "doc_id", names)


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kinds = F.array(*map(F.lit, E.KINDS))
    return p.select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("surface"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")).alias("gloss"), F.get(kinds, F.col("p_size") % 6).alias("type"))


@query("""WITH g AS (SELECT p_brand AS term, p_type AS gloss, p_partkey AS pos, p_size % 5 = 0 AS locked FROM part), l AS (SELECT term, arg_max(gloss, pos) AS gloss FROM g WHERE locked AND trim(gloss) <> '' GROUP BY term)
SELECT term, gloss FROM l""")
def locked_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The locked map, a row for each term."""
    p = table(spark, sf_dir, "part")
    g = p.select(F.col("p_brand").alias("term"), F.col("p_type").alias("gloss"), F.col("p_partkey").alias("pos"), (F.col("p_size") % 5 == 0).alias("locked"))
    return E.locked(g)


@query("""WITH l AS (SELECT p_partkey - 1 AS pos, p_brand || '-' || (p_partkey % 90) AS term, p_name AS gloss FROM part)
SELECT term, arg_max(gloss, pos) AS gloss, true AS locked, true AS confirmed FROM l WHERE pos BETWEEN 1 AND 500 GROUP BY term""")
def imported_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary from lines of CSV: the first 500 after the header, of a term the last."""
    p = table(spark, sf_dir, "part")
    line = F.concat_ws(",", F.concat(F.lit(' "'), "p_brand", F.lit("-"), (F.col("p_partkey") % 90).cast("string"), F.lit('"')), F.concat("p_name", F.lit(" ")), F.when(F.col("p_size") % 4 == 0, "FALSE").otherwise("yes"))
    return E.imported(p.select((F.col("p_partkey") - 1).alias("pos"), line.alias("line")))


@query("""WITH l AS (SELECT p_partkey, p_brand || '-' || (p_partkey % 90) AS term, p_name AS gloss, p_size % 4 <> 0 AS locked FROM part WHERE p_size % 7 <> 0)
SELECT p_partkey AS id, term, gloss, locked, true AS confirmed FROM l""")
def imported_json_glossaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary of one entry from a JSON file of every part; some do not parse, and entries without a term are dropped."""
    p = table(spark, sf_dir, "part")
    term = F.concat(F.lit(" "), "p_brand", F.lit("-"), (F.col("p_partkey") % 90).cast("string"))
    own = F.when(F.col("p_size") % 4 == 0, F.struct(term.alias("chinese"), F.col("p_name").alias("english"), F.lit(False).alias("locked"))).otherwise(F.struct(term.alias("chinese"), F.concat("p_name", F.lit(" ")).alias("english"), F.lit(None).cast("boolean").alias("locked")))
    body = F.to_json(F.array(own, F.struct(F.lit(" ").alias("chinese"), F.lit("x").alias("english"), F.lit(True).alias("locked"))))
    return E.imported_json(p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 7 == 0, "[{").otherwise(body).alias("content")), ["id"])


@query("""SELECT p_partkey AS id, p_name AS surface, CASE WHEN p_size % 2 = 0 THEN p_brand END AS gloss, (['person','place','organization','title','term','other'])[p_size % 6 + 1] AS type FROM part WHERE p_size % 5 <> 0""")
def entity_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities in a service's answers, made of parts; some do not parse."""
    p = table(spark, sf_dir, "part")
    kind = F.get(F.array(*map(F.lit, TYPES)), F.col("p_size") % 6)
    body = F.to_json(F.array(F.struct(F.concat(F.lit(" "), "p_name").alias("chinese"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(" ").alias("english"), kind.alias("type")), F.struct(F.lit("x").alias("chinese"), F.lit("y").alias("english"), F.lit("term").alias("type"))))
    fenced = F.when(F.col("p_size") % 5 == 0, "no json").otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    return E.from_response(p.select(F.col("p_partkey").alias("id"), fenced.alias("body")), ["id"])


@query("""WITH e AS (SELECT o_custkey AS doc_id, o_orderstatus AS type, CAST(o_orderkey AS VARCHAR) AS surface FROM orders)
SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.doc_id = e.doc_id AND b.type = e.type AND contains(b.surface, e.surface) AND length(b.surface) > length(e.surface))""")
def entities_without_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers of a customer that no longer one holds."""
    o = table(spark, sf_dir, "orders")
    return E.without_parts(o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("type"), F.col("o_orderkey").cast("string").alias("surface")), "doc_id")


@query("SELECT p_brand AS id, arg_max(p_name, p_partkey) AS name, max(p_partkey) AS pos FROM part GROUP BY p_brand")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each brand the last part."""
    return M.last_wins(table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("pos")), ["id"], "pos")


@query("""WITH s AS (SELECT source AS doc, doc_id AS page_number, CAST((length(text) - length(replace(lower(text), 'the', ''))) / 3 AS INTEGER) AS n, 'source' AS side, 0 AS side_rank FROM documents
  UNION ALL SELECT source, doc_id, CAST((length(lang || ' the ' || source) - length(replace(lang || ' the ' || source, 'the', ''))) / 3 AS INTEGER), 'translation', 1 FROM documents)
SELECT doc, page_number, side, side_rank, CAST(unnest(range(0, n)) AS INTEGER) AS occurrence FROM s WHERE n > 0""")
def search_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a word in texts and in a made-up translation."""
    d = documents(spark, sf_dir)
    pages = d.select(F.col("source").alias("doc"), F.col("doc_id").alias("page_number"), F.col("text").alias("source"), F.concat("lang", F.lit(" the "), "source").alias("target"))
    return S.matches(pages, ["doc"], " The ")


SOUGHT = ["the", "and the", "ing t", "aaaa", "because of", "zzzyx", "tion", "e the", "of the the", "that"]


@query(f"""WITH q AS (SELECT unnest({SOUGHT}) AS query), x AS (SELECT source AS doc, doc_id AS page_number, 'source' AS side, 0 AS side_rank, lower(coalesce(text, '')) AS t FROM documents UNION ALL SELECT source, doc_id, 'translation', 1, lower(lang || ' the ' || source) FROM documents)
SELECT query, doc, page_number, side, side_rank, unnest(range(0, (length(t) - length(replace(t, query, ''))) // length(query))) AS occurrence FROM x, q WHERE contains(t, query)""")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of ten queries, found by a written index of trigrams and their places in blocks of pages."""
    d = documents(spark, sf_dir)
    pages = d.select(F.col("source").alias("doc"), F.col("doc_id").alias("page_number"), F.col("text").alias("source"), F.concat("lang", F.lit(" the "), "source").alias("target"))
    folder = f"{shared_folder(spark).rstrip('/')}/search-index-{uuid.uuid4().hex}"
    S.write_blocks(pages, ["doc"], folder)
    return S.block_matches(spark, folder, SOUGHT).withColumn("occurrence", F.col("occurrence").cast("long"))


@query("SELECT doc_id, regexp_replace(text, '(?i)the', '<mark>\\0</mark>', 'g') AS text FROM documents")
def search_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a word marked."""
    return documents(spark, sf_dir).select("doc_id", S.highlight("text", " the ").alias("text"))


KINDS_OF = "(['person','organization','place','title','term','other'])[p_size % 6 + 1]"
#: All parts on both sides; the new ones are named by twice their number, so that only some meet.
ALL_KNOWN = f"kn AS (SELECT 'part ' || p_partkey AS surface, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS gloss, {KINDS_OF} AS type FROM part)"
ALL_FRESH = "fr AS (SELECT 'part ' || (p_partkey * 2) AS surface, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END AS gloss, 'term' AS type FROM part)"


def all_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("part "), (F.col("p_partkey") * 2).cast("string")).alias("surface"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand")).alias("gloss"), F.lit("term").alias("type"))


@query(f"WITH {ALL_KNOWN} SELECT surface, type FROM kn")
def all_ordered_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of all parts as they are shown."""
    return E.in_order(part_entities(spark, sf_dir)).select("surface", "type")


@query(f"WITH {ALL_KNOWN}, {ALL_FRESH} SELECT coalesce(kn.surface, fr.surface) AS surface, coalesce(nullif(fr.gloss, ''), kn.gloss) AS gloss, coalesce(kn.type, fr.type) AS type FROM kn FULL JOIN fr ON kn.surface = fr.surface")
def all_merged_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known entities of all parts with a service's new glosses."""
    return E.merge_glosses(part_entities(spark, sf_dir), all_fresh(spark, sf_dir))


@query(f"WITH gl AS (SELECT 'part ' || p_partkey AS term, p_type AS gloss, p_size % 5 = 0 AS locked, p_size % 7 = 0 AS confirmed FROM part), {ALL_FRESH} SELECT coalesce(gl.term, fr.surface) AS term, CASE WHEN coalesce(locked OR confirmed, false) THEN gl.gloss ELSE coalesce(nullif(fr.gloss, ''), gl.gloss, '') END AS gloss, coalesce(locked, false) AS locked, coalesce(confirmed, false) AS confirmed FROM gl FULL JOIN fr ON gl.term = fr.surface")
def all_merged_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary of all parts with the entities' glosses where nobody fixed one."""
    p = table(spark, sf_dir, "part")
    g = p.select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("term"), F.col("p_type").alias("gloss"), (F.col("p_size") % 5 == 0).alias("locked"), (F.col("p_size") % 7 == 0).alias("confirmed"))
    return E.merge_glossary(g, all_fresh(spark, sf_dir))


@query("""WITH g AS (SELECT p_brand AS brand, p_size AS size, p_name AS term, max(p_partkey) AS pos FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY brand, size ORDER BY term) AS k FROM g)
SELECT brand, size, term, 'part ' || pos AS gloss, pos % 3 <> 0 AS locked, true AS confirmed FROM r WHERE k <= 500""")
def glossary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary of each brand and size, exported and imported again; imports take the first 500 entries."""
    g = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_name").alias("term")).agg(F.max("p_partkey").alias("pos"))
    own = g.select("brand", "size", "term", F.concat(F.lit("part "), F.col("pos").cast("string")).alias("gloss"), (F.col("pos") % 3 != 0).alias("locked"), F.lit(False).alias("confirmed"))
    return E.imported_json(outcomes.glossary_files(own, ["brand", "size"]), ["brand", "size"])
