"""Queries on page structure: margins, tables, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import lines_of
from lectern.operators import layout as L
from lectern.plans.base import query
from lectern.plans.qa import PAIRS, pairs
from lectern.plans.text import PAGED, documents, paged

MARGINS = rf"""ln AS (SELECT doc, page_number, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM pages_),
cand AS (SELECT DISTINCT doc, page_number, unnest(list_concat(l[1:2], l[-2:])) AS line FROM ln),
cnt AS (SELECT doc, line, count(DISTINCT page_number) AS k FROM cand WHERE length(line) BETWEEN 2 AND 160 GROUP BY doc, line),
tot AS (SELECT doc, count(*) AS n FROM pages_ GROUP BY doc),
often AS (SELECT doc, line FROM cnt JOIN tot USING (doc) WHERE n >= 3 AND k >= greatest(3, ceil(n * CAST(0.02 AS DECIMAL(6,4))))),
marg AS (SELECT cand.doc, page_number, cand.line FROM cand JOIN often ON cand.doc = often.doc AND cand.line = often.line)"""


@query(f"WITH {PAGED}, {MARGINS} SELECT doc, page_number, line FROM marg")
def repeated_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge lines that repeat on the pages of a source, on at least 2 % of them and 3."""
    return L.margin_lines(paged(spark, sf_dir), "doc", share=0.02)


@query(rf"""WITH {PAGED}, {MARGINS}, dr AS (SELECT doc, page_number, list(line) AS drop_ FROM marg GROUP BY doc, page_number),
k AS (SELECT p.doc, p.page_number, p.doc IN (SELECT doc FROM marg) AS touched, text,
  array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(dr.drop_, []), regexp_replace(x, '^\s+|\s+$', '', 'g'))), chr(10)) AS kept FROM pages_ p LEFT JOIN dr ON p.doc = dr.doc AND p.page_number = dr.page_number)
SELECT doc, page_number, CASE WHEN touched THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(kept, chr(160), ' '), chr(13) || chr(10), chr(10)), '[ \t]+\n', chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') ELSE text END AS text FROM k""")
def pages_without_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with those lines taken out."""
    return L.without_margins(paged(spark, sf_dir).select("doc", "page_number", "text"), "doc", share=0.02).select("doc", "page_number", "text")


TABLES = """tb AS (SELECT segment_id, CASE segment_id % 5
  WHEN 0 THEN '| Order | Amount |' || chr(10) || '|---|:---:|' || chr(10) || '| ' || segment_id || ' | 12 | 13 |' || chr(10) || '| short |'
  WHEN 1 THEN 'Order;Page' || chr(10) || segment_id || ';' || page_number WHEN 2 THEN '1,2' || chr(10) || segment_id || ', 4'
  WHEN 3 THEN 'Orders: ' || segment_id || chr(10) || 'Pages: ' || page_number ELSE target END AS text FROM pairs)"""


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small block of each shape for every order."""
    p = pairs(spark, sf_dir)
    k, s, n = F.col("segment_id") % 5, F.col("segment_id").cast("string"), F.col("page_number").cast("string")
    marked = F.concat(F.lit("| Order | Amount |\n|---|:---:|\n| "), s, F.lit(" | 12 | 13 |\n| short |"))
    text = (
        F.when(k == 0, marked).when(k == 1, F.concat(F.lit("Order;Page\n"), s, F.lit(";"), n)).when(k == 2, F.concat(F.lit("1,2\n"), s, F.lit(", 4")))
        .when(k == 3, F.concat(F.lit("Orders: "), s, F.lit("\nPages: "), n)).otherwise(F.col("target"))
    )
    return p.select("segment_id", text.alias("text"))


@query(f"""WITH {PAIRS}, {TABLES} SELECT segment_id, CASE WHEN segment_id % 5 < 3 THEN 'table' WHEN segment_id % 5 = 3 THEN 'preformatted' ELSE 'paragraph' END AS type, CASE WHEN segment_id % 5 = 3 THEN 'chart' END AS kind,
  CASE segment_id % 5 WHEN 0 THEN 'Order|Amount' WHEN 1 THEN 'Order|Page' WHEN 2 THEN 'Column 1|Column 2' END AS headers, CASE WHEN segment_id % 5 >= 3 THEN trim(text) END AS text FROM tb WHERE trim(text) <> ''""")
def structured_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, headers and text of each block."""
    b = L.blocks(tables(spark, sf_dir))
    return b.select("segment_id", "block.type", "block.kind", F.array_join("block.headers", "|").alias("headers"), "block.text")


@query(f"""WITH {PAIRS}, {TABLES}, c AS (
  SELECT segment_id, 0 AS row_no, 0 AS column_no, 'Order' AS header, CAST(segment_id AS VARCHAR) AS value FROM tb WHERE segment_id % 5 = 0 UNION ALL SELECT segment_id, 0, 1, 'Amount', '12' FROM tb WHERE segment_id % 5 = 0
  UNION ALL SELECT segment_id, 1, 0, 'Order', 'short' FROM tb WHERE segment_id % 5 = 0 UNION ALL SELECT segment_id, 1, 1, 'Amount', '' FROM tb WHERE segment_id % 5 = 0
  UNION ALL SELECT segment_id, 0, 0, 'Order', CAST(segment_id AS VARCHAR) FROM tb WHERE segment_id % 5 = 1 UNION ALL SELECT segment_id, 0, 1, 'Page', CAST(page_number AS VARCHAR) FROM pairs WHERE segment_id % 5 = 1
  UNION ALL SELECT segment_id, 0, 0, 'Column 1', '1' FROM tb WHERE segment_id % 5 = 2 UNION ALL SELECT segment_id, 0, 1, 'Column 2', '2' FROM tb WHERE segment_id % 5 = 2
  UNION ALL SELECT segment_id, 1, 0, 'Column 1', CAST(segment_id AS VARCHAR) FROM tb WHERE segment_id % 5 = 2 UNION ALL SELECT segment_id, 1, 1, 'Column 2', '4' FROM tb WHERE segment_id % 5 = 2)
SELECT * FROM c""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' cells in long form."""
    return L.table_cells(L.blocks(tables(spark, sf_dir)), ["segment_id"])


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with notes after a heading, as last paragraphs, or none."""
    p = pairs(spark, sf_dir)
    k, s, t = F.col("segment_id") % 3, F.col("segment_id").cast("string"), F.trim("target")
    text = F.when(k == 0, F.concat(t, F.lit("\n\nFootnotes:\nx\n\nFootnotes \n[1] first "), s, F.lit("\ngoes on\n2. second"))).when(k == 1, F.concat(t, F.lit("\n\nmore\n\n(1) first "), s, F.lit("\n\n* second\n\ngoes on"))).otherwise(F.concat(t, F.lit("\n\n1. only one")))
    return p.select("segment_id", text.alias("text"))


NOTED = "nt AS (SELECT segment_id, trim(target) AS t FROM pairs)"


@query(f"""WITH {PAIRS}, {NOTED}, n AS (SELECT segment_id, 1 AS note_no, CASE segment_id % 3 WHEN 0 THEN '[1]' ELSE '(1)' END AS marker, 'first ' || segment_id || CASE segment_id % 3 WHEN 0 THEN ' goes on' ELSE '' END AS content FROM nt WHERE segment_id % 3 < 2
  UNION ALL SELECT segment_id, 2, CASE segment_id % 3 WHEN 0 THEN '2.' ELSE '*' END, 'second' || CASE segment_id % 3 WHEN 1 THEN ' goes on' ELSE '' END FROM nt WHERE segment_id % 3 < 2) SELECT segment_id, CAST(note_no AS BIGINT) AS note_no, marker, content FROM n""")
def english_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of every target."""
    return L.split_notes(noted(spark, sf_dir), "segment_id").select("segment_id", F.explode_outer("notes").alias("n")).where("n is not null").select("segment_id", "n.*")


@query(f"""WITH {PAIRS}, {NOTED} SELECT segment_id, regexp_replace(t || CASE segment_id % 3 WHEN 0 THEN chr(10) || chr(10) || 'Footnotes:' || chr(10) || 'x' || chr(10) || chr(10) || 'Footnotes' || chr(10) || '[1] first ' || segment_id || ' goes on' || chr(10) || '2. second'
  WHEN 1 THEN chr(10) || chr(10) || 'more' || chr(10) || chr(10) || 'Footnotes' || chr(10) || '(1) first ' || segment_id || chr(10) || '* second goes on' ELSE chr(10) || chr(10) || '1. only one' END, '^\\n+', '') AS text FROM nt""")
def normal_note_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with their notes put under one heading."""
    return L.normal_note_text(L.split_notes(noted(spark, sf_dir), "segment_id"), "segment_id")


@query(f"""WITH {PAIRS} SELECT segment_id, CASE segment_id % 3 WHEN 0 THEN source || chr(10) || '正文' WHEN 1 THEN source || chr(10) || '正文' ELSE source || chr(10) || '①一' END AS body,
  CASE segment_id % 3 WHEN 0 THEN '①:甲乙;注2:丙' WHEN 1 THEN '1.:甲;(二):乙丙' ELSE '' END AS notes FROM pairs""")
def chinese_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body and notes of sources that had notes added."""
    p = pairs(spark, sf_dir)
    k = F.col("segment_id") % 3
    tail = F.when(k == 0, "\n正文\n註釋：\n①甲\n乙\n注2 丙").when(k == 1, "\n正文\n1.甲\n(二) 乙\n丙").otherwise("\n①一")
    split = L.split_cn_notes(p.select("segment_id", F.concat("source", tail).alias("text")), "segment_id")
    notes = F.array_join(F.transform("notes", lambda n: F.concat(n["marker"], F.lit(":"), n["content"])), ";")
    return split.select("segment_id", F.array_join("body", "\n\n").alias("body"), notes.alias("notes"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) >= 2 AND len(list_filter(l, lambda x: contains(x, '|'))) = len(l) AND len(list_distinct(list_transform(l, lambda x: len(string_split(x, '|'))))) = 1 THEN 'piped' ELSE 'other' END AS kind FROM l""")
def piped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents whose lines all have as many cells between bars."""
    t = L.delimited(lines_of("text"), "|", r"\|")
    return documents(spark, sf_dir).select("doc_id", F.when(t.isNotNull(), "piped").otherwise("other").alias("kind"))
