"""Queries on text rules, segments and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.text import units
from lectern.operators import segments as S
from lectern.plans.base import query, table
from lectern.plans.qa import PAIRS, pairs

TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
NORMAL = r"regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g')"
#: Paragraphs, sentences and greedy packing, as recursive SQL.
SEGMENTS = rf"""
norm AS (SELECT doc_id, {NORMAL} AS t FROM documents),
split AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\n\s*\n'), lambda x: {TRIM.format('x')}), lambda x: x <> '') AS a, list_filter(list_transform(string_split(t, chr(10)), lambda x: {TRIM.format('x')}), lambda x: x <> '') AS b FROM norm),
para AS (SELECT doc_id, unnest(CASE WHEN len(a) > 1 THEN a ELSE b END) AS p, unnest(range(1, len(CASE WHEN len(a) > 1 THEN a ELSE b END) + 1)) AS pi FROM split),
sent AS (
  SELECT doc_id, pi, unnest(s) AS s, unnest(range(1, len(s) + 1)) AS si FROM (
    SELECT doc_id, pi, list_filter(list_transform(string_split(regexp_replace(p, '([。！？!?；;])\s*', '\1' || chr(1), 'g'), chr(1)), lambda x: {TRIM.format('x')}), lambda x: x <> '') AS s FROM para WHERE length(p) > 1200)
), piece AS (
  SELECT doc_id, pi, si, 0 AS hi, s, false AS hard FROM sent WHERE length(s) <= 1200
  UNION ALL SELECT doc_id, pi, si, unnest(range(0, CAST(floor((length(s) - 1) / 1200) AS BIGINT) + 1)) AS hi, s, true FROM sent WHERE length(s) > 1200
), cut AS (SELECT doc_id, pi, row_number() OVER (PARTITION BY doc_id, pi ORDER BY si, hi) AS k, CASE WHEN hard THEN substr(s, CAST(hi * 1200 + 1 AS BIGINT), 1200) ELSE s END AS s, hard FROM piece),
join1 AS (
  SELECT doc_id, pi, k, s AS buf, hard, 1 AS n FROM cut WHERE k = 1
  UNION ALL
  SELECT c.doc_id, c.pi, c.k, CASE WHEN NOT j.hard AND NOT c.hard AND length(j.buf) + length(c.s) <= 1200 THEN j.buf || c.s ELSE c.s END, c.hard,
    CASE WHEN NOT j.hard AND NOT c.hard AND length(j.buf) + length(c.s) <= 1200 THEN j.n ELSE j.n + 1 END
  FROM join1 j JOIN cut c ON c.doc_id = j.doc_id AND c.pi = j.pi AND c.k = j.k + 1
), parts AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pi, n) AS k, p FROM (
    SELECT doc_id, pi, 0 AS n, p FROM para WHERE length(p) <= 1200 UNION ALL SELECT doc_id, pi, n, arg_max(buf, k) FROM join1 GROUP BY doc_id, pi, n)
), join2 AS (
  SELECT doc_id, k, p AS buf, 1 AS n FROM parts WHERE k = 1
  UNION ALL
  SELECT c.doc_id, c.k, CASE WHEN length(j.buf) + length(c.p) + 2 <= 1200 THEN j.buf || chr(10) || chr(10) || c.p ELSE c.p END, CASE WHEN length(j.buf) + length(c.p) + 2 <= 1200 THEN j.n ELSE j.n + 1 END
  FROM join2 j JOIN parts c ON c.doc_id = j.doc_id AND c.k = j.k + 1
), segments AS (SELECT doc_id, CAST(n AS INTEGER) AS page_number, CAST(n AS INTEGER) AS seq, 'text-' || n AS segment_id, arg_max(buf, k) AS source FROM join2 GROUP BY doc_id, n)
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segment(documents(spark, sf_dir), ["doc_id"])


@query(f"WITH RECURSIVE {SEGMENTS} SELECT * FROM segments")
def segment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in segments of at most 1200 units."""
    return segmented(spark, sf_dir)


@query(f"WITH RECURSIVE {SEGMENTS} SELECT * FROM segments")
def segment_documents_by_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of documents as rows of paragraphs, so that none has to fit into a task."""
    parts = S.with_paragraphs(documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("t")), "t", "p").select("doc_id", F.posexplode("p").alias("i", "text"))
    return S.segment_rows(parts, ["doc_id"], ["i"])


@query(rf"""SELECT doc_id, {NORMAL} AS chunk,
  regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS notes,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(160), ' '), chr(13) || chr(10), chr(10)), '[ \t]+\n', chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS page,
  CAST(len(list_filter(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')) AS INTEGER) AS n_lines FROM documents""")
def normal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text normalizers on whole texts."""
    return documents(spark, sf_dir).select("doc_id", T.normal_chunk("text").alias("chunk"), T.normal_notes("text").alias("notes"), T.normal_page("text").alias("page"), F.size(T.source_lines("text")).alias("n_lines"))


@query(f"""WITH {PAIRS} SELECT segment_id, source AS half, CAST(length(regexp_replace(source, '[^\\p{{Han}}]', '', 'g')) AS INTEGER) AS han, CAST(length(source) AS INTEGER) AS units,
  coalesce(CASE WHEN length(target) < 3 THEN false WHEN length(target) < 20 THEN true ELSE length(regexp_replace(target, '[^A-Za-z]', '', 'g')) / length(target) >= 0.3 END, false) AS english FROM pairs""")
def width_and_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width digits folded back, Han counts, lengths, and the English test."""
    p = pairs(spark, sf_dir)
    wide = F.translate("source", "0123456789.", "０１２３４５６７８９．")
    return p.select("segment_id", T.half_width(wide).alias("half"), T.han_count("source").alias("han"), T.units("source").alias("units"), T.is_reasonable_english("target").alias("english"))


@query(f"WITH {PAIRS} SELECT segment_id, source AS cleaned FROM pairs")
def cleaned_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with a space between all characters, cleaned back."""
    spaced = F.regexp_replace("source", r"(.)(?=.)", "$1 ")
    # a point between digits keeps the space after it, so it is left out before cleaning
    return pairs(spark, sf_dir).select("segment_id", T.clean_cjk(F.replace(spaced, F.lit(". "), F.lit("."))).alias("cleaned"))


@query(f"WITH {PAIRS} SELECT segment_id, replace(source, '.', '. ') AS cleaned FROM pairs")
def cleaned_spaced_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with a space between all characters, cleaned as they are; a point keeps the space after it."""
    return pairs(spark, sf_dir).select("segment_id", T.clean_cjk(F.regexp_replace("source", r"(.)(?=.)", "$1 ")).alias("cleaned"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) = 1 AND length(l[1]) <= 30 AND length(l[1]) <= 18 AND NOT regexp_matches(l[1], '[。！？!?；;：:，,、）)】》」』.]$') THEN 'heading'
  WHEN len(l) > 1 AND len(list_filter(l, lambda x: regexp_matches(x, '^(?:[0-9]{1,3}[.、)）]|\([0-9一二三四五六七八九十]+\)|[•·*-]\s)'))) = len(l) THEN 'list' ELSE 'paragraph' END AS kind FROM l""")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text is a heading, a list or prose."""
    return documents(spark, sf_dir).select("doc_id", T.line_kind("text").alias("kind"))


PAGED = "blocks_ AS (SELECT source || '-' || (doc_id // 250) AS doc, text, doc_id FROM documents), pages_ AS (SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY doc_id) AS INTEGER) AS page_number, text, doc_id FROM blocks_)"


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, each file those of one source among 250 ids, so that no file is large."""
    doc = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 250).cast("string"))
    n = F.row_number().over(Window.partitionBy("doc").orderBy("doc_id"))
    return documents(spark, sf_dir).select(doc.alias("doc"), "text", "doc_id").select("doc", n.alias("page_number"), "text", "doc_id")


@query(f"WITH {PAGED}, t AS (SELECT *, max(page_number) OVER (PARTITION BY doc) AS n FROM pages_) SELECT doc, page_number, doc_id FROM t WHERE page_number BETWEEN least(3, n) AND greatest(least(3, n), least(9, n))")
def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages 3 to 9 of every file."""
    return S.in_range(paged(spark, sf_dir), 3, 9, "doc").select("doc", "page_number", "doc_id")


@query(f"""WITH {PAGED}, x AS (SELECT doc, CASE WHEN page_number % 4 = 0 THEN ' ' ELSE text END AS text, CASE WHEN page_number % 8 = 0 THEN NULL ELSE text END AS ocr FROM pages_)
SELECT doc, CAST(sum(CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS selectable, CAST(sum(CASE WHEN trim(text) = '' AND trim(coalesce(ocr, '')) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS recognised,
  CAST(sum(CASE WHEN trim(text) = '' AND trim(coalesce(ocr, '')) = '' THEN 1 ELSE 0 END) AS BIGINT) AS unavailable FROM x GROUP BY doc""")
def page_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with text of their own, with recognised text, with neither, by file."""
    p = paged(spark, sf_dir)
    p = p.withColumns({"ocr_text": F.when(F.col("page_number") % 8 == 0, None).otherwise(F.col("text")), "text": F.when(F.col("page_number") % 4 == 0, " ").otherwise(F.col("text"))})
    return S.availability(p, "doc")


@query(f"WITH {PAGED} SELECT doc, page_number, CASE WHEN page_number % 4 <> 0 AND trim(text) <> '' THEN text WHEN page_number % 8 <> 0 THEN '> ' || text ELSE '' END AS text FROM pages_")
def page_source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own text of each page, else its recognised copy."""
    p = paged(spark, sf_dir)
    own = p.withColumn("text", F.when(F.col("page_number") % 4 == 0, " ").otherwise(F.col("text"))).drop("doc_id")
    copy = p.where("page_number % 8 <> 0").select("doc", "page_number", F.concat(F.lit("> "), "text").alias("text"))
    return S.page_text(own, copy, ["doc", "page_number"]).select("doc", "page_number", "text")


@query(f"""WITH RECURSIVE {SEGMENTS} SELECT doc_id, string_agg(source, chr(10) || chr(10) ORDER BY seq) AS source,
  coalesce(string_agg(rtrim('> ' || source), chr(10) || chr(10) ORDER BY seq) FILTER (WHERE seq % 3 <> 0), '') AS target FROM segments GROUP BY doc_id""")
def regrouped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments joined back in order; every third has no target yet."""
    s = segmented(spark, sf_dir).withColumn("target", F.when(F.col("seq") % 3 != 0, F.concat(F.lit("> "), "source")).otherwise("  "))
    return S.regroup(s, ["doc_id"])


TALK = "talk AS (SELECT a.conv_id, a.turn, a.text AS source, b.text AS target FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user')"


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's next turn."""
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return a.join(b, ["conv_id", "turn"], "left")


@query(f"""WITH {TALK}, w AS (SELECT *, 'Previous source:' || chr(10) || lag(source) OVER o || chr(10) || chr(10) || 'Previous translation:' || chr(10) || lag(coalesce(target, '')) OVER o AS c FROM talk WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, right(c, 800) AS context FROM w""")
def rolling_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each turn, the end of the turn before."""
    return S.rolling_context(talk(spark, sf_dir), "conv_id", ["turn"]).select("conv_id", "turn", "context")


#: Cleaning of text without Chinese characters, outer white space aside; digits two by two, so that each gap is seen.
LOOSE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '([0-9]) +([0-9])', '\1\2', 'g'), '([0-9]) +([0-9])', '\1\2', 'g'), ' +([，。！？；：、,.!?;:）】》〉」』])', '\1', 'g'), '([（【《〈「『]) +', '\1', 'g')"
CLEAN = TRIM.format(LOOSE)
CLEAN_LINES = TRIM.format("regexp_replace(array_to_string(list_transform(string_split(" + LOOSE + r", chr(10)), lambda x: " + TRIM.format("x") + r"), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')")


@query(rf"""WITH RECURSIVE {SEGMENTS}, cp AS (SELECT doc_id, pi, {CLEAN_LINES.format('p')} AS p FROM para), k AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY pi) AS k FROM cp WHERE p <> ''),
j AS (SELECT doc_id, k, p AS buf, 1 AS n FROM k WHERE k = 1 UNION ALL
  SELECT k.doc_id, k.k, CASE WHEN length(j.buf) + length(k.p) + 2 <= 12000 THEN j.buf || chr(10) || chr(10) || k.p ELSE k.p END, CASE WHEN length(j.buf) + length(k.p) + 2 <= 12000 THEN j.n ELSE j.n + 1 END FROM j JOIN k ON j.doc_id = k.doc_id AND k.k = j.k + 1)
SELECT doc_id, CAST(n AS INTEGER) AS page_number, arg_max(buf, k) AS text, CAST(length(arg_max(buf, k)) AS INTEGER) AS chars FROM j GROUP BY doc_id, n""")
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's paragraphs, cleaned and packed into its sections."""
    blocks = S.with_paragraphs(documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("t")), "t", "b")
    rows = blocks.select("doc_id", F.posexplode(S.sections(F.col("b"))).alias("i", "text"))
    return rows.select("doc_id", (F.col("i") + 1).alias("page_number"), "text", units("text").alias("chars"))


@query(rf"""WITH RECURSIVE {SEGMENTS}, k AS (SELECT source, p, row_number() OVER (PARTITION BY source ORDER BY doc_id, pi) AS k FROM para JOIN documents USING (doc_id)),
j AS (SELECT source, k, CAST(length(p) AS BIGINT) AS size, 1 AS n FROM k WHERE k = 1 UNION ALL
  SELECT k.source, k.k, CASE WHEN j.size + length(k.p) + 2 <= 12000 THEN j.size + length(k.p) + 2 ELSE length(k.p) END, CASE WHEN j.size + length(k.p) + 2 <= 12000 THEN j.n ELSE j.n + 1 END FROM j JOIN k ON j.source = k.source AND k.k = j.k + 1)
SELECT source, CAST(n AS INTEGER) AS seq, string_agg(p, chr(10) || chr(10) ORDER BY k) AS text FROM j JOIN k USING (source, k) GROUP BY source, n""")
def packed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paragraphs of a source, as one document of any size, packed into sections."""
    parts = S.with_paragraphs(documents(spark, sf_dir).select("source", "doc_id", F.coalesce("text", F.lit("")).alias("t")), "t", "p").select("source", "doc_id", F.posexplode("p").alias("i", "text"))
    return S.packed(parts, ["source"], ["doc_id", "i"], S.SECTION)


@query(rf"""WITH u AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS u FROM documents), n AS (SELECT doc_id, unnest(u) AS t, unnest(range(1, len(u) + 1)) AS page_number FROM u)
SELECT doc_id, CAST(page_number AS INTEGER) AS page_number, {CLEAN.format('t')} AS text FROM n WHERE {CLEAN.format('t')} <> ''""")
def numbered_document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines as its units: numbered, then cleaned, blank ones dropped."""
    d = documents(spark, sf_dir).select("doc_id", F.split(T.unix_lines("text"), "\n", -1).alias("u"))
    return S.numbered_units(d, ["doc_id"], "u")
