"""Page structure: repeated margins, tables, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import SPACE, col, lines_of, normal_notes, normal_page, paragraphs_of, source_lines, sub, trim, units, unix_lines

# --- repeated headers and footers -------------------------------------------


def margin_lines(pages: DataFrame, by: str, least_pages: int = 3, share: float = 0.6, edge: int = 2) -> DataFrame:
    """(by, page_number, line): page edges that repeat on enough pages of documents with enough pages."""
    lines = F.filter(lines_of("text"), lambda s: s != "")
    ends = F.array_distinct(F.concat(F.slice("_l", 1, edge), F.slice(F.reverse("_l"), 1, edge)))
    rows = pages.withColumn("_l", lines).select(by, "page_number", F.explode(ends).alias("line")).where(units("line").between(2, 160))
    totals = pages.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least_pages)
    often = rows.groupBy(by, "line").agg(F.countDistinct("page_number").alias("_k")).join(totals, by)
    often = often.where(F.col("_k") >= F.greatest(F.lit(least_pages), F.ceil(F.lit(str(share)).cast("decimal(6,4)") * F.col("_n")))).select(by, "line")
    return rows.join(often, [by, "line"]).select(by, "page_number", "line")


def without_margins(pages: DataFrame, by: str, **limits) -> DataFrame:
    """Pages without their repeated edge lines; every page of a document that has any is normalized again."""
    found = margin_lines(pages, by, **limits).groupBy(by, "page_number").agg(F.collect_set("line").alias("_drop"))
    touched = found.select(by).distinct().withColumn("_any", F.lit(True))
    rows = pages.join(found, [by, "page_number"], "left").join(touched, by, "left")
    none = F.array().cast("array<string>")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda s: ~F.array_contains(F.coalesce("_drop", none), trim(s))), "\n")
    return rows.withColumn("text", F.when(F.col("_any"), normal_page(kept)).otherwise(F.col("text"))).drop("_drop", "_any")


# --- structured blocks --------------------------------------------------------
# The marks of tables and charts.
BOX, BAR = "[┌┬┐└┴┘├┼┤│─═║╔╗╚╝]", "[▁▂▃▄▅▆▇█■□◆◇●○]"
GRID = r"\A[+\-|=: ]+\z"
KEY_VALUE = rf"\A.{{1,50}}:[{SPACE}]*[-+]?[0-9][0-9,]*(?:\.[0-9]+)?(?:%|[a-zA-Z]+)?\z"
WIDE_GAP = rf"[^{SPACE}]+[{SPACE}]{{2,}}[^{SPACE}]+"
TABLE = "struct<type:string,text:string,headers:array<string>,rows:array<array<string>>,kind:string>"


def _block(kind: str, text: Column | None = None, headers: Column | None = None, rows: Column | None = None, shape: Column | None = None) -> Column:
    none = lambda x, t: F.lit(None).cast(t) if x is None else x
    return F.struct(F.lit(kind).alias("type"), none(text, "string").alias("text"), none(headers, "array<string>").alias("headers"), none(rows, "array<array<string>>").alias("rows"), none(shape, "string").alias("kind")).cast(TABLE)


def _cells(line: Column, by: str) -> Column:
    return F.transform(F.split(line, by, -1), lambda c: trim(c))


def _fit(row: Column, n: Column) -> Column:
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), n)), F.lit(1), n)


def _marked(lines: Column) -> Column:
    """A table with a row of dashes under its headers, or null."""
    cells = lambda s: _cells(sub(sub(s, r"\A\|", ""), r"\|\z", ""), r"\|")
    first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    head, rule = cells(first), cells(second)
    ok = first.contains("|") & second.contains("|") & (F.size(head) >= 2) & (F.size(rule) == F.size(head)) & F.forall(rule, lambda c: c.rlike(r"\A:?-{3,}:?\z"))
    rows = F.transform(F.filter(F.slice(lines, 3, 1 << 30), lambda s: s.contains("|")), lambda s: _fit(cells(s), F.size(head)))
    return F.when(ok, _block("table", headers=head, rows=rows))


def delimited(lines: Column, by: str, pattern: str) -> Column:
    """A table whose lines all have as many cells, or null."""
    rows = F.transform(lines, lambda s: _cells(s, pattern))
    first = F.get(rows, F.lit(0))
    n = F.size(first)
    ok = (F.size(lines) >= 2) & F.forall(lines, lambda s: s.contains(by)) & (n >= 2) & F.forall(rows, lambda r: F.size(r) == n)
    if by in ",;":
        ok = ok & ~F.exists(rows, lambda r: F.forall(r, lambda c: F.size(F.split(c, " ", -1)) > 8))
    head = F.forall(first, lambda c: (c != "") & ~c.rlike(r"\A[0-9]+(?:\.[0-9]+)?\z")) & F.exists(first, lambda c: c.rlike("[A-Za-z]"))
    names = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("Column "), i.cast("string")))
    return F.when(ok, F.when(head, _block("table", headers=first, rows=F.slice(rows, 2, 1 << 30))).otherwise(_block("table", headers=names, rows=rows)))


def _preformatted(text: Column, lines: Column) -> Column:
    count = lambda pattern: F.size(F.filter(lines, lambda s: s.rlike(pattern)))
    table = F.exists(lines, lambda s: s.rlike(BOX)) | (count(GRID) >= 2) | (count(WIDE_GAP) >= 2)
    chart = F.exists(lines, lambda s: s.rlike(BAR)) | (count(KEY_VALUE) >= 2)
    return F.when((F.size(lines) >= 2) & (table | chart), _block("preformatted", text=trim(text), shape=F.when(chart & ~table, "chart").otherwise("table")))


def blocks(paragraphs: DataFrame, text: str = "text") -> DataFrame:
    """Each non-blank paragraph as a table, preformatted text, or prose, in column ``block``."""
    rows = paragraphs.withColumn("_t", trim(text)).where("_t <> ''").withColumn("_l", lines_of("_t"))
    lines, t = F.col("_l"), F.col("_t")
    made = F.coalesce(_marked(lines), delimited(lines, "\t", "\t"), delimited(lines, ";", ";"), delimited(lines, ",", ","), delimited(lines, "|", r"\|"), _preformatted(t, lines), _block("paragraph", text=t))
    return rows.withColumn("block", made).drop("_t", "_l")


def table_cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Tables in long form: row, column, header and value; short rows are filled, long ones cut."""
    r = rows.where("block.type = 'table'").select(*keys, F.col("block.headers").alias("h"), F.posexplode("block.rows").alias("row_no", "r"))
    cells = r.select(*keys, "row_no", "h", F.posexplode(_fit(F.col("r"), F.size("h"))).alias("column_no", "value"))
    return cells.select(*keys, "row_no", "column_no", F.get("h", F.col("column_no")).alias("header"), "value")


# --- notes -----------------------------------------------------------------
# How notes and their headings begin.
NOTE = rf"\A(\[([0-9]{{1,3}})\]|\(([0-9]{{1,3}})\)|([0-9]{{1,3}})[.)]|([*†‡]))[{SPACE}]+(.+)\z"
NOTES_HEADING = rf"(?i)\n{{1,2}}footnotes?[{SPACE}]*\n"
CN = "一二三四五六七八九十百零〇"
CN_NOTE = (
    rf"\A[{SPACE}]*([\x{{2460}}-\x{{24FF}}\x{{2776}}-\x{{277F}}]|[\x{{B9}}\x{{B2}}\x{{B3}}\x{{2070}}-\x{{2079}}]+|[\[〔〈［【(（][{SPACE}]*(?:[0-9]{{1,3}}|[{CN}]{{1,3}})[{SPACE}]*[\]〕〉］】)）]"
    rf"|(?:註|注|按|案)[{SPACE}]*(?:[0-9]{{1,3}}|[{CN}]{{1,3}})|[0-9]{{1,3}}[{SPACE}]*[.、)）]|[※*＊])[{SPACE}]*(.+)\z"
)
CN_HEADING = rf"\A[{SPACE}]*(註釋|註解|注釋|注解|附註|附注|脚註|腳註|腳注|脚注|備註|备注|注|註|参考文献|參考文獻)[：:]?[{SPACE}]*\z"


def _with_notes(rows: DataFrame, parts: str, pattern: str, marker: int, content: int, between: str) -> DataFrame:
    """Adds ``notes`` (note_no, marker, content) of an array of parts: a marked part starts one, the unmarked after it belong to it."""
    at = F.filter(F.transform(parts, lambda p, i: F.when(p.rlike(pattern), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_at", at)
    taken = lambda i, group: trim(F.regexp_extract(F.get(parts, i), pattern, group))

    def note(i: Column, n: Column) -> Column:
        after = F.slice(parts, i + 2, F.coalesce(F.get("_at", n + 1), F.size(parts)) - i - 1)
        return F.struct((n + 1).cast("long").alias("note_no"), taken(i, marker).alias("marker"), trim(F.array_join(F.concat(F.array(taken(i, content)), after), between)).alias("content"))

    none = F.array().cast("array<struct<note_no:bigint,marker:string,content:string>>")
    return rows.withColumn("notes", F.coalesce(F.transform("_at", note), none)).drop("_at")


def split_notes(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Body paragraphs and notes of each text: ``body`` and ``notes`` (marker, content).

    Notes follow a heading, or are the last paragraphs from the first marked one
    on: at least two marked, the first in the last 55 %, two of them in a row.
    """
    rows = docs.select(key, normal_notes(F.coalesce(col(text), F.lit(""))).alias("_t"))
    at = F.regexp_instr("_t", F.lit(NOTES_HEADING))
    heading = F.regexp_substr("_t", F.lit(NOTES_HEADING))
    rows = rows.withColumns({"_at": at, "_h": heading})
    by_heading = F.col("_h").isNotNull()
    body_text = F.when(by_heading, trim(F.substring(F.col("_t"), F.lit(1), F.col("_at") - 1))).otherwise(F.col("_t"))
    note_text = F.when(by_heading, trim(F.substring(F.col("_t"), F.col("_at") + F.length("_h"), F.length("_t"))))
    rows = rows.withColumns({"_p": paragraphs_of(body_text), "_n": lines_of(note_text)})
    rows = rows.withColumn("_c", F.filter(F.transform("_p", lambda p, i: F.when(p.rlike(NOTE), i)), lambda i: i.isNotNull()))
    first = F.get("_c", F.lit(0))
    near = F.exists("_c", lambda i: F.array_contains("_c", i + 1))
    tail = ~by_heading & (F.size("_p") >= 3) & (F.size("_c") >= 2) & (first >= F.floor(F.size("_p") * F.lit("0.45").cast("decimal(3,2)"))) & near
    rows = rows.withColumn("_from", F.when(tail, first))
    parts = F.when(by_heading, F.col("_n")).when(F.col("_from").isNotNull(), F.slice("_p", F.col("_from") + 1, F.size("_p")))
    out = _with_notes(rows.withColumn("_parts", parts), "_parts", NOTE, 1, 6, " ")
    return out.select(key, F.when(F.col("_from").isNotNull(), F.slice("_p", F.lit(1), F.col("_from"))).otherwise(F.col("_p")).alias("body"), "notes", F.col("_t").alias("normal"))


def normal_note_text(split: DataFrame, key: str) -> DataFrame:
    """Body, then a heading and the notes, as one text."""
    body = trim(F.array_join("body", "\n\n"))
    notes = F.array_join(F.transform("notes", lambda n: F.concat(n["marker"], F.lit(" "), n["content"])), "\n")
    with_notes = trim(F.concat(body, F.lit("\n\nFootnotes\n"), notes))
    return split.select(key, F.when((F.size("notes") == 0) & (F.size("body") == 0), F.col("normal")).when(F.size("notes") == 0, body).otherwise(with_notes).alias("text"))


def split_cn_notes(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Body text and notes of Chinese sources, by lines.

    Notes start at the first heading line, or at the first run of two or more
    marked lines that begins in the last 60 %. They need a body before them;
    what follows a note belongs to it. Else the whole text is body.
    """
    rows = docs.select(key, trim(F.coalesce(col(text), F.lit(""))).alias("_t")).withColumn("_l", source_lines("_t"))
    rows = rows.withColumns({"_m": F.transform("_l", lambda s: s.rlike(CN_NOTE)), "_h": F.transform("_l", lambda s: s.rlike(CN_HEADING))})
    least = F.floor(F.size("_l") * F.lit("0.4").cast("decimal(2,1)"))
    begins = lambda m, i: m & (i >= least) & F.coalesce(F.get("_m", i + 1), F.lit(False)) & ~F.coalesce(F.get("_m", i - 1), F.lit(False))
    by_run = F.array_position(F.transform("_m", begins), True)
    place = F.coalesce(F.nullif(F.array_position("_h", True), F.lit(0)), F.nullif(by_run, F.lit(0))).cast("int") - 1
    rows = rows.withColumn("_from", F.when(place > 0, place))
    tail = F.when(F.col("_from").isNotNull(), F.filter("_l", lambda s, i: (i >= F.col("_from")) & ~F.get("_h", i)))
    out = _with_notes(rows.withColumn("_parts", tail), "_parts", CN_NOTE, 1, 2, "")
    body = F.when(F.size("notes") > 0, F.array_join(F.slice("_l", F.lit(1), F.col("_from")), "\n")).otherwise(F.col("_t"))
    paragraphs = F.filter(F.transform(F.split(sub(unix_lines("_body"), r"\n{3,}", "\n\n"), rf"\n[{SPACE}]*\n", -1), trim), lambda s: s != "")
    return out.withColumn("_body", body).select(key, paragraphs.alias("body"), "notes")
