"""From documents and pages to ordered segments, and back to texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import SPACE, clean_cjk, col, is_blank, lines_of, normal_chunk, paragraphs_of, sub, trim, units
from lectern.operators import folds

#: Longest segment and longest section, in UTF-16 units.
SEGMENT, SECTION = 1200, 12_000
SENTENCE_END = rf"(?<=[。！？!?；;])[{SPACE}]*"


def with_paragraphs(df: DataFrame, text: Column | str, name: str = "_p") -> DataFrame:
    """The rows with the parts of the text between blank lines; if there is one at most, its lines.

    What is read twice is a column first, so that it is computed once.
    """
    rows = df.withColumn(name, normal_chunk(text))
    rows = rows.withColumn("_parts", paragraphs_of(name))
    return rows.withColumn(name, F.when(F.size("_parts") > 1, F.col("_parts")).otherwise(lines_of(name))).drop("_parts")


def _state(done: Column, buffer: Column) -> Column:
    return F.struct(done.alias("done"), buffer.alias("buffer"))


def _fold(parts: Column, step) -> Column:
    """Fold strings into finished pieces and a buffer; the last buffer is a piece unless empty."""
    start = _state(F.array().cast("array<string>"), F.lit(""))
    return F.aggregate(parts, start, step, lambda a: F.when(a["buffer"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["buffer"]))))


def pack(parts: Column, limit: int = SEGMENT, between: str = "\n\n") -> Column:
    """Greedy: a part joins the buffer while both and what is put between them fit."""

    def step(a: Column, p: Column) -> Column:
        fits = units(a["buffer"]) + units(p) + len(between) <= limit
        return F.when(a["buffer"] == "", _state(a["done"], p)).when(fits, _state(a["done"], F.concat(a["buffer"], F.lit(between), p))).otherwise(_state(F.concat(a["done"], F.array(a["buffer"])), p))

    return _fold(parts, step)


def split_long(paragraph: Column, limit: int = SEGMENT) -> Column:
    """A paragraph over the limit by sentences; a sentence over it in pieces of the limit."""
    sentences = F.filter(F.transform(F.split(paragraph, SENTENCE_END, -1), trim), lambda s: s != "")

    def step(a: Column, s: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / limit).cast("int")), lambda i: F.substring(s, i * limit + 1, F.lit(limit)))
        flushed = F.when(a["buffer"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["buffer"])))
        return (
            F.when(units(s) > limit, _state(F.concat(flushed, pieces), F.lit(""))).when(a["buffer"] == "", _state(a["done"], s))
            .when(units(a["buffer"]) + units(s) <= limit, _state(a["done"], F.concat(a["buffer"], s))).otherwise(_state(F.concat(a["done"], F.array(a["buffer"])), s))
        )

    return F.when(units(paragraph) <= limit, F.array(paragraph)).otherwise(_fold(sentences, step))


def segment(docs: DataFrame, keys: list[str], text: str = "text", page: str | None = None) -> DataFrame:
    """One row per segment, numbered from 1: ``text-i``, or ``pdf-p{page}-i`` within pages."""
    parts = with_paragraphs(docs.select(*keys, *([page] if page else []), F.coalesce(col(text), F.lit("")).alias("_t")), "_t").drop("_t")
    long = parts.withColumn("_p", F.flatten(F.transform("_p", lambda p: split_long(p))))
    rows = long.select(*keys, *([page] if page else []), F.posexplode(pack(F.col("_p"))).alias("_i", "source"))
    seq = F.col("_i") + 1
    name = F.concat(F.lit("pdf-p"), F.col(page).cast("string"), F.lit("-"), seq.cast("string")) if page else F.concat(F.lit("text-"), seq.cast("string"))
    return rows.select(*keys, (F.col(page) if page else seq).cast("int").alias("page_number"), seq.alias("seq"), name.alias("segment_id"), "source")


def packed(parts: DataFrame, keys: list[str], order: list[str], limit: int = SEGMENT, between: str = "\n\n", text: str = "text") -> DataFrame:
    """(keys, seq, text): the same greedy packing for rows of parts, of documents of any size.

    A document's rows lie in as many partitions as they need; nothing holds more
    than one piece, which the limit bounds, or one part. Blank parts count as they
    are; null ones are left out. seq starts at 1.
    """
    rows = folds.grouped(parts.where(F.col(text).isNotNull()), keys, order, limit, length=units(text), between=len(between))
    own = F.transform(F.array_sort(F.collect_list(F.struct("row", F.col(text).alias("t")))), lambda r: r["t"])
    return rows.groupBy(*keys, "group").agg(F.array_join(own, between).alias(text)).select(*keys, (F.col("group") + 1).cast("int").alias("seq"), text)


def segment_rows(paragraphs: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """``segment`` for documents that come as rows of paragraphs, none of which is the whole document."""
    rows = paragraphs.select(*keys, *order, F.posexplode(split_long(F.col(text))).alias("_k", text))
    found = packed(rows, keys, [*order, "_k"], text=text)
    return found.select(*keys, F.col("seq").alias("page_number"), "seq", F.concat(F.lit("text-"), F.col("seq").cast("string")).alias("segment_id"), F.col(text).alias("source"))


def sections(blocks: Column, limit: int = SECTION) -> Column:
    """Cleaned blocks packed into sections; long blocks stay whole."""
    return pack(F.filter(F.transform(blocks, clean_cjk), lambda s: s != ""), limit)


def numbered_units(docs: DataFrame, keys: list[str], units_column: str) -> DataFrame:
    """Units numbered in order, then cleaned and blank ones dropped, so numbers may have gaps."""
    rows = docs.select(*keys, F.posexplode(units_column).alias("_i", "_t"))
    return rows.select(*keys, (F.col("_i") + 1).alias("page_number"), clean_cjk("_t").alias("text")).where("text <> ''")


def in_range(pages: DataFrame, start: int, end: int, by: str = "doc_id") -> DataFrame:
    """Pages of an inclusive range, clamped to each document's pages; only counts are shuffled, not texts."""
    totals = pages.groupBy(F.col(by).alias("_by")).agg(F.max("page_number").alias("_n"))
    first = F.least(F.greatest(F.lit(1), F.lit(start)), "_n")
    last = F.greatest(first, F.least(F.lit(end), F.col("_n")))
    wanted = pages.where(F.col("page_number").between(1, max(1, start, end))).join(totals, F.col(by).eqNullSafe(F.col("_by")))
    return wanted.where(F.col("page_number").between(first, last)).drop("_by", "_n")


def availability(pages: DataFrame, by: str, text: str = "text", ocr: str = "ocr_text") -> DataFrame:
    """Pages with selectable text, with recognised text only, and with neither."""
    own, other = ~is_blank(text), ~is_blank(ocr)
    n = lambda c: F.sum(c.cast("long"))
    return pages.groupBy(by).agg(n(own).alias("selectable"), n(~own & other).alias("recognised"), n(~own & ~other).alias("unavailable"))


def page_text(pages: DataFrame, recognised: DataFrame, keys: list[str]) -> DataFrame:
    """Text of each page, or of its recognised copy where it is blank."""
    other = recognised.select(*keys, F.col("text").alias("_o"))
    return pages.join(other, keys, "left").withColumn("text", F.when(~is_blank("text"), F.col("text")).otherwise(F.coalesce("_o", F.lit("")))).drop("_o")


def regroup(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Source and target of each page in segment order, joined by blank lines; blank targets left out."""
    rows = F.array_sort(F.collect_list(F.struct("seq", F.col("source").alias("s"), trim(F.coalesce("target", F.lit(""))).alias("t"))))
    page = segments.groupBy(*keys).agg(rows.alias("r"))
    return page.select(*keys, F.array_join("r.s", "\n\n").alias("source"), F.array_join(F.filter(F.col("r.t"), lambda t: t != ""), "\n\n").alias("target"))


def rolling_context(segments: DataFrame, by: str, order: list[str], keep: int = 800) -> DataFrame:
    """The end of the segment before, source and translation, for continuity; null for the first."""
    w = Window.partitionBy(by).orderBy(*order)
    before = F.concat(F.lit("Previous source:\n"), F.lag("source").over(w), F.lit("\n\nPrevious translation:\n"), F.lag(F.coalesce("target", F.lit(""))).over(w))
    return segments.withColumn("context", F.right(before, F.lit(keep)))
