"""How reading a document ended, and what is written of the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import col, is_blank, trim, units


def extraction(pages: DataFrame, by: list[str], failed: str = "failed") -> DataFrame:
    """error if all pages failed, scanned if none has text, else success."""
    kind = F.when(F.bool_and(col(failed)), "error").when(F.bool_and(is_blank("text")), "scanned").otherwise("success")
    return pages.groupBy(*by).agg(kind.alias("kind"), F.count("*").alias("total_pages"))


def scan_fallback(documents: DataFrame) -> DataFrame:
    """Pages of (total_pages, renderable, source_error) that can still be scanned, and what to say."""
    pages = F.array_sort(F.array_distinct(F.filter("renderable", lambda p: p.between(1, F.col("total_pages")))))
    rows = documents.withColumn("pages", pages).withColumn("skipped", F.greatest(F.col("total_pages") - F.size("pages"), F.lit(0)))
    n, total, skipped = F.size("pages").cast("string"), F.col("total_pages").cast("string"), F.col("skipped")
    whole = F.when(F.col("total_pages") == 1, "The page can still be rendered.").otherwise(F.concat(F.lit("All "), total, F.lit(" pages can still be rendered.")))
    some = F.concat(n, F.lit(" of "), total, F.lit(" pages can still be rendered; "), skipped.cast("string"), F.when(skipped == 1, " unreadable page was skipped.").otherwise(" unreadable pages were skipped."))
    said = F.concat(F.col("source_error"), F.lit(" "), F.when(skipped == 0, whole).otherwise(some), F.lit(" Translation will use OCR. Review names, seals, and dense tables carefully."))
    none = F.size("pages") == 0
    return rows.withColumns({"kind": F.when(none, "error").otherwise("scanned"), "message": F.when(none, F.concat(F.col("source_error"), F.lit(" OCR fallback could not render any pages."))).otherwise(said)})


def target_texts(segments: DataFrame, by: list[str]) -> DataFrame:
    """Non-blank targets of each document in order, joined by blank lines."""
    rows = F.array_sort(F.collect_list(F.struct("page_number", "seq", trim(F.coalesce("target", F.lit(""))).alias("t"))))
    return segments.groupBy(*by).agg(rows.alias("r")).select(*by, F.array_join(F.filter(F.col("r.t"), lambda t: t != ""), "\n\n").alias("text"))


def escaped(x):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(col(x), F.lit(a), F.lit(b))
    return x


def review_rows(segments: DataFrame, by: list[str]) -> DataFrame:
    """Each segment as review pages show it: label, escaped texts, and its document's totals."""
    order = Window.partitionBy(*by).orderBy("page_number", "seq")
    whole = Window.partitionBy(*by)
    n = F.row_number().over(order)
    label = F.when(F.coalesce("page_number", F.lit(0)) != 0, F.concat(F.lit("Page "), F.col("page_number").cast("string"))).otherwise(F.concat(F.lit("Section "), n.cast("string")))
    return segments.select(
        *by, n.alias("section"), label.alias("label"), escaped("source").alias("source"), escaped(F.coalesce("target", F.lit(""))).alias("target"),
        F.count("*").over(whole).alias("sections"), F.sum(units("source")).over(whole).alias("source_chars"), F.sum(units(F.coalesce("target", F.lit("")))).over(whole).alias("target_chars"),
    )


def write_texts(texts: DataFrame, path: str, by: str) -> None:
    """One folder of text files for each document."""
    texts.select(by, "text").write.partitionBy(by).mode("overwrite").text(path)


def glossary_files(glossary: DataFrame, by: list[str]) -> DataFrame:
    """(by, content): each glossary as the JSON array that imports take, sorted by term; a glossary is one file, so it is small."""
    entry = F.struct(F.col("term").alias("chinese"), F.col("gloss").alias("english"), "locked", "confirmed")
    return glossary.groupBy(*by).agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("content"))


def write_glossaries(glossary: DataFrame, path: str, by: str) -> None:
    """One folder with a JSON array for each glossary."""
    glossary_files(glossary, [by]).write.partitionBy(by).mode("overwrite").text(path)
