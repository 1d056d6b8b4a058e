"""Short strings inside long ones, by an index under each short string's rarest gram.

A short string occurs in a text only if its grams do, so it is filed under one of
them: the one that the fewest of the strings it may be found in, or failing that
the fewest of its like, have. A text gives out each of its grams once, meets what
is filed under it by equi-join, and ``contains`` decides. Strings of one character
are filed under themselves. Texts are not carried through the join, only ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram.
SIZE = 2


def grams(text: Column | str) -> Column:
    """The text's distinct grams, and its characters; to be given a plain column."""
    letters = F.split(text, "")
    pairs = F.zip_with(letters, F.slice(letters, 2, F.greatest(F.size(letters) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.concat(F.filter(pairs, lambda g: g.isNotNull()), letters))


def spread(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, gram) for every distinct gram of every row's text."""
    return rows.select(*keys, F.explode(grams(F.col(text))).alias("gram"))


def filed(terms: DataFrame, text: str, within: list[str] = [], counted: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """The distinct terms (of each group ``within``) with the ``gram`` that they are filed under.

    ``counted`` has (within, gram, n); without it a gram's count is the number of terms that hold it.
    """
    own = terms.select(*within, text).where(F.length(text) > 0).distinct()
    each = own.select(*within, text, F.explode(grams(F.col(text))).alias("gram")).where((F.length("gram") == SIZE) | (F.length(text) < SIZE))
    n = each.groupBy(*within, "gram").agg(F.count("*").alias("n")) if counted is None else counted
    known = each.join(n, [*within, "gram"], "left")
    return known.groupBy(*within, text).agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0).cast("long")), "gram")).alias("gram"))


def hits(texts: DataFrame, key: str, text: str, index: DataFrame, term: str) -> DataFrame:
    """(key, term): the terms of an index (term, gram) that each text holds; the key names one row."""
    met = spread(texts.where(F.col(text).isNotNull()), [key], text).join(index.select(term, "gram"), "gram").select(key, term)
    return met.join(texts.select(key, F.col(text).alias("_text")), key).where(F.col("_text").contains(F.col(term))).select(key, term)


def inner(rows: DataFrame, group: list[str], text: str, least: int = 1) -> DataFrame:
    """(group, text) of distinct texts, of so many characters at least, that a longer text of their group holds.

    A text goes by its digest until the last comparison, so a long one costs its length, not its length times its grams.
    """
    distinct = rows.select(F.struct(*group).alias("_g"), F.col(text).alias("_t")).where(F.length("_t") > 0).distinct()
    named = distinct.select("_g", "_t", F.unhex(F.sha2(F.col("_t").cast("binary"), 256)).alias("_id"), F.length("_t").alias("_n"))
    all_grams = spread(named, ["_g", "_id", "_n"], "_t")
    counted = all_grams.groupBy("_g", "gram").agg(F.count("*").alias("n")).where("n > 1")
    short = all_grams.where((F.col("_n") >= least) & ((F.length("gram") == SIZE) | (F.col("_n") < SIZE)))
    # a gram that no other text of the group has proves that none holds this one
    rare = short.join(counted, ["_g", "gram"], "left").groupBy("_g", "_id", "_n").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(1).cast("long")), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(1).cast("long"))).alias("n"))
    some = rare.where("n > 1").select("_g", "gram", F.col("_id").alias("_short"), F.col("_n").alias("_m"))
    met = all_grams.join(some, ["_g", "gram"]).where(F.col("_n") > F.col("_m")).select("_g", F.col("_id").alias("_long"), "_short")
    texts = lambda name, col: named.select("_g", F.col("_id").alias(name), F.col("_t").alias(col))
    both = met.join(texts("_short", "_a"), ["_g", "_short"]).join(texts("_long", "_b"), ["_g", "_long"]).where(F.col("_b").contains(F.col("_a")))
    return both.select("_g", F.col("_a").alias(text)).distinct().select(*(F.col("_g")[g].alias(g) for g in group), text)
