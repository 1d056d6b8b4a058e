"""Translation memory and history: lookups, upserts, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import col, is_blank, short_hash, trim, units, unix_lines

#: Entries of history that are kept.
KEEP = 25


def memory_source(text: Column | str) -> Column:
    return trim(unix_lines(text))


def signature(glossary: Column | str) -> Column:
    """A map's trimmed non-blank pairs, sorted, in one string."""
    pairs = F.transform(F.map_entries(col(glossary)), lambda e: F.struct(trim(e["key"]).alias("k"), trim(e["value"]).alias("v")))
    full = F.array_sort(F.filter(pairs, lambda e: (e["k"] != "") & (e["v"] != "")))
    return F.array_join(F.transform(full, lambda e: F.concat(e["k"], F.lit("\0"), e["v"])), "\1")


def memory_key(source: Column | str, domain: Column | str, sign: Column | str) -> Column:
    """A short id for display; lookups compare the full values."""
    return short_hash(F.concat_ws("\0", memory_source(source), col(domain), col(sign)))


def look_up(segments: DataFrame, memory: DataFrame) -> DataFrame:
    """Segments with ``remembered`` and whether memory has them: same source, domain and glossary signature.

    Of records that agree in these the newest counts, of equally new ones the
    largest target. A digest leads the keys, so that sorting seldom compares texts.
    """
    keys = ["_h", "_s", "domain", "signature"]
    keyed = lambda df: df.withColumn("_s", memory_source("source")).withColumn("_h", F.xxhash64("_s", "domain", "signature"))
    newest_ = F.max_by("target", F.struct("updated_at", "target")).alias("remembered")
    m = keyed(memory).where("target is not null").groupBy(*keys).agg(newest_)
    return keyed(segments).join(m, keys, "left").withColumn("memory_hit", F.col("remembered").isNotNull()).drop("_s", "_h")


def upsert(memory: DataFrame, new: DataFrame) -> DataFrame:
    """Memory after new records: of each key the last written; blank targets are not written."""
    return last_written(memory.unionByName(new.where(~is_blank("target"))))


def last_written(records: DataFrame, parted: list[str] = []) -> DataFrame:  # noqa: B006
    """Of each key the record last written; rows that lie together by ``parted``, columns that the key determines, are not shuffled."""
    both = records.withColumn("source", memory_source("source"))
    keys = [*parted, "source", "domain", "signature"]
    rest = [c for c in both.columns if c not in (*keys, "updated_at")]
    last = F.max_by(F.struct("updated_at", *rest), F.struct("updated_at", "target")).alias("r")
    return both.groupBy(*keys).agg(last).select(*keys, "r.*")


def last_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of each key the row that comes last; of equal places the largest row."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r")).select(*key, "r.*")


def history_entries(segments: DataFrame, keys: list[str], label: Column, unit: str = "page") -> DataFrame:
    """One entry per document: size, units, and an id of its label and its segments' ids and lengths."""
    rows = F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(":", "segment_id", units("source").cast("string")).alias("part"))))
    one = segments.withColumn("_label", label).groupBy(*keys, "_label").agg(F.sum(units("source")).alias("source_characters"), F.countDistinct("page_number").alias("unit_count"), rows.alias("_r"))
    name = F.concat(F.lit(unit), F.when(F.col("unit_count") == 1, "").otherwise("s"))
    return one.select(short_hash(F.concat_ws("|", "_label", F.array_join("_r.part", "|"))).alias("id"), *keys, F.col("_label").alias("source_label"), "source_characters", "unit_count", name.alias("unit_label"))


def newest(history: DataFrame, by: list[str], keep: int = KEEP, id_column: str = "id") -> DataFrame:
    """Of each id the newest entry, and of those the newest so many; ``by`` may hold columns that the others determine."""
    once = Window.partitionBy(*by, id_column).orderBy(F.desc("saved_at"))
    rank = Window.partitionBy(*by).orderBy(F.desc("saved_at"), F.desc(id_column))
    current = history.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return current.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= keep).drop("_n")


def age_label(saved: Column | str, now: Column) -> Column:
    minutes = F.floor((F.unix_millis(now) - F.unix_millis(col(saved))) / 60000)
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return (
        F.when(minutes < 1, "Just now").when(minutes < 60, say(minutes, "m ago")).when(minutes < 1440, say(F.floor(minutes / 60), "h ago"))
        .when(minutes < 10080, say(F.floor(minutes / 1440), "d ago")).otherwise(F.date_format(col(saved), "yyyy-MM-dd"))
    )
