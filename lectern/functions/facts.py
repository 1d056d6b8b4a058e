"""Dates, percentages, amounts and numbers in a text, as comparable strings.

The functions take texts of half width; with_facts makes them so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import SPACE, col, half_width, sub

# Patterns and month names.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
MONTH_NUMBER = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
NUMBER = r"[-+]?[0-9]+(?:[,.][0-9]+)*"
UNITS = "元|圓|圆|人民幣|人民币|美元|港元|新台幣|新台币|RMB|CNY|USD|HKD|TWD"
S = f"[{SPACE}]"
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Each date pattern with the groups of year, month and day, and a pattern or a character that every text with such a
#: date has, cheap to look for. Classes stand outside of (?i), and a look at the first character skips most places quickly.
MONTH, TH = f"(?i:{MONTHS})", "(?i:st|nd|rd|th)?"
APART = "[0-9][-/.][0-9]{1,2}[-/.][0-9]"
DATES = (
    (rf"([0-9]{{4}}){S}*年{S}*([0-9]{{1,2}}){S}*月{S}*([0-9]{{1,2}}){S}*[日號号]?", (1, 2, 3), "年"),
    (rf"(?=[0-9]){LEFT}([0-9]{{4}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{1,2}}){RIGHT}", (1, 2, 3), APART),
    (rf"(?=[0-9]){LEFT}([0-9]{{1,2}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{4}}){RIGHT}", (3, 1, 2), APART),
    (rf"(?=[ADFJMNOSadfjmnos]){LEFT}({MONTH})\.?{S}+([0-9]{{1,2}}){TH},?{S}+([0-9]{{4}}){RIGHT}", (3, 1, 2), "[A-Za-z]{3}"),
    (rf"(?=[0-9]){LEFT}([0-9]{{1,2}}){TH}{S}+({MONTH})\.?{S}+([0-9]{{4}}){RIGHT}", (3, 2, 1), "[A-Za-z]{3}"),
)
PERCENT = rf"{NUMBER}{S}*%"
AMOUNT = rf"(?=[-+0-9$¥￥€£])(?:[$¥￥€£]{S}*{NUMBER}|{NUMBER}{S}*(?i:{UNITS}))"
PAID = rf"[0-9]{S}*(?i:{UNITS})|[$¥￥€£]"


def _all(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), group)


def _where(x: Column, sign: str, found: Column) -> Column:
    """The facts found in a text that has their sign, a character or a pattern; most texts lack most signs."""
    has = x.contains(sign) if len(sign) == 1 else x.rlike(sign)
    return F.when(has, found).otherwise(F.array().cast("array<struct<source:string,normalized:string>>"))


def _month(m: Column) -> Column:
    names = F.create_map(*(F.lit(v) for pair in MONTH_NUMBER.items() for v in pair))
    return F.coalesce(F.try_element_at(names, F.lower(F.substring(m, 1, 3))), m.try_cast("int"))


def _fact(source: Column, normalized: Column) -> Column:
    return F.struct(source.alias("source"), normalized.alias("normalized"))


def once(facts: Column) -> Column:
    """One fact for each normalized value: the first's place, the last's source.

    ``facts`` should be a column, not an expression: it is read for every value.
    """
    keys = F.array_distinct(F.transform(facts, lambda f: f["normalized"]))
    return F.when(F.size(facts) >= 0, F.transform(keys, lambda k: _fact(F.element_at(F.filter(facts, lambda f: f["normalized"] == k), -1)["source"], k)))


def dates(x: Column | str) -> Column:
    """Each pattern is looked for once; the parts are taken from its short matches."""
    found = []
    for pattern, groups, sign in DATES:
        part = lambda s, g: F.regexp_extract(s, pattern, g)  # noqa: B023, E731
        parts = F.transform(_all(col(x), pattern), lambda s: F.struct(s.alias("s"), *(part(s, g).alias(n) for n, g in zip("ymd", groups))))  # noqa: B023
        ok = F.filter(parts, lambda p: _month(p["m"]).between(1, 12) & p["d"].cast("int").between(1, 31))
        found.append(_where(col(x), sign, F.transform(ok, lambda p: _fact(p["s"], F.concat(F.lit("date:"), p["y"], F.lit("-"), F.lpad(_month(p["m"]).cast("string"), 2, "0"), F.lit("-"), F.lpad(p["d"].cast("int").cast("string"), 2, "0"))))))
    return F.concat(*found)


def percentages(x: Column | str) -> Column:
    return _where(col(x), "%", F.transform(_all(col(x), PERCENT), lambda s: _fact(s, F.concat(F.lit("percentage:"), sub(s, f"[{SPACE},]", "")))))


def amounts(x: Column | str) -> Column:
    return _where(col(x), PAID, F.transform(_all(col(x), AMOUNT), lambda s: _fact(s, F.concat(F.lit("currency:"), F.replace(F.regexp_extract(s, NUMBER, 0), F.lit(","), F.lit(""))))))


def numbers(x: Column | str) -> Column:
    return F.transform(_all(col(x), NUMBER), lambda s: _fact(s, F.concat(F.lit("number:"), F.replace(s, F.lit(","), F.lit("")))))


def _keys(facts: Column) -> Column:
    return F.transform(facts, lambda f: f["normalized"])


def _value(fact: Column) -> Column:
    return F.regexp_replace(fact["normalized"], "^[a-z]+:", "")


def with_facts(df, source: str, target: str):
    """The rows with ``facts``: every fact of the source text, checked against the target text.

    Numbers come last and skip those inside earlier facts, which are looked at
    without their sign. Each step's arrays are columns of their own (and asked
    for their size), so that no lambda computes them again for every element.
    """
    parts = {"d": ("date", dates), "p": ("percentage", percentages), "c": ("currency", amounts), "n": ("number", numbers)}
    sides = {"s": source, "t": target}
    wide = df.withColumns({f"_{side}": half_width(text) for side, text in sides.items()})
    wide = wide.withColumns({f"_s{k}": f("_s") for k, (_, f) in parts.items()}).drop("_s")
    wide = wide.withColumns({f"_s{k}": once(F.col(f"_s{k}")) for k in parts})
    # of the target only the values count, and only of kinds that the source has
    keys = {f"_k{k}": _keys(f("_t")) for k, (_, f) in parts.items()}
    wide = wide.withColumns({c: v if c == "_kn" else F.when(F.size(f"_s{c[-1]}") > 0, v).otherwise(F.array().cast("array<string>")) for c, v in keys.items()}).drop("_t")
    inner = F.flatten(F.concat(*(F.transform(f"_s{k}", lambda f: F.transform(_all(f["source"], "[0-9]+(?:[,.][0-9]+)*"), lambda n: F.replace(n, F.lit(","), F.lit("")))) for k in "dpc")))
    wide = wide.withColumn("_inner", inner)

    def judged(kind: str, facts: Column, matched) -> Column:
        return F.transform(facts, lambda f: F.struct(F.lit(kind).alias("kind"), f["source"].alias("source"), f["normalized"].alias("normalized"), matched(f).alias("matched")))

    def either(k: str):
        return lambda f: F.array_contains(f"_k{k}", f["normalized"]) | F.array_contains("_kn", F.concat(F.lit("number:"), _value(f)))

    out = [judged(parts[k][0], F.col(f"_s{k}"), either(k)) for k in "dpc"]
    fresh = F.filter("_sn", lambda f: ~F.array_contains("_inner", _value(f)))
    out.append(judged("number", fresh, lambda f: F.array_contains("_kn", f["normalized"])))
    sized = F.size("_inner") + sum((F.size(f"_k{k}") for k in parts), F.lit(0)) >= 0
    return wide.withColumn("facts", F.when(sized, F.concat(*out))).drop("_inner", *(f"_{x}{k}" for x in "sk" for k in parts))
