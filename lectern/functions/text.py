"""Text rules as column expressions.

Lengths count UTF-16 units, white space and trimming are Unicode's, and word
edges are ASCII's, as the corpora's first consumers count them; Spark's own
functions differ in all three, so everything else builds on these.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space inside a regular expression's class.
SPACE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same characters.
SPACES = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
HAN = r"\p{IsHan}"
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sub(x: Column | str, pattern: str, by: str) -> Column:
    return F.regexp_replace(col(x), F.lit(pattern), F.lit(by))


def trim(x: Column | str) -> Column:
    return F.btrim(col(x), F.lit(SPACES))


def trim_end(x: Column | str) -> Column:
    return F.rtrim(col(x), F.lit(SPACES))


def _is_ascii(x: Column) -> Column:
    """One byte a character."""
    return F.octet_length(x) == F.length(x)


def units(x: Column | str) -> Column:
    """Length in UTF-16 units."""
    t = col(x)
    return F.when(_is_ascii(t), F.length(t)).otherwise(F.length(t) + F.regexp_count(t, F.lit(r"[\x{10000}-\x{10FFFF}]")))


def is_blank(x: Column | str) -> Column:
    return trim(F.coalesce(col(x), F.lit(""))) == ""


def half_width(x: Column | str, space: bool = False) -> Column:
    """Full-width ASCII to ASCII; with ``space`` the ideographic space too."""
    return F.translate(col(x), WIDE + ("　" if space else ""), NARROW + (" " if space else ""))


def han_count(x: Column | str, script: str = HAN) -> Column:
    count = F.regexp_count(col(x), F.lit(script))
    return F.when(_is_ascii(col(x)), F.lit(0)).otherwise(count) if script == HAN else count


def is_reasonable_english(x: Column | str) -> Column:
    """Under 3 units no, under 20 yes, else at least 30 % ASCII letters."""
    n = units(x)
    letters = F.length(sub(x, "[^A-Za-z]", ""))
    return F.coalesce(F.when(n < 3, False).when(n < 20, True).otherwise(letters / F.greatest(n, F.lit(1)) >= 0.3), F.lit(False))


def unix_lines(x: Column | str) -> Column:
    return F.replace(col(x), F.lit("\r\n"), F.lit("\n"))


def _if_ragged(x: Column, tidy: Column) -> Column:
    """The tidied text where there is something to tidy: most texts need no regular expression."""
    return F.when(x.contains("\r\n") | x.contains("\n\n\n") | x.contains(" \n") | x.contains("\t\n"), tidy).otherwise(x)


def normal_chunk(x: Column | str) -> Column:
    """Blank lines to one, then trailing blanks off."""
    return trim(_if_ragged(col(x), sub(sub(unix_lines(x), r"\n{3,}", "\n\n"), r"[ \t]+\n", "\n")))


def normal_notes(x: Column | str) -> Column:
    """Trailing blanks off, then blank lines to one."""
    return trim(_if_ragged(col(x), sub(sub(unix_lines(x), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")))


def normal_extracted(x: Column | str) -> Column:
    return normal_notes(F.replace(col(x), F.lit(" "), F.lit(" ")))


def normal_page(x: Column | str) -> Column:
    """As extracted text, and runs of blanks to one space."""
    spaced = sub(unix_lines(F.replace(col(x), F.lit(" "), F.lit(" "))), r"[ \t]+\n", "\n")
    return trim(sub(sub(spaced, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def source_lines(x: Column | str) -> Column:
    """Lines without outer white space, empty ones dropped."""
    lines = F.split(unix_lines(x), "\n", -1)
    bare = F.transform(lines, lambda s: F.ltrim(F.rtrim(s, F.lit(" \t\u3000")), F.lit(SPACES)))
    return F.filter(bare, lambda s: s != "")


def lines_of(x: Column | str) -> Column:
    """Trimmed non-empty lines."""
    return F.filter(F.transform(F.split(col(x), "\n", -1), trim), lambda s: s != "")


def paragraphs_of(x: Column | str) -> Column:
    """Trimmed non-empty parts between blank lines."""
    return F.filter(F.transform(F.split(col(x), rf"\n[{SPACE}]*\n", -1), trim), lambda s: s != "")


# Note marks and punctuation that spacing is cleaned around.
NOTE_MARK = r"\x{B9}\x{B2}\x{B3}\x{2070}-\x{2079}\x{2460}-\x{24FF}\x{2776}-\x{277F}"
CLOSING = "。！？；：，、）】》〉」』"
TIGHT_BEFORE = "，。！？；：、,.!?;:）】》〉」』"
TIGHT_AFTER = "（【《〈「『"


#: Runs of spaces that go: by the character before them and the one behind. Each run stands between the same two
#: characters whatever happens to others, so one pass sees all; the first test skips all other places quickly.
LOOSE = (
    rf"(?= )(?:(?<={HAN}) +(?=[{HAN}A-Za-z0-9{NOTE_MARK}])|(?<=[A-Za-z]) +(?={HAN})|(?<=[0-9]) +(?=[{HAN}0-9])"
    rf"|(?<=[{CLOSING}]) +(?=[{NOTE_MARK}])|(?<=[{NOTE_MARK}]) +(?={HAN})|(?<=[{TIGHT_AFTER}]) +| +(?=[{TIGHT_BEFORE}]))"
)


def clean_cjk(x: Column | str) -> Column:
    """Spacing that extraction left between CJK characters, digits, marks and punctuation removed."""
    t = sub(sub(unix_lines(half_width(x, space=True)), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    t = F.array_join(F.transform(F.split(sub(t, LOOSE, ""), "\n", -1), trim), "\n")
    return F.coalesce(trim(sub(t, r"\n{3,}", "\n\n")), F.lit(""))


# How headings, sentence ends and list items look.
HEADING = r"\A(?:第[一二三四五六七八九十百零〇0-9]+[章節节回部篇條条]|[一二三四五六七八九十]+[、.．]|（[一二三四五六七八九十0-9]+）|\([一二三四五六七八九十0-9]+\))"
ENDS = r"[。！？!?；;：:，,、）)】》」』.]\z"
LIST_ITEM = rf"\A(?:[0-9]{{1,3}}[.、)）]|\([0-9一二三四五六七八九十]+\)|（[0-9一二三四五六七八九十]+）|[①-⑳]|[•·‧・‣▪◦*-][{SPACE}])"


def is_heading(line: Column | str) -> Column:
    t = trim(line)
    n = units(t)
    return (n > 0) & (n <= 30) & (t.rlike(HEADING) | ((n <= 18) & ~t.rlike(ENDS)))


def line_kind(text: Column | str) -> Column:
    """heading, list or paragraph."""
    lines = lines_of(text)
    one = (F.size(lines) == 1) & is_heading(F.get(lines, F.lit(0)))
    items = (F.size(lines) > 1) & F.forall(lines, lambda s: s.rlike(LIST_ITEM))
    return F.when(one, "heading").when(items, "list").otherwise("paragraph")


def short_hash(x: Column | str) -> Column:
    """FNV-1a, 32 bits, over UTF-16 units, in base 36. An index only: join on full values."""
    codes = F.regexp_extract_all(F.hex(F.encode(col(x), "UTF-16BE")), F.lit("([0-9A-F]{4})"), 1)
    step = lambda a, c: ((a.bitwiseXOR(F.conv(c, 16, 10).cast("long"))) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long"))
    return F.lower(F.conv(F.aggregate(codes, F.lit(2166136261).cast("long"), step).cast("string"), 10, 36))
