"""Names of people, bodies, places and titles; glossaries made of them.

Dictionaries and the script are inputs: ``names`` is a table (kind, word) of
first characters of people's names (person) and of words that mark bodies,
places and titles (organization, place, title), with ``n``, their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import HAN, SPACE, col, is_blank, lines_of, sub, trim, units
from lectern.operators import grams
from lectern.sources.shared import kept

KINDS = ("person", "organization", "place", "title", "term", "other")
# What separates tokens, windows around marking words, and places too general to keep.
BREAKS = rf"[，。！？；：、{SPACE}「」『』（）【】《》“”‘’\"]"
EDGES = rf"[，。！？；：、{SPACE}]+"
WINDOW = {"organization": (8, 8, 20), "place": (6, 4, 14), "title": (10, 0, 14)}
GENERAL = ("省市", "省市縣", "省市區", "縣市", "市區", "鄉鎮", "村里", "山區", "山腳", "山頂", "海邊", "海灣")
NOT_NAMES = ("生", "氏")


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    lines = docs.select(key, F.posexplode_outer(F.transform(F.split(text, "\n", -1), trim)).alias("line_no", "line"))
    return lines.where((F.col("line") != "") & ~F.startswith(F.col("line"), F.lit("http")))


#: Words of a dictionary up to which it is read into the plan; a larger one is joined.
FEW_WORDS = 2_000


def people(lines: DataFrame, key: str, names: DataFrame, script: str = HAN) -> DataFrame:
    """Tokens of 2 to 5 characters that start with a name's first character, the rest in the script."""
    first = names.where("kind = 'person'").select(F.col("word").alias("_f")).distinct()
    tokens = lines.select(key, "line_no", F.posexplode_outer(F.split("line", BREAKS, -1)).alias("pos", "t")).withColumn("t", trim("t")).where(units("t").between(2, 5))
    starts = [r[0] for r in first.limit(FEW_WORDS + 1).collect()]
    tokens = tokens.withColumn("_f", F.substring("t", 1, 1))
    found = tokens.where(F.col("_f").isin(starts)) if len(starts) <= FEW_WORDS else tokens.join(first, "_f")
    found = found.where(F.substring("t", 2, 9).rlike(rf"\A{script}+\z"))
    found = found.where(~((F.length("t") == 2) & F.substring("t", 2, 1).isin(*NOT_NAMES)))
    return found.select(key, "line_no", F.lit(0).alias("rank"), F.lit(0).alias("n"), "pos", F.col("t").alias("surface"))


def _around(text: Column, word: Column, script: str) -> Column:
    """The run of the script around the first place of the word, the word itself kept whole."""
    at = F.position(word, text)
    left = F.regexp_extract(F.substring(text, F.lit(1), at - 1), rf"({script}*)\z", 1)
    right = F.regexp_extract(F.substring(text, at + F.length(word), F.length(text)), rf"\A({script}*)", 1)
    return F.concat(left, word, right)


def places(lines: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """(key, line_no, line, kind, word, n, at): every place of every word in every line."""
    few = words.limit(FEW_WORDS + 1).collect()
    if len(few) > FEW_WORDS:
        return walked(lines, key, words)
    # a dictionary of bounded size: words that a line holds, then their places there
    known = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.word).alias("word"), F.lit(r.n).alias("n")) for r in few)) if few else F.array().cast("array<struct<kind:string,word:string,n:int>>")
    hits = lines.select(key, "line_no", "line", F.explode(F.filter(known, lambda w: F.col("line").contains(w["word"]))).alias("_w")).select(key, "line_no", "line", "_w.*")
    starts = F.filter(F.sequence(F.lit(1), F.length("line")), lambda i: F.substring(F.col("line"), i, F.length("word")) == F.col("word"))
    return hits.select("*", F.explode_outer(starts).alias("at")).where("at is not null")


def trie(words: DataFrame) -> DataFrame:
    """(state, depth, ends): the prefixes of all words, each the state that its characters lead to from the one before it."""
    spelled = words.where("word <> ''").select("word").distinct()
    prefixes = spelled.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.struct(F.substring("word", 1, i).alias("state"), i.alias("depth"), (i == F.length("word")).alias("ends")))).alias("s"))
    return prefixes.groupBy("s.state", "s.depth").agg(F.max("s.ends").alias("ends"))


def walked(lines: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """The same for a dictionary of any size: from every place of a line the words' trie is walked until it fails.

    A round takes one character: places whose next character leads on stay, the
    others go, so most go in the first rounds, however long the longest word is.
    Places carry no more of their line than a word may take; the lines come back
    to the words that were found.
    """
    states = kept(trie(words))
    longest = states.agg(F.max("depth")).first()[0] or 0
    named = kept(lines.select(key, "line_no", "line").withColumn("_line", F.monotonically_increasing_id()))
    at = named.select("_line", F.explode(F.transform(F.sequence(F.lit(1), F.length("line")), lambda i: F.struct(i.alias("at"), F.substring(F.col("line"), i, F.lit(longest)).alias("rest")))).alias("p")).select("_line", "p.*")
    found = None
    for depth in range(1, longest + 1):
        level = states.where(F.col("depth") == depth).select("state", "ends")
        at = at.withColumn("state", F.substring("rest", 1, depth)).where(F.length("state") == depth).join(level, "state")
        own = at.where("ends").select("_line", "at", F.col("state").alias("word"))
        found = own if found is None else found.unionByName(own)
        at = at.drop("state", "ends")
        if depth % 4 == 0:  # else the plan of a round repeats all rounds before it
            at = kept(at)
            if at.isEmpty():
                break
    if found is None:
        found = named.select("_line", F.lit(0).alias("at"), F.lit("").alias("word")).limit(0)
    return found.join(words, "word").join(named, "_line").drop("_line")


def marked(lines: DataFrame, key: str, names: DataFrame, script: str = HAN) -> DataFrame:
    """Phrases around every place of a marking word, with that word's rank and order; one pass for all kinds."""
    words = names.where(F.col("kind").isin(*WINDOW) & (F.col("word") != "")).select("kind", "word", F.col("n").cast("int").alias("n"))
    hits = places(lines, key, words)
    kind, word = F.col("kind"), F.col("word")
    by_kind = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, w in WINDOW.items() for x in (k, w[i]))), kind)
    start = F.greatest(F.lit(1), F.col("at") - by_kind(0))
    part = trim(F.substring(F.col("line"), start, F.col("at") + F.length(word) + by_kind(1) - start))
    bare = F.when(kind == "place", sub(sub(part, rf"\A{EDGES}", ""), rf"{EDGES}\z", "")).when(kind == "title", sub(part, rf"\A(?:(?!{script}).)+", "")).otherwise(part)
    # explode_outer: filters on a plain column would compute it once for each
    rows = hits.withColumn("_p", F.explode_outer(F.array(bare))).where((F.regexp_count("_p", F.lit(script)) >= F.when(kind == "title", 1).otherwise(2)) & (units("_p") <= by_kind(2)))
    around = F.when((kind != "title") & F.col("_p").contains(word), _around(F.col("_p"), word, script)).otherwise(F.col("_p"))
    rows = rows.withColumn("surface", F.explode_outer(F.array(around)))
    size = units("surface")
    fits = F.when(kind == "title", F.col("_p").rlike(rf"\A{script}+\z")).when(kind == "organization", size.between(2, 18)).otherwise((size >= 3) & ~F.col("surface").isin(*GENERAL))
    rank = F.array_position(F.array(*map(F.lit, WINDOW)), kind).cast("int")
    return rows.where(fits).select(key, "line_no", rank.alias("rank"), "n", F.col("at").alias("pos"), trim("surface").alias("surface")).where(units("surface") >= 2)


def extract(docs: DataFrame, key: str, names: DataFrame, text: str = "text", script: str = HAN) -> DataFrame:
    """(key, surface, type) of each document: the first kind to find a surface has it; parts of longer ones of its kind go."""
    lines = _lines(docs, key, text)
    found = people(lines, key, names, script).unionByName(marked(lines, key, names, script))
    kinds = F.array(*map(F.lit, KINDS))
    first = found.groupBy(key, "surface").agg(F.min(F.struct("line_no", "rank", "n", "pos")).alias("f"))
    return without_parts(first.select(key, "surface", F.get(kinds, F.col("f.rank")).alias("type")), key, least=2)


#: Entities of a document and type that are compared in one row; more of them meet under rare grams.
FEW_ENTITIES = 32


def without_parts(entities: DataFrame, key: str, least: int = 1) -> DataFrame:
    """Distinct entities that no longer entity of their document and type contains; shorter ones than ``least`` are not looked for.

    Surfaces may be of any length and number. One shuffle brings a document's
    together; where a type has few they are one row and are compared in it, where
    it has more they stay rows that meet under rare grams.
    """
    group = [key, "type"]
    own = entities.select(*group, "surface").repartition(*group).distinct()
    sized = own.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    many = F.col("_n") > FEW_ENTITIES
    # collect_list leaves out nulls, but not structs of them
    gathered = kept(sized.groupBy(*group, many.alias("_many"), F.when(many, F.col("surface")).alias("_own")).agg(F.collect_list(F.struct("surface")).alias("_s")).drop("_own"))
    holds = lambda a, b: (F.length(b["surface"]) > F.length(a["surface"])) & F.contains(b["surface"], a["surface"])
    whole = F.filter("_s", lambda a: (F.coalesce(F.length(a["surface"]), F.lit(0)) < max(least, 1)) | ~F.exists("_s", lambda b: F.coalesce(holds(a, b), F.lit(False))))
    few = gathered.where(~F.col("_many")).select(*group, F.explode(whole).alias("_w")).select(*group, "_w.surface")
    rest = gathered.where("_many").select(*group, F.explode("_s").alias("_w")).select(*group, "_w.surface")
    if rest.isEmpty():
        return few
    parts = grams.inner(rest, group, "surface", least)
    same = F.lit(True)
    for c in (*group, "surface"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return few.unionByName(rest.alias("a").join(parts.alias("b"), same, "left_anti"))


def in_order(entities: DataFrame, locale: str = "zh_Hans_CHN") -> DataFrame:
    """By kind, then by surface as the locale sorts; for showing only."""
    return entities.orderBy(F.array_position(F.array(*map(F.lit, KINDS)), F.col("type")), F.collate("surface", locale))


def kind_of(raw: Column | str) -> Column:
    """A free-text kind as one of ours, by the first of these words it holds."""
    t = trim(F.lower(col(raw)))
    has = lambda *words: F.coalesce(t.rlike("|".join(words)), F.lit(False))
    return F.when(has("person"), "person").when(has("place", "location"), "place").when(has("org", "institution"), "organization").when(has("title", "role"), "title").when(has("term", "concept"), "term").otherwise("other")


def from_response(responses: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Entities in a service's JSON answers, code fences taken off; what does not parse gives none."""
    bare = trim(sub(sub(col(body), rf"\A```json[{SPACE}]*", ""), rf"[{SPACE}]*```\z", ""))
    items = F.from_json(bare, "array<struct<chinese:string,english:string,type:string>>")
    rows = responses.select(*keys, F.explode_outer(items).alias("i")).select(*keys, trim("i.chinese").alias("surface"), F.nullif(trim("i.english"), F.lit("")).alias("gloss"), kind_of("i.type").alias("type"))
    return rows.where(F.coalesce(units("surface") >= 2, F.lit(False)))


def merge_glosses(known: DataFrame, new: DataFrame) -> DataFrame:
    """Known entities with new glosses where there are any; unknown ones added; known types stay."""
    n = new.select("surface", F.col("gloss").alias("_g"), F.col("type").alias("_t"))
    both = known.join(n, "surface", "full_outer")
    return both.select("surface", F.coalesce(F.nullif("_g", F.lit("")), "gloss").alias("gloss"), F.coalesce("type", "_t").alias("type"))


def merge_glossary(glossary: DataFrame, entities: DataFrame) -> DataFrame:
    """Locked and confirmed entries stay; others take the entity's gloss if it has one; new entities come unlocked."""
    e = entities.select(F.col("surface").alias("term"), F.nullif("gloss", F.lit("")).alias("_g"))
    both = glossary.withColumn("_own", F.lit(True)).join(e, "term", "full_outer")
    fixed = F.coalesce(F.col("locked") | F.col("confirmed"), F.lit(False))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return both.select("term", F.when(fixed, F.col("gloss")).otherwise(F.coalesce("_g", "gloss", F.lit(""))).alias("gloss"), no("locked"), no("confirmed"))


def locked(glossary: DataFrame, order: str = "pos") -> DataFrame:
    """(term, gloss) of locked terms; of a term's entries the last counts."""
    return glossary.where(F.col("locked") & ~is_blank("gloss") & ~is_blank("term")).groupBy("term").agg(F.max_by("gloss", order).alias("gloss"))


def locked_map(glossary: DataFrame, order: str = "pos") -> DataFrame:
    """The same as one row with a map, for a caller who needs a small glossary whole."""
    return locked(glossary, order).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "gloss")))).alias("locked"))


def imported_json(files: DataFrame, keys: list[str], content: str = "content", most: int = 500, largest: int = 1_000_000) -> DataFrame:
    """Glossary entries of each file that holds a JSON array of (chinese, english, locked), the form that is exported.

    The first 500 elements count. Of these, the ones that are objects with a
    string ``chinese`` that is not blank become entries, texts trimmed and cut: an
    ``english`` that is no string is empty, and only a ``locked`` that is false
    unlocks. Entries are confirmed; the last one of a term wins. Files over a
    million bytes, and what does not parse or is no array, give none.
    """
    fits = F.when(F.octet_length(content) <= largest, F.col(content))
    # every element by itself: one of another type spoils only itself
    items = F.try_variant_get(F.try_parse_json(fits), "$", "array<variant>")
    rows = files.select(*keys, F.posexplode(F.slice(items, 1, most)).alias("pos", "i"))
    kind = lambda name: F.schema_of_variant(F.try_variant_get("i", f"$.{name}", "variant"))
    word = lambda name, size: F.left(trim(F.when(kind(name) == "STRING", F.try_variant_get("i", f"$.{name}", "string")).otherwise(F.lit(""))), F.lit(size))
    unlocked = F.coalesce((kind("locked") == "BOOLEAN") & ~F.try_variant_get("i", "$.locked", "boolean"), F.lit(False))
    found = rows.where(F.startswith(F.schema_of_variant("i"), F.lit("OBJECT"))).select(*keys, "pos", word("chinese", 200).alias("term"), word("english", 500).alias("gloss"), (~unlocked).alias("locked"))
    return _last_of_term(found, keys)


def _last_of_term(rows: DataFrame, keys: list[str]) -> DataFrame:
    last = rows.where("term <> ''").groupBy(*keys, "term").agg(F.max_by(F.struct("gloss", "locked"), "pos").alias("r"))
    return last.select(*keys, "term", "r.gloss", "r.locked", F.lit(True).alias("confirmed"))


def imported(lines: DataFrame, most: int = 500) -> DataFrame:
    """Glossary entries of CSV lines (pos from 0, line): the first line, the header, and empty ones off; the first 500 of the rest, trimmed and cut.

    Entries are locked and confirmed; the last one of a term wins. The lines are
    one file's, which a caller keeps to a million bytes.
    """
    cells = F.transform(F.split("line", ",", -1), lambda c: sub(trim(c), r"\A\"|\"\z", ""))
    rows = lines.where((F.col("pos") > 0) & (F.regexp_replace("line", r"\r\z", "") != "")).orderBy("pos").limit(most).withColumn("_c", cells)
    cell = lambda i: F.coalesce(F.get("_c", F.lit(i)), F.lit(""))
    return _last_of_term(rows.select("pos", F.left(trim(cell(0)), F.lit(200)).alias("term"), F.left(trim(cell(1)), F.lit(500)).alias("gloss"), F.lit(True).alias("locked")), [])
