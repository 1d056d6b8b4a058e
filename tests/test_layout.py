"""Blocks, notes, margins, placed text and files against goldens."""

import io
import zipfile

from pyspark.sql import functions as F

from lectern.operators import entities, jobs, layout, outcomes
from lectern.plans import sources
from lectern.sources import files


def block(spark, value):
    r = layout.blocks(spark.createDataFrame([(value,)], "text string")).collect()
    return r[0].block if r else None


def test_blocks(spark):
    b = block(spark, "a|b\n---|---\n1|2|3\nx\n4|")
    assert (b.type, b.headers, b.rows) == ("table", ["a", "b"], [["1", "2"], ["4", ""]])
    b = block(spark, "1,2\n3,4")
    assert (b.headers, b.rows) == (["Column 1", "Column 2"], [["1", "2"], ["3", "4"]])
    assert block(spark, "one two three four five six seven eight nine, a b c d e f g h i\nx, y").type == "paragraph"
    assert block(spark, "┌─┐\n│a│").kind == "table"
    assert block(spark, "a: 1\nb: 2").kind == "chart"
    assert block(spark, "a:   1\nb:   2").kind == "table"  # both signals
    assert block(spark, "  ") is None
    assert block(spark, None) is None


def notes(spark, value):
    r = layout.split_notes(spark.createDataFrame([(1, value)], "id int, text string"), "id").first()
    return r.body, [(n.marker, n.content) for n in r.notes]


def test_english_notes(spark):
    assert notes(spark, "body\n\nFootnotes\n[1] a\nb\n2) c") == (["body"], [("[1]", "a b"), ("2)", "c")])
    assert notes(spark, "a\n\nb\n\nc\n\n1. x\n\n2. y\n\nmore") == (["a", "b", "c"], [("1.", "x"), ("2.", "y more")])
    assert notes(spark, "1. x\n\n2. y") == (["1. x", "2. y"], [])  # two paragraphs only
    assert notes(spark, "1. x\n\na\n\nb\n\n2. y\n\n3. z") == (["1. x", "a", "b", "2. y", "3. z"], [])  # first too early
    assert notes(spark, "a\n\nb\n\n1. x\n\nc\n\n2. y")[1] == []  # none adjacent
    assert notes(spark, "a\n\nb\n\n1. x\nline\n\n2. y")[1] == []  # a marked paragraph is one line
    assert notes(spark, None) == ([], [])


def test_chinese_notes(spark):
    run = lambda t: layout.split_cn_notes(spark.createDataFrame([(1, t)], "id int, text string"), "id").first()
    r = run("甲\n\n乙\n註釋：\n①一\n续")
    assert (r.body, [(n.marker, n.content) for n in r.notes]) == (["甲\n乙"], [("①", "一续")])
    assert run("註釋\n①一").notes == []  # no body
    assert run("1.a\n2.b\n甲\n乙\n丙\n丁").notes == []  # run too early
    assert run("甲\n乙\n丙\n1.a\n2.b").body == ["甲\n乙\n丙"]


def test_margins(spark):
    rows = [(1, p, f"Head\n \ntext {p}\nHead\nfoot") for p in range(1, 6)] + [(2, p, "Head\nx") for p in (1, 2)] + [(3, p, "a\n" + "y" * 161) for p in range(1, 4)]
    pages = spark.createDataFrame(rows, "doc_id int, page_number int, text string")
    got = {(r.doc_id, r.page_number): r.text for r in layout.without_margins(pages, "doc_id").collect()}
    assert got[1, 2] == "text 2" and got[2, 1] == "Head\nx" and got[3, 1] == "a\n" + "y" * 161


def test_scan_fallback(spark):
    d = spark.createDataFrame([(4, [4, 1, 3, 1], "Text extraction failed."), (2, [], "This PDF is password-protected."), (1, [1], "x"), (3, [1, 2, 3], "x")], "total_pages int, renderable array<int>, source_error string")
    a, b, c, e = outcomes.scan_fallback(d).collect()
    assert a.pages == [1, 3, 4] and "3 of 4 pages can still be rendered" in a.message and "1 unreadable page was skipped" in a.message
    assert (b.kind, b.message) == ("error", "This PDF is password-protected. OCR fallback could not render any pages.")
    assert "The page can still" in c.message and "All 3 pages" in e.message


def test_pdf_header(spark):
    d = spark.createDataFrame([(bytearray(b"This is not a PDF file."),), (bytearray(b"  %PDF-1.7"),), (bytearray(b"x" * 2000 + b"%PDF-"),)], "content binary")
    assert [r[0] for r in d.select(files.looks_like_pdf("content")).collect()] == [False, True, False]


def test_html():
    assert files.html_text("<h2>A</h2><ul><li>x</li></ul><table><tr><td>1</td><td>2</td></tr></table>a<br>b<script>no</script>") == "\n## A\n\n- x\n\n\n1\t2\n\na\n\nb"


def item(s, x, y, **k):
    return {"str": s, "x": x, "y": y, "width": 10.0, "height": 10.0, "has_eol": False} | k


def test_placed_text(spark):
    pages = {
        1: [item("b", 100, 50), item("a", 0, 50.5), item("word", 0, 38), item("gap", 14, 38), item("far", 0, 10)],
        2: [item("a", None, 1), item("b", None, 1, has_eol=True)],
        # a tall item widens its line; equal places keep their order; no width and no height have defaults
        3: [item("T", 0, 100, height=40.0), item("low", 20, 84, height=40.0), item("x", 0, 60, width=None, height=None), item("y", 0, 60), item(" ", 5, 60), item("nan", float("nan"), 60), item("z.", 12, 60), item("end", 16, 60)],
    }
    schema = "page int, item_no int, str string, has_eol boolean, x double, y double, width double, height double"
    number = lambda v: None if v is None else float(v)
    rows = [(p, i, r["str"], r["has_eol"], *(number(r[k]) for k in ("x", "y", "width", "height"))) for p, items in pages.items() for i, r in enumerate(items)]
    got = {r.page: r.text for r in files.placed_texts(spark.createDataFrame(rows, schema), ["page"]).collect()}
    assert got == {1: "a\tb\nword gap\n\nfar\n", 2: "a b\n", 3: "T low\n\nxyz.end\n"}
    assert files.page_texts(spark.createDataFrame(rows, schema), ["page"]).where("page = 1").first().text == "a\tb\nword gap\n\nfar"
    as_rows = spark.createDataFrame(rows, schema).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("item_no", "str", "has_eol", "x", "y", "width", "height"))).alias("items"))
    assert {r.page: r.text for r in files.row_texts(as_rows, ["page"]).collect()} == got


def test_words_of_rebuilt_pages_stay_in_their_rows(spark, sf):
    """Nothing is grouped: the only shuffle deals out orders."""
    plan = sources.rebuilt_pages(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan and plan.count("Repartition") == 1


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def test_office_files(spark):
    w = 'xmlns:w="w"'
    docx = zipped(**{"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>i</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    epub = zipped(**{"META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p><item id="b" href="b.x"/><item id="a" href="../a.x"/><itemref idref="a"/><itemref idref="b"/></p>', "a.x": "<html><body><p>first</p></body></html>", "o/b.x": "<body>second</body>"})
    slide = lambda t: f'<s xmlns:a="a"><a:p><a:pPr><a:buChar/></a:pPr><a:t>{t}</a:t></a:p></s>'
    pptx = zipped(**{"ppt/presentation.xml": '<p xmlns:r="r"><sldId r:id="x"/><sldId r:id="y"/></p>', "ppt/_rels/presentation.xml.rels": '<R><Relationship Id="x" Target="s1.xml"/><Relationship Id="y" Target="s2.xml"/></R>', "ppt/s1.xml": slide(""), "ppt/s2.xml": slide("z")})
    damaged = bytearray(docx)
    damaged[40:60] = bytes(20)
    rows = [("d", "docx", docx), ("e", "epub", epub), ("p", "pptx", pptx), ("bad", "docx", b"no"), ("empty", "pptx", zipped(x="y")), ("new", "pdf", b"%PDF-"), ("none", None, b""), ("cut", "docx", bytes(damaged))]
    units = files.office_units(spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in rows], "path string, format string, content binary")).cache()
    pages = {(r.path, r.page_number): r.text for r in files.office_pages(units).collect()}
    assert pages == {("d", 1): "## T\n\n- i\n\n1\t2", ("e", 1): "first", ("e", 2): "second", ("p", 2): "- z"}
    errors = {r.path: r.error for r in units.where("error is not null").collect()}
    assert set(errors) == {"bad", "empty", "new", "none", "cut"} and errors["new"] == errors["none"] == files.UNKNOWN and errors["cut"] == files.DAMAGED and units.where("path = 'p'").first().total == 2


def test_entities(spark):
    names = spark.createDataFrame([("person", "張", 0), ("person", "王", 1), ("organization", "公司", 0), ("place", "市", 0), ("title", "先生", 0)], "kind string, word string, n int")
    docs = spark.createDataFrame([(1, "張三丰。王生。王氏 張甲乙丙丁戊。大華公司、華公司\nhttp 王五\n台北市。縣市。\na王先生"), (2, None)], "id int, text string")
    got = {(r.surface, r.type) for r in entities.extract(docs, "id", names).collect()}
    assert got == {("張三丰", "person"), ("大華公司", "organization"), ("台北市", "place"), ("王先生", "title")}
    shown = [r.surface for r in entities.in_order(spark.createDataFrame([("李", "person"), ("王", "person"), ("张", "person"), ("甲", "title")], "surface string, type string")).collect()]
    assert shown == ["李", "王", "张", "甲"]


def test_attempts(spark):
    zh = "一" * 25
    rows = [
        (1, 0, 200, ""), (1, 1, 200, "good text"), (2, 0, 200, zh), (2, 1, 200, "fine English text right here"), (3, 0, 200, zh), (3, 1, 200, zh), (3, 2, 200, zh),
        (4, 0, 400, None), (4, 1, 200, "late"), (5, 0, 429, None), (5, 1, 200, "good"), (6, 0, 200, ""), (6, 1, 200, ""), (6, 2, 200, " "),
    ]
    got = {r.request_id: (r.attempt, r.temperature) for r in jobs.accepted_attempts(spark.createDataFrame(rows, "request_id int, attempt int, status int, text string")).collect()}
    assert got == {1: (1, 0.3), 2: (1, 0.3), 3: (2, 0.4), 4: (None, None), 5: (1, 0.3), 6: (None, None)}


def test_search(spark):
    from lectern.operators import search

    d = spark.createDataFrame([("aAaa a.b", 1)], "t string, n int")
    assert d.select(search.count_matches("t", " AA ")).first()[0] == 2
    assert d.select(search.highlight("t", "a.B")).first()[0] == "aAaa <mark>a.b</mark>"
    assert d.select(F.col("n"), search.count_matches("t", " ")).first()[1] == 0


def test_references_cut_off_in_pages(spark):
    """As the SQL of html_texts has it, a reference counts with its semicolon alone; chapters of books are read as browsers read them."""
    h = "<p>a&amp;b&amp</p><p>&am</p><p>&copy &#65; &#65 &x1;</p>"
    assert [r.text for r in files.html_pages(spark.createDataFrame([(1, h)], "k int, html string"), ["k"]).collect()] == ["a&b&amp\n\n&am\n\n&copy A &#65 &x1;"]
    assert files.html_text("a&amp</p>") == "a&\n"


def test_notes_are_found_in_rows(spark):
    """No shuffle for notes, whatever the key."""
    made = [(1, "甲\n註釋：\n①乙\n丙\n注2 丁"), (None, "甲\n乙\n1.丙\n2.丁\n戊"), (3, "甲\n①乙")]
    df = spark.createDataFrame(made, "id int, text string")
    for split, want in ((layout.split_cn_notes(df, "id"), [["乙丙", "丁"], ["丙", "丁戊"], []]), (layout.split_notes(df, "id"), None)):
        assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()
        if want:
            assert [[n.content for n in r.notes] for r in split.collect()] == want
