"""Folders of office files, and shards of documents."""

import os

from pyspark.sql import functions as F

from lectern.plans.sources import office_file
from lectern.sources import files, shards


def test_a_folder(spark, tmp_path):
    """Refused files have their reason and are not opened; every file has a result."""
    (tmp_path / "sub").mkdir()
    put = lambda name, data: (tmp_path / name).write_bytes(data)
    put("a.docx", office_file("docx", ["x" * 7000, "y" * 7000, "z"]))
    put("sub/b.EPUB", office_file("epub", ["one", "", "three & <b>"]))
    put("c.pptx", office_file("pptx", ["", "slide"]))
    put("empty.docx", office_file("docx", [""]))
    put("large.docx", b"0" * 5000)
    put("old.ppt", b"x")
    put("photo.exe", b"x")
    put("bad.pptx", b"no archive")
    put("notes.md", b"text")
    units = files.office_folder(spark, str(tmp_path), most=4000).cache()
    name = lambda p: p.rpartition("/")[2]
    got = {name(r.path): (r.kind, r.message, r.total_pages) for r in files.office_results(units).collect()}
    assert got["a.docx"] == ("success", None, 2) and got["b.EPUB"] == ("success", None, 2) and got["c.pptx"] == ("success", None, 2)
    assert got["empty.docx"] == ("error", files.NO_DOCX_TEXT, 0) and got["bad.pptx"] == ("error", files.DAMAGED, 0)
    assert got["old.ppt"][1] == "old format" and got["photo.exe"][1] == "unknown format" and "notes.md" not in got
    assert "large.docx" not in got or got["large.docx"][1]
    pages = sorted((name(r.path), r.page_number, r.text) for r in files.office_pages(units).collect())
    assert pages == [("a.docx", 1, "x" * 7000), ("a.docx", 2, "y" * 7000 + "\n\nz"), ("b.EPUB", 1, "one"), ("b.EPUB", 2, "three & <b>"), ("c.pptx", 2, "slide")]
    plan = files.listed_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_epub_without_a_package_path(spark):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", "<c><rootfile/></c>")
    assert files._read("epub", out.getvalue(), 1 << 20) == ([], 0, files.NO_EPUB_ROOT)
    assert files._read("epub", office_file("docx", ["x"]), 1 << 20)[2] == files.NO_EPUB
    assert files._read("docx", office_file("docx", ["x" * 100_000]), 1000)[2] == files.TOO_LARGE


def test_names_that_need_quotes(spark):
    df = spark.createDataFrame([(1, "<p>x</p>")], "`a``b` int, html string")
    assert [tuple(r) for r in files.html_pages(df, ["a`b"]).collect()] == [(1, "x")]


def test_shards(spark, tmp_path):
    """Many documents in few files; one is read back at its offset; a repeated write changes nothing."""
    df = spark.range(0, 100_000, 1, 4).selectExpr("id", "CASE WHEN id % 1000 = 7 THEN NULL WHEN id % 1000 = 8 THEN '' ELSE concat('é中 ', id, ' ', repeat('x', cast(id % 50 AS int))) END AS text")
    df = df.unionByName(spark.createDataFrame([(5, "again"), (-1, "y" * 3_000_000)], "id long, text string"))
    folder = f"file://{tmp_path}/out"
    manifest = shards.write(df, folder, "id", shard_bytes=1_000_000, partitions=3)
    names = sorted(f for f in os.listdir(tmp_path / "out") if f != "manifest")
    assert 5 <= len(names) <= 15 and all(n.startswith("shard-") for n in names)
    assert max(r.bytes for r in shards.kept_shards(spark, folder).where("documents > 1").collect()) <= 1_000_000
    back = shards.read(manifest, folder)
    assert back.exceptAll(df.select(F.col("id").alias("document"), F.coalesce("text", F.lit("")).alias("text"))).count() == 0 and back.count() == 100_002
    r = manifest.where("document = 77777").first()
    with open(tmp_path / "out" / r.shard, "rb") as f:
        f.seek(r.offset)
        assert f.read(r.length).decode() == "é中 77777 " + "x" * 27
    before = {n: os.stat(tmp_path / "out" / n).st_size for n in names}
    shards.write(df, folder, "id", shard_bytes=1_000_000, partitions=3)
    assert {n: os.stat(tmp_path / "out" / n).st_size for n in os.listdir(tmp_path / "out") if n != "manifest"} == before
    assert shards.write(df.limit(0), f"file://{tmp_path}/none", "id").count() == 0


def test_reviews_in_shards(spark, tmp_path):
    """Review rows of many documents, written as texts and read back by document."""
    from lectern.operators import outcomes

    made = [(d, p, p, f"源{p} <b>", f"Text {p}\nline") for d in range(40) for p in range(3)]
    segments = spark.createDataFrame(made, "doc_id long, page_number int, seq int, source string, target string")
    texts = shards.review_lines(outcomes.review_rows(segments, ["doc_id"]), "doc_id")
    folder = f"file://{tmp_path}/reviews"
    manifest = shards.write(texts, folder, "doc_id", partitions=2)
    assert manifest.select("shard").distinct().count() <= 2
    one = shards.read(manifest.where("document = 7"), folder).first().text
    assert one == "Section 1\t源0 &lt;b&gt;\tText 0 line\nPage 1\t源1 &lt;b&gt;\tText 1 line\nPage 2\t源2 &lt;b&gt;\tText 2 line"
