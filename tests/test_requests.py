"""Rules of requests and keys that the registered queries do not reach."""

import json

from pyspark.sql import functions as F

from lectern.operators import jobs, memory


def test_validation_rules(spark):
    chunk = {"id": "a", "pageNumber": 1, "originalChinese": "中"}
    image = {"id": "a", "pageNumber": 2, "imageDataUrl": "data:image/png;base64,AAAA"}
    cases = [
        ({"chunk": chunk}, None), ({"imageTask": image}, None), ({"imageTask": image | {"mode": "ocr"}}, None), ({"imageTask": image | {"imageDataUrl": "data:image/jpeg;base64,AA==\r\n"}}, None),
        ({}, "Provide exactly one text segment or image task."), ({"chunk": chunk, "imageTask": image}, "Provide exactly one text segment or image task."),
        ({"chunk": chunk | {"id": "x" * 161}}, "Segment id is invalid."), ({"chunk": chunk | {"id": " "}}, "Segment id is invalid."), ({"chunk": chunk | {"pageNumber": 1.5}}, "Segment page is invalid."),
        ({"chunk": chunk | {"pageNumber": 100_001}}, "Segment page is invalid."), ({"chunk": chunk | {"originalChinese": "　"}}, "Segment text is empty."), ({"chunk": chunk | {"originalChinese": "中" * 20_001}}, "This translation segment is too large."),
        ({"imageTask": image | {"id": ""}}, "Image task id is invalid."), ({"imageTask": image | {"pageNumber": 0}}, "Image page is invalid."), ({"imageTask": image | {"imageDataUrl": "data:image/gif;base64,AAAA"}}, "OCR image data is invalid or too large."),
        ({"imageTask": {"id": "a", "pageNumber": 1}}, "OCR image data is invalid or too large."), ({"imageTask": image | {"mode": "scan"}}, "Image task mode is invalid."),
        ({"chunk": chunk, "glossary": {str(i): "x" for i in range(501)}}, "The glossary is too large for one request."), ({"chunk": chunk, "glossary": {"a": " "}}, "A glossary entry is invalid."), ({"chunk": chunk, "glossary": {"a" * 201: "b"}}, "A glossary entry is invalid."),
        ({"chunk": chunk, "model": "a b"}, "Model is invalid."), ({"chunk": chunk, "model": "m" * 201}, "Model is invalid."), ({"chunk": chunk, "domain": "cooking"}, "Translation domain is invalid."),
        ({"chunk": chunk, "temperature": 1.1}, "Temperature is invalid."), ({"chunk": chunk, "previousSummary": "x" * 4001}, "Previous context is invalid."),
    ]
    rows = [(i, json.dumps(body)) for i, (body, _) in enumerate(cases)] + [(len(cases), "no json")]
    got = [r.error for r in jobs.validated(spark.createDataFrame(rows, "i int, body string"), ["general", "legal"]).orderBy("i").collect()]
    assert got == [*(error for _, error in cases), "Invalid request body."]


def test_memory_keys(spark):
    """Keys of records that agree after tidying are equal; the hash is FNV-1a in base 36."""
    d = spark.createDataFrame([(" a\r\nb ", "d", ""), ("a\nb", "d", ""), ("a\nb", "e", "")], "s string, d string, g string")
    got = [r[0] for r in d.select(memory.memory_key("s", "d", "g")).collect()]
    h = 2166136261
    for c in "a\nb\0d\0":
        h = (h ^ ord(c)) * 16777619 % 2**32
    digits = ""
    while h:
        h, r = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
    assert got[0] == got[1] == digits and got[2] != digits


def test_memory_is_unique_before_lookup(spark):
    m = spark.createDataFrame([("a", "d", "", "old", 1), (" a ", "d", "", "new", 2), ("a", "d", "", None, 3)], "source string, domain string, signature string, target string, updated_at int")
    s = spark.createDataFrame([(1, "a\r\n", "d", ""), (2, "b", "d", ""), (3, None, "d", "")], "id int, source string, domain string, signature string")
    got = memory.look_up(s, m).select("id", "remembered", "memory_hit").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "new", True), (2, None, False), (3, None, False)]
    assert memory.look_up(s, m).where(F.col("id") == 1).count() == 1


def test_attempts_with_one_number(spark):
    """Every row with the number that is taken gives one, also where the request is stopped; a request that takes none gives one."""
    rows = [(1, 0, 200, "plain text"), (1, 0, 200, "other text"), (1, 0, 500, None), (2, 0, 400, None), (2, 1, 200, "late one"), (2, 1, 200, "late two"), (3, 0, 429, None), (None, 0, 200, "no id")]
    got = [tuple(r) for r in jobs.accepted_attempts(spark.createDataFrame(rows, "request_id int, attempt int, status int, text string")).collect()]
    want = [(1, 0, "plain text", 0.2), (1, 0, "other text", 0.2), (1, 0, None, 0.2), (2, None, None, None), (2, None, None, None), (3, None, None, None), (None, 0, "no id", 0.2)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_requests_of_few_domains_are_not_dealt_by_domain(spark):
    s = spark.range(100).selectExpr("id", "'legal' AS domain", "'x' AS source", "'' AS context")
    d = spark.createDataFrame([("legal", "Law."), ("general", "All.")], "domain string, system string")
    made = jobs.requests(s, d, F.create_map(F.lit("a"), F.lit("b")))
    assert made.where("system = 'Law.'").count() == 100
    assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()
