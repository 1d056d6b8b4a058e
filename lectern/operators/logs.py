"""Logs of services: event frames, deltas, errors, quotas, catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import col, trim
from lectern.operators import folds


def frames(logs: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Event frames of a log: parts between blank lines, their event (``message`` if none) and joined data; other than JSON objects go."""
    return parsed_frames(logs.select(*keys, F.posexplode_outer(F.split(F.replace(col(body), F.lit("\r\n"), F.lit("\n")), "\n\n", -1)).alias("seq", "frame")), keys)


def parsed_frames(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The same of (keys, seq, frame), what stands between two blank lines."""
    lines = F.split("frame", "\n", -1)
    of = lambda name: F.transform(F.filter(lines, lambda s: F.startswith(s, F.lit(name))), lambda s: trim(F.substring(s, len(name) + 1, 1 << 30)))
    rows = parts.select(*keys, "seq", F.coalesce(F.try_element_at(of("event:"), F.lit(-1)), F.lit("message")).alias("event"), F.array_join(of("data:"), "").alias("data"))
    return rows.where(F.coalesce(F.startswith(F.col("data"), F.lit("{")) & F.try_parse_json("data").isNotNull(), F.lit(False)))


def delta_texts(logs: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Text pieces of a provider's stream: the data lines before ``[DONE]``, content as a string or a list of texts; bad lines are skipped."""
    lines = F.transform(F.split(col(body), "\n", -1), trim)
    data = F.transform(F.filter(lines, lambda s: F.startswith(s, F.lit("data:"))), lambda s: trim(F.substring(s, 6, 1 << 30)))
    done = F.array_position("_d", F.lit("[DONE]"))
    return parsed_deltas(logs.select(*keys, data.alias("_d")).select(*keys, F.posexplode_outer(F.when(done > 0, F.slice("_d", F.lit(1), (done - 1).cast("int"))).otherwise(F.col("_d"))).alias("seq", "line")), keys)


def parsed_deltas(live: DataFrame, keys: list[str]) -> DataFrame:
    """The same of (keys, seq, line), the data of the lines that count."""
    v = F.try_parse_json("line")
    many = F.array_join(F.try_variant_get(v, "$.choices[0].delta.content", "array<struct<text:string>>")["text"], "")
    one = F.try_variant_get(v, "$.choices[0].delta.content", "string")
    return live.select(*keys, "seq", F.coalesce(many, one).alias("text")).where(F.coalesce(F.col("text") != "", F.lit(False)))


def reassembled(events: DataFrame) -> DataFrame:
    """One row per request of (request_id, seq, event, data): its text and how it ended.

    Deltas in order make the text; text of ``done`` replaces it; an ``error``
    ends the request with its message; without either it is open.
    """
    e = events.withColumns({"_text": F.get_json_object("data", "$.text"), "_msg": F.get_json_object("data", "$.message")})
    end = F.min(F.when(F.col("event").isin("done", "error"), F.struct("seq", "event", "_text", "_msg"))).alias("end")
    deltas = F.array_sort(F.collect_list(F.when(F.col("event") == "delta", F.struct("seq", F.col("_text").alias("t"))))).alias("d")
    one = e.groupBy("request_id").agg(end, deltas)
    before = F.filter("d", lambda x: F.col("end").isNull() | (x["seq"] < F.col("end.seq")))
    status = F.coalesce(F.col("end.event"), F.lit("open"))
    joined = F.array_join(F.transform(before, lambda x: x["t"]), "")
    return one.select("request_id", status.alias("status"), F.when(status == "error", F.lit(None)).otherwise(F.coalesce("end._text", joined)).alias("text"), F.when(status == "error", F.col("end._msg")).alias("message"))


def error_class(status: Column | str, message: Column | str) -> Column:
    """What kind of failure a service reports."""
    s, m = col(status), F.lower(F.coalesce(col(message), F.lit("")))
    return (
        F.when(s.isin(401, 403) | m.contains("invalid api key"), "key").when(s == 429, "rate")
        .when((s == 402) | m.contains("insufficient") | m.contains("credit") | m.contains("balance"), "payment").otherwise("other")
    )


def pdf_error_class(name: Column | str, message: Column | str) -> Column:
    """What kind of failure reading a PDF reports."""
    n, m = F.coalesce(col(name), F.lit("")), F.lower(F.coalesce(col(message), F.lit("")))
    return (
        F.when((n == "PasswordException") | m.contains("password"), "password").when((n == "InvalidPDFException") | m.contains("invalid pdf") | m.contains("pdf header"), "damaged")
        .when(m.contains("worker") | m.contains("dynamically imported module"), "reader").when(m.contains("all pages failed"), "pages").otherwise("unknown")
    )


def quota(access: DataFrame, limit: int, seconds: int, key: str = "client_key") -> DataFrame:
    """Every event with whether its client had quota left, and the wait if not.

    A window opens with a client's first event and lasts so long; the first event
    at or after its end opens the next. Refused events neither count nor extend.
    A client's events are folded in sessions: where two of its events are at
    least one window apart, the later one opens a window in any case, so the fold
    starts anew there and no array holds more than one unbroken run.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_us", "event_id")
    apart = F.coalesce((F.col("_us") - F.lag("_us").over(w) >= seconds * 1_000_000).cast("int"), F.lit(0))
    rows = access.withColumn("_us", micros).withColumn("_gap", apart).withColumn("_run", F.sum("_gap").over(w))
    ordered = F.array_sort(F.collect_list(F.struct("_us", "event_id")))
    item = "array<struct<event_id:bigint,allowed:boolean,retry_after:bigint>>"
    zero = F.struct(F.lit(0).alias("count"), F.lit(-(1 << 62)).alias("reset"), F.array().cast(item).alias("out"))

    def step(a: Column, e: Column) -> Column:
        fresh = a["reset"] <= e["_us"]
        ok = fresh | (a["count"] < limit)
        wait = F.when(ok, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.ceil((a["reset"] - e["_us"]) / 1_000_000)))
        made = F.struct(e["event_id"].alias("event_id"), ok.alias("allowed"), wait.alias("retry_after"))
        count = F.when(fresh, F.lit(1)).when(ok, a["count"] + 1).otherwise(a["count"])
        return F.struct(count.alias("count"), F.when(fresh, e["_us"] + seconds * 1_000_000).otherwise(a["reset"]).alias("reset"), F.concat(a["out"], F.array(made)).alias("out"))

    judged = rows.groupBy(key, "_run").agg(ordered.alias("_e")).select(key, F.aggregate("_e", zero, step, lambda a: a["out"]).alias("_o"))
    return judged.select(key, F.explode_outer("_o").alias("o")).select(key, "o.*")


def quota_of_any(access: DataFrame, limit: int, seconds: int, key: str = "client_key") -> DataFrame:
    """The same for clients whose unbroken runs of events no task can hold: windows are groups whose events lie in reach of the first."""
    rows = access.select(key, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"))
    span = seconds * 1_000_000
    judged = folds.grouped(rows, [key], ["_us", "event_id"], span - 1, place="_us")
    ok = F.col("row") - F.col("opened") < limit
    wait = F.greatest(F.lit(1).cast("long"), F.ceil((F.col("begin") + span - F.col("_us")) / 1_000_000))
    return judged.select(key, "event_id", ok.alias("allowed"), F.when(ok, F.lit(0).cast("long")).otherwise(wait).alias("retry_after"))


MODEL = "id string, name string, architecture struct<input_modalities:array<string>,output_modalities:array<string>>, pricing struct<prompt:string,completion:string>, context_length double"


def catalog(raw: DataFrame, payload: str = "payload", order: str = "pos") -> DataFrame:
    """Usable models of a catalog's entries: text in and out, an id of plain characters; the last of an id wins."""
    m = raw.select(order, F.from_json(payload, MODEL).alias("m")).select(order, "m.*")
    price = lambda c: F.when((F.expr(f"try_cast({c} as double)") >= 0) & (F.expr(f"try_cast({c} as double)") < float("inf")), F.expr(f"try_cast({c} as double)") * 1_000_000)
    has = lambda c: F.coalesce(F.array_contains(c, "text"), F.lit(False))
    ok = m.withColumn("id", trim(F.coalesce("id", F.lit("")))).where(F.col("id").rlike(r"\A[A-Za-z0-9._~:/-]{1,200}\z") & has("architecture.input_modalities") & has("architecture.output_modalities"))
    name = F.left(trim(F.coalesce("name", F.lit(""))), F.lit(160))
    rows = ok.select(order, "id", F.when(name == "", F.col("id")).otherwise(name).alias("name"), F.endswith(F.col("id"), F.lit(":free")).alias("free"), F.col("context_length").cast("long").alias("context_length"), price("pricing.prompt").alias("prompt_price"), price("pricing.completion").alias("completion_price"))
    last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("id", order)]), order).alias("r"))
    return last.select("id", "r.*")


def catalog_rank(preferred: list[str]) -> Column:
    """Free models of preferred makers first, in their order; other free ones; the rest."""
    rank = F.when(F.col("free"), len(preferred) + 1).otherwise(len(preferred) + 2)
    for i, maker in reversed(list(enumerate(preferred, 1))):
        rank = F.when(F.col("free") & F.startswith(F.col("id"), F.lit(maker + "/")), i).otherwise(rank)
    return rank


def listed(models: DataFrame, automatic: tuple[str, str], preferred: list[str]) -> DataFrame:
    """The catalog in showing order, the automatic choice put first (rank 0)."""
    spark = models.sparkSession
    first = spark.createDataFrame([automatic], "id string, name string").withColumn("rank", F.lit(0))
    rest = models.where(F.col("id") != automatic[0]).select("id", "name", catalog_rank(preferred).alias("rank"))
    return first.unionByName(rest).orderBy("rank", "name")
