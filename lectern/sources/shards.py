"""Documents in shards: few large files with a manifest that says where each document lies.

A shard holds the UTF-8 texts of many documents one behind the other. Documents
are dealt out by size, so shards are about equally large, and no document, format
or folder gets a file of its own. A task writes a shard under a name of the
attempt and renames it when whole; the name says what is in it, so an attempt
that is made again leaves the same bytes under the same name. The manifest is a
table of (document, shard, offset, length, sha256); one document is read back by
opening its shard at its offset. Where pyarrow knows no such file system, the
driver's error says so; nothing is written on a machine of its own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a shard; a longer document is a shard of its own.
SHARD_BYTES = 128 << 20


def settle(store: fs.FileSystem, own: str, name: str) -> None:
    """Gives a whole file its name; if another attempt was first, its bytes are the same."""
    try:
        store.move(own, name)
    except OSError:
        if store.get_file_info(name).type != fs.FileType.File:
            raise
        store.delete_file(own)


def write(texts: DataFrame, folder: str, document: str, text: str = "text", shard_bytes: int = SHARD_BYTES, partitions: int | None = None) -> DataFrame:
    """Writes the texts (null: empty) and the manifest; gives the manifest.

    Rows are dealt out by hash to so many tasks, sorted by document in each, and
    cut in shards of the wanted size; so a write that is made again with as many
    tasks makes the same shards. Repeated ids are kept, each with its place.
    """
    kind = texts.schema[document].dataType.simpleString()
    place = folder.rstrip("/")
    fs.FileSystem.from_uri(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(place)
        store.create_dir(at, recursive=True)
        held, size, rows = [], 0, []

        def shard() -> pa.RecordBatch:
            digest = hashlib.sha256()
            own = f"{at}/.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                for raw in held:
                    digest.update(len(raw).to_bytes(8, "big") + raw)
                    out.write(raw)
            name = f"shard-{digest.hexdigest()[:32]}.txt"
            settle(store, own, f"{at}/{name}")
            ids = pa.array([r[0] for r in rows], batch.schema.field(0).type)
            return pa.RecordBatch.from_arrays([ids, pa.array([name] * len(rows)), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows])], names=["document", "shard", "offset", "length", "sha256"])

        for batch in batches:
            for one, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (body or "").encode("utf-8", "replace")
                if held and size + len(raw) > shard_bytes:
                    yield shard()
                    held, size, rows = [], 0, []
                rows.append((one, size, len(raw), hashlib.sha256(raw).hexdigest()))
                held.append(raw)
                size += len(raw)
        if rows:
            yield shard()

    rows = texts.select(F.col(document).alias("document"), F.col(text).cast("string").alias("text"))
    by = [F.col("document"), F.xxhash64("text")]
    rows = rows.repartition(partitions or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    made = rows.sortWithinPartitions(*by, "text").mapInArrow(run, f"document {kind}, shard string, offset long, length long, sha256 string")
    made.write.mode("overwrite").parquet(f"{place}/manifest")
    return texts.sparkSession.read.parquet(f"{place}/manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(document, text) of manifest rows: each shard is opened once a task, each document read at its offset and checked."""
    kind = manifest.schema["document"].dataType.simpleString()
    place = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(place)
        name, source = None, None
        for batch in batches:
            texts = []
            for shard, offset, length, digest in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length", "sha256"))):
                if shard != name:
                    name, source = shard, store.open_input_file(f"{at}/{shard}")
                source.seek(offset)
                raw = source.read(length)
                if hashlib.sha256(raw).hexdigest() != digest:
                    raise ValueError(f"{shard} does not hold what the manifest says at {offset}")
                texts.append(raw.decode())
            yield pa.RecordBatch.from_arrays([batch.column("document"), pa.array(texts, pa.string())], names=["document", "text"])

    # a shard's rows lie together, so that it is opened once; where a shard is large, several tasks read it
    rows = manifest.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    return rows.mapInArrow(run, f"document {kind}, text string")


def kept_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, documents, bytes) of a written folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/manifest").groupBy("shard").agg(F.count("*").alias("documents"), F.sum("length").alias("bytes"))


def review_lines(rows: DataFrame, by: str) -> DataFrame:
    """(by, text): the rows of a review (``outcomes.review_rows``) as one text a document, a line a section, for ``write``.

    Lines are put together by section, so a document is one value; documents that no task can hold are written by section instead.
    """
    line = F.concat_ws("\t", "label", F.regexp_replace("source", r"\s+", " "), F.regexp_replace("target", r"\s+", " "))
    own = F.array_sort(F.collect_list(F.struct("section", line.alias("line"))))
    return rows.groupBy(by).agg(own.alias("r")).select(by, F.array_join("r.line", "\n").alias("text"))
