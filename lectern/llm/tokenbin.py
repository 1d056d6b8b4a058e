"""Token ids in binary files of independent zstandard frames.

A file is a row of frames, one for each document, that any zstandard reader
decompresses; then a skippable frame with the documents' ids; then the seek
table, a skippable frame with each frame's compressed size, decompressed size
and checksum, ended by the number of frames and a magic number. A reader takes
the tail first and then only the frames it was asked for, and checks each.

Files are written in ascending order of doc_id by tasks on ranges of it. A task
writes under a name of its own, which starts with a point, and renames when done,
so a lost or repeated task leaves whole files with the same bytes. The folder is
the operator's output: whoever named it removes it.

Defined cases: a null text counts as empty and gets the end id alone; rows are
ordered by doc_id (nulls first), then by the hash of their text, then by text, so
repeated rows keep their places and an id that many rows have is dealt out to
several files; an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import parts

# The format's magic numbers and the end id.
SKIPPABLE, SEEKABLE, IDS = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
CHECKSUMS = 0x80
END = 2
LAST = struct.pack("<I", END)
LEVEL = 1
#: Characters and bytes of the words and ids a worker remembers, twice at most (those in use outlive the others);
#: what an entry takes besides; longer words are not remembered.
HELD_BYTES, ENTRY, LONGEST = 130_000_000, 200, 64
#: Bytes of text encoded at once.
AT_ONCE = 16_000_000
# The pieces that the vocabulary cuts words in, for words of ASCII and composed Latin letters.
PLAIN = re.compile("[!-~À-ÖØ-öø-ɏ]+")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ɏ]+|[0-9]|[^0-9a-zÀ-ÖØ-öø-ɏ]+")
NULL_ID = -(1 << 63)


class Encoder:
    """The tokenizers library, asked once for each new piece of a word.

    White space is dropped by this vocabulary and never inside a token, so a
    text's ids are those of its parts between ASCII white space in a row; Arrow
    finds a slice's distinct parts and puts their ids in place. A part of ASCII
    and of composed Latin letters is cut in pieces as the vocabulary does it;
    any other part, and one that may spell a special token, is asked for whole.
    """

    def __init__(self, data: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def _whole(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _ask(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces: many in one text, told apart by the tokens that end a piece."""
        texts = [" ".join(pieces[at : at + 256]) for at in range(0, len(pieces), 256)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)
        cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
        if len(cuts) != len(pieces) + 1:
            return self._whole(pieces)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    @staticmethod
    def pieces(word: str) -> list[str] | None:
        """The vocabulary's pieces of a plain word; None for any other."""
        low = word.lower()
        return None if "<|" in word or not PLAIN.fullmatch(word) or not PLAIN.fullmatch(low) else PIECES.findall(low)

    def _remember(self, found: dict[str, bytes]) -> None:
        if max(map(len, found), default=0) > LONGEST:
            found = {w: x for w, x in found.items() if len(w) <= LONGEST}
        self.known.update(found)
        self.held += ENTRY * len(found) + sum(map(len, found)) + sum(map(len, found.values()))

    def _new(self, words: list[str], ask: Callable) -> dict[str, bytes]:
        """Ids of distinct words that no worker's table holds."""
        found = {}
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            found.update(zip(part, ask(part)))
        return found

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words not met before: of pieces met before, or asked for now."""
        known, older = self.known, self.older
        split = {w: self.pieces(w) for w in words if not (w.isascii() and w.isalpha() and w.islower())}
        whole = [w for w, p in split.items() if p is None]
        # a word that is one piece is asked for like the pieces of others
        wanted = {x for p in split.values() if p for x in p}
        own = {x: i for x in wanted if (i := known.get(x) or older.get(x)) is not None}
        wanted.difference_update(own)
        wanted.update(w for w in words if w not in split)
        new = self._new(list(wanted), self._ask) | self._new(whole, self._whole)
        own |= new
        for w, p in split.items():
            if p is not None:
                own[w] = own[p[0]] if len(p) == 1 else b"".join([own[x] for x in p])
        self._remember(own)
        return own

    def _rows(self, words: list[str]) -> list[bytes]:
        """Ids of the distinct words of a slice."""
        if self.held > HELD_BYTES:
            self.known, self.older, self.held = {}, self.known, 0
        out = list(map(self.known.get, words))
        new = [i for i, x in enumerate(out) if x is None]
        if new:
            again = {w: x for w in map(words.__getitem__, new) if (x := self.older.get(w)) is not None}
            self._remember(again)
            found = self._learn([w for w in map(words.__getitem__, new) if w not in again]) | again
            for i in new:
                out[i] = found[words[i]]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all whole texts in a row, and where each text's begin (with the end of the last)."""
        texts = pc.fill_null(texts, "")
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        rows = self._rows(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        table = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(np.frombuffer(b"".join(rows), "<u4")))
        ids = table.take(words.indices).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[words.indices.to_numpy()])])
        offsets = split.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]


_encoders: dict[int, Encoder] = {}


def worker_encoder(data: str) -> Encoder:
    """This Python worker's encoder: what it has learned serves all tasks it runs."""
    key = zlib.crc32(data.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data)
    return _encoders[key]


class Writer:
    """Appends documents to one file and ends it with its tables."""

    def __init__(self, out):
        self.out, self.rows, self.ids = out, [], []
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, doc: int | None, data: bytes) -> None:
        frame = self.zstd.compress(data)
        self.out.write(frame)
        self.rows.append(struct.pack("<III", len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.ids.append(NULL_ID if doc is None else doc)

    def close(self) -> None:
        ids = zstandard.ZstdCompressor(level=LEVEL).compress(array("q", self.ids).tobytes())
        self.out.write(struct.pack("<II", IDS, len(ids)) + ids)
        entries = b"".join(self.rows)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.rows), CHECKSUMS, SEEKABLE))
        self.out.close()


class Reader:
    """Reads the tail of a file, then the frames that are asked for."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        size = file.tell()
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("not a seekable token file")
        file.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        file.seek(int(self.offsets[-1]))
        magic, length = struct.unpack("<II", file.read(8))
        if magic != IDS:
            raise ValueError("the documents' ids are missing")
        self.zstd = zstandard.ZstdDecompressor()
        self.ids = np.frombuffer(self.zstd.decompress(file.read(length)), "<i8")

    def frame(self, k: int) -> bytes:
        """Ids of the k-th document; an error if its checksum is wrong."""
        self.file.seek(int(self.offsets[k]))
        data = self.zstd.decompress(self.file.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if len(data) != self.table[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def documents(self, wanted: list[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) of the wanted documents, or of all."""
        for k in range(len(self.ids)) if wanted is None else np.flatnonzero(np.isin(self.ids, wanted)).tolist():
            doc = int(self.ids[k])
            yield None if doc == NULL_ID else doc, self.frame(k)


def _settle(store: fs.FileSystem, own: str, name: str) -> None:
    """Give a finished file its name; an attempt that comes second drops its file, which has the same bytes."""
    try:
        store.move(own, name)
    except OSError:
        if store.get_file_info(name).type != fs.FileType.File:
            raise
        store.delete_file(own)


def write(docs: DataFrame, path: str, folder: str) -> DataFrame:
    """Write the token files; gives (file, n_docs, n_tokens), one row for each file."""
    with open(path, encoding="utf-8") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, place = fs.FileSystem.from_uri(folder)
        encoder, writer, tokens = worker_encoder(data.value), None, 0
        name = f"part-{TaskContext.get().partitionId():06d}.tok"
        own = f"{place}/.{name}.{uuid.uuid4().hex}"
        for part in parts(batches, "text", AT_ONCE):
            if writer is None:
                store.create_dir(place, recursive=True)
                writer = Writer(store.open_output_stream(own))
            ids, ends = encoder.encode(part.column("text"))
            raw, cuts = memoryview(ids.tobytes()), (ends * 4).tolist()
            for doc, a, b in zip(part.column("doc_id").to_pylist(), cuts, cuts[1:]):
                writer.add(doc, b"".join((raw[a:b], LAST)))
            tokens += len(ids) + part.num_rows
        if writer is not None:
            writer.close()
            _settle(store, own, f"{place}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": pa.array([len(writer.ids)], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return ordered.mapInArrow(run, "file string, n_docs long, n_tokens long")


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """One row for each document in the files: its id, place in the order, length and ids' checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                with store.open_input_file(f"{place}/{name}") as file:
                    docs, sizes, sums = [], [], []
                    for doc, ids in Reader(file).documents():
                        docs.append(doc)
                        sizes.append(len(ids) // 4)
                        sums.append(zlib.crc32(ids))
                    start = before + np.cumsum(sizes) - sizes
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("file", "before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents(spark: SparkSession, folder: str, files: list[str], wanted: list[int]) -> dict[int, list[int]]:
    """Token ids of the wanted documents alone, read frame by frame."""
    store, place = fs.FileSystem.from_uri(folder)
    out = {}
    for name in files:
        with store.open_input_file(f"{place}/{name}") as file:
            out |= {doc: np.frombuffer(ids, "<u4").tolist() for doc, ids in Reader(file).documents(wanted)}
    return out


def report(docs: DataFrame, path: str, folder: str) -> DataFrame:
    """Write all documents, read the files back, and give one row for each document."""
    spark = docs.sparkSession
    # a row for each file: as many as tasks, not as documents
    files = sorted(write(docs, path, folder).collect(), key=lambda r: r.file)
    rows, before = [], 0
    for r in files:
        rows.append((r.file, before))
        before += r.n_tokens
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    listed = spark.createDataFrame(rows, "file string, before long").repartition(len(rows), "file")
    return read(spark, folder, listed)
