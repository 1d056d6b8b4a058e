"""Byte-level BPE encoding and decoding: speculate, verify, repair.

A greedy longest match proposes the tokens of each new word. The proposal is the
BPE encoding exactly if every token encodes to itself and every two neighbours,
put together, encode to just these two; both facts are looked up for all
neighbours of all new words at once and computed once per pair. Only words that
fail are merged exactly, step by step.

Defined cases: a null text counts as empty and has no tokens; text that spells a
special token is that token, as the vocabulary file's library has it; repeated
rows each get a row; other columns are ignored by the report and kept by the
pipeline stage.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import uuid
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField

from lectern.llm.common import map_rows, parts

# Fixed value: how the vocabulary's authors split text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: For Arrow: text in which a space may precede white space or the end.
UNEVEN = r" ([\s\v\x1c-\x1f\x{85}\p{Z}]|\z)"
#: Bytes of chunks a worker remembers, twice at most, and as many of words; the same in a pipeline, whose workers
#: also hold other stages' tables; what an entry takes besides; longer ones are not remembered; pairs of neighbours.
HELD_BYTES, PIPELINE_BYTES, ENTRY, LONGEST, PAIRS = 120_000_000, 24_000_000, 200, 64, 300_000
#: Bytes of text encoded at once, and in a pipeline.
AT_ONCE, PIPELINE_AT_ONCE = 16_000_000, 4_000_000
#: A pair's rank and its token in one number; pairs that never merge come after all others.
MASK, NEVER = (1 << 24) - 1, 1 << 60
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The vocabulary file's letters for the 256 bytes: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE file, as plain tables that travel to the executors."""

    def __init__(self, path: str):
        self.name = uuid.uuid4().hex
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        model = file["model"]
        self.ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        self.tokens = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for t, i in self.ids.items():
            self.tokens[i] = t
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        self.ranks = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b = bytes(letters[c] for c in a), bytes(letters[c] for c in b)
            self.ranks[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])


class Coder:
    """Encodes and decodes whole texts; remembers chunks, and which neighbours are compatible."""

    def __init__(self, vocabulary: Vocabulary, held: int = HELD_BYTES):
        self.v, self.most = vocabulary, held
        self.words = regex.compile(WORDS)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        #: text in which a space precedes white space or the end: chunks at spaces are not words there
        self.uneven = regex.compile(r"\x20(?:\s|$)")
        self.letters = [vocabulary.ids[bytes([b])] for b in range(256)]
        self.order = {pair: rank << 24 | new for pair, (rank, new) in vocabulary.ranks.items()}
        self.tokens = pa.array(vocabulary.tokens, pa.large_binary())
        self.names = pa.array(list(map(str, range(len(vocabulary.tokens)))))
        #: every beginning of a token, with the token's id or -1
        self.starts = {t[:n]: -1 for t in vocabulary.ids for n in range(1, len(t))} | vocabulary.ids
        self.compatible: dict[int, bool] = {}
        self.base = len(vocabulary.tokens)
        #: ids of chunks and of their words, the former twice so that those in use outlive the others
        self.chunks: dict[str | int, bytes] = {}
        self.older: dict[str | int, bytes] = {}
        self.seen: dict[str, bytes] = {}
        self.held = self.held_seen = 0
        self.failed = 0

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: again and again the merge of lowest rank, leftmost first."""
        return self._merge_short(word) if len(word) <= 40 else self._merge_long(word)

    def _merge_short(self, word: bytes) -> list[int]:
        parts, get = list(map(self.letters.__getitem__, word)), self.order.get
        found = [get(p, NEVER) for p in zip(parts, parts[1:])]
        while found:
            best = min(found)
            if best == NEVER:
                break
            i = found.index(best)
            parts[i] = best & MASK
            del parts[i + 1], found[i]
            if i:
                found[i - 1] = get((parts[i - 1], parts[i]), NEVER)
            if i < len(found):
                found[i] = get((parts[i], parts[i + 1]), NEVER)
        return parts

    def _merge_long(self, word: bytes) -> list[int]:
        parts: list = [self.v.ids[word[i : i + 1]] for i in range(len(word))]
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap = [(*m, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (m := self.v.ranks.get((parts[i], parts[i + 1])))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = new, None
            right[i] = right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q < len(parts) and (m := self.v.ranks.get((parts[p], parts[q]))):
                    heapq.heappush(heap, (m[0], p, m[1], parts[p], parts[q]))
        return [p for p in parts if p is not None]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        if (whole := self.v.ids.get(word)) is not None:
            return [whole]
        get, out, at, n = self.starts.get, [], 0, len(word)
        while at < n:
            best, to, end = -1, at + 1, at + 1
            while end <= n and (t := get(word[at:end])) is not None:
                if t >= 0:
                    best, to = t, end
                end += 1
            out.append(best)
            at = to
        return out

    def _known(self, code: int) -> bool:
        a, b = divmod(code, self.base + 1)
        want = [a] if b == self.base else [a, b]
        return self.merge(b"".join(self.v.tokens[t] for t in want)) == want

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        out = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter(chain.from_iterable(out), np.int64, int(sizes.sum()))
        if not len(flat):
            return out
        last = np.cumsum(sizes) - 1
        follow = np.empty(len(flat), np.int64)
        follow[:-1] = flat[1:]
        follow[last[sizes > 0]] = self.base  # the last token of a word is tested alone
        codes, back = np.unique(flat * (self.base + 1) + follow, return_inverse=True)
        if len(self.compatible) > PAIRS:
            self.compatible.clear()
        fine = np.empty(len(codes), bool)
        for k, code in enumerate(codes.tolist()):
            ok = self.compatible.get(code)
            if ok is None:
                ok = self.compatible[code] = self._known(code)
            fine[k] = ok
        bad = np.zeros(len(out), bool)
        bad[np.repeat(np.arange(len(out)), sizes)[~fine[back]]] = True
        for i in np.flatnonzero(bad).tolist():
            out[i] = self.merge(words[i])
        self.failed += int(bad.sum())
        return out

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of chunks not met before: of words met before, or encoded now."""
        if self.held_seen + ENTRY * len(self.seen) > self.most:
            self.seen, self.held_seen = {}, 0
        split = [self.words.findall(c) for c in new]
        own = dict.fromkeys(chain.from_iterable(split))
        for w in own:
            own[w] = self.seen.get(w)
        unseen = [w for w, x in own.items() if x is None]
        for w, ids in zip(unseen, self.encode_words([w.encode() for w in unseen])):
            own[w] = x = array("I", ids).tobytes()
            if len(w) <= LONGEST:
                self.seen[w] = x
                self.held_seen += len(w) + len(x)
        return [own[s[0]] if len(s) == 1 else b"".join([own[w] for w in s]) for s in split]

    def _rows(self, chunks: list[str | int]) -> list[bytes]:
        """Ids of each of a slice's distinct chunks; a number is a special token."""
        if self.held + ENTRY * len(self.chunks) > self.most:
            self.chunks, self.older, self.held = {}, self.chunks, 0
        known, older, new = self.chunks, self.older, []
        out = list(map(known.get, chunks))
        for i in [i for i, x in enumerate(out) if x is None]:
            c = chunks[i]
            if (x := older.get(c)) is None and isinstance(c, int):
                x = array("I", [c]).tobytes()
            if x is None:
                new.append(i)
            else:
                out[i] = known[c] = x
        for i, x in zip(new, self._learn([chunks[i] for i in new])):
            out[i], c = x, chunks[i]
            if len(c) <= LONGEST:
                known[c] = x
                self.held += len(c) + len(x)
        return out

    def _pieces(self, text: str) -> list[str | int]:
        """Chunks that are whole words each, and ids of special tokens."""
        parts = self.specials.split(text) if self.specials and "<|" in text else [text]
        out: list = []
        for part in parts:
            if part in self.v.special:
                out.append(self.v.special[part])
            elif part:
                if self.uneven.search(part):
                    out += self.words.findall(part)
                else:
                    first, *more = part.split(" ")
                    out += [first] if first else []
                    out += [" " + p for p in more]
        return out

    def _chunked(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """Distinct chunks; the chunks of all texts by number in a row; and where each text's begin."""
        odd = pc.or_(pc.match_substring_regex(texts, UNEVEN), pc.match_substring(texts, "<|")).to_numpy(zero_copy_only=False).astype(bool)
        split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        words = split.flatten().dictionary_encode()
        chunks, at = [" " + w for w in words.dictionary.to_numpy(zero_copy_only=False).tolist()], words.indices.to_numpy().astype(np.int64)
        more: dict = {}
        begins = split.offsets.to_numpy().astype(np.int64)
        begins -= begins[0]
        if len(begins) > 1:  # a text's first chunk has no space before it
            at[begins[:-1]] = [len(chunks) + more.setdefault(chunks[i][1:], len(more)) for i in at[begins[:-1]].tolist()]
        sizes = np.empty(len(odd), np.int64)
        sizes[~odd] = np.diff(begins)
        if not odd.any():
            return [*chunks, *more], at, np.concatenate([[0], np.cumsum(sizes)])
        rest = [[len(chunks) + more.setdefault(c, len(more)) for c in self._pieces(t)] for t in texts.filter(pa.array(odd)).to_pylist()]
        sizes[odd] = list(map(len, rest))
        out, is_odd = np.empty(int(sizes.sum()), np.int64), np.repeat(odd, sizes)
        out[~is_odd], out[is_odd] = at, list(chain.from_iterable(rest))
        return [*chunks, *more], out, np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, texts: pa.Array, joined: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all whole texts in a row, where each text's begin, and if wanted each text's as decimal text."""
        chunks, at, begins = self._chunked(pc.fill_null(texts, ""))
        rows = self._rows(chunks)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        offsets, flat = np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(rows), np.uint32)
        at = pa.array(at)
        ids = pa.LargeListArray.from_arrays(offsets, pa.array(flat)).take(at).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[at.to_numpy()])])[begins]
        if not joined:
            return ids, ends, []
        names = pc.binary_join(pa.ListArray.from_arrays(offsets.astype(np.int32), self.names.take(pa.array(flat))), ",")
        # a text that begins with a space has an empty first chunk
        return ids, ends, pc.ascii_ltrim(pc.binary_join(pa.ListArray.from_arrays(begins.astype(np.int32), names.take(at)), ","), ",").to_pylist()

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The text of each run of ids, special tokens included."""
        found = self.tokens.take(pa.array(ids))
        _, offsets, data = found.buffers()
        data = memoryview(data) if data is not None else memoryview(b"")
        cuts = np.frombuffer(offsets, np.int64, len(ids) + 1)[ends].tolist() if len(ids) else [0] * len(ends)
        return [str(data[a:b], "utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


_coders: dict[str, Coder] = {}


def worker_coder(vocabulary: Vocabulary, held: int = HELD_BYTES) -> Coder:
    """This Python worker's coder: what it has learned serves all tasks it runs."""
    if vocabulary.name not in _coders:
        _coders.clear()
        _coders[vocabulary.name] = Coder(vocabulary, held)
    return _coders[vocabulary.name]


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, the number of tokens, and digests of the ids and of their decoded text."""
    model = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(model.value)
        for part in parts(batches, "text", AT_ONCE):
            ids, ends, joined = coder.encode(part.column("text"), joined=True)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(np.diff(ends)),
                pa.array([hashlib.sha256(s.encode()).hexdigest() for s in joined], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in coder.decode(ids, ends)], pa.string()),
            ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def with_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Pipeline stage: the rows with their token ids, their number, and whether they decode to the text.

    Columns of these names are replaced.
    """
    docs = docs.drop("n_tokens", "token_ids", "round_trip")
    model, width = docs.sparkSession.sparkContext.broadcast(Vocabulary(path)), len(docs.columns)
    more = [StructField("n_tokens", LongType()), StructField("token_ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(model.value, PIPELINE_BYTES)
        for part in parts(batches, "text", PIPELINE_AT_ONCE):
            text = part.column("text")
            ids, ends, _ = coder.encode(text)
            same = [a == (b or "") for a, b in zip(coder.decode(ids, ends), text.to_pylist())]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(np.diff(ends)), lists, pa.array(same, pa.bool_())], names=[*part.schema.names, "n_tokens", "token_ids", "round_trip"])

    return map_rows(docs, run, more)
