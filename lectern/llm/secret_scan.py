"""Secret scans: fixed patterns, widened by inferred credential grammars.

The patterns find credentials with tell-tale forms. Their values, labelled by
kind, train one probabilistic automaton per kind: a prefix tree whose states are
merged while their frequencies are statistically compatible. A last automaton is
learned from ordinary tokens of the same alphabet. Every other token that is at least as
long as the shortest learned credential, or has 16 characters, is a candidate
and is scored by how much likelier a kind's automaton makes it than the ordinary
one; likely ones become spans of kind ``format``.

Defined cases: a null text counts as empty and has no spans; without labelled
values only the patterns apply; repeated rows each get a row; other columns are
ignored by the scan and kept by the pipeline stage.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, map_rows, slices

# The patterns, the least lengths and the order of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "format")

#: Candidates have so many characters, or fewer if a kind's values do.
CANDIDATE = 16
#: Distinct training values of each kind, and their longest length.
VALUES, VALUE_CHARS = 2000, 200
#: Confidence of the compatibility test, visits below which a state says too little to test, and the certainty asked of a span.
ALPHA, VISITS = 0.05, 12
LEAST_GAIN = 1.0
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and non-overlapping within each kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def tokens(least: int) -> re.Pattern:
    return re.compile(f"[A-Za-z0-9+/_.=-]{{{least},}}")


def candidates(text: str, base: list[tuple[int, int, int]], long: re.Pattern) -> list[tuple[int, int]]:
    """Long tokens that no base span touches; base is sorted by start."""
    out, i, reach = [], 0, -1
    for m in long.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            reach = max(reach, base[i][2])
            i += 1
        if reach <= m.start():
            out.append(m.span())
    return out


class Automaton:
    """A probabilistic automaton inferred from strings.

    ``edges[p][c]`` is [next state, strings that took it]; ``visits`` and ``ends``
    count the strings through a state and those that end there.
    """

    def __init__(self, strings: list[str]):
        self.visits, self.ends, self.edges = [0], [0], [{}]
        for s in strings:
            at = 0
            self.visits[0] += 1
            for c in s:
                edge = self.edges[at].get(c)
                if edge is None:
                    edge = self.edges[at][c] = [len(self.edges), 0]
                    self.visits.append(0)
                    self.ends.append(0)
                    self.edges.append({})
                edge[1] += 1
                at = edge[0]
                self.visits[at] += 1
            self.ends[at] += 1
        self._merge()
        self._logs()

    @staticmethod
    def _differ(a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        """Hoeffding test of endings and of every character, down the tree below b."""
        stack, none = [(a, b)], (None, 0)
        while stack:
            p, q = stack.pop()
            n, m = self.visits[p], self.visits[q]
            if min(n, m) < VISITS:
                continue
            if self._differ(self.ends[p], n, self.ends[q], m):
                return False
            for c in self.edges[p].keys() | self.edges[q].keys():
                (x, i), (y, j) = self.edges[p].get(c, none), self.edges[q].get(c, none)
                if self._differ(i, n, j, m):
                    return False
                if x is not None and y is not None and x != y:
                    stack.append((x, y))
        return True

    def _fold(self, into: int, tree: int) -> None:
        stack = [(into, tree)]
        while stack:
            p, q = stack.pop()
            self.visits[p] += self.visits[q]
            self.ends[p] += self.ends[q]
            for c, (y, j) in self.edges[q].items():
                if c in self.edges[p]:
                    self.edges[p][c][1] += j
                    stack.append((self.edges[p][c][0], y))
                else:
                    self.edges[p][c] = [y, j]

    def _merge(self) -> None:
        """Settle the root; then, most visited first, merge each next state with a settled one or settle it."""
        settled, order, heap = [0], 0, []

        def border(p: int) -> None:
            nonlocal order
            for c, (y, _) in self.edges[p].items():
                if y not in kept:
                    heapq.heappush(heap, (-self.visits[y], order, p, c))
                    order += 1

        kept = {0}
        border(0)
        while heap:
            _, _, p, c = heapq.heappop(heap)
            q = self.edges[p][c][0]
            if q in kept:
                continue
            same = next((s for s in settled if self._compatible(s, q)), None)
            if same is None:
                settled.append(q)
                kept.add(q)
                border(q)
            else:
                self.edges[p][c][0] = same
                self._fold(same, q)
                for s in settled:
                    border(s)

    def _logs(self) -> None:
        """Log probabilities of the states that can still be reached; half a string is left for the unseen."""
        names, stack = {0: 0}, [0]
        while stack:
            for y, _ in self.edges[stack.pop()].values():
                if y not in names:
                    names[y] = len(names)
                    stack.append(y)
        self.moves, self.stop, self.miss = [], [], []
        for state in names:
            total = self.visits[state] + 0.5
            self.moves.append({c: (names[y], math.log(n / total)) for c, (y, n) in self.edges[state].items()})
            self.stop.append(math.log(max(self.ends[state], 0.25) / total))
            self.miss.append(math.log(0.25 / 66 / total))
        del self.visits, self.ends, self.edges

    def log_likelihood(self, s: str) -> float:
        """Natural log of the probability per character, the end included."""
        at, total = 0, 0.0
        for c in s:
            step = self.moves[at].get(c)
            if step is None:
                total += self.miss[at]
                at = 0
            else:
                total += step[1]
                at = step[0]
        return (total + self.stop[at]) / (len(s) + 1)


class Grammars:
    """One automaton per kind, one for ordinary tokens, and what each kind's own values score."""

    def __init__(self, values: dict[str, list[str]]):
        ordinary = values.get("ordinary", [])
        self.ordinary = Automaton(ordinary) if ordinary else None
        self.kinds, self.limits = {}, {}
        for kind, strings in values.items():
            if kind == "ordinary" or len(strings) < VISITS:
                continue
            # every fourth value is held back to set the limits
            held, learned = strings[::4], [s for i, s in enumerate(strings) if i % 4]
            self.kinds[kind] = Automaton(learned)
            scores = sorted(self.kinds[kind].log_likelihood(s) for s in held)
            sizes = sorted(map(len, held))
            low = len(held) // 50
            self.limits[kind] = scores[low], sizes[low]
        self.least = max(1, min([CANDIDATE, *(shortest for _, shortest in self.limits.values())]))
        self.long = tokens(self.least)
        self.known: dict[str, bool] = {}

    def accepts(self, token: str) -> bool:
        """Whether some kind explains the token as well as its own values, and clearly better than ordinary text does."""
        if token not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            found = False
            for kind, automaton in self.kinds.items():
                least, _ = self.limits[kind]
                if (score := automaton.log_likelihood(token)) >= least:
                    found |= self.ordinary is None or score - self.ordinary.log_likelihood(token) >= LEAST_GAIN
            self.known[token] = found
        return self.known[token]

    def spans(self, text: str) -> tuple[list, list]:
        """(start, kind number, end) of the fixed patterns, and those with the learned spans added."""
        base = base_spans(text)
        if not self.kinds:
            return base, base
        more = [(s, 3, e) for s, e in candidates(text, base, self.long) if self.accepts(text[s:e])]
        return base, sorted(base + more) if more else base


def fewest(found: dict[tuple[str, int], set[str]], most: int) -> dict[tuple[str, int], set[str]]:
    """Of each kind and length class the values with the smallest hashes."""
    return {k: v if len(v) <= most else set(heapq.nsmallest(most, v, key=_rank)) for k, v in found.items()}


def _rank(value: str) -> tuple[int, str]:
    h = xxhash.xxh64_intdigest(value.encode("utf-8", "replace"), 42)
    return h - (1 << 64 if h >> 63 else 0), value


def labelled_values(docs: DataFrame) -> DataFrame:
    """(kind, size, value): values of the fixed patterns, and other tokens as kind ``ordinary``, from all texts in one scan.

    ``size`` is a token's length, up to CANDIDATE, and 0 for a pattern's value. A task gives out, of each kind and
    size, only the VALUES distinct values with the smallest hashes; the smallest of all are among them.
    """
    some, most = tokens(LEAST_ASSIGN), VALUES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], set[str]] = defaultdict(set)
        for _, texts in slices(batches, "text"):
            for text in texts:
                base = base_spans(text or "")
                for start, kind, end in base:
                    value = ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]
                    if len(value) <= VALUE_CHARS:
                        found[KINDS[kind], 0].add(value)
                for s, e in candidates(text or "", base, some):
                    if e - s <= VALUE_CHARS:
                        found["ordinary", min(e - s, CANDIDATE)].add(text[s:e])
            if sum(map(len, found.values())) > 200_000:
                found = defaultdict(set, fewest(found, most))
        rows = sorted((*k, value) for k, values in fewest(found, most).items() for value in values)
        yield pa.RecordBatch.from_pydict({"kind": pa.array([r[0] for r in rows], pa.string()), "size": pa.array([r[1] for r in rows], pa.int32()), "value": pa.array([r[2] for r in rows], pa.string())})

    return docs.select("text").where("text is not null").mapInArrow(run, "kind string, size int, value string")


def fit(docs: DataFrame) -> Grammars:
    """Automata of the labelled values, and of ordinary tokens of the lengths that candidates will have."""
    rows = cut(labelled_values(docs).dropDuplicates().withColumn("h", F.xxhash64("value")))

    def few(kind: str, least: int = 0) -> list[str]:
        return [r.value for r in rows.where((F.col("kind") == kind) & (F.col("size") >= least)).orderBy("h", "value").limit(VALUES).select("value").collect()]

    values = {kind: found for kind in ("assign", "access", "hex") if (found := few(kind))}
    ordinary = few("ordinary", Grammars(values).least)
    return Grammars(values | {"ordinary": ordinary} if ordinary else values)


def _digest(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, grammars: Grammars) -> DataFrame:
    """One row for each document: spans by kind, a digest of the fixed patterns' spans, and all spans."""
    model = docs.sparkSession.sparkContext.broadcast(grammars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            found = [model.value.spans(t or "") for t in texts]
            counts = np.array([[sum(k == i for _, k, _ in base) for i in range(3)] for base, _ in found], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), *(pa.array(c) for c in counts.T),
                pa.array([hashlib.sha256(_digest(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([_digest(a) for _, a in found], pa.string()),
            ], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, grammars: Grammars, mark: str = "[SECRET]") -> DataFrame:
    """Pipeline stage: every row, with each span (overlapping ones as one) replaced in its text."""
    model, at = docs.sparkSession.sparkContext.broadcast(grammars), docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        spans = model.value.spans(text)[1] if text else []
        out, reach = [], 0
        for start, _, end in spans:
            if start >= reach:
                out += [text[reach:start], mark]
            reach = max(reach, end)
        return "".join([*out, text[reach:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            yield part.set_column(at, part.schema.field(at), pa.array([clean(t) for t in texts], part.schema.field(at).type))

    return map_rows(docs, run)
