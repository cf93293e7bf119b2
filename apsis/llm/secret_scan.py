"""Secret scan with inferred formats (operator 4).

Base patterns find credentials by kind. Their values are the labelled examples from which grammar inference learns:
a prefix tree over character classes, whose statistically compatible states are merged (Hoeffding test, red-blue
order) into a probabilistic automaton per kind, and one more for ordinary long tokens. Every other candidate of every
text (16 or more key characters with a letter and a digit) is then scored by how much likelier a credential's format is than an ordinary token's, in bits per character.

One pass over whole texts finds base spans and candidates; the candidates are a small table, so scoring does not read
the texts again. Automata are fitted on a bounded sample (sample_per_kind distinct values with the smallest hash, none
longer than max_example characters: parameters), which does not depend on how rows are ordered or dealt to tasks; all
candidates of all rows are scored.

Cases: null text counts as empty; a very long text is scanned whole, in time that grows with its length; repeated rows give the
same spans; base spans of several kinds may overlap, and spans that tie come in the order of KINDS; a kind with fewer than min_examples labelled examples
(a parameter: too few to tell a format) adds no format; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, materialize

#: The base patterns, in the order in which kinds are listed, and the least characters of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs: the same as [0-9a-f]+ of 32 or more
KEYWORDS = ("passw", "secret", "token", "api")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "format")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) in code points: leftmost, not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, taken: list[tuple]) -> list[tuple[str, int, int, str]]:
    """Key-like tokens outside the base spans (in order of their start); those without a digit only serve as ordinary examples.
    Tokens and spans are walked side by side."""
    found, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while at < len(taken) and taken[at][1] < m.end():
            reach, at = max(reach, taken[at][2]), at + 1  # spans that begin before the token's end, and how far they go
        if reach <= m.start() and LETTER.search(m[0]):
            found.append(("candidate" if DIGIT.search(m[0]) else "ordinary", m.start(), m.end(), m[0]))
    return found


#: The character classes of the automata.
CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "L": "GHIJKLMNOPQRSTUVWXYZ"}
CLASS_OF = {c: k for k, members in CLASSES.items() for c in members}
SIZE_OF = {k: len(v) for k, v in CLASSES.items()}
END = "$"


@dataclass
class Automaton:
    """A probabilistic automaton: per state the counts of its symbols (END: stops) and where they lead."""

    counts: list[dict[str, int]] = field(default_factory=list)
    to: list[dict[str, int]] = field(default_factory=list)

    def bits(self, value: str) -> float:
        """log2 likelihood per character; an unseen symbol counts half an arrival."""
        state, total = 0, 0.0
        for c in value:
            k = CLASS_OF.get(c, c)
            total += self._log(state, k) - math.log2(SIZE_OF.get(k, 1))
            state = self.to[state].get(k, state) if state >= 0 else state
        return (total + self._log(state, END)) / max(1, len(value))

    def _log(self, state: int, symbol: str) -> float:
        seen = self.counts[state]
        return math.log2((seen.get(symbol, 0) + 0.5) / (sum(seen.values()) + 8))


def infer(examples: list[str], alpha: float = 0.05) -> Automaton:
    """Merge the compatible states of the examples' prefix tree, in red-blue order."""
    counts: list[dict[str, int]] = [{}]
    to: list[dict[str, int]] = [{}]
    for value in sorted(examples):
        state = 0
        for c in value:
            k = CLASS_OF.get(c, c)
            counts[state][k] = counts[state].get(k, 0) + 1
            if k not in to[state]:
                to[state][k] = len(counts)
                counts.append({})
                to.append({})
            state = to[state][k]
        counts[state][END] = counts[state].get(END, 0) + 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(a: int, b: int) -> bool:
        """Hoeffding's test on every symbol of two states, and of what they lead to."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            m, n = sum(counts[a].values()), sum(counts[b].values())
            if not m or not n:
                continue
            room = bound * (1 / math.sqrt(m) + 1 / math.sqrt(n))
            for k in counts[a].keys() | counts[b].keys():
                if abs(counts[a].get(k, 0) / m - counts[b].get(k, 0) / n) > room:
                    return True
                if k in to[a] and k in to[b]:
                    todo.append((to[a][k], to[b][k]))
        return False

    def fold(a: int, b: int) -> None:
        """Add the tree at b to the state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for k, n in counts[b].items():
                counts[a][k] = counts[a].get(k, 0) + n
            for k, child in to[b].items():
                if k in to[a]:
                    todo.append((to[a][k], child))
                else:
                    to[a][k] = child

    red = [0]
    while True:
        blue = [(r, k, s) for r in red for k, s in sorted(to[r].items()) if s not in red]
        if not blue:
            break
        r, k, s = max(blue, key=lambda x: (sum(counts[x[2]].values()), -x[2]))
        for other in red:
            if not differ(other, s):
                to[r][k] = other
                fold(other, s)
                break
        else:
            red.append(s)
    name = {s: i for i, s in enumerate(red)}
    return Automaton([dict(counts[s]) for s in red], [{k: name[t] for k, t in to[s].items()} for s in red])


@dataclass
class Formats:
    credentials: dict[str, Automaton]
    ordinary: Automaton
    margin: float

    def likelihood(self, value: str) -> float:
        """Bits per character by which the likeliest credential format beats the ordinary one."""
        return max((a.bits(value) for a in self.credentials.values()), default=-math.inf) - self.ordinary.bits(value)

    def added(self, found: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
        return [("format", a, b, v) for k, a, b, v in found if k == "candidate" and self.likelihood(v) >= self.margin]


class Smallest:
    """Which of the values that come by have been among the `size` distinct ones with the smallest MD5 so far."""

    def __init__(self, size: int):
        self.size, self.heap, self.held = size, [], set()

    def takes(self, value: str) -> bool:
        """False for a value that is held already, or that `size` held ones come before."""
        rank = -int.from_bytes(hashlib.md5(value.encode(), usedforsecurity=False).digest())
        if rank in self.held or (len(self.heap) >= self.size and (not self.heap or rank < self.heap[0])):
            return False
        self.held.add(rank)
        if len(self.heap) < self.size:
            heapq.heappush(self.heap, rank)
        else:
            self.held.remove(heapq.heapreplace(self.heap, rank))
        return True


def evidence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_per_kind: int = 600, max_example: int = 256) -> DataFrame:
    """Per row: _id, base (array of spans) and others (candidates, and of the ordinary tokens those that may be among the
    sample_per_kind distinct ones of at most max_example characters with the smallest MD5). Written once."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smallest = Smallest(sample_per_kind)
        for batch in batches:
            for part in blocks(batch, "_text", 8 << 20):
                base, others = [], []
                for text in part.column(1).to_pylist():
                    own = base_spans(text)
                    more = candidates(text, own)
                    plain = [s for s in more if s[0] == "ordinary" and len(s[3]) <= max_example and smallest.takes(s[3])]
                    base.append([dict(zip(("kind", "start", "end", "value"), s, strict=True)) for s in own])
                    others.append([dict(zip(("kind", "start", "end", "value"), s, strict=True)) for s in [*(s for s in more if s[0] == "candidate"), *plain]])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, pa.list_(SPAN)), pa.array(others, pa.list_(SPAN))], names=["_id", "base", "others"])

    span = "array<struct<kind: string, start: bigint, end: bigint, value: string>>"
    return materialize(rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, base {span}, others {span}"), "secret-evidence")


def learn(found: DataFrame, sample_per_kind: int = 600, max_example: int = 256, margin: float = 0.6, alpha: float = 0.05, min_examples: int = 10) -> Formats:
    """Automata from the labelled base values and the ordinary tokens of an evidence table, which must have been made
    with no smaller sample_per_kind and the same max_example."""

    def sample(column: str, kind: str, rank: Callable[[str], Column] = F.xxhash64) -> list[str]:
        spans = found.select(F.explode(column).alias("s")).where((F.col("s.kind") == kind) & (F.length("s.value") <= max_example))
        values = spans.select(F.col("s.value").alias("v")).distinct()
        return [r["v"] for r in values.orderBy(rank("v"), "v").limit(sample_per_kind).collect()]

    known = {kind: sample("base", kind) for kind in KINDS[:3]}
    return Formats({k: infer(v, alpha) for k, v in known.items() if len(v) >= min_examples}, infer(sample("others", "ordinary", F.md5), alpha), margin)


def score(found: DataFrame, formats: Formats, id_col: str = "doc_id") -> DataFrame:
    """Per row: id and spans (array of kind, start, end), base ones and added formats, by start and listed kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = [[dict(zip(("kind", "start", "end", "value"), s, strict=True)) for s in formats.added([(x["kind"], x["start"], x["end"], x["value"]) for x in own])] for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(added, pa.list_(SPAN))], names=["_id", "added"])

    # Most rows have no candidate: only those that have one go through Python.
    types = dict(found.dtypes)
    has = F.exists("others", lambda s: s["kind"] == "candidate")
    scored = found.where(has).select(F.struct("_id", "base").alias("_row"), "others")
    struct_type = scored.schema["_row"].dataType.simpleString()
    scored = scored.mapInArrow(run, f"_id {struct_type}, added {types['others']}").select(F.col("_id._id").alias("_id"), F.col("_id.base").alias("base"), "added")
    rest = found.where(~has).select("_id", "base", F.array().cast(types["others"]).alias("added"))
    order = F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), F.array_position(F.lit(list(KINDS)), s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return scored.unionByName(rest).select(F.col("_id").alias(id_col), F.transform(F.array_sort(order), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.6) -> DataFrame:
    """Per row of docs: id and all its spans."""
    found = evidence(docs, id_col, text_col)
    return score(found, learn(found, margin=margin), id_col)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, formats: Formats, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span of a text replaced by a mark; all columns and rows stay. Null texts stay null."""
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        own = base_spans(text)
        spans = sorted((a, b) for _, a, b, _ in [*own, *formats.added(candidates(text, own))])
        out, to = [], 0
        for a, b in spans:
            if a >= to:
                out += [text[to:a], mark]
            to = max(to, b)
        return "".join([*out, text[to:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(at).type
            for part in blocks(batch, text_col, 8 << 20):
                texts = pa.array([clean(t) for t in part.column(at).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(part.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
