"""Packing into fixed-size sequences by vector bin packing (operator 8).

Pieces have three sizes: tokens, segments (1) and loss-bearing tokens. A bin takes, of the pieces at hand, the one
whose size vector has the largest dot product with what the bin has left (each dimension over its limit); when none
fits whole, the best one is cut to fill the bin; when no loss-bearing token is left to a bin, it is filled with tokens that bear
none. Every input partition packs its own rows with a bounded pool of pieces, so nothing is shuffled and memory does not
grow with the input. A bin that cannot be filled (the end of a partition, or a segment or loss limit) is split into
sequences whose lengths are powers of two, which need no padding.

Ids come from the `tokenizers` library. The vocabulary file is read on the driver and broadcast (two megabytes).
Sequence ids are partition * 2^33 + number: unique, and the same on a rerun of the task.
Cases: null text is empty and gives a piece with the end token alone; a long text fills whole sequences by itself;
repeated rows, and pieces that tie, are packed separately, in the order in which they come; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

#: Parts of texts a worker remembers; beyond it begins anew.
CACHE = 1_200_000
_encoders: WeakKeyDictionary[Broadcast, "Encoder"] = WeakKeyDictionary()


class Encoder:
    """Ids of a byte-level tokenizer, with a bounded memory of parts of texts.

    A cut before a single blank between other characters, on either side of a single line feed between them, or between an
    ASCII letter and an ASCII mark behind it never divides a pre-token, so a part between cuts has the same ids wherever it
    stands. Arrow finds the different parts of a block, and the new ones are encoded in two calls: those that begin with a
    blank in one text, where every token that begins with a blank begins a part, and the others as lines of another. A text with
    other white space or with an added token's string is encoded as it is; so is every text if the vocabulary has other pre-tokens.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.bpe = Tokenizer.from_str(vocabulary)
        self.begins = np.zeros(self.bpe.get_vocab_size(), bool)
        self.begins[[i for t, i in self.bpe.get_vocab().items() if t.startswith("\u0120")]] = True  # how the vocabulary writes a blank
        self.added = [t.content for t in self.bpe.get_added_tokens_decoder().values()]
        self.line = self._ids("\n")
        rules = json.loads(vocabulary)
        before = rules["pre_tokenizer"] or {}
        self.cuts = len(self.line) == 1 and not rules["normalizer"] and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        self.words: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.bpe.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _plain(self, text: str) -> bool:
        odd = not text.replace("\n", "").isprintable() or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in " \n" or text[-1:] in " \n"
        return self.cuts and not odd and not any(t in text for t in self.added)

    def _learn(self, parts: list[str]) -> None:
        words, others = [x for x in parts if x[0] == " "], [x for x in parts if x[0] not in " \n"]
        ids = self._ids("".join(words))
        self._remember(words, ids, np.flatnonzero(self.begins[ids]), 0)
        ids = self._ids("".join("\n" + x for x in others))
        self._remember(others, ids, np.flatnonzero(ids == self.line), 1)
        self.words["\n"] = self.line.tobytes()

    def _remember(self, parts: list[str], ids: np.ndarray, at: np.ndarray, lead: int) -> None:
        """ids hold the parts one after the other; what belongs to one begins at `at`, with `lead` ids before its own."""
        if len(at) != len(parts):
            raise ValueError("the vocabulary does not mark the beginning of parts")
        packed, begins, ends = ids.tobytes(), 4 * (at + lead), 4 * np.append(at, len(ids))[1:]
        self.words.update((part, packed[a:b]) for part, a, b in zip(parts, begins.tolist(), ends.tolist(), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > CACHE:
            self.words.clear()
        plain = [self._plain(text) for text in texts]
        whole = iter(self._by_parts([text.encode() for text, is_plain in zip(texts, plain, strict=True) if is_plain]) if any(plain) else ())
        return [next(whole) if is_plain else self._ids(text) for text, is_plain in zip(texts, plain, strict=True)]

    def _by_parts(self, texts: list[bytes]) -> list[np.ndarray]:
        parts, firsts = cut(texts)
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = [*map(self.words.get, distinct)]
        new = [k for k, ids in enumerate(found) if ids is None]
        self._learn([distinct[k] for k in new])
        for k in new:
            found[k] = self.words[distinct[k]]
        ids = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = coded.indices.to_numpy()
        sizes = size[which]
        ends = np.cumsum(sizes)
        at = np.repeat((np.cumsum(size) - size)[which] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return np.split(ids[at], ends[firsts[1:] - 1])


#: A cut is where a byte's value in _AFTER is above that of the byte before it in _BEFORE.
_BEFORE = bytes(0 if b == 10 else 1 if b < 128 and chr(b).isalpha() else 2 for b in range(256))
_AFTER = bytes(3 if b in (10, 32) else 2 if 32 < b < 127 and not chr(b).isalnum() else 1 for b in range(256))


def cut(texts: list[bytes]) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The parts of some texts, none of them empty, and the number of each text's first part."""
    whole, starts = b"".join(texts), np.cumsum([0, *map(len, texts[:-1])])
    begins = np.ones(len(whole), bool)
    begins[1:] = np.frombuffer(whole.translate(_AFTER), np.uint8)[1:] > np.frombuffer(whole.translate(_BEFORE), np.uint8)[:-1]
    begins[starts] = True
    at = np.append(np.flatnonzero(begins), len(whole))
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(whole)), np.searchsorted(at, starts)


def encoder(vocabulary: Broadcast) -> Encoder:
    """One encoder per worker process and broadcast vocabulary. A worker that goes on to tasks without it drops the
    broadcast, and with it the encoder and its words."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary.value)
    return _encoders[vocabulary]


@lru_cache(maxsize=4)
def shared(context: SparkContext, vocabulary: str) -> Broadcast:
    """One broadcast per session and vocabulary, so that packing jobs that follow one another find the workers' words."""
    return context.broadcast(vocabulary)


@dataclass
class Limits:
    """Of one sequence. loss counts tokens that bear loss."""

    tokens: int = 1024
    segments: int = 5
    loss: int = 1008


@dataclass
class Document:
    """Ids with the end token; those from `prompt` to the end token bear loss."""

    key: object
    ids: np.ndarray
    prompt: int

    def loss(self, a: int, b: int) -> int:
        return max(0, min(b, len(self.ids) - 1) - max(a, self.prompt))

    def within(self, a: int, b: int, room: int) -> int:
        """Where the longest piece from a, to b at most, ends that bears loss in at most `room` tokens."""
        return b if self.loss(a, b) <= room else max(a, self.prompt) + room


class Packer:
    """Packs pieces (document, from, to) as they come; keeps at most `pool` of them."""

    def __init__(self, limits: Limits, first_sequence: int, pool: int = 256):
        self.limits, self.next, self.pool = limits, first_sequence, pool
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
        self.size = np.zeros((pool + 1, 3))  # tokens, segments, loss of the pieces at hand
        self.lead = np.zeros(pool + 1, np.int64)  # how many tokens before the first that bears loss
        self.held: list[tuple[Document, int, int]] = []
        self.bin: list[tuple[Document, int, int]] = []
        self.left = self.cap.copy()
        self.done: list[tuple[Document, int, int, int, int]] = []  # document, from, to, sequence, offset

    def add(self, doc: Document) -> None:
        """A whole document; what is longer than a sequence fills sequences by itself where the loss limit lets it."""
        at, n, whole = 0, len(doc.ids), self.limits.tokens
        while at < n:
            to = doc.within(at, min(n, at + whole), self.limits.loss)
            if to - at == whole:
                self._emit([(doc, at, to)])
            else:
                self._hold(doc, at, to)
                while len(self.held) >= self.pool:
                    self._step()
            at = to

    def _hold(self, doc: Document, a: int, b: int) -> None:
        k = len(self.held)
        self.size[k] = b - a, 1, doc.loss(a, b)
        self.lead[k] = doc.within(a, b, 0) - a
        self.held.append((doc, a, b))

    def _take(self, k: int) -> tuple[Document, int, int]:
        piece, last = self.held[k], len(self.held) - 1
        self.held[k], self.size[k], self.lead[k] = self.held[last], self.size[last], self.lead[last]
        self.held.pop()
        return piece

    def _put(self, doc: Document, a: int, b: int) -> None:
        self.bin.append((doc, a, b))
        self.left -= b - a, 1, doc.loss(a, b)

    def _step(self) -> None:
        """Put one more piece into the open bin, or close it."""
        n = len(self.held)
        size = self.size[:n]
        fits = (size <= self.left).all(1)
        score = size @ (self.left / self.cap**2)
        if fits.any():
            self._put(*self._take(int(np.argmax(np.where(fits, score, -1)))))
        elif self.left[1] >= 1 and (self.left[2] >= 1 or self.lead[:n].any()):
            # Without room for loss, the piece that begins with the most tokens that bear none.
            doc, a, b = self._take(int(np.argmax(score if self.left[2] >= 1 else self.lead[:n])))
            cut = doc.within(a, min(b, a + int(self.left[0])), int(self.left[2]))
            self._put(doc, a, cut)
            self._hold(doc, cut, b)
        else:
            self._close()
        if self.left[0] == 0:
            self._close()

    def _close(self) -> None:
        total = sum(b - a for _, a, b in self.bin)
        while self.bin:
            take = total if total == self.limits.tokens else 1 << (total.bit_length() - 1)
            part, room = [], take
            while room:
                doc, a, b = self.bin[0]
                part.append((doc, a, min(b, a + room)))
                if b - a > room:
                    self.bin[0] = (doc, a + room, b)
                else:
                    self.bin.pop(0)
                room -= part[-1][2] - a
            self._emit(part)
            total -= take
        self.left = self.cap.copy()

    def _emit(self, part: list[tuple[Document, int, int]]) -> None:
        at = 0
        for doc, a, b in part:
            self.done.append((doc, a, b, self.next, at))
            at += b - a
        self.next += 1

    def finish(self) -> None:
        while self.held:
            self._step()
        self._close()


def pack(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None, end_id: int = 0, loss_from: str | None = None, prompt_share: float = 0.125) -> DataFrame:
    """One row per piece: id, start, length, ids (array of int), ids_crc32, doc_tokens, loss_tokens, sequence_id, offset.

    A document is its ids, then end_id, which bears no loss. Its prompt bears none either: the tokens of what stands before the
    code point in the column loss_from (a null: no prompt), encoded alone; without such a column the first
    floor(prompt_share * ids) of its ids. vocabulary_path: a `tokenizers` file of the byte-level kind.
    """
    limits = limits or Limits()
    begin = F.col(loss_from) if loss_from else F.lit(-1)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(begin, F.lit(0)).cast("bigint").alias("_from"))
    id_type = rows.schema["_id"].dataType
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = shared(docs.sparkSession.sparkContext, file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        packer = Packer(limits, TaskContext.get().partitionId() << 33)
        kind = None
        for batch in batches:
            for part in blocks(batch, "_text"):
                kind = part.schema.field("_id").type
                texts, starts = part.column(1).to_pylist(), part.column(2).to_pylist()
                prompts = bpe.encode([t[: max(0, k)] for t, k in zip(texts, starts, strict=True)]) if loss_from else texts
                for key, ids, begin, prompt in zip(part.column(0).to_pylist(), bpe.encode(texts), starts, prompts, strict=True):
                    packer.add(Document(key, np.append(ids, np.uint32(end_id)), int(prompt_share * len(ids)) if begin < 0 else min(len(prompt), len(ids))))
                yield table(packer, kind)
        packer.finish()
        if kind is not None:
            yield table(packer, kind)

    def table(packer: Packer, kind) -> pa.RecordBatch:
        done, packer.done = packer.done, []
        pieces = [doc.ids[a:b] for doc, a, b, *_ in done]
        sizes = np.array([len(x) for x in pieces], np.int64)
        ids = np.concatenate(pieces) if done else np.zeros(0, np.uint32)
        whole = lambda values: pa.array(values, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([doc.key for doc, *_ in done], kind),
                whole([a for _, a, *_ in done]),
                pa.array(sizes),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(ids.view(np.int32))),
                whole([zlib.crc32(x) for x in pieces]),
                whole([len(doc.ids) for doc, *_ in done]),
                whole([doc.loss(a, b) for doc, a, b, *_ in done]),
                whole([x[3] for x in done]),
                whole([x[4] for x in done]),
            ],
            names=["_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset"],
        )

    schema = f"_id {id_type.simpleString()}, start bigint, length bigint, ids array<int>, ids_crc32 bigint, doc_tokens bigint, loss_tokens bigint, sequence_id bigint, offset bigint"
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
