"""Exact substring removal (operator 10): Rabin-Karp hashes of all fixed-length word windows, counted in Spark.

Plan. Texts are dealt once, by a hash of the row, into blocks of some megabytes. Each block sends only its distinct
window hashes, delta-packed into about ten bytes, to ranges of the hash space; each range tells every block which of
its hashes another block has too. The blocks (the same exchange, reused) then hash their texts again, mark the
windows repeated inside the block or elsewhere, and merge them into maximal intervals. A window that half of all
documents share is one hash per block, so no key is hot.

Cases: null text counts as empty; a text shorter than a window loses nothing; repeated rows count as repeats (rows,
not ids, are compared); an empty table gives an empty result; extra columns are ignored.
Windows are compared by 96 bits of two independent hashes: among n different windows n^2 / 2^97 pairs agree by chance,
about one in four hundred runs over 100 TB (2e13 words).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, blocks, mix, window_hashes, within

RESULT = "_id {id}, n_words bigint, n_removed bigint, removed array<struct<start: bigint, end: bigint>>, kept_text string"


class Windows:
    """Windows by a 64-bit hash and a 32-bit check from another hash, in order of both."""

    def __init__(self, hashes: np.ndarray, checks: np.ndarray):
        order = np.argsort(hashes)
        self.hash, self.check = hashes[order], checks[order]
        same = self.hash[1:] == self.hash[:-1]
        if (same & (self.check[1:] != self.check[:-1])).any():  # by chance alone
            order = np.lexsort((checks, hashes))
            self.hash, self.check = hashes[order], checks[order]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each distinct window begins, and how often it occurs."""
        if not len(self.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = (self.hash[1:] != self.hash[:-1]) | (self.check[1:] != self.check[:-1])
        at = np.concatenate(([0], np.flatnonzero(new) + 1))
        return at, np.diff(np.concatenate((at, [len(self.hash)])))

    def only(self, at: np.ndarray) -> Windows:
        out = object.__new__(Windows)
        out.hash, out.check = self.hash[at], self.check[at]
        return out

    def have(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Which of the given windows are among these distinct ones."""
        n = len(self.hash)
        if not n:
            return np.zeros(len(hashes), bool)
        at = np.searchsorted(self.hash, hashes)
        hit = np.zeros(len(hashes), bool)
        step, most = 0, int(np.diff(np.concatenate(([-1], np.flatnonzero(self.hash[1:] != self.hash[:-1]), [n - 1]))).max())
        while step < most:  # once, unless different windows share a 64-bit hash
            k = np.minimum(at + step, n - 1)
            hit |= (self.hash[k] == hashes) & (self.check[k] == checks)
            step += 1
        return hit


def _hashed(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and check of every window. The check is a Rabin-Karp hash too, of the words' hashes put through another mix."""
    return window_hashes(words.hash, width), (window_hashes(mix(words.hash ^ U64(0x5851F42D4C957F2D)), width) >> U64(32)).astype(np.uint32)


def _distinct(texts, width: int) -> tuple[Windows, np.ndarray]:
    """The block's distinct windows in order, and how often each occurs in it."""
    hashes, checks = [np.zeros(0, U64)], [np.zeros(0, np.uint32)]
    for part in blocks(texts, "_text"):
        words = Words(part.column("_text"))
        own = within(words, width)
        for every, found in zip((hashes, checks), _hashed(words, width), strict=True):
            every.append(found[own])
    windows = Windows(np.concatenate(hashes), np.concatenate(checks))
    at, times = windows.runs()
    return windows.only(at), times


def _bounds(hashes: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of the parts of a sorted hash array that fall into each equal range of the hash space."""
    step = -(-(1 << 64) // ranges)
    which = hashes // U64(step) if ranges > 1 else np.zeros(len(hashes), U64)
    at = np.concatenate(([0], np.flatnonzero(np.diff(which)) + 1, [len(hashes)])) if len(hashes) else np.zeros(1, int)
    return [(int(which[a]), int(a), int(b)) for a, b in zip(at[:-1], at[1:], strict=True)]


def _pack(windows: Windows, a: int, b: int) -> bytes:
    """Sorted hashes as first value and 6-byte differences (8-byte values where a difference is too large), then the checks."""
    hashes, checks = windows.hash[a:b], windows.check[a:b].astype("<u4").tobytes()
    gaps = np.diff(hashes)
    if len(gaps) and int(gaps.max()) >= 1 << 48:
        return b"\x08" + hashes.astype("<u8").tobytes() + checks
    return b"\x06" + hashes[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + checks


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide = packed[0] == 8
    n = (len(packed) - 1) // 12 if wide else (len(packed) - 3) // 10
    checks = np.frombuffer(packed, "<u4", n, len(packed) - 4 * n)
    if wide:
        return np.frombuffer(packed, "<u8", n, 1), checks
    short = np.frombuffer(packed, np.uint8, 6 * (n - 1), 9).reshape(-1, 6)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[0] = np.frombuffer(packed, np.uint8, 8, 1)
    gaps[1:, :6] = short
    return np.cumsum(gaps.view("<u8").ravel(), dtype=U64), checks


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, block_bytes: int = 8 << 20, range_hashes: int = 4 << 20) -> DataFrame:
    """Per row of docs: its id, n_words, n_removed, the removed word intervals and the text that is kept.

    A word goes if a window of `width` words over it occurs at any other place of the input. block_bytes and
    range_hashes bound what one task holds; they do not change the result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block_bytes))
    ranges = max(1, math.ceil(size / 5 / range_hashes))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("_id", "_text"), F.lit(n_blocks)).cast("int"))

    def send(table: pa.Table) -> pa.Table:
        windows, _ = _distinct(table, width)
        parts = _bounds(windows.hash, ranges)
        block = table.column("_block")[0].as_py()
        return pa.table({"_range": pa.array([r for r, _, _ in parts], pa.int64()), "_block": pa.array([block] * len(parts), pa.int32()), "_packed": pa.array([_pack(windows, a, b) for _, a, b in parts], pa.binary())})

    def compare(table: pa.Table) -> pa.Table:
        arrays = [_unpack(x.as_py()) for x in table.column("_packed")]
        every = Windows(*(np.concatenate([x[k] for x in arrays]) for k in (0, 1)))
        at, times = every.runs()
        again = every.only(at[times > 1])
        found, marks = [], []
        for k, own in enumerate(arrays):
            hit = again.have(*own)
            if hit.any():
                found.append(k)
                marks.append(np.packbits(hit).tobytes())
        return pa.table({"_range": table.column("_range").take(pa.array(found, pa.int64())), "_block": table.column("_block").take(pa.array(found, pa.int64())), "_marks": pa.array(marks, pa.binary())})

    def remove(texts: pa.Table, marks: pa.Table) -> pa.Table:
        windows, times = _distinct(texts, width)
        again = times > 1
        told = dict(zip(marks.column("_range").to_pylist(), marks.column("_marks").to_pylist(), strict=True))
        for r, a, b in _bounds(windows.hash, ranges):
            if r in told:
                again[a:b] |= np.unpackbits(np.frombuffer(told[r], np.uint8), count=b - a).astype(bool)
        repeated = windows.only(np.flatnonzero(again))
        out = {k: [] for k in ("n_words", "n_removed", "removed", "kept_text")}
        for part in blocks(texts, "_text"):
            words = Words(part.column("_text"))
            own = within(words, width)
            hit = np.zeros(len(own), bool)
            hit[own] = repeated.have(*(x[own] for x in _hashed(words, width)))
            cover = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(hit)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + width, -1)
            gone = np.cumsum(cover[:-1]) > 0
            data = words.data.tobytes()
            for i in range(part.num_rows):
                a, b = words.first[i], words.first[i + 1]
                lost = gone[a:b]
                kept = data[words.offsets[i] : words.offsets[i + 1]].split()
                edge = np.flatnonzero(np.diff(np.concatenate(([0], lost.view(np.int8), [0]))))
                if len(edge):
                    kept = [w for w, x in zip(kept, lost.tolist(), strict=True) if not x]
                out["n_words"].append(int(b - a))
                out["n_removed"].append(int(lost.sum()))
                out["removed"].append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                out["kept_text"].append(b" ".join(kept))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"_id": texts.column("_id"), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "removed": pa.array(out["removed"], span), "kept_text": pa.array(out["kept_text"], pa.binary()).cast(pa.string())})

    sent = dealt.groupBy("_block").applyInArrow(send, "_range bigint, _block int, _packed binary")
    told = sent.groupBy("_range").applyInArrow(compare, "_range bigint, _block int, _marks binary")
    schema = RESULT.format(id=dict(rows.dtypes)["_id"])
    return dealt.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(remove, schema).withColumnRenamed("_id", id_col)
