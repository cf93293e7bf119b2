"""Shared pieces of the training-data operators: scratch tables and vectorised word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)
#: Odd base of the polynomial hashes (modulo 2^64).
BASE = 0x2545F4914F6CDD1D

#: Separators of `[^\x20\x09-\x0D]+`.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators of plain words: every ASCII byte that is neither letter nor digit.
NON_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: ASCII lower-casing of bytes.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SAME = np.arange(256, dtype=np.uint8)


_temporary: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize writes inside the block, but for kept ones, are removed at its end: nothing lazy that
    was made inside may be used after it."""
    paths: list[str] = []
    _temporary.append(paths)
    try:
        yield
    finally:
        _temporary.pop()
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write a DataFrame once to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/apsis/{label}-{uuid.uuid4().hex}"
    if _temporary and not keep:
        _temporary[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside(rows: DataFrame, key: str, spread: str, salts: int = 64, **wanted: tuple[str, Column]) -> DataFrame:
    """rows with columns (name: ("min" | "max" | "sum" | "count", column)) of all rows that share their key.

    Like a window over the key, but rows of one key are dealt over salts by a hash of the column `spread`, so a key with a
    third of all rows is no single task: partial results per (key, salt) are merged and go back to those salts alone."""
    kinds = {"min": (F.min, F.min), "max": (F.max, F.max), "sum": (F.sum, F.sum), "count": (F.count, F.sum)}
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    parts = salted.groupBy(key, "_salt").agg(*[kinds[kind][0](column).alias(name) for name, (kind, column) in wanted.items()])
    whole = parts.groupBy(key).agg(*[kinds[kind][1](name).alias(name) for name, (kind, _) in wanted.items()], F.collect_list("_salt").alias("_salts"))
    return salted.join(whole.withColumn("_salt", F.explode("_salts")).drop("_salts"), [key, "_salt"]).drop("_salt")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_VALUE = mix((np.arange(256, dtype=U64) + U64(1)) * _GOLDEN)


def _power_table(n: int) -> np.ndarray:
    table = np.full(n, U64(BASE))
    table[0] = 1
    return np.cumprod(table, dtype=U64)


_powers = _power_table(256)


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n - 1 and perhaps more, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        _powers = _power_table(2 * n)
    return _powers


class Words:
    """Words of a block of texts: byte spans, the row each belongs to, and a 64-bit hash of each.

    `first[i]:first[i + 1]` are the words of row i.
    """

    def __init__(self, texts: pa.Array, separators: np.ndarray = BLANK, fold: np.ndarray = SAME):
        offsets, data = utf8(texts)
        n, lo = len(texts), int(offsets[0]) if len(offsets) else 0
        hi = int(offsets[-1]) if len(offsets) else 0
        data, offsets = data[lo:hi], offsets - lo
        self.data, self.offsets = data, offsets
        inside = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins, closes = inside.copy(), inside.copy()
        if len(data):
            begins[1:] &= ~inside[:-1] | edge[1:-1]
            closes[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(n), np.diff(self.first))
        self.hash = np.zeros(0, U64)
        if len(self.start):
            size = self.end - self.start
            at = np.concatenate(([0], np.cumsum(size)[:-1]))
            where = np.arange(int(size.sum())) - np.repeat(at, size)
            value = _BYTE_VALUE[fold[data[inside]]] * powers(int(size.max()))[where]
            self.hash = mix(np.add.reduceat(value, at))

    def __len__(self) -> int:
        return len(self.start)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash (modulo 2^64) of every `width` consecutive word hashes: sum of word[i + j] * BASE^j."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    power, block, done, total = 1, words, 0, None
    size = 1
    while True:
        if width & size:
            part = block[done : done + n] * U64(pow(BASE, done, 1 << 64))
            total = part if total is None else total + part
            done += size
        if done == width:
            return mix(total)
        block = block[:-size] + block[size:] * U64(pow(BASE, size, 1 << 64))
        size *= 2


def blocks(batch: pa.RecordBatch | pa.Table, text: str, limit: int = 1 << 20):
    """Slices of a batch with at most `limit` bytes of text each (a longer text comes alone).

    Before and after them Arrow's pool gives back what it no longer uses: it would keep the memory of earlier batches, and
    workers outlive their tasks."""
    pool = pa.default_memory_pool()
    pool.release_unused()
    column = batch.column(batch.schema.get_field_index(text))
    offsets, _ = utf8(column)
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    pool.release_unused()


def within(words: Words, width: int) -> np.ndarray:
    """Which of the windows that start at each word (as many as window_hashes gives) lie wholly in one row."""
    n = max(0, len(words) - width + 1)
    return np.arange(n) + width <= words.first[1:][words.row[:n]]


def is_in(values: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(members):
        return np.zeros(len(values), bool)
    return members[np.minimum(np.searchsorted(members, values), len(members) - 1)] == values
