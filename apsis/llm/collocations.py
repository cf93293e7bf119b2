"""Collocations: the best phrases of two to four words of every language, found best-first.

A phrase is counted only if what is known of its parts leaves it a chance; pairs, only of words that occur often enough. With a = f(phrase), a cut into l = f(first part) and
r = f(rest) scores floor(SCALE * a / (l + r)), and the lowest cut counts. No part of a phrase is rarer than the phrase, and
x / (x + c) grows with x, so a prefix p bounds every phrase that begins with it: its score is at most
SCALE * f(p) / (f(p[:k]) + f(p)) for each cut k; suffixes bound alike. A language's threshold starts at the score of a rank
among its pairs of words; the frontier is what can still reach it (and what tells whether such phrases are dropped). Where
fewer than `top` phrases survive at or above the threshold, it is lowered and the frontier grown by what was not counted before.
In the end every phrase at or above the threshold is known, ties included, so the first `top` are exact.

A phrase is dropped for a longer one that holds it nearly as often. It is enough to look at phrases of one word more: between a
phrase and a longer one that holds it stands one of one word more, at least as frequent as the longer one.

Words are numbered exactly within a block of texts and phrases are counted in Spark by their text, so nothing rests on hashes but
the frontier's filters: bitmaps of fixed size that let some phrases through in vain, and none be missed.

Cases: null texts are empty; a null language is "und"; a text beyond the size of a block is counted in parts that share three
words; repeated rows count as often as they stand; ties of scores go by count, then by the phrase's bytes; an empty table has no
rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, LOWER, U64, Words, blocks, materialize, mix, utf8
from .ordering import BROADCAST_ROWS

TOP, LEAST, WORDS = 2000, 30, 4
SCALE, LONGER = 2_000_000, 80
#: Bytes of text in a block; bits of a frontier's filter.
BLOCK, FILTER_BITS = 2 << 20, 25

_STOP, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP[[0x20, 0x09]] = True
_GAP |= _STOP


def _dense(keys: np.ndarray, below: int = 1 << 62) -> tuple[np.ndarray, np.ndarray]:
    """(a number from 0 for each key, the key of each number). Keys under a small bound need no hashing."""
    if below <= 4 * len(keys):
        met = np.zeros(below, bool)
        met[keys] = True
        return (np.cumsum(met) - 1)[keys], np.flatnonzero(met)
    coded = pa.array(keys).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy()


class Grams:
    """Runs of words within the pieces of a block of texts. id[m][i] numbers the run of m words that begins at word i (-1:
    none); the first `lead` words were counted before."""

    def __init__(self, langs: pa.Array, texts: pa.Array, lead: int = 0):
        offsets, data = utf8(texts)
        lo, hi = int(offsets[0]), int(offsets[-1])
        low, offsets = LOWER[data[lo:hi]], offsets - lo
        stop, inside = _STOP[low], ~_GAP[low]
        edge = np.zeros(len(low) + 1, bool)
        edge[offsets] = True
        begins, closes = inside.copy(), inside.copy()
        if len(low):
            begins[1:] &= ~inside[:-1] | edge[1:-1]
            closes[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(closes) + 1
        self.lead = lead
        row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(self.start, offsets)))
        piece = np.cumsum(stop, dtype=np.int32)[self.start]
        # joined[i]: word i + 1 stands in the same piece as word i.
        self.joined = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        at = np.concatenate(([0], np.cumsum(self.end - self.start)))
        words = pa.LargeStringArray.from_buffers(len(self.start), pa.py_buffer(at), pa.py_buffer(low[inside])).dictionary_encode()
        self.vocabulary = words.dictionary
        spoken = pc.fill_null(langs, "und").dictionary_encode()
        self.langs = spoken.dictionary
        lang = spoken.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        ids, known = _dense(lang * len(self.vocabulary) + words.indices.to_numpy(), len(self.langs) * len(self.vocabulary))
        self.word, self.lang = known % max(1, len(self.vocabulary)), known // max(1, len(self.vocabulary))
        self.id = {1: ids}
        self.keys: dict[int, np.ndarray] = {}

    def extend(self, m: int, wanted: np.ndarray | None = None) -> None:
        """Numbers the runs of m words, those that begin at wanted words or all."""
        n, u = len(self.start), len(self.word)
        ok = np.zeros(n, bool)
        if n >= m:
            ok[: n - m + 1] = self.joined[m - 2 :] & (self.id[m - 1][: n - m + 1] >= 0)
        if wanted is not None:
            ok &= wanted
        self.id[m] = np.full(n, -1)
        where = np.flatnonzero(ok)
        self.id[m][where], self.keys[m] = _dense(self.id[m - 1][where] * u + self.id[1][where + m - 1])

    def parts(self, m: int) -> list[np.ndarray]:
        """The words (numbers of id[1]) of each run of m words."""
        run, out = np.arange(len(self.word)) if m == 1 else self.keys[m], []
        for k in range(m, 1, -1):
            out.append(run % len(self.word))
            run = run // len(self.word)
            run = run if k == 2 else self.keys[k - 1][run]
        return [run, *out[::-1]]

    def counted(self, m: int) -> pa.RecordBatch:
        """lang, phrase and count of the runs of m words whose last word is past the lead."""
        of = self.id[m][max(0, self.lead - m + 1) :]
        n = np.bincount(of[of >= 0], minlength=len(self.keys[m]) if m > 1 else len(self.word))
        words = [part[n > 0] for part in self.parts(m)]
        texts = [self.vocabulary.take(pa.array(self.word[w])) for w in words]
        phrase = texts[0] if m == 1 else pc.binary_join_element_wise(*texts, pa.scalar(" ", pa.large_string()))
        return _row(self.langs.take(pa.array(self.lang[words[0]])), phrase, n[n > 0])

    def hashes(self, m: int) -> np.ndarray:
        """Hash of each run of m words."""
        language = np.array([zlib.crc32(x.encode()) for x in self.langs.to_pylist()], U64)
        word = Words(self.vocabulary).hash[self.word] + mix(language)[self.lang] if len(self.word) else np.zeros(0, U64)
        return _chain([word[p] for p in self.parts(m)])


def _chain(words: list[np.ndarray]) -> np.ndarray:
    out = mix(words[0])
    for w in words[1:]:
        out = mix(out * U64(BASE) + w)
    return out


def _row(langs: pa.Array, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs.cast(pa.string()), phrases.cast(pa.string()), pa.array(n.astype(np.int64))], ["lang", "phrase", "n"])


def _grams(batch: pa.RecordBatch, limit: int) -> Iterator[Grams]:
    """Blocks of a batch (lang, text); a longer text comes in parts, each led by the last words of the one before."""
    for part in blocks(batch, "text", limit):
        langs, texts = part.column("lang"), part.column("text")
        offsets, data = utf8(texts)
        data = data[offsets[0] : offsets[-1]]
        if len(data) <= limit:
            yield Grams(langs, texts)
            continue
        begin, done, lead = 0, 0, 0
        while done < len(data):
            to = done + limit
            while to < len(data):  # on to the next gap, so that no word is cut
                gap = np.flatnonzero(_GAP[data[to : to + limit]])
                to = min(len(data), to + (int(gap[0]) if len(gap) else limit))
                if len(gap):
                    break
            to = min(to, len(data))
            grams = Grams(langs, pa.array([data[begin:to].tobytes().decode()], pa.large_string()), lead)
            yield grams
            lead = min(WORDS - 1, len(grams.start))
            begin, done = begin + (int(grams.start[-lead]) if lead else to - begin), to


COUNTS = "lang string, phrase string, n bigint"


def _summed(counts: DataFrame, least: int) -> DataFrame:
    return counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("phrase") == ""))


def _words(docs: DataFrame, least: int, limit: int) -> DataFrame:
    """Words that occur often enough, and the number of all words of a language as its phrase of no words."""

    def work(batches):
        for batch in batches:
            for grams in _grams(batch, limit):
                words = grams.counted(1)
                totals = pa.table([words.column("lang"), words.column("n")], ["lang", "n"]).group_by("lang").aggregate([("n", "sum")])
                yield _row(totals.column("lang").combine_chunks(), pa.array([""] * len(totals)), totals.column("n_sum").to_numpy())
                yield words

    return _summed(docs.mapInArrow(work, COUNTS), least)


def _bitmap(phrases: DataFrame, bits: int) -> np.ndarray:
    """A filter of phrases (lang, phrase) of equal length. At most 2 ** bits / 64 rows come to the driver."""

    def work(batches):
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            language = mix(np.array([zlib.crc32(x.encode()) for x in langs.dictionary.to_pylist()], U64))[langs.indices.to_numpy()]
            words = Words(batch.column(1))
            word = words.hash + language[words.row] if len(words) else words.hash
            m = len(words) // max(1, batch.num_rows)
            slot = _chain([word[k::m] for k in range(m)]) >> U64(64 - bits) if m else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array((slot >> U64(6)).astype(np.int64)), pa.array((U64(1) << (slot & U64(63))).view(np.int64))], ["at", "bits"])

    found = phrases.select("lang", "phrase").mapInArrow(work, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), U64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(U64)
    return out


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> U64(64 - (len(bitmap).bit_length() + 5))
    return (bitmap[slot >> U64(6)] >> (slot & U64(63))) & U64(1) == 1


def _long(docs: DataFrame, m: int, rounds: list[tuple[np.ndarray, ...]], least: int, limit: int) -> DataFrame:
    """Counts of the phrases of m words in the frontier of the last round, without those of the rounds before. A round has
    filters of phrases of m - 1 words: of prefixes and of suffixes that a phrase may grow from, either (m = 3, since phrases of four
    words need the counts of both their threes) or both, and of those that need all their longer phrases."""
    shared = docs.sparkSession.sparkContext.broadcast(rounds)

    def work(batches):
        filters = shared.value
        for batch in batches:
            for grams in _grams(batch, limit):
                for k in range(2, m):
                    grams.extend(k)
                head = grams.id[m - 1]
                tail = np.concatenate((head[1:], [-1])) if len(head) else head
                hashes, wanted = grams.hashes(m - 1), np.zeros(len(head), bool)
                for k, (prefixes, suffixes, whole) in enumerate(filters):
                    grows = [np.concatenate((_has(f, hashes), [False])) for f in (prefixes, suffixes, whole)]
                    pair = (grows[0][head] | grows[1][tail]) if m == 3 else (grows[0][head] & grows[1][tail])
                    rule = pair | grows[2][head] | grows[2][tail]
                    wanted = rule & ~wanted if k == len(filters) - 1 else wanted | rule
                grams.extend(m, wanted)
                yield grams.counted(m)

    return _summed(docs.mapInArrow(work, COUNTS), least)


def _scored(rows: DataFrame, cuts: list[tuple[str, str]], prefix: list[str], suffix: list[str]) -> DataFrame:
    """rows (a, counts of parts) with l, r and score of the lowest cut, and bounds of what begins (grow) or ends (lead) with the
    phrase, from the counts of its prefixes and suffixes. A cut without both counts gives no score."""
    whole = lambda x: f"cast({x} as decimal(20,0))"
    share = lambda l, r: f"cast({SCALE} as decimal(10,0)) * {whole('a')} div ({whole(l)} + {whole(r)})"
    each = F.array(*[F.struct(F.expr(share(l, r)).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r")) for k, (l, r) in enumerate(cuts, 1)])
    known = F.lit(True)
    for c in {c for cut in cuts for c in cut}:
        known = known & F.col(c).isNotNull()
    rows = rows.withColumn("_cut", F.when(known, F.array_min(each)))
    bound = lambda parts: F.least(*[F.expr(share(c, "a")) for c in parts], F.lit(SCALE))
    return rows.select("lang", "phrase", "a", *[c for c in rows.columns if c.startswith("f_")], "_cut.l", "_cut.r", "_cut.score", bound(prefix).alias("grow"), bound(suffix).alias("lead"))


def _first(k: int) -> Column:
    return F.substring_index("phrase", " ", k)


def _last(k: int) -> Column:
    return F.substring_index("phrase", " ", -k)


def _small(rows: DataFrame) -> DataFrame:
    """A written table, broadcast if it is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def mine(docs: DataFrame, top: int = TOP, least: int = LEAST, rank: int | None = None, text: str = "text", lang: str = "lang", limit: int = BLOCK, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score. rank: that of the pair of words whose score
    is a language's first threshold (default: twice top); it goes up eightfold a round."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    base = materialize(_words(texts, least, limit), "phrases-1")
    words, totals = base.where("phrase <> ''").select("lang", F.col("phrase").alias("word"), F.col("n").alias("f")), base.where("phrase = ''").select("lang", "n")
    often = _bitmap(words.withColumnRenamed("word", "phrase"), filter_bits)
    pairs = _long(texts, 2, [(often, often, np.zeros_like(often))], least, limit).select("lang", "phrase", F.col("n").alias("a"), _first(1).alias("w1"), _last(1).alias("w2"))
    named = lambda side: words.select("lang", F.col("word").alias(f"w{side}"), F.col("f").alias(f"f_{side}"))
    two = materialize(_scored(pairs.join(named(1), ["lang", "w1"]).join(named(2), ["lang", "w2"]), [("f_1", "f_2")], ["f_1"], ["f_2"]), "phrases-2")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")

    filters: dict[int, list] = {3: [], 4: []}
    longer: dict[int, DataFrame] = {}
    settled: DataFrame | None = None
    wanted = rank or 2 * top
    while True:
        # The threshold of a language; 0 where it has no such rank: then all that occurs often enough is counted.
        now = _score_of_rank(two, wanted).withColumnRenamed("score", "tau")
        if settled is not None:
            now = now.join(settled.select("lang", F.col("tau").alias("_tau"), "done"), "lang").select("lang", F.when(F.col("done"), F.col("_tau")).otherwise(F.least("tau", "_tau")).alias("tau"))
        bars = _small(materialize(now, "phrases-bars"))

        def frontier(table: DataFrame) -> tuple[np.ndarray, ...]:
            held = table.join(bars, "lang")
            return tuple(_bitmap(held.where(F.col(c) >= F.col("tau")), filter_bits) for c in ("grow", "lead", "score"))

        tables = {2: two}
        for m in (3, 4):
            filters[m].append(frontier(tables[m - 1]))
            counts = materialize(_long(texts, m, filters[m], least, limit), f"phrases-{m}")
            longer[m] = counts if m not in longer else longer[m].unionByName(counts)
            tables[m] = materialize(_with_parts(longer[m], tables, m), f"phrases-{m}-parts")
        found = materialize(_surviving(tables, bars), "phrases-kept")
        held = found.groupBy("lang").agg(F.count("*").alias("_n"))
        settled = materialize(bars.join(held, "lang", "left").select("lang", "tau", ((F.col("tau") == 0) | (F.coalesce("_n", F.lit(0)) >= top)).alias("done")), "phrases-settled")
        if settled.where("not done").isEmpty():
            break
        wanted *= 8
    # What lies under the score of the last rank goes first; ties at it stay for the order.
    ends = _score_of_rank(found, top).select("lang", F.col("score").alias("_end"))
    ahead = found.join(_small(materialize(ends, "phrases-ends")), "lang").where(F.col("score") >= F.col("_end")).drop("_end")
    out = ahead.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= top)
    return out.join(_small(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))


def _score_of_rank(rows: DataFrame, rank: int) -> DataFrame:
    """The score at a rank of each language, 0 where it has no such rank. Scores are counted first: a language has SCALE / 2 + 1
    of them at most, however many phrases there are."""
    counts = rows.groupBy("lang", "score").agg(F.count("*").alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)))
    reached = F.max(F.when(F.col("_upto") >= rank, F.col("score")))
    return upto.groupBy("lang").agg(F.coalesce(reached, F.lit(0)).cast("bigint").alias("score"))


def _with_parts(counts: DataFrame, tables: dict[int, DataFrame], m: int) -> DataFrame:
    """Phrases of m words with the counts of their parts: f_1, f_2, f_3 of the first words, f_9, f_8, f_7 of the last one, two, three."""
    rows = counts.select("lang", "phrase", F.col("n").alias("a"), _first(m - 1).alias("_head"), _last(m - 1).alias("_tail"))
    below = tables[m - 1]
    if m == 3:
        head = below.select("lang", F.col("phrase").alias("_head"), F.col("f_1").alias("f_1"), F.col("a").alias("f_2"))
        tail = below.select("lang", F.col("phrase").alias("_tail"), F.col("f_2").alias("f_9"), F.col("a").alias("f_8"))
        joined = rows.join(head, ["lang", "_head"]).join(tail, ["lang", "_tail"])
        return _scored(joined, [("f_1", "f_8"), ("f_2", "f_9")], ["f_1", "f_2"], ["f_9", "f_8"])
    head = below.select("lang", F.col("phrase").alias("_head"), "f_1", "f_2", F.col("a").alias("f_3"))
    tail = below.select("lang", F.col("phrase").alias("_tail"), "f_9", "f_8", F.col("a").alias("f_7"))
    joined = rows.join(head, ["lang", "_head"], "left").join(tail, ["lang", "_tail"], "left")
    return _scored(joined, [("f_1", "f_7"), ("f_2", "f_8"), ("f_3", "f_9")], ["f_1", "f_2", "f_3"], ["f_9", "f_8", "f_7"])


def _surviving(tables: dict[int, DataFrame], bars: DataFrame) -> DataFrame:
    """Phrases at or above their language's threshold that no longer one drops."""
    out = None
    for m in (2, 3, 4):
        rows = tables[m].select("lang", "phrase", "a", "l", "r", "score").join(bars, "lang").where(F.col("score") >= F.col("tau")).drop("tau")
        if m < WORDS:
            z = tables[m + 1]
            around = z.select("lang", _first(m).alias("phrase"), "a").unionByName(z.select("lang", _last(m).alias("phrase"), "a"))
            most = around.groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
            held = F.expr(f"cast(100 as decimal(3,0)) * cast(_most as decimal(20,0)) >= cast({LONGER} as decimal(3,0)) * cast(a as decimal(20,0))")
            rows = rows.join(most, ["lang", "phrase"], "left").where(F.coalesce(~held, F.lit(True))).drop("_most")
        out = rows if out is None else out.unionByName(rows)
    return out
