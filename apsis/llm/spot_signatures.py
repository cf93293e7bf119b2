"""Document fingerprints by SpotSigs (operator 5).

At every anchor (a very common word) starts a chain: the next content words (words that are no anchors), every
`spacing`-th, `chain` of them. The set of the chains' hashes is the document's fingerprint, written as sorted 32-bit
hexadecimals, so a Jaccard similarity is exact on the fingerprints alone. similar_pairs partitions the sets by
length, joins only their rarest signatures, and prunes by length before it verifies.

Cases: null text counts as empty; a text without any chain is fingerprinted by its words as one signature, a text
without words by its characters, the empty text by the empty string (alike only to another empty one); repeated rows
get equal fingerprints; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, NON_ALNUM, U64, Words, blocks, is_in, materialize, mix
from .doc_stats import common_hashes


def signatures(texts: pa.Array, chain: int = 3, spacing: int = 1) -> list[np.ndarray]:
    """The sorted distinct 32-bit signatures of every text, worked out for about a megabyte of text at a time."""
    table = pa.table({"_text": texts})
    return [s for part in blocks(table, "_text") for s in _signatures(part.column(0), chain, spacing)]


def _signatures(texts: pa.Array, chain: int, spacing: int) -> list[np.ndarray]:
    words = Words(texts, NON_ALNUM, LOWER)
    anchor = is_in(words.hash, common_hashes())
    content = np.flatnonzero(~anchor)
    n = len(texts)
    spots = np.flatnonzero(anchor)
    begin = np.searchsorted(content, spots)
    last = begin + (chain - 1) * spacing
    whole = last < len(content)
    spots, begin = spots[whole], begin[whole]
    # The chain ends in the same text that it begins in.
    same = words.row[content[begin + (chain - 1) * spacing]] == words.row[spots] if len(spots) else np.zeros(0, bool)
    spots, begin = spots[same], begin[same]
    value = words.hash[spots]
    for k in range(chain):
        value = mix(value * U64(0x9E3779B97F4A7C15) + words.hash[content[begin + k * spacing]])
    value = (value >> U64(32)).astype(np.uint32)
    cuts = np.searchsorted(words.row[spots], np.arange(n + 1))
    out = []
    for i in range(n):
        own = np.unique(value[cuts[i] : cuts[i + 1]])
        if not len(own):
            a, b = words.first[i], words.first[i + 1]
            raw = words.hash[a:b] if b > a else words.data[words.offsets[i] : words.offsets[i + 1]].astype(U64)
            if len(raw):
                place = np.arange(1, len(raw) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
                own = (mix(mix(raw + place).sum(keepdims=True)) >> U64(32)).astype(np.uint32)
        out.append(own)
    return out


def written(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([s.astype(">u4").tobytes().hex() for s in sets], pa.string())


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and fingerprint. One pass, no shuffle."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "_text"):
                yield pa.RecordBatch.from_arrays([part.column(0), written(signatures(part.column(1)))], names=["_id", "fingerprint"])

    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, fingerprint string").withColumnRenamed("_id", id_col)


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members maps each id to the smallest id with the same fingerprint; pairs are those
    representatives (a < b) whose sets have a Jaccard similarity of threshold or more, with it. Empty sets pair with none."""
    marks = materialize(fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "_id"), "spotsigs")
    reps = marks.groupBy("fingerprint").agg(F.min("_id").alias("rep"))
    members = marks.join(reps, "fingerprint").select(F.col("_id").alias(id_col), F.col("rep").alias("class_id"))
    chunks = F.transform(F.sequence(F.lit(0), F.expr("length(fingerprint) div 8 - 1")), lambda i: F.substr("fingerprint", i * 8 + 1, F.lit(8)))
    sets = materialize(reps.where("fingerprint <> ''").select("rep", chunks.alias("sigs")).withColumn("n", F.size("sigs")), "spotsigs-sets")
    each = sets.select("rep", "n", F.explode("sigs").alias("sig"))
    # Rarest first; the first n - ceil(threshold * n) + 1 of them must hold one that both sets share.
    counted = each.join(each.groupBy("sig").agg(F.count("*").alias("df")), "sig")
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("df", "sig"))
    prefix = counted.withColumn("k", rank).where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    # Length partitions: sets a factor of threshold apart in size fall into the same or neighbouring ones.
    part = F.floor(-F.log("n") / F.log(F.lit(threshold)))
    own = prefix.select("sig", part.alias("part"), F.col("rep").alias("a"), F.col("n").alias("na"))
    probe = prefix.select("sig", F.explode(F.array(part, part + 1)).alias("part"), F.col("rep").alias("b"), F.col("n").alias("nb"))
    longer = (F.col("na") > F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") > F.col("b"))
    found = own.join(probe, ["sig", "part"]).where(longer & (F.col("nb") >= F.col("na") * threshold)).select("a", "b").distinct()
    x, y = sets.select(F.col("rep").alias("a"), F.col("sigs").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("sigs").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    checked = found.join(x, "a").join(y, "b").withColumn("similarity", both / (F.size("sa") + F.size("sb") - both)).where(F.col("similarity") >= threshold)
    return members, checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def with_next(docs: DataFrame, work: Callable[[pa.Table, pa.Array], pa.Table], schema: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16 << 20, most: int = 4096) -> DataFrame:
    """Runs work(rows, texts of the next rows) over the rows in descending id order (null ids last); after the last comes the first.

    Rows are compared by their ids themselves, whatever their type; equal ids go by the first 64 characters of their text, then by
    its hash. Spark deals the ids alone by range, and the first row of each range begins a block: as many as the input has
    block_bytes, but for at most `most` (their keys come to the driver). Then every text is shuffled once to its block, and the
    first text of each block to the block before it as well. A task streams through its sorted blocks, so a block may be larger than
    memory. rows: _id, _text, in order.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    id_type = dict(rows.dtypes)["_id"]
    size = rows.agg(F.sum(F.octet_length("_text") + 64).alias("bytes")).first()["bytes"] or 0
    begin, mark = F.substring("_text", 1, 64), F.xxhash64("_text")
    keys = [F.col("_id").desc_nulls_last(), F.col("_begin"), F.col("_mark")]
    dealt = rows.select("_id", begin.alias("_begin"), mark.alias("_mark")).repartitionByRange(min(most, max(1, -(-size // block_bytes))), *keys).sortWithinPartitions(*keys).withColumn("_n", F.monotonically_increasing_id())
    firsts = dealt.groupBy(F.shiftright("_n", 33).alias("_range")).agg(F.min_by(F.struct("_id", "_begin", "_mark"), "_n").alias("k")).orderBy("_range")
    bounds = [r["k"] for r in firsts.collect()]
    if not bounds:
        return docs.sparkSession.createDataFrame([], schema)

    fan = math.isqrt(len(bounds) - 1) + 1
    bound = [F.struct(F.lit(k["_id"]).cast(id_type).alias("id"), F.lit(k["_begin"]).alias("begin"), F.lit(k["_mark"]).cast("bigint").alias("mark")) for k in bounds]
    place = F.struct(begin.alias("begin"), mark.alias("mark"))
    same = lambda x: F.col("_id").eqNullSafe(x["id"])

    def reached(x: Column) -> Column:
        """Whether a row is the first of a block or comes after it."""
        return F.when(same(x), place >= F.struct(x["begin"].alias("begin"), x["mark"].alias("mark"))).when(F.col("_id").isNull(), True).when(x["id"].isNull(), False).otherwise(F.col("_id") < x["id"])

    # The last bound that a row reaches: among every fan-th first, then among those up to the next of these.
    groups = F.array(*[F.array(*bound[k : k + fan]) for k in range(0, len(bound), fan)])
    coarse = rows.withColumn("_group", F.size(F.filter(F.array(*bound[::fan]), reached)))
    blocked = coarse.withColumn("_block", (F.col("_group") - 1) * fan + F.size(F.filter(F.element_at(groups, F.col("_group")), reached)) - 1)
    own = blocked.select("_id", "_text", "_block", F.lit(False).alias("_guest"))
    head = F.element_at(F.element_at(groups, F.col("_group")), F.col("_block") - (F.col("_group") - 1) * fan + 1)
    heads = blocked.where(same(head) & (place == F.struct(head["begin"].alias("begin"), head["mark"].alias("mark")))).dropDuplicates(["_block"])
    guests = heads.select("_id", "_text", F.pmod(F.col("_block") - 1, F.lit(len(bounds))).alias("_block"), F.lit(True).alias("_guest"))
    placed = own.unionByName(guests).repartition(len(bounds), "_block").sortWithinPartitions("_block", "_guest", F.col("_id").desc_nulls_last(), begin, mark)

    def run(batches):
        pending = None
        for batch in batches:
            for piece in blocks(batch, "_text"):
                line = pa.Table.from_batches([piece] if pending is None else [pending, piece])
                pending = piece.slice(piece.num_rows - 1)
                # The guest of a block is its last row, so every other row is followed by the one behind it.
                kept = pc.invert(line.column("_guest").slice(0, line.num_rows - 1))
                ahead = line.slice(0, line.num_rows - 1).filter(kept).combine_chunks()
                texts = line.column("_text").slice(1).filter(kept).combine_chunks()
                block = ahead.column("_block").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a < b:
                        yield from work(ahead.slice(a, b - a).select(["_id", "_text"]), texts.slice(a, b - a)).to_batches()

    return placed.mapInArrow(run, schema)
