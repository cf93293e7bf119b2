"""MinHash near-duplicates (operator 3): improved consistent weighted sampling over TF-IDF weighted word shingles.

1. In how many contexts (words before it) the corpus holds a shingle, in a sketch of fixed size (4 MB once broadcast).
2. Per document: a content key and a signature of `bands * rows` consistent weighted samples.
3. Documents of equal content form a class; only class representatives go on, each named by its id and content key.
4. Bands are buckets. Every representative is verified against one bucket leader (the one it meets in most bands); linked
   documents are labelled by connected components. Buckets that still hold several labels are compared in blocks of
   bounded size: members of different labels are verified there if their signatures agree often enough, the likeliest first.
5. Every link is verified by exact weighted Jaccard similarity on whole texts; components of all links are the classes.

A group of many copies is one row, and one of many near copies costs about a link each: no pair within one label is made, and a
block gives fewer links than it has members. Contents, buckets, hubs and leaders that many rows share are dealt over salts.

Weights are tf * idf, idf = ln(1 + N / df) over that of a rare shingle. df counts contexts: a phrase that many unlike
texts use follows many different words, while the shingles of copies follow the same word in every copy, so a group of copies
counts once, however large it is, and its shingles keep their weight. Each of the two rows of the sketch holds a bitmap a slot
(Flajolet-Martin: the number of trailing ones tells the count up to a factor of about two); shingles within two
bits of the median slot are rare (idf 1), which sets the sketch's own noise apart at every size of the corpus.

Cases: null text counts as empty; empty texts (no words) are equal contents and form one class; a text shorter than a
shingle is one shingle; repeated rows get the same class; rows of one id and different texts are documents of their own
(class_id is the least id); a row without an id is a class of its own (class_id null); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, LOWER, U64, Words, beside, blocks, materialize, mix, window_hashes
from .components import components

WIDTH, DEPTH, CHUNK = 1 << 21, 2, 1 << 15
BANDS, ROWS = 24, 5
SAMPLES = BANDS * ROWS
TABLE = 1 << 12
#: Members, and bytes of their texts, of one bucket block, about.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Over how many tasks at most the texts compared with one text are dealt.
SALTS = 64
_G = U64(0x9E3779B97F4A7C15)


class Shingles:
    """Shingles of a block of texts: hashes, the row of each, first[i]:first[i + 1] those of row i."""

    def __init__(self, texts: pa.Array, size: int):
        words = Words(texts, BLANK, LOWER)
        n_words = np.diff(words.first)
        n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
        self.words = words
        self.first = np.concatenate(([0], np.cumsum(n)))
        self.row = np.repeat(np.arange(len(n)), n)
        start = words.first[:-1][self.row] + np.arange(len(self.row)) - self.first[:-1][self.row]
        self.hash = np.zeros(len(start), U64)
        full = n_words[self.row] >= size
        hashes = window_hashes(words.hash, size)
        self.hash[full] = hashes[start[full]]
        for i in np.flatnonzero((n_words > 0) & (n_words < size)):
            own = words.hash[words.first[i] : words.first[i + 1]]
            self.hash[self.first[i]] = window_hashes(own, len(own))[0] ^ U64(len(own))

    def contexts(self) -> np.ndarray:
        """A hash of every shingle with the word before it (none at the beginning of a text)."""
        start = self.words.first[:-1][self.row] + np.arange(len(self.row)) - self.first[:-1][self.row]
        before = np.zeros(len(start), U64)
        inner = start > self.words.first[:-1][self.row]
        before[inner] = self.words.hash[start[inner] - 1]
        return mix(self.hash * _G + mix(before + U64(1)))

    def counted(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.hash[self.first[i] : self.first[i + 1]], return_counts=True)

    def contents(self) -> list[bytes]:
        """A 128-bit key of every row's word sequence."""
        place = np.arange(len(self.words)) - self.words.first[:-1][self.words.row]
        out = []
        for salt in (U64(1), U64(0x5851F42D4C957F2D)):
            value = mix(mix(self.words.hash * salt + salt) + (place.astype(U64) + U64(1)) * _G)
            total = np.concatenate((np.zeros(1, U64), np.cumsum(value, dtype=U64)))
            out.append(mix(total[self.words.first[1:]] - total[self.words.first[:-1]] + np.diff(self.words.first).astype(U64)))
        return [a + b for a, b in zip((x.tobytes() for x in out[0]), (x.tobytes() for x in out[1]), strict=True)]


def slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & U64(WIDTH - 1)).astype(np.int64), ((hashes >> U64(32)) & U64(WIDTH - 1)).astype(np.int64)


class Weights:
    """Shingle weights from the sketch: levels[d, slot] is the number of trailing ones of a bitmap."""

    def __init__(self, levels: np.ndarray, documents: int):
        self.levels = levels
        self.rare = int(np.median(levels[0])) + 2
        count = np.exp2(np.maximum(np.arange(34), self.rare)) / 0.77351
        idf = np.log1p(max(1, documents) / count)
        #: By level; 1 for rare ones.
        self.idf = idf / idf[0]

    def of(self, hashes: np.ndarray, tf: np.ndarray) -> np.ndarray:
        a, b = slots(hashes)
        return tf * self.idf[np.minimum(self.levels[0][a], self.levels[1][b])]


_draws: tuple[np.ndarray, ...] | None = None


def draws() -> tuple[np.ndarray, ...]:
    """Two rows of each table give an element its draws for every sample: r and c ~ Gamma(2, 1) as sums of two exponentials,
    beta ~ U(0, 1) as a sum modulo 1. Elements share both rows once in TABLE^2."""
    global _draws
    if _draws is None:
        random, shape = np.random.default_rng(3), (TABLE, SAMPLES)
        _draws = *(random.standard_exponential(shape, np.float32) for _ in range(4)), *(random.random(shape, np.float32) for _ in range(2))
    return _draws


def signature(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SAMPLES 32-bit samples of a weighted set (not empty): per sample the (element, level) of the least ln a."""
    r1, r2, c1, c2, b1, b2 = draws()
    best = np.full(SAMPLES, np.inf, np.float32)
    sample = np.zeros(SAMPLES, U64)
    each = np.arange(SAMPLES)
    for at in range(0, len(hashes), 512):
        h, w = hashes[at : at + 512], weights[at : at + 512]
        i, j = (h >> U64(52)).astype(np.int64), ((h >> U64(40)) & U64(TABLE - 1)).astype(np.int64)
        r, a, beta = r1.take(i, 0), c1.take(i, 0), b1.take(i, 0)
        r += r2.take(j, 0)
        a += c2.take(j, 0)
        beta += b2.take(j, 0)
        beta -= beta >= 1
        np.log(a, out=a)
        other, level = np.flatnonzero(w != 1), None
        if len(other):  # the level of weight 1 is 0
            t = np.floor(np.log(w[other]).astype(np.float32)[:, None] / r[other] + beta[other])
            beta[other] -= t
            level = np.zeros(a.shape, np.int32)
            level[other] = t
        # ln a = ln c - ln y - r, where ln y = r * (level - beta)
        beta -= 1
        beta *= r
        a += beta
        k = a.argmin(0)
        least = a[k, each]
        better = least < best
        best[better] = least[better]
        value = h[k]
        if level is not None:
            value = value + level[k, each].astype(np.int64).astype(U64) * _G
        sample[better] = value[better]
    return (mix(sample) >> U64(32)).astype(np.uint32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted hashes, weights): sum of minima over sum of maxima."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    total = float(a[1].sum() + b[1].sum()) - both
    return both / total if total else 1.0


def frequencies(rows: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """The levels of the sketch (DEPTH rows of WIDTH bitmaps) and the number of documents with words. Bitmaps are joined by
    OR, so neither copies nor repeated tasks change them; each of the joining tasks holds a part of one sketch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, documents = np.zeros((DEPTH, WIDTH), np.uint32), 0
        for batch in batches:
            for part in blocks(batch, "_text"):
                s = Shingles(part.column(part.schema.get_field_index("_text")), size)
                seen = s.contexts()
                for d, slot in enumerate(slots(s.hash)):
                    bits = (seen >> U64(32 * d)).astype(np.uint32) | np.uint32(1 << 31)
                    np.bitwise_or.at(sketch[d], slot, bits & (~bits + np.uint32(1)))
                documents += int((np.diff(s.first) > 0).sum())
        for chunk, bitmaps in enumerate(sketch.reshape(-1, CHUNK)):
            if bitmaps.any():
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "bitmaps": [zlib.compress(bitmaps.tobytes(), 1)], "documents": [0]})
        yield pa.RecordBatch.from_pydict({"chunk": [-1], "bitmaps": pa.array([None], pa.binary()), "documents": [documents]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined: dict[int, np.ndarray] = {}
        documents = 0
        for batch in batches:
            for chunk, packed, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                documents += n
                if packed is not None:
                    bitmaps = np.frombuffer(zlib.decompress(packed), np.uint32)
                    joined[chunk] = joined[chunk] | bitmaps if chunk in joined else bitmaps
        for chunk, bitmaps in joined.items():
            ones = np.log2((bitmaps & (bitmaps + np.uint32(1))) ^ (bitmaps + np.uint32(1)), dtype=np.float64, where=bitmaps != 0xFFFFFFFF, out=np.full(len(bitmaps), 32.0))
            yield pa.RecordBatch.from_pydict({"chunk": [chunk], "levels": [zlib.compress(ones.astype(np.uint8).tobytes(), 1)], "documents": [0]})
        yield pa.RecordBatch.from_pydict({"chunk": [-1], "levels": pa.array([None], pa.binary()), "documents": [documents]})

    counted = rows.select("_text").mapInArrow(count, "chunk bigint, bitmaps binary, documents bigint")
    levels, documents = np.zeros((DEPTH * WIDTH // CHUNK, CHUNK), np.uint8), 0
    for r in counted.repartition("chunk").mapInArrow(add, "chunk bigint, levels binary, documents bigint").collect():
        documents += r["documents"]
        if r["levels"] is not None:
            levels[r["chunk"]] = np.frombuffer(zlib.decompress(bytes(r["levels"])), np.uint8)
    return levels.reshape(DEPTH, WIDTH), documents


def _sign(rows: DataFrame, shared, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: Weights = shared.value
        for batch in batches:
            for part in blocks(batch, "_text"):
                s = Shingles(part.column(1), size)
                signs = []
                for i in range(part.num_rows):
                    hashes, tf = s.counted(i)
                    signs.append(signature(hashes, weights.of(hashes, tf)).tobytes() if len(hashes) else None)
                length = pa.array(np.diff(s.words.offsets))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.contents(), pa.binary()), pa.array(signs, pa.binary()), length], names=["_id", "content", "sign", "length"])

    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, content binary, sign binary, length bigint")


def _with_content(rows: DataFrame, text: str = "_text") -> DataFrame:
    """rows with the content key of their text (null as empty) as `_content`."""
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(Shingles(part.column(at), 1).contents(), pa.binary())], names=[*part.schema.names, "_content"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "_content binary"]))


def _verify(pairs: DataFrame, texts: DataFrame, shared, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts have a weighted Jaccard similarity of threshold or more.

    texts: node, _text. Each b, with a share of the texts it is compared with, is one run of rows: its own text first, then
    theirs. A task holds one parsed text and one batch."""
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int").alias("cut"))
    own = dealt.select("b", "cut").distinct().select(F.col("b").alias("node"), "b", "cut", F.lit(True).alias("lead"))
    wanted = own.unionByName(dealt.select(F.col("a").alias("node"), "b", "cut", F.lit(False).alias("lead")))
    run_rows = wanted.join(texts, "node").repartition("b", "cut").sortWithinPartitions("b", "cut", F.desc("lead")).select("node", "b", "lead", "_text")
    kind = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: Weights = shared.value
        against = None
        for batch in batches:
            for part in blocks(batch, "_text"):
                s, found = Shingles(part.column(3), size), []
                for i, lead in enumerate(part.column(2).to_pylist()):
                    hashes, tf = s.counted(i)
                    own = hashes, weights.of(hashes, tf)
                    if lead:
                        against = own
                    elif similarity(own, against) >= threshold:
                        found.append(i)
                at = pa.array(found, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at)], names=["a", "b"])

    return run_rows.mapInArrow(run, f"a {kind}, b {kind}")


def _block_links(members: DataFrame, shared, size: int, threshold: float, least: float) -> DataFrame:
    """members: key, n and bytes (of all members of the bucket), band, node, label, sign, _text. Links (a, b) between members
    of one bucket with different labels.

    Buckets are cut by hash into blocks of about BLOCK members or BLOCK_BYTES of text; every two blocks of a bucket meet in
    one group of bounded size. A pair is looked at in the first band only that it shares, verified if its signatures agree
    in a share of `least` or more of the samples, and skipped once the group's links have joined its labels."""
    cuts = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("x"), F.greatest(k, F.col("own")).alias("y")))
    dealt = members.withColumn("cuts", cuts).withColumn("own", own).withColumn("at", F.explode(met))
    dealt = dealt.select("key", F.col("at.x").alias("x"), F.col("at.y").alias("y"), "own", "band", F.xxhash64("label").alias("label"), "sign", "node", "_text")
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "own", "node")
    kind = dict(members.dtypes)["node"]

    def bounds(table: pa.Table) -> list[int]:
        k, x, y = (table.column(c).to_numpy() for c in ("key", "x", "y"))
        new = (k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        return [0, *(np.flatnonzero(new) + 1).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            groups = bounds(table)
            rest = table.slice(groups[-1])
            if len(groups) > 1:
                yield links(table.slice(0, groups[-1]).combine_chunks(), groups)
        if rest is not None and rest.num_rows:
            yield links(rest.combine_chunks(), [*bounds(rest), rest.num_rows])

    def links(table: pa.Table, groups: list[int]) -> pa.RecordBatch:
        weights: Weights = shared.value
        band, own, x, y, label = (table.column(c).to_numpy() for c in ("band", "own", "x", "y", "label"))
        signs = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint32).reshape(-1, SAMPLES)
        texts = table.column("_text")
        found: list[tuple[int, int]] = []
        for a, b in zip(groups[:-1], groups[1:], strict=True):
            same = x[a] == y[a]
            mid = b if same else a + int((own[a:b] == x[a]).sum())
            now, sets = label[a:b].copy(), {}

            def parsed(i: int, sets=sets):
                if i not in sets:
                    hashes, tf = Shingles(pa.array([texts[i].as_py()], pa.large_string()), size).counted(0)
                    sets[i] = hashes, weights.of(hashes, tf)
                return sets[i]

            for i in range(a, mid):
                js = np.arange(i + 1, b) if same else np.arange(mid, b)
                js = js[now[js - a] != now[i - a]]
                if not len(js):
                    continue
                agree = signs[js] == signs[i]
                share = agree.mean(1)
                likely = np.flatnonzero(share >= least)
                likely = likely[agree[likely].reshape(len(likely), BANDS, ROWS).all(2).argmax(1) == band[a]]
                for j in js[likely[np.argsort(-share[likely], kind="stable")]].tolist():
                    if now[j - a] != now[i - a] and similarity(parsed(i), parsed(j)) >= threshold:
                        found.append((i, j))
                        now[now == now[j - a]] = now[i - a]
        nodes = pa.concat_arrays(table.column("node").chunks) if table.num_rows else pa.array([], table.schema.field("node").type)
        return pa.RecordBatch.from_arrays([nodes.take(pa.array([f[k] for f in found], pa.int64())) for k in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, shingle: int, slack: float) -> tuple[DataFrame, DataFrame]:
    """(members, labels). members: _id, node per row with an id, node being struct(id, content) of the representative of its
    content. labels: node, label (the least node of its class) for nodes that have a link."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    shared = spark.sparkContext.broadcast(Weights(*frequencies(rows, shingle)))  # 4 MB at any input size
    signed = materialize(_sign(rows.where("_id is not null"), shared, shingle), "signatures")
    node = F.struct(F.col("rep").alias("id"), F.col("content").alias("content")).alias("node")
    members = materialize(beside(signed.select("_id", "content"), "content", "_id", rep=("min", F.col("_id"))).select("_id", node), "members")
    reps = signed.where("sign is not null").groupBy("content").agg(F.min("_id").alias("rep"), F.first("sign").alias("sign"), F.max("length").alias("length")).select(node, "sign", "length")
    reps = materialize(reps, "representatives")

    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.struct(k.alias("band"), F.xxhash64(F.substr("sign", k * (4 * ROWS) + 1, F.lit(4 * ROWS)), k).alias("key")))
    banded = reps.select("node", "length", F.explode(band).alias("s")).select("node", "length", "s.band", "s.key")
    met = materialize(beside(banded, "key", "node", n=("count", F.lit(1))).where("n > 1"), "buckets")
    # A bucket's leader is its member with the most bucket neighbours: in a group of near copies, one near the middle.
    degree = met.groupBy("node").agg(F.sum("n").alias("degree"))
    led = beside(met.join(degree, "node"), "key", "node", first=("min", F.struct(-F.col("degree"), F.col("node"))))
    led = led.select("node", F.col("first.node").alias("leader")).where("node <> leader")
    involved = met.select("node").distinct()
    # Of rows that share an id, those with the wanted content. Repeated rows are repeated here, which verifies a pair again.
    texts = rows.join(involved.select(F.col("node.id").alias("_id"), "node"), "_id").select("node", "_text")
    texts = materialize(_with_content(texts).where("_content = node.content").drop("_content"), "candidate-texts")

    # One leader per representative: the one it meets in most bands.
    best = led.groupBy("node").agg(F.mode("leader", deterministic=True).alias("leader"))
    pairs = materialize(best.select(F.col("node").alias("a"), F.col("leader").alias("b")), "first-pairs")
    labels = components(_verify(pairs, texts, shared, shingle, threshold))
    labelled = met.drop("n").join(labels, "node", "left").select("key", "band", "node", "length", F.coalesce("label", "node").alias("label"))
    mixed = beside(labelled, "key", "node", n=("count", F.lit(1)), bytes=("sum", F.col("length")), lo=("min", F.col("label")), hi=("max", F.col("label"))).where("lo <> hi")
    active = materialize(mixed.drop("lo", "hi", "length"), "mixed-buckets").join(reps.select("node", "sign"), "node").join(texts, "node")
    more = materialize(_block_links(active, shared, shingle, threshold, threshold - slack), "more-links")
    if not more.isEmpty():
        labels = components(more.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    return members, labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5, slack: float = 0.11) -> DataFrame:
    """Per row of docs: id, rep_id (the least id with the same content) and class_id (the least id of its class).

    slack: how far below the threshold two signatures may agree and still be verified (3 standard errors of SAMPLES).
    """
    members, labels = _classes(docs, id_col, text_col, threshold, shingle, slack)
    found = members.join(labels, "node", "left").select(F.col("_id").alias(id_col), F.col("node.id").alias("rep_id"), F.coalesce("label", "node")["id"].alias("class_id"))
    none = F.lit(None).cast(dict(found.dtypes)[id_col])
    return found.unionByName(docs.where(F.col(id_col).isNull()).select(F.col(id_col), none.alias("rep_id"), none.alias("class_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5, slack: float = 0.11) -> DataFrame:
    """One row of every class of near duplicates, with all columns: that of the least id, of several texts with this id the
    one with the least content key, of several rows with both the least by all columns. Rows without an id all stay."""
    members, labels = _classes(docs, id_col, text_col, threshold, shingle, slack)
    nodes = members.select("node").distinct().join(labels.where("node <> label"), "node", "left_anti")
    clash = members.groupBy("_id").agg((F.min("node.content") != F.max("node.content")).alias("_clash"))
    chosen = nodes.select(F.col("node.id").alias("_id"), F.col("node.content").alias("_wanted")).join(clash, "_id")
    chosen = materialize(chosen.withColumnsRenamed({"_id": "_chosen"}), "chosen")
    rows = docs.select(F.col(id_col).alias("_chosen"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    # An id with one text needs no look at it: its rows are shuffled once, by id.
    usual = rows.join(chosen.where("not _clash").select("_chosen"), "_chosen").groupBy("_chosen").agg(F.min("_row").alias("_row"))
    several = rows.join(chosen.where("_clash").drop("_clash"), "_chosen").withColumn("_text", F.coalesce(F.col("_row")[text_col], F.lit("")))
    several = _with_content(several).where("_content = _wanted").groupBy("_chosen", "_content").agg(F.min("_row").alias("_row"))
    kept = usual.select("_row.*").unionByName(several.select("_row.*"))
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
