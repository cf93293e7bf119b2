"""Collocations, Hilbert-curve shards and the Merkle manifest against brute force, and neighbours by id."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from apsis.llm import chat_format, collocations, hilbert_shards, merkle_manifest, mixing, ordering, queries, secret_scan, spot_signatures

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- Collocations -------------------------------------------------------------------------------------------------


def brute_collocations(rows, top, least):
    f, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for m in range(1, 5):
                for i in range(len(ws) - m + 1):
                    f[lang, tuple(ws[i : i + m])] += 1
    often = {k: n for k, n in f.items() if n >= least and len(k[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, p), a in often.items():
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, l, r = min(cuts)
        dropped = any(100 * n >= 80 * a for (g, q), n in often.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
        if not dropped:
            out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, k, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)}


def prose(seed, n):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(25)] + ["É", "straße", "A", "New", "York", "zip\x00", "x\xa0y", " "]
    weight = [1 / (k + 1) for k in range(len(words))]
    rows = []
    for k in range(n):
        ws = r.choices(words, weight, k=r.randint(0, 40))
        for _ in range(r.randint(0, 3)):
            ws[len(ws) // 2 : len(ws) // 2] = r.choice([["New", "york", "City"], ["red", "hot", "chili", "pepper"], ["of", "the"], ["\tin", "spite", "of", "the", "rain"]])
        rows.append((r.choice(["en", "en", "en", "de", None, ""]), "".join(w + r.choice([" ", " ", " ", "\t ", ", ", ". ", "\n", " \r\n"]) for w in ws)))
    return rows + [("en", None), (None, ""), ("en", "same words here. " * 5), ("en", "same words here. " * 5), ("lone", "a"), ("long", "one two three four five " * 400)]


@pytest.mark.parametrize(("top", "rank", "least", "limit"), [(5, 2, 3, 1 << 20), (40, 3, 2, 300), (1000, None, 2, 64), (3, 1, 30, 1 << 20)])
def test_collocations(spark, top, rank, least, limit):
    rows = prose(top, 250)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3).withColumn("n", F.lit("clash")).withColumn("phrase", F.lit(1))
    got = [tuple(r) for r in collocations.mine(docs, top=top, least=least, rank=rank, limit=limit, filter_bits=12).collect()]
    want = brute_collocations(rows, top, least)
    assert len(got) == len(set(got)) and set(got) == want and want


def test_collocations_of_nothing(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.mine(spark.createDataFrame([("en", None), (None, "a b")], "lang string, text string")).count() == 0


def test_collocation_scores_are_exact_beyond_64_bits(spark):
    rows = spark.createDataFrame([("en", "a b", 9 * 10**18, 9 * 10**18 + 7, 9 * 10**18 + 5)], "lang string, phrase string, a bigint, f_1 bigint, f_2 bigint")
    got = collocations._scored(rows, [("f_1", "f_2")], ["f_1"], ["f_2"]).first()
    assert got["score"] == 2000000 * 9 * 10**18 // (18 * 10**18 + 12)


def test_long_texts_are_counted_in_parts():
    r = random.Random(3)
    text = " ".join(r.choice(["a", "bb", "c", "d,", "e.", "ééé"]) for _ in range(3000))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})

    def counts(limit, m):
        out = collections.Counter()
        for grams in collocations._grams(batch, limit):
            for k in range(2, m + 1):
                grams.extend(k)
            part = grams.counted(m)
            for p, n in zip(part.column("phrase").to_pylist(), part.column("n").to_pylist(), strict=True):
                out[p] += n
        return out

    for m in (1, 2, 3, 4):
        assert counts(100, m) == counts(1 << 20, m) == counts(1, m)


# --- Hilbert shards -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    names = [f"x{j}" for j in range(dims)]
    cells = spark.range(1 << (dims * bits)).select(*[F.shiftright("id", bits * j).bitwiseAND((1 << bits) - 1).alias(c) for j, c in enumerate(names)])
    got = cells.withColumn("h", hilbert_shards.hilbert_index([F.col(c) for c in names], bits)).orderBy("h").collect()
    assert [r["h"] for r in got] == list(range(1 << (dims * bits)))
    assert all(sum(abs(a[c] - b[c]) for c in names) == 1 for a, b in zip(got, got[1:], strict=False))


def shard_rows():
    r = random.Random(5)
    rows = [(k, r.choice(["hot", "hot", f"s{k % 9}", None]), r.choice(["en", "de", None]), int(r.paretovariate(1)) if k % 10 else None) for k in range(997)]
    return rows + [(5000, "hot", "en", 7)] * 60


@pytest.mark.parametrize("law", ["rows", "weight"])
def test_shards(spark, law):
    rows = shard_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, size bigint").repartition(5).withColumn("slot", F.lit("clash")).withColumn("_size", F.lit("clash"))
    cut = hilbert_shards.shard(docs, ["source", "lang", "size"], 8, law, "size" if law == "weight" else None, ("doc_id",))
    got = cut.collect()
    assert collections.Counter((r["doc_id"], r["source"], r["lang"], r["size"]) for r in got) == collections.Counter(rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append((r["slot"], r["curve"], r["size"] or 0))
    assert all(sorted(s for s, _, _ in v) == list(range(len(v))) for v in slots.values())
    line = [c for s in sorted(slots) for _, c, _ in sorted(slots[s])]
    assert line == sorted(line)
    if law == "rows":
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 8
    else:
        fair, most = sum(r[3] or 0 for r in rows) / 8, max(r[3] or 0 for r in rows)
        assert all(abs(sum(w for _, _, w in v) - fair) <= most + 1 for v in slots.values())
    assert hilbert_shards.shard(docs.limit(0), ["source", "lang"]).count() == 0


def test_shards_let_readers_skip_files(spark, tmp_path):
    docs = spark.range(4096).select(F.col("id").alias("doc_id"), *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)).alias(c) for k, c in enumerate("abc")])
    cut = hilbert_shards.shard(docs, ["a", "b", "c"], 64, ties=("doc_id",))
    hilbert_shards.write_shards(cut, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == 4096
    for c in "abc":  # a filter on any of the three meets a part of the shards only; by one column alone, all of them for the others
        zones = hilbert_shards.zone_map(back, ["a", "b", "c"])
        assert zones.where((F.col(f"min_{c}") <= 100) & (F.col(f"max_{c}") >= 50)).count() <= 24
    with pytest.raises(ValueError):
        hilbert_shards.shard(docs, ["a", "b"], law="weight")


def test_levels_are_exact_quantiles(spark):
    values = [None] * 30 + [5] * 40 + list(range(6, 36))
    rows = spark.createDataFrame([(v,) for v in values], "v int")
    got = collections.Counter(tuple(r) for r in rows.select("v", hilbert_shards.level(rows, "v", 3).alias("q")).collect())
    ordered = sorted(values, key=lambda v: (v is not None, v or 0))
    assert got == collections.Counter((v, ordered.index(v) * 8 // len(values)) for v in values)


# --- Merkle manifest ----------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def proof_of(levels, i):
    out = ""
    for nodes in levels[:-1]:
        begin = i - i % 8
        out += "".join(x for j, x in enumerate(nodes[begin : begin + 8], begin) if j != i)
        i //= 8
    return out


@pytest.mark.parametrize("every", [1, 2, 3])
def test_merkle_proofs(spark, every):
    rows = [(k % 37 if k % 3 else 1000 + k, "lone" if k == 7 else [None, "en", "de", "en", "zz", ""][k % 6], f"t{k % 11}") for k in range(700)] + [(None, "en", None)] * 3
    leaf = merkle_manifest.leaf_digest(F.col("id"), F.col("lang"), F.col("text"))
    docs = spark.createDataFrame(rows, "id bigint, lang string, text string").withColumn("digest", leaf).withColumn("tree", F.lit("clash")).withColumn("position", F.lit("clash"))
    made = merkle_manifest.manifest(docs, "lang", ["id"], ("id", "lang"), every=every)
    assert len(made[0].levels) == -(-3 // every) + 1  # at most 350 leaves a tree: three levels over them
    proven = merkle_manifest.proofs(made)
    got = proven.select("*", merkle_manifest.siblings(F.col("path")).alias("sib"), merkle_manifest.folded(F.col("digest"), F.col("path")).alias("fold"), merkle_manifest.folded(F.lit("0" * 64), F.col("path")).alias("bad")).collect()
    shown = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(((r[0] is not None, r[0] or 0), sha("".join(map(shown, r)))))
    trees = {g: tree_levels([d for _, d in sorted(v)]) for g, v in groups.items()}
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    top = tree_levels([trees[g][-1][0] for g in order])
    want = collections.Counter((d, trees[g][-1][0], top[-1][0], proof_of(trees[g], i) + proof_of(top, order.index(g))) for g, v in groups.items() for i, (_, d) in enumerate(sorted(v)))
    assert collections.Counter((r["digest"], r["subroot"], r["root"], r["sib"]) for r in got) == want
    assert all(r["fold"] == r["root"] != r["bad"] for r in got)


def test_merkle_small_tables(spark):
    empty = spark.createDataFrame([], "id bigint, lang string, digest string")
    assert merkle_manifest.proofs(merkle_manifest.manifest(empty, "lang", ["id"], ("id",))).count() == 0
    one = spark.createDataFrame([(1, None, "ab")], "id bigint, lang string, digest string")
    got = merkle_manifest.proofs(merkle_manifest.manifest(one, "lang", ["id"], ("id",))).first()
    assert (got["subroot"], got["root"], got["path"]) == ("ab", "ab", [])


def test_op13_finds_tampering(spark):
    got = queries.op13_merkle_manifest(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in got:
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and texts[r["doc_id"]] != texts[r["doc_id"]].translate(UPPER)
        assert r["verified"] == (not changed)
    assert len({r["root"] for r in got}) == 1 and 0 < sum(not r["verified"] for r in got) < len(got)


# --- Order --------------------------------------------------------------------------------------------------------


def test_numbers_along_an_order(spark):
    rows = [(k % 3, k * 7 % 50, 10**18 * 5 if k < 4 else k) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, v int, w bigint").repartition(6)
    got = ordering.numbered(df, ["v"], "g", "w").collect()
    for g in range(3):
        own = sorted((r["_position"], r["v"], r["w"], int(r["_before"])) for r in got if r["g"] == g)
        assert [p for p, *_ in own] == list(range(100)) and [v for _, v, *_ in own] == sorted(v for _, v, *_ in own)
        assert all(r["_size"] == 100 for r in got)
        total = 0
        for _, _, w, before in own:
            assert before == total
            total += w


# --- Neighbours by id ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("kind", "ids"), [
    ("string", [f"document-{k:04}" for k in range(200)]),
    ("bigint", [(1 << 60) + k for k in range(200)]),
    ("bigint", [*range(199), 1 << 62]),
    ("decimal(30,0)", [10**25 + k for k in range(200)]),
])
def test_next_row_of_any_id(spark, kind, ids):
    docs = spark.createDataFrame([(str(i), f"text {i}" + " x" * 40) for i in ids], "i string, text string").select(F.col("i").cast(kind).alias("doc_id"), "text").repartition(7)
    seen = lambda own, f: pa.table({"t": own.column("_text"), "f": f.cast(pa.string()), "n": pa.array([own.num_rows] * own.num_rows)})
    got = spot_signatures.with_next(docs, seen, "t string, f string, n bigint", block_bytes=3000).collect()
    line = [f"text {i}" + " x" * 40 for i in sorted(ids, reverse=True)]
    assert {(r["t"], r["f"]) for r in got} == set(zip(line, [*line[1:], line[0]], strict=True)) and len(got) == 200
    assert max(r["n"] for r in got) < 100


def test_op5_likeness_of_edited_texts(spark):
    def sets(text):
        return {text[i : i + 8] for i in range(0, len(text), 8)}

    rows = queries.op5_spot_signatures(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    for r in rows:
        a, b = sets(r["fingerprint"]), sets(r["edited_fingerprint"])
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        t = texts[r["doc_id"]]
        edited = t[: len(t) - len(t) // 3] + texts[after[r["doc_id"]]][: len(t) // 3]
        assert r["edited_fingerprint"] == spot_signatures.written(spot_signatures.signatures(pa.array([edited])))[0].as_py()


# --- Secrets ------------------------------------------------------------------------------------------------------


def test_a_text_of_many_secrets_takes_linear_time():
    r = random.Random(1)
    key = lambda: "".join(r.choice("abcdefXYZ0123456789") for _ in range(24))
    text = "\n".join(f"api_key = {key()} AKIA{key().upper()} {key()}" for _ in range(8000))
    base = secret_scan.base_spans(text)
    began = time.perf_counter()
    found = secret_scan.candidates(text, base)
    assert time.perf_counter() - began < 1
    covered = np.zeros(len(text) + 1, bool)
    for _, a, b, _ in base:
        covered[a:b] = True
    want = [(m.start(), m.end()) for m in secret_scan.CANDIDATE.finditer(text) if not covered[m.start() : m.end()].any() and secret_scan.LETTER.search(m[0])]
    assert [(a, b) for _, a, b, _ in found] == want and want


# --- Mixing -------------------------------------------------------------------------------------------------------


def test_op7_reports_what_it_gives(spark):
    mixed = queries.op7_mixing(spark, SF)
    rows = mixed.collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r["n_tokens"] == len(re.findall(r"[^ \t\n\x0b\f\r]+", texts[r["doc_id"]])) for r in rows) and len(rows) == len(texts)
    got = {(r["margin"], r["value"]): r for r in mixing.achieved(mixed).collect()}
    total = sum(r["n_tokens"] for r in rows)
    for name in mixing.MARGINS:
        have, want, drawn = collections.Counter(), collections.Counter(), collections.Counter()
        for r in rows:
            have[r[name]] += r["n_tokens"]
            want[r[name]] += r["n_tokens"] * r["probability"]
            drawn[r[name]] += r["n_tokens"] * r["sampled"]
        raised = {v: n**0.5 for v, n in have.items() if n}
        for v in have:
            assert got[name, v]["expected"] == pytest.approx(want[v] / sum(want.values()), abs=1e-9)
            assert got[name, v]["sampled"] == pytest.approx(drawn[v] / sum(drawn.values()), abs=1e-9)
            assert got[name, v]["target"] == pytest.approx(raised[v] / sum(raised.values()), abs=1e-9)
            # At its target, or above where others have too little, or whole; so few documents leave cells that are smaller than
            # the margins ask for together, so nearly.
            assert want[v] >= min(have[v], 0.5 * total * raised[v] / sum(raised.values())) * 0.999


def test_raking_ends_at_its_goals(spark):
    r = random.Random(3)
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", r.randint(50, 900)) for a in range(4) for b in range(3) for c in range(2)], "source string, lang string, topic string, tokens bigint")
    goals = {m: spark.createDataFrame([(f"{m[0]}{k}", 120.0 / n) for k in range(n)], "value string, goal double") for m, n in (("source", 4), ("lang", 3), ("topic", 2))}
    fitted = mixing.rake(cells, goals, 40).collect()
    for m, n in (("source", 4), ("lang", 3), ("topic", 2)):
        for k in range(n):
            assert sum(x["weight"] for x in fitted if x[m] == f"{m[0]}{k}") == pytest.approx(120.0 / n, rel=1e-8)


# --- Very long texts ----------------------------------------------------------------------------------------------


def test_very_long_texts(spark):
    long = "word </turn> " * 200_000
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", long)], "conv_id bigint, turn int, role string, text string")
    made = chat_format.format_conversations(rows)
    back = made.select(chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert back["loss"] == long
    docs = spark.createDataFrame([(1, long, "en", "a"), (2, "a b", "en", "a")], "doc_id bigint, text string, lang string, source string").withColumn("probability", F.lit("clash")).withColumn("weight", F.lit("clash"))
    assert {r["doc_id"]: r["n_tokens"] for r in mixing.mix(docs).collect()} == {1: 400_000, 2: 2}
    leaf = docs.select(merkle_manifest.leaf_digest(F.col("text")).alias("d")).first()["d"]
    assert leaf == sha(f"{len(long)}:{long}")
