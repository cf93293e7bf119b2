"""Registered queries of the training-data operators, one per operator, over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, hilbert_shards, merkle_manifest, mixing, near_duplicates, packing, quality_classifier, quality_rules, secret_scan, spot_signatures, substring_dedup, warc_store

#: The vocabulary of the packing query; a parameter of the operator.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("bigint").alias("turn"), F.lit("assistant").alias("role")))).alias("t"))
    own = own.select(F.lit(-7).cast("bigint").alias("conv_id"), "t.turn", "t.role", F.lit("\\### Assistant: </turn> ok").alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    made = chat_format.format_conversations(rows)
    turns = chat_format.parse_turns(F.col("formatted"))
    back = made.select("conv_id", "formatted", "attachments", "attachment_tokens", turns.alias("turns"), chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.size("attachments").cast("bigint").alias("n_attachments"),
        "attachment_tokens",
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'))
          + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g')) + length('<turn >') + length('</turn>') + 2 AS shown
  FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(shown)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens
FROM sized GROUP BY conv_id
"""


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "format")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"), count("format"))


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the next one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def op5_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(rows: pa.Table, following: pa.Array) -> pa.Table:
        texts, after = rows.column("_text").to_pylist(), following.to_pylist()
        changed = [edited(a, b) for a, b in zip(texts, after, strict=True)]
        sets = spot_signatures.signatures(pa.array([*texts, after[-1]], pa.large_string()))
        other = spot_signatures.signatures(pa.array(changed, pa.large_string()))
        return pa.table(
            {
                "doc_id": rows.column("_id"),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                "fingerprint": spot_signatures.written(sets[:-1]),
                "edited_fingerprint": spot_signatures.written(other),
                "near_edited": pa.array(np.array([spot_signatures.jaccard(a, b) for a, b in zip(sets[:-1], other, strict=True)], np.float64)),
                "near_next": pa.array(np.array([spot_signatures.jaccard(a, b) for a, b in zip(sets[:-1], sets[1:], strict=True)], np.float64)),
            }
        )

    return spot_signatures.with_next(read(spark, sf_dir, "documents"), work, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), VOCABULARY).drop("ids")


def op9_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc_store.write_archive(read(spark, sf_dir, "pages"))
    found = warc_store.read_fields(warc_store.read_records(archive))
    return found.select(F.col("page_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM r
"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.repeated_windows(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, ws, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE len(ws) > 0),
h AS (SELECT doc_id, n, i, ws[i] AS word, CASE WHEN i + 34 <= n THEN array_to_string(ws[i:i + 34], ' ') END AS win FROM w),
c AS (SELECT *, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM h),
k AS (SELECT *, coalesce(max(CASE WHEN again THEN i END) OVER (PARTITION BY doc_id ORDER BY i) >= i - 34, false) AS gone FROM c),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""

def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM listed, range(1, 5) AS r(m) WHERE m <= len(ws)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE a >= 30),
cuts AS (SELECT o.*, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail FROM often o, range(1, 4) AS r(k) WHERE k < m),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a::HUGEINT + y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (
  SELECT o.lang, o.a, array_to_string(ws[b:b + p - 1], ' ') AS phrase FROM often o, range(2, 4) AS r(p), range(1, 4) AS s(b) WHERE p < o.m AND b + p - 1 <= o.m
), longest AS (SELECT lang, phrase, max(a) AS most FROM parts GROUP BY ALL),
kept AS (SELECT w.* FROM lowest w LEFT JOIN longest g USING (lang, phrase) WHERE g.most IS NULL OR 100::HUGEINT * g.most < 80::HUGEINT * w.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


def op12_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "lang", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    cut = hilbert_shards.shard(rows, ["source", "lang", "size"], ties=("text_crc32", "doc_id"))
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


#: CRC-32 of bytes in hex, bit by bit.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(regexp_extract_all({0}, '..'), lambda x: [('0x' || x)::BIGINT & 1, ('0x' || x)::BIGINT >> 1 & 1, ('0x' || x)::BIGINT >> 2 & 1, ('0x' || x)::BIGINT >> 3 & 1, ('0x' || x)::BIGINT >> 4 & 1, ('0x' || x)::BIGINT >> 5 & 1, ('0x' || x)::BIGINT >> 6 & 1, ('0x' || x)::BIGINT >> 7 & 1]))), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
#: The curve through three dimensions: of a corner its rank, of a rank the corner it begins in and the axis it runs along.
_RANK, _ENTRY, _AXIS = hilbert_shards._curve_tables(3)
_LEVELS = "\n".join(f"by_{c} AS (SELECT {c}, ((sum(count(*)) OVER (ORDER BY {c} NULLS FIRST) - count(*))::HUGEINT * 32 // sum(count(*)) OVER ())::INT AS level_{c} FROM d GROUP BY {c})," for c in ("source", "lang", "size"))
_LEFT = lambda x, k: f"((({x} << {k}) & 7) | ({x} >> (3 - {k})))"
OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, source, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, {_CRC.format("hx")} AS text_crc32 FROM (SELECT *, hex(encode(coalesce(text, ''))) AS hx FROM documents)),
{_LEVELS}
cells AS (SELECT d.*, level_source AS x, level_lang AS y, level_size AS z FROM d JOIN by_source s ON s.source IS NOT DISTINCT FROM d.source JOIN by_lang g ON g.lang IS NOT DISTINCT FROM d.lang JOIN by_size b ON b.size = d.size),
curve AS (
  SELECT x, y, z, 4 AS b, 0 AS e, 0 AS a, 0::BIGINT AS h FROM (SELECT DISTINCT x, y, z FROM cells)
  UNION ALL
  SELECT x, y, z, b - 1, xor(e, {_LEFT(f"{_ENTRY}[w + 1]", "((a + 1) % 3)")}), (a + {_AXIS}[w + 1] + 1) % 3, h * 8 + w
  FROM (SELECT *, {_RANK}[{_LEFT("xor(e, corner)", "((3 - (a + 1) % 3) % 3)")} + 1] AS w FROM (SELECT *, ((x >> b) & 1) + ((y >> b) & 1) * 2 + ((z >> b) & 1) * 4 AS corner FROM curve WHERE b >= 0))
),
placed AS (SELECT c.*, h AS curve, row_number() OVER (ORDER BY h, text_crc32, doc_id) - 1 AS position, count(*) OVER () AS n FROM cells c JOIN curve k ON k.x = c.x AND k.y = c.y AND k.z = c.z AND k.b = -1),
cut AS (SELECT *, (position * 16 // n)::INT AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, (position - (shard * n + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard, curve FROM cut
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fields = lambda text: merkle_manifest.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", fields(F.col("text")).alias("digest"), F.when(hit, fields(F.translate("text", upper, upper.lower()))).alias("altered"))
    proven = merkle_manifest.proofs(merkle_manifest.manifest(rows, "lang", ["doc_id"], ("doc_id", "altered")))
    digests = proven.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(merkle_manifest.siblings(F.col("path")), 256).alias("proof_sha256"), merkle_manifest.folded(F.coalesce("altered", "digest"), F.col("path")).alias("folded_root"))
    return digests.withColumn("verified", F.col("folded_root") == F.col("root"))


_SHOWN = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_SHOWN.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF("text")} AS leaf,
    CASE WHEN {_CRC.format("hex(encode(doc_id::VARCHAR))")} % 3 = 0 THEN {_LEAF("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_LEAF("text")} END AS used
  FROM documents
),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS position, count(*) OVER (PARTITION BY tree) AS n FROM d),
nodes AS (
  SELECT tree, 0 AS level, position, leaf AS h, n FROM placed
  UNION ALL
  SELECT tree, level + 1, position // 8, sha256(string_agg(h, '' ORDER BY position)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, level, position // 8, n
),
tops AS (SELECT tree AS of, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS position, count(*) OVER () AS n FROM nodes WHERE n = 1),
above AS (
  SELECT 0 AS level, position, subroot AS h, n FROM tops
  UNION ALL
  SELECT level + 1, position // 8, sha256(string_agg(h, '' ORDER BY position)), (n + 7) // 8 FROM above WHERE n > 1 GROUP BY level, position // 8, n
),
runs AS (
  SELECT tree, level, position // 8 AS run, list(h ORDER BY position) AS hs, 0 AS part FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT of, level, run, hs, 1 FROM tops, (SELECT level, position // 8 AS run, list(h ORDER BY position) AS hs FROM above WHERE n > 1 GROUP BY ALL) u WHERE u.run = (tops.position // (8 ** level)::BIGINT) // 8
),
steps AS (
  SELECT p.doc_id, p.leaf, p.used, p.position AS own, row_number() OVER (PARTITION BY p.tree, p.position ORDER BY part, level) AS step, p.tree, hs,
    ((CASE part WHEN 0 THEN p.position ELSE t.position END // (8 ** level)::BIGINT) % 8)::INT AS digit
  FROM placed p JOIN tops t ON t.of = p.tree JOIN runs r ON r.tree = p.tree AND (part = 1 OR r.run = (p.position // (8 ** level)::BIGINT) // 8)
),
proof AS (SELECT tree, own, sha256(string_agg(array_to_string(hs[1:digit], '') || array_to_string(hs[digit + 2:], ''), '' ORDER BY step)) AS proof_sha256, max(step) AS n_steps FROM steps GROUP BY ALL),
fold AS (
  SELECT tree, position AS own, 0::BIGINT AS step, used AS h FROM placed
  UNION ALL
  SELECT f.tree, f.own, s.step, sha256(array_to_string(s.hs[1:s.digit], '') || f.h || array_to_string(s.hs[s.digit + 2:], '')) FROM fold f JOIN steps s ON s.tree = f.tree AND s.own = f.own AND s.step = f.step + 1
)
SELECT p.doc_id, p.leaf, t.subroot, a.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = a.h AS verified
FROM placed p JOIN tops t ON t.of = p.tree CROSS JOIN (SELECT h FROM above WHERE n = 1) a
LEFT JOIN proof q ON q.tree = p.tree AND q.own = p.position
JOIN fold f ON f.tree = p.tree AND f.own = p.position AND f.step = coalesce(q.n_steps, 0)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_format, op2_quality_classifier, op3_minhash_near_dedup, op4_secret_scan, op5_spot_signatures, op6_quality_rules, op7_mixing, op8_packing, op9_warc_store, op10_substring_dedup, op11_collocations, op12_hilbert_shards, op13_merkle_manifest)}
ORACLE_SQL = {"op1_chat_format": OP1_SQL, "op9_warc_store": OP9_SQL, "op10_substring_dedup": OP10_SQL, "op11_collocations": OP11_SQL, "op12_hilbert_shards": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
