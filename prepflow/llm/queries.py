"""The registered queries of the operators, with SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


def tokenizer_path(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


# ------------------------------------------------------------------ 1 packing
from .packing import pack  # noqa: E402


@register("op1_pack_vectors")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(load(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


# ------------------------------------------------------------------ 2 personal data
from . import pii  # noqa: E402


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                s["end"].cast("string"))), ",")


def _base_digest(kinds: tuple[str, ...]) -> Column:
    return F.sha2(_listed(F.filter("spans", lambda s: s["kind"].isin(*kinds))), 256).alias("base_sha256")


@register("op2_pii_anchors")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(load(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(_count, pii.BASE_KINDS), _base_digest(pii.BASE_KINDS),
                        _listed(F.col("spans")).alias("spans"))


# ------------------------------------------------------------------ 3 n-gram join
from .ngram_join import near_duplicates  # noqa: E402


@register("op3_signature_trees")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 4 token counts
from .token_counts import count_tokens  # noqa: E402


@register("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


# ------------------------------------------------------------------ 5 mixing
from .mixing import mix, training_order  # noqa: E402

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '') || '|mix'), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS slot FROM s),
c AS (SELECT *, CASE slot % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
             source_size::DOUBLE * 2.0::DOUBLE AS cap FROM w),
l AS (SELECT *, ((SELECT sum(source_size)::DOUBLE FROM s) * 1.5::DOUBLE
             - COALESCE(sum(cap) OVER (ORDER BY cap / weight, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM c),
t AS (SELECT *, least(cap, (SELECT max(level) FROM l) * weight) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slot,
             CAST(floor(t.target + 0.5) AS BIGINT) AS wanted,
             CAST(sum(d.size) OVER (PARTITION BY t.slot ORDER BY d.key, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, least(size, greatest(wanted - start, 0)) AS t0,
             least(size, greatest(wanted - start - source_size, 0)) AS t1,
             least(start::DOUBLE / nullif(target, 0), 1.0) AS share FROM r)
SELECT doc_id, size, source_size, target, CAST(t0 + t1 AS BIGINT) AS taken,
       CAST((t0 > 0)::INT + (t1 > 0)::INT AS INTEGER) AS n_copies,
       -- time at which the source's demand reaches the document: steady, rising and falling weights
       CASE WHEN t0 > 0 THEN round(CASE slot % 3 WHEN 0 THEN share WHEN 1 THEN sqrt(0.25 + 2 * share) - 0.5
                                   ELSE 1.5 - sqrt(2.25 - 2 * share) END, 6) END AS position
FROM k
"""


@register("op5_mix_curriculum", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(load(spark, sf_dir, "documents")).withColumn("position", F.get("copies", F.lit(0))["position"])
    return training_order(mixed, "doc_id").select("doc_id", "size", "source_size", "target", "taken",
                                                  F.size("copies").alias("n_copies"), F.round("position", 6).alias("position"))


# ------------------------------------------------------------------ 6 licences
from .licenses import scan_licenses  # noqa: E402


@register("op6_license_automaton")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                        F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


# ------------------------------------------------------------------ 7 secrets
from . import secret_scan  # noqa: E402


@register("op7_secret_markov")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(load(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(_count, secret_scan.BASE_KINDS), _base_digest(secret_scan.BASE_KINDS),
                        _listed(F.col("spans")).alias("spans"))


# ------------------------------------------------------------------ 8 fingerprints
from . import fingerprints  # noqa: E402


@register("op8_multiset_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    study = fingerprints.edit_study(load(spark, sf_dir, "documents"))
    return study.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                        fingerprints.as_text(F.col("vector")).alias("fingerprint"),
                        fingerprints.as_text(F.col("edited_vector")).alias("edited_fingerprint"),
                        "near_edited", "near_next")


# ------------------------------------------------------------------ 9 main text
from .html_extract import extract_main_text  # noqa: E402


@register("op9_template_classes")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract_main_text(load(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


# ------------------------------------------------------------------ 10 quality
from .quality import judge  # noqa: E402

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(text, '') AS text, row_number() OVER () AS r,
         regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
m AS (
  SELECT *, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM d),
w AS (
  SELECT r, n_words, unnest(range(1, len(words) - 3)) AS i,
         unnest([words[j:j + 4] FOR j IN range(1, len(words) - 3)]) AS win FROM m),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM w),
p AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM c WHERE n > 1),
v AS (SELECT r, CAST(sum(least(5, i - COALESCE(before, -5))) AS BIGINT) AS n FROM p GROUP BY r),
l AS (
  SELECT r, source, text, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
         translate(trim(regexp_replace(
             CASE WHEN 2 * (length(x) - length(translate(x, '0123456789', '')))
                       >= length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))
                  THEN x ELSE regexp_replace(x, '[0-9]+', '0', 'g') END, '[\x20\x09-\x0D]+', ' ', 'g')),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line
  FROM (SELECT r, source, text, unnest(lines) AS x FROM m)),
h AS (SELECT source, greatest(20.0, count(DISTINCT text) * 0.01) AS most FROM d GROUP BY source),
f AS (SELECT l.source, l.line FROM l JOIN h ON l.source IS NOT DISTINCT FROM h.source
      GROUP BY l.source, l.line, h.most HAVING count(DISTINCT l.text) > h.most),
b AS (SELECT l.r, sum(l.n) AS n FROM l JOIN f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source GROUP BY l.r),
q AS (
  SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(COALESCE(v.n, 0) AS BIGINT) AS n_repeat_words, m.n_words - COALESCE(b.n, 0) AS rest
  FROM m LEFT JOIN v ON m.r = v.r LEFT JOIN b ON m.r = b.r),
g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (rest < 10 OR rest < n_words * 0.2) AS kept
FROM g
"""


@register("op10_line_frequency", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# ------------------------------------------------------------------ 11 near vectors
from .vector_join import near_vectors  # noqa: E402

OP11_SQL = r"""
WITH RECURSIVE
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e, row_number() OVER () AS r FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
         AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
low AS (SELECT reach.a, min(v.vec_id) AS low FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_links, COALESCE(low.low, v.vec_id) AS component_id,
       v.vec_id IS NOT DISTINCT FROM COALESCE(low.low, v.vec_id) AS kept
FROM v LEFT JOIN n ON n.a = v.r LEFT JOIN low ON low.a = v.r
"""


@register("op11_pivot_cells", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(load(spark, sf_dir, "embeddings"))


# ------------------------------------------------------------------ 12 Merkle manifest
from . import manifest as merkle  # noqa: E402

OP12_SQL = r"""
WITH RECURSIVE
d AS (
  SELECT doc_id, lang, row_number() OVER () AS r, text,
         concat(COALESCE(concat(strlen(doc_id::VARCHAR), ':', doc_id), '-'),
                COALESCE(concat(strlen(source), ':', source), '-'), COALESCE(concat(strlen(lang), ':', lang), '-'),
                COALESCE(concat(strlen(n_chars::VARCHAR), ':', n_chars), '-')) AS head,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, x: list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END)) AS crc
  FROM documents),
h AS (
  SELECT doc_id, lang, r, sha256(head || COALESCE(concat(strlen(text), ':', text), '-')) AS leaf,
         sha256(head || COALESCE(concat(strlen(text), ':',
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), '-')) AS lowered,
         doc_id IS NOT NULL AND xor(crc, 4294967295) % 3 = 0 AS hit
  FROM d),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY lang) AS n FROM h),
up AS (
  SELECT lang, 0 AS level, i, n, leaf AS node FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY i))
  FROM up WHERE n > 1 GROUP BY lang, level, n, i // 8),
runs AS (SELECT lang, level, i // 8 AS run, list(node ORDER BY i) AS nodes FROM up WHERE n > 1 GROUP BY lang, level, i // 8),
subs AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
         FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, i, n, subroot AS node FROM subs
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, n, i // 8),
top_runs AS (SELECT level, i // 8 AS run, list(node ORDER BY i) AS nodes FROM top WHERE n > 1 GROUP BY level, i // 8),
steps AS (
  SELECT r, lang, 0 AS level, i, CASE WHEN hit THEN lowered ELSE leaf END AS node, '' AS seen FROM leaves
  UNION ALL
  SELECT s.r, s.lang, s.level + 1, s.i // 8,
         sha256(array_to_string(t.nodes[1:s.i % 8], '') || s.node || array_to_string(t.nodes[s.i % 8 + 2:], '')),
         s.seen || array_to_string(t.nodes[1:s.i % 8], '') || array_to_string(t.nodes[s.i % 8 + 2:], '')
  FROM steps s JOIN runs t ON t.lang IS NOT DISTINCT FROM s.lang AND t.level = s.level AND t.run = s.i // 8),
in_tree AS (SELECT r, lang, arg_max(node, level) AS node, arg_max(seen, level) AS seen FROM steps GROUP BY r, lang),
climb AS (
  SELECT t.r, 0 AS level, s.i, t.node, t.seen FROM in_tree t JOIN subs s ON s.lang IS NOT DISTINCT FROM t.lang
  UNION ALL
  SELECT c.r, c.level + 1, c.i // 8,
         sha256(array_to_string(t.nodes[1:c.i % 8], '') || c.node || array_to_string(t.nodes[c.i % 8 + 2:], '')),
         c.seen || array_to_string(t.nodes[1:c.i % 8], '') || array_to_string(t.nodes[c.i % 8 + 2:], '')
  FROM climb c JOIN top_runs t ON t.level = c.level AND t.run = c.i // 8),
ends AS (SELECT r, arg_max(node, level) AS folded_root, sha256(arg_max(seen, level)) AS proof_sha256 FROM climb GROUP BY r)
SELECT l.doc_id, l.leaf, s.subroot, (SELECT node FROM top WHERE n = 1) AS root, e.proof_sha256, e.folded_root,
       e.folded_root = (SELECT node FROM top WHERE n = 1) AS verified
FROM leaves l JOIN ends e ON e.r = l.r JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@register("op12_merkle_checkpoints", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = merkle.leaf_digest([F.translate(c, UPPER, LOWER) if c == "text" else F.col(c) for c in merkle.FIELDS])
    proved = merkle.manifest(load(spark, sf_dir, "documents"), payload={"tampered": F.when(hit, lowered)})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    return proved.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root",
                         merkle.path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"),
                         ).withColumn("verified", F.col("folded_root") == F.col("root"))


# ------------------------------------------------------------------ 13 ranked search
from .ranked_search import ranked_search  # noqa: E402

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
n AS (SELECT *, CAST(len(words) AS BIGINT) AS n FROM d WHERE len(words) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
tf AS (SELECT r, word, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(words) AS word FROM n) GROUP BY r, word),
w AS (SELECT word, CAST(floor(1000 * ln((2 * (SELECT docs FROM s) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
      FROM tf GROUP BY word),
i AS (SELECT item_id, row_number() OVER () AS q,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM benchmark),
t AS (SELECT q, item_id, word, CAST(count(*) AS BIGINT) AS c
      FROM (SELECT q, item_id, unnest(words) AS word FROM i) GROUP BY q, item_id, word),
m AS (SELECT r, doc_id, 75 + (25 * n * (SELECT docs FROM s)) // (SELECT total FROM s) AS m FROM n),
p AS (SELECT t.q, t.item_id, m.doc_id, m.r,
             CAST(sum(t.c * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m))) AS BIGINT) AS score
      FROM t JOIN w ON w.word = t.word JOIN tf ON tf.word = t.word JOIN m ON m.r = tf.r
      GROUP BY t.q, t.item_id, m.doc_id, m.r),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
      FROM p WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""


@register("op13_blocked_products", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
