"""The queries opN_<name> over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import (bpe, embedding_dedup, exact_dedup, hard_negatives, html_text, licenses, merkle, mixing, pii,
    quality, simhash, substring_dedup, token_files)
from auditlake.llm.common import table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: The vocabulary of the token files and the id that ends a document there.
WORD_TOKENIZER, END_ID = "word_bpe_49k.json", 2


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN,
        keep_ids=False)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents")).drop("found")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), keep_text=False)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = mixing.allocation(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "size", "source_size", "target", "taken")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, sf_dir, "documents")).drop("lang", "place")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return token_files.token_files(docs, public_tokenizers.path(WORD_TOKENIZER), END_ID, keep_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_embedding_dedup,
        op2_byte_bpe,
        op3_html_text,
        op4_license_scan,
        op5_pii,
        op6_simhash_dedup,
        op7_substring_dedup,
        op8_exact_dedup,
        op9_quality,
        op10_source_mixing,
        op11_hard_negatives,
        op12_merkle_manifest,
        op13_token_files,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": OP8_SQL, "op10_source_mixing": OP10_SQL, "op11_hard_negatives": OP11_SQL,
        "op12_merkle_manifest": OP12_SQL}


OP8_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(string_split_regex(trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' '))
           - (trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') = '')::INT AS size,
         ('0x' || substr(md5('mix-1:' || doc_id), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size::DOUBLE * 2 AS cap,
             (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS words FROM s),
l AS (SELECT *, (words - coalesce(sum(source_size) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2)
                / (sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM w),
f AS (SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, rank LIMIT 1),
g AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT level FROM f)), cap) AS target FROM l),
x AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h % 4096, d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       ((whole + CASE WHEN size > 0 AND whole < 2 AND start + size / 2.0::DOUBLE < target - whole * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM x
"""

OP11_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INT AS rank, s.other_id AS negative_id, p.positive_score,
       s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score
  AND 100 * s.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 5
"""

_OP12_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}, '-')" for f in (
    "doc_id", "source", "lang", "n_chars", "{text}")) + ")"

OP12_SQL = f"""
WITH RECURSIVE
crc(b, c, j) AS (SELECT b, b, 0 FROM range(256) r(b) UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, j + 1 FROM crc WHERE j < 8),
crcs AS (SELECT list(c ORDER BY b) AS t FROM crc WHERE j = 8),
d AS (SELECT row_number() OVER () AS row, *, coalesce('=' || lang, '') AS g,
  list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])) AS c FROM documents, crcs),
e AS (SELECT *, xor(c, 4294967295) % 3 = 0 AS touched FROM d),
leaves AS (SELECT row, doc_id, g, {_OP12_LEAF.replace("{text}", "text")} AS h, CASE WHEN touched THEN
  {_OP12_LEAF.replace("{text}", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered FROM e),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
  count(*) OVER (PARTITION BY g) AS n FROM leaves),
low(k, g, i, h, n) AS (SELECT 0, g, i, h, n FROM placed UNION ALL
  SELECT k + 1, g, i // 8, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 7) // 8 FROM low WHERE n > 1 GROUP BY k, g, i // 8),
subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high(k, i, h, n) AS (SELECT 0, i, h, n FROM subroots UNION ALL
  SELECT k + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 7) // 8 FROM high WHERE n > 1 GROUP BY k, i // 8),
nodes AS (SELECT 0 AS tree, k, g, i, h FROM low WHERE n > 1 UNION ALL SELECT 1, k, NULL, i, h FROM high WHERE n > 1),
own AS (SELECT p.row, 0 AS tree, l.k, p.g, p.i // (8 ** l.k)::BIGINT AS i FROM placed p
    JOIN (SELECT DISTINCT k, g FROM low WHERE n > 1) l ON p.g = l.g
  UNION ALL SELECT p.row, 1, l.k, NULL, s.i // (8 ** l.k)::BIGINT FROM placed p JOIN subroots s ON p.g = s.g,
    (SELECT DISTINCT k FROM high WHERE n > 1) l),
steps AS (SELECT o.row, row_number() OVER (PARTITION BY o.row ORDER BY o.tree, o.k) - 1 AS step,
    coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < o.i), '') AS l,
    coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > o.i), '') AS r
  FROM own o JOIN nodes x ON x.tree = o.tree AND x.k = o.k AND x.g IS NOT DISTINCT FROM o.g AND x.i // 8 = o.i // 8
  GROUP BY o.row, o.tree, o.k),
folds(row, step, h) AS (SELECT row, 0, coalesce(tampered, h) FROM placed UNION ALL
  SELECT f.row, f.step + 1, sha256(s.l || f.h || s.r) FROM folds f JOIN steps s ON f.row = s.row AND f.step = s.step),
proofs AS (SELECT row, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM steps GROUP BY row),
folded AS (SELECT row, arg_max(h, step) AS folded_root FROM folds GROUP BY row)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, t.h AS root, coalesce(q.proof, sha256('')) AS proof_sha256, f.folded_root,
       f.folded_root = t.h AS verified
FROM placed p JOIN subroots s ON p.g = s.g JOIN folded f ON p.row = f.row LEFT JOIN proofs q ON p.row = q.row,
     (SELECT h FROM high WHERE n = 1) t
"""
