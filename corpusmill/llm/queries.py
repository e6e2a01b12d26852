"""Queries opN_<name> of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import digest_documents

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 40)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import deduplicate_lines

    found = deduplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.col("n_lines_").alias("n_lines"), F.col("n_removed_").alias("n_removed"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokenbin import token_files

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    return archive(table(spark, sf_dir, "pages"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digests, find_personal_data

    return digests(find_personal_data(table(spark, sf_dir, "documents")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fim import fill_in_middle, restored

    made = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damaged, repair

    return repair(damaged(table(spark, sf_dir, "conversations")))


OPERATORS = (op1_byte_bpe, op2_decontamination, op3_sharding, op4_toxicity, op5_quality, op6_nearest, op7_simhash, op8_line_dedup, op9_token_files, op10_warc, op11_personal_data, op12_fill_in_middle, op13_conversations)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*OPERATORS, pipeline)}


OP8_SQL = """
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, p, greatest(1, len(regexp_extract_all(ls[p], '[^ \t\n\x0B\f\r]+'))) AS w FROM docs, unnest(range(1, len(ls) + 1)) AS u(p)),
sums AS (SELECT doc_id, p, w, sum(w) OVER (PARTITION BY doc_id ORDER BY p) AS e FROM lines),
runs AS (
  SELECT s.doc_id, s.p AS s, min(t.p) AS e FROM sums s JOIN sums t ON s.doc_id = t.doc_id AND t.p >= s.p AND t.e - s.e + s.w >= 50 GROUP BY ALL
  UNION
  SELECT t.doc_id, max(s.p) AS s, t.p AS e FROM sums s JOIN sums t ON s.doc_id = t.doc_id AND t.p >= s.p AND t.e - s.e + s.w >= 50 GROUP BY t.doc_id, t.p
),
named AS (SELECT r.doc_id, r.s, r.e, array_to_string(list_slice(d.ls, r.s, r.e), chr(10)) AS run FROM runs r JOIN docs d USING (doc_id)),
later AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, s) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM later, unnest(range(s, e + 1)) AS u(p) GROUP BY doc_id)
SELECT doc_id, CASE WHEN g IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(g, i)), lambda i: ls[i]), chr(10)) END AS text,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed
FROM docs LEFT JOIN gone USING (doc_id)
"""

OP10_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM k
"""


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
  CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain' WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""


def oracle_sql() -> dict[str, str]:
    """Equal rows by SQL. Learned models, tokenizers, seeded hashes and approximate search have tests in tests/llm instead."""
    return {"op8_line_dedup": OP8_SQL, "op10_warc": OP10_SQL, "op12_fill_in_middle": OP12_SQL}
