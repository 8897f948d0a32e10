"""Queries of the training-data operators with production parameters, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -1 whose texts hold the control strings, as logs of events folded into messages."""
    from . import chat

    own = spark.sql(
        "SELECT -1L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role, '<|im_end|><|im_start|>assistant ok' AS text FROM range(2)"
    )
    log = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.digests(chat.render(chat.reconstruct(chat.as_events(log))))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of floor(256 x) for every vector whose id is divisible by 50."""
    from . import topk

    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.floor(x * 256).cast("double")))
    v = _table(spark, sf_dir, "embeddings").select("vec_id", whole.alias("vector"))
    return topk.top_k(v, v.where("vec_id % 50 = 0"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep_ids=False)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.jaccard_join(_table(spark, sf_dir, "documents"), n=3, percent=90)


def toxicity_model(spark: SparkSession, sf_dir: str):
    """Fitted on labels of rows whose crc32(doc_id as text) mod 3 is not 1."""
    from . import toxicity

    labels = _table(spark, sf_dir, "labels").where("crc32(cast(doc_id as string)) % 3 <> 1")
    return toxicity.fit(_table(spark, sf_dir, "documents"), labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    scored = toxicity.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), toxicity_model(spark, sf_dir), 0.7)
    return scored.select("doc_id", F.expr("crc32(cast(doc_id as string)) % 3 = 1").alias("held_out"), "score", "predicted")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_cap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import cap_dedup

    return cap_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.scan(_table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    from . import licenses

    text = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    text = f"regexp_replace({text}, '{licenses.COPYRIGHT_LINE}', '', 'g')"
    for other, kept in licenses.SPELLINGS:
        text = f"replace({text}, '{other}', '{kept}')"
    text = f"trim(regexp_replace({text}, '{licenses.OTHER}', ' ', 'g'), ' ')"
    known = ", ".join(f"('{d}', '{n}')" for d, n in licenses.digests().items())
    return (
        f"WITH c AS (SELECT doc_id, {text} AS canonical FROM documents), k(digest, license) AS (VALUES {known}) "
        "SELECT doc_id, CAST(length(canonical) AS BIGINT) AS n_canonical, sha256(canonical) AS digest, license FROM c LEFT JOIN k ON k.digest = sha256(canonical)"
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back; the archives are removed once the result is in the shared folder."""
    from . import warc
    from ._util import cut

    path = warc.archive_dir(spark)
    warc.write_pages(_table(spark, sf_dir, "pages"), path)
    out = cut(warc.read_pages(spark, path))
    warc.remove(path)
    return out


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 3, 1, 2, repeating; the mix holds 150 % of all words, no source above twice its own."""
    from . import mixing

    return mixing.per_document(*mixing.mix(_table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if v}


SQL = {
    "op1_chat_formatting": r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
esc AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS body,
         regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g') AS head FROM rows_),
agg AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum(length(head) + length(body) + 24) AS formatted_chars FROM esc GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM agg""",
}
SQL["op9_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_ FROM pages),
h AS (SELECT *, sha1(payload) AS sha FROM p),
b AS (SELECT *, string_agg_bits.bits FROM h, LATERAL (
  SELECT string_agg(bin(CAST('0x' || sha[i] AS INTEGER) + 16)[2:], '' ORDER BY i) AS bits FROM range(1, 41) t(i)) string_agg_bits)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
  (SELECT string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(
     16 * CAST(bits[5*j+1] AS INT) + 8 * CAST(bits[5*j+2] AS INT) + 4 * CAST(bits[5*j+3] AS INT) + 2 * CAST(bits[5*j+4] AS INT) + CAST(bits[5*j+5] AS INT) + 1 AS INT)], '' ORDER BY j)
   FROM range(0, 32) r(j)) AS payload_digest,
  CASE WHEN page_id = first_ THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_ THEN first_ END AS refers_to
FROM b"""

SQL["op2_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
SQL["op8_license_scan"] = _license_sql()
