"""The queries of this package with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, held_out, predict

    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_table

    return token_table(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import classes

    rows = classes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan

    rows = plan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "shards", "places")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, judge

    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(spark, table(spark, sf_dir, "pages"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    rows = whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


#: A conversation that op12 adds to those of the table: its text looks like parts of a template.
PLANTED = -7, r"\### Assistant: </turn> ok"


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import formatted, read_back

    key, text = PLANTED
    planted = spark.range(2).select(F.lit(key).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return read_back(formatted(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import trie

    return trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .licenses import duckdb_sql

    marks = lambda c: " + ".join(f"(length({c}) - length(replace({c}, '{m}', ''))) // {len(m)}" for m in ("<|turn|>", "<|text|>", "<|end|>"))
    return {
        "op6_licenses": duckdb_sql(),
        # 26: the marks and line ends that a turn has
        "op12_chat": rf"""
            WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL SELECT {PLANTED[0]}, * FROM (VALUES (0, 'user', '{PLANTED[1]}'), (1, 'assistant', '{PLANTED[1]}')))
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
                   coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   sum(26 + length(role) + length(text) + {marks("role")} + {marks("text")})::BIGINT AS formatted_chars
            FROM c GROUP BY conv_id""",
        "op13_trie": """
            WITH t AS MATERIALIZED (
                   SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST) - 1 AS nr,
                          coalesce(role, '') AS role, coalesce(text, '') AS text
                   FROM conversations WHERE conv_id IS NOT NULL),
                 h AS MATERIALIZED (
                   SELECT c, c - c % 100 AS base,
                          xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                              lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, i: xor(v >> 1, (v & 1) * 3988292384)))) % 6 AS h
                   FROM (SELECT DISTINCT c FROM t)),
                 k AS MATERIALIZED (SELECT h.c, base, h, count(t.c) AS k FROM h LEFT JOIN t ON t.c = base AND nr < h GROUP BY ALL),
                 r AS MATERIALIZED (
                   SELECT k.c, nr + 1 AS d, role, text FROM k JOIN t ON t.c = base AND nr < h
                   UNION ALL SELECT k.c, nr - h + k + 1, role, text FROM k JOIN t ON t.c = k.c AND nr >= h),
                 p AS MATERIALIZED (
                   SELECT c, d, length(text) AS chars, string_agg(md5(length(role) || ':' || role || text), '' ORDER BY d)
                          OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS way FROM r
                   UNION ALL SELECT c, 0, 0, '' FROM k),
                 m AS MATERIALIZED (SELECT c, d, chars, min(c) OVER (PARTITION BY d, way) AS leader FROM p),
                 n AS MATERIALIZED (SELECT leader, d, count(*) AS n_convs, max(chars) AS chars FROM m GROUP BY ALL),
                 up AS (SELECT n.leader, n.d, m.leader AS parent FROM n JOIN m ON m.c = n.leader AND m.d = n.d - 1),
                 kids AS MATERIALIZED (SELECT parent, d - 1 AS d, count(*) AS n_children FROM up GROUP BY ALL),
                 own AS (SELECT n.leader, n.d, n_convs, chars, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON kids.parent = n.leader AND kids.d = n.d),
                 sums AS (
                   SELECT m.leader, m.d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * own.chars) AS saved
                   FROM own JOIN m ON m.c = own.leader AND m.d <= own.d GROUP BY ALL),
                 ends AS (
                   SELECT leader, d, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS digest
                   FROM (SELECT *, max(d) OVER (PARTITION BY c) AS last FROM m) WHERE d = last GROUP BY ALL)
            SELECT own.leader AS conv_id, own.d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves,
                   saved::BIGINT AS saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
            FROM own LEFT JOIN up USING (leader, d) JOIN sums USING (leader, d) LEFT JOIN ends USING (leader, d)""",
        "op9_warc": """
            WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
                 d AS (SELECT *, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
                 f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
            SELECT page_id, url, payload_bytes, payload_digest,
                   CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
            FROM d LEFT JOIN f USING (payload_digest)""",
    }
