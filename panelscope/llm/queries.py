"""The operators' queries over the test tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm.alignment import link_counts
from panelscope.llm.collocations import collocations
from panelscope.llm.langid import language_query
from panelscope.llm.licenses import find_licenses
from panelscope.llm.linecrf import quality_query
from panelscope.llm.mixing import mix_counts
from panelscope.llm.packing import pack_documents
from panelscope.llm.pii import find_spans
from panelscope.llm.quality_rules import quality_rules
from panelscope.llm.sharding import shard_documents
from panelscope.llm.simhash import near_duplicates
from panelscope.llm.suffix_dedup import remove_repeats
from panelscope.llm.topk import top_k

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_query(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(documents(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_query(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path(), added_tokens=True)


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(documents(spark, sf_dir)).drop("licenses")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_dedup, op2_quality_rules, op3_pii, op4_language_id, op5_mixing, op6_quality_classifier, op7_suffix_dedup, op8_topk, op9_sharding, op10_packing, op11_licenses, op12_alignment, op13_collocations)
}

ORACLE_SQL: dict[str, str] = {
    # every 50-byte string of every text, as 100 hexadecimal digits
    "op7_suffix_dedup": """
        WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        starts AS (SELECT doc_id, h, unnest(range(len(h) // 2 - 49)) AS p FROM texts),
        strings AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS s FROM starts),
        firsts AS (SELECT s, min(doc_id) AS first_id FROM strings GROUP BY s),
        gone AS (
          SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM strings JOIN firsts USING (s) WHERE first_id < doc_id),
        runs AS (
          SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM gone),
        spans AS (SELECT doc_id, r, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY ALL),
        gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM spans),
        cut AS (
          SELECT doc_id, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept,
                 count(*) AS n_spans, sum(b - a) AS n_removed
          FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM texts LEFT JOIN cut USING (doc_id)""",
    "op8_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 5""",
    # crc32 from its bitwise definition
    "op9_sharding": """
        WITH table_of AS (
          SELECT list(v ORDER BY i) AS k FROM (
            SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1)) AS v FROM range(256) r(i))),
        texts AS (SELECT doc_id, md5(coalesce(text, '')) AS m, encode(coalesce(text, '')) AS b FROM documents),
        line AS (
          SELECT doc_id, m, octet_length(b) + 8 AS size,
                 list_transform(regexp_extract_all(hex(b), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM texts),
        placed AS (
          SELECT doc_id, size, bytes, sum(size) OVER (ORDER BY m, doc_id ROWS UNBOUNDED PRECEDING) - size AS ahead,
                 row_number() OVER (ORDER BY m, doc_id) AS nth, sum(size) OVER () AS total FROM line),
        cut AS (
          SELECT *, CAST(least(23, floor((CAST(ahead AS DOUBLE) + size / 2) * 24 / total)) AS INTEGER) AS shard FROM placed)
        SELECT doc_id, CAST(size AS BIGINT) AS size,
               xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, y: xor(c >> 8, k[(xor(c, y) & 255) + 1]))) AS text_crc32,
               'bytes' AS law, shard, nth - min(nth) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM cut, table_of""",
    "op13_collocations": """
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
        lists AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
        starts AS (SELECT lang, w, unnest(range(len(w))) AS i FROM lists),
        grams AS (SELECT lang, w[i + 1:i + k] AS g FROM starts, range(1, 6) s(k) WHERE i + k <= len(w)),
        counts AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 100 OR len(g) = 1),
        totals AS (SELECT lang, sum(f) AS n FROM counts WHERE len(g) = 1 GROUP BY lang),
        candidates AS (SELECT lang, g, f AS a FROM counts WHERE len(g) > 1),
        cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM candidates),
        scored AS (
          SELECT c.lang, c.g, c.a, k, l.f AS l, r.f AS r, n, CAST(1000 * CAST(a AS HUGEINT) * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
          FROM cuts c JOIN counts l ON l.lang = c.lang AND l.g = c.g[:k] JOIN counts r ON r.lang = c.lang AND r.g = c.g[k + 1:] JOIN totals t ON t.lang = c.lang),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        spans AS (
          SELECT lang, g[s + 1:s + m] AS g, max(a) AS longer FROM candidates, range(2, 5) x(m), range(0, 4) y(s) WHERE m < len(g) AND s + m <= len(g) GROUP BY ALL),
        kept AS (SELECT b.* FROM best b LEFT JOIN spans s ON s.lang = b.lang AND s.g = b.g WHERE longer IS NULL OR 100 * longer < 100 * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
               array_to_string(g, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score
        FROM kept QUALIFY rank <= 2000""",
}
