"""The operators as queries over the driver's tables, with their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marquee.folders import scratch
from marquee.llm.common import documents, labels
from marquee.llm.exact_dedup import exact_dedup
from marquee.llm.mixing import mix
from marquee.llm.ngram_join import near_duplicates
from marquee.llm.packing import pack
from marquee.llm.pii import pseudonymise
from marquee.llm.prefix_trie import prefix_trie
from marquee.llm.quality_model import importance_resample
from marquee.llm.quality_rules import quality_rules
from marquee.llm.repeated_bytes import remove_repeated_bytes
from marquee.llm.repeated_passages import remove_repeats
from marquee.llm.token_counts import token_counts
from marquee.llm.training_order import training_pieces, write_training_order
from marquee.llm.vector_codes import vector_codes


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "training-order")
    write_training_order(documents(spark, sf_dir), folder)
    return training_pieces(spark, folder)


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.marquee.pii.key", "an example, not a secret")
    return pseudonymise(documents(spark, sf_dir), key).select("doc_id", "text", "n_entities")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_ngram_join, op3_training_order, op4_repeated_passages, op5_quality_classifier, op6_token_counts, op7_quality_rules,
        op8_packing, op9_mixing, op10_pii_surrogates, op11_vector_codes, op12_repeated_bytes, op13_prefix_trie,
    )
}


def _round_sql(k: int) -> str:
    """Of codebook k (B{k}) the nearest entries (A{k + 1}), and the codebook that follows."""
    return f"""
        A{k + 1} AS MATERIALIZED (
          SELECT x.row, x.part, any_value(x.v) AS v, min(struct_pack(d := list_inner_product(x.v, x.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(x.v, b.v), entry := b.entry)) AS best
          FROM x JOIN B{k} b USING (part) GROUP BY ALL),
        B{k + 1} AS MATERIALIZED (
          SELECT part, entry, coalesce(m, v) AS v FROM B{k} LEFT JOIN (
            SELECT part, entry, list(m ORDER BY pos) AS m
            FROM (SELECT part, best.entry AS entry, pos, floor(sum(v[pos]) / count(*)) AS m FROM A{k + 1}, range(1, 1025) t(pos) WHERE pos <= len(v) GROUP BY ALL) GROUP BY ALL) USING (part, entry)),"""

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
          FROM documents),
        w AS (
          SELECT *, first_value(doc_id) OVER best AS keep_id,
                 count(*) OVER (PARTITION BY text_sha256) AS group_size,
                 row_number() OVER best AS place
          FROM d WINDOW best AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM w""",
    "op2_ngram_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
          FROM documents),
        s AS (
          SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
          FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        l AS (
          SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        r AS (SELECT doc_id AS x, doc_id AS z FROM s UNION SELECT r.x, l.y FROM r JOIN l ON r.z = l.x)
        SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(z) FROM r WHERE r.x = s.doc_id) AS component_id FROM s""",
    "op4_repeated_passages": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
        f AS (SELECT h, min(doc_id) AS m FROM v GROUP BY h),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM v JOIN f USING (h) WHERE m < doc_id),
        e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
        k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM e ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op9_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
          FROM documents),
        s AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                 (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
          FROM d GROUP BY source),
        f AS (
          SELECT *, source_size * 3 AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total,
                 CAST(coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below,
                 CAST(sum(weight) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest
          FROM s),
        g AS (SELECT *, CAST(cap AS DOUBLE) * rest <= CAST(weight AS DOUBLE) * (total - below) AS is_full FROM f),
        t AS (
          SELECT source, source_size,
                 CASE WHEN is_full THEN CAST(cap AS DOUBLE)
                      ELSE CAST(weight AS DOUBLE)
                           * CAST(total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS DOUBLE)
                           / CAST(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target,
                 CAST(CAST('0x' || substr(md5('mix-7|' || coalesce(source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS shift
          FROM g),
        r AS (
          SELECT d.doc_id, d.size, t.source_size, t.target, t.shift,
                 CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0 END AS rate,
                 CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id) AS DOUBLE) AS k
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(size * least(3, floor(k * rate + shift) - floor((k - 1) * rate + shift)) AS BIGINT) AS taken
        FROM r""",
    "op11_vector_codes": f"""
        WITH k AS MATERIALIZED (
          SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS v
          FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        x AS MATERIALIZED (SELECT row, part, v[len(v) // 4 * part + 1:len(v) // 4 * (part + 1)] AS v FROM k, range(4) p(part)),
        B0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v FROM x WHERE row <= 256),{"".join(map(_round_sql, range(5)))}
        h AS (SELECT sha256(coalesce(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos), '')) AS codebooks_sha256
              FROM (SELECT part, entry, unnest(v) AS c, unnest(range(len(v))) AS pos FROM B4)),
        e AS (SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM A5 GROUP BY row)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN k USING (row), h""",
    "op12_repeated_bytes": r"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, encode(coalesce(text, '')) AS b FROM documents),
        v AS MATERIALIZED (SELECT row, doc_id, i, md5(b[i:i + 49]) AS h FROM (SELECT *, unnest(range(1, octet_length(b) - 48)) AS i FROM d)),
        f AS (SELECT h, min(doc_id) AS m FROM v GROUP BY h HAVING count(DISTINCT doc_id) > 1 OR count(doc_id) < count(*)),
        g AS (SELECT row, i, i - max(i) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM v JOIN f USING (h) WHERE m < doc_id OR doc_id IS NULL AND m IS NOT NULL),
        n AS (SELECT *, count_if(gap IS NULL OR gap > 50) OVER (PARTITION BY row ORDER BY i) AS span FROM g),
        s AS (SELECT row, span, min(i) AS a, max(i) + 49 AS z FROM n GROUP BY ALL),
        w AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY row ORDER BY a), 0) AS before FROM s),
        k AS (SELECT row, string_agg(hex(b[before + 1:a - 1]), '' ORDER BY a) AS kept, max(z) AS z, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM w JOIN d USING (row) GROUP BY row)
        SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(CASE WHEN z IS NULL THEN b ELSE unhex(kept || hex(b[z + 1:octet_length(b)])) END) AS kept_sha256
        FROM d LEFT JOIN k USING (row)""",
    "op13_prefix_trie": r"""
        WITH t AS (
          SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) || printf('%08x', length(coalesce(text, ''))) AS token
          FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT conv_id, list(token ORDER BY turn NULLS FIRST, token) AS own FROM t GROUP BY conv_id),
        h AS (
          SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                   lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda y, i: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 6 AS h FROM o),
        r AS (SELECT h.conv_id, array_to_string(list_concat(coalesce(b.own, CAST([] AS VARCHAR[]))[1:h], h.own[h + 1:]), '') AS path FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
        m AS (SELECT conv_id, path, unnest(range(0, len(path) // 40 + 1)) AS depth FROM r),
        n AS (
          SELECT path[1:40 * depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(path) = 40 * depth), '')) AS ends_sha256
          FROM m GROUP BY ALL),
        c AS (SELECT node[1:40 * (depth - 1)] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
        s AS (
          SELECT node, depth, coalesce(n_children, 0) = 0 AS leaf,
                 CASE WHEN depth > 0 THEN (n_convs - 1) * CAST('0x' || right(node, 8) AS BIGINT) ELSE 0 END AS saved
          FROM n LEFT JOIN c USING (node)),
        u AS (SELECT node[1:40 * k] AS node, count_if(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM s) GROUP BY ALL)
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
               CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM n JOIN u USING (node) LEFT JOIN c USING (node) LEFT JOIN n p ON n.depth > 0 AND p.node = n.node[1:40 * (n.depth - 1)]""",
}
