"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import Workspace, read_table


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.exact_dedup import exact_dedup

    decided = exact_dedup(read_table(spark, sf_dir, "documents"), Workspace(spark, "op10"))
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


#: White space runs become one space; of equal texts the smallest doc_id stays.
OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), g AS (
  SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g USING (body)
"""


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.license_scan import document_paths, scan_licenses

    return scan_licenses(document_paths(read_table(spark, sf_dir, "documents")), Workspace(spark, "op1"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.mixing import mix_plan

    plan = mix_plan(read_table(spark, sf_dir, "documents"), Workspace(spark, "op3"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.simhash import hex_fingerprint, near_groups

    groups = near_groups(read_table(spark, sf_dir, "documents"), Workspace(spark, "op2"))
    return groups.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.suffix_dedup import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"), Workspace(spark, "op4"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.toxicity import score_toxicity

    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), Workspace(spark, "op5"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.quality import score_quality

    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), Workspace(spark, "op9"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.token_counts import count_tokens

    counted = count_tokens(read_table(spark, sf_dir, "documents"), Workspace(spark, "op6"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.sentencepiece_codec import digests

    Workspace(spark, "op7")  # sends the package to the executors
    return digests(read_table(spark, sf_dir, "documents"))


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.ogg import describe_column, encode_column

    work = Workspace(spark, "op8")
    return describe_column(work.keep(encode_column(read_table(spark, sf_dir, "documents")), "media"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.warc import archive_pages

    records = archive_pages(read_table(spark, sf_dir, "pages"), Workspace(spark, "op11"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.resampling import resample

    rows = resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), Workspace(spark, "op12"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.prefix_trie import prefix_trie

    return prefix_trie(read_table(spark, sf_dir, "conversations"), Workspace(spark, "op13"))


#: Words, targets by levels (sources below the level are full), and one draw a document.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1
), c AS (
  SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w, source_size * 2::DOUBLE AS cap FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM c WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM l WHERE cap / w >= level ORDER BY cap / w, level DESC LIMIT 1) * w, cap)) AS target FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2::DOUBLE) ELSE 0::DOUBLE END AS rate FROM t
), n AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.rate, ('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS draw
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM n
"""

#: All windows of 50 bytes (as hexadecimal digits, cut from pieces), those that a smaller doc_id has, and runs of them.
OP4_SQL = """
WITH b AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS d, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT r, d, k * 1024 AS base, substr(h, k * 2048 + 1, 2048 + 98) AS piece FROM (SELECT r, d, h, unnest(range((len(h) + 2047) // 2048)) AS k FROM b)
), w AS (
  SELECT r, d, base + o AS start, substr(piece, 2 * o + 1, 100) AS bytes FROM (SELECT *, unnest(range(least(1024, len(piece) // 2 - 49))) AS o FROM p WHERE len(piece) >= 100)
), m AS (
  SELECT bytes, min(d) AS first FROM w GROUP BY 1
), g AS (
  SELECT w.r, w.start, w.start > coalesce(lag(w.start) OVER (PARTITION BY w.r ORDER BY w.start) + 50, -1) AS opens FROM w JOIN m USING (bytes) WHERE m.first < w.d
), i AS (
  SELECT r, k, min(start) AS a, max(start) + 50 AS z FROM (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY r ORDER BY start) AS k FROM g) GROUP BY 1, 2
), e AS (
  SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM i
), q AS (
  SELECT e.r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(b.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM e JOIN b USING (r) GROUP BY 1
)
SELECT b.doc_id, (len(b.h) // 2)::BIGINT AS n_bytes, coalesce(q.n_removed, 0)::BIGINT AS n_removed, coalesce(q.n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN q.r IS NULL THEN b.h ELSE q.head || substr(b.h, 2 * q.last + 1) END)) AS kept_sha256
FROM b LEFT JOIN q USING (r)
"""


OP11_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(body) AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


def _crc32(text: str) -> str:
    """The CRC of the UTF-8 bytes of an expression, bit by bit (3988292384 is the polynomial)."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    bits = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {bits}), 4294967295)"


#: Distinct words get their buckets once; sums by bucket and document are joins.
OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), q AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), o AS (
  SELECT r, unnest(words) AS w FROM d
), c AS (
  SELECT w, {_crc32('w')} % 10000 AS bucket FROM (SELECT w FROM o UNION SELECT w FROM q)
), s AS (
  SELECT bucket, count(*) AS s FROM o JOIN c USING (w) GROUP BY 1
), t AS (
  SELECT bucket, count(*) AS t FROM q JOIN c USING (w) GROUP BY 1
), g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM o) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM q) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)
), f AS (
  SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM o JOIN c USING (w) JOIN g USING (bucket) GROUP BY 1
), e AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN f USING (r)
), z AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM e
), k AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place FROM z
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM z WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM k
"""

#: A node is the joined digests of its turns; ancestors are prefixes of that.
OP13_SQL = f"""
WITH t AS (
  SELECT coalesce(conv_id, 9223372036854775807) AS c, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS points FROM conversations
), o AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS k FROM t
), i AS (
  SELECT c, max(k) AS own, CASE WHEN c = 9223372036854775807 THEN '' ELSE c::VARCHAR END AS name FROM o GROUP BY 1
), f AS (
  SELECT *, CASE WHEN name <> '' THEN c - c % 100 END AS base, {_crc32('name')} % 6 AS h FROM i
), e AS (
  SELECT f.*, least(f.h, coalesce(b.own, 0)) AS there FROM f LEFT JOIN i b ON b.c = f.base
), r AS (
  SELECT e.c, o.k AS depth, o.digest, o.points FROM e JOIN o ON o.c = e.base AND o.k <= e.there
  UNION ALL SELECT e.c, o.k - e.h + e.there, o.digest, o.points FROM e JOIN o ON o.c = e.c AND o.k > e.h
), p AS (
  SELECT e.c, e.name, count(r.c) AS n, coalesce(string_agg(r.digest, '' ORDER BY r.depth), '') AS path, list(r.points ORDER BY r.depth) AS lengths FROM e LEFT JOIN r USING (c) GROUP BY 1, 2
), m AS (
  SELECT *, unnest(range(n + 1)) AS depth FROM p
), x AS (
  SELECT substr(path, 1, 64 * depth) AS node, depth, min(c) AS c, count(*) AS n, max(CASE WHEN depth > 0 THEN lengths[depth] ELSE 0 END) AS points, coalesce(string_agg(CASE WHEN n = depth THEN name END, ',' ORDER BY c), '') AS ends FROM m GROUP BY 1, 2
), y AS (
  SELECT substr(node, 1, 64 * (depth - 1)) AS node, count(*) AS kids FROM x WHERE depth > 0 GROUP BY 1
), z AS (
  SELECT x.*, coalesce(y.kids, 0) AS kids FROM x LEFT JOIN y USING (node)
), u AS (
  SELECT substr(node, 1, 64 * d) AS node, sum((kids = 0)::BIGINT)::BIGINT AS leaves, sum((n - 1) * points)::BIGINT AS saved FROM (SELECT *, unnest(range(depth + 1)) AS d FROM z) GROUP BY 1
)
SELECT nullif(z.c, 9223372036854775807) AS conv_id, z.depth::BIGINT AS depth, nullif(a.c, 9223372036854775807) AS parent_conv_id, z.n::BIGINT AS n_convs, z.kids::BIGINT AS n_children, u.leaves AS n_leaves, u.saved AS saved_tokens, sha256(z.ends) AS ends_sha256
FROM z JOIN u USING (node) LEFT JOIN x a ON z.depth > 0 AND a.node = substr(z.node, 1, 64 * (z.depth - 1))
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_ogg_media": op8_ogg_media,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_warc": op11_warc,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op3_source_mixing": OP3_SQL,
    "op4_suffix_dedup": OP4_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_warc": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
