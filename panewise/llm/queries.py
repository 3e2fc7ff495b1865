"""The registered queries of this package and, where SQL can tell them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panewise.llm import (
    bitslice,
    language,
    lines,
    mixing,
    negatives,
    neighbours,
    packing,
    quality,
    ranking,
    simhash,
    substrings,
    suffixes,
    token_files,
)
from panewise.llm.tables import shipped
from panewise.llm.tokens import default_path
from panewise.session import shared_folder
from panewise.sources.tables import table


def every(df: DataFrame, id_column: str, step: int) -> DataFrame:
    """The stated query set: rows whose id is divisible by ``step``."""
    return df.where(F.pmod(F.col(id_column), F.lit(step)) == 0)


def op1_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), shingle=3, threshold=2)
    return groups.select("doc_id", "fingerprint", "component_id")


def op3_patience_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_lines(table(spark, sf_dir, "documents"))
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", sha.alias("kept_sha256"))


def op4_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.drop_repeats(table(spark, sf_dir, "documents"), words=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return bitslice.top_k(rows, every(rows, "vec_id", 50), k=5, scale=256)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), epochs=3)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op7_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    token_files.write_tokens(
        table(spark, sf_dir, "documents"), path, default_path("word_bpe_49k.json"), end_id=2
    )
    read = token_files.read_tokens(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))


def op8_round_robin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    pieces = packing.pack(documents, default_path("byte_bpe_50k.json"), end_id=0, window=1024)
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select(*columns)


def op9_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, every(rows, "vec_id", 20), k=20)


def op10_radix_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.drop_repeated_bytes(table(spark, sf_dir, "documents"), depth=50)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op12_norm_bucket_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_threshold_join_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.mine(rows, every(rows, "vec_id", 50))


SQL_OP4 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM words WHERE len(w) >= 13
), hashed AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS h FROM windows
), firsts AS (
  SELECT h, min(doc_id) AS first_doc FROM hashed GROUP BY h HAVING count(DISTINCT doc_id) > 1
), repeats AS (
  SELECT doc_id, list(i ORDER BY i) AS found FROM hashed JOIN firsts USING (h)
  WHERE doc_id > first_doc GROUP BY doc_id
), places AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM (SELECT doc_id, unnest(found) AS i FROM repeats)
), each AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS place, unnest(w) AS word FROM words WHERE len(w) > 0
), stays AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n
  FROM each ANTI JOIN places USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN stays USING (doc_id)
"""

SQL_OP10 = r"""
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), strings AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM texts WHERE n >= 50)
), firsts AS (
  SELECT s, min(doc_id) AS first_doc FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)
), places AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place FROM strings JOIN firsts USING (s) WHERE doc_id > first_doc
), runs AS (
  SELECT doc_id, place, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM places
), spans AS (
  SELECT doc_id, run, min(place) AS a, max(place) + 1 AS b FROM runs GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM spans
), joined AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS z,
         string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS front
  FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN joined USING (doc_id)
"""

SQL_OP5 = """
WITH usable AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), ints AS (
  SELECT vec_id, list_transform(min(embedding), lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM usable GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

SQL_OP6 = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS key
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), named AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
         sum(source_size) OVER () AS total
  FROM sources
), ordered AS (
  SELECT *, row_number() OVER o AS ratio_place,
         CAST(total - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS remaining,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM named WINDOW o AS (ORDER BY source_size / weight, place)
), cut AS (
  SELECT ratio_place AS cut_place, remaining AS cut_remaining, weights AS cut_weights FROM ordered
  WHERE weight * CAST(remaining AS DOUBLE) / weights <= 3 * source_size ORDER BY ratio_place LIMIT 1
), goals AS (
  SELECT source, source_size,
         CASE WHEN ratio_place < cut_place THEN CAST(3 * source_size AS DOUBLE)
              ELSE weight * CAST(cut_remaining AS DOUBLE) / cut_weights END AS target
  FROM ordered, cut
), placed AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, source, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0
                 ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - before)) END
            AS BIGINT) AS taken
FROM placed
"""

SQL_OP12 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS place
  FROM documents
), sized AS (
  SELECT doc_id, place, w, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized
), texts AS (
  SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL GROUP BY item_id
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM texts
), counted AS (
  SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(w) AS term FROM sized)
  WHERE term IN (SELECT term FROM asked) GROUP BY place, term
), weighted AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM counted, totals GROUP BY term
), lengths AS (
  SELECT place, doc_id, 100 - 50 + ((50 * n * docs) // terms) AS m FROM sized, totals
), impacts AS (
  SELECT place, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * m)) AS part
  FROM counted JOIN weighted USING (term) JOIN lengths USING (place)
), scored AS (
  SELECT item_id, place, any_value(doc_id) AS doc_id, CAST(sum(part) AS BIGINT) AS score
  FROM asked JOIN impacts USING (term) GROUP BY item_id, place
), ranked AS (
  SELECT item_id, doc_id, score,
         CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

SQL_OP13 = """
WITH usable AS (
  SELECT vec_id, embedding, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), least AS (
  SELECT vec_id, min({'v': embedding, 'l': label}) AS s FROM usable GROUP BY vec_id
), ints AS (
  SELECT vec_id, s.l AS label, list_transform(s.v, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM least
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM ints a JOIN ints b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), pairs AS (
  SELECT anchor_id, positive_id, positive_score, n.vec_id AS negative_id, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives JOIN scored n USING (anchor_id)
  WHERE NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM pairs WHERE rank <= 3
"""

QUERIES = {
    "op1_byte_cnn_quality": op1_byte_cnn_quality,
    "op2_covering_simhash": op2_covering_simhash,
    "op3_patience_lines": op3_patience_lines,
    "op4_seed_and_extend": op4_seed_and_extend,
    "op5_bit_sliced_top_k": op5_bit_sliced_top_k,
    "op6_mix_sources": op6_mix_sources,
    "op7_elias_fano_tokens": op7_elias_fano_tokens,
    "op8_round_robin_packing": op8_round_robin_packing,
    "op9_block_matrix_neighbours": op9_block_matrix_neighbours,
    "op10_radix_suffixes": op10_radix_suffixes,
    "op11_byte_cnn_language": op11_byte_cnn_language,
    "op12_norm_bucket_ranking": op12_norm_bucket_ranking,
    "op13_threshold_join_negatives": op13_threshold_join_negatives,
}
QUERIES = {name: shipped(query) for name, query in QUERIES.items()}
SQL = {
    "op4_seed_and_extend": SQL_OP4,
    "op5_bit_sliced_top_k": SQL_OP5,
    "op6_mix_sources": SQL_OP6,
    "op10_radix_suffixes": SQL_OP10,
    "op12_norm_bucket_ranking": SQL_OP12,
    "op13_threshold_join_negatives": SQL_OP13,
}
