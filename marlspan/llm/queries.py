"""The registered queries of the corpus operators and the SQL that some of
them can be checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .embedding_dedup import near_duplicates
from .exact_dedup import exact_groups
from .html_extract import extract
from .language_id import held_out, predict, train
from .line_dedup import repeated_units
from .mixing import entropy_mix
from .ngram_jaccard import near_components
from .packing import pack_documents
from .sharding import shard_plan
from .spelling import spelling_variants
from .stupid_backoff import backoff_scores
from .token_alignment import align_tokenizers
from .token_files import token_table

MIX_WEIGHTS = [3.0, 1.0, 2.0]


def op1_word_backoff_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).select("text", "lang"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def op2_text_density_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def op3_token_group_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"), n=5, percent=80)
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


# Shingles as text, pairs that share one, and the ids that links reach; ids are unique in the driver's tables.
OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
), r AS (
  SELECT doc_id, doc_id AS seen FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.seen) AS component_id FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY 1
"""


def op4_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = entropy_mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, share=1.5, cap=2.0)
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
        "copies", "rate",
    )


def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = backoff_scores(table(spark, sf_dir, "documents"), order=3)
    return scores.select(F.col("id").alias("doc_id"), "n_words", "n_backed_off", F.round("log_score", 6).alias("log_score"), F.round("score", 6).alias("score"))


# Exploded n-grams of orders 1 to 3 with counts per document and in all; ids are unique in the driver's tables.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (
  SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS k FROM d
), g AS (
  SELECT doc_id, k, w, CASE WHEN k > 0 THEN lag(w) OVER p END AS v, CASE WHEN k > 1 THEN lag(w, 2) OVER p END AS u FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY k)
), c AS (
  SELECT *, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
    count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) AS c2, count(*) OVER (PARTITION BY u, v, w, k = 1) - count(*) OVER (PARTITION BY doc_id, u, v, w, k = 1) AS c3,
    (SELECT count(*) FROM t) - count(*) OVER (PARTITION BY doc_id) AS others FROM g
), x AS (
  SELECT *, lag(c1) OVER p AS c1v, lag(c2) OVER p AS c2v, (SELECT count(*) FROM d WHERE len(w) > 0) - 1 AS starts FROM c WINDOW p AS (PARTITION BY doc_id ORDER BY k)
), s AS (
  SELECT doc_id, c3 > 0 AS known, CASE WHEN c3 > 0 THEN ln(c3 / (CASE WHEN k = 0 THEN starts ELSE c2v END)::DOUBLE)
    WHEN c2 > 0 THEN ln(0.4 * c2 / (CASE WHEN k = 0 THEN starts ELSE c1v END)::DOUBLE) ELSE ln(0.16 * greatest(1, c1) / greatest(1, others)::DOUBLE) END AS l FROM x
)
SELECT doc_id, len(w) AS n_words, count(*) FILTER (NOT known) AS n_backed_off, round(sum(l), 6) AS log_score, round(sum(l) / len(w), 6) AS score FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id, w
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), "group_size", "kept", F.col("digest").alias("text_sha256")
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""


def op7_line_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removals = repeated_units(table(spark, sf_dir, "documents"), unit="phrase")
    return removals.select(
        F.col("id").alias("doc_id"), "unit", "start", "end", "n_words", "group_size",
        F.col("keep_id").alias("keep_doc_id"), "keep_unit",
    )


def op8_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), "word_bpe_49k.json", 2048)
    return packed.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op9_pivot_permutation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op10_two_pass_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = shard_plan(table(spark, sf_dir, "documents"), n_shards=24)
    return plan.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_byte_owner_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_tokenizers(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", "piece_bpe_32k.model")
    return aligned.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_rare_qgram_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


# crc32 by its table of 256 remainders; near words share what is left when the edited code point is taken out.
OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), r AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL
), h AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))::BIGINT[]),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM r, crc
), v AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3
), k AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)
), p AS (
  SELECT a.word AS a, b.word AS b FROM k a JOIN k b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT k.word, v.word FROM k JOIN v ON v.word = k.rest UNION SELECT v.word, k.word FROM k JOIN v ON v.word = k.rest
), f AS (
  SELECT p.a AS word, count(*) AS n_near, min(struct_pack(less := -b.n, near := b.word)) AS best FROM p JOIN v b ON b.word = p.b GROUP BY 1
), o AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * v.n THEN best.near END AS form, CASE WHEN -best.less >= 2 * v.n THEN -best.less END AS form_n
  FROM v LEFT JOIN f USING (word)
), w AS (
  SELECT word, form AS at FROM o UNION ALL SELECT w.word, o.form FROM w JOIN o ON o.word = w.at WHERE w.at IS NOT NULL
), e AS (
  SELECT w.word, w.at AS root FROM w JOIN o ON o.word = w.at WHERE o.form IS NULL
)
SELECT o.word, o.n, o.n_near, o.form, o.form_n, coalesce(e.root, o.word) AS root FROM o LEFT JOIN e USING (word)
"""


def op13_bit_packed_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = token_table(table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=1)
    return tokens.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


LLM_QUERIES = {
    "op1_word_backoff_language": op1_word_backoff_language,
    "op2_text_density_html": op2_text_density_html,
    "op3_token_group_jaccard": op3_token_group_jaccard,
    "op4_entropy_mixing": op4_entropy_mixing,
    "op5_stupid_backoff": op5_stupid_backoff,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_line_hash_dedup": op7_line_hash_dedup,
    "op8_genetic_packing": op8_genetic_packing,
    "op9_pivot_permutation_dedup": op9_pivot_permutation_dedup,
    "op10_two_pass_sharding": op10_two_pass_sharding,
    "op11_byte_owner_alignment": op11_byte_owner_alignment,
    "op12_rare_qgram_spelling": op12_rare_qgram_spelling,
    "op13_bit_packed_token_files": op13_bit_packed_token_files,
}
LLM_SQL = {"op3_token_group_jaccard": OP3_SQL, "op5_stupid_backoff": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op12_rare_qgram_spelling": OP12_SQL}
