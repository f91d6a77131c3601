"""Registered queries over the text operators, with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import decontaminate, fill_in_middle, hard_negatives, jaccard, language_model, license_scan, packing, preference, quality_rules, repair, suffixes, toxicity, url_filter
from gleanery.llm.common import document_key
from gleanery.queries.common import Registry, table
from gleanery.session import scratch_path

R = Registry()
TOKENIZER = "word_bpe_49k.json"

URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

URL_SQL = r"""
WITH cut AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), rules(rule, verdict, h, p) AS (
  VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
         ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')
), best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id
)
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (page_id)
"""


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizer lies; every executor has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


@R.add("op5_url_filters", URL_SQL)
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filter.RULES)
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


@R.add("op9_quality_rules")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


@R.add("op4_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


@R.add("op10_token_id_output")
def token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    repair.write(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return repair.read(spark.read.schema(repair.SHARDS).parquet(path)).drop("ids")


@R.add("op7_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.pmod(document_key(), F.lit(5)) == 0
    ranking = preference.learn(documents, table(spark, sf_dir, "labels"), ~held_out)
    scored = documents.select("doc_id", held_out.alias("held_out"), preference.score(F.col("text"), ranking).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= preference.ACCEPT).cast("int"))


@R.add("op8_toxicity")
def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.pmod(document_key(), F.lit(4)) == 2
    classifier = toxicity.learn(documents, table(spark, sf_dir, "labels"), ~held_out)
    scored = documents.select("doc_id", held_out.alias("held_out"), toxicity.score(F.col("text"), classifier).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.ACCEPT).cast("int"))


@R.add("op1_language_model")
def language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(document_key(), F.lit(10)) == 0
    return language_model.score(table(spark, sf_dir, "documents"), held_out)


@R.add("op6_decontamination")
def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@R.add("op2_suffix_array_dedup")
def shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents")).drop("document")


SIMILARITY_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), tokens AS (
  SELECT doc_id, unnest(s) AS t FROM sets
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM tokens a JOIN tokens b USING (t) WHERE a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y
  WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)
), ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION SELECT reached.doc_id, ways.y FROM reached JOIN ways ON ways.x = reached.other
)
SELECT sets.doc_id, any_value(len(s)) AS n_shingles, min(other) AS component_id
FROM sets JOIN reached USING (doc_id) GROUP BY sets.doc_id
"""


@R.add("op3_ngram_jaccard", SIMILARITY_SQL)
def similarity_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents")).drop("document", "class")


FILL_IN_MIDDLE_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), numbers AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM drawn
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
              THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT doc_id, n, form, text, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
         array_to_string(units[b + 1:n], '') AS s
  FROM cut
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@R.add("op11_fill_in_middle", FILL_IN_MIDDLE_SQL)
def fill_in_middle_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.rearrange(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(fill_in_middle.restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def _license_sql() -> str:
    """The scan over the shipped templates: their k-grams are laid out as rows."""
    rows, width = [], license_scan.WIDTH
    named = [(*x, True) for x in license_scan.PHRASES] + [(*x, False) for x in license_scan.NOTICES]
    for number, (label, text, phrase) in enumerate(named):
        words = text.split()
        k = min(width, len(words))
        for i in range(len(words) - k + 1):
            rows.append(f"({number}, '{label}', {phrase}, {len(words)}, {k}, {i}, '{' '.join(words[i:i + k])}')")
    return rf"""
WITH t(template, label, phrase, size, k, place, gram) AS (VALUES {", ".join(rows)}), texts AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), grams AS (
  SELECT r, k, i - 1 AS pos, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT r, w, ks.k, unnest(range(1, len(w) - ks.k + 2)) AS i FROM texts, (VALUES (2), (3)) ks(k))
), hits AS (
  SELECT r, template, label, phrase, size, k, place, pos, pos - place AS diagonal FROM grams JOIN t USING (k, gram)
), diagonals AS (
  SELECT r, template, label, phrase, size, k, diagonal, min(pos) AS b, max(pos) + k AS e, list(DISTINCT place) AS places
  FROM hits GROUP BY r, template, label, phrase, size, k, diagonal
), marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal)
    <= CASE WHEN phrase THEN 0 ELSE {license_scan.DRIFT} END THEN 0 ELSE 1 END AS apart
  FROM diagonals
), numbered AS (
  SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM marked
), found AS (
  SELECT r, template, label, phrase, size, span, min(b) AS b, max(e) AS e, count(DISTINCT word) AS n
  FROM (SELECT *, p + unnest(range(k)) AS word FROM (SELECT *, unnest(places) AS p FROM numbered)) GROUP BY ALL
), judged AS (
  SELECT *, phrase AND n = size AS base,
    NOT phrase AND 100 * n >= {license_scan.SHARE} * size AND e - b <= {license_scan.STRETCH} * size AS notice
  FROM found
)
SELECT any_value(doc_id) AS doc_id, any_value(len(w))::BIGINT AS n_words, count(*) FILTER (base) AS n_base,
  min(b) FILTER (base) AS first_word, max(b) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR notice), '') AS labels,
  coalesce(max(n / size), 0)::DOUBLE AS score
FROM texts LEFT JOIN judged USING (r) GROUP BY r
"""


@R.add("op12_license_scan", _license_sql())
def license_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.templates(spark))


HARD_NEGATIVES_SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM whole a JOIN whole r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@R.add("op13_hard_negatives", HARD_NEGATIVES_SQL)
def mined_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved))
