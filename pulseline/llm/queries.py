"""The operators as named queries over the test tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.llm import (
    ann,
    html_text,
    imatch,
    language_id,
    merkle,
    mixing,
    near_dedup,
    negatives,
    packing,
    quality,
    secret_scan,
    token_counts,
    toxicity,
)
from pulseline.llm.common import table, work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, TOKENIZER, work_dir(spark, "token-cache"))


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_counts(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(table(spark, sf_dir, "documents"))


@query
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    # The labels of this task: every seventh row has the next one.
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", label)
    return negatives.hard_negatives(rows, rows.filter(F.col("vec_id") % 100 == 0))


@query
def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


# SQL twins. The other operators learn models or follow a tokenizer, which SQL cannot express;
# tests/llm holds those against plain versions, round trips and held-out labels.

ORACLE["op3_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    len(regexp_extract_all(coalesce(text, ''), '\p{L}{2,}')) AS runs,
    ('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT AS bits
  FROM documents),
keyed AS (
  SELECT doc_id, source, size, -ln((bits + 0.5) / 4503599627370496.0)
    / greatest(0.1, least(1.0, runs / greatest(size, 1))) AS key FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w
  FROM keyed GROUP BY source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER fill AS place,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER (
       ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST
       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources WINDOW fill AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST)),
final AS (SELECT arg_min(level, place) AS level FROM levels WHERE cap > w * level),
targets AS (
  SELECT source, source_size, CASE WHEN final.level IS NOT NULL AND cap > w * final.level
    THEN w * final.level ELSE cap END AS target FROM levels LEFT JOIN final ON true),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
summed AS (
  SELECT k.doc_id, k.size, s.source_size, s.target, s.epochs,
    CAST(round(s.target - s.epochs * s.source_size) AS BIGINT) AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM keyed k JOIN shares s ON k.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM summed
"""

ORACLE["op4_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2
    THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b
    ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 100 >= 80 * b.n AND b.n * 100 >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS label FROM documents
  UNION SELECT s.y, r.label FROM reach r JOIN sides s ON s.x = r.doc_id),
components AS (SELECT doc_id, min(label) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN components USING (doc_id)
"""


def _merkle_sql(levels: int = 7, top_levels: int = 4) -> str:
    """The manifest level by level: 8^levels rows of a language and 8^top_levels languages at most."""
    value = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    row = [value.format(c) for c in ("doc_id", "source", "lang", "n_chars")]
    original = " || ".join([*row, value.format("text")])
    lowered = " || ".join([*row, value.format(low)])
    parts = [
        # crc32 bit by bit: a byte is mixed in, eight steps follow.
        "steps AS (SELECT DISTINCT doc_id AS key, flatten(list_transform(string_split(doc_id::VARCHAR, ''), "
        "lambda c: list_concat([ascii(c)::BIGINT], repeat([-1::BIGINT], 8)))) AS s FROM documents)",
        "marked AS (SELECT key, xor(list_reduce(list_concat([4294967295], s), lambda c, x: CASE WHEN x >= 0 "
        "THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 3 = 0 AS yes FROM steps)",
        f"leaves AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256({original}) AS leaf, "
        f"CASE WHEN yes AND text IS NOT NULL THEN sha256({lowered}) END AS changed "
        "FROM documents LEFT JOIN marked ON doc_id = key)",
        "w0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, "
        "count(*) OVER (PARTITION BY tree) AS n, '' AS proof, coalesce(changed, leaf) AS t FROM leaves)",
        "n0 AS (SELECT tree, i, n, leaf AS d FROM w0)",
    ]
    up = (
        "n{b} AS (SELECT tree, i // 8 AS i, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN "
        "sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d, list(d ORDER BY i) AS ds FROM n{a} "
        "GROUP BY tree, i // 8, n)"
    )
    step = (
        "w{b} AS (SELECT w.* REPLACE (w.i // 8 AS i, (w.n + 7) // 8 AS n, proof || lft || rgt AS proof, "
        "CASE WHEN w.n > 1 THEN sha256(lft || t || rgt) ELSE t END AS t) FROM (SELECT w.*, "
        "array_to_string(r.ds[1 : w.i % 8], '') AS lft, array_to_string(r.ds[w.i % 8 + 2 : 8], '') AS rgt "
        "FROM w{a} w JOIN n{b} r ON w.{tree} = r.tree AND w.i // 8 = r.i) w)"
    )
    for k in range(levels):
        parts += [up.format(a=k, b=k + 1), step.format(a=k, b=k + 1, tree="tree")]
    a = levels + 1
    parts += [
        f"n{a} AS (SELECT '' AS tree, tree AS sub, row_number() OVER (ORDER BY tree) - 1 AS i, "
        f"count(*) OVER () AS n, d FROM n{levels})",
        f"w{a} AS (SELECT w.* EXCLUDE (i, n), s.i, s.n, s.d AS subroot, '' AS top "
        f"FROM w{levels} w JOIN n{a} s ON w.tree = s.sub)",
    ]
    for k in range(a, a + top_levels):
        parts += [up.format(a=k, b=k + 1), step.format(a=k, b=k + 1, tree="top")]
    z = a + top_levels
    drop = "SELECT w.* EXCLUDE (lft, rgt) REPLACE"
    parts = [p.replace("SELECT w.* REPLACE", drop) for p in parts]
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, n{z}.d AS root, "
        f"sha256(proof) AS proof_sha256, t AS folded_root, t = n{z}.d AS verified FROM w{z} JOIN n{z} ON true"
    )


ORACLE["op11_merkle"] = _merkle_sql()

ORACLE["op12_negatives"] = r"""
WITH scaled AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM scaled a JOIN scaled b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""
