"""The registered queries of the corpus operators, each beside its SQL where SQL can express it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import (
    bit_sliced,
    exact_dedup,
    hard_negatives,
    language_id,
    licenses,
    line_dedup,
    line_quality,
    ngram_join,
    packing,
    pieces,
    toxicity,
    url_models,
    vector_codes,
)
from assay.llm.common import saved, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


@query()
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return toxicity.scored(docs, labels, ~toxicity.held_out()).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query(
    r"""
    WITH l AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS spot FROM documents),
    k AS (
      SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    c AS (
      SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    d AS (SELECT k.*, coalesce(k.doc_id < c.last_id, false) AS gone FROM k LEFT JOIN c USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY spot) FILTER (NOT gone), '')) AS kept_sha256
    FROM d GROUP BY doc_id
    """
)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_common_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query()
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents")).drop("spans", "expressions")


@query()
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identified(docs, ~language_id.held_out()).withColumn("held_out", language_id.held_out())


@query(
    r"""
    WITH t AS (
      SELECT doc_id, length(coalesce(text, '')) AS points,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
    """
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_classes(table(spark, sf_dir, "documents"))


@query()
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


@query()
def op9_url_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_models.judged(table(spark, sf_dir, "pages"), whole=True)


@query(
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
      FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS query_id, b.vec_id,
             CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                 vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """
)
def op10_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_rows(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query(
    """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (
      SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
             CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
      FROM p JOIN s USING (anchor_id)
      WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
    """
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


@query()
def op12_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return line_quality.judged(docs, labels).drop("line_labels")


def vector_digests(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every coded row."""
    coded = vector_codes.fitted(rows)
    held = saved(coded.rows, "vector-codes")
    spelled = ",".join(str(x) for book in coded.books for entry in book for x in entry)
    totals = saved(
        held.groupBy(F.col("label").alias("of_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")),
        "label-errors",
    )  # small where labels are few, so that the planner's size check can send it to every task
    return held.join(totals, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id",
        F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "").alias("code"),
        "error",
        "label_error",
        F.lit(hashlib.sha256(spelled.encode()).hexdigest()).alias("codebooks_sha256"),
    )


def code_rounds(rounds: int, parts: int = 4) -> str:
    """SQL of the rounds: ``a<k>`` assigns parts to the entries ``e<k>``, which ``e<k + 1>`` replaces by their means."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
    a{k} AS MATERIALIZED (
      SELECT pos, part, min(d) AS d, CAST(min(d * 256 + entry) % 256 AS INTEGER) AS entry
      FROM (SELECT pos, p.part, entry, CAST(list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, e.x)
                   + list_inner_product(e.x, e.x) AS BIGINT) AS d
            FROM p JOIN e{k} e ON p.part = e.part) GROUP BY pos, part)""")
        if k < rounds:
            steps.append(f"""
    m{k} AS (
      SELECT part, entry, list(s ORDER BY i) AS x
      FROM (SELECT part, entry, i, floor(sum(x[i]) / count(*)) AS s
            FROM a{k} JOIN p USING (pos, part), w, unnest(range(1, w.width + 1)) AS u(i) GROUP BY part, entry, i)
      GROUP BY part, entry),
    e{k + 1} AS MATERIALIZED (
      SELECT e.part, e.entry, coalesce(m.x, e.x) AS x
      FROM e{k} e LEFT JOIN m{k} m ON e.part = m.part AND e.entry = m.entry)""")
    return ",".join(steps)


@query(
    f"""
    WITH v AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, vec_id, label,
             list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q
      FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    w AS (SELECT CAST(max(len(q)) // 4 AS BIGINT) AS width FROM v),
    p AS MATERIALIZED (
      SELECT pos, part, list_slice(q, part * width + 1, (part + 1) * width) AS x FROM v, w, unnest(range(4)) AS u(part)),
    e0 AS (SELECT part, pos AS entry, x FROM p WHERE pos < 256),{code_rounds(4)},
    r AS (SELECT pos, CAST(sum(d) AS BIGINT) AS error, string_agg(printf('%02x', entry), '' ORDER BY part) AS code
          FROM a4 GROUP BY pos),
    h AS (SELECT sha256(string_agg(CAST(CAST(x[i] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256
          FROM e4, w, unnest(range(1, w.width + 1)) AS u(i))
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM v JOIN r USING (pos), h
    """
)
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_digests(table(spark, sf_dir, "embeddings"))
