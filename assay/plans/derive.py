"""Judge-evaluation inputs derived from the given tables, in Spark and as SQL.

Each derived table exists twice: as a DataFrame plan and as a SQL common table
expression with the same columns, so that a query and its SQL twin read the same
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.identity import hash_unit
from assay.operators.joins import join_scored
from assay.operators.splits import assign_split
from assay.vocab import class_order, lit_array

JUDGES = (("a", 0.10), ("b", 0.25), ("c", 0.40))
# Unequal class offsets keep two classes of one row from tying.
BASE_WEIGHTS = {1: 0.051, 2: 0.052, 3: 0.053}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # part of the session contract: of equal JSON keys the last one counts
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def unit_sql(text: str) -> str:
    return f"(('0x'||substr(sha256({text}),1,16))::UBIGINT::DOUBLE/18446744073709551616.0)"


def split_sql(key: str, seed: int = 20260920) -> str:
    u = unit_sql(f"'{seed}:'||{key}")
    return (
        f"CASE WHEN {u} < 0.5 THEN 'train' WHEN {u} < 0.5+0.2 THEN 'dev' "
        f"WHEN {u} < 0.5+0.2+0.15 THEN 'calibration' ELSE 'test' END"
    )


# --- records -----------------------------------------------------------------


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Single records from labelled documents, pairwise records from parts."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    single = docs.select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("record_id"),
        F.lit("single").alias("mode"),
        F.col("source"),
        F.lit("Is this document well written?").alias("prompt"),
        F.col("text").alias("candidate_a"),
        F.lit(None).cast("string").alias("candidate_b"),
        F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("gold"),
        F.col("doc_id").alias("ordinal"),
    )
    la, lb = F.length("p_name"), F.length("p_type")
    pairwise = table(spark, sf, "part").select(
        F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("record_id"),
        F.lit("pairwise").alias("mode"),
        F.col("p_brand").alias("source"),
        F.lit("Which text is longer?").alias("prompt"),
        F.col("p_name").alias("candidate_a"),
        F.col("p_type").alias("candidate_b"),
        F.when(la > lb, "A").when(la < lb, "B").otherwise("TIE").alias("gold"),
        (F.col("p_partkey") + F.lit(1_000_000_000_000)).alias("ordinal"),
    )
    out = single.unionByName(pairwise).withColumn("source_problem_id", F.col("record_id"))
    return assign_split(out, "source_problem_id")


REC = f"""rec AS (
 SELECT *, {split_sql("record_id")} AS split, record_id AS source_problem_id FROM (
  SELECT 'doc:'||doc_id AS record_id, 'single' AS mode, source, 'Is this document well written?' AS prompt,
         text AS candidate_a, NULL AS candidate_b,
         CASE WHEN quality=1 THEN 'pass' ELSE 'fail' END AS gold, doc_id AS ordinal
  FROM documents JOIN labels USING (doc_id)
  UNION ALL
  SELECT 'part:'||p_partkey, 'pairwise', p_brand, 'Which text is longer?', p_name, p_type,
         CASE WHEN length(p_name)>length(p_type) THEN 'A' WHEN length(p_name)<length(p_type) THEN 'B' ELSE 'TIE' END,
         p_partkey+1000000000000
  FROM part))"""


# --- predictions -------------------------------------------------------------


def predictions(recs: DataFrame, seed: int = 42, judges=JUDGES) -> DataFrame:
    """Hash-driven judges of known skill; every outcome depends on its key alone."""

    def hashed(j: str, kind: str, *rest) -> Column:
        return hash_unit(seed, kind, F.lit(j), F.col("record_id"), *rest)

    def drawn(j: str, position: int) -> Column:
        return F.floor(hashed(j, "w", position) * 100) / 100

    def judge(j: str, skill: float) -> Column:
        third = F.when(F.col("mode") == "pairwise", drawn(j, 3))
        return F.struct(
            F.lit(j).alias("judge_id"), F.lit(skill).alias("skill"), drawn(j, 1).alias("_c1"), drawn(j, 2).alias("_c2"),
            third.alias("_c3"), hashed(j, "status").alias("_s"), hashed(j, "map").alias("_m"),
        )

    # rows of the generator: a condition on a label is not pushed below it, which would hash every term of it again
    base = recs.select("record_id", "mode", "gold", F.explode(F.array(*[judge(j, s) for j, s in judges])).alias("j"))
    base = base.select("record_id", "mode", "gold", "j.*")

    def u(kind: str) -> Column:
        return hash_unit(seed, kind, F.col("judge_id"), F.col("record_id"))

    def weight(position: int) -> Column:
        target = F.col("gold") == F.try_element_at(F.col("classes"), F.lit(position))
        return F.lit(BASE_WEIGHTS[position]) + F.col(f"_c{position}") + F.when(target, 2 * F.col("skill")).otherwise(0.0)

    base = base.withColumn("classes", class_order(F.col("mode")))
    base = base.withColumns({"_w1": weight(1), "_w2": weight(2)}).withColumn(
        "_w3", F.when(F.col("mode") == "pairwise", weight(3)).otherwise(0.0)
    )
    base = base.withColumn("_sum", F.col("_w1") + F.col("_w2") + F.col("_w3"))
    shares = F.slice(F.array(*[F.col(f"_w{i}") / F.col("_sum") for i in (1, 2, 3)]), 1, F.size("classes"))
    base = base.withColumns({"_p": shares, "_k": u("kind")})
    status = (
        F.when(F.col("_s") < 0.90, "ok")
        .when(F.col("_s") < 0.95, "rate_limited")
        .when(F.col("_s") < 0.97, "parse_error")
        .when(F.col("_s") < 0.99, "provider_error")
        .otherwise("skipped")
    )
    base = base.withColumn("execution_status", status)
    ok = F.col("execution_status") == "ok"
    kind = F.when(
        (F.col("execution_status") == "provider_error") & (F.col("_k") < 0.5), "timeout"
    ).when(F.col("execution_status") == "skipped", F.when(F.col("_k") < 0.5, "abstention").otherwise("context_limit"))
    tokens_in, tokens_out = F.floor(100 + u("in") * 400), F.floor(10 + u("out") * 50)
    usage = F.struct(
        tokens_in.cast("double").alias("input_tokens"),
        tokens_out.cast("double").alias("output_tokens"),
        (tokens_in * 0.00001 + tokens_out * 0.00003).alias("cost"),
    )
    return base.select(
        "judge_id",
        "record_id",
        F.lit("v1").alias("protocol_version"),
        F.when(ok, F.element_at("classes", F.array_position("_p", F.array_max("_p")).cast("int"))).alias("label"),
        F.when(ok & (F.col("_m") >= 0.05), F.map_from_arrays("classes", "_p")).alias("probabilities"),
        "execution_status",
        kind.alias("error_kind"),
        F.when(F.col("execution_status") != "skipped", 50 + 1000 * u("latency")).alias("latency_ms"),
        F.when(ok & (u("usage") >= 0.1), usage).alias("usage"),
    )


def pred_sql(name: str, seed: int, source: str = "rec") -> str:
    def u(kind: str, tail: str = "") -> str:
        return unit_sql(f"'{seed}:{kind}:'||judge_id||':'||record_id{tail}")

    def w(i: int) -> str:
        cls = f"CASE WHEN mode='single' THEN {['', repr('pass'), repr('fail'), 'NULL'][i]} ELSE '{'_ABT'[i]}{'IE' if i == 3 else ''}' END"
        return (
            f"({BASE_WEIGHTS[i]}::DOUBLE + floor({u('w', f'||{chr(39)}:{i}{chr(39)}')}*100)/100 + "
            f"CASE WHEN gold={cls} THEN 2*skill ELSE 0.0::DOUBLE END)"
        )

    return f"""{name}_w AS (
 SELECT record_id, mode, gold, judge_id, {w(1)} AS w1, {w(2)} AS w2,
        CASE WHEN mode='pairwise' THEN {w(3)} ELSE 0.0::DOUBLE END AS w3,
        {u('status')} AS s, {u('kind')} AS k, {u('map')} AS um, {u('latency')} AS ul, {u('usage')} AS uu,
        floor(100+{u('in')}*400) AS ti, floor(10+{u('out')}*50) AS tou
 FROM {source} CROSS JOIN (VALUES ('a',0.10::DOUBLE),('b',0.25::DOUBLE),('c',0.40::DOUBLE)) jj(judge_id,skill)),
{name}_p AS (SELECT *, w1/(w1+w2+w3) AS q1, w2/(w1+w2+w3) AS q2, w3/(w1+w2+w3) AS q3,
  CASE WHEN s<0.90 THEN 'ok' WHEN s<0.95 THEN 'rate_limited' WHEN s<0.97 THEN 'parse_error'
       WHEN s<0.99 THEN 'provider_error' ELSE 'skipped' END AS execution_status FROM {name}_w),
{name} AS (SELECT judge_id, record_id, execution_status,
  CASE WHEN execution_status='ok' THEN
    CASE WHEN mode='single' THEN CASE WHEN q1>=q2 THEN 'pass' ELSE 'fail' END
         WHEN q1>=q2 AND q1>=q3 THEN 'A' WHEN q2>=q3 THEN 'B' ELSE 'TIE' END END AS label,
  execution_status='ok' AND um>=0.05 AS has_p,
  CASE WHEN execution_status='ok' AND um>=0.05 THEN q1 END AS p1,
  CASE WHEN execution_status='ok' AND um>=0.05 THEN q2 END AS p2,
  CASE WHEN execution_status='ok' AND um>=0.05 AND mode='pairwise' THEN q3 END AS p3,
  CASE WHEN execution_status='provider_error' AND k<0.5 THEN 'timeout'
       WHEN execution_status='skipped' THEN CASE WHEN k<0.5 THEN 'abstention' ELSE 'context_limit' END END AS error_kind,
  CASE WHEN execution_status<>'skipped' THEN 50+1000*ul END AS latency_ms,
  execution_status='ok' AND uu>=0.1 AS has_usage, ti::DOUBLE AS ti, tou::DOUBLE AS tou FROM {name}_p)"""


PRED = pred_sql("pred", 42)
PRED_RETRY = pred_sql("redo", 43)

SCORED = """sc AS (
 SELECT r.record_id, r.mode, r.source, r.gold, r.ordinal, r.split, r.source_problem_id,
  p.* EXCLUDE (record_id),
  (p.execution_status='ok' AND p.label IS NOT NULL)::INT AS resolved,
  (p.execution_status='ok' AND p.label IS NOT NULL AND p.label=r.gold)::INT AS correct,
  CASE WHEN p.has_p THEN greatest(p1,p2,coalesce(p3,0.0)) END AS conf
 FROM rec r JOIN pred p USING (record_id))"""

SLICED = """sl AS (
 SELECT *, 'overall' AS slice, 'all' AS slice_value FROM sc
 UNION ALL SELECT *, 'mode', mode FROM sc UNION ALL SELECT *, 'source', source FROM sc)"""


def scored_with(*more: str) -> str:
    """WITH clause up to the scored table, plus further expressions."""
    return "WITH " + ",\n".join([REC, PRED, SCORED, *more])


def bare_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records without their texts."""
    return records(spark, sf).drop("prompt", "candidate_a", "candidate_b")


def spread(recs: DataFrame) -> DataFrame:
    """Records dealt to all tasks by their key.

    The tables are small files of few row groups, but a record is dozens of hashes once
    the judges are derived, so that work must not stay in the tasks that scan. A join by
    the key needs no other exchange.
    """
    return recs.repartition(int(recs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "record_id")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Every record x judge row with ``resolved`` and ``correct``.

    The judges are derived from the records, so the key join of real prediction
    files is kept here as well.
    """
    recs = spread(bare_records(spark, sf))
    return join_scored(recs, predictions(recs))


def slices() -> dict[str, Column]:
    return {"mode": F.col("mode"), "source": F.col("source")}


def labels_of(judges=JUDGES) -> Column:
    return lit_array([j for j, _ in judges])


# --- responses ----------------------------------------------------------------


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Free-form provider answers stating the derived labels in four styles."""
    rows = scored(spark, sf).select(
        "record_id", "judge_id", "mode", F.coalesce("label", F.lit("none")).alias("said")
    )
    rows = rows.withColumn("style", F.floor(hash_unit(42, "style", F.col("judge_id"), F.col("record_id")) * 4).cast("int"))
    said, style = F.col("said"), F.col("style")
    text = (
        F.when(style == 0, F.concat(F.lit('{"label": "'), F.upper(said), F.lit('"}')))
        .when(
            style == 1,
            F.concat(
                F.lit('note {"result": {"verdict": {"choice": "'), said, F.lit('"}}, "model": "m-'), "judge_id", F.lit('"} end')
            ),
        )
        .when(style == 2, F.concat(F.lit("I thought fail or B first; LABEL: "), said, F.lit(" it is.")))
        .otherwise(F.concat(F.lit('{"label": "maybe"} {"value": "'), said, F.lit('"')))
    )
    return rows.withColumn("text", text)


RESP = f"""rp0 AS (SELECT record_id, judge_id, mode, coalesce(label,'none') AS said,
  floor({unit_sql("'42:style:'||judge_id||':'||record_id")}*4)::INT AS style FROM sc),
rp AS (SELECT *, CASE style WHEN 0 THEN '{{"label": "'||upper(said)||'"}}'
  WHEN 1 THEN 'note {{"result": {{"verdict": {{"choice": "'||said||'"}}}}, "model": "m-'||judge_id||'"}} end'
  WHEN 2 THEN 'I thought fail or B first; LABEL: '||said||' it is.'
  ELSE '{{"label": "maybe"}} {{"value": "'||said||'"' END AS text FROM rp0)"""
