"""Queries of the seeded splits, samples and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions.identity import case_key, content_id, hash_unit
from assay.operators import identity as I
from assay.operators import splits as S
from assay.plans import derive as D
from assay.plans.metrics import rounded
from assay.plans.registry import query

SEED = 7


def rank_sql(*parts: str) -> str:
    return "sha256(" + "||':'||".join(parts) + ")"


@query("SPL1", f"SELECT o_orderkey, round({D.unit_sql(chr(39) + '7:orders:' + chr(39) + '||o_orderkey')},12) AS u FROM orders")
def unit_interval_hash(spark, sf):
    return D.table(spark, sf, "orders").select(
        "o_orderkey", F.round(hash_unit(SEED, "orders", F.col("o_orderkey")), 12).alias("u")
    )


@query("SPL2", f"SELECT o_orderkey, {D.split_sql('o_orderkey')} AS split FROM orders")
def weighted_split(spark, sf):
    return S.assign_split(D.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


_CASE_KEY = r"substr(sha256(trim(regexp_replace(text,'[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+',' ','g'),' ')),1,16)"


@query(
    "SPL3",
    f"""SELECT 'registry' AS layout, c_name AS id, CASE WHEN {D.unit_sql("'7:registry:'||upper(trim(c_name))")}<0.5 THEN 'calibration' ELSE 'test' END AS split FROM customer
 UNION ALL SELECT 'citation', p_partkey::VARCHAR, CASE WHEN {D.unit_sql("'7:citations:split:'||p_partkey")}<0.5 THEN 'dev' ELSE 'test' END FROM part
 UNION ALL SELECT 'case', doc_id::VARCHAR, CASE WHEN {D.unit_sql("'7:tasks:prose:'||" + _CASE_KEY)}<0.5 THEN 'calibration' ELSE 'test' END FROM documents""",
)
def two_way_splits(spark, sf):
    c, p, d = (D.table(spark, sf, t) for t in ("customer", "part", "documents"))
    return (
        c.select(F.lit("registry").alias("layout"), F.col("c_name").alias("id"), S.entity_split(F.col("c_name"), SEED, "registry").alias("split"))
        .unionByName(
            p.select(
                F.lit("citation").alias("layout"),
                F.col("p_partkey").cast("string").alias("id"),
                S.source_split(F.col("p_partkey"), SEED, "citations").alias("split"),
            )
        )
        .unionByName(
            d.select(
                F.lit("case").alias("layout"),
                F.col("doc_id").cast("string").alias("id"),
                S.case_split(F.col("text"), "prose", SEED, "tasks").alias("split"),
            )
        )
    )


@query(
    "SPL4",
    f"""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'test' ELSE
 CASE WHEN {D.unit_sql("'20260920:'||o_orderkey||':validation'")}<0.5 THEN 'dev' ELSE 'calibration' END END AS split FROM orders""",
)
def upstream_split_map(spark, sf):
    o = D.table(spark, sf, "orders")
    upstream = (
        F.when(F.col("o_orderstatus") == "F", "TRAIN").when(F.col("o_orderstatus") == "O", "testing").otherwise("Valid")
    )
    return o.select("o_orderkey", S.map_upstream_split(upstream, F.col("o_orderkey")).alias("split"))


@query(
    "SPL5",
    f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {rank_sql("'7'", "'tasks'", "o_orderkey")}, o_orderkey) AS pos, count(*) OVER () AS n FROM orders)
 SELECT o_orderkey, CASE WHEN pos<=floor(n*0.2::DOUBLE) THEN 'dev' WHEN pos<=floor(n*0.2::DOUBLE)+floor(n*0.2::DOUBLE) THEN 'calibration' ELSE 'test' END AS split FROM r""",
)
def exact_count_split(spark, sf):
    return S.rank_split(D.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", SEED, "tasks")


@query(
    "SPL6",
    f"""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {rank_sql("'7'", "'docs'", "doc_id")}, doc_id) AS rn
 FROM (SELECT DISTINCT source, doc_id FROM documents)) WHERE rn<=5""",
)
def stable_sample_per_source(spark, sf):
    return S.stable_sample(D.table(spark, sf, "documents"), "doc_id", SEED, "docs", 5, ["source"]).select("source", "doc_id")


@query(
    "SPL7",
    f"""SELECT o_custkey, hash_rank FROM (SELECT DISTINCT o_custkey, {rank_sql("'7'", "'buyers'", "o_custkey")} AS hash_rank FROM orders
 WHERE {D.unit_sql("'7:buyers:'||o_custkey")}<0.3) ORDER BY hash_rank, o_custkey LIMIT 40""",
)
def threshold_sample(spark, sf):
    rows = D.table(spark, sf, "orders").select("o_custkey")
    return S.bernoulli_top(rows, "o_custkey", SEED, "buyers", 0.3, 40, required=False)


_LINKS = rank_sql("'7'", "'links'", "l_orderkey", "l_linenumber")


@query(
    "SPL8",
    f"""WITH f AS (SELECT l_partkey, l_orderkey, l_linenumber, {_LINKS} AS hash_rank FROM lineitem),
 k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY hash_rank, l_orderkey, l_linenumber) AS rn FROM f)
 SELECT l_partkey, l_orderkey, l_linenumber, hash_rank FROM k WHERE rn=1 ORDER BY hash_rank, l_orderkey, l_linenumber LIMIT 200""",
)
def first_link_per_part(spark, sf):
    li = D.table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return S.first_per_key(li, "l_partkey", SEED, "links", ["l_orderkey", "l_linenumber"], 200)


@query(
    "SPL9",
    "WITH "
    + D.REC
    + """ SELECT mode, record_id, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY ordinal) AS rn FROM rec) WHERE rn<=50""",
)
def first_rows_per_mode(spark, sf):
    return S.first_n_per_group(D.bare_records(spark, sf), "mode", 50, "ordinal").select("mode", "record_id", "ordinal")


@query(
    "SPL10",
    f"SELECT doc_id FROM (SELECT DISTINCT doc_id FROM documents) ORDER BY {rank_sql(chr(39) + '7' + chr(39), chr(39) + 'matched-control' + chr(39), 'doc_id')}, doc_id LIMIT 60",
)
def matched_control_sample(spark, sf):
    return S.matched_control(D.table(spark, sf, "documents"), "doc_id", 60, SEED)


def _sched(kind: str, where: str, index: str) -> str:
    return f"""SELECT '{kind}' AS kind, record_id, {index} AS repeat_index FROM (SELECT record_id FROM rec {where}
 ORDER BY {rank_sql("'7'", f"'{kind}'", "record_id")}, record_id LIMIT 12)"""


@query(
    "SPL11",
    "WITH "
    + D.REC
    + " "
    + _sched("repeat", "", "unnest([0,1,2])::INT")
    + " UNION ALL "
    + _sched("option_order", "WHERE mode='single'", "NULL::INT")
    + " UNION ALL "
    + _sched("rubric_paraphrase", "", "NULL::INT"),
)
def perturbation_schedule(spark, sf):
    return S.perturbation_schedule(D.bare_records(spark, sf), SEED)


@query(
    "SPL12",
    "WITH " + D.REC + " SELECT record_id, CASE WHEN split='test' THEN 'final_evaluation' ELSE 'threshold_selection' END AS partition FROM rec",
)
def threshold_partition(spark, sf):
    return S.partition_records(D.bare_records(spark, sf)).select("record_id", "partition")


@query(
    "IDN1",
    """SELECT l_orderkey, l_linenumber, sha256('{"line":'||l_linenumber||',"order":'||l_orderkey||',"part":"'||l_partkey||'"}') AS record_id FROM lineitem""",
)
def content_record_ids(spark, sf):
    return D.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        content_id(
            {"order": F.col("l_orderkey"), "line": F.col("l_linenumber"), "part": F.col("l_partkey").cast("string")}
        ).alias("record_id"),
    )


@query("IDN2", f"SELECT doc_id, {_CASE_KEY} AS case_key FROM documents")
def case_keys(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", case_key(F.col("text")).alias("case_key"))


def _lane(i: int) -> str:
    return f"sum(('0x'||substr(h,{1 + 16 * i},16))::UBIGINT::HUGEINT)::VARCHAR"


@query(
    "IDN3",
    f"""SELECT o_orderstatus, count(*) AS rows, sha256(count(*)||':'||{"||':'||".join(_lane(i) for i in range(4))}) AS fingerprint FROM (
 SELECT o_orderstatus, sha256('{{"o_custkey":'||o_custkey||',"o_orderkey":'||o_orderkey||',"o_orderpriority":"'||o_orderpriority||'"}}') AS h FROM orders) GROUP BY o_orderstatus""",
)
def table_fingerprint(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", "o_custkey", "o_orderpriority")
    return I.fingerprint(o, ["o_orderstatus"])
