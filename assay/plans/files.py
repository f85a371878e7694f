"""Round trips through the file sources and sinks, over data derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assay.operators import exports as E
from assay.operators import identity as I
from assay.operators import metrics as M
from assay.plans import derive as D
from assay.plans.metrics import KEYS, rounded, sliced
from assay.plans.records import entities
from assay.plans.registry import query
from assay.plans.retrieval import corpus, edges
from assay.plans.routing import _SUMS, _obs
from assay.session import ensure_checkpoint_dir
from assay.sources import readers as S
from assay.sources import writers as K


def scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


_PRED_SQL = (
    D.scored_with()
    + """ SELECT judge_id, record_id, label, execution_status, error_kind, round(latency_ms,6) AS latency_ms, round(CASE WHEN has_p THEN p1 END,9) AS p_first FROM sc"""
)


@query("SRC1 SNK1", _PRED_SQL)
def prediction_lines(spark, sf):
    """Half of the rows are written flat, half in an envelope; both come back alike."""
    recs = D.spread(D.bare_records(spark, sf))
    rows = D.predictions(recs).withColumn("error", F.when(F.col("error_kind").isNotNull(), F.struct(F.col("error_kind").alias("kind"))))
    fields = ["record_id", "judge_id", "protocol_version", "label", "probabilities", "execution_status", "latency_ms", "error"]
    base = scratch(spark)
    flat = rows.filter("judge_id <> 'b'").select(F.concat_ws("|", "judge_id", "record_id").alias("row_id"), *fields)
    boxed = rows.filter("judge_id = 'b'").select("record_id", F.struct(*fields).alias("prediction"))
    K.write_jsonl(flat, f"{base}/flat", "row_id")
    K.write_jsonl(boxed, f"{base}/boxed", "record_id")
    back = S.read_predictions(spark, [f"{base}/flat", f"{base}/boxed"])
    first = F.when(F.startswith("record_id", F.lit("doc:")), "pass").otherwise("A")
    return rounded(
        back.select(
            "judge_id", "record_id", "label", "execution_status", "error_kind",
            F.round("latency_ms", 6).alias("latency_ms"), F.col("probabilities")[first].alias("p_first"),
        )
    )


ALIASES = {
    "lei": ("LEI", "lei_code"),
    "legal_name": ("Entity.LegalName", "name"),
    "entity_category": ("Entity.Category", "category"),
    "legal_jurisdiction": ("Entity.Jurisdiction",),
}


@query(
    "SRC2",
    """SELECT 'LEI'||lpad(c_custkey::VARCHAR,17,'0') AS lei, c_name||', "Ltd"' AS legal_name, c_mktsegment AS entity_category, n_name AS legal_jurisdiction
 FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE c_mktsegment<>'BUILDING'""",
)
def registry_file(spark, sf):
    e = entities(spark, sf)
    lei = F.when(F.col("entity_category") == "BUILDING", F.concat("lei", F.lit("-X"))).otherwise(F.col("lei"))
    path = f"{scratch(spark)}/registry"
    e.select(
        F.col("legal_jurisdiction").alias("Entity.Jurisdiction"),
        lei.alias("lei_code"),
        F.concat("legal_name", F.lit(', "Ltd"')).alias("name"),
        F.col("entity_category").alias("Entity.Category"),
    ).write.option("header", True).option("escape", '"').csv(path)
    return S.read_registry_csv(spark, path, ALIASES)


@query("SRC3", "SELECT conv_id::VARCHAR AS index, CASE role WHEN 'user' THEN 'Yes' ELSE 'No' END AS answer, text, turn::VARCHAR AS slice FROM conversations")
def task_file(spark, sf):
    c = D.table(spark, sf, "conversations")
    path = f"{scratch(spark)}/tasks"
    c.select(
        F.col("conv_id").alias("index"), F.when(F.col("role") == "user", "Yes").otherwise("No").alias("answer"), "text", F.col("turn").alias("slice")
    ).write.option("header", True).option("sep", "\t").option("escape", '"').option("quoteAll", True).csv(path)
    return S.read_tsv(spark, path, ["index", "answer", "text", "slice"])


@query(
    "SRC4",
    """SELECT 'p'||lpad(p_partkey::VARCHAR,9,'0') AS entry_cid, p_type AS citation, '' AS family, p_name AS title, '' AS section_id,
 p_type||' '||p_brand AS text, p_name||chr(10)||p_type||' '||p_brand AS body FROM part""",
)
def corpus_file(spark, sf):
    path = f"{scratch(spark)}/corpus"
    corpus(spark, sf).withColumn("family", F.lit(None).cast("string")).write.parquet(path)
    return S.read_corpus(spark, path)


@query(
    "SRC5",
    """SELECT DISTINCT 'p'||lpad(a.l_partkey::VARCHAR,9,'0') AS source, 'p'||lpad(b.l_partkey::VARCHAR,9,'0') AS target FROM lineitem a JOIN lineitem b
 ON a.l_orderkey=b.l_orderkey AND b.l_linenumber=a.l_linenumber+1 WHERE a.l_partkey<>b.l_partkey""",
)
def graph_shards(spark, sf):
    path = f"{scratch(spark)}/graph"
    edges(spark, sf).withColumn("relation", F.lit("references_authority")).write.parquet(path)
    return S.read_graph(spark, path, ["source", "target"])


ORDERS_A_DOCUMENT = 500


@query(
    "SRC6",
    f"""WITH b AS (SELECT o_orderkey % (SELECT count(*) // {ORDERS_A_DOCUMENT} + 1 FROM orders) AS bucket, o_orderkey, o_orderstatus FROM orders)
    SELECT bucket::VARCHAR AS folder, bucket % 5 < 3 AS readable, CASE WHEN bucket % 5 < 3 THEN count(*) END AS documents,
      CASE WHEN bucket % 5 < 3 THEN min(o_orderkey) END AS first_key, CASE WHEN bucket % 5 < 3 THEN arg_min(o_orderstatus, o_orderkey) END AS first_status
    FROM b GROUP BY bucket""",
)
def result_tree(spark, sf):
    """A document per bucket of orders, so the tree grows with the table; two of five are cut off or no object and read as null."""
    o = D.table(spark, sf, "orders")
    path = f"{scratch(spark)}/tree"
    buckets = o.count() // ORDERS_A_DOCUMENT + 1
    rows = o.select((F.col("o_orderkey") % buckets).alias("bucket"), F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("row"))
    docs = rows.groupBy("bucket").agg(F.array_sort(F.collect_list("row")).alias("orders"))  # a bucket holds about ORDERS_A_DOCUMENT rows
    whole = F.to_json(F.struct(F.size("orders").alias("documents"), "orders"))
    kind = F.col("bucket") % 5
    value = F.when(kind == 3, F.substring(whole, 1, 40)).when(kind == 4, F.to_json("orders")).otherwise(whole)
    docs.select(F.col("bucket").alias("folder"), value.alias("value")).write.partitionBy("folder").text(path)
    tree = S.read_result_tree(spark, path, "part-*")

    def field(at: str, kind: str):
        return F.try_variant_get("doc", at, kind)

    return tree.select(
        F.regexp_extract("path", "folder=([^/]*)/", 1).alias("folder"),
        F.col("doc").isNotNull().alias("readable"),
        field("$.documents", "bigint").alias("documents"),
        field("$.orders[0].key", "bigint").alias("first_key"),
        field("$.orders[0].status", "string").alias("first_status"),
    )


@query(
    "SNK2 EXP1",
    D.scored_with(D.SLICED, _SUMS)
    + " "
    + " UNION ALL ".join(
        [
            _obs("all_record_accuracy", "correct", "records"),
            _obs("conditional_accuracy", "correct", "resolved"),
            _obs("coverage", "resolved", "records"),
        ]
    ),
)
def exported_observations(spark, sf):
    path = f"{scratch(spark)}/observations"
    K.write_observations(E.observations(M.judge_summary(sliced(spark, sf), KEYS)), path)
    return rounded(spark.read.parquet(path))


# Files of a hundred documents each, with both kinds of line ends.
_FILES = """f AS (SELECT 'bucket='||(doc_id // 100) AS file, doc_id // 100 AS bucket,
  sha256(replace(string_agg(coalesce(text, ''), chr(13)||chr(10) ORDER BY doc_id)||chr(10), chr(13)||chr(10), chr(10))) AS sha256 FROM documents GROUP BY ALL)"""


def document_files(spark, sf):
    """Write all documents as text files of a hundred each and digest them; a file is named by its folder."""
    path = f"{scratch(spark)}/set"
    docs = D.table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 100).alias("bucket"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("l"))  # a hundred each
    rows.select("bucket", F.array_join(F.col("l.text"), "\r\n").alias("value")).repartition("bucket").write.partitionBy("bucket").text(path)
    digests = I.file_digests(spark, path, "part-*")
    return digests.select(F.regexp_extract("file", "^(bucket=[0-9]+)/", 1).alias("file"), "sha256")


@query("IDN4", f"WITH {_FILES} SELECT file, sha256, (SELECT count(*) FROM f) AS files FROM f")
def file_set_digests(spark, sf):
    """Digest of every file with line ends made alike, and how many files the revision covers."""
    digests = document_files(spark, sf)
    revision = I.content_revision(digests)
    return digests.withColumn("files", revision.select("files").scalar())


@query(
    "IDN5",
    f"""WITH {_FILES} SELECT 'manifest' AS rule, file AS key, 'checksum mismatch' AS detail FROM f WHERE bucket % 3 = 1
 UNION ALL SELECT 'manifest', 'gone-'||bucket, 'missing file' FROM f WHERE bucket % 2 = 0""",
)
def file_set_findings(spark, sf):
    """A written manifest of the files: a third of the sums are wrong, and it names files that are not there."""
    digests = document_files(spark, sf)
    bucket = F.regexp_extract("file", "=([0-9]+)$", 1).cast("long")
    wrong = F.lit("0" * 64)
    lines = digests.select(F.concat(F.when(bucket % 3 == 1, wrong).otherwise(F.col("sha256")), F.lit("  "), "file").alias("value"))
    gone = digests.where(bucket % 2 == 0).select(F.concat(wrong, F.lit("  gone-"), bucket.cast("string")).alias("value"))
    path = f"{scratch(spark)}/sums"
    lines.unionByName(gone).write.text(path)
    return I.verify_manifest(I.read_manifest(spark, path), digests)
