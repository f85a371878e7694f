"""Queries that build judge records from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions.identity import content_id
from assay.operators import metrics as M
from assay.operators import ranking as R
from assay.operators import records as G
from assay.plans import derive as D
from assay.plans.registry import query

SEED = 20260920


def questions(spark, sf):
    """One four-choice question per part; the choices are rotated by the part size."""
    p = D.table(spark, sf, "part")
    base = F.array("p_brand", "p_type", "p_name", F.concat(F.lit("size "), "p_size"))
    r = F.pmod(F.col("p_size"), F.lit(4))
    texts = F.concat(F.slice(base, r + 1, 4 - r), F.slice(base, F.lit(1), r))
    upstream = F.when(F.col("p_type") == "ECONOMY", "train").when(F.col("p_type") == "SMALL", "test").otherwise("validation")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.concat(F.lit("What is the brand of part "), "p_partkey", F.lit("?")).alias("question"),
        texts.alias("choices"),
        F.pmod(4 - r, F.lit(4)).cast("string").alias("answer_key"),
        upstream.alias("upstream_split"),
    )


_UPSTREAM = f"""CASE p_type WHEN 'ECONOMY' THEN 'train' WHEN 'SMALL' THEN 'test' ELSE
 CASE WHEN {D.unit_sql("'20260920:'||p_partkey||':validation'")}<0.5 THEN 'dev' ELSE 'calibration' END END"""
_QS = f"""q0 AS (SELECT p_partkey::VARCHAR AS id, (p_size%4)::INT AS r, [p_brand,p_type,p_name,'size '||p_size] AS base, {_UPSTREAM} AS split FROM part),
 q1 AS (SELECT id, split, list_concat(base[r+1:4],base[1:r]) AS texts, (4-r)%4 AS ai FROM q0),
 q2 AS (SELECT *, substr('ABCD',ai+1,1) AS al, list_filter(['A','B','C','D'], lambda x: x<>substr('ABCD',ai+1,1)) AS wl,
  'Question: What is the brand of part '||id||'?'||chr(10)||'Choices:'||chr(10)||'A) '||texts[1]||chr(10)||'B) '||texts[2]||chr(10)||'C) '||texts[3]||chr(10)||'D) '||texts[4] AS prompt FROM q1)"""


@query("GEN1", f"WITH {_QS} SELECT id, 'A,B,C,D' AS labels, array_to_string(texts,'|') AS texts, al AS answer_label FROM q2")
def choice_lists(spark, sf):
    return G.normalize_choices(questions(spark, sf)).select(
        "id", F.array_join("labels", ",").alias("labels"), F.array_join("texts", "|").alias("texts"), "answer_label"
    )


_PAIR = """q3 AS (SELECT *, wl[((('0x'||substr(sha256('20260920:'||id||':wrong'),1,16))::UBIGINT%3)+1)::INT] AS w,
  ('0x'||substr(sha256('20260920:'||id||':order'),1,2))::INT%2=0 AS first FROM q2),
 q4 AS (SELECT *, al||') '||texts[ai+1] AS good, w||') '||texts[ascii(w)-64] AS poor FROM q3)"""


@query(
    "GEN2",
    f"""WITH {_QS}, {_PAIR} SELECT 'arc-pair:'||id AS record_id, prompt, CASE WHEN first THEN good ELSE poor END AS candidate_a,
 CASE WHEN first THEN poor ELSE good END AS candidate_b, CASE WHEN first THEN 'A' ELSE 'B' END AS gold, split, w AS wrong_label FROM q4""",
)
def pairwise_question_records(spark, sf):
    _, records = G.pairwise_records(G.normalize_choices(questions(spark, sf)), SEED)
    return records.select("record_id", "prompt", "candidate_a", "candidate_b", "gold", "split", "wrong_label")


@query(
    "GEN2",
    f"WITH {_QS} SELECT 'arc:'||id AS source_id, split, al AS answer_key, texts[ai+1] AS answer_text FROM q2",
)
def question_sources(spark, sf):
    sources, _ = G.pairwise_records(G.normalize_choices(questions(spark, sf)), SEED)
    return sources.select("source_id", "split", "answer_key", "answer_text")


def _variants_sql(record: str, right: str, wrong: str, table: str, extra: str = "") -> str:
    return f"""SELECT {record}||':correct' AS record_id, {right} AS candidate_a, 'pass' AS gold, split{extra} FROM {table}
 UNION ALL SELECT {record}||':wrong', {wrong}, 'fail', split{extra} FROM {table}"""


SHOWN = ["record_id", "candidate_a", "gold", "split"]


@query(
    "GEN3",
    f"WITH {_QS} "
    + _variants_sql("'arc-single:'||id", "al||') '||texts[ai+1]", "wl[1]||') '||texts[ascii(wl[1])-64]", "q2"),
)
def first_wrong_pairs(spark, sf):
    return G.single_pair(G.normalize_choices(questions(spark, sf)), SEED).select(*SHOWN)


@query(
    "GEN4",
    f"WITH {_QS} "
    + _variants_sql(
        "'mmlu:'||id",
        "'Answer: '||al||') '||texts[ai+1]",
        "'Answer: '||substr('ABCD',(ai+1)%4+1,1)||') '||texts[(ai+1)%4+1]",
        "q2",
    ),
)
def next_choice_pairs(spark, sf):
    rows = G.normalize_choices(questions(spark, sf))
    split = G.map_upstream_split(F.col("upstream_split"), F.col("id"), SEED)
    rows = rows.select(
        F.col("id").alias("source_problem_id"), "question", "choices", F.col("answer_key").cast("int").alias("answer_index"), split.alias("split")
    )
    return G.choice_pair(rows, "mmlu").select(*SHOWN)


_NUM = r"regexp_replace(regexp_replace(o_totalprice::DECIMAL(18,2)::VARCHAR,'(\.[0-9]*?)0+$','\1'),'\.$','')"
_NUM1 = _NUM.replace("o_totalprice::DECIMAL(18,2)", "(o_totalprice::DECIMAL(18,2)+1)")


@query(
    "GEN5",
    f"WITH n AS (SELECT o_orderkey AS id, {_NUM} AS a, {_NUM1} AS b, {D.split_sql('o_orderkey')} AS split FROM orders) "
    + _variants_sql("'gsm8k:'||id", "'Final answer: '||a", "'Final answer: '||b", "n"),
)
def numeric_answer_pairs(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    rows = o.select(
        F.col("o_orderkey").cast("string").alias("source_problem_id"),
        F.lit(" How much is the order? ").alias("question"),
        F.concat(F.lit("Add the lines.\n#### $"), F.format_number("o_totalprice", 2)).alias("answer"),
        G.split_of(F.col("o_orderkey")).alias("split"),
    )
    return G.numeric_pair(rows).select(*SHOWN)


def entities(spark, sf):
    """Registry entities: customers with their nation, balance state and first order date."""
    first = D.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("d"))
    nation = D.table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    rows = D.table(spark, sf, "customer").join(nation, "c_nationkey").join(first, "c_custkey", "left")
    return rows.select(
        F.concat(F.lit("LEI"), F.lpad(F.col("c_custkey").cast("string"), 17, "0")).alias("lei"),
        F.col("c_name").alias("legal_name"),
        F.col("c_mktsegment").alias("entity_category"),
        F.col("n_name").alias("legal_jurisdiction"),
        F.when(F.col("c_acctbal") < 0, "LAPSED").otherwise("ISSUED").alias("registration_status"),
        F.coalesce(F.date_format("d", "yyyy-MM-dd"), F.lit("")).alias("initial_registration_date"),
        "c_custkey",
    )


_ENT = f"""en AS (SELECT 'LEI'||lpad(c_custkey::VARCHAR,17,'0') AS lei, c_custkey, c_name AS legal_name, c_mktsegment AS entity_category, n_name AS legal_jurisdiction,
  CASE WHEN c_acctbal<0 THEN 'LAPSED' ELSE 'ISSUED' END AS registration_status, coalesce(strftime(d,'%Y-%m-%d'),'') AS initial_registration_date
  FROM customer JOIN nation ON c_nationkey=n_nationkey LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS d FROM orders GROUP BY ALL) ON o_custkey=c_custkey),
 es AS (SELECT *, CASE WHEN {D.unit_sql("'7:gleif:'||lei")}<0.5 THEN 'calibration' ELSE 'test' END AS split FROM en)"""


def _claim_sql(family: str, field: str) -> str:
    wrong = f"CASE WHEN {field}<>(SELECT min({field}) FROM en) THEN (SELECT min({field}) FROM en) ELSE (SELECT min({field}) FROM en WHERE {field}>(SELECT min({field}) FROM en)) END"
    return _variants_sql(f"'gleif:{family}:'||lei", f"'Answer: '||{field}", f"'Answer: '||{wrong}", "es")


@query(
    "GEN6",
    f"WITH {_ENT} "
    + " UNION ALL ".join(
        _claim_sql(a, b)
        for a, b in (("status", "registration_status"), ("jurisdiction", "legal_jurisdiction"), ("entity-category", "entity_category"))
    ),
)
def registry_fact_claims(spark, sf):
    return G.registry_claims(entities(spark, sf), 7).select(*SHOWN)


@query(
    "GEN7",
    f"WITH {_ENT}, ed AS (SELECT * FROM es WHERE initial_registration_date<>'') "
    + _variants_sql(
        "'gleif:initial-registration-date:'||lei",
        "'Answer: '||initial_registration_date",
        "'Answer: '||strftime(initial_registration_date::DATE+1,'%Y-%m-%d')",
        "ed",
    ),
)
def registry_date_claims(spark, sf):
    return G.date_claims(entities(spark, sf), 7).select(*SHOWN)


@query(
    "GEN8",
    f"WITH {_ENT}, ea AS (SELECT es.*, 'LEI'||lpad((c_custkey+1)::VARCHAR,17,'0') AS other FROM es) "
    + _variants_sql("'gleif:alias:'||lei", "'Answer: '||lei", "'Answer: '||other", "ea"),
)
def registry_alias_claims(spark, sf):
    e = entities(spark, sf)
    aliases = e.select(
        "lei",
        F.lower("legal_name").alias("alias"),
        F.concat(F.lit("lei"), F.lpad((F.col("c_custkey") + 1).cast("string"), 17, "0")).alias("wrong_lei"),
    )
    return G.alias_claims(e, aliases, 7).select(*SHOWN)


@query(
    "GEN9",
    f"""WITH {_ENT}, rl AS (SELECT DISTINCT 'LEI'||lpad(o_custkey::VARCHAR,17,'0') AS s, 'LEI'||lpad(((o_custkey+1)//2)::VARCHAR,17,'0') AS e, o_orderpriority AS t FROM orders WHERE o_custkey<>(o_custkey+1)//2),
 pk AS (SELECT rl.*, split, (SELECT min(lei) FROM en WHERE lei<>s AND lei<>e) AS other FROM rl JOIN es ON lei=s) """
    + _variants_sql("'gleif:parent:'||s||':'||e||':'||t", "'Answer: '||e", "'Answer: '||other", "pk"),
)
def registry_parent_claims(spark, sf):
    def lei(c):
        return F.concat(F.lit("LEI"), F.lpad(c.cast("bigint").cast("string"), 17, "0"))

    key = F.col("o_custkey")
    parent = F.floor((key + 1) / 2)
    rel = (
        D.table(spark, sf, "orders")
        .filter(key != parent)
        .select(lei(key).alias("start"), lei(parent).alias("end"), F.col("o_orderpriority").alias("type"))
        .distinct()
    )
    e = entities(spark, sf)
    sampled = e.select("lei", F.col("lei").alias("spot"))
    return G.parent_claims(rel, e, sampled, ["spot"], 7).select(*SHOWN)


_SEGMENTS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_LANDS = ["NATION_0", "NATION_1", "NATION_2", "OTHER"]


@query(
    "GEN10",
    f"""WITH {_ENT} SELECT 'gleif:entity-category:'||lei AS record_id, CASE WHEN entity_category IN ('BUILDING','FURNITURE','HOUSEHOLD','MACHINERY') THEN entity_category END AS gold,
  entity_category NOT IN ('BUILDING','FURNITURE','HOUSEHOLD','MACHINERY') AS skipped, split, contains('x', entity_category) AS leaked FROM es
 UNION ALL SELECT 'gleif:registration-status:'||lei, registration_status, false, split, false FROM es
 UNION ALL SELECT 'gleif:legal-jurisdiction:'||lei, CASE WHEN legal_jurisdiction IN ('NATION_0','NATION_1','NATION_2') THEN legal_jurisdiction ELSE 'OTHER' END, false, split, false FROM es""",
)
def closed_set_items(spark, sf):
    vocab = {
        "entity-category": _SEGMENTS,
        "registration-status": ["ISSUED", "LAPSED"],
        "legal-jurisdiction": _LANDS,
    }
    rows = G.classification_items(entities(spark, sf), vocab, 7)
    leaked = F.contains(F.element_at(F.split("prompt", "\n\nQuestion"), 1), F.coalesce("gold", F.lit("\u0000")))
    return rows.select("record_id", "gold", "skipped", "split", leaked.alias("leaked"))


_TASK_KEY = r"substr(sha256(trim(regexp_replace(text,'\s+',' ','g'),' ')),1,16)"


@query(
    "GEN11",
    f"""SELECT 'legalbench-turns:test:'||conv_id AS record_id, 'legalbench-turns:case:'||{_TASK_KEY} AS source_problem_id,
 'Read: '||trim(text)||chr(10)||'By '||role||'. Is it fine?' AS prompt, CASE role WHEN 'user' THEN 'Yes' ELSE 'No' END AS gold FROM conversations""",
)
def template_prompts(spark, sf):
    c = D.table(spark, sf, "conversations")
    rows = c.select(
        F.col("conv_id").alias("index"), "text", F.concat(F.lit(" "), "role").alias("role"),
        F.when(F.col("role") == "user", " Yes").otherwise("No ").alias("answer"),
    )
    out = G.task_records(rows, "turns", "Read: {{text}}\nBy {{role}}. Is it fine?", ["text", "role"], F.lit("test"))
    return out.select("record_id", "source_problem_id", "prompt", "gold")


def _code_json(x: str) -> str:
    return (
        "sha256('{\"candidate_origin\":\"fixture\",\"candidate_sha256\":\"'||sha256(" + x + ")||'\",\"candidate_slot\":'||l_linenumber||'"
        ",\"dataset_id\":\"code\",\"dataset_revision\":\"r1\",\"task_id\":\"T'||l_orderkey||'\"}')"
    )


@query(
    "GEN12 IDN1",
    f"""SELECT DISTINCT {_code_json("'return '||l_partkey")} AS record_id, 'T'||l_orderkey AS source_problem_id,
 'def f():'||chr(10)||chr(10)||'Candidate completion:'||chr(10)||'return '||l_partkey AS prompt, CASE l_linestatus WHEN 'F' THEN 'pass' ELSE 'fail' END AS gold FROM lineitem""",
)
def code_candidate_records(spark, sf):
    """Equal lines are dropped by their keys, before these are spelled out, so candidates and labels are distinct."""
    keys = ["l_orderkey", "l_partkey", "l_linenumber"]
    label = F.when(F.col("l_linestatus") == "F", "pass").otherwise("fail").alias("label")
    li = D.table(spark, sf, "lineitem").select(*keys, label)
    task = [
        F.concat(F.lit("T"), "l_orderkey").alias("task_id"),
        F.lit("def f():").alias("prompt"),
        F.concat(F.lit("return "), "l_partkey").alias("candidate_code"),
        F.lit("fixture").alias("candidate_origin"),
        F.col("l_linenumber").alias("candidate_slot"),
        F.lit("test").alias("split"),
    ]
    rows = li.select(*keys).distinct().select(*task)
    gold = li.distinct().select(*task, "label").select(
        content_id(
            {
                "dataset_id": F.lit("code"),
                "dataset_revision": F.lit("r1"),
                "task_id": F.col("task_id"),
                "candidate_sha256": F.sha2("candidate_code", 256),
                "candidate_origin": F.col("candidate_origin"),
                "candidate_slot": F.col("candidate_slot"),
            }
        ).alias("record_id"),
        "label",
    )
    out = G.code_records(rows, gold, "code", "r1")
    return out.select("record_id", "source_problem_id", "prompt", "gold")


@query(
    "GEN13",
    f"""WITH {D.REC} SELECT record_id, candidate_b AS candidate_a, candidate_a AS candidate_b, CASE gold WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE gold END AS gold,
 'ab_swap' AS kind FROM rec WHERE mode='pairwise'""",
)
def swapped_pairs(spark, sf):
    out = G.swap_pairs(D.records(spark, sf).filter("mode = 'pairwise'"))
    return out.select("record_id", "candidate_a", "candidate_b", "gold", F.col("perturbation")["kind"].alias("kind"))


def fixture_sources(spark, sf):
    p = D.table(spark, sf, "part")
    numeric = F.col("p_type") == "ECONOMY"
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    return p.select(
        F.concat(F.lit("fx-"), "p_partkey").alias("source_problem_id"),
        F.when(numeric, "arithmetic").otherwise("code_output").alias("domain"),
        F.when(numeric, "arithmetic-v1").otherwise("code-output-v1").alias("verifier_id"),
        F.lit("Give the value.").alias("prompt"),
        F.when(numeric, price).otherwise(F.col("p_name")).alias("reference"),
        F.when(numeric, F.concat(price, F.lit("0"))).otherwise(F.concat("p_name", F.lit(" \n"))).alias("correct"),
        F.when(numeric, F.concat(F.lit("1"), price)).otherwise(F.concat("p_name", F.lit("s"))).alias("subtle"),
        F.lit("none").alias("obvious"),
    )


@query(
    "GEN14 UDF1",
    f"""WITH f AS (SELECT 'fx-'||p_partkey AS id, {D.split_sql("'fx-'||p_partkey")} AS split FROM part)
 SELECT 'single-'||id||'-correct' AS record_id, 'single' AS mode, 'pass' AS gold, split FROM f
 UNION ALL SELECT 'single-'||id||'-subtle','single','fail',split FROM f UNION ALL SELECT 'single-'||id||'-obvious','single','fail',split FROM f
 UNION ALL SELECT 'pair-'||id||'-correct-first','pairwise','A',split FROM f UNION ALL SELECT 'pair-'||id||'-incorrect-first','pairwise','B',split FROM f""",
)
def fixture_records(spark, sf):
    return G.fixture_variants(fixture_sources(spark, sf)).select("record_id", "mode", "gold", "split")


_PASS_OPTIONS = '"labels":["pass","fail"],"options":[{"id":"pass","description":"The candidate is objectively correct."},{"id":"fail","description":"The candidate is objectively incorrect."}]'
_PAIR_OPTIONS = '"labels":["A","B","TIE"],"options":[{"id":"A","description":"Candidate A is better or more correct."},{"id":"B","description":"Candidate B is better or more correct."},{"id":"TIE","description":"The candidates are objectively equivalent."}]'


@query(
    "GEN15",
    f"""WITH {D.REC} SELECT record_id, mode, '{{'||CASE mode WHEN 'single' THEN '{_PASS_OPTIONS}' ELSE '{_PAIR_OPTIONS}' END||
 ',"question":"Return the single objective verdict for the candidate record.","record_id":"'||record_id||'","state":'||
 to_json('User prompt: '||prompt||chr(10)||'Candidate A: '||candidate_a||CASE WHEN mode='pairwise' THEN chr(10)||'Candidate B: '||candidate_b ELSE '' END)||'}}' AS packet FROM rec""",
)
def decision_requests(spark, sf):
    return G.request_packets(D.records(spark, sf))


@query(
    "GEN16 TOP3 TOP4",
    D.scored_with(
        "lo AS (SELECT record_id, label, coalesce(conf,1.0) AS c FROM sc WHERE judge_id='a')",
        """ds AS (SELECT b.record_id, count(DISTINCT CASE WHEN p.execution_status='ok' AND p.label IS DISTINCT FROM b.label THEN p.label END) AS d
  FROM lo b LEFT JOIN (SELECT * FROM sc WHERE judge_id<>'a') p USING (record_id) GROUP BY b.record_id)""",
        "hc AS (SELECT record_id FROM (SELECT record_id FROM lo ORDER BY c, record_id LIMIT 10) UNION SELECT record_id FROM (SELECT record_id FROM ds ORDER BY d DESC, record_id LIMIT 10))",
    )
    + " SELECT record_id, r.mode, r.candidate_a, lo.label AS local_label FROM rec r JOIN hc USING (record_id) LEFT JOIN lo USING (record_id)",
)
def review_batch(spark, sf):
    rows = D.scored(spark, sf)
    local = rows.filter("judge_id = 'a'")
    hard = R.least_confident(local).select("record_id").unionByName(
        R.most_disputed(rows.filter("judge_id <> 'a'"), local).select("record_id")
    )
    out = G.review_batch(D.records(spark, sf), local, hard)
    return out.select("record_id", "mode", "candidate_a", "local_label")


PARAPHRASES = {"arithmetic": "The number is right.", "code_output": "The printed text is right."}


def fixture_training(spark, sf):
    rows = G.fixture_variants(fixture_sources(spark, sf))
    return rows.select(
        "record_id", "source_problem_id", "mode", "split", G.domain_of_verifier(F.col("verifier_id")).alias("domain"),
        "prompt", "candidate_a", "gold", F.lit("Matches the key.").alias("criterion_text"),
    )


def proposals(spark, sf):
    p = D.table(spark, sf, "part")
    wrong = F.when(F.col("p_size") > 25, "nothing").otherwise(
        F.when(F.col("p_type") == "ECONOMY", F.col("p_retailprice").cast("decimal(18,2)").cast("string")).otherwise(F.col("p_name"))
    )
    return p.select(
        F.concat(F.lit("fx-"), "p_partkey").alias("source_problem_id"),
        wrong.alias("candidate"),
        F.when(F.col("p_type") == "PROMO", "other").otherwise("unheard_of").alias("failure_mode"),
    )


DEFAULT_MODES = {"arithmetic": "arithmetic_slip", "code_output": "output_slip"}


def negatives(spark, sf):
    sources = fixture_sources(spark, sf).withColumn("split", G.split_of(F.col("source_problem_id")))
    return G.accept_negatives(proposals(spark, sf), sources, ["unsupported_claim", "format_confusion", "other"], DEFAULT_MODES)


@query(
    "GEN19",
    """SELECT 'fx-'||p_partkey AS source_problem_id, CASE WHEN p_size>25 THEN 'accepted' ELSE 'rejected' END AS outcome,
 CASE WHEN p_size<=25 THEN NULL WHEN p_type='PROMO' THEN 'other' WHEN p_type='ECONOMY' THEN 'arithmetic_slip' ELSE 'output_slip' END AS failure_mode FROM part""",
)
def hard_negative_acceptance(spark, sf):
    accepted, rejected = negatives(spark, sf)
    return accepted.select("source_problem_id", F.lit("accepted").alias("outcome"), "failure_mode").unionByName(
        rejected.select("source_problem_id", F.lit("rejected").alias("outcome"), F.lit(None).cast("string").alias("failure_mode"))
    )


_TRAIN = f"""tf AS (SELECT 'fx-'||p_partkey AS id, CASE p_type WHEN 'ECONOMY' THEN 'arithmetic' ELSE 'code_output' END AS domain, p_size FROM part
  WHERE {D.split_sql("'fx-'||p_partkey")}='train'),
 tr AS (SELECT 'single-'||id||'-'||v AS rid, domain, CASE v WHEN 'correct' THEN 'pass' ELSE 'fail' END AS label, 'objective' AS kind, 'canonical' AS aug FROM tf, (VALUES ('correct'),('subtle'),('obvious')) x(v)
  UNION ALL SELECT 'hard-negative:'||id||':001', domain, 'fail', 'verified_hard_negative', 'verified-hard-negative' FROM tf WHERE p_size>25)"""


@query(
    "GEN17 VAL14",
    f"""WITH {_TRAIN} SELECT rid||':'||aug AS row_id, domain, label, kind AS source_kind FROM tr
 UNION ALL SELECT rid||':criterion-paraphrase:'||domain, domain, label, kind FROM tr""",
)
def training_arm_rows(spark, sf):
    accepted, _ = negatives(spark, sf)
    hard = accepted.withColumnRenamed("candidate", "candidate_a").withColumn("criterion_text", F.lit(G.CANONICAL_CRITERION))
    rows = G.training_arm(fixture_training(spark, sf), "D", hard, PARAPHRASES)
    return rows.select("row_id", "domain", "label", "source_kind")


@query(
    "GEN18",
    f"""WITH {_TRAIN} SELECT rid AS record_id, sha256('Task: decide whether the candidate satisfies the rubric.'||chr(10)||'Rubric: Matches the key.'||chr(10)||'Domain: '||domain||chr(10)||'Prompt: Give the value.'||chr(10)||'Candidate: '||
 CASE WHEN v='obvious' THEN 'none' WHEN domain='arithmetic' THEN CASE v WHEN 'correct' THEN pr||'0' ELSE '1'||pr END ELSE CASE v WHEN 'correct' THEN nm||' '||chr(10) ELSE nm||'s' END END) AS text_hash
 FROM (SELECT 'single-'||id||'-'||v AS rid, v, domain, p_retailprice::DECIMAL(18,2)::VARCHAR AS pr, p_name AS nm FROM tf JOIN part ON 'fx-'||p_partkey=id, (VALUES ('correct'),('subtle'),('obvious')) x(v))""",
)
def rendered_training_texts(spark, sf):
    rows = fixture_training(spark, sf).filter("mode = 'single' AND split = 'train'").withColumnRenamed("candidate_a", "candidate")
    return rows.select("record_id", F.sha2(G.render_text(True), 256).alias("text_hash"))


@query(
    "SET1",
    f"""WITH {_QS}, {D.REC} SELECT 'arc-single:'||id||':'||v AS record_id, split FROM q2, (VALUES ('correct'),('wrong')) x(v)
 UNION ALL SELECT record_id, split FROM rec WHERE mode='single'""",
)
def united_families(spark, sf):
    questions_ = G.single_pair(G.normalize_choices(questions(spark, sf)), SEED)
    docs = D.bare_records(spark, sf).filter("mode = 'single'")
    return G.union_families(questions_, docs).select("record_id", "split")


@query(
    "SET3",
    f"""WITH {D.REC}, mc AS (SELECT mode, gold, row_number() OVER (PARTITION BY mode ORDER BY count(*) DESC, CASE gold WHEN 'pass' THEN 1 WHEN 'fail' THEN 2 WHEN 'A' THEN 3 WHEN 'B' THEN 4 ELSE 5 END) AS rn
 FROM rec WHERE split<>'test' GROUP BY mode, gold) SELECT 'majority_baseline' AS judge_id, record_id, mc.gold AS label, 'ok' AS execution_status FROM rec JOIN mc ON mc.mode=rec.mode AND rn=1 WHERE split='test'""",
)
def majority_judge(spark, sf):
    recs = D.bare_records(spark, sf)
    return G.majority_judge(recs.filter("split = 'test'"), recs.filter("split <> 'test'"))


_FLIPPED = """flipped AS (SELECT * REPLACE (CASE gold WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE gold END AS gold) FROM rec WHERE mode='pairwise')"""
_SWAPQ = """sq AS (SELECT p.judge_id, p.record_id, p.label, r.label AS other FROM pred p JOIN turned r USING (judge_id, record_id)
  WHERE p.label IS NOT NULL AND r.label IS NOT NULL)"""


@query(
    "AGG20",
    D.scored_with(_FLIPPED, D.pred_sql("turned", 43, "flipped"), _SWAPQ)
    + """ SELECT judge_id, count(*) AS pairs, round(avg((other=CASE label WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE label END)::INT),9) AS swap_consistency FROM sq GROUP BY judge_id""",
)
def swap_consistency(spark, sf):
    """The second predictions are made on the swapped pairs; the swap names the record that each comes from."""
    recs = D.records(spark, sf).filter("mode = 'pairwise'")
    swapped = G.swap_pairs(recs)
    ok = "execution_status = 'ok'"
    second = D.predictions(swapped, seed=43).filter(ok).join(swapped.select("record_id", "source_record_id"), "record_id")
    from assay.plans.metrics import rounded

    return rounded(M.swap_consistency(D.predictions(recs).filter(ok), second, ["judge_id"]))


_REP = """ar AS (SELECT * FROM pred UNION ALL SELECT * FROM redo)"""


@query(
    "AGG18",
    D.scored_with(D.PRED_RETRY, _REP, "st AS (SELECT judge_id, record_id, (min(label)=max(label))::INT AS s FROM ar WHERE execution_status='ok' GROUP BY ALL)")
    + " SELECT judge_id, count(*) AS records, round(avg(s),9) AS repeatability_rate FROM st GROUP BY judge_id",
)
def repeatability(spark, sf):
    from assay.plans.metrics import rounded

    recs = D.bare_records(spark, sf)
    rows = D.predictions(recs).unionByName(D.predictions(recs, seed=43))
    return rounded(M.repeatability(rows, ["judge_id"]))


@query(
    "AGG19",
    D.scored_with(D.PRED_RETRY)
    + """ SELECT p.judge_id AS kind, count(*) AS comparable, round(avg((p.label=r.label)::INT),9) AS agreement_rate
 FROM redo p JOIN (SELECT * FROM pred WHERE judge_id='c' AND label IS NOT NULL) r USING (record_id) WHERE p.label IS NOT NULL GROUP BY p.judge_id""",
)
def perturbation_agreement(spark, sf):
    from assay.plans.metrics import rounded

    recs = D.bare_records(spark, sf)
    primary = D.predictions(recs).filter("judge_id = 'c' AND label IS NOT NULL")
    rows = D.predictions(recs, seed=43).withColumnRenamed("judge_id", "kind")
    return rounded(M.perturbation_agreement(rows, primary))
