"""Queries of the scalar functions: verifiers, normalisers, parsers, probability maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import probability as P
from assay.functions import text as T
from assay.functions import verdicts as W
from assay.functions import verifiers as X
from assay.functions.identity import hash_unit
from assay.plans import derive as D
from assay.plans.metrics import rounded
from assay.plans.registry import query
from assay.vocab import class_order, lit_array


def _coin(kind: str, key: str):
    return hash_unit(42, kind, F.col(key))


def _coin_sql(kind: str, key: str) -> str:
    return D.unit_sql(f"'42:{kind}:'||{key}")


@query(
    "FN1 UDF1",
    f"""WITH c AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2)::VARCHAR AS e, CASE WHEN {_coin_sql('num', 'o_orderkey')}<0.5
   THEN ' +'||o_totalprice::DECIMAL(18,2)||'00 ' WHEN {_coin_sql('num', 'o_orderkey')}<0.7 THEN 'about '||o_totalprice::DECIMAL(18,2)
   ELSE (o_totalprice+1)::DECIMAL(18,2)::VARCHAR END AS c FROM orders)
 SELECT o_orderkey, c AS candidate, coalesce(try_cast(replace(trim(c),',','') AS DECIMAL(38,10))=e::DECIMAL(38,10),false) AS is_correct,
 CASE WHEN coalesce(try_cast(replace(trim(c),',','') AS DECIMAL(38,10))=e::DECIMAL(38,10),false) THEN 'pass' ELSE 'fail' END AS label FROM c""",
)
def numeric_verifier(spark, sf):
    o = D.table(spark, sf, "orders")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    coin = _coin("num", "o_orderkey")
    candidate = (
        F.when(coin < 0.5, F.concat(F.lit(" +"), price, F.lit("00 ")))
        .when(coin < 0.7, F.concat(F.lit("about "), price))
        .otherwise((F.col("o_totalprice") + 1).cast("decimal(18,2)").cast("string"))
    )
    rows = o.select("o_orderkey", candidate.alias("candidate"), price.alias("expected"))
    result = X.verify(F.lit("arithmetic-v1"), F.col("candidate"), F.col("expected"))
    return rows.select("o_orderkey", "candidate", result["is_correct"].alias("is_correct"), result["label"].alias("label"))


@query(
    "FN2",
    """WITH c AS (SELECT p_partkey, substr('ABCD',1+p_size%4,1) AS l, p_type AS t, p_name AS n FROM part)
 SELECT p_partkey, upper(CASE WHEN regexp_matches(c,'^[A-Za-z]([.)\\s]|$)') THEN substr(c,1,1) ELSE c END) AS choice,
 upper(CASE WHEN regexp_matches(c,'^[A-Za-z]([.)\\s]|$)') THEN substr(c,1,1) ELSE c END)=l AS is_correct
 FROM (SELECT *, CASE t WHEN 'ECONOMY' THEN lower(l)||') '||n WHEN 'SMALL' THEN 'b. '||n WHEN 'PROMO' THEN l ELSE n END AS c FROM c)""",
)
def choice_verifier(spark, sf):
    letter = F.substring(F.lit("ABCD"), F.lit(1) + F.col("p_size") % 4, F.lit(1))
    kind, name = F.col("p_type"), F.col("p_name")
    candidate = (
        F.when(kind == "ECONOMY", F.concat(F.lower(letter), F.lit(") "), name))
        .when(kind == "SMALL", F.concat(F.lit("b. "), name))
        .when(kind == "PROMO", letter)
        .otherwise(name)
    )
    expected = F.to_json(F.struct(letter.alias("answer")))
    result = X.verify_choice(candidate, expected)
    return D.table(spark, sf, "part").select(
        "p_partkey", result["evidence"]["candidate_choice"].alias("choice"), result["is_correct"].alias("is_correct")
    )


@query(
    "FN3",
    """SELECT event_id, event_type NOT IN ('click') AND event_type<>'view' AS is_correct FROM events""",
)
def json_verifier(spark, sf):
    e = D.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    candidate = (
        F.when(kind == "click", F.concat(F.lit('{"k": '), k, F.lit(', "t": "x"')))
        .when(kind == "view", F.concat(F.lit('{"k": '), (k.cast("int") + 1).cast("string"), F.lit(', "t": "1.0"}')))
        .otherwise(F.concat(F.lit('{"t": "1.0", "k": '), k, F.lit(".0}")))
    )
    expected = F.concat(F.lit('{"k": '), k, F.lit(', "t": "1.0"}'))
    return e.select("event_id", X.verify_json(candidate, expected)["is_correct"].alias("is_correct"))


@query(
    "FN4",
    """SELECT conv_id, turn, role<>'assistant' OR NOT contains(text, chr(10)) AS is_correct FROM conversations""",
)
def text_verifier(spark, sf):
    c = D.table(spark, sf, "conversations")
    padded = F.concat(F.lit("\n "), F.regexp_replace("text", "\n", "  \t\r\n"), F.lit("  \n"))
    candidate = F.when(F.col("role") == "assistant", F.regexp_replace("text", "\n", "\n ")).otherwise(padded)
    return c.select("conv_id", "turn", X.verify_text(candidate, F.col("text"))["is_correct"].alias("is_correct"))


_RUN = "CASE event_type WHEN 'view' THEN 'pass' WHEN 'click' THEN 'test_failure' WHEN 'signup' THEN 'syntax_error' WHEN 'error' THEN 'crash' ELSE 'timeout' END"


@query(
    "FN5",
    f"""SELECT event_id, 'gold' AS outcome, s AS status, CASE s WHEN 'pass' THEN 'pass' ELSE 'fail' END AS label
 FROM (SELECT event_id, {_RUN} AS s FROM events) WHERE s IN ('pass','test_failure','syntax_error')
 UNION ALL SELECT event_id, 'rejected', s, NULL FROM (SELECT event_id, {_RUN} AS s FROM events) WHERE s IN ('crash','timeout')""",
)
def execution_gold(spark, sf):
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", " Pass ")
        .when(kind == "click", "TEST_FAILURE")
        .when(kind == "signup", "syntax_error")
        .when(kind == "error", "crash")
        .otherwise("timeout")
    )
    gold, rejected = X.gold_from_execution(D.table(spark, sf, "events").select("event_id", status.alias("status")))
    return gold.select("event_id", F.lit("gold").alias("outcome"), "status", "label").unionByName(
        rejected.select("event_id", F.lit("rejected").alias("outcome"), "status", F.lit(None).cast("string").alias("label"))
    )


@query(
    "FN6",
    """SELECT p_partkey, p_size||'-usc-'||p_partkey||'-a' AS slug FROM part""",
)
def citation_slugs(spark, sf):
    cite = F.concat(F.col("p_size"), F.lit(" U. S.C. § "), F.col("p_partkey"), F.lit("(A)."))
    return D.table(spark, sf, "part").select("p_partkey", T.citation_slug(cite).alias("slug"))


@query(
    "FN7",
    r"""WITH s AS (SELECT doc_id, trim(regexp_replace(lower(source||' '||lang||chr(10)||text),'[^a-z0-9]+','-','g'),'-') AS hay,
  trim(regexp_replace(lower(split_part(trim(text),' ',1)),'[^a-z0-9]+','-','g'),'-') AS pin FROM documents)
 SELECT doc_id, pin<>'' AND contains(hay, pin) AS echoed FROM s""",
)
def citation_echo(spark, sf):
    first = F.element_at(F.split(F.trim("text"), " "), 1)
    return D.table(spark, sf, "documents").select(
        "doc_id", T.is_echoed(F.concat_ws(" ", "source", "lang"), F.col("text"), first).alias("echoed")
    )


@query(
    "FN8",
    """SELECT doc_id, len(t)::INT AS tokens, t[1] AS first_token, t[len(t)] AS last_token, len(list_distinct(t))::INT AS distinct_tokens
 FROM (SELECT doc_id, regexp_extract_all(lower(text),'[a-z0-9]+') AS t FROM documents)""",
)
def search_tokens(spark, sf):
    t = T.tokens(F.col("text"))
    return D.table(spark, sf, "documents").select(
        "doc_id",
        F.size(t).alias("tokens"),
        F.get(t, F.lit(0)).alias("first_token"),
        F.get(t, F.size(t) - 1).alias("last_token"),
        F.size(F.array_distinct(t)).alias("distinct_tokens"),
    )


@query(
    "FN9",
    """SELECT c_custkey, upper(c_name) AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'CC-BY-SA-4.0' ELSE c_mktsegment END AS license FROM customer""",
)
def identifier_forms(spark, sf):
    raw = F.when(F.col("c_mktsegment") == "BUILDING", " CC_BY-SA-4.0\n").otherwise(F.concat(F.col("c_mktsegment"), F.lit(" ")))
    return D.table(spark, sf, "customer").select(
        "c_custkey", T.norm_id(F.concat(F.lit("\t"), F.lower("c_name"))).alias("id"), T.norm_license(raw).alias("license")
    )


@query(
    "FN10",
    D.scored_with()
    + """ SELECT judge_id, record_id, round(conf,9) AS confidence,
 round(conf-list_sort([p1,p2,coalesce(p3,0)],'DESC')[2],9) AS margin FROM sc WHERE has_p""",
)
def confidence_and_margin(spark, sf):
    p = F.col("probabilities")
    rows = D.scored(spark, sf).filter(p.isNotNull())
    return rounded(rows.select("judge_id", "record_id", P.confidence(p).alias("confidence"), P.margin(p).alias("margin")))


@query(
    "FN11",
    D.scored_with()
    + """ SELECT judge_id, record_id, round(exp(p1)/(exp(p1)+exp(p2)+CASE WHEN p3 IS NULL THEN 0 ELSE exp(p3) END),9) AS soft_first,
 round(ln(greatest(p1,1e-15)),9) AS log_first, round(1/(1+exp(-(p1-p2)*20)),9) AS sigmoid FROM sc WHERE has_p""",
)
def softmax_and_sigmoid(spark, sf):
    from assay.operators.calibration import sigmoid

    p, classes = F.col("probabilities"), class_order(F.col("mode"))
    rows = D.scored(spark, sf).filter(p.isNotNull())
    return rounded(
        rows.select(
            "judge_id",
            "record_id",
            F.element_at(P.softmax(p), classes[0]).alias("soft_first"),
            P.log_floor(p[classes[0]]).alias("log_first"),
            sigmoid((p[classes[0]] - p[classes[1]]) * 20).alias("sigmoid"),
        )
    )


@query(
    "FN12",
    """SELECT doc_id, CASE WHEN lang='en' THEN 'MMLU (8 subjects)' WHEN lang='fr' THEN 'GSM8K' ELSE 'ARC-Easy (pairwise)' END AS source_group FROM documents""",
)
def source_groups(spark, sf):
    lang = F.col("lang")
    name = (
        F.when(lang == "en", F.concat(F.lit("cais/mmlu:"), "source"))
        .when(lang == "fr", "openai/gsm8k:main")
        .otherwise("allenai/ai2_arc:ARC-Easy")
    )
    return D.table(spark, sf, "documents").select("doc_id", T.source_group(name).alias("source_group"))


@query(
    "FN13",
    D.scored_with(D.RESP)
    + r""" SELECT judge_id, record_id, CASE WHEN style IN (0,1) AND said<>'none' THEN said
  WHEN mode='single' THEN lower(list_extract(regexp_extract_all(text,'(?i)\b(?:pass|fail)\b'),-1))
  ELSE upper(list_extract(regexp_extract_all(text,'(?i)\b(?:A|B|TIE)\b'),-1)) END AS label FROM rp""",
)
def free_text_verdicts(spark, sf):
    return D.responses(spark, sf).select(
        "judge_id", "record_id", W.parse_verdict(F.col("text"), F.col("mode")).alias("label")
    )


@query(
    "FN14",
    D.scored_with(D.RESP)
    + """ SELECT judge_id, record_id, CASE WHEN said<>'none' AND style<3 THEN said END AS label,
 CASE WHEN said='none' OR style=3 THEN 'unresolved' WHEN style=2 THEN 'marker' ELSE 'json' END AS source FROM rp""",
)
def strict_verdicts(spark, sf):
    parsed = W.parse_verdict_strict(F.col("text"), F.col("mode"))
    return D.responses(spark, sf).select("judge_id", "record_id", parsed.alias("v")).select("judge_id", "record_id", "v.*")


@query(
    "FN15",
    D.scored_with()
    + """ SELECT judge_id, record_id, CASE WHEN resolved=1 THEN 'ok' ELSE 'parse_error' END AS execution_status, label,
 round(CASE WHEN has_p THEN p1 END,9) AS p_first, CASE WHEN resolved=1 THEN 'm-'||judge_id END AS resolved_model,
 CASE WHEN resolved=0 THEN 'no_typed_verdict' END AS error_kind FROM sc""",
)
def typed_responses(spark, sf):
    rows = D.scored(spark, sf)
    answer = F.struct(
        F.when(F.col("resolved") == 1, F.lower("label")).alias("verdict"),
        F.transform_values("probabilities", lambda _, v: v * 2).alias("probs"),
    )
    body = F.to_json(
        F.struct(
            F.when(F.col("resolved") == 1, F.concat(F.lit("m-"), "judge_id")).alias("model"),
            F.struct(F.struct(answer.alias("decision")).alias("answers")).alias("result"),
        )
    )
    out = rows.select("judge_id", "record_id", "mode", W.normalize_response(body, F.col("mode")).alias("r"))
    first = class_order(F.col("mode"))[0]
    return rounded(
        out.select(
            "judge_id",
            "record_id",
            "r.execution_status",
            "r.label",
            F.col("r.probabilities")[first].alias("p_first"),
            "r.resolved_model",
            "r.error_kind",
        )
    )


@query(
    "FN16",
    D.scored_with()
    + """ SELECT judge_id, record_id, round(CASE WHEN latency_ms<200 THEN NULL ELSE p1 END,9) AS p_first,
 round(CASE WHEN latency_ms<200 THEN NULL ELSE p2 END,9) AS p_second FROM sc WHERE has_p""",
)
def renormalized_maps(spark, sf):
    rows = D.scored(spark, sf).filter("probabilities IS NOT NULL")
    spelled = F.transform_keys(
        F.transform_values("probabilities", lambda _, v: v * 3),
        lambda k, _: F.when(F.col("latency_ms") < 200, F.concat(k, F.lit("?")))
        .when(k == "pass", " TRUE ")
        .when(k == "fail", "0")
        .otherwise(F.lower(k)),
    )
    p, classes = P.renormalize(spelled, F.col("mode")), class_order(F.col("mode"))
    return rounded(
        rows.select("judge_id", "record_id", p[classes[0]].alias("p_first"), p[classes[1]].alias("p_second"))
    )


@query(
    "FN17",
    D.scored_with(
        """ca AS (SELECT record_id, mode, count(label) AS seen, min(label) AS a, max(label) AS b, bool_and(has_p) FILTER (label IS NOT NULL) AS maps,
  avg(p1) FILTER (label IS NOT NULL) AS q1, avg(p2) FILTER (label IS NOT NULL) AS q2, avg(coalesce(p3,0)) FILTER (label IS NOT NULL) AS q3 FROM sc GROUP BY ALL)"""
    )
    + """ SELECT record_id, CASE WHEN seen=3 THEN 'ok' ELSE 'parse_error' END AS execution_status,
 CASE WHEN seen<3 THEN NULL WHEN mode='single' THEN CASE WHEN a='pass' AND b='pass' THEN 'pass' ELSE 'fail' END WHEN a=b THEN a ELSE 'TIE' END AS label,
 round(CASE WHEN seen=3 AND maps THEN q1/(q1+q2+q3) END,9) AS p_first FROM ca""",
)
def criterion_aggregation(spark, sf):
    rows = D.scored(spark, sf).select(
        "record_id", "mode", F.col("judge_id").alias("criterion_id"), "label", "probabilities", F.lit(3).alias("criteria_count")
    )
    out = P.aggregate_criteria(rows)
    first = class_order(F.col("mode"))[0]
    return rounded(out.select("record_id", "execution_status", "label", F.col("probabilities")[first].alias("p_first")))


@query(
    "FN18",
    D.scored_with(D.RESP) + " SELECT judge_id, record_id, CASE WHEN style=1 THEN 'm-'||judge_id ELSE '' END AS models FROM rp",
)
def reported_models(spark, sf):
    return D.responses(spark, sf).select(
        "judge_id", "record_id", F.array_join(W.surfaced_models(F.col("text")), ",").alias("models")
    )


@query(
    "FN19",
    """SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY','SMALL') THEN p_name END AS candidate, CASE WHEN p_type IN ('ECONOMY','SMALL') THEN p_brand END AS failure_mode FROM part""",
)
def proposal_payloads(spark, sf):
    kind, name, brand = F.col("p_type"), F.col("p_name"), F.col("p_brand")
    doc = F.to_json(
        F.struct(F.concat(F.lit(" "), name).alias("candidate"), brand.alias("failure_mode"), F.lit("r").alias("rationale"))
    )
    text = (
        F.when(kind == "ECONOMY", doc)
        .when(kind == "SMALL", F.concat(F.lit("Sure:\n"), doc, F.lit("\nDone")))
        .when(kind == "PROMO", F.lit('{"candidate": 5, "failure_mode": "x", "rationale": "r"}'))
        .otherwise(F.lit('{"candidate": "  ", "failure_mode": "x", "rationale": "r"}'))
    )
    parsed = W.parse_proposal(text)
    return D.table(spark, sf, "part").select(
        "p_partkey", parsed["candidate"].alias("candidate"), parsed["failure_mode"].alias("failure_mode")
    )


@query(
    "FN20",
    """SELECT event_id::VARCHAR AS record_id, 'tiny-model' AS judge_id, 'proto-v1' AS protocol_version, event_type AS execution_status,
 value AS latency_ms, 'q4' AS quant FROM events""",
)
def runner_rows(spark, sf):
    raw = D.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("record_id"),
        F.col("event_type").alias("execution_status"),
        F.col("value").alias("latency_ms"),
    )
    out = W.normalize_run(raw, {"model_id": "tiny-model", "quant": "q4"}, "proto-v1")
    return out.select(
        "record_id", "judge_id", "protocol_version", "execution_status", "latency_ms", F.col("provider_metadata")["quant"].alias("quant")
    )


@query(
    "FN21",
    D.scored_with(
        """ch AS (SELECT judge_id, record_id, mode, p1, p2, p3, label, latency_ms AS t, CASE WHEN mode='single' THEN CASE WHEN p1>=p2 THEN 'pass' ELSE 'fail' END
   WHEN p1>=p2 AND p1>=p3 THEN 'A' WHEN p2>=p3 THEN 'B' ELSE 'TIE' END AS top FROM sc WHERE has_p),
 cs AS (SELECT *, CASE WHEN t<150 THEN '' WHEN t<250 THEN 'abstain' WHEN t<350 THEN 'maybe' WHEN mode='single' THEN 'pass' ELSE 'A' END AS selected FROM ch)"""
    )
    + """ SELECT judge_id, record_id, CASE WHEN t<150 THEN 'parse_error' WHEN t<250 THEN 'skipped' WHEN t<350 OR t>900 OR selected<>top THEN 'parse_error' ELSE 'ok' END AS execution_status,
 CASE WHEN t<150 THEN 'selected_label_missing' WHEN t<250 THEN 'abstention' WHEN t<350 THEN 'selected_label_outside_declared_choices'
  WHEN t>900 THEN 'probability_mass_does_not_sum_to_one' WHEN selected<>top THEN 'selected_label_disagrees_with_probability_argmax' END AS error_kind,
 CASE WHEN t BETWEEN 350 AND 900 AND selected=top THEN selected END AS label FROM cs""",
)
def choice_outputs(spark, sf):
    t, mode = F.col("latency_ms"), F.col("mode")
    selected = (
        F.when(t < 150, "").when(t < 250, "abstain").when(t < 350, "maybe").when(mode == "single", "pass").otherwise("A")
    )
    p = F.transform_values("probabilities", lambda _, v: F.when(t > 900, v / 2).otherwise(v))
    rows = D.scored(spark, sf).filter("probabilities IS NOT NULL")
    out = P.normalize_choice(selected, p, class_order(mode))
    return rows.select(
        "judge_id",
        "record_id",
        out["execution_status"].alias("execution_status"),
        out["error_kind"].alias("error_kind"),
        out["label"].alias("label"),
    )


@query(
    "FN22",
    """SELECT l_orderkey, string_agg(l_returnflag||'-', '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS content,
 array_to_string(list_sort(list_distinct(list(l_linestatus))),',') AS models FROM lineitem GROUP BY l_orderkey""",
)
def assembled_responses(spark, sf):
    li = D.table(spark, sf, "lineitem")
    seq = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    event = F.concat(
        F.lit('data: {"model": "'), "l_linestatus", F.lit('", "choices": [{"delta": {"content": "'), "l_returnflag", F.lit('-"}}]}')
    )
    extra = F.explode(F.array(event, F.lit("data: [DONE]"), F.lit("data: {broken"), F.lit(": ping")))
    lines = li.select("l_orderkey", seq.alias("seq"), extra.alias("line"))
    out = W.assemble_responses(lines, "l_orderkey")
    return out.select("l_orderkey", "content", F.array_join("models", ",").alias("models"))


@query(
    "FN23",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'click' END AS label FROM events""",
)
def exact_verdicts(spark, sf):
    kind = F.col("event_type")
    content = F.when(kind == "view", F.concat(F.lit(" "), kind, F.lit("\n"))).when(kind == "click", "").when(
        kind == "error", F.upper(kind)
    ).otherwise(F.concat(kind, F.lit(".")))
    return D.table(spark, sf, "events").select(
        "event_id", W.exact_verdict(content, kind, lit_array(["view", "click", "error", "signup", "purchase"])).alias("label")
    )
