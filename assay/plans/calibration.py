"""Calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import calibration as C
from assay.plans import derive as D
from assay.plans.metrics import mode_classes, rounded
from assay.plans.registry import query

# An artifact for the queries that only apply a calibration.
TEMPERATURES = {"single": 1.7, "pairwise": 0.6}
PLATT = {"a": (0.8, 0.3), "b": (1.4, -0.2), "c": (2.1, 0.1)}


def usable(spark, sf):
    return D.scored(spark, sf).filter("resolved = 1 AND probabilities IS NOT NULL")


def fit_rows(spark, sf):
    return usable(spark, sf).filter("split = 'calibration'")


def mode_model(spark):
    return spark.createDataFrame(list(TEMPERATURES.items()), "mode string, temperature double")


_FIT = "ft AS (SELECT * FROM sc WHERE split='calibration' AND resolved=1 AND has_p)"
_NLL = """CASE WHEN mode='single' THEN
  ln(exp((ln(p1)-ln(conf))/t)+exp((ln(p2)-ln(conf))/t))+(ln(conf)-ln(CASE gold WHEN 'pass' THEN p1 ELSE p2 END))/t
 ELSE ln(exp((ln(p1)-ln(conf))/t)+exp((ln(p2)-ln(conf))/t)+exp((ln(p3)-ln(conf))/t))
  +(ln(conf)-ln(CASE gold WHEN 'A' THEN p1 WHEN 'B' THEN p2 ELSE p3 END))/t END"""


_SLOPE = """CASE WHEN mode='single' THEN [ln(p1),ln(p2)] ELSE [ln(p1),ln(p2),ln(p3)] END AS l,
 ln(CASE WHEN gold IN ('pass','A') THEN p1 WHEN gold IN ('fail','B') THEN p2 ELSE p3 END) AS lg"""


def _inverse_newton(k: int) -> str:
    return f"""w{k} AS (SELECT judge_id, mode, s-avg(e1-lg)/avg(e2-e1*e1) AS s FROM (
  SELECT lv.judge_id, lv.mode, lg, s, list_sum([exp(s*x)*x FOR x IN l])/list_sum([exp(s*x) FOR x IN l]) AS e1,
   list_sum([exp(s*x)*x*x FOR x IN l])/list_sum([exp(s*x) FOR x IN l]) AS e2
  FROM lv JOIN w{k - 1} USING (judge_id, mode)) GROUP BY judge_id, mode, s)"""


_INVERSE = (
    f"lv AS (SELECT judge_id, mode, {_SLOPE} FROM ft)",
    "w0 AS (SELECT DISTINCT judge_id, mode, 1.0::DOUBLE AS s FROM lv)",
    *[_inverse_newton(k) for k in range(1, 13)],
)


@query(
    "CAL1",
    D.scored_with(
        _FIT,
        f"""gr AS (SELECT judge_id, mode, t, avg({_NLL}) AS nll, count(*) AS n
 FROM ft, (SELECT exp(i*0.002::DOUBLE) AS t FROM range(-3000,3001) r(i)) GROUP BY ALL)""",
        *_INVERSE,
    )
    + """ SELECT judge_id, mode, round(any_value(1/s),4) AS temperature, round(max(nll) FILTER (t=1.0),9) AS nll_before,
 round(least(min(nll),max(nll) FILTER (t=1.0)),5) AS nll_after, max(n) AS fit_rows FROM gr JOIN w12 USING (judge_id, mode) GROUP BY ALL""",
)
def temperature_fit(spark, sf):
    model = C.fit_temperature(fit_rows(spark, sf), ["judge_id", "mode"], mode_classes())
    return model.select(
        "judge_id", "mode", F.round("temperature", 4).alias("temperature"), F.round("nll_before", 9).alias("nll_before"), F.round("nll_after", 5).alias("nll_after"), "fit_rows"
    )


_TEMP = """tp AS (SELECT *, CASE mode WHEN 'single' THEN 1.7::DOUBLE ELSE 0.6::DOUBLE END AS t FROM sc WHERE resolved=1 AND has_p),
 te AS (SELECT * EXCLUDE (p1,p2,p3), exp((ln(p1)-ln(conf))/t) AS e1, exp((ln(p2)-ln(conf))/t) AS e2,
   CASE WHEN mode='pairwise' THEN exp((ln(p3)-ln(conf))/t) END AS e3 FROM tp),
 tq AS (SELECT *, e1/(e1+e2+coalesce(e3,0)) AS p1, e2/(e1+e2+coalesce(e3,0)) AS p2, e3/(e1+e2+coalesce(e3,0)) AS p3 FROM te)"""


@query(
    "CAL2",
    D.scored_with(_TEMP)
    + " SELECT judge_id, record_id, round(p1,9) AS p1, round(p2,9) AS p2, round(p3,9) AS p3 FROM tq",
)
def temperature_applied(spark, sf):
    out = C.apply_temperature(usable(spark, sf), mode_model(spark), ["mode"], mode_classes())
    values = F.map_values("probabilities")
    return rounded(
        out.select("judge_id", "record_id", *[F.get(values, F.lit(i)).alias(f"p{i + 1}") for i in range(3)])
    )


_PLATT = """pt AS (SELECT judge_id, record_id, ln(greatest(p1,1e-15)/greatest(1-p1,1e-15)) AS x, (gold='A')::INT::DOUBLE AS y FROM ft WHERE mode='pairwise'),
 n0 AS (SELECT DISTINCT judge_id, 1.0::DOUBLE AS s, 0.0::DOUBLE AS i FROM pt)"""


def _newton(k: int) -> str:
    return f"""n{k} AS (SELECT judge_id, s-((h22+1e-8)*g1-h12*g2)/((h11+1e-8)*(h22+1e-8)-h12*h12) AS s,
  i-((h11+1e-8)*g2-h12*g1)/((h11+1e-8)*(h22+1e-8)-h12*h12) AS i FROM (
  SELECT judge_id, s, i, sum((q-y)*x) AS g1, sum(q-y) AS g2, sum(q*(1-q)*x*x) AS h11, sum(q*(1-q)*x) AS h12, sum(q*(1-q)) AS h22
  FROM (SELECT pt.judge_id, x, y, s, i, 1/(1+exp(-(s*x+i))) AS q FROM pt JOIN n{k - 1} USING (judge_id)) GROUP BY judge_id, s, i))"""


@query(
    "CAL3",
    D.scored_with(_FIT, _PLATT, *[_newton(k) for k in range(1, 16)])
    + " SELECT judge_id, round(s,6) AS slope, round(i,6) AS intercept FROM n15",
)
def platt_fit(spark, sf):
    rows = fit_rows(spark, sf).filter("mode = 'pairwise'")
    return rounded(C.fit_platt(rows, ["judge_id"], "A"), 6)


@query(
    "CAL4",
    D.scored_with(
        "pl AS (SELECT judge_id, record_id, ln(greatest(p1,1e-15)/greatest(1-p1,1e-15)) AS x FROM sc WHERE resolved=1 AND has_p AND mode='single')",
        "pp AS (SELECT * FROM (VALUES ('a',0.8::DOUBLE,0.3::DOUBLE),('b',1.4,-0.2),('c',2.1,0.1)) v(judge_id,s,i))",
    )
    + " SELECT judge_id, record_id, round(1/(1+exp(-(s*x+i))),9) AS p_pass, round(1-1/(1+exp(-(s*x+i))),9) AS p_fail FROM pl JOIN pp USING (judge_id)",
)
def platt_applied(spark, sf):
    model = spark.createDataFrame([(j, *v) for j, v in PLATT.items()], "judge_id string, slope double, intercept double")
    out = C.apply_platt(usable(spark, sf).filter("mode = 'single'"), model, ["judge_id"], "fail", "pass")
    p = F.col("probabilities")
    return rounded(out.select("judge_id", "record_id", p["pass"].alias("p_pass"), p["fail"].alias("p_fail")))


@query(
    "CAL5",
    D.scored_with(_FIT, *_INVERSE)
    + """ SELECT judge_id, record_id, mode, label, true AS calibrated,
 round(1/(exp(s*(ln(p1)-ln(conf)))+exp(s*(ln(p2)-ln(conf)))+CASE WHEN mode='single' THEN 0 ELSE exp(s*(ln(p3)-ln(conf))) END),6) AS confidence
 FROM sc JOIN w12 USING (judge_id, mode) WHERE resolved=1 AND has_p""",
)
def calibrators_by_mode(spark, sf):
    model = C.fit_temperature(fit_rows(spark, sf), ["judge_id", "mode"], mode_classes())
    out = C.apply_temperature(usable(spark, sf), model, ["judge_id", "mode"], mode_classes())
    values = F.map_values("probabilities")
    return rounded(out.select("judge_id", "record_id", "mode", "label", "calibrated", F.array_max(values).alias("confidence")), 6)


@query(
    "CAL6",
    D.scored_with(_TEMP)
    + """ SELECT judge_id, record_id, CASE WHEN mode='single' THEN CASE WHEN p1>=p2 THEN 'pass' ELSE 'fail' END
 WHEN p1>=p2 AND p1>=p3 THEN 'A' WHEN p2>=p3 THEN 'B' ELSE 'TIE' END AS label, round(ln(greatest(p1,p2,coalesce(p3,0))),9) AS top_score FROM tq""",
)
def calibrated_labels(spark, sf):
    out = C.relabel(C.apply_temperature(usable(spark, sf), mode_model(spark), ["mode"], mode_classes()), mode_classes())
    return rounded(
        out.select("judge_id", "record_id", "label", F.array_max(F.map_values("raw_scores")).alias("top_score"))
    )


def _view(name: str, source: str) -> str:
    return f"SELECT '{name}' AS view, judge_id, mode, gold, label, p1, p2, p3, greatest(p1,p2,coalesce(p3,0)) AS conf FROM {source}"


@query(
    "CAL7 AGG7",
    D.scored_with(
        _TEMP,
        f"vw AS ({_view('raw', 'sc WHERE resolved=1 AND has_p')} UNION ALL {_view('calibrated', 'tq')})",
        """vt AS (SELECT *, pow(p1-(gold IN ('pass','A'))::INT,2)+pow(p2-(gold IN ('fail','B'))::INT,2)
   +CASE WHEN mode='pairwise' THEN pow(p3-(gold='TIE')::INT,2) ELSE 0 END AS bt,
   -ln(greatest(1e-15,CASE WHEN gold IN ('pass','A') THEN p1 WHEN gold IN ('fail','B') THEN p2 ELSE p3 END)) AS nt,
   CASE WHEN mode='single' THEN CASE WHEN p1=conf THEN 'pass' ELSE 'fail' END WHEN p1=conf THEN 'A' WHEN p2=conf THEN 'B' ELSE 'TIE' END AS top,
   list_sum([(conf>=i/10.0::DOUBLE)::INT FOR i IN range(1,10)])::INT AS bin FROM vw)""",
        """vc AS (SELECT view, judge_id, mode, c, count(*) FILTER (gold=c) AS support, count(*) FILTER (label=c) AS predicted,
   count(*) FILTER (gold=c AND label=c) AS tp FROM vt CROSS JOIN (VALUES ('pass'),('fail'),('A'),('B'),('TIE')) v(c) GROUP BY ALL)""",
        """vl AS (SELECT view, judge_id, mode, sum(support)::BIGINT AS count, sum(tp)::DOUBLE/sum(support)::DOUBLE AS a,
   avg(tp::DOUBLE/nullif(support,0)) AS b, avg(2.0::DOUBLE*tp/(support+predicted)) AS f FROM vc WHERE support+predicted>0 GROUP BY ALL)""",
        """ve AS (SELECT view, judge_id, mode, sum(m*abs(x-c))/sum(m) AS ece FROM (SELECT view, judge_id, mode, bin, count(*) AS m,
   avg(conf) AS c, avg((top=gold)::INT) AS x FROM vt GROUP BY ALL) GROUP BY ALL)""",
    )
    + """ SELECT vl.view, vl.judge_id, vl.mode, vl.count, round(a,9) AS accuracy, round(b,9) AS balanced_accuracy, round(f,9) AS macro_f1,
 round(avg(bt),9) AS brier, round(avg(nt),9) AS nll, round(any_value(ece),9) AS ece, true AS probability_metrics_available
 FROM vl JOIN vt USING (view,judge_id,mode) JOIN ve USING (view,judge_id,mode) GROUP BY ALL""",
)
def calibration_before_after(spark, sf):
    raw = usable(spark, sf).select("judge_id", "mode", "gold", "label", "probabilities")
    calibrated = C.apply_temperature(raw, mode_model(spark), ["mode"], mode_classes())
    return rounded(C.calibration_report(raw, calibrated, ["judge_id", "mode"], mode_classes()))
