"""URL verdicts: host and path rules, and a character model ratio for the rest.

Two variable-order Markov models, one of the URLs the rules accept and one of
those they reject, are smoothed by interpolating every context with the next
shorter one (Witten-Bell). A URL's score is the difference of its
log-likelihoods under both, divided by its number of characters; the threshold
is where the rates of wrongly rejected and wrongly accepted rule-decided URLs
meet. All counts cover all rows. Models hold one row per distinct gram, joined
by gram; strings are scored once per distinct value, so a repeated URL or a hot
host is one row per map task. Grams carry the first 128 bits of their string's
SHA-256 and are cut in one pass, so a very long URL costs its length and no more.

With ``whole`` the models learn and score the whole URL as it is written, scheme,
query and fragment included; without it only host and path, one after the other.
Rules read host and path either way. A null URL counts as empty; one without
``://`` has an empty host and path, so only ``whole`` tells such URLs apart. Null
ids pass through; repeated rows each get the same verdict. When the rules accept or reject nothing, a score has no sign and
the verdict is allow; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import ascii_lower, saved

ORDER = 3
# The rules of the contract, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
START, END = "\x02", "\x03"
BIN = 0.01
WIDEST = 20.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def grams(text: Column, order: int) -> Column:
    """Each character with the ``order`` characters before it, the end mark included."""
    signs = F.split(F.concat(F.lit(START * order), text, F.lit(END)), "")
    shifted = [F.slice(signs, k + 1, F.length(text) + 1).alias(f"s{k}") for k in range(order + 1)]
    return F.transform(F.arrays_zip(*shifted), lambda z: F.concat(*[z[f"s{k}"] for k in range(order + 1)]))


def text_key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def gram_ratios(counts: DataFrame, order: int) -> DataFrame:
    """(gram, ratio): log of P(last | before) under the accepted over the rejected.

    ``counts`` has gram, allow and block (training counts, zero for grams that
    only occur in undecided URLs).
    """
    kinds = ("allow", "block")
    totals = counts.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds]).first()
    last = counts.groupBy(F.substring("gram", order + 1, 1).alias("tail")).agg(*[F.sum(k).alias(k) for k in kinds])
    seen = last.agg(*[F.count_if(F.col(k) > 0).alias(k) for k in kinds], F.count(F.lit(1)).alias("signs")).first()
    rows = counts.select("gram")
    for k in range(order + 1):
        tail = F.substring("gram", order + 1 - k, k + 1)
        own = counts.groupBy(tail.alias("tail")).agg(*[F.sum(c).alias(f"n_{c}") for c in kinds])
        rows = rows.withColumn("tail", tail).join(own, "tail").drop("tail")
        if k == 0:
            for c in kinds:
                n, t = totals[c], seen[c]
                base = 1.0 / max(1, seen["signs"])
                p = (F.col(f"n_{c}") + F.lit(float(t) * base)) / F.lit(float(n + t)) if n else F.lit(base)
                rows = rows.withColumn(f"p_{c}", p)
        else:
            context = own.groupBy(F.substring("tail", 1, k).alias("context")).agg(
                *[F.sum(f"n_{c}").alias(f"all_{c}") for c in kinds],
                *[F.count_if(F.col(f"n_{c}") > 0).alias(f"kinds_{c}") for c in kinds],
            )
            rows = (
                rows.withColumn("context", F.substring("gram", order + 1 - k, k))
                .join(context, "context")
                .drop("context")
            )
            for c in kinds:
                n, a, t = F.col(f"n_{c}"), F.col(f"all_{c}"), F.col(f"kinds_{c}")
                p = F.when(a > 0, (n + t * F.col(f"p_{c}")) / (a + t)).otherwise(F.col(f"p_{c}"))
                rows = rows.withColumn(f"p_{c}", p)
            rows = rows.drop(*[f"{x}_{c}" for x in ("all", "kinds") for c in kinds])
        rows = rows.drop(*[f"n_{c}" for c in kinds])
    return rows.select("gram", (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def balanced_threshold(scored: DataFrame) -> float:
    """The score at which both error rates meet, over bins of fixed width."""
    place = F.floor(F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), "score")) / BIN)
    bins = scored.where("allow + block > 0").groupBy(place.alias("place")).agg(F.sum("allow"), F.sum("block"))
    rows = sorted(bins.collect())  # at most 2 * WIDEST / BIN + 1 rows
    accepted, rejected = (sum(r[i] for r in rows) for i in (1, 2))
    if not accepted or not rejected:
        return -WIDEST
    edges, below, above = [], 0, rejected
    for place, allow, block in rows:  # threshold at the lower edge of the bin
        gap = abs(below / accepted - above / rejected) + (below / accepted + above / rejected)
        edges.append((gap, place * BIN))
        below, above = below + allow, above - block
    least = min(g for g, _ in edges)
    # every edge after the last bin of rejected URLs up to the first of accepted ones is as good
    good = [i for i, (g, _) in enumerate(edges) if g == least]
    lower = edges[max(0, good[0] - 1)][1] + BIN if least == 0 else edges[good[0]][1]
    return (lower + edges[good[-1]][1]) / 2


def judged(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
    order: int = ORDER,
    whole: bool = False,
) -> DataFrame:
    """page_id, host, path, rule, verdict, score, threshold; the query sets ``whole``."""
    host, path = host_and_path(F.col(url_col))
    text = F.coalesce(F.col(url_col), F.lit("")) if whole else F.concat(host, path)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), text.alias("text"))
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "decided": verdict, "key": text_key(F.col("text"))})
    kinds = [F.count_if(F.col("decided") == k).alias(k) for k in ("allow", "block")]
    strings = saved(rows.groupBy("key", "text").agg(*kinds), "urls")
    spelled = strings.select("key", "allow", "block", F.explode(grams(F.col("text"), order)).alias("gram"))
    counts = saved(
        spelled.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "url-grams"
    )
    ratios = saved(gram_ratios(counts, order), "url-ratios")
    scored = saved(
        spelled.join(ratios, "gram")
        .groupBy("key")
        .agg(F.avg("ratio").alias("score"), F.first("allow").alias("allow"), F.first("block").alias("block")),
        "url-scores",
    )
    threshold = balanced_threshold(scored)
    own = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return rows.join(scored.select("key", "score"), "key").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("decided", own).alias("verdict"),
        "score",
        F.lit(threshold).alias("threshold"),
    )
