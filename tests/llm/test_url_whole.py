"""The query judges whole URLs: scheme, query string and fragment count."""

import math
from collections import Counter

from assay.llm import queries, url_models
from tests.llm.test_url_models import rule, split


def grams(text, order):
    padded = url_models.START * order + text + url_models.END
    return [padded[i : i + order + 1] for i in range(len(text) + 1)]


def log_p(gram, counts, signs):
    p = 1 / signs
    order = len(gram) - 1
    for at in range(order, -1, -1):
        own = Counter()
        for other, n in counts.items():
            if other[at:-1] == gram[at:-1]:
                own[other[-1]] += n
        if own:
            p = (own[gram[-1]] + len(own) * p) / (sum(own.values()) + len(own))
    return math.log(p)


def brute_scores(urls, order=url_models.ORDER):
    """Score of each whole URL, by plain counting."""
    spelled = {u: grams(u or "", order) for u in urls}
    counts = {"allow": Counter(), "block": Counter()}
    for u in urls:
        if kind := rule(*split(u))[1]:
            counts[kind].update(spelled[u])
    signs = len({g[-1] for gs in spelled.values() for g in gs})
    return {
        u: sum(log_p(g, counts["allow"], signs) - log_p(g, counts["block"], signs) for g in gs) / len(gs)
        for u, gs in spelled.items()
    }


def test_query_scores_whole_urls(spark, tmp_path):
    urls = [None, "", "no scheme", "mailto:good", "http://a.org/x?good", "http://b.org/y?good#fine", "HTTP://c.Org/?good",
            "http://b.com/de/?bad", "http://c.com/de/x#bad", "x://EXAMPLE.org/es/1?bad", "http://n.net/p?good", "http://n.net/p?bad",
            "ftp://n.net/p", "http://n.net/p#bad", "http://n.net/p?good"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries.QUERIES["op9_url_models"](spark, str(tmp_path)).collect()}
    want = brute_scores(urls)
    assert sorted(got) == list(range(len(urls)))
    for i, u in enumerate(urls):
        r = got[i]
        name, kind = rule(*split(u))
        assert (r.host, r.path, r.rule) == (*split(u), name)
        assert abs(r.score - want[u]) < 1e-9
        assert r.verdict == (kind or ("allow" if r.score >= r.threshold else "block"))
    assert got[10].score > got[11].score and (got[10].verdict, got[11].verdict) == ("allow", "block")
    assert got[2].score != got[3].score
