"""Quality rules and URL filters against their SQL, on awkward rows."""
import duckdb
import pandas as pd
import pytest
from helpers import awkward, documents, with_clashes

from fundflow.llm import quality as Q
from fundflow.llm import url_filter as U


def same(spark_df, con, sql):
    got = spark_df.toPandas()
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)

    def text(v):
        if pd.isna(v):
            return ""
        return f"{float(v):.6g}" if isinstance(v, (int, float)) else str(v)

    def as_text(d):
        return sorted(tuple(map(text, r)) for r in d[cols].astype(object).itertuples(index=False))

    assert as_text(got) == as_text(want)


def test_quality_rules(spark):
    texts, ids, sources = awkward()
    docs = documents(spark, texts, range(len(texts)), sources)
    con = duckdb.connect()
    frame = docs.toPandas()
    con.register("documents", frame)
    same(Q.quality_rules(with_clashes(docs)), con, Q.quality_sql())
    assert Q.quality_rules(documents(spark, [])).count() == 0


def test_bad_host_goes_and_small_host_is_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(60))
    texts = [good] * 400 + ["short"] * 90 + [good] * 10 + ["short"] + [good]
    sources = ["fine"] * 400 + ["farm"] * 100 + ["tiny"] * 2
    rows = Q.quality_rules(documents(spark, texts, sources=sources)).collect()
    kept = {r.doc_id for r in rows if r.kept}
    assert kept == set(range(400)) | {501}
    left = Q.good_documents(with_clashes(documents(spark, texts, sources=sources)))
    assert {r.doc_id for r in left.collect()} == kept and left.first()["rest"] == "clash"


URLS = ["https://www.Example.org/es/x", "http://example.org/en/12?q", "http://example.org/en/2", "https://a.b.com/fr/", "ftp://com/de/1",
        "https://x.com/de", "https://notexample.org/es/", "http://org/", "http://org", "no url", "", None, "://", "https://ads.x.net/a#f",
        "https://A-ads-track.net/", "http://m.ads-track.example.com/en/1", "x://y.com?/fr/", "https://u.com/fr/\nz", "https://u.COM/FR/",
        "http://site.net/wp-login.php?a=1", "http://example.org:80/es/", "http://.org/a", "http://ünï.org/", "a://b://c.org/d"]


def test_urls(spark):
    rows = [(i, u, "<p>") for i, u in enumerate(URLS + URLS[:5])] + [(None, URLS[0], "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas().astype({"page_id": "Int64"}))
    same(U.judge_urls(with_clashes(pages), U.rule_table(spark)), con, U.url_sql())
    assert U.judge_urls(pages.limit(0), U.rule_table(spark)).count() == 0


def test_many_rules_are_joined(spark, monkeypatch):
    monkeypatch.setattr(U, "MOST_RULES", 0)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    same(U.judge_urls(pages, U.rule_table(spark)), con, U.url_sql())


#: URLs that fit a pattern without holding its literal text as a whole token.
OPEN_ENDS = ["https://ad.example.net/", "https://ad-server.example.net/", "https://ads-server.example.net/", "https://ads2.example.net/",
             "https://x.ad77.net/", "https://AD.x.net/a", "https://ads.x.net/", "http://a.net/wp-login.php5", "http://a.net/wp-login.php5/x?y",
             "http://a.net/WP-Login.phpx", "http://my-tracker.net/", "http://x.doubleclick.net/", "http://a.net/cgi-bin/x", "http://a.net/casino/",
             "http://a.net/porn.html", "http://add.net/", "http://a.net/xwp-login.php", "http://bads.net/"]


@pytest.mark.parametrize("most", [U.MOST_RULES, 0])
def test_patterns_with_open_ends(spark, monkeypatch, most):
    monkeypatch.setattr(U, "MOST_RULES", most)
    # each alone too, and the tokens wp and login in many URLs: the rarest token depends on the corpus
    for urls in (OPEN_ENDS, OPEN_ENDS + ["http://wp.net/login"] * 30, *[[u] for u in OPEN_ENDS[:8:7]]):
        pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        con = duckdb.connect()
        con.register("pages", pages.toPandas())
        same(U.judge_urls(pages, U.rule_table(spark)), con, U.url_sql())
        blocked = {r.page_id for r in U.judge_urls(pages, U.rule_table(spark)).where("verdict = 'block'").collect()}
        assert {i for i, u in enumerate(urls) if u in OPEN_ENDS[:15]} == blocked


def test_rarest_token_indexes_the_rule(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.example.org/es/") for i in range(5)] + [(9, "http://q.org/")], "page_id long, url string")
    host, path = U.url_parts(U.F.col("url"))
    tokens = pages.select("url", U.F.explode(U.url_tokens(U.F.concat(host, path))).alias("token"))
    index = {r.rule: r.token for r in U.rule_index(tokens, U.rule_table(spark, patterns=[])).collect()}
    assert index["example.org/es/"] in ("es", "example") and index["org/"] == "org" and index["example.org/en/1"] == "en"
