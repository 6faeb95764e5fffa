"""URL rules and host reputation (op13) against their SQL on hand-made pages."""

import duckdb
import pandas as pd

from crewline.llm import url_reputation
from crewline.llm.queries import ORACLES, QUERIES

URLS = [
    "https://a.example.com/en/x",  # block example.com/en/
    "https://WWW.Example.com/en/x",  # allow www.example.com/en/ (longer), host lower-cased
    "http://shop.com/",  # allow com/
    "http://xcom/en/",  # no rule: xcom is not a subdomain of com
    "https://b.example.net/es/1?q=/fr/",  # block net/es/
    "https://b.example.net/de/1#/es/",  # path stops at #: no rule
    "https://b.example.net?x=1",  # empty path
    "ftp://c.org/es/",
    "no scheme at all",
    None,
    "",
    "https://a.example.com/en/x",  # a repeated url
    "http://" + "z" * 5000 + ".net/fr/" + "p" * 5000,
]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>x</p>", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")


def test_rules_and_cuts(spark):
    got = {r["page_id"]: r for r in url_reputation.judge(pages(spark, URLS)).collect()}
    assert [got[i]["rule"] for i in range(len(URLS))] == [
        "example.com/en/", "www.example.com/en/", "com/", None, "net/es/", None, None, None, None, None, None, "example.com/en/", "net/fr/",
    ]
    assert (got[1]["host"], got[1]["path"]) == ("www.example.com", "/en/x")
    assert (got[5]["host"], got[5]["path"]) == ("b.example.net", "/de/1")
    assert (got[6]["host"], got[6]["path"]) == ("b.example.net", "")
    assert (got[9]["host"], got[9]["path"]) == ("", "") and (got[8]["host"], got[8]["path"]) == ("", "")
    assert got[0]["verdict"] == "block" and got[1]["verdict"] == "allow" and got[4]["verdict"] == "block"
    assert all(r["verdict"] in ("allow", "block") for r in got.values())


def test_reputation_follows_the_host(spark):
    urls = [f"https://bad.example.net/es/{i}" for i in range(40)] + ["https://bad.example.net/en/new", "https://fresh.example.org/a"]
    urls += [f"https://good.shop.com/{i}" for i in range(40)]
    got = {r["url"]: r["verdict"] for r in url_reputation.judge(pages(spark, urls)).collect()}
    assert got["https://bad.example.net/en/new"] == "block"  # its host's labelled pages are all blocked
    assert got["https://fresh.example.org/a"] == "allow"  # no evidence anywhere near it


def test_empty_table(spark):
    assert url_reputation.judge(pages(spark, [])).count() == 0


def test_query_equals_its_sql(spark, tmp_path):
    path = str(tmp_path / "pages.parquet")
    pd.DataFrame({"page_id": range(len(URLS)), "url": URLS, "html": ["<p>x</p>"] * len(URLS)}).drop(index=11).to_parquet(path)
    folder = str(tmp_path)
    got = sorted(tuple(r) for r in QUERIES["op13_url_reputation"](spark, folder).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}'")
    want = sorted(con.execute(ORACLES["op13_url_reputation"]).fetchall())
    assert got == want
