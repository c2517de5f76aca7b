"""Verdicts against a plain version with union-find over all links."""

from urllib.parse import urlsplit

from tests.compare import difference, duck
from tickloom.llm.registry import ORACLES, QUERIES, URL_RULES
from tickloom.llm.url_filters import Rule, canonical, judge

RULES = [Rule.read(r) for r in URL_RULES]

PAGES = [
    (1, "HTTP://WWW.Example.com/en/a?x=1#top", ""),
    (2, "http://example.com/en/a", None),
    (3, "http://badexample.com/en/a", ""),
    (4, "http://x.org/a/", '<LINK class="c" rel="canonical" href="https://y.net/es/1">'),
    (5, "https://x.org/a?utm_source=f&gclid=3", ""),
    (6, "https://x.org/a?page=2&ref=x", ""),
    (7, "http://z.org/r", "<meta http-equiv='refresh' content='0; URL=//y.net/fr/'>"),
    (8, "https://z.org/r#here", ""),
    (9, "http://q.org/s", '<link rel=canonical href="/t">'),
    (10, "https://q.org/t", '<meta http-equiv="refresh" content="1;url=http://y.net/es/9">'),
    (11, "http://q.org/t/", '<link rel="canonical" href="https://shop.com/ok">'),
    (12, "https://shop.com", ""),
    (13, "https://shop.com/ok", ""),
    (14, None, "x"),
    (15, "no scheme", '<link rel="canonical" href="https://y.net/es/1">'),
    (None, "https://y.net/es/1", ""),
    (16, "https://y.net/es/1", ""),
    (16, "https://y.net/es/1", ""),
    (17, "ftp://a://b.net/es/x", ""),
    (18, "https://v.org/w", '<link rel="stylesheet" href="https://y.net/es/1">'),
    (19, "https://v.org/" + "p" * 70000, "<p>" * 50000 + '<link rel="canonical" href="https://n.net/fr/2" >'),
    (20, "http://y.net/es", ""),
]


def pages_of(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_rules_hosts_and_paths(spark):
    found = {r["page_id"]: r for r in judge(pages_of(spark), RULES).collect()}
    assert (found[1]["host"], found[1]["path"], found[1]["rule"], found[1]["verdict"]) == (
        "www.example.com", "/en/a", "www.example.com/en/", "allow",
    )
    assert (found[2]["rule"], found[2]["verdict"]) == ("example.com/en/", "block")
    assert (found[3]["rule"], found[3]["verdict"]) == ("com/", "allow")
    assert (found[12]["path"], found[12]["rule"], found[12]["verdict"]) == ("", None, "allow")
    assert (found[14]["host"], found[14]["path"], found[15]["host"]) == ("", "", "")
    assert (found[17]["host"], found[17]["path"]) == ("a:", "//b.net/es/x")
    for page_id in (1, 2, 3, 13, 16):
        parts = urlsplit(dict((p, u) for p, u, _ in PAGES)[page_id])
        assert (found[page_id]["host"], found[page_id]["path"]) == (parts.netloc.lower(), parts.path)


def test_blocks_reach_aliases_and_allows_come_first(spark):
    rows = judge(pages_of(spark), RULES).collect()
    assert len(rows) == len(PAGES)
    verdicts = {r["page_id"]: r["verdict"] for r in rows}
    assert {p for p, v in verdicts.items() if v == "block"} == {None, 2, 4, 5, 7, 8, 16, 19}
    assert verdicts[9] == verdicts[10] == verdicts[11] == "allow"
    assert verdicts[6] == verdicts[14] == verdicts[15] == verdicts[18] == verdicts[20] == "allow"
    assert judge(pages_of(spark).where("false"), RULES).count() == 0


def test_canonical_forms(spark):
    forms = {
        "http://A.org/B/?ref=1&x=2&utm_term=&y=3#f": "https://a.org/B?x=2&y=3",
        "https://a.org/?utm_source=x": "https://a.org",
        "https://a.org/b?reference=1": "https://a.org/b?reference=1",
        "nothing": None,
    }
    df = spark.createDataFrame([(u,) for u in forms], "url string")
    assert [r[0] for r in df.select(canonical(df["url"])).collect()] == list(forms.values())


def test_clashing_columns_and_other_pages_unchanged(spark):
    from pyspark.sql import functions as F

    pages = pages_of(spark).withColumns({c: F.lit("c") for c in ("node", "component", "host", "verdict", "target", "label", "src")})
    plain = sorted(map(tuple, judge(pages_of(spark), RULES).collect()), key=str)
    assert sorted(map(tuple, judge(pages, RULES).collect()), key=str) == plain


def test_registered_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    df = QUERIES["op3_url_filter"](spark, folder)
    assert difference(df, duck(folder), ORACLES["op3_url_filter"]) is None


def test_sql_equals_the_operator_on_stated_links(spark):
    import duckdb
    import pandas as pd

    connection = duckdb.connect()
    connection.register("pages", pd.DataFrame(PAGES, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    assert difference(judge(pages_of(spark), RULES), connection, ORACLES["op3_url_filter"]) is None
