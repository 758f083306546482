from cantata.llm import url_filter
from cantata.llm.queries import URL_RULES
from tests.llm import brute

URLS = [
    None, "", "no scheme/en/", "http://example.com", "http://example.com/", "http://Example.COM/en/x?q=1", "http://www.example.com/en/", "https://a.www.example.com/en/1#f",
    "http://notexample.com/en/", "ftp://x.net/es/a", "http://net/fr/", "http://x.net/fr", "http://x.net?/fr/", "http://com#/", "x://://a.com/", "http:///en/", "http://a..com/en/", "http://example.org/es/", "http://É.com/É",
]


def check(spark, urls, rules):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' as host", "1 as size", "2 as row")
    out = url_filter.match(df, url_filter.rule_table(spark, rules)).collect()
    assert {r.page_id: tuple(r)[1:] for r in out} == {i: brute.url(u, rules) for i, u in enumerate(urls)}
    assert len(out) == len(urls)


def test_rules(spark, monkeypatch):
    check(spark, URLS, URL_RULES)
    check(spark, URLS, [("com", "", "block"), ("example.com", "/e", "allow"), ("b.example.com", "/", "block"), ("com", "/en/x", "block")])
    check(spark, URLS, [("É.com", "/", "block"), ("EXAMPLE.com", "/EN/", "block")])
    check(spark, URLS, [])
    out = url_filter.match(spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/")], "page_id long, url string"), url_filter.rule_table(spark, [("com", "/", "block")] * 2 + [(None, "/", "allow")]))
    assert [r.verdict for r in out.collect()] == ["block"] * 2


def test_large_rule_tables_take_the_shuffled_join(spark):
    rules = [(f"h{i}.example.com", "/en/", "block") for i in range(90_000)] + [("example.com", "/", "allow")]
    urls = [f"http://x.h{i}.example.com/en/{i}" for i in range(0, 200_000, 10_000)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r.page_id: r.rule for r in url_filter.match(df, url_filter.rule_table(spark, rules)).collect()}
    assert out == {i: (f"h{i * 10_000}.example.com/en/" if i < 9 else "example.com/") for i in range(20)}


def test_frequent_expressions_and_empty_tables(spark):
    rules = [("com", "/", "allow"), ("a.com", "/x", "block")]
    df = spark.createDataFrame([(i, "http://a.com/x" if i % 3 else "http://b.com/") for i in range(3000)], "page_id long, url string")
    out = url_filter.match(df, url_filter.rule_table(spark, rules), limit=0).groupBy("rule", "verdict").count().collect()
    assert {tuple(r) for r in out} == {("a.com/x", "block", 2000), ("com/", "allow", 1000)}
    assert url_filter.match(df.where("false"), url_filter.rule_table(spark, rules)).count() == 0 and url_filter.match(df.where("false"), url_filter.rule_table(spark, rules), limit=0).count() == 0
    long = "http://" + "a." * 300 + "com/" + "x" * 200_000
    assert url_filter.match(spark.createDataFrame([(1, long)], "page_id long, url string"), url_filter.rule_table(spark, rules)).first().rule == "a.com/x"


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = url_filter.match(pages, url_filter.rule_table(spark, URL_RULES)).collect()
    assert {r.page_id: tuple(r)[1:] for r in out} == {r.page_id: brute.url(r.url, URL_RULES) for r in pages.collect()}
