"""The url rules of op3's contract, through the query."""

from densigrid.llm import queries


def test_every_rule_gives_its_own_verdict(spark, tmp_path):
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://x.example.com/en/7a": ("example.com/en/7", "allow"), "http://a.net/de/1": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"), "http://a.example.net/de/9": ("net/de/", "allow"), "http://a.org/es/": ("org/es/", "block"),
    }
    pages = spark.createDataFrame([(i, url, "") for i, url in enumerate(want)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    # every page is labelled as one to block, so what is allowed is allowed by its rule
    spark.createDataFrame([(i, 0, 1) for i in range(len(want))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.op3_url_association_rules(spark, str(tmp_path)).collect()}
    assert found == dict(enumerate(want.values()))
