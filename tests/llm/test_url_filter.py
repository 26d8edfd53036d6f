"""URL parts and rules against plain Python; the model on URLs it has not seen."""

from panelark.llm import url_filter as urls

ODD = [
    None, "", "no scheme", "http://", "http://NET/", "http://a.Net", "https://x.example.NET/en/1", "http://example.net/en", "http://badexample.net/en/x",
    "http://example.com/de/", "ftp://A.Example.Com/de/x?y#z", "http://fr.org/fr/", "http://org/fr/x", "http://x.org#/fr/", "a://b://c/d",
    "http://É.com/ü?é", "//x.net/", "http://x.net?/", "http://" + "a" * 3000 + ".com/" + "b/" * 2000, "http://x.org/fr/\nnew", "://net/x",
]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in urls.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def agree(rows, by_id):
    for r in rows:
        host, path, rule, verdict = plain(by_id[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.p_block >= 0.5 else "allow"))


def test_odd_urls(spark):
    by_id = dict(enumerate(ODD))
    pages = spark.createDataFrame([(i, u, "x", 1.0) for i, u in by_id.items()] * 2, "page_id long, url string, host string, _p double")
    rows = urls.judge(pages, urls.fit(urls.labelled_urls(spark))).collect()
    assert len(rows) == 2 * len(ODD)
    agree(rows, by_id)
    assert urls.judge(pages.limit(0), 0.0).collect() == []
    assert {r.p_block for r in urls.judge(pages, 1.0, rules=[]).collect()} == {1.0}


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    by_id = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = urls.query(spark, folder).collect()
    assert len(rows) == len(by_id)
    agree(rows, by_id)


def test_model_on_unseen_urls(spark):
    model = urls.fit(urls.labelled_urls(spark))
    bad = ["http://spam-farm.example.org/en/1", "https://www.cheap-pills.example.com/fr/176/", "http://m.free-bets.example.com/en/27", "https://casino-win.com/slots"]
    good = ["http://blog.thering.example.com/en/328/", "https://www.ththti.example.com/es/380", "https://library.org/books/12", "http://ththin.example.com/fr/92.html"]
    rows = urls.judge(spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string"), model, rules=[]).collect()
    assert [r.verdict for r in sorted(rows, key=lambda r: r.page_id)] == ["block"] * 4 + ["allow"] * 4


def test_one_kind_of_label(spark):
    labelled = urls.labelled_urls(spark)
    assert urls.fit(labelled.where("blocked")) == 1.0 and urls.fit(labelled.limit(0)) == 0.0
    again = [urls.fit(labelled).stages[-1].coefficients.toArray().tolist() for _ in range(2)]
    assert again[0] == again[1]
