import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import crawl, html
from tessera.plans.queries import LASTMODS, ORACLES, QUERIES, SITE_PAGES, SITEMAPS
from tessera.sources import tables
from tessera.streaming import ingest


def test_generic_text(spark):
    page = "<html><head><title>T</title><script>x</script></head><body><nav>n</nav><!-- c --><p>One <b>two</b></p><p>a &amp; b &lt;c&gt;</p></body></html>"
    got = spark.createDataFrame([(page,), (None,), ("",)], "h string").select(html.generic_text(F.col("h"))).collect()
    assert [r[0] for r in got] == ["T\nOne\ntwo\na & b <c>", "", ""]


def test_site_rules(spark):
    rows = html.with_clean_text(spark.createDataFrame(SITE_PAGES, "page_id long, source_name string, html string")).collect()
    assert {r["page_id"]: r["clean_text"] for r in rows} == {1: "Main\ntext", 2: "Post\ntwo", 3: "Only body", 4: "Kept", 5: "All & everything", 6: "generic\nrule", 7: ""}


def test_class_search_is_unanchored():
    assert html.site_text("<body><div class='shadow'>x</div><p>y</p></body>", html.SITE_B) == "y"


def test_corpus_statistics(spark):
    rows = [("<p>ab</p>", "www.stopgame.ru", "ab"), (None, "PlayGround.ru", ""), ("<i></i>", None, "")]
    got = html.corpus_statistics(spark.createDataFrame(rows, "html string, source_name string, clean_text string")).first().asDict()
    assert got["total_documents"] == 3 and got["documents_from_stopgame"] == 1 and got["documents_from_playground"] == 1
    assert got["avg_doc_clean_size_kb"] == 2 / 3 / 1024 and got["min_doc_clean_size_kb"] == 2 / 1024 and got["min_doc_raw_size_kb"] == 7 / 1024
    empty = html.corpus_statistics(spark.createDataFrame([], "html string, source_name string, clean_text string")).first().asDict()
    assert set(empty.values()) == {0}


def test_source_name_keeps_port_and_user(spark):
    urls = ["https://u:p@h.example:80/x?y", "http://a.example", "mailto:x", None]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(crawl.source_name(F.col("u"))).collect()] == ["u:p@h.example:80", "a.example", "", ""]


@pytest.mark.parametrize("sitemap,url,want", [("https://s.example/news_1.xml", "https://s.example/news/64976/", "https://s.example/newsdata/64976/"), ("https://other/x.xml", "https://s.example/news/1/", "https://s.example/news/1/"), ("https://s.example/news_2.xml", "https://s.example/news/2/", "second")])
def test_rewrite(spark, sitemap, url, want):
    rules = [crawl.RewriteRule("https://s.example/", "(bad", "x"), crawl.RewriteRule("https://s.example/news_1*", r"^https://s\.example/news/(.+)$", r"https://s.example/newsdata/\1"), crawl.RewriteRule("https://s.example/", "^https://.*$", "second"), crawl.RewriteRule("https://s.example/", "^https://.*$", "third")]
    assert spark.range(1).select(crawl.rewrite(F.lit(url), F.lit(sitemap), rules)).first()[0] == want


def test_lastmod(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in LASTMODS], "s string").select(crawl.lastmod_epoch(F.col("s"))).collect()]
    assert got == [1704153845, 1704153845, 1704164645, 1704164645, 1704153600, None, None, None]


def test_crawl_plan(spark):
    now = 1_706_745_600
    cache = spark.createDataFrame([("new", "2024-01-01"), ("fresh", "2024-02-01"), ("same", "2023-01-01"), ("changed", "2024-01-20"), ("bad", "x"), ("zero", "2024-01-20")], "url string, lastmod string")
    store = spark.createDataFrame([("fresh", now - 10.0), ("same", 1704067200.0), ("changed", 1704067200.0), ("bad", 1704067200.0), ("zero", 0.0)], "url string, crawl_time double")
    got = {r["url"]: r["needs_crawl"] for r in crawl.crawl_plan(cache, store, now).collect()}
    assert got == {"new": True, "fresh": False, "same": False, "changed": True, "bad": False, "zero": False}


def test_sitemaps(spark):
    rows = tables.sitemap_entries(spark.createDataFrame(SITEMAPS, "sitemap_url string, body string"), most=3).collect()
    assert sorted((r["url"], r["lastmod"]) for r in rows) == [("https://a.example/1", "2024-01-01"), ("https://a.example/1", "2024-02-01"), ("https://a.example/3", "2024-01-03")]


def test_queue_and_cache(spark):
    entries = spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("a", "3", 3)], "url string, lastmod string, seq int")
    assert sorted((r["url"], r["lastmod"]) for r in crawl.sitemap_cache(entries, "seq").collect()) == [("a", "3"), ("b", "2")]
    queue = crawl.enqueue(spark.createDataFrame([(4, "b")], "seq long, url string"), entries)
    assert [tuple(r) for r in crawl.dequeue(queue, 5).collect()] == [(4, "b"), (5, "a")]


def test_options():
    got = crawl.CrawlOptions.of({"logic": {"sitemaps": ["s"], "url_transforms": [{"sitemap_pattern": "p", "pattern": "a", "replacement": "b"}]}})
    assert got.interval_seconds == 86_400 and got.state_dir == "crawler_state" and got.max_urls_per_sitemap == 0 and got.url_transforms[0].valid()


def test_upsert_is_idempotent(spark):
    store = spark.createDataFrame([], tables.PAGE_SCHEMA)
    pages = spark.createDataFrame([("https://b.example/", "x", 1.0), ("https://a.example/", "y", 1.0), ("https://a.example/", "z", 2.0)], ingest.LANDING)
    once = crawl.upsert(store, pages).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["url"], r["html"], r["source_name"]) for r in once] == [(1, "https://a.example/", "z", "a.example"), (2, "https://b.example/", "x", "b.example")]
    assert crawl.upsert(spark.createDataFrame(once, tables.PAGE_SCHEMA), pages).orderBy("doc_id").collect() == once


def test_text_directory_and_state(spark, tmp_path):
    d = tmp_path / "t"
    d.mkdir()
    for name, body in {"1.txt": "one", "20.txt": "two\nlines", "x.txt": "no", "3.txt": "", "4.txt.bak": "no"}.items():
        (d / name).write_text(body)
    assert sorted(map(tuple, tables.text_directory(spark, str(d)).collect())) == [(1, "one", 3), (20, "two\nlines", 9)]
    path = str(tmp_path / "state")
    assert tables.load_state(spark, path, "seq long, url string").count() == 0
    tables.save_state(spark.createDataFrame([(1, "a")], "seq long, url string"), path)
    assert [tuple(r) for r in tables.load_state(spark, path, "seq long, url string").collect()] == [(1, "a")]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"https://s.example/{i % 5}", f"v{i}", float(i)) for i in range(9)]
    for k in range(3):
        spark.createDataFrame(rows[3 * k : 3 * k + 3], ingest.LANDING).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
    for _ in range(2):  # a second start finds nothing new
        ingest.ingest(ingest.landing_stream(spark, str(tmp_path / "landing")), str(tmp_path / "store"), str(tmp_path / "checkpoint")).awaitTermination()
    got = ingest.read_store(spark, str(tmp_path / "store")).collect()
    assert len({r["doc_id"] for r in got}) == 5
    assert {r["url"]: r["crawl_time"] for r in got} == {f"https://s.example/{i % 5}": float(i) for i in range(9)}


def test_incremental_index_equals_rebuild(spark):
    from tessera.operators.index import posting_blocks, postings

    before = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    change = spark.createDataFrame([(2, "c d"), (3, "a")], "doc_id long, text string")
    after = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "a")], "doc_id long, text string")
    build = lambda d: posting_blocks(postings(d, "doc_id", "text"), "doc_id")
    order = lambda d: [tuple(r) for r in d.orderBy("term", "block").collect()]
    assert order(ingest.merge_index(build(before), change)) == order(build(after))


def test_rewrite_rules_of_both_syntaxes(spark):
    rules = (
        crawl.RewriteRule("s", r"^https://(?P<host>[a-z_]+)/(?P<n>\d+)(?P=n)$", r"https://\g<host>/$\g<n>\\"),
        crawl.RewriteRule("s", r"(?P<broken", "never"),
        crawl.RewriteRule("s", r"x(?(1)a|b)", "only the first syntax has it"),
        crawl.RewriteRule("s", r"^(a)(b)", r"\2$1"),
    )
    rows = [("https://h_t/1212",), ("abc",), ("other",), (None,)]
    got = spark.createDataFrame(rows, "url string").select(crawl.rewrite(F.col("url"), F.lit("s1"), rules).alias("u")).collect()
    assert [r["u"] for r in got] == ["https://h_t/$12\\", "b$1c", "other", None]


def test_lastmod_is_in_utc_in_any_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = [("2024-01-02",), ("2024-01-02T03:04:05",), ("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05+0300",), ("2024-01-02T03:04:05+03:00",), ("2024-01-02T03:04:05.5Z",), ("bad",), (None,)]
        got = [r["e"] for r in spark.createDataFrame(rows, "t string").select(crawl.lastmod_epoch(F.col("t")).alias("e")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [1704153600, 1704164645, 1704164645, 1704153845, 1704153845, None, None, None]


def test_deep_pages_and_all_entities(spark):
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    rows = [(1, html.SITE_A, f"<body>{deep}</body>"), (2, "x", "<p>caf&eacute; &rsquo;&#1071;&#x41; &amp;rsquo;</p><p>&copy; a & b</p>"), (3, "x", "<p>&amp;copy; &lt;b&gt;</p>")]
    got = {r["k"]: r["clean_text"] for r in html.with_clean_text(spark.createDataFrame(rows, "k int, source_name string, html string")).collect()}
    assert got == {1: "core", 2: "café ’ЯA &rsquo;\n© a & b", 3: "&copy; <b>"}


def against_sql(spark, folder, name: str, pages: list[tuple]) -> tuple[list, list]:
    """Rows of the query and of its SQL over these pages (page_id, url, html)."""
    path = f"{folder}/pages.parquet"
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).select(*columns).collect()), key=repr), sorted(found.fetchall(), key=repr)


#: Each url comes on several pages, the later ones first.
REPEATED = [(i, f"https://h{i % 7}.example/{i % 11}", "x") for i in reversed(range(400))]


def test_upsert_of_repeated_urls(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "crawl_upsert", REPEATED)
    assert got == want and len(got) == 77


def test_plan_of_repeated_urls(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "crawl_plan", REPEATED)
    assert got == want and len(got) == 77


@pytest.mark.parametrize("name", ["html_clean_text", "corpus_size_stats"])
def test_odd_pages_against_sql(spark, tmp_path, name):
    odd = ["a&amp", "caf&eacute; &amp;amp; &#65;", "<ſcript>gone</SCRIPT>t", "<scrıpt>stays</scrıpt>", "<formé>gone</form>t", "<formſ>gone</form>t", "<forms>t</forms>", "a \u2028", "\x0b a \x0b\nb\x0b", "a\x85", "\x1c\na\xa0\n", "<nav>n</nav\x0b>t</nav\f>", "<p>a\r\n\t b </p>\n\n", "<script>open", "<!-- open", "", None]
    urls = ["https://stopgame.ru/1", "http://playground.ru/2", "https://x.example/3", "none", None]
    rows = [(len(urls) * i + k, u, h) for i, h in enumerate(odd) for k, u in enumerate(urls)] + [(1000 + r[0], f"https://{r[1]}/", r[2]) for r in SITE_PAGES]
    got, want = against_sql(spark, tmp_path, name, rows)
    assert got == want and got
