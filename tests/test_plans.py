"""End-to-end plans on small literal sites."""

from pyspark.sql import functions as F

from corpusflow.operators import extract, recommend
from corpusflow.operators.crawl import retry_single
from corpusflow.plans.ingest import crawl_sites

CHUNK = ("chunk_id string, tenant_id string, source_url string, title string, content string, language string, "
         "is_active boolean, crawled_at timestamp, embedding array<float>")


def page(title, links=(), words=120):
    body = f"{title} words of this page " * words
    return f"<html><title>{title}</title><body><article><p>{body}</p>" + "".join(f"<a href='{u}'>x</a>" for u in links) + "</article></body></html>"


def sites(spark):
    tenants = spark.createDataFrame([("a", "https://a.example.com/", ["a.example.com"]), ("b", "https://b.example.com/", ["b.example.com"])],
                                    "tenant_id string, base_url string, allowed_domains array<string>")
    pages = spark.createDataFrame(
        [(f"https://a.example.com/{i}", page(f"A{i}")) for i in range(4)]
        + [("https://b.example.com/", page("B", ["/1", "/2#x", "/pic.jpg", "https://a.example.com/0"])),
           ("https://b.example.com/1", page("B1", ["/", "/3"])), ("https://b.example.com/3", page("B3", ["/4"])),
           ("https://b.example.com/4", page("B4"))], "url string, html string")
    maps = spark.createDataFrame([("https://a.example.com/sitemap.xml", "<urlset>" + "".join(
        f"<url><loc>https://a.example.com/{i}</loc></url>" for i in range(4)) + "</urlset>")], "sitemap_url string, xml string")
    return tenants, pages, maps


def test_crawl_by_sitemap_and_by_links(spark):
    tenants, pages, maps = sites(spark)
    old = spark.createDataFrame([("old", "a", "https://a.example.com/old", "T", "c", "de", True, None, None),
                                 ("keep", "z", "https://z/1", "T", "c", "de", True, None, None)], CHUNK)
    table, verdicts = crawl_sites(tenants, pages, maps, old, max_depth=2, max_pages=50)
    urls = {(r["tenant_id"], r["source_url"]) for r in table.collect()}
    assert urls == {("z", "https://z/1"), *[("a", f"https://a.example.com/{i}") for i in range(4)],
                    *[("b", f"https://b.example.com/{p}") for p in ("", "1", "3")]}
    assert {r["tenant_id"]: r["retry"] for r in verdicts.collect()} == {"a": False, "b": False}
    assert table.filter("tenant_id = 'a' AND size(embedding) = 64").count() == 4


def test_without_limits_all_linked_pages_are_found(spark):
    tenants, pages, maps = sites(spark)
    old = spark.createDataFrame([], CHUNK)
    table, _ = crawl_sites(tenants, pages, maps, old)
    assert {r["source_url"] for r in table.filter("tenant_id = 'b'").collect()} == {f"https://b.example.com/{p}" for p in ("", "1", "3", "4")}


def test_links_lead_to_every_allowed_host(spark):
    tenants = spark.createDataFrame([("a", "https://a.example.com/", ["a.example.com", "WWW.a.example.com"])],
                                    "tenant_id string, base_url string, allowed_domains array<string>")
    pages = spark.createDataFrame([("https://a.example.com/", page("A", ["https://www.a.example.com/1", "https://b.example.com/"])),
                                   ("https://www.a.example.com/1", page("A1", ["https://a.example.com/2"])), ("https://a.example.com/2", page("A2")),
                                   ("https://b.example.com/", page("B"))], "url string, html string")
    maps = spark.createDataFrame([], "sitemap_url string, xml string")
    table, verdicts = crawl_sites(tenants, pages, maps, spark.createDataFrame([], CHUNK))
    assert {r["source_url"] for r in table.collect()} == {"https://a.example.com/", "https://www.a.example.com/1", "https://a.example.com/2"}
    assert not verdicts.first()["retry"]


def test_second_pass_reads_pages_that_gave_nothing(spark):
    tenants = spark.createDataFrame([("a", "https://a.example.com/", ["a.example.com"])],
                                    "tenant_id string, base_url string, allowed_domains array<string>")
    html = "<body><div class='content'>x</div><div id='app'>" + "text of the rendered part " * 40 + "<a href='/1'>more</a></div></body>"
    pages = spark.createDataFrame([("https://a.example.com/", html), ("https://a.example.com/1", html)], "url string, html string")
    maps = spark.createDataFrame([], "sitemap_url string, xml string")
    table, verdicts = crawl_sites(tenants, pages, maps, spark.createDataFrame([], CHUNK))
    assert verdicts.first()["pages"] == 0 and verdicts.first()["retry"]
    assert {r["source_url"] for r in table.collect()} == {"https://a.example.com/", "https://a.example.com/1"}


def test_sitemaps_nested_deeply(spark):
    from corpusflow.sources.sitemap import sitemap_urls

    def index(i):
        return f"<sitemapindex><sitemap><loc>https://a/{i + 1}.xml</loc></sitemap><sitemap><loc>https://a/0.xml</loc></sitemap></sitemapindex>"

    docs = spark.createDataFrame([(f"https://a/{i}.xml", index(i)) for i in range(12)]
                                 + [("https://a/12.xml", "<urlset><url><loc>https://a/page</loc></url></urlset>")], "sitemap_url string, xml string")
    candidates = spark.createDataFrame([("t", 0, "https://a/0.xml")], "tenant_id string, priority int, sitemap_url string")
    allowed = spark.createDataFrame([("t", "a")], "tenant_id string, host string")
    assert [tuple(r) for r in sitemap_urls(docs, candidates, allowed).collect()] == [("t", "https://a/page")]


def test_vectors_of_different_sizes_raise(spark):
    import pytest

    from corpusflow.operators import retrieve

    chunks = spark.createDataFrame([("1", "a", [1.0, 0.0])], "chunk_id string, tenant_id string, embedding array<float>")
    for vectors in ([[1.0, 0.0, 0.0]], [[1.0, 0.0], [1.0, 0.0, 0.0]]):
        queries = spark.createDataFrame([(str(i), "a", v) for i, v in enumerate(vectors)], "query_id string, tenant_id string, embedding array<float>")
        with pytest.raises(Exception, match="vectors of different sizes"):
            retrieve.search(queries, chunks).collect()


def test_names_are_no_patterns(spark):
    from corpusflow.operators.textmodel import cue_match

    df = spark.createDataFrame([("abc",), ("a.c (x)",)], "text string")
    assert [r[0] for r in df.select(cue_match(F.col("text"), {"names": ["a.c (x)"]})).collect()] == [False, True]


def test_incremental_crawl_adds_only_new_pages(spark):
    tenants, pages, maps = sites(spark)
    old = spark.createDataFrame([("old", "a", "HTTPS://a.example.com/0", "T", "c", "de", True, None, None)], CHUNK)
    table, verdicts = crawl_sites(tenants, pages, maps, old, incremental=True)
    assert {r["source_url"] for r in table.collect()} == {"HTTPS://a.example.com/0", *[f"https://a.example.com/{i}" for i in (1, 2, 3)]}
    assert not any(r["retry"] for r in verdicts.collect())


def test_short_pages_use_the_rendered_profile(spark):
    html = "<body><article>tiny</article><div id='app'>" + "text of the rendered part " * 5 + "</div></body>"
    pages = spark.createDataFrame([("https://a/1", html), ("https://a/2", page("T"))], "url string, html string")
    again = retry_single(extract.parse_pages(pages), pages)
    assert again.count() == 0  # the article still comes first in both profiles
    bare = spark.createDataFrame([("https://a/1", html.replace("article", "span"))], "url string, html string")
    assert extract.extract_chunks(bare, "rendered").first()["content"].startswith("text of the rendered part")


def test_catalog_adds_unlocated_tenants_with_region_hits(spark):
    tenants = spark.createDataFrame([("a", "A", "Tirol", "X", "C", "a.at", True), ("b", "B", None, None, "C", "b.at", True),
                                     ("c", "D", "Wien", "Y", "C", "c.at", True), ("d", "E", None, None, "C", "d.at", True)],
                                    "tenant_id string, name string, region string, location string, country string, domain string, is_active boolean")
    chunks = spark.createDataFrame([("1", "b", [1.0, 0.0]), ("2", "c", [1.0, 0.0]), ("3", "d", [0.0, 1.0])],
                                   "chunk_id string, tenant_id string, embedding array<float>")
    queries = spark.createDataFrame([("q", "Tirol", [1.0, 0.1]), ("r", None, None)], "query_id string, region string, embedding array<float>")
    out = recommend.catalog(queries, tenants, chunks)
    assert {r["tenant_id"] for r in out.filter("query_id = 'q'").collect()} == {"a", "b"}
    rows = out.filter("query_id = 'r'").orderBy("position").collect()
    assert [r["position"] for r in rows] == [1, 2, 3, 4] and {r["tenant_id"] for r in rows} == set("abcd")
    assert any(r["line"].endswith("A — X, Tirol (id: a)") for r in rows)


def test_batch_gate_context_pending_and_state(spark):
    from corpusflow.operators import textmodel as tm
    from corpusflow.operators.extract import embed_texts
    from corpusflow.plans.recommend_batch import PENDING, Models, recommend_batch

    texts = [("de", "das hotel hat einen garten und die sauna ist schön"), ("en", "the hotel has a garden and the sauna is nice"),
             ("en", "more sources please for the hotel with sauna"), ("de", "weitere quellen bitte für das hotel mit sauna")]
    language = tm.train_nb(spark.createDataFrame(texts, "label string, text string"))
    tenants = spark.createDataFrame([("a", "Hotel Adler", "Tirol", "Imst", "A", "a.at", True, 47.0, 11.0, False), ("b", "Hotel Berg", "Wien", "Wien", "A", "b.at", True, 48.0, 16.0, False)],
                                    "tenant_id string, name string, region string, location string, country string, domain string, is_active boolean, latitude double, longitude double, has_lift boolean")
    rows = [("1", "a", "Sauna", "quiet sauna garden with seven plain words more here now", "https://a.at/1"), ("2", "b", "Bar", "bar and music", "https://b.at/2")]
    chunks = embed_texts(spark.createDataFrame(rows, "chunk_id string, tenant_id string, title string, content string, source_url string").withColumn("is_active", F.lit(True)))
    turns = spark.createDataFrame([("s1", 0, "user", "quiet sauna garden please"), ("s2", 0, "user", "more sources please")],
                                  "session_id string, turn int, role string, text string")
    held = spark.createDataFrame([("s2", 2, "Hotel B", 0.5, "https://b"), ("s2", 1, "Hotel A", 0.75, "https://a"), ("s3", 1, "Hotel C", 0.4, "https://c")], PENDING)

    def answer(questions, summaries, contexts):
        return [f"{s} <{c.count('[Result ')}>" for s, c in zip(summaries, contexts)]

    def run(relevant):
        out = recommend_batch(turns, chunks, tenants, Models(language, answer=answer, relevant=relevant), pending=held, configured=" 1 ")
        return {r["session_id"]: r for r in out.responses.collect()}, out

    rejected, _ = run(lambda questions, contexts: [False] * len(questions))
    assert rejected["s1"]["response_type"] == "no_results" and rejected["s1"]["answer"] is None
    kept, out = run(lambda questions, contexts: ["Section: Sauna" in c for c in contexts])
    assert kept["s1"]["response_type"] == "recommendations" and kept["s1"]["tenants"] == ["a"] and "<1>" in kept["s1"]["answer"]
    assert kept["s2"]["response_type"] == "more_sources" and kept["s2"]["answer"].endswith("- Hotel A (0.75): https://a\n- Hotel B (0.50): https://b")
    assert [r["session_id"] for r in out.pending.collect()] == ["s3"]
    state = {r["session_id"]: r for r in out.state.collect()}
    assert state["s1"]["focus_tenant"] == "a" and state["s1"]["tenants"] == ["a"] and state["s2"]["tenants"] is None


def test_upsert_resolves_repeats_without_an_order(spark):
    from corpusflow.sources.sinks import upsert_sessions

    old = spark.createDataFrame([("a", "x", 1)], "session_id string, messages string, updated_at int")
    new = spark.createDataFrame([("a", "y", 2), ("a", "z", 3), ("b", "n", 1), ("b", "n", 1)], "session_id string, messages string, updated_at int")
    assert sorted(r["session_id"] for r in upsert_sessions(old, new).collect()) == ["a", "b"]
