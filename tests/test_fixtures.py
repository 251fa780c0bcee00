"""Small literal cases: tags, language policy, distance ranking, sources, limits."""

import pytest
from pyspark.sql import functions as F

from corpusflow.functions.html import parse_page
from corpusflow.functions.policy import empty_state, step
from corpusflow.functions.text import truncate_sentence
from corpusflow.defaults import PLAIN_SELECTORS
from corpusflow.operators import crawl, extract, geo, recommend, report, sessions, turns
from corpusflow.sources import corpus, querylog, sinks, sitemap


def one(df):
    return df.first()[0]


@pytest.mark.parametrize("text, region", [
    ("Welche Hotels kennst du in Tirol?", "Tirol"), ("Something in Carinthia please", "Kärnten"),
    ("Wellness ohne Ort", None), ("South Tyrol", "Tirol")])
def test_region(spark, text, region):
    assert one(spark.range(1).select(turns.region_tag(F.lit(text)))) == region


@pytest.mark.parametrize("test, text, expected", [
    (turns.is_deictic, "Wieviele Zimmer gibt es dort?", True), (turns.is_deictic, "Welche Hotels in Tirol?", False),
    (turns.is_broad_catalog, "Which hotels do you know?", True),
    (turns.is_broad_catalog, "Ich suche ein Hotel mit Sauna in Tirol", False),
    (turns.is_broad_catalog, "Welche Hotels kennst du so nah an Salzburg-Stadt wie möglich?", False),
    (turns.is_more_sources, "more sources please", True), (geo.is_proximity, "nahe Salzburg", True),
    (geo.is_proximity, "Hotels in Salzburg", False), (geo.is_proximity, "Which hotel is closest to Zell am See?", True),
    (extract.is_resource, "https://example.com/photo.JPG", True), (extract.is_resource, "https://example.com/a.jpg?x=1", False)])
def test_flags(spark, test, text, expected):
    assert one(spark.range(1).select(test(F.lit(text)))) is expected


def test_places_are_claimed_longest_first():
    assert geo.places_in("near saalbach-hinterglemm and munich airport") == ["Skicircus Saalbach", "Flughafen München"]
    assert geo.places_in("im salzburger land") == []


def turn(text, ranked=(), code=None, unknown=None, unrecognized=False, hint=None, **flags):
    from corpusflow import defaults as d

    top = ranked[0][1] if ranked else 0
    close = [c for c, p in ranked if p >= d.MIN_CANDIDATE and (top - p <= d.CLOSE_MARGIN or p >= top * d.CLOSE_RATIO)][:4]
    sticky = {c for c, p in ranked if p >= d.STICKY_MIN} | set(close)
    base = {"text": text, "hint": hint, "marker": False, "shared": False, "cue": False, "choice": None,
            "affirmative": False, "close": close, "sticky": sorted(sticky), "code": code or (ranked[0][0] if ranked else None),
            "unknown": not ranked if unknown is None else unknown, "unrecognized": unrecognized}
    return {**base, **flags}


PENDING = {"locked": None, "first_unambiguous": False, "pending_codes": ["rm", "ca"], "pending_query": "Hotels mit Sauna"}
LOCKED = dict(empty_state(), locked="de", first_unambiguous=True)


@pytest.mark.parametrize("state, t, language, source, lock", [
    (None, turn("Hotels in Salzburg", [("de", .34), ("en", .32), ("nl", .28)], shared=True, cue=True), "de", "shared_vocab", None),
    (None, turn("Ich suche", [("de", .88), ("en", .06)], marker=True, cue=True), "de", "german_marker", "de"),
    (LOCKED, turn("Hotels in Salzburg", [("nl", .38), ("en", .30), ("de", .22)], shared=True, cue=True), "de", "sticky", "de"),
    (LOCKED, turn("Je cherche", [("fr", .91), ("de", .03)], cue=True), "fr", "switched", "fr"),
    (None, turn("京都のホテル", unrecognized=True), "en", "unrecognized_en", None),
    (None, turn("ok", affirmative=True), "de", "fallback_de", None),
    (PENDING, turn("Deutsch", choice="de"), "de", "choice", "de"),
    (None, turn("Hotels in Salzburg", [("nl", .97), ("de", .03)], hint="en", shared=True, cue=True), "en", "shared_vocab", "en"),
    (None, turn("Hotels in Tirol sauna", [("rm", .42), ("ca", .31)], cue=True), "de", "hotel_fallback", None),
    (PENDING, turn("Ja", affirmative=True), "de", "choice_default", "de")])
def test_language_policy(state, t, language, source, lock):
    after, got, why, text = step(dict(state) if state else empty_state(), t)
    assert (got, why, after["locked"], after["pending_codes"]) == (language, source, lock, None)
    if state is PENDING:
        assert text == "Hotels mit Sauna"


def test_choice_names(spark):
    rows = spark.createDataFrame([("English please",), ("de",), ("auf italienisch",), ("nothing",)], "t string")
    assert [r[0] for r in rows.select(turns.match_choice(F.col("t"))).collect()] == ["en", "de", "it", None]


TENANTS = [("t_city", "Stadthof", 47.839749, 13.022782, False), ("t_lift", "Talhof", 47.2374, 13.2009, True),
           ("t_far", "Lermoos", 47.4014, 10.8796, True), ("t_lake", "Achen", 47.4250, 11.7548, False)]


def rank(spark, text, n=3):
    tenants = geo.resolve_coordinates(spark.createDataFrame(TENANTS, "tenant_id string, name string, latitude double, longitude double, has_lift boolean")
                                      .withColumn("is_active", F.lit(True)))
    queries = geo.prepare(geo.parse_geo(spark.createDataFrame([("q", text)], "query_id string, text string")))
    hits = spark.createDataFrame([], "query_id string, tenant_id string, text_rank int")
    return geo.geo_rank(queries, tenants, hits, n).orderBy("geo_rank").collect()


def test_closest_first(spark):
    rows = rank(spark, "so nah an Salzburg-Stadt wie möglich")
    assert rows[0]["tenant_id"] == "t_city" and rows[0]["primary_km"] < 10 and not rows[0]["conflict"]


def test_conflict_names_both_poles(spark):
    rows = rank(spark, "nahe Salzburg-Stadt mit Skilift vor dem Hotel", 4)
    assert [r["tenant_id"] for r in rows[:1]] == ["t_city"] and all(r["conflict"] for r in rows)
    assert rows[1]["tenant_id"] == "t_lift"


def test_haversine(spark):
    km = one(spark.range(1).select(geo.haversine_km(F.lit(47.839749), F.lit(13.022782), F.lit(47.7982), F.lit(13.0465))))
    assert 3 < km < 8


def test_weighted_sources(spark):
    hits = spark.createDataFrame([("q", "hotel_a", "c1", .40, "low"), ("q", "hotel_a", "c2", .90, "high"), ("q", "hotel_a", "c3", .70, "mid"),
                                  ("q", "hotel_a", "c4", .60, "extra"), ("q", "hotel_b", "c5", .95, "x")],
                                 "query_id string, tenant_id string, chunk_id string, score double, source_url string")
    tenants = spark.createDataFrame([("hotel_a", "Hotel Seeblick"), ("hotel_b", "Hotel Gipfel")], "tenant_id string, name string")
    answers = spark.createDataFrame([("q", "Ich empfehle das Hotel Seeblick am Achensee.", "de")], "query_id string, answer string, language string")
    sources = recommend.weighted_sources(answers, hits, tenants)
    assert [(r["url"], r["is_primary"]) for r in sources.orderBy("position").collect()] == [("high", True), ("mid", True)]
    section = one(recommend.sources_section(sources, answers).select("section"))
    assert "(0.90)" in section and "Gipfel" not in section


def test_result_count(spark):
    rows = spark.createDataFrame([("3",), ("0",), ("21",), ("x",), (None,), (" 20 ",)], "v string")
    assert [r[0] for r in rows.select(recommend.result_count(F.col("v"))).collect()] == [3, 3, 3, 3, 3, 20]


def test_verdict_limits(spark):
    rows = [("a", 2, None, 900.0), ("b", 3, None, 900.0), ("c", 19, 100, 900.0), ("d", 20, 100, 900.0), ("e", 5, 5, 499.0), ("f", 5, 5, 500.0)]
    out = crawl.verdict_of(spark.createDataFrame(rows, "tenant_id string, pages long, expected long, avg_length double"))
    assert [r["reason"] for r in out.orderBy("tenant_id").collect()] == ["few_pages", None, "low_coverage", None, "short_content", None]


def test_health_limits(spark):
    stats = spark.createDataFrame([("a", 0), ("b", 9), ("c", 10), ("d", 29), ("e", 30)], "tenant_id string, chunks long")
    maps = spark.createDataFrame([("e", 45, "found")], "tenant_id string, sitemap_urls long, sitemap_status string")
    out = report.crawl_health(stats, maps).orderBy("tenant_id").collect()
    assert [r["status"] for r in out] == ["not_crawled", "problematic", "warning", "warning", "good"]
    assert out[4]["coverage"] == "66.7%" and out[0]["coverage"] == "n/a"


@pytest.mark.parametrize("index, length", [(12000, 15000), (12001, 12002)])
def test_truncation_boundary(spark, index, length):
    text = "a" * index + "." + "a" * (15000 - index)
    assert one(spark.range(1).select(F.length(truncate_sentence(F.lit(text))))) == length


def test_html_page():
    html = ("<html><head><title>A &amp; B</title><script>var t='</p>';</script></head><body><nav><a href='/n'>menu item</a></nav>"
            "<div class='x content'>outer words<p>first para<p>second para &lt;x&gt;<br>abc</div><footer>foot notes</footer></body></html>")
    title, content, hrefs = parse_page(html, PLAIN_SELECTORS)
    assert title == "A & B" and content == "outer words\nfirst para\nsecond para <x>\n" and hrefs == ["/n"]
    assert parse_page("<title></title><h1>H</h1>", PLAIN_SELECTORS)[0] == ""
    assert parse_page("<h1>Head</h1>", PLAIN_SELECTORS)[0] == "Head"


def test_bfs_cycle_cap_and_case(spark):
    edges = spark.createDataFrame([("t", "/a", 0, "/b"), ("t", "/a", 1, "/c"), ("t", "/b", 0, "/a"), ("t", "/b", 1, "/D"),
                                   ("t", "/c", 0, "/d"), ("t", "/D", 0, "/e")], "tenant_id string, url string, position int, link string")
    seeds = spark.createDataFrame([("t", "/a")], "tenant_id string, url string")
    plain = {r["url"]: r["depth"] for r in crawl.crawl_bfs(seeds, edges, max_depth=2, max_pages=None).collect()}
    assert plain == {"/a": 0, "/b": 1, "/c": 1, "/D": 2, "/d": 2}
    folded = {r["url"] for r in crawl.crawl_bfs(seeds, edges, max_depth=2, max_pages=None, ignore_case=True).collect()}
    assert folded == {"/a", "/b", "/c", "/D"}
    fetched = spark.createDataFrame([("t", u) for u in ("/a", "/c", "/D", "/d")], "tenant_id string, url string")
    capped = {r["url"] for r in crawl.crawl_bfs(seeds, edges, fetched, 2, 3).collect()}
    assert capped == {"/a", "/c", "/D"}


def test_sitemap_index_and_broken_file(spark):
    docs = spark.createDataFrame([
        ("https://h/sitemap.xml", "<sitemapindex><sitemap><loc>https://h/1.xml</loc></sitemap><sitemap><loc>https://h/2.xml</loc></sitemap><sitemap><loc>https://h/bad.xml</loc></sitemap></sitemapindex>"),
        ("https://h/1.xml", "<urlset><url><loc> https://h/p?a=1&amp;b=2 </loc></url></urlset>"),
        ("https://h/2.xml", "<urlset><url><loc>https://other/x</loc></url><url><loc>https://h/q</loc></url></urlset>"),
        ("https://h/bad.xml", "<urlset><url><loc>https://h/never</loc></url>")], "sitemap_url string, xml string")
    cand = spark.createDataFrame([("t", 0, "https://h/sitemap.xml")], "tenant_id string, priority int, sitemap_url string")
    allowed = spark.createDataFrame([("t", "h")], "tenant_id string, host string")
    assert {r["url"] for r in sitemap.sitemap_urls(docs, cand, allowed).collect()} == {"https://h/p?a=1&b=2", "https://h/q"}


def test_query_log_round_trip(spark, tmp_path):
    sep = querylog.SEPARATOR
    text = (sep + "\n[2026-01-02 03:04:05]  ANFRAGE OK\n  Query    : Sauna?\n  Language : de\n  Prompt   : p.key\n\n  ┌─ x\n  │ Query : no\n  └─\n\n"
            "  Ergebnis : JA  →  weiter\n\n" + sep + "\n[2026-01-02 04:04:05]  KEINE-TREFFER  (alle)\n  Query    : Pool\n  Language : en\n  Prompt   : p2\n\n"
            "  Hotel    : A  →  PASST:NEIN\n           | text\n  Hotel    : B  →  PASST:JA\n\n")
    (tmp_path / "2026-01-02.txt").write_text(text, encoding="utf-8")
    rows = querylog.read_query_log(spark, str(tmp_path)).orderBy("ts").collect()
    assert (rows[0]["query"], rows[0]["language"], rows[0]["prompt_key"], rows[0]["decision"]) == ("Sauna?", "de", "p.key", "JA")
    assert [(v["name"], v["matches"]) for v in rows[1]["verdicts"]] == [("A", False), ("B", True)]
    sinks.append_query_log(querylog.read_query_log(spark, str(tmp_path)), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("day = DATE'2026-01-02'").count() == 2


def test_labelled_reader(spark, tmp_path):
    path = tmp_path / "c.tsv"
    path.write_text("label\ttext\n# note\n\nde\tGuten Tag\nbroken line\nen\tHello\tthere\n", encoding="utf-8")
    assert sorted(map(tuple, corpus.read_labeled_tsv(spark, str(path)).collect())) == [("de", "Guten Tag"), ("en", "Hello\tthere")]
    with pytest.raises(ValueError):
        corpus.read_labeled_tsv(spark, str(path), strict=True, known=["de", "en"])
    with pytest.raises(ValueError):
        corpus.read_labeled_tsv(spark, str(path), known=["de", "en", "fr"], require_all=True)


def test_enrichment(spark):
    def enrich(text, region, focus, name):
        return one(spark.range(1).select(sessions.enrich_query(*[F.lit(v).cast("string") for v in (text, region, focus, name)])))

    assert enrich("Zu welchen Hotels hast du Informationen?", "Tirol", None, None).endswith("Tirol")
    assert enrich("Wieviele Zimmer gibt es dort?", "Tirol", "h", "Bergruh") == "Bergruh Wieviele Zimmer gibt es dort?"
