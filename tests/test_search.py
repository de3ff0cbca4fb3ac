import pytest
from pyspark.sql import functions as F

from quire.operators.search import expected_places, filter_tier, first_tier, index_hits, scores, search_terms, summary, text_search, top_places, topic_words

SCHEMA = "rel string, folder string, type string, title string, description string, tags array<string>, status string, frontmatter string"
PAGES = [
    ("systems/dns.md", "systems", "Concept", "DNS", "Resolves host names to addresses.", ["networking"], "stable", "{}"),
    ("systems/dhcp.md", "systems", "Concept", "DHCP", "Leases addresses to hosts.", ["networking"], "stable", '{"verified": {"by": "human:x"}}'),
    ("data/parquet.md", "data", "Concept", "Parquet", "Columnar file format.", None, "stable", "{}"),
]
TEXTS = {"systems/dns.md": "DNS Resolves host names to addresses. Recursive resolvers cache.", "systems/dhcp.md": "DHCP Leases addresses to hosts. Leases expire; see resolvers.", "data/parquet.md": "Parquet Columnar file format. Row groups and zstd compression.", "index.md": "zstd zstd", ".h/x.md": "zstd"}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(PAGES, SCHEMA), spark.createDataFrame(list(TEXTS.items()), "rel string, text string")


def test_words():
    assert search_terms("a C++ of dns-names!") == ["dns-names"] and search_terms("a b") == ["a b"] and search_terms(" ") == []
    assert topic_words("What are the columns") == ["columns"]


def test_text_search(spark, corpus):
    docs = spark.createDataFrame([("dns.md", "title: DNS description: names\nDNS resolves names. DNS caches answers. dns"), ("tcp.md", "TCP carries DNS sometimes."), ("n.md", None)], "rel string, text string")
    assert [tuple(r) for r in text_search(docs, "dns names").collect()] == [("dns.md", 6), ("tcp.md", 1)]
    assert text_search(docs, "").count() == 0 and text_search(docs.limit(0), "dns").count() == 0
    assert [r.rel for r in text_search(corpus[1], "zstd").collect()] == ["data/parquet.md"]


@pytest.mark.parametrize(("query", "want"), [("columnar storage layout", []), ("columnar format layout", ["data/parquet.md"]), ("columnar", ["data/parquet.md"]), ("what are the columns", [])])
def test_index(corpus, query, want):
    assert [r.rel for r in index_hits(corpus[0], [query]).collect()] == want


def test_first_tier(corpus):
    got = top_places(first_tier(*corpus, ["addresses hosts resolvers"]), 10).orderBy("place_no").collect()
    assert [r.rel for r in got] == ["systems/dhcp.md", "systems/dns.md"]


def test_evaluation(spark, corpus):
    questions = ["How are host names resolved?", "Which compression does zstd give?", "Which pages are about networking?", "Where is the kubernetes scheduler described?"]
    filters = [{}, {}, {"tag": "networking", "folder": "systems"}, {}]
    expected = spark.createDataFrame([(1, "systems/dns.md"), (2, "data/parquet.md"), (3, "Systems/DHCP.md"), (3, "systems/dns.md"), (4, "data/parquet.md")], "qid int, rel string")
    one = scores(expected_places(first_tier(*corpus, questions), expected), 10)
    got = {r.qid: (r.n_found, r.n_expected, r.first_place) for r in one.collect()}
    assert got[1] == (1, 1, 1) and got[2] == (1, 1, 1) and got[4] == (0, 1, None)
    ranking = filter_tier(corpus[0], filters)
    places = expected_places(ranking, expected.where("qid = 3"))
    assert {r.rel: r.place_no for r in places.collect()} == {"Systems/DHCP.md": 1, "systems/dns.md": 2}
    assert scores(places, 1).first().recall == 0.5 and summary(scores(places), "filters", 0.9).first().passed
    assert not summary(one, "index+text", 0.9).first().passed and summary(one.limit(0), "x").first().recall is None
    assert filter_tier(corpus[0], [{"trust": "human-reviewed"}]).select("rel").collect()[0].rel == "systems/dhcp.md" and filter_tier(corpus[0], [{}]).count() == 0
    assert top_places(ranking, 1).select(F.count("*")).first()[0] == 1
