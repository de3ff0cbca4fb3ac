import __spark_entry__ as entry
from pyspark.sql import functions as F

from quire.functions.strings import acronym, jaccard, slug, tokens
from quire.operators import graph
from quire.operators.graph import analysis, colink_gaps, component_sizes, components, degrees, orphans, pagerank, tag_cohesion
from quire.plans import skew
from quire.queries.reference import snapshot_changes
from quire.session import is_single_machine


def test_names(spark):
    df = spark.createDataFrame([("C++ & Écoles",), ("Domain-specific languages",), ("C#",), ("",), (None,)], "s string")
    rows = df.select(slug(F.col("s")), tokens(F.col("s")), acronym(tokens(F.col("s")))).collect()
    assert rows[0][0] == "cpp-ecoles" and rows[1][1] == ["domain", "specific", "language"] and rows[1][2] == "dsl" and rows[2][1] == ["csharp"]
    assert rows[3][1] == [] and rows[4][0] is None


def test_fold(spark):
    df = spark.createDataFrame([("Žižek",), ("Ősz",), ("Œuvre",), ("ＡＢＣ",), ("Straße",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(slug(F.col("s"))).collect()] == ["zizek", "osz", "uvre", "abc", "strasse", None, ""]


def test_components_and_islands(spark):
    nodes = spark.createDataFrame([(c, "Concept") for c in "abcdefgh"], "rel string, type string")
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "d"), ("d", "a"), ("f", "e"), ("g", "g")], "src string, dst string")
    labels = {r.rel: r.component for r in components(nodes, e).collect()}
    assert labels == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e", "g": "g", "h": "h"}
    sizes = {r.component: (r.n_pages, r.members) for r in component_sizes(components(nodes, e)).collect()}
    assert sizes == {"a": (4, None), "e": (2, ["e", "f"]), "g": (1, None), "h": (1, None)}
    assert components(nodes, e.limit(0)).count() == 8 and components(nodes.limit(0), e.limit(0)).count() == 0


def test_pagerank_with_a_hub(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"n{i}", "Concept") for i in range(40)], "rel string, type string")
    links = [("n0", f"n{i}") for i in range(1, 40)] + [(f"n{i}", f"n{(i * 7) % 40}") for i in range(1, 30) if i * 7 % 40 != i]
    e = spark.createDataFrame(sorted(set(links)), "src string, dst string")
    plain = {r.rel: r.score for r in pagerank(nodes, e, rounds=14).collect()}
    monkeypatch.setattr(graph, "hot_keys", lambda df, key: skew.hot_keys(df, key, 0.2, 5))
    split = {r.rel: r.score for r in pagerank(nodes, e, rounds=14).collect()}
    rank = {f"n{i}": 1 / 40 for i in range(40)}
    out = {}
    for a, b in set(links):
        out.setdefault(a, []).append(b)
    for _ in range(14):
        hang = sum(v for k, v in rank.items() if k not in out)
        new = {k: 0.15 / 40 + 0.85 * hang / 40 for k in rank}
        for a, bs in out.items():
            for b in bs:
                new[b] += 0.85 * rank[a] / len(bs)
        rank = new
    for k, v in rank.items():
        assert abs(plain[k] - v) < 1e-12 and abs(split[k] - v) < 1e-12
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_analysis(spark):
    nodes = spark.createDataFrame([("systems/a.md", "Concept"), ("systems/b.md", "Concept"), ("data/c.md", "Concept"), ("data/lonely.md", "Concept")], "rel string, type string")
    e = spark.createDataFrame([("systems/a.md", "systems/b.md"), ("systems/a.md", "data/c.md"), ("systems/b.md", "data/c.md")], "src string, dst string")
    cites = spark.createDataFrame([("data/c.md", "sources/s.md")], "src string, dst string")
    facts = nodes.select("rel", F.lit("unverified").alias("tier"), F.lit(True).alias("cited"))
    got = {}
    for r in analysis(nodes, e, cites, facts, nodes.select("rel", F.lit("test").alias("tag"))).collect():
        got.setdefault(r.section, []).append((r["rank"], r.item, r.detail))
    assert ("data/c.md" == next(x[1] for x in got["central"] if x[0] == 1)) and {x[1] for x in got["orphans"]} == {"systems/a.md", "data/lonely.md"}
    assert {x[1] for x in got["dead ends"]} == {"data/c.md", "data/lonely.md"} and got["cited"] == [(None, "sources/s.md", "1")]
    assert {(x[1], x[2]) for x in got["totals"]} == {("pages", "4"), ("links", "3"), ("components, largest", "2, 3")}


def test_shared_folder_is_asked_for():
    assert is_single_machine("local[4]") and is_single_machine("local-cluster[3,2,100]") and not is_single_machine("spark://h:7077") and not is_single_machine("yarn")


def test_graph(spark):
    nodes = spark.createDataFrame([("a", "Concept"), ("b", "Concept"), ("c", "Concept"), ("l", "Concept"), ("s", "Synthesis")], "rel string, type string")
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "src string, dst string")
    d = degrees(nodes, e)
    assert sorted(r.rel for r in orphans(d).collect()) == ["a", "l"]
    top = pagerank(nodes, e, rounds=12).orderBy(F.desc("score"), "rel").collect()
    assert top[0].rel == "c" and abs(sum(r.score for r in top) - 1) < 1e-9
    assert pagerank(nodes.limit(0), e.limit(0), rounds=2).count() == 0
    tags = nodes.select("rel", F.lit("t").alias("tag"))
    assert [tuple(r) for r in tag_cohesion(tags, e, below=0.5).collect()] == [("t", 5, 0.3)]


def test_colink_gaps(spark):
    nodes = spark.createDataFrame([(f"p{i}", "Concept") for i in range(3)] + [("x", "Concept"), ("y", "Concept"), ("z", "Concept"), ("s", "Synthesis")], "rel string, type string")
    links = [(f"p{i}", t) for i in range(3) for t in ("x", "y", "z")] + [("s", "y"), ("s", "z")]
    got = colink_gaps(nodes, spark.createDataFrame(links, "src string, dst string")).collect()
    assert sorted(tuple(r) for r in got) == [("x", "y", 3), ("x", "z", 3)]


def test_changes_and_jaccard(spark):
    a = spark.createDataFrame([("k", "1"), ("m", "1"), ("g", "1")], "rel string, digest string")
    b = spark.createDataFrame([("k", "1"), ("m", "2"), ("n", "1")], "rel string, digest string")
    assert sorted(tuple(r) for r in snapshot_changes(a, b).collect()) == [("g", "deleted"), ("m", "modified"), ("n", "created")]
    assert spark.range(1).select(jaccard(F.array(F.lit(1)), F.array().cast("array<int>"))).first()[0] == 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
