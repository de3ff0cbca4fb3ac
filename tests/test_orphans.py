import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire.functions.paths import page_path
from quire.operators.orphans import dangling_page_references, orphan_references
from quire.plans import skew

REFS = [(1, "a", 1), (2, "a", None), (3, None, None), (4, "z", 1), (5, "z", None), (6, None, 9), (6, None, 9)]


@pytest.mark.parametrize(("match", "ids"), [("simple", [4]), ("full", [2, 4, 5, 6, 6]), ("partial", [4, 5, 6, 6])])
def test_match_semantics(spark, match, ids):
    refs = spark.createDataFrame(REFS, "null_mask long, x string, y int").withColumnRenamed("null_mask", "id")
    targets = spark.createDataFrame([("a", 1), ("b", 2), (None, 9), (None, None)][:3], "x string, k int").where("x is not null")
    assert sorted(r.id for r in orphan_references(refs, targets, [("x", "x"), ("y", "k")], match).collect()) == ids
    everything = orphan_references(refs, targets.limit(0), [("x", "x")]).collect()
    assert sorted(r.id for r in everything) == [1, 2, 4, 5]


def test_intervals_and_facts(spark):
    refs = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "a", None), (4, None, 5), (5, "z", 5), (6, "b", 99)], "id long, x string, y int")
    targets = spark.createDataFrame([("a", 2, 9), ("a", 2, 9), ("a", None, None), ("b", 3, None)], "x string, since int, until int")
    keys = [("x", "x"), ("y", ("since", "until"))]
    got = {r.id: (r.null_mask, r.least) for r in orphan_references(refs, targets, keys, "full", {"least": F.min("since")}).collect()}
    assert got == {2: ("00", 2), 5: ("00", None), 3: ("01", None), 4: ("10", None)}
    assert {r.id for r in orphan_references(refs, targets, keys).collect()} == {2, 5}
    with pytest.raises(ValueError):
        orphan_references(refs, targets, keys, "partial")


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (0.01, 10))
    refs = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "gone").otherwise(F.col("id").cast("string")).alias("x"))
    targets = spark.createDataFrame([("hot",), ("5",)], "x string")
    got = {r.id for r in orphan_references(refs, targets, [("x", "x")]).collect()}
    assert got == {i for i in range(300) if i % 3 and i != 5}


def test_hot_paths_keep_their_state(spark, monkeypatch):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [(i, "x.md", "/gone.md" if i % 3 == 0 else "/late.md" if i % 3 == 1 else f"/p{i}.md", day(5)) for i in range(90)]
    links = spark.createDataFrame(rows, "link_id long, rel string, target string, seen_at timestamp_ntz")
    pages = spark.createDataFrame([("gone.md", day(1), day(3)), ("late.md", day(9), None), ("p2.md", day(1), None)], "rel string, added_at timestamp_ntz, deleted_at timestamp_ntz")
    plain = {tuple(r) for r in dangling_page_references({"page_link": links}, [pages]).collect()}
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (0.1, 5))
    split = {tuple(r) for r in dangling_page_references({"page_link": links}, [pages]).collect()}
    assert plain == split and len(plain) == 89 and {r[3] for r in plain} == {"missing", "deleted", "late"}


def test_paths(spark):
    cases = [("/a/b.md", "x/y.md", "a/b.md"), ("b.md#f", "x/y.md", "x/b.md"), ("../b.md", "x/y.md", "b.md"), ("../../b.md", "x/y.md", None), ("/a/../c%20d.md", "y.md", "c d.md"), ("https://h/a.md", "y.md", None), ("#a.md", "y.md", None), ("//h/a.md", "y.md", None), ("a%zz+.md", "y.md", "a%zz+.md"), ("mailto:a.md", "y.md", None), ("a.png", "y.md", None), (None, "y.md", None), ("./a//b.md", "y.md", "a/b.md")]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "t string, r string")
    assert [r[0] for r in df.select(page_path(F.col("t"), F.col("r"))).collect()] == [c for _, _, c in cases]


def test_states(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    links = spark.createDataFrame([(1, "x.md", "/a.md", day(5)), (2, "x.md", "/a.md", day(1)), (3, "x.md", "/a.md", day(9)), (4, "x.md", "/n.md", day(5)), (4, "x.md", "/n.md", day(5)), (5, "x.md", "/n.md", None), (6, None, "/n.md", day(5))], "link_id long, rel string, target string, seen_at timestamp_ntz")
    pages = spark.createDataFrame([("a.md", day(2), day(8)), ("a.md", day(2), day(8))], "rel string, added_at timestamp_ntz, deleted_at timestamp_ntz")
    got = {tuple(r)[1:] for r in dangling_page_references({"page_link": links}, [pages]).collect()}
    assert got == {(2, "2024-01", "late"), (3, "2024-01", "deleted"), (4, "2024-01", "missing"), (6, "2024-01", "missing")}
    assert dangling_page_references({"page_link": links}, [pages.limit(0)]).count() == 5
