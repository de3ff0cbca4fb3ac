import json

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators.nested import group_of, group_table, list_table, nested_objects, nested_rows, one_version, record_triples, render

LISTS = ("verified", "sources")
VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=6), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(min_size=1, max_size=4), c, max_size=3), max_leaves=12)


def walk(v, path, parent, out):
    if isinstance(v, str):
        try:
            w = json.loads(v)
        except ValueError:
            w = None
        if not isinstance(w, dict | list):
            return
        v = w
    if isinstance(v, dict):
        if path:
            out.append((parent, path))
        for k, x in v.items():
            walk(x, f"{path}.{k}" if path else k, path, out)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            walk(x, f"{path}[{i}]", parent, out)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text(min_size=1, max_size=4), VALUES, max_size=4), st.booleans())
def test_like_a_tree_walk(record, plain):
    text = json.dumps(record, ensure_ascii=plain)
    expected = []
    walk(record, "", "", expected)
    got = [(render(t[1]), render(t[0])) for t in record_triples(text) if t[3] == "object"]
    assert sorted(got) == sorted(expected)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text(min_size=1, max_size=4), VALUES, min_size=1, max_size=4), st.integers(1, 40))
def test_cut_off_records_give_nothing(record, n):
    text = json.dumps(record)
    assert record_triples(text[: -min(n, len(text))]) is None


def test_odd_records():
    for bad in (None, "", " ", "null", "[1]", '"{}"', '{"a": 1} x', '{"a": 01}', '{"a": NaN}', "{'a': 1}", '{"a": 1,}', '{"a" 1}', '{"a": "\t"}'):
        assert record_triples(bad) is None, bad
    assert record_triples("{}") == []
    assert record_triples('{"a": {"x": 1}, "a": 2}') == [("a", "", None, "number", "2")]
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    assert len(record_triples(deep)) == 3000


def test_objects(spark):
    rows = [(1, '{"verified": {"by": "x"}, "sources": [{"id": 1}, null, {"w": {}}]}', "k"), (1, '{"verified": {"by": "x"}, "sources": [{"id": 1}, null, {"w": {}}]}', "k"), (2, '{"review": "{\\"rounds\\": [{}]}"}', None), (3, None, None), (4, '{"a": ', None)]
    df = spark.createDataFrame(rows, "id long, js string, path string")
    got = {tuple(r) for r in nested_objects(nested_rows(df, "id", "js", LISTS)).collect()}
    assert got == {(1, "", "verified[0]"), (1, "", "sources[0]"), (1, "", "sources[2]"), (1, "sources[2]", "sources[2].w"), (2, "", "review"), (2, "review", "review.rounds[0]")}
    assert nested_objects(nested_rows(df.limit(0), "id", "js")).count() == 0


def test_tables(spark):
    df = spark.createDataFrame([(1, '{"sources": [{"id": 1, "x": "y", "author": ["a", null]}, {}], "n": null}')], "id long, js string")
    t = one_version(nested_rows(df.union(df), "id", "js", LISTS))
    rows = {r.node_path: r for r in group_table(t, "sources[]", ["id"]).collect()}
    assert rows["sources[0]"].id == "1" and rows["sources[0]"].other == {"x": "y"} and rows["sources[0]"].ordinal == 0
    assert rows["sources[1]"].id is None and rows["sources[1]"].parent_path == "" and len(rows) == 2
    assert [(r.path, r.value) for r in list_table(t, "sources[].author[]").orderBy("path").collect()] == [("sources[0].author[0]", "a"), ("sources[0].author[1]", None)]
    root = group_table(t, "").collect()
    assert len(root) == 1 and root[0].other == {"n": None}


def test_versions_are_not_mixed(spark):
    df = spark.createDataFrame([(1, 5, '{"s": {"id": "a", "free": "1"}, "only": {}}'), (1, 9, '{"s": {"title": "zz", "free": "2"}}'), (1, None, "{")], "id long, at long, js string")
    t = one_version(nested_rows(df, "id", "js", keep=("at",)), "at")
    assert [(r.node_path, r.id, r.title, r.other) for r in group_table(t, "s", ["id", "title"]).collect()] == [("s", None, "zz", {"free": "2"})]
    assert group_table(t, "only").count() == 0
    assert group_table(one_version(nested_rows(df, "id", "js")), "s").count() == 1


def test_keys_like_paths(spark):
    df = spark.createDataFrame([(1, '{"a.b": {"x": 1}, "a": {"b": {"x": 2}, "c[0]": {}}, "back\\\\": [{}]}')], "id long, js string")
    t = one_version(nested_rows(df, "id", "js"))
    assert sorted((r.parent_path, r.other["x"]) for r in group_table(t, group_of("a.b")).union(group_table(t, "a\\.b")).collect()) == [("", "1"), ("a", "2")]
    assert {(r.parent_path, r.node_path) for r in nested_objects(t).collect()} == {("", "a.b"), ("a", "a.b"), ("", "a"), ("a", "a.c[0]"), ("", "back\\[0]")}
