import json
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quire.sinks import changed_files, commit_files, log_entry, new_page, write_new, write_redirects
from quire.sources.bundle import html_text, html_to_text, list_files, load_profile, parse_document, read_bundle, read_properties, read_questions
from quire.streaming.changes import blocking, expired, reuse_digests, stream_changes


def test_documents():
    d = parse_document("﻿---\r\ntype: Concept\nat: 2024-01-01\nok: yes\n---\r\nBody\n")
    assert json.loads(d["frontmatter"]) == {"type": "Concept", "at": "2024-01-01", "ok": True} and d["body"] == "Body\n" and d["body_line"] == 5
    assert parse_document("---\na: 1\n...\nx")["error"].endswith("'---'") and parse_document("x\n---\n")["has_frontmatter"] is False
    assert "mapping" in parse_document("---\n- a\n---\n")["error"] and "unparseable" in parse_document("---\na: [\n---\n")["error"]
    assert parse_document("---\n---\nx")["frontmatter"] == "{}" and parse_document("")["body"] == ""


def test_bundle(spark, tmp_path):
    for rel, text in {"a b.md": "---\ntype: X\n---\nHi", "x/ü+.md": "plain", ".git2/h.md": "no", "x/.h/y.md": "no", "x/i.png": "no"}.items():
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    rows = {r.rel: r for r in read_bundle(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a b.md", "x/ü+.md"} and rows["a b.md"].body == "Hi" and rows["x/ü+.md"].frontmatter is None
    assert set(list_files(tmp_path)) == {"a b.md", "x/ü+.md", "x/i.png"}
    assert read_bundle(spark, str(tmp_path), ["a b.md"]).count() == 1


def test_configuration_and_questions():
    p = load_profile("types: {Source: {folders: [sources], required: [resource]}}\nrelations: {related: x}", "folders: {journal: {group: Personal, auto_children: true, sort: date-desc}}")
    assert p.types["Source"].required == ("resource",) and p.known("journal/2024") and not p.known("journal/2024/x") and p.sort_of("journal/2024/x") == "date-desc" and p.personal == ("journal",)
    good, errors = read_questions("questions:\n- {question: q, expected: [/a.md], filters: {tag: [x]}}\n")
    assert not errors and good[0]["expected"] == ["/a.md"]
    assert len(read_questions("questions:\n- {question: '', expected: [a, a], filters: {status: no, z: 1}}\n- 3\n")[1]) == 7
    assert read_questions("x: 1")[1] and read_questions("")[0] == []


def test_notes_and_pages(spark):
    assert read_properties("tags:: [[a]], #b\ntype:: [[guide]]\nid:: 3\nBody\nx:: y") == ({"tags": ["a", "b"], "type": "guide"}, "Body\nx:: y")
    page = "<h1>A &amp; b</h1><script>x</script><p>c</p><br><br><br>d"
    assert html_to_text(page) == "A & b\n\nc\n\nd" and html_to_text(None) is None
    assert [r[0] for r in spark.createDataFrame([(page,), (None,)], "h string").select(html_text("h")).collect()] == ["A & b\n\nc\n\nd", None]


def test_commit_is_all_or_nothing(tmp_path):
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbfold\r\n")
    (tmp_path / "b.md").write_text("b")
    calls = []

    def failing(src, dst):
        calls.append(dst)
        if len(calls) == 3:
            raise OSError("full")
        os.replace(src, dst)

    with pytest.raises(OSError):
        commit_files(tmp_path, [("a.md", "new\n"), ("n/c.md", "c"), ("b.md", None), ("d.md", "d")], failing)
    assert (tmp_path / "a.md").read_bytes() == b"\xef\xbb\xbfold\r\n" and (tmp_path / "b.md").exists() and not (tmp_path / "n/c.md").exists() and not (tmp_path / "d.md").exists()
    assert commit_files(tmp_path, [("a.md", "new\n"), ("b.md", None)]) == ["a.md", "b.md"]
    assert (tmp_path / "a.md").read_bytes() == b"\xef\xbb\xbfnew\r\n" and not (tmp_path / "b.md").exists()
    with pytest.raises(ValueError):
        commit_files(tmp_path, [("../x", "y")])


def test_log():
    one = log_entry("# Log\n", "update", "first\nline", date(2024, 2, 1))
    two = log_entry(one, "add", "second", date(2024, 2, 1))
    assert two == "# Log\n\n## 2024-02-01\n\n* **Add**: second\n* **Update**: first line\n"
    assert log_entry(two, "add", "older", date(2024, 1, 1)).count("##") == 1 and log_entry(two, "add", "newer", date(2024, 3, 1)).index("2024-03-01") < two.index("2024-02-01") + 5
    for bad in (("two words", "x"), ("add", " \n ")):
        with pytest.raises(ValueError):
            log_entry("", *bad, date(2024, 1, 1))
    assert new_page({"type": "Concept"}, "T", ["A", "B"]).endswith("# A\n\n# B\n")


def test_tables_out(spark, tmp_path):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("n", "3")], "rel string, content string")
    b = spark.createDataFrame([("x", "1"), ("y", "0"), ("g", "3")], "rel string, content string")
    assert sorted(tuple(r)[:2] for r in changed_files(a, b).collect()) == [("g", "delete"), ("n", "write"), ("y", "write")]
    write_redirects(spark.createDataFrame([("b", "2"), ("a", "1")], "source string, path string"), f"{tmp_path}/r")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/r").collect()] == ["source\tpath", "a\t1", "b\t2"]
    write_new(a, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    with pytest.raises(FileExistsError):
        write_new(a, f"{tmp_path}/t")


def test_stream(spark, tmp_path):
    src, out = f"{tmp_path}/in", []
    schema = "rel string, digest string, at int"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    write([("a", "1", 1), ("b", "1", 1), ("b", "1", 2), (None, "1", 1)])

    def run():
        stream = stream_changes(spark.readStream.schema(schema).parquet(src))
        q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).foreachBatch(lambda df, i: out.extend(tuple(r) for r in df.collect())).start()
        assert q.awaitTermination(60)

    run()
    write([("a", "1", 5), ("b", "2", 5), ("c", "9", 5), ("c", None, 6)])
    run()
    assert sorted(out[:2]) == [("a", "created"), ("b", "created")] and sorted(out[2:]) == [("b", "modified"), ("c", "created"), ("c", "deleted")]


def test_sessions(spark):
    listing = spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 1, "y"), ("c", 1, 1, "z")], "path string, mtime long, size long, content string")
    known = spark.createDataFrame([("a", 1, 1, "old"), ("b", 1, 1, "old")], "path string, mtime long, size long, digest string")
    got = {r.path: (r.digest == "old", r.reused) for r in reuse_digests(listing, known, F.md5).collect()}
    assert got == {"a": (True, True), "b": (False, False), "c": (False, False)}
    s = spark.createDataFrame([("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 9))], "id string, changed_at timestamp")
    assert [r.id for r in expired(s, datetime(2024, 1, 10)).collect()] == ["a"]
    touched = spark.createDataFrame([("x/a.md",)], "rel string")
    diag = spark.createDataFrame([("x/a.md", "H001"), ("x/a.md", "W010"), ("b.md", "H001")], "path string, code string")
    late = spark.createDataFrame([("",), ("x",), ("y",)], "folder string")
    assert {tuple(r) for r in blocking(touched, diag, late).collect()} == {("x/a.md", "H001"), ("", "H040"), ("x", "H040")}
