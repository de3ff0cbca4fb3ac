from datetime import UTC, datetime

import pytest

from quire.operators.checks import Corpus, check, totals, violations
from quire.operators.index import expected_indexes
from quire.operators.profile import Folder, PageType, Profile
from quire.sources.bundle import parse_document

NOW = datetime(2026, 9, 26, tzinfo=UTC)
PROFILE = Profile(
    types={"Concept": PageType("Concepts"), "Synthesis": PageType("Syntheses", ("syntheses",)), "Source": PageType("Sources", ("sources",), ("resource",)), "Template": PageType("Templates", ("_templates",))},
    relations=("depends_on", "related"),
    folders={f: Folder("Knowledge domains", f.capitalize()) for f in ("systems", "data")} | {"sources": Folder("Library"), "journal": Folder("Personal", "Journal", "", "date-desc", True)},
    root_groups=("Knowledge domains", "Library", "Personal"),
    roots=("papers",),
    deny=("papers/private/**",),
)
SCHEMA = "rel string, has_frontmatter boolean, frontmatter string, error string, body_offset int, body_line int, body string"


def page(title, body="", **more):
    head = {"type": "Concept", "title": title, "description": f'"{title} in one sentence."', "tags": "[test]", "status": "stable", "generated": "{by: test/0, at: 2026-01-25T12:00:00Z}", **more}
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in head.items() if v is not None) + f"---\n\n{body}\n"


def docs_of(spark, texts):
    return spark.createDataFrame([(rel, *[parse_document(t)[k] for k in ("has_frontmatter", "frontmatter", "error", "body_offset", "body_line", "body")]) for rel, t in texts.items()], SCHEMA)


def codes(spark, texts, without=("H040",)):
    got = check(Corpus.of_texts(docs_of(spark, texts)), PROFILE, NOW).collect()
    return sorted((r.path, r.line, r.code) for r in got if r.code not in without)


def test_documents(spark):
    a = page("A", "See [b](/systems/b.md).")
    got = codes(
        spark,
        {
            "systems/a.md": a,
            "systems/b.md": page("B", "[a](a.md) and [x](/no.md) [[W]] `[[no]]` [out](../../x.md)\n\n[r]: /z.md"),
            "systems/none.md": "text",
            "systems/only.md": "---\ntitle: B\n---\n",
            "systems/open.md": "---\ntype: Concept\n...\n",
            "systems/Odd_Name.md": page("O", type="Gizmo"),
            "systems/src.md": page("S", type="Source"),
            "_templates/t.md": page("T", "[x](/no.md)", type="Template", tags=None),
        },
    )
    assert got == sorted(
        [
            ("systems/b.md", 10, "W030"), ("systems/b.md", 10, "W031"), ("systems/b.md", 10, "H032"), ("systems/b.md", 10, "H030"), ("systems/b.md", 12, "W033"),
            ("systems/none.md", 1, "O001"), ("systems/only.md", 1, "O002"), ("systems/open.md", 1, "O001"),
            ("systems/Odd_Name.md", 1, "H001"), ("systems/Odd_Name.md", 1, "H011"), ("systems/src.md", 1, "H012"), ("systems/src.md", 1, "H013"),
        ]
    )


def test_citations_relations_times(spark):
    got = codes(
        spark,
        {
            "data/a.md": page("A", "Claim.[^good] Other.[^bad]\n\n[^good]: /data/b.md\n", sources="[{id: good, resource: /data/b.md}, {id: 7, resource: /data/no.md}]"),
            "data/b.md": page("B", depends_on='["[A](/data/a.md)"]', related='["[N](/data/no.md)"]', stale_after="2026-01-01T00:00:00Z"),
            "data/c.md": page("C", "[a](/data/a.md)", depends_on='["[A](/data/a.md)"]', stale_after="2027-01-01T00:00:00", generated="{by: test/0, at: 2030-01-01T00:00:00Z}", locators='["file:papers/private/x", "file:other/y"]', odd=1),
        },
    )
    assert got == sorted(
        [
            ("data/a.md", 11, "H020"), ("data/a.md", 11, "H021"), ("data/a.md", 1, "W020"), ("data/a.md", 1, "W021"), ("data/a.md", 1, "H010"),
            ("data/b.md", 1, "H031"), ("data/b.md", 1, "H031"), ("data/b.md", 1, "W032"), ("data/b.md", 1, "W040"),
            ("data/c.md", 1, "H010"), ("data/c.md", 1, "W041"), ("data/c.md", 1, "H060"), ("data/c.md", 1, "W060"), ("data/c.md", 1, "W010"),
        ]
    )


def test_indexes_and_logs(spark):
    texts = {
        "systems/a.md": page("A", "[b](/journal/2024/b.md)"),
        "journal/2024/b.md": page("B"),
        "extra/c.md": page("C"),
        "systems/index.md": "---\nx: 1\n---\n# Concepts\n\nwords\n",
        "index.md": "---\nokf_version: 1\nmore: 2\n---\n",
        "log.md": "# Log\n\n## 2026-01-01\n\n[x](/no.md)\n\n## 2026-02-01\n\n## soon\n",
    }
    got = codes(spark, texts)
    assert [g for g in got if g[2] != "H012"] == sorted([("systems/index.md", 1, "O003"), ("index.md", 1, "O003"), ("systems/index.md", 6, "O004"), ("log.md", 7, "O005"), ("log.md", 9, "O005"), ("log.md", 5, "W030"), ("extra/", 1, "W050")])


def test_generated_indexes_are_current(spark):
    texts = {"systems/a.md": page("A", "[b](/systems/b.md)"), "systems/b.md": page("B [x]", "[a](/systems/a.md)"), "journal/2024/j1.md": page("J1", type="Template"), "journal/2024/j2.md": page("J2", type="Template")}
    docs = docs_of(spark, texts)
    from quire.operators.checks import document_pages, frontmatter_facts

    want = {r.folder: r.content for r in expected_indexes(document_pages(docs, frontmatter_facts(docs)), PROFILE).collect()}
    assert want["systems"] == "# Concepts\n\n* [A](./a.md) - A in one sentence.\n* [B \\[x\\]](./b.md) - B [x] in one sentence.\n"
    assert want["journal/2024"].index("j2.md") < want["journal/2024"].index("j1.md") and want["data"] == "# Pages\n"
    assert want[""].startswith('---\nokf_version: "0.2"\n---\n\n# Knowledge domains\n\n* [Systems](./systems/index.md)\n* [Data](./data/index.md)\n\n# Library\n')
    full = texts | {(f + "/" if f else "") + "index.md": c for f, c in want.items()}
    late = lambda t: sorted(p for p, _, c in codes(spark, t, ()) if c == "H040")
    assert late(full) == []
    assert late(full | {"systems/c.md": page("C")}) == ["systems/index.md"]
    assert late({k: v for k, v in full.items() if k != "data/index.md"} | {"gone/index.md": "# Pages\n"}) == ["data/index.md", "gone/index.md"]


def test_shapes():
    good = {"type": "Concept", "title": "T", "description": "d", "tags": ["a/b"], "status": "draft", "generated": {"by": "human:x", "at": "2024-01-01T00:00Z"}}
    assert violations(good) == []
    for change in ({"status": "odd"}, {"tags": ["A"]}, {"tags": ["a", "a"]}, {"tags": "a"}, {"generated": {"by": "x"}}, {"verified": []}, {"sources": [{"id": "x"}]}, {"description": "d" * 301}, {"zotero": {"key": "ABCD2345", "x": 1}}, {"stale_after": "2024-01-01"}, {"usage_window": 3}, {"locators": ["x"]}):
        assert violations(good | change), change
    assert violations(good | {"related": ["[x](y.md)"]}, ("related",)) and not violations(good | {"verified": {"by": "m/1", "at": "2024-01-01T00:00:00+01:00"}})


def test_totals(spark):
    d = spark.createDataFrame([("a", 1, "W010", ""), ("a", 1, "H001", "")], "path string, line int, code string, message string")
    assert tuple(totals(d).first()) == (1, 1, 1, 1) and tuple(totals(d.where("code = 'W010'")).first()) == (0, 1, 0, 1) and tuple(totals(d.limit(0)).first()) == (0, 0, 0, 0)
    empty = check(Corpus.of_texts(docs_of(spark, {"a.md": "x"}).limit(0)), PROFILE, NOW)
    assert {r.code for r in empty.collect()} == {"H040"}  # the profile's folders have no index


@pytest.mark.parametrize("rel", ["systems/a.md"])
def test_one_rule_is_planned_alone(spark, rel):
    d = check(Corpus.of_texts(docs_of(spark, {rel: page("A")})), PROFILE, NOW)
    assert d.where("code = 'H001'").count() == 0
