from datetime import UTC, datetime

import pytest

from quire.operators.nested import record_triples
from quire.operators.report import health_report, is_stale, trust_tier

NOW = datetime(2025, 1, 1, tzinfo=UTC)


@pytest.mark.parametrize(
    "text, tier",
    [
        ('{"verified": []}', "unverified"),
        ('{"verified": {}}', "unverified"),
        ('{"verified": null, "by": "human:a"}', "unverified"),
        ('{"verified": [{}]}', "machine-confirmed"),
        ('{"verified": {"by": "process:n"}, "generated": {"by": "human:a"}}', "machine-confirmed"),
        ('{"verified": [{"by": "process:n"}, {"by": "human:a"}]}', "human-reviewed"),
        ('{"verified": "{\\"by\\": \\"human:a\\"}"}', "human-reviewed"),
    ],
)
def test_tiers(text, tier):
    assert trust_tier(record_triples(text)) == tier


def test_stale():
    stale = lambda v: is_stale([("stale_after", "", None, "string", v)], NOW)
    assert stale("2024-12-31T23:59:59Z") and stale("2025-01-01T01:00:00+01:00") and not stale("2025-01-01T00:00:01Z")
    assert not stale("2024-01-01T00:00:00") and not stale("2024-01-01") and not stale("15/01/2023 08:47") and not is_stale([], NOW)


def test_report(spark):
    rows = [
        ("a.md", "", "Concept", "stable", '{"sources": [{"id": 1}], "verified": {"by": "human:a"}, "stale_after": "2024-01-01T00:00:00Z"}'),
        ("b.md", "", "Concept", "draft", '{"sources": []}'),
        ("journal/j.md", "journal", "Note", "draft", '{"stale_after": "2023-01-01T00:00:00Z"}'),
        ("p.md", "", "Person", "stable", None),
        ("s.md", "", "Source", "stable", '{"verified": [{"by": "m"}]}'),
        ("t.md", "", "Source", "stable", '{"verified": [{"by": "m"'),
        ("u.md", "", "Source", "stable", "{}"),
        ("_x/t.md", "_x", "Concept", "draft", "{}"),
        ("log.md", "", "Log", "stable", None),
    ]
    p = spark.createDataFrame(rows, "rel string, folder string, type string, status string, frontmatter string")
    links = [("a.md", "s.md"), ("log.md", "t.md"), ("u.md", "u.md"), ("_x/t.md", "u.md"), ("gone.md", "t.md"), ("a.md", "no.md"), ("a.md", "no.md"), ("log.md", "no.md"), ("_x/t.md", "no.md")]
    body = spark.createDataFrame([(i, a, b, "/" + b) for i, (a, b) in enumerate(links)], "link_id long, src string, dst string, target string")
    got: dict[str, dict] = {}
    for r in health_report(p, body, NOW).collect():
        got.setdefault(r.section, {})[r.item] = r.n
    assert got == {
        "type": {"Concept": 2, "Note": 1, "Person": 1, "Source": 3},
        "trust": {"human-reviewed": 1, "machine-confirmed": 1, "unverified": 4},
        "status": {"stable": 5, "draft": 2},
        "stale": {"a.md": 1, "journal/j.md": 1},
        "uncited": {"b.md": 1},
        "unused": {"t.md": 1, "u.md": 1},
        "broken": {"a.md -> /no.md": 2, "log.md -> /no.md": 1},
        "draft": {"b.md": 1, "journal/j.md": 1},
    }
