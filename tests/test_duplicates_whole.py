"""Pages in blocks of any size are compared: nothing is left out or starred without a cap."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quire.operators import duplicates
from quire.operators.duplicates import DISTINCT_RELATIONS, duplicate_candidates, spelling_ratio
from quire.operators.sharedtext import near_sets, shared_text

SCHEMA = "rel string, folder string, type string, title string, description string, tags array<string>, aliases array<string>, status string, resource string"
WORDS = "amber basalt cobalt dynamo ember falcon granite harbor indigo jasper".split()


def pages(spark, rows):
    """rows: rel, title, type, aliases, resource."""
    return spark.createDataFrame([(r, r.rpartition("/")[0], k, t, "", None, a, "stable", u) for r, t, k, a, u in rows], SCHEMA)


def found(df):
    return {(r.a, r.b): set(r.signals) - {"same folder"} for r in df.collect()}


def slow(rows, texts, apart=frozenset()):
    """All pairs that share a key, with their signals, by the plain definition."""
    names = [sorted({" ".join(n.lower().split()) for n in [t, r.rpartition("/")[2][:-3].replace("-", " "), *(a or [])]}) for r, t, k, a, u in rows]
    short = lambda n: "".join(x[0] for x in n.split())
    acronyms = [{short(n) for n in ns if " " in n} for ns in names]
    singles = [{n for n in ns if " " not in n} for ns in names]
    resources = [(u or "").rstrip("/") for _, _, _, _, u in rows]
    keys = [{"p:" + x[:4] for n in ns for x in n.split()} | {"a:" + x for x in a | s} | ({"r:" + u} if u else set()) for ns, a, s, u in zip(names, acronyms, singles, resources)]
    runs = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (texts.get(r[0], "").split() for r in rows)]
    share = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    want = {}
    for i, j in itertools.combinations(range(len(rows)), 2):
        kinds = rows[i][2], rows[j][2]
        if not keys[i] & keys[j] or (rows[i][0], rows[j][0]) in apart or kinds.count("Source") == 1 or kinds.count("Journal Entry") == 2:
            continue
        fired = {
            "same name": bool(set(names[i]) & set(names[j])),
            "same resource": bool(resources[i]) and resources[i] == resources[j],
            "acronym": bool(acronyms[i] & singles[j] or acronyms[j] & singles[i]),
            "name overlap": max(share(set(x.split()), set(y.split())) for x in names[i] for y in names[j]) >= 0.5,
            "similar spelling": spelling_ratio(names[i], names[j]) > 0,
            "shared text": share(runs[i], runs[j]) >= 0.3,
        }
        if any(fired.values()):
            want[rows[i][0], rows[j][0]] = {k for k, v in fired.items() if v}
    return want


@pytest.fixture(scope="module")
def many():
    """300 pages that all share a word, beside pages of one name, acronym or resource; every third text begins like the one before."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("bcdfgklmnprtvz", k=6))
    rows = []
    for i in range(300):
        kind = rng.choices(["Concept", "Source", "Journal Entry"], [8, 1, 1])[0]
        title = " ".join(["common", *rng.sample(WORDS, rng.choice([1, 2])), *[word() for _ in range(rng.choice([0, 1, 2]))]])
        if i % 7 == 6:
            title = title[:-3] + title[-2:]  # a letter missing
        alias = rng.choice([None, None, [f"{word()} {word()}"], ["cac"], [rows[-1][1][:-1] if rows else "x"]])
        rows.append((f"x/{i:03}{word()}.md", title, kind, alias, rng.choice([None, None, "https://one/", "https://one", f"https://{i}"])))
    texts = {}
    for i, r in enumerate(rows):
        own = [word() for _ in range(rng.choice([3, 40, 90]))]
        texts[r[0]] = " ".join((texts[rows[i - 1][0]].split()[: int(90 * rng.random())] if i % 3 and i else []) + own)
    return rows, texts


@pytest.mark.parametrize("part", [8_192, 60])
def test_large_blocks_are_compared_whole(spark, many, monkeypatch, part):
    monkeypatch.setattr(duplicates, "MAX_PART", part)
    monkeypatch.setattr(duplicates, "STEP_NAMES", 5_000)
    rows, texts = many
    apart = sorted(slow(rows, texts))[0]
    bodies = spark.createDataFrame(list(texts.items()), "rel string, text string")
    relations = spark.createDataFrame([(apart[1], DISTINCT_RELATIONS[0], apart[0])], "src string, key string, dst string")
    want = slow(rows, texts, {apart})
    got = found(duplicate_candidates(pages(spark, rows), relations, bodies, min_score=0.0, cap=None))
    assert got == want
    assert all(sum(k in v for v in want.values()) > 5 for k in ("same name", "same resource", "acronym", "name overlap", "similar spelling", "shared text"))


def test_groups_of_one_name_or_resource_are_paired_in_full(spark):
    rows = [(f"x/n{i:03}.md", "Same title", "Concept", None, None) for i in range(203)] + [(f"y/{w}{i:03}.md", f"{w} {i}", "Concept", None, "https://r/" if i % 2 else "https://r") for i in range(102) for w in ("uvw", "klm")]
    got = found(duplicate_candidates(pages(spark, rows), cap=None).where(F.array_contains("signals", "same name") | F.array_contains("signals", "same resource")))
    assert len(got) == 203 * 202 // 2 + 204 * 203 // 2


def test_the_query_has_no_cap(spark, monkeypatch, tmp_path):
    caps = []
    monkeypatch.setattr("quire.queries.site.duplicate_candidates", lambda p, r, b, cap=200: caps.append(cap))
    monkeypatch.setattr("quire.queries.site.relations", lambda *a: None)
    monkeypatch.setattr("quire.queries.site.pages", lambda s, d: s.createDataFrame([], SCHEMA))
    spark.createDataFrame([("a.md", "x")], "rel string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    __spark_entry__.queries()["dup_05_scores_with_text"](spark, str(tmp_path))
    assert caps == [None]


def test_common_text_finds_all_pairs(spark):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 40))) for _ in range(200)]
    sets += [np.unique(np.concatenate([s[: rng.integers(0, len(s) + 1)], rng.integers(0, 400, 3)])) for s in sets[:100]]
    docs = np.repeat(np.arange(len(sets)) * 7 - 500, [len(s) for s in sets])
    hashes = np.concatenate(sets)
    got = {(int(min(a, b)), int(max(a, b))) for x, y in near_sets(docs, hashes, 0.3) for a, b in zip(x, y)}
    own = {i * 7 - 500: set(s.tolist()) for i, s in enumerate(sets)}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(own), 2) if len(own[a] & own[b]) / len(own[a] | own[b]) >= 0.3}
    same = [(f"p{i}", "one two three four five six seven eight".split()) for i in range(250)] + [("few", ["one", "two"]), ("none", None), ("p1", "quite another text of more than five words".split())]
    texts = spark.createDataFrame(same, "rel string, words array<string>")
    rows = shared_text(texts, 0.3).collect()
    assert len(rows) == len({(r.a, r.b) for r in rows}) in (249 * 248 // 2, 250 * 249 // 2) and all(r.shared == 1.0 for r in rows)
