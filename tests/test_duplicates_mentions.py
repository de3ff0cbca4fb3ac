import random
import time

import pytest
from pyspark.sql import functions as F

from quire.operators.duplicates import duplicate_candidates, name_signals, spelling_ratio
from quire.operators.mentions import name_key, name_owners, plain_text, unlinked_mentions

SCHEMA = "rel string, folder string, type string, title string, description string, tags array<string>, aliases array<string>, status string, resource string"


def pages(spark, rows):
    full = []
    for rel, title, *more in rows:
        kind, aliases, resource = (more + ["Concept", None, None][len(more) :])[:3]
        full.append((rel, rel.rpartition("/")[0], kind, title, "", None, aliases, "stable", resource))
    return spark.createDataFrame(full, SCHEMA)


def found(df):
    return {(r.a, r.b): (r.score, r.signals) for r in df.collect()}


def test_duplicates(spark):
    p = pages(spark, [("x/domain-specific-languages.md", "Domain-specific languages"), ("y/dsl.md", "DSL"), ("x/kubernetes.md", "Kubernetes"), ("y/kubernets.md", "Kubernets"), ("x/raft-consensus.md", "Raft consensus protocol"), ("y/paxos-consensus.md", "Paxos consensus protocol"), ("x/c.md", "C"), ("x/cpp.md", "C++"), ("x/csharp.md", "C#"), ("x/j1.md", "Journal 2024-10-22", "Journal Entry"), ("x/j2.md", "Journal 2024-10-28", "Journal Entry"), ("x/s.md", "Kubernetes", "Source"), ("x/r1.md", "One", "Concept", None, "https://r/"), ("z/r2.md", "Two", "Concept", None, "https://r")])
    apart = spark.createDataFrame([("y/paxos-consensus.md", "alternative_to", "x/raft-consensus.md")], "src string, key string, dst string")
    got = found(duplicate_candidates(p, apart))
    assert "acronym" in got["x/domain-specific-languages.md", "y/dsl.md"][1]
    assert got["x/kubernetes.md", "y/kubernets.md"] == (0.94, ["similar spelling"])
    assert got["x/r1.md", "z/r2.md"][1] == ["same resource"]
    assert set(got) == {("x/domain-specific-languages.md", "y/dsl.md"), ("x/kubernetes.md", "y/kubernets.md"), ("x/r1.md", "z/r2.md")}
    assert ("x/raft-consensus.md", "y/paxos-consensus.md") in found(duplicate_candidates(p, None, min_score=0.3)) and ("x/raft-consensus.md", "y/paxos-consensus.md") not in found(duplicate_candidates(p, apart, min_score=0.3))
    assert duplicate_candidates(p.limit(0)).count() == 0


def test_large_blocks(spark):
    rows = [(f"x/w{i}.md", f"Widget number {i}") for i in range(205)] + [("x/wa.md", "Widget cache"), ("y/wb.md", "Widget cache")]
    got = found(duplicate_candidates(pages(spark, rows), cap=200).where(F.array_contains("signals", "same name")))
    assert set(got) == {("x/wa.md", "y/wb.md")}
    same = [(f"x/s{i:03}.md", "Same title") for i in range(30)]
    stars = found(duplicate_candidates(pages(spark, same), cap=10).where(F.array_contains("signals", "same name")))
    assert set(stars) == {("x/s000.md", f"x/s{i:03}.md") for i in range(1, 30)}


def test_shared_text(spark):
    p = pages(spark, [("x/alpha-one.md", "Alpha one"), ("y/alpha-two.md", "Alpha two"), ("z/alpha-three.md", "Alpha three")])
    text = "the quick brown fox jumps over the lazy dog and then it sleeps for a long while"
    bodies = spark.createDataFrame([("x/alpha-one.md", text), ("y/alpha-two.md", text.replace("while", "time")), ("z/alpha-three.md", None)], "rel string, text string")
    got = found(duplicate_candidates(p, None, bodies))
    assert set(got) == {("x/alpha-one.md", "y/alpha-two.md")} and "shared text" in got["x/alpha-one.md", "y/alpha-two.md"][1]
    assert spelling_ratio(["ab"], ["xy"]) == 0.0


def test_pairs_of_a_block_are_sifted_before_they_are_joined(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    names = [f"Widget {word()} {word()} {word()}" for _ in range(150)]
    names += [n[:9] + n[10:] for n in names[:10]] + [f"Widget {n.split()[2]} {n.split()[1]}" for n in names[10:20]]  # a letter missing, two words of three
    rows = [(f"x/{i:03}.md", n) for i, n in enumerate(names)]
    signals = name_signals(pages(spark, rows)).select("a", "b").collect()
    assert len(signals) == len(set(signals)) < 1000  # of 14,365 pairs that share a word
    texts = [[word() for _ in range(rng.choice([3, 5, 30, 70, 300, 1100]))] for _ in rows]
    for i in range(0, 120, 3):  # shared text from none to all, also with texts of other lengths
        texts[i + 1] = texts[i][: int(len(texts[i]) * (0.2 + i / 150))] + texts[i + 1][: rng.choice([0, 10])]
    bodies = spark.createDataFrame([(r, " ".join(t)) for (r, _), t in zip(rows, texts)], "rel string, text string")
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    toks = [set(n.lower().split()) for n in names]
    want = {}
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            shared = len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j]))
            overlap = len(toks[i] & toks[j]) / len(toks[i] | toks[j])
            fired = {"shared text": shared >= 0.3, "name overlap": overlap >= 0.5, "similar spelling": spelling_ratio([names[i].lower()], [names[j].lower()]) > 0}
            if any(fired.values()):
                want[rows[i][0], rows[j][0]] = {k for k, v in fired.items() if v}
    got = found(duplicate_candidates(pages(spark, rows), None, bodies, min_score=0.0))
    assert {k: set(v[1]) - {"same folder"} for k, v in got.items()} == want
    assert sum("shared text" in v for v in want.values()) > 20


def test_one_text_of_a_page_counts_in_every_run(spark):
    p = pages(spark, [("x/alpha-one.md", "Alpha one"), ("y/alpha-two.md", "Alpha two")])
    text = "the quick brown fox jumps over the lazy dog and then it sleeps"
    rows = [("x/alpha-one.md", text), ("x/alpha-one.md", "quite another text that shares no words with it at all"), ("y/alpha-two.md", text)]
    scores = [found(duplicate_candidates(p, None, spark.createDataFrame(x, "rel string, text string").coalesce(1), min_score=0.0)) for x in (rows, rows[::-1])]
    assert scores[0] == scores[1]


NO_LINKS = "src string, dst string"


def mention(spark, rows, texts, links=(), **kw):
    docs = spark.createDataFrame(list(texts.items()), "rel string, body string")
    got = unlinked_mentions(docs, name_owners(pages(spark, rows)), spark.createDataFrame(list(links), NO_LINKS), **kw)
    return sorted((r.page, r.target, r.text, r.line) for r in got.collect())


DSL = [("d/dsl.md", "Domain-specific language", "Concept", ["DSL"]), ("d/halide.md", "Halide"), ("d/other.md", "Other"), ("d/case.md", "Case")]


@pytest.mark.parametrize("block", [100_000, 1])
def test_mentions(spark, block):
    texts = {"d/halide.md": "## domain specific languages\n\nOf the domain specific languages family, `DSL` too.\n", "d/other.md": "A domain-specific language [x](/d/dsl.md)", "d/case.md": "the dsl", "d/dsl.md": "Domain-specific language", "d/null.md": None}
    assert mention(spark, DSL, texts, [("d/other.md", "d/dsl.md")], block=block) == [("d/halide.md", "d/dsl.md", "domain specific languages", 3)]
    more = {"d/case.md": "A DSL, then domain_specific languages; domain, specific language; xDSL"}
    assert mention(spark, DSL, more, block=block) == [("d/case.md", "d/dsl.md", "DSL", 1)]


def test_names(spark):
    rows = [("hpc/b.md", "Scheduler"), ("systems/a.md", "Scheduler"), ("e.md", "Écoles normales"), ("n.md", "Framework", "Concept", [".NET"]), ("s.md", "A source page", "Source")]
    owners = {r.key: r.owners for r in name_owners(pages(spark, rows)).collect()}
    assert owners["scheduler"] == ["hpc/b.md", "systems/a.md"] and "source page" not in owners
    assert mention(spark, rows, {"t.md": "Scheduler in ecoles normales"}) == [("t.md", "e.md", "ecoles normales", 1)]
    assert mention(spark, rows, {"t.md": "x y\nBuilt on .NET today."}) == [("t.md", "n.md", ".NET", 2)]
    assert name_key("Stencils") == name_key("stencil") and name_key("DSL") == "=DSL"
    text = "a [b](/c.md) <https://x.y/z>\n# H\n[^n]: f\n"
    assert plain_text(text).split() == ["a"] and len(plain_text(text)) == len(text)


def test_mentions_in_time(spark):
    rows = [(f"p/name-{i}.md", f"Curious name{i}") for i in range(400)]
    texts = {f"p/name-{i}.md": f"Of curious name{(i * 7) % 400} and the like. " * 10 for i in range(400)}
    mention(spark, rows[:2], {"p/name-0.md": "x"})  # start the workers
    began = time.time()
    assert len(mention(spark, rows, texts)) >= 390
    assert time.time() - began < 5
