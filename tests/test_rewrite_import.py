from pyspark.sql import functions as F

from quire.functions.paths import encode_path
from quire.functions.strings import glob_regex
from quire.operators import biblio as B
from quire.operators import importing as I
from quire.operators import rewrite as R
from quire.operators.find import bundle_path


def col(spark, values, make, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i").select(make(F.col("x"))).collect()]


def test_fix_links(spark):
    refs = spark.createDataFrame([(1, "systems/dns.md", "tcp.md"), (2, "systems/dns.md", "data/sql.md#joins"), (3, "systems/dns.md", "/systems/tcp.md"), (4, "systems/dns.md", "../data/sql.md"), (5, "systems/dns.md", "no.md"), (6, "systems/dns.md", "https://x/tcp.md"), (7, "systems/dns.md", "#a"), (8, "a.md", "data/a%20b.md"), (9, "a.md", None)], "id int, rel string, target string")
    there = spark.createDataFrame([("systems/tcp.md",), ("data/sql.md",), ("data/a b.md",)], "dst string")
    got = {r.id: r.new_target for r in R.absolute_targets(refs, there).collect()}
    assert got == {1: "/systems/tcp.md", 2: "/data/sql.md#joins", 4: "/data/sql.md", 8: "/data/a%20b.md"}


def test_moves(spark):
    refs = spark.createDataFrame([(1, "x.md", "/systems/tcp.md#handshake"), (2, "systems/b.md", "./a.md"), (3, "systems/b.md", "#top"), (4, "systems/b.md", "/systems/a.md"), (5, "x.md", "systems/b.md")], "id int, rel string, target string")
    moves = spark.createDataFrame([("systems/tcp.md", "systems/networking/tcp.md"), ("systems/b.md", "data/b.md")], "old string, new string")
    got = {r.id: r.new_target for r in R.retargeted(refs, moves).collect()}
    assert got == {1: "/systems/networking/tcp.md#handshake", 2: "/systems/a.md", 5: "/data/b.md"}
    q = spark.createDataFrame([(1, ["systems/b.md", "x.md", "data/b.md"]), (2, [])], "qid int, expected array<string>")
    assert {r.qid: r.expected for r in R.renamed_expectations(q, moves).collect()} == {1: ["data/b.md", "x.md"], 2: []}
    files = spark.createDataFrame([("a.md",), ("b.md",), ("index.md",), ("f/x.md",)], "rel string")
    bad = [("a.md", "b.md"), ("a.md", "a.md"), ("a.md", "A.md"), ("no.md", "n.md"), ("a.md", "x.txt"), ("a.md", "q/index.md"), ("a.md", ".h/a.md"), ("a.md", "../a.md"), ("a.md", "b.md/c.md"), ("index.md", "i.md"), ("a.md", ""), ("a.md", "ok/a.md"), ("a.md", "B.md")]
    got = {}
    for r in R.destination_errors(spark.createDataFrame(bad, "old string, new string"), files).collect():
        got.setdefault((r.old, r.new), set()).add(r.error)
    assert set(bad) - set(got) == {("a.md", "A.md"), ("a.md", "ok/a.md")} and got["a.md", "b.md/c.md"] == {"a file is in the way"} and got["a.md", "B.md"] == {"already there"}
    assert [tuple(r) for r in R.folder_moves(files, [("f", "g/f")]).collect()] == [("f/x.md", "g/f/x.md")]
    assert bundle_path("kb\\x//./y.md", "kb") == "x/y.md"


def test_merges(spark):
    p = spark.createDataFrame([("old.md", "Old name", ["t2", "t1"], ["Legacy"]), ("new.md", "New", ["t1"], None), ("other.md", "Other", None, None)], "rel string, title string, tags array<string>, aliases array<string>")
    m = spark.createDataFrame([("old.md", "new.md")], "old string, new string")
    r = R.merged_pages(p, m).collect()
    assert len(r) == 1 and r[0].aliases == ["Legacy", "Old name"] and r[0].tags == ["t1", "t2"] and r[0].verified is None
    s = spark.createDataFrame([("old.md", "s1", "/x", 0), ("new.md", "s2", "/y", 0), ("old.md", "s2", "/z", 1), ("other.md", "s9", "/q", 0)], "rel string, id string, resource string, ord int")
    assert sorted(tuple(x) for x in R.merged_sources(s, m).collect()) == [("new.md", "s1", "/x", False), ("new.md", "s2", "/y", True)]
    rel = spark.createDataFrame([("old.md", "related", "new.md"), ("old.md", "related", "other.md"), ("other.md", "part_of", "old.md"), ("other.md", "part_of", "new.md")], "rel string, key string, dst string")
    assert sorted(tuple(x) for x in R.merged_relations(rel, m).collect()) == [("new.md", "related", "other.md"), ("other.md", "part_of", "new.md")]


def test_edits_and_paths(spark):
    df = spark.createDataFrame([("abcdef", [(1, 3, "X"), (4, 4, "++")]), ("é🚀z", [(1, 2, "_")])], "t string, e array<struct<start:int,end:int,new:string>>")
    assert [r[0] for r in df.select(R.apply_edits(F.col("t"), F.col("e"))).collect()] == ["aXd++ef", "é_z"]
    assert col(spark, ["a b/ü+(1)'$&.md", "x/~y,;=:@!*.md"], encode_path) == ["a%20b/%C3%BC+(1)'$&.md", "x/~y,;=:@!*.md"]


def test_globs(spark):
    hits = lambda g, path, ic=False: spark.createDataFrame([(path,)], "x string").where(F.col("x").rlike(glob_regex(g, ic))).count() == 1
    assert hits("**/*.md", "a/b/c.md") and hits("**/*.md", "c.md") and not hits("*.md", "a/c.md") and hits("a/[x].md", "a/[x].md")
    assert not hits("*.md", "c.md\n") and hits("*.MD", "c.md", True) and hits("a?c", "abc") and not hits("a?c", "a/c") and hits("a/**", "a/b/c")


RULES = [I.Rule("drop", ("**/draft-*",), skip=True), I.Rule("journal", ("diary/**",), "journal/{yyyy}/{date}"), I.Rule("notes", ("**/*.md",), "{dir}/{stem}", kebab=True)]


def test_plan(spark):
    src = [("a/My Note.md", 10, None), ("diary/2024-05-06.md", 10, None), ("diary/none.md", 10, None), ("x/draft-1.md", 5, None), ("x/big.png", 999, None), ("x/pic.png", 9, None), ("x/doc.pdf", 9, None), (".hidden/a.md", 1, None), ("node_modules/x.md", 1, None), ("z/bad.md", 1, "not readable"), ("secret/s.md", 1, None)]
    planned = I.plan(spark.createDataFrame(src, "src string, size long, problem string"), RULES, exclude=("SECRET/**",), max_bytes=100, into="in")
    got = {r.src: (r.dest, r.reason) for r in planned.collect()}
    assert got == {"a/My Note.md": ("in/a/my-note.md", ""), "diary/2024-05-06.md": ("in/journal/2024/2024-05-06.md", ""), "diary/none.md": (None, "no name"), "x/draft-1.md": (None, "left out by a rule"), "x/big.png": (None, "attachment"), "x/pic.png": (None, "attachment"), "x/doc.pdf": (None, "attachment"), "z/bad.md": (None, "not readable"), "secret/s.md": (None, "excluded")}
    shown = spark.createDataFrame([("a/My Note.md", "x/pic.png"), ("a/My Note.md", "x/big.png"), ("a/My Note.md", "x/doc.pdf"), ("x/draft-1.md", "x/no.png")], "src string, target string")
    got = {r.src: (r.dest, r.reason) for r in I.with_attachments(planned, shown, 100, "in").collect()}
    assert got["x/pic.png"] == ("in/assets/pic.png", "") and got["x/big.png"] == (None, "too large") and got["x/doc.pdf"] == (None, "linked document")
    assert I.plan(spark.createDataFrame([], "src string, size long, problem string"), RULES).count() == 0


def test_destinations(spark):
    rows = [("1", "a/x.md"), ("2", "a/x.md"), ("3", "b/Y.md"), ("4", "b/y.md"), ("5", "c"), ("6", "c/z.md"), ("7", "old.md"), ("8", "OLD2.md"), ("9", "n/index.md"), ("10", "fine.md")]
    planned = spark.createDataFrame([(s, d, True, "") for s, d in rows], "src string, dest string, note boolean, reason string")
    there = spark.createDataFrame([("old.md",), ("old2.md",)], "rel string")
    got = {r.src: r.error for r in I.destination_errors(planned, there).collect()}
    assert got == {"1": "several files map here", "2": "several files map here", "3": "differs only in case", "4": "differs only in case", "5": "is also a folder", "7": "already exists", "8": "differs only in case from an existing file", "9": "a reserved name"}


def test_names(spark):
    files = spark.createDataFrame([("a/Note.md",), ("b/c/note.md",), ("b/note.png",), ("x___y.md",), ("d/note.md",)], "rel string")
    names = spark.createDataFrame([("note", "b/c"), ("Note", "zzz"), ("c/note", ""), ("x/y", ""), ("note.png", ""), ("gone", "")], "name string, folder string")
    got = {(r.name, r.folder): r.rel for r in I.resolve_names(names, files).collect()}
    assert got == {("note", "b/c"): "b/c/note.md", ("Note", "zzz"): "a/Note.md", ("c/note", ""): "b/c/note.md", ("x/y", ""): "x___y.md", ("note.png", ""): "b/note.png"}


def test_texts(spark):
    assert col(spark, ["# H\n\nFirst one here. Second.", "- [ ] item text is long enough", "short", None, "> q\n\n" + "word " * 60, "```\ncode\n```\nAfter the **code** [link](/x.md) [[P|shown]]."], I.description) == ["First one here.", "item text is long enough", None, None, ("word " * 40).strip() + "…", "After the code link shown."]
    assert col(spark, ["A b! C_d-é"], I.heading_anchor) == ["a-b-c_d-é"] and col(spark, ["a<!-- x --> %%y%% **b** `c`"], I.plain) == ["a b c"]
    assert I.convert_body("See [[P|x]], [[P#Sub part]], ![[I.png]], [[no]], `[[P]]` %%c%%", {"P": "p.md", "I.png": "assets/i.png"}) == "See [x](/p.md), [P#Sub part](/p.md#sub-part), ![I.png](/assets/i.png), no, `[[P]]` <!--c-->"
    notes = spark.createDataFrame([("s", "[[P]]"), ("t", "[[P]]"), ("n", None)], "src string, body string")
    got = {r.src: r.body for r in I.converted(notes, spark.createDataFrame([("s", "P", "p.md")], "src string, name string, dest string")).collect()}
    assert got == {"s": "[P](/p.md)", "t": "P", "n": None}


def test_properties(spark):
    df = spark.createDataFrame([({"a": "1", "b": "x", "c": "y"}, ["#A b", "drop"], ["x/Y z", "A b"], "v/Untitled.md", "T")], "p map<string,string>, w array<string>, i array<string>, src string, t string")
    r = df.select(I.mapped_properties(F.col("p"), {"a": "z", "b": "c"}, ["q"], {"c": {"y": "yes"}}).alias("m"), I.page_tags(F.col("w"), F.col("i"), {"A b": "ab"}, "dr.*", ["imp"]).alias("tags"), I.page_aliases(F.array(F.lit("K")), F.col("src"), F.col("t")).alias("al"), I.page_aliases(F.lit(None).cast("array<string>"), F.lit("v/Stem.md"), F.col("t")).alias("al2"), I.title_of(F.lit(" "), F.lit(None).cast("string"), F.lit("a/b___c.md")).alias("title")).first()
    assert r.m == {"z": "1", "c": "yes"} and r.tags == ["ab", "x/y-z", "imp"] and r.al == ["K"] and r.al2 == ["Stem"] and r.title == "b/c"
    t = df.select(I.page_time(F.lit(None).cast("long"), F.lit(5), F.lit(3), F.lit(4)).alias("t")).first().t
    assert t == 4


def tables(spark):
    make = lambda rows, s: spark.createDataFrame(rows, s)
    return {
        "itemTypes": make([(1, "journalArticle"), (2, "attachment")], "itemTypeID int, typeName string"),
        "items": make([(1, 1, "ABCD2345"), (2, 1, "GONE2345"), (3, 2, "ATTA2345"), (4, 1, "PLAI2345")], "itemID int, itemTypeID int, key string"),
        "deletedItems": make([(2,)], "itemID int"),
        "fields": make([(1, "title"), (2, "date"), (3, "extra"), (4, "DOI"), (5, "url")], "fieldID int, fieldName string"),
        "itemDataValues": make([(1, "Roofline model"), (2, "2009-04-00 2009"), (3, "x\nCitation Key: williams2009roofLine"), (4, "doi:10.1/x"), (5, "50%_off")], "valueID int, value string"),
        "itemData": make([(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 4), (2, 1, 1), (3, 1, 1), (4, 1, 5)], "itemID int, fieldID int, valueID int"),
        "creators": make([(1, "Sam", "Williams"), (2, "", "Patterson")], "creatorID int, firstName string, lastName string"),
        "itemCreators": make([(1, 1, 1), (1, 2, 0), (2, 1, 0)], "itemID int, creatorID int, orderIndex int"),
    }


def test_bibliography(spark):
    t = tables(spark)
    keys = lambda s, **k: [r.key for r in B.search_items(t, s, **k).collect()]
    assert keys("williams") == ["ABCD2345"] and keys("ROOF") == ["ABCD2345"] and keys("0%_o") == ["PLAI2345"] and keys("%", limit=1) == ["PLAI2345"] and keys("zzz") == []
    rec = B.item_records(t)
    r = rec.where("key = 'ABCD2345'").first()
    assert r.creators == ["Patterson", "Sam Williams"] and r.fields["title"] == "Roofline model"
    page = B.page_frontmatter(rec).where("key = 'ABCD2345'").first()
    assert page.slug == "williams-2009-roof-line" and page.resource == "https://doi.org/10.1/x" and page.author == "Patterson; Sam Williams" and page.published == "2009-04" and page.citekey == "williams2009roofLine"
    assert B.page_frontmatter(rec).where("key = 'PLAI2345'").first().resource == "zotero://select/library/items/PLAI2345"
    names = spark.createDataFrame([("abcd2345",), ("williams-2009-roof-line",), ("williams2009roofLine",), ("no",)], "name string")
    assert {r.name: r.key for r in B.find_item(names, B.page_frontmatter(rec).select("key", "slug", "citekey")).collect()} == {n: "ABCD2345" for n in ("abcd2345", "williams-2009-roof-line", "williams2009roofLine")}
    a = spark.createDataFrame([("k", 2, "two", None), ("k", 1, "", "one"), ("k", 3, None, None)], "key string, ord int, indexed string, cached string")
    assert B.full_text(a).first().text == "one\n\ntwo"


def test_references(spark):
    rows = spark.createDataFrame([("file:root/a b",), ("https://x.y/z",), ("https://",), ("plain",), (None,)], "x string").select(*B.reference_parts(F.col("x"))).collect()
    assert [tuple(r) for r in rows] == [("file", "root/a b", False), ("https", "//x.y/z", True), ("https", "//", False), ("", "plain", False), (None, None, False)]
    assert col(spark, ["human:a", "tool/model-1 [x]", "process:n", "Bob", None], B.actor) == ["human:a", "tool/model-1", "process:n", None, None]
    assert col(spark, ["2020-05-06T", "May 2020-07", "c. 1999", "none"], B.published) == ["2020-05-06", "2020-07", "1999", None]


def test_mapping_errors():
    good = {"actor": "process:import-x", "notes": [{"match": "**/*.md", "to": "{dir}/{stem}"}, {"match": ["a"], "skip": True}], "max_bytes": 10}
    assert I.mapping_errors(good) == []
    bad = {"actor": "me", "odd": 1, "max_bytes": 0, "notes": [{"match": [], "to": "x"}, {"match": "a"}, {"match": "a", "to": "{nope}", "type": "Gizmo", "z": 1}, 3], "files": {}, "tags": {"drop": ["("]}}
    assert len(I.mapping_errors(bad, ["Concept"])) == 11 and I.mapping_errors([])


def test_relation_links(spark):
    values = spark.createDataFrame([("n", "related", "[[Page|x]]"), ("n", "related", "Other Thing"), ("m", "related", "[[Page]]")], "src string, key string, value string")
    resolved = spark.createDataFrame([("n", "Page", "a/page.md")], "src string, name string, dest string")
    rows = {(r.src, r.value): r.link for r in I.relation_links(values, resolved, "/people/{slug}.md").collect()}
    assert rows == {("n", "[[Page|x]]"): "[Page](/a/page.md)", ("n", "Other Thing"): "[Other Thing](/people/other-thing.md)", ("m", "[[Page]]"): "[Page](/people/page.md)"}
    assert I.relation_links(values, resolved).count() == 1
