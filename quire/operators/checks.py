"""The rules a bundle must keep, one DataFrame per rule: (path, line, code, message). Codes with O are errors of the format, H of the house, W are warnings."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.paths import ancestors, file_path, folder_of, is_internal, leaves_bundle, name_of, normalize, stem_of, without_fragment
from quire.functions.strings import glob_regex, is_kebab
from quire.operators.catalog import existing, is_tooling
from quire.operators.index import VERSION_KEY, expected_indexes, folders_to_index
from quire.operators.markdown import parse_relation, text_parts
from quire.operators.profile import Profile
from quire.sources import table

# The shapes of the common profile, and its keys.
KEBAB = r"[a-z0-9]+(?:-[a-z0-9]+)*"
DATETIME = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})"
ACTOR = r"(?:human:[a-z0-9._-]+|process:[a-z0-9._-]+|[A-Za-z0-9._-]+/[A-Za-z0-9._:-]+)"
RELATION = r"\[[^\]]+\]\(/[^)\s]+\.md(?:#[^)\s]*)?\)"
INDEX_LINE = r"^[*-] \[(?:[^\]\\]|\\.)+\]\([^)\s]+\)( - .+)?\z"
DATE_LINE = r"^## \d{4}-\d{2}-\d{2}\s*\z"

Rule = Callable[[Any], list[str]]


def _text(pattern: str | None = None, least: int = 0, most: int | None = None) -> Rule:
    def check(v: Any) -> list[str]:
        if not isinstance(v, str):
            return ["is no string"]
        bad = ["is too short"] if len(v) < least else []
        bad += ["is too long"] if most is not None and len(v) > most else []
        return bad + ([] if pattern is None or re.fullmatch(pattern, v) else ["has the wrong form"])

    return check


def _number(v: Any) -> list[str]:
    ok = isinstance(v, int | float) and not isinstance(v, bool) and v == int(v)
    return [] if ok and v >= 0 else ["is no count"]


def _choice(*values: str) -> Rule:
    return lambda v: [] if v in values else ["is none of " + ", ".join(values)]


def _list(item: Rule, unique: bool = False, least: int = 0) -> Rule:
    def check(v: Any) -> list[str]:
        if not isinstance(v, list):
            return ["is no list"]
        bad = [f"{i}: {m}" for i, x in enumerate(v) for m in item(x)]
        texts = [json.dumps(x, sort_keys=True) for x in v]
        return bad + (["repeats a value"] if unique and len(set(texts)) < len(texts) else []) + (["is empty"] if len(v) < least else [])

    return check


def _record(fields: dict[str, Rule], needed: tuple[str, ...] = (), closed: bool = False) -> Rule:
    def check(v: Any) -> list[str]:
        if not isinstance(v, dict):
            return ["is no mapping"]
        bad = [f"lacks {k}" for k in needed if k not in v] + [f"{k}: {m}" for k, rule in fields.items() if k in v for m in rule(v[k])]
        return bad + ([f"has the unknown key {k}" for k in v if k not in fields] if closed else [])

    return check


def _one_or_list(item: Rule) -> Rule:
    many = _list(item, least=1)
    return lambda v: many(v) if isinstance(v, list) else item(v)


_TIME = _text(DATETIME)
_EVENT = _record({"by": _text(ACTOR), "at": _TIME}, ("by", "at"))
_WINDOW = _record({"from": _TIME, "to": _TIME}, ("from", "to"))
_SOURCE = _record({"id": _text(KEBAB), "resource": _text(least=1), "title": _text(), "author": _text(), "usage_count": _number, "last_modified": _TIME, "usage_window": _WINDOW}, ("id", "resource"))
COMMON: dict[str, Rule] = {
    "type": _text(least=1),
    "title": _text(least=1),
    "description": _text(least=1, most=300),
    "resource": _text(least=1),
    "tags": _list(_text(f"{KEBAB}(?:/{KEBAB})*"), unique=True),
    "aliases": _list(_text(least=1)),
    "status": _choice("draft", "stable", "deprecated"),
    "stale_after": _TIME,
    "generated": _EVENT,
    "verified": _one_or_list(_EVENT),
    "sources": _list(_SOURCE),
    "usage_window": _WINDOW,
    "author": _text(),
    "published": _text(r"\d{4}(?:-\d{2}(?:-\d{2})?)?"),
    "archived": _text(r"https?://.*"),
    "zotero": _record({"key": _text("[A-Z0-9]{8}"), "citekey": _text(least=1), "library": _text("user|group:[0-9]+")}, ("key",), closed=True),
    "locators": _list(_text(r"(?s:file:[a-z0-9-]+/.+|zotero:[A-Z0-9]{8})"), unique=True, least=1),
}
_LINKS = _list(_text(RELATION), least=1)


def violations(fm: dict[str, Any], relations: tuple[str, ...] = ()) -> list[str]:
    """Where a frontmatter departs from the common profile, as `key: what`."""
    needed = ("type", "title", "description") + (() if fm.get("type") == "Template" else ("tags", "status", "generated"))
    out = [f"frontmatter: lacks {k}" for k in needed if k not in fm]
    for key, rule in {**COMMON, **{r: _LINKS for r in relations if r not in COMMON}}.items():
        if key in fm:
            out += [f"{key}: {m}" for m in rule(fm[key])]
    return out


@dataclass
class Corpus:
    """A bundle as DataFrames. docs: rel, has_frontmatter, error, frontmatter (JSON), body, body_line (lines before the body). The others by page: links (rel, target,
    line in the file), relations (rel, key, target), ref_defs (rel, line), footnote_refs (rel, label, line), footnote_defs (rel, label), wikilinks (rel, text, line)."""

    docs: DataFrame
    links: DataFrame
    relations: DataFrame
    ref_defs: DataFrame
    footnote_refs: DataFrame
    footnote_defs: DataFrame
    wikilinks: DataFrame

    @staticmethod
    def of_texts(docs: DataFrame) -> Corpus:
        """From documents as read_bundle gives them: everything is read from their bodies and frontmatter."""
        got = text_parts(docs, "body", ["rel", "body_line"], ["links", "ref_defs", "footnote_refs", "footnote_defs", "wikilinks"])
        each = lambda part: got.select("rel", "body_line", F.explode(part).alias("x"))
        line = (F.col("x.line") + F.col("body_line")).alias("line")
        facts = frontmatter_facts(docs)
        return Corpus(
            docs,
            each("links").select("rel", "x.target", line),
            facts.select("rel", F.explode("relations").alias("x")).select("rel", "x.key", "x.target"),
            each("ref_defs").select("rel", line),
            each("footnote_refs").select("rel", "x.label", line),
            got.select("rel", F.explode("footnote_defs").alias("label")),
            each("wikilinks").select("rel", "x.text", line),
        )

    @staticmethod
    def of_tables(spark: SparkSession, d: str) -> Corpus:
        """From the bundle tables: pages that exist now, their texts, and the references extracted from them."""
        own = table(spark, d, "bundle_page").where(F.col("deleted_at").isNull()).select("page_id", "rel", "frontmatter").distinct()
        text = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("body"))
        readable = F.coalesce(F.trim("frontmatter"), F.lit(""))
        docs = own.join(text, "page_id", "left").select("rel", (readable != "").alias("has_frontmatter"), F.lit(None).cast("string").alias("error"), "frontmatter", "body", F.lit(0).alias("body_line"))
        got = text_parts(docs, "body", ["rel"], ["footnote_refs", "footnote_defs", "wikilinks"])
        alive = own.select("rel").distinct()
        of = lambda name, *cols: table(spark, d, name).join(alive, "rel", "left_semi").select("rel", *cols).distinct()
        return Corpus(
            docs,
            of("page_link", "target", "line"),
            of("page_relation", "key", "target"),
            of("ref_def", "line"),
            got.select("rel", F.explode("footnote_refs").alias("x")).select("rel", "x.label", "x.line"),
            got.select("rel", F.explode("footnote_defs").alias("label")),
            got.select("rel", F.explode("wikilinks").alias("x")).select("rel", "x.text", "x.line"),
        )


_FACTS = {
    "readable": "boolean",
    "type": "string",
    "keys": "array<string>",
    "violations": "array<string>",
    "source_ids": "array<string>",
    "resources": "array<string>",
    "times": "array<struct<field:string,at:string,epoch:double>>",
    "stale_after": "string",
    "stale_at": "double",
    "locators": "array<string>",
    "relations": "array<struct<key:string,target:string>>",
}


def instant(text: str) -> float | None:
    """Seconds since 1970 of an ISO time with an offset, else None."""
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    return at.timestamp() if at.tzinfo else None


def frontmatter_facts(docs: DataFrame, relations: tuple[str, ...] = ()) -> DataFrame:
    """What the rules ask of each document's frontmatter: rel, and the columns of _FACTS. Unreadable frontmatter says nothing and has readable false."""

    def facts(text: str | None) -> dict[str, Any]:
        try:
            fm = json.loads(text) if text else None
        except ValueError:
            fm = None
        if not isinstance(fm, dict):
            return {"readable": False}
        kind = fm.get("type")
        sources = [s for s in (fm.get("sources") if isinstance(fm.get("sources"), list) else []) if isinstance(s, dict)]
        events = [("generated.at", fm.get("generated"))] + [("verified.at", e) for e in (fm["verified"] if isinstance(fm.get("verified"), list) else [fm.get("verified")])]
        links = []
        for key, v in fm.items():
            for item in v if isinstance(v, list) else [v]:
                got = parse_relation(item) if isinstance(item, str) else None
                if got and (not relations or key in relations):
                    links.append({"key": key, "target": got[1]})
        return {
            "readable": True,
            "type": kind.strip() if isinstance(kind, str) and kind.strip() else None,
            "keys": list(fm),
            "violations": violations(fm, relations),
            "source_ids": [str(s["id"]) for s in sources if s.get("id")],
            "resources": [s["resource"] for s in sources if isinstance(s.get("resource"), str)],
            "times": [{"field": f, "at": str(e["at"]), "epoch": instant(str(e["at"]))} for f, e in events if isinstance(e, dict) and e.get("at")],
            "stale_after": fm["stale_after"] if isinstance(fm.get("stale_after"), str) else None,
            "stale_at": instant(fm["stale_after"]) if isinstance(fm.get("stale_after"), str) else None,
            "locators": [x for x in (fm.get("locators") if isinstance(fm.get("locators"), list) else []) if isinstance(x, str)],
            "relations": links,
        }

    from quire.operators.markdown import _arrow

    types = {k: _arrow(v) for k, v in _FACTS.items()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [facts(t) for t in batch.column("frontmatter").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rel"), *[pa.array([g.get(k) for g in got], t) for k, t in types.items()]], names=["rel", *_FACTS])

    return docs.select("rel", "frontmatter").mapInArrow(read, "rel string, " + ", ".join(f"{k} {v}" for k, v in _FACTS.items()))


def check(c: Corpus, profile: Profile, now: datetime, extra_paths: DataFrame | None = None) -> DataFrame:
    """All diagnostics of a bundle: path, line, code, message, each once.

    now decides what is stale or in the future; extra_paths (rel) are files that exist besides the documents, images for instance. Documents without readable frontmatter or type get no further
    rules, templates none about their text. Every rule is one filter or anti-join; asked for one code, Spark plans that rule only.
    """
    docs = c.docs.withColumn("folder", folder_of(F.col("rel"))).withColumn("name", name_of(F.col("rel")))
    reserved = F.col("name").isin("index.md", "log.md")
    facts = frontmatter_facts(docs.where(~reserved), profile.relations)
    valid = facts.where(F.col("type").isNotNull()).withColumn("folder", folder_of(F.col("rel")))
    prose = valid.where(F.col("type") != "Template")
    pages = prose.select("rel").distinct()
    files = docs.select("rel") if extra_paths is None else docs.select("rel").unionByName(extra_paths.select("rel"))
    there = existing(files.distinct())
    out: list[DataFrame] = []

    def say(code: str, df: DataFrame, message: Column | str, line: Column | int = 1, path: str = "rel") -> None:
        message = F.lit(message) if isinstance(message, str) else message
        line = F.lit(line) if isinstance(line, int) else line
        out.append(df.select(F.col(path).alias("path"), line.cast("int").alias("line"), F.lit(code).alias("code"), message.alias("message")))

    quoted = lambda before, col, after="": F.concat(F.lit(before + "`"), col, F.lit("`" + after))
    unread = docs.where(~reserved).join(facts.where("readable").select("rel"), "rel", "left_anti")
    say("O001", unread.unionByName(docs.where(~reserved & F.col("error").isNotNull())), F.coalesce("error", F.when(F.col("has_frontmatter"), "unreadable frontmatter").otherwise("missing frontmatter")))
    say("O002", facts.where("readable and type is null"), "frontmatter needs a non-empty `type`")
    parts = valid.select("rel", F.explode(F.filter(F.split("folder", "/"), lambda x: x != "")).alias("part")).where(~is_kebab(F.regexp_replace("part", r"^_*\.*", "")))
    say("H001", parts, quoted("folder name ", F.col("part"), " is not kebab-case"))
    say("H001", valid.where(~is_kebab(stem_of(F.col("rel")))), quoted("file name ", name_of(F.col("rel")), " is not kebab-case"))
    say("H010", valid.select("rel", F.explode("violations").alias("x")), F.col("x"))
    known = [*COMMON, *profile.relations, *profile.fields]
    say("W010", valid.select("rel", F.explode("keys").alias("x")).where(~F.col("x").isin(known)), quoted("unknown frontmatter key ", F.col("x")))
    # types: a short list, so its rules are expressions
    say("H011", valid.where(~F.col("type").isin(*profile.types)), quoted("unknown type ", F.col("type")))
    top = F.when(F.instr("rel", "/") > 0, F.substring_index("rel", "/", 1)).otherwise("")
    misplaced, lacking = F.lit(False), []
    for name, spec in profile.types.items():
        allowed = F.lit(False)
        for f in spec.folders:
            allowed = allowed | (top.isin(*profile.domains) if f == "*" else (F.col("folder") == f) | F.col("folder").startswith(f + "/"))
        misplaced = F.when(F.col("type") == name, ~allowed).otherwise(misplaced)
        lacking += [F.when((F.col("type") == name) & ~F.array_contains("keys", k), F.lit(k)) for k in spec.required]
    say("H012", valid.where(misplaced), quoted("type ", F.col("type"), " does not belong here"))
    if lacking:
        say("H013", valid.select("rel", "type", F.explode(F.array_compact(F.array(*lacking))).alias("k")), quoted("missing key ", F.col("k")))
    # citations
    ids = prose.select("rel", F.explode("source_ids").alias("label")).distinct()
    cited = c.footnote_refs.join(pages, "rel", "left_semi")
    say("H020", cited.join(ids, ["rel", "label"], "left_anti"), quoted("no source has the id of footnote ", F.col("label")), F.col("line"))
    say("H021", cited.join(c.footnote_defs.distinct(), ["rel", "label"], "left_anti"), quoted("no definition of footnote ", F.col("label")), F.col("line"))
    say("W020", ids.join(cited.select("rel", "label").distinct(), ["rel", "label"], "left_anti"), quoted("never cited: source ", F.col("label")))
    res = prose.select("rel", F.explode("resources").alias("x")).where(F.col("x").startswith("/"))
    res = res.withColumn("dst", F.coalesce(file_path(F.col("x"), F.col("rel")), F.lit("..")))
    say("W021", res.join(there, "dst", "left_anti"), quoted("missing source resource ", F.col("x")))
    # links
    target, rel = F.col("target"), F.col("rel")
    links = c.links.where(is_internal(target) & (without_fragment(target) != "")).withColumn("dst", file_path(target, rel))
    own = links.join(pages, "rel", "left_semi")
    say("H030", own.where(leaves_bundle(target, rel)), quoted("leaves the bundle: ", target), F.col("line"))
    logs = docs.where(F.col("name") == "log.md").select("rel")
    say("W030", links.where(F.col("dst").isNotNull()).join(pages.unionByName(logs), "rel", "left_semi").join(there, "dst", "left_anti"), quoted("broken link ", target), F.col("line"))
    say("W031", own.where(F.col("dst").isNotNull() & ~target.startswith("/")), quoted("not bundle-absolute: ", target), F.col("line"))
    say("H032", c.wikilinks.join(pages, "rel", "left_semi"), quoted("a wikilink: ", F.substring("text", 1, 60)), F.col("line"))
    say("W033", c.ref_defs.join(pages, "rel", "left_semi"), "a reference-style link definition", F.col("line"))
    # relations
    related = c.relations.where(F.col("key").isin(*profile.relations) & is_internal(target) & (without_fragment(target) != "")).join(pages, "rel", "left_semi").withColumn("dst", file_path(target, rel))
    say("W032", related.where((F.col("dst") != "") & F.col("dst").isNotNull()).join(there, "dst", "left_anti"), F.concat("key", F.lit(": no target `"), target, F.lit("`")))
    say("H031", related.join(own.where(F.col("dst").isNotNull()).select("rel", "dst").distinct(), ["rel", "dst"], "left_anti"), F.concat("key", F.lit(": not linked from the body: `"), target, F.lit("`")))
    # times
    say("W040", prose.where(F.col("stale_at") <= now.timestamp()), F.concat(F.lit("stale since "), "stale_after"))
    at = prose.select("rel", F.explode("times").alias("x")).select("rel", "x.field", "x.at", "x.epoch")
    say("W041", at.where(F.col("epoch") > now.timestamp()), F.concat("field", F.lit(" is in the future: "), "at"))
    # locators
    loc = prose.select("rel", F.explode("locators").alias("x")).where(F.col("x").startswith("file:")).withColumn("root", F.regexp_extract("x", "^file:([^/]*)", 1))
    say("W060", loc.where(~F.col("root").isin(*profile.roots)), quoted("undeclared locator root ", F.col("root")))
    if profile.deny:
        say("H060", loc.where(F.col("root").isin(*profile.roots) & denied(F.substring("x", 6, 1 << 30), profile.deny)), quoted("denied locator ", F.col("x")))
    # indexes and logs
    index = docs.where(F.col("name") == "index.md")
    keys = F.coalesce(F.json_object_keys("frontmatter"), F.array(F.lit("?")))
    say("O003", index.where(F.col("has_frontmatter") & ((F.col("folder") != "") | (F.size(F.array_except(keys, F.array(F.lit(VERSION_KEY)))) > 0))), "an index has no frontmatter but the version at the root")
    lines = lambda df: df.select("rel", "body_line", F.posexplode(F.split("body", "\n")).alias("n", "text")).select("rel", (F.col("n") + F.col("body_line") + 1).alias("line"), F.regexp_replace("text", r"\r+\z", "").alias("text"))
    say("O004", lines(index).where((F.trim("text") != "") & ~F.col("text").startswith("#") & ~F.col("text").rlike(INDEX_LINE)), "no heading or entry", F.col("line"))
    log = docs.where(F.col("name") == "log.md")
    say("O005", log.where("has_frontmatter"), "a log has no frontmatter")
    heads = lines(log).where(F.col("text").startswith("## "))
    say("O005", heads.where(~F.col("text").rlike(DATE_LINE)), "a section's heading is its date", F.col("line"))
    dated = heads.where(F.col("text").rlike(DATE_LINE)).withColumn("day", F.substring("text", 4, 10))
    say("O005", unordered(dated, "rel", "line", "day"), "dates are unique, the newest first", F.col("line"))
    # folders
    have = folders_to_index(docs.where(~reserved).select("rel"), profile)
    own_entry = [f for f in profile.folders]
    auto = [f for f, s in profile.folders.items() if s.auto_children]
    above = folder_of(F.col("folder"))
    undeclared = have.where((F.col("folder") != "") & ~F.col("folder").isin(own_entry) & ~((above != "") & above.isin(auto)))
    say("W050", undeclared.select(F.concat("folder", F.lit("/")).alias("rel")), "no entry for the folder")
    wanted = expected_indexes(document_pages(docs.where(~reserved), facts), profile)
    late = stale_indexes(wanted, index.select("rel", "has_frontmatter", "frontmatter", "body"), have)
    say("H040", late, F.when(F.col("orphan"), "an index is left in a folder without pages").otherwise("the index is missing or out of date"))
    return reduce(DataFrame.unionByName, out).distinct()


def document_pages(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """The documents an index lists: rel, folder, type, title, description; what is not readable is left out."""
    fm = lambda k: F.get_json_object("frontmatter", f"$.{k}")
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    from quire.operators.catalog import page_title

    ok = docs.where(F.col("error").isNull())
    unreadable = facts.where(~F.col("readable")).select("rel").join(docs.where("has_frontmatter").select("rel"), "rel", "left_semi")
    ok = ok.join(unreadable, "rel", "left_anti")
    return ok.select("rel", folder_of(F.col("rel")).alias("folder"), F.when(F.trim(fm("type")) != "", F.trim(fm("type"))).alias("type"), page_title(fm("title"), F.col("rel")).alias("title"), F.coalesce(plain(fm("description")), F.lit("")).alias("description"))


def stale_indexes(wanted: DataFrame, index: DataFrame, have: DataFrame) -> DataFrame:
    """Index files that are missing, differ from what they should be, or stand in a folder without pages: rel, orphan."""
    head = F.when(F.col("has_frontmatter"), F.concat(F.lit(f'---\n{VERSION_KEY}: "'), F.coalesce(F.get_json_object("frontmatter", f"$.{VERSION_KEY}"), F.lit("")), F.lit('"\n---\n'))).otherwise("")
    actual = index.select("rel", F.concat(head, F.coalesce("body", F.lit(""))).alias("actual"))
    file = F.when(F.col("folder") == "", "index.md").otherwise(F.concat("folder", F.lit("/index.md")))
    both = wanted.select(file.alias("rel"), "content").join(actual, "rel", "full_outer")
    return both.where(~F.col("content").eqNullSafe(F.col("actual"))).select("rel", F.col("content").isNull().alias("orphan"))


def unordered(rows: DataFrame, group: str, place: str, value: str) -> DataFrame:
    """Rows whose value is not below that of the row before them in their group."""
    w = Window.partitionBy(group).orderBy(place)
    return rows.withColumn("__before", F.lag(value).over(w)).where(F.col(value) >= F.col("__before")).drop("__before")


def denied(path: Column, globs: tuple[str, ...]) -> Column:
    """Whether a path or a folder above it matches a glob, whatever the case."""
    up = F.concat(F.array(path), F.filter(ancestors(path), lambda a: a != ""))
    return reduce(lambda x, g: x | F.exists(up, lambda a: a.rlike(glob_regex(posixpath.normpath(g), ignore_case=True))), globs, F.lit(False))


def confined(root: str, path: Column, globs: tuple[str, ...] = ()) -> Column:
    """A path below a declared root as root/path, null where it leaves the root or is denied."""
    inside = F.when(~path.startswith("/"), normalize(path))
    whole = F.concat(F.lit(root + "/"), inside)
    return F.when((inside != "") & ~denied(whole, globs), whole)


def totals(diagnostics: DataFrame) -> DataFrame:
    """One row: errors, warnings, and the exit codes of a run and of a strict run."""
    errors, warnings = F.count_if(~F.col("code").startswith("W")), F.count_if(F.col("code").startswith("W"))
    return diagnostics.agg(errors.alias("errors"), warnings.alias("warnings")).select("*", (F.col("errors") > 0).cast("int").alias("exit_code"), (F.col("errors") + F.col("warnings") > 0).cast("int").alias("strict_exit_code"))
