"""Importing notes: which are taken and where they go, by ordered rules; and what becomes of their text and properties."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions.paths import ancestors, folder_of, name_of, normalize, stem_of
from quire.functions.strings import casefold, glob_regex, slug
from quire.operators.catalog import RESERVED
from quire.operators.markdown import mask_code

# Files that are never imported; extensions of images; titles that are no names; a date in a name.
NEVER = ("**/node_modules/**", "**/.trash/**", "**/*.tmp")
IMAGES = ("png", "jpg", "jpeg", "gif", "svg", "webp", "avif", "bmp")
GENERIC = ("index", "readme", "untitled", "note")
DATE = r"(?<![0-9])([0-9]{4})[-_.]?([0-9]{2})[-_.]?([0-9]{2})(?![0-9])"


@dataclass(frozen=True)
class Rule:
    """match: globs over the source path; to: template of the destination; skip: leave out what matches; kebab: kebab-case the destination's names; type: of the page."""

    name: str
    match: tuple[str, ...]
    to: str = "{path}"
    skip: bool = False
    kebab: bool = False
    type: str = ""


def any_glob(path: Column, globs: Sequence[str], ignore_case: bool = False) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g, ignore_case))
    return out


def first_rule(path: Column, rules: Sequence[Rule]) -> Column:
    """The place of the first rule that matches a path, null if none does."""
    return F.coalesce(*[F.when(any_glob(path, r.match), F.lit(i)) for i, r in enumerate(rules)], F.lit(None).cast("int"))


def render(template: str, src: Column, kebab: bool = False, into: str = "") -> Column:
    """A destination from a template of {path}, {dir}, {parent}, {stem}, {name}, {ext}, {date}, {yyyy}, {mm}, {dd} (the date in the file's name, else in its path).

    A template without a leading slash is below `into`. Empty steps fall away. With kebab every name is put in kebab-case, the extension in small letters. Null where the template asks for a date
    that is not there, or names nothing.
    """
    dated = F.when(stem_of(src).rlike(DATE), stem_of(src)).otherwise(src)
    part = lambda k: F.when(dated.rlike(DATE), F.regexp_extract(dated, DATE, k))
    path = F.regexp_replace(src, r"\.[^./]*$", "")
    ext = F.regexp_extract(name_of(src), r"\.([^.]*)$", 1)
    values = {
        "path": path, "dir": folder_of(src), "parent": name_of(folder_of(src)), "stem": stem_of(src), "name": name_of(src), "ext": ext,
        "date": F.concat_ws("-", *[part(k) for k in (1, 2, 3)]), "yyyy": part(1), "mm": part(2), "dd": part(3),
    }
    pieces = [values[x[1:-1]] if x[:1] == "{" else F.lit(x) for x in re.split(r"(\{\w+\})", template) if x]
    if "{date}" in template:
        pieces.append(F.when(dated.rlike(DATE), F.lit("")))
    whole = F.regexp_replace(F.regexp_replace(F.concat(*pieces), "/+", "/"), "^/|/$", "")
    if kebab:
        steps = F.split(whole, "/")
        last = F.element_at(steps, -1)
        name = F.when(F.instr(F.substring(last, 2, 1 << 30), ".") > 0, F.concat(slug(F.regexp_replace(last, r"\.[^.]*$", "")), F.lower(F.regexp_extract(last, r"(\.[^.]*)$", 1)))).otherwise(slug(last))
        dirs = F.regexp_replace(F.regexp_replace(slug(F.regexp_replace(F.array_join(F.slice(steps, F.lit(1), F.size(steps) - 1), "/"), "/", " zzslashzz ")), "-*zzslashzz-*", "/"), "^/|/$", "")
        whole = F.when(F.size(steps) > 1, F.concat(dirs, F.lit("/"), name)).otherwise(name)
    below = whole if template.startswith("/") or not into else F.concat(F.lit(into.strip("/") + "/"), whole)
    return F.when(whole != "", normalize(below))


def plan(sources: DataFrame, notes: Sequence[Rule], files: Sequence[Rule] = (), exclude: Sequence[str] = (), max_bytes: int = 1 << 24, into: str = "") -> DataFrame:
    """What happens to each source file: src, size, note, rule, type, dest, reason ('' for what is imported).

    sources: src, size, problem (why it cannot be read, or null). The first reason holds: excluded, its problem, no rule (a file without one may still come along
    with a note that shows it), left out by a rule, no name, too large (files only). Hidden and never imported files have no row.
    """
    src = F.col("src")
    own = sources.where(~F.concat(F.lit("/"), src).rlike(r"/\.") & ~any_glob(src, NEVER, True)).withColumn("note", F.lower(src).endswith(".md"))
    place = F.when(F.col("note"), first_rule(src, notes)).otherwise(first_rule(src, files) if files else F.lit(None).cast("int"))
    own = own.withColumn("__r", place)
    pick = lambda of: F.coalesce(*[F.when(F.col("note") == isnote, F.when(F.col("__r") == i, of(r))) for isnote, rules in ((True, notes), (False, files)) for i, r in enumerate(rules)], F.lit(None).cast("string"))
    template = lambda r: r.to if r.to.endswith((".md", "{name}")) else r.to + ".md"
    dest = F.coalesce(*[F.when(F.col("note") == isnote, F.when(F.col("__r") == i, render(template(r) if isnote else r.to, src, r.kebab, into))) for isnote, rules in ((True, notes), (False, files)) for i, r in enumerate(rules) if not r.skip], F.lit(None).cast("string"))
    skipped = F.coalesce(pick(lambda r: F.lit("yes" if r.skip else "no")), F.lit("no")) == "yes"
    own = own.select("src", "size", "problem", "note", "__r", pick(lambda r: F.lit(r.name)).alias("rule"), pick(lambda r: F.lit(r.type)).alias("type"), skipped.alias("__skip"), dest.alias("dest"))
    reason = (
        F.when(any_glob(src, exclude, True), "excluded")
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("__r").isNull(), F.when(F.col("note"), "no rule matches").otherwise("attachment"))
        .when(F.col("__skip"), "left out by a rule")
        .when(F.col("dest").isNull(), "no name")
        .when(~F.col("note") & (F.col("size") > max_bytes), "too large")
        .otherwise("")
    )
    return own.withColumn("reason", reason).select("src", "size", "note", "rule", "type", F.when(F.col("reason") == "", F.col("dest")).alias("dest"), "reason")


def with_attachments(planned: DataFrame, shown: DataFrame, max_bytes: int = 1 << 24, into: str = "") -> DataFrame:
    """A plan in which the images that imported notes show come along to `assets/`. shown: src (of the note), target (source path of the file)."""
    wanted = shown.join(planned.where("note and reason = ''").select("src"), "src", "left_semi").select(F.col("target").alias("src"), F.lit(True).alias("__w")).distinct()
    both = planned.join(wanted, "src", "left")
    linked = ~F.col("note") & (F.col("reason") == "attachment") & F.coalesce("__w", F.lit(False))
    image = F.lower(F.regexp_extract("src", r"\.([^.]*)$", 1)).isin(*IMAGES)
    fits = F.col("size") <= max_bytes
    dest = F.when(linked & image & fits, render("assets/{name}", F.col("src"), True, into)).otherwise(F.col("dest"))
    reason = F.when(linked & image & fits, "").when(linked & image, "too large").when(linked, "linked document").otherwise(F.col("reason"))
    return both.select("src", "size", "note", "rule", "type", dest.alias("dest"), reason.alias("reason"))


def destination_errors(planned: DataFrame, there: DataFrame) -> DataFrame:
    """Why a plan cannot be carried out: src, dest, error. there: rel, the files of the bundle.

    Errors are a destination of several files, also if only its case differs, one that is another's folder, one that exists (in any case), a reserved name, one outside.
    Destinations meet in groups by their folded path; of each group only counts are kept.
    """
    own = planned.where("reason = ''").withColumn("__k", casefold(F.col("dest")))
    groups = own.groupBy("__k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dest").alias("kinds"))
    many = own.join(groups.where("n > 1"), "__k").select("src", "dest", F.when(F.col("kinds") == 1, "several files map here").otherwise("differs only in case").alias("error"))
    ups = own.select(F.explode(F.filter(ancestors(F.col("__k")), lambda a: a != "")).alias("__k")).distinct()
    folder = own.join(ups, "__k", "left_semi").select("src", "dest", F.lit("is also a folder").alias("error"))
    old = there.select(casefold(F.col("rel")).alias("__k"), "rel").distinct()
    exists = own.join(old, "__k").select("src", "dest", F.when(F.col("rel") == F.col("dest"), "already exists").otherwise("differs only in case from an existing file").alias("error"))
    name = own.where(F.col("note") & name_of(F.col("dest")).isin(*RESERVED)).select("src", "dest", F.lit("a reserved name").alias("error"))
    outside = own.where(normalize(F.col("dest")).isNull()).select("src", "dest", F.lit("outside the bundle").alias("error"))
    return many.unionByName(folder).unionByName(exists).unionByName(name).unionByName(outside).distinct()


def name_forms(files: DataFrame) -> DataFrame:
    """Every name by which a link may mean a file: form (folded), rel. Forms are the path and each of its ends, with and without `.md`; `a___b` also means a/b."""
    key = casefold(F.col("rel"))
    own = files.select("rel", key.alias("k")).withColumn("parts", F.split("k", "/"))
    ends = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "/"))
    bare = F.transform(F.filter(ends, lambda e: e.endswith(".md")), lambda e: F.regexp_replace(e, r"\.md$", ""))
    spaced = F.when(stem_of(F.col("k")).contains("___"), F.array(F.replace(stem_of(F.col("k")), F.lit("___"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return own.select("rel", F.explode(F.array_distinct(F.concat(ends, bare, spaced))).alias("form"))


def resolve_names(names: DataFrame, files: DataFrame) -> DataFrame:
    """The file each name means where it stands: name, folder, rel. Of several the one in the same folder, then a page, then the one highest up, then the smallest path.

    names: name, folder (of the page it stands in). Names meet the files' forms in a join; the best is a minimum, partially aggregated.
    """
    own = names.select("name", "folder").distinct().withColumn("form", F.regexp_replace(casefold(F.trim("name")), "^/+", "")).where("form <> ''")
    hits = own.join(name_forms(files), "form")
    rank = F.struct((folder_of(F.col("rel")) != F.col("folder")).alias("away"), (~F.col("rel").endswith(".md")).alias("file"), (F.size(F.split("rel", "/"))).alias("depth"), F.col("rel"))
    return hits.groupBy("name", "folder").agg(F.min(rank).alias("m")).select("name", "folder", "m.rel")


#: Keys of a mapping and of its rules.
MAPPING_KEYS = ("label", "actor", "notes", "files", "exclude", "max_bytes", "timestamp", "rename", "drop", "values", "tags")
RULE_KEYS = ("match", "to", "skip", "kebab", "type", "title")


def mapping_errors(mapping: object, types: Sequence[str] = ()) -> list[str]:
    """Every error in an import mapping as it was read: shapes, unknown keys, rules that match or name nothing, patterns that don't compile, unknown types."""
    if not isinstance(mapping, dict):
        return ["a mapping is a table of keys"]
    out = [f"unknown key `{k}`" for k in mapping if k not in MAPPING_KEYS]
    if not isinstance(mapping.get("actor"), str) or not re.fullmatch(r"(human|process):[a-z0-9._-]+|[A-Za-z0-9._-]+/[A-Za-z0-9._:-]+", mapping["actor"]):
        out.append("`actor` must name who imports")
    size = mapping.get("max_bytes", 1)
    if not isinstance(size, int) or isinstance(size, bool) or size < 1:
        out.append("`max_bytes` must be a number above 0")
    for group in ("notes", "files"):
        rules = mapping.get(group, [])
        if not isinstance(rules, list):
            out.append(f"`{group}` must be a list of rules")
            continue
        for i, r in enumerate(rules, 1):
            where = f"{group} rule {i}"
            if not isinstance(r, dict):
                out.append(f"{where}: no table of keys")
                continue
            out += [f"{where}: unknown key `{k}`" for k in r if k not in RULE_KEYS]
            match = r.get("match")
            globs = [match] if isinstance(match, str) else match
            if not isinstance(globs, list) or not globs or not all(isinstance(g, str) and g for g in globs):
                out.append(f"{where}: `match` must name globs")
            if not r.get("skip") and not (isinstance(r.get("to"), str) and r["to"].strip("/")):
                out.append(f"{where}: `to` must say where it goes")
            out += [f"{where}: unknown placeholder {{{x}}}" for x in re.findall(r"\{(\w*)\}", str(r.get("to", ""))) if x not in ("path", "dir", "parent", "stem", "name", "ext", "date", "yyyy", "mm", "dd")]
            if types and r.get("type") and r["type"] not in types:
                out.append(f"{where}: unknown type {r['type']}")
    for t in mapping.get("tags", {}).get("drop", []) if isinstance(mapping.get("tags"), dict) else []:
        try:
            re.compile(t)
        except re.error as e:
            out.append(f"tags: {t}: {e}")
    return out


def relation_links(values: DataFrame, resolved: DataFrame, template: str = "") -> DataFrame:
    """Relation values of notes as links to pages: src, key, value, link. values: src, key, value (a name, perhaps in double brackets).

    resolved: src, name, dest, the names that mean an imported page; of the others the template makes the target ({slug} stands for the value's slug), without one they have no row.
    """
    own = values.withColumn("name", F.trim(F.regexp_replace("value", r"^\[\[([^\]|#]*)[^\]]*\]\]$", "$1")))
    both = own.join(resolved.select("src", "name", "dest"), ["src", "name"], "left")
    made = F.when(F.lit(template != ""), F.replace(F.lit(template.lstrip("/")), F.lit("{slug}"), slug(F.col("name"))))
    target = F.coalesce("dest", made)
    return both.where(target.isNotNull()).select("src", "key", "value", F.concat(F.lit("["), "name", F.lit("](/"), target, F.lit(")")).alias("link"))


# --- texts and properties --------------------------------------------------------------------------------------------


def plain(text: Column) -> Column:
    """A text without comments, links and emphasis, white space collapsed."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"(?s)%%.*?%%", "")
    t = F.regexp_replace(t, r"!?\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"`|\*\*|__|~~", "")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def heading_anchor(title: Column) -> Column:
    """The anchor of a heading: small letters, spaces as hyphens, other marks dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), r"(?U)[^\w\s-]", ""), r"(?U)\s", "-")


_STRUCTURE = ("#", "|", ">", "<", "---", "![", "```", "~~~")
_MARK = re.compile(r"^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+(?:\[.\][ \t]+)?")


def first_paragraph(body: str | None) -> str | None:
    """The first lines of prose of a body, joined: no headings, tables, quotes, code or comments; a list item counts without its mark. Null if there is none."""
    if not body:
        return None
    out: list[str] = []
    for line, seen in zip(body.split("\n"), mask_code(body).split("\n")):
        bare = line.strip()
        other = not seen.strip() or bare.startswith(_STRUCTURE)
        if out and (other or _MARK.match(line)):
            break
        if not other:
            out.append(_MARK.sub("", line).strip())
    return " ".join(out) or None


@F.udf(StringType(), useArrow=True)
def _first_paragraph(body):
    return first_paragraph(body)


def description(body: Column) -> Column:
    """The first sentence of a body's first paragraph; cut at a word with an ellipsis beyond 200 characters; null under twelve."""
    text = plain(_first_paragraph(body))
    sentence = F.element_at(F.split(text, r"(?<=[.!?])\s", 2), 1)
    cut = F.concat(F.regexp_replace(F.regexp_replace(F.substring(sentence, 1, 200), r" [^ ]*$", ""), "[,;:]+$", ""), F.lit("…"))
    return F.when(F.length(text) >= 12, F.when(F.length(sentence) > 200, cut).otherwise(sentence))


def title_of(h1: Column, prop: Column, src: Column, template: Column | None = None) -> Column:
    """A note's title: the rule's, else its first heading, else its property, else the file's stem with `___` as a slash."""
    full = lambda c: F.when(F.trim(c) != "", c)
    names = [full(template)] if template is not None else []
    return F.coalesce(*names, plain(full(h1)), plain(full(prop)), F.replace(stem_of(src), F.lit("___"), F.lit("/")))


def page_time(prop_us: Column, commit: Column, modified: Column, now: Column) -> Column:
    """When a note was written: by its property, else its last commit, else its file, and never after now."""
    return F.least(F.coalesce(prop_us, commit, modified), now)


def page_tags(written: Column, inline: Column, mapping: dict[str, str], drop: str = "", extra: Sequence[str] = ()) -> Column:
    """Tags of a page: those of its property and text, mapped, without those that match `drop`, in kebab-case (a slash stays), each once, then the rule's."""
    none = F.array().cast("array<string>")
    each = F.transform(F.concat(F.coalesce(written, none), F.coalesce(inline, none)), lambda t: F.regexp_replace(F.trim(t), "^#", ""))
    if mapping:
        table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        each = F.transform(each, lambda t: F.coalesce(table[t], t))
    if drop:
        each = F.filter(each, lambda t: ~t.rlike(f"^(?:{drop})\\z"))
    shaped = F.transform(each, lambda t: F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9/]+", "-"), "^-+|-+$|(?<=/)-+|-+(?=/)", ""))
    return F.array_distinct(F.concat(F.filter(shaped, lambda t: t != ""), F.array(*[F.lit(t) for t in extra]).cast("array<string>")))


def page_aliases(aliases: Column, src: Column, title: Column) -> Column:
    """Aliases of a page: its own, and the file's stem unless it says nothing or equals the title."""
    stem = stem_of(src)
    own = F.when(~F.lower(stem).isin(*GENERIC) & (F.lower(stem) != F.lower(title)), F.array(stem)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(aliases, F.array().cast("array<string>")), own)))


def _value_map(key: str, table: Column):
    """The values of one key by a table, those that it lacks as they are."""
    return lambda k, v: F.when(k == key, F.coalesce(table[v], v)).otherwise(v)


def mapped_properties(props: Column, rename: dict[str, str], drop: Sequence[str] = (), values: dict[str, dict[str, str]] | None = None) -> Column:
    """Properties after the mapping: dropped ones gone, values mapped, keys renamed (a renamed key does not replace one that is there)."""
    p = F.map_filter(F.coalesce(props, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*drop)) if drop else F.coalesce(props, F.create_map().cast("map<string,string>"))
    for key, table in (values or {}).items():
        p = F.transform_values(p, _value_map(key, F.create_map(*[F.lit(x) for kv in table.items() for x in kv])))
    if rename:
        t = F.create_map(*[F.lit(x) for kv in rename.items() for x in kv])
        kept = F.filter(F.map_entries(p), lambda e: t[e["key"]].isNull() | ~F.map_contains_key(p, t[e["key"]]))
        p = F.map_from_entries(F.transform(kept, lambda e: F.struct(F.coalesce(t[e["key"]], e["key"]), e["value"])))
    return p


_WIKILINK = re.compile(r"(!?)\[\[([^\]\n]+)\]\]")


def convert_body(body: str | None, names: dict[str, str]) -> str | None:
    """A body with its wikilinks as links: names gives the page of each name that resolves; others stay as their text. Comments `%%…%%` become HTML comments; code stays."""
    if body is None:
        return None
    seen = mask_code(body)
    out, at = [], 0
    for m in sorted([*_WIKILINK.finditer(seen), *re.finditer(r"%%(.*?)%%", seen, re.S)], key=lambda m: m.start()):
        if m.start() < at:
            continue
        out.append(body[at : m.start()])
        at = m.end()
        if m[0].startswith("%%"):
            out.append("<!--" + body[m.start(1) : m.end(1)] + "-->")
            continue
        target, _, text = body[m.start(2) : m.end(2)].replace("\\|", "|").partition("|")
        name, _, part = target.partition("#")
        dest = names.get(name.strip())
        label = text or target
        if dest is None:
            out.append(label)
        else:
            out.append(f"{m[1]}[{label}](/{dest}" + (f"#{re.sub(r'[^\w-]', '', part.strip().lower().replace(' ', '-'))}" if part and not m[1] else "") + ")")
    return "".join([*out, body[at:]])


@F.udf(StringType(), useArrow=True)
def _convert(body, names):
    return convert_body(body, dict(names or {}))


def converted(notes: DataFrame, resolved: DataFrame) -> DataFrame:
    """notes (src, body) with body converted; resolved: src, name, dest, the names of each note that mean an imported page."""
    names = resolved.groupBy("src").agg(F.map_from_entries(F.collect_set(F.struct("name", "dest"))).alias("__n"))
    return notes.join(names, "src", "left").withColumn("body", _convert("body", "__n")).drop("__n")


def last_times(commits: DataFrame) -> DataFrame:
    """The last commit of each file: rel, at."""
    return commits.groupBy("rel").agg(F.max("at").alias("at"))

