"""The generated indexes: which folders have one, and what it says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.paths import ancestors, encode_path, folder_of, name_of
from quire.functions.strings import casefold
from quire.operators.catalog import is_tooling
from quire.operators.profile import Profile

# The key and value by which a root index names the version of its format; headings of folders outside any group, and of an index without entries; the type of pages without one.
VERSION_KEY, VERSION = "okf_version", "0.2"
FOLDERS, EMPTY, UNTYPED = "Folders", "Pages", "Untyped"


def folders_to_index(pages: DataFrame, profile: Profile) -> DataFrame:
    """Folders that have an index: those with pages anywhere below, and those of the profile with all above them; no tooling folders: folder."""
    spark = pages.sparkSession
    own = pages.where(~is_tooling(folder_of(F.col("rel")))).select(F.explode(ancestors(F.col("rel"))).alias("folder"))
    declared = {""}
    for f in profile.folders:
        if not any(p[:1] in "_." for p in f.split("/")):
            declared |= {f.rsplit("/", n)[0] for n in range(f.count("/") + 1)}
    return own.unionByName(spark.createDataFrame([(f,) for f in sorted(declared)], "folder string")).distinct()


def _case(column: Column, values: dict[str, str], default: Column) -> Column:
    """A column's value by a short fixed mapping."""
    if not values:
        return default
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[column], default)


def _sentence(folder: Column) -> Column:
    name = F.replace(name_of(folder), F.lit("-"), F.lit(" "))
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1 << 30)))


def folder_contexts(folders: DataFrame, profile: Profile) -> DataFrame:
    """Title and description of folders: folder, title, description."""
    titles = {f: s.title for f, s in profile.folders.items() if s.title}
    texts = {f: s.description for f, s in profile.folders.items() if s.description}
    auto = [f for f, s in profile.folders.items() if s.auto_children]
    own = F.when(folder_of(F.col("folder")).isin(auto) & ~F.col("folder").isin(list(profile.folders)), name_of(F.col("folder"))).otherwise(_sentence(F.col("folder")))
    return folders.select("folder", _case(F.col("folder"), titles, own).alias("title"), _case(F.col("folder"), texts, F.lit("")).alias("description"))


def newest_first(folder: Column, profile: Profile) -> Column:
    """Whether a folder lists by name, the newest first; inherited from the nearest folder above that has a sort."""
    out = F.lit(False)
    for f, s in sorted(profile.folders.items(), key=lambda x: x[0].count("/")):
        if s.sort:
            out = F.when((folder == f) | folder.startswith(f + "/"), s.sort == "date-desc").otherwise(out)
    return out


def escape_entry(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))


def _entry(title: Column, href: Column, description: Column) -> Column:
    line = F.concat(F.lit("* ["), escape_entry(title), F.lit("]("), encode_path(href), F.lit(")"))
    return F.when(description != "", F.concat(line, F.lit(" - "), description)).otherwise(line)


def index_entries(pages: DataFrame, profile: Profile) -> DataFrame:
    """Every line of every index: folder, section_ord, heading, k1..k3 (the order within its section), descending (whether k2 runs down), line.

    pages: rel, folder, type, title, description. The root lists its folders by group, others theirs in one section; then come the pages by type, in the profile's order of
    types, unknown types last. Folders and pages stand by title, or by name, newest first, where the folder says so.
    """
    types = list(profile.types)
    order = {t: f"{i:06}" for i, t in enumerate(types)}
    kind = F.coalesce("type", F.lit(UNTYPED))
    down = newest_first(F.col("folder"), profile)
    shown = pages.where(~is_tooling(F.col("folder")))
    items = shown.select(
        "folder",
        F.concat(F.lit("2"), _case(kind, order, F.concat(F.lit("~"), kind))).alias("section_ord"),
        _case(kind, {t: s.plural for t, s in profile.types.items()}, kind).alias("heading"),
        F.when(down, F.lit("")).otherwise(casefold(F.col("title"))).alias("k1"),
        name_of(F.col("rel")).alias("k2"),
        down.alias("descending"),
        _entry(F.col("title"), F.concat(F.lit("./"), name_of(F.col("rel"))), F.col("description")).alias("line"),
    )
    children = folder_contexts(folders_to_index(pages, profile).where(F.col("folder") != ""), profile)
    parent = folder_of(F.col("folder"))
    groups = {f: s.group for f, s in profile.folders.items() if s.group}
    places = {f: f"{i:06}" for i, f in enumerate(profile.folders)}
    rank = {g: f"{i:06}" for i, g in enumerate(profile.root_groups)}
    group = _case(F.col("folder"), groups, F.lit(FOLDERS))
    down = newest_first(parent, profile)
    child = children.select(
        parent.alias("folder"),
        F.concat(F.lit("1"), F.when(parent == "", _case(group, rank, F.concat(F.lit("~"), group))).otherwise("")).alias("section_ord"),
        F.when(parent == "", group).otherwise(FOLDERS).alias("heading"),
        F.when(parent == "", _case(F.col("folder"), places, F.lit("~"))).when(down, "").otherwise(casefold(F.col("title"))).alias("k1"),
        F.col("folder").alias("k2"),
        ((parent != "") & down).alias("descending"),
        _entry(F.col("title"), F.concat(F.lit("./"), name_of(F.col("folder")), F.lit("/index.md")), F.col("description")).alias("line"),
    )
    return items.unionByName(child)


def expected_indexes(pages: DataFrame, profile: Profile) -> DataFrame:
    """The content of every index: folder, content. An index is one file, so a folder's lines come together in one value; only its own lines do."""
    entries = index_entries(pages, profile)
    up = F.array_sort(F.collect_list(F.struct("k1", "k2", "line")))
    lists = entries.groupBy("folder", "section_ord", "heading", "descending").agg(up.alias("l"))
    lines = F.transform(F.when(F.col("descending"), F.reverse("l")).otherwise(F.col("l")), lambda x: x["line"])
    sections = lists.select("folder", "section_ord", F.concat(F.lit("# "), "heading", F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("text"))
    bodies = sections.groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_ord", "text"))), lambda x: x["text"]), "\n").alias("body"))
    every = folders_to_index(pages, profile).join(bodies, "folder", "left").withColumn("body", F.coalesce("body", F.lit(f"# {EMPTY}\n")))
    return every.select("folder", F.when(F.col("folder") == "", F.concat(F.lit(f'---\n{VERSION_KEY}: "{VERSION}"\n---\n\n'), "body")).otherwise(F.col("body")).alias("content"))
