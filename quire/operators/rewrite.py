"""Rewriting references: absolute targets, moved and merged pages. Every operator returns the edits as rows; nothing is changed in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.paths import encode_path, file_path, fragment_of, is_internal, name_of, normalize, percent_decode, without_fragment
from quire.functions.strings import casefold
from quire.operators.catalog import RESERVED


def absolute_targets(refs: DataFrame, there: DataFrame) -> DataFrame:
    """refs with new_target for relative targets: absolute by the file it names from its page, else by the one from the root, else unchanged (no row).

    refs: target, rel and any other columns; there: dst, all files and folders. Fragments are kept; external, absolute and bare targets have no row.
    """
    path = percent_decode(without_fragment(F.col("target")))
    own = refs.where(is_internal(F.col("target")) & (path != "") & ~path.startswith("/"))
    own = own.withColumn("__near", file_path(F.col("target"), F.col("rel"))).withColumn("__root", normalize(path)).withColumn("__id", F.monotonically_increasing_id())
    known = lambda c: there.select(F.col("dst").alias(c), F.lit(True).alias(f"{c}_ok")).where(F.col(c) != "").distinct()
    both = own.join(known("__near"), "__near", "left").join(known("__root"), "__root", "left")
    found = F.when(F.col("__near_ok"), F.col("__near")).when(F.col("__root_ok"), F.col("__root"))
    new = F.concat(F.lit("/"), encode_path(found), fragment_of(F.col("target")))
    return both.where(found.isNotNull()).select(*refs.columns, new.alias("new_target")).where(F.col("new_target") != F.col("target"))


def retargeted(refs: DataFrame, moves: DataFrame) -> DataFrame:
    """refs with new_target where pages move: references to an old path lead to the new one, and relative ones of a moved page become absolute, since its folder changes.

    refs: target, rel and other columns; moves: old, new (each old path once; a declared list, or any number). Fragments are kept; what stays as it is has no row.
    """
    own = refs.where(is_internal(F.col("target")) & (without_fragment(F.col("target")) != ""))
    own = own.withColumn("__path", file_path(F.col("target"), F.col("rel"))).where(F.col("__path").isNotNull())
    to = moves.select(F.col("old").alias("__path"), F.col("new").alias("__to"))
    leaving = moves.select(F.col("old").alias("rel"), F.lit(True).alias("__leaves"))
    both = own.join(to, "__path", "left").join(leaving, "rel", "left")
    rebased = F.when(F.col("__leaves") & ~F.col("target").startswith("/"), F.col("__path"))
    new = F.concat(F.lit("/"), encode_path(F.coalesce("__to", rebased)), fragment_of(F.col("target")))
    return both.select(*refs.columns, new.alias("new_target")).where(F.col("new_target").isNotNull() & (F.col("new_target") != F.col("target")))


def destination_errors(moves: DataFrame, files: DataFrame) -> DataFrame:
    """Why a move is refused: old, new, error, a row for each reason. moves: old, new (paths); files: rel, all files.

    Refused are an unknown or reserved page, an empty or unchanged path, another extension, a reserved name, a hidden folder, a path outside, one that exists (whatever its case), and one below a file.
    """
    ext = lambda c: F.lower(F.regexp_extract(name_of(c), r"(\.[^.]*)$", 1))
    old, new = F.col("old"), F.col("new")
    known = files.select(F.col("rel").alias("old"), F.lit(True).alias("__known"))
    taken = files.select(casefold(F.col("rel")).alias("__fold"), F.col("rel").alias("__twin")).distinct()
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("rel", "/"))), lambda n: F.array_join(F.slice(F.split("rel", "/"), F.lit(1), n), "/"))).alias("__d"), "rel")
    is_file = folders.where(F.col("__d") == F.col("rel")).select(F.col("__d").alias("__up"), F.lit(True).alias("__below"))
    m = moves.select("old", "new").distinct().withColumn("__fold", casefold(new)).join(known, "old", "left").join(taken, "__fold", "left")
    up = m.select("old", "new", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split(new, "/"))), lambda n: F.array_join(F.slice(F.split(new, "/"), F.lit(1), n), "/")), lambda a: a != new)).alias("__up"))
    below = up.join(is_file, "__up").select("old", "new", F.lit("a file is in the way").alias("error")).distinct()
    rules = {
        "not a file of the bundle": F.col("__known").isNull(),
        "a reserved file stays where it is": name_of(old).isin(*RESERVED),
        "no path": F.coalesce(new, F.lit("")) == "",
        "the same path": old == new,
        "another extension": ext(old) != ext(new),
        "a reserved name": name_of(new).isin(*RESERVED),
        "a hidden folder": F.concat(F.lit("/"), new).rlike(r"/\.[^/.]"),
        "outside the bundle": normalize(new).isNull(),
        "already there": F.col("__twin").isNotNull() & (F.col("__twin") != old),
    }
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return m.select("old", "new", F.explode(reasons).alias("error")).distinct().unionByName(below)


def renamed_expectations(questions: DataFrame, moves: DataFrame) -> DataFrame:
    """questions (qid, expected array of paths) with moved pages under their new names; a page that is then listed twice stays once, at its first place."""
    each = questions.select("qid", F.posexplode_outer("expected").alias("i", "rel")).join(moves.select(F.col("old").alias("rel"), "new"), "rel", "left")
    back = each.groupBy("qid").agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", F.coalesce("new", "rel").alias("rel"))))).alias("l"))
    return back.select("qid", F.array_distinct(F.transform("l", lambda x: x["rel"])).alias("expected"))


def apply_edits(text: Column, edits: Column) -> Column:
    """A text with spans replaced: edits are structs (start, end, new) with offsets in the text, in any order, not overlapping; applied from the right, so offsets hold."""
    ordered = F.reverse(F.array_sort(F.array_distinct(edits)))
    return F.aggregate(ordered, text, lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["new"], F.substring(t, e["end"] + 1, F.length(t))))


def union_keep_first(first: Column, second: Column) -> Column:
    """The elements of two lists, each once, in the order of their first occurrence; null lists are empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(first, none), F.coalesce(second, none))))


def merged_pages(p: DataFrame, merges: DataFrame) -> DataFrame:
    """The metadata of pages after others are folded into them: rel, tags, aliases, verified (always null: nobody has seen the result).

    p: rel, title, tags, aliases (a path once); merges: old, new, each old page once. Tags and aliases are united, the target's first, then those of the old pages by path; the titles of old pages
    become aliases unless they are the target's own. A page that is merged into itself is ignored.
    """
    old = merges.where(F.col("old") != F.col("new")).join(p.select(F.col("rel").alias("old"), "title", "tags", "aliases"), "old")
    none = F.array().cast("array<string>")
    part = F.struct("old", F.coalesce("tags", none).alias("tags"), F.coalesce("aliases", none).alias("aliases"), "title")
    gathered = old.groupBy(F.col("new").alias("rel")).agg(F.array_sort(F.collect_list(part)).alias("l"))
    both = p.select("rel", "title", "tags", "aliases").join(gathered, "rel")
    tags = union_keep_first(F.col("tags"), F.flatten(F.transform("l", lambda x: x["tags"])))
    aliases = union_keep_first(F.col("aliases"), F.flatten(F.transform("l", lambda x: F.concat(x["aliases"], F.array(x["title"])))))
    return both.select("rel", tags.alias("tags"), F.array_remove(aliases, F.col("title")).alias("aliases"), F.lit(None).cast("string").alias("verified"))


def merged_sources(sources: DataFrame, merges: DataFrame) -> DataFrame:
    """The sources (rel, id, resource, ord) of merged pages: the target's first; of one id the first stays, and `conflict` says whether others name another resource."""
    whole = sources.join(merges.select(F.col("old").alias("rel"), "new"), "rel", "left").withColumn("own", F.col("new").isNull()).withColumn("into", F.coalesce("new", "rel"))
    touched = whole.join(merges.select(F.col("new").alias("into")).distinct(), "into", "left_semi")
    got = touched.groupBy("into", "id").agg(F.min(F.struct((~F.col("own")).alias("late"), "rel", "ord", "resource")).alias("m"), F.count_distinct("resource").alias("n"))
    return got.select(F.col("into").alias("rel"), "id", "m.resource", (F.col("n") > 1).alias("conflict"))


def merged_relations(relations: DataFrame, merges: DataFrame) -> DataFrame:
    """The relations (rel, key, dst) of merged pages: united, led to the pages that remain, without those from a page to itself."""
    to = merges.select(F.col("old").alias("__o"), F.col("new").alias("__n"))
    moved = relations.join(to.withColumnsRenamed({"__o": "rel", "__n": "__from"}), "rel", "left").join(to.withColumnsRenamed({"__o": "dst", "__n": "__to"}), "dst", "left")
    got = moved.select(F.coalesce("__from", "rel").alias("rel"), "key", F.coalesce("__to", "dst").alias("dst")).distinct()
    return got.where(F.col("rel") != F.col("dst"))


def folder_moves(p: DataFrame, folders: Sequence[tuple[str, str]]) -> DataFrame:
    """Moves of all pages below folders: old, new."""
    out = F.lit(None).cast("string")
    for a, b in folders:
        out = F.coalesce(out, F.when(F.col("rel").startswith(a + "/"), F.concat(F.lit(b), F.substring("rel", len(a) + 1, 1 << 30))))
    return p.select(F.col("rel").alias("old"), out.alias("new")).where("new is not null").distinct()

