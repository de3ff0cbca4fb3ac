"""Bundle paths and link targets as Column expressions (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folder_of(rel: Column) -> Column:
    """Folder of a bundle path, '' at the root."""
    return F.when(F.instr(rel, "/") == 0, F.lit("")).otherwise(F.regexp_replace(rel, "/[^/]*$", ""))


def name_of(rel: Column) -> Column:
    return F.regexp_extract(rel, "([^/]*)$", 1)


def stem_of(rel: Column) -> Column:
    return F.regexp_replace(name_of(rel), r"\.[^.]*$", "")


def percent_decode(s: Column) -> Column:
    """Percent-decoding that keeps '+' and leaves malformed escapes as they are written."""
    kept = F.replace(F.regexp_replace(s, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(F.instr(s, "%") > 0, F.url_decode(kept)).otherwise(s)


def normalize(path: Column) -> Column:
    """Follow '.', '..' and doubled slashes of a root-relative path; NULL if it leaves the root, '' for the root."""
    # a stack of segments; NULL once '..' meets an empty stack
    stack = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(acc.isNull(), F.lit(None).cast("array<string>"))
        .when((s == "") | (s == "."), acc)
        .when((s == "..") & (F.size(acc) == 0), F.lit(None).cast("array<string>"))
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(path.rlike(r"(^|/)\.{0,2}(/|$)"), F.array_join(stack, "/")).otherwise(path)


def has_scheme(target: Column) -> Column:
    return target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")


def is_internal(target: Column) -> Column:
    """No scheme, no '//' host, not a bare anchor."""
    return ~has_scheme(target) & ~target.startswith("//") & ~target.startswith("#")


def without_fragment(target: Column) -> Column:
    return F.substring_index(target, "#", 1)


def fragment_of(target: Column) -> Column:
    """The fragment with its '#', or ''."""
    return F.regexp_extract(target, "(?s)(#.*)$", 1)


def resolve(target: Column, folder: Column) -> Column:
    """Bundle path a target names when written in `folder`: absolute from the root, else relative; NULL outside the bundle."""
    p = percent_decode(without_fragment(target))
    whole = F.when(p.startswith("/"), F.substring(p, 2, 1 << 30)).when(folder == "", p).otherwise(F.concat(folder, F.lit("/"), p))
    return normalize(whole)


def encode_path(path: Column) -> Column:
    """A path as a link target: percent-encoded but for the characters that targets may hold."""
    coded = F.url_encode(path)
    for keep in "/~!$&'()*,;=:@":
        coded = F.regexp_replace(coded, "%%%02X" % ord(keep), F.lit("\\$" if keep == "$" else keep))
    return F.replace(F.regexp_replace(coded, r"\+", "%20"), F.lit("%2B"), F.lit("+"))


def file_path(target: Column, rel: Column) -> Column:
    """Path of the file or folder an internal reference written in `rel` names ('' the root); NULL for what is external, a bare anchor, or outside."""
    return F.when(is_internal(target) & (without_fragment(target) != ""), resolve(target, folder_of(rel)))


def leaves_bundle(target: Column, rel: Column) -> Column:
    """Whether an internal reference points outside the bundle."""
    return is_internal(target) & (without_fragment(target) != "") & resolve(target, folder_of(rel)).isNull()


def ancestors(rel: Column) -> Column:
    """All folders above a path, the root '' first."""
    parts = F.split(rel, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def page_path(target: Column, rel: Column) -> Column:
    """Path of the page an internal reference written in `rel` names; NULL for anything that is no page reference."""
    page = percent_decode(without_fragment(target)).endswith(".md")
    return F.when(is_internal(target) & page, resolve(target, folder_of(rel)))


def relation_parts(value: Column) -> tuple[Column, Column]:
    """Text and target of a value `[text](target)`, null for anything else."""
    shape = r"^\s*\[([^\]]+)\]\((?:<([^<>\n]*)>|([^()\s]+))\)\s*\z"
    part = lambda k: F.regexp_extract(value, shape, k)
    ok = value.rlike(shape)
    return F.when(ok, part(1)), F.when(ok, F.concat(part(2), part(3)))
