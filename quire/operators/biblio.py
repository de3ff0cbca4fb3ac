"""Bibliographic items kept as entity, attribute and value: search, records, and the page of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.skew import lookup

# What is part of another item and no item itself; fields that a search looks at.
PARTS = ("attachment", "note", "annotation")
SEARCHED = ("title", "date", "publicationTitle", "DOI")


def live_items(t: dict[str, DataFrame]) -> DataFrame:
    """Items that are neither deleted nor part of another: itemID, key, typeName."""
    own = lookup(t["items"], t["itemTypes"], ["itemTypeID"], "inner").where(~F.col("typeName").isin(*PARTS))
    return own.join(t["deletedItems"].select("itemID"), "itemID", "left_anti").select("itemID", "key", "typeName")


def item_fields(t: dict[str, DataFrame]) -> DataFrame:
    """The values of items: itemID, fieldName, value."""
    return lookup(t["itemData"], t["fields"], ["fieldID"], "inner").join(t["itemDataValues"], "valueID").select("itemID", "fieldName", "value")


def search_items(t: dict[str, DataFrame], text: str, limit: int | None = None, fields: tuple[str, ...] = SEARCHED) -> DataFrame:
    """Keys of items with a text in one of the fields or in a creator's last name, whatever its case, each once: key. With a limit, the smallest keys."""
    like = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    by_field = item_fields(t).where(F.col("fieldName").isin(*fields) & F.col("value").ilike(like)).select("itemID")
    by_name = t["itemCreators"].join(t["creators"], "creatorID").where(F.col("lastName").ilike(like)).select("itemID")
    got = live_items(t).join(by_field.unionByName(by_name).distinct(), "itemID", "left_semi").select("key").distinct()
    return got if limit is None else got.orderBy("key").limit(limit)


def item_records(t: dict[str, DataFrame]) -> DataFrame:
    """Items put together: key, typeName, fields (map), creators (array of names in their order)."""
    fields = item_fields(t).groupBy("itemID", "fieldName").agg(F.max("value").alias("value")).groupBy("itemID").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fieldName", "value")))).alias("fields"))
    name = F.concat_ws(" ", F.when(F.col("firstName") != "", F.col("firstName")), "lastName")
    people = t["itemCreators"].join(t["creators"], "creatorID").groupBy("itemID").agg(F.transform(F.array_sort(F.collect_list(F.struct("orderIndex", name.alias("name")))), lambda x: x["name"]).alias("creators"))
    both = live_items(t).join(fields, "itemID", "left").join(people, "itemID", "left")
    return both.select("key", "typeName", F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"), F.coalesce("creators", F.array().cast("array<string>")).alias("creators"))


def citation_key(fields: Column) -> Column:
    """An item's citation key: its own field, else the line `Citation Key:` of its extra field, else null."""
    extra = F.regexp_extract(F.coalesce(fields["extra"], F.lit("")), r"(?im)^Citation Key:[ \t]*(\S+)", 1)
    return F.coalesce(F.when(fields["citationKey"] != "", fields["citationKey"]), F.when(extra != "", extra))


def key_slug(key: Column) -> Column:
    """A citation key in kebab-case: words end where small letters meet capitals, and letters meet digits."""
    parts = F.regexp_replace(F.regexp_replace(key, r"([a-z])([A-Z])", "$1-$2"), r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", "-")
    return F.regexp_replace(F.regexp_replace(F.lower(parts), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def published(date: Column) -> Column:
    """The published date as year, year and month, or day, as far as it is given."""
    day = F.regexp_extract(date, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    month = F.regexp_extract(date, r"([0-9]{4}-[0-9]{2})(?![0-9])", 1)
    year = F.regexp_extract(date, r"(?<![0-9])([0-9]{4})(?![0-9])", 1)
    day = F.when(~day.rlike("-00$"), day)
    month = F.when(~month.rlike("-00$"), month)
    return F.coalesce(F.when(day != "", day), F.when(month != "", month), F.when(year != "", year))


def page_frontmatter(records: DataFrame, library: str = "user") -> DataFrame:
    """The metadata of an item's page: key, slug, type, title, resource (by DOI, else its address, else its place in the library), author, published, citekey."""
    f = F.col("fields")
    doi = F.regexp_replace(f["DOI"], r"^(?i)(?:https?://(?:dx\.)?doi\.org/|doi:)", "")
    resource = F.coalesce(F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)), F.when(f["url"].rlike("^https?://"), f["url"]), F.concat(F.lit(f"zotero://select/{'library' if library == 'user' else library.replace(':', 's/')}/items/"), "key"))
    cite = citation_key(f)
    author = F.when(F.size("creators") > 0, F.array_join("creators", "; "))
    return records.select("key", F.coalesce(key_slug(cite), F.lower("key")).alias("slug"), F.lit("Source").alias("type"), F.coalesce(f["title"], F.lit("")).alias("title"), resource.alias("resource"), author.alias("author"), published(f["date"]).alias("published"), cite.alias("citekey"))


def find_item(names: DataFrame, pages: DataFrame) -> DataFrame:
    """The item each name means: name, key; by key, else by slug, else by citation key, the smallest key of those. pages: key, slug, citekey."""
    out = None
    for rank, (column, own) in enumerate((("key", F.upper("name")), ("slug", F.col("name")), ("citekey", F.col("name")))):
        hit = names.withColumn("__v", own).join(pages.select(F.col(column).alias("__v"), F.col("key").alias("found")).where("__v is not null"), "__v").select("name", F.struct(F.lit(rank).alias("rank"), F.col("found")).alias("m"))
        out = hit if out is None else out.unionByName(hit)
    return out.groupBy("name").agg(F.min("m").alias("m")).select("name", F.col("m.found").alias("key"))


def full_text(attachments: DataFrame) -> DataFrame:
    """The text of an item from its attachments in order: key, text. attachments: key, ord, indexed, cached (either may be null; the index comes first)."""
    each = attachments.select("key", F.struct("ord", F.coalesce(F.when(F.col("indexed") != "", F.col("indexed")), F.col("cached")).alias("t")).alias("x")).where("x.t is not null")
    return each.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n").alias("text"))


def reference_parts(reference: Column) -> tuple[Column, Column, Column]:
    """Scheme and rest of a reference such as `file:root/path`, and whether it is a usable web address."""
    scheme = F.lower(F.regexp_extract(reference, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.when(scheme == "", reference).otherwise(F.substring(reference, F.length(scheme) + 2, F.length(reference)))
    web = scheme.isin("http", "https") & F.coalesce(F.try_parse_url(reference, F.lit("HOST")), F.lit("")).rlike(r"^[^\s]+$")
    return scheme, rest, web


def actor(name: Column) -> Column:
    """An actor's name without a bracketed suffix of its model, null where it has none of the three forms (human:, process:, tool/model)."""
    bare = F.trim(F.regexp_replace(name, r"\[[^\]]*\]\s*$", ""))
    return F.when(bare.rlike(r"^(human:[a-z0-9._-]+|process:[a-z0-9._-]+|[A-Za-z0-9._-]+/[A-Za-z0-9._:-]+)\z"), bare)
