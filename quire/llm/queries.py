"""Queries of the llm problems over the bundle tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.components import candidate_matches, groups
from quire.llm.cooccur import item_pairs
from quire.llm.mojibake import corpus_letters, garbled_values
from quire.llm.neardup import duplicate_pairs, link_counts, near_duplicates
from quire.llm.packing import certificates, container_fill, pack
from quire.llm.sentences import corpus_words, sentence_positions, split_sentences
from quire.llm.tokenizer import decode_column, encode_column, token_counts
from quire.session import checkpoint
from quire.sources import table

#: Tokens a container of problem 9 holds.
CONTAINER = 2048


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_pairs(*near_duplicates(table(spark, d, "documents"), "doc_id", "text"))


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    return link_counts(*near_duplicates(table(spark, d, "documents"), "doc_id", "text")).withColumnRenamed("id", "doc_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return groups(candidate_matches(table(spark, d, "dup_candidate")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pairs(spark, d).select("item_a", "item_b")


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = item_pairs(table(spark, d, "graph_out"), "page_id", "targets", "built_at", max_items=60, min_count=5, min_lift=10.0)
    return pairs.withColumn("lift", F.round("lift", 6)).withColumn("odds_ratio", F.round("odds_ratio", 4))


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "source_note")
    fields = F.map_concat(F.transform_keys(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda k, v: F.concat(F.lit("props."), k)), F.create_map(F.lit("body"), F.col("body")))
    values = notes.select("note_id", F.explode(fields).alias("field", "value")).where(F.col("value").isNotNull())
    return garbled_values(values, "value", ["note_id", "field"], corpus_letters(values, "value"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("note_id", "field").distinct()


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("note_id", "field", "restored").distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(table(spark, d, "documents"), "text", ["doc_id"])


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_counts(table(spark, d, "documents"), "text", ["doc_id"]), "n_tokens", CONTAINER, ["doc_id"])


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnsRenamed({"start": "start_token", "n": "n_tokens"})


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    fill = container_fill(_packed(spark, d))
    one = fill.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("most_tokens"))
    return one.withColumn("filled", F.round(F.col("n_tokens") / (F.col("n_containers") * CONTAINER), 4))


def p9_certificates(spark: SparkSession, d: str) -> DataFrame:
    """Bins, certified lower bound and gap of each partition of the packing."""
    return certificates(_packed(spark, d), CONTAINER)


def p9_whole(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document is in containers with all its tokens, and only a document larger than a container is split; and whether its containers hold no more than they may."""
    packed = checkpoint(_packed(spark, d))
    full = container_fill(packed).select("container", (F.col("n_tokens") <= CONTAINER).alias("fits"))
    got = packed.join(full, "container").groupBy("doc_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pieces"), F.bool_and("fits").alias("fits"))
    want = token_counts(table(spark, d, "documents"), "text", ["doc_id"])
    same = (F.col("n") == F.col("n_tokens")) & (F.col("pieces") == F.greatest(F.ceil(F.col("n_tokens") / CONTAINER), F.lit(1)))
    return want.join(got, "doc_id", "left").select("doc_id", F.coalesce(same, F.lit(False)).alias("whole"), F.coalesce("fits", F.lit(False)).alias("fits"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The texts decoded from their ids."""
    return decode_column(p8_ids(spark, d), "ids", ["doc_id"]).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return sentence_positions(docs, "text", ["doc_id"], corpus_words(docs, "text")).distinct()


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return split_sentences(docs, "text", ["doc_id"], corpus_words(docs, "text"))


QUERIES = {f.__name__: f for f in (p2_found, p2_links, p4_found, p6_found, p6_pairs, p7_found, p7_restored, p8_ids, p8_round_trip, p9_containers, p9_fill, p9_certificates, p9_whole, p10_found, p10_sentences)}

_P6 = """
with one as (
  select page_id, list_sort(list_distinct([x for x in arg_max(targets, built_at) if x is not null])) as items
  from graph_out where targets is not null and page_id is not null group by page_id),
sets as (select * from one where len(items) between 1 and 60),
total as (select count(*) as n from sets),
rows as (select page_id, unnest(items) as item from sets),
single as (select item, count(*) as n from rows group by item),
pairs as (select x.item as item_a, y.item as item_b, count(*) as n_ab
  from rows x join rows y on x.page_id = y.page_id and x.item < y.item group by 1, 2 having count(*) >= 5),
good as (select item_a, item_b, n_ab, s.n as n_a, t.n as n_b, total.n as n_baskets
  from pairs join single s on s.item = item_a join single t on t.item = item_b cross join total
  where n_ab * total.n >= 10 * s.n * t.n)
"""

_P2 = """
with w as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
s as (select doc_id, unnest(list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)])) as s from w where len(w) >= 5),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select x.doc_id as doc_a, y.doc_id as doc_b, count(*) as c from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2)
select doc_a, doc_b from pairs join n a on a.doc_id = doc_a join n b on b.doc_id = doc_b where c >= 0.5 * (a.n + b.n - c)
"""
_P2_LINKS = (
    _P2.replace("select doc_a, doc_b from pairs", ", found as (select doc_a, doc_b from pairs").rstrip()
    + """),
both_ways as (select doc_a as doc_id, doc_b as other from found union all select doc_b, doc_a from found),
sets as (select doc_id, list_sort(list(s)) as l from s group by doc_id),
class as (select x.doc_id, (select min(y.doc_id) from sets y where y.l = x.l) as class_id from sets x)
select doc_id, class_id, (select count(*) from both_ways b where b.doc_id = class.doc_id) as n_links from class
"""
)
_P4 = """
with recursive m0 as (select distinct regexp_replace(a, '^/', '') as a, regexp_replace(b, '^/', '') as b from dup_candidate where score >= 0.6),
m as (select a, b from m0 where a <> b union select b, a from m0 where a <> b),
r(rel, g) as (select a, a from m union select m.b, r.g from r join m on m.a = r.rel)
select rel, min(g) as group_rel from r group by rel
"""
SQL = {
    "p2_found": _P2,
    "p2_links": _P2_LINKS,
    "p4_found": _P4,
    "p8_round_trip": "select doc_id, md5(coalesce(text, '')) as digest from documents",
    "p9_whole": "select doc_id, true as whole, true as fits from documents",
    "p6_found": _P6 + "select item_a, item_b from good",
    "p6_pairs": _P6
    + """select *, round(n_ab * n_baskets::double / (n_a * n_b), 6) as lift,
      round(((n_ab + 0.5) * (n_baskets - n_a - n_b + n_ab + 0.5)) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5)), 4) as odds_ratio from good""",
}
