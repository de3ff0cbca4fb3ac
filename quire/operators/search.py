"""Ranking pages for a query, and how well the rankings reach the pages that questions expect."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.paths import name_of
from quire.functions.strings import casefold
from quire.operators.catalog import RESERVED, is_tooling
from quire.operators.find import find_pages

# Words of a question that say nothing about its topic.
QUESTION_WORDS = set(
    "about all and any are can could did does for from had has have how into its not our should than that the their them then there these they this those "
    "use was were what when where which who whom why will with would you your".split()
)


def search_terms(query: str) -> list[str]:
    """The words of a query that are searched: without marks, of three characters at least; the whole query if there are none."""
    if not query.strip():
        return []
    words = [re.sub(r"[^\w-]", "", w) for w in query.split()]
    return [w for w in words if len(w) >= 3] or [query]


def topic_words(query: str) -> list[str]:
    """The distinct words of a query that say something, of three characters at least."""
    return sorted({w for w in re.findall(r"[\w-]+", query.casefold()) if len(w) >= 3 and w not in QUESTION_WORDS})


def question_table(spark: SparkSession, questions: Sequence[str]) -> DataFrame:
    """Questions as rows: qid from 1, question."""
    return spark.createDataFrame([(i, q) for i, q in enumerate(questions, 1)], "qid int, question string")


def text_hits(docs: DataFrame, questions: Sequence[str]) -> DataFrame:
    """How often the words of each question occur in each text, as parts of words and whatever their case: qid, rel, n (above 0).

    docs: rel, text (the whole file). Generated indexes and files below folders with a leading dot are left out, logs are not. A question's words count
    together, from left to right without overlaps. Questions are a declared list; texts are read once for all of them.
    """
    patterns = [(i, [t.casefold() for t in search_terms(q)], re.compile("|".join(map(re.escape, search_terms(q))), re.I)) for i, q in enumerate(questions, 1) if search_terms(q)]
    src = docs.select("rel", "text").where(F.col("text").isNotNull() & (name_of(F.col("rel")) != "index.md") & ~F.concat(F.lit("/"), "rel").rlike(r"/\."))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rel, text in zip(batch.column("rel").to_pylist(), batch.column("text").to_pylist()):
                folded = text.casefold()
                for qid, terms, rx in patterns:
                    if any(t in folded for t in terms) and (n := len(rx.findall(text))):
                        rows.append((qid, rel, n))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64()))], names=["qid", "rel", "n"])

    return src.mapInArrow(count, "qid int, rel string, n long")


def text_search(docs: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The pages in which a query's words occur most often: rel, n; ties by path."""
    return text_hits(docs, [query]).select("rel", "n").orderBy(F.desc("n"), "rel").limit(limit)


def index_hits(p: DataFrame, questions: Sequence[str]) -> DataFrame:
    """How many distinct words of each question stand in the title or description of each page: qid, rel, n.

    Whole words, without those that say nothing. With three or more such words two must be there, else one. The words of questions and pages meet in a join on the word.
    """
    spark = p.sparkSession
    words = [(i, w, 2 if len(topic_words(q)) >= 3 else 1) for i, q in enumerate(questions, 1) for w in topic_words(q)]
    terms = spark.createDataFrame(words, "qid int, word string, least int")
    own = p.where(F.col("type").isNotNull() & ~name_of(F.col("rel")).isin(*RESERVED) & ~is_tooling(F.col("folder")))
    found = own.select("rel", F.explode(F.array_distinct(F.regexp_extract_all(casefold(F.concat_ws(" ", "title", "description")), F.lit(r"(?U)[\w-]+"), F.lit(0)))).alias("word")).distinct()
    hits = found.join(F.broadcast(terms), "word").groupBy("qid", "rel").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least"))
    return hits.where(F.col("n") >= F.col("least")).select("qid", "rel", "n")


def first_tier(p: DataFrame, docs: DataFrame, questions: Sequence[str]) -> DataFrame:
    """The ranking by index, then by text for pages the index did not show: qid, rel, place (what orders it: smaller first)."""
    index, text = index_hits(p, questions), text_hits(docs, questions)
    rest = text.join(index.select("qid", "rel"), ["qid", "rel"], "left_anti")
    place = lambda tier: F.struct(F.lit(tier).alias("tier"), (-F.col("n")).alias("n"), F.col("rel").alias("rel")).alias("place")
    return index.select("qid", "rel", place(1)).unionByName(rest.select("qid", "rel", place(2)))


def filter_tier(p: DataFrame, filters: Sequence[dict]) -> DataFrame:
    """The pages each question's filters find, in path order: qid, rel, place. Questions without filters have none."""
    out = None
    for i, f in enumerate(filters, 1):
        if f:
            tags = f.get("tag") or ()
            got = find_pages(p, f.get("type"), (tags,) if isinstance(tags, str) else tuple(tags), f.get("status"), f.get("folder"), f.get("trust"))
            got = got.select(F.lit(i).alias("qid"), "rel").distinct().select("qid", "rel", F.struct(F.lit(1).alias("tier"), F.lit(0).cast("long").alias("n"), F.col("rel").alias("rel")).alias("place"))
            out = got if out is None else out.unionByName(got)
    return p.sparkSession.createDataFrame([], "qid int, rel string, place struct<tier:int,n:bigint,rel:string>") if out is None else out


def top_places(ranking: DataFrame, k: int = 10) -> DataFrame:
    """The first k pages of each ranking: qid, place_no, rel. Spark keeps k rows a question and partition before it shuffles."""
    w = Window.partitionBy("qid").orderBy("place")
    return ranking.withColumn("place_no", F.row_number().over(w)).where(F.col("place_no") <= k).select("qid", "place_no", "rel")


def expected_places(ranking: DataFrame, expected: DataFrame) -> DataFrame:
    """The place of each expected page in its question's ranking, from 1, null where it is not in it: qid, rel, place_no.

    expected: qid, rel, a declared list. Pages ahead of an expected one are counted, so no ranking is sorted or gathered; paths are compared whatever their case.
    """
    want = F.broadcast(expected.select("qid", F.col("rel").alias("want"), casefold(F.col("rel")).alias("__k")).distinct())
    own = ranking.withColumn("__k", casefold(F.col("rel"))).join(want, ["qid", "__k"]).groupBy("qid", "want").agg(F.min("place").alias("at"))
    ahead = ranking.join(F.broadcast(own), "qid").where(F.col("place") < F.col("at")).groupBy("qid", "want").agg(F.count(F.lit(1)).alias("n"))
    got = own.join(ahead, ["qid", "want"], "left").select("qid", F.col("want").alias("rel"), (F.coalesce("n", F.lit(0)) + 1).alias("place_no"))
    return expected.select("qid", "rel").distinct().join(got, ["qid", "rel"], "left")


def scores(places: DataFrame, k: int = 10) -> DataFrame:
    """Per question: qid, first_place (of any expected page), n_found (among the first k), n_expected, recall, hit."""
    found = F.count_if(F.col("place_no") <= k)
    got = places.groupBy("qid").agg(F.min("place_no").alias("first_place"), found.alias("n_found"), F.count(F.lit(1)).alias("n_expected"))
    return got.select("*", (F.col("n_found") / F.col("n_expected")).alias("recall"), (F.col("n_found") > 0).alias("hit"))


def summary(per_question: DataFrame, tier: str, least: float | None = None) -> DataFrame:
    """One row: tier, n_questions, n_hits, recall (mean, null without questions), passed (whether recall reaches `least`; null where either is missing)."""
    got = per_question.agg(F.count(F.lit(1)).alias("n_questions"), F.count_if("hit").alias("n_hits"), F.avg("recall").alias("recall"))
    return got.select(F.lit(tier).alias("tier"), "*", (F.col("recall") >= F.lit(least).cast("double")).alias("passed"))
