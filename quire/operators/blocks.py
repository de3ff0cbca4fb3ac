"""Candidate pairs of names by blocking keys.

Members are grouped by what must match exactly, a whole name (n:) or a resource (r:); such a group, a class, stands for all
pairs of its members, whatever its size, and takes one row per member. Only between classes of names do the common keys count: a token
(t:), the first four letters of one (p:), an acronym (a:). Two members are candidates if they share a class or their
classes are a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.strings import acronym, tokens

#: Members above which a block of a common key (t:, p:, a:) says nothing. Classes have no such limit.
MAX_BLOCK = 200


def name_classes(members: DataFrame) -> DataFrame:
    """The classes of the members (id, names, resource; several rows of an id add up): one row (id, class) per member and class."""
    named = members.select("id", F.explode("names").alias("name")).select("id", F.array_join(tokens(F.col("name")), " ").alias("key"))
    whole = named.where(F.col("key") != "").select("id", F.concat(F.lit("n:"), "key").alias("class"))
    source = members.where(F.col("resource") != "").select("id", F.concat(F.lit("r:"), F.regexp_replace("resource", "/+$", "")).alias("class"))
    return whole.unionByName(source).distinct()


def _keys(name: Column) -> Column:
    """The common keys of a whole name (its tokens, joined by spaces)."""
    t = F.split(name, " ")
    short = F.when(F.size(t) == 1, name).otherwise(acronym(t))
    return F.array_distinct(F.concat(F.transform(t, lambda x: F.concat(F.lit("t:"), x)), F.transform(t, lambda x: F.concat(F.lit("p:"), F.substring(x, 1, 4))), F.array(F.concat(F.lit("a:"), short))))


def class_pairs(classes: DataFrame, cap: int = MAX_BLOCK) -> DataFrame:
    """Pairs of name classes that share a common key of at most cap members: (class_a, class_b), class_a < class_b, each once.

    A block's size is that of its members, not its classes. Pairs of members within a class are not listed: the class is their list.
    """
    own = classes.where(F.col("class").startswith("n:"))
    keys = own.select("class").distinct().select("class", F.explode(_keys(F.substring("class", 3, 1 << 30))).alias("key"))
    few = own.join(keys, "class").select("key", "id").distinct().groupBy("key").count().where(F.col("count") <= cap).select("key")
    kept = keys.join(few, "key", "left_semi")
    a, b = kept.select("key", F.col("class").alias("class_a")), kept.select("key", F.col("class").alias("class_b"))
    return a.join(b, "key").where(F.col("class_a") < F.col("class_b")).select("class_a", "class_b").distinct()
