"""Link-graph analytics: ranks, gaps, cohesion, degrees."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.paths import stem_of
from quire.functions.strings import tokens
from quire.operators.catalog import SYNTHESES
from quire.plans.skew import hot_keys
from quire.session import checkpoint, detached, fixed_plans


def page_names(p: DataFrame) -> DataFrame:
    """The names of each page as tokens: rel, tokens. Names are title, aliases and the file's stem; names without a token are left out, equal ones of a page fall together."""
    stem = F.replace(stem_of(F.col("rel")), F.lit("-"), F.lit(" "))
    names = F.array_compact(F.concat(F.array("title", stem), F.coalesce("aliases", F.array().cast("array<string>"))))
    named = p.select("rel", F.explode(names).alias("name")).distinct()
    return named.select("rel", tokens(F.col("name")).alias("tokens")).where(F.size("tokens") > 0).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rel, n_in, n_out over distinct edges; nodes without edges have 0."""
    both = edges.select(F.col("dst").alias("rel"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("src").alias("rel"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    got = both.groupBy("rel").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return nodes.select("rel", "type").join(got, "rel", "left").select("rel", "type", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def orphans(deg: DataFrame) -> DataFrame:
    """Nodes that nothing links to, gathering types excepted."""
    return deg.where((F.col("n_in") == 0) & ~F.coalesce(F.col("type").isin(*SYNTHESES), F.lit(False))).select("rel")


def sinks(deg: DataFrame, least: int = 3) -> DataFrame:
    """Hubs that link nowhere."""
    return deg.where((F.col("n_out") == 0) & (F.col("n_in") >= least)).select("rel", "n_in")


#: Rounds of an iteration whose plans build on each other; then its state is written and starts a plan of its own.
ROUNDS_A_PLAN = 12


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 60) -> DataFrame:
    """rel, score after exactly `rounds` rounds; the rank of nodes without links is spread evenly. An empty graph gives no rows.

    The links are partitioned by their source once and kept; a round is one join on that partitioning, one partially aggregated shuffle by target, and one job that
    also returns the rank that hangs. Pages that hold a large share of all links keep theirs spread and meet their rank by broadcast (at most 100 rows). The state, a row a node, is kept in memory
    between rounds and written to the shared folder every ROUNDS_A_PLAN rounds; what an executor takes with it when it is lost is computed again from there.
    """
    n = nodes.count()
    if n == 0:
        return nodes.select("rel", F.lit(0.0).alias("score"))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n_out"))
    links = checkpoint(edges.join(out, "src").select("src", "dst", "n_out"))
    hot = hot_keys(links, "src")
    cold = links if hot is None else links.join(F.broadcast(hot), "src", "left_anti")
    large = None if hot is None else links.join(F.broadcast(hot), "src", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
    every = checkpoint(nodes.select("rel").distinct().join(out.select(F.col("src").alias("rel"), "n_out"), "rel", "left").select("rel", F.col("n_out").isNull().alias("dangling")))
    state = every.select("rel", F.lit(1.0 / n).alias("score"), "dangling")
    hanging = state.where("dangling").count() / n
    with fixed_plans(nodes.sparkSession):
        adj = cold.repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
        kept: list[DataFrame] = []
        for turn in range(rounds):
            ranks = state.select(F.col("rel").alias("src"), "score")
            given = adj.join(ranks, "src")
            if large is not None:
                given = given.unionByName(large.join(F.broadcast(ranks.join(F.broadcast(hot), "src", "left_semi")), "src"))
            given = given.select(F.col("dst").alias("rel"), (F.col("score") / F.col("n_out")).alias("got"), F.lit(None).cast("boolean").alias("dangling"))
            both = given.unionByName(every.select("rel", F.lit(0.0).alias("got"), "dangling"))
            base = (1 - damping) / n + damping * hanging / n
            new = both.groupBy("rel").agg(F.sum("got").alias("got"), F.max("dangling").alias("dangling")).select("rel", (F.lit(base) + F.lit(damping) * F.col("got")).alias("score"), "dangling")
            if (turn + 1) % ROUNDS_A_PLAN == 0:
                state = checkpoint(new)
            else:
                state = new.persist(StorageLevel.MEMORY_AND_DISK)
                kept.append(state)
            hanging = state.agg(F.sum(F.when(F.col("dangling"), F.col("score")))).first()[0] or 0.0
            while len(kept) > 2:
                kept.pop(0).unpersist()
        result = checkpoint(state.select("rel", "score"))
    for df in (*kept, adj, *([] if large is None else [large])):
        df.unpersist()
    return result


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(rel, component) of every node, links taken in either direction; component is the smallest path in it.

    Neighbours greater than a node are linked to the least of its neighbourhood, then the smaller ones, in turns, until every component is a star around its least
    node. Degrees only matter through a minimum, which is partially aggregated; each round is written to the shared folder.
    """
    pairs = edges.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    pairs = checkpoint(pairs)
    before: tuple | None = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = wide.groupBy("u").agg(F.min("v").alias("m"))
        joined = wide.join(least, "u")
        near = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        pairs = checkpoint(near)
        state = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return nodes.select("rel").distinct().join(pairs.select(F.col("u").alias("rel"), "v"), "rel", "left").select("rel", F.coalesce("v", "rel").alias("component"))
        before = state
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def component_sizes(labels: DataFrame) -> DataFrame:
    """Per component: component, n_pages, and its members if it is a small island of two or three."""
    few = F.array_sort(F.collect_list(F.when(F.col("__n") <= 3, F.col("rel"))))
    sized = labels.join(labels.groupBy("component").agg(F.count(F.lit(1)).alias("__n")), "component")
    got = sized.groupBy("component").agg(F.max("__n").alias("n_pages"), few.alias("members"))
    return got.select("component", "n_pages", F.when(F.col("n_pages").between(2, 3), F.col("members")).alias("members"))


def tag_cohesion(tags: DataFrame, edges: DataFrame, least: int = 5, below: float = 0.15) -> DataFrame:
    """Tags of at least `least` pages whose linked pairs are less than `below` of all pairs: tag, n_pages, density.

    tags has rel and tag. Linked pairs are found from the edges, so no pairs of pages are made within a tag.
    """
    sizes = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n_pages"))
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    shared = pairs.join(tags.select(F.col("rel").alias("a"), "tag"), "a").join(tags.select(F.col("rel").alias("b"), "tag"), ["b", "tag"])
    linked = shared.groupBy("tag").agg(F.count(F.lit(1)).alias("linked"))
    dens = F.coalesce("linked", F.lit(0)) / (F.col("n_pages") * (F.col("n_pages") - 1) / 2)
    return sizes.where(F.col("n_pages") >= least).join(linked, "tag", "left").withColumn("density", dens).where(F.col("density") < below).select("tag", "n_pages", F.round("density", 3).alias("density"))


def _pairs_of(sets: DataFrame) -> DataFrame:
    """All pairs a < b within the sorted arrays `t`."""
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.transform(F.slice(F.col("t"), i + 1, F.size("t")), lambda b: F.struct(F.element_at("t", i).alias("a"), b.alias("b")))))
    return sets.where(F.size("t") > 1).select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def colinks(edges: DataFrame, least: int = 3, max_out: int = 60) -> DataFrame:
    """Pairs a < b linked from the same page by at least `least` pages with at most max_out links: a, b, n."""
    fit = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_out).select("src")
    sets = edges.join(fit, "src", "left_semi").groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("t"))  # at most max_out each
    return _pairs_of(sets).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def colink_gaps(nodes: DataFrame, edges: DataFrame, least: int = 3, max_out: int = 60) -> DataFrame:
    """Colinked pairs that no gathering page discusses together and that hold no gathering page themselves.

    The pairs a gathering page covers come from its own links: all of them if it has at most max_out; of a larger page only those pairs that are colinked,
    found through its links, so that no page's pairs are all written out.
    """
    edges = checkpoint(edges)
    gather = nodes.where(F.col("type").isin(*SYNTHESES)).select("rel").distinct()
    pairs = colinks(edges, least, max_out)
    for side in ("a", "b"):
        pairs = pairs.join(gather.select(F.col("rel").alias(side)), side, "left_anti")
    pairs = checkpoint(pairs)
    own = edges.join(gather.select(F.col("rel").alias("src")), "src", "left_semi")
    n = own.groupBy("src").agg(F.count(F.lit(1)).alias("__n"))
    small = own.join(n.where(F.col("__n") <= max_out), "src", "left_semi").groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("t"))
    big = own.join(n.where(F.col("__n") > max_out), "src", "left_semi")
    seen = pairs.select("a", "b").join(big.select("src", F.col("dst").alias("a")), "a").join(big.select("src", F.col("dst").alias("b")), ["src", "b"]).select("a", "b")
    return pairs.join(_pairs_of(small).unionByName(seen).distinct(), ["a", "b"], "left_anti").select("a", "b", "n")


def analysis(nodes: DataFrame, edges: DataFrame, citations: DataFrame, facts: DataFrame, tags: DataFrame, top: int = 15) -> DataFrame:
    """The whole analysis of a link graph as rows (section, rank, item, detail): totals, components and small islands, central pages, orphans, dead ends,
    sinks, weak tags, colink gaps, cited sources, and central pages to review first.

    facts: rel, tier, cited; tags: rel, tag. Ranked sections have at most `top` rows, by their value and then by path; the others all of theirs, with rank null.
    """
    edges = checkpoint(edges)
    deg = checkpoint(degrees(nodes, edges))
    score = pagerank(nodes, edges)
    info = score.join(deg.drop("type"), "rel").join(facts, "rel", "left").select("rel", "score", "n_in", "n_out", F.coalesce("tier", F.lit("unverified")).alias("tier"), F.coalesce("cited", F.lit(False)).alias("cited"))
    sizes = component_sizes(components(nodes, edges))
    text = lambda *c: F.concat_ws(", ", *[F.col(x).cast("string") for x in c])

    def ranked(df: DataFrame, section: str, order: list, item, detail) -> DataFrame:
        best = df.orderBy(*order).limit(top)
        return best.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("rank"), item.alias("item"), detail.alias("detail"))  # at most `top` rows

    def plain(df: DataFrame, section: str, item, detail=None) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.lit(None).cast("int").alias("rank"), item.alias("item"), (F.lit("") if detail is None else detail).alias("detail"))

    by_score = [F.desc("score"), F.asc("rel")]
    parts = [
        plain(nodes.agg(F.count(F.lit(1)).alias("n")), "totals", F.lit("pages"), text("n")),
        plain(edges.agg(F.count(F.lit(1)).alias("n")), "totals", F.lit("links"), text("n")),
        plain(sizes.agg(F.count(F.lit(1)).alias("n"), F.max("n_pages").alias("m")), "totals", F.lit("components, largest"), text("n", "m")),
        plain(sizes.where(F.col("members").isNotNull()), "islands", F.col("component"), F.array_join("members", ", ")),
        ranked(info, "central", by_score, F.col("rel"), text("n_in", "n_out")),
        ranked(info.where((F.col("tier") == "unverified") | ~F.col("cited")), "review first", by_score, F.col("rel"), text("tier", "cited")),
        plain(orphans(deg), "orphans", F.col("rel")),
        plain(deg.where("n_out = 0"), "dead ends", F.col("rel")),
        plain(sinks(deg), "sinks", F.col("rel"), text("n_in")),
        plain(tag_cohesion(tags, edges), "weak tags", F.col("tag"), text("n_pages", "density")),
        plain(citations.groupBy("dst").agg(F.count_distinct("src").alias("n")), "cited", F.col("dst"), text("n")),
        ranked(colink_gaps(nodes, edges), "colink gaps", [F.desc("n"), F.asc("a"), F.asc("b")], F.concat_ws(" + ", "a", "b"), text("n")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
