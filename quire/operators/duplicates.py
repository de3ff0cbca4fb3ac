"""Scored candidates for pages that are the same: names, acronyms, resources, spelling, text, metadata."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quire.functions.strings import acronym, casefold, jaccard, tokens
from quire.operators.graph import page_names
from quire.operators.sharedtext import shared_text
from quire.plans.ids import dense_ids
from quire.session import checkpoint, default_parallelism

#: Members above which a block of a common key (a token, a prefix, an acronym) says nothing.
MAX_BLOCK = 200
#: Relations between pages that are related, and so distinct.
DISTINCT_RELATIONS = ("alternative_to", "supersedes", "contradicts")
#: Least values of the signals: token overlap of two names, similarity of their spelling, shared text.
OVERLAP, SPELLING, SHARED = 0.5, 0.85, 0.3
#: Pairs of pages compared at once, and pairs of names in blocks of more than MAX_BLOCK pages.
STEP_PAIRS, STEP_NAMES = 50_000, 1 << 20
#: Pages of such a block that are held at once.
MAX_PART = 8_192


def name_features(p: DataFrame) -> DataFrame:
    """Per page: rel, names (tokens joined by blanks), words (all their tokens), singles (names of one token), acronyms (of names of more)."""
    n = page_names(p)
    whole = F.array_join("tokens", " ")
    one, more = F.size("tokens") == 1, F.size("tokens") > 1
    words = F.array_distinct(F.flatten(F.collect_set("tokens"))).alias("words")
    return n.groupBy("rel").agg(F.array_sort(F.collect_set(whole)).alias("names"), words, F.collect_set(F.when(one, whole)).alias("singles"), F.collect_set(F.when(more, acronym(F.col("tokens")))).alias("acronyms"))


def blocks(p: DataFrame, features: DataFrame, cap: int = MAX_BLOCK) -> DataFrame:
    """Pages (by the column id of features, which ascends with rel) in blocks: block, id, star. In a block all pages are to be paired, with star only its smallest with each other one.

    Common keys are name tokens (t:), their first four letters (p:), acronyms (a:); their blocks count up to cap members. Whole names (n:) and resources
    (r:) always count; beyond cap members the smallest page is paired with each other one instead of all with all: such a group is a class, and blocks.name_classes
    lists its members. So pairs are at most cap times the keys of the pages, and no group of any size is lost or multiplied out. Keys with the same pages make one
    block, and a star of many pages is cut into blocks that all hold its smallest.
    """
    words = F.flatten(F.transform("names", lambda n: F.split(n, " ")))
    common = F.concat(F.transform(words, lambda t: F.concat(F.lit("t:"), t)), F.transform(words, lambda t: F.concat(F.lit("p:"), F.substring(t, 1, 4))), F.transform(F.array_union("singles", "acronyms"), lambda t: F.concat(F.lit("a:"), t)))
    exact = F.transform("names", lambda n: F.concat(F.lit("n:"), n))
    keys = features.select("id", F.explode(F.array_distinct(F.concat(common, exact))).alias("key"))
    source = p.where(F.col("resource") != "").select("rel", F.concat(F.lit("r:"), F.regexp_replace("resource", "/+$", "")).alias("key"))
    keys = keys.unionByName(source.join(features.select("rel", "id"), "rel").select("id", "key"))
    sized = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first")).where("size > 1")
    sized = checkpoint(sized.where((F.col("size") <= cap) | F.col("key").rlike("^[nr]:")))
    few = keys.join(sized.where(F.col("size") <= cap).select("key"), "key", "left_semi")
    whole = few.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids")).groupBy("ids").agg(F.min("key").alias("block"))
    whole = whole.select("block", F.explode("ids").alias("id"), F.lit(False).alias("star"))
    large = sized.where(F.col("size") > cap).select("key", "first", F.ceil(F.col("size") / cap).alias("parts"))
    part = F.concat_ws("#", "key", F.pmod(F.xxhash64("id"), F.col("parts")))
    spread = keys.join(large, "key").where(F.col("id") != F.col("first")).select(part.alias("block"), "id", "first")
    star = spread.select("block", "id").unionByName(spread.select("block", F.col("first").alias("id")).distinct())
    return whole.unionByName(star.withColumn("star", F.lit(True)))


def parity(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """A set in n_words 64-bit words (a power of two): each bit tells whether an odd number of its hashes end in the bit's number.

    Two sets differ in at least as many elements as their words differ in bits, since equal elements cancel out.
    """
    counts = np.bincount((hashes & (64 * n_words - 1)).astype(np.int64), minlength=64 * n_words)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def marks(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """A set in n_words 64-bit words (a power of two): each bit tells whether any of its hashes ends in the bit's number."""
    bits = np.zeros(64 * n_words, np.uint8)
    bits[hashes & (64 * n_words - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _letters(name: str) -> np.ndarray:
    """The letters of a name as hashes; an equal one counts as another at each further occurrence, so that common elements are common letters."""
    codes = np.sort(np.frombuffer(name.encode("utf-32-le", "surrogatepass"), np.uint32)).astype(np.uint64)
    first = np.concatenate([[True], codes[1:] != codes[:-1]])
    at = np.arange(len(codes))
    nth = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return ((codes * np.uint64(1024) + nth) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)


#: What follows the last letter of a name, in the codes of letters.
_NONE = 63
_ASCII = np.array([ord(c) - 97 if "a" <= c <= "z" else ord(c) - 22 if "0" <= c <= "9" else 36 if c == " " else 37 + ord(c) % 26 for c in map(chr, range(128))], np.uint8)


def _codes(name: str) -> bytes:
    """The letters of a name in order, in codes below _NONE: equal letters have equal ones."""
    codes = np.frombuffer(name.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _ASCII[codes & 127], 37 + codes % 26).astype(np.uint8).tobytes()


def _name_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page the parities of each name's tokens and letters (two words each), all in one list, their numbers, and the codes of the letters."""
    for batch in batches:
        described = [parity(np.array(sorted(set(h)), np.int64), 2).view(np.int64) for h in batch.column("described").to_pylist()]
        n_described = pa.array([len(set(h)) for h in batch.column("described").to_pylist()], pa.int32())
        tagged = [int(marks(np.array(h, np.int64), 1).view(np.int64)[0]) for h in batch.column("tags").to_pylist()]
        sketches, sizes, codes = [], [], []
        for names, hashes in zip(batch.column("names").to_pylist(), batch.column("hashes").to_pylist()):
            own = [(np.array(sorted(set(h)), np.int64), _letters(n)) for n, h in zip(names, hashes)]
            sketches.append(np.concatenate([np.concatenate([parity(t, 2), parity(x, 2)]) for t, x in own] or [np.zeros(0, np.uint64)]).view(np.int64))
            sizes.append([m for (t, _), n in zip(own, names) for m in (len(t), len(n))])
            codes.append(b"".join(map(_codes, names)))
        kept = ["id", "acronyms", "singles", "resource", "kind", "folder"]
        columns = [*[batch.column(c) for c in kept], pa.array(sketches, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(codes, pa.binary())]
        more = [pa.array(described, pa.list_(pa.int64())), n_described, pa.array(tagged, pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, *more], names=[*kept, "sketches", "sizes", "codes", "described", "n_described", "tags"])


class _Pages:
    """The rows of some blocks as flat arrays, to compare pairs of them whose score may be `least` or more."""

    def __init__(self, t: pa.Table, least: float) -> None:
        self.least = least

        def flat(column: str) -> tuple[np.ndarray, np.ndarray]:
            lists = t.column(column).combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            return lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)

        self.id = t.column("id").to_numpy()
        self.resource = t.column("resource").to_numpy()
        self.acronyms, self.singles = flat("acronyms"), flat("singles")
        starts, sketches = flat("sketches")
        self.names = starts // 4
        sketches = np.ascontiguousarray(sketches).view(np.uint64).reshape(-1, 4)
        self.tokens, self.letters = sketches[:, :2].T.copy(), sketches[:, 2:].T.copy()
        sizes = flat("sizes")[1].reshape(-1, 2)
        self.n_tokens, self.n_letters = sizes[:, 0].astype(np.int64), sizes[:, 1].astype(np.int64)

        self.folder, self.tags = t.column("folder").to_numpy(), t.column("tags").to_numpy().view(np.uint64)
        self.described, self.n_described = np.ascontiguousarray(flat("described")[1]).view(np.uint64).reshape(-1, 2), t.column("n_described").to_numpy().astype(np.int64)
        self.codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8)
        self.first = np.cumsum(self.n_letters) - self.n_letters

    def scored(self, overlap: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pairs of pages whose names overlap so far at most may reach the least score by that, with what descriptions, folders and tags add at most."""
        short = np.flatnonzero(overlap < self.least - 0.006)
        ok = np.ones(len(left), bool)
        x, y = left[short], right[short]
        apart = np.bitwise_count(self.described[x] ^ self.described[y]).sum(axis=1, dtype=np.int64)
        described = apart <= (self.n_described[x] + self.n_described[y]) / 3 + 1e-6
        more = 0.1 * described + 0.05 * (self.folder[x] == self.folder[y]) + 0.05 * ((self.tags[x] & self.tags[y]) != 0)
        ok[short] = overlap[short] + more >= self.least - 0.006  # scores are rounded to two places
        return ok

    def in_order(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether pairs of names have enough letters in common in the same order to be of similar spelling: all that are, and few others.

        The longest common subsequence is counted in one word of 64 bits for each pair, so pairs of two longer names all stay.
        """
        ok = np.ones(len(i), bool)
        swap = self.n_letters[i] > self.n_letters[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        short = np.flatnonzero(self.n_letters[i] <= 64)
        short = short[np.argsort(self.n_letters[j[short]], kind="stable")]
        for at in range(0, len(short), STEP_PAIRS):
            own = short[at : at + STEP_PAIRS]
            x, y = i[own], j[own]
            names, row = np.unique(x, return_inverse=True)
            n = self.n_letters[names]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            places = np.zeros((len(names), 64), np.uint64)  # the places of each letter in each name
            np.bitwise_or.at(places, (np.repeat(np.arange(len(names)), n), self.codes[np.repeat(self.first[names], n) + place]), np.uint64(1) << place.astype(np.uint64))
            places, row = places.ravel(), row * 64
            left = np.full(len(own), ~np.uint64(0))
            size, start = self.n_letters[y], self.first[y]
            for k in range(int(size[-1])):
                code = np.where(k < size, self.codes[np.minimum(start + k, len(self.codes) - 1)], _NONE)
                hit = left & places[row + code]
                left = (left + hit) | (left - hit)
            ok[own] = np.bitwise_count(~left) >= (self.n_letters[x] + size) * (SPELLING / 2) - 1e-6
        return ok

    @staticmethod
    def _each(off_l: np.ndarray, off_r: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All combinations of the elements of two rows, for pairs of rows: number of the pair, place in the left list, place in the right one."""
        n_l, n_r = off_l[left + 1] - off_l[left], off_r[right + 1] - off_r[right]
        n = n_l * n_r
        pair = np.repeat(np.arange(len(left)), n)
        within = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        return pair, off_l[left][pair] + within // n_r[pair], off_r[right][pair] + within % n_r[pair]

    def by_name(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether names, acronyms or resources of pairs may be near enough for a signal: all that are, and few others."""
        ok = (self.resource[left] != 0) & (self.resource[left] == self.resource[right])
        pair, i, j = self._each(self.names, self.names, left, right)
        for sketch, n, least in ((self.tokens, self.n_tokens, 2 * OVERLAP / (1 + OVERLAP)), (self.letters, self.n_letters, SPELLING)):
            apart = sum(np.bitwise_count(s[i] ^ s[j]) for s in sketch)
            near = np.flatnonzero(apart <= (n[i] + n[j]) * (1 - least) + 1e-6)
            if sketch is self.letters:
                near = near[~ok[pair[near]]]
                near = near[self.in_order(i[near], j[near])]
            else:
                both = (n[i] + n[j])[near]
                near = near[self.scored((both - apart[near]) / (both + apart[near]), left[pair[near]], right[pair[near]])]
            ok[pair[near]] = True
        for l, r in ((left, right), (right, left)):
            pair, i, j = self._each(self.acronyms[0], self.singles[0], l, r)
            ok[pair[self.acronyms[1][i] == self.singles[1][j]]] = True
        return ok


def _near_pairs(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of pages of the same block that may be near and score `least`: a, b. Rows come sorted by block and id."""

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        pages = _Pages(t, least)
        block = t.column("block").combine_chunks().dictionary_encode()
        block = block.combine_chunks() if isinstance(block, pa.ChunkedArray) else block
        code, star = block.indices.to_numpy(), t.column("star").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        sizes = np.diff(np.append(starts, len(code)))
        kinds = np.unique(np.stack([sizes, star[starts]]), axis=1).T
        for k, is_star in kinds.tolist():  # all blocks of one size together
            own = starts[(sizes == k) & (star[starts] == bool(is_star))]
            x, y = (np.zeros(k - 1, np.int64), np.arange(1, k)) if is_star else np.triu_indices(k, 1)
            for some in range(0, len(x), STEP_PAIRS):
                u, v = x[some : some + STEP_PAIRS], y[some : some + STEP_PAIRS]
                step = max(1, STEP_PAIRS // len(u))
                for at in range(0, len(own), step):
                    left, right = ((own[at : at + step, None] + z[None, :]).ravel() for z in (u, v))
                    hit = np.flatnonzero(pages.by_name(left, right))
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array(pages.id[left[hit]]), pa.array(pages.id[right[hit]])], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        blocks_ = batch.column("block")
        if blocks_[0].as_py() == blocks_[-1].as_py() == held[0].column("block")[-1].as_py():
            continue  # the block goes on
        t = pa.Table.from_batches(held)
        last = t.column("block").to_numpy() == blocks_[-1].as_py()
        done = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        yield from compare(t.slice(0, done).combine_chunks())
        held = t.slice(done).combine_chunks().to_batches()
    if held:
        yield from compare(pa.Table.from_batches(held).combine_chunks())


def _page_sketches(p: DataFrame, features: DataFrame) -> DataFrame:
    """Per page what its names, acronyms and resource are compared by, as hashes and sketches, and kind (1 for a Source, 2 for a journal entry, else 0)."""
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    resource = F.when(F.col("resource") != "", F.xxhash64(F.regexp_replace("resource", "/+$", ""))).otherwise(F.lit(0).cast("long"))
    kind = F.when(F.col("type") == "Source", 1).when(F.col("type") == "Journal Entry", 2).otherwise(0)
    described, tags = (F.coalesce(c, F.array().cast("array<string>")) for c in (tokens(F.col("description")), F.col("tags")))
    more = p.select("rel", resource.alias("resource"), kind.alias("kind"), F.coalesce(F.xxhash64("folder"), F.lit(0).cast("long")).alias("folder"), hashed(described).alias("described"), hashed(tags).alias("tags"))
    own = features.join(more, "rel")
    own = own.select("id", "names", F.transform("names", lambda n: hashed(F.split(n, " "))).alias("hashes"), hashed("acronyms").alias("acronyms"), hashed("singles").alias("singles"), "resource", "kind", "folder", "described", "tags")
    return own.mapInArrow(_name_sketches, "id long, acronyms array<long>, singles array<long>, resource long, kind int, folder long, sketches array<long>, sizes array<int>, codes binary, described array<long>, n_described int, tags long")


def candidate_pairs(p: DataFrame, features: DataFrame, cap: int | None = MAX_BLOCK, least: float = 0.0) -> DataFrame:
    """Pairs of pages that share a block and may have a signal of names or resources and so a score of `least`, a < b by rel, each once: (a, b).

    The sketches of a page travel once for each of its blocks, never once for each pair. A sketch bounds from below how far two sets are apart, so no pair with a signal is
    lost; the pairs left are to be compared in full. Without a cap blocks of any size are compared, those above MAX_BLOCK as in large_blocks.
    """
    sketches = _page_sketches(p, features)
    sketches = sketches if cap is not None else checkpoint(sketches)
    rows = checkpoint(blocks(p, features, MAX_BLOCK if cap is None else cap))
    rows = (rows if cap is not None else rows.where(~F.col("star"))).join(sketches, "id")
    # blocks are small rows that take long to compare: their partitions are not merged by size
    rows = rows.repartition(default_parallelism(p.sparkSession), "block").sortWithinPartitions("block", "id")
    near = rows.mapInArrow(lambda batches: _near_pairs(batches, least), "a long, b long")
    if cap is None:
        rows = large_blocks(p, features).join(sketches, "id")
        rows = rows.repartition(default_parallelism(p.sparkSession), "block").sortWithinPartitions("block", "side", "id")
        near = near.unionByName(rows.mapInArrow(lambda batches: _near_pairs_of_tiles(batches, least), "a long, b long"))
    near = near.distinct()
    name = features.select("id", "rel")
    near = near.join(name.select(F.col("id").alias("a"), F.col("rel").alias("__a")), "a").join(name.select(F.col("id").alias("b"), F.col("rel").alias("__b")), "b")
    return near.select(F.col("__a").alias("a"), F.col("__b").alias("b"))


def _prefixes(words: Column) -> Column:
    return F.array_distinct(F.transform(words, lambda t: F.substring(t, 1, 4)))


def large_blocks(p: DataFrame, features: DataFrame, least: int = MAX_BLOCK, part: int | None = None) -> DataFrame:
    """Pages in the blocks of more than `least` pages: block, side, id. A block is cut into tiles: pairs are those of side 0 with side 1, or of side 0 if there is no other.

    Whole names and tokens are not listed, since pages that share one share the first letters of a token. Each page is once in a tile for each part of its block.
    """
    part = part or MAX_PART
    common = F.concat(F.transform(_prefixes(F.col("words")), lambda t: F.concat(F.lit("p:"), t)), F.transform(F.array_union("singles", "acronyms"), lambda t: F.concat(F.lit("a:"), t)))
    keys = features.select("id", F.explode(common).alias("key"))
    source = p.where(F.col("resource") != "").select("rel", F.concat(F.lit("r:"), F.regexp_replace("resource", "/+$", "")).alias("key"))
    keys = keys.unionByName(source.join(features.select("rel", "id"), "rel").select("id", "key")).select("id", F.xxhash64("key").alias("key"))
    large = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > least).select("key", F.ceil(F.col("size") / part).cast("int").alias("parts"))
    own = keys.join(large, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return own.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("block"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id")


def _equal(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of equal elements of two arrays, about STEP_NAMES at a time."""
    order = np.argsort(y, kind="stable")
    first, last = (np.searchsorted(y[order], x, side) for side in ("left", "right"))
    n = last - first
    total, at = np.cumsum(n), 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP_NAMES, "right")))
        size = n[at:to]
        i = np.repeat(np.arange(at, to), size)
        yield i, order[first[i] + np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)]
        at = to


def _near_of_tile(pages: _Pages, kind: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a page of left and one of right that by_name would keep, of kinds that may be the same page; some more than once."""

    def rows_of(offsets: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = offsets[some + 1] - offsets[some]
        page = np.repeat(some, n)
        return page, np.repeat(offsets[some] - (np.cumsum(n) - n), n) + np.arange(len(page))

    def kept(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (x != y) & ((kind[x] == 1) == (kind[y] == 1)) & ~((kind[x] == 2) & (kind[y] == 2))
        x, y = x[ok], y[ok]
        packed = np.unique(np.minimum(x, y) * len(kind) + np.maximum(x, y))
        return np.divmod(packed, len(kind))

    some, more = left[pages.resource[left] != 0], right[pages.resource[right] != 0]
    for i, j in _equal(pages.resource[some], pages.resource[more]):
        yield kept(some[i], more[j])
    for l, r in ((left, right), (right, left)):
        (xp, x), (yp, y) = rows_of(pages.acronyms[0], l), rows_of(pages.singles[0], r)
        for i, j in _equal(pages.acronyms[1][x], pages.singles[1][y]):
            yield kept(xp[i], yp[j])
    (xp, x), (yp, y) = rows_of(pages.names, left), rows_of(pages.names, right)
    for sketch, n, least, reach in ((pages.tokens, pages.n_tokens, 2 * OVERLAP / (1 + OVERLAP), OVERLAP), (pages.letters, pages.n_letters, SPELLING, SPELLING / (2 - SPELLING))):
        p, q = np.argsort(n[x], kind="stable"), np.argsort(n[y], kind="stable")
        i, j, ip, jp = x[p], y[q], xp[p], yp[q]
        ni, nj, at = n[i], n[j], 0
        while at < len(i):  # names of like sizes with those that they may be near to
            lo = ni[at]
            start = np.searchsorted(nj, np.ceil(lo * reach - 1e-6), "left")
            to = min(len(i), at + max(1, STEP_NAMES // max(1, len(j) - start)))
            to = min(to, int(np.searchsorted(ni, max(lo + 1, int(lo * 1.05)), "left")))
            hi = ni[to - 1]
            end = np.searchsorted(nj, np.floor(hi / reach + 1e-6), "right")
            if end > start:
                cols = j[start:end]
                apart = np.bitwise_count(sketch[0][i[at:to], None] ^ sketch[0][None, cols])
                apart += np.bitwise_count(sketch[1][i[at:to], None] ^ sketch[1][None, cols])
                most = np.minimum(np.floor((hi + nj[start:end]) * (1 - least) + 1e-6), 128).astype(np.uint8)
                u, v = np.divmod(np.flatnonzero(apart <= most[None, :]), end - start)
                ok = apart[u, v] <= (ni[at:to][u] + nj[start:end][v]) * (1 - least) + 1e-6
                u, v = u[ok], v[ok]
                if sketch is pages.letters:
                    x_, y_ = ip[at + u], jp[start + v]
                    # of a tile's pairs with itself each is there twice
                    ok = np.flatnonzero((x_ < y_) if left is right else (x_ != y_))
                    ok = ok[pages.in_order(i[at + u[ok]], j[start + v[ok]])]
                    u, v = u[ok], v[ok]
                else:
                    both, differ = ni[at:to][u] + nj[start:end][v], apart[u, v].astype(np.int64)
                    ok = pages.scored((both - differ) / (both + differ), ip[at + u], jp[start + v])
                    u, v = u[ok], v[ok]
                yield kept(ip[at + u], jp[start + v])
            at = to


def _near_pairs_of_tiles(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of pages of the same tile that may be near and score `least`: a, b. Rows come sorted by block and side."""
    held: list[pa.RecordBatch] = []

    def compare() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        pages, side, kind = _Pages(t, least), t.column("side").to_numpy(), t.column("kind").to_numpy()
        left = np.flatnonzero(side == 0)
        # a tile of one part alone is compared with itself
        for x, y in _near_of_tile(pages, kind, left, np.flatnonzero(side == 1) if side.any() else left):
            if len(x):
                a, b = pages.id[x], pages.id[y]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if held and i < j and held[0].column("block")[0].as_py() != block[i]:
                yield from compare()
            if i < j:
                held.append(batch.slice(i, j - i))
    if held:
        yield from compare()


def spelling_ratio(xs: list[str], ys: list[str], least: float = SPELLING) -> float:
    """The greatest similarity of two spellings, one of each list, if any reaches `least`, else 0; the cheap upper bound is asked first."""
    best = 0.0
    for x in xs:
        for y in ys:
            m = difflib.SequenceMatcher(None, x, y)
            if m.real_quick_ratio() >= least and m.quick_ratio() >= least:
                best = max(best, m.ratio())
    return best if best >= least else 0.0


@F.arrow_udf(DoubleType())
def _spelling(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([spelling_ratio(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


# a filter on its result is not pushed below it, where it would run once more
_spelling = _spelling.asNondeterministic()


def _best_overlap(x: Column, y: Column) -> Column:
    """The greatest Jaccard overlap of the tokens of two names, one of each list."""
    each = lambda n: F.array_distinct(F.split(n, " "))
    return F.coalesce(F.array_max(F.flatten(F.transform(x, lambda n: F.transform(y, lambda m: jaccard(each(n), each(m)))))), F.lit(0.0))


def shingles(text: Column, size: int = 5) -> Column:
    """Hashes of the runs of `size` words of a text, each once."""
    words = F.regexp_extract_all(casefold(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("__w") - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("__w", i, F.lit(size))))
    return words, F.when(F.size("__w") >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def name_signals(p: DataFrame, relations: DataFrame | None = None, cap: int | None = MAX_BLOCK) -> DataFrame:
    """Candidate pairs that may be the same page, with their signals by name: a, b, same_name, same_resource, by_acronym, overlap, shared (0.0), and names and type of
    both pages (xa, xb).

    Left out are pairs of a Source with another type, of two journal entries, and of pages that a relation (src, key, dst) in DISTINCT_RELATIONS tells apart, in
    either direction.
    """
    return _signals(checkpoint(p.dropDuplicates(["rel"])), relations, cap, None)


def _signals(own: DataFrame, relations: DataFrame | None, cap: int | None, texts: DataFrame | None, least: float = 0.0) -> DataFrame:
    """name_signals of pages of which each is there once. With texts (rel, words) pairs that share a key, of whatever size its block, and text from SHARED are candidates too."""
    f = dense_ids(name_features(own), "rel")
    info = own.join(f, "rel").select("rel", F.struct("type", "resource", "names", "words", "singles", "acronyms").alias("x"))
    pairs = candidate_pairs(own, f, cap, least).withColumn("shared", F.lit(0.0))
    if texts is not None:
        pairs = pairs.unionByName(shared_text(texts, SHARED)).groupBy("a", "b").agg(F.max("shared").alias("shared"))
    if relations is not None:
        apart = relations.where(F.col("key").isin(*DISTINCT_RELATIONS)).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
        pairs = pairs.join(apart, ["a", "b"], "left_anti")
    # pairs are small rows that take long to compare: their partitions are not merged by size
    pairs = pairs.repartition(default_parallelism(own.sparkSession), "a", "b")
    both = pairs.join(info.select(F.col("rel").alias("a"), F.col("x").alias("xa")), "a").join(info.select(F.col("rel").alias("b"), F.col("x").alias("xb")), "b")
    a, b = F.col("xa"), F.col("xb")
    both = both.where(((a["type"] == "Source") == (b["type"] == "Source")) & ~((a["type"] == "Journal Entry") & (b["type"] == "Journal Entry")))
    ra, rb = F.regexp_replace(a["resource"], "/+$", ""), F.regexp_replace(b["resource"], "/+$", "")
    same_resource = F.coalesce((a["resource"] != "") & (ra == rb), F.lit(False))
    if texts is not None:  # the others come from blocks
        key = F.arrays_overlap(_prefixes(a["words"]), _prefixes(b["words"])) | F.arrays_overlap(F.array_union(a["singles"], a["acronyms"]), F.array_union(b["singles"], b["acronyms"])) | same_resource
        both = both.where((F.col("shared") == 0) | key)
    return both.select(
        "a",
        "b",
        "shared",
        F.arrays_overlap(a["names"], b["names"]).alias("same_name"),
        same_resource.alias("same_resource"),
        (F.arrays_overlap(a["acronyms"], b["singles"]) | F.arrays_overlap(b["acronyms"], a["singles"])).alias("by_acronym"),
        F.when(F.arrays_overlap(a["words"], b["words"]), _best_overlap(a["names"], b["names"])).otherwise(F.lit(0.0)).alias("overlap"),
        "xa",
        "xb",
    )


def duplicate_candidates(p: DataFrame, relations: DataFrame | None = None, bodies: DataFrame | None = None, min_score: float = 0.6, cap: int | None = MAX_BLOCK) -> DataFrame:
    """Scored pairs: a, b, score, signals; a < b, score at least min_score.

    Same name or resource 1.0; acronym 0.9; name overlap from 0.5 and similar spelling from 0.85 by their value; with bodies (rel, text: what remains without
    code), shared text from 0.3 by half its share and 0.5. Where a signal fired, a similar description adds 0.1, the same folder and two shared tags 0.05
    each. The greatest counts; scores are rounded to two places and at most 1. Blocks of more than cap pages are left out as blocks() says, without a cap none is.
    """
    # of several texts of a page one counts, the same in every run
    texts = None if bodies is None else bodies.where(F.col("rel").isNotNull()).select("rel", shingles(F.col("text"))[0].alias("words"))
    own = checkpoint(p.dropDuplicates(["rel"]))
    s = _signals(own, relations, cap, texts, min_score).withColumn("ratio", _spelling(F.col("xa.names"), F.col("xb.names"))).drop("xa", "xb")
    by_name = F.col("same_name") | F.col("same_resource") | F.col("by_acronym") | (F.col("overlap") >= OVERLAP) | (F.col("ratio") > 0)
    s = checkpoint(s.where(by_name | (F.col("shared") >= SHARED)))
    # what adds to a score is read for the pairs left only
    more = own.select("rel", F.struct("folder", "description", "tags").alias("x"))
    s = s.join(more.select(F.col("rel").alias("a"), F.col("x").alias("xa")), "a").join(more.select(F.col("rel").alias("b"), F.col("x").alias("xb")), "b")
    # description tokens of both sides
    s = s.withColumn("ta", F.array_distinct(tokens(F.col("xa.description")))).withColumn("tb", F.array_distinct(tokens(F.col("xb.description"))))
    base = F.greatest(
        F.when(F.col("same_name") | F.col("same_resource"), 1.0).otherwise(0.0),
        F.when(F.col("by_acronym"), 0.9).otherwise(0.0),
        F.when(F.col("overlap") >= OVERLAP, F.col("overlap")).otherwise(0.0),
        F.col("ratio"),
        F.when(F.col("shared") >= SHARED, F.col("shared") / 2 + 0.5).otherwise(0.0),
    )
    described = jaccard(F.col("ta"), F.col("tb")) >= 0.5
    same_folder = F.col("xa.folder") == F.col("xb.folder")
    tagged = F.size(F.array_intersect(F.coalesce("xa.tags", F.array().cast("array<string>")), F.coalesce("xb.tags", F.array().cast("array<string>")))) >= 2
    bonus = F.when(described, 0.1).otherwise(0.0) + F.when(same_folder, 0.05).otherwise(0.0) + F.when(tagged, 0.05).otherwise(0.0)
    fired = {
        "same name": F.col("same_name"),
        "same resource": F.col("same_resource"),
        "acronym": F.col("by_acronym"),
        "name overlap": F.col("overlap") >= OVERLAP,
        "similar spelling": F.col("ratio") > 0,
        "shared text": F.col("shared") >= SHARED,
        "similar description": described,
        "same folder": same_folder,
        "shared tags": tagged,
    }
    signals = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in fired.items()]))
    score = F.least(F.round(base + bonus, 2), F.lit(1.0))
    return s.where(base > 0).select("a", "b", score.alias("score"), signals.alias("signals")).where(F.col("score") >= min_score)
