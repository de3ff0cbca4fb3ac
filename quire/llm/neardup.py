"""Near-duplicate texts: banded MinHash candidates verified by odd sketches.

Each text's set of word shingles is sampled by MinHash. Bands of samples make candidates; all samples are folded into a parity
bitmap (odd sketch), and the number of ones in the XOR of two bitmaps tells the pair's similarity precisely enough to
reject or accept most candidates. Only pairs near the limit are checked exactly.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.skew import HOT_ROWS, hot_keys, lookup
from quire.session import checkpoint

#: Share of all band rows from which a band's rows are taken apart; so there are at most a thousand such bands.
HOT_BAND = 0.001

_WORDS = re.compile(r"[^\W_]+")
_U = np.uint64


@dataclass(frozen=True)
class Sketching:
    """Parameters of the sketches.

    limit: similarity (intersection over union) from which a pair counts. A pair at limit + 0.05 shares no band with probability
    (1 - (limit + 0.05)^rows)^bands: 9e-6 for the defaults and limit 0.5. slack: a pair is rejected if its estimate is below
    limit - slack and accepted if above limit + slack, without an exact check; the estimate's standard deviation there is
    about 0.05, so a slack of 0.25 is five of them. bits: length of the odd sketch.
    """

    limit: float = 0.5
    words: int = 5
    bands: int = 64
    rows: int = 3
    bits: int = 1024
    slack: float = 0.25
    bucket: int = 64
    block: int = 2000

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    def most_ones(self, similarity: float) -> int:
        """Ones expected in the XOR of two odd sketches at a similarity."""
        return round(self.bits / 2 * (1 - math.exp(-4 * self.samples * (1 - similarity) / self.bits)))


def _mix(x: np.ndarray) -> np.ndarray:
    """A finalizer with full avalanche on 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_WORD_HASH = _WordHash()


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` consecutive words; words are maximal runs of letters and digits of the lower-cased text."""
    found = _WORDS.findall(text.lower()) if text else []
    if len(found) < words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORD_HASH.__getitem__, found), np.uint64, len(found))
    n = len(h) - words + 1
    factors = _mix(np.arange(1, words + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
    s = h[:n] * factors[0]
    for j in range(1, words):
        s += h[j : j + n] * factors[j]
    s = _mix(s)
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def _sketch(sets: list[np.ndarray], p: Sketching) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (docs x bands) and odd sketches (docs x bits/64) of non-empty shingle sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    seeds = _mix(np.arange(1, p.samples + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95))
    mins = np.empty((p.samples, len(sets)), np.uint64)
    buf = np.empty_like(flat)
    for k, seed in enumerate(seeds):
        np.bitwise_xor(flat, seed, out=buf)
        np.multiply(buf, seed | _U(1), out=buf)
        np.minimum.reduceat(buf, starts, out=mins[k])
    tagged = _mix(mins + (np.arange(1, p.samples + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))[:, None])
    keys = tagged.reshape(p.bands, p.rows, -1)
    band = keys[:, 0].copy()
    for r in range(1, p.rows):
        band = _mix(band * _U(0x9E3779B97F4A7C15) + keys[:, r])
    place = (tagged % _U(p.bits)).astype(np.int64) + np.arange(len(sets), dtype=np.int64)[None, :] * p.bits
    odd = (np.bincount(place.ravel(), minlength=len(sets) * p.bits) & 1).astype(np.uint8).reshape(len(sets), p.bits)
    return band.T.copy(), np.packbits(odd, axis=1, bitorder="little").view(np.uint64)


def _signatures(df: DataFrame, key: str, text: str, p: Sketching) -> DataFrame:
    """Per row with at least one shingle: id, hi and lo (hash of the shingle set), bands, sketch words s0.."""
    src = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("__t")).where(F.col("id").isNotNull() & F.col("__t").isNotNull())
    words = p.bits // 64
    schema = f"id {src.schema['id'].dataType.simpleString()}, hi long, lo long, bands array<long>, " + ", ".join(f"s{i} long" for i in range(words))
    names = ["id", "hi", "lo", "bands", *[f"s{i}" for i in range(words)]]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, p.words) for t in part.column("__t").to_pylist()]
                kept = [i for i, s in enumerate(sets) if len(s)]
                if not kept:
                    continue
                sets = [sets[i] for i in kept]
                band, odd = _sketch(sets, p)
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, p.bands, dtype=np.int32)), pa.array(band.ravel().view(np.int64)))
                cols = [part.column("id").take(pa.array(kept)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(odd[:, i].view(np.int64)) for i in range(words)]], names=names)

    return src.mapInArrow(sign, schema)


def _bucket_pairs(bucket: int):
    """From rows sorted by (key, rep): the pairs of buckets of at most `bucket` rows (key null), and the rows of larger buckets (b null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key = np.zeros(0, np.int64)
        held_rep = np.zeros(0, np.int64)
        hot: int | None = None  # the key of a bucket already known to be large
        for batch in batches:
            k = np.concatenate([held_key, batch.column("key").to_numpy()])
            r = np.concatenate([held_rep, batch.column("rep").to_numpy()])
            if not len(k):
                continue
            # the last bucket may go on in the next batch: hold it back unless it is large already
            last = int(np.searchsorted(k, k[-1], "left"))
            if len(k) - last > bucket:
                yield from _emit(k, r, bucket, hot)
                hot, held_key, held_rep = int(k[-1]), k[:0], r[:0]
            elif hot is not None and k[-1] == hot and last == 0:
                yield from _emit(k, r, bucket, hot)
                held_key, held_rep = k[:0], r[:0]
            else:
                yield from _emit(k[:last], r[:last], bucket, hot)
                held_key, held_rep = k[last:], r[last:]
        yield from _emit(held_key, held_rep, bucket, hot)

    return run


def _emit(k: np.ndarray, r: np.ndarray, bucket: int, hot: int | None) -> Iterator[pa.RecordBatch]:
    if not len(k):
        return
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    sizes = np.diff(np.append(starts, len(k)))
    large = sizes > bucket
    if hot is not None:
        large |= k[starts] == hot
    left, right = [], []
    for n in np.unique(sizes[(sizes > 1) & ~large]).tolist():
        rows = r[starts[(sizes == n) & ~large][:, None] + np.arange(n)[None, :]]
        i, j = np.triu_indices(n, 1)
        left.append(rows[:, i].ravel())
        right.append(rows[:, j].ravel())
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        both = np.unique(np.stack([lo, hi], 1), axis=0)
        both = both[both[:, 0] != both[:, 1]]
        if len(both):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(both), pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["key", "a", "b"])
    if large.any():
        rows = np.repeat(large, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(k[rows]), pa.array(r[rows]), pa.nulls(int(rows.sum()), pa.int64())], names=["key", "a", "b"])


def _ones(words: int) -> Column:
    total = F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0")))
    for i in range(1, words):
        total = total + F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}")))
    return total


def _block_pairs(hot: DataFrame, sketches: DataFrame, p: Sketching, most: int) -> DataFrame:
    """Pairs within large buckets whose sketches are close: every bucket is cut in blocks of about p.block rows, and each two blocks meet in
    one task that compares their bitmaps and returns only the close pairs."""
    words = p.bits // 64
    sizes = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / p.block).cast("int").alias("__n"))
    own = lookup(hot, sizes, ["key"], "inner").join(sketches, "rep").withColumn("__i", F.pmod(F.xxhash64("rep"), F.col("__n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__n") - 1))
    spread = own.withColumn("__j", other).select("key", F.least("__i", "__j").alias("lo"), F.greatest("__i", "__j").alias("hi"), (F.col("__i") <= F.col("__j")).alias("first"), "rep", *[f"s{i}" for i in range(words)])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
        rep, bits = pdf["rep"].to_numpy(), pdf[[f"s{i}" for i in range(words)]].to_numpy().view(np.uint64)
        one = pdf["first"].to_numpy()
        x, y = (np.arange(len(rep)),) * 2 if same else (np.flatnonzero(one), np.flatnonzero(~one))
        out_a, out_b = [], []
        for at in range(0, len(x), 64):
            ones = np.zeros((len(x[at : at + 64]), len(y)), np.int32)
            for w in range(words):
                ones += np.bitwise_count(bits[x[at : at + 64], w][:, None] ^ bits[y, w][None, :])
            i, j = np.nonzero(ones <= most)
            out_a.append(rep[x[at + i]])
            out_b.append(rep[y[j]])
        a, b = np.concatenate(out_a or [rep[:0]]), np.concatenate(out_b or [rep[:0]])
        keep = a < b if same else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]})

    return spread.groupBy("key", "lo", "hi").applyInPandas(compare, "a long, b long")


def near_duplicates(df: DataFrame, key: str, text: str, params: Sketching | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes and links of near-duplicate texts: (members, links).

    members: id, rep - for every row with at least `words` words, the smallest id with the same shingle set. links: a, b (a < b),
    the representatives of two different classes with a similarity of at least the limit. key must be an integer
    column; rows with a null key or text, and texts of fewer words, are in no class. Repeated ids with one text change nothing. Whole texts count.

    Exact copies collapse to their representative before anything is paired. Buckets of at most `bucket` classes are paired at once; larger ones are
    cut in blocks and compared by their bitmaps in place, so no bucket is dropped, capped or collected, and none emits pairs that
    are not close. Shuffled are band keys (8 bytes a band) and bitmaps, and shingle sets only of pairs near the limit.
    """
    p = params or Sketching()
    words = p.bits // 64
    sig = checkpoint(_signatures(df.select(F.col(key).cast("long").alias(key), text), key, text, p))
    reps = sig.groupBy("hi", "lo").agg(F.min("id").alias("rep"))
    members = checkpoint(sig.select("id", "hi", "lo").distinct().join(reps, ["hi", "lo"]).select("id", "rep"))
    own = sig.join(members.where(F.col("id") == F.col("rep")).select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    sketches = own.select(F.col("id").alias("rep"), *[f"s{i}" for i in range(words)])
    bands = own.select(F.explode("bands").alias("key"), F.col("id").alias("rep"))
    # a band that many classes share would stream through one task: its rows go to the blocks at once
    popular = hot_keys(bands, "key", HOT_BAND, HOT_ROWS) if reps.count() >= HOT_ROWS else None
    few = bands if popular is None else bands.join(F.broadcast(popular), "key", "left_anti")
    paired = checkpoint(few.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_bucket_pairs(p.bucket), "key long, a long, b long").distinct())
    low, high = p.most_ones(p.limit - p.slack), p.most_ones(min(1.0, p.limit + p.slack))
    pairs = paired.where(F.col("b").isNotNull()).select("a", "b")
    hot = paired.where(F.col("b").isNull()).select("key", F.col("a").alias("rep"))
    if popular is not None:
        hot = hot.unionByName(bands.join(F.broadcast(popular), "key", "left_semi"))
    if hot.limit(1).count():
        pairs = pairs.unionByName(_block_pairs(hot, sketches, p, low)).distinct()
    near = pairs.join(sketches.select(F.col("rep").alias("a"), F.struct(*[f"s{i}" for i in range(words)]).alias("x")), "a")
    near = near.join(sketches.select(F.col("rep").alias("b"), F.struct(*[f"s{i}" for i in range(words)]).alias("y")), "b")
    near = near.select(F.col("a").alias("left"), F.col("b").alias("right"), F.col("x").alias("a"), F.col("y").alias("b")).withColumn("ones", _ones(words))
    near = checkpoint(near.where(F.col("ones") <= low).select(F.col("left").alias("a"), F.col("right").alias("b"), "ones"))
    sure = near.where(F.col("ones") <= high).select("a", "b")
    return members, sure.unionByName(_exact(near.where(F.col("ones") > high).select("a", "b"), df, key, text, p))


def _exact(pairs: DataFrame, df: DataFrame, key: str, text: str, p: Sketching) -> DataFrame:
    """The pairs whose shingle sets, read again from the texts, reach the limit."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    src = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("__t")).join(needed, "id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [shingle_set(t, p.words) for t in part.column("__t").to_pylist()]
                ends = np.cumsum([0, *[len(s) for s in got]]).astype(np.int32)
                flat = np.concatenate(got).view(np.int64) if got else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "sh"])

    own = src.mapInArrow(sets, "id long, sh array<long>").dropDuplicates(["id"])
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("sh").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("sh").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    both = both.select("a", "b", common.alias("n"), (F.size("x") + F.size("y")).alias("m"))
    return both.where(F.col("n") >= F.lit(p.limit) * (F.col("m") - F.col("n"))).select("a", "b")


def duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs (doc_a, doc_b), doc_a < doc_b: of one class, or of two linked classes."""
    left, right = members.select("rep", F.col("id").alias("x")), members.select("rep", F.col("id").alias("y"))
    within = left.join(right, "rep").where(F.col("x") < F.col("y")).select("x", "y")
    across = links.join(left.withColumnRenamed("rep", "a"), "a").join(right.withColumnRenamed("rep", "b"), "b").select("x", "y")
    return within.unionByName(across).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per document: id, class_id (its representative) and n_links, the number of its near-duplicates, without expanding copies."""
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes.select(F.col("rep").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("linked")).withColumnRenamed("a", "rep")
    per = sizes.join(others, "rep", "left").select("rep", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return members.join(per, "rep").select("id", F.col("rep").alias("class_id"), "n_links")
