"""Pairs of texts that share much, with the share: an exact join of sets of hashes that lists no block of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.skew import is_small
from quire.session import checkpoint, default_parallelism, detached

#: Least number of parts into which the hashes are divided.
MIN_PARTS = 24
#: Words hashed at once, pairs held at once, documents and parts that are broadcast at most.
STEP_WORDS, STEP_PAIRS, SMALL_KEYS = 400_000, 250_000, 1_000_000
#: Bits of a hash, and so of the number of a text within a step.
HASH_BITS = 48


def _run_hashes(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The distinct runs of `size` words of each text (words: their hashes, text i from starts[i] on) as numbers that ascend: text, then hash."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run = words[:n].copy()
    for k in range(1, size):
        run = (run ^ (run >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[k : n + k]
    run = (run ^ (run >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    whole = text[:n] == text[size - 1 :]
    return np.unique(text[:n][whole].astype(np.uint64) << np.uint64(HASH_BITS) | run[whole] >> np.uint64(64 - HASH_BITS))


def _parts_of(parts: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rel, version, doc, words: rows of one part of the hashes each (docs, how many hashes of each, the hashes), and rows of the texts themselves (rels)."""

    def step(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        lists = t.column("words").chunk(0)
        starts = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(0).dictionary_encode()
        known = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), object), categorize=False) if len(coded.dictionary) else np.zeros(0, np.uint64)
        words = known[coded.indices.to_numpy()][starts[0] : starts[-1]]
        keys = _run_hashes(words, starts - starts[0], size)
        text, run = (keys >> np.uint64(HASH_BITS)).astype(np.int64), (keys & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)
        docs = t.column("doc").to_numpy()
        part = run % parts
        order = np.argsort(part, kind="stable")
        text, run, ends = text[order], run[order], np.cumsum(np.bincount(part, minlength=parts))
        some = np.flatnonzero(np.bincount(text, minlength=len(docs)))
        rows = []
        for p, (i, j) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
            own, n = np.unique(text[i:j], return_counts=True)
            rows.append((p, docs[own].tobytes(), n.astype(np.int32).tobytes(), run[i:j].tobytes(), None))
        rels, versions = t.column("rel").take(pa.array(some)).to_pylist(), t.column("version").to_numpy()[some]
        rows.append((int(docs[0]) % parts, docs[some].tobytes(), versions.tobytes(), b"", rels))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string())))], names=["part", "docs", "n", "hashes", "rels"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, most = [], 0, (1 << (64 - HASH_BITS)) - 1
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                held.append(piece)
                words += len(piece.column("words").flatten())
                if words >= STEP_WORDS or sum(b.num_rows for b in held) + 1000 > most:
                    yield from step(pa.Table.from_batches(held))
                    held, words = [], 0
        if held:
            yield from step(pa.Table.from_batches(held))

    return read


def _in_lists(sizes: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within lists that follow each other, about `step` pairs at a time: each place with all later ones of its list."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    later = ends - np.arange(len(ends)) - 1
    total = np.cumsum(later)
    at = 0
    while at < len(later):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step, "right")))
        n = later[at:to]
        left = np.repeat(np.arange(at, to), n)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        at = to


def common(keys: np.ndarray, starts: np.ndarray, width: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of common elements of pairs of sets. keys: set * width + element, ascending; set i from starts[i] on."""
    n = np.diff(starts)
    swap = n[left] > n[right]
    few, more = np.where(swap, right, left), np.where(swap, left, right)
    out = np.zeros(len(left), np.int64)
    total = np.cumsum(n[few])
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP_PAIRS, "right")))
        size = n[few[at:to]]
        pair = np.repeat(np.arange(to - at), size)
        place = starts[few[at:to]][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        wanted = keys[place] + (more[at:to] - few[at:to])[pair] * width
        found = np.searchsorted(keys, wanted)
        hit = keys[np.minimum(found, len(keys) - 1)] == wanted
        out[at:to] = np.bincount(pair[hit], minlength=to - at)
        at = to
    return out


def near_sets(docs: np.ndarray, hashes: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of numbers in docs whose sets of hashes have a Jaccard overlap of `least` or more: all of them, some more than once.

    Of a set with n elements at least n * least are common to such a pair, so the rest and one more, the rarest first, hold a common one. Of the pairs that do, parities
    of the sets tell most apart; the others are counted.
    """
    names, doc = np.unique(docs, return_inverse=True)
    _, element = np.unique(hashes, return_inverse=True)
    width = int(element.max(initial=0)) + 1
    keys = np.unique(doc * width + element)
    doc, element = keys // width, keys % width
    n = np.bincount(doc, minlength=len(names))
    need = np.maximum(np.ceil(n * least - 1e-9), 1)
    for _ in range(3):  # what no two sets hold is in no pair, nor a set without enough of the rest
        df = np.bincount(element, minlength=width)[element]
        shared = np.bincount(doc[df > 1], minlength=len(names))
        kept = (df > 1) & (shared >= need)[doc]
        doc, element, keys = doc[kept], element[kept], keys[kept]
    if not len(keys):
        return
    starts = np.searchsorted(doc, np.arange(len(names) + 1))
    shared = np.diff(starts)
    # parities of the shared elements in 128 bits; n - shared more differ from every other set
    bit = ((element.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)).astype(np.int64)
    odd = (np.bincount(doc * 128 + bit, minlength=len(names) * 128) & 1).astype(np.uint8)
    low, high = np.packbits(odd, bitorder="little").view(np.uint64).reshape(-1, 2).T.copy()
    df = np.bincount(element, minlength=width)
    order = np.lexsort((element, df[element], doc))
    rank = np.arange(len(order)) - starts[doc]  # doc ascends, in this order too
    prefix = order[rank < (shared - need + 1)[doc]]
    by_element = prefix[np.argsort(element[prefix], kind="stable")]
    sizes = np.bincount(element[by_element], minlength=width)
    at = doc[by_element]
    n, alone = n.astype(np.int32), (n - shared).astype(np.int32)
    most = 1 - 2 * least / (1 + least)
    for i, j in _in_lists(sizes[sizes > 0], STEP_PAIRS):
        x, y = at[i], at[j]
        apart = np.bitwise_count(low[x] ^ low[y]).astype(np.int32) + np.bitwise_count(high[x] ^ high[y]) + alone[x] + alone[y]
        ok = np.flatnonzero(apart <= (n[x] + n[y]) * most + 1e-6)
        x, y = np.divmod(np.unique(np.minimum(x[ok], y[ok]) * len(names) + np.maximum(x[ok], y[ok])), len(names))
        c = common(keys, starts, width, x, y)
        ok = c >= (n[x] + n[y]) * (least / (1 + least)) - 1e-6
        yield names[x[ok]], names[y[ok]]


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """docs, n and hashes of rows of hashes."""
    for docs, n, hashes, rels in zip(*(batch.column(c).to_pylist() for c in ("docs", "n", "hashes", "rels"))):
        if rels is None:
            yield np.frombuffer(docs, np.int64), np.frombuffer(n, np.int32), np.frombuffer(hashes, np.int64)


def _near_in_part(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of texts (x, y) whose hashes of one part overlap enough; the rows of texts (x, rel, version) pass."""
    names = ["x", "y", "rel", "version"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, hashes = [], []
        for batch in batches:
            for d, v, rels in zip(*(batch.column(c).to_pylist() for c in ("docs", "n", "rels"))):
                if rels is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(d, np.int64)), pa.nulls(len(rels), pa.int64()), pa.array(rels, pa.string()), pa.array(np.frombuffer(v, np.int64))], names=names)
            for d, n, h in _unpacked(batch):
                docs.append(np.repeat(d, n))
                hashes.append(h)
        if not hashes:
            return
        d, h = np.concatenate(docs), np.concatenate(hashes)
        docs.clear(), hashes.clear()
        for x, y in near_sets(d, h, least):
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.nulls(len(x), pa.string()), pa.nulls(len(x), pa.int64())], names=names)

    return read


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's hashes of one part as a row: doc, hashes."""
    for batch in batches:
        for docs, n, hashes in _unpacked(batch):
            offsets = np.concatenate([[0], np.cumsum(n)])
            own = [hashes[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(own, pa.binary())], names=["doc", "hashes"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of hashes (x, hashes) and pairs (x, y) of the same places: the overlap of each pair."""
    docs, hashes, left, right = [], [], [], []
    for batch in batches:
        x, y, own = batch.column("x").to_numpy(), batch.column("y"), batch.column("hashes")
        pair = own.is_null().to_numpy(zero_copy_only=False)
        left.append(x[pair])
        right.append(y.filter(pa.array(pair)).to_numpy(zero_copy_only=False).astype(np.int64))
        own = own.filter(pa.array(~pair)).to_pylist()
        docs.append(np.repeat(x[~pair], [len(h) // 8 for h in own]))
        hashes.append(np.frombuffer(b"".join(own), np.int64))
    if not docs:
        return
    x, y = np.concatenate(left), np.concatenate(right)
    names, doc = np.unique(np.concatenate(docs), return_inverse=True)
    _, element = np.unique(np.concatenate(hashes), return_inverse=True)
    width = int(element.max(initial=0)) + 1
    keys = np.unique(doc * width + element)
    starts = np.searchsorted(keys // width, np.arange(len(names) + 1))
    n, i, j = np.diff(starts), np.searchsorted(names, x), np.searchsorted(names, y)
    c = common(keys, starts, width, i, j)
    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(c / (n[i] + n[j] - c))], names=["x", "y", "shared"])


def shared_text(texts: DataFrame, least: float, size: int = 5) -> DataFrame:
    """Pairs of texts (rel, words) of different rel whose runs of `size` words overlap (Jaccard) by `least` or more: a, b, shared; a < b, each once.

    The hashes of runs are divided into parts. A pair overlaps by `least` in one part at least, as it could not in all of them together else; so each part finds its pairs
    by itself, and the pairs found are counted over all parts. Of several texts of one rel the one whose words have the smallest hash counts.
    """
    spark = texts.sparkSession
    parallel = default_parallelism(spark)
    parts = max(MIN_PARTS, parallel)
    # the same hash for the same text in every run
    named = texts.select("rel", F.xxhash64("words").alias("version"), "words").withColumn("doc", F.xxhash64("rel", "version")).select("rel", "version", "doc", "words")
    rows = named.mapInArrow(_parts_of(parts, size), "part int, docs binary, n binary, hashes binary, rels array<string>")
    # shuffled once, read twice
    rows = detached(rows.repartitionById(parts, F.col("part")))
    found = checkpoint(rows.mapInArrow(_near_in_part(least), "x long, y long, rel string, version long").distinct())
    docs = found.where(F.col("y").isNull()).groupBy("rel").agg(F.min(F.struct("version", "x")).alias("t")).select("rel", F.col("t.x").alias("x"))
    docs = checkpoint(docs)
    pairs = found.where(F.col("y").isNotNull()).select("x", "y")
    for c in ("x", "y"):  # only texts that count
        pairs = pairs.join(docs.select(F.col("x").alias(c)), c, "left_semi")
    pairs = checkpoint(pairs)
    # pairs meet where the smallest neighbour of their first text names the place, the same for all pairs of texts that are all alike, so that lists seldom travel twice
    place = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).groupBy("x").agg(F.min("y").alias("place")).select("x", F.least("x", "place").alias("place"))
    pairs = checkpoint(pairs.join(place, "x").select("place", "x", "y"))
    wanted = checkpoint(pairs.select("place", F.explode(F.array("x", "y")).alias("doc")).distinct())
    lists = rows.mapInArrow(_lists, "doc long, hashes binary")
    lists = lists.join(F.broadcast(wanted) if is_small(wanted, SMALL_KEYS) else wanted, "doc").select("place", F.col("doc").alias("x"), F.lit(None).cast("long").alias("y"), "hashes")
    both = lists.unionByName(pairs.withColumn("hashes", F.lit(None).cast("binary"))).repartition(parallel, "place").drop("place")
    counted = both.mapInArrow(_count, "x long, y long, shared double").where(F.col("shared") >= least)
    rels = counted.join(docs.select("x", F.col("rel").alias("ra")), "x").join(docs.select(F.col("x").alias("y"), F.col("rel").alias("rb")), "y")
    return rels.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "shared")
