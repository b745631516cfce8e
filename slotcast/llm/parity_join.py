"""Jaccard join of shingle sets by parity sketches.

The tokens of a set are its distinct three-word shingles as 64-bit hashes.  A parity
sketch is a row of 64-bit words: every token flips one bit.  A token that two sets
share flips the same bit in both, so the Hamming distance of two sketches is at most
the size of the sets' symmetric difference.

Sizes are cut into levels such that a set and its partners lie in one level or in
neighbouring ones; a band is two neighbouring levels.  In a band of sizes up to N two
sets that link differ in at most D = 2 N (100 - p) / (100 + p) tokens, hence in at most
D bits.  A sketch of D // 2 + 1 parts of three words has a part with at most one
differing bit, of whose words two agree: the pairs of words of each part are the join
keys, so every linked pair meets under a key of its band.

Equal sets are one set from then on.  Sets under one key are not paired with each other:
each is compared with the key's first set, links are joined to classes, and only keys
over several classes are searched in full, in blocks of a bounded size, where a sketch
of fixed size drops most pairs.  What is left is verified on the whole sets.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, join_counted, stored
from .near_dup import components

WIDTH = 3
PERCENT = 90
SEED = 42
#: Words of 64 bits in the sketch of fixed size.
SMALL = 8
#: Members of a key compared at a time in a full search.
BLOCK = 512


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one UTF-8 text."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    runs = {b" ".join(words)} if len(words) < width else set(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in runs), np.uint64, len(runs)))


@cache
def levels(percent: int = PERCENT) -> list[int]:
    """Smallest size of each level; a partner of a set is at most one level away."""
    out = [1, 2]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, (out[-1] - 1) * 100 // percent + 1))
    return out


def most_differing(size_a: int, size_b: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of two linked sets of these sizes."""
    return (size_a + size_b) * (100 - percent) // (100 + percent)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def parity_sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` numbers of 64 bits, in each of which the tokens dealt to it flip one bit each.

    ``hashes`` are sorted, so the tokens of one word are neighbours.
    """
    out = np.zeros(words, np.uint64)
    if len(hashes):
        word = ((hashes >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[starts].astype(np.int64)] = np.bitwise_xor.reduceat(np.uint64(1) << (hashes & np.uint64(63)), starts)
    return out


def band_keys(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The join keys of a set in the two bands that its level lies in."""
    sizes = levels(percent)
    level = bisect_right(sizes, len(hashes)) - 1
    out = []
    for band in (level - 1, level):
        most = most_differing(sizes[band + 2] - 1, sizes[band + 2] - 1, percent) if band >= 0 else 0
        if not most:  # only equal sets link
            continue
        parts = most // 2 + 1
        words = parity_sketch(hashes, 3 * parts).reshape(parts, 3)
        part = np.arange(parts, dtype=np.uint64)
        for way, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
            place = _mixed((part << np.uint64(24)) + np.uint64(4 * band + way + 1))
            out.append(_mixed(_mixed(words[:, i] ^ place) + words[:, j]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


_SETS = "doc_id long, tid long, n_shingles long, digest binary, sketch array<long>, keys array<long>"


def _longs(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(flat.view(np.int64)))


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _sets(percent: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t.as_py()) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tid"), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_digest, sets), pa.binary()),
                     _longs([parity_sketch(s, SMALL) for s in sets]), _longs([band_keys(s, percent) if len(s) else s for s in sets])],
                    ["doc_id", "tid", "n_shingles", "digest", "sketch", "keys"],
                )

    return run


def set_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, tid (a hash of the text), n_shingles, digest (of the set), sketch and keys of every row."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tid"), text.cast("binary").alias("text")).mapInArrow(_sets(percent), _SETS)


def _near(percent: int, n_a: Column, n_b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """Whether sizes and sketches leave it open that two sets link."""
    bits = F.aggregate(F.zip_with(sketch_a, sketch_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (bits * (100 + percent) <= (n_a + n_b) * (100 - percent))


def _hashes(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingles(t.as_py()) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(map(_digest, sets), pa.binary()), _longs(sets)], ["digest", "hashes"])


def _verified(pairs: DataFrame, known: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of digests that link; only the texts that the sketches leave open are read again."""
    slim = known.select("digest", "n_shingles", "sketch")
    sides = [slim.select(F.col("digest").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]
    open_ = pairs.join(sides[0], "a").join(sides[1], "b")
    open_ = stored(open_.where(_near(percent, *map(F.col, ("n_a", "n_b", "sketch_a", "sketch_b")))).select("a", "b", "n_a", "n_b"), "open")
    wanted = open_.select(F.col("a").alias("digest")).union(open_.select("b")).distinct()
    wanted = stored(known.join(wanted, "digest", "left_semi").select("tid", "digest"), "wanted")
    texts = docs.join(beside(wanted.select("tid").distinct()), "tid", "left_semi").groupBy("tid", F.xxhash64(F.lit(1), "text")).agg(F.first("text").alias("text"))
    sets = texts.select("text").mapInArrow(_hashes, "digest binary, hashes array<long>").join(wanted.select("digest"), "digest", "left_semi")
    sets = stored(sets.groupBy("digest").agg(F.first("hashes").alias("hashes")), "hashes")
    both = open_.join(sets.withColumnsRenamed({"digest": "a", "hashes": "hashes_a"}), "a").join(sets.withColumnsRenamed({"digest": "b", "hashes": "hashes_b"}), "b")
    common = F.size(F.array_intersect("hashes_a", "hashes_b"))
    return both.where(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def _across(percent: int):
    """Pairs of different classes that the sketches leave open, within each block of a key or between two."""

    def run(batches):
        for batch in batches:
            first, second = [], []
            for left, right in zip(batch.column("left"), batch.column("right")):
                left, right = left.as_py() or [], right.as_py()
                other = right or left
                if not left:
                    continue
                sizes, masks, roots = _arrays(other)
                for i, x in enumerate(left):
                    n = x["n_shingles"]
                    bits = np.bitwise_count(masks ^ np.array(x["sketch"], np.int64).view(np.uint64)).sum(axis=1, dtype=np.int64)
                    close = (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)) & (bits * (100 + percent) <= (sizes + n) * (100 - percent))
                    close &= roots != x["root"]
                    if right is None:
                        close[: i + 1] = False
                    for j in np.flatnonzero(close):
                        pair = sorted((x["digest"], other[j]["digest"]))
                        first.append(pair[0])
                        second.append(pair[1])
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.binary()), pa.array(second, pa.binary())], ["a", "b"])

    return run


def _arrays(rows: list[dict]) -> tuple:
    masks = np.array([r["sketch"] for r in rows], np.int64).view(np.uint64)
    return np.array([r["n_shingles"] for r in rows], np.int64), masks, np.array([r["root"] for r in rows], object)


def _crossing(members: DataFrame, roots: DataFrame, known: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs (a, b) under keys that hold several classes, of different classes, that may link."""
    rooted = members.select("key", "digest").join(roots, members["digest"] == roots["node"], "left").select("key", "digest", F.coalesce("root", "digest").alias("root"))
    rooted = stored(rooted, "rooted")
    mixed = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = rooted.join(mixed.select("key", blocks.alias("blocks")), "key").join(known.select("digest", "n_shingles", "sketch"), "digest")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    # each block meets itself and every later one: a member goes to the groups of its block and any other
    dealt = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = F.struct("digest", "root", "n_shingles", "sketch")
    low, high = F.least("own", "with"), F.greatest("own", "with")
    groups = dealt.groupBy("key", low.alias("low"), high.alias("high")).agg(
        F.collect_list(F.when(F.col("own") == low, member)).alias("left"), F.collect_list(F.when((F.col("own") == high) & (F.col("own") != low), member)).alias("right")
    )
    groups = groups.select("left", F.when(F.col("low") != F.col("high"), F.col("right")).alias("right"))
    return groups.mapInArrow(_across(percent), "a binary, b binary").distinct()


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Returns doc_id, n_shingles and component_id for every row of ``docs``.

    Two rows link when the Jaccard coefficient of their sets is at least ``percent`` in a
    hundred; component_id is the smallest doc_id that links reach.  A text of fewer than
    three words, but not none, is one shingle.  Null texts and texts without words have no
    shingles and are linked with nothing, not even with each other.  Rows with null id
    are kept and link others, but name a class only if no member has an id; repeated rows
    stay repeated; an empty table gives an empty result; other columns are ignored.
    """
    rows = stored(set_table(docs, id_col, text_col, percent).withColumn("rid", F.monotonically_increasing_id()), "sets")
    full = rows.where("n_shingles > 0")
    known = full.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.min(F.struct("rid", "tid", "n_shingles", "sketch")).alias("one"))
    known = stored(known.select("digest", "first_id", "n", "one.*"), "known")
    texts = docs.select(F.xxhash64(text_col).alias("tid"), F.col(text_col).cast("binary").alias("text"))

    own = full.select("rid", "digest", "keys").join(beside(known.select("rid")), "rid", "left_semi").select(F.explode("keys").alias("key"), "digest")
    order = Window.partitionBy("key").orderBy("digest")
    own = own.select("key", "digest", F.first("digest").over(order).alias("hub"), F.lead("digest").over(order).alias("next"))
    members = stored(own.where("hub <> digest or next is not null").select("key", "digest", "hub"), "members")

    tried = stored(members.where("hub <> digest").select(F.col("hub").alias("a"), F.col("digest").alias("b")).distinct(), "tried")
    edges = stored(_verified(tried, known, texts, percent), "links")
    roots = stored(components(edges.toDF("u", "v")), "roots")
    more = stored(_crossing(members, roots, known, percent, block).join(tried, ["a", "b"], "left_anti"), "crossing")
    if not more.isEmpty():
        edges = edges.unionByName(_verified(more, known, texts, percent))
        roots = stored(components(edges.toDF("u", "v")), "roots")

    firsts = known.select(F.col("digest").alias("node"), "first_id")
    least = stored(roots.join(firsts, "node").groupBy("root").agg(F.min("first_id").alias("class_id"), F.count("*").alias("n")), "least")
    classes = join_counted(roots, least, "root", roots.count()).select(F.col("node").alias("digest"), "class_id")
    names = stored(known.select("digest", "n", "first_id").join(classes, "digest", "left").select("digest", "n", F.coalesce("class_id", "first_id").alias("component_id")), "names")
    linked = join_counted(full.select("doc_id", "n_shingles", "digest"), names, "digest", full.count())
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", "component_id").unionByName(alone)
