"""SimHash near-duplicate classes by pigeonhole blocks.

A fingerprint of 64 bits is split into five blocks.  Two fingerprints that differ
in at most three bits agree on at least two blocks, so each of the ten pairs of
blocks is a join key of 25 or 26 bits, and every close pair meets under one of
them.  Copies have one fingerprint and are joined once.

A key that many different fingerprints share is dealt anew: the bits that the key
leaves open are split into five blocks again (up to three bits may differ there,
so the same argument holds).  After two such rounds a key leaves at most 14 bits
open, so a group has at most 2**14 fingerprints whatever the input.  Within a
group, members are compared and only a spanning star of each class is emitted, not
all pairs.  The stars are joined to classes by alternating large and small stars.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, join_counted, stored

MAX_BITS = 3
BLOCKS = 5
LEVELS = 3
HOT = 2048
SEED = 42


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of one UTF-8 text as an unsigned number; no words: 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``fp``, the fingerprint as a signed long.

    Words are split at ASCII white space, A-Z are lower-cased, and each run of
    three words counts as often as it occurs.  A null text counts as empty.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(_fingerprints, "long")(F.col(text_col).cast("binary")).alias("fp"))


def _split(bits: tuple[int, ...]) -> list[tuple[int, ...]]:
    parts = [tuple(int(b) for b in p) for p in np.array_split(np.array(bits), BLOCKS)]
    return [a + b for a, b in combinations(parts, 2)]


def block_masks(levels: int = LEVELS) -> list[list[int]]:
    """For each level, the bits that the key number ``path`` compares, as signed longs."""
    fixed: list[tuple[int, ...]] = [()]
    out = []
    for _ in range(levels):
        fixed = [done + more for done in fixed for more in _split(tuple(b for b in range(64) if b not in done))]
        out.append([int(np.uint64(sum(1 << b for b in f)).view(np.int64)) for f in fixed])
    return out


def _keyed(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Ten keys for each row; ``path`` numbers the blocks compared so far."""
    ways = len(list(combinations(range(BLOCKS), 2)))
    table = F.array(*[F.lit(m) for m in masks])
    return (
        rows.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
        .select((F.col("path") * ways + F.col("way")).cast("int").alias("path"), "fp")
        .withColumn("part", F.col("fp").bitwiseAND(F.element_at(table, F.col("path") + 1)))
    )


def _stars(batches):
    """(fp, hub) for the members of each class within each group of fingerprints."""
    for batch in batches:
        fps, hubs = [], []
        for group in batch.column("fps").to_pylist():
            left = np.array(group, np.int64).view(np.uint64)
            while len(left) > 1:
                hub, left = left[0], left[1:]
                todo = [hub]
                while todo and len(left):
                    near = np.bitwise_count(left ^ todo.pop()) <= MAX_BITS
                    if near.any():
                        hit = left[near]
                        left = left[~near]
                        todo.extend(hit)
                        fps.append(hit.view(np.int64))
                        hubs.append(np.full(len(hit), hub).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in (fps, hubs)], ["u", "v"]
        )


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (u, v) that join every class of the distinct fingerprints in ``fp``.

    Each pair of at most three differing bits lies in one class of the edges.
    """
    rows = distinct.select(F.lit(0).alias("path"), "fp")
    found = []
    levels = block_masks()
    for level, masks in enumerate(levels):
        keyed = _keyed(rows, masks)
        rows = None
        if level + 1 < len(levels):
            crowded = stored(keyed.groupBy("path", "part").count().where(F.col("count") > hot).select("path", "part"), "crowded")
            if not crowded.isEmpty():
                rows = stored(keyed.join(crowded, ["path", "part"], "left_semi").select("path", "fp"), "redealt")
                keyed = keyed.join(crowded, ["path", "part"], "left_anti")
        groups = keyed.groupBy("path", "part").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        found.append(groups.select("fps").mapInArrow(_stars, "u long, v long"))
        if rows is None:
            break
    return reduce(DataFrame.unionByName, found).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (u, v): the smallest node of its class.

    Large and small stars alternate until the edges are stars around the smallest
    node.  Every round is written to the shared folder.
    """
    edges = stored(edges.where("u <> v").select("u", "v"), "edges")
    before = None
    while (now := _state(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        large = join_counted(both, least, "u", 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = join_counted(large, least, "u", large.count()).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, fp, root (a fingerprint that names the class) and component_id for every row of ``docs``."""
    marked = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    first = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "first")
    roots = stored(components(links(first.select("fp"), hot)), "roots")
    known = roots.join(first.drop("n"), roots["node"] == first["fp"])
    least = stored(known.groupBy("root").agg(F.min("first_id").alias("class_id"), F.count("*").alias("n")), "least")
    classes = join_counted(roots, least, "root", roots.count()).select(F.col("node").alias("fp"), "root", "class_id")
    named = first.join(classes, "fp", "left")
    names = stored(named.select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("class_id", "first_id").alias("component_id")), "names")
    return join_counted(marked, names, "fp", marked.count()).select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Returns doc_id, fp (signed long) and component_id for every row of ``docs``.

    component_id is the smallest doc_id that links of at most three bits reach.
    Null and empty texts have fingerprint 0 and are linked like any other; null ids
    are kept as rows and never name a class; repeated rows stay repeated; an empty
    table gives an empty result; other columns are ignored.
    """
    return _classes(docs, id_col, text_col, hot).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest (doc_id, fingerprint).

    A doc_id that occurs over several texts keeps one row of each class that it stands
    for, and where rows agree in id and fingerprint the one of the smallest text, then
    of the smallest other columns (as JSON), stays.  Rows without doc_id stay.  Texts
    are not shuffled but those of repeated ids: what is dropped is a list of ids, which
    is sent to the tasks if it is short.
    """
    found = stored(_classes(docs, hot=hot).where("doc_id is not null"), "classes")
    best = stored(found.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("b")).select("b.*"), "best")
    by_id = found.groupBy("doc_id").agg(F.count("*").alias("rows")).join(best.select("doc_id").distinct().withColumn("won", F.lit(True)), "doc_id", "left")
    marks = stored(by_id.where("rows > 1 or won is null").select("doc_id", (F.col("rows") > 1) & F.col("won").isNotNull()).toDF("doc_id", "again"), "marks")
    known = docs.where("doc_id is not null")
    out = known.join(beside(marks.select("doc_id")), "doc_id", "left_anti").select(*docs.columns).unionByName(docs.where("doc_id is null"))
    again = marks.where("again").select("doc_id")
    if again.isEmpty():
        return out
    # ids of several rows: the rows are told apart by fingerprint
    rows = known.join(beside(again), "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    rows = rows.withColumn("fp", F.pandas_udf(_fingerprints, "long")(F.col("text").cast("binary")))
    won = stored(rows.join(best, ["doc_id", "fp"], "left_semi"), "again")
    one = won.groupBy("doc_id", "fp").agg(F.min_by("row", F.struct("text", F.to_json("row"))).alias("row"))
    return out.unionByName(one.select("row.*"))
