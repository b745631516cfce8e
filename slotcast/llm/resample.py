"""Importance resampling towards a target distribution, on hashed n-grams.

A document's weight is its mean log ratio of the target's to the source's share of each
n-gram's bucket; the sample is drawn without replacement by adding Gumbel noise to the
weights and keeping the highest scores.

Texts are counted in batches: the texts of a batch are joined with a separator that no
word contains, one regex pass finds all words, a binary search of their offsets says
which document each belongs to, n-grams that reach into the next document are masked,
and one ``bincount`` counts the rest.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import methodcaller

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SEPARATOR = b"\x00"
#: In bytes: digits, lower-case letters and all of a character beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xFF]+")
#: Bytes of texts joined at a time; a longer text is a batch of its own.
BATCH_BYTES = 1 << 21


@dataclass(frozen=True)
class Plan:
    """Longest n-gram, number of buckets, seed of the noise, words a drawn document needs, share drawn in a hundred."""

    order: int = 1
    buckets: int = 10_000
    seed: int = 2024
    least_words: int = 20
    percent: int = 10


def joined_batches(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of consecutive rows of about ``BATCH_BYTES``; null texts are empty."""
    group, size, first = [], 0, 0
    for i, t in enumerate(texts):
        t = t.as_py() or b""
        if group and size + len(t) > BATCH_BYTES:
            yield first, group
            group, size, first = [], 0, i
        group.append(t)
        size += len(t)
    if group:
        yield first, group


def features(texts: list[bytes], order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and document of every n-gram of up to ``order`` words, and the words of each document.

    N-grams keep to one document; their words are joined by one space.
    """
    joined = SEPARATOR.join(texts).lower()  # bytes: A-Z only
    starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    words, offsets = [], []
    for m in WORD.finditer(joined):
        words.append(m.group())
        offsets.append(m.start())
    owner = np.searchsorted(starts, np.array(offsets, np.int64), "right") - 1
    found, owners = [], []
    for k in range(1, order + 1):
        whole = owner[: len(owner) - k + 1] == owner[k - 1 :]
        grams = words if k == 1 else list(map(b" ".join, zip(*(words[i:] for i in range(k)))))
        code = np.fromiter(map(zlib.crc32, grams), np.uint32, len(grams)) % np.uint32(buckets)
        found.append(code[whole])
        owners.append(owner[: len(whole)][whole])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners), np.bincount(owner, minlength=len(texts))


def bucket_counts(docs: DataFrame, plan: Plan = Plan(), text_col: str = "text") -> DataFrame:
    """(bucket, n) of all n-grams of all texts; each task adds up its own before the shuffle."""

    def run(batches):
        total = np.zeros(plan.buckets, np.int64)
        for batch in batches:
            for _, texts in joined_batches(batch.column(0)):
                total += np.bincount(features(texts, plan.order, plan.buckets)[0], minlength=plan.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _totals(docs: DataFrame, plan: Plan, text_col: str) -> list[int]:
    """Counts of all buckets on the driver: ``plan.buckets`` numbers, whatever the input."""
    out = [0] * plan.buckets
    for bucket, n in bucket_counts(docs, plan, text_col).collect():
        out[bucket] = n
    return out


def gains(source: list[int], target: list[int], scale: int = 1000) -> list[int]:
    """Of each bucket, the log ratio of the smoothed shares, in floored thousandths."""
    all_s, all_t, buckets = sum(source), sum(target), len(source)
    return [math.floor(scale * math.log((t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets)))) for s, t in zip(source, target)]


def weights(docs: DataFrame, bucket_gains: list[int], plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean gain; without features 0) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(np.array(bucket_gains, np.int64))

    def run(batches):
        for batch in batches:
            parts = []
            for _, texts in joined_batches(batch.column("text")):
                bucket, owner, words = features(texts, plan.order, plan.buckets)
                n = np.bincount(owner, minlength=len(texts))
                total = np.bincount(owner, sent.value[bucket], minlength=len(texts)).astype(np.int64)  # whole numbers far below 2**53
                parts.append((words, n, total // np.maximum(n, 1)))
            words, n, weight = (np.concatenate(x) for x in zip(*parts)) if parts else [np.empty(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in floored thousandths, fixed by seed and id."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(name, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def with_rank(scored: DataFrame, most: int, by: str, key: str = "doc_id") -> DataFrame:
    """``scored`` with ``rank``: 1 to ``most`` by falling ``by``, ties to the smaller ``key``; null for all others and where ``by`` is null.

    Scores are whole numbers of a narrow range, so their histogram is small: it says how
    many rows come before those of each score, and only rows of one score are put in
    order together.  Equal rows are counted before and dealt out again after that.
    """
    above = Window.orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
    histogram = stored(scored.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("_n")), "histogram")
    base = histogram.select(by, F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above")).where(F.col("_above") < most)
    marked = scored.join(F.broadcast(base), by, "left")
    alike = marked.where("_above is not null").groupBy(*scored.columns, "_above").agg(F.count("*").alias("_n"))
    within = Window.partitionBy(by).orderBy(F.col(key).asc_nulls_last(), *[c for c in scored.columns if c not in (by, key)]).rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("_first", F.col("_above") + F.coalesce(F.sum("_n").over(within), F.lit(0)) + 1)
    placed = placed.withColumn("rank", F.explode(F.sequence("_first", F.col("_first") + F.col("_n") - 1)))
    drawn = placed.select(*scored.columns, F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))
    return drawn.unionByName(marked.where("_above is null").select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def importance_resample(docs: DataFrame, target: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; ``target`` has its texts in ``text_col`` too.

    Of the rows with enough words the share ``plan.percent`` with the highest scores is
    drawn and ranked from 1, ties to the smaller doc_id (null ids last); the others have
    no rank.  Null and empty texts have no features and weight 0.  Repeated rows have one
    score and successive ranks.  Ids must be whole numbers.  Empty tables give an empty
    result, and an empty target weighs all words alike but for their smoothing.  Other
    columns are ignored.
    """
    found = gains(_totals(docs, plan, text_col), _totals(target, plan, text_col))
    rows = weights(docs, found, plan, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("doc_id"), plan.seed))
    rows = stored(rows.withColumn("_by", F.when(F.col("n_words") >= plan.least_words, F.col("score"))), "scored")
    most = rows.where("_by is not null").count() * plan.percent // 100
    return with_rank(rows, most, "_by").drop("_by")
