"""Benchmark decontamination by Wu-Manber search over words.

Symbols are words; a block is two words.  For every block the shift table says how
far the search may move on because no test string can end sooner; blocks that end a
test string (shift 0) select a bucket of test strings by their suffix, of which
those with the right first word are compared word by word.

The tables are sent to the tasks in shards of about ``max_patterns`` pairs of a test
string and an item that holds it, so what is broadcast has a bound however many items
share a string.  A larger benchmark is searched shard by shard: the texts are written once,
with a number for each row, and a pass writes only the numbers and places of its hits.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, beside, stored

WIDTH = 13
MAX_PATTERNS = 200_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: For UTF-8 bytes: A-Z to lower case, what is in no word to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each pattern (words joined by spaces) with each item_id, as a string, that holds it.

    An item of fewer than ``width`` words, but not none, is one window; items
    without words or id have none.  Repeated rows and windows count once.
    """
    words = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0))
    items = benchmark.select("item_id", words.alias("w")).where("size(w) > 0 and item_id is not null")
    each = items.select(
        "item_id",
        F.explode(
            F.expr(f"transform(sequence(1, greatest(size(w) - {width} + 1, 1)), i -> array_join(slice(w, i, {width}), ' '))")
        ).alias("pattern"),
    )
    return each.select("pattern", F.col("item_id").cast("string").alias("item_id")).distinct()


class WuManber:
    """Search tables for word sequences; ``find`` gives the covered words and the owners."""

    def __init__(self, patterns: list[tuple[bytes, list[str]]]):
        by_length = defaultdict(list)
        for pattern, owners in patterns:
            words = tuple(pattern.split(b" "))
            by_length[len(words)].append((words, owners))
        self.tables = [self._table(m, rows) for m, rows in sorted(by_length.items())]

    @staticmethod
    def _table(m: int, rows: list) -> tuple:
        size = min(2, m)
        shift: dict = {}
        bucket = defaultdict(list)
        for words, owners in rows:
            for end in range(size, m + 1):
                block = words[end - size : end]
                block = block[0] if size == 1 else block
                if m - end < shift.get(block, m):
                    shift[block] = m - end
            bucket[block].append((words[0], list(words), owners))
        return m, size, m - size + 1, shift, dict(bucket)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words, in order of their ends for each length, and the owners."""
        spans, found = [], set()
        n = len(words)
        for m, size, most, shift, bucket in self.tables:
            at = m - 1
            while at < n:
                block = words[at] if size == 1 else (words[at - 1], words[at])
                step = shift.get(block, most)
                if step:
                    at += step
                    continue
                start = at - m + 1
                first = words[start]
                part = None
                for head, pattern, owners in bucket[block]:
                    if head == first:
                        part = part or words[start : at + 1]
                        if part == pattern:
                            spans.append((start, at + 1))
                            found.update(owners)
                at += 1
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as disjoint spans in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


_FOUND = "n_words long, starts array<int>, ends array<int>, items array<string>"


def _search(tables) -> Column:
    @F.pandas_udf(_FOUND)
    def search(texts: pd.Series) -> pd.DataFrame:
        rows = []
        finder = tables.value
        for text in texts:
            words = words_of(text)
            spans, items = finder.find(words)
            spans = merged(spans)
            rows.append((len(words), [s for s, _ in spans], [e for _, e in spans], sorted(items)))
        return pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])

    return search(F.col("text").cast("binary"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """``docs`` with a struct ``found``: n_words, hits (start and end in words, disjoint, sorted), items.

    A word inside any occurrence of a window of ``benchmark`` is hit.  Null and empty
    texts have no words; a benchmark without windows hits nothing; repeated rows are
    searched as they are; other columns pass through (a column called ``found`` is
    replaced).
    """
    spark = docs.sparkSession
    listed = stored(windows(benchmark, width), "windows")
    shards = max(1, -(-listed.count() // max_patterns))
    listed = listed.groupBy(F.expr(f"pmod(xxhash64(pattern, item_id), {shards})").alias("shard"), "pattern").agg(F.collect_set("item_id").alias("items"))
    docs = docs.drop("found")

    def tables(shard: int):
        rows = listed.where(F.col("shard") == shard).select("pattern", "items").collect()
        return spark.sparkContext.broadcast(WuManber([(r["pattern"].encode(), r["items"]) for r in rows]))

    if shards == 1:
        docs = docs.withColumn("found", _search(tables(0)))
        spans = F.array_sort(F.arrays_zip("found.starts", "found.ends"))
        return docs.withColumn("found", F.struct(F.col("found.n_words").alias("n_words"), spans.alias("hits"), F.array_sort("found.items").alias("items")))
    docs = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    hits = []
    for shard in range(shards):
        sent = tables(shard)
        found = docs.select("_row", _search(sent).alias("f")).select("_row", "f.*")
        hits.append(stored(found if shard == 0 else found.where(F.size("starts") > 0), "hits"))  # the first pass counts the words of all
        sent.unpersist()
    spans = F.arrays_zip("starts", "ends")
    more = reduce(DataFrame.unionByName, hits).groupBy("_row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list(spans)).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
    more = more.select("_row", F.struct("n_words", F.array_sort("hits").alias("hits"), F.array_sort(F.array_distinct("items")).alias("items")).alias("found"))
    return docs.join(beside(stored(more, "places")), "_row").drop("_row")


def hit_words(hits: str = "found.hits") -> Column:
    """Words in the union of sorted spans (those of several shards may overlap)."""
    zero = "named_struct('n', 0L, 'upto', 0)"
    step = "named_struct('n', a.n + greatest(0, h.ends - greatest(h.starts, a.upto)), 'upto', greatest(a.upto, h.ends))"
    return F.expr(f"aggregate({hits}, {zero}, (a, h) -> {step}, a -> a.n)")


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20, **options) -> DataFrame:
    """``docs`` with n_words, n_hit, items and contaminated added.

    A document is contaminated if it has hit words and they are at least one in
    ``share`` of its words.  See :func:`find_contamination` for the other cases.
    """
    found = find_contamination(docs.drop("n_words", "n_hit", "items", "contaminated"), benchmark, **options)
    found = found.withColumn("n_words", F.col("found.n_words")).withColumn("n_hit", hit_words()).withColumn("items", F.col("found.items"))
    return found.drop("found").withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated rows, with the same columns."""
    marked = contamination(docs.select(F.struct("*").alias("row"), "text"), benchmark, **options)
    return marked.where(~F.col("contaminated")).select("row.*")
