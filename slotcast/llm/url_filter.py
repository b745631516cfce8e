"""URL filter: host and path rules, then a block list behind a blocked Bloom filter.

A Bloom filter of blocks of four 64-bit words holds the canonical URLs of the block
list; a URL sets one bit in each word of one block.  The filter grows with the list, so
it always passes few URLs that are not listed (about 1 in 400).  Up to
``BROADCAST_BLOCKS`` blocks it is broadcast; beyond, URLs and blocks are joined by block
number.  URLs that pass go to an exact hash join with the list, which removes the false
positives; the others take no part in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_counted, stored

WORDS = 4
URLS_PER_BLOCK = 16
BROADCAST_BLOCKS = 1 << 18
#: (action, host, path)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Query parameters that do not change the page.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def host_of(url: Column) -> Column:
    """Lower case (A-Z); empty for null and where there is no ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host/path?query without scheme, www., tracking parameters, fragment and last slash."""
    host = F.regexp_replace(host_of(url), "^www[.]|:(?:80|443)$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*[?]([^#]*)", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike(f"^(?:{TRACKING})(?:=|$)"))), "&")
    path = F.rtrim(path_of(url), F.lit("/"))
    return F.when(host_of(url) == "", F.lit(None)).otherwise(F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def rule_of(host: Column, path: Column, rules: list = RULES) -> tuple[Column, Column]:
    """(rule text, action) of the longest rule that fits; null where none does."""
    ordered = sorted(rules, key=lambda r: (len(r[1] + r[2]), r))
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in ordered:  # a longer rule stands further out
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(action)
    return name, action


def _bits(key: Column) -> list[Column]:
    """For each word of the block, the bit that the key sets."""
    h = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.pmod(F.shiftrightunsigned(h, 6 * i), F.lit(64)).cast("int")) for i in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """One row for each block that is not empty: its number and its words."""
    rows = listed.select(_block(F.col("key"), blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def probed(urls: DataFrame, keys: DataFrame, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """``urls`` with the boolean ``maybe`` added: false only if the column ``key`` is not among ``keys`` (distinct)."""
    blocks = max(1, -(-keys.count() // URLS_PER_BLOCK))
    words = bloom_filter(keys, blocks)
    if blocks <= broadcast_blocks:  # at most so many rows of five numbers
        words = F.broadcast(words)
    none = F.lit(-1) - F.pmod(F.xxhash64("page_id"), F.lit(1 << 16)).cast("int")  # null keys meet no block, and not all in one place
    both = urls.withColumn("block", F.coalesce(_block(F.col("key"), blocks), none)).join(words, "block", "left")
    passes = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"w{i}").bitwiseAND(b) == b, F.lit(False)) for i, b in enumerate(_bits(F.col("key")))])
    return both.withColumn("maybe", passes & F.col("key").isNotNull()).drop("block", *[f"w{i}" for i in range(WORDS)])


def on_list(urls: DataFrame, listed: DataFrame, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """``urls`` (page_id, key and more) with the boolean ``listed`` added: the column ``key`` is in ``listed.key``.

    Null keys are never listed; repeated rows of either side do not multiply; long keys
    are like any other.
    """
    keys = stored(listed.select("key").where("key is not null").distinct(), "listed")
    rows = stored(probed(urls, keys, broadcast_blocks), "probed")
    exact = rows.where("maybe").join(keys.withColumn("hit", F.lit(True)), "key", "left")
    found = exact.withColumn("listed", F.coalesce("hit", F.lit(False))).drop("hit", "maybe")
    return found.unionByName(rows.where("not maybe").drop("maybe").withColumn("listed", F.lit(False)))


def judge(pages: DataFrame, listed: DataFrame, rules: list = RULES, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict and listed for every row of ``pages``.

    The longest rule that fits decides; where none fits, a URL is blocked if its
    canonical form is that of a row of ``listed`` (column ``url``).  Null and broken
    URLs have empty host and path, no rule, and are allowed; repeated rows stay; an empty
    table or list gives what the rules alone give; other columns are ignored.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key"))
    seen = on_list(rows, listed.select(canonical(F.col("url")).alias("key")))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow"))
    return seen.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "listed")


def mirrored(pages: DataFrame, story: Column, url_col: str = "url") -> DataFrame:
    """(url) of the pages whose ``story`` stands on at least two hosts: a list made from other rows than the one judged.

    Stories are compared by a digest; null and empty ones are on no list.
    """
    rows = pages.where(F.length(story) > 0).select(F.col(url_col).alias("url"), F.sha2(story, 256).alias("digest"), host_of(F.col(url_col)).alias("host"))
    rows = stored(rows, "stories")
    hosts = rows.groupBy("digest").agg(F.min("host").alias("a"), F.max("host").alias("b"), F.count("*").alias("n")).where("a <> b")
    return join_counted(rows, stored(hosts.select("digest", "n"), "mirrored"), "digest", rows.count()).select("url")
