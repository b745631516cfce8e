"""Delta-maintained token counts by source, language and tokenizer version.

A change is a signed row: an insert adds a document's count, a delete takes it away,
a revision adds the difference.  A batch of changes is summed by key and added to the
totals of the version before; the sum is the next version of the totals table.  Totals
never need the documents or the earlier batches again, and reading them takes one small
table however many batches there were.  A batch id that is committed already changes
nothing.

A version is committed by one file in the log, moved into place only where none is yet.
Of two writers of one version one wins; the other begins again on the winner's totals.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from urllib.parse import quote

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
TOKENIZERS = "/opt/tokenizers"
_encoders: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a byte-pair vocabulary and their numbers."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(path: str, pattern: str):
    """One encoder for each Python worker and pattern."""
    if (path, pattern) not in _encoders:
        import tiktoken

        _encoders[path, pattern] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _encoders[path, pattern]


#: Fixed value: the public byte-pair vocabularies' pattern for splitting a text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: White space as the pattern knows it (Unicode's property, which has no separators below 0x20), in runs too long for its look-ahead.
LONG_RUN = 50_000
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG = re.compile(f"[{_SPACE}]{{{LONG_RUN},}}")


def encode_whole(text: str, encode, encode_space, stops: tuple[str, ...] = ()) -> list[int]:
    """Tokens of a text whose runs of white space may have any length.

    The pattern looks back from the end of a run one character at a time, which ends in
    an error on very long ones.  Of such a run, all but the last character (or all, at
    the end of the text and before one of ``stops``) is one piece of its own to the
    pattern, so it is encoded apart with a pattern that does not look back.
    """
    found = [(m.start(), m.end()) for m in _LONG.finditer(text)]
    if not found:
        return encode(text)
    out: list[int] = []
    at = 0
    for start, end in found:
        last = end if end == len(text) or text.startswith(stops, end) and stops else end - 1
        out += encode(text[at:start]) + encode_space(text[start:last])
        at = last
    return out + encode(text[at:])


def count_tokens(text: Column, version: str, folder: str = TOKENIZERS) -> Column:
    """Tokens of each whole text under ``folder``/``version``.tiktoken; 0 for null."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        path = f"{folder}/{version}.tiktoken"
        encode, spaces = _encoder(path, PATTERN).encode_ordinary, _encoder(path, r"\s+").encode_ordinary
        return pd.Series([len(encode_whole(t, encode, spaces)) if t else 0 for t in texts], dtype="int64")

    return count(text)


COUNTS = ["n_docs", "n_tokens"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Older versions of the totals that are kept for readers who have them open.
KEEP_VERSIONS = 8


def _summed(changes: DataFrame) -> DataFrame:
    """Counts by key; null counts are 0, null keys are a key of their own."""
    return changes.groupBy(*KEYS).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in COUNTS])


class TokenRollup:
    """A maintained totals table in a folder that Spark reads and writes.

    ``totals/NAME`` holds a version of the totals, ``log/N`` says which is version N and
    which batch made it, ``done/ID`` marks a committed batch.  The log file is the
    commit; its marker is set after it, at the latest by the next writer.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.path, *parts]))

    @staticmethod
    def _marker(batch_id: str) -> str:
        """A file name for any id: what is no letter or digit is escaped, dots as well."""
        return "id-" + quote(batch_id, safe="").replace(".", "%2E")

    def _log(self, version: int) -> str:
        return f"{version:012d}"

    def _read(self, *parts: str) -> str:
        stream = self._fs.open(self._path(*parts))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, text: str, overwrite: bool, *parts: str) -> bool:
        """Writes a small file whole: beside its place, then moved there.  False if it is there already and must stay."""
        jvm = self.spark._jvm
        beside = self._path("tmp", uuid.uuid4().hex)
        stream = self._fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.mkdirs(self._path(*parts[:-1]))
        how = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        how[0] = self._hadoop.Options.Rename.OVERWRITE if overwrite else self._hadoop.Options.Rename.NONE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri() if beside.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(beside, self._path(*parts), how)
            return True
        except Py4JJavaError as e:
            self._fs.delete(beside, False)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass()):
                return False
            raise

    def _last(self) -> tuple[int, dict | None]:
        """The newest version and its log entry; 0 and None in an empty store.

        A pointer says where to begin; it may lag behind, never ahead.
        """
        version = int(self._read("latest")) if self._fs.exists(self._path("latest")) else 0
        while self._fs.exists(self._path("log", self._log(version + 1))):
            version += 1
        return version, json.loads(self._read("log", self._log(version))) if version else None

    def committed(self, batch_id: str) -> bool:
        _, entry = self._last()
        return (entry is not None and entry["batch"] == batch_id) or self._fs.exists(self._path("done", self._marker(batch_id)))

    def publish(self, version: int, batch_id: str, table: str) -> bool:
        """Makes ``totals/table`` version ``version``; False if another writer was first."""
        return self._write(json.dumps({"version": version, "batch": batch_id, "table": table}), False, "log", self._log(version))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds signed changes (source, lang, tokenizer, n_docs, n_tokens) as one batch.

        Returns False, and changes nothing, if the batch is committed already, by this
        or another writer.  A commit that broke off has no log entry and leaves the
        totals as they were; the next try begins anew.  Rows may repeat (each counts), an
        empty batch is committed too, other columns are ignored.
        """
        delta = None
        while True:
            version, entry = self._last()
            if entry is not None:  # the marker of the newest version may be missing, those of older ones are not
                self._write(str(version), True, "done", self._marker(entry["batch"]))
            if self._fs.exists(self._path("done", self._marker(batch_id))):
                return False
            if delta is None:  # summed once, whatever the number of tries
                delta = f"{self.path}/tmp/{uuid.uuid4().hex}"
                _summed(changes).write.parquet(delta)
            name = uuid.uuid4().hex
            both = self.spark.read.schema(SCHEMA).parquet(delta).unionByName(self._table(entry))
            _summed(both).where("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{self.path}/totals/{name}")
            if self.publish(version + 1, batch_id, name):
                break
            self._fs.delete(self._path("totals", name), True)
        self._write(str(version + 1), True, "done", self._marker(batch_id))
        self._write(str(version + 1), True, "latest")
        self._fs.delete(self._hadoop.Path(delta), True)
        old = version + 1 - KEEP_VERSIONS
        if old > 0:
            self._fs.delete(self._path("totals", json.loads(self._read("log", self._log(old)))["table"]), True)
        return True

    def _table(self, entry: dict | None) -> DataFrame:
        if entry is None:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/totals/{entry['table']}")

    def totals(self) -> DataFrame:
        """The totals after the newest batch; keys whose sums are all zero are left out."""
        return self._table(self._last()[1])

    def batches(self) -> DataFrame:
        """(version, batch) of every committed batch."""
        log = self.spark.createDataFrame([], "version long, batch string, table string")
        if self._last()[0]:
            log = self.spark.read.schema(log.schema).json(f"{self.path}/log")
        return log.select("version", "batch")


def inserts(counted: DataFrame) -> DataFrame:
    """Changes that add documents: (source, lang, tokenizer, n_tokens) of each."""
    return counted.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens")


def deletes(counted: DataFrame) -> DataFrame:
    """Changes that take documents away, with the counts they were added with."""
    return counted.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(counted: DataFrame) -> DataFrame:
    """Changes of documents that stay, from ``n_tokens`` to ``n_tokens_new``."""
    more = F.coalesce("n_tokens_new", F.lit(0)) - F.coalesce("n_tokens", F.lit(0))
    return counted.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), more.alias("n_tokens"))


def moves(counted: DataFrame) -> DataFrame:
    """Changes of documents whose keys change as well, to ``source_new``, ``lang_new``, ``tokenizer_new`` and ``n_tokens_new``."""
    there = counted.select(*[F.col(f"{k}_new").alias(k) for k in KEYS], F.col("n_tokens_new").alias("n_tokens"))
    return deletes(counted).unionByName(inserts(there))
